"""Suffix-tree scores against a tree of dictionaries."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.llm import suffix_tree as st

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


class Tree:
    def __init__(self, texts, depth, least, cost):
        self.depth = depth
        self.words = Counter(t for x in texts for t in tokens(x))
        self.n, self.v = sum(self.words.values()), len(self.words)
        next_of = defaultdict(Counter)
        for x in texts:
            t = tokens(x)
            for i in range(len(t)):
                for k in range(1, min(depth, i) + 1):
                    next_of[tuple(t[i - k:i])][t[i]] += 1
        self.kept, self.once = {}, {}
        for context, c in next_of.items():
            n = sum(c.values())
            parent = next_of[context[1:]] if len(context) > 1 else self.words
            m = sum(parent.values())
            d = sum(x * math.log((x / n) / (parent[w] / m)) for w, x in c.items())
            if n >= least and d >= cost * len(c):
                self.kept[context] = c
                self.once[context] = ({w for w in c if parent[w] == 1} if len(context) > 1
                                      else set())

    def base(self, w):
        return (self.words[w] + 1) / (self.n + self.v + 1)

    def probability(self, before, w):
        p = self.base(w)
        for k in range(1, self.depth + 1):
            c = self.kept.get(tuple(before[-k:])) if len(before) >= k else None
            if c:
                once = self.once[tuple(before[-k:])]
                mine = 0 if w in once else c[w]
                p = (mine + (len(c) + len(once)) * p) / (sum(c.values()) + len(c))
        return p

    def score(self, text):
        t = tokens(text)
        return (len(t), sum(w in self.words for w in t), self.n,
                sum(math.log10(self.base(w)) for w in t),
                sum(math.log10(self.probability(t[max(0, i - self.depth):i], t[i]))
                    for i in range(len(t))))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(docs, got, tree):
    want = sorted(((repr(r.doc_id), *tree.score(r.text)) for r in docs.collect()),
                  key=lambda r: (r[0], r[1:4], round(r[5], 4)))
    rows = sorted(((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                   for r in got.collect()), key=lambda r: (r[0], r[1:4], round(r[5], 4)))
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in rows], [r[4:] for r in want], rtol=1e-9)


def train():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2,
                      F.lit(True))


@pytest.mark.parametrize("depth,least,chunk,target", [(3, 8, 2_000_000, 16 << 20),
                                                      (2, 3, 4000, 20_000)])
def test_scores(spark, some_docs, depth, least, chunk, target):
    docs = some_docs.repartition(4)
    got = st.score(docs, train(), depth=depth, least=least, chunk=chunk, target=target)
    tree = Tree([r.text for r in docs.collect() if not held(r.doc_id)], depth, least, st.COST)
    assert len(tree.kept) > 20
    check(docs, got, tree)


@pytest.mark.parametrize("chunk", [2_000_000, 700])
def test_scores_edges(spark, edge, no_docs, chunk):
    docs = edge.union(edge.where("doc_id = 7")).withColumn("train", edge.mark)
    got = st.score(docs, train(), least=2, cost=0.1, chunk=chunk)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check(docs, got, Tree([r.text for r in docs.collect() if not held(r.doc_id)], 3, 2, 0.1))
    assert st.score(no_docs, train()).collect() == []
    check(edge, st.score(edge, F.lit(None).cast("boolean")), Tree([], 3, 8, st.COST))


def test_split_contexts(spark):
    """One context with nearly all tokens is counted in many tasks."""
    docs = spark.createDataFrame([(i, " ".join(f"a w{(i * 31 + j * j) % 300}" for j in range(200)))
                                  for i in range(60)], "doc_id long, text string")
    got = st.score(docs, F.lit(True), least=4, chunk=3000)
    check(docs, got, Tree([r.text for r in docs.collect()], 3, 4, st.COST))


def test_levels_leave_no_shuffle_files(spark, some_docs):
    """What a level has shuffled isn't kept for the levels behind it."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            disk.getAllFiles())
        return {f.getName(): f.length() for f in list(files) if f.getName().startswith("shuffle_")}

    def left():
        return sum(size for name, size in shuffled().items() if name not in before)

    before, settings = shuffled(), spark.conf.getAll
    got = st.score(some_docs, train(), chunk=20_000)
    assert spark.conf.getAll == settings
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of pieces of texts; answers are where their chunks are
    until = time.monotonic() + 10
    while left() > 10_000 and time.monotonic() < until:
        time.sleep(0.2)
    assert left() <= 10_000  # of sums with one row per task
    assert got.count() == some_docs.count()


def test_packed_chunk():
    """Tokens are packed by frequency: frequent words take few bytes wherever their hashes lie."""
    r = np.random.default_rng(0)
    u = np.unique(r.integers(0, 1 << 63, 60_000).astype(np.uint64))
    inv = r.permutation(len(u))[np.minimum(r.zipf(1.3, 200_000), len(u)) - 1]
    one = [np.array([x], np.int64) for x in (5, 7, len(inv), 0)]
    body = st.Chunk(*one, np.array([1], np.uint8), u, inv).pack()
    back = st.Chunk.unpack(body)
    assert (back.u == u).all() and (back.inv == inv).all() and back.learn.all()
    plain = st.pack(*one, np.array([1], np.uint8), st._steps(u), inv.astype(np.int32))
    assert len(body) < 0.9 * len(plain)


def test_probabilities_add_up(some_docs):
    tree = Tree([r.text for r in some_docs.limit(60).collect()], 3, 4, 0.5)
    for context in list(tree.kept)[:20] + [("never", "seen")]:
        total = sum(tree.probability(list(context), w) for w in [*tree.words, "not in any text"])
        assert abs(total - 1) < 1e-9


def test_word_hashes(monkeypatch):
    texts = [b"One  two\tONE", None, b"", b" lead", b"x" * 5000 + b" one " + b"two " * 900, b"two"]
    whole = [h.tolist() for h in st.word_hashes(texts)]
    assert [len(h) for h in whole] == [3, 0, 0, 1, 902, 1]
    assert whole[0][0] == whole[0][2] == whole[4][1] and whole[5][0] == whole[4][2] == whole[0][1]
    many = [f"w{i} v{i}w x{i * i}y".encode() for i in range(20_000)]
    assert len(np.unique(np.concatenate(list(st.word_hashes(many))))) == 60_000
    monkeypatch.setattr(st, "SEGMENT", 64)
    assert [h.tolist() for h in st.word_hashes(texts)] == whole
