"""Ranked search against plain counting, and the sharing graph against the items it is made from."""

import math
import re
from collections import Counter

import pytest

from sparkrag.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, d is not None, d))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block,k", [(4 << 20, 20), (1000, 3)])
def test_search(spark, some_docs, block, k):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows(ranked.search(some_docs.repartition(5), bench, k, block))
    assert got == brute([(r.doc_id, r.text) for r in some_docs.collect()],
                        [(r.item_id, r.text) for r in bench.collect()], k)


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_search_edges(spark, edge, no_docs, block, monkeypatch):
    monkeypatch.setattr(ranked, "HELD", 700)  # many small groups
    long = next(r.text for r in edge.collect() if r.text and len(r.text) > 100_000)
    items = [(1, "one two words the THE the"), (2, None), (3, ""), (4, "... !"), (1, "the of an x1"),
             (None, "the of an und"), (5, "日本語 é"), (6, long[:20_000]), (7, "unheard of things")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    docs = edge.union(edge.where("doc_id > 5")).withColumn("score", edge.doc_id)
    got = ranked.search(docs, bench, 4, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == brute([(r.doc_id, r.text) for r in docs.collect()], items, 4)
    assert rows(ranked.search(no_docs, bench)) == []
    assert rows(ranked.search(edge, bench.limit(0))) == []
    named = bench.withColumn("item_id", bench.item_id.cast("string"))
    assert ranked.search(edge, named).schema["item_id"].dataType.simpleString() == "string"


def test_share():
    items = [[0, 1, 2, 3, 9], [0, 1, 2, 3, 8], [3, 2, 1, 0], [0, 0, 0, 0], [0, 0, 5], [7], [7, 6]]
    graph = ranked.share(items, 10)

    def expand(s):
        if s < 10:
            return [s]
        return expand(graph.left[s - 10]) + expand(graph.right[s - 10])

    assert [sorted(x for s in row for x in expand(s)) for row in graph.items] == \
        [sorted(row) for row in items]
    assert graph.items[2] == [max(graph.items[0])] or len(graph.items[2]) == 1  # one shared node
    uses = Counter(s for row in graph.items for s in set(row)) + Counter(
        s for pair in zip(graph.left, graph.right) for s in set(pair))
    assert all(uses[10 + i] >= 1 for i in range(len(graph.left)))
    begin = 0
    for end in graph.levels:  # a level needs earlier ones only
        assert all(s < 10 + begin for s in graph.left[begin:end] + graph.right[begin:end])
        begin = end
    assert begin == len(graph.left)
