"""Nearest neighbours and benchmark passages against brute force."""

import re

import numpy as np
import pytest

from sparkrag.llm import ann, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items):
    w = words(text)
    hit, found = [False] * len(w), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else ()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k:k + n]) in windows:
                hit[k:k + n] = [True] * n
                if i is not None:
                    found.add(str(i))
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 400])
def test_contamination(spark, some_docs, block):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = decontaminate.mark_contamination(some_docs, bench, block_bytes=block).collect()
    n = 0
    for r in got:
        m = r.contamination
        assert (m.n_words, m.n_hit, list(m["items"])) == brute_hits(r.text, items)
        n += m.n_hit
    assert n > 0


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination_edges(spark, edge, no_docs, block):
    rows = {r.doc_id: r.text for r in edge.collect()}
    a = rows[9]
    items = [(10, " ".join(a.split()[5:40])), (2, "two WORDS"), (3, None), (4, ""), (5, "..."),
             (None, " ".join(a.split()[30:50])), (10, "one"), (6, "no such thing in here"),
             (11, "a, b; c"), (12, "a, b; c"), (7, " ".join(a.split()[:13])), (8, "日本語 😀 é 日本語")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark_contamination(edge.withColumn("contamination", edge.doc_id), bench,
                                           block_bytes=block)
    assert got.columns == [*edge.columns, "contamination"]
    for r in got.collect():
        m = r.contamination
        assert (m.n_words, m.n_hit, list(m["items"])) == brute_hits(r.text, items)
    none = bench.limit(0)
    assert all(r.contamination.n_hit == 0 for r in
               decontaminate.mark_contamination(edge, none).collect())
    assert decontaminate.mark_contamination(no_docs, bench).count() == 0


def test_contaminated_share(spark):
    item = " ".join(f"q{i}" for i in range(13))
    docs = spark.createDataFrame(
        [(1, item + " x" * 247), (2, item + " x" * 248), (3, "x"), (4, None)],
        "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.mark_contamination(docs, bench).where(decontaminate.contaminated())
    assert [r.doc_id for r in got.collect()] == [1]


def brute_nearest(rows, every=20, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted(((-float(np.dot(q, v)), j) for j, v in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {i for i, v in want.items() if v}
    found = 0
    for i, rows in by.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[i]) + 1))
        assert rows == sorted(rows, key=lambda x: (-x[2], x[1]))
        found += len({j for _, j, _ in rows} & {j for j, _ in want[i]})
    return found / sum(map(len, want.values()))


def test_nearest_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in v.collect()])
    assert compare(ann.nearest(v).collect(), want) >= 0.9


def test_nearest_hot_vector(spark, monkeypatch):
    """A third of the vectors are equal, norms differ, and blocks are small."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 8)
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 12)) * r.uniform(0.5, 3, (600, 1))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert compare(ann.nearest(v).collect(), brute_nearest(rows)) >= 0.9


def test_nearest_edges(spark):
    good = [(i, [float(i % 7) + 0.5, 1.0, -float(i % 3)]) for i in range(41)]
    odd = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, []),
           (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]), (220, [1.0, 2.0]),
           (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame([(i, e, "x") for i, e in good + odd],
                              "vec_id long, embedding array<float>, rank string")
    assert compare(ann.nearest(v).collect(), brute_nearest(good)) >= 0.9
    few = spark.createDataFrame(good[:5], "vec_id long, embedding array<float>")
    got = ann.nearest(few).collect()
    assert [(r.query_id, r.rank) for r in got] == [(0, i) for i in range(1, 5)]
    assert ann.nearest(few.limit(0)).count() == 0
    assert ann.nearest(few.limit(1)).count() == 0
    twice = ann.nearest(few.unionAll(few)).collect()
    assert [r.vec_id for r in sorted(twice, key=lambda r: r.rank)] == \
        [r.vec_id for r in sorted(got, key=lambda r: r.rank)]


def test_probe_order():
    """The own bucket comes first, then the step over the nearest border."""
    h = ann.fit(np.random.default_rng(1).normal(size=(500, 5)), 4.0, 10)
    q = np.random.default_rng(8).normal(size=(3, 5))
    slots, inside = h.places(q, True)
    probes = h.probe(q)
    assert (probes[:, :, 0] == h.codes(slots)).all()
    for i in range(3):
        for t in range(ann.TABLES):
            f = inside[i, t]
            border = np.minimum(f, 1 - f)
            k = int(border.argmin())
            step = slots[i, t].copy()
            step[k] += -1 if f[k] < 0.5 else 1
            want = h.codes(step) if 0 <= step[k] < ann.SLOTS else -1
            assert probes[i, t, 1] == want


def test_nearest_ties(spark):
    """Of a thousand equal vectors the smallest ids come first, whatever a matrix product says."""
    r = np.random.default_rng(5)
    x = r.normal(size=(1003, 384))
    x[:1000] = x[0]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)],
                              "vec_id long, embedding array<double>").repartition(4)
    by = {}
    for row in ann.nearest(v).collect():
        by.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    assert len(by) == 51
    for q, rows in by.items():
        if q < 1000:
            assert [i for _, i in sorted(rows)] == [i for i in range(21) if i != q][:20]
