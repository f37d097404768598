"""Substring, line and SimHash duplicates against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sparkrag.llm import components, lines, simhash, substrings
from sparkrag.llm.common import WordHashes, window_hashes


def cut_words(rows, window=13):
    """rows: (doc_id, text) with distinct ids."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k:k + window]), i)
    out = {}
    for i, w in words.items():
        hit = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                hit[k:k + window] = [True] * window
        out[i] = (len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode())
    return out


def test_substrings(spark, some_docs):
    rows = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    want = cut_words(rows)
    for chunk in (500, 2_000_000):
        got = substrings.remove_repeats(some_docs, chunk=chunk).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_substrings_edges(edge, no_docs):
    rows = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    # Null ids come first: their texts cut others, nothing cuts them.
    nulls = [r.text or "" for r in edge.collect() if r.doc_id is None]
    want = cut_words([*rows.items(), (-99, " | ".join(nulls))])
    got = substrings.remove_repeats(edge, chunk=3000).collect()
    assert len(got) == edge.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
            assert all(a < b for a, b in zip(r.starts or [], r.ends or []))
            assert all(b < a for b, a in zip((r.ends or [])[:-1], (r.starts or [])[1:]))
    assert substrings.remove_repeats(no_docs).count() == 0


def test_hot_passage(spark):
    """A passage that most documents hold counts once per chunk and goes everywhere but first."""
    p = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {p} c{i}") for i in range(400)],
                                 "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert got[0][0] == 0
    assert all(got[i] == (60, f"a{i} b{i} c{i}") for i in range(1, 400))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 20))
def test_window_hashes(words, size):
    h = window_hashes(WordHashes().array(words), size)
    windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    assert len(h) == len(windows)
    assert len(set(h.tolist())) == len(set(windows)) == len(set(zip(windows, h.tolist())))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2 ** 64 - 1), st.integers(-2 ** 63, 2 ** 63 - 1),
                          st.integers(0, 2 ** 31 - 1)), min_size=1, max_size=50))
def test_pack(rows):
    rows.sort()
    h, d, p = (np.array(x, t) for x, t in zip(zip(*rows), (np.uint64, np.int64, np.int32)))
    kind, *got = substrings.unpack(substrings.pack(0, h, d, p))
    assert kind == 0 and all((a == b).all() for a, b in zip(got, (h, d, p)))


def cut_lines(rows):
    """rows: (doc_id, text); chunks and first places worked out in plain Python."""
    seen, out = {}, {}
    chunked = []
    for i, text in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        parts = text.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in parts]
        chunks, at = [], 0
        for k in range(len(parts)):
            rolling = sum(31 ** b * hashes[k - b] for b in range(3) if k >= b)
            if rolling % 2147483647 % 4 == 0 or k == len(parts) - 1:
                chunks.append((at, parts[at:k + 1]))
                at = k + 1
        chunked.append((i, chunks))
        for at, c in chunks:
            if len(c) > 1:
                key = "\n".join(c)
                seen[key] = min(seen.get(key, (i, at)), (i, at))
    for i, chunks in chunked:
        kept = [c for at, c in chunks if len(c) < 2 or seen["\n".join(c)] == (i, at)]
        n = sum(len(c) for _, c in chunks)
        text = "\n".join(x for c in kept for x in c)
        out[i] = (text, n, n - sum(map(len, kept)))
    return out


def test_lines(some_docs):
    want = cut_lines([(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()])
    got = lines.remove_repeated_lines(some_docs).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == want
    assert sum(n for _, _, n in want.values()) > 0


def test_lines_edges(edge, no_docs):
    rows = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    want = cut_lines(rows.items())
    got = lines.remove_repeated_lines(edge)
    assert sorted(got.columns) == sorted([*edge.columns, "n_removed"])
    got = got.collect()
    assert len(got) == edge.count()
    assert all((r.text, r.n_lines, r.n_removed) == want[r.doc_id] for r in got
               if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert lines.remove_repeated_lines(no_docs).count() == 0


def test_lines_move_with_content(spark):
    """A line put in above leaves the chunks below as they were."""
    body = [f"line number {i} of the body" for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new", *body]))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in lines.remove_repeated_lines(docs).collect()}
    assert got[1].n_removed == 0
    assert got[2].n_removed > 30 and got[2].text.startswith("new")


def test_lines_native(some_docs):
    plan = lines.remove_repeated_lines(some_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def cut_passages(rows):
    """rows: (doc_id, text) with distinct ids; what is kept, and how many lines are not."""
    first, out = {}, {}
    for i, text in sorted(rows):
        parts = (text or "").split("\n")
        gone = set()
        for k, pair in enumerate(zip(parts, parts[1:])):
            j, at = first.setdefault(pair, (i, k))
            if j != i or k >= at + 2:
                gone |= {k, k + 1}
        out[i] = ("\n".join(x for k, x in enumerate(parts) if k not in gone), len(gone))
    return out


def test_passages(some_docs):
    want = cut_passages(some_docs.select("doc_id", "text").collect())
    got = lines.remove_repeated_passages(some_docs).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
    assert sum(n for _, n in want.values()) > 0


def test_passages_edges(edge, no_docs):
    got = lines.remove_repeated_passages(edge)
    assert sorted(got.columns) == sorted([*edge.columns, "n_removed"])
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in edge.collect()
                   if r.text is not None)
    got = got.collect()
    assert len(got) == edge.count()
    assert all(r.text is None and r.n_lines == 0 for r in got if r.doc_id == 1)
    kept = {x for r in got for x in (r.text or "").split("\n")}
    assert kept == {x for *_, t in texts for x in t.split("\n")}  # no line is lost everywhere
    assert lines.remove_repeated_passages(no_docs).count() == 0
    plan = lines.remove_repeated_passages(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [2, 3, 7])
def test_pipeline_cuts_whole_passages(spark, n):
    """Planted passages go up to their edges, whatever stands around them; single lines stay."""
    rows = []
    for k in range(30):
        body = [f"passage {k} line {i}" for i in range(n)]
        rows.append((2 * k, "\n".join([f"a {k}", *body, f"b {k}"]), "m"))
        rows.append((2 * k + 1, "\n".join([f"c {k}", *body, f"d {k}", "one"]), "m"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    for i, text, _ in rows:
        assert got[i] == (f"c {i // 2}\nd {i // 2}\none" if i % 2 else text)


def test_pipeline_takes_repeated_chunks(spark, monkeypatch):
    """The pipeline's line stage goes by content-defined chunks; pairs of lines only add the edges."""
    body = [f"line {i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new", *body]))],
                                 "doc_id long, text string")
    monkeypatch.setattr(lines, "line_pairs", lambda docs, keys: spark.createDataFrame(
        [], "doc_id long, __row long, start int, a long, b long, c long, d long"))
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_repeated_lines(
        spark, docs, "").collect()}
    assert got[1] == body and got[2][0] == "new" and len(got[2]) < 31


def brute_components(marks):
    marks = np.array(marks, np.uint64)
    parent = list(range(len(marks)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(marks[i + 1:] ^ marks[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(marks))]


def component_ids(rows):
    roots = brute_components([simhash.fingerprint((t or "").encode()) for _, t in rows])
    ids = collections.defaultdict(list)
    for (i, _), r in zip(rows, roots):
        if i is not None:
            ids[r].append(i)
    return sorted(((i, min(ids[r], default=None)) for (i, _), r in zip(rows, roots)), key=repr)


@pytest.mark.parametrize("name", ["some_docs", "edge"])
def test_simhash(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == component_ids(rows)


def test_simhash_definition():
    import xxhash
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One  TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    text = ("a b c a b c d " * 9).split()
    count = [0] * 64
    for i in range(len(text) - 2):
        h = xxhash.xxh64_intdigest(" ".join(text[i:i + 3]).encode(), 42)
        for j in range(64):
            count[j] += h >> j & 1
    want = sum(1 << j for j in range(64) if 2 * count[j] > len(text) - 2)
    assert simhash.fingerprint(" ".join(text).encode()) == want


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_links_of_dense_groups(spark, monkeypatch):
    """Near copies around one centre, in blocks smaller than their posting."""
    r = np.random.default_rng(4)
    centre = int(r.integers(0, 2 ** 63))
    marks = {centre}
    for _ in range(300):
        m = centre
        for b in r.choice(64, r.integers(1, 4), replace=False):
            m ^= 1 << int(b)
        marks.add(m)
    marks |= {int(x) for x in r.integers(0, 2 ** 63, 300)}
    marks = sorted(m - 2 ** 64 if m >= 2 ** 63 else m for m in marks)
    df = spark.createDataFrame([(m,) for m in marks], "mark long")
    want = brute_components([m % 2 ** 64 for m in marks])
    for block in (30_000, 40):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = components.components(simhash.links(df)).collect()
        root = {x.node: x.root for x in found}
        groups = {}
        for m, w in zip(marks, want):
            groups.setdefault(w, set()).add(root.get(m, m))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set().union(*groups.values())) == len(groups)


def test_keep_one(edge):
    kept = simhash.keep_one(edge).collect()
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    roots = brute_components([simhash.fingerprint((t or "").encode()) for _, t in rows])
    assert len(kept) == len(set(roots))
    assert kept[0].asDict().keys() == set(edge.columns)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (50, 60), (60, 55), (None, 4)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 55: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
