"""Fill-in-middle rows against a plain loop over the characters of a text."""

import hashlib

import pytest

from sparkrag.llm import fim

SPACE = " \t\n\x0b\x0c\r"


def units(text):
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in SPACE:
            j += 1
        while j < len(text) and text[j] not in SPACE:
            j += 1
        out.append(text[i:j])
        i = j
    return out


def brute(text, doc_id, rate, spm):
    text = text or ""
    u = units(text)
    hexes = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (0, 0)])
def test_fim(spark, some_docs, edge, rate, spm):
    odd = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["<", "<P", "a <P> b", "<S", "x<M>", "P>", "<<<", "a b c",
                                       " lead", "tail ", " wide", "S> <P M>", "<S <P <M"])],
        "doc_id long, text string")
    docs = some_docs.select("doc_id", "text").union(edge.select("doc_id", "text")).union(odd)
    made = fim.transform(docs, rate=rate, spm=spm)
    got = made.withColumn("back", fim.restore(made.fim.output, made.fim.form)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r.fim) == brute(r.text, r.doc_id, rate, spm)
        assert r.back == (r.text or "")
    forms = {r.fim.form for r in got}
    assert forms == ({"plain", "spm", "psm"} if rate else {"plain"})


def test_fim_columns(edge, no_docs):
    named = edge.withColumn("fim", edge.doc_id).withColumn("form", edge.mark)
    got = fim.transform(named)
    assert got.columns == [*[c for c in named.columns if c != "fim"], "fim"]
    assert {r.form for r in got.collect()} == {r.mark for r in edge.collect()}
    assert fim.transform(no_docs).collect() == []


def test_fim_long_text():
    text = " ab\né" * 1_000_000
    got = fim.transform_text(text, 1, rate=100)
    assert (got["n"], len(got["output"])) == (2_000_000, len(text) + 9)
