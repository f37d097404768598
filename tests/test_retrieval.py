import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrag.models import embed_with_hash, hash_embed
from sparkrag.operators import bm25 as BM
from sparkrag.operators import dense as DN
from sparkrag.operators import fusion as FU
from sparkrag.operators.evidence import check_evidence
from sparkrag.operators.metrics import retrieval_metrics
from sparkrag.operators.permissions import scope_filter
from sparkrag.operators.quotes import quoted_pairs
from sparkrag.plans.search import SearchSetup, four_way_recall, search_with_retry

CORPUS = [("c-fert", "IOI", ["worker", "manager"], [], "榴莲开花期施肥以磷钾肥为主，少施氮肥"),
          ("c-irr", "IOI", ["manager"], ["ORCHARD_3"], "旱季每7天灌溉一次，保持土壤湿润"),
          ("c-th", "IOI", ["worker", "manager"], [], "โรครากเน่าของทุเรียน"),
          ("c-en", "OTHER", ["worker", "manager"], [], "Stem borer larvae tunnel into the trunk"),
          ("c-o3", "IOI", ["worker", "manager"], ["ORCHARD_3"], "3号园开花期施肥记录")]
COLS = ("chunk_id string, tenant_id string, role_scope array<string>, orchard_scope array<string>, "
        "text string")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, COLS).withColumn("document_id", F.col("chunk_id"))


def qs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)],
                                 "query_id string, text string")


def test_bm25_known_items(spark, corpus):
    index = BM.bm25_index(corpus)
    hits = BM.bm25_search(qs(spark, "开花期施什么肥", "stem borer trunk damage", "量子力学薛定谔方程"), index)
    first = {r["query_id"]: r["chunk_id"] for r in hits.filter("rank = 1").collect()}
    assert first["0"] in ("c-fert", "c-o3") and first["1"] == "c-en" and "2" not in first


def test_salted_join_gives_the_same_scores(spark, corpus, monkeypatch):
    index = BM.bm25_index(corpus)
    q = qs(spark, "开花期施肥 stem borer", "灌溉 trunk")
    a = {tuple(r) for r in BM.bm25_scores(q, index).collect()}
    monkeypatch.setattr(BM, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(BM, "HOT_SHARE", 1_000_000)
    assert {tuple(r) for r in BM.bm25_scores(q, index).collect()} == a


def test_dense_bar(monkeypatch):
    """Once a query has its k chunks, others are only compared with the worst of them; ties, vectors
    that are zero or not finite, and masked rows as in a search without a bar."""
    import pandas as pd
    rng = np.random.default_rng(2)
    vec = rng.integers(-2, 3, (900, 6)).astype(float)  # many equal scores
    vec[5], vec[9, 0], vec[11, 2] = 0, np.inf, np.nan
    ids = rng.permutation(900)
    monkeypatch.setattr(DN, "SCORE_CELLS", 60 * 40)
    cuts, whole = [], np.partition
    monkeypatch.setattr(np, "partition", lambda s, *a, **k: cuts.append(len(s)) or whole(s, *a, **k))
    pdf = pd.DataFrame({"chunk_id": ids, "vec": list(vec)})
    with np.errstate(invalid="ignore"):
        unit = DN._unit(list(vec))
        for low in (None, 0.3):
            best = DN._TopK(unit[:60], [], 7, low, list(ids[:60]))
            cuts.clear()
            best.add(pdf)
            assert sum(cuts) <= 4 * 60
            got = list(zip(best.row.tolist(), best.ids.tolist(), best.score.tolist()))
            exact = np.round(unit[:60] @ unit.T, DN.SCORE_DIGITS)
            want = []
            for q in range(60):
                rows = [(-exact[q, c], ids[c]) for c in range(900) if c != q
                        and np.isfinite(exact[q, c]) and (low is None or exact[q, c] >= low)]
                want += [(q, i, -x) for x, i in sorted(rows)[:7]]
            assert got == want


def test_hash_embed(spark):
    """Counts of hashed tokens, without a pass over the tokens for every slot."""
    import hashlib
    words = [f"w{i % 70}" for i in range(200)]
    df = spark.createDataFrame([(0, words), (1, []), (2, ["é", None, "é"]), (3, None)],
                               "id int, t array<string>")
    for dim in (64, 10, 100):
        got = dict(df.select("id", hash_embed("t", dim).alias("v")).collect())
        for i, tokens in ((0, words), (1, []), (2, ["é", "é"])):
            v = np.zeros(dim)
            for x in tokens:
                v[int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % dim] += 1
            assert np.allclose(got[i], v / max(1e-9, np.linalg.norm(v)), atol=1e-12)
        assert set(got[3]) == {None}
    plan = df.select(hash_embed("t")).select("*")._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan


def test_bm25_search_in_tasks(spark, monkeypatch):
    """The best of every slice against all scores in rows, with ties and documents without tokens."""
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 6))))
            for i in range(300)] + [("none", None)]
    index = BM.bm25_index(spark.createDataFrame(rows, "chunk_id string, text string").repartition(3))
    asked = qs(spark, "w1 w2 w3", "w4", "w9 w11 nowhere", "nowhere", "")
    scores = BM.bm25_scores(asked, index).where("score > 0").collect()
    monkeypatch.setattr(BM, "SCORE_CELLS", 4 * 17)
    called = []
    monkeypatch.setattr(BM, "bm25_scores", lambda *a: called.append(1))
    got = [tuple(r) for r in BM.bm25_search(asked, index, 7).orderBy("query_id", "rank").collect()]
    want = []
    for q in sorted({r.query_id for r in scores}):
        best = sorted((-r.score, r.chunk_id) for r in scores if r.query_id == q)[:7]
        want += [(q, c, -x, i + 1) for i, (x, c) in enumerate(best)]
    assert got == want and len(got) == 21 and not called


def test_dense_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)],
                               "chunk_id long, vec array<double>")
    q = df.select(F.col("chunk_id").alias("query_id"), "vec")
    a = sorted(map(tuple, DN.dense_search(q, df, 5, None, exclude_self="query_id").collect()))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for i in range(60):
        best = sorted(range(60), key=lambda j: (-s[i, j], j))[:5]
        assert [r[1] for r in a if r[0] == i] == sorted(best, key=lambda j: j)
    monkeypatch.setattr(DN, "MATRIX_QUERIES", 7)
    monkeypatch.setattr(DN, "BLOCK_ROWS", 11)
    b = DN.dense_search(q, df, 5, None, exclude_self="query_id")
    assert sorted(map(tuple, b.collect())) == a


def test_fusion_formula(spark):
    h = spark.createDataFrame([("q", "dense_canonical", "x", 1), ("q", "dense_canonical", "y", 2),
                               ("q", "bm25_expanded", "y", 1), ("q", "bm25_expanded", "x", 2),
                               ("q", "nope", "z", 1)],
                              "query_id string, route string, chunk_id string, rank int")
    got = {r["chunk_id"]: (r["score"], r["rrf_rank"], r["sources"]) for r in FU.weighted_rrf(h).collect()}
    assert got["y"][0] == pytest.approx(.30 / 62 + .35 / 61) and got["y"][1] == 1
    assert got["x"][0] == pytest.approx(.30 / 61 + .35 / 62) and "z" not in got
    assert got["x"][2] == {"dense_canonical": 1, "bm25_expanded": 2}


def test_scopes(spark, corpus):
    s = spark.createDataFrame([("w", "IOI", "worker", []), ("w5", "IOI", "worker", ["ORCHARD_5"]),
                               ("a", "IOI", "admin", [])],
                              "user_id string, tenant_id string, role string, orchard_scope array<string>")
    got = {}
    for r in scope_filter(corpus, s).collect():
        got.setdefault(r["user_id"], set()).add(r["chunk_id"])
    assert got == {"w": {"c-fert", "c-th", "c-o3"}, "w5": {"c-fert", "c-th"},
                   "a": {"c-fert", "c-irr", "c-th", "c-o3"}}


def test_scope_holds_in_all_routes(spark, corpus):
    embed = embed_with_hash(32)
    setup = SearchSetup(embed(corpus, "text", "vec"), embed=embed, scoped=True)
    q = spark.createDataFrame([("w5", "开花期施肥 灌溉 stem borer", "IOI", "worker", ["ORCHARD_5"]),
                               ("a", "开花期施肥 灌溉 stem borer", "IOI", "admin", [])],
                              "query_id string, text string, tenant_id string, role string, "
                              "orchard_scope array<string>")
    hits = four_way_recall(q, setup).collect()
    seen = {u: {r["chunk_id"] for r in hits if r["query_id"] == u} for u in ("w5", "a")}
    # Hashed vectors may add weak hits, so check what must and what must not be seen.
    assert {"c-fert"} <= seen["w5"] <= {"c-fert", "c-th"}
    assert {"c-fert", "c-irr", "c-o3"} <= seen["a"] <= {"c-fert", "c-irr", "c-o3", "c-th"}
    assert {r["route"] for r in hits} == {"dense_original", "dense_canonical", "bm25_original",
                                          "bm25_expanded"}


EVIDENCE = [
    ("炭疽病怎么治", {}, [], [], False), ("猫山王施肥", {"cultivar": "猫山王"}, [],
     ["金枕施肥以复合肥为主", "幼树薄肥勤施"], False),
    ("猫山王施肥", {"cultivar": "猫山王"}, [], ["Musang King requires potash", "drip line"], True),
    ("叶片发黄是什么病", {}, ["叶片发黄"], ["蚜虫用吡虫啉防治", "炭疽病用波尔多液"], False),
    ("吡虫啉25ml兑水可以吗", {}, [], ["按标签浓度喷施"], False),
    ("吡虫啉25ml兑水可以吗", {}, [], ["每25ml兑水15升喷雾", "安全间隔期7天"], True),
    ("株施复合肥2kg对吗", {}, [], ["每株施30公斤复合肥", "建议50公斤每株"], False),
    ("炭疽病怎么治", {}, [], ["一份"], False), ("3号园施肥", {"orchard": "ORCHARD_3"}, [], ["a", "b"], True)]


def test_evidence(spark):
    q = spark.createDataFrame([(i, e[0], e[1], e[2]) for i, e in enumerate(EVIDENCE)],
                              "query_id int, query string, entities map<string,string>, "
                              "symptoms array<string>")
    d = spark.createDataFrame([(i, f"{i}-{j}", t) for i, e in enumerate(EVIDENCE)
                               for j, t in enumerate(e[3])], "query_id int, chunk_id string, text string")
    got = {r["query_id"]: r for r in check_evidence(q, d, {"猫山王": ["Musang King", "D197"]}).collect()}
    assert [got[i]["sufficient"] for i in range(len(EVIDENCE))] == [e[4] for e in EVIDENCE]
    assert got[0]["reasons"] == ["无任何证据"]
    assert got[6]["entity_conflict"] and got[6]["reasons"] == ["证据数值与查询条件 2.0 不一致，疑来源冲突"]
    assert got[4]["reasons"] == ["查询含数值条件但证据无任何数字", "证据单点（1 份），不足以支撑专业结论"]


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("1", "zh"), ("2", "zh")], "query_id string, language string")
    h = spark.createDataFrame([("1", "x", 1), ("1", "a", 2), ("1", "b", 3)],
                              "query_id string, chunk_id string, rank int")
    g = spark.createDataFrame([("1", "a"), ("1", "b")], "query_id string, chunk_id string")
    m = {r["query_id"]: r for r in retrieval_metrics(q, h, g, 3).collect()}
    assert m["1"]["ndcg"] == pytest.approx((1 / 1.58496250072 + .5) / (1 + 1 / 1.58496250072))
    assert (m["1"]["hit_at_1"], m["1"]["hit_at_3"], m["1"]["recall_at_k"], m["1"]["mrr"]) == (0, 1, 1, .5)
    assert m["2"]["ndcg"] == 0


def test_retry_rounds(spark, corpus):
    q = spark.createDataFrame([("good", "开花期施肥", {}, []), ("bad", "量子力学", {}, [])],
                              "query_id string, text string, entities map<string,string>, "
                              "symptoms array<string>")
    docs, v = search_with_retry(q, SearchSetup(corpus))
    got = {r["query_id"]: (r["sufficient"], r["rounds"], r["error"]) for r in v.collect()}
    assert got == {"good": (True, 1, None), "bad": (False, 2, "RAG_NO_RESULT")}
    assert docs.filter("query_id = 'good'").count() >= 2


def test_quotes(spark):
    """Windows of whole texts against brute force; no step compares the windows of a text pairwise."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    asked = [(i, " ".join(r.choice(words, n))) for i, n in enumerate([20, 13, 5, 1, 30])] + [(8, " , "), (9, None)]
    docs = [(i, ", ".join([*r.choice(words, 50), *(asked[i % 5][1].upper().split()), *r.choice(words, 40)]))
            for i in range(20)] + [(30, ""), (31, None), (32, "w " * 3000)]
    d = spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, text string")
    want = {}
    for i, a in asked:
        w = (a or "").replace(",", " ").split()
        n = min(len(w), 13)
        for j, t in docs:
            held = (t or "").lower().replace(",", " ").split()
            hit = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} & {
                tuple(held[k:k + n]) for k in range(len(held) - n + 1)} if n else set()
            if hit:
                want[i, j] = len(hit)
    got = quoted_pairs(d, q)
    assert "array_distinct" not in got._jdf.queryExecution().toString()
    assert {(x["query_id"], x["chunk_id"]): x["windows"] for x in got.collect()} == want and want


def test_gold_of_the_search_is_made_once(spark):
    """Sizes and hits read the pairs of quotes; they don't cut all texts into windows once each."""
    from sparkrag.catalog import load
    out = load()[0]["evaluate_search"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
