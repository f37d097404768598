import pytest
from pyspark.sql import functions as F

from sparkrag import fixed_values as V
from sparkrag.functions import tagging as G
from sparkrag.functions.text import normalize_text
from sparkrag.operators import tagging as T
from sparkrag.plans.semantic import route, semantic_parse

TERMS = [("variety_malaysia", 0, 0, "Musang King", "猫山王"), ("variety_malaysia", 0, 1, "D197", "猫山王"),
         ("variety_thai", 1, 0, "Monthong", "金枕"), ("variety_thai", 1, 1, "หมอนทอง", "金枕"),
         ("disease", 2, 0, "root rot", "根腐病"), ("disease", 2, 1, "anthracnose", "炭疽病"),
         ("disease", 2, 2, "โรค", "病害"), ("pest", 3, 0, "stem borer", "茎蛀虫"),
         ("nutrient", 4, 0, "nitrogen", "氮"), ("symptom", 5, 0, "ใบเหลือง", "叶片发黄"),
         ("malay_common", 6, 0, "penyakit", "病害")]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(
        TERMS, "category string, category_ord int, alias_ord int, alias string, canonical string")


@pytest.fixture(scope="module")
def words(terms):
    return T.dictionary(T.entity_keys(terms))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_entities(spark, words):
    df = rows(spark, ["MUSANG KING in orchard 03", "3号园 炭疽病", "สวนที่ 3 หมอนทอง", "缺氮 plot_12",
                      "petak 5 D197 and Monthong"])
    got = [r["entities"] for r in T.detect_entities(df, words).orderBy("i").collect()]
    assert got[0] == {"cultivar": "猫山王", "orchard": "ORCHARD_3"}
    assert got[1] == {"disease": "炭疽病", "orchard": "ORCHARD_3"}
    assert got[2] == {"cultivar": "金枕", "orchard": "ORCHARD_3"}
    assert got[3] == {"fertilizer": "氮", "plot": "PLOT_12"}
    assert got[4] == {"cultivar": "金枕", "plot": "PLOT_5"}  # the longer key wins


def test_wide_dictionary_gives_the_same(spark, terms, words, monkeypatch):
    """A joined dictionary finds what the CASE finds, also across the pieces of a long text."""
    words = T.dictionary(T.entity_keys(terms))
    names = [k for k, _, _ in words]
    texts = ["x".join(names), "", None, "no key", "施肥" * 700 + names[0] + "。" * 990 + names[-1],
             names[3].upper(), *names]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = T.detect_entities(df, words).orderBy("i").collect()
    monkeypatch.setattr(T, "CASE_TERMS", 0)
    assert T.detect_entities(df, words).orderBy("i").collect() == want
    assert T.detect_entities(df, T.entity_keys(terms)).orderBy("i").collect() == want


def test_concepts(spark, terms):
    c = {r["canonical_name"]: r for r in T.build_concepts(terms).collect()}
    assert c["猫山王"]["canonical_id"] == "CULTIVAR_001" and c["金枕"]["canonical_id"] == "CULTIVAR_002"
    assert c["病害"]["type"] == "disease"
    assert c["病害"]["source_categories"] == ["disease", "malay_common"]
    assert c["病害"]["aliases"]["ms"] == ["penyakit"] and c["病害"]["aliases"]["th"] == ["โรค"]
    assert c["猫山王"]["aliases"]["zh"] == ["猫山王"]
    ids = T.dictionary(T.concept_keys(T.build_concepts(terms)))
    e = T.detect_entities(rows(spark, ["D197"]), ids).first()["entities"]
    assert e == {"cultivar": "CULTIVAR_001"}


def test_build_queries(spark, terms, words):
    q = T.build_queries(rows(spark, ["Musang King 施肥"]), words, T.alias_map(terms)).first()
    assert q["canonical"] == "Musang King 施肥 猫山王"
    assert q["expanded"] == "Musang King 施肥 猫山王 Musang King D197"


@pytest.mark.parametrize("text,intent,decision", [
    ("帮我创建一个巡检工单", "task_create", "COMPLEX_TASK"), ("any alarms today", "alarm_query", "COMPLEX_TASK"),
    ("炭疽病怎么防治", "unknown", "MUST_RAG"), ("吡虫啉25ml兑水可以吗", "unknown", "MUST_RAG"),
    ("什么是榴莲", "unknown", "SIMPLE"), ("kemaskini tugasan 7 jadi selesai", "task_update", "COMPLEX_TASK")])
def test_routes(spark, words, text, intent, decision):
    r = route(semantic_parse(rows(spark, [text]), words, [("ใบเหลือง", "叶片发黄")])).first()
    assert (r["semantic"]["intent"], r["route"]) == (intent, decision)


def test_model_output_merges(spark, words):
    df = rows(spark, ["D197 叶子"]).withColumn("m", F.lit(
        'x ```json\n{"language": "zh", "intent": "irrigation_decision", "secondary_intents": '
        '["harvest", "bad"], "entities": {"cultivar": "其他", "pesticide": "吡虫啉"}, '
        '"growth_stage": "谢花", "plant_parts": ["leaf", "wing"], '
        '"risk_features": {"pesticide_related": true}}\n```'))
    s = semantic_parse(df, words, [], model_col="m").first()["semantic"]
    assert s["intent"] == "irrigation" and s["secondary_intents"] == ["harvest"]
    assert s["entities"]["cultivar"] == "猫山王" and s["entities"]["pesticide"] == "吡虫啉"
    assert s["growth_stage"] == "unknown" and s["plant_parts"] == ["leaf"]
    assert s["risk_features"]["pesticide_related"] and s["risk_features"]["domain_knowledge_required"]


def test_scope_and_stage(spark):
    df = spark.createDataFrame([(["", None],), (["A", ""],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(G.normalize_scope("s")).collect()] == [["ALL"], ["A"], ["ALL"]]
    d = rows(spark, ["花芽分化期开花", "post-harvest", "Flowering"])
    assert [r[0] for r in d.orderBy("i").select(G.growth_stage("text")).collect()] == [
        "pre_flowering", "post_harvest", "unknown"]


def test_dictionary_in_blocks(spark, terms, words, monkeypatch):
    """A dictionary cut into many automata gives what one gives, whatever the order of the texts."""
    names = [k for k, _, _ in words]
    df = rows(spark, ["x".join(names), "", None, *names, names[0] + names[5] + names[1]])
    keys = T.entity_keys(terms)
    want = T.detect_entities(df, keys).orderBy("i").collect()
    assert want == T.detect_entities(df, words).orderBy("i").collect()
    monkeypatch.setattr(T, "BLOCK_BYTES", 150)
    monkeypatch.setattr(T, "CHAINED", 2)
    assert T._ranked_keys(keys).selectExpr("max(block)").first()[0] > 4
    assert T.detect_entities(df, keys).orderBy("i").collect() == want
    assert T.find_keys(df.selectExpr("i AS id", "text AS v"), keys.limit(0)).collect() == []


def test_ranked_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 4000)
    made = [(f"k{i % 5000}" + "x" * (i % 7), f"v{i}", f"s{i % 3}", i) for i in range(20_000)]
    keys = spark.createDataFrame(made, "key string, value string, slot string, ord long").repartition(5)
    best = {}
    for k, v, s, o in made:
        best.setdefault((k, s), (v, o))  # the smallest ord comes first
    want = sorted(((-len(k), o, k, s, v) for (k, s), (v, o) in best.items()))
    got = T._ranked_keys(keys).orderBy("rank").collect()
    assert [(r.key, r.slot, r.value, r["rank"]) for r in got] == [
        (k, s, v, i) for i, (_, _, k, s, v) in enumerate(want)]
    sizes = {}
    for r in got:
        sizes[r.block] = sizes.get(r.block, 0) + len(r.key) + len(r.value) + len(r.slot) + 48
    assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) < 4100


def test_large_tables_stay_tables(spark, terms, words):
    table = T.dictionary(T.entity_keys(terms), limit=3)
    lists = T.alias_map(terms, limit=2)
    assert not isinstance(table, list) and not isinstance(lists, dict)
    df = rows(spark, ["Musang King 施肥", "根腐病 D197 หมอนทอง", "", None, "no name"])
    want = T.build_queries(df, words, T.alias_map(terms)).orderBy("i").collect()
    assert T.build_queries(df, table, lists).orderBy("i").collect() == want
    assert "D197" in want[0].expanded and want[4].expanded == "no name"


def test_patterns_need_their_words(spark):
    """Looking for the words first loses no match, whatever the case."""
    texts = ["新建 一个任务", "Create a TASK", "BUAT satu tugasan", "เปิด งาน", "任务 5 号 完成", "把 任务 取消",
             "MARK the Task 5 as Completed", "Kemaskini tugasan", "看看 工单", "任务 列表", "Show all tasks",
             "SEMAK tugasan", "警报", "ALARM", "การแจ้งเตือน", "Amaran", "资产 列表", "几个 设备", "LIST Sensors",
             "Senarai aset", "农药", "Fungicides", "Racun Kulat", "SOP", "Food Safety", "RAIN", "Hujan", "Real time",
             "real-time", "Realtime", "LIVE data", "Kelembapan tanah sekarang", "安排巡检", "Schedule an inspection",
             "Jadualkan", "What Pest", "KENAPA", "โรคอะไร", "İ kein \u212aenapa", "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = list(V.NEEDS)
    row = df.select(*[F.sum((~G._matches(F.col("t"), F.lower("t"), p).eqNullSafe(F.col("t").rlike(p)))
                            .cast("int")) for p in patterns],
                    *[F.count_if(F.col("t").rlike(p)) for p in patterns]).first()
    assert list(row[:len(patterns)]) == [0] * len(patterns)
    assert min(row[len(patterns):]) > 0


def test_merged_risks_read_no_text(spark):
    """The flags of a document are computed once, not on both sides of the join and for every flag."""
    from sparkrag.catalog import load
    queries, _ = load()
    plan = queries["merge_risks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert "insecticides" not in plan.toString()
    plan = queries["evidence_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("|weather|") == 1
