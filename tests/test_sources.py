import json
import os

import pytest
from pyspark.sql import functions as F

from sparkrag import models as MO
from sparkrag.plans.corpus_build import build_corpus, salvage
from sparkrag.sources import readers as R
from sparkrag.sources import writers as W


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)
    return path


def test_chunks_and_salvage(spark, folder):
    body = "榴莲开花期需要充足的磷钾肥，并保持土壤湿润。" * 4
    lines = [json.dumps({"doc": "FAQ_zh_1", "text": "问：怎么  施肥？ 答：薄肥勤施，少量多次为好。", "category": "f"}),
             "", "{bad", json.dumps({"doc": "a.docx", "text": "ทุเรียน " * 10}),
             json.dumps({"doc": "book", "text": body, "page": 3}),
             json.dumps({"doc": "book", "text": "<td>Table 3. Effect of potassium on fruit weight in field trials</td> <td>1.5</td>"}),
             json.dumps({"doc": "book", "text": body, "page": 4}), json.dumps({"doc": "skip_me", "text": body})]
    rows, bad = R.read_chunks(spark, put(folder, "c.jsonl", "\n".join(lines)))
    assert bad.first()["bad_lines"] == 1 and rows.count() == 6
    got = salvage(rows, ["skip"]).orderBy("pos").collect()
    assert [r["block_type"] for r in got] == ["qa_pair", "text", "text", "table_broken", "text"]
    assert [r["seq"] for r in got] == [1, 1, 1, 2, 3]
    assert got[0]["metadata"]["src_lang"] == "zh" and got[1]["metadata"]["needs_translation"] == "true"
    assert got[3]["metadata"]["damaged"] == "true" and "不可引用" in got[3]["display_text"]
    pages = spark.createDataFrame([("p.pdf", 1, body + "另外的页"), ("q.pdf", 1, body + "另外的页")],
                                  "doc string, page int, text string")
    tables = spark.createDataFrame([("p.pdf", 1, 0, "|a|b|\n|---|---|\n|x one|y two|\n|z three|w four|")],
                                   "doc string, page int, table_no int, markdown string")
    rules = spark.createDataFrame([], "prefix string, ord int, size int, overlap int")
    final = build_corpus(rows, pages, rules, ["skip"], tables).collect()
    assert len(final) == 6  # one literature copy and the copied document are gone
    assert sum(r["block_type"] == "table" for r in final) == 1
    W.write_chunks(salvage(rows), folder + "/out")
    assert spark.read.json(folder + "/out").count() == 6


def test_terms_and_concepts(spark, folder):
    path = put(folder, "g.json", json.dumps({
        "_meta": {"purpose": "x"}, "note": "text", "disease": {"_note": "n", "root rot": "根腐病", "bad": 5},
        "pest": {"mite": "螨"}}))
    terms = R.read_terms(spark, path)
    got = {(r["category"], r["alias"], r["canonical"]) for r in terms.collect()}
    assert got == {("disease", "root rot", "根腐病"), ("pest", "mite", "螨")}
    built = R.read_concepts(spark, folder + "/none", terms)
    W.write_concepts(built, folder + "/concepts")
    assert R.read_concepts(spark, folder + "/concepts").count() == built.count() == 2


def test_terms_parse_each_category_once(spark, folder):
    """Work grows with the terms: a plan that parses the category again for each of them does not."""
    os.makedirs(folder + "/terms")
    for n in range(2):  # a table in two files
        put(folder + "/terms", f"{n}.json", json.dumps({
            "_meta": {"a": "b"}, "pest": {"count": 5, "_note": "x", **{f"it's {n} {i}": "c" for i in range(3000)}}}))
    terms = R.read_terms(spark, folder + "/terms")
    assert "parse_json" not in terms._jdf.queryExecution().toString()
    got = terms.collect()
    assert {(r["category"], r["alias"], r["canonical"]) for r in got} == {
        ("pest", f"it's {n} {i}", "c") for n in range(2) for i in range(3000)}
    assert len(got) == 6000


def test_gold_and_samples(spark, folder):
    gold = put(folder, "gold.jsonl", "\n".join(json.dumps(x) for x in [
        {"question": "D197 怎么样", "q_lang": "zh", "category": "v", "ref_doc_id": "d", "anchors": ["c1"]},
        {"question": " "}, {"question": "long " * 20, "language": "en", "cross_lingual": True}]))
    got = R.read_gold(spark, gold, ["D197"]).collect()
    assert [(r["language"], r["difficulty"]) for r in got] == [("zh", "Alias"), ("en", "Cross-language")]
    path = put(folder, "s.json", json.dumps({"samples": [{"query": "q", "language": "en", "intent": "harvest"}]},
                                            indent=1))
    assert R.read_intent_samples(spark, path).first()["rule_backstop"] is False


def test_tables(spark, folder):
    users = spark.createDataFrame([("u1", None)], "user_id string, role string")
    W.write_ops(users, folder + "/ops", "users")
    got = R.read_ops(spark, folder + "/ops", ("users",))["users"].first()
    assert (got["role"], got["tenant_id"]) == ("worker", "default")
    rec = spark.createDataFrame([("c", "x" * 5000, None, ["a"] * 9)],
                                "chunk_id string, text string, orchard_scope array<string>, role_scope array<string>")
    W.build_search_table(rec, folder + "/search")
    row = spark.read.parquet(folder + "/search").filter("tenant_id = 'default'").first()
    assert len(row["text"]) == 4095 and row["orchard_scope"] == ["ALL"] and len(row["role_scope"]) == 8
    assert R.list_documents(spark, folder + "/search", "*.parquet").count() == 1


def test_failing_images_keep_their_row(spark):
    def describe(blobs):
        if b"bad" in blobs:
            raise RuntimeError("no model")
        return ['{"description": "叶片", "text_in_image": "A1"}' for _ in blobs]

    df = spark.createDataFrame([("1", "image", "", b"ok"), ("2", "scan_page", "t", b"bad"), ("3", "text", "x", None)],
                               "id string, block_type string, text string, content binary")
    got = {r["id"]: (r["text"], r["enrich_error"]) for r in MO.enrich_images(df, describe).collect()}
    assert got == {"1": ("叶片\n图中文字：A1", None), "2": ("t", "no model"), "3": ("x", None)}


def test_chunk_table_function(spark):
    MO.register_chunk_function(spark)
    spark.createDataFrame([("d", "句子。" * 400)], "id string, text string").createOrReplaceTempView("docs")
    n = spark.sql("SELECT id, piece, chunk FROM docs, LATERAL chunk_text(text)")
    assert n.count() == n.select(F.max("piece")).first()[0] + 1 > 1


class _Session:
    """Only the settings of a session."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_folder_is_required_on_clusters():
    from sparkrag.sources.stage import shared_dir

    at = _Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_dir(at) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(_Session(spark_master=master))
    own = _Session(spark_master="local[2]", spark_app_id="a-test")
    assert shared_dir(own) == shared_dir(own)


def test_content_key_ignores_page_breaks(spark, monkeypatch):
    from sparkrag.operators import corpus as O

    monkeypatch.setattr(O, "PIECE_CHARS", 7)
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [("a", 1, text), ("b", 1, text[:5]), ("b", 2, text[5:20]), ("b", 3, ""), ("b", 4, text[20:]),
            ("c", 1, text[::-1]), ("d", 1, text[7:14]), ("d", 2, text[:7] + text[14:]), ("e", 1, "")]
    df = spark.createDataFrame(rows, "doc string, page int, text string")
    key = {r["doc"]: r["content_key"] for r in O.page_fingerprints(df).collect()}
    assert key["a"] == key["b"] and len(set(key.values())) == 4
    assert {r["doc"] for r in O.dedup_documents(df).collect()} == {"a", "c", "d", "e"}


def test_positions_do_not_depend_on_splits(spark, folder):
    for name, lo in (("b.jsonl", 300), ("a.jsonl", 0)):
        put(folder, name, "\n".join(json.dumps({"doc": "d", "text": f"line {i} " + "x" * (i % 50)})
                                     for i in range(lo, lo + 300)))
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for size in ("128m", "2k"):
            spark.conf.set(key, size)
            rows, _ = R.read_chunks(spark, folder)
            seen.append(sorted((r["pos"], r["text"]) for r in rows.collect()))
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1]
    assert [t.split()[1] for _, t in seen[0]] == [str(i) for i in range(600)]


def test_trace_batches_replace_themselves(spark, folder):
    df = spark.createDataFrame([(1,), (2,)], "trace_id int")
    for batch in (0, 1, 1):
        W.write_trace(df, folder + "/trace", batch)
    assert spark.read.json(folder + "/trace").count() == 4


def test_scratch_tables_go(spark):
    from sparkrag.sources.stage import scratch, staged

    kept = staged(spark.range(3), "kept")
    with scratch(spark):
        held = staged(spark.range(5), "held")
        (path,) = held.inputFiles()[:1]
        assert held.count() == 5
    assert not os.path.exists(path.removeprefix("file://"))
    assert kept.count() == 3


def test_captions_equal_their_sql(spark, folder):
    """Lone letters are no caption, in the SQL as in the query."""
    import duckdb
    from sparkrag.catalog import load
    queries, sql = load()
    docs = [(1, "a " * 22), (2, "words of a caption, a b c d e f g h"), (3, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(folder + "/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(sql["caption_rescue"]).fetchall()
    got = [tuple(r) for r in queries["caption_rescue"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (1, None, 1) in got
