import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sparkrag.functions import dialog as D
from sparkrag.operators import dialog as O
from sparkrag.operators import metrics as M
from sparkrag.operators import ops as P
from sparkrag.streaming import jobs as J
from sparkrag.streaming import stateful as S


def messages(spark, rows):
    return spark.createDataFrame([("c", i, r, t) for i, (r, t) in enumerate(rows)],
                                 "conv_id string, turn long, role string, text string")


def test_window_and_summary(spark):
    turns = [x for i in range(12) for x in (("user", f"问题{i}" + "长" * 300), ("assistant", f"答{i}" + "好" * 300))]
    kept, s = O.compress(messages(spark, turns))
    assert kept.filter("trimmed").count() == 8
    text = s.first()["summary"]
    assert text.startswith("用户问：问题0") and "回答要点：答3" in text and "问题4" not in text
    small = messages(spark, [("user", "你好"), ("assistant", "同样的回答"), ("assistant", "同样的回答"),
                             ("tool", "x" * 100), ("user", "谢谢")])
    kept, s = O.compress(small)
    assert kept.filter("trimmed").count() == 0 and s.first()["summary"] == ""
    assert O.rule_summary(small).first()["summary"] == "回答要点：同样的回答\n工具结果：" + "x" * 60
    prev = spark.createDataFrame([("c", "旧"), ("z", "别")], "conv_id string, summary string")
    got = {r["conv_id"]: r["summary"] for r in O.rule_summary(small, prev).collect()}
    assert got["c"].startswith("旧\n回答要点") and got["z"] == "别"


def test_summary_of_partitioned_messages(spark):
    """Messages that a shuffle join has dealt out; equal tool lines of one turn stay."""
    rows = [(c, i, r, t) for c in range(40) for i, r, t in (
        (0, "user", f"asked {c}"), (1, "assistant", "same"), (2, "assistant", "same"),
        (3, "tool", "out"), (3, "tool", "out"))]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = m.repartition(9).join(m.repartition(5).select("conv_id").distinct().hint("merge"), "conv_id", "left")
    plan = O.summary_lines(m)._jdf.queryExecution().toString()
    assert "Union" not in plan
    got = O.rule_summary(m).collect()
    assert {r["conv_id"]: r["summary"] for r in got} == {
        c: f"用户问：asked {c}\n回答要点：same\n工具结果：out\n工具结果：out" for c in range(40)}


def test_levels(spark):
    m = messages(spark, [("user", "a" * 400), ("tool", "t" * 4000), ("assistant", "b" * 400),
                         ("user", "c" * 40)])
    ctx = spark.createDataFrame([("c", "", "state", "query")],
                                "conv_id string, summary string, business_state string, query string")
    assert O.apply_level(m, 3).count() == 2 and O.apply_level(m, 4).count() == 0
    levels = [O.fit_level(m, ctx, n).first()["level"] for n in (5000, 1000, 150, 10)]
    assert levels == [0, 1, 1, 4]
    assert O.fit_level(m, ctx, 300, start=2).first()["level"] == 2


def test_budgets():
    assert D.budget_caps(8000) == {"system": 800, "summary": 1200, "history": 2000, "rag": 2800,
                                   "query": 400, "output": 800}


def test_coverage(spark):
    rows = [("text",)] * 70 + [("qa_pair",)] * 10 + [("table",)] * 4 + [("image",)] * 2 + [("table_broken",)]
    ann = M.load_annotations(spark.createDataFrame([('{"text": 100, "table": 5}',)], "annotations string"))
    got = {r["type"]: r["coverage"] for r in M.parse_coverage(
        spark.createDataFrame(rows, "block_type string"), ann).collect()}
    assert got == {"text": .8, "table": .8, "image": None, "scan_page": None, "overall": .8}


T0 = dt.datetime(2024, 1, 1)


def calls(spark, seconds):
    return spark.createDataFrame([(i, "k", T0 + dt.timedelta(seconds=s), float(i)) for i, s in enumerate(seconds)],
                                 "event_id long, key string, ts timestamp, value double")


def test_rate_limit(spark):
    got = [r["allowed"] for r in P.rate_limit(calls(spark, [0, 1, 2, 3, 4, 64, 65]), 3, 60)
           .orderBy("event_id").collect()]
    assert got == [True, True, True, False, False, True, True]
    renewed = P.rate_limit(calls(spark, [0, 59, 118, 177]), 3, 60, bucket=50).orderBy("event_id")
    assert [r["call_no"] for r in renewed.collect()] == [1, 2, 3, 4]


def test_ttl(spark):
    seconds = [0, 5, 9.999, 10, 12, 19, 21, 40, 45]
    got = [(r["cached"], r["hit"]) for r in P.ttl_first_value(calls(spark, seconds), 10, bucket=7)
           .orderBy("event_id").collect()]
    assert got == [(0, False), (0, True), (0, True), (3, False), (3, True), (3, True), (6, False),
                   (7, False), (7, True)]


def test_idempotent_and_validation(spark):
    rows = [(1, "t", "排水", None, "normal"), (2, "t", "排水", None, "bad"), (3, "t", "x", "k1", None),
            (4, "t", "y", "k1", None), (5, "t", " ", None, "low")]
    df = spark.createDataFrame(rows, "n int, thread_id string, title string, idempotency_key string, "
                                     "priority string")
    got = P.idempotent_create(df.filter("n < 5"), ["n"]).orderBy("n").collect()
    assert [(r["n"], r["idempotency_key"]) for r in got] == [(1, "t:排水"), (3, "k1")]
    err = [r["error"] for r in P.validate_tasks(df, "create").orderBy("n").collect()]
    assert err == [None, "参数错误: priority 需为 low/normal/high", None, None, "参数错误: title 必填"]


def write_batches(df, folder, cut):
    """Files in event order, one per micro-batch."""
    for i, (lo, hi) in enumerate(cut):
        df.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode(
            "append").parquet(f"{folder}/in")


def test_state_lives_across_batches(spark, folder):
    seconds = [0, 1, 2, 3, 64, 65, 66, 67, 200]
    df = calls(spark, seconds)
    write_batches(df, folder, [(0, 3), (3, 6), (6, 9)])
    src = J.read_stream(spark, folder + "/in", "*.parquet", df.schema, 1)
    J.append(S.rate_limit(src, 3, 60), folder + "/rate", folder + "/ck1")
    got = spark.read.parquet(folder + "/rate").orderBy("event_id").collect()
    want = P.rate_limit(df, 3, 60).orderBy("event_id").collect()
    assert [(r["call_no"], r["allowed"]) for r in got] == [(r["call_no"], r["allowed"]) for r in want]
    J.append(S.ttl_first_value(src, 10), folder + "/ttl", folder + "/ck2")
    got = spark.read.parquet(folder + "/ttl").orderBy("event_id").collect()
    want = P.ttl_first_value(df, 10).orderBy("event_id").collect()
    assert [(r["cached"], r["hit"]) for r in got] == [(r["cached"], r["hit"]) for r in want]


def test_stream_of_a_folder(spark, folder):
    """A table can be one file or a folder of files of that name."""
    df = calls(spark, [0, 10, 50])
    df.repartition(2).write.parquet(f"{folder}/in/events.parquet")
    J.append(S.rate_limit(J.read_stream(spark, folder + "/in", "events.parquet", df.schema), 3, 60),
             folder + "/rate", folder + "/ck")
    assert spark.read.schema("event_id long").parquet(folder + "/rate").count() == 3


def test_stream_of_a_file(spark, folder):
    """A table of one file, and folders of partitions below the table's name, not above it."""
    df = calls(spark, [0, 10, 50])
    base = folder + "/run=1"
    df.coalesce(1).write.parquet(folder + "/made")
    os.makedirs(base)
    (made,) = glob.glob(folder + "/made/*.parquet")
    shutil.copy(made, base + "/events.parquet")
    shutil.copy(made, base + "/other-events.parquet")
    df.withColumn("day", F.col("event_id") % 2).write.partitionBy("day").parquet(base + "/days.parquet")
    for name in ("events", "days"):
        table = spark.read.parquet(f"{base}/{name}.parquet")
        J.append(J.read_stream(spark, base + "/", name + ".parquet", table.schema),
                 f"{folder}/{name}", f"{folder}/{name}-ck")
        got = spark.read.schema(table.schema).parquet(f"{folder}/{name}").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, table.collect())) and len(got) == 3


def test_late_rows(spark, folder):
    """Calls that come a batch late neither end a period early nor change what was handed out."""
    df = calls(spark, [0, 10, 50, 5, 100, 101])
    write_batches(df, folder, [(0, 3), (3, 4), (4, 6)])
    src = J.read_stream(spark, folder + "/in", "*.parquet", df.schema, 1)
    J.append(S.rate_limit(src, 3, 60), folder + "/rate", folder + "/ck1")
    got = spark.read.parquet(folder + "/rate").orderBy("event_id").collect()
    assert [r["call_no"] for r in got] == [1, 2, 3, 4, 5, 6]
    J.append(S.ttl_first_value(src, 30), folder + "/ttl", folder + "/ck2")
    got = spark.read.parquet(folder + "/ttl").orderBy("event_id").collect()
    assert [r["hit"] for r in got] == [False, True, False, True, False, True]
    assert got[3]["cached"] == got[2]["cached"]


def test_compact_log(spark, folder):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (1, 3, "d")]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "k int, o int, v string").write.parquet(f"{folder}/log/batch_no={n}")
    got = J.compact(spark.read.parquet(folder + "/log"), folder + "/small", ["k"], ["o"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [(1, "d"), (2, "c")]


def test_summary_rule_is_one(spark):
    """The stream merges the same lines as the batch form."""
    texts = ["hello there", "the answer", "x" * 500, "THE ANSWER", "the answer", "", "ok"]
    rows = [(1, i, ["user", "assistant", "tool"][i % 3], t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = O.rule_summary(df).first()["summary"]
    lines = df.orderBy("turn").select(O.summary_line(F.col("role"), F.col("text")).alias("s"))
    pairs = [(r["s"]["line"], r["s"]["key"]) for r in lines.collect()]
    assert S.merge_summary("", pairs) == want
    assert S.merge_summary("before", pairs) == ("before\n" + want)[:6000]


def test_creates_are_idempotent_across_batches(spark, folder):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), "t", t, None)
                                for i, t in enumerate("aabacb")],
                               "event_id long, ts timestamp, thread_id string, title string, "
                               "idempotency_key string")
    write_batches(df, folder, [(0, 2), (2, 4), (4, 6)])
    src = J.read_stream(spark, folder + "/in", "*.parquet", df.schema, 1)
    J.create_tasks(src, folder + "/tasks", ["event_id"], folder + "/ck")
    got = spark.read.parquet(folder + "/tasks").select("title", "event_id").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 2), ("c", 4)]


def test_rolling_conversation(spark, folder):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"第{i}句" + "长" * 50, i) for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, event_id long")
    write_batches(df, folder, [(0, 4), (4, 9)])
    src = J.read_stream(spark, folder + "/in", "*.parquet", df.schema, 1).drop("event_id")
    J.append(S.rolling_conversations(src, 4, 200), folder + "/out", folder + "/ck",
             empty_batches=False)
    last = spark.read.parquet(folder + "/out").orderBy(F.desc("last_turn")).first()
    assert last["kept"] == 4 and last["trimmed"] == 5 and last["summary"].startswith("用户问：第0句")


def test_confirmations(spark):
    p = spark.createDataFrame([("a", "t1", "task_create", "{}")],
                              "confirmation_id string, thread_id string, tool string, args string")
    d = spark.createDataFrame([(1, 1, "a", "t2", True), (2, 2, "a", "t1", True), (3, 3, "a", "t1", True),
                               (4, 4, "b", "t1", True)],
                              "decision_id int, ts int, confirmation_id string, thread_id string, approved boolean")
    got = {r["decision_id"]: r["status"] for r in P.apply_confirmations(p, d).collect()}
    assert got == {1: "forbidden", 2: "executed", 3: "not_found", 4: "not_found"}


@pytest.mark.parametrize("err,level,want", [("LLM_TIMEOUT", 2, 2), ("SUMMARY_FAILED", 1, 3),
                                            ("LLM_TOKEN_OVERFLOW", 4, 4), ("X", 1, 2)])
def test_next_level(spark, err, level, want):
    assert spark.range(1).select(D.next_level(F.lit(err), F.lit(level))).first()[0] == want
