import random

import pytest
from pyspark.sql import functions as F

from sparkrag.functions.splitting import _whole_or_pieces, chunks_of
from sparkrag.operators import blocks as B
from sparkrag.operators import segments as S

SCHEMA = ("doc_id string, pos long, type string, text string, content string, image_path string, "
          "page_idx int, page_scan boolean")


def test_types(spark):
    rows = [("d", 0, None, "第一章 施肥", None, None, None, False),
            ("d", 1, None, "每株施复合肥。", None, None, None, False),
            ("d", 2, None, "|a|b|\n|-|-|", None, None, None, False),
            ("d", 3, None, "", None, "x/y.PNG", None, False),
            ("d", 4, "Image", "", None, "p.png", 3, True), ("d", 5, "tbl", "x", None, None, 1, False)]
    got = [r["block_type"] for r in B.type_blocks(spark.createDataFrame(rows, SCHEMA))
           .orderBy("pos").collect()]
    assert got == ["title", "text", "table", "image", "scan_page", "table"]


def test_section_chunks(spark):
    long_table = "|a|\n" * 400
    rows = [("d", 0, "title", "S1"), ("d", 1, "text", "甲" * 40), ("d", 2, "text", ""),
            ("d", 3, "text", "乙" * 40), ("d", 4, "table", long_table), ("d", 5, "text", "丙" * 70),
            ("d", 6, "image", ""), ("d", 7, "text", "丁" * 70), ("d", 8, "title", "S2"),
            ("d", 9, "text", "戊" * 70)]
    df = spark.createDataFrame(rows, "doc_id string, pos long, type string, text string")
    for c, t in (("content", "string"), ("image_path", "string"), ("page_idx", "int"),
                 ("page_scan", "boolean")):
        df = df.withColumn(c, F.lit(None).cast(t))
    got = [(r["source_index"], r["section"], r["block_type"], r["text"][:1])
           for r in B.chunk_document(B.type_blocks(df)).orderBy("source_index", "piece").collect()]
    assert got == [(1, "S1", "text", "甲"), (4, "S1", "table", "|"), (5, "S1", "text", "丙"),
                   (7, "S1", "text", "丁"), (9, "S2", "text", "戊")]


def test_markdown(spark):
    heads = spark.createDataFrame([("t", 0, "药剂", None, "说明"), ("t", 1, "剂量", "ml", "说明"),
                                   ("t", 2, "症状", None, "说明")],
                                  "table_id string, col int, header string, unit string, caption string")
    cells = spark.createDataFrame([("t", 0, 0, "A"), ("t", 0, 1, "25"), ("t", 0, 2, "黄斑|落叶"),
                                   ("t", 1, 0, "只有一列"), ("t", 0, 3, "多余")],
                                  "table_id string, row int, col int, value string")
    assert B.table_to_markdown(cells, heads).first()["markdown"] == (
        "|药剂|剂量 (ml)|症状|\n|---|---|---|\n|A|25|黄斑\\|落叶|\n|只有一列|||\n说明")


def test_layout(spark):
    rows = [("p", "50 g per tree", 0, 90, 10, 20), ("p", "榴莲施肥", 0, 0, 80, 20),
            ("p", "雨季", 22, 0, 40, 20), ("p", "drain", 200, 0, 40, 20), ("p", "well", 222, 0, 9, 20)]
    df = spark.createDataFrame(rows, "page_id string, text string, top int, left int, width int, height int")
    got = [r["text"] for r in B.restore_layout(df).orderBy("par_idx").collect()]
    assert got == ["榴莲施肥50 g per tree雨季", "drain well"]
    pages = df.withColumns({"doc_id": F.lit("d"), "page_idx": F.lit(0)})
    chunk = B.pages_to_chunks(pages.withColumn("text", F.repeat("text", 10))).first()
    assert chunk["block_type"] == "text" and "drain" in chunk["text"]


def test_layout_of_long_pages(spark):
    """Paragraphs that go on from bucket to bucket, pages of one bucket beside them, chunks in order."""
    rng, rows, want = random.Random(8), [], {}
    for page in range(6):
        top, bottom, paragraphs = rng.choice([0, 65_500]), None, []
        for n in range(rng.choice([1, 40])):
            top += rng.choice([20, 45, 60, 30_000 if page % 2 else 45, 70_000 if page % 2 else 20])
            text = rng.choice(["甲", "b c", " d "])
            if bottom is None or top - bottom > 30:
                paragraphs.append([])
            paragraphs[-1].append(text)
            rows.append((f"p{page}", f"d{page // 3}", page % 3, text, top, 0, 10, 20))
            bottom = top + 20
        for i, p in enumerate(paragraphs):
            got = ""
            for x in map(str.strip, p):
                got += x if not got or "甲" in (got[-1], x[0]) else " " + x
            want[f"p{page}", i] = got
    df = spark.createDataFrame(rows, "page_id string, doc_id string, page_idx int, text string, "
                               "top int, left int, width int, height int").repartition(5)
    got = B.restore_layout(df.drop("doc_id", "page_idx")).collect()
    assert {(r.page_id, r.par_idx): r.text for r in got} == want and len(got) == len(want)
    chunks = B.pages_to_chunks(df.withColumn("text", F.repeat("text", 9)), 120)
    assert chunks.columns[0] == "doc_id"
    starts = [r.source_index for r in chunks.select("source_index").distinct().collect()]
    assert starts == [0]


def test_texts_of_pages_are_shuffled_three_times(spark):
    text = F.sha2(F.col("id").cast("string"), 512)
    df = spark.range(0, 40_000, 1, 4).select(
        F.floor(F.col("id") / 20).alias("page_id"), F.floor(F.col("id") / 100).alias("doc_id"),
        (F.floor(F.col("id") / 20) % 5).cast("int").alias("page_idx"), text.alias("text"),
        (F.col("id") % 20 * 45).cast("int").alias("top"), F.lit(0).alias("left"),
        F.lit(0).alias("width"), F.lit(20).alias("height"))
    before = _shuffled(spark)
    B.pages_to_chunks(df).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 4.5 * 40_000 * 128


def _shuffled(spark):
    """Bytes written to shuffles so far."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lines_are_made_before_the_shuffle(spark):
    """Words in order, backwards and dealt out, with gaps and blanks: parts of lines are all that meet."""
    rng, rows = random.Random(5), []
    for page in range(40):
        for n in range(rng.randrange(1, 90)):
            text = rng.choice(["a", "b b", " ", "", None, "ç"])
            height = rng.choice([None, 20])
            rows.append((f"p{page}", 0, page % 2 or None, n // 10, n, text, n // 10 * 20,
                         rng.randrange(50), rng.choice([None, 10, 25]), height))
    df = spark.createDataFrame(rows, "page_id string, block int, par int, line int, word_no int, "
                               "text string, top int, left int, width int, height int")
    want, seen = {}, [r for r in rows if r[5] and r[5].strip()]
    for r in sorted(seen, key=lambda r: (r[0], r[4])):
        x = want.setdefault(r[:4], [[], r[6], r[7], None, r[9]])
        x[0].append(r[5])
        x[3] = x[3] if r[8] is None else (x[3] or 0) + r[8]
    want = {k: (" ".join(x[0]), *x[1:]) for k, x in want.items()}
    for words in (df.coalesce(1), df.coalesce(1).sortWithinPartitions(F.desc("word_no")),
                  df.repartition(7)):
        got = B.words_to_lines(words)
        assert got.columns == ["page_id", "block", "par", "line", "text", "top", "left", "width",
                               "height"] and dict(got.dtypes)["width"] == "bigint"
        assert {tuple(r[:4]): tuple(r[4:]) for r in got.collect()} == want

    n = F.col("id").cast("int")
    many = spark.range(0, 200_000, 1, 4).select(
        F.floor(n / 1000).alias("page_id"), F.lit(0).alias("block"), F.lit(0).alias("par"),
        F.floor(n / 10).alias("line"), n.alias("word_no"),
        F.substring(F.md5(n.cast("string")), 1, 6).alias("text"), (n % 977).alias("top"),
        (n % 10 * 50).alias("left"), F.lit(60).alias("width"), F.lit(20).alias("height"))
    before = _shuffled(spark)
    B.words_to_lines(many).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 20_000 * 110


def test_containment(spark):
    from sparkrag.operators.corpus import blocks_outside_tables
    b = spark.createDataFrame([(1, "d", 1, 0, 0, 5, 5), (2, "d", 1, 50, 0, 60, 5), (3, "d", 2, 0, 0, 5, 5)],
                              "id int, doc string, page int, x0 int, y0 int, x1 int, y1 int")
    t = spark.createDataFrame([("d", 1, 3, 3, 9, 9)],
                              "doc string, page int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["id"] for r in blocks_outside_tables(b, t).collect()) == [2, 3]


@pytest.mark.parametrize("segment", [200, 999, 1 << 18])
def test_segments_give_the_same_pieces(spark, segment, monkeypatch):
    """Runs cut into segments against runs split whole, with all kinds of marks and blanks."""
    monkeypatch.setattr(S, "SEGMENT", segment)
    rng, rows, want = random.Random(3), [], []
    for doc in range(60):
        runs, pos = [[]], 0
        alphabet = rng.choice(["ab c.,。", "abc", "a" + " " * 30, "xy z"])
        for _ in range(rng.randrange(1, 25)):
            if rng.random() < 0.1:
                rows.append((doc, pos, "title", "T"))
                runs.append([])
            else:
                size = rng.choice([1, 5, 30, 90, 400, 1500])
                text = "".join(rng.choice(alphabet) for _ in range(size))
                rows.append((doc, pos, "text", text))
                if text.strip():
                    runs[-1].append((pos, text.strip()))
            pos += 1
        for run in runs:
            for i, p in enumerate(_whole_or_pieces("\n".join(t for _, t in run), 120, 18, 150)):
                want.append((doc, run[0][0], i, p))
    df = spark.createDataFrame(rows, "doc_id long, pos long, type string, text string")
    for c, t in (("content", "string"), ("image_path", "string"), ("page_idx", "int"),
                 ("page_scan", "boolean")):
        df = df.withColumn(c, F.lit(None).cast(t))
    got = B.chunk_document(B.type_blocks(df.repartition(5)), 120, 0.15)
    assert sorted((r.doc_id, r.source_index, r.piece, r.text) for r in got.collect()) == sorted(want)


def test_document_without_titles(spark, monkeypatch):
    """A long document of one run: no row holds more than a segment and what a window reaches."""
    widest = []
    whole = S._segments

    def watched(texts, rule):
        out = whole(texts, rule)
        widest.append(out.agg(F.max(F.aggregate(
            "items", F.lit(0), lambda a, x: a + F.length(x["text"])))).first()[0])
        return out

    monkeypatch.setattr(S, "_segments", watched)
    n = 200_000
    line = F.concat(F.lit("Block "), F.col("id").cast("string"), F.repeat(F.lit(" wörd"), 4),
                    F.when(F.col("id") % 3 == 0, ".").otherwise(","))
    none = F.lit(None).cast("string")
    df = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"),
                               F.lit("text").alias("type"), line.alias("text"), none.alias("content"),
                               none.alias("image_path"), F.lit(None).cast("int").alias("page_idx"),
                               F.lit(False).alias("page_scan"))
    got = B.chunk_document(B.type_blocks(df)).select("piece", "text", "source_index").collect()
    text = "\n".join(f"Block {i}" + " wörd" * 4 + (".," [i % 3 > 0]) for i in range(n))
    assert [r.text for r in sorted(got, key=lambda r: r.piece)] == chunks_of(text)
    assert {r.source_index for r in got} == {0} and max(widest) <= S.SEGMENT + 802
