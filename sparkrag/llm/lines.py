"""Removal of repeated multi-line chunks with content-defined borders, in DataFrame operations only.

A rolling hash over the hashes of the last three lines decides where a chunk ends, so borders move
with the content: lines put in or taken out above change the chunks next to them and no others.
Chunks of two and more lines are counted by hash; those whose hash repeats are compared byte by
byte, and all but the first occurrence go.

A passage whose ends fall inside chunks keeps lines by this rule, and one that holds no complete chunk
stays; ``remove_repeated_passages`` compares all pairs of neighbouring lines and leaves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.stage import staged
from .common import parts_for, quoted, text_bytes

SPAN = 3  # lines that a border depends on
ONE_IN = 4  # lines per border on average
TARGET = 16 << 20  # bytes of text per shuffle partition

_PRIME = 2147483647
_BASE = 31


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


def _ends(hashes: Column) -> Column:
    """Numbers, from 1, of the last lines of the chunks."""
    def border(i: Column) -> Column:
        rolling = F.get(hashes, i - 1)
        for back in range(1, SPAN):
            rolling = rolling + _BASE ** back * F.when(
                i > back, F.get(hashes, i - 1 - back)).otherwise(0)
        return (i == F.size(hashes)) | (rolling % _PRIME % ONE_IN == 0)

    return F.filter(F.sequence(F.lit(1), F.size(hashes)), border)


def line_chunks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, n, chunk``: the chunks of ``docs(keys, text)`` with two and more lines."""
    df = docs.where("text is not null").select(*keys, F.split("text", "\n", -1).alias("lines"))
    df = once(df, "hashes", _line_hashes(F.col("lines")))
    df = once(df, "ends", _ends(F.col("hashes"))).drop("hashes")
    before = F.concat(F.array(F.lit(0)), F.col("ends"))
    spans = F.zip_with(before, F.col("ends"),
                       lambda a, b: F.struct((a + 1).alias("start"), (b - a).alias("n")))
    spans = F.filter(spans, lambda s: s["n"] > 1)
    df = df.select(*keys, "lines", F.explode(spans).alias("s"))
    return df.select(*keys, "s.start", "s.n",
                     F.array_join(F.slice("lines", F.col("s.start"), F.col("s.n")), "\n")
                     .alias("chunk"))


def _without(lines: Column, spans: Column) -> Column:
    """``lines`` without ``spans(start, n)``, which are disjoint and in order."""
    opens = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["start"] + s["n"]))
    closes = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(lines) + 1))
    return F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice(lines, a, b - a)))


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the lines in ``spans(doc_id, __row, __spans)``, and their numbers."""
    row = F.xxhash64(docs["text"])
    out = docs.withColumn("__row", row).alias("d").join(
        spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
        & (F.col("d.__row") == F.col("s.__row")), "left").select("d.*", "s.__spans")
    lines = F.split("text", "\n", -1)
    removed = F.coalesce(F.aggregate("__spans", F.lit(0), lambda t, s: t + s["n"]), F.lit(0))
    kept = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(
        F.array_join(_without(F.col("__lines"), F.col("__spans")), "\n"))
    out = out.withColumn("__lines", lines).withColumns({
        "n_lines": F.coalesce(F.size("__lines"), F.lit(0)), "n_removed": removed, "__kept": kept})
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")))
    return out.select(*[F.col("__kept").alias("text") if n == "text" else c
                        for n, c in zip(docs.columns, quoted(docs.columns))],
                      "n_lines", "n_removed")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with ``text`` cut, and ``n_lines, n_removed``.

    A chunk of two and more lines that occurs more than once, in one document or in several, stays
    where (doc_id, line number) is smallest and goes elsewhere; null doc_ids come first.  Lines
    end at line feeds.  A null text stays null with zero lines; an empty text is one empty
    line.  Rows that repeat doc_id and text share their places, so none of them loses what another
    keeps.  Columns named ``n_lines`` or ``n_removed`` are replaced, others stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    spans = _repeated_chunks(docs, ["doc_id", "start"]).groupBy("doc_id", "__row").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("__spans"))
    return _cut(docs, spans)


def _repeated_chunks(docs: DataFrame, place: list[str]) -> DataFrame:
    """``doc_id, __row, start, n``: chunks that occur at a smaller ``place`` too."""
    parts = parts_for(docs, text_bytes(docs), TARGET)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__row"), "text")
    chunks = line_chunks(keyed, ["doc_id", "__row"])
    chunks = chunks.withColumn("hash", F.xxhash64("chunk"))
    twice = chunks.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    repeated = staged(chunks.repartition(parts, "hash").join(twice.select("hash"), "hash",
                                                            "left_semi"), "chunks")
    at = F.struct(*place)
    first = repeated.groupBy("hash", "chunk").agg(F.min(at).alias("first"))
    later = (repeated.join(first, ["hash", "chunk"])  # the chunk itself is a key: bytes compared
             .where(~at.eqNullSafe(F.col("first"))))
    return later.select("doc_id", "__row", "start", "n")


def line_pairs(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, a, b, c, d``: every two neighbouring lines, each line as a 128-bit hash."""
    df = docs.where("text is not null").select(*keys, F.split("text", "\n", -1).alias("lines"))
    df = once(df, "hashes", F.transform("lines", lambda x: F.struct(
        F.xxhash64(x).alias("x"), F.xxhash64(F.lit(1), x).alias("y")))).drop("lines")
    n = F.size("hashes") - 1
    pairs = F.zip_with(F.slice("hashes", F.lit(1), n), F.slice("hashes", F.lit(2), n),
                       lambda p, q: F.struct(p["x"].alias("a"), p["y"].alias("b"),
                                             q["x"].alias("c"), q["y"].alias("d")))
    return (df.where(n > 0).select(*keys, F.posexplode(pairs).alias("at", "pair"))
            .select(*keys, (F.col("at") + 1).alias("start"), "pair.*"))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """As ``remove_repeated_lines``, for passages of two and more lines wherever they begin and end.

    Repeated content-defined chunks are found and compared byte by byte, the first by (doc_id, hash of
    the text, line number) stays; pairs of lines then take the passages up to their edges.  Two neighbouring lines go if an earlier place holds them too, so a passage goes up to the edges
    of what is equal.  Earlier is a smaller (doc_id, hash of the text, line number); inside a text
    only pairs that share no line count, so of equal lines in a row the first two stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__row"), "text")
    pairs = staged(line_pairs(keyed, ["doc_id", "__row"]), "pairs")
    pair = ["a", "b", "c", "d"]
    first = pairs.groupBy(*pair).agg(
        F.min(F.struct("doc_id", "__row", "start")).alias("first"), F.count("*").alias("times"))
    later = pairs.join(first.where("times > 1"), pair).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
          & (F.col("__row") == F.col("first.__row"))
          & (F.col("start") < F.col("first.start") + 2)))
    # Repeated chunks first; the pairs reach the edges that fall inside chunks.
    cut = _repeated_chunks(docs, ["doc_id", "__row", "start"]).select(
        "doc_id", "__row", F.sequence("start", F.col("start") + F.col("n") - 1).alias("at"))
    cut = cut.unionByName(later.select("doc_id", "__row", F.array(
        F.col("start"), F.col("start") + 1).alias("at")))
    spans = cut.groupBy("doc_id", "__row").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("gone"))
    return _cut(docs, spans.select("doc_id", "__row", F.transform(
        "gone", lambda i: F.struct(i.alias("start"), F.lit(1).alias("n"))).alias("__spans")))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h + {_BASE} * coalesce(lag(h, 1) OVER w, 0)
    + {_BASE ** 2} * coalesce(lag(h, 2) OVER w, 0)) % {_PRIME} % {ONE_IN} = 0 AS border
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(border::INT) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
k AS (SELECT doc_id, c, min(i) AS start, count(*) AS n,
    string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, c),
p AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) > 1 AND n > 1 AS gone
  FROM k)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines,
  coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY start) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id"""
