"""Terminology: dictionary tagging, canonical vocabulary, query building, chunk records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import tagging as G
from ..functions.matching import first_numbers
from ..functions.text import normalize_text, once
from ..sources.stage import staged
from .prefix import numbered

# Up to here the dictionary becomes one CASE per slot (JVM); above it an automaton reads the texts.
CASE_TERMS = 256
# Keys that come to the driver as one list; a larger dictionary stays a table.
MAX_TERMS = 200_000
# Bytes of keys, names and slots that one automaton is made of; more take further automata.
BLOCK_BYTES = 2 << 20
# Automata that a text passes before the rows are written down.
CHAINED = 16


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size is bounded; refuse it when it is larger than allowed."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def entity_keys(terms: DataFrame) -> DataFrame:
    """Match keys ``(key, value, slot, ord)``: folded aliases and canonical names of entity slots.

    ``terms``: category, category_ord, alias_ord, alias, canonical.
    """
    slot = G.first_case(
        [(F.col("category") == c, F.lit(V.SLOT_BY_TYPE[t]))
         for c, (_, t) in V.CATEGORY_PREFIX_TYPE.items() if t in V.SLOT_BY_TYPE],
        F.lit(None).cast("string"))
    return (terms.withColumn("slot", slot).filter("slot IS NOT NULL")
            .select(F.explode(F.array(
                F.struct(F.col("alias").alias("alias"), F.lit(0).alias("o")),
                F.struct(F.col("canonical").alias("alias"), F.lit(1).alias("o")))).alias("f"),
                    F.col("canonical").alias("value"), "slot", "category_ord", "alias_ord")
            .transform(_fold_keys))


def concept_keys(concepts: DataFrame) -> DataFrame:
    """The same keys from the canonical vocabulary; the value is the canonical id."""
    slot = G.first_case([(F.col("type") == t, F.lit(s)) for t, s in V.SLOT_BY_TYPE.items()],
                        F.lit(None).cast("string"))
    forms = F.concat(F.array("canonical_name"), "aliases.zh", "aliases.en", "aliases.th",
                     "aliases.ms")
    return (concepts.withColumn("slot", slot).filter("slot IS NOT NULL")
            .select(F.posexplode(F.array_distinct(forms)).alias("alias_ord", "a"),
                    F.col("canonical_id").alias("value"), "slot",
                    F.regexp_extract("canonical_id", r"(\d+)$", 1).cast("int")
                    .alias("category_ord"))
            .withColumn("f", F.struct(F.col("a").alias("alias"), F.lit(0).alias("o")))
            .transform(_fold_keys))


def _fold_keys(df: DataFrame) -> DataFrame:
    key = F.lower("f.alias")
    wide = (F.length(key) >= 2) | key.rlike("[" + V.CJK + "]")
    return (df.withColumn("key", key).filter(wide)
            .groupBy("key", "slot")
            .agg(F.min_by("value", F.struct("category_ord", "alias_ord", "f.o", "value"))
                 .alias("value"),
                 F.min(F.struct("category_ord", "alias_ord", F.col("f.o").alias("o"),
                                F.col("value").alias("v"))).alias("ord")))


def dictionary(keys: DataFrame, limit: int = MAX_TERMS) -> list[tuple[str, str, str]] | DataFrame:
    """``(key, value, slot)`` on the driver, longest first, then dictionary order.

    More than ``limit`` keys stay the table that they are; ``detect_entities`` takes both.
    """
    rows = keys.limit(limit + 1).collect()
    if len(rows) > limit:
        return keys
    rows.sort(key=lambda r: (-len(r["key"]), tuple(r["ord"])))
    return [(r["key"], r["value"], r["slot"]) for r in rows]


_FOUND = "struct<slot:string,value:string,rank:int>"


def _found_by_case(value: Column, words: list[tuple[str, str, str]]) -> Column:
    slots: dict[str, list] = {}
    for rank, (key, name, slot) in enumerate(words):
        slots.setdefault(slot, []).append((key, name, rank))
    hits = [G.first_case(
        [(F.contains(value, F.lit(k)),
          F.struct(F.lit(s).alias("slot"), F.lit(n).alias("value"), F.lit(r).alias("rank")))
         for k, n, r in entries], F.lit(None).cast(_FOUND)) for s, entries in slots.items()]
    found = F.array(*hits) if hits else F.array().cast(f"array<{_FOUND}>")
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()),
                        lambda a, b: a["rank"] - b["rank"])


def _ranked_keys(keys: DataFrame) -> DataFrame:
    """``key, value, slot, rank, block``: all keys numbered, longest first, then by ``ord``, in blocks of at
    most ``BLOCK_BYTES`` and one key.

    Numbers and sizes run on over ranges of the order; only one row per range reaches the driver.
    """
    order = [F.desc(F.length("key")), F.asc("ord"), F.asc("key"), F.asc("slot")]
    size = sum((F.octet_length(c) for c in ("key", "value", "slot")), F.lit(48))
    split = staged(keys.groupBy("key", "slot")
                   .agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
                   .withColumn("size", size).repartitionByRange(*order)
                   .withColumn("part", F.spark_partition_id()), "keys")
    ahead, rows, total = [], 0, 0
    for r in split.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")) \
            .orderBy("part").collect():
        ahead += [F.lit(r["part"]), F.struct(F.lit(rows).alias("n"), F.lit(total).alias("size"))]
        rows, total = rows + r["n"], total + r["size"]
    w = Window.partitionBy("part").orderBy(*order)
    before = F.create_map(*ahead)[F.col("part")] if ahead else F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("size"))
    at = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return split.select(
        "key", "value", "slot", (F.row_number().over(w) - 1 + before["n"]).cast("long").alias("rank"),
        F.floor((F.coalesce(at, F.lit(0)) + before["size"]) / BLOCK_BYTES).alias("block"))


_TAG = pa.struct([("slot", pa.string()), ("value", pa.string()), ("rank", pa.int64())])
_TAGS = "array<struct<slot:string,value:string,rank:bigint>>"


def _tagger(rows: list):
    """A function of texts and the tags of earlier blocks, whose keys all rank before ``rows``."""
    words = tuple(dict.fromkeys(r["key"] for r in rows))
    slots = list(dict.fromkeys(r["slot"] for r in rows))
    number, slot_no = ({w: i for i, w in enumerate(x)} for x in (words, slots))
    groups: list[list[int]] = [[] for _ in words]
    tags: dict[tuple[int, int], dict] = {}
    for r in rows:
        i, g = number[r["key"]], slot_no[r["slot"]]
        groups[i].append(g)
        tags[g, i] = {"slot": r["slot"], "value": r["value"], "rank": r["rank"]}

    @F.arrow_udf(_TAGS)
    def tag(texts: pa.Array, before: pa.Array) -> pa.Array:
        out = []
        for text, held in zip(texts.to_pylist(), before.to_pylist()):
            known = {t["slot"] for t in held or ()}
            new = [tags[x] for x in first_numbers(text or "", words, groups).items()]
            out.append((held or []) + sorted((t for t in new if t["slot"] not in known),
                                             key=lambda t: t["rank"]))
        return pa.array(out, pa.list_(_TAG))
    return tag


def with_tags(df: DataFrame, keys: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``array(slot, value, rank)``: the best key per slot that a text holds, best first.

    ``keys``: key, value, slot, ord.  The longest key wins, then the smallest ``ord``.  The dictionary is
    cut into blocks of bounded size, in order of rank; each becomes one automaton that walks once over
    every text, inside the rows' own partitions, so nothing is shuffled.
    """
    ranked = staged(_ranked_keys(keys), "keys")
    blocks = ranked.agg(F.max("block")).first()[0]
    df = df.withColumn(out, F.array().cast(_TAGS))
    for block in range(0 if blocks is None else blocks + 1):
        rows = ranked.where(F.col("block") == block).orderBy("rank").collect()
        if block and block % CHAINED == 0:
            df = staged(df, "tags")
        if rows:
            df = df.withColumn(out, _tagger(rows)(F.col(text), F.col(out)))
    return df


def find_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``id, slot, value, rank``: the best key per slot for ``texts(id, v)``, see ``with_tags``."""
    return with_tags(texts.select("id", "v"), keys, "v", "__tags").select(
        "id", F.inline("__tags"))


def detect_entities(df: DataFrame, words: list[tuple[str, str, str]] | DataFrame,
                    text: str = "text", out: str = "entities", normalized: bool = False
                    ) -> DataFrame:
    """Add the map slot -> name: the longest dictionary key per slot, plus orchard and plot codes.

    ``words`` comes from ``dictionary(entity_keys(...))`` or, for ids, ``concept_keys``, or is a table
    of such keys, of any size.  ``normalized`` says that the text went through
    ``normalize_text`` already.
    """
    df = once(df, "__v", F.lower(text) if normalized else normalize_text(text, fold_case=True))
    if isinstance(words, DataFrame) or len(words) > CASE_TERMS:
        if not isinstance(words, DataFrame):
            words = df.sparkSession.createDataFrame(
                [(k, n, s, r) for r, (k, n, s) in enumerate(words)],
                "key string, value string, slot string, ord long")
        df = with_tags(df, words, "__v", "__found")
    else:
        df = df.withColumn("__found", _found_by_case(F.col("__v"), words))
    df = df.withColumn("__found", F.transform("__found", lambda x: F.struct(
        x["slot"].alias("slot"), x["value"].alias("value"))))
    codes = [("orchard", G.orchard_code("__v")), ("plot", G.plot_code("__v"))]
    extra = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("value")) for s, c in codes])
    pairs = F.filter(F.concat("__found", extra), lambda x: x["value"].isNotNull())
    return df.withColumn(out, F.map_from_entries(pairs)).drop("__v", "__found")


def flat_terms(terms: DataFrame) -> DataFrame:
    """alias -> canonical; a later category overwrites an earlier one."""
    return terms.groupBy("alias").agg(
        F.max_by("canonical", F.struct("category_ord", "alias_ord")).alias("canonical"))


def alias_lists(terms: DataFrame) -> DataFrame:
    """canonical -> its aliases, itself excluded, in dictionary order."""
    order = terms.groupBy("alias").agg(
        F.min(F.struct("category_ord", "alias_ord")).alias("o"))
    item = F.struct("o", F.when(F.col("alias") != F.col("canonical"), F.col("alias")).alias("a"))
    return (flat_terms(terms).join(order, "alias").groupBy("canonical")
            .agg(F.array_sort(F.collect_list(item)).alias("x"))
            .select("canonical", F.filter(F.col("x.a"), lambda a: a.isNotNull())
                    .alias("aliases")))


def alias_map(terms: DataFrame, limit: int = MAX_TERMS) -> dict[str, list[str]] | DataFrame:
    """Alias lists on the driver; more than ``limit`` stay the table that they are."""
    lists = alias_lists(terms)
    rows = lists.limit(limit + 1).collect()
    return lists if len(rows) > limit else {r["canonical"]: r["aliases"] for r in rows}


def _alias_lists_of(df: DataFrame, names: Column, aliases) -> tuple[DataFrame, Column]:
    """The alias list of every name of a row, in order: a literal map, or a join with a table."""
    empty = F.array().cast("array<string>")
    if not isinstance(aliases, DataFrame):
        lists = (F.create_map(*[x for k, v in aliases.items() for x in (
            F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
            if aliases else F.create_map().cast("map<string,array<string>>"))
        return df, F.transform(names, lambda n: F.coalesce(lists[n], empty))
    df = staged(df.withColumn("__id", F.monotonically_increasing_id()), "queries")
    named = df.select("__id", F.posexplode(names).alias("at", "canonical"))
    lists = named.join(aliases, "canonical").groupBy("__id").agg(F.map_from_entries(
        F.collect_list(F.struct("canonical", "aliases"))).alias("__lists"))
    df = df.join(lists, "__id", "left").drop("__id")
    return df, F.transform(names, lambda n: F.coalesce(F.col("__lists")[n], empty))


def build_queries(df: DataFrame, words, aliases: dict[str, list[str]] | DataFrame,
                  text: str = "text", entities: str | None = None) -> DataFrame:
    """Add ``original``, ``canonical`` and ``expanded`` query texts.

    ``entities`` names an existing slot map; without it entities are detected from the text.
    ``aliases`` is a map or a table ``(canonical, aliases)`` of any size.
    """
    df = once(df, "original", normalize_text(text))
    if entities is None:
        df, entities = detect_entities(df, words, "original", "__e", normalized=True), "__e"
    names = F.filter(F.map_values(F.col(entities)), lambda x: x.isNotNull() & (x != ""))
    df, lists = _alias_lists_of(df, F.array_distinct(names), aliases)
    add = F.aggregate(names, F.col("original"), lambda acc, n: F.when(
        F.contains(acc, n), acc).otherwise(F.trim(F.concat_ws(" ", acc, n))))
    own = F.transform(F.array_distinct(names), lambda n: F.array(n))
    terms = F.array_distinct(F.flatten(F.zip_with(own, lists, lambda a, b: F.concat(a, b))))
    return (df.withColumn("canonical", add)
            .withColumn("expanded", F.concat_ws(" ", "original", terms)).drop("__e", "__lists"))


def _numbers(named: DataFrame) -> DataFrame:
    """``prefix, canonical, n``: names numbered within their prefix, in order, by ranges of names."""
    return numbered(named.select("prefix", "canonical"), ["prefix"], [F.asc("canonical")], "n")


def build_concepts(terms: DataFrame) -> DataFrame:
    """Canonical vocabulary: one row per canonical name with a stable id and grouped aliases."""
    known = F.create_map(*[x for c, (p, t) in V.CATEGORY_PREFIX_TYPE.items()
                           for x in (F.lit(c), F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")))])
    order = F.struct("category_ord", "alias_ord")
    named = terms.groupBy("canonical").agg(
        F.min_by("category", order).alias("first"),
        F.array_sort(F.collect_set("category")).alias("source_categories"))
    prefix = F.coalesce(known[F.col("first")]["p"], F.lit("TERM"))
    named = named.withColumn("prefix", prefix).withColumn(
        "type", F.coalesce(known[F.col("first")]["t"], F.lit("unknown")))
    number = _numbers(named)
    alias = (terms.filter(F.col("alias") != F.col("canonical"))
             .groupBy("canonical", "alias").agg(F.max_by("category", order).alias("category"))
             .withColumn("lang", G.alias_language("alias", "category")))
    grouped = alias.groupBy("canonical").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("lang") == g, F.col("alias")))).alias("a_" + g)
        for g in V.LANGUAGES])
    own = G.alias_language("canonical", "first")
    empty = F.array().cast("array<string>")

    def group(g):
        mine = F.when(own == g, F.array("canonical")).otherwise(empty)
        return F.concat(mine, F.coalesce("a_" + g, empty)).alias(g)

    return (named.join(number, ["prefix", "canonical"]).join(grouped, "canonical", "left").select(
        F.concat_ws("_", "prefix", F.lpad(F.col("n").cast("string"), F.greatest(
            F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("canonical_id"),
        "type", F.col("canonical").alias("canonical_name"),
        F.struct(*[group(g) for g in V.LANGUAGES]).alias("aliases"),
        empty.alias("related_entities"), "source_categories"))


def concept_counts(concepts: DataFrame) -> DataFrame:
    n = sum((F.size("aliases." + g) for g in V.LANGUAGES), F.lit(0))
    return concepts.agg(F.count("*").alias("concepts"), F.sum(n).alias("aliases"))


def chunk_records(df: DataFrame, words) -> DataFrame:
    """Corpus rows to search records with entities, domain, source type and scopes.

    ``df``: chunk_id, document_id, language, text, provenance, block_type.
    """
    df = once(df, "__n", normalize_text("text"))
    df = detect_entities(df, words, "__n", normalized=True)
    return df.select(
        "chunk_id", "document_id",
        F.coalesce(F.nullif("language", F.lit("")), F.lit("zh")).alias("language"),
        F.col("document_id").alias("title"), F.lit("").alias("section"), "entities",
        G.infer_domain("__n", "entities").alias("domain"),
        G.source_type("provenance", "block_type").alias("source_type"),
        F.array(*map(F.lit, V.DEFAULT_ROLE_SCOPE)).alias("role_scope"),
        F.array().cast("array<string>").alias("orchard_scope"), "text")
