"""Text normalization and Thai tokens over whole documents.

The driver's texts are Latin, so one query writes them in Thai letters, and others put phrases of other
scripts behind them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .base import quote, query, table
from .tagging import _PT, _part_terms

# Forms that normalization changes, and what becomes of them.
RAW = " ２５ ˚C，ＫＭ３ kg　５０ ％ ㎡​ ๑๒ ml what？？？ 好。。。吗 室温 ℃！！！、"
CLEAN = " 25℃,KM3kg 50 % m2 12ml what? 好。吗 室温℃!"
# Damaged tone marks, and their repair.
BROKEN = " เช้ือรา น้้า รากเนําโคน"
REPAIRED = " เชื้อรา น้ำ รากเนำโคน"

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_THAI = "กขคฆงจฉชซญดตถทธนบปผฝพฟมยรล"

# The same rules for the driver's texts: white space, units behind numbers, repeated marks.
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({t},
  '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}]+', ' ', 'g'),
  '([0-9]) +(mm|cm|km|kg|mg|ml|ppm|ha|m|g|l)([^\pL\pN_]|$)', '\1\2\3', 'gi'),
  '!{{3,}}', '!', 'g'), '\?{{3,}}', '?', 'g')"""
_EDGE = "' 。，、；：,;:~～'"


def _plain(text: str) -> str:
    return f"trim({_PLAIN.format(t=text)}, {_EDGE})"


def _before(text: str) -> str:
    """The same with something behind it, so its end is no end."""
    return f"rtrim(ltrim({_PLAIN.format(t=text)}, {_EDGE}), ' ')"


@query("normalize_texts", f"SELECT doc_id, md5({_before('text')} || {quote(CLEAN)}) AS text_md5, "
                          f"md5(lower({_plain('text')})) AS folded_md5 FROM documents")
def normalize_texts(spark, sf_dir):
    """Form normalization of whole texts with phrases in other forms behind them; case folding."""
    d = X.spread(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", F.md5(X.normalize_text(F.concat(F.rtrim("text"), F.lit(RAW)))).alias("text_md5"),
        F.md5(X.normalize_text("text", fold_case=True)).alias("folded_md5"))


_WROTE = f"translate(lower(text), '{_LATIN}', '{_THAI}')"


@query("normalize_thai_texts", f"SELECT doc_id, md5({_before(_WROTE)} || {quote(REPAIRED)}) "
                               "AS text_md5 FROM documents")
def normalize_thai_texts(spark, sf_dir):
    """Whole texts in Thai letters with damaged words behind them: normalized, then repaired."""
    d = X.spread(table(spark, sf_dir, "documents"))
    thai = F.translate(F.lower("text"), _LATIN, _THAI)
    return d.select("doc_id", F.md5(X.normalize_thai_text(
        F.concat(F.rtrim(thai), F.lit(BROKEN)))).alias("text_md5"))


@query("normalize_queries", f"""SELECT conv_id, turn, role, md5(CASE WHEN role = 'user'
  THEN {_before('text')} || {quote(REPAIRED)} ELSE {_plain('text')} END) AS text_md5
FROM conversations""")
def normalize_queries(spark, sf_dir):
    """Turns as queries: those with Thai words are repaired too, the others only normalized."""
    d = X.spread(table(spark, sf_dir, "conversations"))
    asked = F.when(F.col("role") == "user", F.concat(F.rtrim("text"), F.lit(BROKEN))) \
        .otherwise(F.col("text"))
    return d.select("conv_id", "turn", "role", F.md5(X.normalize_query(asked)).alias("text_md5"))


@query("thai_terms", f"WITH {_PT} SELECT DISTINCT alias FROM pt WHERE contains(alias, 'ใบ')")
def thai_terms(spark, sf_dir):
    """The aliases of a term table that are written in Thai."""
    return X.thai_terms(_part_terms(spark, sf_dir))


# Every term stands for itself by one private character and is then taken out of the leftover runs.
_FIRST, _REST = 0xE000, 0xF8FF


@query("thai_tokens", f"""WITH w AS (
  SELECT DISTINCT translate(lower(w), '{_LATIN}', '{_THAI}') AS term FROM (
    SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{8,}}')) AS w FROM benchmark)),
o AS (SELECT term, row_number() OVER (ORDER BY length(term) DESC, term) - 1 AS k FROM w),
l AS (SELECT list({{'term': term, 'mark': chr(({_FIRST} + k)::INTEGER)
    || repeat(chr({_REST}), length(term) - 1)}} ORDER BY k) AS terms FROM o),
d AS (SELECT doc_id, {_WROTE} AS text FROM documents),
m AS (SELECT doc_id, list_reduce(list_prepend({{'term': '', 'mark': text}}, terms),
    lambda a, b: {{'term': '', 'mark': replace(a.mark, b.term, b.mark)}}).mark AS masked
  FROM d, l),
r AS (SELECT doc_id, masked, unnest(regexp_extract_all(masked, '[ก-๿{chr(_FIRST)}-{chr(_REST)}]+')) AS run,
    generate_subscripts(regexp_extract_all(masked, '[ก-๿{chr(_FIRST)}-{chr(_REST)}]+'), 1) AS i FROM m),
f AS (SELECT doc_id, i, regexp_replace(run, '[{chr(_FIRST)}-{chr(_REST)}]', '', 'g') AS rest FROM r),
g AS (SELECT doc_id, unnest(regexp_extract_all(masked, '[{chr(_FIRST)}-{chr(_REST - 1)}]')) AS mark,
    generate_subscripts(regexp_extract_all(masked, '[{chr(_FIRST)}-{chr(_REST - 1)}]'), 1) AS p
  FROM m),
t AS (
  SELECT doc_id, 0 AS a, p AS b, 0 AS c, term FROM g JOIN o ON ord(mark) = {_FIRST} + k
  UNION ALL SELECT doc_id, i, 1, 0, rest FROM f WHERE length(rest) BETWEEN 2 AND 14
  UNION ALL SELECT doc_id, i, n, s, substr(rest, s::BIGINT, n) FROM f, (VALUES (3), (4)) v(n),
    unnest(generate_series(1, length(rest) - n + 1)) u(s)),
u AS (SELECT doc_id, term, min((a, b, c)) AS place FROM t GROUP BY ALL)
SELECT doc_id, count(term) AS n_tokens, md5(coalesce(string_agg(term, '|' ORDER BY place), ''))
  AS tokens_md5 FROM documents LEFT JOIN u USING (doc_id) GROUP BY doc_id""")
def thai_tokens(spark, sf_dir):
    """Whole texts in Thai letters, cut by a dictionary of the benchmark's long words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w"))
    words = words.select(F.translate(F.lower("w"), _LATIN, _THAI).alias("w")).distinct()
    terms = sorted((r.w for r in words.collect()), key=lambda w: (-len(w), w))
    d = X.spread(table(spark, sf_dir, "documents"))
    d = X.once(d, "t", X.tokenize_thai(F.translate(F.lower("text"), _LATIN, _THAI), terms))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("t", "|")).alias("tokens_md5"))
