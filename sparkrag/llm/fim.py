"""Fill-in-middle transformation: texts cut at two token borders and put together anew.

One full match of a repeated group keeps every repetition, so the ends of the group are the token
borders of a text: their number is the number of tokens, and both cuts are looked up among them.
The cuts and the form of a row come from a digest of a seed and its doc_id, so a repeated
task or a later run makes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  # of a hundred rows, those that are cut
SPM = 80  # of a hundred cut rows, those in suffix-prefix-middle order
COLUMN = "fim"

_SPACE = r"\x20\x09-\x0D"
UNIT = rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
_UNITS = regex.compile(f"({UNIT})*")

_FIELDS = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])
FIELDS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType())])


def transform_text(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE,
                   spm: int = SPM) -> dict:
    """Number of tokens, form, length of prefix and middle in code points, and the new text."""
    ends = _UNITS.fullmatch(text).ends(1)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None,
                "output": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return {"n": n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": output}


def _batches(seed: int, rate: int, spm: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [transform_text(text or "", doc, seed, rate, spm) for text, doc in
                    zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, _FIELDS)], names=[*batch.schema.names, COLUMN])
    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` and ``fim``: n, form, prefix_chars, middle_chars,
    output.

    A token is a run of other characters with the ASCII white space before it, or white space at the
    end.  A row stays plain if its text is empty or holds a marker, or if the digest of its
    doc_id says so; plain rows have no lengths and their text as output.

    A null text counts as empty: no tokens, plain, an empty output.  A null doc_id takes the digest of
    the seed alone.  Every row stands for itself, so rows that repeat a doc_id are cut at the same
    token numbers.  An empty table gives an empty table; other columns stay, also one named like a
    field, and a column named ``fim`` is replaced.  A text is matched whole, in time that grows with
    its length.
    """
    return add_column(docs, COLUMN, FIELDS, _batches(seed, rate, spm))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: markers occur once each in a row that is not plain."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, middle, second))
            .when(form == "spm", F.concat(second, middle, first)).otherwise(output))


SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units
  FROM documents),
d AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS h1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS h2,
    text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}')
      OR contains(text, '{MIDDLE}') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {RATE} AS plain,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM} AS spm FROM t),
c AS (
  SELECT *, coalesce(array_to_string(units[1:least(h1, h2)], ''), '') AS prefix,
    coalesce(array_to_string(units[least(h1, h2) + 1:greatest(h1, h2)], ''), '') AS middle,
    coalesce(array_to_string(units[greatest(h1, h2) + 1:], ''), '') AS suffix FROM d)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars,
  CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text
    WHEN spm THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle
    ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END)
    AS output_sha256,
  sha256(text) AS restored_sha256 FROM c"""
