"""Residue stripping, quality grades and caption rescue as column expressions (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import ascii_only, contains_any, fold_spaces, let, where_found

# Three numbers with commas between them, from the first comma on: any bare list of coordinates has it.
COORDS_MARK = rf",{V.WS}*\p{{Nd}}{{1,4}}{V.WS}*,{V.WS}*\p{{Nd}}"


# What the patterns of parser residue need one of, besides "<" and "http", and all but printable ASCII.
_NOT_PLAIN = r"""[\x00-\x1f"&',\[-\]_{}\x7f-\x{10ffff}]"""


def _c(col) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _gsub(c: Column, *patterns: str, by: str = " ") -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, by)
    return c


def normalize_units(col, restore_degrees: bool = False) -> Column:
    """LaTeX unit residue to plain text.

    ``\\%`` becomes ``%``.  With ``restore_degrees`` a number before ``\\%`` is read as a
    temperature when a temperature word stands within 28 characters before or 16 after it; the
    default leaves that off because the unescaping step runs first and makes the rule unreachable.
    """
    return where_found(_c(col), ["\\"], lambda c: _latex(c, restore_degrees))


def _latex(c: Column, restore_degrees: bool) -> Column:
    for pattern, by in V.LATEX_MEASURES:
        c = F.regexp_replace(c, pattern, by)
    if restore_degrees:
        before = "|".join("(?<=%s.{0,%d})" % (w, 28 - len(w)) for w in V.TEMPERATURE_WORDS)
        after = "|".join("(?=.{0,%d}%s)" % (16 - len(w), w) for w in V.TEMPERATURE_WORDS)
        c = F.regexp_replace(c, "(?is)(?<!\\p{Nd})(?:" + before + ")" + V.LATEX_PERCENT, "$1℃")
        c = F.regexp_replace(c, "(?is)" + V.LATEX_PERCENT + "(?:" + after + ")", "$1℃")
    return F.regexp_replace(c, *V.LATEX_ESCAPE)


def strip_quote_noise(col) -> Column:
    """Unwrap quoted span values and drop bare coordinate lists left by flattened layouts."""
    return _trimmed(_unquoted(_c(col)))


def _trimmed(c: Column) -> Column:
    return F.btrim(fold_spaces(c), F.lit(V.RESIDUE_EDGE_CHARS))


def _unquoted(c: Column) -> Column:
    c = _where_like(c, {",": COORDS_MARK}, _drop_coords)
    return where_found(c, ["'"], _unquote)


def _where_like(c: Column, marks: dict[str, str], fn) -> Column:
    """Run ``fn`` only on texts that match one of ``marks``: patterns by the character that they start
    with, so they are tried at its places only."""
    def found(x: Column) -> Column:
        hit = F.lit(False)
        for part, mark in marks.items():
            hit = hit | (F.contains(x, F.lit(part)) & x.rlike(mark))
        return hit
    return let(c, lambda x: F.when(found(x), fn(x)).otherwise(x))


def _drop_coords(c: Column) -> Column:
    return _gsub(c, V.BARE_BBOX)


def _unquote(c: Column) -> Column:
    for _ in range(3):
        c = F.regexp_replace(c, V.QUOTED_VALUE, "$1")
    return _gsub(c, V.LONE_QUOTE)


def strip_residue(col, drop_table_html: bool = True) -> Column:
    """Remove parser residue and markup, keep natural language.

    Every group of patterns runs only on texts that hold a character it needs.  What holds none of
    these characters, and no white space but spaces, has tags and spaces at most.
    """
    tags = [V.HTML_TABLE_TAG, V.HTML_ANY_TAG] if drop_table_html else [V.HTML_ANY_TAG]
    return let(_c(col), lambda x: F.when(
        x.rlike(_NOT_PLAIN) | F.contains(x, F.lit("http")), _without_residue(x, tags))
        .otherwise(_plain(x, tags)))


def _plain(c: Column, tags: list[str]) -> Column:
    c = F.when(F.contains(c, F.lit("<")), _gsub(c, *tags)).otherwise(c)
    return F.btrim(F.regexp_replace(c, " {2,}", " "), F.lit(V.RESIDUE_EDGE_CHARS))


def _without_residue(c: Column, tags: list[str]) -> Column:
    c = where_found(c, ["'", '"'], lambda x: _gsub(
        x, V.RESIDUE_BBOX, V.RESIDUE_SCALAR, V.RESIDUE_KEY, V.RESIDUE_TYPE))
    c = where_found(c, ["_"], lambda x: _gsub(x, V.RESIDUE_BODY))
    c = where_found(c, ["<"], lambda x: _gsub(x, *tags))
    c = where_found(c, ["&"], lambda x: _gsub(x, V.HTML_ENTITY))
    c = normalize_units(where_found(c, ["http"], lambda x: _gsub(x, V.URL)))
    c = where_found(c, ["'", '"', "[", "]", "{", "}"], lambda x: _gsub(x, V.STRUCT_PUNCT))
    c = _where_like(c, {m: f"{m}[{m}{V.WS[1:-1]}]*{m}" for m in ",'"},
                    lambda x: _gsub(x, V.ORPHAN_PUNCT))
    # What is folded and trimmed stays so where nothing more is taken out.
    return let(_trimmed(c), lambda x: let(_unquoted(x), lambda y: F.when(y == x, y)
                                          .otherwise(_trimmed(y))))


def _share(c: Column, chars: str, plain: str) -> Column:
    """Share of the characters of a class; taken out in runs, so no character is a row of its own.

    ``plain`` are those of the class in ASCII, which is all that many texts hold.
    """
    def rest(x: Column) -> Column:
        return F.when(ascii_only(x), F.regexp_replace(x, plain + "++", "")).otherwise(
            F.regexp_replace(x, chars + "++", ""))
    return let(c, lambda x: (F.length(x) - F.length(rest(x))) / F.greatest(F.length(x), F.lit(1)))


def word_ratio(col) -> Column:
    return _share(_c(col), V.LETTERS, "[A-Za-z]")


def digit_ratio(c: Column) -> Column:
    return _share(c, V.DIGIT_CHARS, "[0-9]")


def grade(raw, cleaned, ratio: Column | None = None) -> Column:
    """``usable``, ``table_fragment`` or ``junk``; the order of the tests matters.

    ``ratio`` is ``word_ratio(cleaned)``, where it was made before.
    """
    raw, c = _c(raw), _c(cleaned)
    ratio = word_ratio(c) if ratio is None else ratio
    return (
        F.when(F.length(c) < V.MIN_CHUNK_CHARS, "junk")
        .when(F.contains(raw, F.lit("<")) & raw.rlike(V.TABLE_MARK), "table_fragment")
        .when(ratio < V.GRADE_MIN_WORD_RATIO, "junk")
        .when(c.rlike(V.RESIDUE_MARK), "junk")
        .when(digit_ratio(c) > V.GRADE_MAX_DIGIT_RATIO, "junk")
        .otherwise("usable")
    )


def extract_caption(col) -> Column:
    """Caption of a damaged table, or NULL when nothing but the bare data is left."""
    return caption_of(strip_residue(col))


def caption_of(cleaned) -> Column:
    """The same for text that went through ``strip_residue`` already."""
    return let(_c(cleaned), _caption)


def _caption(s: Column) -> Column:
    # Bound once each: every use would take them from the text again.
    return let(F.regexp_extract(s, V.CAPTION, 0), lambda found: F.when(found != "", let(
        # The caption begins with its label, so that is found at once, without the text behind it.
        F.regexp_extract(found, V.CAPTION_LABEL + "(?=" + V.CAPTION_CHARS + "{4})", 0),
        lambda label: let(_labelled(label, F.substr(found, F.length(label) + 1)), _whole_caption))))


def _labelled(label: Column, body: Column) -> Column:
    body = F.btrim(F.regexp_replace(body, "(?s)" + V.CAPTION_BOUNDARY + r".*\z", ""),
                   F.lit(" ,.;:'\"()"))
    return F.trim(F.concat_ws(" ", F.btrim(label, F.lit(" .:：")), body))


def _whole_caption(cap: Column) -> Column:
    tail = F.regexp_replace(cap, V.CAPTION_HEAD, "")
    ok = (
        F.length(cap).between(8, 90)
        & cap.rlike(V.CAPTION_START)
        & (F.length(tail) >= 8)
        & (word_ratio(cap) >= V.GRADE_MIN_WORD_RATIO)
        & ~contains_any(cap, "'\"<>")
        & (digit_ratio(cap) <= 0.3)
    )
    return F.when(ok, cap)


def source_group(doc) -> Column:
    d = _c(doc)
    return (F.when(d.rlike(V.FAQ_DOC), "faq").when(d.endswith(".docx"), "thai_docx")
            .otherwise("literature"))


def valid_md_table(col) -> Column:
    """Is this a real Markdown table rather than a falsely detected one?"""
    lines = F.filter(F.split(_c(col), "\n"), lambda x: x.rlike(r"[^" + V.WS[1:-1] + "]"))
    return let(lines, _valid_lines)


def _valid_lines(lines: Column) -> Column:
    head = F.get(lines, F.lit(0))

    def pipes(x):
        return F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))

    cells = F.filter(
        F.transform(F.flatten(F.transform(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))),
                                          lambda x: F.split(x, r"\|"))), fold_edges),
        lambda x: x != "")
    even = F.size(F.filter(lines, lambda x: F.abs(pipes(x) - pipes(head)) <= 1))
    placeholders = F.regexp_count(head, F.lit(r"(?i)\|Col\p{Nd}+"))
    ok = (
        (F.size(lines) >= 3)
        & ~head.rlike(r"(?i)^" + V.WS + r"*\|?" + V.WS + r"*Col\p{Nd}")
        & (pipes(head) >= 3)
        & (placeholders / pipes(head) <= 0.4)
        & (even / F.size(lines) >= 0.8)
        & ((F.size(cells) == 0)
           | ((F.size(F.array_distinct(cells)) > 2)
              & (word_ratio(F.concat_ws(" ", cells)) >= 0.25)))
    )
    return F.coalesce(ok, F.lit(False))


def fold_edges(c: Column) -> Column:
    return F.regexp_replace(c, "^" + V.WS + "+|" + V.WS + r"+\z", "")


def dedup_key(col) -> Column:
    """Lower-cased letters and digits only, first 400; empty means the row is dropped."""
    return F.substring(F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]+", ""),
                       1, V.DEDUP_KEY_CHARS)


def chunk_id(doc, page, seq, text) -> Column:
    """sha1 of ``doc:page:seq:sha1(text)``; a missing page prints as ``None``."""
    return F.sha1(F.concat_ws(":", _c(doc), F.coalesce(page.cast("string"), F.lit("None")),
                              seq.cast("string"), F.sha1(_c(text))))
