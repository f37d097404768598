"""Conversation windows, rule summaries, shrink levels and budgets.

Messages are rows ``(conv_id, turn, role, text)`` with roles user, assistant and tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dialog as D
from ..functions.text import estimate_tokens, strip
from .prefix import int_bucket, prefix, top_n

# A summary line has at least six characters, so the first 1001 lines fill the summary cap.
SUMMARY_LINES = V.SUMMARY_CHARS // 6 + 1


def with_recency(df: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Add ``recency`` (1 = newest message) and ``talk_recency`` (same, without tool messages)."""
    talk = F.when(F.col("role").isin("user", "assistant"), 1).otherwise(0)
    back = df.withColumn("__back", -F.col("turn"))
    return prefix(back, ["conv_id"], ["__back"], int_bucket("__back", width),
                  sums={"recency": F.lit(1), "talk_recency": talk}).drop("__back")


def split_window(df: DataFrame, n: int = V.RECENT_MESSAGES) -> DataFrame:
    """Add ``recent``: is the message among the newest ``n`` of its conversation?"""
    return with_recency(df).withColumn("recent", F.col("recency") <= n).drop(
        "recency", "talk_recency")


def recent_window(df: DataFrame, n: int = V.RECENT_MESSAGES) -> DataFrame:
    """Only the newest ``n`` messages, cut to ``n`` per conversation before the shuffle."""
    return top_n(df, ["conv_id"], [F.desc("turn")], n, "recency")


def critical_messages(df: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` user or assistant messages."""
    return recent_window(df.filter(F.col("role").isin("user", "assistant")), n)


def summary_line(role: Column, text: Column) -> Column:
    """What a message adds to a summary: ``line`` (NULL: nothing) and, for an answer, the ``key``
    by which repeated answers count once."""
    t = strip(F.coalesce(text, F.lit("")))
    said = (t != "") & ~D.is_smalltalk(t)
    line = (F.when(role == "tool", F.concat(F.lit(V.SUMMARY_TOOL), F.substring(
                F.coalesce(text, F.lit("")), 1, V.SUMMARY_TOOL_CHARS)))
            .when((role == "user") & said, F.concat(
                F.lit(V.SUMMARY_USER), F.substring(t, 1, V.SUMMARY_USER_CHARS)))
            .when((role == "assistant") & said, F.concat(
                F.lit(V.SUMMARY_ASSISTANT), F.substring(t, 1, V.SUMMARY_ASSISTANT_CHARS))))
    key = F.when((role == "assistant") & said, F.substring(t, 1, V.REPEAT_KEY_CHARS))
    return F.struct(line.alias("line"), key.alias("key"))


def summary_lines(df: DataFrame) -> DataFrame:
    """Lines of a rule summary ``(conv_id, turn, line)``: small talk and repeated answers drop."""
    t = (df.select("conv_id", "turn", summary_line(F.col("role"), F.col("text")).alias("s"))
         .select("conv_id", "turn", "s.line", "s.key").filter("line IS NOT NULL"))
    # One aggregate for both kinds: a union of the two would claim the partitions of its inputs, which
    # change while it runs.  Lines without a key are their own key, and equal ones keep their number.
    own = F.when(F.col("key").isNull(), F.struct("turn", "line"))
    first = t.groupBy("conv_id", "key", own.alias("own")).agg(
        F.min(F.struct("turn", "line")).alias("first"), F.count("*").alias("times"))
    times = F.when(F.col("key").isNull(), F.col("times")).otherwise(1).cast("int")
    return first.select("conv_id", F.explode(F.array_repeat("first", times)).alias("s")).select(
        "conv_id", "s.*")


def rule_summary(df: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Deterministic summary per conversation, earlier summary first, capped at 6000 characters."""
    lines = top_n(summary_lines(df), ["conv_id"], [F.asc("turn")], SUMMARY_LINES, "n")
    body = lines.groupBy("conv_id").agg(F.concat_ws("\n", F.array_sort(
        F.collect_list(F.struct("turn", "line")))["line"]).alias("body"))
    convs = df.select("conv_id").distinct()
    if prev is None:
        out = convs.join(body, "conv_id", "left").withColumn("before", F.lit(""))
    else:
        before = prev.select("conv_id", F.coalesce("summary", F.lit("")).alias("before"))
        out = (convs.join(body, "conv_id", "left").join(before, "conv_id", "full")
               .withColumn("before", F.coalesce("before", F.lit(""))))
    merged = F.substring(F.concat_ws("\n", F.nullif("before", F.lit("")), "body"), 1,
                         V.SUMMARY_CHARS)
    return out.select("conv_id", F.when(F.col("body").isNull(), F.col("before"))
                      .otherwise(merged).alias("summary"))


def summarize(overflow: DataFrame, prev: DataFrame | None = None,
              model: DataFrame | None = None) -> DataFrame:
    """Model summary where there is one, else the rule summary; no overflow keeps the previous.

    ``model``: conv_id, model_summary, for conversations that have overflow.
    """
    rule = rule_summary(overflow, prev)
    if model is None:
        return rule
    own = overflow.select("conv_id").distinct().join(model, "conv_id").select(
        "conv_id", F.substring(F.nullif(strip(F.col("model_summary")), F.lit("")), 1,
                               V.SUMMARY_CHARS).alias("m"))
    return rule.join(own, "conv_id", "left").select(
        "conv_id", F.coalesce("m", "summary").alias("summary"))


def compress(df: DataFrame, n: int = V.RECENT_MESSAGES, threshold: int = V.SUMMARY_CHARS,
             prev: DataFrame | None = None, model: DataFrame | None = None
             ) -> tuple[DataFrame, DataFrame]:
    """Trim long conversations: (messages with ``trimmed``, summary per conversation).

    Below the threshold of characters nothing is cut.  A conversation that is skewed large meets
    its one-row total in a skew join, which AQE splits.
    """
    chars = df.groupBy("conv_id").agg(
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("__chars"))
    marked = split_window(df, n).join(chars, "conv_id").withColumn(
        "trimmed", ~F.col("recent") & (F.col("__chars") >= threshold)).drop("__chars", "recent")
    overflow = marked.filter("trimmed").drop("trimmed")
    done = summarize(overflow, prev, model)
    kept = F.lit("") if prev is None else F.coalesce("__before", F.lit(""))
    convs = df.select("conv_id").distinct()
    if prev is not None:
        convs = convs.join(prev.select("conv_id", F.col("summary").alias("__before")),
                           "conv_id", "left")
    summaries = convs.join(done, "conv_id", "left").select(
        "conv_id", F.coalesce("summary", kept).alias("summary"))
    return marked, summaries


def _with_size(df: DataFrame) -> DataFrame:
    size = df.groupBy("conv_id").agg(F.count("*").alias("__n"))
    return with_recency(df).join(size, "conv_id")


def _half(factor: float):
    return F.greatest(F.lit(2), F.floor(F.col("__n") * F.lit(factor)))


def shrink_window(df: DataFrame, factor: float = 0.5) -> DataFrame:
    """Newest half of every conversation, at least two messages."""
    return _with_size(df).filter(F.col("recency") <= _half(factor)).select(*df.columns)


def apply_level(df: DataFrame, level: int) -> DataFrame:
    """Messages left at a shrink level (0 everything ... 4 nothing)."""
    if level <= 0:
        return df
    if level == 1:
        return shrink_window(df)
    if level == 2:
        return df.withColumn("text", F.when(F.col("role") == "tool", V.TOOL_OMITTED)
                             .otherwise(F.col("text")))
    if level == 3:
        return critical_messages(df).select(*df.columns)
    return df.limit(0)


def level_tokens(df: DataFrame, context: DataFrame) -> DataFrame:
    """Token estimate of every shrink level, one pass over the messages.

    ``context``: conv_id, summary, business_state, query.
    """
    tok = estimate_tokens("text")
    tool = F.col("role") == "tool"
    omitted = estimate_tokens(F.lit(V.TOOL_OMITTED))
    talk = F.col("role").isin("user", "assistant") & (F.col("talk_recency") <= 2)

    def total(cond, value=tok):
        return F.sum(F.when(cond, value).otherwise(0))

    m = _with_size(df).groupBy("conv_id").agg(
        F.sum(tok).alias("m0"), total(F.col("recency") <= _half(0.5)).alias("m1"),
        F.sum(F.when(tool, omitted).otherwise(tok)).alias("m2"), total(talk).alias("m3"))
    summary, state, query = (estimate_tokens(c) for c in ("summary", "business_state", "query"))
    base = state + query

    def fill(c):
        return F.coalesce(c, F.lit(0))

    return context.join(m, "conv_id", "left").select(
        "conv_id", *[(fill(F.col(f"m{i}")) + summary + base).cast("long").alias(f"l{i}")
                     for i in range(4)], base.cast("long").alias("l4"))


def fit_level(df: DataFrame, context: DataFrame, limit: int, start: int = 0,
              max_level: int = 4) -> DataFrame:
    """Smallest shrink level from ``start`` on whose estimate fits the limit, else the last."""
    t = level_tokens(df, context)
    level = F.coalesce(*[F.when(F.col(f"l{i}") <= limit, F.lit(i))
                         for i in range(start, max_level + 1)], F.lit(max_level))
    tokens = F.array(*[F.col(f"l{i}") for i in range(5)])
    return t.select("conv_id", level.alias("level"), F.get(tokens, level).alias("tokens"))


def budget_report(sections: DataFrame, total: int = V.BUDGET_TOTAL) -> DataFrame:
    """Used tokens, cap and overrun of every section row ``(conv_id, section, text)``."""
    caps = D.budget_caps(total)
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("section")]
    used = estimate_tokens("text")
    return sections.select("conv_id", "section", used.alias("used"), cap.alias("cap"),
                           (used > cap).alias("over"))


def render_messages(df: DataFrame, n: int = V.RECENT_MESSAGES) -> DataFrame:
    """History text per conversation from its newest ``n`` messages."""
    line = D.render_message("role", F.coalesce("text", F.lit("")))
    return (recent_window(df, n).groupBy("conv_id").agg(F.concat_ws("\n", F.array_sort(
        F.collect_list(F.struct("turn", line.alias("line"))))["line"]).alias("history")))
