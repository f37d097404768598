"""Message predicates, budgets and context texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .tagging import first_case
from .text import strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _any_of(text: Column, markers) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m))
    return hit


def is_smalltalk(col) -> Column:
    t = F.lower(strip(_c(col)))
    return t.isin(*V.SMALLTALK) | (F.length(t) == 1)


def is_abstention(col) -> Column:
    return _any_of(F.coalesce(_c(col), F.lit("")), V.ABSTAIN_MARKERS)


def classify_failure(col) -> Column:
    """Failure class of a final answer, NULL for success."""
    t = F.coalesce(_c(col), F.lit(""))
    pairs = [(strip(t) == "", F.lit("NO_RESPONSE"))]
    pairs += [(_any_of(t, words), F.lit(name)) for name, words in V.FAILURE_MARKERS]
    return first_case(pairs, F.lit(None).cast("string"))


def classify_error(kind, message, domain) -> Column:
    """Error type from the exception class name, its message and the domain (llm / tool)."""
    k, m = _c(kind), F.coalesce(_c(message), F.lit(""))
    tool = _c(domain) == "tool"
    full = F.concat(k, F.lit(": "), m)
    timeout = F.when(tool, "TOOL_TIMEOUT").otherwise("LLM_TIMEOUT")
    return (
        F.when(full.rlike(V.TIMEOUT_MESSAGE), timeout)
        .when(full.rlike(V.OVERFLOW_MESSAGE), "LLM_TOKEN_OVERFLOW")
        .when(F.contains(m, F.lit("权限不足")) | F.contains(k, F.lit("PermissionError")),
              "TOOL_PERMISSION_DENIED")
        .when(tool & (F.contains(m, F.lit("参数错误")) | k.isin("ValueError", "TypeError")),
              "TOOL_INVALID_ARGUMENT")
        .when(_c(domain) == "llm", "LLM_TIMEOUT").otherwise("TOOL_TIMEOUT"))


def error_strategy(error) -> Column:
    """Struct ``(action, retry_budget, then)``; unknown errors retry once."""
    e = _c(error)

    def row(t):
        return F.struct(*[F.lit(v).cast("string").alias(n)
                          for n, v in zip(("action", "retry_budget", "then"), t)])

    return first_case([(e == k, row(v)) for k, v in V.ERROR_STRATEGIES.items()],
                      row(V.DEFAULT_STRATEGY))


def degrades_memory(error) -> Column:
    return error_strategy(error)["action"] == "memory_degrade"


def next_level(error, level) -> Column:
    """Degrade level after an error: timeouts keep it, a lost summary jumps to 3, else one up."""
    e, n = _c(error), _c(level)
    return (F.when(e.isin("LLM_TIMEOUT", "TOOL_TIMEOUT"), n)
            .when(e == "SUMMARY_FAILED", F.greatest(n, F.lit(3)))
            .otherwise(F.least(n + 1, F.lit(4)))).cast("int")


def budget_caps(total: int = V.BUDGET_TOTAL) -> dict[str, int]:
    return {s: int(total * r) for s, r in V.BUDGET_RATIOS.items()}


def fit(col, section: str, total: int = V.BUDGET_TOTAL) -> Column:
    """Cut to the budget of a section, keeping the tail."""
    c, cap = _c(col), budget_caps(total)[section]
    return c if cap == 0 else F.when(F.length(c) <= cap, c).otherwise(F.right(c, F.lit(cap)))


def render_message(role, text) -> Column:
    names = F.create_map(*[F.lit(x) for kv in V.ROLE_NAMES.items() for x in kv])
    return F.concat(F.lit("["), F.coalesce(names[_c(role)], F.lit(V.ROLE_NAME_OTHER)),
                    F.lit("] "), F.substring(_c(text), 1, V.RENDER_CHARS))


def build_context(system, summary, history, state, query, total: int = V.BUDGET_TOTAL) -> Column:
    """Five sections, empty ones left out, each cut to its own budget."""
    def part(col, marker, section):
        c = F.coalesce(_c(col), F.lit(""))
        return F.when(c != "", F.concat(F.lit(V.SECTION_MARKERS[marker]),
                                        fit(c, section, total)))
    q = F.concat(F.lit(V.SECTION_MARKERS["query"]),
                 fit(F.coalesce(_c(query), F.lit("")), "query", total))
    return F.concat_ws("\n\n", fit(F.coalesce(_c(system), F.lit("")), "system", total),
                       part(summary, "summary", "summary"), part(history, "history", "history"),
                       part(state, "business_state", "summary"), q)


def business_state(entities, stage, pending_tool, pending_title) -> Column:
    """State text of a turn: active entities, growth stage, operation waiting for approval."""
    pairs = F.filter(F.map_entries(_c(entities)),
                     lambda x: x["value"].isNotNull() & (x["value"] != ""))
    shown = F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["key"], x["value"])), "，")
    s, tool = _c(stage), _c(pending_tool)
    wait = strip(F.concat(F.lit(V.STATE_PENDING), tool, F.lit(" "),
                          F.coalesce(_c(pending_title), F.lit(""))))
    return F.concat_ws(
        "\n", F.when(shown != "", F.concat(F.lit(V.STATE_ENTITIES), shown)),
        F.when((F.coalesce(s, F.lit("")) != "") & (s != "unknown"),
               F.concat(F.lit(V.STATE_STAGE), s)),
        F.when(tool.isNotNull(), wait))
