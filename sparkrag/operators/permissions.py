"""Row-level data permissions, tool permissions and request contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.tagging import normalize_scope
from ..functions.text import strip
from ..sources.stage import staged


def visible(tenant: Column, roles: Column, orchards: Column, user_tenant: Column,
            user_role: Column, user_orchards: Column) -> Column:
    """Same tenant, role listed (admins skip that), and orchard scopes that meet."""
    own = F.filter(F.coalesce(user_orchards, F.array().cast("array<string>")),
                   lambda x: x.isNotNull() & (x != ""))
    return ((tenant == user_tenant)
            & ((user_role == "admin") | F.array_contains(roles, user_role))
            & ((F.size(own) == 0) | F.arrays_overlap(
                normalize_scope(orchards), F.concat(own, F.array(F.lit(V.ALL_ORCHARDS))))))


# A scope class that holds more than 1/2000 of the rows is spread over tasks.
HOT_SHARE = 2000
# Keys that no role or orchard has.
_EVERY = "\0every"


def _scope_classes(df: DataFrame) -> DataFrame:
    """``tenant_id, __roles, __orchards, n``: the different access rules of a table, and their rows."""
    return df.groupBy("tenant_id", "__roles", "__orchards").agg(F.count("*").alias("n"))


def _readers(classes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Which users read which class, as an equi-join on (tenant, role, orchard).

    A class is listed under each of its roles and orchards, and under a key that stands for every role
    (admins) or every orchard (users without a scope of their own).  Of several orchards that a
    class and a user share, the first makes the pair.
    """
    every = F.array(F.lit(_EVERY))
    rule = classes.select(
        "tenant_id", "__roles", "__orchards", F.explode(F.array_distinct(F.concat(
            "__roles", every))).alias("__role"))
    rule = rule.withColumn("__orchard", F.explode(F.concat(F.array_distinct("__orchards"), every)))
    own = F.filter(F.coalesce("orchard_scope", F.array().cast("array<string>")),
                   lambda x: x.isNotNull() & (x != ""))
    user = scopes.select(
        "user_id", "tenant_id",
        F.when(F.col("role") == "admin", _EVERY).otherwise(F.col("role")).alias("__role"),
        F.when(F.size(own) == 0, every).otherwise(F.array_distinct(F.concat(
            own, F.array(F.lit(V.ALL_ORCHARDS))))).alias("__own"))
    user = user.withColumn("__orchard", F.explode("__own"))
    both = rule.join(user, ["tenant_id", "__role", "__orchard"])
    first = F.get(F.array_intersect("__own", F.concat("__orchards", every)), F.lit(0))
    return both.where(F.col("__orchard") == first).select(
        "user_id", "tenant_id", "__roles", "__orchards")


def scope_filter(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of ``df`` that each user may read (see ``visible``), with the ``user_id`` added.

    ``scopes``: user_id, tenant_id, role, orchard_scope.  Users are matched with the different
    access rules of the table, not with its rows; rows then join their rule's readers.  A rule that
    many rows share is salted, so a tenant that holds all rows is read in many tasks.
    """
    src = df.where("tenant_id is not null").withColumns({
        "__roles": F.array_sort(F.filter(F.coalesce("role_scope", F.array().cast("array<string>")),
                                         lambda x: x.isNotNull())),
        "__orchards": F.array_sort(normalize_scope(F.col("orchard_scope")))})
    rule = ["tenant_id", "__roles", "__orchards"]
    classes = staged(_scope_classes(src), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    limit = max(total / HOT_SHARE, 1)
    # At most HOT_SHARE classes are that large, so their list is small.
    hot = F.broadcast(classes.where(F.col("n") > limit).select(
        *rule, F.ceil(F.col("n") / limit).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    readers = _readers(classes, scopes).join(hot, rule, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    rows = src.join(hot, rule, "left").withColumn("__salt", F.pmod(
        F.xxhash64(*plain), salts).cast("int"))
    return rows.join(readers, [*rule, "__salt"]).select(*[rows[c] for c in df.columns], "user_id")


def user_scope(df: DataFrame) -> DataFrame:
    """Scope columns with defaults; the user scope wins over the record scope when filled."""
    own = F.col("user_orchard_scope")
    return df.select(
        "user_id", F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"),
        F.coalesce("role", F.lit("worker")).alias("role"),
        F.coalesce(F.when(F.size(own) > 0, own), F.col("orchard_scope"),
                   F.array().cast("array<string>")).alias("orchard_scope"))


def allowed(tool, role) -> Column:
    """May this role call this tool?  Unknown roles count as workers."""
    t = F.col(tool) if isinstance(tool, str) else tool
    r = F.col(role) if isinstance(role, str) else role
    listed = F.when(r == "manager", t.isin(*V.ROLE_TOOLS["manager"])).otherwise(
        t.isin(*V.ROLE_TOOLS["worker"]))
    return (r == "admin") | (t == V.EVERYONE_TOOL) | listed


def allowed_tools(calls: DataFrame, role_tools: DataFrame) -> DataFrame:
    """The same rule with the role table as data: calls that are permitted."""
    known = role_tools.select(F.col("role").alias("__known")).distinct()
    rule = role_tools.select(F.col("role").alias("__role"), F.col("tool_name").alias("__tool"))
    c = calls.join(known, F.col("role") == F.col("__known"), "left")
    c = c.withColumn("__as", F.when(F.col("__known").isNull(), "worker").otherwise(F.col("role")))
    hit = (F.col("__as") == F.col("__role")) & (F.col("tool_name") == F.col("__tool"))
    c = c.join(rule.dropDuplicates(), hit, "left")
    ok = ((F.col("role") == "admin") | (F.col("tool_name") == V.EVERYONE_TOOL)
          | F.col("__tool").isNotNull())
    return c.filter(ok).select(*calls.columns)


def request_context(df: DataFrame) -> DataFrame:
    """Cleaned request context with the isolation key; bad roles and languages are rejected."""
    def text(name, default):
        return F.coalesce(F.nullif(strip(F.col(name)), F.lit("")), F.lit(default))

    role = F.lower(strip(F.coalesce(F.nullif("role", F.lit("")), F.lit("worker"))))
    lang = F.lower(strip(F.coalesce(F.nullif("language", F.lit("")), F.lit("auto"))))
    reject = (F.when(~role.isin(*V.ROLES), "role").when(~lang.isin(*V.CONTEXT_LANGUAGES),
                                                        "language"))
    tenant, user = text("tenant_id", "default"), text("user_id", "anonymous")
    thread = strip(F.col("thread_id"))
    return df.select("request_id", user.alias("user_id"), role.alias("role"),
                     thread.alias("thread_id"),
                     F.concat_ws(":", tenant, user, thread).alias("checkpoint_thread_id"),
                     tenant.alias("tenant_id"), lang.alias("language"), reject.alias("reject"))
