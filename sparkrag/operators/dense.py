"""Exact cosine search: blocked matrix products with a partial top-k in every task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .prefix import top_n

# Queries up to this many form one matrix that every task holds (4096 x 512 doubles = 16 MB);
# more are cut into blocks and joined with corpus blocks on block coordinates.  Every block of queries
# travels with the whole corpus, so very many queries go in blocks of up to four times that.
MATRIX_QUERIES = 4096
BLOCK_ROWS = 50_000
SCORE_CELLS = 2 << 20  # 8 MB of single precision
SCORE_DIGITS = 9
TIES = 2 * 10.0 ** -SCORE_DIGITS  # two scores further apart than this differ when rounded
NO_SCORE = -2.0  # below any cosine


def _unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(np.float64, copy=False) if len(vectors) else \
        np.empty((0, 0))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _allowed(pdf: pd.DataFrame, scope: dict) -> np.ndarray:
    """Row permission of one scope over a batch of corpus rows."""
    ok = (pdf["tenant_id"] == scope["tenant_id"]).to_numpy()
    if scope["role"] != "admin":
        ok &= pdf["role_scope"].map(lambda r: scope["role"] in r).to_numpy(dtype=bool)
    own = {o for o in (scope["orchard_scope"] if scope["orchard_scope"] is not None else []) if o}
    if own:
        own.add(V.ALL_ORCHARDS)
        ok &= pdf["orchard_scope"].map(
            lambda o: not own.isdisjoint([x for x in o if x] or [V.ALL_ORCHARDS])
        ).to_numpy(dtype=bool)
    return ok


class _TopK:
    """Running best ``k`` per query row over the batches of one task.

    Products in single precision say which pairs can be among the best; only those are computed in
    double precision and sorted.  Once a query has ``k`` chunks its worst is the bar for all others.
    """

    def __init__(self, unit_queries: np.ndarray, scopes: list, k: int, min_score: float | None,
                 same: list | None):
        self.q, self.k, self.min = unit_queries, k, min_score
        self.q32 = unit_queries.astype(np.float32)
        self.bad = ~np.isfinite(unit_queries).all(axis=1)
        # Of a product of unit vectors in single precision, with room for the rounding of both.
        self.error = TIES + (unit_queries.shape[1] + 8) * 2.0 ** -23
        self.scopes, self.same = scopes, same
        self.rows_of: dict = {}
        for i, x in enumerate(same if same is not None else []):
            self.rows_of.setdefault(x, []).append(i)
        self.bar = np.full(len(unit_queries), NO_SCORE if min_score is None else min_score)
        self.full = self.bad.copy()  # without a score there is no bar to look for
        self.row = np.empty(0, dtype=np.int64)
        self.ids: np.ndarray | None = None
        self.score = np.empty(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, pdf: pd.DataFrame) -> None:
        """Corpus rows in slices, so that the scores of all queries stay below ``SCORE_CELLS``."""
        step = max(1, SCORE_CELLS // max(1, len(self.q)))
        for at in range(0, len(pdf), step):
            self._add(pdf.iloc[at:at + step])
            if self.ids is None or self.n_waiting > self.k * len(self.q):
                self.merge()
        self.merge()

    def _add(self, pdf: pd.DataFrame) -> None:
        ids = pdf["chunk_id"].to_numpy()
        unit = _unit(pdf["vec"])
        s = self.q32 @ unit.astype(np.float32).T  # query x chunk
        s[:, ~np.isfinite(unit).all(axis=1)] = -np.inf
        s[self.bad] = -np.inf
        if self.same is not None:
            for col, x in enumerate(ids):
                if x in self.rows_of:
                    s[self.rows_of[x], col] = -np.inf
        if self.scopes:
            masks: dict = {}
            for i, sc in enumerate(self.scopes):
                key = repr(sc)
                if key not in masks:
                    masks[key] = _allowed(pdf, sc)
                s[i, ~masks[key]] = -np.inf
        bar = self.bar.copy()
        few = np.flatnonzero(~self.full)
        if len(few) and s.shape[1] > self.k:
            kth = np.partition(s[few], -self.k, axis=1)[:, -self.k]
            bar[few] = np.maximum(bar[few], kth - self.error)
        found = np.flatnonzero(s >= (bar - self.error).astype(np.float32)[:, None])
        row, col = np.divmod(found, max(1, s.shape[1]))
        score = np.empty(len(row))
        for lo in range(0, len(row), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            score[at] = np.einsum("ij,ij->i", self.q[row[at]], unit[col[at]])
        score = np.round(score, SCORE_DIGITS)
        good = score >= (bar - TIES)[row]
        if self.min is not None:
            good &= score >= self.min
        self.waiting.append((row[good], score[good], ids[col[good]]))
        self.n_waiting += int(good.sum())

    def merge(self) -> None:
        """The best of what was kept and what came since."""
        if not self.waiting:
            return
        rows, scores, ids = zip(*self.waiting)
        self.waiting, self.n_waiting = [], 0
        self.row = np.concatenate([self.row, *rows])
        self.score = np.concatenate([self.score, *scores])
        self.ids = np.concatenate([*([] if self.ids is None else [self.ids]), *ids])
        order = np.lexsort((self.ids, -self.score, self.row))
        r = self.row[order]
        start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.empty(0, dtype=bool)
        at = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0))
        order = order[at < self.k]
        last = order[at[at < self.k] == self.k - 1]
        self.bar[self.row[last]] = self.score[last]
        self.full[self.row[last]] = True
        self.row, self.score, self.ids = self.row[order], self.score[order], self.ids[order]


def dense_search(queries: DataFrame, corpus: DataFrame, k: int = 10,
                 min_score: float | None = V.DENSE_MIN_SCORE, by: list[str] = ("query_id",),
                 exclude_self: str | None = None, scoped: bool = False) -> DataFrame:
    """Top ``k`` chunks per query by cosine: ``(by..., chunk_id, score, rank)``.

    ``queries``: by..., vec.  ``corpus``: chunk_id, vec.  With ``scoped`` both sides carry
    tenant_id and orchard_scope, queries a role and the corpus a role_scope; rows outside the
    scope are masked before the top-k.  ``exclude_self`` names a query column holding a chunk id
    that must not be returned.
    """
    by = list(by)
    scope_cols = ["tenant_id", "role", "orchard_scope"] if scoped else []
    acl_cols = ["tenant_id", "role_scope", "orchard_scope"] if scoped else []
    extra = [exclude_self] if exclude_self and exclude_self not in by else []
    qs = queries.select(*by, *extra, *scope_cols, "vec")
    cs = corpus.select("chunk_id", *acl_cols, "vec")
    id_type = corpus.schema["chunk_id"].dataType
    schema = T.StructType([*[T.StructField(c, queries.schema[c].dataType) for c in by],
                           T.StructField("chunk_id", id_type),
                           T.StructField("score", T.DoubleType())])

    def scorer(qpdf: pd.DataFrame) -> _TopK:
        scopes = qpdf[scope_cols].to_dict("records") if scoped else []
        same = qpdf[exclude_self].tolist() if exclude_self else None
        return _TopK(_unit(qpdf["vec"]), scopes, k, min_score, same)

    def result(qpdf: pd.DataFrame, best: _TopK) -> pd.DataFrame:
        out = qpdf[by].iloc[best.row].reset_index(drop=True)
        out["chunk_id"] = best.ids if best.ids is not None else np.empty(0, dtype=object)
        out["score"] = best.score
        return out

    head = qs.limit(MATRIX_QUERIES + 1).toPandas()
    if len(head) <= MATRIX_QUERIES:
        def scan(batches):
            best, seen = None, False
            for pdf in batches:
                if len(pdf) and len(head):
                    best = best or scorer(head)
                    best.add(pdf)
                    seen = True
            if seen:
                yield result(head, best)

        hits = cs.mapInPandas(scan, schema)
    else:
        hits = _block_join(qs, cs, by, scorer, result, schema)
    return top_n(hits, by, [F.desc("score"), F.asc("chunk_id")], k)


def _block_join(qs, cs, by, scorer, result, schema) -> DataFrame:
    """Many queries: every (query block, corpus block) pair is one bounded task."""
    n = qs.count()
    n_q = max(1, -(-n // (MATRIX_QUERIES * min(4, max(1, n // 100_000)))))
    n_c = max(1, -(-cs.count() // BLOCK_ROWS))
    q = (qs.withColumn("qb", F.pmod(F.xxhash64(*by), F.lit(n_q)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))))
    c = (cs.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(n_c)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))))

    def block(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        best = scorer(qpdf) if len(qpdf) else _TopK(np.empty((0, 0)), [], 1, None, None)
        if len(qpdf) and len(cpdf):
            best.add(cpdf)
        return result(qpdf, best)

    return (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInPandas(block, schema))
