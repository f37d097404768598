"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors get one more component that makes all of them equally long, queries get zero there and the same
length: then the largest inner product is the smallest distance, which Gaussian (2-stable) hashes
keep.  A table hashes with several projections cut into slots.  A query visits the bucket it falls
into and then perturbed buckets, those first whose slot borders lie nearest to it; candidates of all
tables meet, scored exactly on the original vectors.

Buckets lie one behind the other in blocks of about equal size, so a bucket with a third of all vectors
is shared by many tasks, and a task holds one block and a bounded number of queries.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

TABLES, PROJECTIONS = 3, 6
SLOTS = 4  # slots of a projection; what lies outside falls into the outer ones
SLOT_WIDTH = 2.0  # standard deviations of the projected vectors
SAMPLE, SAMPLE_QUERIES = 8192, 256  # vectors that the hashes and the number of probes are fitted on
TARGET_RECALL = 0.95  # on the sample
BLOCK = 32_768  # vectors of a task
QUERIES = 4096  # queries of a task
SCORES = 1 << 22  # inner products held at once
PROBED = 500  # queries whose probes are ordered at once

STEPS = np.array(list(itertools.product((-1, 0, 1), repeat=PROJECTIONS)))


@dataclass
class Hashes:
    """Projections, offsets and slot width, the common length, and the probes per table."""

    ways: np.ndarray
    offsets: np.ndarray
    width: float
    longest: float
    probes: int = 1

    def lift(self, x: np.ndarray, queries: bool) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        if queries:
            return np.hstack([x * (self.longest / norms), np.zeros_like(norms)])
        return np.hstack([x, np.sqrt(np.maximum(self.longest ** 2 - norms ** 2, 0))])

    def places(self, x: np.ndarray, queries: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Slots (rows, tables, projections), and where inside its slot each row lies, 0 to 1."""
        along = np.einsum("nd,tkd->ntk", self.lift(x, queries), self.ways)
        along = (along + self.offsets) / self.width + SLOTS // 2
        slots = np.clip(np.floor(along), 0, SLOTS - 1)
        return slots.astype(np.int64), np.clip(along - slots, 0, 1)

    def codes(self, slots: np.ndarray) -> np.ndarray:
        return slots @ (SLOTS ** np.arange(PROJECTIONS))

    def probe(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Bucket codes (rows, tables, probes) in order of estimated success; -1: no bucket."""
        slots, inside = self.places(x, True)
        # Squared distance to the border that a step goes over, per projection and step.
        cost = np.stack([inside ** 2, np.zeros_like(inside), (1 - inside) ** 2], axis=-1)
        total = np.zeros((*slots.shape[:2], len(STEPS)))
        for k in range(PROJECTIONS):
            total += cost[:, :, k, :][:, :, STEPS[:, k] + 1]
        order = np.argsort(total, axis=2, kind="stable")[:, :, :probes or self.probes]
        moved = slots[:, :, None, :] + STEPS[order]
        codes = self.codes(moved)
        codes[((moved < 0) | (moved >= SLOTS)).any(axis=3)] = -1
        return codes


def fit(sample: np.ndarray, longest: float, k: int, seed: int = 3) -> Hashes:
    """Hashes for vectors like those of the sample, with as many probes as the target recall needs."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    ways = rng.normal(size=(TABLES, PROJECTIONS, dims + 1))
    made = Hashes(ways, np.zeros((TABLES, PROJECTIONS)), 1.0, longest, len(STEPS))
    along = np.einsum("nd,tkd->ntk", made.lift(sample, False), ways)
    made.width = float(SLOT_WIDTH * (along.std() or 1.0))
    made.offsets = rng.uniform(-0.5, 0.5, made.offsets.shape) * made.width - along.mean(axis=0)
    n = min(SAMPLE_QUERIES, len(sample))
    scores = sample[:n] @ sample.T
    scores[np.arange(n), np.arange(n)] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :min(k, len(sample) - 1)]
    if not near.size:
        return made
    # The first probe, over all tables, that reaches a neighbour.
    codes = made.codes(made.places(sample)[0])
    probes = made.probe(sample[:n])
    first = np.full(near.shape, len(STEPS))
    for t in range(TABLES):
        same = probes[:, t, :, None] == codes[near, t][:, None, :]
        first = np.minimum(first, np.where(same.any(1), same.argmax(1), len(STEPS)))
    reached = np.sort(first.ravel())
    made.probes = min(len(STEPS), int(reached[int(np.ceil(TARGET_RECALL * len(reached))) - 1]) + 1)
    return made


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _code_batches(hashes: Hashes):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            codes = hashes.codes(hashes.places(_matrix(batch.column("embedding")))[0])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(codes) + 1) * TABLES, pa.int32()),
                pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists],
                                             names=[*batch.schema.names, "codes"])
    return run


def _spread(ids: np.ndarray, groups: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def _visits(hashes: Hashes, x: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[tuple]:
    """Query number, table and non-empty buckets to visit.

    A query goes on past its probes, and at last through all buckets, until those it visits hold
    more than k vectors (it may be one of them itself).
    """
    for lo in range(0, len(x), PROBED):
        every = hashes.probe(x[lo:lo + PROBED], len(STEPS))
        for q in range(len(every)):
            for t in range(TABLES):
                codes = every[q, t]
                n = np.where(codes >= 0, sizes[t, codes], 0)
                enough = int(np.searchsorted(np.cumsum(n), k, side="right")) + 1
                if enough > len(n):
                    yield lo + q, t, np.flatnonzero(sizes[t])
                else:
                    upto = max(enough, hashes.probes)
                    yield lo + q, t, codes[:upto][n[:upto] > 0]


def _probe_batches(hashes: Hashes, starts: np.ndarray, sizes: np.ndarray, groups: int, k: int):
    """For each query the blocks that hold a bucket it visits, with these buckets."""
    first, last = starts // BLOCK, (starts + sizes - 1) // BLOCK

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            rows: list[tuple[int, int, int, list[int]]] = []
            for q, t, codes in _visits(hashes, _matrix(batch.column("embedding")), sizes, k):
                low, high = first[t, codes], last[t, codes]
                for block in np.unique(np.concatenate([low, high])):
                    rows.append((q, t, int(block),
                                 codes[(low <= block) & (block <= high)].tolist()))
                for code, a, b in zip(codes, low, high):  # a bucket over many blocks
                    rows += [(q, t, i, [int(code)]) for i in range(a + 1, b)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("embedding").take(at),
                 pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int32()),
                 pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                 pa.array(_spread(ids[at.to_numpy()], groups), pa.int32())],
                names=["query_id", "query", "table", "block", "probed", "part"])
    return run


_FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("scores", pa.list_(pa.float64()))])


def _rank(k: int):
    """The k best of a block for each query, among the rows of the buckets it probes."""
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and asked.num_rows:
            code = data.column("code").to_numpy()
            order = np.argsort(code, kind="stable")
            code = code[order]
            ids = data.column("vec_id").to_numpy()[order]
            x = _matrix(data.column("embedding"))[order]
            names, begin = np.unique(code, return_index=True)
            end = np.append(begin[1:], len(code))
            queries = asked.column("query_id").to_numpy()
            q = _matrix(asked.column("query"))
            probed = asked.column("probed").to_pylist()
            step = max(1, SCORES // len(ids))
            norm = np.linalg.norm(q, axis=1)
            slack = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1).max()
            for lo in range(0, len(queries), step):
                part = q[lo:lo + step]
                scores = np.full((len(part), len(ids)), -np.inf)
                who = np.repeat(np.arange(len(part)), [len(p) for p in probed[lo:lo + step]])
                what = np.searchsorted(names, [c for p in probed[lo:lo + step] for c in p])
                known = np.isin([c for p in probed[lo:lo + step] for c in p], names)
                who, what = who[known], what[known]
                by = np.argsort(what, kind="stable")
                for group in np.split(by, np.flatnonzero(np.diff(what[by])) + 1):
                    if len(group):
                        b = what[group[0]]
                        scores[who[group], begin[b]:end[b]] = part[who[group]] @ x[begin[b]:end[b]].T
                for i, row in enumerate(scores):
                    row[ids == queries[lo + i]] = -np.inf
                    # In the matrix product equal vectors differ in the last bits, so all that may
                    # tie with the k-th are scored one by one before ids decide.
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    at = np.flatnonzero((row >= least - slack * norm[lo + i]) & (row > -np.inf))
                    exact = np.array([np.dot(part[i], x[j]) for j in at])
                    best = np.lexsort((ids[at], -exact))[:k]
                    if len(at):
                        out.append((int(queries[lo + i]), ids[at[best]].tolist(),
                                    exact[best].tolist()))
        columns = zip(*out) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)],
                                    schema=_FOUND)
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(fine & some)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``,
    candidates all rows with another id; nearness is the inner product in double precision, ties
    go to the smaller id.  Null, zero and empty vectors, those with null or non-finite components,
    rows without id and vectors of another length than most take no part.  A repeated id is one
    candidate, with the larger score.  An empty table gives no rows.

    Hashes and the number of probes are fitted on at most ``SAMPLE`` vectors; every vector is
    indexed.  The number of buckets, and with it what is sent to all tasks, is bounded by
    ``TABLES * SLOTS ** PROJECTIONS``.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("embedding") == most["d"])
    asked = rows.where(F.col("vec_id") % every == 0)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    longest, n_asked = rows.agg(F.max(length), F.count_if(F.col("vec_id") % every == 0)).first()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    hashes = fit(np.array([r["embedding"] for r in drawn]), float(longest), k)

    coded = rows.mapInArrow(_code_batches(hashes),
                            "vec_id long, embedding array<double>, codes array<int>")
    coded = coded.select("vec_id", "embedding", F.posexplode("codes").alias("table", "code"))
    along = (Window.partitionBy("table").orderBy("code")
             .rowsBetween(Window.unboundedPreceding, -1))
    buckets = coded.groupBy("table", "code").agg(F.count("*").alias("n"))
    buckets = buckets.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)))
    held = buckets.collect()  # bounded by the possible buckets
    codes = SLOTS ** PROJECTIONS
    starts, counts = np.zeros((TABLES, codes), np.int64), np.zeros((TABLES, codes), np.int64)
    for b in held:
        starts[b["table"], b["code"]], counts[b["table"], b["code"]] = b["start"], b["n"]
    groups = max(1, -(-n_asked // QUERIES))

    sized = spark.createDataFrame(held, buckets.schema)
    place = F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    keys = ["table", "block", "part"]
    probes = asked.mapInArrow(
        _probe_batches(hashes, starts, counts, groups, k),
        "query_id long, query array<double>, table int, block int, probed array<int>, part int")
    if groups > 1:
        probes = staged(probes, "probes")
        visits = probes.groupBy("table", "block").agg(F.collect_set("part").alias("part"))
    data = coded.join(F.broadcast(sized), ["table", "code"]).select(
        "vec_id", "embedding", "table", "code", F.floor(place / BLOCK).cast("int").alias("block"))
    # A block goes to the groups of queries that visit it, and to no others.
    data = (data.join(visits, ["table", "block"]).withColumn("part", F.explode("part"))
            if groups > 1 else data.withColumn("part", F.lit(0)))
    found = data.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(
        _rank(k), "query_id long, ids array<long>, scores array<double>")
    pairs = (found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p"))
             .groupBy("query_id", F.col("p.ids").alias("vec_id"))
             .agg(F.max("p.scores").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
