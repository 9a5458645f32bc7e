"""Exact top-k search, in three phases with a uniform threshold, for every vector or for the rows whose
vec_id is divisible by ``every``; all rows are searched.

A score is an inner product, and the dimensions are cut into m blocks whose partial scores add up
(the lists of the three-phase uniform-threshold algorithm, Cao and Wang, 2004).

1. Every cell of queries and vectors gathers, from each block's list, the k best entries of each
   query, and sends their k best whole scores.  The k-th best of all cells is a safe cutoff.
2. The cutoff goes out with the queries.  An entry that reaches it has at least one partial score
   of cutoff / m; only such entries are collected, and bounded from above by what they have.
3. The scores that remain possible are resolved exactly, in double precision, and the k best of
   every query are given.

Partial scores may be negative: the cutoff comes from whole scores, and the pigeonhole argument of
phase 2 needs no sign.  Vectors travel in cells of at most about ``block_rows`` queries and as many
vectors, so memory doesn't grow with the table, and only survivors of phase 3 leave a cell.

Defined cases: rows with a null vec_id, a null or empty vector, or a null or not finite element take no
part.  Vectors of different lengths have no score: each is compared with those of its own length.
Repeated rows count once.  A vector is no neighbour of its own vec_id.  Equal scores, as rounded to
nine places, are ranked by vec_id.  With fewer than k others, all are given.  An empty table gives
no rows.  Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
BLOCKS = 2
BLOCK_ROWS = 8192
#: The query's searches: rows whose id is divisible by it.
EVERY = 50

_STEP = 512
_SLACK = 1e-4


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def local_best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, m: int) -> list[np.ndarray]:
    """Phase 1: for each query, k whole scores at most of entries that lead a block's list."""
    cuts = np.array_split(np.arange(x.shape[1]), m)
    q4, x4, out = q.astype(np.float32), x.astype(np.float32), []
    for a in range(0, len(q), _STEP):
        rows = slice(a, min(a + _STEP, len(q)))
        own = qid[rows, None] == xid[None, :]
        lead = []
        for c in cuts:
            part = q4[rows][:, c] @ x4[:, c].T
            part[own] = -np.inf
            lead.append(np.argpartition(-part, k - 1, axis=1)[:, :k] if part.shape[1] > k else np.tile(np.arange(part.shape[1]), (len(part), 1)))
        lead = np.concatenate(lead, axis=1)
        for i in range(len(lead)):
            some = np.unique(lead[i])
            some = some[xid[some] != qid[a + i]]
            out.append(np.sort(x[some] @ q[a + i])[::-1][:k])
    return out


def survivors(q: np.ndarray, qid: np.ndarray, cutoff: np.ndarray, x: np.ndarray, xid: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, vector, score) of all entries whose score reaches the cutoff."""
    cuts = np.array_split(np.arange(x.shape[1]), m)
    q4, x4, out = q.astype(np.float32), x.astype(np.float32), []
    for a in range(0, len(q), _STEP):
        rows = slice(a, min(a + _STEP, len(q)))
        least = cutoff[rows].astype(np.float32)[:, None]
        share = least / m
        bound = np.zeros((len(least), len(x)), np.float32)
        seen = np.zeros(bound.shape, bool)
        for c in cuts:
            part = q4[rows][:, c] @ x4[:, c].T
            seen |= part >= share - _SLACK
            bound += np.maximum(part, share)
        i, j = np.nonzero(seen & (bound >= least - _SLACK))
        other = qid[a + i] != xid[j]
        i, j = i[other], j[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[a + i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        good = score >= cutoff[a + i] - 1e-8
        out.append((qid[a + i[good]], xid[j[good]], score[good]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def top_k(vectors: DataFrame, k: int = K, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS, every: int = 1) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best other vectors of every vector whose vec_id is
    divisible by every."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))"
    ).distinct()
    rows = rows.withColumn("d", F.size("embedding"))
    asked = F.col("vec_id") % every == 0
    sizes = rows.groupBy("d").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cells"), F.ceil(F.count(F.when(asked, 1)) / block_rows).cast("int").alias("rounds"))
    rows = rows.join(sizes.where("rounds > 0"), "d")

    def block(count: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def spread(queries: DataFrame) -> DataFrame:
        """Queries and vectors, each in every cell that it belongs to."""
        a = queries.select("d", block("rounds").alias("i"), each("cells").alias("j"), F.lit(True).alias("query"), "vec_id", "embedding", "cutoff")
        b = rows.select("d", each("rounds").alias("i"), block("cells").alias("j"), F.lit(False).alias("query"), "vec_id", "embedding", F.lit(0.0).alias("cutoff"))
        return a.union(b).groupBy("d", "i", "j")

    def split(group: pa.Table) -> tuple[np.ndarray, ...]:
        query = group.column("query").to_numpy()
        x, ids, cutoff = _matrix(group.column("embedding")), group.column("vec_id").to_numpy(), group.column("cutoff").to_numpy()
        return x[query], ids[query], cutoff[query], x[~query], ids[~query]

    def first(group: pa.Table) -> pa.Table:
        q, qid, _, x, xid = split(group)
        best = local_best(q, qid, x, xid, k, blocks) if len(q) and len(x) else [np.zeros(0)] * len(q)
        return pa.table({"d": group.column("d")[: len(qid)], "vec_id": qid, "scores": pa.array(best, pa.list_(pa.float64()))})

    def rest(group: pa.Table) -> pa.Table:
        q, qid, cutoff, x, xid = split(group)
        found = survivors(q, qid, cutoff, x, xid, blocks) if len(q) and len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    led = spread(rows.where(asked).withColumn("cutoff", F.lit(0.0))).applyInArrow(first, "d int, vec_id bigint, scores array<double>")
    best = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
    # a vec_id that has several vectors is answered from the best of them: the least cutoff is safe
    cutoffs = led.groupBy("d", "vec_id").agg(best.alias("best")).select("d", "vec_id", F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))).otherwise(-1e30).alias("cutoff"))
    several = rows.where(asked).groupBy("d", "vec_id").count().where("count > 1").select("d", "vec_id", F.lit(-1e30).alias("none"))
    cutoffs = cutoffs.join(several, ["d", "vec_id"], "left").select("d", "vec_id", F.coalesce("none", "cutoff").alias("cutoff"))
    found = spread(rows.join(cutoffs, ["d", "vec_id"])).applyInArrow(rest, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.round(F.max("score"), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
