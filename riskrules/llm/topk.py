"""Exact top-k vector search with block-at-a-time pruning.

Vectors become integers, floor(scale * x).  Each signed dimension is a pair of
terms (positive and negative part of the query).  Vectors are cut into
document-range blocks; a block holds its forward index (the integer matrix) and
its term maxima.  For a query the upper bound of a block is the sum of the term
maxima weighted by the query; blocks are scored in order of falling bound until
the next bound lies below the query's k-th score.  Ties at the k-th score are
still scored (the bound must be strictly below), so ties go to the smaller id.

Work is dealt as (shard of blocks, batch of queries): a shard row and a batch row
have a fixed largest size, every pair is one bounded unit of work, and only k
rows per query and shard leave it.  The query set is stated by the caller and
meets all rows, in blocks; there is no cap and no sample.

Defined results: rows with a null id or a vector that is null, empty or holds
null or non-finite components take no part; a vector shorter than the longest
counts as 0 in the missing components; rows with the query's id are the query's
own; an id that occurs several times is a candidate once per row and, as a
query, uses its first row in vector order; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

#: Vectors of a block, of a shard and queries of a batch.
BLOCK, SHARD, BATCH = 128, 8192, 512
RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, q array<long>`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite).select(
        "vec_id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q")
    )


def _small(mat: np.ndarray) -> bytes:
    """The matrix in the narrowest integers that hold it."""
    most = int(np.abs(mat).max(initial=0))
    return mat.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (rows * dim)]
    return np.frombuffer(raw, kind).reshape(rows, dim)


def _packer(size: int):
    """Rows of one group (at most ``size``) as one row: ids and matrix as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            ids = np.concatenate([h[0] for h in held])
            dim = max(h[1].shape[1] for h in held)
            mat = np.concatenate([np.pad(h[1], ((0, 0), (0, dim - h[1].shape[1]))) for h in held])
            for i in range(0, len(ids), size):
                yield pa.record_batch([pa.array([ids[i : i + size].tobytes()]), pa.array([_small(mat[i : i + size])]), pa.array([dim], pa.int32())], names=["ids", "mat", "dim"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q")
            off = q.offsets.to_numpy()
            lens = np.diff(off)
            vals = q.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype(np.int64)
            mat = np.zeros((len(lens), int(lens.max())), np.int64)
            mat[np.repeat(np.arange(len(lens)), lens), np.arange(len(vals)) - np.repeat(off[:-1] - off[0], lens)] = vals
            held.append((b.column("vec_id").to_numpy().astype(np.int64), mat))
            n += len(lens)
            if n >= size:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    return pack


def best(query: np.ndarray, own: int, ids: np.ndarray, mat: np.ndarray, order: np.ndarray, bounds: np.ndarray, k: int, exact: np.dtype) -> list[tuple[int, int]]:
    """The k best ``(score, id)`` of one shard for one query, block by block."""
    kept_s, kept_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in order:
        if len(kept_s) == k and bounds[b] < kept_s[-1]:
            break
        lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(ids))
        score = (mat[lo:hi] @ query.astype(exact)).astype(np.int64)
        keep = ids[lo:hi] != own
        if len(kept_s) == k:
            keep &= score >= kept_s[-1]
        if keep.any():
            s, i = np.r_[kept_s, score[keep]], np.r_[kept_i, ids[lo:hi][keep]]
            top = np.lexsort((i, -s))[:k]
            kept_s, kept_i = s[top], i[top]
    return list(zip(kept_s.tolist(), kept_i.tolist(), strict=True))


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                ids = np.frombuffer(r["ids"], np.int64)
                mat = _matrix(r["mat"], len(ids), r["dim"]).astype(np.int64)
                qids = np.frombuffer(r["q_ids"], np.int64)
                qmat = _matrix(r["q_mat"], len(qids), r["q_dim"]).astype(np.int64)
                dim = max(mat.shape[1], qmat.shape[1])
                mat, qmat = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (mat, qmat))
                # doubles are exact below 2^53, else integers
                largest = float(np.abs(mat).max(initial=0)) * float(np.abs(qmat).max(initial=0)) * dim
                exact = np.float64 if largest < 2**53 else np.int64
                m = mat.astype(exact)
                cuts = np.arange(0, len(ids), BLOCK)
                # term maxima: of the dimension, and of its negative
                high, low = np.maximum.reduceat(m, cuts), np.maximum.reduceat(-m, cuts)
                q = qmat.astype(exact)
                bounds = np.maximum(q, 0) @ high.T + np.maximum(-q, 0) @ low.T
                orders = np.argsort(-bounds, axis=1, kind="stable")
                out = [(int(qids[i]), d, s) for i in range(len(qids)) for s, d in best(qmat[i], qids[i], ids, m, orders[i], bounds[i], k, exact)]
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = shared_table(quantised(vectors, id_col, vec_col, scale), "vectors")
    parts = max(1, -(-rows.count() // SHARD))
    shards = (
        rows.repartitionByRange(F.col("vec_id"))
        .sortWithinPartitions("vec_id")
        .mapInArrow(_packer(SHARD), "ids binary, mat binary, dim int")
        .withColumn("part", F.pmod(F.xxhash64("ids", "mat"), F.lit(parts)))
    )
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    # each batch of the stated query set goes to every part: bounded units of work
    asked = queries.mapInArrow(_packer(BATCH), "ids binary, mat binary, dim int").select(
        F.col("ids").alias("q_ids"),
        F.col("mat").alias("q_mat"),
        F.col("dim").alias("q_dim"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
    )
    found = shards.join(asked, "part").mapInArrow(_searcher(k), RESULT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
