"""Exact nearest vectors of many queries, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_per_key

#: Queries of a block, and rows of a chunk on average.
BLOCK, CHUNK = 1024, 8192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _best(queries: pa.Table, rows: pa.Table, n: int) -> pa.Table:
    """The n best rows of a chunk for each query of a block. Products are summed place by place, so equal vectors get equal cosines."""
    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and rows.num_rows:
        ids, q, e = rows["vec_id"].to_numpy(), _matrix(queries["embedding"]), _matrix(rows["embedding"])
        norm = lambda m: np.sqrt(np.add.accumulate(m * m, axis=1)[:, -1])
        nq, ne, columns = norm(q), norm(e), np.ascontiguousarray(e.T)
        for k, own in enumerate(queries["vec_id"].to_pylist()):
            dot = np.zeros(len(ids))
            for i, x in enumerate(q[k]):
                dot += x * columns[i]
            size = nq[k] * ne
            c = np.divide(dot, size, out=np.full(len(ids), -np.inf), where=size > 0)
            other = np.flatnonzero(ids != own)
            if len(other) > n:
                other = other[c[other] >= np.partition(c[other], len(other) - n)[len(other) - n]]
            other = other[np.lexsort((ids[other], -c[other]))[:n]]
            out[0].extend([own] * len(other))
            out[1].extend(ids[other].tolist())
            out[2].extend(None if x == -np.inf else x for x in c[other].tolist())
    return pa.table({"q": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "c": pa.array(out[2], pa.float64())})


def cosine_topk(queries: DataFrame, rows: DataFrame, n: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """q, vec_id, c: the n rows of greatest cosine for each query but the row of its own id, ties by vec_id; null, and last, where either is a
    zero vector. Both have vec_id and embedding. Each block of queries meets each chunk of rows, which leaves n rows a query."""
    blocks, chunks = -(-queries.count() // block), -(-rows.count() // chunk)
    if not blocks or not chunks:
        return queries.sparkSession.createDataFrame([], "q long, vec_id long, c double")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(k)).cast("int")
    one = F.col("vec_id").cast("long").alias("vec_id")
    left = queries.select(one, "embedding", own(blocks, "q").alias("block"), each(chunks).alias("chunk")).groupBy("block", "chunk")
    right = rows.select(one, "embedding", own(chunks, "r").alias("chunk"), each(blocks).alias("block")).groupBy("block", "chunk")
    some = left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, n), "q long, vec_id long, c double")
    return top_per_key(some, ["q"], [F.col("c").desc(), F.col("vec_id").asc()], n)
