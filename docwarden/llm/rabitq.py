"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is padded, turned by a random rotation and kept as the signs of its coordinates, packed
in bits, with two correction scalars: its norm, and the cosine between it and its code. The code
gives an unbiased estimate of an inner product and an error bound that holds with high
probability (``ERROR_FACTOR`` standard errors). A query first takes the exact products of the
best estimates, then of every vector whose upper bound reaches the k-th exact product so far, so
only a vector whose true error passes the bound can be missed.

Vectors and queries are dealt into blocks. A block of queries meets a block of vectors in one
task, which returns each query's k best; those are merged by rank. Memory is that of two blocks.
Original vectors travel with their codes, in the type they are stored in: reranking inside the task
narrows a query's bound vector by vector, while candidates of codes alone, fetched by a later join,
would be about one in a hundred of all pairs. What is shuffled is vectors times blocks of queries and
queries times blocks of vectors, so a block of queries holds as many as a task can.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; fewer than k candidates give as many rows; ties go to the
smaller id; rows with a null id take no part; an id that occurs twice is a candidate twice;
empty tables give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.storage import bounded_batches, stored

#: Bits of a code at least: vectors with fewer components are padded, which narrows the bounds.
LEAST_BITS = 512
ERROR_FACTOR = 2.6
#: Code bits of one block of vectors, and components of one block of queries.
VECTOR_BLOCK = 1 << 23
QUERY_BLOCK = 1 << 20
#: A query counts as that many components at least.
LEAST_DIM = 64
#: Queries estimated at once inside a task.
AT_ONCE = 128


def rotation(dim: int, bits: int, seed: int = 5) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of ``bits`` dimensions, as (dim, bits)."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(bits, dim)))
    return np.ascontiguousarray(q.T)


def encode(x: np.ndarray, turn: np.ndarray):
    """Packed signs, norms, and cosines between vectors and their codes."""
    norm = np.linalg.norm(x, axis=1)
    y = x @ turn
    codes = np.packbits(y > 0, axis=1)
    cosine = np.abs(y).sum(1) / np.sqrt(turn.shape[1]) / norm
    return codes, norm, cosine


def signs_of(codes: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1


def estimates(signs, norm, cosine, queries: np.ndarray, turn: np.ndarray):
    """Estimated inner products (queries x vectors) and what they may be off by."""
    bits = turn.shape[1]
    turned = (queries @ turn).astype(np.float32)
    scale = (norm / cosine / np.sqrt(bits)).astype(np.float32)
    off = norm * np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine / np.sqrt(bits - 1) * ERROR_FACTOR
    width = np.linalg.norm(queries, axis=1)[:, None] * off[None, :] + 1e-6
    return (turned @ signs.T) * scale[None, :], width


def best_in_block(ids, x, codes, norm, cosine, query_ids, queries, turn, k: int):
    """(query id, id, product) rows of each query's k best vectors of one block."""
    out = []
    signs = signs_of(codes, turn.shape[1])
    for i in range(0, len(queries), AT_ONCE):
        estimate, width = estimates(signs, norm, cosine, queries[i : i + AT_ONCE], turn)
        own = ids[None, :] == query_ids[i : i + AT_ONCE, None]
        estimate[own] = -np.inf
        few = min(k, len(ids))
        top = np.argpartition(-estimate, few - 1, axis=1)[:, :few]
        for j in range(len(estimate)):
            q = queries[i + j]
            first = top[j][estimate[j, top[j]] > -np.inf]
            if not len(first):
                continue
            exact = _products(x[first], q)
            floor = np.sort(exact)[0] if len(first) == few else -np.inf
            again = np.flatnonzero(estimate[j] + width[j] >= floor)
            again = again[~own[j, again]]
            exact = _products(x[again], q)
            order = np.lexsort((ids[again], -exact))[:k]
            out.append((np.full(len(order), query_ids[i + j]), ids[again][order], exact[order]))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(x * q[None, :], axis=1)[:, -1]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coded(dim: int, bits: int):
    """Add codes and correction scalars to (block, id, vec) batches; vectors stay as they are."""

    def run(batches):
        turn = rotation(dim, bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, norm, cosine = encode(_matrix(batch.column(2), dim), turn)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(cosine)],
                ["block", "id", "vec", "code", "norm", "cosine"])

    return run


def _meet(dim: int, bits: int, k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not vectors.num_rows:
            return empty
        x = _matrix(vectors.column("vec").combine_chunks(), dim)
        codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        found = best_in_block(
            vectors.column("id").to_numpy(), x, codes, vectors.column("norm").to_numpy(),
            vectors.column("cosine").to_numpy(), queries.column("id").to_numpy(),
            _matrix(queries.column("vec").combine_chunks(), dim), rotation(dim, bits), k)
        return empty if found is None else pa.table(dict(zip(empty.column_names, found)))

    return run


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda c: c != 0)


def nearest(
    vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` largest inner products."""
    bounded_batches(vectors.sparkSession)
    vec = F.col(f"`{vector}`")
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    given = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), vec.cast(kind).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("is_query")).where("id IS NOT NULL AND size(vec) > 0")
    dims = given.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 1
    kept = given.where(usable(F.col("vec"), dim))
    bits = -(-max(dim, LEAST_BITS) // 8) * 8
    sizes = kept.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    # small tables are cut into one block of vectors per core, which repeats the queries only
    v_blocks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-sizes.n * bits // VECTOR_BLOCK))
    q_blocks = max(1, -(-sizes.q * max(dim, LEAST_DIM) // QUERY_BLOCK))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")

    coded = stored(kept.select(block(v_blocks).alias("block"), "id", "vec").mapInArrow(
        _coded(dim, bits), f"block int, id long, vec {kind}, code binary, norm double, cosine double"))
    asked = kept.where("is_query").select(block(q_blocks).alias("q_block"), "id", "vec")
    # every block of queries meets every block of vectors
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    all_coded = coded.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    found = asked.groupBy("q_block", "block").cogroup(all_coded.groupBy("q_block", "block")).applyInArrow(
        _meet(dim, bits, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
