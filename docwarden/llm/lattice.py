"""Near duplicates of vectors by lattice hashing.

A table projects unit vectors at random to eight dimensions and decodes them to the nearest point of
the E8 lattice; that point is the vector's cell. A vector is stored in its own cell of every table
and probes the neighbouring cells nearest to its projection (of the 240 at the least distance). Two
vectors meet if one's cell is the other's cell or one of its probes.

* Equal vectors are one class with a weight, so copies are never paired.
* First only cell hashes, ids and 128 sign bits travel. Entries that have no partner in their cell
  within ``SIGN_BITS_APART`` bits go, which spares fetching vectors for chance meetings (at cosine
  0.9 a pair is lost with a probability of about 1 in 10,000).
* Vectors of the entries that stay are fetched and compared in blocks, in double precision. A block
  returns, for each vector, its number of links and the smallest vector it is connected with, never
  pairs. A pair that meets several times counts in the first table where it does, which both
  vectors' cells and probes tell.
* A cell with more rows than ``BLOCK`` is dealt into blocks, and every two blocks meet in one task.

The work of chance meetings grows as ``n ** 2 / ((4 * pi) ** 4 * scale ** 8)``; larger collections
take a larger ``scale`` and more ``tables``. Recall of pairs at cosine 0.9 is that of ``tables``
tries; it is measured in the tests.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing and are kept; so are rows with a null id, without a component; rows of
one id are vectors of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.components import smallest_reachable
from docwarden.llm.ranks import runs
from docwarden.llm.storage import bounded_batches, stored

#: Tables, probes per table, and spread of a unit vector's projection. A pair at cosine 0.9 meets
#: in one table with probability 0.67.
TABLES, PROBES, SCALE = 5, 8, 0.7
#: Differing sign bits of 128 up to which two vectors are compared; 18.4 are expected at cosine 0.9,
#: with a deviation of 4, and 64 at a right angle.
SIGN_BITS_APART = 34
#: Rows of a cell that meet in one task.
BLOCK = 2048
#: Pairs compared at once inside a task.
PAIRS_AT_ONCE = 1 << 20


def nearest_points(y: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point of every row: the better one of D8 and D8 shifted by a half."""
    def even(z: np.ndarray) -> np.ndarray:
        """Nearest integer points with an even sum: the worst coordinate gives way if it is odd."""
        r = np.rint(z)
        off = z - r
        worst = np.abs(off).argmax(1)
        row = np.flatnonzero(r.sum(1) % 2)
        r[row, worst[row]] += np.where(off[row, worst[row]] >= 0, 1.0, -1.0)
        return r

    whole, half = even(y), even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    signs = np.array(np.meshgrid(*[[-0.5, 0.5]] * 8)).reshape(8, -1).T
    out = [signs[(signs < 0).sum(1) % 2 == 0]]
    for i in range(8):
        for j in range(i):
            for s in (-1, 1):
                for t in (-1, 1):
                    v = np.zeros((1, 8))
                    v[0, i], v[0, j] = s, t
                    out.append(v)
    return np.concatenate(out)


class Tables:
    """Random projections, fixed by the seed."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.projection = rng.normal(size=(dim, 8 * tables)) * scale
        self.signs = rng.normal(size=(dim, 128))
        self.factors = rng.integers(1, 2**63, 9, dtype=np.uint64) | np.uint64(1)
        self.tables, self.probes, self.neighbours = tables, probes, shortest_vectors()

    def _hash(self, table: int, points: np.ndarray) -> np.ndarray:
        from docwarden.llm.tokens import mix

        # twice a lattice point is integer
        total = np.full(points.shape[:-1], table + 1, np.uint64) * self.factors[8]
        for k in range(8):
            total += np.rint(2 * points[..., k]).astype(np.int64).view(np.uint64) * self.factors[k]
        return mix(total).view(np.int64)

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells (n x tables), probes (n x tables x probes) and sign bits (n x 2) of unit vectors."""
        y = unit @ self.projection
        cells = np.empty((len(unit), self.tables), np.int64)
        probed = np.empty((len(unit), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            z = y[:, 8 * t: 8 * t + 8]
            point = nearest_points(z)
            cells[:, t] = self._hash(t, point)
            if self.probes:
                near = np.argpartition(-((z - point) @ self.neighbours.T), self.probes - 1, axis=1)[:, : self.probes]
                probed[:, t] = self._hash(t, point[:, None] + self.neighbours[near])
        bits = np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)
        return cells, probed, bits


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = rows.reshape(len(rows), -1)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.int64()))


def _coded(dim: int, make: tuple):
    def run(batches):
        tables = Tables(dim, *make)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), dim)
                # scaled first: squares of very large and very small components stay finite
                x = x / np.abs(x).max(1, keepdims=True)
                cells, probed, bits = tables.coded(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, _lists(cells), _lists(probed), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                    [*batch.schema.names, "cells", "probed", "bits", "more"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, components summed from the first to the last."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    square = lambda v: np.cumsum(v * v, axis=1)[:, -1]
    return np.cumsum(x * y, axis=1)[:, -1] / np.sqrt(square(x) * square(y))


def _sides(block: pa.Table):
    """Row numbers of both sides of the blocks that meet: all rows, or the first and second block."""
    a, b = block.column("i").to_numpy()[0], block.column("j").to_numpy()[0]
    part = block.column("part").to_numpy()
    return (np.flatnonzero(part == a), np.flatnonzero(part == b)), a == b


def _near_pairs(left: np.ndarray, right: np.ndarray, same: bool):
    """Chunks (rows, columns) of all pairs of two blocks, each pair once."""
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    for k in range(0, len(left), step):
        yield left[k: k + step], right[k:] if same else right


def _likely(apart: int):
    """Rows that have a partner in their cell, by sign bits; one of the two must own the cell."""

    def run(batches):
        for block in runs(batches, "cell", "i", "j"):
            (left, right), same = _sides(block)
            bits, more = (block.column(c).to_numpy().view(np.uint64) for c in ("bits", "more"))
            own = block.column("own").to_numpy()
            found = np.zeros(len(bits), bool)
            for rows, columns in _near_pairs(left, right, same):
                off = np.bitwise_count(bits[rows][:, None] ^ bits[columns][None, :])
                off += np.bitwise_count(more[rows][:, None] ^ more[columns][None, :])
                near = off <= apart
                near &= (own[rows][:, None] | own[columns][None, :]) & (rows[:, None] != columns[None, :])
                found[rows] |= near.any(1)
                found[columns] |= near.any(0)
            if found.any():
                yield pa.RecordBatch.from_arrays(
                    [block.column(c).combine_chunks().filter(pa.array(found)) for c in ("cell", "id", "own")],
                    ["cell", "id", "own"])

    return run


def _linked(dim: int, tables: int, least: float):
    """``id, links, other`` of a cell's blocks: links first met here, and the smallest vector of
    the part of the block's links that holds the row."""

    def run(batches):
        for block in runs(batches, "cell", "i", "j"):
            (left, right), same = _sides(block)
            ids, weight = block.column("id").to_numpy(), block.column("weight").to_numpy()
            own, cell = block.column("own").to_numpy(), block.column("cell").to_numpy()[0]
            x = _matrix(block.column("vec").combine_chunks(), dim)
            scaled = x / np.abs(x).max(1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            cells = np.stack(block.column("cells").to_numpy())
            probed = np.stack(block.column("probed").to_numpy()).reshape(len(ids), tables, -1)
            links, least_id = np.zeros(len(ids), np.int64), ids.copy()
            pairs = []
            for rows, columns in _near_pairs(left, right, same):
                close = unit[rows] @ unit[columns].T >= least - 1e-9
                close &= own[rows][:, None] | own[columns][None, :]
                if same:
                    close &= rows[:, None] < columns[None, :]
                a, b = np.nonzero(close)
                a, b = rows[a], columns[b]
                for k in range(0, len(a), PAIRS_AT_ONCE // 64):
                    p, q = a[k: k + PAIRS_AT_ONCE // 64], b[k: k + PAIRS_AT_ONCE // 64]
                    sure = cosines(x[p], x[q]) >= least
                    p, q = p[sure], q[sure]
                    here = first_met(cells, probed, ids, own, cell, p, q)
                    np.add.at(links, p[here], weight[q[here]])
                    np.add.at(links, q[here], weight[p[here]])
                    pairs.append((p, q))
            if not pairs:
                continue
            p, q = (np.concatenate(side) for side in zip(*pairs))
            while True:  # the smallest id spreads along the block's links
                before = least_id.copy()
                np.minimum.at(least_id, p, before[q])
                np.minimum.at(least_id, q, before[p])
                if (least_id == before).all():
                    break
            use = np.flatnonzero((links > 0) | (least_id < ids))
            if len(use):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[use]), pa.array(links[use]), pa.array(least_id[use])], ["id", "links", "other"])

    return run


def first_met(cells, probed, ids, own, cell, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the pairs (p, q), which meet in ``cell``, do so there for the first time."""
    out = np.ones(len(p), bool)
    settled = np.zeros(len(p), bool)
    for t in range(cells.shape[1]):
        equal = cells[p, t] == cells[q, t]
        p_in_q = (probed[q, t] == cells[p, t][:, None]).any(1) & ~equal  # they meet in p's cell
        q_in_p = (probed[p, t] == cells[q, t][:, None]).any(1) & ~equal
        # of two meetings in one table, that in the cell of the smaller id comes first
        in_p = p_in_q & (~q_in_p | (ids[p] < ids[q]))
        place = np.where(equal | in_p, cells[p, t], cells[q, t])
        meets = (equal | p_in_q | q_in_p) & ~settled
        out[meets] = place[meets] == cell
        settled |= meets
    return out


def _meetings(rows: DataFrame, block: int) -> DataFrame:
    """Rows (cell, id, own, ...), large cells dealt to pairs of blocks (``i``, ``j``, the row's own
    being ``part``), sorted by them."""
    large = rows.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > block).select(
        "cell", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(large, "cell", "left").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")}).drop("parts", "with")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (F.size(vector) == dim) & finite & F.exists(vector, lambda c: c != 0)


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9,
    tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: vectors found with a cosine of ``least``
    or more, the smallest id that links lead to, and whether that is the row's own."""
    bounded_batches(vectors.sparkSession)
    key = F.col(f"`{vec_id}`").cast("long")
    given = vectors.select(key.alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    dims = given.where("size(vec) > 0").groupBy(F.size("vec").alias("dim")).count().orderBy(
        F.desc("count"), "dim").limit(1).collect()
    dim = dims[0].dim if dims else 1
    kept = given.where(F.col("id").isNotNull() & usable(F.col("vec"), dim))
    # equal vectors are one class, named by its smallest id
    classes = kept.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    # rows of one id may be several classes, so classes have a number of their own
    named = stored(classes.select(
        F.monotonically_increasing_id().alias("class"), "id", "weight", "vec"))
    coded = stored(named.select(F.col("class").alias("id"), "weight", "vec").mapInArrow(
        _coded(dim, (tables, probes, scale)),
        "id long, weight long, vec array<double>, cells array<long>, probed array<long>, bits long, more long"))
    entries = coded.select("id", "bits", "more", F.explode(F.concat(
        F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("own"))),
        F.transform("probed", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own"))))).alias("e"))
    entries = stored(entries.select("e.cell", "e.own", "id", "bits", "more"))
    likely = stored(_meetings(entries, block).mapInArrow(_likely(SIGN_BITS_APART), "cell long, id long, own boolean").distinct())
    met = stored(_meetings(likely.join(coded.drop("bits", "more"), "id"), block).mapInArrow(
        _linked(dim, tables, least), "id long, links long, other long"))
    numbers = met.groupBy("id").agg(F.sum("links").alias("links"))
    # from classes to vectors: components of classes, each named by its smallest vector id
    joined = smallest_reachable(met.where("id <> other"), "id", "other").select(F.col("id").alias("class"), "component")
    of_class = named.join(numbers.withColumnRenamed("id", "class"), "class", "left").join(joined, "class", "left").select(
        "class", "id", "weight", "vec", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "class").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("id").alias("smallest"), F.count("*").alias("classes"))
    # only classes with a link or with copies differ from a vector that is alone
    told = stored(of_class.join(smallest, "component").where("links > 0 OR weight > 1 OR classes > 1").select(
        "vec", (F.col("links") + F.col("weight") - 1).alias("links"), "smallest"))
    known = told.withColumnRenamed("vec", "same")
    found = given.join(known, (F.col("vec") == F.col("same")) & F.col("id").isNotNull(), "left")
    smallest = F.coalesce("smallest", "id")
    return found.select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        smallest.alias("component_id"), F.coalesce(F.col("id") == smallest, F.lit(True)).alias("kept"))
