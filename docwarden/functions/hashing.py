"""Signed feature-hash vectors of terms, computed inside the row.

A term maps to one of 128 dimensions and a sign through its sha-256 digest. A
text's vector is the sum over its terms, scaled to unit length. For a query,
terms become sorted integer codes, so equal dimensions are adjacent and one fold
yields the vector. For the chunks of documents, which have nearly all terms, sums
and scores are taken over Arrow batches, where a term is hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docwarden.catalog import HASH_DIMENSIONS
from docwarden.functions.once import named
from docwarden.functions.text import TERM


def _byte(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 2 * index + 1, 2), 16, 10).cast("int")


def term_codes(terms: Column) -> Column:
    """Sorted ``2 * dimension + (1 if negative)`` codes.

    Only the fourth digest byte decides a dimension because 128 divides 256.
    """
    digests = F.transform(terms, lambda t: F.sha2(t, 256))
    code = lambda h: (_byte(h, 3) % HASH_DIMENSIONS) * 2 + _byte(h, 4) % 2
    return F.sort_array(F.transform(digests, code))


def sparse_sums(codes: Column) -> Column:
    """array<(dim, total)> with non-zero totals, by dimension (at most 128)."""
    item = "struct<dim:int,total:int>"

    def closed(a: Column) -> Column:
        entry = F.struct(a["dim"].alias("dim"), a["run"].alias("total"))
        return F.when(a["run"] != 0, F.concat(a["done"], F.array(entry))).otherwise(a["done"])

    def step(a: Column, c: Column) -> Column:
        dim, sign = F.floor(c / 2).cast("int"), F.lit(1) - (c % 2) * 2
        same = a["dim"] == dim
        return F.struct(
            dim.alias("dim"),
            F.when(same, a["run"] + sign).otherwise(sign).alias("run"),
            F.when(same, a["done"]).otherwise(closed(a)).alias("done"),
        )

    zero = F.struct(
        F.lit(-1).alias("dim"), F.lit(0).alias("run"), F.array().cast(f"array<{item}>").alias("done")
    )
    return F.aggregate(codes, zero, step, closed)


def _norm(sparse: Column) -> Column:
    squares = F.aggregate(
        sparse, F.lit(0).cast("bigint"), lambda a, x: a + x["total"] * x["total"]
    )
    return F.when(squares > 0, F.sqrt(squares.cast("double"))).otherwise(F.lit(1.0))


#: Chunks whose terms are summed at a time, which bounds a worker's memory.
SUMMED_CHUNKS = 8_192


def _hashing(dimensions: int, most: int, term: str, scored: bool):
    """Sums, or scores, of Arrow batches of rows of chunks. Workers need no module of ours for it."""

    def run(batches):
        import hashlib
        import re
        from functools import lru_cache
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        find = re.compile(term).findall
        entry = pa.struct([("dim", pa.int32()), ("total", pa.int32())])

        @lru_cache(maxsize=1 << 16)
        def code(word: str) -> int:
            digest = hashlib.sha256(word.encode()).digest()
            return digest[3] % dimensions * 2 + digest[4] % 2

        def totals_of(codes, owner, n: int):
            """The vector of each text before it is scaled."""
            place = owner * dimensions + codes // 2
            return np.bincount(place, 1 - codes % 2 * 2, n * dimensions).reshape(n, dimensions)

        def norms(totals):
            return np.sqrt(np.maximum((totals * totals).sum(axis=1), 1.0))

        def read(texts: pa.Array):
            """Totals, and which distinct word stands where."""
            found = [find(t) for t in texts.to_pylist()]
            words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            codes = np.array([code(w) for w in distinct], np.int64)[at]
            return totals_of(codes, owner, len(found)), distinct, at, owner

        def sums(texts: pa.Array) -> pa.Array:
            totals = read(texts)[0].astype(np.int32).ravel()
            kept = np.flatnonzero(totals)
            ends = np.searchsorted(kept, np.arange(len(texts) + 1) * dimensions)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(kept % dimensions, pa.int32()), pa.array(totals[kept])], fields=list(entry)))

        def scores(texts: pa.Array, asked, queries, vectors) -> pa.Array:
            """``asked``: the number of each text's query."""
            totals, distinct, at, owner = read(texts)
            near = (totals * vectors[asked]).sum(axis=1) / norms(totals)
            place = {w: i for i, w in enumerate(distinct)}
            wanted = np.array([q * len(distinct) + place[w] for q, ws in enumerate(queries) for w in ws if w in place], np.int64)
            some = np.zeros(len(distinct), bool)
            some[wanted % max(len(distinct), 1)] = True
            hits = np.flatnonzero(some[at])
            pairs = np.unique(owner[hits] * len(distinct) + at[hits])
            text, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
            shared = np.bincount(text[np.isin(asked[text] * len(distinct) + word, wanted)], minlength=len(texts))
            return pa.array(near + shared / np.array([max(len(ws), 1) for ws in queries])[asked])

        for batch in batches:
            rows = batch[0]
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            texts, kind, more = rows.flatten(), pa.list_(entry), ()
            if scored:
                kind, number = pa.float64(), {}
                of_row = [number.setdefault(tuple(q or ()), len(number)) for q in batch[1].to_pylist()]
                asked = np.repeat(np.array(of_row, np.int64), sizes)
                codes = [np.array([code(w) for w in q], np.int64) for q in number]
                vectors = np.concatenate([totals_of(c, np.zeros(len(c), np.int64), 1) for c in codes] or [np.zeros((0, dimensions))])
                more = [set(q) for q in number], vectors / norms(vectors)[:, None]
            found = [pa.array([], kind)]
            for start in range(0, len(texts), most):
                part = texts.slice(start, most)
                found.append(scores(part, asked[start:start + most], *more) if scored else sums(part))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found), mask=rows.is_null())

    def sums_of(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run((r,) for r in rows)

    def scores_of(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(rows)

    return scores_of if scored else sums_of


def chunk_sums(lowered: Column) -> Column:
    """array<array<(dim, total)>> of an array of lower-case texts: ``sparse_sums`` of each one's terms."""
    return F.arrow_udf(
        _hashing(HASH_DIMENSIONS, SUMMED_CHUNKS, TERM, False), "array<array<struct<dim:int,total:int>>>")(lowered)


def hashed_scores(lowered: Column, query_terms: Column) -> Column:
    """array<double> of an array of lower-case texts: the dot product of each one's unit vector with
    that of the row's query terms, plus the share of distinct query terms that the text holds."""
    return F.arrow_udf(
        _hashing(HASH_DIMENSIONS, SUMMED_CHUNKS, TERM, True), "array<double>")(lowered, query_terms)


def unit_vector(sums: Column) -> Column:
    """array<(dim, w)> of unit length from the sums of a text."""

    def scaled(s: Column) -> Column:
        return F.transform(
            s["sums"], lambda x: F.struct(x["dim"].alias("dim"), (x["total"] / s["norm"]).alias("w"))
        )

    def measured(sums: Column) -> Column:
        return F.struct(sums.alias("sums"), _norm(sums).alias("norm"))

    return named(named(sums, measured), scaled)


def dense_vector(terms: Column) -> Column:
    """The unit vector of a text's terms as array<double> of 128 values."""
    return named(
        F.map_from_entries(unit_vector(sparse_sums(term_codes(terms)))),
        lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(HASH_DIMENSIONS - 1)),
            lambda d: F.coalesce(F.try_element_at(m, d), F.lit(0.0)),
        ),
    )

