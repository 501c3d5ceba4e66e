"""Toxicity scores from a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first 4, 5 and 6 bytes of longer words, so that
inflected and compounded forms share evidence. A term's hash names one of 2^22 buckets; a text
is the set of its buckets. The machine adds a weight per bucket and the inner product of two
factor vectors per pair of buckets, so an insult next to a mention of a group can count for more
than both alone.

Learning: at most ``MAX_TRAINING`` labelled texts, chosen by a hash of their id (a documented
bound; all of them where there are fewer; of an id that documents repeat, one text). Spark counts
each bucket by label over that sample. The machine keeps the ``MAX_TERMS`` buckets that tell most
alone, and the buckets of the ``MAX_PAIRS`` pairs that tell most together and far more than their
parts: words that are harmless each and toxic next to each other tell nothing alone. Pairs are
looked for among the ``PAIR_TERMS`` most frequent buckets. All three are parameters of the model's
size, as the number of factors is. The sample's rows over these buckets, which are bounded by both
limits, go to the driver, where the machine is fitted. Scoring runs over every whole text and sends
only the model to the executors.

Defined cases: null and empty texts score the model's base rate; labels other than 0 and 1 or
with a null id are left out; an id labelled twice counts as toxic if one label says so; without
training labels every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.storage import bounded_batches, stored
from docwarden.llm.tokens import NOT_ALPHANUMERIC, Words, pieces, words

BITS = 22
PREFIX_BYTES = (4, 5, 6)
#: Labelled texts the machine is fitted on, at most.
MAX_TRAINING = 20_000
#: Buckets the machine keeps because they tell something alone, and pairs it keeps besides, at most.
MAX_TERMS, MAX_PAIRS = 512, 128
#: Most frequent buckets among which pairs are looked for.
PAIR_TERMS = 2_048
#: Chi-squared value of a pair from which it is kept (there are millions of pairs), and how much more
#: than the sum of its parts' it has to be.
LEAST_PAIR_CHI2, PAIR_GAIN = 60.0, 2.0
#: Chi-squared value of a bucket from which it is kept.
LEAST_CHI2 = 30.0
FACTORS = 4
STEPS = 400


@dataclass
class Machine:
    """Bucket ids and their weights and factors; ``bias`` alone scores a text without terms."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def table(self) -> np.ndarray:
        """Index of each bucket among the kept ones, or -1."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return out

    def score(self, rows: np.ndarray, terms: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores of ``n_rows`` texts given (row, kept term) pairs."""
        return 1 / (1 + np.exp(-self.margin(rows, terms, n_rows)))

    def margin(self, rows, terms, n_rows):
        out = self.bias + np.bincount(rows, self.weights[terms], n_rows)
        for k in range(self.factors.shape[1]):
            v = self.factors[terms, k]
            out += 0.5 * (np.bincount(rows, v, n_rows) ** 2 - np.bincount(rows, v * v, n_rows))
        return np.clip(out, -30, 30)


def term_buckets(found: Words, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a run of texts, or (row, kept term) given a table."""
    n_words = np.diff(found.row_ptr)
    row = np.repeat(np.arange(len(n_words)), n_words)
    rows, buckets = [], []
    for h in (found.hashes, *(found.prefix_hashes(k) for k in PREFIX_BYTES)):
        b = (h >> np.uint64(64 - BITS)).astype(np.int64)
        use = h != 0
        if kept is not None:
            b = kept[b].astype(np.int64)
            use &= b >= 0
        rows.append(row[use])
        buckets.append(b[use])
    both = np.unique((np.concatenate(rows) << BITS) | np.concatenate(buckets))
    return both >> BITS, both & ((1 << BITS) - 1)


def _count_terms(batches):
    """(bucket, texts with label 1, texts with label 0) from (text, label) batches."""
    held = []

    def flush():
        b, y = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket, at = np.unique(b, return_inverse=True)
        pos = np.bincount(at, y, len(bucket)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(pos), pa.array(np.bincount(at, minlength=len(bucket)) - pos)],
            ["bucket", "pos", "neg"])

    for batch in batches:
        for piece in pieces(batch, 0):
            row, bucket = term_buckets(words(piece.column(0), NOT_ALPHANUMERIC))
            held.append((bucket, piece.column(1).to_numpy()[row]))
            if sum(len(x) for x, _ in held) > 500_000:
                yield flush()
                held = []
    if held:
        yield flush()


def _kept_terms(table):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                row, term = term_buckets(words(piece.column(0), NOT_ALPHANUMERIC), table.value)
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(1), terms], ["y", "terms"])

    return run


def fit(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, n_terms: int, seed: int = 7):
    """Weights by full-batch Adam on the logistic loss; returns (bias, weights, factors)."""
    rng = np.random.default_rng(seed)
    n = len(y)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    state = [np.array([np.log(rate / (1 - rate))]), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in state]
    penalty = (0.0, 1e-5, 1e-3)
    for step in range(1, STEPS + 1):
        m = Machine(np.zeros(0), float(state[0][0]), state[1], state[2])
        error = (m.score(rows, terms, n) - y) / n
        per = error[rows]
        gv = np.empty_like(state[2])
        for k in range(FACTORS):
            v = state[2][terms, k]
            total = np.bincount(rows, v, n)
            gv[:, k] = np.bincount(terms, per * (total[rows] - v), n_terms)
        grads = [np.array([error.sum()]), np.bincount(terms, per, n_terms), gv]
        for i, g in enumerate(grads):
            g = g + penalty[i] * state[i]
            a = 0.9 * moments[i][0] + 0.1 * g
            b = 0.999 * moments[i][1] + 0.001 * g * g
            moments[i] = (a, b)
            state[i] = state[i] - 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return float(state[0][0]), state[1], state[2]


def chi_squared(a, b, n1: int, n0: int):
    """Of a feature that ``a`` of ``n1`` texts with label 1 have, and ``b`` of ``n0`` others."""
    spread = (a + b) * (float(n1 + n0) - a - b) * float(max(n1, 1)) * float(max(n0, 1))
    return (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / spread


#: Texts and terms handled at once on the driver.
ROWS_AT_ONCE, TERMS_AT_ONCE = 500, 128


def _blocks(offsets: np.ndarray, terms: np.ndarray, number: np.ndarray):
    """(first row, row within the block, number) of the terms that have a number, block by block."""
    for k in range(0, len(offsets) - 1, ROWS_AT_ONCE):
        ends = offsets[k: k + ROWS_AT_ONCE + 1]
        found = number[terms[ends[0]: ends[-1]]]
        row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        yield k, row[found >= 0], found[found >= 0]


def telling_pairs(blocks, y: np.ndarray, n_terms: int) -> list[tuple[int, int]]:
    """Pairs of terms that tell the label together and far more than each alone, best first.

    ``blocks`` are those of ``_blocks``. Counts are whole numbers below 2 ** 24, exact in 32 bits."""
    both, toxic = (np.zeros((n_terms, n_terms), np.float32) for _ in range(2))
    for k, row, term in blocks:
        mine = y[k: k + ROWS_AT_ONCE]
        block = np.zeros((len(mine), n_terms), np.float32)
        block[row, term] = 1
        both += block.T @ block
        marked = block[mine == 1]
        toxic += marked.T @ marked
    n1 = int(y.sum())

    def chi2(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(chi_squared(a.astype(float), b.astype(float), n1, len(y) - n1), posinf=0.0)

    alone = chi2(np.diag(toxic), np.diag(both) - np.diag(toxic))
    found = []
    for k in range(0, n_terms, TERMS_AT_ONCE):
        at = slice(k, k + TERMS_AT_ONCE)
        value = chi2(toxic[at], both[at] - toxic[at])
        least = np.maximum(LEAST_PAIR_CHI2, PAIR_GAIN * (alone[at, None] + alone[None, :]))
        a, b = np.nonzero((value >= least) & (both[at] >= 3))
        found += [(-value[i, j], k + i, j) for i, j in zip(a.tolist(), b.tolist()) if k + i < j]
        found = sorted(found)[:MAX_PAIRS]
    return [(i, j) for _, i, j in found]


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str) -> Machine | None:
    """Fit a machine on a bounded sample of ``labels`` joined with their texts."""
    y = F.col(f"`{label}`")
    one = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), y.cast("int").alias("y"))
    one = one.where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(MAX_TRAINING)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most MAX_TRAINING pairs of numbers, and one text for each
    sample = stored(texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y"))
    n = dict(sample.groupBy("y").count().collect())
    if not n:
        return None
    n1, n0 = n.get(1, 0), n.get(0, 0)
    counts = stored(sample.mapInArrow(_count_terms, "bucket long, pos long, neg long").groupBy("bucket").agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
        .where(F.col("p") + F.col("q") >= 3).where(F.col("p") + F.col("q") < n1 + n0))
    chi2 = chi_squared(F.col("p"), F.col("q"), n1, n0)
    alone = counts.select("bucket", chi2.alias("chi2")).where(F.col("chi2") >= LEAST_CHI2).orderBy(
        F.desc("chi2"), "bucket").limit(MAX_TERMS).toArrow().column("bucket").to_numpy()
    frequent = counts.orderBy(F.desc(F.col("p") + F.col("q")), "bucket").limit(PAIR_TERMS).toArrow().column("bucket").to_numpy()
    seen = np.union1d(alone, frequent)
    table = np.full(1 << BITS, -1, np.int32)
    table[seen] = np.arange(len(seen), dtype=np.int32)
    found = sample.mapInArrow(
        _kept_terms(docs.sparkSession.sparkContext.broadcast(table)), "y int, terms array<int>").toArrow()
    y = found.column("y").to_numpy().astype(float)
    lists = found.column("terms").combine_chunks()
    offsets, terms = (lists.offsets.to_numpy(), lists.flatten().to_numpy()) if len(y) else (np.zeros(1, int), np.zeros(0, int))

    def numbered(chosen: np.ndarray) -> np.ndarray:
        number = np.full(len(seen), -1, np.int32)
        number[np.searchsorted(seen, chosen)] = np.arange(len(chosen))
        return number

    pairs = telling_pairs(_blocks(offsets, terms, numbered(frequent)), y, len(frequent))
    buckets = np.union1d(alone, [frequent[i] for pair in pairs for i in pair]).astype(np.int64)
    own = [(k + row.astype(np.int64), term.astype(np.int64)) for k, row, term in _blocks(offsets, terms, numbered(buckets))]
    rows, kept = (np.concatenate(side) for side in zip(*own)) if own else (np.zeros(0, int), np.zeros(0, int))
    machine = Machine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), FACTORS)))
    machine.bias, machine.weights, machine.factors = fit(rows, kept, y, len(buckets))
    return machine


def _score(schema: pa.Schema, text: int, model):
    def run(batches):
        bias_table, machine = model.value
        for batch in batches:
            for piece in pieces(batch, text):
                found = words(piece.column(text), NOT_ALPHANUMERIC)
                if machine is None:
                    score = np.zeros(piece.num_rows)
                else:
                    score = machine.score(*term_buckets(found, bias_table), piece.num_rows)
                kept = [piece.column(i) for i in range(len(schema) - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], schema.names)

    return run


def scored(docs: DataFrame, machine: Machine | None, columns: list[str], *, text: str = "text") -> DataFrame:
    """``columns`` of ``docs``, ``text`` not among them, and ``score``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = None if machine is None else machine.table()
    model = spark.sparkContext.broadcast((table, machine))
    given = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    schema = pa.schema([(c, pa.null()) for c in columns] + [("score", pa.float64())])
    return given.mapInArrow(_score(schema, len(columns), model), f"{kinds}, score double")


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", threshold: float = 0.3, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` and the columns ``keep`` for every
    row of ``docs``."""
    bounded_batches(docs.sparkSession)
    known = labels.where(~F.coalesce(held_out(F.col(f"`{doc_id}`")), F.lit(False)))
    machine = learn(docs, known, doc_id=doc_id, text=text, label=label)
    found = scored(docs, machine, [doc_id, *keep], text=text)
    key = F.col(f"`{doc_id}`")
    return found.select(
        key.alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"`{c}`") for c in keep])
