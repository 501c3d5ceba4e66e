"""Line deduplication by deletion neighbourhoods: equal and nearly equal lines, the earliest kept.

Lines are sequences of lower-cased words. Two lines are near if one word changed, added or missing
turns one into the other; both need ``least_words`` words, five by default, so that near lines agree
in four fifths at least, and shorter lines only match equal ones. Lines are taken by document id and
then line number. A line is kept unless an equal line or a near line that is kept itself stands
earlier; so every removed line has a line that stays and is equal to it or one word away.

* Equal lines are one class with the place of its first line.
* Every class emits its deletion neighbourhood: the line itself and, for each word, the line
  without that word, as 128-bit hashes with the place of the missing word. Equal variants are
  joined: two lines of one length that lack the word at one place differ in that word alone, and
  a whole line that equals a variant lacks just that word, which verifies the distance, up to a
  chance of at most 2 ** -128 for each two variants that two of them have one hash.
* Variants of classes that share one are few. On them classes are settled by place: a class with no
  earlier near class that is still open is kept, one with an earlier kept near class is removed, and
  so on until none is open. Per variant only minima meet, never pairs of lines. Once at most
  ``LAST_ROWS`` rows are open, one task takes them in order, so long chains need few rounds.

Classes that can have no near class emit nothing: an edit leaves the first or the second half of a
line as it is, so a line none of whose half keys another class has is alone. Filters over such keys
have a fixed size and only ever let too much through.

Defined cases: null and empty texts have no lines; lines without words are never removed; rows
with a null id count as later than all others; repeated rows are later copies only if their ids
differ (lines of one id and number are one line); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.idfilter import id_filter, passes
from docwarden.llm.storage import bounded_batches, stored
from docwarden.llm.tokens import mix, pieces, signed, words

#: Words a line needs to be near another one.
LEAST_WORDS = 5
#: Rows per task where a class has very many lines.
CLASS_ROWS = 1 << 14
#: Open rows that one task settles in order.
LAST_ROWS = 1 << 18
#: A place is a document id, a line number below ``LINES``, and some bits of the line's hash, which
#: tell the lines of repeated ids apart.
LINES, TIES = 1 << 31, 1 << 28
#: Classes with very many lines that are broadcast; a table with more of them is shuffled.
LARGE_CLASSES = 100_000
#: Odd factors of the two sequence hashes.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _inverse(q: np.uint64) -> np.uint64:
    return np.uint64(pow(int(q), -1, 1 << 64))


def _powers(q: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, q, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Lines:
    """The lines with words of a run of texts: row, number, length, and running hash sums."""

    def __init__(self, column: pa.Array):
        found = words(column)
        newlines = np.flatnonzero(found.data == 10)
        row = np.searchsorted(found.row_ptr, np.arange(len(found.hashes)), "right") - 1
        line = np.searchsorted(newlines, found.begin)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(self.first, append=len(line)) if len(line) else np.zeros(0, np.int64)
        self.row = row[self.first]
        starts = _row_starts(column)
        self.number = line[self.first] - np.searchsorted(newlines, starts[self.row])
        self.place = np.arange(len(line)) - np.repeat(self.first, self.n)
        top = int(self.n.max()) if len(self.n) else 0
        self.sums, self.powers, self.inverses = [], [], []
        for salt, q in enumerate(FACTORS):
            power = _powers(q, top)
            total = np.zeros(len(line) + 1, np.uint64)
            np.cumsum(mix(found.hashes + np.uint64(salt)) * power[self.place], out=total[1:])
            self.sums.append(total)
            self.powers.append(power)
            self.inverses.append(_powers(_inverse(q), top))

    def part(self, k: int, lines: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The k-th hash sum of words lo to hi of each line, as if it began there."""
        at = self.first[lines]
        return (self.sums[k][at + hi] - self.sums[k][at + lo]) * self.inverses[k][lo]

    def whole(self, k: int) -> np.ndarray:
        every = np.arange(len(self.n))
        return sealed(self.part(k, every, np.zeros_like(self.n), self.n), self.n)

    def half_keys(self) -> list[np.ndarray]:
        """Per line four keys: halves that a near line of up to ``n`` or ``n + 1`` words may share."""
        every, zero = np.arange(len(self.n)), np.zeros_like(self.n)
        keys = []
        for longer in (self.n, self.n + 1):
            p = longer // 2
            tail = np.minimum(longer - p, self.n)
            for side, value in ((1, self.part(0, every, zero, p)), (2, self.part(0, every, self.n - tail, self.n))):
                keys.append(mix(value + longer.astype(np.uint64) * np.uint64(0x2545F491) + np.uint64(side)))
        return keys

    def variants(self, use: np.ndarray):
        """(line, place of the missing word or -1, two hashes) of the neighbourhoods of ``use``."""
        n = self.n[use]
        line = np.repeat(use, n)
        i = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        zero, size = np.zeros_like(i), self.n[line]
        out = []
        for k in range(2):
            head = self.part(k, line, zero, i)
            tail = self.part(k, line, i + 1, size) * self.powers[k][i]
            out.append(np.concatenate([sealed(head + tail, size - 1), self.whole(k)[use]]))
        return np.concatenate([line, use]), np.concatenate([i, np.full(len(use), -1)]), *out


def _row_starts(column: pa.Array) -> np.ndarray:
    from docwarden.llm.tokens import bytes_of

    return bytes_of(column)[1][:-1]


def sealed(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(total + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


KEYS = ["k1", "k2", "k3", "k4"]
CLASS = ["h1", "h2", "n"]


def _line_rows(batches):
    """Every line with words: its place, its class and its half keys."""
    for batch in batches:
        for piece in pieces(batch, 1):
            found = Lines(piece.column(1))
            columns = [found.whole(0), found.whole(1), *found.half_keys()]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(found.row)), pa.array(found.number.astype(np.int32)),
                 pa.array(found.n.astype(np.int32)), *[pa.array(signed(c)) for c in columns]],
                ["id", "line", "n", "h1", "h2", *KEYS])


def _occurrence(h1: np.ndarray, ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A key of one line at one place."""
    return mix(mix(h1.view(np.uint64) + mix(ids.view(np.uint64))) + lines.astype(np.uint64))


def _first_occurrences(shared):
    """Keys of the first lines of classes that share a half key with another class."""

    def run(batches):
        for batch in batches:
            use = np.zeros(batch.num_rows, bool)
            for key in KEYS:
                use |= passes(shared.value, batch.column(key).to_numpy())
            h1, ids, lines = (batch.column(c).to_numpy()[use] for c in ("h1", "id", "line"))
            yield pa.RecordBatch.from_arrays([pa.array(signed(_occurrence(h1, ids, lines)))], ["key"])

    return run


def _variant_rows(chosen, least: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 1):
                found = Lines(piece.column(1))
                h1, h2 = found.whole(0), found.whole(1)
                ids = piece.column(0).to_numpy()[found.row]
                use = np.flatnonzero(found.n >= least)
                use = use[passes(chosen.value, signed(_occurrence(signed(h1[use]), ids[use], found.number[use])))]
                if not len(use):
                    continue
                line, i, v1, v2 = found.variants(use)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(v1)), pa.array(signed(v2)), pa.array(i.astype(np.int32)), pa.array(signed(h1[line])),
                     pa.array(signed(h2[line])), pa.array(found.n[line].astype(np.int32))],
                    ["v1", "v2", "i", *CLASS])

    return run


def _passing(filled, column: str):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(filled.value, batch.column(column).to_numpy())))

    return run


def _meetings(texts: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``k1, k2, side, other, place``: near classes meet in a key, those of one side with all of the
    other. Classes that differ in the word at one place are one side and its own other."""
    able = classes.where(F.col("n") >= least)
    keys = able.select(F.explode(F.array(*KEYS)).alias("key")).groupBy("key").count().where("count > 1")
    shared = id_filter(stored(keys.select("key")))
    able = able.withColumns({"id": _id(F.col("place")), "line": _line(F.col("place"))})
    firsts = able.select("h1", "id", "line", *KEYS).mapInArrow(_first_occurrences(shared), "key long")
    chosen = id_filter(stored(firsts))
    variants = stored(texts.mapInArrow(_variant_rows(chosen, least), "v1 long, v2 long, i int, h1 long, h2 long, n int"))
    # variants of two classes at least; what the filter lets through besides goes below
    several = variants.groupBy("v1", "v2").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi")
    common = id_filter(stored(several.select("v1")))
    few = stored(variants.mapInArrow(_passing(common, "v1"), variants.schema).distinct())
    same = few.where("i >= 0").groupBy("v1", "v2", "i").count().where("count > 1").drop("count")
    both = few.groupBy("v1", "v2").agg(F.bool_or(F.col("i") < 0).alias("s"), F.bool_or(F.col("i") >= 0).alias("l")).where(
        "s AND l").drop("s", "l")
    changed = few.join(same, ["v1", "v2", "i"]).select(
        F.xxhash64("v1", "i").alias("k1"), F.xxhash64("v2", "i").alias("k2"), F.lit(0).alias("side"),
        F.lit(0).alias("other"), *CLASS)
    side = F.when(F.col("i") < 0, 0).otherwise(1)
    added = few.join(both, ["v1", "v2"]).select(
        F.col("v1").alias("k1"), F.col("v2").alias("k2"), side.alias("side"), (1 - side).alias("other"), *CLASS)
    return changed.unionByName(added).distinct().join(classes.select(*CLASS, "place"), CLASS).select(
        "k1", "k2", "side", "other", "place")


def _in_order(batches):
    """Places of removed classes: open ones are settled by place, kept ones are settled already."""
    rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("place", "kept", "keys")))]
    taken: set = set()
    out = []
    for place, kept, keys in sorted(rows, key=lambda row: row[0]):
        if kept or not any((k["k1"], k["k2"], k["other"]) in taken for k in keys):
            taken.update((k["k1"], k["k2"], k["side"]) for k in keys)
        else:
            out.append(place)
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.decimal128(38, 0))], ["place"])


def _removed(meetings: DataFrame) -> DataFrame:
    """``place`` of classes that have an earlier near class which is kept."""
    removed = meetings.sparkSession.createDataFrame([], "place decimal(38,0)")
    rows = stored(meetings.withColumn("kept", F.lit(False)))
    while (n := rows.where("NOT kept").count()) > LAST_ROWS:
        # per key and side the earliest kept and the earliest open class
        least = rows.groupBy("k1", "k2", F.col("side").alias("other")).agg(
            F.min(F.when(F.col("kept"), F.col("place"))).alias("stays"),
            F.min(F.when(~F.col("kept"), F.col("place"))).alias("open"))
        earlier = lambda c: F.coalesce(F.col(c) < F.col("place"), F.lit(False))
        seen = stored(rows.where("NOT kept").join(least, ["k1", "k2", "other"], "left").groupBy("place").agg(
            F.bool_or(earlier("stays")).alias("goes"), F.bool_or(earlier("open")).alias("waits")))
        removed = stored(removed.unionByName(seen.where("goes").select("place")))
        now = rows.join(seen, "place", "left").where("goes IS NULL OR NOT goes").select(
            "k1", "k2", "side", "other", "place", (F.col("kept") | ~F.coalesce("waits", F.lit(True))).alias("kept"))
        # keys without an open class have done their part
        rows = stored(now.join(now.where("NOT kept").select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"))
    if not n:
        return removed
    # of the kept classes of one key and side the earliest speaks for all
    kept = rows.where("kept").groupBy("k1", "k2", "side").agg(F.min("place").alias("place")).select(
        "place", F.lit(True).alias("kept"), F.array(F.struct("k1", "k2", "side", F.col("side").alias("other"))).alias("keys"))
    still = rows.where("NOT kept").groupBy("place", "kept").agg(F.collect_list(F.struct("k1", "k2", "side", "other")).alias("keys"))
    last = still.unionByName(kept).coalesce(1).mapInArrow(_in_order, "place decimal(38,0)")
    return removed.unionByName(last)


def _kept_near(meetings: DataFrame, removed: DataFrame) -> DataFrame:
    """``place, near`` of every removed class: the earliest kept class that is near."""
    stays = meetings.join(removed, "place", "left_anti").groupBy("k1", "k2", F.col("side").alias("other")).agg(
        F.min("place").alias("near"))
    return meetings.join(removed, "place", "left_semi").join(stays, ["k1", "k2", "other"]).groupBy("place").agg(
        F.min("near").alias("near"))


def _place() -> Column:
    """A line's place as one number, so that minima need no sort."""
    number = F.col("id").cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)") + F.col("line")
    return (number.cast("decimal(29,0)") * F.lit(TIES).cast("decimal(9,0)") + F.pmod("h1", F.lit(TIES))).cast("decimal(38,0)")


def _over(number: Column, divisor: int) -> Column:
    """Whole part of a division of whole decimals, rounded down."""
    return ((number - F.pmod(number, F.lit(divisor))) / F.lit(divisor)).cast("decimal(38,0)")


def _line(place: Column) -> Column:
    return F.pmod(_over(place, TIES), F.lit(LINES)).cast("int")


def _id(place: Column) -> Column:
    return _over(_over(place, TIES), LINES).cast("long")


def duplicate_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """``doc_id, line, kept_doc_id, kept_line, near``: one row per removed line (numbers from 0)
    and the kept line it repeats, the earliest; ``near`` says whether that one differs by a word."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1)).alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"))
    longs = ", ".join(f"{c} long" for c in ("h1", "h2", *KEYS))
    lines = stored(texts.mapInArrow(_line_rows, f"id long, line int, n int, {longs}"))
    classes = stored(lines.groupBy(*CLASS).agg(
        F.min(_place()).alias("place"), F.count("*").alias("rows"), *[F.min(k).alias(k) for k in KEYS]))
    meetings = stored(_meetings(texts, classes, max(least_words, 2)))
    near = stored(_kept_near(meetings, stored(_removed(meetings))))
    judged = classes.join(near, "place", "left").where("rows > 1 OR near IS NOT NULL")
    # classes with very many lines are dealt to several tasks
    parts = F.ceil(F.col("rows") / CLASS_ROWS).cast("int")
    judged = judged.select(*CLASS, F.col("place").alias("first"), "near", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    large = stored(classes.where(F.col("rows") > CLASS_ROWS).select(*CLASS, parts.alias("parts")))
    large = F.broadcast(large) if large.count() < LARGE_CLASSES else large
    dealt = lines.select("id", "line", *CLASS).join(large, CLASS, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("id", "line"), F.col("parts")), F.lit(0)).cast("int"))
    gone = dealt.join(judged, [*CLASS, "part"]).where(F.col("near").isNotNull() | (_place() != F.col("first")))
    kept = F.coalesce("near", "first")
    null = lambda c: F.when(c != 2**63 - 1, c)
    return gone.select(
        null(F.col("id")).alias("doc_id"), "line", null(_id(kept)).alias("kept_doc_id"), _line(kept).alias("kept_line"),
        F.col("near").isNotNull().alias("near")).distinct()


def n_lines(text: Column) -> Column:
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.octet_length(text) > 0, breaks + 1).otherwise(0)


def dedup_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: removed line numbers of every row of ``docs``."""
    found = duplicate_lines(docs, doc_id=doc_id, text=text).groupBy(F.col("doc_id").alias("id")).agg(
        F.sort_array(F.collect_list("line")).alias("removed"))
    key = F.col(f"`{doc_id}`").cast("long")
    counted = docs.select(key.alias("doc_id"), n_lines(F.col(f"`{text}`").cast("string")).cast("int").alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))
