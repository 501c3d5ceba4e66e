"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Every text is the set of its distinct word n-grams. N-grams are put in one global order: those
seen in few texts first, by hash, then frequent ones by how often they were seen. Two sets that
reach the threshold share an n-gram in the first few places of both (prefix and position
filters), which gives the candidate pairs. A candidate's sets are then cut into fragments of
hash ranges; partial overlaps are counted fragment by fragment and summed per pair.

Kept linear in group sizes:

* Equal sets are one class, so copies cost one row each.
* Texts that share a frequent n-gram at a candidate place are compared with one leader, the text
  with the fewest rarer n-grams. Only those without a link to their leader are compared with
  the other members, so no link between components is lost and a group of near copies makes
  about one pair per member. Groups of up to ``PAIRED`` members are paired directly.

Frequencies only shape the order; any order gives the same links.

Defined cases: null and empty texts have an empty set and link with nothing, one another
included; fewer words than the n-gram size make one n-gram of them all; rows with a null id keep
a null component; repeated rows belong to one class; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.components import smallest_reachable
from docwarden.llm.idfilter import id_filter, passes
from docwarden.llm.storage import bounded_batches, stored
from docwarden.llm.tokens import mix, pieces, shingle_sets, words

#: Texts an n-gram must be seen in to stand among the frequent ones.
FREQUENT = 16
#: Most frequent n-grams whose order is sent to the executors (at most 16 bytes each).
MAX_FREQUENT = 1 << 20
#: Rounds of counting; the last takes all n-grams of the texts that still need it.
COUNTS = 4
#: Members up to which a group is paired directly.
PAIRED = 16
#: N-grams of one fragment of a set, about.
FRAGMENT = 1024


def _prefix(n: np.ndarray | int, percent: int):
    """Places of a set's order in which a partner of any size shares an n-gram."""
    return n - (percent * n + 99) // 100 + 1


def _sets(batches, size: int, keep=None):
    """(id, sorted distinct n-gram hashes) of each text; ``keep`` chooses rows by id."""
    for batch in batches:
        if keep is not None:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(keep(ids) & ~np.asarray(batch.column(0).is_null())))
        for piece in pieces(batch, 1):
            found = words(piece.column(1))
            yield from zip(piece.column(0).to_pylist(), shingle_sets(found, size), strict=True)


def _flushed(rows, schema: pa.Schema, at: int = 20_000):
    """Row tuples as record batches."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _profiles(size: int, percent: int):
    """Set size, two fingerprints of the set, and its lowest n-grams for counting."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()),
                        ("f2", pa.int64()), ("low", pa.binary())])

    def rows(batches):
        for i, s in _sets(batches, size):
            n = len(s)
            f1 = int(mix(s).sum(dtype=np.uint64).view(np.int64)) if n else 0
            f2 = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if n else 0
            yield i, n, f1, f2, s[: _counted(n, percent)].tobytes()

    return lambda batches: _flushed(rows(batches), schema, 250)


def _counted(n: int, percent: int, again: int = 0) -> int:
    """How many of a set's lowest n-grams are counted: first the prefix and half as much, then
    twice as many each time, all in the last round."""
    if not n or again >= COUNTS - 1:
        return n
    return min(n, (_prefix(n, percent) * 3 // 2) << again)


def _counts(arrays):
    """Counted n-grams as (gram, how often) batches, summed over some hundred thousand."""
    held, size = [], 0
    for s in arrays:
        held.append(s)
        size += len(s)
        if size > 250_000:
            yield _count_batch(held)
            held, size = [], 0
    if size:
        yield _count_batch(held)


def _count_batch(held):
    gram, c = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(gram.view(np.int64)), pa.array(c.astype(np.int64))], ["gram", "c"])


def _count_low(batches):
    yield from _counts(
        np.frombuffer(x, np.uint64) for b in batches for x in b.column(0).to_pylist() if x)


def _count_more(size: int, percent: int, again: int, frequent):
    """Count further n-grams of texts whose n-grams counted so far are mostly frequent ones."""

    def more(batches):
        hot = np.sort(frequent.value[0])
        for _, s in _sets(batches, size):
            k = _counted(len(s), percent, again - 1)
            if k < len(s) and k - int(_member(hot, s[:k]).sum()) < _prefix(len(s), percent):
                yield s[k : _counted(len(s), percent, again)]

    return lambda batches: _counts(more(batches))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _postings(size: int, percent: int, frequent):
    """(gram, id, n, place) for the first places of each set in the global order."""
    names = ["gram", "id", "n", "place"]

    def run(batches):
        grams, count = frequent.value
        order = np.argsort(grams, kind="stable")
        grams, count = grams[order], count[order]
        held, rows = [], 0
        for i, s in _sets(batches, size):
            n = len(s)
            if not n or i is None:
                continue
            hot = _member(grams, s)
            p = _prefix(n, percent)
            cold = s[~hot]
            if len(cold) < p:
                h = s[hot]
                h = h[np.lexsort((h, count[np.searchsorted(grams, h)]))]
                cold = np.concatenate([cold, h])
            cold = cold[:p]
            held.append((cold, i, n))
            rows += p
            if rows > 50_000:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    def flush(held):
        size_of = [len(x[0]) for x in held]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([x[0] for x in held]).view(np.int64)),
            pa.array(np.repeat(np.array([x[1] for x in held], np.int64), size_of)),
            pa.array(np.repeat(np.array([x[2] for x in held], np.int32), size_of)),
            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size_of])),
        ], names)

    return run


def _parts(n) -> int:
    return 1 << max(0, int(-(-int(n) // FRAGMENT) - 1).bit_length())


def _fragments(size: int, percent: int, wanted):
    """(id, parts, part, grams): each wanted set cut at equal hash ranges."""
    schema = pa.schema([("id", pa.int64()), ("parts", pa.int32()), ("part", pa.int32()),
                        ("grams", pa.list_(pa.int64()))])

    def rows(batches):
        filled = wanted.value
        for i, s in _sets(batches, size, lambda ids: passes(filled, ids)):
            if not len(s):
                continue
            # a partner may be larger and cut more finely
            for parts in range_of_parts(len(s), percent):
                bounds = (np.arange(1, parts).astype(np.float64) * (2.0**64 / parts)).astype(np.uint64)
                for part, cut in enumerate(np.split(s, np.searchsorted(s, bounds))):
                    yield i, parts, part, cut.view(np.int64)

    return lambda batches: _flushed(rows(batches), schema, 250)


def range_of_parts(n: int, percent: int) -> list[int]:
    first, last = _parts(n), _parts(100 * n // percent + 1)
    return [first << k for k in range((last // first).bit_length())]


def _may_link(percent: int, a: str, b: str) -> Column:
    """Length and position filters on two postings of one n-gram."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    reach = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
    return (reach * (100 + percent) >= percent * (na + nb)) & (
        100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _pair(a: str, b: str) -> list[Column]:
    first = F.col(f"{a}.id") < F.col(f"{b}.id")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    return [pick(f"{a}.id", f"{b}.id").alias("a"), pick(f"{b}.id", f"{a}.id").alias("b"),
            pick(f"{a}.n", f"{b}.n").alias("na"), pick(f"{b}.n", f"{a}.n").alias("nb")]


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed partial overlaps reach the threshold."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    fragments = texts.mapInArrow(
        _fragments(size, percent, id_filter(ids)), "id long, parts int, part int, grams array<long>")
    larger = F.ceil(F.greatest("na", "nb") / F.lit(FRAGMENT))
    parts = F.pow(F.lit(2), F.ceil(F.log2(larger))).cast("int")
    cut = pairs.withColumn("parts", parts).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = fragments.select(F.col("id").alias("a"), "parts", "part", F.col("grams").alias("ga"))
    right = fragments.select(F.col("id").alias("b"), "parts", "part", F.col("grams").alias("gb"))
    # both joins read one exchange of the fragments; an id that occurs again repeats its counts
    partial = cut.join(left, ["a", "parts", "part"]).join(right, ["b", "parts", "part"]).select(
        "a", "b", "na", "nb", "part", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o")
    ).groupBy("a", "b", "na", "nb", "part").agg(F.max("o").alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(
        100 * F.col("o") >= percent * (F.col("na").cast("long") + F.col("nb") - F.col("o"))
    ).select("a", "b")


def _frequent(spark, counts: list[DataFrame]):
    """Broadcast (grams, counts) of the most frequent n-grams, at most MAX_FREQUENT of them."""
    found = None
    for c in counts:
        found = c if found is None else found.unionByName(c)
    found = found.groupBy("gram").agg(F.max("c").alias("c"))
    sizes = found.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect()
    least, room = FREQUENT, MAX_FREQUENT
    for k, n in sorted(((r.k, r["count"]) for r in sizes), reverse=True):
        room -= n
        if room < 0:
            least = 2 ** (k + 1)
            break
    table = found.where(F.col("c") >= least).toArrow()
    grams = table.column("gram").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast((grams, table.column("c").to_numpy()))


def jaccard_classes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two texts link when the Jaccard similarity of their ``size``-word n-gram sets is at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    profile = stored(texts.mapInArrow(
        _profiles(size, percent), "id long, n long, f1 long, f2 long, low binary"))
    classes = stored(
        profile.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")))

    def count(found: DataFrame) -> DataFrame:
        return found.groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)

    first = stored(count(profile.select("low").mapInArrow(_count_low, "gram long, c long")))
    frequent = _frequent(spark, [first])
    counted = [first]
    for again in range(1, COUNTS):
        more = stored(count(
            texts.mapInArrow(_count_more(size, percent, again, frequent), "gram long, c long")))
        if more.isEmpty():
            break
        counted.append(more)
        frequent = _frequent(spark, counted)

    postings = stored(texts.mapInArrow(
        _postings(size, percent, frequent), "gram long, id long, n int, place int"))
    shared = (
        postings.groupBy("gram").agg(F.min("id").alias("x"), F.max("id").alias("y"))
        .where("x < y").select("gram"))
    reps = classes.select(F.col("rep").alias("id"))
    members = stored(
        postings.join(shared, "gram", "left_semi").join(reps, "id", "left_semi").distinct())
    groups = stored(
        members.groupBy("gram").agg(
            F.count("*").alias("members"), F.min(F.struct("place", "id", "n")).alias("leader"))
        .where("members > 1"))

    small = members.join(groups.where(F.col("members") <= PAIRED).select("gram"), "gram", "left_semi")
    x, y = small.alias("x"), small.alias("y")
    direct = x.join(
        y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id"))
        & _may_link(percent, "x", "y")).select(*_pair("x", "y"))
    large = stored(members.join(
        groups.where(F.col("members") > PAIRED).select("gram", "leader"), "gram"))
    led = large.select(F.struct("id", "n", "place").alias("m"), F.col("leader").alias("l"))
    stars = led.where(F.col("m.id") != F.col("l.id")).where(_may_link(percent, "m", "l")).select(
        *_pair("m", "l"))
    pairs = stored(direct.unionByName(stars).distinct())
    links = stored(_linked(pairs, texts, size, percent))

    rest = _unled_pairs(large, links, percent)
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(stored(_linked(rest, texts, size, percent)))

    components = smallest_reachable(links).select(
        F.col("id").alias("rep"), F.col("component").alias("low_id"))
    named = classes.join(components, "rep", "left").select(
        "n", "f1", "f2", F.coalesce("low_id", "rep").alias("component_id"))
    return profile.drop("low").join(named, ["n", "f1", "f2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _unled_pairs(large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs of members without a link to their leader with the others of their group."""
    a, b = F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")
    unled = large.where(F.col("id") != F.col("leader.id")).select("gram", "id", "n", "place", a, b)
    unled = unled.join(links, ["a", "b"], "left_anti").select("gram", "id", "n", "place")
    u, m = unled.alias("u"), large.select("gram", "id", "n", "place").alias("m")
    return u.join(
        m, (F.col("u.gram") == F.col("m.gram")) & (F.col("u.id") != F.col("m.id"))
        & _may_link(percent, "u", "m")).select(*_pair("u", "m")).distinct()
