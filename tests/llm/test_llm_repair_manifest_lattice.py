"""Vector near duplicates, conversation repair and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docwarden.llm import conversations as conv
from docwarden.llm import lattice, manifest
from docwarden.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return str(tuple(row))


# Merkle manifest

def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i: i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        low = i // 16 * 16
        out.append(("".join(level[low:i]), "".join(level[i + 1: low + 16])))
        i //= 16
    return out


def manifest_by_hand(rows):
    def leaf(r, text):
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [tree([leaf(r, r["text"]) for r in by[s]]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            path = beside(trees[j], i) + beside(top, j)
            fold = leaf(r, text)
            for a, b in path:
                fold = sha(a + fold + b)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r, r["text"]), trees[j][-1][0], root, sha("".join(a + b for a, b in path)),
                        fold, fold == root))
    return sorted(out, key=key)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("band", [1, 2, 3])
def test_manifest_is_the_tree_by_hand(spark, band):
    rng = random.Random(band)
    rows = []
    for i, source in enumerate(["big"] * 700 + ["b"] * 17 + ["a"] * 16 + [None, None, "", "é", "Z", "one"] + [f"s{i}" for i in range(20)]):
        rows.append((rng.choice([i, i, i, 7, None]), source, rng.choice(["en", None]), rng.choice([3, None]),
                     rng.choice(["", None, "Ä Word", "lower", "X" * 5000])))
    rows += rows[:40]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = manifest.manifest(docs, tampered=manifest.every_fifth(), band=band).collect()
    assert sorted((tuple(r) for r in got), key=key) == manifest_by_hand([dict(zip(DOCS.replace(",", "").split()[::2], r)) for r in rows])


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_small_tables(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "idx", "id", "digest", "given", "row", "n", "block", "kind", "_at", "_part", "root"):
        docs = docs.withColumn(c, F.lit("x"))
    got = manifest.manifest(docs, tampered=manifest.every_fifth(), band=1).collect()
    assert sorted((tuple(r) for r in got), key=key) == manifest_by_hand([dict(zip(DOCS.replace(",", "").split()[::2], r)) for r in rows])


def test_manifest_without_tampering_is_verified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert manifest.manifest(docs).where("NOT verified").isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300))
def test_climb_and_descend_agree_with_the_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = manifest.height(n)
    children, top = manifest.climb(leaves, levels)
    assert top == tree(leaves)[-1]
    suffixes = manifest.descend(children, levels, n, [("l", "r")])
    assert suffixes == [beside(tree(leaves), i) + [("l", "r")] for i in range(n)]
    # messages are handled in the order of labels
    assert list(children) == sorted(children)


# conversation repair

def cheapest(turns, start=0, ends=conv.ACCEPTED, costs=conv.Costs()):
    """The least (cost, audit) by a table over all turns and states."""
    def put(table, state, value):
        table[state] = min(value, table.get(state, value))

    def inserted(table):
        for _ in range(3):
            for q, (cost, audit) in list(table.items()):
                for letter in "ua":
                    if letter in conv.STEP[q]:
                        put(table, conv.STEP[q][letter], (cost + costs.insert, audit + "I"))
        return table

    table = inserted({start: (0, "")})
    for initial, fault in turns:
        after = {}
        for q, (cost, audit) in table.items():
            put(after, q, (cost + costs.delete, audit + "D"))
            if fault not in (1, 2):
                extra = costs.truncated if fault == 3 else 0
                if initial in conv.STEP[q]:
                    put(after, conv.STEP[q][initial], (cost + extra, audit + "K"))
                for letter in "ua":
                    if letter in conv.STEP[q]:
                        put(after, conv.STEP[q][letter], (cost + extra + costs.rerole, audit + "R"))
        table = inserted(after)
    return min((table[q] for q in ends if q in table), default=None)


TURNS = st.lists(st.tuples(st.sampled_from("suaua?"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=300, deadline=None)
@given(TURNS, st.integers(0, 3), st.sampled_from([(0, 3), (0,), (1,), (2,), (3,)]),
       st.sampled_from([conv.Costs(), conv.Costs(3, 2, 1, 1), conv.Costs(2, 2, 2, 2), conv.Costs(1, 9, 4, 0)]))
def test_search_finds_the_cheapest_repair(turns, start, ends, costs):
    assert conv.search(turns, start, ends, costs) == cheapest(turns, start, ends, costs)


@settings(max_examples=150, deadline=None)
@given(TURNS, st.sampled_from([(0, 3), (1,), (2,), (3,)]))
def test_bounds_never_exceed_what_is_left(turns, ends):
    bound = conv.bounds(turns, ends, conv.Costs())
    for i in range(len(turns) + 1):
        for state in range(4):
            exact = cheapest(turns[i:], state, ends)
            assert exact is None or bound[i][state] <= exact[0]


def test_search_of_long_conversations():
    rng = random.Random(5)
    for letters in ("suaua?", "s", "us", "as", "u", "??s"):
        turns = [(rng.choice(letters), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(400)]
        assert conv.search(turns) == cheapest(turns)


def report_by_hand(rows):
    said = lambda v: " " if v is None else str(v)
    by = {}
    for c, t, r, x in rows:
        turns = by.setdefault(c, [])
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        r, x = said(r), said(x)
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            turns += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, sha(f"{len(v[1].encode())}:{v[1]}{v[2]}")))
        faults, seen = [], set()
        for _, r, x in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append(1 if not words else 2 if (r, x) in seen else 3 if words[-1] not in ".!?" else 0)
            seen.add((r, x))
        initials = [r[:1] if r[:1] in tuple("sua") else "?" for _, r, _ in turns]
        cost, audit = cheapest(list(zip(initials, faults)))
        left = sum(e != "D" for e in audit)
        letters = iter("s" * (left % 2) + "ua" * (left // 2))
        repaired, at = [], iter(turns)
        for e in audit:
            _, r, x = (None, None, "") if e == "I" else next(at)
            if e != "D":
                letter = next(letters)
                repaired.append(f"{r if e == 'K' else {'u': 'user', 'a': 'assistant'}[letter]}:{x}")
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(repaired))))
    return sorted(out, key=key)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [2, 5, 512])
def test_report_is_that_by_hand(spark, segment):
    rng = random.Random(segment)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randrange(1, 60 if c == 7 else 9)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "", None, "tool", "Äh"]),
                         rng.choice(["Yes.", "No", "What?\n", "\t \x0b", "", None, "Good ! ", "é.", "long text. " * 500])))
    table = spark.createDataFrame(rows, CONVERSATIONS)
    for c in ("tree", "idx", "n", "digest", "row", "kind", "segment", "place", "copy", "first"):
        table = table.withColumn(c, F.lit(1))
    got = conv.repair_report(conv.damaged(table), table.select("conv_id"), segment=segment).collect()
    assert sorted((tuple(r) for r in got), key=key) == report_by_hand(rows)


def test_repaired_turns_read_as_demanded(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    got = conv.repair(conv.damaged(rows), rows.select("conv_id")).where("place >= 0").groupBy("tree").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda x: F.substr(x.role, F.lit(1), F.lit(1))), "").alias("roles"))
    assert got.where("NOT roles RLIKE '^s?(ua)+$'").isEmpty() and not got.isEmpty()


def test_conversations_without_rows_and_empty_tables(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conv.repair_report(conv.damaged(empty), empty.select("conv_id")).isEmpty()
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Hi.")], CONVERSATIONS)
    assert [tuple(r) for r in conv.repair_report(conv.damaged(table), table.select("conv_id")).collect()] == [
        (lost, 0, 0, 0, 0, 0, 0, "", sha(""))]


# lattice hashing of vectors

def links_by_hand(rows, least=0.9):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        new = np.where(near, comp[None, :], comp[:, None]).min(1)
        if (new == comp).all():
            return {i: (int(n), int(c), bool(c == i)) for i, n, c in zip(ids, near.sum(1), comp)}
        comp = new


def turned(rng, x, cosine):
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * u


def unit(rng, n, dim=64):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(500, 8)) * 2
    points = lattice.nearest_points(y)
    doubled = np.rint(2 * points).astype(int)
    assert (np.isin(doubled % 2, [0, 1])).all() and (doubled % 2 == doubled[:, :1] % 2).all()
    assert (doubled.sum(1) % 4 == 0).all()
    vectors = lattice.shortest_vectors()
    assert len(np.unique(vectors, axis=0)) == 240 and np.allclose((vectors**2).sum(1), 2)
    # the cell of a lattice point is bounded by its shortest vectors
    here = ((y - points) ** 2).sum(1)
    around = ((y[:, None] - points[:, None] - vectors[None]) ** 2).sum(2)
    assert (here[:, None] <= around + 1e-9).all()


@pytest.mark.parametrize("block", [16, 2048])
def test_recall_at_the_threshold(spark, block):
    rng = np.random.default_rng(2)
    x = unit(rng, 1500)
    y = turned(rng, x, rng.uniform(0.9, 0.92, size=(len(x), 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
    expected = links_by_hand(rows)
    assert all(got[i].n_links <= n for i, (n, _, _) in expected.items())  # none below the threshold
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _, _ in expected.values())
    assert there >= 2990 and found >= 0.98 * there


@pytest.mark.parametrize("block", [32, 2048])
def test_clusters_and_copies_are_counted_exactly(spark, block):
    rng = np.random.default_rng(4)
    base = unit(rng, 12)
    near = turned(rng, np.repeat(base, 25, axis=0), 0.985)
    x = np.concatenate([base, near, near[:60], unit(rng, 300), near[60:90] * 1e160, near[:5] * 1e-160])
    order = rng.permutation(len(x))
    rows = [(int(i) + 10, v.tolist()) for i, v in zip(order, x)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), block=block).collect()
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == links_by_hand(scaled)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]),
            (8, [inf, 0.0]), (9, [1.0]), (None, [1.0, 0.0]), (None, None), (11, [1.0, 0.0]), (12, [0.0, -1.0]), (12, [3.0, 0.0]), (13, [nan, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "vec", "cell", "cells", "class", "weight", "links", "component", "label", "own", "part"):
        table = table.withColumn(c, F.lit(0))
    got = sorted((tuple(r) for r in lattice.near_vectors(table).collect()), key=key)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12, 13)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (12, 3, 1, False)]
    assert got == sorted([*alone, *linked, (None, 0, None, True), (None, 0, None, True)], key=key)
    assert lattice.near_vectors(table.limit(0)).isEmpty()


def test_registered_query_reads_the_table(spark, sf):
    got = QUERIES["op11_embedding_near_dedup"](spark, sf)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
