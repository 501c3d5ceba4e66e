"""A Merkle manifest of documents by time-forward processing.

Every row is a leaf. The leaves of a source, by id, are the lowest nodes of its tree: sixteen
consecutive nodes make one node above. The roots of the sources, by source, are the lowest nodes
of one more tree, whose root stands for the whole table.

A node's label is its place in time: level by level, left to right. Nodes are handled in the
order of their labels, and what a node has to tell a later one is a message in a priority queue:

* Forward, a node sends its digest to its parent's label. The queue is external: a sorted
  exchange by label delivers messages to blocks of ``16 ** band`` nodes of one tree, and a heap
  inside the task, never larger than one block, to the nodes of the ``band`` levels of that block.
* Backward, in the reversed order of labels, a node sends its children the digests beside their
  path to the root (the proof's suffix); the same exchange delivers one message to each block.

So a source with a third of all rows is many blocks, each level band moves a 4096th of the rows
of the one below, and no task holds more than a block. Leaves are hashed in the JVM, where the
texts stay; only digests are shuffled.

Defined cases: null values are hashed as ``-`` and so differ from empty ones; rows with a null
source are a tree of their own, before all others; null ids come first in a tree, and equal rows
are leaves of their own, next to each other (rows of one id are ordered by their digest); a source
of one row has that leaf as its root; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.ranks import ranked, runs
from docwarden.llm.storage import stored

FANOUT = 16
#: Levels that one block climbs.
BAND = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SUFFIX = "array<struct<l:string,r:string>>"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: list[Column]) -> Column:
    """Hex sha-256 of values, each ``-`` if null, else its UTF-8 bytes, a colon and itself."""
    def field(value: Column) -> Column:
        return F.when(value.isNull(), "-").otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, values)), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def climb(lowest: list[str], levels: int) -> tuple[dict[tuple[int, int], list[str]], list[str]]:
    """The children's digests of every node above ``lowest``, in the order of labels, and the
    digests that no node of the block waits for: time-forward processing of one block."""
    if not levels:
        return {}, lowest
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in enumerate(lowest)]
    heapify(queue)
    children, out = {}, []
    while queue:
        level, node, _, first = heappop(queue)
        run = [first]
        while queue and queue[0][:2] == (level, node):
            run.append(heappop(queue)[3])
        children[level, node] = run
        made = digest("".join(run))
        if level < levels:
            heappush(queue, (level + 1, node // FANOUT, node % FANOUT, made))
        else:
            out.append(made)
    return children, out


def descend(children, levels: int, n_lowest: int, suffix: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The suffix of every lowest node: what stands left and right of its path, level by level."""
    inbox = {(levels, 0): suffix}
    for (level, node), run in reversed(children.items()):
        above = inbox.pop((level, node))
        for i in range(len(run)):
            inbox[level - 1, node * FANOUT + i] = [("".join(run[:i]), "".join(run[i + 1:])), *above]
    return [inbox[0, i] for i in range(n_lowest)]


def _up(band: int):
    """Blocks of nodes in, the nodes ``band`` levels higher out."""

    def run(batches):
        for block in runs(batches, "tree", "block"):
            n = block.column("n")[0].as_py()
            _, top = climb([d.hex() for d in block.column("digest").to_pylist()], min(band, height(n)))
            yield pa.RecordBatch.from_pydict({
                "tree": block.column("tree")[:1].to_pylist(), "idx": block.column("block")[:1].to_pylist(),
                "n": [-(-n // FANOUT**band)], "digest": [bytes.fromhex(top[0])]},
                pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    return run


def _delivered(run: pa.Table, band: int):
    """The message of a block and its nodes' suffixes."""
    message, nodes = run.slice(0, 1).to_pylist()[0], run.slice(1)
    levels = min(band, height(nodes.column("n")[0].as_py()))
    lowest = [d.hex() for d in nodes.column("digest").to_pylist()]
    children, _ = climb(lowest, levels)
    suffix = [(s["l"], s["r"]) for s in message["suffix"]]
    return message, nodes, lowest, descend(children, levels, len(lowest), suffix)


def _down(band: int, name: str | None = None):
    """Messages for the nodes of a block: blocks of the band below or, with ``name``, whole trees."""

    def run(batches):
        for block in runs(batches, "tree", "block"):
            message, nodes, lowest, suffixes = _delivered(block, band)
            made = [[{"l": left, "r": right} for left, right in s] for s in suffixes]
            yield pa.RecordBatch.from_arrays([
                nodes.column(name or "tree").combine_chunks(),
                pa.array([0] * len(lowest), pa.int64()) if name else nodes.column("idx").combine_chunks(),
                pa.array(made, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))),
                pa.array(lowest if name else [message["subroot"]] * len(lowest), pa.string()),
            ], ["tree", "block", "suffix", "subroot"])

    return run


def _proofs(band: int):
    """What every leaf of a block gets: subroot, proof and the root it leads to."""

    def run(batches):
        for block in runs(batches, "tree", "block"):
            message, nodes, lowest, suffixes = _delivered(block, band)
            proof, folded = [], []
            for given, suffix in zip(nodes.column("given").to_pylist(), suffixes):
                proof.append(digest("".join(left + right for left, right in suffix)))
                value = given.hex()
                for left, right in suffix:
                    value = digest(left + value + right)
                folded.append(value)
            yield pa.RecordBatch.from_arrays(
                [nodes.column("id").combine_chunks(), pa.array(lowest), pa.array([message["subroot"]] * len(lowest)),
                 pa.array(proof), pa.array(folded)], ["id", "leaf", "subroot", "proof", "folded"])

    return run


def _blocks(rows: DataFrame, *order: str) -> DataFrame:
    """Deliver rows to their blocks, sorted by label."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _in_blocks(nodes: DataFrame, band: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", 4 * band))


def _forward(nodes: DataFrame, band: int) -> list[DataFrame]:
    """The nodes of every band, from the lowest; trees end in the band where they have one node."""
    bands, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        wait = _in_blocks(bands[-1].where("n > 1").select("tree", "idx", "n", "digest"), band)
        bands.append(stored(_blocks(wait, "idx").mapInArrow(_up(band), "tree string, idx long, n long, digest binary")))
        most = -(-most // FANOUT**band)
    return bands


def _roots(bands: list[DataFrame]) -> DataFrame:
    found = [b.where("n = 1").select("tree", "digest") for b in bands]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _backward(bands: list[DataFrame], tops: DataFrame, band: int) -> DataFrame:
    """The lowest band's nodes and one message to each of their blocks, delivered in order.

    ``tops`` holds ``tree, suffix, subroot`` of every tree."""
    inbox = None
    for k in reversed(range(len(bands))):
        # trees that end in this band begin their way down here
        ended = bands[k].where("n = 1").select("tree").join(tops, "tree").select(
            "tree", F.lit(0).cast("long").alias("block"), "suffix", "subroot")
        inbox = ended if inbox is None else inbox.unionByName(ended)
        nodes = _in_blocks(bands[k], band).withColumn("kind", F.lit(1))
        mixed = nodes.unionByName(inbox.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        delivered = _blocks(mixed, "kind", "idx")
        if k:
            inbox = stored(delivered.mapInArrow(
                _down(band), f"tree string, block long, suffix {SUFFIX}, subroot string"))
    return delivered


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, band: int = BAND
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``fields`` names id, source and the other values of a leaf, the text last. Where ``tampered``
    holds, the root is folded from a leaf whose text has A-Z lower-cased.
    """
    id_, source, *_, text = (F.col(f"`{c}`") for c in fields)
    values = [F.col(f"`{c}`").cast("string") for c in fields]
    plain = leaf_digest(values)
    changed = leaf_digest([*values[:-1], F.translate(text.cast("string"), A_Z, a_z)])
    given = plain if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(plain)
    # the empty name of the null source comes before all others
    leaves = stored(docs.select(
        F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("")).alias("tree"), id_.alias("id"),
        F.unhex(plain).alias("digest"), F.unhex(given).alias("given"), F.monotonically_increasing_id().alias("row")))
    bands = _forward(stored(ranked(leaves, "tree", ["id", "digest", "row"]).drop("row")), band)
    subroots = _roots(bands).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = _forward(stored(ranked(subroots, "tree", ["name"])), band)
    root = _roots(sources).first()
    start = docs.sparkSession.sql(f"SELECT '' tree, CAST(array() AS {SUFFIX}) suffix, CAST(NULL AS STRING) subroot")
    tops = stored(_backward(sources, start, band).mapInArrow(
        _down(band, "name"), f"tree string, block long, suffix {SUFFIX}, subroot string").drop("block"))
    kind = leaves.schema["id"].dataType.simpleString()
    proved = _backward(bands, tops, band).mapInArrow(
        _proofs(band), f"id {kind}, leaf string, subroot string, proof string, folded string")
    root = F.lit(root.digest.hex() if root else None).cast("string")
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def every_fifth(doc_id: str = "doc_id") -> Column:
    """Whether 5 divides the unsigned crc-32 of the decimal id."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0
