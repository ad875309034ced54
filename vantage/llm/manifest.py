"""A Merkle manifest of a dataset whose inner nodes retain the hash states from which they can be resumed.

The rows of a source are leaves in the order of their ids, three consecutive nodes have a parent, and so on up to one node a
source; the sources' nodes form one more tree. Every parent keeps a copied SHA-256 state from before each of its child slots.
A changed leaf is folded by resuming, at each parent, the state of its slot with the new digest and the siblings to its
right; what lies to its left is in the state already.

Trees are built in blocks of ``BLOCK`` consecutive nodes, seven levels at once: a block is one task's work, its top node is a
node of the next stage, and a stage has a 2187th of the nodes of the one before. A block learns the path from its top to the
root as the siblings on that way, and rebuilds the states there once for all its leaves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.llm.storage import documents, materialise
from vantage.llm.words import slices

FANOUT, DEPTH = 3, 7
BLOCK = FANOUT**DEPTH
#: What a leaf hashes, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A step of a path: the hexadecimal digests of the siblings to the left and to the right.
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PATH = "array<struct<left: string, right: string>>"


def encode(values: list[str | None]) -> bytes:
    """``-`` for a null, else the number of UTF-8 bytes, a colon and the value; one after the other."""
    out = []
    for value in values:
        raw = b"" if value is None else value.encode()
        out.append(b"-" if value is None else b"%d:%b" % (len(raw), raw))
    return b"".join(out)


def leaf(values: list[str | None]) -> str:
    return hashlib.sha256(encode(values)).hexdigest()


def leaves(table: DataFrame) -> DataFrame:
    """``(tree, doc_id, leaf, tampered)``: ``tree`` orders sources (null first), ``tampered`` is the leaf of the changed row.

    Where 2 divides the checksum of the id the change deletes the line feeds of the text; elsewhere, for a null id and for a
    null text the two leaves are equal.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own, other = [], []
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                own.append(leaf(row))
                changed = row[0] is not None and row[4] is not None and zlib.crc32(row[0].encode()) % 2 == 0 and "\n" in row[4]
                other.append(leaf([*row[:4], row[4].replace("\n", "")]) if changed else own[-1])
            yield pa.record_batch([part.column(0), part.column(1), pa.array(own), pa.array(other)], ["id", "source", "leaf", "tampered"])

    hashes = table.select(*(F.col(c).cast("string").alias(c) for c in FIELDS)).mapInArrow(hashed, "id string, source string, leaf string, tampered string")
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    return hashes.select(tree.alias("tree"), F.col("id").cast("long").alias("doc_id"), "leaf", "tampered")


def numbered(table: DataFrame, order: list[str]) -> DataFrame:
    """``table`` with ``at``, the place of each row in its ``tree`` by ``order``, from 0, and ``n``, the rows of the tree.

    Rows are dealt by ranges of tree and order, so a tree with a third of all rows lies in many tasks; places are counted in
    each range, and one row for each range and tree tells where it begins.
    """
    ranged = table.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialise(ranged.withColumn("range", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    parts = dealt.groupBy("tree", "range").agg(F.count("*").alias("c"), F.min("line").alias("first"))
    before = F.sum("c").over(Window.partitionBy("tree").orderBy("range")) - F.col("c")
    starts = parts.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return dealt.join(starts, ["tree", "range"]).withColumn("at", F.col("line") + F.col("shift")).drop("range", "line", "shift")


class Block:
    """The tree over at most ``BLOCK`` consecutive nodes of a stage with ``n`` nodes; ``levels[0]`` has their digests."""

    def __init__(self, digests: list[str], n: int):
        self.levels: list[list[str]] = [digests]
        #: For each level above the first: the states of each parent before its child slots.
        self.states: list[list[list]] = []
        for _ in range(DEPTH):
            if n == 1:
                break
            below = self.levels[-1]
            nodes, kept = [], []
            for i in range(0, len(below), FANOUT):
                state, own = hashlib.sha256(), []
                for child in below[i : i + FANOUT]:
                    own.append(state.copy())
                    state.update(child.encode())
                nodes.append(state.hexdigest())
                kept.append(own)
            self.levels.append(nodes)
            self.states.append(kept)
            n = -(-n // FANOUT)

    def top(self) -> str:
        return self.levels[-1][0]

    def steps(self, i: int) -> list[dict[str, str]]:
        """The siblings on the way from node ``i`` to the top."""
        out = []
        for level in self.levels[:-1]:
            j = i - i % FANOUT
            out.append({"left": "".join(level[j:i]), "right": "".join(level[i + 1 : j + FANOUT])})
            i //= FANOUT
        return out

    def fold(self, i: int, digest: str) -> str:
        """The top with ``digest`` in the place of node ``i``: retained states, resumed with what lies to the right."""
        for level, states in zip(self.levels[:-1], self.states, strict=True):
            state = states[i // FANOUT][i % FANOUT].copy()
            state.update(digest.encode())
            for sibling in level[i + 1 : i - i % FANOUT + FANOUT]:
                state.update(sibling.encode())
            digest, i = state.hexdigest(), i // FANOUT
        return digest


class Way:
    """The path above a block: the states before its slots are rebuilt once, from the siblings to the left."""

    def __init__(self, path: list[dict[str, str]]):
        self.steps = [(hashlib.sha256(s["left"].encode()), s["right"].encode()) for s in path]
        self.siblings = "".join(s["left"] + s["right"] for s in path)

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest.encode())
            state.update(right)
            digest = state.hexdigest()
        return digest


def _block(group: pa.Table) -> tuple[pa.Table, Block]:
    group = group.sort_by("at")
    return group, Block(group.column("digest").to_pylist(), group.column("n")[0].as_py())


def stages(nodes: DataFrame) -> list[DataFrame]:
    """Nodes ``(tree, at, n, digest)`` of every stage, the given ones first, one a tree last."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group, block = _block(group)
        n = -(-group.column("n")[0].as_py() // BLOCK)
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([block.top()])], ["tree", "at", "n", "digest"])

    out = [nodes]
    while out[-1].where("n > 1").head(1):
        blocks = out[-1].select("tree", "at", "n", "digest").withColumn("block", F.floor(F.col("at") / BLOCK))
        out.append(materialise(blocks.groupBy("tree", "block").applyInArrow(build, "tree string, at long, n long, digest string")))
    return out


def descend(held: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(tree, at, path)`` of the nodes of the first of the stages ``held``, from the paths of those of the last."""

    def spread(key: tuple, group: pa.Table, top: pa.Table) -> pa.Table:
        group, block = _block(group)
        path = top.column("path")[0].as_py()
        ways = [block.steps(i) + path for i in range(group.num_rows)]
        return pa.table([group.column("tree"), group.column("at"), pa.array(ways, pa.list_(STEP))], ["tree", "at", "path"])

    for nodes in reversed(held[:-1]):
        blocks = nodes.select("tree", "at", "n", "digest").withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
        above = materialise(blocks.cogroup(above.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInArrow(spread, f"tree string, at long, path {PATH}"))
    return above


def manifest(table: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row a row of ``table`` (columns ``FIELDS``).

    Null ids come first in their source, rows of one id stand in the order of their leaves, null sources are a tree of their
    own before all others; an empty table has no rows. Null values and empty ones have different leaves.
    """
    rows = numbered(materialise(leaves(table)), ["doc_id", "leaf"])
    rows = materialise(rows.withColumnRenamed("leaf", "digest"))
    own = stages(rows)
    tops = materialise(numbered(own[-1].select(F.col("tree").alias("source"), F.lit("").alias("tree"), "digest"), ["source"]))
    over = stages(tops)
    root = over[-1].select(F.col("digest").alias("root"))
    nothing = F.array().cast(PATH)
    ways = descend(over, over[-1].select("tree", "at", nothing.alias("path")))
    subroots = tops.select("source", "at", F.col("digest").alias("subroot")).join(ways.select("at", "path"), "at").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "path")
    above = descend(own[1:], subroots) if len(own) > 1 else None

    def fold(key: tuple, group: pa.Table, top: pa.Table) -> pa.Table:
        group, block = _block(group)
        way = Way(top.column("path")[0].as_py())
        after: dict[tuple[int, int], str] = {}

        def siblings(level: int, i: int) -> str:
            """All siblings from a node of the block to the root, once for each node."""
            if level == len(block.levels) - 1:
                return way.siblings
            if (level, i) not in after:
                nodes, j = block.levels[level], i - i % FANOUT
                after[level, i] = "".join(nodes[j:i]) + "".join(nodes[i + 1 : j + FANOUT]) + siblings(level + 1, i // FANOUT)
            return after[level, i]

        changed = group.column("tampered").to_pylist()
        proofs = [hashlib.sha256(siblings(0, i).encode()).hexdigest() for i in range(group.num_rows)]
        folded = [way.fold(block.fold(i, d)) for i, d in enumerate(changed)]
        return pa.table([group.column("tree"), group.column("doc_id"), group.column("digest"), pa.array(proofs), pa.array(folded)], ["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    blocks = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "block")
    paths = (subroots if above is None else above).withColumnRenamed("at", "block").groupBy("tree", "block")
    folded = blocks.cogroup(paths).applyInArrow(fold, "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string")
    named = folded.join(tops.select(F.col("source").alias("tree"), F.col("digest").alias("subroot")), "tree").crossJoin(F.broadcast(root))  # one row
    return named.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf, roots, proof and folded root of every document; nulls, ties and repeated rows as in ``manifest``."""
    return manifest(documents(spark, sf_dir))
