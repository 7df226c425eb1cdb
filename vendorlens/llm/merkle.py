"""Merkle manifest of a table: a postorder append log per tree, and proofs addressed by closed-form positions.

The rows of a tree (a language, say) are its leaves, in order. Level by level every two consecutive nodes become
the hash of their hex digests; a last one without partner is hashed alone. The trees' roots, in the trees' order,
are the leaves of one more tree, whose root stands for the whole table.

* **Builders.** Leaves are ranked within their tree in range partitions, and cut into aligned blocks of
  ``2 ** bits``. A builder per block appends nodes in the order in which they are complete (postorder), holding one
  open node a level; its nodes are a segment of the log. Block roots are the leaves of the next tier of builders,
  until a tree has a single block. A tree with most of the rows has more blocks, not larger ones.
* **Positions.** A complete subtree of height h holds 2 ** (h + 1) - 1 nodes, so the position of any node follows
  from its level, its index and the number of leaves (``position``); nothing is searched.
* **Proofs.** From the top tier down, a segment and the path of its own root give the path of each of its leaves:
  siblings are read at their positions. No node is looked up by a join, so the nodes next to the root, which
  stand in every proof, are no hot keys.

Digests are 32 bytes; a path is a string of steps from the leaf to the root: ``L`` or ``R`` (the side on which the
sibling stands) and the sibling's digest, or ``-`` for a node without sibling.

Defined results: null tree, order and field values are values like others (null sorts first); rows equal in all of
them are a leaf each; an empty table has no rows and no root; a tree of one row has its leaf as root. Columns to
keep travel in the struct ``doc``, so their names cannot clash.
"""
from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlens.llm.tables import stored
from vendorlens.operators.ordered import running_totals

BLOCK_BITS = 10
WIDTH = 32


def field_text(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers are decimal."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: Column) -> Column:
    """The digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]), 256))


def parent(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def subtree_size(level: int, leaves: int) -> int:
    """Nodes of a subtree of height ``level`` over ``leaves`` leaves."""
    return sum(-(-leaves >> t) for t in range(level + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Position in the log of node ``index`` of ``level`` in a tree of ``leaves`` leaves: the complete subtrees
    before it, their parents that are complete by then, and its own subtree."""
    own = min(1 << level, leaves - (index << level))
    return index * ((2 << level) - 1) + index - index.bit_count() + subtree_size(level, own) - 1


def height_of(leaves: int) -> int:
    return (leaves - 1).bit_length()


def append_log(leaves: list[bytes], height: int) -> bytes:
    """The nodes over ``leaves`` in completion order, up to the one node of level ``height``."""
    log, waiting = bytearray(), [b""] * (height + 1)
    for node in leaves:
        log += node
        level = 0
        while waiting[level]:
            node, waiting[level] = parent(waiting[level], node), b""
            log += node
            level += 1
        waiting[level] = node
    carried = b""
    for level in range(height):
        pair = [d for d in (waiting[level], carried) if d]
        carried = parent(*pair) if pair else b""
        log += carried
    return bytes(log)


def leaf_paths(nodes: bytes, leaves: int, above: bytes) -> list[bytes]:
    """The path of every leaf of a segment whose root has the path ``above``."""
    paths = [above]
    for level in reversed(range(_height(len(nodes) // WIDTH, leaves))):
        count = -(-leaves >> level)
        below = []
        for i in range(count):
            if i ^ 1 < count:
                at = WIDTH * position(level, i ^ 1, leaves)
                step = (b"L" if i & 1 else b"R") + nodes[at:at + WIDTH]
            else:
                step = b"-"
            below.append(step + paths[i >> 1])
        paths = below
    return paths


def _height(nodes: int, leaves: int) -> int:
    """Height of a segment: beyond its own tree's, every level adds one node."""
    own = height_of(leaves)
    return own + nodes - subtree_size(own, leaves)


def steps(path: bytes) -> list[tuple[str, bytes]]:
    out, at = [], 0
    while at < len(path):
        side = chr(path[at])
        end = at + 1 + (0 if side == "-" else WIDTH)
        out.append((side, path[at + 1:end]))
        at = end
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and a path lead to."""
    for side, sibling in steps(path):
        leaf = parent(sibling, leaf) if side == "L" else parent(leaf, sibling) if side == "R" else parent(leaf)
    return leaf


def path_digest(path: bytes) -> bytes:
    """Digest of the siblings of a path, from the leaf upward."""
    return parent(*[sibling for side, sibling in steps(path) if side != "-"])


_SEGMENT = "tree string, block long, leaves int, weight long, nodes binary, root binary"


def _tier(nodes: DataFrame, bits: int) -> DataFrame:
    """A segment per block of ``nodes`` (tree, i, weight, digest), of which a tree's i run from 0."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        digests, block = table.column("digest").to_pylist(), table.column("block")[0].as_py()
        height = bits if block else height_of(len(digests))
        log = append_log(digests, height)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "block": [block], "leaves": pa.array([len(digests)], pa.int32()),
                         "weight": [sum(table.column("weight").to_pylist())], "nodes": [log], "root": [log[-WIDTH:]]})
    blocks = nodes.select("tree", F.shiftright("i", bits).alias("block"), "i", "weight", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(build, _SEGMENT)


def _tiers(leaves: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of segments over ``leaves`` (tree, i, digest), and the root of each tree (tree, root, tier)."""
    tiers, nodes, roots = [], leaves.select("tree", "i", F.lit(1).cast("long").alias("weight"), "digest"), None
    while True:
        segments = stored(_tier(nodes, bits))
        more = segments.groupBy("tree").agg(F.max("block").alias("last"))
        done = segments.join(more.where("last = 0"), "tree").select("tree", "root", F.lit(len(tiers)).alias("tier"))
        roots = done if roots is None else roots.unionByName(done)
        tiers.append(segments)
        open_trees = more.where("last > 0").select("tree")
        if open_trees.isEmpty():
            return tiers, stored(roots)
        nodes = segments.join(open_trees, "tree").select("tree", F.col("block").alias("i"), "weight", F.col("root").alias("digest"))


def _segments_with_paths(tiers: list[DataFrame], above: DataFrame, at: int) -> DataFrame:
    """The segments of tier ``at`` with the path of their root and what ``above`` (tree, tier, path, subroot)
    says of their tree."""
    own = above.where(F.col("tier") == at).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    if at + 1 < len(tiers):
        def down(batches):
            for batch in batches:
                out = {"tree": [], "block": [], "path": [], "subroot": []}
                for s in batch.to_pylist():
                    for i, path in enumerate(leaf_paths(s["nodes"], s["leaves"], s["path"])):
                        out["tree"].append(s["tree"])
                        out["block"].append((s["block"] * s["full"]) + i)
                        out["path"].append(path)
                        out["subroot"].append(s["subroot"])
                yield pa.RecordBatch.from_pydict(out, pa.schema([("tree", pa.string()), ("block", pa.int64()),
                                                                 ("path", pa.binary()), ("subroot", pa.binary())]))
        upper = _segments_with_paths(tiers, above, at + 1)
        own = own.unionByName(upper.mapInArrow(down, "tree string, block long, path binary, subroot binary"))
    return tiers[at].join(own, ["tree", "block"])


@dataclass
class Manifest:
    leaves: DataFrame  # tree, i, digest, claim, doc
    tiers: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame  # tree, i, digest (its root), tier
    root: bytes | None
    bits: int


def build(rows: DataFrame, tree: Column, order: Column, leaf: Column, keep: list[str], claim: Column | None = None,
          bits: int = BLOCK_BITS) -> Manifest:
    """The manifest of ``rows``: a tree for each value of ``tree``, leaves by ``order`` (ties by digest). ``claim``
    is a digest to fold along the leaf's path instead of the leaf (null: the leaf)."""
    claim = F.lit(None).cast("binary") if claim is None else claim
    name = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))  # null first, then as the values sort
    doc = F.struct(*[F.col(f"`{c}`") for c in keep])
    flat = stored(rows.select(name.alias("tree"), order.alias("at"), leaf.alias("digest"), claim.alias("claim"), doc.alias("doc")))
    ranked = running_totals(flat, [F.col("at").asc(), F.col("digest").asc()], row_number="place", segment_by=["tree"])
    leaves = stored(ranked.select("tree", (F.col("place") - 1).cast("long").alias("i"), "digest", "claim", "doc"))
    tiers, roots = _tiers(leaves, bits)
    ranked = running_totals(roots, [F.col("tree").asc()], row_number="place")
    trees = stored(ranked.select("tree", (F.col("place") - 1).cast("long").alias("i"), F.col("root").alias("digest"), "tier"))
    top, whole = _tiers(trees.select(F.lit("").alias("tree"), "i", "digest"), bits)
    found = whole.select("root").first()
    return Manifest(leaves, tiers, top, trees, bytes(found[0]) if found else None, bits)


def _grouped(segments: DataFrame, bits: int) -> DataFrame:
    """``segments`` with the number of children of a full segment, to number theirs."""
    return segments.withColumn("full", F.lit(1 << bits).cast("long"))


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf: ``doc``, ``leaf``, ``subroot`` (its tree's root), ``path`` to the table's root, ``proof`` (digest of
    the siblings) and ``folded``, the root that its claim, or else its leaf, leads to."""
    bits = manifest.bits
    tops, tiers = [_grouped(t, bits) for t in manifest.top], [_grouped(t, bits) for t in manifest.tiers]
    ends = F.lit(len(tops) - 1)
    crown = _segments_with_paths(tops, _one(manifest).select("tree", ends.alias("tier"), "path", "subroot"), 0)
    roots = crown.mapInArrow(_children, "i long, path binary")
    above = stored(manifest.trees.join(roots, "i").select("tree", "tier", "path", F.col("digest").alias("subroot")))
    segments = _segments_with_paths(tiers, above, 0).select("tree", "block", "leaves", "nodes", "path", "subroot")
    leaves = manifest.leaves.select("tree", F.shiftright("i", bits).alias("block"), "i", "digest", "claim", "doc")

    def join(rows: pa.Table, segment: pa.Table) -> pa.Table:
        s = segment.to_pylist()[0]
        paths = leaf_paths(s["nodes"], s["leaves"], s["path"])
        mask = (1 << bits) - 1
        mine = [paths[i & mask] for i in rows.column("i").to_pylist()]
        digests, claims = rows.column("digest").to_pylist(), rows.column("claim").to_pylist()
        return pa.table({"doc": rows.column("doc"), "leaf": rows.column("digest"),
                         "subroot": pa.array([s["subroot"]] * len(mine), pa.binary()), "path": pa.array(mine, pa.binary()),
                         "proof": pa.array([path_digest(p) for p in mine], pa.binary()),
                         "folded": pa.array([fold(c or d, p) for c, d, p in zip(claims, digests, mine)], pa.binary())})
    out = T.StructType([leaves.schema["doc"], *(T.StructField(c, T.BinaryType()) for c in ("leaf", "subroot", "path", "proof", "folded"))])
    return leaves.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInArrow(join, out)


def _one(manifest: Manifest) -> DataFrame:
    """The top tree, whose root has the empty path."""
    return manifest.top[-1].limit(1).select(F.lit("").alias("tree"), F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))


def _children(batches):
    for batch in batches:
        i, path = [], []
        for s in batch.to_pylist():
            found = leaf_paths(s["nodes"], s["leaves"], s["path"])
            i += range(s["block"] * s["full"], s["block"] * s["full"] + len(found))
            path += found
        yield pa.RecordBatch.from_pydict({"i": i, "path": path}, pa.schema([("i", pa.int64()), ("path", pa.binary())]))


def log_nodes(manifest: Manifest, top: bool = False) -> DataFrame:
    """The append log: (tree, position, level, index, digest) of every node of the trees, or of the tree over
    their roots. Positions of a tree run from 0 without gaps in completion order."""
    bits, out = manifest.bits, None
    for tier, segments in enumerate(manifest.top if top else manifest.tiers):
        def nodes(batches, tier=tier):
            for batch in batches:
                rows = {"tree": [], "position": [], "level": [], "index": [], "digest": []}
                for s in batch.to_pylist():
                    for level in range(1 if tier else 0, _height(len(s["nodes"]) // WIDTH, s["leaves"]) + 1):
                        for j in range(-(-s["leaves"] >> level)):
                            here = tier * bits + level
                            index = (s["block"] << (bits - level)) + j
                            before = s["block"] << (bits - level)
                            at = WIDTH * position(level, j, s["leaves"])
                            rows["tree"].append(s["tree"])
                            rows["position"].append(position(here, index, (before << here) + s["weight"]))
                            rows["level"].append(here)
                            rows["index"].append(index)
                            rows["digest"].append(s["nodes"][at:at + WIDTH])
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()),
                                                                  ("index", pa.int64()), ("digest", pa.binary())]))
        part = segments.mapInArrow(nodes, "tree string, position long, level int, index long, digest binary")
        out = part if out is None else out.unionByName(part)
    return out


def write_log(manifest: Manifest, path: str) -> None:
    """The log as Parquet, in ranges of (tree, position)."""
    log_nodes(manifest).repartitionByRange("tree", "position").sortWithinPartitions("tree", "position").write.parquet(path)
