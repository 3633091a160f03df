"""Merkle manifest of a table of documents, and what a changed document does to it: a persistent tree, copied by path.

Each row is a leaf: the SHA-256 (hex) of its fields, each `-` if null, else its UTF-8 byte count, `:` and value. Per source
the leaves ascend by id; while several nodes remain, every `FAN` consecutive ones (last run: fewer, even one) become the
hash of their hex digests. What remains is the source's subroot; subroots, ordered by source (null first, by bytes), give
the root in the same way.

A changed leaf makes a new version of the tree. It shares every node but its own ancestors: only these are copied, each
with one child replaced, and hashed anew. The tree is cut into aligned blocks of `DEPTH` levels (4,096 nodes):
one task builds a block and copies the paths of the versions within it. Above the block a version meets only siblings
that are the same for all of the block's versions. So they are worked out once for each block (`_paths`, the same operator
on the table of block roots, thousands of times smaller at every round), brought back to the block by a cogroup, and each
version goes on to the root where it is. No task sees more than one block of nodes, whatever a source's share of the rows,
and nothing but two counts comes to the driver.

Rows are numbered by a range partitioning on (source, id, leaf) that is written before it is counted, so that a task that
runs again deals rows alike.

Cases: null id: a leaf as any, first in its source, never changed by the query's rule; null source: a source of its own,
first; null or empty text: `-` or `0:`; repeated rows: leaves of their own, ties of an id in order of leaf digest, then of
the changed digest; a lone leaf: its digest is the subroot, and of a lone source the root, with an empty proof; an empty
table: no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import col, cut, partitions

FAN, DEPTH = 16, 3
#: The columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length, so that no two lists of values give one string."""
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels(n: int) -> int:
    """Rounds until n nodes are one."""
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found


@dataclass(frozen=True)
class Version:
    """A version of a block's tree: the nodes that it made, by level (0: leaves) and place; all others are the block's."""

    block: Block
    made: dict[tuple[int, int], str]

    def node(self, level: int, at: int) -> str:
        return self.made.get((level, at)) or self.block.layers[level][at]

    @property
    def top(self) -> str:
        return self.node(len(self.block.layers) - 1, 0)


@dataclass(frozen=True)
class Block:
    """At most FAN ** depth consecutive nodes of a tree and the levels above them, up to `depth` or the tree's top."""

    layers: list[list[str]] = field(default_factory=list)

    @classmethod
    def of(cls, nodes: list[str], n: int, depth: int) -> Block:
        """n: how many nodes the whole tree has on the level of `nodes`; it says how many levels there are to build."""
        layers = [nodes]
        for _ in range(min(depth, levels(n))):
            below = layers[-1]
            layers.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        return cls(layers)

    @property
    def top(self) -> str:
        return self.layers[-1][0]

    def siblings(self, at: int) -> Iterator[tuple[str, str]]:
        """What stands before and after the node and its ancestors in their runs, level by level."""
        for layer in self.layers[:-1]:
            start = at - at % FAN
            yield "".join(layer[start:at]), "".join(layer[at + 1 : start + FAN])
            at //= FAN

    def changed(self, at: int, leaf: str) -> Version:
        """The version in which the node `at` is `leaf`: its ancestors are copied, nothing else."""
        made = {(0, at): leaf}
        for level, (before, after) in enumerate(self.siblings(at), start=1):
            leaf, at = digest(before + leaf + after), at // FAN
            made[level, at] = leaf
        return Version(self, made)


def _ordered(table: pa.Table) -> tuple[pa.Table, list[str]]:
    table = table.sort_by("pos")
    return table, table.column("digest").to_pylist()


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**depth}"))


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, n, digest) of the blocks of nodes (tree, pos, n, digest), as nodes of the next table."""

    def top(group: pa.Table) -> pa.Table:
        table, nodes = _ordered(group)
        n = table.column("n")[0].as_py()
        return pa.table({
            "tree": table.column("tree")[:1], "pos": table.column("block")[:1], "n": pa.array([-(-n // FAN**depth)], pa.int64()), "digest": pa.array([Block.of(nodes, n, depth).top])})

    return _blocks(nodes, depth).groupBy("tree", "block").applyInArrow(top, "tree long, pos long, n long, digest string")


def _paths(nodes: DataFrame, most: int, depth: int) -> DataFrame:
    """(tree, pos, path, top) of nodes (tree, pos, n, digest): the siblings on the way to the tree's top, and that top.

    most: the greatest n, which bounds the rounds.
    """
    tops = cut(_tops(nodes, depth))
    if most > FAN**depth:
        above = _paths(tops, -(-most // FAN**depth), depth)
    else:
        above = tops.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))

    def walk(group: pa.Table, above: pa.Table) -> pa.Table:
        table, found = _ordered(group)
        block, rest = Block.of(found, table.column("n")[0].as_py(), depth), above.column("path")[0].as_py()
        paths = [[{"before": a, "after": b} for a, b in block.siblings(i)] + rest for i in range(len(found))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        tops = pa.array([above.column("top")[0].as_py()] * len(found), pa.string())
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "path": pa.array(paths, kind), "top": tops})

    both = _blocks(nodes, depth).groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block"))
    return cut(both.applyInArrow(walk, f"tree long, pos long, path {_PATH}, top string"))


def _numbered(rows: DataFrame, group: str | None, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with `part` and `at`, starts): the place of a row in its group, in `order`, is at + the start of (group, part).

    Without a group all rows are one. The range partitioning is written before anything is counted by it.
    """
    key = F.col(group) if group else F.lit(0)
    keys = [F.col(group).asc_nulls_first(), *order] if group else order
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    # That id is the partition's number, shifted by 33 bits, and the row's number within it.
    dealt = cut(dealt.withColumn("part", F.shiftright("__id", 33)).withColumn("at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"))
    counts = cut(dealt.groupBy(key.alias("__group"), "part").agg(F.count("*").alias("rows"), F.min("at").alias("first")))
    earlier = Window.partitionBy("__group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, counts.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first"))


@dataclass(frozen=True)
class Manifest:
    """A tree over documents: its leaves (tree, pos, n, doc_id, digest, changed) and what is above each block of them."""

    leaves: DataFrame
    above: DataFrame
    depth: int = DEPTH

    def check(self, *, made: bool = False) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each leaf.

        The proof is the hash of all siblings up to the root; folded_root is the root of the version in which the leaf is
        `changed`, or of the leaf as it is. With made, also the nodes that the version copied: (level, pos, digest), where
        levels go on from the source's tree to that of the subroots.
        """
        depth, kind = self.depth, self.leaves.schema["doc_id"].dataType.simpleString()
        nodes = pa.list_(pa.struct([("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())]))

        def versions(group: pa.Table, above: pa.Table) -> pa.Table:
            table, found = _ordered(group)
            base, block = table.column("pos")[0].as_py(), Block.of(found, table.column("n")[0].as_py(), depth)
            rest = [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
            upper = "".join(a + b for a, b in rest)
            root, subroot, source = (above.column(c)[0].as_py() for c in ("root", "subroot", "tree"))
            in_source = levels(table.column("n")[0].as_py()) - (len(block.layers) - 1)
            proofs, folded, copies = [], [], []
            for i, changed in enumerate(table.column("changed").to_pylist()):
                proofs.append(digest("".join(a + b for a, b in block.siblings(i)) + upper))
                version = block.changed(i, changed or found[i])
                at, top, level = (base + i) // FAN ** (len(block.layers) - 1), version.top, len(block.layers) - 1
                path = [(k, base // FAN**k + p, d) for (k, p), d in sorted(version.made.items())]
                for j, (before, after) in enumerate(rest):
                    # Above the source's top the nodes are those of the subroots, by the source's place.
                    at = source // FAN if j == in_source else at // FAN
                    top, level = digest(before + top + after), level + 1
                    path.append((level, at, top))
                folded.append(top)
                copies.append([{"level": k, "pos": p, "digest": d} for k, p, d in path] if changed else [])
            out = {
                "doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": pa.array([subroot] * len(found), pa.string()),
                "root": pa.array([root] * len(found), pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_())}
            return pa.table(out | {"made": pa.array(copies, nodes)} if made else out)

        schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        both = _blocks(self.leaves, depth).groupBy("tree", "block").cogroup(self.above.groupBy("tree", "block"))
        return both.applyInArrow(versions, schema + (", made array<struct<level:int,pos:long,digest:string>>" if made else ""))


def build_manifest(
    docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text",
    tampered: Column | None = None, becomes: Column | None = None, depth: int = DEPTH,
) -> Manifest:
    """The manifest of docs. Where `tampered` holds, a row's changed leaf is that with `becomes` in place of its text.

    depth: the levels of a block, which doesn't change the result.
    """
    values = [col(f) for f in fields]
    leaf = leaf_digest(values)
    changed = F.lit(None).cast("string")
    if tampered is not None and becomes is not None:
        changed = F.when(tampered, leaf_digest([becomes if f == text else v for f, v in zip(fields, values)]))
    rows = cut(docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), leaf.alias("digest"), changed.alias("changed")))
    dealt, starts = _numbered(rows, "source", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("changed").asc_nulls_first()])
    # Sources in order are the leaves of the upper tree; a source's place there is its tree's number.
    sizes = starts.groupBy(F.col("__group").alias("source")).agg(F.sum("rows").alias("n"))
    places, bases = _numbered(sizes, None, [F.col("source").asc_nulls_first()])
    trees = cut(places.join(bases.select("part", "start"), "part").select(F.col("source").alias("__tree_of"), (F.col("at") + F.col("start")).alias("tree"), "n"))
    most, n_trees = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    known = starts.select("__group", F.col("part").alias("__part"), "start").join(trees, F.col("__group").eqNullSafe(F.col("__tree_of")))
    placed = dealt.join(known, F.col("source").eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__part")))
    leaves = cut(placed.select("tree", (F.col("at") + F.col("start")).alias("pos"), "n", "doc_id", "digest", "changed"))
    tops = cut(_tops(leaves.select("tree", "pos", "n", "digest"), depth))
    blocks = _paths(tops, -(-most // FAN**depth), depth)
    subroots = blocks.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), F.col("top").alias("digest"))
    upper = _paths(subroots, n_trees, depth).select(F.col("pos").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root"))
    above = blocks.join(upper, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root")
    return Manifest(leaves, above, depth)
