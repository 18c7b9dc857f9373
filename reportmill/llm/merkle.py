"""Merkle manifest of a dataset: digests of rows, of sources and of the whole, a proof for each row, and rows held against it.

A row's leaf is H (sha256, lowercase hex) of its columns, each `-` if null, else its UTF-8 bytes' count, `:` and the value.
Leaves of a source ascend by key; every FAN consecutive nodes become the H of their digests, level by level, until one is
left: the source's root. These, in the order of sources, become the root of all in the same way.

Rows are numbered by one range shuffle of digests (no text is moved), so a source of any size is dealt over many tasks.
Cogrouped subtree exchange: FAN ** LEVELS consecutive leaves are a superblock, whose root is a node of the tree. On the
way up superblocks are reduced, and their roots again in superblocks, until one node is left. On the way down the leaves
of a superblock and the outer nodes of its proofs are cogrouped: there the local levels are reduced, proofs joined, and
what is held against the manifest is folded to a root. Small sources share a task's superblock.

Null source is a source of its own and comes first; others follow in UTF-8 byte order. Null keys come first in their
source, rows of equal keys by their leaves, so repeated rows are leaves of their own with proofs of their own. Empty texts
are values of no bytes, unlike null; texts of any length are hashed whole. A lone leaf is its source's root, a lone source's root the
root of all; then proofs are empty. An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_hot
from .store import written

#: Children of a node, and levels of a superblock (2,187 leaves).
FAN, LEVELS = 3, 7
#: The columns of a leaf, in the manifest's order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_ROW = "key {key}, leaf binary, subroot binary, proof binary, folded binary"
_NODE = "tree long, n long, pos long, node binary"
_PATH = "tree long, n long, pos long, node binary, subroot binary, path binary"


def leaf_digest(values: list[Column]) -> Column:
    """The 32 bytes of a row's leaf."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df, written, with `at`: a row's place (from 0) in this order of all rows. The driver holds a number for each partition."""
    told = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    counts = sorted(told.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before - (r["part"] << 33)))
        before += r["count"]
    shifts = F.broadcast(df.sparkSession.createDataFrame(offsets, "part long, shift long"))
    return told.withColumn("part", part).join(shifts, "part").withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def _digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _levels(leaves: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of a superblock from its leaves up, as far as it goes: all, or to the root of a tree of n nodes that fits in one."""
    out = [leaves]
    while len(out) <= levels if n > FAN**levels else len(out[-1]) > 1:
        last = out[-1]
        out.append([_digest(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def _trees(nodes: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """The trees of a group, each in the order of its nodes."""
    return nodes.sort_values(["tree", "pos"], kind="stable").groupby("tree", sort=False)


def _climb(nodes: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The root of each superblock of the group: nodes of the next table."""
    rows = []
    for tree, part in _trees(nodes):
        n, pos = int(part["n"].iloc[0]), int(part["pos"].iloc[0])
        rows.append((tree, -(-n // FAN**levels), pos // FAN**levels, bytes.fromhex(_levels([x.hex() for x in part["node"]], n, levels)[-1][0])))
    return pd.DataFrame(rows, columns=["tree", "n", "pos", "node"])


def _pack(path: list[tuple[list[str], list[str]]]) -> bytes:
    """A path (left and right siblings of each level): a byte for their numbers, then their digests."""
    return b"".join(bytes([len(left) * FAN + len(right)]) + bytes.fromhex("".join(left + right)) for left, right in path)


def _unpack(packed: bytes) -> list[tuple[list[str], list[str]]]:
    out, at = [], 0
    while at < len(packed):
        left, right = divmod(packed[at], FAN)
        told = packed[at + 1 : at + 1 + 32 * (left + right)].hex()
        digests = [told[i : i + 64] for i in range(0, len(told), 64)]
        out.append((digests[:left], digests[left:]))
        at += 1 + 32 * (left + right)
    return out


def _paths(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> Iterator[tuple[pd.DataFrame, bytes, list[list[tuple[list[str], list[str]]]]]]:
    """For each superblock of a cogroup: its nodes, its source's root, and each node's path to the root of all."""
    above = {r.tree: (r.subroot, _unpack(r.path)) for r in outer.itertuples()}
    for tree, part in _trees(nodes):
        subroot, path = above[tree]
        paths = [path]
        for level in reversed(_levels([x.hex() for x in part["node"]], int(part["n"].iloc[0]), levels)[:-1]):
            paths = [[(level[i - i % FAN : i], level[i + 1 : i - i % FAN + FAN]), *paths[i // FAN]] for i in range(len(level))]
        yield part, subroot, paths


def _descend(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    told = [part.assign(subroot=[subroot] * len(part), path=[_pack(p) for p in paths]) for part, subroot, paths in _paths(nodes, outer, levels)]
    return pd.concat(told)[["tree", "n", "pos", "node", "subroot", "path"]]


def _fold(leaf: str, path: list[tuple[list[str], list[str]]]) -> bytes:
    for left, right in path:
        leaf = _digest([*left, leaf, *right])
    return bytes.fromhex(leaf)


def _finish(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    told = []
    for part, subroot, paths in _paths(nodes, outer, levels):
        proofs = [bytes.fromhex("".join(x for left, right in p for x in left + right)) for p in paths]
        folded = [_fold(h.hex(), p) for h, p in zip(part["held"], paths, strict=True)]
        told.append(part[["key", "node"]].rename(columns={"node": "leaf"}).assign(subroot=[subroot] * len(part), proof=proofs, folded=folded))
    return pd.concat(told)


def _keyed(nodes: DataFrame, n: str, block: Column, levels: int) -> DataFrame:
    """nodes with the key of their superblock: b0 and b1 are tree and block, or those of the superblock that small trees (n nodes) share, b0 below 0."""
    small = F.col(n) <= FAN**levels
    return nodes.withColumns({"b0": F.when(small, -1 - F.expr(f"tree div {FAN**levels}")).otherwise(F.col("tree")), "b1": F.when(small, F.lit(0).cast("long")).otherwise(block)})


def _grouped(nodes: DataFrame, levels: int) -> DataFrame:
    return _keyed(nodes, "n", F.expr(f"pos div {FAN**levels}"), levels)


def _tables(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """nodes, then the roots of their superblocks, and so on until every tree has one node. Finished trees are not carried on."""
    out = [nodes]
    while largest > 1:
        told = _grouped(out[-1].filter("n > 1").select("tree", "n", "pos", "node"), levels)
        out.append(written(told.groupBy("b0", "b1").applyInPandas(lambda nodes: _climb(nodes, levels), _NODE), "nodes"))
        largest = -(-largest // FAN**levels)
    return out


def _ends(tables: list[DataFrame]) -> DataFrame:
    """tree, node of each tree's root."""
    found = [t.filter("n = 1").select("tree", "node") for t in tables]
    for f in found[1:]:
        found[0] = found[0].unionByName(f)
    return found[0]


def _outer(tables: list[DataFrame], i: int, paths: DataFrame | None, ends: DataFrame, levels: int) -> DataFrame:
    """What superblocks of tables[i] need: the path of their roots, which are trees' roots (in ends) or nodes of the next table (in paths)."""
    trees = tables[i].filter("pos = 0").select(F.col("tree").alias("tree"), F.col("n").alias("below"))
    last = trees.filter(F.col("below") <= FAN**levels).join(ends, "tree").select("tree", "below", F.lit(0).cast("long").alias("pos"), "subroot", "path")
    if paths is None:
        return _keyed(last, "below", F.col("pos"), levels)
    more = trees.filter(F.col("below") > FAN**levels).join(paths.select("tree", "pos", "subroot", "path"), "tree").select(*last.columns)
    return _keyed(last.unionByName(more), "below", F.col("pos"), levels)


def _down(tables: list[DataFrame], ends: DataFrame, lowest: int, levels: int) -> DataFrame | None:
    """Paths of the nodes of tables[lowest]."""
    paths = None
    for i in range(len(tables) - 1, lowest - 1, -1):
        if i == len(tables) - 1 and i > 0:
            continue
        inner, outer = _grouped(tables[i].select("tree", "n", "pos", "node"), levels), _outer(tables, i, paths, ends, levels)
        paths = written(inner.groupBy("b0", "b1").cogroup(outer.groupBy("b0", "b1")).applyInPandas(lambda nodes, outer: _descend(nodes, outer, levels), _PATH), "paths")
    return paths


def prove(docs: DataFrame, now: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, by: str = "source", key: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof, folded_root and verified of every row of docs.

    now: columns whose values are to be held against the manifest, as they are found now; without it rows are held as they
    are. leaf, subroot, root and folded_root are lowercase hex, proof holds the siblings' digests (32 bytes each) from
    the leaf's level to the root's, left to right. verified: whether the row found now, folded with its proof, gives the root.
    """
    spark, now = docs.sparkSession, now or {}
    values = {c: F.col(c) for c in columns}
    name = F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("n"))
    leaf, held = leaf_digest(list(values.values())), leaf_digest(list((values | now).values()))
    hashed = docs.select(name.alias("name"), F.col(key).alias("key"), leaf.alias("node"), (held if now else leaf).alias("held"), F.monotonically_increasing_id().alias("tie"))
    rows = numbered(written(hashed, "leaves"), "name", "key", "node", "tie").drop("tie")
    sources = written(rows.groupBy("name").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "sources")
    total = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("largest")).first()
    kind = docs.schema[key].dataType.simpleString()
    if not total["sources"]:
        return spark.createDataFrame([], f"`{key}` {kind}, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean")
    leaves = written(join_hot(rows, sources, "name").select("tree", "n", (F.col("at") - F.col("tree")).alias("pos"), "node", "held", "key"), "placed")
    tables = _tables(leaves, total["largest"], levels)
    # The tree of sources: as the others, with their roots for leaves and no tree above.
    ends = written(_ends(tables), "ends")
    tops = numbered(ends, "tree").select(F.lit(0).cast("long").alias("tree"), F.lit(total["sources"]).cast("long").alias("n"), F.col("at").alias("pos"), "node", F.col("tree").alias("source"))
    tops = written(tops, "tops")
    top = _tables(tops, total["sources"], levels)
    root = bytes(_ends(top).first()["node"])
    whole = spark.createDataFrame([(0, bytearray(), bytearray())], "tree long, subroot binary, path binary")
    told = tops.select(F.col("source").alias("tree"), "pos", F.col("node").alias("subroot"))
    ends = written(told.join(_down(top, whole, 0, levels).select("pos", "path"), "pos").select("tree", "subroot", "path"), "proofs")
    paths = _down(tables, ends, 1, levels) if len(tables) > 2 else None
    inner, outer = _grouped(leaves, levels), _outer(tables, 0, paths, ends, levels)
    done = inner.groupBy("b0", "b1").cogroup(outer.groupBy("b0", "b1")).applyInPandas(lambda nodes, outer: _finish(nodes, outer, levels), _ROW.format(key=kind))
    digest = lambda c: F.lower(F.hex(c))
    hex_root = F.lit(root.hex())
    return done.select(F.col("key").alias(key), digest("leaf").alias("leaf"), digest("subroot").alias("subroot"), hex_root.alias("root"), "proof", digest("folded").alias("folded_root"), (digest("folded") == hex_root).alias("verified"))
