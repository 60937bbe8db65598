"""Merkle manifest of a dataset: a hash tree over the rows of each group, and one over the groups, in van Emde Boas layout.

A tree is cut into aligned subtrees of ``BLOCK`` levels. A subtree is one row of a table and holds its nodes in one array: the upper half of its levels first,
then each lower subtree, every one of them laid out in the same way, so that a path from a leaf to the root touches few stretches of the array whatever the size
of a page. Places of nodes are computed, never stored. The roots of the subtrees are the leaves of the next tier, until each group has one root; these are the
leaves of the tree of groups, which is built by the same steps. Proofs come down the same way: a subtree gives each of its leaves the siblings inside it and
what its own root was given from above.

Results: nulls in any column have a digest of their own; rows of a null group are a group, the first; rows of null key come first in their group, rows of equal
key are ordered by digest, so equal rows are interchangeable and get rows of their own; texts of any length are one digest; an empty table has no rows; extra
columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut_lineage, numbered

#: Levels below the root of a subtree, where none are named: 512 leaves, 32 kB of digests in a row.
BLOCK = 9


def digest_of(*values: Column) -> Column:
    """SHA-256 in hexadecimal of values, each with its length before it, null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def address(levels: int, depth: int, index: np.ndarray | int):
    """Place of node ``index`` of a depth in the array of a complete tree of so many levels: halves of the height, upper tree first."""
    at = 0
    while levels > 1:
        upper = levels // 2
        lower = levels - upper
        if depth < upper:
            levels = upper
            continue
        below = depth - upper
        at = at + (1 << upper) - 1 + (index >> below) * ((1 << lower) - 1)
        levels, depth, index = lower, below, index & ((1 << below) - 1)
    return at


def height_of(block: int, n: int, levels: int) -> int:
    """Levels below the root of a subtree with ``n`` leaves; only the sole one of its group can be lower than the others."""
    return levels if block else (n - 1).bit_length()


def node_of(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def build_nodes(leaves: list[str], height: int) -> bytes:
    """The array of a subtree; places past the ragged end stay zero."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    row = leaves
    for level in range(height + 1):
        nodes[address(height + 1, height - level, np.arange(len(row)))] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        row = [node_of(row[i : i + 2]) for i in range(0, len(row), 2)] if level < height else row
    return nodes.tobytes()


def siblings(nodes: bytes, height: int, n: int, index: int) -> Iterator[tuple[str | None, bool]]:
    """From a leaf upwards the digest beside it, none at the ragged end, and whether that stands left."""
    for level in range(height):
        at, count = index >> level, -(-n >> level)
        beside = at ^ 1
        place = 32 * address(height + 1, height - level, beside)
        yield (nodes[place : place + 32].hex() if beside < count else None), bool(at & 1)


def fold(leaf: str, path: Sequence[tuple[str | None, bool]]) -> str:
    """The root that a leaf and the digests beside its way up give."""
    for beside, left in path:
        leaf = node_of([leaf] if beside is None else [beside, leaf] if left else [leaf, beside])
    return leaf


def _subtrees(leaves: DataFrame, levels: int) -> DataFrame:
    """Aligned subtrees of rows ``group, pos, digest, key, other``: their arrays, roots, keys and other digests of the leaves."""
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", "key", "other")))
    grouped = leaves.groupBy("group", F.shiftright("pos", levels).alias("block")).agg(held.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                digests = [x["digest"].hex() for x in r["held"]]
                height = height_of(r["block"], len(digests), levels)
                nodes = build_nodes(digests, height)
                yield pa.RecordBatch.from_pylist([r | {"held": None, "n": len(digests), "keys": [x["key"] for x in r["held"]], "others": [x["other"] for x in r["held"]], "nodes": nodes, "root": nodes[:32]}], schema)

    schema = pa.schema([("group", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.string())), ("others", pa.list_(pa.binary())), ("nodes", pa.binary()), ("root", pa.binary())])
    return cut_lineage(grouped.mapInArrow(run, "group string, block long, n long, keys array<string>, others array<binary>, nodes binary, root binary"))


def tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Subtrees of the leaves, of their roots, and so on to one subtree for each group; ``log2(rows) / levels`` tables, each far smaller than the last."""
    found = [_subtrees(leaves, levels)]
    while not found[-1].where("block > 0").isEmpty():
        up = found[-1].select("group", F.col("block").alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("binary").alias("other"))
        found.append(_subtrees(up, levels))
    return found


_ABOVE = "path array<struct<digest:binary,left:boolean>>, subroot binary"
_PATH = pa.list_(pa.struct([("digest", pa.binary()), ("left", pa.bool_())]))


def _paths(subtrees: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``group, pos, key, path, subroot`` of all leaves; ``above`` holds the path of each subtree's root, and the subroot that all leaves below share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                height, rows = height_of(r["block"], r["n"], levels), []
                for i, key in enumerate(r["keys"]):
                    own = [{"digest": d and bytes.fromhex(d), "left": left} for d, left in siblings(r["nodes"], height, r["n"], i)]
                    rows.append({"group": r["group"], "pos": (r["block"] << levels) + i, "key": key, "path": own + (r["path"] or []), "subroot": r["subroot"]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("group", pa.string()), ("pos", pa.int64()), ("key", pa.string()), ("path", _PATH), ("subroot", pa.binary())])
    joined = subtrees.join(above.select("group", F.col("pos").alias("block"), "path", "subroot"), ["group", "block"], "left").select("group", "block", "n", "keys", "nodes", "path", "subroot")
    return joined.mapInArrow(run, f"group string, pos long, key string, {_ABOVE}")


def _descend(found: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The paths of the subtrees of the lowest tier, from those of the roots of the highest."""
    for subtrees in reversed(found[1:]):
        above = _paths(subtrees, above, levels)
    return above


class Manifest:
    """The trees of a dataset. ``rows`` and ``groups`` are their tiers, ``root`` the digest of all, null if there are no rows."""

    def __init__(self, leaves: DataFrame, levels: int = BLOCK):
        """``leaves``: key, group, leaf, and other, a digest to hold against the manifest in its place, or null."""
        self.levels = levels
        named = leaves.select(
            F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-")).alias("group"),
            F.col("key").cast("long").alias("key"),
            F.unhex("leaf").alias("digest"),
            F.unhex("other").alias("other"),
        )
        self.rows = tiers(numbered(cut_lineage(named), "group", "key", "digest").select("group", "pos", "digest", F.col("key").cast("string").alias("key"), "other"), levels)
        subroots = self.rows[-1].select(F.lit("").alias("all"), F.col("group").alias("key"), F.col("root").alias("digest"))
        self.groups = tiers(numbered(subroots, "all", "key").select(F.col("all").alias("group"), "pos", "digest", "key", F.lit(None).cast("binary").alias("other")), levels)
        top = self.groups[-1].select("root").first()  # one row: the tree of groups has one root
        self.root = bytes(top["root"]).hex() if top else None

    def proofs(self) -> DataFrame:
        """For each row: key, leaf, subroot, root, the digest of the siblings on its way up, and the root that ``other`` (else the leaf) gives with them."""
        levels = self.levels
        none = self.groups[0].sparkSession.createDataFrame([], f"group string, pos long, {_ABOVE}")
        of_groups = _paths(self.groups[0], _descend(self.groups, none, levels), levels).select(F.col("key").alias("group"), F.lit(0).cast("long").alias("pos"), "path")
        above = _descend(self.rows, of_groups.join(self.rows[-1].select("group", F.col("root").alias("subroot")), "group"), levels)
        joined = self.rows[0].join(above.select("group", F.col("pos").alias("block"), "path", "subroot"), ["group", "block"]).select("block", "n", "keys", "others", "nodes", "path", "subroot")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    height, nodes, out = height_of(r["block"], r["n"], levels), r["nodes"], []
                    above = [(x["digest"] and x["digest"].hex(), x["left"]) for x in r["path"]]
                    for i, (key, other) in enumerate(zip(r["keys"], r["others"], strict=True)):
                        place = 32 * address(height + 1, height, i)
                        leaf, path = nodes[place : place + 32].hex(), [*siblings(nodes, height, r["n"], i), *above]
                        out.append((key and int(key), leaf, r["subroot"].hex(), node_of([d for d, _ in path if d is not None]), fold(other.hex() if other else leaf, path)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        names, types = ["key", "leaf", "subroot", "proof_sha256", "folded_root"], [pa.int64(), *[pa.string()] * 4]
        found = joined.mapInArrow(run, "key long, leaf string, subroot string, proof_sha256 string, folded_root string")
        root = F.lit(self.root).cast("string")
        return found.select("key", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", levels: int = BLOCK) -> Manifest:
    """The manifest of a table. ``changed`` gives columns other values in the rows ``where`` holds; :meth:`Manifest.proofs` holds their digests against it."""
    leaf = digest_of(*(F.col(c) for c in columns))
    other = digest_of(*((changed or {}).get(c, F.col(c)) for c in columns)) if changed else F.lit(None).cast("string")
    other = other if where is None else F.when(where, other)
    return Manifest(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), other.alias("other")), levels)
