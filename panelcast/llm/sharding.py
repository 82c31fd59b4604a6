"""Sharding by a hierarchical weighted hash tree.

Each row descends region, rack and shard levels. At a node every child makes a draw from the row's key and the child's
name, scaled by the child's weight (minus the logarithm of a uniform draw, divided by the weight), and the lowest draw
wins. A child wins in proportion to its weight, and changing a weight changes draws of that child alone: rows move only
into or out of subtrees whose weights changed. A new shard enters as a subtree of its own, so that growing takes rows
only into the new shard; folding it into an existing rack later is a planned change of two subtree weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import OWN, number_rows, spread_key, unit_draw


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf carries its shard number and weight, an inner node weighs what its children weigh."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.shard]


def balanced_tree(regions: int, racks: int, shards: int) -> Node:
    """`regions` x `racks` x `shards` equal shards, numbered in order."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(
        Node(f"g{g}", tuple(Node(f"g{g}r{r}", tuple(Node(f"s{(n := next(number))}", shard=n) for _ in range(shards))) for r in range(racks)))
        for g in range(regions)
    ))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = max(tree.shards()) + 1
    leaf = Node(f"s{n}", shard=n, own_weight=weight)
    return replace(tree, children=(*tree.children, Node(f"g+{n}", (Node(f"g+{n}r", (leaf,)),))))


def descend(tree: Node, key: Column) -> Column:
    """The shard a key reaches. Only the draws of nodes on the path are evaluated."""
    if not tree.children:
        return F.lit(tree.shard)
    kids = [c for c in tree.children if c.weight > 0]
    if len(kids) == 1:
        return descend(kids[0], key)
    draws = [F.struct((-F.log(unit_draw(F.md5(F.concat(key, F.lit("/" + c.name))))) / F.lit(float(c.weight))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(kids)]
    won = F.least(*draws)["i"]
    inner = [descend(c, key) for c in kids]
    if all(not c.children for c in kids):
        return F.array(*inner)[won]
    case = F.when(won == 0, inner[0])
    for i, x in enumerate(inner[1:], 1):
        case = case.when(won == i, x)
    return case


def assign_shards(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard and `keep`.

    Law `key`: the key and the tree decide alone. Slots number a shard's rows from 0 in hash order of key and text.
    Null keys share one shard; repeated rows get slots of their own; a null text counts as empty (size 8, checksum 0).
    An empty table gives no rows; other columns are ignored. Texts are read once and not shuffled.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("~"))
    rows = docs.select(
        F.col(key), *keep,
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(tree, name).cast("int").alias("shard"),
        descend(grown(tree), name).cast("int").alias("grown_shard"),
    ).withColumn(f"{OWN}order", spread_key(key, "text_crc32"))
    numbered = number_rows(rows, ["shard"], [f"{OWN}order", key, "text_crc32"], "slot")
    return numbered.select(key, *keep, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
