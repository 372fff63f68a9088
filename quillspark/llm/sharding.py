"""Sharding by a hierarchical weighted hash tree: each document descends region, rack and shard.

At every level each child draws ``-weight / ln(u)`` with u from a hash of the child's path and the document's key, and the largest
draw wins, so a child gets its share of the weight. A draw depends on nothing but the child, so if a subtree's weight changes,
documents move only into it or out of it; its siblings swap none among themselves. Built-in functions only.

`tree(n)` lays out the first 16 shards as 2 regions of 2 racks of 4; every shard after these opens a region of its own, so it takes
documents from all others and gives none elsewhere (law ``key``). Below 16, `tree(n)` and `tree(n + 1)` differ in weights of regions and racks
that hold old shards, so keys move among old shards too; `grown` adds a shard to any tree in a region of its own, and the law holds for every
count. Defined cases: a null key is hashed as such and lands in one shard; repeated keys share a shard and get slots of their own; equal
draws go to the first child; a null text has size 1, one of any length its bytes and 1; an empty table gives an empty result; columns named
as those added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let, with_start

BASE = 16


@dataclass(frozen=True)
class Node:
    path: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def _above(path: str, children: list[Node]) -> Node:
    return Node(path, sum(c.weight for c in children), tuple(children))


def tree(n: int, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``n`` shards; ``weights`` by shard, 1 where not given."""
    shards = [Node("", (weights or {}).get(i, 1.0), (), i) for i in range(n)]
    at = lambda s, path: Node(f"{path}/{s.shard}", s.weight, (), s.shard)
    regions = []
    for r, low in enumerate(range(0, min(n, BASE), 8)):
        racks = [_above(f"/{r}/{k}", [at(s, f"/{r}/{k}") for s in shards[first : min(first + 4, low + 8)]]) for k, first in enumerate(range(low, min(low + 8, n, BASE), 4))]
        regions.append(_above(f"/{r}", racks))
    for s in shards[BASE:]:
        r = f"/{2 + s.shard - BASE}"
        regions.append(_above(r, [_above(f"{r}/0", [at(s, f"{r}/0")])]))
    return _above("", regions)


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard in a region of its own: keys move into it and nowhere else."""
    r = f"/+{shard}"
    return _above(root.path, [*root.children, _above(r, [_above(f"{r}/0", [Node(f"{r}/0/{shard}", weight, (), shard)])])])


def draw(key: Column, node: Node) -> Column:
    """The weighted draw of a child for a key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.path), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.lit(float(node.weight)) / F.log(u)


def descend(key: Column, node: Node) -> Column:
    """The shard of a key below ``node``."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    best = F.array_max(F.array(*[F.struct(draw(key, c).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(node.children)]))["i"]

    def chosen(b: Column) -> Column:
        branch = descend(key, node.children[-1])
        for i, c in reversed(list(enumerate(node.children[:-1]))):
            branch = F.when(b == -i, descend(key, c)).otherwise(branch)
        return branch

    return let(best, chosen)


def assign(docs: DataFrame, shards: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of every row."""
    return docs.withColumn(name, descend(F.col(key), shards).cast("int"))


def with_slots(assigned: DataFrame, key: str = "doc_id", shard: str = "shard", name: str = "slot") -> DataFrame:
    """Adds a place in the shard, gapless from 0. No task holds a whole shard: see `with_start`."""
    return with_start(assigned, [shard], [F.col(key).asc_nulls_first()], [key], name)
