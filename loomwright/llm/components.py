"""Connected components of links, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import written


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, component for every node of links (columns a, b) that isn't the smallest of its component.

    Each round hangs every larger neighbour of a node on its smallest neighbour, then every smaller one; it ends when a
    round changes nothing, which takes about the logarithm of the longest path in rounds. Minima are pre-aggregated,
    and are written before they are joined with the links again, so that adaptive execution can split the partition of
    a node with very many links.
    """
    a, b = F.col("a"), F.col("b")
    links = written(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), folder, "links0")
    u, v, before, k = F.col("u"), F.col("v"), None, 0
    sign = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")]
    while (now := tuple(links.agg(*sign).first())) != before and now[0]:
        before, k = now, k + 1
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), folder, f"low{k}")
        large = written(both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct(), folder, f"large{k}")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"small{k}")
        moved = large.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        links = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"links{k}")
    return links.select(u.alias("node"), v.alias("component"))


class Forest:
    """Union-find over the nodes that a task has seen linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        """Each node that isn't a root, with its root; then the forest is empty."""
        got = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        return [x for x, _ in got], [r for _, r in got]
