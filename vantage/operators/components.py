"""Connected components of an edge list as alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """``(id, root)`` of every node on an edge ``(src, dst)``; the root is the smallest id of the component.

    Large-star and small-star steps in turn: each hangs the neighbours of a node on its smallest neighbour, which
    converges in a logarithmic number of rounds and never gathers the neighbours of one node in a list. ``cut`` writes a
    frame out and reads it back, so the plan of a round does not hold those before it. Null ends are left out, loops are
    components of their own.
    """
    seen = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = seen.select(F.col("src").alias("id")).union(seen.select(F.col("dst").alias("id"))).distinct()
    now = cut(seen.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        now = cut(small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").union(small.select("src", F.col("m").alias("dst"))).distinct())
        after = now.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("long"))).first()
        if tuple(after) == state:
            break
        state = tuple(after)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(now.select(F.col("src").alias("id"), F.col("dst").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def components_of_few(edges: DataFrame) -> DataFrame:
    """The same result by union-find in one task, for an edge list whose size was checked: one job instead of rounds."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["src"], pdf["dst"], strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        ids = list(root)
        if ids:
            yield pd.DataFrame({"id": ids, "root": [find(x) for x in ids]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").coalesce(1).mapInPandas(join, f"id {kind}, root {kind}")
