"""Projection of the graph as of a horizon, and walks on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.sources.shared import materialise


def fold_edges(assertions: DataFrame, components: DataFrame, h: hz.Horizon) -> DataFrame:
    """Visible relations between components: weight, highest confidence, first position. Identities and loops fall away."""
    ends = hz.asof_assertions(assertions, h).where(F.col("predicate") != idn.IDENTITY)
    ends = ends.join(components.select(F.col("id").alias("subject"), F.col("root").alias("source")), "subject").join(components.select(F.col("id").alias("object"), F.col("root").alias("target")), "object")
    return ends.where("source <> target").groupBy("source", "predicate", "target").agg(F.count("*").alias("weight"), F.max("confidence").alias("confidence"), F.min("from_pos").alias("first_pos"))


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("root")).groupBy("root").agg(F.count("*").alias("degree"))


@dataclass
class Projection:
    """``nodes``: (root, node_type, members, merged_away, first_pos, label, degree), one row a component; ``edges``: both ends among
    the nodes; ``meta``: one row (total, merged_away, truncated) over the whole graph, before the cut."""

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame


def project(entities: DataFrame, assertions: DataFrame, names: DataFrame, h: hz.Horizon, node_types: list[str] | None = None, limit: int = 25_000) -> Projection:
    """The graph as of a horizon: components of some types (of all by default), the ``limit`` of highest degree, and their edges.

    Components and folded edges are written once, and the visible entities are read once.
    """
    seen = materialise(hz.asof_entities(entities, h))
    components = idn.identity_components(seen, assertions, h, written=True)
    folded = materialise(fold_edges(assertions, components, h))
    members = seen.join(components, "id")
    nodes = members.groupBy("root").agg(F.max(F.when(F.col("id") == F.col("root"), F.col("node_type"))).alias("node_type"), F.count("*").alias("members"), F.min("first_pos").alias("first_pos"))
    nodes = nodes if node_types is None else nodes.where(F.col("node_type").isin(node_types))
    ranked = materialise(nodes.join(node_degree(folded), "root", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("merged_away", F.col("members") - 1))
    meta = ranked.agg(F.count("*").alias("total"), F.coalesce(F.sum("merged_away"), F.lit(0)).alias("merged_away")).withColumn("truncated", F.col("total") > limit)
    kept = materialise(ranked.orderBy(F.desc("degree"), "first_pos", "root").limit(limit))
    # only components that stay need a name
    shown = idn.component_label(components.join(kept.select("root"), "root", "left_semi"), names, h)
    return Projection(kept.join(shown, "root"), induced_edges(folded, kept), meta)


def raw_degree(assertions: DataFrame, h: hz.Horizon) -> DataFrame:
    return hz.asof_assertions(assertions, h).select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def cap_nodes(entities: DataFrame, assertions: DataFrame, h: hz.Horizon, limit: int) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nodes of highest degree, and one row that says how many there were and whether some were cut."""
    ranked = hz.asof_entities(entities, h).join(raw_degree(assertions, h), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    meta = ranked.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > limit)
    return ranked.orderBy(F.desc("degree"), "first_pos", "id").limit(limit), meta


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes (column ``root``)."""
    return edges.join(nodes.select(F.col("root").alias("source")), "source", "left_semi").join(nodes.select(F.col("root").alias("target")), "target", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(node, other)`` for each end of each edge, once."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()


def neighbourhood(links: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(node, distance)`` up to ``hops`` from any seed, by frontier joins against what was not yet seen."""
    seen = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, hops + 1):
        reached = frontier.select("node").join(links, "node").select(F.col("other").alias("node")).distinct()
        frontier = materialise(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        seen = materialise(seen.unionByName(frontier))
        if not frontier.head(1):
            break
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """``(step, node, predicate, first_pos)`` of a shortest undirected path of at most ``most`` hops; of several the one least from the end on.

    A step tells by which relation, the first known, it was reached from the step before. No rows if there is no path or if
    start and end are the same. Frontiers stop at the end node.
    """
    if start == end:
        return edges.sparkSession.createDataFrame([], "step int, node string, predicate string, first_pos int")
    links = materialise(both_ways(edges))
    spark = links.sparkSession
    at = spark.createDataFrame([(start,)], "node string")
    levels, found = [at], False
    seen = at
    while not found and len(levels) <= most:
        reached = levels[-1].join(links, "node").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        levels.append(materialise(reached))
        seen = materialise(seen.union(levels[-1]))
        found = bool(levels[-1].where(F.col("node") == end).head(1))
        if not found and not levels[-1].head(1):
            break
    if not found:
        return spark.createDataFrame([], "step int, node string, predicate string, first_pos int")
    path = [end]
    for level in reversed(levels[:-1]):  # one row a step
        here = links.where(F.col("node") == path[-1]).select(F.col("other").alias("node")).join(level, "node")
        path.append(here.agg(F.min("node")).first()[0])
    path.reverse()
    steps = spark.createDataFrame([(i, n, path[i - 1] if i else None) for i, n in enumerate(path)], "step int, node string, back string")
    ways = [edges.select(F.col(a).alias("node"), F.col(b).alias("back"), F.struct("first_pos", "predicate").alias("way")) for a, b in (("source", "target"), ("target", "source"))]
    taken = ways[0].unionByName(ways[1]).join(F.broadcast(steps.select("node", "back")), ["node", "back"], "left_semi").groupBy("node", "back").agg(F.min("way").alias("way"))
    return steps.join(taken, ["node", "back"], "left").select("step", "node", "way.predicate", "way.first_pos")


def expand(links: DataFrame, degree: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Neighbours of the seeds that are no seeds, scored 1 / (1 + ln(1 + degree)), best first."""
    near = seeds.select("node").join(links, "node").select(F.col("other").alias("node")).distinct().join(seeds.select("node"), "node", "left_anti")
    scored = near.join(degree.withColumnRenamed("root", "node"), "node").select("node", F.round(1 / (1 + F.log1p("degree")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "node").limit(limit)


def isolated(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    ends = assertions.where("status = 'accepted'").select(F.explode(F.array("subject", "object")).alias("id"))
    return entities.where("status = 'accepted'").join(ends, "id", "left_anti")


def rank_cast(entities: DataFrame, assertions: DataFrame, h: hz.Horizon, types: list[str], limit: int) -> DataFrame:
    """Entities of some types by their visible facts, identities apart."""
    facts = hz.asof_assertions(assertions, h).where(F.col("predicate") != idn.IDENTITY).select(F.explode(F.array("subject", "object")).alias("id"))
    counted = facts.groupBy("id").agg(F.count("*").alias("facts"))
    return hz.asof_entities(entities, h).where(F.col("node_type").isin(types)).join(counted, "id").select("id", "first_pos", "facts").orderBy(F.desc("facts"), "id").limit(limit)
