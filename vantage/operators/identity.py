"""Identity: dated ``same_as`` edges fold entities into components, and a component shows its best name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.operators import horizon as hz
from vantage.operators.components import components_of_few, connected_components
from vantage.sources.shared import materialise

IDENTITY = "same_as"
UNNAMED = "?"
#: Identity edges up to which one task joins them; more are contracted in distributed rounds.
FEW_EDGES = 100_000


def identity_edges(entities: DataFrame, assertions: DataFrame, h: hz.Horizon) -> DataFrame:
    """Visible identity edges both of whose ends are visible entities."""
    seen = hz.asof_entities(entities, h).select("id")
    edges = hz.asof_assertions(assertions, h).where(F.col("predicate") == IDENTITY).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")


def identity_components(entities: DataFrame, assertions: DataFrame, h: hz.Horizon, written: bool = False) -> DataFrame:
    """``(id, root)`` of every visible entity; the root is the smallest id of its component.

    Only entities on an identity edge enter the iteration. Lowering the horizon unfolds what was folded later. The result
    is written once: all that is asked of one horizon shares it. So are the visible entities, unless ``entities`` is a
    ``written`` table itself.
    """
    entities = entities if written else materialise(hz.asof_entities(entities, h).select("id", "status", "first_pos"))
    edges = materialise(identity_edges(entities, assertions, h))
    few = edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    folded = components_of_few(edges) if few else connected_components(edges, materialise)
    return materialise(hz.asof_entities(entities, h).select("id").join(folded, "id", "left").select("id", F.coalesce("root", "id").alias("root")))


def component_label(components: DataFrame, names: DataFrame, h: hz.Horizon) -> DataFrame:
    """``(root, label)``: the best visible label among all members, or a placeholder."""
    shown = hz.asof(names, "revealed_pos", h).join(components.withColumnRenamed("id", "entity_id"), "entity_id")
    best = hz.first_by(shown, ["root"], [F.desc("precedence"), F.desc("revealed_pos"), F.asc("entity_id"), F.asc("label")])
    return components.select("root").distinct().join(best.select("root", "label"), "root", "left").select("root", F.coalesce("label", F.lit(UNNAMED)).alias("label"))


def label_history(components: DataFrame, names: DataFrame, h: hz.Horizon) -> DataFrame:
    """All visible labels of each component with their rank."""
    from pyspark.sql.window import Window

    shown = hz.asof(names, "revealed_pos", h).join(components.withColumnRenamed("id", "entity_id"), "entity_id")
    order = Window.partitionBy("root").orderBy(F.desc("precedence"), F.desc("revealed_pos"), "entity_id", "label")
    return shown.select("root", "entity_id", "label", "kind", F.row_number().over(order).alias("rank"))


def unnamed_figures(entities: DataFrame, names: DataFrame, assertions: DataFrame, pending: DataFrame) -> DataFrame:
    """Accepted actors that have a label but no true name, no identity edge and no pending card."""
    linked = assertions.where((F.col("predicate") == IDENTITY) & (F.col("status") == "accepted")).select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    actors = entities.where((F.col("status") == "accepted") & F.col("node_type").isin("character", "group"))
    named = names.where("kind = 'true_name' AND revealed_pos IS NOT NULL").select(F.col("entity_id").alias("id"))
    return (
        actors.join(names.select(F.col("entity_id").alias("id")), "id", "left_semi").join(named, "id", "left_anti").join(linked, "id", "left_anti")
        .join(pending.select(F.col("subject").alias("id")), "id", "left_anti")
    )


def capped_groups(entities: DataFrame, grouping, caps: dict[str, int], order: list) -> DataFrame:
    """The first rows of each group up to its cap, with their rank."""
    from pyspark.sql.window import Window

    ranked = entities.withColumn("grp", grouping).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return ranked.where(F.col("rank") <= cap[F.col("grp")])
