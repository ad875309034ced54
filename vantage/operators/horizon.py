"""Reads as of a horizon: nothing learned after it is visible, and an unset horizon shows nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Horizon = int | None


def _bound(h: Horizon) -> int:
    return -1 if h is None else h


def clamp_horizon(given: Column, latest: Column) -> Column:
    """A given horizon floored and held within 0 and the latest position; null means the latest."""
    return F.when(given.isNull(), latest).otherwise(F.least(F.greatest(F.floor(given).cast("int"), F.lit(0)), latest))


def asof_assertions(assertions: DataFrame, h: Horizon) -> DataFrame:
    """Accepted assertions with ``from_pos <= h`` that are still open: the interval excludes its end."""
    return assertions.where((F.col("status") == "accepted") & (F.col("from_pos") <= _bound(h)) & (F.col("until_pos").isNull() | (F.col("until_pos") > _bound(h))))


def asof_entities(entities: DataFrame, h: Horizon) -> DataFrame:
    return entities.where((F.col("status") == "accepted") & (F.col("first_pos") <= _bound(h)))


def asof(table: DataFrame, position: str | Column, h: Horizon) -> DataFrame:
    """Rows placed at ``h`` or before; a null position is never shown."""
    at = F.col(position) if isinstance(position, str) else position
    return table.where(at <= _bound(h))


def asof_scenes(scenes: DataFrame, h: Horizon) -> DataFrame:
    """Scenes by where they are told, else shown; a scene placed nowhere counts as position 0."""
    return asof(scenes, F.coalesce("told_pos", "shown_pos", F.lit(0)), h)


def asof_evidence(evidence: DataFrame, assertions: DataFrame, h: Horizon) -> DataFrame:
    return evidence.join(asof_assertions(assertions, h).select(F.col("id").alias("assertion_id")), "assertion_id", "left_semi")


def asof_attachments(attachments: DataFrame, h: Horizon, later_from: int) -> DataFrame:
    """Revealed attachments; those of the later era only from ``later_from`` on."""
    shown = asof(attachments, "revealed_pos", h)
    return shown if _bound(h) >= later_from else shown.where("era <> 'later'")


def tellable(resolved: Column, h: Horizon) -> Column:
    """The position of a resolution, null while it lies beyond the horizon."""
    return F.when(resolved <= _bound(h), resolved)


def first_by(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def label_order() -> list[Column]:
    return [F.desc("precedence"), F.desc_nulls_first("revealed_pos"), F.asc("label")]


def best_label(names: DataFrame, h: Horizon) -> DataFrame:
    """``(entity_id, label, kind, precedence, revealed_pos)``: highest precedence, then latest revealed, then by the label."""
    return first_by(asof(names, "revealed_pos", h), ["entity_id"], label_order())


def previous_label(names: DataFrame, changes: DataFrame) -> DataFrame:
    """For each ``(entity_id, pos)`` the best label revealed strictly before ``pos``, if there is one."""
    earlier = changes.select("entity_id", "pos").distinct().join(names.where("revealed_pos IS NOT NULL"), "entity_id").where("revealed_pos < pos")
    return first_by(earlier, ["entity_id", "pos"], label_order()).select("entity_id", "pos", F.col("label").alias("previous"))


def best_quote(passages: DataFrame) -> DataFrame:
    """One sentence-shaped line of 40 to 240 characters for each position: dialogue first, then the longest, then by text."""
    lines = passages.select("pos", F.explode(F.split("text", "\n")).alias("line")).select("pos", F.trim("line").alias("quote")).where(F.length("quote").between(40, 240) & F.col("quote").rlike(r"^\p{Lu}.*[.!?]$"))
    talk = F.col("quote").rlike("[\"“«]")
    return first_by(lines, ["pos"], [F.desc(talk), F.desc(F.length("quote")), F.asc("quote")])
