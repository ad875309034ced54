"""Views along the axis: timelines, what changed at a position, registers as of a horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import horizon as hz
from vantage.operators import identity as idn


def timeline(scenes: DataFrame, questions: DataFrame, h: hz.Horizon) -> DataFrame:
    """Scenes and questions in the order of their revelation, ties by recording."""
    a = hz.asof_scenes(scenes, h).select("id", F.lit("scene").alias("kind"), F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("pos"), "recorded")
    b = hz.asof(questions, "opened_pos", h).select("id", F.lit("question").alias("kind"), F.col("opened_pos").alias("pos"), "recorded")
    both = a.unionByName(b)
    # ranks within a position, then positions are counted: no window over all rows
    within = both.withColumn("k", F.row_number().over(Window.partitionBy("pos").orderBy("recorded", "kind", "id")))
    sizes = both.groupBy("pos").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(sizes.select("pos", F.coalesce("before", F.lit(0)).alias("before")), "pos").select("id", "kind", "pos", (F.col("before") + F.col("k")).alias("place"))


def describe_time(kind: Column, year: Column, years_ago: Column) -> Column:
    """The text of a tagged story time."""
    return (
        F.when((kind == "exact") & year.isNotNull(), F.concat(F.lit("in "), year.cast("string")))
        .when((kind == "approximate") & year.isNotNull(), F.concat(F.lit("around "), year.cast("string")))
        .when((kind == "relative") & years_ago.isNotNull(), F.concat(years_ago.cast("string"), F.lit(" years ago")))
        .otherwise("unknown")
    )


def learned_at(assertions: DataFrame, pos: int) -> DataFrame:
    return assertions.where((F.col("status") == "accepted") & (F.col("from_pos") == pos))


def refuted_at(assertions: DataFrame, pos: int) -> DataFrame:
    """Beliefs that close at ``pos``, as they read one position before."""
    return hz.asof_assertions(assertions, pos - 1).where(F.col("until_pos") == pos)


def with_end_labels(assertions: DataFrame, best: DataFrame) -> DataFrame:
    """Best labels of both ends, or the ids where there is none."""
    side = lambda end: best.select(F.col("entity_id").alias(end), F.col("label").alias(f"{end}_label"))
    out = assertions.join(side("subject"), "subject", "left").join(side("object"), "object", "left")
    return out.withColumn("subject_label", F.coalesce("subject_label", "subject")).withColumn("object_label", F.coalesce("object_label", "object"))


def chronology(scenes: DataFrame) -> DataFrame:
    """Scenes on the axis of the story: dated ones from the longest ago, then earlier ones, then the present."""
    place = F.when(F.col("years_ago").isNotNull(), "dated").when(F.col("flashback"), "earlier").otherwise("present")
    rank = F.when(F.col("years_ago").isNotNull(), 0).when(F.col("flashback"), 1).otherwise(2)
    return scenes.select("id", place.alias("placement"), rank.alias("rank"), F.coalesce(F.when(F.col("years_ago").isNotNull(), -F.col("years_ago")), F.coalesce("told_pos", "shown_pos", F.lit(0))).alias("sort_key"))


def arc_of(positions: DataFrame, arcs: DataFrame) -> DataFrame:
    """Each position's named range; a range without an end is open. ``arcs`` is a short fixed list."""
    return positions.join(F.broadcast(arcs), F.col("pos").between(F.col("arc_from"), F.coalesce("arc_to", F.lit(2147483647))), "left")


def last_known(register: DataFrame, h: hz.Horizon, column: str, key: str = "entity_id") -> DataFrame:
    """The last non-null value of a column at ``h``, by position and then by sequence."""
    seen = hz.asof(register, "pos", h).where(F.col(column).isNotNull())
    return seen.groupBy(key).agg(F.max_by(column, F.struct("pos", "seq")).alias(column), F.max("pos").alias("pos"))


def carried(register: DataFrame, key: str, column: str) -> DataFrame:
    """Each row with the last non-null value of a column up to it."""
    upto = Window.partitionBy(key).orderBy("pos", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return register.withColumn("carried", F.last(column, ignorenulls=True).over(upto))


def entries(occurrences: DataFrame) -> DataFrame:
    """Per entity and position: ``mentioned`` if only a stated mention and no stated appearance is there, else ``enters``."""
    flag = lambda kind: F.max(F.when((F.col("kind") == kind) & F.col("stated"), 1).otherwise(0))
    seen = occurrences.groupBy("entity_id", "pos").agg(flag("mention").alias("m"), flag("appearance").alias("a"))
    return seen.select("entity_id", "pos", F.when((F.col("m") == 1) & (F.col("a") == 0), "mentioned").otherwise("enters").alias("entry"))


def late_entries(occurrences: DataFrame) -> DataFrame:
    """First stated appearance of an entity that was mentioned before."""
    first = occurrences.where("stated").groupBy("entity_id").agg(F.min(F.when(F.col("kind") == "appearance", F.col("pos"))).alias("pos"), F.min(F.when(F.col("kind") == "mention", F.col("pos"))).alias("mentioned"))
    return first.where("mentioned < pos").select("entity_id", "pos", "mentioned")


def identity_reveals(assertions: DataFrame, names: DataFrame, h: hz.Horizon) -> DataFrame:
    """Identity edges whose two ends show different names at the position of the edge: the best and the worst of the pair."""
    edges = hz.asof_assertions(assertions, h).where(F.col("predicate") == idn.IDENTITY).select("id", "subject", "object", "from_pos")
    ends = edges.select("id", "from_pos", F.explode(F.array("subject", "object")).alias("entity_id"))
    shown = ends.join(names, "entity_id").where("revealed_pos <= from_pos")
    best = hz.first_by(shown, ["id", "entity_id"], hz.label_order())
    rank = F.struct("precedence", "revealed_pos", "label")
    pair = best.groupBy("id", "from_pos").agg(F.max_by("label", rank).alias("now"), F.min_by("label", rank).alias("was"), F.count("*").alias("n"))
    return pair.where("n = 2 AND now <> was").select("id", F.col("from_pos").alias("pos"), "now", "was")


def short_name_owner(best: DataFrame, entities: DataFrame) -> DataFrame:
    """The last word of a label where exactly one entity owns it; characters come before others."""
    short = F.element_at(F.split("label", " "), -1)
    owned = best.select("entity_id", short.alias("short")).join(entities.select(F.col("id").alias("entity_id"), (F.col("node_type") == "character").alias("person")), "entity_id")
    grouped = owned.groupBy("short").agg(F.sum(F.col("person").cast("int")).alias("people"), F.count("*").alias("n"), F.min(F.when(F.col("person"), F.col("entity_id"))).alias("p"), F.min("entity_id").alias("o"))
    return grouped.where("people = 1 OR (people = 0 AND n = 1)").select("short", F.coalesce("p", "o").alias("entity_id"))


def transcript(beats: DataFrame, at: str, order: list[str], text: str) -> DataFrame:
    """One text per position, lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return beats.groupBy(at).agg(F.array_join(F.transform(lines, lambda x: x["_t"]), "\n").alias("transcript"))


def component_sheet(assertions: DataFrame, named: DataFrame, names: DataFrame, evidence: DataFrame, h: hz.Horizon) -> DataFrame:
    """Each visible fact from both ends, by component: who, direction, the other end and its name, and all that shows the fact; then each visible name.

    ``named`` has (id, root, label). A fact inside a component, as its identities are, is told once, with the other member
    and no name for it. Facts without evidence have no quote and count 0. A fact takes root, name and evidence of its ends
    while it is one row; only then it becomes two. Names are rows of the direction ``name``: kind, bearer, name and position.
    """
    facts = hz.asof_assertions(assertions, h).select("id", "subject", "predicate", "object", "from_pos", "confidence")
    told = F.when(F.col("excerpt") != "", F.col("excerpt"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "id", "kind", "excerpt"))), "\n")
    quotes = evidence.groupBy(F.col("assertion_id").alias("_a")).agg(F.min(told).alias("quote"), F.count(told).alias("quotes"), listed.alias("evidence")).withColumnRenamed("_a", "id")
    end = lambda key: named.select(F.col("id").alias(key), F.struct("root", "label").alias(f"{key}_end"))
    told = facts.join(quotes, "id", "left").join(end("subject"), "subject").join(end("object"), "object")
    seen = lambda here, direction, other, label: F.struct(F.col(f"{here}.root").alias("root"), F.col(f"{here}.label").alias("label"), F.lit(direction).alias("direction"), F.col(other).alias("other"), label.alias("other_label"))
    both = F.array(seen("subject_end", "out", "object_end.root", F.col("object_end.label")), seen("object_end", "in", "subject_end.root", F.col("subject_end.label")))
    inside = F.array(seen("subject_end", "out", "object", F.lit(None).cast("string")))
    sides = told.withColumn("e", F.explode(F.when(F.col("subject_end.root") == F.col("object_end.root"), inside).otherwise(both)))
    sides = sides.select("e.root", "e.label", "e.direction", "predicate", "e.other", "e.other_label", "from_pos", "confidence", "id", "quote", F.coalesce("quotes", F.lit(0)).alias("quotes"), "evidence")
    shown = hz.asof(names, "revealed_pos", h).select(F.col("entity_id").alias("id"), F.col("kind").alias("predicate"), F.col("label").alias("other_label"), F.col("revealed_pos").alias("from_pos"))
    nothing = {c: F.lit(None).cast(sides.schema[c].dataType) for c in ("confidence", "quote", "evidence")}
    shown = shown.join(named, "id").withColumn("direction", F.lit("name")).withColumn("quotes", F.lit(0)).withColumns(nothing)
    return sides.unionByName(shown.withColumnRenamed("id", "other").withColumn("id", F.lit(None).cast("string")))


def profile_sections(sheet: DataFrame) -> DataFrame:
    """Facts of an entity by section and other end: first position, strongest confidence, number of facts, predicates in order."""
    section = F.when(F.col("predicate") == "located_at", "places").when(F.col("predicate").isin("owns", "gives"), "possessions").when(F.col("predicate") == idn.IDENTITY, "identity").otherwise("aims")
    roles = sheet.withColumn("section", section).groupBy("entity_id", "section", "other")
    return roles.agg(F.min("from_pos").alias("first_pos"), F.max("confidence").alias("confidence"), F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))


def entity_sheet(assertions: DataFrame, h: hz.Horizon) -> DataFrame:
    """Visible facts seen from either end."""
    seen = hz.asof_assertions(assertions, h)
    out = seen.select(F.col("subject").alias("entity_id"), "predicate", F.col("object").alias("other"), F.lit("out").alias("direction"), "from_pos", "confidence", "id")
    return out.unionByName(seen.select(F.col("object").alias("entity_id"), "predicate", F.col("subject").alias("other"), F.lit("in").alias("direction"), "from_pos", "confidence", "id"))
