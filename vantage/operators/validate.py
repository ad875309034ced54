"""Checks of proposals and of the store: reasons instead of exceptions, rows instead of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators import identity as idn
from vantage.operators import text as tx
from vantage.sources.shared import materialise

# Predicates that refute, that tell a death, that admit one answer, and whose subject must be alive.
REFUTING, DEATH = ["refutes", "contradicts"], "dies_at"
SINGLE = ["dies_at", "parent_of", "child_of", "belongs_to_species", "leads"]
ACTIONS = ["fights", "speaks_to", "meets", "travels_to", "travels_from", "captures", "protects", "creates", "destroys", "promises", "seeks", "kills", "injures", "knocks_out", "gives", "receives", "eats"]

#: Ends of proposals up to which every task holds them, so that facts that none meets are never shuffled.
FEW_ENDS = 200_000


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds, null if none does."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(checks):
        out = F.when(condition, F.lit(reason)).otherwise(out)
    return out


def all_reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))


def with_types(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    side = lambda end: entities.select(F.col("id").alias(end), F.col("node_type").alias(f"{end}_type"))
    return assertions.join(side("subject"), "subject", "left").join(side("object"), "object", "left")


def check_types(assertions: DataFrame, entities: DataFrame, ontology: DataFrame) -> DataFrame:
    """``fits`` and ``reversed_fits`` of each assertion by the ontology, a short fixed list."""
    o = F.broadcast(ontology.select("predicate", F.split("subject_types", " ").alias("st"), F.split("object_types", " ").alias("ot")))
    typed = with_types(assertions, entities).join(o, "predicate", "left")
    fits = F.array_contains("st", F.col("subject_type")) & F.array_contains("ot", F.col("object_type"))
    turned = F.array_contains("st", F.col("object_type")) & F.array_contains("ot", F.col("subject_type"))
    return typed.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("reversed_fits", F.coalesce(turned, F.lit(False)))


def _ended_at(facts: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """Facts whose ``columns`` are among ``ends`` (end), taken out before facts travel; all facts if the ends are not few."""
    ends = materialise(ends.distinct())
    if ends.limit(FEW_ENDS + 1).count() > FEW_ENDS:
        return facts
    for c in columns:
        facts = facts.join(F.broadcast(ends.withColumnRenamed("end", c)), c, "left_semi")  # its size was checked
    return facts


def conflicts(proposed: DataFrame, accepted: DataFrame) -> DataFrame:
    """``(id, old, kind, since)``: proposals against what was accepted before their position and still holds there.

    ``proposed`` has (id, subject, predicate, object, pos); ``accepted`` (id, subject, predicate, object, from_pos, until_pos,
    status). A refutation meets only the facts that join its two ends, in either order, and nothing else. An action meets each
    death of its subject. A predicate that admits one answer meets another answer, compared after normalising; empty and null
    ends say nothing. Two equi-joins on what must be shared, over the facts that a proposal can meet: refutations by their
    ends, the others by subject and the predicate that each looks for.
    """
    new = materialise(proposed.where(F.col("predicate").isin(REFUTING + ACTIONS + SINGLE) & F.col("subject").isNotNull()).select("id", "subject", "predicate", "object", "pos"))
    old = accepted.where("status = 'accepted'").select(F.col("id").alias("old"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), "from_pos", "until_pos")
    before = (F.col("from_pos") < F.col("pos")) & (F.col("until_pos").isNull() | (F.col("until_pos") > F.col("pos")))
    refuting = new.where(F.col("predicate").isin(REFUTING) & F.col("object").isNotNull())
    joined = _ended_at(old.where("s IS NOT NULL AND o IS NOT NULL"), refuting.select(F.explode(F.array("subject", "object")).alias("end")), "o", "s")
    refuted = refuting.select("id", "pos", *unordered()).join(joined.select("old", "from_pos", "until_pos", *unordered("s", "o")), ["a", "b"]).where(before)
    acts = F.col("predicate").isin(ACTIONS)
    told = new.where(F.col("predicate").isin(ACTIONS + SINGLE)).select("id", "pos", F.col("subject").alias("s"), F.when(acts, DEATH).otherwise(F.col("predicate")).alias("p"), acts.alias("acts"), tx.normalise(F.col("object")).alias("x"))
    known = _ended_at(old.where(F.col("p").isin(SINGLE)), told.select(F.col("s").alias("end")), "s").withColumn("y", tx.normalise(F.col("o")))
    other = (F.col("x") != "") & (F.col("y") != "") & (F.col("x") != F.col("y"))
    met = told.join(known, ["s", "p"]).where(before & (F.col("acts") | other))
    rows = lambda df, kind: df.select("id", "old", kind.alias("kind"), F.col("from_pos").alias("since"))
    return rows(refuted, F.lit("explicit refutation")).union(rows(met, F.when(F.col("acts"), "action after death").otherwise("another answer")))


def unordered(a: str = "subject", b: str = "object") -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def identities(assertions: DataFrame) -> DataFrame:
    return assertions.where((F.col("predicate") == idn.IDENTITY) & (F.col("status") == "accepted"))


def merge_findings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """What to do with each fingerprint: insert, keep, resolve, or leave alone what is no longer open."""
    both = stored.select("fingerprint", F.col("status").alias("was")).join(found.select("fingerprint", F.lit(True).alias("seen")), "fingerprint", "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("was") != "open", "leave").when(F.col("seen"), "keep").otherwise("resolve")
    return both.select("fingerprint", action.alias("action"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Keys that were deleted, and keys of which a column that may not change did, with those columns."""
    a = before.select(key, *[F.col(c).alias(f"_{c}") for c in fixed], F.lit(True).alias("_a"))
    b = after.select(key, *fixed, F.lit(True).alias("_b"))
    both = a.join(b, key, "full").where("_a")
    moved = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fixed]))
    return both.select(key, F.when(F.col("_b").isNull(), F.array(F.lit("deleted"))).otherwise(moved).alias("changed")).where(F.size("changed") > 0)
