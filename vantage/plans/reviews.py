"""Folds, second readings and the findings that verdicts give."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import folds as fo
from vantage.operators import horizon as hz
from vantage.operators import text as tx
from vantage.operators import validate as va
from vantage.plans.catalog import H, query
from vantage.plans.text import norm


def placed(v):
    return v.scenes.select("id", F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("pos"), F.col("recorded").alias("place"), tx.content_tokens(F.col("summary")).alias("words"), tx.capitalised(F.col("summary")).alias("names"))


@query("one_entry_per_scene")
def one_entry_per_scene(v):
    return fo.keep_first(placed(v)).where("kept").select("id", "pos")


@query("dedupe_beats")
def dedupe_beats(v):
    return fo.keep_first(placed(v)).select("id", "pos", "kept")


@query("audit_duplicate_scenes")
def audit_duplicate_scenes(v):
    return fo.keep_first(placed(v)).where("NOT kept").select("id", "pos", "twin_of")


@query("split_on_names")
def split_on_names(v):
    return v.scenes.select("id", F.explode(fo.name_spans(F.col("summary"), ["the", "le", "der", "tion", "que la"])).alias("s")).select("id", "s.piece", "s.name")


LOOPED = """WITH RECURSIVE e AS (SELECT id, least(subject, object) AS a, greatest(subject, object) AS b, from_pos FROM kg_assertions WHERE predicate = 'same_as' AND status = 'accepted'),
    b AS (SELECT id, from_pos, a AS x, b AS y FROM e UNION ALL SELECT id, from_pos, b, a FROM e),
    r AS (SELECT id AS edge, a AS node FROM e UNION SELECT r.edge, b.y FROM r JOIN e q ON q.id = r.edge JOIN b ON b.x = r.node AND (b.from_pos, b.id) < (q.from_pos, q.id))
    SELECT e.id FROM e JOIN r ON r.edge = e.id AND r.node = e.b"""


@query("audit_looped_identity", LOOPED)
def audit_looped_identity(v):
    """Identity edges that close a cycle in the order of date and id: those outside the least spanning forest."""
    edges = va.identities(v.assertions).select("id", F.least("subject", "object").alias("src"), F.greatest("subject", "object").alias("dst"), "from_pos")
    forest = fo.spanning_forest(edges, lambda: [F.col("from_pos"), F.col("id")])
    return edges.join(forest.select("id"), "id", "left_anti").select("id")


@query("audit_verbose_label", "SELECT entity_id, label FROM kg_names WHERE length(label) - length(replace(label, ' ', '')) >= 2 OR regexp_matches(label, '[,;:!?#]')")
def audit_verbose_label(v):
    blanks = F.length("label") - F.length(F.replace("label", F.lit(" "), F.lit("")))
    return v.names.where((blanks >= 2) | F.col("label").rlike("[,;:!?#]")).select("entity_id", "label")


@query("question_findings", "SELECT id, CASE WHEN resolved_pos < opened_pos THEN 'too early' WHEN resolved_pos > 60 THEN 'too late' WHEN state = 'resolved' AND swept_pos IS NULL THEN 'unwritten' END AS finding FROM kg_questions")
def question_findings(v):
    r = F.col("resolved_pos")
    return v.questions.select("id", va.first_reason((r < F.col("opened_pos"), "too early"), (r > 60, "too late"), ((F.col("state") == "resolved") & F.col("swept_pos").isNull(), "unwritten")).alias("finding"))


@query("resolving_scene", "SELECT q.id, arg_min(s.id, (coalesce(s.told_pos, s.shown_pos, 0), s.recorded)) AS scene FROM kg_questions q JOIN kg_scenes s ON s.recorded // 100 = q.recorded // 100 WHERE coalesce(s.told_pos, s.shown_pos, 0) > q.opened_pos GROUP BY q.id")
def resolving_scene(v):
    s = v.scenes.select(F.col("id").alias("scene"), F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("at"), F.col("recorded").alias("rec"), F.floor(F.col("recorded") / 100).alias("k"))
    q = v.questions.select("id", "opened_pos", F.floor(F.col("recorded") / 100).alias("k"))
    return q.join(s, "k").where("at > opened_pos").groupBy("id").agg(F.min_by("scene", F.struct("at", "rec")).alias("scene"))


@query("recompute_question", "SELECT q.id, least(q.resolved_pos, min(coalesce(s.told_pos, s.shown_pos, 0))) AS resolved_pos FROM kg_questions q JOIN kg_scenes s ON s.recorded // 100 = q.recorded // 100 WHERE coalesce(s.told_pos, s.shown_pos, 0) > q.opened_pos GROUP BY q.id, q.resolved_pos")
def recompute_question(v):
    s = v.scenes.select(F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("at"), F.floor(F.col("recorded") / 100).alias("k"))
    q = v.questions.withColumn("k", F.floor(F.col("recorded") / 100))
    return q.join(s, "k").where("at > opened_pos").groupBy("id", "resolved_pos").agg(F.min("at").alias("m")).select("id", F.least("resolved_pos", "m").alias("resolved_pos"))


#: Replies to a second reading, one line each: card, verdict, quote.
REPLY = "SELECT id, subject, object, confidence, concat(id, ' | ', CASE WHEN seq % 3 = 0 THEN 'same' ELSE 'other' END, ' | ', substring(summary, 5, 30)) AS line, summary FROM kg_proposals"


def replies(v):
    line = F.concat(F.col("id"), F.lit(" | "), F.when(F.col("seq") % 3 == 0, "same").otherwise("other"), F.lit(" | "), F.substring("summary", 5, 30))
    parts = F.split(line, r"\|", 3)
    quote = tx.normalise(parts[2])
    return v.proposals.select("id", "subject", "object", "pos", F.trim(parts[1]).alias("verdict"), quote.alias("quote"), F.contains(tx.normalise(F.col("summary")), quote).alias("held"))


PARSED = f"SELECT p.id, p.subject, p.object, p.pos, CASE WHEN p.seq % 3 = 0 THEN 'same' ELSE 'other' END AS verdict, {norm('substring(p.summary, 5, 30)')} AS quote, contains({norm('p.summary')}, {norm('substring(p.summary, 5, 30)')}) AS held FROM kg_proposals p"


@query("reread_findings", f"SELECT id, verdict FROM ({PARSED}) WHERE held AND length(quote) >= 24")
def reread_findings(v):
    return replies(v).where("held AND length(quote) >= 24").select("id", "verdict")


@query("provenance_findings", f"SELECT id, CASE WHEN NOT held THEN 'not found' WHEN length(quote) < 24 THEN 'too short' ELSE 'quoted' END AS provenance FROM ({PARSED})")
def provenance_findings(v):
    return replies(v).select("id", va.first_reason((~F.col("held"), "not found"), (F.length("quote") < 24, "too short"), (F.lit(True), "quoted")).alias("provenance"))


@query("identity_gap_findings", f"SELECT f.id, greatest(f.pos, s.first_pos, o.first_pos) AS pos FROM ({PARSED}) f JOIN kg_entities s ON s.id = f.subject JOIN kg_entities o ON o.id = f.object WHERE f.verdict = 'same' AND f.held AND NOT EXISTS (SELECT 1 FROM kg_assertions i WHERE i.predicate = 'same_as' AND least(i.subject, i.object) = least(f.subject, f.object) AND greatest(i.subject, i.object) = greatest(f.subject, f.object))")
def identity_gap_findings(v):
    """Pairs that a verified reply calls the same and no identity joins, dated where all of it is known."""
    first = lambda end: v.entities.select(F.col("id").alias(end), F.col("first_pos").alias(f"{end}_first"))
    said = replies(v).where("verdict = 'same' AND held").join(first("subject"), "subject").join(first("object"), "object")
    linked = v.assertions.where("predicate = 'same_as'").select(*va.unordered())
    return said.withColumn("a", F.least("subject", "object")).withColumn("b", F.greatest("subject", "object")).join(linked, ["a", "b"], "left_anti").select("id", F.greatest("pos", "subject_first", "object_first").alias("pos"))


@query("identity_verdicts", f"SELECT i.id, min(f.verdict) AS verdict FROM kg_assertions i JOIN ({PARSED}) f ON f.subject = i.subject WHERE i.predicate = 'same_as' AND i.status = 'accepted' AND f.verdict <> 'same' GROUP BY i.id")
def identity_verdicts(v):
    doubt = replies(v).where("verdict <> 'same'").select("subject", "verdict")
    return va.identities(v.assertions).join(doubt, "subject").groupBy("id").agg(F.min("verdict").alias("verdict"))


@query("twin_findings", f"SELECT pos, count(*) AS twins, max(length(quote)) AS longest FROM ({PARSED}) WHERE verdict = 'same' AND held GROUP BY pos")
def twin_findings(v):
    return replies(v).where("verdict = 'same' AND held").groupBy("pos").agg(F.count("*").alias("twins"), F.max(F.length("quote")).alias("longest"))


@query("apply_findings", "SELECT e.id, CASE WHEN e.status = 'accepted' AND min(o.pos) > e.first_pos THEN min(o.pos) ELSE e.first_pos END AS first_pos, coalesce(e.status = 'accepted' AND min(o.pos) > e.first_pos, false) AS applied FROM kg_entities e LEFT JOIN kg_occurrences o ON o.entity_id = e.id AND o.stated GROUP BY e.id, e.status, e.first_pos")
def apply_findings(v):
    """Late entrances applied: an accepted entity moves to where it is first written; others are no-ops."""
    written = v.occurrences.where("stated").groupBy(F.col("entity_id").alias("id")).agg(F.min("pos").alias("w"))
    moves = F.coalesce((F.col("status") == "accepted") & (F.col("w") > F.col("first_pos")), F.lit(False))
    return v.entities.join(written, "id", "left").select("id", F.when(moves, F.col("w")).otherwise(F.col("first_pos")).alias("first_pos"), moves.alias("applied"))


@query("identify_entities", "SELECT p.id, CASE WHEN p.subject = p.object THEN 'one entity' WHEN s.id IS NULL OR o.id IS NULL THEN 'unknown entity' WHEN p.pos < greatest(s.first_pos, o.first_pos) THEN 'too early' ELSE 'joined' END AS outcome, greatest(s.first_pos, o.first_pos) AS earliest FROM kg_proposals p LEFT JOIN kg_entities s ON s.id = p.subject LEFT JOIN kg_entities o ON o.id = p.object WHERE p.predicate = 'same_as'")
def identify_entities(v):
    first = lambda end: v.entities.select(F.col("id").alias(end), F.col("first_pos").alias(f"{end}_first"))
    asked = v.proposals.where("predicate = 'same_as'").join(first("subject"), "subject", "left").join(first("object"), "object", "left")
    earliest = F.greatest("subject_first", "object_first")
    unknown = F.col("subject_first").isNull() | F.col("object_first").isNull()
    return asked.select("id", va.first_reason((F.col("subject") == F.col("object"), "one entity"), (unknown, "unknown entity"), (F.col("pos") < earliest, "too early"), (F.lit(True), "joined")).alias("outcome"), earliest.alias("earliest"))


@query("reanchor", "SELECT a.id, min(p.id) AS proposal FROM kg_assertions a JOIN kg_proposals p ON p.subject = a.subject AND p.predicate = a.predicate WHERE a.status = 'accepted' AND a.id NOT IN (SELECT assertion_id FROM kg_evidence) GROUP BY a.id")
def reanchor(v):
    bare = v.assertions.where("status = 'accepted'").join(v.evidence.select(F.col("assertion_id").alias("id")), "id", "left_anti")
    cards = v.proposals.select("subject", "predicate", F.col("id").alias("card"))
    return bare.join(cards, ["subject", "predicate"]).groupBy("id").agg(F.min("card").alias("proposal"))


@query("latest_names_at_many_horizons", "SELECT p.pos, count(DISTINCT n.entity_id) AS named FROM kg_positions p JOIN kg_names n ON n.revealed_pos <= p.pos GROUP BY p.pos")
def latest_names_at_many_horizons(v):
    """All horizons in one plan: first reveals counted by position, then summed along the axis."""
    from pyspark.sql.window import Window

    first = v.names.where("revealed_pos IS NOT NULL").groupBy("entity_id").agg(F.min("revealed_pos").alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))
    axis = v.positions.select("pos").join(first, "pos", "full").withColumn("named", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return axis.join(v.positions.select("pos"), "pos", "left_semi").where("named > 0").select("pos", "named")
