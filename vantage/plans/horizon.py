"""Horizon views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import horizon as hz
from vantage.operators import text as tx
from vantage.plans.catalog import H, query


@query("horizon_default", """
    WITH g AS (SELECT * FROM (VALUES (NULL), (-3.0E0), (12.7E0), (40.0E0), (9999.0E0)) AS t(given)), m AS (SELECT max(pos) AS latest FROM kg_positions WHERE status = 'published')
    SELECT given, CAST(CASE WHEN given IS NULL THEN latest ELSE least(greatest(floor(given), 0), latest) END AS INT) AS horizon FROM g, m""")
def horizon_default(v):
    latest = v.positions.where("status = 'published'").agg(F.max("pos").alias("latest"))
    given = latest.select("latest", F.explode(F.array(F.lit(None).cast("double"), *map(F.lit, (-3.0, 12.7, 40.0, 9999.0)))).alias("given"))
    return given.select("given", hz.clamp_horizon(F.col("given"), F.col("latest")).cast("int").alias("horizon"))


@query("asof_assertions", "SELECT id, subject, predicate, object, from_pos, until_pos FROM kg_assertions WHERE status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)")
def asof_assertions(v):
    return hz.asof_assertions(v.assertions, H).select("id", "subject", "predicate", "object", "from_pos", "until_pos")


@query("asof_entities", "SELECT id, node_type, first_pos FROM kg_entities WHERE status = 'accepted' AND first_pos <= $h")
def asof_entities(v):
    return hz.asof_entities(v.entities, H).select("id", "node_type", "first_pos")


@query("asof_labels", "SELECT * FROM kg_names WHERE revealed_pos IS NOT NULL AND revealed_pos <= $h")
def asof_labels(v):
    return hz.asof(v.names, "revealed_pos", H)


@query("asof_positioned", "SELECT entity_id, pos, kind, stated FROM kg_occurrences WHERE pos <= $h")
def asof_positioned(v):
    return hz.asof(v.occurrences, "pos", H)


@query("asof_scenes", "SELECT id, told_pos, shown_pos FROM kg_scenes WHERE coalesce(told_pos, shown_pos, 0) <= $h")
def asof_scenes(v):
    return hz.asof_scenes(v.scenes, H).select("id", "told_pos", "shown_pos")


@query("asof_questions", "SELECT id, opened_pos FROM kg_questions WHERE opened_pos <= $h")
def asof_questions(v):
    return hz.asof(v.questions, "opened_pos", H).select("id", "opened_pos")


@query("asof_evidence", """SELECT e.id, e.assertion_id FROM kg_evidence e WHERE EXISTS (SELECT 1 FROM kg_assertions a WHERE a.id = e.assertion_id AND a.status = 'accepted'
       AND a.from_pos <= $h AND (a.until_pos IS NULL OR a.until_pos > $h))""")
def asof_evidence(v):
    return hz.asof_evidence(v.evidence, v.assertions, H).select("id", "assertion_id")


@query("asof_attachments", "SELECT image, entity_id, revealed_pos FROM kg_attachments WHERE revealed_pos IS NOT NULL AND revealed_pos <= $h AND (era <> 'later' OR $h >= 60)")
def asof_attachments(v):
    return hz.asof_attachments(v.attachments, H, later_from=60).select("image", "entity_id", "revealed_pos")


@query("asof_glossary", "SELECT source_term, target_term, decided_pos FROM kg_glossary WHERE decided_pos <= $h")
def asof_glossary(v):
    return hz.asof(v.glossary, "decided_pos", H).select("source_term", "target_term", "decided_pos")


@query("tenant_filter", "SELECT event_id, action FROM kg_actions WHERE user_id = 7")
def tenant_filter(v):
    return v.actions.where(F.col("user_id") == 7).select("event_id", "action")


@query("tellable_resolution", "SELECT id, CASE WHEN resolved_pos <= $h THEN resolved_pos END AS resolved_pos, CASE WHEN resolved_pos <= $h THEN 'resolved' ELSE 'open' END AS state FROM kg_questions WHERE opened_pos <= $h")
def tellable_resolution(v):
    known = hz.tellable(F.col("resolved_pos"), H)
    return hz.asof(v.questions, "opened_pos", H).select("id", known.alias("resolved_pos"), F.when(known.isNull(), "open").otherwise("resolved").alias("state"))


@query("best_quote", r"""
    WITH l AS (SELECT pos, trim(unnest(string_split(text, chr(10))), ' ') AS quote FROM kg_passages),
         g AS (SELECT * FROM l WHERE length(quote) BETWEEN 40 AND 240 AND regexp_matches(quote, '^\p{Lu}.*[.!?]$')),
         r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY regexp_matches(quote, '["“«]') DESC, length(quote) DESC, quote) AS n FROM g)
    SELECT pos, quote FROM r WHERE n = 1""")
def best_quote(v):
    return hz.best_quote(v.passages)


@query("fragment_lookup", "SELECT id FROM kg_scenes WHERE lower(summary) LIKE '%th%' AND lower(summary) LIKE '%ing%' AND lower(summary) LIKE '%tion%'")
def fragment_lookup(v):
    return v.scenes.where(tx.contains_all(F.lower("summary"), ["th", "ing", "tion"])).select("id")
