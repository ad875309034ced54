"""Identity and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.plans.catalog import H, query
from vantage.sources.shared import materialise

COMPONENTS = """
    WITH RECURSIVE vis AS (SELECT id, node_type, first_pos FROM kg_entities WHERE status = 'accepted' AND first_pos <= $h),
    open AS (SELECT * FROM kg_assertions WHERE status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)),
    ident AS (SELECT subject AS a, object AS b FROM open WHERE predicate = 'same_as' AND subject IN (SELECT id FROM vis) AND object IN (SELECT id FROM vis)),
    pairs AS (SELECT a, b FROM ident UNION SELECT b, a FROM ident),
    reach AS (SELECT id AS node, id AS seen FROM vis UNION SELECT reach.node, pairs.b FROM reach JOIN pairs ON pairs.a = reach.seen),
    root AS (SELECT node AS id, min(seen) AS root FROM reach GROUP BY node)"""


def components(v):
    return idn.identity_components(v.entities, v.assertions, H)


@query("identity_components", COMPONENTS + " SELECT id, root FROM root")
def identity_components(v):
    return components(v)


@query("component_of", COMPONENTS + " SELECT id FROM root WHERE root = (SELECT root FROM root WHERE id = 'c8')")
def component_of(v):
    comp = materialise(components(v))
    return comp.join(comp.where("id = 'c8'").select("root"), "root", "left_semi").select("id")


BEST = "SELECT entity_id, label, kind, precedence, revealed_pos FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY precedence DESC, revealed_pos DESC, label) AS r FROM kg_names WHERE revealed_pos <= $h) WHERE r = 1"


@query("best_label", BEST)
def best_label(v):
    return hz.best_label(v.names, H).select("entity_id", "label", "kind", "precedence", "revealed_pos")


@query("component_label", COMPONENTS + """ SELECT r.root, coalesce(max(l.label), '?') AS label FROM (SELECT DISTINCT root FROM root) r LEFT JOIN
    (SELECT root, label FROM (SELECT x.root, n.label, row_number() OVER (PARTITION BY x.root ORDER BY n.precedence DESC, n.revealed_pos DESC, n.entity_id, n.label) AS k FROM kg_names n JOIN root x ON x.id = n.entity_id WHERE n.revealed_pos <= $h) WHERE k = 1) l USING (root) GROUP BY r.root""")
def component_label(v):
    return idn.component_label(materialise(components(v)), v.names, H)


@query("label_history", COMPONENTS + """ SELECT x.root, n.entity_id, n.label, n.kind, row_number() OVER (PARTITION BY x.root ORDER BY n.precedence DESC, n.revealed_pos DESC, n.entity_id, n.label) AS rank
    FROM kg_names n JOIN root x ON x.id = n.entity_id WHERE n.revealed_pos <= $h""")
def label_history(v):
    return idn.label_history(components(v), v.names, H)


@query("previous_label", """WITH c AS (SELECT DISTINCT entity_id, revealed_pos AS pos FROM kg_names WHERE revealed_pos IS NOT NULL)
    SELECT entity_id, pos, label AS previous FROM (SELECT c.entity_id, c.pos, n.label, row_number() OVER (PARTITION BY c.entity_id, c.pos ORDER BY n.precedence DESC, n.revealed_pos DESC, n.label) AS r
    FROM c JOIN kg_names n ON n.entity_id = c.entity_id AND n.revealed_pos < c.pos) WHERE r = 1""")
def previous_label(v):
    return hz.previous_label(v.names, v.names.where("revealed_pos IS NOT NULL").select("entity_id", F.col("revealed_pos").alias("pos")))


@query("unnamed_figures", """SELECT id FROM kg_entities e WHERE status = 'accepted' AND node_type IN ('character', 'group') AND EXISTS (SELECT 1 FROM kg_names n WHERE n.entity_id = e.id)
    AND NOT EXISTS (SELECT 1 FROM kg_names n WHERE n.entity_id = e.id AND kind = 'true_name' AND revealed_pos IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM kg_assertions a WHERE predicate = 'same_as' AND status = 'accepted' AND (subject = e.id OR object = e.id))
    AND NOT EXISTS (SELECT 1 FROM kg_proposals p WHERE p.subject = e.id AND p.status = 'proposed')""")
def unnamed_figures(v):
    return idn.unnamed_figures(v.entities, v.names, v.assertions, v.proposals.where("status = 'proposed'")).select("id")


@query("known_entities", """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM kg_assertions WHERE status = 'accepted' UNION ALL SELECT object FROM kg_assertions WHERE status = 'accepted') GROUP BY id),
    g AS (SELECT e.id, e.first_pos, coalesce(d.degree, 0) AS degree, CASE WHEN NOT EXISTS (SELECT 1 FROM kg_names n WHERE n.entity_id = e.id AND kind = 'true_name' AND revealed_pos <= $h) THEN 'unnamed' WHEN e.node_type = 'place' THEN 'question' ELSE 'other' END AS grp
          FROM kg_entities e LEFT JOIN d USING (id) WHERE e.status = 'accepted' AND e.first_pos <= $h),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY first_pos DESC, degree DESC, id) AS rank FROM g)
    SELECT id, grp, rank FROM r WHERE rank <= CASE grp WHEN 'unnamed' THEN 50 WHEN 'question' THEN 150 ELSE 250 END""")
def known_entities(v):
    degree = v.assertions.where("status = 'accepted'").select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    named = hz.asof(v.names.where("kind = 'true_name'"), "revealed_pos", H).select(F.col("entity_id").alias("id")).distinct().withColumn("named", F.lit(True))
    known = hz.asof_entities(v.entities, H).join(degree, "id", "left").join(named, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    grouping = F.when(F.col("named").isNull(), "unnamed").when(F.col("node_type") == "place", "question").otherwise("other")
    return idn.capped_groups(known, grouping, {"unnamed": 50, "question": 150, "other": 250}, [F.desc("first_pos"), F.desc("degree"), F.asc("id")]).select("id", "grp", "rank")


@query("attach_types", """WITH b AS (SELECT entity_id, label FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY precedence DESC, revealed_pos DESC, label) AS r FROM kg_names WHERE revealed_pos <= $h) WHERE r = 1)
    SELECT b.entity_id, b.label, coalesce(e.node_type, 'passage') AS result_type FROM b LEFT JOIN kg_entities e ON e.id = b.entity_id AND e.status = 'accepted'""")
def attach_types(v):
    types = v.entities.where("status = 'accepted'").select(F.col("id").alias("entity_id"), "node_type")
    return hz.best_label(v.names, H).select("entity_id", "label").join(types, "entity_id", "left").select("entity_id", "label", F.coalesce("node_type", F.lit("passage")).alias("result_type"))
