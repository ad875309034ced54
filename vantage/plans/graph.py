"""Graph projection and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import graph as gr
from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.plans.catalog import H, query
from vantage.plans.identity import COMPONENTS
from vantage.sources.shared import materialise

FOLDED = COMPONENTS + """,
    fold AS (SELECT s.root AS source, a.predicate, t.root AS target, count(*) AS weight, max(a.confidence) AS confidence, min(a.from_pos) AS first_pos
             FROM open a JOIN root s ON s.id = a.subject JOIN root t ON t.id = a.object WHERE a.predicate <> 'same_as' AND s.root <> t.root GROUP BY ALL),
    deg AS (SELECT root, count(*) AS degree FROM (SELECT source AS root FROM fold UNION ALL SELECT target FROM fold) GROUP BY root),
    link AS (SELECT source AS node, target AS other FROM fold UNION SELECT target, source FROM fold)"""
NAMED = """,
    lab AS (SELECT root, label FROM (SELECT r.root, n.label, row_number() OVER (PARTITION BY r.root ORDER BY n.precedence DESC, n.revealed_pos DESC, n.entity_id, n.label) AS k
            FROM kg_names n JOIN root r ON r.id = n.entity_id WHERE n.revealed_pos <= $h) WHERE k = 1)"""


def folded(v):
    return gr.fold_edges(v.assertions, idn.identity_components(v.entities, v.assertions, H), H)


def links(v):
    return materialise(gr.both_ways(folded(v)))


@query("project_graph", FOLDED + NAMED + """
    SELECT r.root, max(CASE WHEN e.id = r.root THEN e.node_type END) AS node_type, count(*) AS members, count(*) - 1 AS merged_away, min(e.first_pos) AS first_pos,
           coalesce(any_value(l.label), '?') AS label, coalesce(any_value(d.degree), 0) AS degree, count(*) OVER () > 25000 AS truncated
    FROM vis e JOIN root r USING (id) LEFT JOIN lab l ON l.root = r.root LEFT JOIN deg d ON d.root = r.root GROUP BY r.root ORDER BY degree DESC, first_pos, root LIMIT 25000""")
def project_graph(v):
    graph = gr.project(v.entities, v.assertions, v.names, H)
    nodes = graph.nodes.select("root", "node_type", "members", "merged_away", "first_pos", "label", "degree")
    return nodes.crossJoin(F.broadcast(graph.meta.select("truncated")))  # one row


@query("project_edges", FOLDED + """, n AS (SELECT r.root, max(CASE WHEN e.id = r.root THEN e.node_type END) AS node_type, min(e.first_pos) AS first_pos, coalesce(any_value(d.degree), 0) AS degree
    FROM vis e JOIN root r USING (id) LEFT JOIN deg d ON d.root = r.root GROUP BY r.root),
    k AS (SELECT root FROM n WHERE node_type IN ('character', 'group', 'place') ORDER BY degree DESC, first_pos, root LIMIT 25000)
    SELECT f.* FROM fold f WHERE f.source IN (SELECT root FROM k) AND f.target IN (SELECT root FROM k)""")
def project_edges(v):
    """The edges that a projection of some node types shows."""
    return gr.project(v.entities, v.assertions, v.names, H, ["character", "group", "place"]).edges


@query("fold_edges", FOLDED + " SELECT * FROM fold")
def fold_edges(v):
    return folded(v)


@query("node_degree", FOLDED + " SELECT * FROM deg")
def node_degree(v):
    return gr.node_degree(folded(v))


CAPPED = """WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM kg_assertions WHERE status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)
    UNION ALL SELECT object FROM kg_assertions WHERE status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)) GROUP BY id),
    e AS (SELECT id, first_pos, coalesce(degree, 0) AS degree FROM kg_entities LEFT JOIN d USING (id) WHERE status = 'accepted' AND first_pos <= $h)"""


@query("cap_nodes", CAPPED + " SELECT id, degree, (SELECT count(*) FROM e) AS total, (SELECT count(*) > 25000 FROM e) AS truncated FROM e ORDER BY degree DESC, first_pos, id LIMIT 25000")
def cap_nodes(v):
    kept, meta = gr.cap_nodes(v.entities, v.assertions, H, 25_000)
    return kept.select("id", "degree").crossJoin(F.broadcast(meta))  # one row of totals


@query("induced_edges", FOLDED + """ SELECT f.* FROM fold f WHERE f.source IN (SELECT id FROM vis WHERE node_type IN ('character', 'object')) AND f.target IN (SELECT id FROM vis WHERE node_type IN ('character', 'object'))""")
def induced_edges(v):
    kept = hz.asof_entities(v.entities, H).where("node_type IN ('character', 'object')").select(F.col("id").alias("root"))
    return gr.induced_edges(folded(v), kept)


@query("adjacency", FOLDED + " SELECT node, count(*) AS n, string_agg(other, ',' ORDER BY other) AS neighbours FROM link GROUP BY node")
def adjacency(v):
    pairs = gr.both_ways(folded(v))
    return pairs.groupBy("node").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))


@query("neighbourhood", FOLDED + """,
    hop AS (SELECT 'c1' AS node, 0 AS distance UNION SELECT link.other, distance + 1 FROM hop JOIN link ON link.node = hop.node WHERE distance < 2)
    SELECT node, min(distance) AS distance FROM hop GROUP BY node""")
def neighbourhood(v):
    return gr.neighbourhood(links(v), v.spark.createDataFrame([("c1",)], "node string"), 2)


PATH = FOLDED + """,
    hop AS (SELECT 'c1' AS node, 0 AS d UNION SELECT link.other, d + 1 FROM hop JOIN link ON link.node = hop.node WHERE d < 6),
    dist AS (SELECT node, min(d) AS d FROM hop GROUP BY node),
    back AS (SELECT node, d FROM dist WHERE node = 'c500'
             UNION ALL SELECT p.node, p.d FROM (SELECT b.d AS bd, min(q.node) AS node, b.d - 1 AS d FROM back b JOIN link l ON l.node = b.node JOIN dist q ON q.node = l.other AND q.d = b.d - 1 GROUP BY b.d) p)
    SELECT CAST(b.d AS INT) AS step, b.node, arg_min(w.predicate, (w.first_pos, w.predicate)) AS predicate, min(w.first_pos) AS first_pos
    FROM back b LEFT JOIN back a ON a.d = b.d - 1 LEFT JOIN (SELECT source AS u, target AS w, predicate, first_pos FROM fold UNION ALL SELECT target, source, predicate, first_pos FROM fold) w ON w.u = b.node AND w.w = a.node
    GROUP BY b.d, b.node"""


@query("shortest_path", PATH)
def shortest_path(v):
    return gr.shortest_path(materialise(folded(v)), "c1", "c500")


@query("expand_neighbours", FOLDED + """ SELECT node, round(1 / (1 + ln(1 + degree)), 6) AS score FROM (SELECT DISTINCT other AS node FROM link WHERE node IN ('c1', 'c5')) n JOIN deg ON deg.root = n.node
    WHERE node NOT IN ('c1', 'c5') ORDER BY score DESC, node LIMIT 25""")
def expand_neighbours(v):
    edges = materialise(folded(v))
    return gr.expand(gr.both_ways(edges), gr.node_degree(edges), v.spark.createDataFrame([("c1",), ("c5",)], "node string"), 25)


@query("graph_table", FOLDED + " SELECT root, degree FROM deg ORDER BY degree DESC, root LIMIT 200")
def graph_table(v):
    return gr.node_degree(folded(v)).orderBy(F.desc("degree"), "root").limit(200)


@query("isolated_entities", """SELECT id FROM kg_entities WHERE status = 'accepted' AND id NOT IN (SELECT subject FROM kg_assertions WHERE status = 'accepted' UNION SELECT object FROM kg_assertions WHERE status = 'accepted')""")
def isolated_entities(v):
    return gr.isolated(v.entities, v.assertions).select("id")


CAST = """WITH f AS (SELECT id, count(*) AS facts FROM (SELECT subject AS id FROM kg_assertions WHERE predicate <> 'same_as' AND status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)
    UNION ALL SELECT object FROM kg_assertions WHERE predicate <> 'same_as' AND status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h)) GROUP BY id)
    SELECT id, first_pos, facts FROM kg_entities JOIN f USING (id) WHERE status = 'accepted' AND first_pos <= $h AND node_type IN ('character', 'group') ORDER BY facts DESC, id LIMIT 60"""


@query("rank_cast", CAST)
def rank_cast(v):
    return gr.rank_cast(v.entities, v.assertions, H, ["character", "group"], 60)


@query("assemble_cast", FOLDED + NAMED + """, f AS (SELECT id, count(*) AS facts FROM (SELECT subject AS id FROM open WHERE predicate <> 'same_as' UNION ALL SELECT object FROM open WHERE predicate <> 'same_as') GROUP BY id),
    top AS (SELECT id, first_pos, facts FROM vis JOIN f USING (id) WHERE node_type IN ('character', 'group') ORDER BY facts DESC, id LIMIT 60)
    SELECT r.root, CAST(sum(facts) AS BIGINT) AS facts, min(first_pos) AS first_pos, any_value(coalesce(l.label, '?')) AS label FROM top JOIN root r USING (id) LEFT JOIN lab l ON l.root = r.root GROUP BY r.root""")
def assemble_cast(v):
    comp = materialise(idn.identity_components(v.entities, v.assertions, H))
    top = gr.rank_cast(v.entities, v.assertions, H, ["character", "group"], 60)
    cast = top.join(comp, "id").groupBy("root").agg(F.sum("facts").alias("facts"), F.min("first_pos").alias("first_pos"))
    return cast.join(idn.component_label(comp, v.names, H), "root").select("root", "facts", "first_pos", "label")


@query("fold_by_person", """WITH k AS (SELECT entity_id, label, kind, array_to_string(list_sort(string_split(lower(label), ' ')), ' ') AS person, length(label) AS n FROM kg_names WHERE kind IN ('alias', 'true_name') AND revealed_pos <= $h)
    SELECT person, entity_id AS kept, label, n_members FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY kind = 'true_name' DESC, n DESC, entity_id, label) AS r, count(*) OVER (PARTITION BY person) AS n_members FROM k) WHERE r = 1""")
def fold_by_person(v):
    named = hz.asof(v.names.where("kind IN ('alias', 'true_name')"), "revealed_pos", H)
    person = F.array_join(F.array_sort(F.split(F.lower("label"), " ")), " ")
    keyed = named.select("entity_id", "label", "kind", person.alias("person"))
    best = hz.first_by(keyed, ["person"], [F.desc(F.col("kind") == "true_name"), F.desc(F.length("label")), F.asc("entity_id"), F.asc("label")])
    return best.join(keyed.groupBy("person").agg(F.count("*").alias("n_members")), "person").select("person", F.col("entity_id").alias("kept"), "label", "n_members")
