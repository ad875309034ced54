"""Sources, sinks and transformations of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import horizon as hz
from vantage.operators import store as st
from vantage.operators import temporal as tm
from vantage.operators import validate as va
from vantage.plans.audits import DEALT, FILTERED, filtered, spread
from vantage.plans.catalog import H, query
from vantage.plans.identity import BEST, COMPONENTS
from vantage.sources import passages as ps
from vantage.sources.shared import shared_folder


@query("scan_tables", "SELECT 'entities' AS name, count(*) AS n FROM kg_entities UNION ALL SELECT 'assertions', count(*) FROM kg_assertions UNION ALL SELECT 'names', count(*) FROM kg_names UNION ALL SELECT 'scenes', count(*) FROM kg_scenes")
def scan_tables(v):
    return st.counted({"entities": v.entities, "assertions": v.assertions, "names": v.names, "scenes": v.scenes})


@query("scan_candidates", "SELECT kind, array_to_string(list_sort(string_split(lower(label), ' ')), ' ') AS signature, count(*) AS n, min(revealed_pos) AS first_pos FROM kg_names GROUP BY 1, 2")
def scan_candidates(v):
    sig = F.array_join(F.array_sort(F.split(F.lower("label"), " ")), " ")
    return v.names.groupBy("kind", sig.alias("signature")).agg(F.count("*").alias("n"), F.min("revealed_pos").alias("first_pos"))


@query("html_to_paragraphs", r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<table[^>]*>.*?</table>', '', 'g') AS h FROM pages),
    p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?s)<(?:p|li)>(.*?)</(?:p|li)>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS ps FROM c)
    SELECT page_id, generate_subscripts(ps, 1) - 1 AS ord, unnest(ps) AS paragraph FROM p""")
def html_to_paragraphs(v):
    return v.pages.select("page_id", F.posexplode(st.paragraphs(F.col("html"))).alias("ord", "paragraph"))


@query("decode_entities")
def decode_entities(v):
    return v.pages.select("page_id", F.sha2(ps.decode_entities(F.col("html")), 256).alias("decoded_sha256"))


@query("split_passages")
def split_passages(v):
    return ps.split_passages(v.documents, "doc_id", "text")


@query("upsert_documents", "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN concat(text, ' new') ELSE text END) AS fingerprint, doc_id % 3 = 0 AS changed FROM documents")
def upsert_documents(v):
    stored = v.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.lit(False).alias("changed"))
    arrived = v.documents.select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" new"))).otherwise(F.col("text")), 256).alias("fingerprint"))
    fresh = arrived.join(stored.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti").withColumn("changed", F.lit(True))
    return st.upsert(stored, fresh, ["doc_id"])


@query("import_guards", "SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) < 120 THEN 'too short' WHEN length(text) > 120000 THEN 'too long' WHEN lang NOT IN ('fr', 'en') THEN 'other language' ELSE 'accepted' END AS reason FROM documents")
def import_guards(v):
    reason = va.first_reason((F.col("text").isNull() | (F.length(F.trim("text")) < 120), "too short"), (F.length("text") > 120000, "too long"), (~F.col("lang").isin("fr", "en"), "other language"), (F.lit(True), "accepted"))
    return v.documents.select("doc_id", reason.alias("reason"))


@query("upsert_embeddings", "SELECT kind, label, arg_max(vec_id, vec_id) AS vec_id FROM kg_vectors GROUP BY kind, label")
def upsert_embeddings(v):
    return st.latest(v.vectors, ["kind", "label"], ["vec_id"]).select("kind", "label", "vec_id")


@query("embedding_documents", f"WITH best AS ({BEST}) SELECT a.id, concat(coalesce(s.label, a.subject), ' ', a.predicate, ' ', coalesce(o.label, a.object)) AS doc FROM kg_assertions a LEFT JOIN best s ON s.entity_id = a.subject LEFT JOIN best o ON o.entity_id = a.object WHERE a.status = 'accepted' AND a.from_pos = $h")
def embedding_documents(v):
    told = tm.with_end_labels(tm.learned_at(v.assertions, H), hz.best_label(v.names, H))
    return told.select("id", F.concat_ws(" ", "subject_label", "predicate", "object_label").alias("doc"))


#: What tells the tenant of a row: user n owns its actions and runs, and all that is told of figure n.
OWNER = {"actions": "user_id", "steps": "run_id", "entities": "id", "names": "entity_id", "assertions": "subject", "occurrences": "entity_id", "attachments": "entity_id", "registry": "entity_id", "proposals": "subject"}
OWNED = " UNION ALL ".join(f"SELECT '{t}' AS name, regexp_extract(CAST({c} AS VARCHAR), '^(?:run|c)?([0-9]+)(?:-[0-9]+)?$', 1) AS tenant FROM kg_{t}" for t, c in OWNER.items())


def owned(v):
    tables = {t: (getattr(v, t), F.col(c).cast("string")) for t, c in OWNER.items()}
    lead = {"user_id": r"^(\d+)$", "run_id": r"^run(\d+)-"}
    return {t: df.withColumn("tenant", F.regexp_extract(key, lead.get(OWNER[t], r"^c(\d+)$"), 1)) for t, (df, key) in tables.items()}


@query("export_bundle", f"SELECT t.name, count(o.tenant) AS n FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in OWNER)}) AS t(name) LEFT JOIN ({OWNED}) o ON o.name = t.name AND o.tenant = '7' GROUP BY t.name")
def export_bundle(v):
    return st.export(owned(v), "7", shared_folder(v.spark))


@query("purge_tenant", f"SELECT name, count(*) FILTER (tenant NOT IN ('7', '8')) AS kept, count(*) FILTER (tenant IN ('7', '8')) AS removed FROM ({OWNED}) GROUP BY name")
def purge_tenant(v):
    return st.purge(owned(v), v.spark.createDataFrame([("7",), ("8",)], "tenant string"), shared_folder(v.spark))


@query("delete_position", "SELECT id, from_pos FROM kg_assertions WHERE from_pos <> $h")
def delete_position(v):
    gone = v.spark.createDataFrame([(H,)], "from_pos int")
    return v.assertions.join(F.broadcast(gone), "from_pos", "left_anti").select("id", "from_pos")


@query("deletion_preview", "SELECT 'assertions' AS name, count(*) AS n FROM kg_assertions WHERE from_pos = $h UNION ALL SELECT 'entities', count(*) FROM kg_entities WHERE first_pos = $h UNION ALL SELECT 'occurrences', count(*) FROM kg_occurrences WHERE pos = $h")
def deletion_preview(v):
    return st.counted({"assertions": v.assertions.where(F.col("from_pos") == H), "entities": v.entities.where(F.col("first_pos") == H), "occurrences": v.occurrences.where(F.col("pos") == H)})


DECIDED = f"SELECT f.id, f.category, CASE WHEN d.action IS NULL THEN 'pending' WHEN d.action = 'reject' THEN 'rejected' WHEN f.reason IS NOT NULL THEN concat('failed: ', f.reason) ELSE 'published' END AS outcome FROM ({FILTERED}) f LEFT JOIN (SELECT id, min(action) AS action FROM kg_decisions GROUP BY id) d ON d.id = f.id"


@query("publish_decisions", DECIDED)
def publish_decisions(v):
    """Cards by what becomes of them: only clean, accepted ones are published; each failure keeps its reason."""
    d = v.decisions.groupBy("id").agg(F.min("action").alias("action"))
    outcome = va.first_reason((F.col("action").isNull(), "pending"), (F.col("action") == "reject", "rejected"))
    outcome = F.coalesce(outcome, F.when(F.col("reason").isNotNull(), F.concat(F.lit("failed: "), "reason")), F.lit("published"))
    return filtered(v).join(d, "id", "left").select("id", "category", outcome.alias("outcome"))


@query("reuse_decisions", "SELECT id FROM kg_proposals WHERE id NOT IN (SELECT id FROM kg_decisions)")
def reuse_decisions(v):
    return v.proposals.join(v.decisions.select("id"), "id", "left_anti").select("id")


@query("card_priority", "SELECT id, CASE category WHEN 'entity' THEN 30 WHEN 'assertion' THEN 20 ELSE 10 END + CASE WHEN confidence < 0.5 THEN 5 ELSE 0 END AS priority FROM kg_proposals")
def card_priority(v):
    return v.proposals.select("id", st.card_priority(F.col("category"), F.col("confidence")).alias("priority"))


@query("merge_label_precedence", "SELECT n.entity_id, n.label, CASE WHEN n.kind = 'true_name' THEN n.precedence ELSE least(n.precedence, m.top - 1) END AS precedence FROM kg_names n JOIN (SELECT entity_id, max(precedence) AS top FROM kg_names GROUP BY entity_id) m USING (entity_id)")
def merge_label_precedence(v):
    top = v.names.groupBy("entity_id").agg(F.max("precedence").alias("top"))
    return v.names.join(top, "entity_id").select("entity_id", "label", F.when(F.col("kind") == "true_name", F.col("precedence")).otherwise(F.least("precedence", F.col("top") - 1)).alias("precedence"))


@query("record_presence", "SELECT DISTINCT entity_id, pos, kind FROM (SELECT entity_id, pos, kind FROM kg_occurrences WHERE stated UNION ALL SELECT subject, from_pos, 'mention' FROM kg_assertions WHERE status = 'accepted' AND predicate = 'located_at')")
def record_presence(v):
    told = v.assertions.where("status = 'accepted' AND predicate = 'located_at'").select(F.col("subject").alias("entity_id"), F.col("from_pos").alias("pos"), F.lit("mention").alias("kind"))
    return v.occurrences.where("stated").select("entity_id", "pos", "kind").unionByName(told).dropDuplicates()


@query("link_cast", "SELECT DISTINCT o.entity_id, s.id AS scene, CASE WHEN e.node_type = 'place' THEN 'located_at' ELSE 'participates_in' END AS predicate FROM kg_occurrences o JOIN kg_scenes s ON coalesce(s.told_pos, s.shown_pos, 0) = o.pos JOIN kg_entities e ON e.id = o.entity_id WHERE o.stated AND o.kind = 'appearance'")
def link_cast(v):
    """Both sides are distinct before they meet, so the links, many for each position, are neither sorted nor shuffled."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(DEALT)).alias("part")
    s = v.scenes.select(F.col("id").alias("scene"), F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("pos")).distinct()
    kind = F.when(F.col("node_type") == "place", "located_at").otherwise("participates_in").alias("predicate")
    cast = v.occurrences.where("stated AND kind = 'appearance'").select("entity_id", "pos").join(v.entities.select(F.col("id").alias("entity_id"), kind), "entity_id").distinct()
    dealt = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    at = ["pos", "part"]
    return spread(cast.withColumn("part", part("entity_id")), *at).join(spread(dealt, *at).hint("shuffle_hash"), at).select("entity_id", "scene", "predicate")


@query("apply_question_verdict", "SELECT q.id, least(q.resolved_pos, min(p.pos)) AS resolved_pos FROM kg_questions q JOIN kg_proposals p ON p.pos = q.opened_pos AND p.category = 'mystery' GROUP BY q.id, q.resolved_pos")
def apply_question_verdict(v):
    p = v.proposals.where("category = 'mystery'").groupBy(F.col("pos").alias("opened_pos")).agg(F.min("pos").alias("p"))
    return v.questions.join(p, "opened_pos").select("id", F.least("resolved_pos", "p").alias("resolved_pos"))


@query("open_when_reviewed", "SELECT pos FROM kg_positions WHERE pos NOT IN (SELECT pos FROM kg_proposals WHERE status = 'proposed' AND confidence > 0.9)")
def open_when_reviewed(v):
    return v.positions.join(v.proposals.where("status = 'proposed' AND confidence > 0.9").select("pos"), "pos", "left_anti").select("pos")


REVISED = "SELECT id, object, CASE WHEN id IN (SELECT id FROM kg_assertions WHERE id[1] = 'i') THEN concat(id, '''') END AS superseded_by, false AS locked FROM kg_assertions WHERE predicate IN ('same_as', 'seeks') UNION ALL SELECT concat(id, ''''), 'c1', NULL, true FROM kg_assertions WHERE id[1] = 'i'"


@query("revise_assertion", REVISED)
def revise_assertion(v):
    rows = v.assertions.where("predicate IN ('same_as', 'seeks')")
    return st.revise(rows, rows.where("id LIKE 'i%'").select("id", F.lit("c1").alias("new_object"))).select("id", "object", "superseded_by", "locked")


@query("retract_assertion", "SELECT id, CASE WHEN from_pos = $h THEN 'rejected' ELSE status END AS status FROM kg_assertions")
def retract_assertion(v):
    return v.assertions.select("id", F.when(F.col("from_pos") == H, "rejected").otherwise(F.col("status")).alias("status"))


@query("repoint_assertion", "SELECT id, CASE WHEN object = 'n3' THEN 'n4' ELSE object END AS object FROM kg_assertions WHERE predicate = 'located_at'")
def repoint_assertion(v):
    return v.assertions.where("predicate = 'located_at'").select("id", F.when(F.col("object") == "n3", "n4").otherwise(F.col("object")).alias("object"))


@query("rename_label", """WITH r AS (SELECT DISTINCT label, concat('Name ', right(label, 1)) AS t FROM kg_names WHERE kind = 'true_name' AND label LIKE 'Name 1%'),
    u AS (SELECT entity_id, label, precedence, revealed_pos FROM kg_names WHERE label NOT IN (SELECT label FROM r) UNION ALL SELECT n.entity_id, r.t, n.precedence, n.revealed_pos FROM kg_names n JOIN r USING (label) UNION ALL SELECT n.entity_id, n.label, 5, n.revealed_pos FROM kg_names n JOIN r USING (label))
    SELECT entity_id, label, max(precedence) AS precedence, min(revealed_pos) AS revealed_pos FROM u GROUP BY entity_id, label""")
def rename_label(v):
    renames = v.names.where("kind = 'true_name' AND label LIKE 'Name 1%'").select("label").distinct().withColumn("to", F.concat(F.lit("Name "), F.right("label", F.lit(1))))
    return st.rename(v.names, renames)


@query("rewrite_prose", r"SELECT id, regexp_replace(regexp_replace(summary, '(^|[^\p{L}\p{N}])tion([^\p{L}\p{N}]|$)', '\1TION\2', 'g'), '(^|[^\p{L}\p{N}])tion([^\p{L}\p{N}]|$)', '\1TION\2', 'g') AS summary FROM kg_scenes")
def rewrite_prose(v):
    return v.scenes.select("id", F.regexp_replace("summary", r"(?<![\p{L}\p{N}])tion(?![\p{L}\p{N}])", "TION").alias("summary"))


@query("upsert_glossary", "SELECT source_term, arg_max(target_term, (decided_pos, seq)) AS target_term FROM kg_glossary GROUP BY source_term")
def upsert_glossary(v):
    return st.latest(v.glossary, ["source_term"], ["decided_pos", "seq"]).select("source_term", "target_term")


@query("retype_component", COMPONENTS + " SELECT r.id, CASE WHEN r.root IN (SELECT root FROM root WHERE id IN ('c8', 'c100')) THEN 'group' ELSE e.node_type END AS node_type FROM root r JOIN vis e ON e.id = r.id")
def retype_component(v):
    from vantage.operators import identity as idn
    from vantage.sources.shared import materialise

    comp = materialise(idn.identity_components(v.entities, v.assertions, H))
    hit = comp.where("id IN ('c8', 'c100')").select("root").distinct().withColumn("hit", F.lit(True))
    typed = comp.join(hit, "root", "left").join(v.entities.select("id", "node_type"), "id")
    return typed.select("id", F.when(F.col("hit"), "group").otherwise(F.col("node_type")).alias("node_type"))


@query("bulk_retype", "SELECT e.id, CASE WHEN e.node_type = 'object' AND bool_or(n.label LIKE '%n') THEN 'place' ELSE e.node_type END AS node_type FROM kg_entities e LEFT JOIN kg_names n ON n.entity_id = e.id GROUP BY e.id, e.node_type")
def bulk_retype(v):
    ends = v.names.groupBy(F.col("entity_id").alias("id")).agg(F.bool_or(F.col("label").endswith("n")).alias("hit"))
    return v.entities.join(ends, "id", "left").select("id", F.when((F.col("node_type") == "object") & F.col("hit"), "place").otherwise(F.col("node_type")).alias("node_type"))


@query("reopen_items", "SELECT p.id, CASE WHEN status IN ('rejected', 'deferred') AND run_id = 'run3' THEN 'proposed' ELSE status END AS status, CASE WHEN status IN ('rejected', 'deferred') AND run_id = 'run3' THEN NULL ELSE (SELECT min(action) FROM kg_decisions d WHERE d.id = p.id) END AS action FROM kg_proposals p")
def reopen_items(v):
    return st.reopen(v.proposals, v.decisions, F.col("run_id") == "run3")


@query("backfill_scenes", f"WITH best AS ({BEST}) SELECT e.id, coalesce(b.label, '?') AS summary, e.first_pos FROM kg_entities e LEFT JOIN best b ON b.entity_id = e.id WHERE e.node_type = 'group' AND NOT EXISTS (SELECT 1 FROM kg_occurrences o WHERE o.entity_id = e.id AND o.stated)")
def backfill_scenes(v):
    bare = v.entities.where("node_type = 'group'").join(v.occurrences.where("stated").select(F.col("entity_id").alias("id")), "id", "left_anti")
    return bare.join(hz.best_label(v.names, H).select(F.col("entity_id").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", F.lit("?")).alias("summary"), "first_pos")


@query("backfill_questions", "SELECT e.id, e.first_pos FROM kg_entities e WHERE e.node_type = 'place' AND NOT EXISTS (SELECT 1 FROM kg_questions q WHERE q.opened_pos = e.first_pos AND q.state = 'resolved')")
def backfill_questions(v):
    return v.entities.where("node_type = 'place'").join(v.questions.where("state = 'resolved'").select(F.col("opened_pos").alias("first_pos")), "first_pos", "left_anti").select("id", "first_pos")


@query("backfill_presence", "SELECT DISTINCT subject AS entity_id, pos FROM kg_proposals WHERE status = 'accepted' EXCEPT SELECT entity_id, pos FROM kg_occurrences WHERE stated")
def backfill_presence(v):
    said = v.proposals.where("status = 'accepted'").select(F.col("subject").alias("entity_id"), "pos").distinct()
    return said.join(v.occurrences.where("stated").select("entity_id", "pos"), ["entity_id", "pos"], "left_anti")


@query("reject_bad_resolutions", "SELECT id, CASE WHEN resolved_pos <= opened_pos THEN NULL ELSE resolved_pos END AS resolved_pos FROM kg_questions")
def reject_bad_resolutions(v):
    return v.questions.select("id", F.when(F.col("resolved_pos") > F.col("opened_pos"), F.col("resolved_pos")).alias("resolved_pos"))


@query("propagate_position", "SELECT id, CASE WHEN from_pos >= 30 THEN from_pos + 1 ELSE from_pos END AS from_pos FROM kg_assertions")
def propagate_position(v):
    moved = v.positions.select(F.col("pos").alias("from_pos"), F.when(F.col("pos") >= 30, F.col("pos") + 1).otherwise(F.col("pos")).alias("to"))
    return v.assertions.join(moved, "from_pos", "left").select("id", F.coalesce("to", F.when(F.col("from_pos") >= 30, F.col("from_pos") + 1).otherwise(F.col("from_pos"))).alias("from_pos"))


@query("undo_from_log", "SELECT user_id, arg_min(action, (ts, event_id)) AS action FROM kg_actions GROUP BY user_id")
def undo_from_log(v):
    return v.actions.groupBy("user_id").agg(F.min_by("action", F.struct("ts", "event_id")).alias("action"))


@query("resolve_evidence", "SELECT e.id, s.id AS passage, concat('p', coalesce(s.told_pos, s.shown_pos, 0), 'c', row_number() OVER (PARTITION BY coalesce(s.told_pos, s.shown_pos, 0) ORDER BY s.recorded)) AS ref FROM kg_scenes s LEFT JOIN kg_evidence e ON e.passage_id = s.id")
def resolve_evidence(v):
    from pyspark.sql.window import Window

    at = v.scenes.select(F.col("id").alias("passage_id"), F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("at"), "recorded")
    nth = F.row_number().over(Window.partitionBy("at").orderBy("recorded"))
    ref = at.withColumn("ref", F.concat(F.lit("p"), F.col("at").cast("string"), F.lit("c"), nth.cast("string")))
    return ref.join(v.evidence.select("id", "passage_id"), "passage_id", "left").select("id", F.col("passage_id").alias("passage"), "ref")
