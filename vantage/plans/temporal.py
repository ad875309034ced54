"""Temporal views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.operators import temporal as tm
from vantage.operators import text as tx
from vantage.plans.catalog import H, query
from vantage.plans.graph import NAMED
from vantage.plans.identity import BEST, COMPONENTS
from vantage.sources.shared import materialise

BEST_CTE = f"WITH best AS ({BEST})"
OPEN = "(status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h))"


@query("timeline", """WITH t AS (SELECT id, 'scene' AS kind, coalesce(told_pos, shown_pos, 0) AS pos, recorded FROM kg_scenes WHERE coalesce(told_pos, shown_pos, 0) <= $h
    UNION ALL SELECT id, 'question', opened_pos, recorded FROM kg_questions WHERE opened_pos <= $h) SELECT id, kind, pos, row_number() OVER (ORDER BY pos, recorded, kind, id) AS place FROM t""")
def timeline(v):
    return tm.timeline(v.scenes, v.questions, H)


@query("describe_story_time", """SELECT id, CASE WHEN time_kind = 'exact' AND time_year IS NOT NULL THEN 'in ' || time_year WHEN time_kind = 'approximate' AND time_year IS NOT NULL THEN 'around ' || time_year
    WHEN time_kind = 'relative' AND years_ago IS NOT NULL THEN years_ago || ' years ago' ELSE 'unknown' END AS story_time FROM kg_scenes""")
def describe_story_time(v):
    return v.scenes.select("id", tm.describe_time(F.col("time_kind"), F.col("time_year"), F.col("years_ago")).alias("story_time"))


@query("delta_entities", BEST_CTE + " SELECT e.id, e.node_type, coalesce(b.label, '?') AS label FROM kg_entities e LEFT JOIN best b ON b.entity_id = e.id WHERE e.status = 'accepted' AND e.first_pos = $h")
def delta_entities(v):
    fresh = v.entities.where((F.col("status") == "accepted") & (F.col("first_pos") == H))
    return fresh.join(hz.best_label(v.names, H).select(F.col("entity_id").alias("id"), "label"), "id", "left").select("id", "node_type", F.coalesce("label", F.lit("?")).alias("label"))


@query("delta_facts", BEST_CTE + """ SELECT a.id, a.predicate, coalesce(s.label, a.subject) AS subject_label, coalesce(o.label, a.object) AS object_label
    FROM kg_assertions a LEFT JOIN best s ON s.entity_id = a.subject LEFT JOIN best o ON o.entity_id = a.object WHERE a.status = 'accepted' AND a.from_pos = $h""")
def delta_facts(v):
    return tm.with_end_labels(tm.learned_at(v.assertions, H), hz.best_label(v.names, H)).select("id", "predicate", "subject_label", "object_label")


REFUTED = "status = 'accepted' AND until_pos = $h AND from_pos <= $h - 1"


@query("delta_refuted", f"SELECT id, subject, predicate, object, from_pos FROM kg_assertions WHERE {REFUTED}")
def delta_refuted(v):
    return tm.refuted_at(v.assertions, H).select("id", "subject", "predicate", "object", "from_pos")


@query("delta_names", """WITH c AS (SELECT entity_id, label, kind FROM kg_names WHERE revealed_pos = $h),
    p AS (SELECT entity_id, label AS previous FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY precedence DESC, revealed_pos DESC, label) AS r FROM kg_names WHERE revealed_pos < $h) WHERE r = 1)
    SELECT c.*, p.previous FROM c LEFT JOIN p USING (entity_id)""")
def delta_names(v):
    now = v.names.where(F.col("revealed_pos") == H).select("entity_id", "label", "kind", F.lit(H).alias("pos"))
    return now.join(hz.previous_label(v.names, now), ["entity_id", "pos"], "left").select("entity_id", "label", "kind", "previous")


@query("delta_questions", "SELECT id, question FROM kg_questions WHERE opened_pos = $h")
def delta_questions(v):
    return v.questions.where(F.col("opened_pos") == H).select("id", "question")


@query("chronology", """SELECT id, CASE WHEN years_ago IS NOT NULL THEN 'dated' WHEN flashback THEN 'earlier' ELSE 'present' END AS placement, CASE WHEN years_ago IS NOT NULL THEN 0 WHEN flashback THEN 1 ELSE 2 END AS rank,
    CASE WHEN years_ago IS NOT NULL THEN -years_ago ELSE coalesce(told_pos, shown_pos, 0) END AS sort_key FROM kg_scenes""")
def chronology(v):
    return tm.chronology(v.scenes)


ARCS = [(f"arc {i + 1}", 1 + 8 * i, 8 * i + 8 if i < 9 else None) for i in range(10)]


@query("arc_of", "WITH a AS (SELECT concat('arc ', i + 1) AS arc, 1 + 8 * i AS f, CASE WHEN i < 9 THEN 8 * i + 8 END AS t FROM range(10) r(i)) SELECT pos, arc FROM kg_positions LEFT JOIN a ON pos BETWEEN f AND coalesce(t, 2147483647)")
def arc_of(v):
    return tm.arc_of(v.positions, v.spark.createDataFrame(ARCS, "arc string, arc_from int, arc_to int")).select("pos", "arc")


NEW_NAME = "SELECT n.entity_id, n.revealed_pos AS pos, n.label FROM kg_names n WHERE n.precedence > 5 AND n.revealed_pos IS NOT NULL AND EXISTS (SELECT 1 FROM kg_names o WHERE o.entity_id = n.entity_id AND o.precedence > 5 AND o.revealed_pos < n.revealed_pos)"


def new_names(v):
    shown = v.names.where("precedence > 5 AND revealed_pos IS NOT NULL")
    first = shown.groupBy("entity_id").agg(F.min("revealed_pos").alias("first"))
    return shown.join(first, "entity_id").where("first < revealed_pos").select("entity_id", F.col("revealed_pos").alias("pos"), "label")


@query("beat_new_name", NEW_NAME)
def beat_new_name(v):
    return new_names(v)


REVEAL = f"""WITH e AS (SELECT id, subject, object, from_pos FROM kg_assertions WHERE predicate = 'same_as' AND {OPEN}),
    s AS (SELECT e.id, e.from_pos, n.*, row_number() OVER (PARTITION BY e.id, n.entity_id ORDER BY precedence DESC, revealed_pos DESC, label) AS r FROM e JOIN kg_names n ON n.entity_id IN (e.subject, e.object) AND n.revealed_pos <= e.from_pos),
    p AS (SELECT id, from_pos AS pos, arg_max(label, (precedence, revealed_pos, label)) AS now, arg_min(label, (precedence, revealed_pos, label)) AS was, count(*) AS n FROM s WHERE r = 1 GROUP BY id, from_pos)
    SELECT id, pos, now, was FROM p WHERE n = 2 AND now <> was"""


@query("beat_identity_reveal", REVEAL)
def beat_identity_reveal(v):
    return tm.identity_reveals(v.assertions, v.names, H)


@query("beat_entry_or_mention", """SELECT entity_id, pos, CASE WHEN max(CASE WHEN kind = 'mention' AND stated THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN kind = 'appearance' AND stated THEN 1 ELSE 0 END) = 0 THEN 'mentioned' ELSE 'enters' END AS entry
    FROM kg_occurrences GROUP BY entity_id, pos""")
def beat_entry_or_mention(v):
    return tm.entries(v.occurrences)


@query("beat_late_entry", "SELECT entity_id, pos, mentioned FROM (SELECT entity_id, min(pos) FILTER (kind = 'appearance') AS pos, min(pos) FILTER (kind = 'mention') AS mentioned FROM kg_occurrences WHERE stated GROUP BY entity_id) WHERE mentioned < pos")
def beat_late_entry(v):
    return tm.late_entries(v.occurrences)


@query("beat_refutation", BEST_CTE + f" SELECT a.id, concat(coalesce(s.label, a.subject), ' ', a.predicate, ' ', coalesce(o.label, a.object), ', held since ', a.from_pos) AS sentence FROM kg_assertions a LEFT JOIN best s ON s.entity_id = a.subject LEFT JOIN best o ON o.entity_id = a.object WHERE {REFUTED}")
def beat_refutation(v):
    told = tm.with_end_labels(tm.refuted_at(v.assertions, H), hz.best_label(v.names, H))
    return told.select("id", F.concat("subject_label", F.lit(" "), "predicate", F.lit(" "), "object_label", F.lit(", held since "), F.col("from_pos").cast("string")).alias("sentence"))


@query("story_beats", f"""
    SELECT pos, 1 AS arm, quote AS beat FROM (SELECT pos, quote, row_number() OVER (PARTITION BY pos ORDER BY regexp_matches(quote, '["“«]') DESC, length(quote) DESC, quote) AS n
        FROM (SELECT pos, trim(unnest(string_split(text, chr(10))), ' ') AS quote FROM kg_passages) WHERE length(quote) BETWEEN 40 AND 240 AND regexp_matches(quote, '^\\p{{Lu}}.*[.!?]$')) WHERE n = 1
    UNION ALL SELECT coalesce(told_pos, shown_pos, 0), CASE WHEN flashback THEN 3 ELSE 2 END, id FROM kg_scenes
    UNION ALL SELECT pos, 4, entity_id || ' is ' || label FROM ({NEW_NAME})
    UNION ALL SELECT pos, 5, was || ' is ' || now FROM ({REVEAL})
    UNION ALL SELECT pos, 6, entity_id || ' enters' FROM (SELECT entity_id, pos, mentioned FROM (SELECT entity_id, min(pos) FILTER (kind = 'appearance') AS pos, min(pos) FILTER (kind = 'mention') AS mentioned FROM kg_occurrences WHERE stated GROUP BY entity_id) WHERE mentioned < pos)
    UNION ALL SELECT resolved_pos, 7, id FROM kg_questions WHERE resolved_pos IS NOT NULL
    UNION ALL SELECT opened_pos, 8, id FROM kg_questions""")
def story_beats(v):
    arm = lambda df, pos, n, beat: df.select(F.expr(pos).alias("pos"), (n if not isinstance(n, int) else F.lit(n)).alias("arm"), beat.alias("beat"))
    scene = F.when(F.col("flashback"), 3).otherwise(2)
    parts = [
        arm(hz.best_quote(v.passages), "pos", 1, F.col("quote")),
        arm(v.scenes, "coalesce(told_pos, shown_pos, 0)", scene, F.col("id")),
        arm(new_names(v), "pos", 4, F.concat("entity_id", F.lit(" is "), "label")),
        arm(tm.identity_reveals(v.assertions, v.names, H), "pos", 5, F.concat("was", F.lit(" is "), "now")),
        arm(tm.late_entries(v.occurrences), "pos", 6, F.concat("entity_id", F.lit(" enters"))),
        arm(v.questions.where("resolved_pos IS NOT NULL"), "resolved_pos", 7, F.col("id")),
        arm(v.questions, "opened_pos", 8, F.col("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("collapse_tail", "SELECT id, pos, r > 5 AS collapsed FROM (SELECT id, coalesce(told_pos, shown_pos, 0) AS pos, row_number() OVER (PARTITION BY coalesce(told_pos, shown_pos, 0) ORDER BY recorded, id) AS r FROM kg_scenes)")
def collapse_tail(v):
    placed = v.scenes.withColumn("pos", F.coalesce("told_pos", "shown_pos", F.lit(0)))
    return placed.select("id", "pos", (F.row_number().over(Window.partitionBy("pos").orderBy("recorded", "id")) > 5).alias("collapsed"))


@query("story_page", "SELECT pos, lead(pos) OVER (ORDER BY pos) AS next_pos FROM (SELECT pos FROM kg_positions WHERE status = 'published' AND pos > 12 ORDER BY pos LIMIT 11) ORDER BY pos LIMIT 10")
def story_page(v):
    page = v.positions.where("status = 'published' AND pos > 12").select("pos").orderBy("pos").limit(11)
    return page.withColumn("next_pos", F.lead("pos").over(Window.orderBy("pos"))).orderBy("pos").limit(10)


@query("open_questions", """SELECT id, question FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY opened_pos DESC, id) AS r FROM kg_questions WHERE opened_pos <= $h AND (resolved_pos IS NULL OR resolved_pos > $h)) WHERE r = 1 ORDER BY opened_pos DESC, id LIMIT 12""")
def open_questions(v):
    still = hz.asof(v.questions, "opened_pos", H).where(hz.tellable(F.col("resolved_pos"), H).isNull()).withColumn("k", F.lower(F.trim("question")))
    return hz.first_by(still, ["k"], [F.desc("opened_pos"), F.asc("id")]).orderBy(F.desc("opened_pos"), "id").limit(12).select("id", "question")


@query("question_board", """SELECT id, state, count(*) OVER (PARTITION BY state) AS in_state, row_number() OVER (PARTITION BY state ORDER BY coalesce(resolved_pos, opened_pos) DESC, id) AS place FROM
    (SELECT id, opened_pos, CASE WHEN resolved_pos <= $h THEN resolved_pos END AS resolved_pos, CASE WHEN resolved_pos <= $h THEN 'resolved' ELSE 'open' END AS state FROM kg_questions WHERE opened_pos <= $h)""")
def question_board(v):
    known = hz.asof(v.questions, "opened_pos", H).select("id", "opened_pos", hz.tellable(F.col("resolved_pos"), H).alias("resolved_pos")).withColumn("state", F.when(F.col("resolved_pos").isNull(), "open").otherwise("resolved"))
    counts = known.groupBy("state").agg(F.count("*").alias("in_state"))
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.coalesce("resolved_pos", "opened_pos")), "id"))
    return known.withColumn("place", place).join(F.broadcast(counts), "state").select("id", "state", "in_state", "place")  # two states


@query("asof_registry", "SELECT entity_id, arg_max(amount, (pos, seq)) AS amount, max(pos) AS pos FROM kg_registry WHERE pos <= $h AND amount IS NOT NULL GROUP BY entity_id")
def asof_registry(v):
    return tm.last_known(v.registry, H, "amount")


@query("registry_counts", "SELECT entity_id, pos, seq, last_value(amount IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS carried FROM kg_registry")
def registry_counts(v):
    return tm.carried(v.registry, "entity_id", "amount").select("entity_id", "pos", "seq", "carried")


@query("registry_match", BEST_CTE + """, alias AS (SELECT DISTINCT label AS alias FROM kg_names WHERE kind = 'alias'), w AS (SELECT entity_id, label, unnest(string_split(label, ' ')) AS word FROM best)
    SELECT entity_id, arg_max(alias, (length(alias), alias)) AS alias FROM w JOIN alias ON string_split(alias, ' ')[1] = word WHERE contains(' ' || label || ' ', ' ' || alias || ' ') GROUP BY entity_id""")
def registry_match(v):
    alias = v.names.where("kind = 'alias'").select(F.col("label").alias("alias")).distinct().withColumn("word", F.split("alias", " ")[0])
    worded = hz.best_label(v.names, H).select("entity_id", "label", F.explode(F.split("label", " ")).alias("word"))
    whole = F.contains(F.concat(F.lit(" "), F.col("label"), F.lit(" ")), F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))
    return worded.join(alias, "word").where(whole).groupBy("entity_id").agg(F.max_by("alias", F.struct(F.length("alias"), F.col("alias"))).alias("alias"))


@query("wanted_asof", BEST_CTE + """ SELECT entity_id, amount, label FROM (SELECT entity_id, arg_max(amount, (pos, seq)) AS amount FROM kg_registry WHERE pos <= $h AND amount IS NOT NULL GROUP BY entity_id) JOIN best USING (entity_id) ORDER BY amount DESC, entity_id LIMIT 60""")
def wanted_asof(v):
    return tm.last_known(v.registry, H, "amount").join(hz.best_label(v.names, H).select("entity_id", "label"), "entity_id").orderBy(F.desc("amount"), "entity_id").limit(60).select("entity_id", "amount", "label")


@query("latest_attachment", "SELECT entity_id, image FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY revealed_pos DESC, created DESC) AS r FROM kg_attachments WHERE kind = 'poster' AND revealed_pos <= $h) WHERE r = 1")
def latest_attachment(v):
    return hz.first_by(hz.asof(v.attachments.where("kind = 'poster'"), "revealed_pos", H), ["entity_id"], [F.desc("revealed_pos"), F.desc("created")]).select("entity_id", "image")


@query("place_match", """WITH p AS (SELECT r_regionkey AS k, lower(r_name) AS entry FROM region), n AS (SELECT n_nationkey, lower(n_name) AS name, n_regionkey FROM nation)
    SELECT p.entry, min(n.name) AS node FROM p JOIN n ON n.n_regionkey = p.k AND length(n.name) = (SELECT min(length(m.name)) FROM n m WHERE m.n_regionkey = p.k) GROUP BY p.entry""")
def place_match(v):
    nodes = v.nation.select(F.col("n_regionkey").alias("k"), F.lower("n_name").alias("name"))
    best = nodes.groupBy("k").agg(F.min_by("name", F.struct(F.length("name"), F.col("name"))).alias("node"))
    return v.region.select(F.col("r_regionkey").alias("k"), F.lower("r_name").alias("entry")).join(best, "k").select("entry", "node")


@query("era_of", "SELECT image, CASE WHEN era = 'later' THEN 'after' WHEN revealed_pos IS NULL THEN 'unknown' WHEN revealed_pos < 60 THEN 'before' ELSE 'after' END AS era FROM kg_attachments")
def era_of(v):
    return v.attachments.select("image", F.when(F.col("era") == "later", "after").when(F.col("revealed_pos").isNull(), "unknown").when(F.col("revealed_pos") < 60, "before").otherwise("after").alias("era"))


SHEET = f"SELECT subject AS entity_id, predicate, object AS other, 'out' AS direction, from_pos, confidence, id FROM kg_assertions WHERE {OPEN} UNION ALL SELECT object, predicate, subject, 'in', from_pos, confidence, id FROM kg_assertions WHERE {OPEN}"


@query("entity_sheet", COMPONENTS + NAMED + """,
    f AS (SELECT a.*, s.root AS here, t.root AS there FROM open a JOIN root s ON s.id = a.subject JOIN root t ON t.id = a.object),
    u AS (SELECT here AS root, 'out' AS direction, predicate, CASE WHEN here = there THEN object ELSE there END AS other, here <> there AS apart, from_pos, confidence, id FROM f
        UNION ALL SELECT there, 'in', predicate, here, true, from_pos, confidence, id FROM f WHERE here <> there),
    quoted AS (SELECT assertion_id, min(excerpt) FILTER (excerpt <> '') AS quote, count(*) FILTER (excerpt <> '') AS quotes, string_agg(concat_ws(' ', id, kind, excerpt), chr(10) ORDER BY concat_ws(' ', id, kind, excerpt)) AS evidence FROM kg_evidence GROUP BY assertion_id)
    SELECT u.root, coalesce(l.label, '?') AS label, direction, predicate, other, CASE WHEN apart THEN coalesce(o.label, '?') END AS other_label, from_pos, confidence, u.id, quote, coalesce(quotes, 0) AS quotes, evidence
    FROM u LEFT JOIN lab l ON l.root = u.root LEFT JOIN lab o ON o.root = u.other LEFT JOIN quoted ON quoted.assertion_id = u.id
    UNION ALL SELECT r.root, l.label, 'name', n.kind, n.entity_id, n.label, n.revealed_pos, NULL, NULL, NULL, 0, NULL FROM kg_names n JOIN root r ON r.id = n.entity_id JOIN lab l ON l.root = r.root WHERE n.revealed_pos <= $h""")
def entity_sheet(v):
    """The sheets of all components: each visible fact from both ends, the name of the other end, its evidence, and all visible names."""
    comp = idn.identity_components(v.entities, v.assertions, H)
    named = materialise(comp.join(idn.component_label(comp, v.names, H), "root").select("id", "root", "label"))
    return tm.component_sheet(v.assertions, named, v.names, v.evidence, H)


@query("entity_profile", f"""SELECT entity_id, CASE WHEN predicate = 'located_at' THEN 'places' WHEN predicate IN ('owns', 'gives') THEN 'possessions' WHEN predicate = 'same_as' THEN 'identity' ELSE 'aims' END AS section, other,
    min(from_pos) AS first_pos, max(confidence) AS confidence, count(*) AS facts, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM ({SHEET}) GROUP BY 1, 2, 3""")
def entity_profile(v):
    return tm.profile_sections(tm.entity_sheet(v.assertions, H))


@query("short_name_owner", BEST_CTE + """, o AS (SELECT b.entity_id, string_split(label, ' ')[-1] AS short, node_type = 'character' AS person FROM best b JOIN kg_entities e ON e.id = b.entity_id)
    SELECT short, coalesce(min(entity_id) FILTER (person), min(entity_id)) AS entity_id FROM o GROUP BY short HAVING count(*) FILTER (person) = 1 OR (count(*) FILTER (person) = 0 AND count(*) = 1)""")
def short_name_owner(v):
    return tm.short_name_owner(hz.best_label(v.names, H), v.entities)


@query("mentions_in_prose", """WITH w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(summary), '[^\\p{L}\\p{N}]+')) AS word FROM kg_scenes), n AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT lower(source) FROM documents UNION SELECT unnest(['idiot', 'tion', 'the', 'le', 'der']) )
    SELECT w.id, n.name FROM w JOIN n ON n.name = w.word""")
def mentions_in_prose(v):
    words = v.scenes.select("id", F.explode(F.array_distinct(F.split(F.lower("summary"), tx.WORDS))).alias("name"))
    names = v.part.select(F.lower("p_brand").alias("name")).union(v.documents.select(F.lower("source"))).union(v.spark.createDataFrame([(x,) for x in ("idiot", "tion", "the", "le", "der")], "name string")).distinct()
    return words.join(names, "name").select("id", "name")


@query("transcript", "SELECT coalesce(told_pos, shown_pos, 0) AS pos, string_agg(id, chr(10) ORDER BY ord, recorded, id) AS transcript FROM kg_scenes GROUP BY 1")
def transcript(v):
    return tm.transcript(v.scenes.withColumn("pos", F.coalesce("told_pos", "shown_pos", F.lit(0))), "pos", ["ord", "recorded", "id"], "id")


@query("spotlight_wall")
def spotlight_wall(v):
    posters = hz.asof(v.attachments, "revealed_pos", H).groupBy("entity_id").agg(F.max((F.col("kind") == "poster").cast("int")).alias("poster"))
    return posters.withColumn("draw", F.rand(17)).orderBy(F.desc("poster"), "draw").limit(24).select("entity_id", "poster")
