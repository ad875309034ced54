"""Search and question context."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import graph as gr
from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.operators import search as se
from vantage.operators import text as tx
from vantage.plans.catalog import H, query
from vantage.plans.graph import FOLDED
from vantage.plans.text import content, tok, word_grams
from vantage.sources.shared import materialise

#: Query, tokens that are wanted, tokens that exclude.
ASKED = [("q1", ["the", "tion"], ["idiot"]), ("q2", ["le", "est"], []), ("q3", ["der", "ist"], ["und"])]
FUZZY = [("q1", "argentina"), ("q2", "Name 12"), ("q3", "building")]
QSQL = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}', {w})" for q, yes, no in ASKED for t, w in [(x, "true") for x in yes] + [(x, "false") for x in no]) + ") AS t(query_id, token, wanted)"


def tokens_asked(v):
    return v.spark.createDataFrame([(q, t, w) for q, yes, no in ASKED for t, w in [(x, True) for x in yes] + [(x, False) for x in no]], "query_id string, token string, wanted boolean")


INDEX = f"SELECT token, id, count(*) AS n, min(place) AS place FROM (SELECT id, unnest({tok('summary')}) AS token, generate_subscripts({tok('summary')}, 1) - 1 AS place FROM kg_scenes) GROUP BY token, id"
#: The index as a search sees it: nothing told beyond the horizon.
SEEN = INDEX.replace("FROM kg_scenes)", "FROM kg_scenes WHERE coalesce(told_pos, shown_pos, 0) <= $h)")
LEX = f"i AS ({SEEN}), q AS ({QSQL}), h AS (SELECT query_id, id, count(*) AS matched, sum(n) AS n FROM q JOIN i USING (token) WHERE wanted GROUP BY query_id, id), b AS (SELECT DISTINCT query_id, id FROM q JOIN i USING (token) WHERE NOT wanted), lex AS (SELECT * FROM (SELECT query_id, id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, n DESC, id) AS rank FROM h ANTI JOIN b USING (query_id, id)) WHERE rank <= 20)"


def lexical(v):
    return se.lexical(se.inverted_index(hz.asof_scenes(v.scenes, H), "id", "summary"), tokens_asked(v), 20)


@query("fts_index", INDEX)
def fts_index(v):
    """Every scene, whenever it is told: a search cuts by its horizon."""
    return se.inverted_index(v.scenes, "id", "summary")


#: Query, clause (none: excluded), phrase. q1: dans "de la" -idiot; q2: worthless or "of the"; q3: "auf der" und -nicht; q4: name 12.
WEB = [("q1", 0, "dans"), ("q1", 1, "de la"), ("q1", None, "idiot"), ("q2", 0, "worthless"), ("q2", 0, "of the"), ("q3", 0, "auf der"), ("q3", 1, "und"), ("q3", None, "nicht"), ("q4", 0, "name"), ("q4", 1, "12")]
#: Passages are numbered by document, not by month, so no horizon cuts them.
FIVE = "SELECT DISTINCT 'label' AS source, concat(entity_id, ' ', label) AS id, label AS text FROM kg_names WHERE revealed_pos <= $h UNION ALL SELECT 'passage', CAST(doc_id AS VARCHAR), text FROM kg_passages UNION ALL SELECT 'scene', id, summary FROM kg_scenes WHERE coalesce(told_pos, shown_pos, 0) <= $h UNION ALL SELECT 'question', id, question FROM kg_questions WHERE opened_pos <= $h UNION ALL SELECT 'description', id, description FROM kg_evidence WHERE description IS NOT NULL AND assertion_id IN (SELECT id FROM kg_assertions WHERE status = 'accepted' AND from_pos <= $h AND (until_pos IS NULL OR until_pos > $h))"


def five_sources(v):
    label = hz.asof(v.names, "revealed_pos", H).select(F.lit("label").alias("source"), F.concat_ws(" ", "entity_id", "label").alias("id"), F.col("label").alias("text")).distinct()
    passage = v.passages.select(F.lit("passage"), F.col("doc_id").cast("string"), "text")
    scene = hz.asof_scenes(v.scenes, H).select(F.lit("scene"), "id", "summary")
    question = hz.asof(v.questions, "opened_pos", H).select(F.lit("question"), "id", "question")
    description = hz.asof_evidence(v.evidence.where("description IS NOT NULL"), v.assertions, H).select(F.lit("description"), "id", "description")
    return label.union(passage).union(scene).union(question).union(description)


@query("lexical_search", "WITH src AS (" + FIVE + "), t AS (SELECT source, id, " + tok("text") + " AS w FROM src), term AS (SELECT query_id, clause, string_split(p, ' ') AS p FROM (VALUES " + ", ".join(f"('{q}', {'NULL' if c is None else c}, '{p}')" for q, c, p in WEB) + """) AS x(query_id, clause, p)),
    occ AS (SELECT source, id, query_id, clause, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) AS start FROM t JOIN term ON list_has_all(w, p)),
    held AS (SELECT * FROM occ WHERE clause IS NOT NULL AND (source, id, query_id) NOT IN (SELECT (source, id, query_id) FROM occ WHERE clause IS NULL)),
    k AS (SELECT DISTINCT query_id, clause FROM term WHERE clause IS NOT NULL),
    c AS (SELECT o.source, o.id, o.query_id, o.start, k.clause, max(b.start) AS m FROM (SELECT DISTINCT source, id, query_id, start FROM held) o JOIN k ON k.query_id = o.query_id LEFT JOIN held b ON b.source = o.source AND b.id = o.id AND b.query_id = o.query_id AND b.clause = k.clause AND b.start <= o.start GROUP BY ALL),
    s AS (SELECT source, id, query_id, min(span) AS span FROM (SELECT source, id, query_id, start - min(m) + 1 AS span FROM c GROUP BY source, id, query_id, start HAVING count(m) = count(*)) GROUP BY ALL)
    SELECT source, query_id, id, span, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY span, n DESC, id) AS rank FROM s JOIN (SELECT source, id, query_id, count(*) AS n FROM held GROUP BY ALL) USING (source, id, query_id)) WHERE rank <= 20""")
def lexical_search(v):
    asked = v.spark.createDataFrame([(q, c, p.split()) for q, c, p in WEB], "query_id string, clause int, phrase array<string>")
    return se.web_search(five_sources(v), asked, 20)


@query("headline", f"WITH t AS (SELECT id, {tok('summary')} AS w FROM kg_scenes WHERE coalesce(told_pos, shown_pos, 0) <= $h), f AS (SELECT id, w, list_position(w, 'tion') AS p FROM t WHERE list_contains(w, 'tion')) SELECT id, array_to_string(w[greatest(1, p - 8):p + 8], ' ') AS headline FROM f")
def headline(v):
    w = hz.asof_scenes(v.scenes, H).select("id", tx.tokens(F.col("summary")).alias("w")).where(F.array_contains("w", "tion")).withColumn("p", F.array_position("w", "tion").cast("int"))
    a = F.greatest(F.lit(1), F.col("p") - 8)
    return w.select("id", F.array_join(F.slice("w", a, F.col("p") + 9 - a), " ").alias("headline"))


FZ = f"fq AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in FUZZY)}) AS t(query_id, query)), fl AS (SELECT entity_id, {word_grams('label')} AS s FROM kg_names WHERE revealed_pos <= $h), fg AS (SELECT query_id, {word_grams('query')} AS s FROM fq), fz AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT fg.query_id, fl.entity_id AS id, max(len(list_intersect(fg.s, fl.s)) / len(list_distinct(list_concat(fg.s, fl.s)))) AS score FROM fg, fl GROUP BY 1, 2) WHERE score >= 0.3) WHERE rank <= 20)"


def fuzzy(v):
    return se.gram_search(hz.asof(v.names, "revealed_pos", H), v.spark.createDataFrame(FUZZY, "query_id string, query string"), 0.3, 20)


@query("fuzzy_search", f"WITH {FZ} SELECT query_id, id, round(score, 6) AS score, rank FROM fz")
def fuzzy_search(v):
    return fuzzy(v).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("entity_lookup", "SELECT entity_id, label FROM (SELECT n.entity_id, n.label, row_number() OVER (PARTITION BY n.entity_id ORDER BY length(n.label), n.label) AS r FROM kg_names n JOIN kg_entities e ON e.id = n.entity_id AND e.status = 'accepted' WHERE contains(lower(n.label), 'an') AND n.revealed_pos <= $h) WHERE r = 1 ORDER BY length(label), entity_id LIMIT 40")
def entity_lookup(v):
    found = hz.asof(v.names, "revealed_pos", H).where(F.contains(F.lower("label"), F.lit("an"))).join(v.entities.where("status = 'accepted'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return hz.first_by(found, ["entity_id"], [F.length("label").asc(), F.asc("label")]).orderBy(F.length("label"), "entity_id").limit(40).select("entity_id", "label")


VEC = "vec AS (SELECT * FROM (SELECT q.id AS query_id, c.id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, c.id) AS rank FROM kg_vectors q JOIN kg_vectors c ON c.id <> q.id AND c.pos <= $h WHERE q.vec_id < 5) WHERE rank <= 10)"


def vectors(v):
    return se.vector_search(hz.asof(v.vectors, "pos", H), v.vectors.where("vec_id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("vector_search", f"WITH {VEC} SELECT query_id, id, round(score, 6) AS score, rank FROM vec")
def vector_search(v):
    return vectors(v).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


RRF = f"WITH {LEX}, {FZ}, u AS (SELECT query_id, id, rank, 'lexical' AS mode FROM lex UNION ALL SELECT query_id, id, rank, 'fuzzy' FROM fz) SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM u GROUP BY query_id, id"


@query("rrf_fuse", RRF)
def rrf_fuse(v):
    return se.fuse({"lexical": lexical(v), "fuzzy": fuzzy(v)})


#: The vector of each query stands for its text.
QUERY_VECTOR = {"q1": 1, "q2": 2, "q3": 3}
SEMANTIC = "sem AS (SELECT * FROM (SELECT t.query_id, c.id, row_number() OVER (PARTITION BY t.query_id ORDER BY list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, c.id) AS rank FROM (VALUES " + ", ".join(f"('{q}', {i})" for q, i in QUERY_VECTOR.items()) + ") AS t(query_id, vec_id) JOIN kg_vectors q ON q.vec_id = t.vec_id JOIN kg_vectors c ON c.kind = 'entity' AND c.pos <= $h) WHERE rank <= 20)"
ALL_MODES = FOLDED + f""", {LEX}, {FZ}, {SEMANTIC},
    three AS (SELECT query_id, id, rank, 'lexical' AS mode FROM lex UNION ALL SELECT query_id, id, rank, 'fuzzy' FROM fz UNION ALL SELECT query_id, id, rank, 'semantic' FROM sem),
    seeds AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sum(1 / (60 + rank)) DESC, id) AS k FROM three WHERE id IN (SELECT root FROM deg) GROUP BY query_id, id) WHERE k <= 5),
    near AS (SELECT DISTINCT s.query_id, l.other AS id FROM seeds s JOIN link l ON l.node = s.id ANTI JOIN seeds t ON t.query_id = s.query_id AND t.id = l.other),
    gra AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + ln(1 + degree)) DESC, id) AS rank FROM near JOIN deg ON deg.root = near.id) WHERE rank <= 25),
    four AS (SELECT * FROM three UNION ALL SELECT query_id, id, rank, 'graph' FROM gra)"""


def modes(v):
    """Ranked lists of every mode: lexical, fuzzy and semantic, then the neighbours in the graph of the five best entities of these."""
    asked = F.broadcast(v.spark.createDataFrame(list(QUERY_VECTOR.items()), "query_id string, vec_id long"))  # one row a query
    wanted = v.vectors.join(asked, "vec_id").select("query_id", F.col("embedding").alias("q"))
    lists = {"lexical": lexical(v), "fuzzy": fuzzy(v), "semantic": se.vector_search(hz.asof(v.vectors.where("kind = 'entity'"), "pos", H), wanted, 20)}
    lists = {mode: materialise(df.select("query_id", "id", "rank")) for mode, df in lists.items()}
    edges = materialise(gr.fold_edges(v.assertions, idn.identity_components(v.entities, v.assertions, H), H).select("source", "target"))
    return lists | {"graph": se.expand_best(lists, edges, 5, 25)}


@query("hybrid_search", ALL_MODES + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes FROM four GROUP BY query_id, id)) WHERE place <= 10")
def hybrid_search(v):
    fused = se.fuse(modes(v))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("place <= 10")


@query("search_modes", ALL_MODES + " SELECT q.query_id, m.mode, count(four.id) > 0 AS ran, count(four.id) AS found FROM (SELECT DISTINCT query_id FROM q) q CROSS JOIN (VALUES ('lexical'), ('fuzzy'), ('semantic'), ('graph')) AS m(mode) LEFT JOIN four ON four.query_id = q.query_id AND four.mode = m.mode GROUP BY q.query_id, m.mode")
def search_modes(v):
    """What each mode of the hybrid search did for each query, also if it found nothing."""
    asked = tokens_asked(v).select("query_id").distinct()
    out = None
    for mode, df in modes(v).items():
        one = asked.join(df.groupBy("query_id").agg(F.count("*").alias("found")), "query_id", "left").select("query_id", F.lit(mode).alias("mode"), (F.coalesce("found", F.lit(0)) > 0).alias("ran"), F.coalesce("found", F.lit(0)).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


@query("broaden_query", f"SELECT id, array_to_string(list_sort({content('question')}), ' or ') AS query FROM kg_questions")
def broaden_query(v):
    return v.questions.select("id", F.array_join(F.array_sort(tx.content_tokens(F.col("question"))), " or ").alias("query"))


@query("qa_context", f"""WITH {FZ}, touch AS (SELECT DISTINCT fz.query_id, a.id, a.subject, a.predicate, a.object, a.from_pos FROM kg_assertions a JOIN fz ON fz.id IN (a.subject, a.object) WHERE a.status = 'accepted' AND a.from_pos <= $h AND (a.until_pos IS NULL OR a.until_pos > $h)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY from_pos, id) AS rank FROM touch)
    SELECT query_id, rank, id, subject, predicate, object, (SELECT min(excerpt) FROM kg_evidence e WHERE e.assertion_id = r.id) AS excerpt FROM r WHERE rank <= 40""")
def qa_context(v):
    return se.context(hz.asof_assertions(v.assertions, H), fuzzy(v), v.evidence, 40)


CITES = "SELECT e.id, CASE WHEN a.id IS NULL THEN 'unknown' WHEN a.status <> 'accepted' THEN 'not accepted' WHEN a.from_pos > $h THEN 'beyond the horizon' WHEN row_number() OVER (PARTITION BY e.assertion_id ORDER BY e.id) > 1 THEN 'repeated' ELSE 'kept' END AS verdict FROM kg_evidence e LEFT JOIN kg_assertions a ON a.id = e.assertion_id"


def citations(v):
    a = v.assertions.select(F.col("id").alias("assertion_id"), "status", "from_pos", F.lit(True).alias("found"))
    nth = F.row_number().over(Window.partitionBy("assertion_id").orderBy("id"))
    verdict = F.when(F.col("found").isNull(), "unknown").when(F.col("status") != "accepted", "not accepted").when(F.col("from_pos") > H, "beyond the horizon").when(F.col("nth") > 1, "repeated").otherwise("kept")
    return v.evidence.select("id", "assertion_id").join(a, "assertion_id", "left").withColumn("nth", nth).select("id", verdict.alias("verdict"))


@query("verify_citations", CITES)
def verify_citations(v):
    return citations(v)


@query("eval_answers", f"SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM ({CITES}) GROUP BY verdict")
def eval_answers(v):
    counts = citations(v).groupBy("verdict").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("verdict", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))  # one row of totals


@query("groundedness", f"WITH p AS (SELECT id, {content('summary')} AS s, {content('excerpt')} AS x FROM (SELECT e.id, s.summary, e.excerpt FROM kg_evidence e JOIN kg_scenes s ON s.id = e.passage_id)) SELECT id, CASE WHEN len(x) = 0 THEN 0 ELSE round(len(list_intersect(x, s)) / len(x), 6) END AS grounded FROM p")
def groundedness(v):
    pair = v.evidence.join(v.scenes.select(F.col("id").alias("passage_id"), "summary"), "passage_id").select("id", tx.content_tokens(F.col("excerpt")).alias("x"), tx.content_tokens(F.col("summary")).alias("s"))
    return pair.select("id", F.when(F.size("x") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("x", "s")) / F.size("x"), 6)).alias("grounded"))
