"""Text functions run as corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import text as tx
from vantage.plans.catalog import H, query

# The SQL side of the text functions, for texts of Latin letters.
NORM = "trim(regexp_replace(replace(replace(replace(strip_accents(translate(lower({0}), '‘’‚‛´`“”„«»–—−‐‑', '''''''''''''\"\"\"\"\"-----')), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '\\s+', ' ', 'g'))"
TOK = "list_filter(regexp_split_to_array(" + NORM + ", '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0)"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
CONTENT = "list_distinct(list_filter(" + TOK + ", lambda x: length(x) > 1 AND NOT list_contains(" + STOP + ", x)))"


def norm(c: str) -> str:
    return NORM.format(c)


def tok(c: str) -> str:
    return TOK.format(c)


def content(c: str) -> str:
    return CONTENT.format(c)


@query("normalize_text", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(v):
    return v.documents.select("doc_id", tx.normalise(F.col("text")).alias("norm"))


@query("name_key", f"SELECT entity_id, label, regexp_replace({norm('label')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS name_key, array_to_string(list_sort({tok('label')}), ' ') AS signature FROM kg_names")
def name_key(v):
    return v.names.select("entity_id", "label", tx.name_key(F.col("label")).alias("name_key"), tx.signature(F.col("label")).alias("signature"))


@query("signature", f"SELECT array_to_string(list_sort({tok('p_name')}), ' ') AS signature, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def signature(v):
    return v.part.groupBy(tx.signature(F.col("p_name")).alias("signature")).agg(F.count_distinct("p_name").alias("names"))


@query("word_pad", f"SELECT entity_id, label, concat(' ', array_to_string({tok('label')}, ' '), ' ') AS padded FROM kg_names")
def word_pad(v):
    return v.names.select("entity_id", "label", tx.word_pad(F.col("label")).alias("padded"))


@query("content_tokens", f"SELECT id, array_to_string(list_sort({content('summary')}), ' ') AS tokens FROM kg_scenes")
def content_tokens(v):
    return v.scenes.select("id", F.array_join(F.array_sort(tx.content_tokens(F.col("summary"))), " ").alias("tokens"))


PAIR = "SELECT a.id AS a, b.id AS b, a.summary AS x, b.summary AS y FROM kg_scenes a JOIN kg_scenes b ON b.recorded = a.recorded + 1"


def neighbours(v):
    b = v.scenes.select(F.col("id").alias("b"), F.col("summary").alias("y"), (F.col("recorded") - 1).alias("recorded"))
    return v.scenes.select(F.col("id").alias("a"), F.col("summary").alias("x"), "recorded").join(b, "recorded")


@query("token_jaccard", f"WITH p AS ({PAIR}), t AS (SELECT a, b, {content('x')} AS x, {content('y')} AS y FROM p) SELECT a, b, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS score FROM t")
def token_jaccard(v):
    return neighbours(v).select("a", "b", F.round(tx.jaccard(tx.content_tokens(F.col("x")), tx.content_tokens(F.col("y"))), 6).alias("score"))


GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
LABEL_PAIR = "SELECT DISTINCT a.label AS x, b.label AS y FROM kg_names a JOIN kg_names b ON b.entity_id = a.entity_id AND a.label < b.label"


def label_pairs(v):
    a, b = v.names.select("entity_id", F.col("label").alias("x")), v.names.select("entity_id", F.col("label").alias("y"))
    return a.join(b, "entity_id").where("x < y").select("x", "y").distinct()


@query("trgm_dice", f"WITH p AS ({LABEL_PAIR}), k AS (SELECT x, y, concat('  ', {norm('x')}, ' ') AS u, concat('  ', {norm('y')}, ' ') AS w FROM p), g AS (SELECT x, y, {GRAMS.format('u')} AS u, {GRAMS.format('w')} AS w FROM k) SELECT x, y, round(2 * len(list_intersect(u, w)) / (len(u) + len(w)), 6) AS score FROM g")
def trgm_dice(v):
    return label_pairs(v).select("x", "y", F.round(tx.dice(tx.trigrams_padded(F.col("x")), tx.trigrams_padded(F.col("y"))), 6).alias("score"))


def word_grams(c: str) -> str:
    return f"list_distinct(flatten(list_transform({tok(c)}, lambda t: list_transform(range(1, length(t) + 2), lambda i: substr(concat('  ', t, ' '), i, 3)))))"


@query("trgm_jaccard", f"WITH p AS ({LABEL_PAIR}), g AS (SELECT x, y, {word_grams('x')} AS u, {word_grams('y')} AS w FROM p) SELECT x, y, round(len(list_intersect(u, w)) / len(list_distinct(list_concat(u, w))), 6) AS score FROM g")
def trgm_jaccard(v):
    return label_pairs(v).select("x", "y", F.round(tx.jaccard(tx.trigrams_by_word(F.col("x")), tx.trigrams_by_word(F.col("y"))), 6).alias("score"))


@query("word_similarity", f"WITH p AS ({LABEL_PAIR}), g AS (SELECT x, y, {word_grams('x')} AS u, {word_grams('y')} AS w FROM p) SELECT x, y, round(len(list_intersect(u, w)) / len(u), 6) AS score FROM g")
def word_similarity(v):
    g, w = tx.trigrams_by_word(F.col("x")), tx.trigrams_by_word(F.col("y"))
    return label_pairs(v).select("x", "y", F.round(F.size(F.array_intersect(g, w)) / F.size(g), 6).alias("score"))


@query("edit_distance_le", f"WITH p AS ({LABEL_PAIR}) SELECT x, y, CASE WHEN levenshtein(x, y) <= 6 THEN levenshtein(x, y) END AS distance FROM p")
def edit_distance_le(v):
    d = F.levenshtein("x", "y", 6)
    return label_pairs(v).select("x", "y", F.when(d >= 0, d).alias("distance"))


@query("anchor_exact", f"SELECT e.id, contains({norm('p.summary')}, {norm('e.excerpt')}) AND e.excerpt <> '' AS anchored FROM kg_evidence e JOIN kg_scenes p ON p.id = e.passage_id")
def anchor_exact(v):
    p = v.scenes.select(F.col("id").alias("passage_id"), "summary")
    return v.evidence.join(p, "passage_id").select("id", (F.contains(tx.normalise(F.col("summary")), tx.normalise(F.col("excerpt"))) & (F.col("excerpt") != "")).alias("anchored"))


@query("anchor_fuzzy")
def anchor_fuzzy(v):
    """Excerpts that no passage holds word for word but that come within ``min(4, length / 10)`` edits of a window of it."""
    from vantage.functions.fuzzy import within_edits

    p = v.scenes.select(F.col("id").alias("passage_id"), tx.normalise(F.col("summary")).alias("passage"))
    e = v.evidence.where("excerpt <> ''").select("id", "passage_id", tx.normalise(F.col("excerpt")).alias("excerpt"))
    return e.join(p, "passage_id").select("id", within_edits("excerpt", "passage").alias("edits")).where("edits >= 0")


def marks(lang: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x IN ({', '.join(repr(w) for w in tx.MARKERS[lang].split())})))"


@query("detect_language", f"""WITH m AS (SELECT doc_id, {marks('fr')} AS fr, {marks('en')} AS en FROM documents)
    SELECT doc_id, CASE WHEN fr >= 8 AND fr >= 1.5 * en THEN 'fr' WHEN en >= 8 AND en >= 1.5 * fr THEN 'en' END AS detected FROM m""")
def detect_language(v):
    return v.documents.select("doc_id", tx.detect_language(F.col("text")).alias("detected"))


@query("classify_scene", f"SELECT id, CASE WHEN regexp_matches({norm('summary')}, '{'|'.join(tx.BATTLE)}') THEN 'battle' ELSE 'event' END AS scene FROM kg_scenes")
def classify_scene(v):
    return v.scenes.select("id", F.when(tx.is_battle(F.col("summary")), "battle").otherwise("event").alias("scene"))


SHAPE = "length(trim(x)) - length(replace(trim(x), ' ', '')) + 1"


@query("label_shape", f"WITH l AS (SELECT item_id, split_part(text, '.', 1) AS x FROM benchmark) SELECT item_id, {SHAPE} > 6 AS long, regexp_matches(x, '[,;:!?]') AS marked, regexp_matches(concat(' ', lower(x), ' '), ' (that|which|who|when|que|qui) ') AS clause FROM l")
def label_shape(v):
    x = F.split_part("text", F.lit("."), F.lit(1))
    words = F.length(F.trim(x)) - F.length(F.replace(F.trim(x), F.lit(" "), F.lit(""))) + 1
    return v.benchmark.select("item_id", (words > 6).alias("long"), x.rlike("[,;:!?]").alias("marked"), F.concat(F.lit(" "), F.lower(x), F.lit(" ")).rlike(" (that|which|who|when|que|qui) ").alias("clause"))


@query("whole_word_match", r"SELECT id FROM kg_scenes WHERE list_contains(regexp_split_to_array(summary, '[^\p{L}\p{N}]+'), 'tion')")
def whole_word_match(v):
    return v.scenes.where(tx.whole_word(F.col("summary"), "tion")).select("id")


FIRST = r"""WITH w AS (SELECT coalesce(told_pos, shown_pos, 0) AS pos, unnest(regexp_split_to_array(lower(summary), '[^\p{L}\p{N}]+')) AS word FROM kg_scenes)
    SELECT word, min(pos) AS first_pos FROM w WHERE word IN (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+'))) FROM benchmark) AND word <> '' GROUP BY word"""


def first_written_frame(v):
    """First position whose text writes each word of the benchmark."""
    written = v.scenes.select(F.coalesce("told_pos", "shown_pos", F.lit(0)).alias("pos"), F.explode(F.array_distinct(F.split(F.lower("summary"), tx.WORDS))).alias("word"))
    wanted = v.benchmark.select(F.explode(F.split(F.lower("text"), tx.WORDS)).alias("word")).where("word <> ''").distinct()
    return written.join(wanted, "word", "left_semi").groupBy("word").agg(F.min("pos").alias("first_pos"))


@query("first_written", FIRST)
def first_written(v):
    return first_written_frame(v)


@query("name_revealed_later", f"SELECT * FROM ({FIRST}) WHERE first_pos > $h")
def name_revealed_later(v):
    return first_written_frame(v).where(F.col("first_pos") > H)


@query("proposal_fingerprint", "SELECT id, sha256(concat_ws('|', category, subject, predicate, object, array_to_string(list_sort([lang, source]), ','))) AS fingerprint FROM kg_proposals")
def proposal_fingerprint(v):
    anchors = F.array_join(F.array_sort(F.array("lang", "source")), ",")
    return v.proposals.select("id", F.sha2(F.concat_ws("|", "category", "subject", "predicate", "object", anchors), 256).alias("fingerprint"))


@query("input_hash", "SELECT event_id, sha256(concat_ws('|', user_id, action, value)) AS input_hash FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, action, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value FROM kg_actions)")
def input_hash(v):
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    return v.actions.select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "action", cents), 256).alias("input_hash"))


@query("literal_of", "SELECT event_id, coalesce(CAST(props->>'$.k' AS VARCHAR), props) AS literal FROM events")
def literal_of(v):
    return v.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.col("props")).alias("literal"))


LINES = "WITH l AS (SELECT item_id, concat('- c', item_id, ' | ', CASE WHEN item_id % 2 = 0 THEN 'same' ELSE 'other' END, ' | why | ', text) AS line FROM benchmark)"


@query("verdict_lines", LINES + " SELECT item_id, trim(string_split(regexp_replace(line, '^[-* ]+', ''), '|')[1]) AS subject, trim(string_split(line, '|')[2]) AS verdict, trim(array_to_string(string_split(line, '|')[3:], '|')) AS reason FROM l")
def verdict_lines(v):
    line = F.concat(F.lit("- c"), F.col("item_id").cast("string"), F.lit(" | "), F.when(F.col("item_id") % 2 == 0, "same").otherwise("other"), F.lit(" | why | "), F.col("text"))
    parts = F.split(F.regexp_replace(line, "^[-* ]+", ""), r"\|", 3)
    return v.benchmark.select("item_id", F.trim(parts[0]).alias("subject"), F.trim(parts[1]).alias("verdict"), F.trim(parts[2]).alias("reason"))
