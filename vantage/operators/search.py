"""Lexical, fuzzy and vector search for batches of queries, and fusion of their ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vantage.operators import text as tx
from vantage.operators.grams import jaccard_join
from vantage.sources.shared import materialise


def top(df: DataFrame, per: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= k)


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(token, id, n, place)``: occurrences of each token in each text and the first place of one."""
    placed = docs.select(F.col(id_col).alias("id"), F.posexplode(tx.tokens(F.col(text_col))).alias("place", "token"))
    return placed.groupBy("token", "id").agg(F.count("*").alias("n"), F.min("place").alias("place"))


def lexical(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, matched, rank)``: texts by distinct query tokens they hold, then occurrences, then id.

    ``queries`` is a short stated list of (query_id, token, wanted): tokens that are not wanted exclude a text.
    """
    met = index.join(F.broadcast(queries), "token").groupBy("query_id", "id").agg(F.count_if("wanted").alias("matched"), F.sum(F.when(F.col("wanted"), F.col("n"))).alias("n"), F.max(~F.col("wanted")).alias("banned"))
    return top(met.where("matched > 0 AND NOT banned").drop("banned"), ["query_id"], [F.desc("matched"), F.desc("n"), F.asc("id")], k)


def web_search(texts: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``(source, query_id, id, span, n, rank)``: the ``k`` best texts of each source for queries with and, or, quotes and minus.

    ``texts`` has (source, id, text), ``id`` unique in its source. ``terms`` is a short stated list of (query_id, clause,
    phrase): ``phrase`` is an array of tokens that follow one another, a text must hold a phrase of every clause of its query,
    and a phrase whose clause is null excludes a text. Ranked by cover density: the least number of places from the first to
    the last of starts that take one phrase of each clause, then by occurrences, then by id. Null and empty texts match nothing.
    """
    parts = terms.withColumn("term", F.monotonically_increasing_id()).select("query_id", "clause", "term", F.size("phrase").alias("len"), F.posexplode("phrase").alias("j", "token"))
    placed = texts.select("source", "id", F.posexplode(tx.tokens(F.col("text"))).alias("place", "token"))
    key = ["source", "query_id", "id"]
    # the hits of a text travel once: all that follows groups by its key and more
    met = placed.join(F.broadcast(parts), "token").select(*key, "clause", "term", "len", (F.col("place") - F.col("j")).alias("start")).repartition(*key)
    found = met.groupBy(*key, "clause", "term", "len", "start").agg(F.count("*").alias("n")).where("n = len").select(*key, "clause", "start")
    wanted = terms.where("clause IS NOT NULL").select("query_id", "clause").distinct().groupBy("query_id").agg(F.count("*").alias("clauses"), F.collect_list("clause").alias("each"))
    banned = F.max(F.col("clause").isNull()).over(Window.partitionBy(*key))
    starts = found.withColumn("banned", banned).where("NOT banned").drop("banned").join(F.broadcast(wanted), "query_id")
    # the last start of every clause up to each start: a sliding cover, so frequent words make no pairs
    so_far = Window.partitionBy(*key, "target").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    last = starts.select("*", F.explode("each").alias("target")).withColumn("last", F.max(F.when(F.col("clause") == F.col("target"), F.col("start"))).over(so_far))
    covers = last.groupBy(*key, "start").agg(F.min("last").alias("first"), F.count_if(F.col("last").isNull()).alias("open"), (F.count("*") / F.first("clauses")).cast("long").alias("n"))
    best = covers.groupBy(*key).agg(F.min(F.when(F.col("open") == 0, F.col("start") - F.col("first") + 1)).alias("span"), F.sum("n").alias("n")).where("span IS NOT NULL")
    return top(best, ["source", "query_id"], [F.asc("span"), F.desc("n"), F.asc("id")], k)


def gram_search(names: DataFrame, queries: DataFrame, least: float, k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: best label of each entity by trigram similarity to a query of three letters or more.

    ``queries`` is a short stated list of (query_id, query), so each label meets every query where it lies.
    """
    grams = names.select(F.col("entity_id").alias("id"), tx.trigrams_by_word(F.col("label")).alias("s"))
    asked = queries.where(F.length("query") >= 3).select("query_id", tx.trigrams_by_word(F.col("query")).alias("q"))
    shared = F.size(F.array_intersect("s", "q"))
    scored = grams.join(F.broadcast(asked), F.arrays_overlap("s", "q")).select("query_id", "id", (shared / (F.size("s") + F.size("q") - shared)).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top(best, ["query_id"], [F.desc("score"), F.asc("id")], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or for different dimensions."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank)`` by cosine; ``queries`` (query_id, q) is a short stated list that every task holds."""
    scored = vectors.join(F.broadcast(queries)).where("id <> query_id").select("query_id", "id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return top(scored, ["query_id"], [F.desc_nulls_last("score"), F.asc("id")], k)


def context(assertions: DataFrame, found: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, subject, predicate, object, excerpt)``: the first ``k`` assertions by position that touch what each query found.

    ``found`` has (query_id, id), a bounded list a query. ``evidence`` has (assertion_id, excerpt); the least excerpt stands for
    an assertion, none is null. An assertion that touches several of the entities found counts once.
    """
    ends = assertions.select(F.col("id").alias("assertion"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("id"))
    touching = ends.join(found.select("query_id", "id").distinct(), "id").select("query_id", F.col("assertion").alias("id")).distinct()
    first = top(touching.join(assertions, "id"), ["query_id"], [F.asc("from_pos"), F.asc("id")], k)
    quotes = evidence.select(F.col("assertion_id").alias("id"), "excerpt").join(first.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("excerpt").alias("excerpt"))
    return first.join(quotes, "id", "left").select("query_id", "rank", "id", "subject", "predicate", "object", "excerpt")


def _held_in(few: DataFrame, many: DataFrame) -> DataFrame:
    """Columns of both of rows whose token set ``a`` is a proper part of the set ``b``, met on the token of ``a`` that ``many`` has least."""
    flat = many.select("*", F.explode("b").alias("t"))
    freq = flat.groupBy("t").agg(F.count("*").alias("f"))
    own = [c for c in few.columns if c != "a"]
    rarest = few.select(*own, "a", F.explode("a").alias("t")).join(freq, "t", "left").groupBy(*own, "a").agg(F.min(F.struct(F.coalesce("f", F.lit(0)), "t")).alias("o")).withColumn("t", F.col("o.t")).drop("o")
    return rarest.join(flat, "t").where((F.size("a") < F.size("b")) & (F.size(F.array_except("a", "b")) == 0))


def catalogue(wanted: DataFrame, shelf: DataFrame, least: float = 0.62, margin: float = 0.05) -> DataFrame:
    """``(label, name, score)``: the entry of the ``shelf`` (name, first) that each ``wanted`` label means, none if none does.

    A cascade: equal after normalising 1, the same words in another order 0.95, an entry with all words of the label and more
    0.85 (0.75 for a label of one word), an entry with some words of the label and no others 0.7. A label that none of these
    finds takes the entry with the greatest trigram similarity, if it is ``least`` or more and ``margin`` above the next name.
    Equal scores go to the smallest ``first``, then name. Labels and entries without a letter or digit match by equality alone.
    """
    w = wanted.select("label").where("label IS NOT NULL").distinct()
    c = shelf.where("name IS NOT NULL").groupBy("name").agg(F.min("first").alias("first"))
    words = {"label": F.array_distinct(tx.tokens(F.col("label"))), "name": F.array_distinct(tx.tokens(F.col("name")))}
    same = w.withColumn("k", tx.normalise(F.col("label"))).join(c.withColumn("k", tx.normalise(F.col("name"))), "k").withColumn("score", F.lit(1.0))
    turned = w.withColumn("k", tx.signature(F.col("label"))).where("k <> ''").join(c.withColumn("k", tx.signature(F.col("name"))), "k").withColumn("score", F.lit(0.95))
    wider = _held_in(w.withColumn("a", words["label"]), c.withColumn("b", words["name"])).withColumn("score", F.when(F.size("a") > 1, 0.85).otherwise(0.75))
    narrower = _held_in(c.withColumn("a", words["name"]), w.withColumn("b", words["label"])).withColumn("score", F.lit(0.7))
    cols = ["label", "name", "first", "score"]
    found = same.select(cols).union(turned.select(cols)).union(wider.select(cols)).union(narrower.select(cols))
    sure = top(found, ["label"], [F.desc("score"), F.asc("first"), F.asc("name")], 1)
    sure = materialise(sure)
    left = materialise(w.join(sure, "label", "left_anti").select(F.col("label").alias("l"), tx.trigrams_by_word(F.col("label")).alias("set")))
    right = materialise(c.select(F.col("name").alias("r"), tx.trigrams_by_word(F.col("name")).alias("set")))
    near = jaccard_join(left, right, [], least - margin)
    near = near.select(F.col("l").alias("label"), F.col("r").alias("name"), "score").join(c, "name")
    ranked = top(near, ["label"], [F.desc("score"), F.asc("first"), F.asc("name")], 2)
    clear = ranked.groupBy("label").agg(F.max_by("name", -F.col("rank")).alias("name"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    clear = clear.where((F.col("score") >= least - 1e-9) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin - 1e-9)))
    return sure.select("label", "name", "score").union(clear.select("label", "name", "score"))


def expand_best(lists: dict[str, DataFrame], edges: DataFrame, seeds: int, k: int) -> DataFrame:
    """``(query_id, id, rank)``: neighbours of the ``seeds`` best nodes of the fused lists that are no seeds themselves, those of low degree first.

    ``lists`` are short, and so are the nodes and seeds taken from them: of ``edges`` (source, target) only what touches these
    is told apart and counted.
    """
    fused = materialise(fuse(lists))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    nodes = ends.join(F.broadcast(fused.select("id").distinct()), "id", "left_semi").distinct()
    best = materialise(top(fused.join(nodes, "id"), ["query_id"], [F.desc("score"), F.asc("id")], seeds).select("query_id", "id"))
    links = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))
    near = links.join(F.broadcast(best.withColumnRenamed("id", "node")), "node").select("query_id", F.col("other").alias("id")).distinct().join(F.broadcast(best), ["query_id", "id"], "left_anti")
    degree = ends.join(near, "id").groupBy("query_id", "id").agg(F.count("*").alias("degree"))
    scored = degree.withColumn("score", 1 / (1 + F.log1p("degree")))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "rank")


def fuse(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank)`` lists: score, and the modes that found each."""
    both = None
    for mode, df in lists.items():
        one = df.select("query_id", "id", "rank", F.lit(mode).alias("mode"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))
