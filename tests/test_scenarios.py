"""Small frames: what is visible one position before and at a revelation, invariants, and stream against batch."""

from __future__ import annotations

from conftest import SF
from pyspark.sql import functions as F

from vantage import registry
from vantage.functions.fuzzy import least_edits
from vantage.operators import folds
from vantage.operators import graph as gr
from vantage.operators import horizon as hz
from vantage.operators import identity as idn
from vantage.operators import search, store, validate
from vantage.operators import text as tx
from vantage.operators.components import components_of_few, connected_components
from vantage.operators.grams import jaccard_join, overlap_join, within_hamming
from vantage.plans import streams
from vantage.sources.passages import cut
from vantage.sources.shared import materialise
from vantage.sources.views import Views
from vantage.streaming import feeds


def world(spark):
    entities = spark.createDataFrame([("a", "character", 1, "accepted"), ("b", "character", 1, "accepted"), ("c", "object", 1, "accepted"), ("late", "character", 35, "accepted"), ("guess", "character", 1, "proposed")], "id string, node_type string, first_pos int, status string")
    rows = [("i1", "a", "same_as", "b", 30, None, 1.0, "accepted"), ("i2", "a", "same_as", "c", 5, None, 1.0, "proposed"), ("o1", "b", "owns", "c", 2, None, 0.5, "accepted"), ("o2", "a", "owns", "c", 3, 20, 0.9, "accepted"), ("o3", "a", "seeks", "late", 2, None, 0.9, "accepted")]
    assertions = spark.createDataFrame(rows, "id string, subject string, predicate string, object string, from_pos int, until_pos int, confidence double, status string")
    names = spark.createDataFrame([("a", "the stranger", "placeholder", 10, 1), ("a", "Alias", "alias", 50, 10), ("a", "True", "true_name", 100, 50), ("b", "never", "true_name", 100, None)], "entity_id string, label string, kind string, precedence int, revealed_pos int")
    return entities, assertions, names


def test_identity_folds_from_its_position_on(spark):
    entities, assertions, _ = world(spark)
    roots = {h: {r["id"]: r["root"] for r in idn.identity_components(entities, assertions, h).collect()} for h in (29, 30)}
    assert roots[29] == {"a": "a", "b": "b", "c": "c"}
    assert roots[30] == {"a": "a", "b": "a", "c": "c"}


def test_unset_horizon_shows_nothing(spark):
    entities, assertions, names = world(spark)
    assert hz.asof_entities(entities, None).count() == hz.asof_assertions(assertions, None).count() == hz.asof(names, "revealed_pos", None).count() == 0


def test_best_label_by_horizon(spark):
    _, _, names = world(spark)
    shown = lambda h: {r["entity_id"]: r["label"] for r in hz.best_label(names, h).collect()}
    assert (shown(9), shown(49), shown(50)) == ({"a": "the stranger"}, {"a": "Alias"}, {"a": "True"})


def test_refuted_belief_goes_but_stays_stored(spark):
    _, assertions, _ = world(spark)
    ids = lambda h: {r["id"] for r in hz.asof_assertions(assertions, h).collect()}
    assert "o2" in ids(19) and "o2" not in ids(20) and assertions.where("id = 'o2'").count() == 1


def test_projection_counts_every_visible_entity_once(spark):
    entities, assertions, names = world(spark)
    graph = gr.project(entities, assertions, names, 40)
    nodes = graph.nodes.collect()
    assert sum(r["members"] for r in nodes) == hz.asof_entities(entities, 40).count()
    assert {r["root"]: r["degree"] for r in nodes} == {"a": 2, "c": 1, "late": 1}
    assert not graph.meta.first()["truncated"] and graph.meta.first()["merged_away"] == sum(r["members"] - 1 for r in nodes)
    cut = gr.project(entities, assertions, names, 40, limit=1)
    assert [r["root"] for r in cut.nodes.collect()] == ["a"] and cut.meta.first()["truncated"] and cut.edges.count() == 0


def test_components_on_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, None), (500, 500)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), materialise).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[500] == 500


def test_both_ways_to_components_agree(spark):
    import random

    rng = random.Random(9)
    edges = spark.createDataFrame([(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)], "src string, dst string")
    assert sorted(map(tuple, components_of_few(edges).collect())) == sorted(map(tuple, connected_components(edges, materialise).collect()))


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long"), materialise).count() == 0


def test_shortest_path_tells_the_way(spark):
    edges = spark.createDataFrame([("a", "owns", "b", 5), ("b", "gives", "a", 3), ("c", "seeks", "b", 9), ("x", "owns", "y", 1)], "source string, predicate string, target string, first_pos int")
    path = lambda a, b, most=6: sorted(tuple(r) for r in gr.shortest_path(edges, a, b, most).collect())
    assert path("a", "x") == [] and path("a", "a") == [] and path("a", "c", 1) == []
    assert path("a", "c") == [(0, "a", None, None), (1, "b", "gives", 3), (2, "c", "seeks", 9)]


def test_overlap_join_loses_no_pair(spark):
    import random

    rng = random.Random(4)
    sets = {i: {rng.randrange(16) for _ in range(rng.randrange(0, 10))} for i in range(90)}
    df = spark.createDataFrame([(i % 2, i, sorted(s)) for i, s in sets.items()], "pos int, id int, set array<int>")
    for ratio, shared in ((0.34, 3), (0.7, 2), (1.0, 1)):
        got = {(r["x"], r["y"]): r["shared"] for r in overlap_join(df, ["pos"], ratio, shared).collect()}
        want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and a % 2 == b % 2 and len(sets[a] & sets[b]) >= max(shared, ratio * min(len(sets[a]), len(sets[b])))}
        assert got == {k: n for k, n in want.items() if n}


def test_keep_first_against_the_loop(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(150):
        words = rng.sample("abcdefghij", rng.randrange(2, 8))
        rows.append((f"s{i}", i % 3, rng.randrange(100), words, rng.sample(["Ann", "Bo"], rng.randrange(0, 3))))
    scenes = spark.createDataFrame(rows, "id string, pos int, place int, words array<string>, names array<string>")
    got = {r["id"]: (r["kept"], r["twin_of"]) for r in folds.keep_first(scenes).collect()}
    want, kept = {}, []
    for i, pos, _, words, names in sorted(rows, key=lambda r: (r[2], r[0])):
        w, n = set(words), set(names)
        like = lambda k: k[1] == pos and min(len(w), len(k[2])) >= 4 and len(w & k[2]) >= max(2, 0.7 * min(len(w), len(k[2]))) and (not n - k[3] or not k[3] - n)  # noqa: B023, E731
        twin = next((k[0] for k in kept if like(k)), None)
        want[i] = (twin is None, twin)
        if twin is None:
            kept.append((i, pos, w, n))
    assert got == want and 10 < sum(k for k, _ in got.values()) < 140
    assert folds.keep_first(scenes.limit(0)).count() == 0


def test_two_people_make_two_scenes(spark):
    texts = ["Zed cuts Kuro in the hall of the old inn", "Zed cuts Hachi in the hall of the old inn", "Zed cuts Kuro and leaves in the hall of the old inn with Koby", "He cuts"]
    df = spark.createDataFrame([(f"e{i}", 1, t) for i, t in enumerate(texts)], "id string, pos int, summary string")
    scenes = df.select("id", "pos", tx.content_tokens(F.col("summary")).alias("words"), tx.capitalised(F.col("summary")).alias("names"))
    assert {(r["x"], r["y"]) for r in folds.same_beats(scenes).collect()} == {("e0", "e2")}


def test_hamming_pairs_are_complete(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(12)]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 13))) for h in base for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id int, h long")
    got = {(r["id"], r["id2"]) for r in within_hamming(df, "id", "h", 10).collect()}
    assert got == {(a, b) for a in range(96) for b in range(a + 1, 96) if (hashes[a] ^ hashes[b]).bit_count() <= 10} and got


def test_language_marks_count_next_to_accents(spark):
    texts = ["élan le la les des est dans pour une que", "the of and to in is that for été", "the la " * 20, "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.detect_language(F.col("t"))).collect()]
    assert got == ["fr", "en", None, None, None]


def test_ingest_replaces_changed_documents(spark, tmp_path):
    for day, rows in enumerate(([(1, "a"), (2, "b"), (None, "x")], [(1, "a2"), (2, "b"), (3, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = [r["doc_id"] for r in feeds.ingest(spark, str(tmp_path / "in"), schema).collect()]
    assert sorted(got) == [1, 2, 3]


def test_sliding_hours_over_the_cap(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, 8)
    rows = [(7, "view", at + dt.timedelta(minutes=5 * i)) for i in range(4)] + [(7, "view", at + dt.timedelta(hours=9)), (8, "view", at)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = feeds.refused(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 3).collect()
    starts = sorted(r["start"] for r in got)
    assert {(r["user_id"], r["used"]) for r in got} == {(7, 4)} and starts == [at - dt.timedelta(minutes=40) + dt.timedelta(minutes=10 * i) for i in range(5)]


def test_jaccard_join_loses_no_pair(spark):
    import random

    rng = random.Random(3)
    sets = {i: sorted({rng.randrange(14) for _ in range(rng.randrange(1, 9))}) for i in range(120)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "i int, set array<int>")
    for t in (0.3, 0.6, 0.8):
        got = {(r["l"], r["r"]) for r in jaccard_join(df.withColumnRenamed("i", "l"), df.withColumnRenamed("i", "r"), [], t).collect()}
        want = {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert got == want


def test_passages_bounds():
    text = "One. " * 400 + "\n\n" + "x" * 1500 + "\n\nshort\n\n" + "A line of some length that stands by itself for once."
    parts = cut(text)
    assert all(0 < len(p) <= 600 for p in parts) and cut("") == [] and cut("   ") == []
    assert "".join(text.split()) == "".join("".join(parts).split())


def test_least_edits():
    assert least_edits("hello", "say hallo there", 1) == 1 and least_edits("hello", "nothing", 1) == -1 and least_edits("", "x", 0) == 0


def test_stream_equals_batch(spark):
    v = Views(spark, SF)
    batch = {r["user_id"]: r["n"] for r in streams.run_state_feed(v).groupBy("user_id").count().withColumnRenamed("count", "n").collect()}
    stream = {r["user_id"]: r["changes"] for r in streams.change_feed_stream(v).collect()}
    assert stream == batch


def test_web_search_by_words_phrases_and_exclusion(spark):
    texts = [(1, "The red house stands"), (2, "house, red and blue"), (3, "red x y z house red barn"), (4, "a red house of spam"), (5, None), (6, ""), (7, "blue x x house"), (8, "red house red house")]
    frame = spark.createDataFrame([("s", str(i), t) for i, t in texts] + [("t", "1", "red house")], "source string, id string, text string")
    terms = [("and", 0, ["house"]), ("and", 1, ["red"]), ("and", 1, ["blue"]), ("and", None, ["spam"]), ("quote", 0, ["red", "house"]), ("none", 0, ["missing"])]
    asked = spark.createDataFrame(terms, "query_id string, clause int, phrase array<string>")
    got = [tuple(r) for r in search.web_search(frame, asked, 5).select("source", "query_id", "rank", "id", "span", "n").orderBy("source", "query_id", "rank").collect()]
    assert got == [
        ("s", "and", 1, "8", 2, 4), ("s", "and", 2, "2", 2, 3), ("s", "and", 3, "3", 2, 3), ("s", "and", 4, "1", 2, 2), ("s", "and", 5, "7", 4, 2),
        ("s", "quote", 1, "8", 1, 2), ("s", "quote", 2, "1", 1, 1), ("s", "quote", 3, "4", 1, 1),
        ("t", "and", 1, "1", 2, 2), ("t", "quote", 1, "1", 1, 1),
    ]


def test_export_and_purge_of_a_tenant(spark, tmp_path):
    rows = spark.createDataFrame([("7", 1), ("7", 1), ("8", 2), (None, 3), ("70", 4)], "tenant string, x int")
    tables = {"a": rows, "b": rows.where("tenant = '8'"), "c": rows.limit(0)}
    assert {tuple(r) for r in store.export(tables, "7", f"{tmp_path}/out").collect()} == {("a", 2), ("b", 0), ("c", 0)}
    assert [r[0] for r in spark.read.parquet(f"{tmp_path}/out/a").collect()] == [1, 1]
    gone = spark.createDataFrame([("7",), ("8",)], "tenant string")
    assert {tuple(r) for r in store.purge(tables, gone, f"{tmp_path}/left").collect()} == {("a", 2, 3), ("b", 0, 1), ("c", 0, 0)}
    assert sorted(r["x"] for r in spark.read.parquet(f"{tmp_path}/left/a").collect()) == [3, 4]


def test_context_of_what_queries_found(spark):
    told = spark.createDataFrame([("a1", "c1", "gives", "c2", 5), ("a2", "c2", "owns", "p1", 3), ("a3", "c3", "owns", "p2", 1), ("a4", "c1", "same_as", "c1", 5)], "id string, subject string, predicate string, object string, from_pos int")
    found = spark.createDataFrame([("q", "c1"), ("q", "c2"), ("q", "c1"), ("r", "p2"), ("s", "p9")], "query_id string, id string")
    quotes = spark.createDataFrame([("a1", "y"), ("a1", "x"), ("a9", "z")], "assertion_id string, excerpt string")
    got = search.context(told, found, quotes, 2).select("query_id", "rank", "id", "excerpt").collect()
    assert {tuple(r) for r in got} == {("q", 1, "a2", None), ("q", 2, "a1", "x"), ("r", 1, "a3", None)}


def test_catalogue_cascade(spark):
    shelf = spark.createDataFrame([("Saudi Arabia", 3), ("Arabia", 4), ("Great Old Harbour", 5), ("Harbour of the Long Night", 6), ("Kingsbridge", 7), ("Kingsbridga", 8), ("Millbrook", 9), ("--", 10), (None, 11), ("Arabia", 2)], "name string, first long")
    labels = ["SAUDI  arabia", "Arabia Saudi", "old great", "Night", "Arabia Felix", "Kingsbridge!", "Kingsbridg", "Millbrooks", "nothing", "", "--", None]
    got = {r["label"]: (r["name"], round(r["score"], 4)) for r in search.catalogue(spark.createDataFrame([(x,) for x in labels], "label string"), shelf).collect()}
    assert got == {
        "SAUDI  arabia": ("Saudi Arabia", 1.0), "Arabia Saudi": ("Saudi Arabia", 0.95), "old great": ("Great Old Harbour", 0.85), "Night": ("Harbour of the Long Night", 0.75),
        "Arabia Felix": ("Arabia", 0.7), "Kingsbridge!": ("Kingsbridge", 0.95), "Millbrooks": ("Millbrook", round(9 / 12, 4)), "--": ("--", 1.0),
    }


def test_reopened_cards_lose_their_decision(spark):
    cards = spark.createDataFrame([("a", "rejected", "r"), ("b", "deferred", "r"), ("c", "accepted", "r"), ("d", "rejected", "s"), ("e", "rejected", None)], "id string, status string, run_id string")
    decided = spark.createDataFrame([("a", "reject"), ("c", "reject"), ("c", "accept"), ("d", "reject")], "id string, action string")
    got = {tuple(r) for r in store.reopen(cards, decided, F.col("run_id") == "r").collect()}
    assert got == {("a", "proposed", None), ("b", "proposed", None), ("c", "accepted", "accept"), ("d", "rejected", "reject"), ("e", "rejected", None)}


def test_no_path_from_a_node_to_itself(spark):
    edges = spark.createDataFrame([("a", "b", "knows", 1)], "source string, target string, predicate string, first_pos int")
    assert gr.shortest_path(edges, "a", "a").collect() == []


def test_no_search_returns_what_lies_beyond_its_horizon(spark):
    from vantage.plans.catalog import H

    wider = "/root/testdata/sf0.01"  # the smallest tables tell no scene beyond the horizon
    v = Views(spark, wider)
    vectors = {r[0] for r in v.vectors.where(f"pos > {H}").select("id").collect()}
    assert vectors and not vectors & {r["id"] for r in registry.queries()["vector_search"](spark, wider).collect()}
    scenes = {r[0] for r in v.scenes.where(f"coalesce(told_pos, shown_pos, 0) > {H}").select("id").collect()}
    assert scenes
    for key in ["rrf_fuse", "lexical_search", "headline"]:
        assert not scenes & {r["id"] for r in registry.queries()[key](spark, wider).collect()}


def test_conflicts_of_three_kinds_and_no_others(spark):
    rows = [("b1", "zoe", "dies_at", "hill", 3, None), ("b2", "zoe", "member_of", "crew", 2, None), ("b3", "ann", "leads", "Crew", 2, 8), ("b4", "ann", "leads", "", 1, None), ("b5", "crew", "knows", "ann", 5, None), ("b6", "ann", "member_of", "club", 1, None), ("b7", "bo", "dies_at", None, 1, None)]
    accepted = spark.createDataFrame([(*r, "accepted") for r in rows] + [("b8", "zoe", "dies_at", "sea", 1, None, "proposed")], "id string, subject string, predicate string, object string, from_pos int, until_pos int, status string")
    claims = [
        ("dead acts", "zoe", "gives", "sword", 5), ("at once", "zoe", "gives", "sword", 3), ("no action", "zoe", "knows", "ann", 5), ("dead bo", "bo", "eats", "pie", 5), ("other death", "zoe", "dies_at", "sea", 5), ("same death", "zoe", "dies_at", "HILL", 5),
        ("second lead", "ann", "leads", "guild", 5), ("same lead", "ann", "leads", "crew", 5), ("closed", "ann", "leads", "guild", 8), ("many", "ann", "member_of", "guild", 5),
        ("refute", "zoe", "refutes", "crew", 5), ("turned", "crew", "contradicts", "zoe", 5), ("too early", "ann", "refutes", "crew", 2), ("both", "ann", "refutes", "crew", 6), ("no end", "zoe", "refutes", None, 5),
    ]
    proposed = spark.createDataFrame(claims, "id string, subject string, predicate string, object string, pos int")
    got = sorted(tuple(r) for r in validate.conflicts(proposed, accepted).collect())
    assert got == sorted([
        ("dead acts", "b1", "action after death", 3), ("dead bo", "b7", "action after death", 1), ("other death", "b1", "another answer", 3), ("second lead", "b3", "another answer", 2),
        ("refute", "b2", "explicit refutation", 2), ("turned", "b2", "explicit refutation", 2), ("both", "b5", "explicit refutation", 5),  # names are compared after normalising, the ends of a refutation as they are
    ])
    assert validate.conflicts(proposed.limit(0), accepted).count() == validate.conflicts(proposed, accepted.limit(0)).count() == 0


def test_overlap_join_counts_every_pair_of_all_blocks_once(spark, monkeypatch):
    import random

    from vantage.operators import grams

    rng = random.Random(8)
    monkeypatch.setattr(grams, "BLOCK", 7)
    rows = [(i % 2, f"{i % 9}é{i}", [f"w{rng.randrange(16)}" for _ in range(rng.randrange(0, 12))], rng.sample("ABC", rng.randrange(0, 4))) for i in range(80)]
    df = spark.createDataFrame(rows, "pos int, id string, set array<string>, names array<string>")
    got = sorted(tuple(r) for r in overlap_join(df, ["pos"], 0.5, 2, also="names").collect())
    want = []
    for p, a, s, m in rows:
        for q, b, t, n in rows:
            shared, least = len(set(s) & set(t)), min(len(set(s)), len(set(t)))
            if p == q and a < b and shared >= 2 and shared / least >= 0.5:
                want.append((p, a, b, shared, least, shared / least, len(set(m) - set(n)), len(set(n) - set(m))))
    assert got == sorted(want) and len(want) > 100
