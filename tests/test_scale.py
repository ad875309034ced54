"""Queries whose rows meet many to many: what they must not sort, shuffle or pair, and the same rows all the same."""

from __future__ import annotations

import hashlib
import random
from types import SimpleNamespace

from conftest import SF

from vantage import registry
from vantage.operators import grams, search, text, validate
from vantage.plans import audits, matching, store, temporal


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenes_are_numbered_before_questions_meet_them(spark):
    p = plan(registry.queries()["context_window"](spark, SF))
    assert p.index("ShuffledHashJoin") < p.index("Window") and "Sort" not in p[: p.index("ShuffledHashJoin")]


def test_a_window_is_written_as_runs_of_scenes(spark):
    """All questions of a scene follow one another, so reference and scene are runs; few bytes are dealt to many tasks."""
    v = SimpleNamespace(
        scenes=spark.createDataFrame([(f"e{i:03}", 3 + i % 2, None, i) for i in range(200)], "id string, shown_pos int, told_pos int, recorded long"),
        questions=spark.createDataFrame([(f"q{i}", 4) for i in range(20)], "id string, opened_pos int"),
    )
    got = audits.context_window(v)
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    rows = [tuple(r) for r in got.select("scene", "ref", "id").collect()]
    order = sorted((3 + i % 2, i, f"e{i:03}") for i in range(200))
    assert sorted(rows) == sorted((e, f"b{k + 1}", f"q{i}") for k, (_, _, e) in enumerate(order) for i in range(20))
    assert 1 + sum(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False)) == 200


def test_links_of_the_cast_are_not_sorted_out_after_they_are_made(spark):
    p = plan(registry.queries()["link_cast"](spark, SF))
    assert "Aggregate" not in p[: p.index("ShuffledHashJoin")]


def test_every_scene_has_its_cast(spark):
    v = SimpleNamespace(
        scenes=spark.createDataFrame([("e1-0", 0, 3, None), ("e1-1", 1, 3, None), ("e1-2", 2, None, 5), ("e2-0", 0, 9, None)], "id string, ord int, shown_pos int, told_pos int"),
        entities=spark.createDataFrame([("c1", "character"), ("n1", "place"), ("c2", "character")], "id string, node_type string"),
        occurrences=spark.createDataFrame([("c1", 3, "appearance", True), ("n1", 5, "appearance", True), ("c2", 3, "mention", True), ("c2", 5, "appearance", False)], "entity_id string, pos int, kind string, stated boolean"),
    )
    assert sorted(map(tuple, store.link_cast(v).collect())) == [("c1", "e1-0", "participates_in"), ("c1", "e1-1", "participates_in"), ("n1", "e1-2", "located_at")]


def test_two_bearers_of_a_name_decide_a_twin(spark):
    n = 50
    v = SimpleNamespace(
        entities=spark.createDataFrame([(f"c{i:02}", "character", 1, "accepted") for i in range(n)], "id string, node_type string, first_pos int, status string"),
        names=spark.createDataFrame([(f"c{i:02}", "NAME" if i % 2 else "name", "true_name", 1) for i in range(n)] + [("c07", "alone", "true_name", 1)], "entity_id string, label string, kind string, revealed_pos int"),
        proposals=spark.createDataFrame([("k0", "c00", "entity"), ("k1", "c30", "entity"), ("k2", "c01", "event"), ("k3", "c07", "entity"), ("k4", "zz", "entity")], "id string, subject string, category string"),
    )
    twins = matching.exact_twin(v)
    assert {tuple(r) for r in twins.collect()} == {("k0", "c01"), ("k1", "c00"), ("k3", "c00")}
    assert "WindowGroupLimit" in plan(twins)


def test_nearest_against_brute_force(spark):
    rng = random.Random(12)
    sets = {f"i{n}": frozenset(rng.sample(range(12), rng.randrange(2, 9))) for n in range(90)}
    df = spark.createDataFrame([(i, int(i[1:]) % 2, sorted(s)) for i, s in sets.items()], "id string, kind int, set array<int>")
    got = {(r["l"], r["r"]) for r in grams.nearest(df, ["kind"], 0.25, 3).collect()}
    want = set()
    for a in sets:
        scored = sorted((-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), b) for b in sets if a != b and int(a[1:]) % 2 == int(b[1:]) % 2)
        want |= {(a, b) for s, b in scored[:3] if -s >= 0.25}
    assert got == want


def test_entities_of_one_name_are_candidates_of_each_other(spark):
    rng = random.Random(21)
    labels = ["Ann Lee"] * 12 + ["ann lee"] * 2 + ["Lee Ann"] * 3 + ["Ann Leo", "Anna Lee", "Zed", "Bob", "Bob"] + ["".join(rng.choice("abn le") for _ in range(8)) for _ in range(30)]
    rows = [(f"c{i:02}", "group" if i % 9 == 8 else "character", label) for i, label in enumerate(labels)]
    v = SimpleNamespace(
        entities=spark.createDataFrame([(i, kind, 1, "accepted") for i, kind, _ in rows], "id string, node_type string, first_pos int, status string"),
        names=spark.createDataFrame([(i, label, "true_name", 1) for i, _, label in rows], "entity_id string, label string, kind string, revealed_pos int"),
    )
    grams = {r["label"]: set(r["g"]) for r in v.names.select("label", text.trigrams_by_word(v.names["label"]).alias("g")).collect()}
    want = []
    for i, kind, label in rows:
        scored = [(-len(grams[label] & grams[m]) / (len(grams[label] | grams[m]) or 1), j) for j, other, m in rows if j != i and other == kind]
        want += [(i, j, round(-s, 6)) for s, j in sorted(scored)[:8] if -s >= 0.25]
    assert sorted(map(tuple, matching.trgm_block(v).collect())) == sorted(want)


def test_copies_are_not_compared(spark):
    base = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven", "red green blue black white grey"]
    rows = [(i, base[i % 2]) for i in range(1, 41)] + [(0, base[2]), (50, base[2]), (51, None), (52, "")]
    v = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, text string"))
    sets, copies = matching.word_classes(v)
    assert {r["doc_id"] for r in sets.collect()} == {0, 1, 2} and copies.count() == 39
    echo = {r["x"]: (r["y"], r["score"]) for r in matching.find_echo(v).collect()}
    assert echo == {2: (1, round(9 / 11, 6)), 50: (0, 1.0)} | {i: (1 if i % 2 else 2, 1.0) for i in range(3, 41)}
    assert {r["x"]: r["folded_into"] for r in matching.fold_echoes(v).collect()} == {50: 0} | {i: 1 for i in range(2, 41)}


def test_passages_of_a_few_texts_are_held_at_once(spark):
    """A task that takes one frame from the splitter has cut no more than its share of the texts."""
    from vantage.sources import passages

    docs = spark.createDataFrame([(i, f"text {i}. " * 90 if i % 3 else None) for i in range(700)], "doc_id long, text string").coalesce(1)
    got = passages.split_passages(docs, "doc_id", "text")
    assert {(r["id"], r["ord"]): r["passage"] for r in got.collect()} == {(i, n): p for i in range(700) if i % 3 for n, p in enumerate(passages.cut(f"text {i}. " * 90))}
    assert 0 < passages.AT_ONCE < 700


def test_a_fact_takes_its_names_before_it_is_seen_from_both_ends(spark):
    """The plan is read from the result down: between the explode and the result no row is joined or shuffled."""
    p = plan(registry.queries()["entity_sheet"](spark, SF))
    assert "Generate explode" in p and "Join" not in p[: p.index("Generate explode")] and "Exchange" not in p[: p.index("Generate explode")]


def test_a_sheet_tells_all_names_facts_and_evidence(spark):
    v = SimpleNamespace(
        entities=spark.createDataFrame([(i, "character", 1, "accepted") for i in "abcd"] + [("late", "character", 50, "accepted")], "id string, node_type string, first_pos int, status string"),
        assertions=spark.createDataFrame([("i", "a", "same_as", "b", 5, None, 1.0, "accepted"), ("f", "b", "owns", "c", 6, None, 0.5, "accepted"), ("g", "c", "seeks", "late", 6, None, 0.5, "accepted")], "id string, subject string, predicate string, object string, from_pos int, until_pos int, confidence double, status string"),
        names=spark.createDataFrame([("a", "An", "alias", 50, 2), ("b", "Bo", "true_name", 100, 3), ("b", "Zo", "true_name", 200, 99), ("d", "Di", "alias", 50, 1)], "entity_id string, label string, kind string, precedence int, revealed_pos int"),
        evidence=spark.createDataFrame([("v2", "f", "y y", "text"), ("v1", "f", "", "visual"), ("v3", "f", None, "text"), ("v10", "f", "x", "text")], "id string, assertion_id string, excerpt string, kind string"),
    )
    every = "v1 visual \nv10 text x\nv2 text y y\nv3 text"
    got = {tuple(r[c] for c in ("root", "label", "direction", "predicate", "other", "other_label", "id", "quote", "quotes", "evidence")) for r in temporal.entity_sheet(v).collect()}
    assert got == {
        ("a", "Bo", "out", "same_as", "b", None, "i", None, 0, None),
        ("a", "Bo", "out", "owns", "c", "?", "f", "x", 2, every), ("c", "?", "in", "owns", "a", "Bo", "f", "x", 2, every),
        ("a", "Bo", "name", "alias", "a", "An", None, None, 0, None), ("a", "Bo", "name", "true_name", "b", "Bo", None, None, 0, None), ("d", "Di", "name", "alias", "d", "Di", None, None, 0, None),
    }


def test_facts_that_no_proposal_meets_do_not_travel(spark, monkeypatch):
    p = plan(registry.queries()["detect_conflicts"](spark, SF))
    assert p.count("LeftSemi") >= 3 and p.count("l_linenumber") > 0
    rng = random.Random(5)
    preds = ["refutes", "seeks", "leads", "dies_at", "other"]
    draw = lambda i: (f"x{i}", rng.choice("abcdef"), rng.choice(preds), rng.choice(["a", "b", "B", "", None]))
    new = [(*draw(i), rng.randrange(9)) for i in range(60)] + [("n", None, "refutes", "a", 9), ("n", None, "leads", "a", 9)]
    old = [(*draw(i), rng.randrange(9), rng.choice([None, 5, 9]), rng.choice(["accepted", "proposed"])) for i in range(90)] + [("f", None, "leads", "a", 0, None, "accepted"), ("g", "a", "other", "a", 0, None, "accepted")]
    want = []
    for i, s, p, o, pos in new:
        for j, t, q, u, since, until, status in old:
            if status != "accepted" or since >= pos or (until is not None and until <= pos) or s is None or t is None:
                continue
            if p == "refutes":
                want += [(i, j, "explicit refutation", since)] * (o is not None and u is not None and sorted((s, o)) == sorted((t, u)))
            elif s == t and p == "seeks" and q == "dies_at":
                want.append((i, j, "action after death", since))
            elif s == t and p == q and p in ("leads", "dies_at") and o and u and o.lower() != u.lower():
                want.append((i, j, "another answer", since))
    frames = spark.createDataFrame(new, "id string, subject string, predicate string, object string, pos int"), spark.createDataFrame(old, "id string, subject string, predicate string, object string, from_pos int, until_pos int, status string")
    for few in (validate.FEW_ENDS, 0):
        monkeypatch.setattr(validate, "FEW_ENDS", few)
        assert sorted(tuple(r) for r in validate.conflicts(*frames).collect()) == sorted(want)


def test_a_state_of_the_ingest_serves_many_documents(spark, tmp_path, monkeypatch):
    """One file a batch: replayed documents are not written again, one that returns to an older text is."""
    import os

    from vantage.streaming import feeds

    days = [[(i, f"t{i}") for i in range(-3, 300)], [(i, f"t{i}") for i in range(-3, 300)] + [(299, "new"), (None, "x")], [(5, "other"), (5, None), (2**40, "far")], [(5, "t5"), (299, "new")]]
    for n, rows in enumerate(days):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if not (tmp_path / f"{f.name}.seen").exists():
                (tmp_path / f"{f.name}.seen").touch()
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    monkeypatch.setattr(feeds, "shared_root", lambda spark: f"file://{tmp_path}/out")
    monkeypatch.setattr(feeds, "source", lambda spark, path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = {r["doc_id"]: r["fingerprint"] for r in feeds.ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    last = max(sha("new"), sha("t299"))
    assert got == {i: sha(f"t{i}") for i in range(-3, 299)} | {299: sha("new"), 2**40: sha("far")}
    (base,) = (tmp_path / "out").iterdir()
    log = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/log")
    assert {r["batch"]: r["count"] for r in log.groupBy("batch").count().collect()} == {0: 303, 2: 2, 3: 1} | ({1: 1, 3: 1} if last == sha("new") else {3: 2})
    assert spark.read.format("statestore").load(f"{base}/state").count() == 4


def test_texts_are_cut_into_tokens_once_for_a_web_search(spark):
    p = plan(registry.queries()["lexical_search"](spark, SF))
    assert p.count("Generate posexplode(filter") == 1


def test_short_lists_meet_labels_and_edges_where_they_lie(spark):
    rng = random.Random(3)
    names = spark.createDataFrame([(f"e{i}", "".join(rng.choice("ab ") for _ in range(7))) for i in range(60)] + [("n", None)], "entity_id string, label string")
    queries = spark.createDataFrame([("q1", "aab ba"), ("q2", "bbb"), ("q3", "ab")], "query_id string, query string")
    found = search.gram_search(names, queries, 0.3, 5)
    assert plan(found).count("Generate") == 0
    grams = lambda t: {w[i : i + 3] for x in (t or "").split() for w in [f"  {x} "] for i in range(len(w) - 2)}
    want = []
    for q, text in (("q1", "aab ba"), ("q2", "bbb")):
        scored = sorted((-len(grams(text) & grams(r["label"])) / len(grams(text) | grams(r["label"])), r["entity_id"]) for r in names.collect())
        want += [(q, i, round(-s, 9), k + 1) for k, (s, i) in enumerate([x for x in scored if -x[0] >= 0.3][:5])]
    assert sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in found.collect()) == sorted(want)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("c", "e"), ("x", "y")], "source string, target string")
    lists = {"one": spark.createDataFrame([("q", "a", 1), ("q", "zz", 2), ("q", "b", 3)], "query_id string, id string, rank int")}
    assert [tuple(r) for r in search.expand_best(lists, edges, 1, 9).orderBy("rank").collect()] == [("q", "b", 1), ("q", "c", 2)]
    assert [tuple(r) for r in search.expand_best(lists, edges, 2, 9).collect()] == [("q", "c", 1)]


def test_only_pairs_that_share_many_rare_elements_take_their_sets_along(spark, monkeypatch):
    """Large sets share a few rare elements by chance: such pairs are dropped before any set travels; blocks lose no pair."""
    rng = random.Random(8)
    sets = {i: set(rng.sample(range(20_000), 1200)) for i in range(24)}
    for i in range(24, 40):  # near copies, some in chains
        drop = rng.sample(sorted(sets[i - 24]), rng.randrange(40, 400))
        sets[i] = (sets[i - 24] - set(drop)) | {50_000 + 1000 * i + k for k in range(rng.randrange(200))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "i long, set array<int>")
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    seen, real = [], grams._judged
    monkeypatch.setattr(grams, "_judged", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    for t, block in ((0.6, 1024), (0.8, 3)):
        monkeypatch.setattr(grams, "BLOCK", block)
        got = {(r["l"], r["r"]): (r["shared"], r["score"]) for r in grams.jaccard_join(df.withColumnRenamed("i", "l"), df.withColumnRenamed("i", "r"), [], t, "r < l").collect()}
        want = {(a, b): (len(sets[a] & sets[b]), score(a, b)) for a in sets for b in sets if b < a and score(a, b) >= t}
        assert not set(got.items()) ^ set(want.items())
        assert want and seen[-1] < 2 * len(want) + 5
