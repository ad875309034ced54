"""The corpus operators on small fixtures against brute force, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantage.llm import dedup, html, language, media, mixing, packing, substrings, topk, toxicity, warc
from vantage.llm.words import Words, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é ß 漢字 \x1c x y"), (6, "word " * 3000), (7, None), (8, "one")]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("kept", "n_words", "id", "block", "score", "src")}) if extra else df


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 160))]
        if i % 5 == 4 and out:
            words = out[rng.randrange(len(out))].split() + words[:3]
        if i % 7 == 6:
            words += [rng.choice(["same", "passage"]) for _ in range(3)] + [f"p{k}" for k in range(30)]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return [(i, t) for i, t in enumerate(out)]


def test_words_match_the_pattern():
    texts = [t for _, t in ODD] + ["a\x0bb\x0cc", "x" * 5000]
    raw, at = text_bytes(pa.array(texts, pa.string()))
    w = Words.of(raw, at)
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    got = [bytes(raw[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    by_word = {}
    for word, h in zip(got, w.hashes().tolist(), strict=True):
        assert by_word.setdefault(word, h) == h


# --- substring dedup


def brute_substrings(rows, k=20):
    seen, gone = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone[i] |= set(range(a, a + k))
            else:
                seen[key] = (i, a)
    return {i: " ".join(x for n, x in enumerate(WORD.findall(t or "")) if n not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("rows", [sample_texts(), ODD, []], ids=["sample", "odd", "empty"])
def test_substrings_against_brute_force(spark, rows):
    got = {r["doc_id"]: r["kept"] for r in substrings.deduplicate(docs(spark, rows, extra=True)).collect()}
    assert got == brute_substrings(rows)


def test_substrings_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    got = substrings.deduplicate(docs(spark, [(None, text), (3, text), (3, text)])).select("doc_id", "n_removed").collect()
    assert sorted(((r[0] is None, r[0], r[1]) for r in got), key=str) == sorted([(True, None, 30), (False, 3, 0), (False, 3, 0)], key=str)


@pytest.mark.parametrize("i", [None, 5, (1 << 63) - 1])
def test_substrings_of_one_id_with_several_texts(spark, i):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    passage, shared = words("p", 30), words("s", 25)
    rows = [(1, passage), (i, words("a", 40) + " " + passage), (i, words("b", 60)), (i, words("c", 3)), (i, shared + " x"), (i, shared + " y z")]
    rows += [(i, words("d", 50)), (i, words("d", 50))]
    got = {(r["doc_id"], r["text"]): r["kept"] for r in substrings.deduplicate(docs(spark, rows).coalesce(1)).collect()}
    dealt = {(r["doc_id"], r["text"]): r["kept"] for r in substrings.deduplicate(docs(spark, rows).repartition(8)).collect()}
    assert got == dealt
    # of two texts that begin alike one keeps the passage, in the order of a hash; copies of one row lose nothing
    assert sorted([got.pop((i, shared + " x")), got.pop((i, shared + " y z"))], key=len)[0] in ("x", "y z")
    assert got == {(d, t): words("a", 40) if t.startswith("a0") else t for d, t in rows if not t.startswith("s0")}


def test_substrings_null_id_sorts_after_the_greatest(spark):
    texts = [" ".join(f"{n}{k}" for k in range(30)) for n in "abcdefgh"]
    rows = [(i, f"{t} {i}") for t in texts for i in (None, (1 << 63) - 1)]
    got = substrings.deduplicate(docs(spark, rows)).select("doc_id", "n_removed").collect()
    assert {(r[0] is None, r[1]) for r in got} == {(True, 30), (False, 0)}


@pytest.mark.parametrize("split", [0, 3, 60])
def test_split_minimisers_change_no_result(spark, split):
    rows = sample_texts(seed=4, n=80)
    rows += [(100 + i, f"{' '.join(f'u{i}x{k}' for k in range(14))} one line that all of them share here {' '.join(f'v{i}x{k}' for k in range(14 + i % 2))}") for i in range(60)]
    rows += [(200, rows[-1][1]), (201, "lead " + rows[-2][1]), (202, None)]
    got = {r["doc_id"]: r["kept"] for r in substrings.deduplicate(docs(spark, rows), split=split, sample=1).collect()}
    assert got == brute_substrings(rows)


def test_a_shared_line_is_split_by_what_lies_around_it(spark):
    line = " ".join(f"l{k}" for k in range(12))
    rows = [(i, f"{' '.join(f'u{i}x{k}' for k in range(20))} {line} {' '.join(f'v{i}x{k}' for k in range(20))}") for i in range(300)]
    table = docs(spark, rows).select(F.col("doc_id").alias("_skid"), F.lit(-1).cast("long").alias("_skhigh"), F.lit(0).cast("long").alias("_sklow"), "text")
    hot = substrings.frequent_keys(table, least=400, sample=1)
    w = Words.of(*text_bytes(pa.array([t for _, t in rows])))
    h = w.hashes()
    starts, window = w.windows(h, 20)
    most = lambda keys: np.unique(keys, return_counts=True)[1].max()
    plain, dealt = (substrings.route(h, starts, 20, 4, x) for x in (np.zeros(0, np.uint64), hot))
    assert 0 < len(hot) < 30 and most(plain) > 600 and most(dealt) <= 400
    by_window = {}
    assert all(by_window.setdefault(a, b) == b for a, b in zip(window.tolist(), dealt.tolist(), strict=True))


def test_hash_collisions_change_nothing():
    raw, at = text_bytes(pa.array(["a b c d a b c e a b c d"]))
    w = Words.of(raw, at)
    codes = pa.array("a b c d a b c e a b c d".split()).dictionary_encode().indices.to_numpy()
    starts, first = substrings.repeats(w, codes, np.zeros(12, np.uint64), 4)
    assert [(int(s), int(starts[f])) for s, f in zip(starts, first, strict=True) if starts[f] != s] == [(8, 0)]


# --- near copies


def shingle_bag(text, k=5):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def near_rows():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    rows, base = [], [rng.choice(vocab) for _ in range(300)]
    for i in range(30):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rng.choice(vocab) for _ in range(200))) for i in range(30)]
    return rows + [(200, rows[0][1] + " "), (201, None), (202, ""), (203, "tiny"), (204, "tiny")]


def test_near_copies_against_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in dedup.near_copies(docs(spark, rows)).collect()}
    bags = {i: shingle_bag(t or "") for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                j = sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())
                if j >= 0.86:  # far enough above the threshold that neither weights nor bands decide
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
                    assert got[a]["class_id"] == got[b]["class_id"], (a, b, j)
    assert all(got[100 + i]["class_id"] == 100 + i for i in range(30))
    assert got[200]["copy_of"] == 0 and got[204]["class_id"] == 203
    assert got[201]["class_id"] == 201 and got[202]["class_id"] == 202


@pytest.mark.parametrize("shift", [0, 8], ids=["few samples agree", "low bytes agree in every band"])
def test_near_copies_that_share_one_band(spark, monkeypatch, shift):
    def samples(doc, shingle, weight, count, seed=1):
        own = np.arange(1, len(np.unique(doc)) + 1, dtype=np.uint32)[:, None] << np.uint32(shift)
        out = np.repeat(own, count, axis=1)
        out[:, 5:10] = 7  # the second band
        return out

    monkeypatch.setattr(dedup, "samples", samples)
    base = [f"w{i}" for i in range(400)]
    # the head is far from both others, which are near each other
    rows = [(0, " ".join(base[:200] + [f"h{i}" for i in range(200)])), (1, " ".join(base)), (2, " ".join([*base[:-10], "x"]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in dedup.near_copies(docs(spark, rows).coalesce(1)).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1)}


def test_recall_of_the_bands(spark):
    """Shares of pairs that meet in a band, by weighted similarity from the threshold on, over 1 500 pairs of a mixed corpus."""
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(50_000)]
    line = " ".join(rng.choice(common) for _ in range(60))
    rows = []
    for i in range(1500):
        base = [*line.split(), *(rng.choice(rare) for _ in range(rng.randrange(60, 300)))]
        other = list(base)
        for _ in range(rng.randrange(0, max(2, len(base) // 40))):
            other[rng.randrange(len(other))] = rng.choice(rare)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    table = docs(spark, rows).withColumnRenamed("doc_id", "id")
    idf = dedup.document_frequency(table)
    pairs = spark.range(1500).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    likeness = {r["a"]: r["similarity"] for r in dedup.similarities(table, pairs, idf).collect()}
    bands = {r["id"]: r["bands"] for r in dedup.signatures(table, idf).collect()}
    met = {a: any(x == y for x, y in zip(bands[a], bands[a + 1], strict=True)) for a in likeness}
    for low, high, least in ((0.8, 0.86, 0.985), (0.86, 0.9, 0.995), (0.9, 1.01, 1.0)):
        some = [met[a] for a, s in likeness.items() if low <= s < high]
        assert len(some) > 100 and np.mean(some) >= least, (low, len(some), np.mean(some))


def test_a_large_group_links_through_its_middle(spark):
    """Members of a third of the corpus that are edited apart from one text, which is not the least id."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    rows = [(900, " ".join(base))]
    for i in range(150):
        w = list(base)
        at = rng.randrange(380)
        w[at : at + 8] = [f"e{i}x{j}" for j in range(8)]
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(9000)}" for _ in range(200))) for i in range(300)]
    rows += [(900, " ".join(base)), (900, "another text of this id"), (2000, "word " * 30_000)]
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_copies(docs(spark, rows, extra=True)).collect()}
    assert {got[i] for i in range(150)} == {0} and got[2000] == 2000 and all(got[1000 + i] == 1000 + i for i in range(300))


def test_profiles_bound_what_is_shared(spark):
    table = docs(spark, near_rows()).withColumnRenamed("doc_id", "id")
    idf = dedup.document_frequency(table)
    known = {r["id"]: r for r in dedup.profiles(table, idf).collect()}
    pairs = table.select(F.col("id").alias("a")).crossJoin(table.select(F.col("id").alias("b"))).where("a < b AND b < 130")
    ruled_out = 0
    for r in dedup.similarities(table, pairs, idf).collect():
        a, b = known[r["a"]], known[r["b"]]
        shared = sum(min(x, y) for x, y in zip(a["profile"], b["profile"], strict=True))
        assert shared / (a["total"] + b["total"] - shared) >= r["similarity"] - 1e-9
        ruled_out += shared / (a["total"] + b["total"] - shared) < 0.8
    assert ruled_out > 100


def test_near_copies_of_nothing(spark):
    assert dedup.near_copies(docs(spark, [])).count() == 0
    assert [r["class_id"] for r in dedup.near_copies(docs(spark, [(1, None)])).collect()] == [1]


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:250], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    wa, wb = 1 + (a % np.uint64(3)), 1 + (b % np.uint64(3))
    s = dedup.samples(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([wa, wb]).astype(float), 4000)
    shared = wa[np.isin(a, b)].sum()
    assert abs((s[0] == s[1]).mean() - shared / (wa.sum() + wb.sum() - shared)) < 0.03


# --- media


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.features(media.store(docs(spark, ODD, extra=True))).collect()}
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[i]["n_bytes"] == len(raw)
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:]) and got[i]["media_bytes"] == len(media.encode_wav(payload))
        assert media.decode_wav(media.encode_wav(payload)) == payload
    assert got[4]["feature"] == got[8]["feature"] and got[1]["feature"] == got[2]["feature"]


def test_fingerprints_do_not_depend_on_the_chunk():
    payload = bytes(random.Random(1).randrange(256) for _ in range(576 * 9))
    assert (media.fingerprints(payload, chunk=4) == media.fingerprints(payload)).all() is np.True_


# --- WARC


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        parts = [sorted(rng.randrange(40) for _ in range(rng.randrange(15))) for _ in range(k)]
        assert list(warc.LoserTree(parts)) == sorted(sum(parts, []))


def test_warc_round_trip_and_order(spark):
    rows = [(1, "http://a.example/x", "same"), (2, None, None), (3, "http://b.example/", "same"), (4, "not a url [", ""), (5, "http://a.example/x", "ünï\r\n\r\nbody"), (5, "http://a.example/x", "ünï\r\n\r\nbody")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    captures = warc.read_archives(warc.write_archives(warc.winners(pages)))
    merged = warc.merged_index(captures, range_rows=2, run_rows=2).orderBy("capture_rank").collect()
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in merged]
    assert keys == sorted(keys) and [r["capture_rank"] for r in merged] == list(range(len(rows)))
    ranges = [r["index_range"] for r in merged]
    assert ranges == sorted(ranges) and len(set(ranges)) > 1
    for r in merged:
        body = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        last = max(i for i, _, h in rows if (h or "").encode() == body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and r["payload_bytes"] == len(body)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
    none = warc.merged_index(warc.read_archives(warc.write_archives(warc.winners(pages.limit(0)))))
    assert none.count() == 0


def test_url_keys():
    assert warc.url_key("https://www.B.Example.com:80/A/b?Q=1#f") == "com,example,b)/a/b?q=1" and warc.url_key("http://u@h.x") == "x,h)/"
    assert warc.url_key(None) == "" and warc.url_key(" Not a url ") == "not a url"


@pytest.mark.parametrize("share", [1, 1000], ids=["by join", "by broadcast"])
def test_warc_winners_of_hot_payloads(spark, share):
    rows = [(i, None, "same" if i % 3 else str(i % 5)) for i in range(60)] + [(None, None, "same"), (59, None, "same"), (70, None, "x" * 3_000_000)]
    got = {(r["page_id"], r["html"]): r["refers_to"] for r in warc.winners(spark.createDataFrame(rows, "page_id long, url string, html string"), share).collect()}
    for i, _, h in rows:
        last = max(j for j, _, g in rows if g == h and j is not None)
        assert got[i, h] == (None if i == last else last)


# --- packing


def test_packing_covers_every_id_once(spark):
    rows = [*ODD, (9, "long text " * 6000)]
    cut = packing.pieces(docs(spark, rows, extra=True))
    got = packing.pack(cut, group_rows=4).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    model = packing.WordTokenizer(packing.tokenizer_path())
    for i, t in rows:
        ids = np.array([*model.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, total, crc in sorted(by_doc[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0


def test_units_go_alone_if_the_vocabulary_splits_them():
    model = packing.WordTokenizer(packing.tokenizer_path())
    model.ends_word[:] = True  # as if a word could end inside
    ids, n = model.encode(*text_bytes(pa.array(["extraordinarily unsplittable words", "x"])))
    assert ids[: n[0]].tolist() == model.tokenizer.encode("extraordinarily unsplittable words", add_special_tokens=False).ids


def test_window_fill_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 9))]
        first = max(lengths)
        chosen = packing.fill_window(Counter(lengths), 100, first)
        rest = list(lengths)
        rest.remove(first)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 100 - first}
        assert not Counter(chosen) - Counter(lengths) and sum(chosen) == first + max(sums)


def test_units_give_the_tokenizers_ids():
    texts = ["It's A'S <|endoftext|>. x<|ENDOFTEXT|>y É. ×. ÷! Ünß a…. 12.5 ??! ΣΑΣ. İx. ﬁ", "", None, "don't. stop!!!   nbsp", "é. Å!"]
    model = packing.WordTokenizer(packing.tokenizer_path())
    ids, n = model.encode(*text_bytes(pa.array(texts, pa.string())))
    at = 0
    for t, k in zip(texts, n, strict=True):
        assert model.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[at : at + k].tolist()
        at += k


# --- language


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    m = language.Model(["x", "y"], *[language.Direction(rng.normal(0, 0.2, (9, 257)), rng.normal(0, 0.2, (9, 3))) for _ in range(2)], rng.normal(0, 0.5, (2, 7)))
    x, y = rng.integers(0, 5, (6, 4)), np.array([0, 1, 1, 0])

    def loss():
        total = 0.0
        n = 3
        h, lefts = np.zeros((n, 4)), []
        for t in range(6):
            h = m.left.step(x[t], h)
            lefts.append(h)
        h = np.zeros((n, 4))
        for t in range(5, -1, -1):
            h = m.right.step(x[t], h)
            p = m.out @ np.concatenate([lefts[t], h, np.ones((1, 4))])
            p = np.exp(p - p.max(axis=0))
            total -= np.log((p / p.sum(axis=0))[y, np.arange(4)]).sum()
        return total / 24

    for param, grad in zip(m.params(), language.gradients(m, x, y), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) if k != 257 else rng.integers(0, 5) for k, s in zip(param.shape, param.shape, strict=True))
            old = param[at]
            param[at] = old + 1e-3
            up = loss()
            param[at] = old - 1e-3
            down = loss()
            param[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_language_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "123 ### ½ ² ①"), (4, "word")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs(spark, rows, extra=True), None).collect()}
    assert set(got.values()) == {("und", 0.0)}
    m = language.train([b"aaaa aaab", b"zzzz zzzy"], ["a", "z"], steps=30, batch=16, span=16)
    assert language.predict(docs(spark, []), m).count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs(spark, [*rows, (5, "aaaa " * 400), (6, "zzzz zzzz")]), m).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] == "a" and got[6] == "z"


def test_language_pools_every_position():
    """Document probabilities against a network run byte by byte over each span."""
    m = language.train([b"aaaa aaab", b"zzzz zzzy"], ["a", "z"], steps=5, batch=8, span=8)
    texts = ["", "az", "aazz" * 9 + "q"]
    got = language.document_probabilities(m, *text_bytes(pa.array(texts)), span=16, lanes=2)
    for text, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        raw = text.encode()
        for a in range(0, len(raw), 16):
            span = np.frombuffer(raw[a : a + 16], np.uint8).astype(int)
            n = m.left.inner.shape[1]
            h, left, right = np.zeros((n, 1), np.float32), [], []
            for b in span:
                h = m.left.step(np.array([b]), h)
                left.append(h)
            h = np.zeros((n, 1), np.float32)
            for b in span[::-1]:
                h = m.right.step(np.array([b]), h)
                right.append(h)
            for x, y in zip(left, right[::-1], strict=True):
                z = m.out @ np.concatenate([x, y, np.ones((1, 1))])
                total += (np.exp(z - z.max()) / np.exp(z - z.max()).sum())[:, 0]
        assert p == pytest.approx(total / max(1, len(raw)), abs=1e-4)


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(table.select("doc_id", "text", "lang"), language.fit(table, per_lang=100)).where(language.held_out()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


# --- toxicity


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta omega kappa".split()) + rng.choice("abc") for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "vrakka" + rng.choice("xyzuvw") * 2])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    table = docs(spark, rows)
    model = toxicity.fit(*toxicity.training_features(table, spark.createDataFrame(labels, "doc_id long, toxic int")))
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    fresh = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in fresh]) > 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.5


def test_label_model_corrects_wrong_labels_and_counts_copies_once():
    rng = np.random.default_rng(2)
    truth = rng.random(2000) < 0.3
    rates = [(0.8, 0.05)] * 4
    fires = np.stack([np.where(truth, rng.random(2000) < a, rng.random(2000) < b) for a, b in rates], axis=1)
    clean = np.stack([np.where(truth, rng.random(2000) < 0.1, rng.random(2000) < 0.7) for _ in range(2)], axis=1)
    noisy = rng.random(2000) < np.where(truth, 0.5, 0.3)  # a poor voter, copied five times
    votes = np.concatenate([fires, clean, np.repeat(noisy[:, None], 5, axis=1)], axis=1).astype(float)
    post, found = toxicity.label_model(votes, np.array([1] * 4 + [-1] * 2 + [1] * 5), 0.3)
    assert np.mean((post > 0.5) == truth) > 0.95
    assert abs(found["rate"][1][:4] - 0.8).max() < 0.06 and abs(found["rate"][0][4:6] - 0.7).max() < 0.06
    parent = found["parent"]
    assert all(parent[j] >= 6 or any(parent[i] == j for i in range(6, 11)) for j in range(6, 11))  # the copies hang together
    assert all(parent[j] < 6 for j in range(6))


def test_label_model_posterior_against_brute_force():
    """The last step over all voters of a row, from the rates that the model returns."""
    rng = np.random.default_rng(4)
    votes = (rng.random((300, 5)) < 0.4).astype(float)
    polarity = np.array([1, 1, 1, -1, -1])
    post, m = toxicity.label_model(votes, polarity, 0.4, rounds=1)
    start = np.where(votes @ polarity > 0, 0.9, np.where(votes @ polarity < 0, 0.1, 0.4))
    for row in range(0, 300, 17):
        odds = start.mean() / (1 - start.mean())
        for j in range(5):
            above = int(votes[row, m["parent"][j]]) if m["parent"][j] >= 0 else 0
            p = [m["given"][c, above, j] if votes[row, j] else 1 - m["given"][c, above, j] for c in (0, 1)]
            odds *= p[1] / p[0]
        assert post[row] == pytest.approx(odds / (1 + odds), abs=1e-9)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    empty = toxicity.fit(*toxicity.training_features(docs(spark, []), labels))
    rows = [(None, "x"), (1, "you idiot"), (1, "you idiot"), (5, "idiot " * 20_000), (6, None)]
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score(docs(spark, rows, extra=True), empty).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (1, 1), (1, 1), (5, 1), (6, 0)], key=str)
    few = docs(spark, [(i, "bad vrakk" if i % 2 else "all is well") for i in range(40)], extra=True)
    model = toxicity.fit(*toxicity.training_features(few, labels))
    assert {r["doc_id"] % 2: r["predicted"] for r in toxicity.score(few, model).collect()} == {0: 0, 1: 1}


def test_toxicity_without_labels(spark):
    model = toxicity.fit(*toxicity.training_features(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, [(1, "you idiot"), (2, "fine")]), model).collect()}
    assert got == {1: 1, 2: 0}


# --- top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (300, 8)).astype(np.float32)
    v[40:120] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (None, v[0].tolist()), (50, v[50].tolist()), (950, [1.0, 2.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, shard_rows=64, block_queries=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(256 * v.astype(float)).astype(int)
    for i in range(0, 300, 10):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert 950 not in got and 900 not in got
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_over_several_batches_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_SHARDS", 2)
    monkeypatch.setattr(topk, "BATCH_BLOCKS", 2)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 1, (200, 3)) * 4) / 4  # many ties
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[3].tolist()), (500, [])], "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit("clash") for c in ("v", "dim", "shard", "block", "batch", "part")})
    got = topk.top_k(table, every=2, shard_rows=16, block_queries=8).collect()
    q = np.floor(256 * v).astype(int)
    want = {(i, n + 1, j, -s) for i in range(0, 200, 2) for n, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(200) if j != i)[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


# --- mixing


def test_mixing_meets_budget_and_keeps_everything(spark):
    rows = [(i, ["big", "mid", "small", None][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2 if i % 20 < 10 else 3], "w " * (1 + i % 7)) for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("weight", F.lit("clash")).withColumn("src", F.lit("clash"))
    m = mixing.plan_mixture(table)
    got = mixing.mix_sources(table, m).select("doc_id", "source", "mix_epoch", F.size(F.split(F.trim("text"), " ")).alias("n")).collect()
    assert {r["doc_id"] for r in got} == set(range(4000))
    assert len({(r["doc_id"], r["mix_epoch"]) for r in got}) == len(got)
    tokens, base = Counter(), Counter()
    for r in got:
        tokens[r["source"] or ""] += r["n"]
    for _, s, t in rows:
        base[s or ""] += len(t.split())
    for r in m.plan.collect():
        assert 0 <= tokens[r["src"]] - r["passes"] * base[r["src"]] <= 8
    passes = [r["passes"] for r in m.plan.collect()]
    assert max(passes) / min(passes) <= mixing.MAX_PASSES + 1e-6 and m.exponent < 1


def test_mixing_small_cases(spark):
    for rows in ([], [(1, None, None)], [(1, "a", "x y"), (2, "b", "")]):
        table = spark.createDataFrame(rows, "doc_id long, source string, text string")
        assert mixing.mix_sources(table, mixing.plan_mixture(table)).count() == len(rows)


# --- HTML


def extracted(spark, pages, **kw):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), **kw).collect()}


def test_html_cases(spark):
    page = "<html><body><header>Site</header><nav><a>m</a></nav><div class='sidebar'>s</div><main><h1>T &amp; x</h1><p>a<br>b <i>c</i>d<p>e<!-- n --><div class=\"cookie-notice\">no</div><ul><li>1<li>2</ul><section id=comments>c</section><form>f</form><script>var x='<p>'</script></main><footer>z"
    cases = {
        page: "T & x\n\na b cd\n\ne\n\n1\n\n2",
        "": "",
        "plain  text": "plain text",
        "<p>cut <b": "cut",
        "a < b": "a < b",
        "<div>" * 3000 + "deep": "deep",
        # names that only hint at furniture lose nothing
        '<div class="content-sidebar-wrap"><main><p>Article text</p></main></div>': "Article text",
        '<article><p>One</p><div class="social-history">Of the guilds</div></article>': "One\n\nOf the guilds",
        '<div class="lead">Before it</div><article><p>One</p></article>': "Before it\n\nOne",
        '<div class="share-buttons">x</div><article>a<div class="ad">buy</div></article><article class="comment">me too</article><div class="related"><article>more</article></div>': "a",
        '<form><article>in a form</article></form><form><input>mail</form><div role="navigation">n</div><p hidden>h</p>': "in a form",
    }
    got = extracted(spark, [(i, f"http://h{i}.example/", h) for i, h in enumerate(cases)])
    assert got == dict(enumerate(cases.values()))


def brute_importance(pages):
    """Importance of each path by the definition: every entropy from its list of features."""
    import math

    seen = {}
    for host, page in pages:
        own = {}
        for path, base, kind, look, text in html.styles(html.parse(page)):
            own.setdefault(path, (base, kind, [], []))[2].append(look)
            own[path][3].append(text)
        for path, (base, kind, looks, texts) in own.items():
            seen.setdefault((host, path), (base, kind, [], []))[2].append(tuple(looks))
            seen[host, path][3].append(tuple(texts))

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(values.count(v) / m * math.log(values.count(v) / m, m) for v in set(values))

    own = {k: (len(x) * (0.2 * entropy(x) + 0.8 * entropy(y)) + 0.5) / (len(x) + 0.5) for k, (_, _, x, y) in seen.items()}
    prior = {0: (0.5, 0.5), 1: (0, 1), 2: (0, 0.5), 3: (0, 0.1)}
    return {k: prior[kind][0] + prior[kind][1] * min(1, own[k] / own[k[0], base]) for k, (base, kind, _, _) in seen.items()}


def test_importance_against_brute_force(spark):
    rng = random.Random(3)
    pages = []
    for i in range(60):
        blocks = "".join(f"<{t} class='{c}'>{rng.choice(['same', 'other', str(i)])}</{t}>" for t, c in zip("ppbbi", rng.choices(["x", "y", "ad", "share-x"], k=5), strict=True))
        pages.append((rng.choice("ab"), f"<body><nav>{rng.random()}</nav>{rng.choice(['<article>', '<div>'])}{blocks}<p>{rng.choice('uvw')}</p></body>"))
    got = {(r["host"], r["path"]): r["importance"] for r in html.style_tree(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert got == pytest.approx(brute_importance(pages), abs=1e-9) and len({round(v, 3) for v in got.values()}) > 10


def test_the_tree_decides_inside_and_outside_articles(spark):
    rows = []
    for i in range(20):
        own = f"<p>Story {i} of {i * i}</p>"
        rows.append((i, "http://a.example/", f"<div class='q'>Read us daily</div><article>{own}<div class='z'>Same in all</div></article>"))
        # a site that repeats whole articles: sameness tells nothing
        rows.append((100 + i, "http://b.example/", "<nav>go</nav><article><p>One story</p><p>again</p></article>"))
    rows += [(300, "http://c.example/", rows[0][2]), (None, None, "<p>alone"), (0, "http://a.example/", rows[0][2])]
    for limit in (1_000_000, 0):
        got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_paths=limit).collect()
        assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 0] == ["Story 0 of 0"] * 2
        got = {r["page_id"]: r["text"] for r in got}
        assert all(got[i] == f"Story {i} of {i * i}" and got[100 + i] == "One story\n\nagain" for i in range(20))
        assert got[300] == "Read us daily\n\nStory 0 of 0\n\nSame in all" and got[None] == "alone"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, "http://h.example/" + str(i), f"<body><div class='x'>Read all our stories</div><div class='y'><p>Story {i} has its own words {i * i}</p></div></body>") for i in range(12)]
    rows += [(100, None, None), (101, "::", "<p>alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("low", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert all(got[i] == f"Story {i} has its own words {i * i}" for i in range(12)) and got[100] == "" and got[101] == "alone"
    assert html.extract(pages.limit(0)).count() == 0


def test_style_tree_reads_every_element_of_a_path(spark):
    tags = "b i u em strong span code sub sup small q s".split()
    pages = [("h", f"<body><div class='x'><{t}>same</{t}></div>" + "<div class='x'><p>same</p></div>" * 64 + "</body>") for t in tags]
    path = next(p for p, _, _, look, text in html.styles(html.parse("<body><div class='x'><p>same</p></div></body>")) if look == html._hash("p"))
    tree = lambda p: {r["path"]: r["importance"] for r in html.style_tree(spark.createDataFrame(p, "host string, html string")).collect()}
    assert tree(pages)[path] > 0.9
    same = [(h, text.replace(f"<{t}>", "<p>").replace(f"</{t}>", "</p>")) for (h, text), t in zip(pages, tags, strict=True)]
    beside = [(h, f"<p>{i}</p>{text}") for i, (h, text) in enumerate(same)]
    assert tree(beside)[path] < html.LEAST_IMPORTANCE


def test_near_copies_of_an_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (9, b), (10, b + " tail"), (11, "other words that nobody else has written here"), (3, b + " end"), (3, "z" + a)]
    got = {r["doc_id"]: r for r in dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9]["class_id"] == got[10]["class_id"] == got[3]["class_id"] == 3
    assert got[5]["copy_of"] == 5 and got[9]["copy_of"] == 5 and got[11]["class_id"] == 11
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_copies(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()}
    assert got == {5: 5, 9: 5, 10: 5}


def test_warc_keeps_negative_and_null_ids(spark, tmp_path):
    rows = [(-5, "http://a.b/x", "<p>one</p>"), (-1, "http://a.b/x", "<p>one</p>"), (None, "http://a.b/x", "<p>two</p>"), (7, None, None), (7, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op5_warc(spark, str(tmp_path)).collect()]
    assert len(got) == 5 and {(-5, "revisit", -1), (-1, "response", None)} <= set(got)
    assert sorted(str(x[0]) for x in got) == ["-1", "-5", "7", "7", "None"]
