"""Phrases, manifests and license scans against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF

from vantage.llm import licenses, manifest, phrases, queries

ROWS = [
    (1, "red fox. red fox, the red fox runs\tfar", "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, "A b a b A b a b; A B", "de", "a"),
    (4, "A b a b A b a b; A B", "de", "a"),
    (5, "red fox the red fox runs far\nthe red fox runs", "en", None),
    (None, "a b", None, "b"),
    (7, "ß é b\n\nß é b", "fr", "b"),
    (7, "other text of one id", "fr", "b"),
] + [(100 + i, "one two three four five " * (i % 7) + f"w{i % 3} one two", "en", f"s{i % 4}") for i in range(60)]


def frame(spark, rows=ROWS):
    rows = [(i, t, lang, source, None if t is None else len(t), "extra") for i, t, lang, source in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def mined(rows, support, kept):
    f, size = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: n for p, n in f.items() if n >= support and len(p[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if any(g == lang and len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), n in often.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], size[lang]))
    return sorted((g, r, p.decode(), -a, x, y, n, -s) for g, rows in out.items() for r, (s, a, p, x, y, n) in enumerate(sorted(rows)[:kept], 1))


@pytest.mark.parametrize("sample", [1, 3, 10**6])
def test_phrases_are_those_of_brute_force_whatever_the_sample(spark, sample):
    found, passes = phrases.frequent_phrases(frame(spark), support=4, sample=sample)
    got = sorted(tuple(r) for r in phrases.collocations(found, 5).collect())
    assert got == mined(ROWS, 4, 5)
    assert passes == 1 if sample == 1 else passes <= 4
    if sample > 100:
        assert passes > 1  # nothing was proposed, so the border failed


def test_phrases_of_nothing(spark):
    assert phrases.collocations(phrases.frequent_phrases(frame(spark, []))[0]).collect() == []
    assert phrases.collocations(phrases.frequent_phrases(frame(spark, ROWS[1:3]), support=1)[0]).collect() == []


def test_phrases_of_one_very_long_text(spark):
    rows = [(1, "a b c " * 300_000, "en", "s")]
    got = sorted(tuple(r) for r in phrases.collocations(phrases.frequent_phrases(frame(spark, rows))[0]).collect())
    assert got == mined(rows, 30, 2000)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proved(rows):
    """The manifest by lists: every level of every tree is built anew for each leaf."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def climb(nodes, i):
        siblings = []
        while len(nodes) > 1:
            runs = [nodes[j : j + 3] for j in range(0, len(nodes), 3)]
            own = runs[i // 3]
            siblings.append((own[: i % 3], own[i % 3 + 1 :]))
            nodes, i = [digest(*r) for r in runs], i // 3
        return nodes[0], siblings

    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[s]], 0)[0] for s in names]
    out = []
    for j, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(trees[s]):
            sub, low = climb([x[2] for x in trees[s]], i)
            root, high = climb(subroots, j)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in low + high:
                folded = digest(*before, folded, *after)
            out.append((r["doc_id"], own, sub, root, digest(*(x for b, a in low + high for x in b + a)), folded, folded == root))
    return sorted(out, key=str)


def test_manifest_of_nulls_ties_and_repeats(spark):
    table = frame(spark)
    assert sorted((tuple(r) for r in manifest.manifest(table).collect()), key=str) == proved([r.asDict() for r in table.collect()])


def test_manifest_of_nothing_and_of_one_row(spark):
    assert manifest.manifest(frame(spark, [])).collect() == []
    one = frame(spark, [(4, "a\nb", "en", None)])
    assert [tuple(r) for r in manifest.manifest(one).collect()] == proved([r.asDict() for r in one.collect()])


def test_manifest_over_several_stages(spark):
    rows = [(i, f"t\n{i}", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(7000)]
    table = frame(spark, rows)
    got = {r["doc_id"]: tuple(r) for r in manifest.manifest(table).collect()}
    assert len(got) == len(rows)
    # proofs are checked by folding the leaf with the siblings of an independently built tree
    trees = defaultdict(list)
    for r in sorted(rows):
        trees[r[3]].append(got[r[0]][1])
    tops = []
    for s in sorted(trees):
        nodes = trees[s]
        while len(nodes) > 1:
            nodes = [digest(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
        tops.append(nodes[0])
    while len(tops) > 1:
        tops = [digest(*tops[j : j + 3]) for j in range(0, len(tops), 3)]
    assert {r[3] for r in got.values()} == set(tops)
    assert all(r[6] == (zlib.crc32(str(i).encode()) % 2 == 1) for i, r in got.items())


def test_manifest_query(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in queries()["op12_merkle_manifest"](spark, SF).collect()), key=str)
    assert got == proved([r.asDict() for r in table.collect()])


LICENSED = [
    (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License. MIT license"),
    (2, "the GNU General Public License, version 2.0 or any later version; gnu general public license"),
    (3, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"),
    (4, "SPDX-License-Identifier: BSD-3-Clause"),
    (5, "CC BY-SA 4.0 and cc by, CC-BY"),
    (6, None), (7, ""), (8, "mit licenses; apachelicense; cc bye; gnu general public"),
    (9, "the GPL v3 and the LGPL 2.1, lgpl version 2"),
    (10, "Creative Commons Attribution ShareAlike 4.0 International License"),
    (None, "mit license"), (11, "mit license " * 30_000), (12, "ÉMIT license mit license mit　license"),
]


def scanned(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    form = "".join(f" {w}." for w in words)
    base, found = [], []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    for i, rule in enumerate(licenses.RULES):
        for m in re.finditer(licenses.pattern(rule.words), form):
            start = form.count(".", 0, m.start())
            found.append((start, start + m.group().count("."), rule.priority, i, rule.label))
    left = [x for x in found if not any(y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:3] != x[:3] or y[3] < x[3]) for y in found)] if len(found) < 2000 else None
    at = [i for i, _ in base]
    out = (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})))
    if left is None:
        return out
    miss = 1.0
    for _, w in {(x[4], licenses.WEIGHTS[x[2]]) for x in left}:
        miss *= 1 - w
    return (*out, ",".join(sorted({x for _, x in base} | {x[4] for x in left})), round(1 - miss, 6))


def test_licenses_are_those_of_brute_force(spark):
    table = spark.createDataFrame([(i, t, "x", 5) for i, t in LICENSED], "doc_id long, text string, labels string, n_words int")
    rows = licenses.scan(table).collect()
    assert len(rows) == len(LICENSED)
    text = dict(LICENSED)
    for r in rows:
        want = scanned(text[r["doc_id"]])
        assert tuple(r[c] for c in licenses.RESULT[: len(want)]) == want
    got = {r["doc_id"]: r["labels"] for r in rows}
    assert got[1] == "mit" and got[2] == "gpl,gpl-2.0-or-later" and got[3] == "apache,apache-2.0" and got[4] == "bsd-3-clause"
    assert got[5] == "cc-by,cc-by-sa-4.0" and got[9] == "gpl-3.0,lgpl-2.0,lgpl-2.1" and got[10] == "cc-by-sa-4.0" and got[6] == got[8] == ""


def test_every_rule_matches_its_own_words():
    """A rule with all its optional words, gaps filled, is found, and its keyword stands in it."""
    for rule in licenses.RULES:
        words = re.sub(r"(\S+) \?(\S+)", r"\1\2", rule.words).replace(".{1,60}", "x")
        plain = [re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"s\{0,1\}", "s", w.removesuffix("?").split("|")[0])).replace("v?", "v") for w in words.split()]
        form = "".join(f" {w}." for w in plain)
        assert re.fullmatch(licenses.pattern(rule.words), form), rule
        assert rule.keyword in re.findall(r"[^ .]+", form), rule


def test_a_keyword_stands_in_all_that_a_rule_matches():
    """The prefilter loses nothing: the word of a keyword is neither optional nor one of several."""
    for rule in licenses.RULES:
        assert rule.keyword in rule.words.split(), rule


def test_license_query(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries()["op13_license_scans"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = scanned(text[r["doc_id"]])
        assert tuple(r[c] for c in licenses.RESULT[: len(want)]) == want


def test_licenses_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
