"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its words, lower-cased, each as `` word.`` (a blank before and a point behind it), so that a rule's words match
whole words that stand consecutively. A rule is a regular expression with a keyword, a priority and a label; it is tried on
texts that hold its keyword. A place that lies inside the place of another rule of the same or a better priority is suppressed:
the name of a license inside a longer name, or a name inside a notice, says nothing by itself. Equal places go to the rule that
comes first.

Rules are written by hand as words: ``x|y`` for one of several, ``x?`` for a word that may lack, other regular expressions inside
of a word. Names and identifiers are combined with the phrases around them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents

#: Priorities, best first: text of a license, identifier tag, name with version, bare name.
TEXT, TAG, VERSIONED, BARE = 1, 2, 3, 4
#: How sure one place of a rule makes the reading that the text is licensed.
WEIGHTS = {TEXT: 1.0, TAG: 0.95, VERSIONED: 0.9, BARE: 0.6}

# The phrases of the base labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Passages of license texts and notices: label, keyword, words.
PASSAGES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "furnished", "permit persons to whom the software is furnished to do so"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "copy", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,60} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0? the license you may not use this file except in compliance"),
    ("apache-2.0", "apache", "http www apache org licenses license 2 0"),
    ("apache", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-2.0-or-later", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", "gnu", "you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("lgpl-2.1-or-later", "lesser", "terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser", "terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("agpl-3.0-or-later", "affero", "terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v? 2 0"),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e v1? 1? 0"),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public licen[cs]e v?2? 2? 0"),
    ("cddl-1.0", "distribution", "contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "public", "do what the fuck you want to public licen[cs]e"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "creative", "licensed under a? creative commons attribution 4 0 international licen[cs]e"),
    ("cc-by-sa-4.0", "creative", "licensed under a? creative commons attribution sharealike 4 0 international licen[cs]e"),
    ("ofl-1.1", "sil", "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("artistic-2.0", "artistic", "licensed under the terms of the artistic licen[cs]e 2 0"),
    ("postgresql", "written", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[cs]e"),
    ("python-2.0", "psf", "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("proprietary", "reserved", "all rights reserved"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("public-domain", "domain", "released into|to the public domain"),
    ("public-domain", "domain", "dedicated to the public domain"),
]

#: Families: label, keyword, the words of the name, and versions as (end of the label, words).
FAMILIES = [
    ("gpl", "gnu", "gnu general public licen[cs]es{0,1}", ["1 0", "2 0", "3 0"]),
    ("gpl", "gpl", "gpl", ["1 0", "2 0", "3 0"]),
    ("lgpl", "lesser", "gnu? lesser general public licen[cs]es{0,1}", ["2 0", "2 1", "3 0"]),
    ("lgpl", "library", "gnu? library general public licen[cs]es{0,1}", ["2 0"]),
    ("lgpl", "lgpl", "lgpl", ["2 0", "2 1", "3 0"]),
    ("agpl", "affero", "gnu? affero general public licen[cs]es{0,1}", ["1 0", "3 0"]),
    ("agpl", "agpl", "agpl", ["1 0", "3 0"]),
    ("gfdl", "documentation", "gnu? free documentation licen[cs]e", ["1 1", "1 2", "1 3"]),
    ("gfdl", "gfdl", "gfdl", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", "apache software? licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("apache", "asl", "asl", ["1 1", "2 0"]),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", "eclipse public licen[cs]e", ["1 0", "2 0"]),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", ["1 0"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ["1 0", "1 1"]),
    ("cpl", "common", "common public licen[cs]e", ["1 0"]),
    ("ipl", "ibm", "ibm public licen[cs]e", ["1 0"]),
    ("eupl", "eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("eupl", "european", "european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("osl", "open", "open software licen[cs]e", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic", "academic free licen[cs]e", ["1 2", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic", "artistic licen[cs]e", ["1 0", "2 0"]),
    ("bsl", "boost", "boost software licen[cs]e", ["1 0"]),
    ("busl", "business", "business source licen[cs]e", ["1 1"]),
    ("sspl", "server", "server side public licen[cs]e", ["1 0"]),
    ("elastic", "elastic", "elastic licen[cs]e", ["1 0", "2 0"]),
    ("cecill", "cecill", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
    ("lppl", "latex", "latex project public licen[cs]e", ["1 0", "1 2", "1 3"]),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", []),
    ("zpl", "zope", "zope public licen[cs]e", ["1 1", "2 0", "2 1"]),
    ("php", "php", "php licen[cs]e", ["3 0", "3 1"]),
    ("python", "python", "python software foundation licen[cs]e", ["2 0"]),
    ("psf", "psf", "psf licen[cs]e", ["2 0"]),
    ("qpl", "public", "q public licen[cs]e", ["1 0"]),
    ("sil-ofl", "open", "sil? open font licen[cs]e", ["1 0", "1 1"]),
    ("odbl", "database", "open database licen[cs]e", ["1 0"]),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", ["1 0"]),
    ("etalab", "etalab", "etalab open licen[cs]e", ["2 0"]),
    ("ogl", "government", "open government licen[cs]e", ["1 0", "2 0", "3 0"]),
    ("openrail", "openrail", "openrail m?", []),
    ("llama", "community", "llama [23]? community licen[cs]e", []),
    ("mit", "mit", "mit licen[cs]e", []),
    ("mit", "expat", "expat licen[cs]e", []),
    ("mit", "x11", "x11 licen[cs]e", []),
    ("isc", "isc", "isc licen[cs]e", []),
    ("zlib", "zlib", "zlib libpng? licen[cs]e", []),
    ("ncsa", "ncsa", "ncsa open source licen[cs]e", []),
    ("unlicense", "unlicense", "the? unlicense", []),
    ("beerware", "beerware", "beerware licen[cs]e", []),
    ("wtfpl", "wtfpl", "wtfpl", []),
    ("ruby", "ruby", "ruby licen[cs]e", []),
    ("openssl", "openssl", "openssl licen[cs]e", []),
    ("bsd-2-clause", "bsd", "bsd 2 clause|cl licen[cs]e?", []),
    ("bsd-2-clause", "bsd", "simplified|freebsd bsd licen[cs]e?", []),
    ("bsd-3-clause", "bsd", "bsd 3 clause|cl licen[cs]e?", []),
    ("bsd-3-clause", "bsd", "new|modified|revised bsd licen[cs]e?", []),
    ("bsd-4-clause", "bsd", "bsd 4 clause|cl licen[cs]e?", []),
    ("0bsd", "bsd", "zero|0 clause bsd licen[cs]e?", []),
    ("bsd", "bsd", "bsd style? licen[cs]e", []),
]

#: Creative Commons: label, long name, short name; each in VERSIONS.
COMMONS = [
    ("cc-by", "creative commons attribution", "cc by"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by-nd", "creative commons attribution no derivatives|derivs|derivatives", "cc by nd"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no derivatives|derivs", "cc by nc nd"),
]
VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# License identifiers of the SPDX list.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
    "BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 "
    "CDLA-Permissive-2.0 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 "
    "GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MirOS "
    "MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 "
    "Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()


class Rule(NamedTuple):
    keyword: str
    priority: int
    label: str
    words: str
    base: bool = False


def pattern(words: str) -> str:
    """The regular expression of a rule's words over `` word.`` forms; it needs no look-around, so engines agree on it."""
    out = []
    for word in re.sub(r"(\S+) \?(\S+)", r"\1\2|\1+\2", words).split():
        if word.startswith(".{"):  # a gap of a few words
            out.append(r"(?: [^ .]+\.){1,12}")
            continue
        often = word.endswith("?")
        options = word.removesuffix("?").split("|")
        one = "|".join(r"\. ".join(o.split("+")) for o in options)
        one = rf" (?:{one})\." if len(options) > 1 else rf" {one}\."
        out.append(f"(?:{one})?" if often else one)
    return "".join(out)


def _rules() -> list[Rule]:
    def version(v: str) -> str:
        major, minor = v.split()
        return f"version|v? v?{major} {minor}" + ("?" if minor == "0" else "")

    out = [Rule(phrase.split()[0] if phrase != "mit license" else "license", BARE, label, phrase, True) for phrase, label in BASE.items()]
    out += [Rule(keyword, TEXT, label, words) for label, keyword, words in PASSAGES]
    for name in IDENTIFIERS:
        words, label = " ".join(re.findall("[a-z0-9]+", name.lower())), name.lower()
        keyword = words.split()[0]
        out.append(Rule(keyword, TAG, label, f"spdx licen[cs]e identifier {words}"))
        out.append(Rule(keyword, TAG, label, f"licensed under the? {words} licen[cs]e?"))
        out.append(Rule(keyword, TAG, label, f"licen[cs]e {words}"))
    for label, keyword, words, versions in FAMILIES:
        for v in versions:
            for end, tail in [("-only", "only"), ("-or-later", "or any? later version?"), ("", "")]:
                out.append(Rule(keyword, VERSIONED, f"{label}-{v.replace(' ', '.')}{end}", f"{words} {version(v)} {tail}".strip()))
        out.append(Rule(keyword, BARE, label, words))
    for label, long, short in COMMONS:
        for v in VERSIONS:
            out.append(Rule("creative", VERSIONED, f"{label}-{v.replace(' ', '.')}", f"{long} {v} international|unported? licen[cs]e?"))
            out.append(Rule("cc", VERSIONED, f"{label}-{v.replace(' ', '.')}", f"{short} {v}"))
        out.append(Rule("creative", BARE, label, long))
        out.append(Rule("cc", BARE, label, short))
    out.append(Rule("cc0", VERSIONED, "cc0-1.0", "cc0 1? 0?"))
    return out


RULES = _rules()

# The bytes of words.
INSIDE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_map(rules: list[Rule]) -> Column:
    """The rules by keyword, as one constant: as large as the list of rules, whatever the corpus."""
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        row = f"named_struct('i', {i}, 'priority', {r.priority}, 'label', '{r.label}', 'base', {str(r.base).lower()}, 'pattern', r'{pattern(r.words)}')"
        by_keyword.setdefault(r.keyword, []).append(row)
    return F.expr("map(" + ", ".join(f"'{k}', array({', '.join(rows)})" for k, rows in by_keyword.items()) + ")")


def places(form: Column, rule: Column) -> Column:
    """The places of a rule in a text as ``(start, minus_end, priority, i, label, base)``, in words from 0, in one pass.

    Points and brackets are no part of a word, so brackets around each place tell, word by word, where one begins and ends.
    """
    marked = F.split(F.regexp_replace(form, rule["pattern"], F.lit("<$0>")), r"\.")
    at = F.transform(marked, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    begin = F.filter(at, lambda x: x["w"].startswith("<") | x["w"].startswith("><"))
    end = F.filter(at, lambda x: x["w"].startswith(">"))
    return F.zip_with(begin, end, lambda b, e: F.struct(
        b["i"].cast("long").alias("start"), (-e["i"]).cast("long").alias("minus_end"), rule["priority"].alias("priority"), rule["i"].alias("i"), rule["label"].alias("label"), rule["base"].alias("base"),
    ))


def kept_labels(found: Column) -> Column:
    """The distinct ``(label, weight)`` of the places that no other one suppresses, from places in their natural order.

    What may suppress a place stands before it: it begins no later and ends no earlier, and of equal places the better
    priority and the earlier rule come first. So the furthest end so far of each priority decides, in one pass.
    """
    weight = lambda p: F.element_at(F.array(*(F.lit(WEIGHTS[q]) for q in sorted(WEIGHTS))), p)

    def step(held: Column, x: Column) -> Column:
        end = -x["minus_end"]
        inside = F.exists(F.slice(held["ends"], F.lit(1), x["priority"]), lambda e: e >= end)
        ends = F.transform(held["ends"], lambda e, p: F.when(p + 1 == x["priority"], F.greatest(e, end)).otherwise(e))
        own = F.array(F.struct(x["label"].alias("label"), weight(x["priority"]).alias("weight")))
        return F.struct(ends.alias("ends"), F.when(inside, held["kept"]).otherwise(F.array_union(held["kept"], own)).alias("kept"))

    none = F.struct(F.array_repeat(F.lit(-1).cast("long"), len(WEIGHTS)).alias("ends"), F.array().cast("array<struct<label: string, weight: double>>").alias("kept"))
    return F.aggregate(found, none, step, lambda held: held["kept"])


def scan(table: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``table`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    Base rules count every place and are never suppressed; ``labels`` adds what the other rules leave. The score is the
    chance that one of the distinct labels is meant, by the weights of their priorities. Null and empty texts have no words
    and a score of 0. Nothing is shuffled; a text is read once for its words and once for each rule whose keyword it holds.
    Columns of ``table`` that are called like a result are replaced.
    """
    keywords = sorted({r.keyword for r in rules})
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(INSIDE), F.lit(0))
    read = table.withColumn("__words", words)
    read = read.withColumn("__present", F.array_intersect("__words", F.array(*map(F.lit, keywords)))).withColumn("n_words", F.size("__words").cast("long"))
    read = read.withColumn("__form", F.when(F.size("__present") > 0, F.concat(F.lit(" "), F.array_join("__words", ". "), F.lit("."))).otherwise(""))
    tried = F.flatten(F.transform("__present", lambda k: F.element_at(rule_map(rules), k)))
    hits = F.filter(tried, lambda r: F.rlike(F.col("__form"), r["pattern"]))
    read = read.withColumn("__found", F.sort_array(F.flatten(F.transform(hits, lambda r: places(F.col("__form"), r)))))
    base = F.filter("__found", lambda x: x["base"])
    read = read.withColumn("__base", base).withColumn("__kept", kept_labels(F.col("__found")))
    named = F.array_sort(F.array_distinct(F.transform("__base", lambda x: x["label"])))
    every = F.array_sort(F.array_union(F.transform("__base", lambda x: x["label"]), F.transform("__kept", lambda x: x["label"])))
    miss = F.aggregate("__kept", F.lit(1.0), lambda p, x: p * (F.lit(1.0) - x["weight"]))
    return read.select(
        *(c for c in table.columns if c not in RESULT), "n_words", F.size("__base").cast("long").alias("n_base"), F.get("__base", F.lit(0))["start"].alias("first_word"),
        F.array_max(F.transform("__base", lambda x: x["start"])).alias("last_word"), F.array_join(named, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.round(F.lit(1.0) - miss, 6).alias("score"),
    )


RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names, over whole texts; nulls and empty texts as in ``scan``, repeated rows each for itself."""
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
