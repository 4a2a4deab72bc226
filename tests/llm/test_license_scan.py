import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import license_scan as ls

MARKUP = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;words=1..2;match=[x-z]+>> d"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_optional_and_replaceable_regions():
    a = ls.TokenAutomaton("t", MARKUP)
    run = lambda t: a.matches(t.encode().split())
    assert run("a x d") == [(0, 3)] and run("a b y z d") == [(0, 5)] and run("a b c x d a x d") == [(0, 5), (5, 8)]
    assert run("a c x d") == [] and run("a b d") == [] and run("a x y z d") == [] and run("q a x e") == [] and run("") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdxyz"), max_size=14))
def test_automaton_agrees_with_a_regular_expression(text):
    a = ls.TokenAutomaton("t", MARKUP)
    found = a.matches([w.encode() for w in text])
    assert bool(found) == bool(re.search(" " + a.regex(), " " + " ".join(text) + " "))


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", "<<var;words=3..1>>", "<<other>>", "<<beginOptional>>a<<endOptional>>"])
def test_bad_markup_is_refused(bad):
    with pytest.raises(ValueError):
        ls.TokenAutomaton("t", bad)


def test_places_in_whole_texts(docs, rows, spark):
    more = spark.createDataFrame([(1, "CC-BY x cc by, All rights reserved. all RIGHTS\nreserved"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Released under the MIT License!"), (4, "released under a MIT license")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ls.scan_licenses(more).collect()}
    assert [(p["label"], p["start"]) for p in got[1]["base_places"]] == [("cc-by", 0), ("cc-by", 3), ("reserved", 5), ("reserved", 8)]
    assert [m["label"] for m in got[2]["matches"]] == ["gpl-notice"] and [m["label"] for m in got[3]["matches"]] == ["mit"] and got[4]["matches"] == []
    counts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in ls.scan_licenses(docs).collect())
    assert counts == sorted((i is None, i or 0, len(words(t))) for i, t in rows)


def test_templates_without_plain_mandatory_words(spark):
    """Expectations by hand."""
    templates = [("kind", "<<var;words=1..1;match=mit|bsd>> <<beginOptional>>licence<<endOptional>>"), ("two", "<<var;words=2..2;match=gpl|v3>>"), ("plain", "<<beginOptional>>the<<endOptional>> isc")]
    docs = spark.createDataFrame([(1, "MIT"), (2, "a bsd licence, the ISC"), (3, "gpl v3 gpl"), (4, "licence"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(m["label"], m["start"], m["end"]) for m in r["matches"]] for r in ls.scan_licenses(docs, templates).collect()}
    assert got == {1: [("kind", 0, 1)], 2: [("kind", 1, 3), ("plain", 3, 5)], 3: [("two", 0, 2)], 4: [], 5: []}


def test_empty_table(empty):
    assert ls.scan_licenses(empty).collect() == []


def test_published_headers(spark):
    """Headers as they stand in source files, with comment signs and line breaks."""
    texts = {
        "apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n * 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n * 3. Neither the name of the Académie nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    changed = {k: t.replace("permitted", "allowed").replace("compliance", "accordance").replace("redistribute", "spread").replace("without fee", "without a fee").replace("Mozilla", "other") for k, t in texts.items()}
    rows = [(k, t) for k, t in enumerate([*texts.values(), *changed.values()])]
    got = {r["doc_id"]: r for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(texts):
        mine = [m for m in got[k]["matches"] if m["label"] == label]
        assert mine and max(m["end"] - m["start"] for m in mine) >= got[k]["n_words"] - 3
        assert all(m["end"] - m["start"] < 25 for m in got[k + len(texts)]["matches"])
    a = {label: ls.TokenAutomaton(label, markup) for label, markup in ls.TEMPLATES}
    assert all(re.search(" " + a[x].regex(), " " + " ".join(words(texts[x])) + " ") for x in ("bsd", "isc", "mpl-2.0"))
