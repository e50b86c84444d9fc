import re

import pytest

from scholium.llm import licences, queries

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = sorted((k, name) for phrase, name in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({n for _, n in places}))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (b"MIT", ("MIT", ["mit"], 1)),
        (b"MIT OR Apache-2.0 and GPL-3.0-only", ("MIT OR Apache-2.0 AND GPL-3.0-only", ["apache", "gpl", "mit"], 1)),
        (b"(MIT or Apache-2.0) AND GPL-3.0-or-later", ("(MIT OR Apache-2.0) AND GPL-3.0-or-later", ["apache", "gpl", "mit"], 2)),
        (b"GPL-2.0+ WITH Classpath-exception-2.0", ("GPL-2.0+ WITH Classpath-exception-2.0", ["gpl"], 1)),
        (b"GPL-2.0 WITH x AND CC-BY-NC-4.0 OR CC0-1.0", ("GPL-2.0 WITH x AND CC-BY-NC-4.0 OR CC0-1.0", ["cc-by-nc", "cc0", "gpl"], 0)),
        (b"BSD-3-Clause is what we use", ("BSD-3-Clause", ["bsd"], 1)),
        (b"MIT and", ("MIT", ["mit"], 1)),
        (b"MIT or whatever", ("MIT", ["mit"], 1)),
        (b"MIT) or ISC", ("MIT", ["mit"], 1)),
        (b"((MIT", None),
        (b"LicenseRef-Own and MIT", ("LicenseRef-Own AND MIT", ["licenseref-own", "mit"], 3)),
        (b"(MIT and ISC) with x", ("(MIT AND ISC)", ["isc", "mit"], 1)),
        (b"see below", None),
        (b"and or with", None),
        (b"()", None),
        (b"", None),
    ],
)
def test_expressions(text, want):
    assert licences.parse(text) == want


def test_precedence_by_brackets():
    # with binds before and, and before or, both to the left
    assert licences.postfix("mit or isc and gpl with x or zlib".split()) == ["mit", "isc", "gpl", "x", "with", "and", "or", "zlib", "or"]
    assert licences.postfix("( mit or isc ) and zlib".split()) == ["mit", "isc", "or", "zlib", "and"]


def test_scan_of_tags_and_notices(spark):
    rows = [
        (1, "/* SPDX-License-Identifier: MIT OR Apache-2.0 */ code"),
        (2, '{"name": "x", "license": "BSD-3-Clause", "y": 1}'),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0. All rights reserved."),
        (5, "the mit license of a thing. MIT LICENSEé mit\xa0license mit\tlicense"),
        (6, None),
        (7, ""),
        (None, "cc by cc by cc"),
        (None, "cc by cc by cc"),
        (8, "Mİt license; King mit license"),
        (9, "License:\nMIT"),
        (10, "no word of it"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS label", "1 AS places")
    found = licences.find(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [tuple(e) for e in by[1].expressions] == [("MIT OR Apache-2.0", ["apache", "mit"], 1)] and by[1].licence_score == 0.9
    assert [tuple(e) for e in by[2].expressions] == [("BSD-3-Clause", ["bsd"], 1)]
    assert [tuple(p) for p in by[3].places] == [("gpl", 6, 4, True, True)] and by[3].licence_score == 0.8
    assert [p.label for p in by[4].places] == ["cc-by", "cc-by-nc", "all-rights-reserved"]
    assert [p.word for p in by[5].places] == [1, 9] and not by[9].expressions
    assert by[6].n_words == by[7].n_words == 0 and by[6].licence_score == by[10].licence_score == 0.0
    assert {r.label for r in found} == {"own"}
    for r in found:
        own = [p for p in r.places if p.base]
        n, count, first, last, names = brute(r.text)
        assert (r.n_words, len(own)) == (n, count)
        assert (min((p.word for p in own), default=None), max((p.word for p in own), default=None), ",".join(sorted({p.label for p in own}))) == (first, last, names)
    assert licences.find(docs.limit(0)).collect() == []


def test_long_text(spark):
    text = "word mit license. " * 200_000 + "spdx-license-identifier: ISC"
    row = licences.find(spark.createDataFrame([(text,)], "text string")).first()
    assert len(row.places) == 200_000 and row.places[-1].word == 599_998 and row.expressions[0].labels == ["isc"]


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op12_licences(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "")
    assert sum(r.n_base for r in rows) > 10
