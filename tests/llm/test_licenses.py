import re

import duckdb

from larkspur.llm import licenses


def _scan(docs, *texts):
    found = {r.doc_id: r for r in licenses.scan(docs(*enumerate(texts))).collect()}
    return [found[i] for i in range(len(texts))]


def test_base_places(docs):
    a, b, c, d, e = _scan(docs, "Under the MIT License. under\nthe, mit license", "CC BY-NC cc by nc", None, "xunder the mit license", "Kunder the mit licenseé under the mit license ÀB")
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (8, 2, 0, 4, "mit")
    assert (b.n_words, b.n_base, b.first_word, b.last_word, b.base_labels) == (6, 2, 0, 3, "cc-by-nc")
    assert (c.n_words, c.n_base, c.first_word, c.labels, c.score) == (0, 0, None, "", 0.0)
    assert d.n_base == 0 and (e.n_base, e.first_word, e.n_words) == (1, 4, 9)


def test_signatures_and_suppression(docs):
    rows = _scan(
        docs,
        "SPDX-License-Identifier: GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 2.0",
        "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "Redistribution and use in source and binary forms, with or without modification",
        "nothing of the kind, though a license is named",
        "GNU General Public License",
    )
    assert [r.labels for r in rows] == ["gpl-3", "gpl-3", "apache-2", "cc-by-nc", "mit", "bsd", "", "gpl"]
    assert rows[0].score == 0.99 and rows[6].score == 0.0 and all(0 <= r.score <= 1 for r in rows)
    assert len(licenses.WRITTEN) > 250 and len({r.pattern for r in licenses.WRITTEN}) == len(licenses.WRITTEN)


def test_every_written_rule_can_match(docs):
    """A text with just the wording opens the gate, holds the keyword, and is detected (if no better rule covers it)."""
    for r in licenses.RULES:
        assert f" {r.keyword}#" in licenses.required(r.pattern), r
    texts = [re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", licenses.required(r.pattern)) for r in licenses.WRITTEN]
    texts = [" ".join(re.findall(" ([^ #]+)#", t)).replace("licen[cs]e", "license") for t in texts]
    for r, row in zip(licenses.WRITTEN, _scan(docs, *texts)):
        assert row.labels, r


def test_rows_without_id_and_long_texts(docs):
    long = "word " * 300_000 + "Under the MIT License."
    rows = licenses.scan(docs((None, long), (1, long), (1, long))).collect()
    assert sorted((r.doc_id is not None, r.n_words, r.first_word, r.base_labels, r.labels) for r in rows) == [(False, 300_004, 300_000, "mit", "mit")] + [(True, 300_004, 300_000, "mit", "mit")] * 2


def test_against_brute_force(docs, sample):
    texts = [(r.doc_id, r.text) for r in sample.collect()] + [(10_000, None), (10_001, "under the mit license " * 300), (10_002, "ÉÀ apache license version 2")]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = {}
    for i, t in texts:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(n, label) for label, p in licenses.BASE.items() for n in range(len(words)) if words[n : n + len(p.split())] == p.split()]
        want[i] = (len(words), len(hits), min((n for n, _ in hits), default=None), max((n for n, _ in hits), default=None), ",".join(sorted({x for _, x in hits})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs(*texts)).collect()}
    assert got == want and licenses.scan(docs()).count() == 0


def test_against_sql(spark, docs):
    texts = ["MIT License and GPLv3, all rights reserved", "released under the BSD 3-Clause License", "Creative Commons Attribution-ShareAlike 4.0 International", "apache license", "", "LGPL 2.1 or MPL 2.0"]
    found = licenses.scan(docs(*enumerate(texts)))
    documents = found.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas()  # noqa: F841
    want = duckdb.sql(licenses.oracle()).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
