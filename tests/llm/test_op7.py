import re

import pytest
from tracewell.llm import licenses, queries

from .cases import empty, frame, nasty_rows

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    ws = words(text)
    places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(ws)) if [w.decode("utf-8", "replace") for w in ws[k : k + len(phrase.split())]] == phrase.split())
    blocks = []
    for n, line in enumerate((text or "").encode().split(b"\n")):
        block = set(words(line.decode("utf-8", "replace")))
        for label, texts in templates.items():
            for t in texts:
                own = set(words(t))
                if own and block and len(block & own) >= threshold * len(own) - 1e-9:
                    blocks.append((n, label, len(block & own) / len(own)))
    return len(ws), places, sorted(blocks)


def check(df, rows, **more):
    got = sorted(repr((r["doc_id"], r["n_words"], [(p["start"], p["label"]) for p in r["phrases"]], sorted((b["line"], b["label"], b["containment"]) for b in r["blocks"]))) for r in df.collect())
    assert got == sorted(repr((i, *brute(t, **more))) for i, t in rows)


NOTICES = [
    (30, "Licensed under the Apache License, Version 2.0."), (31, "licensed UNDER the apache-license version 2.1 0"),
    (32, "x\nRELEASED under the MIT license\nAll Rights Reserved. all rights reserved all rights\nreserved"),
    (33, "cc by cc by cc"), (34, "General-Public License general public license"), (35, "released the mit\nlicense under"),
    (36, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (37, "Übercc by"), (38, "CC BY-NC 4.0 licensed under"),
]


@pytest.mark.parametrize("clash", [False, True])
def test_blocks_and_phrases(spark, clash):
    rows = [*nasty_rows(), *NOTICES]
    check(licenses.scan_licenses(frame(spark, rows, clash)), rows)


@pytest.mark.parametrize("threshold", [0.5, 0.67, 1.0])
def test_other_thresholds(spark, threshold):
    templates = {"a": ["alpha beta gamma delta epsilon"], "b": ["beta beta zeta", "omega"], "c": ["1"], "d": ["?"]}
    rows = [*nasty_rows(), *[(100 + k, t) for k, t in enumerate(["alpha gamma", "zeta\nbeta", "omega 1", "alpha beta gamma", "delta epsilon alpha beta"])]]
    check(licenses.scan_licenses(frame(spark, rows), templates=templates, threshold=threshold), rows, templates=templates, threshold=threshold)


def test_query_on_the_whole_small_table(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.collect()]
    check(licenses.scan_licenses(docs), rows)
    for r in queries.op7_licenses(spark, sf_mid).collect():
        n, places, blocks = brute(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p for _, p in places}))
        assert r["labels"] == ",".join(sorted({p for _, p in places} | {b for _, b, _ in blocks})) and 0 <= r["score"] <= 1


def test_empty_table(spark):
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert {r["n_words"] for r in licenses.scan_licenses(frame(spark, [(1, "a b")]), templates={}).collect()} == {2}


def test_templates_in_several_blocks_and_as_a_table(spark):
    rows = [*nasty_rows(), *NOTICES]
    shown = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    whole = shown(licenses.scan_licenses(frame(spark, rows)))
    assert shown(licenses.scan_licenses(frame(spark, rows, True), block_bytes=100)) == whole
    table = spark.createDataFrame([(label, t) for label, texts in licenses.TEMPLATES.items() for t in texts] + [("none", None), (None, "x")], "name string, body string")
    assert shown(licenses.scan_licenses(frame(spark, rows), templates=table, block_bytes=300)) == whole


def test_many_places_of_a_phrase():
    words = [b"cc", b"by"] * 200_000
    places = licenses.phrase_places(words, [(b"cc by", "cc-by")])
    assert [p["start"] for p in places] == list(range(0, 400_000, 2))


def test_wrapped_notices(spark, tmp_path):
    """As they stand in license files and in comments."""
    rows = [
        (1, "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
        (2, "bsd", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"),
        (3, "gpl-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by"),
        (4, "isc", "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that"),
        (5, None, "Permission is hereby " + "and so on " * 40 + "\ngranted, free of charge, " + "and so on " * 40 + "\nto any person obtaining a copy of"),
    ]
    docs = frame(spark, [(i, t) for i, _, t in rows])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = {r["doc_id"]: r["labels"].split(",") for r in queries.op7_licenses(spark, str(tmp_path)).collect()}
    for i, label, _ in rows:
        assert any(x.startswith(label) for x in labels[i]) if label else labels[i] == [""], (i, labels[i])
    found = {r["doc_id"]: r["windows"] for r in licenses.scan_licenses(docs).collect()}
    assert all(w["containment"] >= licenses.THRESHOLD for ws in found.values() for w in ws) and found[1][0]["start"] == 0
