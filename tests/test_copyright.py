import pytest
from pyspark.sql import functions as F
from tracewell.operators import copyright as cr


def detect(spark, text):
    rows = cr.detect_copyrights(spark.createDataFrame([("f", text)], "path string, text string")).collect()
    return sorted((r["kind"], r["value"], r["start_line"], r["end_line"]) for r in rows)


@pytest.mark.parametrize(("text", "want"), [
    ("# Copyright (c) 2020 Jane Doe", [("copyright", "Copyright (c) 2020 Jane Doe", 1, 1), ("holder", "Jane Doe", 1, 1)]),
    ("/*\n * Copyright 2001-2003, 2005 Acme Inc.\n * All rights reserved.\n */", [("copyright", "Copyright 2001-2003, 2005 Acme Inc.", 2, 2), ("holder", "Acme Inc.", 2, 2)]),
    ("© 1999 Free Software Foundation, Inc.", [("copyright", "(c) 1999 Free Software Foundation, Inc.", 1, 1), ("holder", "Free Software Foundation, Inc.", 1, 1)]),
    ("@author John Smith", [("author", "John Smith", 1, 1)]), ("Written by Ann Lee <ann@x.org>", [("author", "Ann Lee <ann@x.org>", 1, 1)]), ("no statement here", []), ("", []), ("by the way, contributions @ 5", []),
])
def test_statements(spark, text, want):
    got = detect(spark, text)
    if not want:
        assert got == []
    for w in want:
        assert any(g[:2] == w[:2] and g[2] <= w[3] and g[3] >= w[2] for g in got), (w, got)


@pytest.mark.parametrize(("line", "hint"), [("Copyright", True), ("x (c) 2001", True), ("f(c) x", False), ("a (c)", False), ("(C) Jane", True), ("(c) jane", False), ("plain", False), ("x@y", True)])
def test_hints(spark, line, hint):
    assert spark.createDataFrame([(line,)], "s string").select(cr.has_hint(F.col("s"))).first()[0] is hint


@pytest.mark.parametrize(("line", "year", "trailing"), [("2001 x", False, False), ("a 1999, b", True, False), ("x 2001.", True, True), ("x 1959", False, False), ("2004", False, True), ("a,2005 ,", True, True)])
def test_years(spark, line, year, trailing):
    r = spark.createDataFrame([(line,)], "s string").select(cr.has_year(F.col("s")), cr.has_trailing_year(F.col("s"))).first()
    assert (r[0], r[1]) == (year, trailing)


def test_credits(spark):
    text = "intro\n\nN: Ann\nE: a@x.org\nW: http://x\nD: things\n\nN: Bob\n"
    rows = cr.credits_authors(spark.createDataFrame([("CREDITS", text), ("late", "x\n" * 60 + "N: Z\n")], "path string, text string")).collect()
    assert sorted((r["author"], r["start_line"], r["end_line"]) for r in rows) == [("Ann a@x.org http://x", 3, 5), ("Bob", 8, 8)]


def test_shadowed_and_canonical(spark):
    rows = [("p", "copyright", "Copyright 2001", 1, 1), ("p", "copyright", "Copyright 2001 Jane", 1, 1), ("p", "holder", "Jane", 1, 1)]
    df = spark.createDataFrame(rows, "path string, kind string, value string, start_line int, end_line int")
    assert sorted(r["value"] for r in cr.without_shadowed(df).collect()) == ["Copyright 2001 Jane", "Jane"]
    assert spark.createDataFrame([("a . ,  b ) , c",)], "s string").select(cr.canonical(F.col("s"))).first()[0] == "a ., b ), c"


def test_only_candidates_reach_python(spark):
    df = spark.createDataFrame([("f", "x")], "path string, text string")
    plan = cr.detect_copyrights(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter")


@pytest.mark.parametrize(("text", "authors"), [
    ("# Originally by Ann Lee <ann@corp.io>, 1999", ["Ann Lee <ann@corp.io>"]), ("// Original Author: Bo Ray <bo@corp.io>", ["Bo Ray <bo@corp.io>"]), ("* Current maintainer: Cy Day <cy@corp.io>", ["Cy Day <cy@corp.io>"]),
    ("// Author(s): kim, joe@corp.io", ["kim, joe@corp.io"]), ("* Author: a@corp.io or b@corp.io", ["a@corp.io or b@corp.io"]), ("* fixes by Di Orr\n *   (di@corp.io)", ["Di Orr (di@corp.io)"]),
    ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE", []),
])
def test_more_forms_of_authors(spark, text, authors):
    df = spark.createDataFrame([("f", text)], "path string, text string")
    assert [r["value"] for r in cr.detect_copyrights(df).where("kind = 'author'").collect()] == authors
