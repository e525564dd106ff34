import hashlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from tracewell.operators import license as lic
from tracewell.operators import rules as rl

TEXTS = [
    ("a", "x\nReleased under the MIT License\nmore\n"), ("b", "Licensed under the Apache License, Version 2.0 Licensed under the Apache License, Version 2.0"), ("c", "Released under the MIT License"), ("d", ""), ("e", "nothing"), ("f", None),
    ("g", "GNU Lesser General Public License version 2.1 <br> or\n\n\n\n\n\n\nlicensed under the GNU General Public License, version 3"), ("h", "subject to the license agreement"), ("i", "released UNDER the\nMIT\nlicense"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "path string, text string")


def places(df):
    return sorted((r["path"], r["rid"], r["start_token"], r["end_token"], r["start_line"], r["end_line"]) for r in df.collect())


def test_two_exact_matchers_agree(spark, docs):
    rules = rl.default_rules(spark)
    exact = places(lic.exact_matches(docs, rules))
    assert exact == places(lic.automaton_matches(docs, rules)) and len(exact) == 8
    assert ("i", 1, 0, 5, 1, 3) in exact and ("b", 0, 8, 16, 1, 1) in exact


def test_tiers(spark, docs):
    got = {(r["path"], r["matcher"]) for r in lic.scan_licenses(docs, rl.default_rules(spark)).collect()}
    assert ("c", lic.HASH) in got and ("i", lic.HASH) in got and ("a", lic.EXACT) in got and ("c", lic.EXACT) not in got


def test_detections(spark, docs):
    found = lic.detections(lic.split_clues(lic.exact_matches(docs, rl.default_rules(spark)))[0]).collect()
    by = sorted((r["path"], r["detection"], r["license_expression"], len(r["matches"])) for r in found)
    assert by == [("a", 0, "mit", 1), ("b", 0, "apache-2.0", 2), ("c", 0, "mit", 1), ("g", 0, "lgpl-2.1", 1), ("g", 1, "gpl-3.0", 1), ("i", 0, "mit", 1)]


def test_contained_matches_go(spark):
    rows = [("p", 1, 0, 10), ("p", 2, 2, 5), ("p", 3, 8, 12), ("p", 4, 0, 10), ("q", 2, 2, 5)]
    df = spark.createDataFrame(rows, "path string, rid int, start_token int, end_token int")
    assert sorted((r["path"], r["rid"]) for r in lic.without_contained(df).collect()) == [("p", 1), ("p", 3), ("q", 2)]


def test_coverage(spark):
    df = spark.createDataFrame([("a", 100.0, 10), ("a", 50.0, 10), ("b", 120.0, 5), ("c", 40.0, 0), ("c", 60.0, 0)], "k string, c double, n int")
    got = {r["k"]: r["x"] for r in df.groupBy("k").agg(lic.coverage(F.col("c"), F.col("n")).alias("x")).collect()}
    assert got == {"a": 75.0, "b": 100.0, "c": 50.0}


def test_identifiers():
    shown = "(('mit.LICENSE', 100.0, ('mit', 'license')),)"
    want = hashlib.sha1(shown.encode()).hexdigest()[:32]
    assert lic.detection_identifier("mit", [("mit.LICENSE", 100.0, ["mit", "license"])]).replace("-", "")[3:] == want
    assert lic.detection_identifier("GPL-2.0 WITH x", []).startswith("GPL_2_0_WITH_x-")
    quoted = lic.detection_identifier("a", [("it's", 99.5, ["o'k"]), ('say "x"', 1.0, [])])
    assert quoted == lic.detection_identifier("a", [("it's", 99.5, ["o'k"]), ('say "x"', 1.0, [])]) and "-" in quoted


def test_sequence_matches_are_the_longest_blocks(spark):
    rules = rl.default_rules(spark)
    text = "Redistribution and use in source or binary forms, with or without any modification, are permitted"
    docs = spark.createDataFrame([("s", text)], "path string, text string")
    got = sorted((r["start_token"], r["matched_length"]) for r in lic.sequence_matches(docs, rules).where("rid = 4").collect())
    a, b = (__import__("re").findall(r"[a-z0-9]+", t.lower()) for t in (text, rl.DEFAULT_RULES[4][3]))
    blocks = [(m.a, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size and set(a[m.a : m.a + m.size]) & lic.LEGALESE]
    assert got == sorted(blocks) and blocks


def test_ignorables(spark):
    rules = rl.default_rules(spark).withColumn("ignorable_urls", F.when(F.col("rid") == 1, F.array(F.lit("http://x.io/"))).otherwise(F.array().cast("array<string>")))
    matches = spark.createDataFrame([("p", 1, 3, 5)], "path string, rid int, start_line int, end_line int")
    urls = spark.createDataFrame([("p", "http://x.io/", 4, 4), ("p", "http://x.io/", 9, 9), ("p", "http://y.io/", 4, 4), ("q", "http://x.io/", 4, 4)], "path string, url string, start_line int, end_line int")
    assert sorted(tuple(r)[:3] for r in lic.without_ignorables(urls, matches, rules, "url", "ignorable_urls").collect()) == [("p", "http://x.io/", 9), ("p", "http://y.io/", 4), ("q", "http://x.io/", 4)]


def test_rule_files(spark, tmp_path):
    rule = "---\nlicense_expression: mit\nis_license_notice: yes\nrelevance: 90\n---\nReleased under MIT\n"
    lic_file = "---\nshort_name: My\nspdx_license_key: MY-1\ntext_urls:\n  - ' http://a '\n---\nThe text\n"
    rules = rl.load_rules(spark.createDataFrame([("r/mit_1.RULE", rule), ("r/bad.RULE", "no header"), ("r/empty.RULE", "---\nis_license_text: yes\n---\n")], "path string, text string")).collect()
    assert [(r["identifier"], r["kind"], r["relevance"], r["text"]) for r in rules] == [("mit_1.RULE", "notice", 90, "Released under MIT")]
    licenses = rl.load_licenses(spark.createDataFrame([("l/my-1.LICENSE", lic_file)], "path string, text string"))
    assert rl.spdx_names(licenses) == {"my-1": "MY-1"} and licenses.first()["reference_urls"] == ["http://a"] and licenses.first()["name"] == "My"
    assert rl.license_rules(licenses).first()["license_expression"] == "my-1"
    rl.write_index(rl.default_rules(spark), licenses, str(tmp_path / "index"))
    again, kept = rl.read_index(spark, str(tmp_path / "index"))
    assert again.count() == len(rl.DEFAULT_RULES) and kept.count() == 1
    with pytest.raises(ValueError):
        rl.rule_kind({"is_license_text": True, "is_license_tag": True})


def test_headers_read_as_by_the_plain_reader():
    import yaml

    for text in ("a: yes\nb: 'x'\n", "a:\n  - http://a:1/x\n  - 2020-01-01\n", "n: |\n  two\n  lines\n", "a: é\nb: ~\nc: 0o7\n", "", "- x\n"):
        assert rl.header(text) == yaml.safe_load(text)
    for text in ("a: [1\n", "d:\t3\n", "a: b: c\n", "m: !!python/object:os.system {}\n"):
        with pytest.raises(yaml.YAMLError):
            rl.header(text)


def test_license_files_are_parsed_once(spark, sf_small):
    from tracewell.plans.queries import queries

    assert "MapInArrow" not in queries()["license_files"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()


def test_rule_files_are_parsed_once(spark, tmp_path):
    files = spark.createDataFrame([(f"r/{k}.RULE", f"---\nis_license_notice: yes\n---\nrule {k}\n") for k in range(40)], "path string, text string").repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rules = rl.load_rules(files.mapInArrow(count, files.schema))
    rl.write_index(rules, rl.default_licenses(spark), str(tmp_path / "once"))
    assert seen.value == 40 and rl.read_index(spark, str(tmp_path / "once"))[0].count() == 40
    assert len(list((tmp_path / "once" / "rules").glob("*.parquet"))) > 1
