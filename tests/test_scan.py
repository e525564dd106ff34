"""Sources, whole scans, sinks, the store of results, streams."""

import json
import xml.dom.minidom as minidom

import pytest
import yaml
from pyspark.sql import functions as F
from tracewell import sinks
from tracewell.plans import ScanOptions, scan
from tracewell.sinks.lines import text_of
from tracewell.sinks.pages import render
from tracewell.sources import cache, load_scans, merged_counts, normalised, read_tree, section, texts_of
from tracewell.sources.files import file_info

FILES = {
    "package.json": '{"name":"@a/b","version":"1.0.0","license":"MIT","dependencies":{"x":"^1"},"author":"Jo <jo@corp.io>"}',
    "src/main.py": "#!/usr/bin/env python\n# Copyright (c) 2019 Jane Doe\n# Licensed under the Apache License, Version 2.0\nprint('http://www.corp.io/x?y=1.')\n",
    "LICENSE": "Released under the MIT License\n", "docs/README.md": "mail bob@corp.io\n", "gen.c": "/* automatically generated by foo */\n", ".hid/x.txt": "x", "it's <odd> & \"q\".txt": "Copyright 2001 A & B <x@y.io>\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


@pytest.fixture(scope="module")
def scanned(spark, root):
    files, _ = read_tree(spark, root, excludes=[".hid"])
    options = ScanOptions(info=True, packages=True, licenses=True, emails=True, urls=True, generated=True, classify=True, summary=True, tallies=True, tallies_by_facet=True, facets=(("docs", "*.md"),), mark_source=True, license_text=True)
    return scan(files, options)


@pytest.fixture(scope="module")
def report(spark, scanned, tmp_path_factory):
    made = scanned.report({"start_timestamp": "s", "end_timestamp": "2024-01-01T00:00:00Z"})
    folder = str(tmp_path_factory.mktemp("report"))
    made.files.write.mode("overwrite").parquet(folder)
    made.files = spark.read.parquet(folder)
    return made


def test_tree(spark, root):
    files, excluded = read_tree(spark, root)
    assert {r["path"] for r in files.select("path").collect()} == set(FILES) and excluded.first()[0] == 0
    files, excluded = read_tree(spark, root, excludes=[".hid", "*.md"])
    assert files.count() == 5 and excluded.first()[0] == 2
    assert read_tree(spark, root, max_depth=0)[0].count() == 7
    assert "content" not in files.select("path", "size")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_info(spark, root):
    r = file_info(read_tree(spark, root)[0]).where("path = 'src/main.py'").first()
    assert (r["name"], r["base_name"], r["extension"], r["programming_language"], r["is_source"], r["is_script"], r["is_binary"]) == ("main.py", "main", ".py", "Python", True, True, False)


def test_texts(spark):
    rows = [("a", "é".encode()), ("b", "é".encode("latin-1")), ("c", b"\x00\x01abcdef\x00xy\x00longer"), ("d.js.map", b'{"sourcesContent":["x"]}'), ("e", b"\xef\xbb\xbfbom")]
    got = {r["path"]: r["text"] for r in texts_of(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": "é", "b": "é", "c": "abcdef\nlonger", "d.js.map": "x", "e": "bom"}


def test_findings(scanned):
    rows = lambda name, *c: sorted(tuple(r) for r in scanned.facts[name].select(*c).collect())
    assert rows("emails", "path", "email") == [("docs/README.md", "bob@corp.io"), ("it's <odd> & \"q\".txt", "x@y.io"), ("package.json", "jo@corp.io")]
    assert rows("urls", "url") == [("http://www.corp.io/x?y=1",)] and rows("license_detections", "path", "license_expression") == [("LICENSE", "mit"), ("src/main.py", "apache-2.0")]
    assert ("src/main.py", "Jane Doe") in rows("holders", "path", "holder") and [r["purl"] for r in scanned.packages.collect()] == ["pkg:npm/%40a/b@1.0.0"]
    assert [r["purl"] for r in scanned.dependencies.collect()] == ["pkg:npm/x"]
    flags = {r["path"]: r for r in scanned.files.collect()}
    assert flags["gen.c"]["is_generated"] and flags["LICENSE"]["is_key_file"] and flags["src"]["type"] == "directory" and flags["docs/README.md"]["facets"] == ["docs"] and flags["src"]["source_count"] == 1
    assert scanned.extra["summary"].first()["declared_license_expression"] == "mit"


def test_documents(report):
    whole = json.loads(text_of(sinks.json_document(report)))
    assert [f["path"] for f in whole["files"]] == sorted(f["path"] for f in whole["files"]) and len(whole["files"]) == 8 and whole["packages"][0]["name"] == "b" and whole["headers"][0]["output_format_version"] == "4.0.0"
    assert json.loads(text_of(sinks.json_document(report, pretty=True))) == whole
    lines = [json.loads(x) for x in text_of(sinks.json_lines(report)).splitlines()]
    assert list(lines[0]) == ["headers"] and list(lines[1]) == ["summary"] and [x["files"][0] for x in lines if "files" in x] == whole["files"]
    assert yaml.safe_load(text_of(sinks.yaml_document(report)))["files"][0]["path"] == whole["files"][0]["path"]


def test_tables_and_markup(report):
    rows = sinks.csv_table(report).collect()
    kinds = {r["kind"] for r in rows}
    assert {"info", "license", "copyright", "holder", "email", "url", "package_data"} <= kinds and any(r["path"] == "src/" for r in rows) and any(r["package__version"] == "v 1.0.0" for r in rows)
    spdx = text_of(sinks.spdx_tag_value(report))
    assert "PackageVerificationCode: " in spdx and "FileName: ./LICENSE" in spdx and "LicenseInfoInFile: mit" in spdx
    for made in (sinks.spdx_rdf(report), sinks.cyclonedx_xml(report)):
        minidom.parseString(text_of(made))
    bom = json.loads(text_of(sinks.cyclonedx_json(report)))
    assert bom["components"][0]["licenses"] == [{"expression": "MIT"}] and bom["dependencies"][0]["ref"] == "pkg:npm/x" and bom == json.loads(text_of(sinks.cyclonedx_json(report)))
    page = text_of(sinks.html_report(report))
    assert "it&apos;s &lt;odd&gt; &amp; &quot;q&quot;.txt" in page and page.strip().endswith("</html>")


def test_empty_documents(spark):
    files = spark.createDataFrame([], "path string, type string, sha1 string")
    empty = sinks.Report(spark, files)
    assert text_of(sinks.spdx_tag_value(empty)) == "# No results for package 'scan'.\n" and json.loads(text_of(sinks.cyclonedx_json(empty)))["components"] == []
    assert json.loads(text_of(sinks.json_document(empty)))["files"] == []


def test_written(report, tmp_path):
    sinks.write_report(report, {"json-lines": str(tmp_path / "jl"), "csv": str(tmp_path / "csv"), "html-app": str(tmp_path / "app")}, single=True)
    (part,) = (tmp_path / "jl").glob("part-*")
    assert len(part.read_text().splitlines()) > 8 and list((tmp_path / "csv").glob("part-*"))
    data = json.loads((tmp_path / "app" / "assets" / "data.js").read_text().removeprefix("data = "))
    assert [f["path"] for f in data["files"]] == sorted(f["path"] for f in data["files"]) and data["packages"][0]["name"] == "b"
    assert 'src="assets/data.js"' in (tmp_path / "app" / "index.html").read_text()


def test_templates(report):
    values = {"files": [{"path": "<a>", "x": True}, {"path": "b", "tags": ["t", 1]}], "none": None}
    assert render("{% for f in files %}{{ f.path }}{% if f.x %}!{% endif %}{{ f.tags }};{% endfor %}{{ none }}{# note #}", values) == "&lt;a&gt;!;b[&quot;t&quot;, 1];"
    assert render("{{ files.0.path | safe }}{% if none %}x{% for f in files %}y{% endfor %}{% endif %}", values) == "<a>"
    assert "package.json" in sinks.custom_template(report, "{% for f in files %}{{ f.path }} {% endfor %}")


def test_earlier_scans(spark, tmp_path):
    doc = {"headers": [{"extra_data": {"excluded_count": 2}}], "files": [{"path": "r", "type": "directory"}, {"path": "r/a.c", "type": "file", "size": 5, "copyrights": [{"copyright": "C", "start_line": 1, "end_line": 1}], "unknown": 1}], "odd": {}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"files": [{"path": "s/x", "type": "file", "size": 7}]}))
    scans = load_scans(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert tuple(merged_counts(scans).first()) == (2, 1, 12, 2) and section(scans, "files").count() == 3
    assert {r["path"] for r in normalised(scans, strip=True).collect()} == {"r", "a.c", "x"} and {r["path"] for r in normalised(scans, full="/top").collect()} == {"top/r", "top/r/a.c", "top/s/x"}


def test_store(spark, tmp_path):
    folder, mark = str(tmp_path / "store"), cache.fingerprint({"emails": True})
    files = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1")], "path string, sha256 string")
    assert cache.cached(spark, folder, mark) is None and cache.probe(files, None)[0].count() == 3
    cache.store(spark.createDataFrame([("h1", "found")], "sha256 string, value string"), folder, mark)
    left, known = cache.probe(files, cache.cached(spark, folder, mark))
    assert [r["path"] for r in left.collect()] == ["b"] and {r["path"] for r in known.collect()} == {"a", "c"}
    assert cache.cached(spark, folder, cache.fingerprint({"emails": False})).count() == 0
    cache.clear(spark, folder)
    assert cache.cached(spark, folder, mark) is None and cache.cache_folder("/r", "/x") == "/x" and cache.cache_folder("/r/").startswith("/r/")


def test_streams(spark, root, tmp_path):
    from tracewell.operators.finder import find_emails
    from tracewell.operators.license import scan_licenses  # noqa: F401
    from tracewell.streaming import incoming_files, start, windowed_tallies

    stream = incoming_files(spark, root)
    assert stream.isStreaming

    def detect(df):
        from tracewell.operators.finder import email_candidates

        return email_candidates(texts_of(df)).where("rejection IS NULL").select("path", "value")

    start(stream, detect, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"bob@corp.io", "jo@corp.io", "x@y.io"}
    start(incoming_files(spark, root), detect, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counted = windowed_tallies(stream.select(F.col("modified").alias("t"), "path"), "t", "path")
    assert counted.columns == ["start", "value", "count"] and find_emails is not None
