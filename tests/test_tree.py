import pytest
from pyspark.sql import functions as F
from tracewell.operators import summary as sm
from tracewell.operators import tree as tr

PATHS = ["a/b/c.txt", "a/b/d.py", "a/e.py", "f.md", "g/h/i/j.c"]


@pytest.fixture(scope="module")
def tree(spark):
    return tr.with_directories(spark.createDataFrame([(p,) for p in PATHS], "path string"))


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_directories_and_ancestors(spark, tree):
    assert paths(tree) == sorted([*PATHS, "a", "a/b", "g", "g/h", "g/h/i"])
    rows = tr.ancestors(spark.createDataFrame([("a/b/c",)], "path string")).collect()
    assert sorted((r["ancestor"], r["distance"]) for r in rows) == [("", 3), ("a", 2), ("a/b", 1)]


@pytest.mark.parametrize(("limit", "n"), [(0, 10), (1, 6), (2, 9), (9, 10)])
def test_depth(tree, limit, n):
    assert tr.limit_depth(tree, limit).count() == n


def test_include_exclude(tree):
    assert paths(tr.include_exclude(tree, ["*.py"])) == ["a", "a/b", "a/b/d.py", "a/e.py"]
    assert paths(tr.include_exclude(tree, ["*.py"], ["a/b"])) == ["a", "a/e.py"]
    left, count = tr.exclude(tree, ["h", "*.md"])
    assert paths(left) == ["a", "a/b", "a/b/c.txt", "a/b/d.py", "a/e.py", "g"] and count.first()[0] == 2
    assert tr.include_exclude(tree, [" "], [""]).count() == tree.count()


def test_inputs():
    assert tr.common_root(["x"]) == ("x", []) and tr.common_root(["a/b/c", "a/b/d"]) == ("a/b", ["a/b/c", "a/b/d"]) and tr.common_root(["a", "b"]) == (".", ["a", "b"])
    with pytest.raises(ValueError):
        tr.common_root(["/a", "b"])


@pytest.mark.parametrize(("rows", "root"), [([("r/a.txt", False), ("r", True), ("r/x", True)], "r"), ([("r/a.txt", False)], "r/a.txt"), ([("r/a/1", False), ("r/b/2", False)], "r"), ([("x/1", False), ("y/2", False)], "")])
def test_scan_root(spark, rows, root):
    assert tr.scan_root(spark.createDataFrame(rows, "path string, is_dir boolean")).first()["root"] == root


@pytest.mark.parametrize(("path", "root", "stripped"), [("r/a/b", "r", "a/b"), ("/r/a", "/r/", "a"), ("r", "r", "r"), ("x/r", "x/r", "r"), ("rr/a", "r", "rr/a"), ("a/b", "", "a/b")])
def test_strip_root(spark, path, root, stripped):
    assert spark.range(1).select(tr.strip_root(F.lit(path), root)).first()[0] == stripped


def test_full_root(spark):
    assert spark.range(1).select(tr.full_root(F.lit("/a/b/"), "/srv/x/")).first()[0] == "srv/x/a/b"


def test_source_marks(spark, tree):
    marked = tr.mark_source(tree.withColumn("is_source", F.col("path").rlike(r"\.(py|c)$")))
    got = {r["path"]: (r["is_source"], r["source_count"]) for r in marked.collect()}
    assert got["a/b"] == (False, 1) and got["g"] == (True, 1) and got["a/e.py"] == (True, 1) and got["f.md"] == (False, 0)


def test_trimmed_assembly(spark):
    packages = spark.createDataFrame([("u1", ["a/p.json", "b/l.json"], "x"), ("u2", ["z/p.json"], "y")], "package_uid string, datafile_paths array<string>, name string")
    dependencies = spark.createDataFrame([("a/p.json", "d1"), ("z/p.json", "d2")], "datafile_path string, purl string")
    left, kept = tr.trim_assembly(packages, dependencies, spark.createDataFrame([("a/p.json",)], "path string"))
    assert [(r["package_uid"], r["datafile_paths"]) for r in left.collect()] == [("u1", ["a/p.json"])] and [r["purl"] for r in kept.collect()] == ["d1"]


@pytest.mark.parametrize(("path", "flags"), [
    ("LICENSE", "legal key"), ("COPYING.LIB", "legal key"), ("README.md", "readme key"), ("setup.py", "manifest key"), ("sub/LICENSE", "legal"), ("CONTRIBUTING.md", "community"), ("licensed.c", ""), ("main.c", ""), ("Readme", "readme key"), ("mit.LICENSE", "legal key"),
])
def test_classify(spark, path, flags):
    r = sm.classify(spark.createDataFrame([(path,)], "path string")).first()
    got = [n for n in ("legal", "readme", "manifest", "community") if r[f"is_{n}"]] + ["key"] * r["is_key_file"]
    assert " ".join(got) == flags


def test_package_roots_make_key_files(spark):
    files = spark.createDataFrame([("p/LICENSE",), ("q/LICENSE",), ("q/deep/COPYING",)], "path string")
    packages = spark.createDataFrame([(["p/package.json"],)], "datafile_paths array<string>")
    referenced = spark.createDataFrame([("q/deep/COPYING",)], "path string")
    got = {r["path"]: r["is_key_file"] for r in sm.classify(files, packages=packages, referenced=referenced).collect()}
    assert got == {"p/LICENSE": True, "q/LICENSE": False, "q/deep/COPYING": True}


def test_facets(spark, tree):
    got = {r["path"]: r["facets"] for r in sm.facets(tree, [("tests", "*.py"), ("dev", "/a/b"), ("tests", "d.py")], is_dir="is_dir").collect()}
    assert got["a/b/d.py"] == ["dev", "tests"] and got["a/e.py"] == ["tests"] and got["f.md"] == ["core"] and got["a"] == []


def test_clarity_and_summary(spark):
    flags = spark.createDataFrame([("LICENSE", True), ("x.c", False)], "path string, is_key_file boolean")
    licenses = spark.createDataFrame([("LICENSE", "mit", "text", 100.0), ("x.c", "gpl-3.0", "notice", 90.0)], "path string, license_expression string, kind string, score double")
    holders = spark.createDataFrame([("LICENSE", "Jane"), ("x.c", "Bob"), ("x.c", "Bob")], "path string, holder string")
    categories = spark.createDataFrame([("mit", "Permissive"), ("gpl-3.0", "Copyleft")], "license_expression string, category string")
    r = sm.clarity(flags, licenses, holders, categories).first()
    assert r["score"] == 80 and r["has_license_text"] and r["conflicting_license_categories"] and not r["ambiguous_compound_licensing"]
    packages = spark.createDataFrame([("apache-2.0", None)], "declared_license_expression string, holder string")
    languages = spark.createDataFrame([("x.c", "C"), ("y", "C"), ("z", "Go")], "path string, programming_language string")
    s = sm.summary(flags, packages, licenses, holders, languages).first()
    assert (s["declared_license_expression"], s["declared_holder"], s["primary_language"]) == ("apache-2.0", "Jane", "C")
    assert [tuple(x) for x in s["other_holders"]] == [("Bob", 2)] and [tuple(x) for x in s["other_languages"]] == [("Go", 1)]


def test_roots_above_many_paths_are_joined_in_groups(spark):
    names = [f"r{k % 3}/d{k % 7}/f{k}" for k in range(60)] + ["/r0/x", "top", "r0/d0/e/deep/y"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    roots = spark.createDataFrame([("", "t"), ("", "u"), ("r0", "a"), ("r0/d0", "b"), ("r9", "c")], "root string, package_uid string")
    above = tr.ancestors(files)
    plain = sorted(tuple(r) for r in above.join(roots, F.col("ancestor") == F.col("root")).select("path", "distance", "package_uid").collect())
    for most in (1, 4, 1000):
        assert sorted(tuple(r) for r in tr.at_roots(above, roots, "path", most).select("path", "distance", "package_uid").collect()) == plain
    plan = tr.at_roots(above, roots, "path", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "_group" in next(line for line in plan.split("\n") if "Join Inner" in line)  # rows of a large directory have several keys
    assert "LeftSemi" in plan  # levels without a root, as the top mostly is one, aren't shuffled
