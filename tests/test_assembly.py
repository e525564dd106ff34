import pytest
from tracewell.operators import assembly as asm

SCHEMA = "path string, datasource_id string, type string, namespace string, name string, version string, purl string, description string, dependencies array<struct<purl:string,extracted_requirement:string,scope:string>>"


def row(path, source, name=None, version=None, description=None, needs=(), kind="npm"):
    url = f"pkg:{kind}/{name}@{version}" if name else None
    return (path, source, kind, None, name, version, url, description, [(n, "*", "s") for n in needs])


def frame(spark, *rows):
    return spark.createDataFrame([*rows], SCHEMA)


def packages_of(df):
    return sorted((r["name"], r["version"], r["description"], tuple(r["datafile_paths"])) for r in df.collect())


def test_siblings(spark):
    made, needs = asm.sibling_packages(frame(
        spark, row("d/package.json", "npm_package_json", "x", "1", needs=["pkg:npm/a"]), row("d/package-lock.json", "npm_package_lock_json", "x", "1", "from lock", ["pkg:npm/b"]), row("e/package.json", "npm_package_json", "y", "2"),
        row("e/package-lock.json", "npm_package_lock_json", "z", "9", "other"), row("f/package.json", "npm_package_json"), row("f/package-lock.json", "npm_package_lock_json", "w", "1"), row("g/yarn.lock", "yarn_lock", needs=["pkg:npm/c"]),
    ))
    assert packages_of(made) == [("x", "1", "from lock", ("d/package-lock.json", "d/package.json")), ("y", "2", None, ("e/package.json",))]
    assert sorted((r["purl"], r["for_package_uid"] is not None) for r in needs.collect()) == [("pkg:npm/a", True), ("pkg:npm/b", True), ("pkg:npm/c", False)]


def test_ids_follow_from_what_is_read(spark):
    rows = [row("d/package.json", "npm_package_json", "x", "1")]
    ids = [asm.sibling_packages(frame(spark, *rows))[0].first()["package_uid"] for _ in range(2)]
    assert ids[0] == ids[1] and ids[0].startswith("pkg:npm/x@1?uuid=")


def test_installed_rows_are_packages_each(spark):
    made = asm.each_packages(frame(spark, row("lib/apk/db/installed", "alpine_installed_db", "a", "1", kind="apk"), row("lib/apk/db/installed", "alpine_installed_db", "b", "2", kind="apk"), row("lib/apk/db/installed", "alpine_installed_db", kind="apk")))
    assert sorted(r["name"] for r in made.collect()) == ["a", "b"]


def test_nested(spark):
    rows = [row("x/META-INF/maven/g/a/pom.xml", "maven_pom", "a", "1", kind="maven"), row("x/META-INF/MANIFEST.MF", "java_jar_manifest", kind="maven"), row("y/META-INF/MANIFEST.MF", "java_jar_manifest", "lone", "1", kind="maven")]
    made = asm.nested_packages(frame(spark, *rows))
    assert [(r["root"], r["name"], len(r["datafile_paths"])) for r in made.collect()] == [("x", "a", 2)]
    two = [*rows[:2], row("x/META-INF/maven/g/b/pom.xml", "maven_pom", "b", "1", kind="maven")]
    assert asm.nested_packages(frame(spark, *two)).count() == 0


def test_owners(spark):
    packages = spark.createDataFrame([("npm", ["package.json"], "top"), ("npm", ["a/package.json"], "a"), ("composer", ["a/composer.json"], "c"), ("gem", ["a/x.gemspec"], "g"), ("pypi", ["setup.py"], "p"), ("pypi", ["b/setup.py"], "q"), ("pypi", ["b/pyproject.toml"], "r")], "type string, datafile_paths array<string>, package_uid string")
    names = ["a/s.js", "a/node_modules/z.js", "b.js", "a/vendor/v.php", "a/m/requirements/dev.txt", "b/requirements/x.txt"]
    files = spark.createDataFrame([(n, "pip_requirements") for n in names], "path string, datasource_id string")
    own = lambda kind: {(r["path"], r["package_uid"]) for r in asm.owned_files(files, packages, kind).collect()}
    assert ("a/s.js", "a") in own("npm") and ("a/node_modules/z.js", "top") in own("npm") and ("b.js", "top") in own("npm")
    assert ("a/vendor/v.php", "c") not in own("composer") and ("a/s.js", "c") in own("composer") and ("a/s.js", "g") in own("gem")
    assert {(r["path"], r["package_uid"]) for r in asm.requirements_owners(files, packages).collect()} == {("a/m/requirements/dev.txt", "p")}


def test_workspaces(spark):
    packages = spark.createDataFrame([(["w/packages/a/package.json"], "a"), (["w/packages/b/package.json"], "b"), (["w/other/package.json"], "o")], "datafile_paths array<string>, package_uid string")
    spaces = spark.createDataFrame([("w/package.json", ["packages/*", "!packages/b"])], "path string, patterns array<string>")
    assert [tuple(r) for r in asm.workspace_members(spaces, packages).collect()] == [("w/package.json", "a")]


def test_references_and_leftovers(spark):
    packages = spark.createDataFrame([("u",)], "package_uid string")
    refs = spark.createDataFrame([("u", "/", "usr/bin/x"), ("u", "root", "y"), ("v", "", "usr/bin/x")], "package_uid string, root string, path string")
    files = spark.createDataFrame([("usr/bin/x",), ("root/y",), ("z",)], "path string")
    assert sorted(tuple(r) for r in asm.referenced_files(packages, refs, files).collect()) == [("root/y", "u"), ("usr/bin/x", "u")]
    rows = frame(spark, row("odd/thing", "unlisted", needs=["pkg:x/a"]), row("d/Directory.Build.props", "nuget_directory_build_props", needs=["pkg:nuget/b"]), row("d/package.json", "npm_package_json", needs=["pkg:npm/c"]))
    none = spark.createDataFrame([], "path string")
    assert [r["purl"] for r in asm.unassembled_dependencies(rows, none).collect()] == ["pkg:x/a"]


@pytest.mark.parametrize(("cabals", "owned"), [(0, [False]), (1, [True]), (2, [False])])
def test_hackage(spark, cabals, owned):
    rows = [row(f"h/{k}.cabal", "hackage_cabal", f"n{k}", "1", kind="hackage") for k in range(cabals)]
    made, needs = asm.hackage_packages(frame(spark, *rows, row("h/cabal.project", "hackage_cabal_project", needs=["pkg:hackage/d"], kind="hackage")))
    assert made.count() == cabals and [r["for_package_uid"] is not None for r in needs.collect()] == owned
