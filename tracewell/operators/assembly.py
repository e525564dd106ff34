"""Packages from manifest rows: sibling, one-per-row and nested merges, ownership of files, hoisted dependencies.

Manifest rows: path, datasource_id, type, namespace, name, version, purl, and any other package columns, with
``dependencies`` as array<struct<purl, extracted_requirement, scope, ...>>. Packages get a ``package_uid`` made from
purl and datafile, so that equal input gives equal ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..functions.text import file_name
from .tree import ancestors, at_roots, parent


@dataclass(frozen=True)
class Assembler:
    """name, mode (siblings, each, nested), and its files: (datasource, name pattern) in order of precedence."""

    name: str
    mode: str
    files: tuple[tuple[str, str], ...]


ASSEMBLERS = (
    Assembler("npm", "siblings", (("npm_package_json", "package.json"), ("npm_package_lock_json", "package-lock.json"), ("npm_package_lock_json", "npm-shrinkwrap.json"), ("yarn_lock", "yarn.lock"), ("pnpm_lock_yaml", "pnpm-lock.yaml"), ("bun_lock", "bun.lock"))),
    Assembler("cargo", "siblings", (("cargo_toml", "cargo.toml"), ("cargo_lock", "cargo.lock"))),
    Assembler("composer", "siblings", (("php_composer_json", "*composer.json"), ("php_composer_lock", "composer.lock"))),
    Assembler("pypi", "siblings", (("pypi_pyproject_toml", "pyproject.toml"), ("pypi_setup_cfg", "setup.cfg"), ("pypi_setup_py", "setup.py"), ("pypi_poetry_lock", "poetry.lock"), ("pypi_uv_lock", "uv.lock"), ("pipfile", "pipfile"), ("pipfile_lock", "pipfile.lock"), ("pip_requirements", "*requirements*.txt"))),
    Assembler("go", "siblings", (("go_mod", "go.mod"), ("go_sum", "go.sum"), ("go_mod_graph", "*go.mod*graph"))),
    Assembler("ruby", "siblings", (("gemspec", "*.gemspec"), ("gemfile", "gemfile"), ("gemfile_lock", "gemfile.lock"))),
    Assembler("cocoapods", "siblings", (("cocoapods_podspec", "*.podspec"), ("cocoapods_podfile", "podfile"), ("cocoapods_podfile_lock", "podfile.lock"))),
    Assembler("dart", "siblings", (("pubspec_yaml", "pubspec.yaml"), ("pubspec_lock", "pubspec.lock"))),
    Assembler("helm", "siblings", (("helm_chart_yaml", "chart.yaml"), ("helm_chart_lock", "chart.lock"))),
    Assembler("deno", "siblings", (("deno_json", "deno.json*"), ("deno_lock", "deno.lock"))),
    Assembler("conan", "siblings", (("conan_conanfile_py", "conanfile.py"), ("conan_conanfile_txt", "conanfile.txt"), ("conan_conandata_yml", "conandata.yml"), ("conan_lock", "conan.lock"))),
    Assembler("swift", "siblings", (("swift_package_manifest_json", "package.swift.json"), ("swift_package_show_dependencies", "swift-show-dependencies.deplock"), ("swift_package_resolved", "*package.resolved"))),
    Assembler("nuget", "siblings", (("nuget_csproj", "*.csproj"), ("nuget_packages_config", "packages.config"), ("nuget_packages_lock", "packages.lock.json"))),
    Assembler("maven", "nested", (("maven_pom", "pom.xml"), ("maven_pom_properties", "pom.properties"), ("java_jar_manifest", "manifest.mf"))),
    Assembler("debian", "nested", (("debian_control_in_source", "control"), ("debian_copyright", "copyright"))),
    Assembler("installed", "each", (("alpine_installed_db", "installed"), ("debian_installed_status_db", "status"), ("rpm_mariner_manifest", "container-manifest-2"), ("conda_meta_json", "*.json"), ("freebsd_compact_manifest", "*compact_manifest"), ("etc_os_release", "os-release"))),
)
#: Lock files whose name and version have to equal the package's, and those where they just mustn't differ.
STRICT_LOCKS = ("npm_package_lock_json", "bun_lock")
LOOSE_LOCKS = ("pypi_uv_lock", "pypi_pip_origin_json")
ANCHORS = ("META-INF", "debian", "data.gz-extract")
CACHE_DIRECTORY = ".tracewell-cache"
PROJECT_FILES = ("pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "pip-inspect.deplock", "PKG-INFO", "METADATA")
IDENTITY = ("type", "namespace", "name", "version", "purl")


def assembler_table(spark: SparkSession, assemblers: tuple[Assembler, ...] = ASSEMBLERS) -> DataFrame:
    """datasource_id, pattern, pattern_pos, assembler, mode: a dimension, one row for each listed file."""
    rows = [(d, p, n, a.name, a.mode) for a in assemblers for n, (d, p) in enumerate(a.files)]
    return spark.createDataFrame(rows, "datasource_id string, pattern string, pattern_pos int, assembler string, mode string")


def package_uid(purl: Column, datafile: Column) -> Column:
    """purl with a uuid that follows from purl and datafile."""
    h = F.sha1(F.concat_ws("|", purl, datafile).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return F.concat(F.coalesce(purl, F.lit("")), F.when(purl.contains("?"), "&").otherwise("?"), F.lit("uuid="), uuid)


def identified(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return c("purl").isNotNull() | (c("type").isNotNull() & c("name").isNotNull())


def _ordered(manifests: DataFrame, mode: str, assemblers: tuple[Assembler, ...]) -> DataFrame:
    """Manifest rows that an assembler of the mode reads, with parent_path, assembler and pattern_pos."""
    plain = lambda p: not set(p) & set("*?[")
    rows = [
        (d, p, n, a.name, p.lower() if plain(p) else None, None if plain(p) else glob_regex(p.lower()))
        for a in assemblers if a.mode == mode for n, (d, p) in enumerate(a.files)
    ]
    table = manifests.sparkSession.createDataFrame(rows, "datasource_id string, pattern string, pattern_pos int, assembler string, _exact string, _regex string")
    # Most patterns are whole names, compared as such; those with a star are few and come from the table, not the plan.
    named = manifests.withColumn("_name", F.lower(file_name(F.col("path"))))
    hit = F.when(F.col("_exact").isNotNull(), F.col("_name") == F.col("_exact")).otherwise(F.regexp_like("_name", F.col("_regex")))
    joined = named.join(F.broadcast(table), "datasource_id").where(hit).drop("_name", "_exact", "_regex")
    return joined.withColumn("parent_path", parent(F.col("path")))


def sibling_packages(manifests: DataFrame, assemblers: tuple[Assembler, ...] = ASSEMBLERS) -> tuple[DataFrame, DataFrame]:
    """Packages and dependencies of directories.

    Within a directory, rows come by pattern, then path. The first row with an identity starts the package; lock rows
    that disagree with it are left out; later rows fill what is still null. Grouped by directory and assembler, which
    bounds a group by a directory's manifests."""
    rows = _ordered(manifests, "siblings", assemblers)
    order = Window.partitionBy("parent_path", "assembler").orderBy("pattern_pos", "path", "row_pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("row_pos", F.col("row_pos") if "row_pos" in manifests.columns else F.lit(0))
    blank_npm = F.coalesce(F.max(F.when((F.col("datasource_id") == "npm_package_json") & F.col("purl").isNull(), 1)).over(so_far), F.lit(0)) == 1
    is_lock = F.col("datasource_id").isin(*STRICT_LOCKS)
    starter = numbered.withColumn("_starts", identified() & ~(is_lock & blank_npm))
    first = lambda c: F.first(F.when(F.col("_starts"), F.struct(c)), ignorenulls=True).over(so_far)[c]
    has = F.coalesce(F.max(F.col("_starts")).over(so_far), F.lit(False))
    marked = starter.withColumn("_has", has).withColumn("_name", first("name")).withColumn("_version", first("version"))
    same = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")) == F.nullif(F.trim(b), F.lit("")), F.lit(False))
    clash = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")) != F.nullif(F.trim(b), F.lit("")), F.lit(False))
    strict = is_lock & ~(same(F.col("name"), F.col("_name")) & same(F.col("version"), F.col("_version")))
    loose = F.col("datasource_id").isin(*LOOSE_LOCKS) & (clash(F.col("name"), F.col("_name")) | clash(F.col("version"), F.col("_version")))
    used = marked.where(~(F.col("_has") & (strict | loose)))
    rank = F.struct("pattern_pos", "path", "row_pos")
    fields = [c for c in manifests.columns if c not in ("path", "datasource_id", "dependencies", "row_pos")]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col("_starts") | F.col("_has")), rank)).alias(c) for c in fields]
    started = F.min(F.when(F.col("_starts"), F.struct(*rank_columns(), F.col("path").alias("datafile"), F.col("purl").alias("purl"))))
    packages = used.groupBy("parent_path", "assembler").agg(
        *filled, started.alias("_first"),
        F.array_sort(F.collect_set(F.when(F.col("_starts") | F.col("_has"), F.col("path")))).alias("datafile_paths"),
        F.array_sort(F.collect_set(F.when(F.col("_starts") | F.col("_has"), F.col("datasource_id")))).alias("datasource_ids"),
    ).where("_first IS NOT NULL")
    made = packages.withColumn("package_uid", package_uid(F.coalesce("_first.purl", F.concat_ws("/", "type", "name")), F.col("_first.datafile"))).drop("_first")
    owner = made.select("parent_path", "assembler", F.col("package_uid").alias("for_package_uid"))
    hoisted = hoist(used.select("path", "datasource_id", "parent_path", "assembler", "dependencies"), ["parent_path", "assembler"]) if "dependencies" in manifests.columns else None
    dependencies = None if hoisted is None else hoisted.join(owner, ["parent_path", "assembler"], "left").drop("parent_path", "assembler")
    return made, dependencies


def rank_columns() -> list[Column]:
    return [F.col("pattern_pos").alias("a"), F.col("path").alias("b"), F.col("row_pos").alias("c")]


def hoist(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each dependency that has a purl: its fields, datafile_path, datasource_id."""
    return rows.select(F.col("path").alias("datafile_path"), "datasource_id", *keep, F.inline("dependencies")).where("purl IS NOT NULL")


def each_packages(manifests: DataFrame, assemblers: tuple[Assembler, ...] = ASSEMBLERS) -> DataFrame:
    """Every row with a purl is a package of its own."""
    table = F.broadcast(assembler_table(manifests.sparkSession, assemblers).where("mode = 'each'").select("datasource_id", "assembler").distinct())
    rows = manifests.join(table, "datasource_id").where("purl IS NOT NULL")
    return rows.select(
        *[c for c in manifests.columns if c not in ("path", "datasource_id", "dependencies", "row_pos")], F.array("path").alias("datafile_paths"),
        F.array("datasource_id").alias("datasource_ids"), package_uid(F.col("purl"), F.col("path")).alias("package_uid"), "assembler",
    )


def package_root(path: Column) -> Column:
    """Root of a nested layout: above the deepest anchor directory, or the directory of a POM or extracted metadata."""
    segments = F.split(path, "/")
    places = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda s, i: F.when(s.isin(*ANCHORS), i))
    anchor = F.array_max(places)
    return F.when(anchor.isNotNull(), F.array_join(F.slice(segments, F.lit(1), anchor), "/")).when(file_name(path).isin("metadata.gz-extract", "pom.xml"), parent(path))


def nested_packages(manifests: DataFrame, assemblers: tuple[Assembler, ...] = ASSEMBLERS, one_per_config: bool = False) -> DataFrame:
    """One package for each root with two datafiles or more; a Maven root with several POMs below META-INF/maven has none.

    one_per_config keeps the least root of each assembler alone."""
    rows = _ordered(manifests, "nested", assemblers).withColumn("root", package_root(F.col("path"))).where("root IS NOT NULL")
    rows = rows.withColumn("row_pos", F.lit(0))
    fields = [c for c in manifests.columns if c not in ("path", "datasource_id", "dependencies", "row_pos")]
    rank = F.struct("pattern_pos", "path")
    grouped = rows.groupBy("root", "assembler").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields],
        F.array_sort(F.collect_set("path")).alias("datafile_paths"), F.array_sort(F.collect_set("datasource_id")).alias("datasource_ids"),
        F.count_if((F.col("datasource_id") == "maven_pom") & F.col("path").contains("META-INF/maven/")).alias("_poms"),
    )
    kept = grouped.where((F.size("datafile_paths") >= 2) & (F.col("_poms") <= 1) & identified()).drop("_poms")
    if one_per_config:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("assembler").orderBy("root"))).where("_n = 1").drop("_n")
    return kept.withColumn("package_uid", package_uid(F.coalesce("purl", F.concat_ws("/", "type", "name")), F.col("datafile_paths")[0]))


def replace_by_nested(packages: DataFrame, nested: DataFrame) -> DataFrame:
    """Packages whose purl a nested package has give way to it."""
    return packages.join(nested.select("purl").where("purl IS NOT NULL").distinct(), "purl", "left_anti").unionByName(nested.drop("root"), allowMissingColumns=True)


def distinct_gem_dependencies(dependencies: DataFrame) -> DataFrame:
    """Extracted gems list a dependency in several places: one row by package, purl, requirement and scope."""
    gem = F.col("datasource_id") == "gem_archive_extracted"
    return dependencies.where(~gem).unionByName(dependencies.where(gem).dropDuplicates(["for_package_uid", "purl", "extracted_requirement", "scope"]))


def hackage_packages(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By directory: with one cabal file its rows and project files make one package; with several each makes its own and
    project dependencies have no owner; with none dependencies are hoisted."""
    rows = manifests.where(F.col("datasource_id").isin("hackage_cabal", "hackage_cabal_project", "hackage_stack_yaml")).withColumn("parent_path", parent(F.col("path")))
    cabal = (F.col("datasource_id") == "hackage_cabal") & identified()
    counted = rows.withColumn("_cabals", F.count_if(cabal).over(Window.partitionBy("parent_path")))
    single = counted.withColumn("_all", F.when(F.col("_cabals") == 1, F.array_sort(F.collect_set("path").over(Window.partitionBy("parent_path")))).otherwise(F.array("path")))
    made = single.where(cabal).withColumn("package_uid", package_uid(F.col("purl"), F.col("path"))).withColumnRenamed("_all", "datafile_paths")
    own = made.select(F.col("parent_path").alias("_dir"), F.col("path").alias("_path"), F.col("package_uid").alias("for_package_uid"), F.col("_cabals").alias("_n"))
    dependencies = hoist(counted.select("path", "datasource_id", "parent_path", "dependencies"), ["parent_path"])
    owned = dependencies.join(own, (F.col("parent_path") == F.col("_dir")) & ((F.col("_n") == 1) | (F.col("datafile_path") == F.col("_path"))), "left")
    return made.drop("dependencies", "_cabals", "path", "datasource_id", "row_pos"), owned.drop("parent_path", "_dir", "_path", "_n")


def conda_merge(packages: DataFrame, files: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recipe packages fold into the installed package with the same purl whose ``extracted_package_dir`` holds their
    datafile; files and dependencies of theirs get its id."""
    installed = packages.where(F.array_contains("datasource_ids", "conda_meta_json") & F.col("extracted_package_dir").isNotNull())
    recipe = packages.where(F.array_contains("datasource_ids", "conda_meta_yaml")).select(F.col("package_uid").alias("_old"), F.col("purl").alias("_purl"), F.explode("datafile_paths").alias("_file"))
    above = ancestors(recipe, "_file").withColumnRenamed("_file", "_f")
    placed = recipe.join(above, F.col("_file") == F.col("_f")).select("_old", "_purl", "_file", "ancestor").distinct()
    directory = F.trim(F.col("extracted_package_dir"), F.lit("/"))
    pairs = placed.join(installed.select("package_uid", "purl", directory.alias("_dir")), (F.col("ancestor") == F.col("_dir")) & F.col("_purl").eqNullSafe(F.col("purl")))
    keys = pairs.groupBy("_old").agg(F.min("package_uid").alias("_new"), F.collect_set("_file").alias("_files"))
    more = keys.groupBy("_new").agg(F.flatten(F.collect_list("_files")).alias("_more"))
    left = packages.join(keys.select("_old"), F.col("package_uid") == F.col("_old"), "left_anti").join(more, F.col("package_uid") == F.col("_new"), "left")
    merged = left.withColumn("datafile_paths", F.array_sort(F.array_distinct(F.concat("datafile_paths", F.coalesce("_more", F.array().cast("array<string>")))))).drop("_new", "_more")
    swap = lambda df, c: df.join(keys.select("_old", "_new"), F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return merged, swap(files, "for_package"), swap(dependencies, "for_package_uid")


_MANIFEST_NAMES = {
    "npm": r"(?i)^package\.json$", "cargo": r"(?i)^cargo\.toml$", "composer": r"^(?:.*\.)?composer\.json$|^composer\..*\.json$",
    "gem": r"\.gemspec$|^Gemfile(?:\.lock)?$|^metadata\.gz-extract$",
}
_SKIPPED = {"npm": ("node_modules",), "cargo": ("target",), "composer": ("vendor", CACHE_DIRECTORY), "gem": (CACHE_DIRECTORY,)}


def package_roots(packages: DataFrame, kind: str) -> DataFrame:
    """root, package_uid: the directory of the first datafile that is a manifest of the kind."""
    manifest = F.filter("datafile_paths", lambda p: file_name(p).rlike(_MANIFEST_NAMES[kind]))
    found = packages.where(F.col("type") == kind).select("package_uid", F.get(manifest, F.lit(0)).alias("_m")).where("_m IS NOT NULL")
    return found.select(parent(F.col("_m")).alias("root"), "package_uid")


def owned_files(files: DataFrame, packages: DataFrame, kind: str, path: str = "path") -> DataFrame:
    """path, package_uid. npm, composer and gem: the deepest root above a file owns it; cargo: every root above does.
    Files in a root's dependency or build directory aren't that root's."""
    roots = package_roots(packages, kind)
    pairs = at_roots(ancestors(files, path), roots, path)
    inside = F.when(F.col("root") == "", F.col(path)).otherwise(F.substr(F.col(path), F.length("root") + 2, F.length(path)))
    kept = pairs.where(~F.split(inside, "/")[0].isin(*_SKIPPED[kind]))
    if kind == "cargo":
        return kept.select(path, "package_uid").distinct()
    nearest = Window.partitionBy(path).orderBy("distance")
    return kept.withColumn("_n", F.rank().over(nearest)).where("_n = 1").select(path, "package_uid").distinct()


def requirements_owners(files: DataFrame, packages: DataFrame, path: str = "path") -> DataFrame:
    """path, package_uid for requirement files in a directory named ``requirements``: the nearest project above that
    directory, and none if two projects are equally near."""
    project = F.filter("datafile_paths", lambda p: file_name(p).isin(*PROJECT_FILES))
    roots = packages.where("type = 'pypi'").select("package_uid", F.get(project, F.lit(0)).alias("_m")).where("_m IS NOT NULL").select(parent(F.col("_m")).alias("root"), "package_uid")
    own = files.where(F.col("datasource_id") == "pip_requirements").where(file_name(parent(F.col(path))) == "requirements")
    pairs = at_roots(ancestors(own, path).where("distance >= 2"), roots, path)
    best = pairs.withColumn("_n", F.rank().over(Window.partitionBy(path).orderBy("distance"))).where("_n = 1")
    return best.groupBy(path).agg(F.count(F.lit(1)).alias("_k"), F.min("package_uid").alias("package_uid")).where("_k = 1").drop("_k")


def nearest_versions(references: DataFrame, central: DataFrame) -> DataFrame:
    """References without a version get the central one of the nearest directory above: references (path, name, version),
    central (path of the file, name, version)."""
    given = central.select(parent(F.col("path")).alias("_dir"), F.col("name").alias("_name"), F.col("version").alias("_version"))
    above = ancestors(references.select("path").distinct()).withColumnRenamed("path", "_p")
    pairs = references.select("path", "name").distinct().join(above, F.col("path") == F.col("_p")).join(given, (F.col("ancestor") == F.col("_dir")) & (F.lower("name") == F.lower("_name")))
    best = pairs.groupBy("path", "name").agg(F.min_by("_version", "distance").alias("_found"))
    return references.join(best, ["path", "name"], "left").withColumn("version", F.coalesce("version", "_found")).drop("_found")


def referenced_files(packages: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """path, package_uid of files that an installed package lists: references (package_uid, root, path below it)."""
    full = F.trim(F.concat_ws("/", F.nullif(F.trim(F.col("root"), F.lit("/")), F.lit("")), F.trim(F.col("path"), F.lit("/"))), F.lit("/"))
    wanted = references.join(packages.select("package_uid"), "package_uid", "left_semi").select("package_uid", full.alias("path"))
    return wanted.join(files.select("path"), "path", "left_semi").select("path", "package_uid").distinct()


def workspace_members(workspaces: DataFrame, packages: DataFrame) -> DataFrame:
    """path of a workspace manifest and package_uid of each member. workspaces: path, patterns (relative globs of member
    directories; one that starts with ! takes away)."""
    roots = packages.select("package_uid", F.explode("datafile_paths").alias("_m")).select("package_uid", parent(F.col("_m")).alias("_dir")).distinct()
    above = ancestors(roots.select("_dir").distinct(), "_dir", self=True).withColumnRenamed("_dir", "_d")
    pairs = roots.join(above, F.col("_dir") == F.col("_d")).join(workspaces.select("path", "patterns", parent(F.col("path")).alias("_root")), F.col("ancestor") == F.col("_root"))
    inside = F.when(F.col("_root") == "", F.col("_dir")).otherwise(F.substr(F.col("_dir"), F.length("_root") + 2, F.length("_dir")))
    regex = lambda p: F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.regexp_replace(F.regexp_replace(p, r"^!|/$|^\./", ""), r"([.+^${}()|\[\]\\])", r"\\$1"), F.lit("**"), F.lit("\0")), F.lit("*"), F.lit("[^/]*")), F.lit("\0"), F.lit(".*")), F.lit("$"))
    plus = F.exists("patterns", lambda p: ~p.startswith("!") & F.regexp_like(inside, regex(p)))
    minus = F.exists("patterns", lambda p: p.startswith("!") & F.regexp_like(inside, regex(p)))
    return pairs.where(plus & ~minus).select("path", "package_uid").distinct()


def unassembled_dependencies(manifests: DataFrame, owners: DataFrame, assemblers: tuple[Assembler, ...] = ASSEMBLERS) -> DataFrame:
    """Dependencies of manifests that nobody owns and no assembler reads; shared property files don't count."""
    read = F.broadcast(assembler_table(manifests.sparkSession, assemblers).select("datasource_id").distinct())
    props = F.col("datasource_id").isin("nuget_directory_build_props", "nuget_directory_packages_props")
    free = manifests.where(~props).join(read, "datasource_id", "left_anti").join(owners.select("path").distinct(), "path", "left_anti")
    return hoist(free, []).withColumn("for_package_uid", F.lit(None).cast("string"))


def final_order(packages: DataFrame, dependencies: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """For sinks: packages by purl, name, version, first datafile; dependencies by six keys, ids without their uuid."""
    ordered = packages.withColumn("datafile_paths", F.array_sort(F.array_distinct("datafile_paths"))).orderBy("purl", "name", "version", F.get("datafile_paths", F.lit(0)))
    if dependencies is None:
        return ordered, None
    bare = F.regexp_replace("for_package_uid", "uuid=[0-9a-f-]*", "")
    return ordered, dependencies.orderBy("purl", "extracted_requirement", "scope", "datafile_path", "datasource_id", bare)
