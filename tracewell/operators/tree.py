"""Path trees: ancestors, depth limits, include and exclude filters, counters, roots, result shaping.

A tree is a table with ``path`` (relative, ``/`` between segments) and ``is_dir``. Tree questions are equi-joins with
``ancestors``, never prefix comparisons of all paths with all others.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_path


def parent(path: Column) -> Column:
    """Path of the directory that holds it; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    """Segments: entries of the root have depth 1."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(df: DataFrame, path: str = "path", self: bool = False) -> DataFrame:
    """path, ancestor, distance, for every directory above a path (the root is empty), and the path itself if asked."""
    parts = F.col("_parts")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor"), (F.size(parts) - k).alias("distance")))
    split = df.select(path, F.split(F.col(path), "/").alias("_parts"))
    return split.select(path, F.inline(above)).where(F.col("distance") >= (0 if self else 1))


#: A directory above more paths than this is joined in several groups of them.
MOST_BELOW = 1_000_000


def at_roots(above: DataFrame, roots: DataFrame, path: str = "path", most: int | None = None) -> DataFrame:
    """Rows of ``ancestors`` joined with the roots (root and other columns) at their ancestor.

    Only levels that have a root are looked at. All paths are below the top, and many may be below one root, which one
    task would read: such rows are dealt over groups by a hash of the path, and the few roots go to each group."""
    most = most or MOST_BELOW
    levels = roots.select(depth(F.col("root")).alias("_level")).distinct()
    near = above.withColumn("_level", depth(F.col("ancestor"))).join(F.broadcast(levels), "_level", "left_semi").drop("_level")
    heavy = near.groupBy("ancestor").agg(F.ceil(F.count(F.lit(1)) / most).alias("_groups")).where("_groups > 1").withColumnRenamed("ancestor", "_heavy")
    dealt = near.join(F.broadcast(heavy), F.col("ancestor") == F.col("_heavy"), "left").withColumn("_group", F.when(F.col("_groups").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(path), F.col("_groups")))).drop("_heavy", "_groups")
    numbers = F.sequence(F.lit(0).cast("long"), F.coalesce("_groups", F.lit(1).cast("long")) - 1)
    copies = roots.join(F.broadcast(heavy), F.col("root") == F.col("_heavy"), "left").withColumn("_number", F.explode(numbers)).drop("_heavy", "_groups")
    return dealt.join(copies, (F.col("ancestor") == F.col("root")) & (F.col("_group") == F.col("_number"))).drop("_group", "_number")


def with_directories(files: DataFrame, path: str = "path") -> DataFrame:
    """The files and every directory above one: path, is_dir. Directories are pre-aggregated by the distinct."""
    above = ancestors(files, path).where("ancestor <> ''").select(F.col("ancestor").alias(path)).distinct()
    return files.select(path, F.lit(False).alias("is_dir")).unionByName(above.withColumn("is_dir", F.lit(True)))


def limit_depth(tree: DataFrame, max_depth: int, path: str = "path") -> DataFrame:
    """0 is no limit; a limit of N keeps entries down to depth N + 1, as entries of the last directory are listed."""
    return tree.where(depth(F.col(path)) <= max_depth + 1) if max_depth > 0 else tree


def exclude(tree: DataFrame, patterns: list[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """What is left, and one row with ``excluded_count``: paths that match with no match above them."""
    hit = matches_path(F.col(path), patterns)
    directories = tree.where("is_dir").where(hit).select(F.col(path).alias("ancestor"))
    below = ancestors(tree, path).join(directories, "ancestor", "left_semi").select(path).distinct()
    own = tree.where(hit)
    count = own.join(below, path, "left_anti").agg(F.count(F.lit(1)).alias("excluded_count"))
    return tree.where(~hit).join(below, path, "left_anti"), count


def keep_with_parents(tree: DataFrame, kept: DataFrame, path: str = "path") -> DataFrame:
    """The kept paths and the directories above them."""
    wanted = ancestors(kept.select(path), path, self=True).select(F.col("ancestor").alias("_wanted")).distinct()
    return tree.join(wanted, F.col(path) == F.col("_wanted"), "left_semi")


def include_exclude(tree: DataFrame, includes: list[str] = (), excludes: list[str] = (), path: str = "path") -> DataFrame:
    """Includes come first, then excludes. A directory stays if it matches itself or is above a file that stays."""
    out = tree
    chosen = [p for p in includes if p.strip()]
    if chosen:
        own = tree.where(matches_path(F.col(path), chosen))
        out = keep_with_parents(tree, own, path)
    dropped = [p for p in excludes if p.strip()]
    if dropped:
        out = exclude(out, dropped, path)[0]
    return out


def common_root(inputs: list[str]) -> tuple[str, list[str]]:
    """Root of several relative inputs, and the inputs as include patterns below it; one input is its own root."""
    if len(inputs) == 1:
        return inputs[0], []
    if any(p.startswith("/") or re.match(r"^[A-Za-z]:", p) for p in inputs):
        raise ValueError("several inputs have to be relative paths")
    split = [[s for s in p.split("/") if s not in ("", ".")] for p in inputs]
    shared: list[str] = []
    for names in zip(*split, strict=False):
        if len(set(names)) > 1:
            break
        shared.append(names[0])
    return "/".join(shared) or ".", ["/".join(s) for s in split]


def counters(files: DataFrame, type_col: str = "type", size_col: str = "size") -> DataFrame:
    """files_count, directories_count, size_count in one row."""
    file = F.col(type_col) == "file"
    return files.agg(
        F.count_if(file).alias("files_count"), F.count_if(F.col(type_col) == "directory").alias("directories_count"),
        F.coalesce(F.sum(F.when(file, F.col(size_col))), F.lit(0)).alias("size_count"),
    )


def directory_counts(tree: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """path of each directory, with files_count, dirs_count, size_count of all that is below it."""
    below = ancestors(tree.select(path, "is_dir", size), path).join(tree.select(path, "is_dir", size), path)
    counted = below.groupBy("ancestor").agg(
        F.count_if(~F.col("is_dir")).alias("files_count"), F.count_if("is_dir").alias("dirs_count"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col(size))), F.lit(0)).alias("size_count"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files_count", "dirs_count", "size_count")]
    return tree.where("is_dir").select(path).join(counted, F.col(path) == F.col("ancestor"), "left").select(path, *zero)


def scan_root(files: DataFrame, path: str = "path", is_dir: str = "is_dir") -> DataFrame:
    """One row, root: the shallowest, then shortest directory; a single file is its own root; else files' common start."""
    order = lambda c: F.struct(F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))), F.length(c), c)
    p = F.col(path)
    summed = files.agg(
        F.min_by(p, F.when(F.col(is_dir), order(p))).alias("directory"), F.count_if(F.col(is_dir)).alias("dirs"),
        F.count(p).alias("n"), F.min(p).alias("first"), F.max(p).alias("last"),
    )
    a, b = F.split("first", "/"), F.split("last", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda k: F.when(F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k), k))
    common = F.array_join(F.slice(a, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/")
    return summed.select(F.when(F.col("dirs") > 0, F.col("directory")).when(F.col("n") == 1, F.col("first")).otherwise(common).alias("root"))


def strip_root(path: Column, root: Column | str) -> Column:
    """Path below the root; the root itself is its name."""
    root = F.lit(root) if isinstance(root, str) else root
    bare = F.trim(root, F.lit("/"))
    own = F.trim(path, F.lit("/"))
    inside = own.startswith(F.concat(bare, F.lit("/")))
    return F.when(own == bare, F.element_at(F.split(bare, "/"), -1)).when((bare == "") | ~inside, own).otherwise(F.substr(own, F.length(bare) + 2, F.length(own)))


def full_root(path: Column, root: str) -> Column:
    """Absolute path, without slashes at its ends."""
    return F.trim(F.concat_ws("/", F.lit(root.rstrip("/")), F.trim(path, F.lit("/"))), F.lit("/"))


def unique_findings(found: DataFrame, key: str, value: str) -> DataFrame:
    """Findings with equal value and lines once."""
    return found.dropDuplicates([key, value, "start_line", "end_line"])


def drop_matching(files: DataFrame, facts: DataFrame, value: str, patterns: list[str], path: str = "path") -> DataFrame:
    """Files of which no fact (an author, a holder) matches a pattern."""
    if not patterns:
        return files
    hit = reduce(lambda a, b: a | b, [F.col(value).rlike(p) for p in patterns])
    return files.join(facts.where(hit).select(path).distinct(), path, "left_anti")


def only_findings(tree: DataFrame, facts: list[DataFrame], path: str = "path") -> DataFrame:
    """Files with a row in some fact table, and directories above them."""
    with_fact = reduce(DataFrame.unionByName, [f.select(path) for f in facts]).distinct()
    return keep_with_parents(tree, with_fact, path)


def mark_source(tree: DataFrame, path: str = "path", least: float = 0.9) -> DataFrame:
    """path, is_source, source_count. A directory is one of source if at least ``least`` of the files below it are."""
    files = tree.where(~F.col("is_dir")).select(path, F.coalesce("is_source", F.lit(False)).alias("is_source"))
    below = ancestors(files, path).join(files, path).groupBy("ancestor").agg(F.count_if("is_source").alias("source_count"), F.count(F.lit(1)).alias("n"))
    directories = tree.where("is_dir").select(path).join(below, F.col(path) == F.col("ancestor"), "left").select(
        path, (F.coalesce(F.col("source_count") / F.col("n"), F.lit(0.0)) >= least).alias("is_source"), F.coalesce("source_count", F.lit(0)).alias("source_count")
    )
    return files.select(path, "is_source", F.when(F.col("is_source"), 1).otherwise(0).cast("long").alias("source_count")).unionByName(directories)


def trim_assembly(packages: DataFrame, dependencies: DataFrame, kept: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Packages with a datafile among the kept files, cut to those, and dependencies of kept files."""
    opened = packages.withColumn("_datafile", F.explode("datafile_paths")).join(kept.select(F.col(path).alias("_datafile")), "_datafile", "left_semi")
    columns = [c for c in packages.columns if c not in ("datafile_paths", "package_uid")]
    left = opened.groupBy("package_uid").agg(F.array_sort(F.collect_set("_datafile")).alias("datafile_paths"), *[F.first(c).alias(c) for c in columns])
    return left.select(*packages.columns), dependencies.join(kept.select(F.col(path).alias("datafile_path")), "datafile_path", "left_semi")
