"""File trees through Spark's own file source, so that any store it reads will do.

Paths are relative to the root. Content is a column that Spark reads only where a plan asks for it: tree questions
(selection, counts, facets) never open a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tree as tr

#: Types by extension, of those that need no look at the content.
_MIME = {
    "application/json": "json map", "application/pdf": "pdf", "application/gzip": "gz tgz", "application/zip": "zip jar war ear whl nupkg", "application/x-tar": "tar", "application/xml": "xml xsd xsl pom",
    "image/png": "png", "image/jpeg": "jpg jpeg", "image/gif": "gif", "image/svg+xml": "svg", "audio/ogg": "ogg oga", "text/html": "htm html", "text/css": "css", "text/markdown": "md markdown", "text/x-python": "py",
    "text/x-c": "c h", "text/x-c++": "cc cpp cxx hpp", "text/x-java": "java", "application/javascript": "js mjs", "text/csv": "csv", "application/yaml": "yaml yml",
}
_ARCHIVES = "zip jar war ear tar gz tgz bz2 xz zst 7z rar whl gem nupkg deb rpm apk egg cab iso dmg".split()
_MEDIA = "png jpg jpeg gif svg bmp ico webp mp3 mp4 ogg oga ogv wav flac avi mov mkv webm ttf otf woff woff2".split()
_SCRIPTS = "sh bash zsh csh ksh py pl rb php js lua ps1 bat awk tcl".split()


def hidden_paths(spark: SparkSession, root: str) -> list[str]:
    """Files and directories whose names begin with a dot or an underscore: Spark's listing leaves them out unless they
    are named. Found level by level through the store's own interface; as many names as there are such entries."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, level = [], root.rstrip("/")
    while True:
        found = store.globStatus(at(level + "/{.,_}*"))
        out += [s.getPath().toString() for s in found or []]
        level += "/*"
        if not len(store.globStatus(at(level)) or []):
            return out


def read_tree(spark: SparkSession, root: str, max_depth: int = 0, excludes: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, excluded): path, size, modified, content of the files below a root, and one row with ``excluded_count``.

    An excluded directory hides all that is below it; a depth limit of N lists entries down to depth N + 1. An excluded
    root leaves nothing and counts as one."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("__globPaths__", "false").load([root, *hidden_paths(spark, root)])
    base = root.rstrip("/").split("://")[-1]
    inside = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    prefix = "/" + base.removeprefix("file:").lstrip("/") if not base.startswith("/") else base
    own = F.when(inside.startswith(prefix + "/"), F.substr(inside, F.lit(len(prefix) + 2), F.length(inside))).otherwise(tx.file_name(inside))
    files = raw.select(own.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    if max_depth > 0:
        files = tr.limit_depth(files, max_depth)
    patterns = [p for p in excludes if p.strip()]
    if not patterns:
        return files, spark.range(1).select(F.lit(0).cast("long").alias("excluded_count"))
    left, count = tr.exclude(tr.with_directories(files.select("path")), patterns)
    kept = left.where(~F.col("is_dir")).select("path")
    return files.join(kept, "path", "left_semi"), count


def directories_of(files: DataFrame, path: str = "path") -> DataFrame:
    """path, is_dir of files and the directories above them."""
    return tr.with_directories(files, path)


def texts_of(files: DataFrame, content: str = "content") -> DataFrame:
    """path, text: decoded as UTF-8 where that works, as Latin-1 where the bytes are text in another coding, and the
    readable runs of other files; source maps give the sources they carry. A byte-order mark is left out."""
    raw = F.col(content).cast("string")
    valid = F.is_valid_utf8(raw)
    binary = F.position(F.lit("\0"), F.substring(raw, 1, 1024)) > 0
    latin = F.decode(content, "ISO-8859-1")
    runs = F.array_join(F.regexp_extract_all(latin, F.lit(r"[\x20-\x7E\t]{4,}"), F.lit(0)), "\n")
    text = F.when(valid & ~binary, raw).when(~binary, latin).otherwise(runs)
    mapped = F.col("path").rlike(r"\.(?:js|css)\.map$")
    return files.select("path", tx.strip_bom(F.when(mapped, F.coalesce(tx.sourcemap_text(text), text)).otherwise(text)).alias("text"))


def _extension_in(kinds: list[str]) -> Column:
    return tx.extension(F.col("path")).isin(*kinds)


def file_info(files: DataFrame, content: str = "content") -> DataFrame:
    """Columns about a file: name, type, size, hashes, language and flags. One projection."""
    raw = F.col(content)
    name = tx.file_name(F.col("path"))
    extension = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    text = tx.is_utf8_text(raw)
    by_extension = F.try_element_at(F.create_map(*[F.lit(x) for kind, exts in _MIME.items() for e in exts.split() for x in (e, kind)]), tx.extension(F.col("path")))
    shebang = F.substring(raw.cast("string"), 1, 2) == "#!"
    return files.select(
        "path", F.lit("file").alias("type"), name.alias("name"), F.when(extension == "", name).otherwise(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")).alias("base_name"), extension.alias("extension"),
        F.octet_length(raw).cast("long").alias("size"), *tx.content_hashes(raw), F.coalesce(by_extension, F.when(text, F.lit("text/plain")).otherwise("application/octet-stream")).alias("mime_type"),
        tx.language(F.col("path"), raw).alias("programming_language"), (~text).alias("is_binary"), text.alias("is_text"), (_extension_in(_ARCHIVES) | tx.is_zip(raw)).alias("is_archive"), _extension_in(_MEDIA).alias("is_media"),
        tx.is_source(F.col("path")).alias("is_source"), (_extension_in(_SCRIPTS) | shebang).alias("is_script"),
    )
