"""Text and content columns: lines, hashes, languages, generated code, magic bytes, source maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of which a hint of generated code is looked for, and characters of a hint that are kept.
GENERATED_LINES, HINT_CHARS = 150, 100

#: Shortest forms only: a phrase that holds another one can't match alone.
GENERATED_PHRASES = (
    "auto-generated",
    "automatically created by",
    "automatically generated",
    "do not edit this file",
    "following schema fragment specifies the",
    "generated automatically by aclocal",
    "generated by",
    "generated code -- do not edit",
    "generated file, do not edit",
    "generated on",
    "it is machine generated",
    "this code is generated",
    "this is an autogenerated file",
)

# Extensions and names by language, and what counts as source.
LANGUAGE_EXTENSIONS = {
    "C": "c h", "C#": "cs", "C++": "cc cpp cxx hpp", "CSS": "css", "Clojure": "clj", "Dart": "dart", "Elixir": "ex exs",
    "Erlang": "erl", "F#": "fs", "GAS": "s", "Go": "go", "HTML": "htm html", "Haskell": "hs", "JSON": "json", "Java": "java",
    "JavaScript": "js", "Julia": "jl", "Kotlin": "kt kts", "Lua": "lua", "Markdown": "markdown md", "PHP": "php", "Perl": "pl",
    "Python": "py", "R": "r", "Ruby": "rb", "Rust": "rs", "SQL": "sql", "Scala": "scala", "Shell": "bash sh",
    "SuperCollider": "sc", "Swift": "swift", "TeX": "tex", "TypeScript": "ts", "XML": "xml", "YAML": "yaml yml",
}
SHEBANGS = (("python", "Python"), ("node", "JavaScript"), ("ruby", "Ruby"), ("perl", "Perl"), ("php", "PHP"), ("sh", "Shell"))
NAMES = {"containerfile": "Dockerfile", "containerfile.core": "Dockerfile", "dockerfile": "Dockerfile", "gemfile": "Ruby", "makefile": "Makefile", "rakefile": "Ruby"}
SOURCE_EXTENSIONS = frozenset(
    "py rb ruby pl php lua r nim swift kt scala groovy java jsp js jsx ts html htm go rs hs clj lisp el "
    "c cc cpp cxx c++ h hh hpp hxx m d e cs csx fs vb bas asp aj ada adb pas cob f f77 f90 for fth ftn "
    "asm s vhdl verilog m4 sh csh ksh bat ps1 pp po".split()
)


def lines(text: Column) -> Column:
    """Lines without their ends: cut at LF, one CR before it dropped, and no empty line after a last LF."""
    parts = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"\r\z", ""))
    ended = text.endswith("\n") | (text == "")
    return F.when(ended, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(_last_as_is(text, parts))


def _last_as_is(text: Column, parts: Column) -> Column:
    """A CR that no LF follows belongs to the last line."""
    return F.when(text.endswith("\r"), F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.regexp_extract(text, r"([^\n]*)\z", 1)))).otherwise(parts)


def explode_lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """A row for each line: the columns ``keep``, line (from 1), text_line."""
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("pos", "text_line")).select(*keep, (F.col("pos") + 1).alias("line"), "text_line")


def line_at(text: Column, offset: Column) -> Column:
    """The line (from 1) of a character offset (from 0)."""
    before = F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def strip_bom(text: Column) -> Column:
    return F.when(text.startswith("﻿"), F.substr(text, F.lit(2), F.length(text))).otherwise(text)


def unescape_space(text: Column) -> Column:
    """Written-out escapes of CR, LF and tab become spaces."""
    return F.regexp_replace(text, r"\\[rnt]", " ")


def git_blob_sha1(content: Column) -> Column:
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def content_hashes(content: Column) -> list[Column]:
    return [
        F.sha1(content).alias("sha1"),
        F.md5(content).alias("md5"),
        F.sha2(content, 256).alias("sha256"),
        git_blob_sha1(content).alias("sha1_git"),
    ]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case, without the dot; empty for a name without one and for one whose only dot is its first character."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(*sorted(SOURCE_EXTENSIONS))


def is_utf8_text(content: Column) -> Column:
    """No zero byte near the start, and valid UTF-8."""
    return (F.position(F.lit("\0"), F.substring(content.cast("string"), 1, 1024)) == 0) & F.is_valid_utf8(content.cast("string"))


def language(path: Column, content: Column) -> Column:
    """Programming language, by shebang, extension, name, then a look at the first 1000 characters."""
    text = content.cast("string")
    head = F.substring(text, 1, 1000)
    shebang = F.regexp_extract(text, r"^#!([^\n]*)", 1)
    by_shebang = F.coalesce(*[F.when(text.startswith("#!") & shebang.contains(word), F.lit(name)) for word, name in SHEBANGS])
    pairs = [F.lit(x) for name, exts in LANGUAGE_EXTENSIONS.items() for e in exts.split() for x in (e, name)]
    by_extension = F.try_element_at(F.create_map(*pairs), extension(path))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.lower(file_name(path)))
    sniffed = (
        F.when(head.contains("<?php"), "PHP")
        .when(head.contains("<html") | head.contains("<!DOCTYPE html"), "HTML")
        .when(head.contains("import React") | head.contains("import {"), "JavaScript/TypeScript")
        .when(head.contains("def ") & head.contains(":"), "Python")
        .when(head.contains("package ") & head.contains("import ") & head.contains("{"), "Go")
        .otherwise("Text")
    )
    readable = is_utf8_text(content)
    return F.when((F.octet_length(content) > 32) & ~readable, "Binary").otherwise(
        F.coalesce(by_shebang, by_extension, by_name, F.when(readable, sniffed), F.lit("Unknown"))
    )


def generated_hints(text: Column) -> Column:
    """Lower-cased lines, cut short, that say the file is generated."""
    found = F.lit(False)
    trimmed = F.transform(F.slice(lines(text), 1, GENERATED_LINES), lambda s: F.lower(F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))))

    def says(s: Column) -> Column:
        hit = found
        for phrase in GENERATED_PHRASES:
            hit = hit | s.contains(phrase)
        return hit

    return F.transform(F.filter(trimmed, says), lambda s: F.substring(s, 1, HINT_CHARS))


def is_generated(text: Column) -> Column:
    return F.size(generated_hints(text)) > 0


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.unhex(F.lit("504B0304"))


def is_squashfs(content: Column) -> Column:
    return F.substring(content, 1, 4).isin(b"hsqs", b"sqsh")


def is_nsis(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8192))
    return F.regexp_like(head, F.lit("^(..)*" + b"Nullsoft.NSIS.exehead".hex().upper()))


def sourcemap_text(text: Column) -> Column:
    """The sources that a source map carries, joined by LF, with written-out line ends made real; null if it has none."""
    parsed = F.from_json(strip_bom(text), "struct<sourcesContent:array<string>>")
    held = F.filter(parsed["sourcesContent"], lambda s: s.isNotNull())
    joined = F.array_join(held, "\n")
    for old in (r"\\r\\n", r"\\n", r"\\r"):
        joined = F.regexp_replace(joined, old, "\n")
    return F.when((F.size(held) > 0) & (joined != ""), joined)


def is_pem(text: Column) -> Column:
    """A PEM certificate or key file: its text gives no findings."""
    return F.regexp_like(text, F.lit(r"^\s*-----BEGIN (?:[A-Z0-9]+ )*(?:CERTIFICATE|KEY|PKCS7|X509 CRL)"))
