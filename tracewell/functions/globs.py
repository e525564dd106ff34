"""Path patterns as regular expressions, so that they run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str | None:
    """Whole-string expression of a glob: ``*`` and ``?`` don't stop at ``/``, ``**`` takes whole segments, classes may
    start with ``!``. None for a malformed one, which matches nothing."""
    out, k, n = [], 0, len(pattern)
    while k < n:
        c = pattern[k]
        if c == "*":
            run = len(pattern[k:]) - len(pattern[k:].lstrip("*"))
            if run > 2:
                return None
            if run == 2:
                before = k == 0 or pattern[k - 1] == "/"
                after = k + 2 == n or pattern[k + 2] == "/"
                if not (before and after):
                    return None
                if k + 2 == n:
                    out.append(".*")
                    k = n
                else:
                    out.append("(?:.*/)?")
                    k += 3
                continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            at = k + 1 + (pattern[k + 1 : k + 2] == "!")
            end = pattern.find("]", at + 1)
            if end < 0:
                return None
            body = pattern[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append("[" + ("^" if at > k + 1 else "") + body + "]")
            k = end
        else:
            out.append(re.sub(r"([^\w/])", r"\\\1", c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def matches_path(path: Column, patterns: list[str]) -> Column:
    """Whether a path is selected. Patterns are lower-cased. One without ``/`` selects by any segment of the path; one
    with it by the path or any directory above it, without leading slashes (and zeros: they go with the slashes)."""
    lowered = F.lower(path)
    segments = F.filter(F.split(lowered, "/"), lambda s: s != "")
    stripped = F.regexp_replace(lowered, "^[/0]+", "")
    hit = F.lit(False)
    for pattern in patterns:
        p = pattern.strip().lower()
        whole = glob_regex(p.lstrip("/") if "/" in p else p) if p else None
        if whole is None:
            continue
        if "/" not in p:
            hit = hit | _any_segment(segments, whole)
        else:
            parts = F.split(stripped, "/")
            above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
            hit = hit | _any_segment(above, whole)
    return hit


def _any_segment(values: Column, whole: str) -> Column:
    return F.exists(values, lambda s: s.rlike(whole))
