"""Copyright statements, their holders, and authors.

The JVM picks candidate lines; only these go to Python, where each run of lines is cut into tagged tokens, reduced by an
ordered grammar, and read off the tree. Facts are rows (key, kind, value, start_line, end_line).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as tx

#: Fixed values. A line that holds one of these (lower-cased) may state a copyright or an author.
MARKERS = ("opyr", "opyl", "copr", "©", "|copy|", "&#169", "&#xa9", "169", "xa9", "00a9", "\\251", "reserv", "auth", "contrib", "commit", "devel", "by ", "@", "<s>", "</s>", "<s/>")
_YEAR = r"(?:19[6-9][0-9]|20[0-9]{2})"
YEAR_HINT = rf"[(.,\-)\s]{_YEAR}(?:[(.,\-)\s]|$)"
#: The first "(c)" after no letter or digit, with what follows it past white space.
C_SIGN = r"(?i)(?:^|[^a-z0-9])\(c\)\s*(\S)"
TRAILING_YEAR = rf"{_YEAR}[\p{{Punct}}\s]*$"
LONG_LINE = 2000
CREDITS_NAMES = ("author", "authors", "authors.md", "authors.rst", "authors.txt", "credit", "credits", "credits.md", "credits.rst", "credits.txt")
CREDITS_LINES = 50
#: Reductions of a group's parse, at most.
REDUCTIONS = 50
#: Characters up to which a run of lines is remembered.
REMEMBERED_CHARS = 1000
#: Statements that are handed on together.
ROWS_AT_ONCE = 10_000


def normalise(text: Column) -> Column:
    """Links in short "copyrighted by" snippets become their URLs, and URLs in angle brackets that are cut by a line end
    are joined by a space."""
    low = F.lower(text)
    snippet = low.contains("copyrighted by") & low.contains("href=") & ~low.contains("<html") & ~low.contains("<head") & (F.size(tx.lines(text)) <= 40)
    linked = F.regexp_replace(text, r"""(?is)\bhref\s*=\s*['"](http://[^'">\s]+)['"]\s*/?>?""", " $1 ")
    out = F.when(snippet, linked).otherwise(text)
    return F.regexp_replace(out, r"(?is)<\s*(https?://[^\s>]+)\s*\r?\n\s*([^\s>]+)\s*>", "$1 $2")


def has_hint(line: Column) -> Column:
    low, hit = F.lower(line), F.lit(False)
    for m in MARKERS:
        hit = hit | low.contains(m)
    return hit | (low.contains("(c)") & F.regexp_extract(line, C_SIGN, 1).rlike("^[0-9A-Z]$"))


def has_year(line: Column) -> Column:
    return line.rlike(YEAR_HINT)


def has_trailing_year(line: Column) -> Column:
    return line.rlike(TRAILING_YEAR)


def is_encoded(line: Column) -> Column:
    """Lines of uuencoded or base64 data."""
    return line.rlike(r"^M[\x20-\x60]{60}$") | line.rlike(r"^[A-Za-z0-9+/]{60,}={0,2}$")


def is_candidate(line: Column) -> Column:
    strong = F.lower(line).rlike(r"copyright|\(c\)|©|&copy")
    return (has_hint(line) | has_year(line)) & ~is_encoded(line) & ((F.length(line) <= LONG_LINE) | strong)


def prepare(line: Column) -> Column:
    """Comment signs, markup and entities go; signs for copyright become (c); white space is collapsed."""
    out = line
    for old, new in (
        (r"(?i)&copy;?|&#169;?|&#xa9;?|\\251|\|copy\||\\u00a9|©", " (c) "), (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"(?i)&amp;", "&"), (r"(?i)&quot;|&#34;", '"'),
        (r"(?i)</?(?:p|br|s|b|i|a|tt|td|tr|li|div|span|em|strong|center|font|h[1-6]|small|address|copyright|author|holder)(?:\s[^>]*)?/?>", " "),
        (r"^[\s/*#;%!'\"|>\\-]+|(?<=\s)[/*#|\\]+(?=\s|$)|\*+/\s*$", " "), (r"\\[nrt]", " "), (r"[`“”‘’\"]", "'"), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, old, new)
    return F.trim(out)


def candidate_lines(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, line, text_line, next_line of each candidate, prepared; next_line is null if it is a candidate itself. PEM
    files are left out.

    Lines are rows before they are tested, so that the test runs in generated code; no shuffle, and the rows of a text
    stay together and in order."""
    lines = tx.lines(normalise(F.col(text)))
    pairs = F.arrays_zip(lines.alias("own"), F.slice(lines, F.lit(2), F.size(lines)).alias("following"))
    opened = df.where(~tx.is_pem(F.col(text))).select(key, F.posexplode(pairs).alias("pos", "pair"))
    shown = opened.select(key, (F.col("pos") + 1).alias("line"), F.col("pair").getField("own").alias("own"), F.col("pair").getField("following").alias("following"))
    kept = shown.where(is_candidate(F.col("own")))
    follows = F.when(F.col("following").isNotNull() & ~is_candidate(F.col("following")), prepare(F.col("following")))
    return kept.select(key, "line", prepare(F.col("own")).alias("text_line"), follows.alias("next_line"))


def candidate_groups(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, group_id, line, text_line: runs of candidate lines, as islands over line numbers."""
    opened = candidate_lines(df, key, text).select(key, "line", "text_line")
    order = Window.partitionBy(key).orderBy("line")
    new = F.when(F.col("line") - F.lag("line").over(order) == 1, 0).otherwise(1)
    return opened.withColumn("_new", new).withColumn("group_id", F.sum("_new").over(order)).select(key, "group_id", "line", "text_line")


@dataclass
class Token:
    value: str
    tag: str
    line: int


_W = r"[A-ZÀ-ÖØ-Þ][\w'’.\-]*"
#: The first expression that fits a whole token names its tag.
TAGS: list[tuple[str, re.Pattern]] = [
    (tag, re.compile(rf"(?:{p.removeprefix('(?i)')})\Z", re.IGNORECASE if p.startswith("(?i)") else 0))
    for tag, p in (
        ("EMAIL", r"[<(\[{]*[\w.+%\-]+@[\w\-]+(?:\.[\w\-]+)+[>)\]},.;:]*"),
        ("URL", r"[<(\[]*(?:https?|ftp)://\S+|[<(\[]*www\.\S+"),
        ("COPY", r"(?i)[(\[]?copyrights?[)\]:.,]*|copr\.?|copyrighted|\(c\)[.,:]?|copyleft|copyright\(c\)|©"),
        ("YR", rf"{_YEAR}(?:,[0-9]{{2}})+[.,]*|[(\[]?{_YEAR}(?:[-–/]{_YEAR}|[-–/][0-9]{{1,2}})?\+?[)\].,:;]*|{_YEAR}(?:,{_YEAR}|[-–]{_YEAR})+[.,;:]*|{_YEAR}-(?:present|now|date)[.,]*"),
        ("ALL", r"(?i)all"), ("RIGHT", r"(?i)rights?|rechte|droits"), ("RESERVED", r"(?i)reserved[.,!)]*|vorbehalten\.?|r[ée]serv[ée]s\.?"),
        ("AUTHS", r"(?i)@?authors?[:.]?|author\(s\):?|contributors?:|maintainers?:|maintained|committers?:"),
        ("AUTH2", r"(?i)written|developed|created|contributed|authored|programmed|modified|coded|implemented|ported|rewritten|designed"),
        ("BY", r"(?i)by"), ("CC", r"(?i)and|&|,|und|et"), ("OF", r"(?i)of|for"), ("THE", r"(?i)the"), ("IN", r"(?i)in|en"), ("VAN", r"van|von|de|du|der|den|di|da|la|le|del|bin"),
        ("TO", r"(?i)to|present|now"), ("DASH", r"-+|–|—|/"), ("HOLDER", r"(?i)holders?[.,]?"), ("IS", r"(?i)is|are|was|were|be"), ("HELD", r"(?i)held|owned"),
        ("NOTICE", r"(?i)notices?[.,:]*|statements?[.,:]*|law[s]?[.,]*|licen[cs]es?[.,:]*|protection|interest|infringement|ownership|information|permission|disclaimer|line[s]?|year|owners?[.,]?|assignments?"),
        ("OTH", r"(?i)others\.?|al\."), ("PORTIONS", r"(?i)portions|parts"),
        ("COMP", r"(?i)(?:inc|ltd|llc|llp|gmbh|corp|co|ag|s\.?a|b\.?v|ab|oy|kg|plc|pty|srl|spa|limited|corporation|incorporated|company|foundation|consortium|institute|university|laboratory|laboratories|labs|group|team|project|association|society|technologies|systems|software|networks|college|council|center|centre|department)(?:\.?[.,;:)]*)"),
        ("OR", r"or"),
        ("JUNK", r"(?:[Tt]his|[Tt]hat|[Tt]hese|[Tt]hose|[Yy]our?|[Ww]e|our|its?|If|if|not|must|may|shall|will|can|any|no|as|with|without|from|at|on|[Ff]iles?|[Pp]rograms?|[Cc]ode|[Ss]ource|above|below|following|[Ss]ee|[Uu]se[ds]?|[Pp]ermission|[Ww]arranty|under|[Uu]nder|[Tt]erms|[Vv]ersion|also|each|such|other|than|which|where|when|there|here|has|have|had|been|do|does|domain|applicable|provided|[Rr]edistributions?|[Dd]ocumentation|including|retain|reproduce|[Hh]owever|[Uu]nless|[Pp]lease|[Rr]ead|[Ee]veryone|[Nn]either|nor|[Aa]dded|[Cc]hanged|[Ff]ixed|[Ll]icen[cs]ed|LICEN[CS]E[DS]?|NOTICE|PERMISSION|THE|THIS|SOFTWARE|[Dd]istributed|[Rr]eleased)[.,;:)]*"),
        ("NUM", r"[0-9][0-9.,:/x\-]*"), ("CAPS", r"[A-Z0-9&.\-]{2,}[.,;:)]*"), ("NNP", rf"[(']*{_W}(?:[/&+]{_W})*[)']*[.,;:]*"), ("SYM", r"\W+"), ("NN", r".*"),
    )
]
_SPLIT = re.compile(r"[\t =;]+")


#: Words that name people where a colon follows, and words that tell one author from others.
_PEOPLE = re.compile(r"(?i)@?(?:co-?)?(?:authors?|contributors?|maintainers?|committers?)\Z")
_WHICH_AUTHOR = frozenset("original current main principal primary initial previous former".split())


@lru_cache(100_000)
def tag_of(word: str) -> str:
    return next(t for t, p in TAGS if p.match(word))


def tokens_of(lines: list[tuple[int, str]]) -> list[Token]:
    """Tagged tokens of a run of lines. A blank line ends what stands before it, but not right after a copyright word, a
    year or "by"."""
    out: list[Token] = []
    last = ""
    for number, line in lines:
        if not line.strip():
            bare = last.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            if not (bare.startswith("copyright") or bare.endswith(("by", "copyright")) or bare[-1:].isdigit()):
                out.append(Token("\n", "EMPTY", number))
                last = ""
            continue
        last = line
        for part in _SPLIT.split(line):
            word = part.rstrip(",'") if part.endswith("',") else part
            word = word.strip("' ").rstrip(":").strip() if word not in (":",) else ""
            if word in ("", ":", "."):
                continue
            comma = word.endswith(",") and word.rstrip(",").strip()
            base = word.rstrip(",").strip() if comma else word
            out.append(Token(base, "AUTHS" if part.endswith(":") and _PEOPLE.match(base) else tag_of(base), number))
            if comma:
                out.append(Token(",", "CC", number))
    for a, b in zip(out, out[1:], strict=False):
        if b.tag == "AUTHS" and a.tag == "NNP" and a.value.lower() in _WHICH_AUTHOR:
            a.tag = "NN"
        if a.value == "its" and b.value.lower().rstrip(".,") == "contributors":
            a.tag, b.tag, a.value, b.value = "OTH", "SKIP", f"{a.value} {b.value}", ""
        if a.value == "Open" and b.value == "Source":
            b.tag = "NNP"
        camel = re.fullmatch(r"[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*", a.value) and re.search("[a-z]", a.value)
        if a.tag == "JUNK" and b.tag == "COMP" and a.line == b.line and camel and any(t.tag == "COPY" and t.line == a.line for t in out[: out.index(a)]):
            a.tag = "NNP"
    return [t for t in out if t.tag != "SKIP"]


@dataclass
class Node:
    label: str
    children: list
    start: int
    end: int

    def leaves(self) -> Iterator[tuple[Token, str]]:
        for c in self.children:
            if isinstance(c, Token):
                yield c, self.label
            else:
                yield from c.leaves()


#: Ordered rules: the first that fits anywhere reduces its leftmost fit, then all are tried anew. NL is a line's end:
#: nodes on different lines only go together where a rule says so.
GRAMMAR = [
    (label, pattern)
    for label, pattern in (
        ("RIGHTS", r"(?:ALL )?RIGHT RESERVED "),
        ("YEARS", r"YR (?:(?:CC |DASH |TO |CC DASH )*(?:NL )?(?:YR |TO ))+"), ("YEARS", r"YR "),
        ("COMPANY", r"(?:THE )?(?:NNP |CAPS )(?:(?:VAN |NNP |CAPS |COMP )*(?:NNP |CAPS |COMP ))?(?:NL (?=COMP ))?(?:CC )?COMP (?:(?:CC )?COMP )*(?:OF (?:THE )?(?:NNP |CAPS |COMP )+)?(?:AUTHS )?"),
        ("COMPANY", r"(?:THE )?COMP (?:COMP )*(?:OF |IN )(?:THE )?(?:NNP |CAPS |COMP )+(?:(?:CC )?COMP )*"),
        ("NAME", r"(?:THE )?(?:NNP |CAPS )(?:(?:VAN |NNP |CAPS |COMP )*(?:NNP |CAPS |COMP ))?(?:AUTHS |HOLDER )?"),
        ("NAME_EMAIL", r"(?:NAME |COMPANY )(?:SYM |CC )*(?:EMAIL |URL )+"),
        ("PARTIES", r"(?:NAME |COMPANY |NAME_EMAIL )(?:NL (?=CC ))?(?:CC |SYM (?=NAME_EMAIL ))+(?:NL )?(?:NAME |COMPANY |NAME_EMAIL |PARTIES |OTH |AUTHS )"),
        ("PARTIES", r"(?:NAME |COMPANY |NAME_EMAIL |PARTIES )(?:IN |DASH |OF )(?:NL )?(?:NAME |COMPANY |NAME_EMAIL |PARTIES )"),
        ("PARTIES", r"(?:PARTIES )(?:NL (?=CC ))?(?:CC )+(?:NL )?(?:NAME |COMPANY |NAME_EMAIL |OTH |AUTHS )"),
        ("PARTIES", r"NAME_EMAIL NL NAME_EMAIL (?:NL NAME_EMAIL )*"),
        ("PARTIES", r"PARTIES NL NAME (?=CC )"),
        ("COPYRIGHT", r"(?:PORTIONS )?(?:COPY )+(?:OR COPY )?(?:HOLDER |IS |HELD |BY )*(?:CC |DASH |SYM )*(?:YEARS )+(?:CC |DASH |SYM |NUM )*(?:NL )?(?:BY |OF )?(?:NL )?(?:PARTIES |NAME_EMAIL |COMPANY |NAME |EMAIL |URL )+(?:RIGHTS )?"),
        ("COPYRIGHT", r"(?:PORTIONS )?(?:COPY )+(?:OR COPY )?(?:HOLDER |IS |HELD |CC )*(?:BY |OF )?(?:SYM )*(?:NL )?(?:PARTIES |NAME_EMAIL |COMPANY |NAME |EMAIL )+(?:CC |SYM |DASH )*(?:YEARS )*(?:NL (?:NAME_EMAIL |COMPANY |NAME )(?:CC )*YEARS )*(?:RIGHTS )?"),
        ("COPYRIGHT", r"(?:PARTIES |COMPANY |NAME )(?:CC )*(?:COPY )+(?:YEARS )+"),
        ("COPYRIGHT", r"(?:COPY )+(?:YEARS )+(?:CC |BY )*(?:THE )?(?:NN )(?:NN )?(?:EMAIL )?"),
        ("COPYRIGHT", r"(?:COPY )(?:COPY )*(?:CC |SYM |DASH )*(?:YEARS )+(?:RIGHTS )?"),
        ("COPYRIGHT", r"HOLDER IS (?:PARTIES |NAME_EMAIL |COMPANY |NAME )"),
        ("AUTHOR", r"AUTHS (?:NN CC )?EMAIL (?:(?:CC |OR )EMAIL )+"), ("AUTHOR", r"AUTHS NN CC EMAIL "),
        ("AUTHOR", r"BY (?:NL )?(?:NAME_EMAIL )(?:NL NAME_EMAIL )*"), ("AUTHOR", r"BY EMAIL "),
        ("AUTHOR", r"(?:AUTH2 )?BY (?:NAME |COMPANY )(?:(?:OF |NL )(?:NAME |COMPANY ))?NL EMAIL "),
        ("AUTHOR", r"(?:AUTHS |AUTH2 (?:CC AUTH2 )*BY )(?:IS |SYM |DASH |BY )*(?:PARTIES |NAME_EMAIL |COMPANY |NAME |EMAIL )+"),
    )
]
_COMPILED = [(label, re.compile("(?:^|(?<= ))" + re.sub(r"\b([A-Z_0-9]+) ", r"(?:\1:\\d+ )", pattern))) for label, pattern in GRAMMAR]


def reduce_tokens(tokens: list[Token]) -> list:
    nodes: list = list(tokens)
    for _ in range(REDUCTIONS):
        parts, line = [], None
        for k, n in enumerate(nodes):
            if line is not None and (n.line if isinstance(n, Token) else n.start) != line:
                parts.append("NL:0 ")
            line = n.line if isinstance(n, Token) else n.end
            parts.append(f"{n.tag if isinstance(n, Token) else n.label}:{k} ")
        tags = "".join(parts)
        for label, pattern in _COMPILED:
            m = pattern.search(tags)
            if m:
                own = [int(k) for name, k in re.findall(r"(\w+):(\d+) ", m.group(0)) if name != "NL"]
                a, b = own[0], own[-1] + 1
                inner = nodes[a:b]
                start = inner[0].line if isinstance(inner[0], Token) else inner[0].start
                end = inner[-1].line if isinstance(inner[-1], Token) else inner[-1].end
                nodes[a:b] = [Node(label, inner, start, end)]
                break
        else:
            break
    return nodes


#: Statements without a year that speak of copyrights and state none.
_NO_STATEMENT = re.compile(r"(?i)copyrights? (?:holders?|owners?|notices?|laws?|restrict)\b(?!.*\bis\b)|.*\b(?:and/or|liable|any)\b|copyright:? l?gpl")
#: What follows "authors" in a disclaimer.
_NO_AUTHOR = re.compile(r"(?:OR|AS|AND|IS|BE)(?: [A-Z ]+)?\Z")
_PREFIX = re.compile(r"^(?:by|the author\b|and|of|is|are|:|,|-|\.|'|\)|held)\s+", re.I)
_DUPLICATE = re.compile(r"(?i)\bcopyright(?: copyright)+\b")


def refine(value: str) -> str:
    """Spaces before commas, doubled words, trailing signs, unpaired brackets and quotes go."""
    out = re.sub(r"\s+", " ", value).strip()
    out = re.sub(r" ,", ",", _DUPLICATE.sub("Copyright", out))
    out = re.sub(r"\s+--?\s+Licen[cs]\w*$", "", out)
    out = re.sub(r"\$(?:Id|Date|Author|Revision)[^$]*\$", "", out)
    for a, b in (("(", ")"), ("[", "]"), ("<", ">")):
        if out.count(a) > out.count(b) and not out.rstrip(" .,").endswith(a):
            out = out.replace(a, "", 1) if out.startswith(a) and not out.lower().startswith("(c)") else out
        if out.count(b) > out.count(a) and out.endswith(b):
            out = out[:-1]
    out = re.sub(r"\s*\(\s*'[^']*'?\s*\)?$", "", out).strip(" ,;:-/*'")
    if out.endswith(".") and not re.search(r"(?i)\b(?:inc|ltd|corp|co|s\.a|b\.v|llc|jr|sr|al|copr|(?<=\s)[a-z])\.$", out):
        out = out.rstrip(".")
    return out.strip(" ,;:")


def refine_holder(value: str) -> str:
    out = refine(value)
    while (m := _PREFIX.match(out)) is not None:
        out = out[m.end() :]
    return refine(re.sub(r"(?i)[,\s]+all rights reserved.*$", "", out)).strip("()<> ")


def statements(lines: list[tuple[int, str]]) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, first line, last line) of a run of lines. Headers are the same in many files, so that short runs are
    remembered with lines counted from their first."""
    base = lines[0][0] if lines else 0
    run = tuple((n - base, s) for n, s in lines)
    found = _remembered(run) if sum(len(s) for _, s in run) <= REMEMBERED_CHARS else _statements(run)
    return ((kind, value, a + base, b + base) for kind, value, a, b in found)


@lru_cache(20_000)
def _remembered(run: tuple[tuple[int, str], ...]) -> tuple[tuple[str, str, int, int], ...]:
    return tuple(_statements(run))


def _statements(lines: tuple[tuple[int, str], ...]) -> Iterator[tuple[str, str, int, int]]:
    for node in reduce_tokens(tokens_of(lines)):
        if isinstance(node, Token) or node.label not in ("COPYRIGHT", "AUTHOR"):
            continue
        leaves = [*node.leaves()]
        if node.label == "COPYRIGHT":
            body = [(t, label) for t, label in leaves if label != "RIGHTS"]
            whole = refine(re.sub(r"\(C\)", "(c)", " ".join(t.value for t, _ in body)))
            holder = refine_holder(" ".join(t.value for t, label in body if label != "YEARS" and t.tag not in ("COPY", "EMAIL", "URL", "YR", "HELD", "IS", "PORTIONS", "OR") and (t.tag != "HOLDER" or label == "NAME")))
            dated = any(t.tag == "YR" for t, _ in body)
            if not dated and _NO_STATEMENT.match(whole):
                continue
            if dated or holder:
                yield "copyright", whole, node.start, node.end
                if holder:
                    yield "holder", holder, node.start, node.end
        else:
            parts = [t.value for t, label in leaves if t.tag not in ("AUTHS", "AUTH2", "BY", "IS")]
            value = refine(" ".join(parts))
            if value and not _NO_AUTHOR.match(value):
                yield "author", value, node.start, node.end


def detect_copyrights(df: DataFrame, key: str = "path", text: str = "text", kinds: tuple[str, ...] = ("copyright", "holder", "author")) -> DataFrame:
    """key, kind, value, start_line, end_line."""
    found = candidate_lines(df, key, text).select(F.col(key).alias("k"), "line", "text_line", "next_line")
    kind = dict(found.dtypes)["k"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[int, str]]]]:
        """Runs of candidates of one text and the line after each; a run can go on in the next batch."""
        name, run, after = None, [], None
        for batch in batches:
            for k, line, own, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run and (k != name or line != run[-1][0] + 1):
                    yield name, run + ([(run[-1][0] + 1, after)] if after is not None else [])
                    run = []
                name, after = k, following
                run.append((line, own))
        if run:
            yield name, run + ([(run[-1][0] + 1, after)] if after is not None else [])

    def run(batches):
        rows: list[tuple] = []
        for name, group in runs(batches):
            rows += [(name, *s) for s in statements(group) if s[0] in kinds]
            if len(rows) >= ROWS_AT_ONCE:
                yield _found(rows, target)
                rows = []
        yield _found(rows, target)

    schema = f"k {kind}, kind string, value string, start_line int, end_line int"
    target = to_arrow_schema(_parse_datatype_string(schema))
    return found.mapInArrow(run, schema).withColumnRenamed("k", key)


def _found(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def without_shadowed(found: DataFrame, key: str = "path") -> DataFrame:
    """Drops a statement that is the beginning of a longer one of its kind on the same first line."""
    order = Window.partitionBy(key, "kind", "start_line").orderBy(F.desc(F.length("value")), "value").rowsBetween(Window.unboundedPreceding, -1)
    longer = F.collect_set("value").over(order)
    return found.withColumn("_longer", longer).where(~F.exists("_longer", lambda v: v.startswith(F.col("value")) & (v != F.col("value")))).drop("_longer")


def is_credits_file(path: Column) -> Column:
    return F.lower(tx.file_name(path)).isin(*CREDITS_NAMES)


def credits_authors(df: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, author, start_line, end_line from blocks of ``N:``, ``E:`` and ``W:`` lines between blank lines; names come
    before addresses before links. A text without such a line among the first CREDITS_LINES gives none."""
    trimmed = tx.explode_lines(df, text, key).withColumn("s", F.trim(F.regexp_replace("text_line", r"^\s+|\s+$", "")))
    entry = F.col("s").rlike("^[NEW]:")
    order = Window.partitionBy(key).orderBy("line")
    blocks = trimmed.withColumn("block", F.sum(F.when(F.col("s") == "", 1).otherwise(0)).over(order)).where(entry)
    first = F.min("line").over(Window.partitionBy(key))
    items = blocks.withColumn("_first", first).where(F.col("_first") <= CREDITS_LINES + 1).drop("_first")
    value = F.trim(F.substr("s", F.lit(3), F.length("s")))
    rank = F.when(F.col("s").startswith("N"), 0).when(F.col("s").startswith("E"), 1).otherwise(2)
    grouped = items.groupBy(key, "block").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"),
        F.array_sort(F.collect_list(F.when(value != "", F.struct(rank.alias("r"), "line", value.alias("v"))))).alias("parts"),
    )
    return grouped.where(F.size("parts") > 0).select(key, F.array_join("parts.v", " ").alias("author"), "start_line", "end_line")


def canonical(value: Column) -> Column:
    """Form in which statements are compared: no space before commas, white space collapsed."""
    out = value
    for old, new in ((". ,", ".,"), (") ,", "),"), (" ,", ",")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
