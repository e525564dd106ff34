"""HTML pages and custom templates.

Table rows are made where the findings are; a page's lines are ordered like any document's. Templates are filled on the
driver, with sections that are limited to TEMPLATE_ROWS rows each: more raise an error, as a page of that size is of no use.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import document, escape_xml, fixed, of_rows, write_file
from .report import TOOL, Report, as_json

TEMPLATE_ROWS = 100_000
#: Heading, column with the findings, fields shown after the path.
_TABLES = (
    ("Copyrights", "copyrights", ("start_line", "end_line", "copyright")), ("Holders", "holders", ("start_line", "end_line", "holder")), ("Authors", "authors", ("start_line", "end_line", "author")),
    ("E-mails", "emails", ("start_line", "end_line", "email")), ("URLs", "urls", ("start_line", "end_line", "url")), ("Licenses", "license_detections", ("start_line", "end_line", "license_expression")),
    ("Packages", "package_data", ("type", "name", "version", "purl")),
)


def html_report(report: Report, title: str = "Scan results") -> DataFrame:
    """One page with a table for files and one for each kind of finding."""
    spark, files = report.spark, report.files
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(escape_xml(c.cast("string")), F.lit("")), F.lit("</td>"))
    row = lambda cells: F.concat(F.lit("<tr>"), *[cell(c) for c in cells], F.lit("</tr>"))
    parts = [fixed(spark, 0, "<!DOCTYPE html>", f'<html><head><meta charset="utf-8"><title>{title}</title></head><body>', f"<h1>{title}</h1>")]
    shown = [c for c in ("path", "type", "name", "extension", "size", "sha1", "mime_type", "programming_language") if c in files.columns]
    tables = [("Files", shown, files.select(*shown))]
    for heading, column, fields in _TABLES:
        if column in files.columns:
            found = files.select("path", F.inline(column))
            own = [f for f in fields if f in found.columns]
            tables.append((heading, ["path", *own], found.select("path", *own)))
    at = 10
    for heading, columns, rows in tables:
        parts += [
            fixed(spark, at, f"<h2>{heading}</h2>", "<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>"),
            of_rows(rows, at + 1, F.concat_ws("\u0001", F.col("path"), *[F.lpad(F.col(c).cast("string"), 9, "0") for c in columns if c == "start_line"]), row([F.col(c) for c in columns])), fixed(spark, at + 2, "</tbody></table>"),
        ]
        at += 10
    return document(*parts, fixed(spark, at, "</body></html>"))


def _limited(df: DataFrame | None) -> list[dict]:
    if df is None:
        return []
    rows = df.select(as_json(df, nulls=True)).limit(TEMPLATE_ROWS + 1).collect()
    if len(rows) > TEMPLATE_ROWS:
        raise ValueError(f"a page shows at most {TEMPLATE_ROWS} rows of a section")
    return [json.loads(r[0]) for r in rows]


APP_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>TITLE</title><script src="assets/data.js"></script></head>
<body><h1>TITLE</h1>
<p><select id="section"></select> <input id="filter" placeholder="filter"> <span id="count"></span></p>
<table id="rows"></table>
<script>
const section = document.getElementById("section"), filter = document.getElementById("filter");
for (const name of Object.keys(data)) section.add(new Option(name));
function show() {
  const wanted = filter.value.toLowerCase(), all = data[section.value];
  const rows = all.filter(r => JSON.stringify(r).toLowerCase().includes(wanted));
  const table = document.getElementById("rows");
  table.textContent = "";
  document.getElementById("count").textContent = rows.length + " of " + all.length;
  for (const r of rows) {
    const line = table.insertRow();
    for (const [k, v] of Object.entries(r)) {
      if (v === null || (Array.isArray(v) && !v.length)) continue;
      line.insertCell().textContent = k + ": " + (typeof v === "object" ? JSON.stringify(v) : v);
    }
  }
}
section.onchange = filter.oninput = show;
show();
</script></body></html>
"""


def html_app(report: Report, folder: str) -> None:
    """``index.html``, which shows ``assets/data.js`` with a filter. Both are written through the store's own interface, so
    that any store will do; their size is bounded by TEMPLATE_ROWS."""
    spark = report.spark
    page = APP_PAGE.replace("TITLE", TOOL)
    data = "data = " + json.dumps({"files": _limited(report.files.orderBy("path")), "packages": _limited(report.packages), "dependencies": _limited(report.dependencies)}, ensure_ascii=False)
    for name, text in (("index.html", page), ("assets/data.js", data)):
        write_file(spark, f"{folder.rstrip('/')}/{name}", text)


_TAG = re.compile(r"\{%\s*(for\s+(\w+)\s+in\s+([\w.]+)|endfor|if\s+([\w.]+)|endif)\s*%\}|\{\{\s*([\w.]+)\s*(?:\|\s*(\w+)\s*)?\}\}|\{#.*?#\}", re.S)


def custom_template(report: Report, template: str) -> str:
    """A template with ``{{ value }}``, ``{{ value | safe }}``, ``{% for x in list %}`` and ``{% if value %}`` over
    headers, files, packages, dependencies and license_detections."""
    values = {
        "headers": _limited(report.header_frame()), "files": _limited(report.files.orderBy("path")), "packages": _limited(report.packages), "dependencies": _limited(report.dependencies),
        "license_detections": _limited(report.license_detections),
    }
    values["output"] = dict(values)
    return render(template, values)


def render(template: str, values: dict) -> str:
    """Fills a template; missing values are empty, and text is escaped unless it is marked safe."""
    tokens, at = [], 0
    for m in _TAG.finditer(template):
        tokens += [template[at : m.start()], m]
        at = m.end()
    tokens.append(template[at:])

    def look(path: str, scope: dict) -> object:
        value: object = scope
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) else value[int(name)] if isinstance(value, list) and name.isdigit() and int(name) < len(value) else None
        return value

    def walk(k: int, scope: dict, show: bool) -> tuple[str, int]:
        out = []
        while k < len(tokens):
            t = tokens[k]
            if isinstance(t, str):
                out.append(t if show else "")
            elif t[1] in ("endfor", "endif"):
                return "".join(out), k
            elif t[2]:
                items, end = look(t[3], scope) if show else [], k
                for item in items or []:
                    text, end = walk(k + 1, {**scope, t[2]: item}, True)
                    out.append(text)
                if end == k:
                    _, end = walk(k + 1, scope, False)
                k = end
            elif t[4]:
                text, k = walk(k + 1, scope, show and bool(look(t[4], scope)))
                out.append(text)
            elif t[5] and show:
                value = look(t[5], scope)
                text = "" if value is None else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)
                if t[6] != "safe":
                    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
                        text = text.replace(sign, entity)
                out.append(text)
            k += 1
        return "".join(out), k

    return walk(0, values, True)[0]
