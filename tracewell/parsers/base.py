"""What manifest readers share: the row they make, the table of readers, package URLs.

A reader is a function of (path, document) that gives one row or a list of rows, as dicts of the columns in
``PACKAGE_SCHEMA``; ``reads`` puts it into ``READERS``. The document is what ``form`` says: text, bytes, or parsed JSON,
JSON with comments, TOML, YAML or XML. A reader that fails gives one row with its type and datasource alone.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import quote

#: Content beyond this isn't read, nor are more rows, nested levels and characters of a value kept.
MOST_BYTES, MOST_ITEMS, MOST_DEPTH, MOST_CHARS = 100 << 20, 100_000, 50, 10 << 20

PARTY = "struct<type:string,role:string,name:string,email:string,url:string,organization:string,organization_url:string,timezone:string>"
DEPENDENCY = "struct<purl:string,extracted_requirement:string,scope:string,is_runtime:boolean,is_optional:boolean,is_pinned:boolean,is_direct:boolean,resolved_package:string,extra_data:string>"
PACKAGE_SCHEMA = (
    "datasource_id string, type string, namespace string, name string, version string, qualifiers map<string,string>, subpath string, purl string, "
    "primary_language string, description string, release_date string, copyright string, holder string, notice_text string, "
    "extracted_license_statement string, declared_license_expression string, declared_license_expression_spdx string, keywords array<string>, "
    "homepage_url string, download_url string, bug_tracking_url string, code_view_url string, vcs_url string, repository_homepage_url string, "
    "repository_download_url string, api_data_url string, size bigint, sha1 string, md5 string, sha256 string, sha512 string, "
    f"parties array<{PARTY}>, dependencies array<{DEPENDENCY}>, file_references array<struct<path:string,size:bigint,sha1:string,md5:string,sha256:string>>, "
    "source_packages array<string>, is_private boolean, is_virtual boolean, extra_data string, row_pos int"
)
LISTS = ("keywords", "parties", "dependencies", "file_references", "source_packages")


@dataclass(frozen=True)
class Reader:
    datasource: str
    type: str
    #: Regular expression over paths, in the subset that Java and Python share.
    paths: str
    form: str
    language: str | None
    about: str
    read: Callable


READERS: list[Reader] = []


def names(*files: str) -> str:
    """Expression for files of these names, in any directory; ``*`` stands for a part of a name."""
    return r"(?:^|/)(?:" + "|".join(re.escape(f).replace(r"\*", "[^/]*") for f in files) + r")$"


def reads(datasource: str, type: str, paths: str, form: str = "text", language: str | None = None, about: str = ""):  # noqa: A002
    def keep(read: Callable) -> Callable:
        READERS.append(Reader(datasource, type, paths, form, language, about or (read.__doc__ or "").strip(), read))
        return read

    return keep


_UNQUOTED = re.compile(r"[A-Za-z0-9:._~-]*")


def purl(type: str, name: str | None, version: str | None = None, namespace: str | None = None, qualifiers: dict | None = None, subpath: str | None = None) -> str | None:  # noqa: A002
    """Package URL; None without a name."""
    if not name or not str(name).strip():
        return None
    part = lambda s: s if _UNQUOTED.fullmatch(s := str(s)) else quote(s, safe=":.-_~")
    out = f"pkg:{type}/" + "".join(f"{part(n)}/" for n in (namespace or "").split("/") if n) + part(name)
    if version:
        out += f"@{part(version)}"
    if qualifiers:
        out += "?" + "&".join(f"{k}={quote(str(v), safe=':/.-_~')}" for k, v in sorted(qualifiers.items()) if v)
    return out + (f"#{subpath}" if subpath else "")


def dependency(url: str | None, requirement: object = None, scope: str | None = None, runtime: bool | None = True, optional: bool | None = False, pinned: bool | None = False, direct: bool | None = True, extra: dict | None = None, resolved: dict | None = None) -> dict:
    return {
        "purl": url, "extracted_requirement": None if requirement is None else str(requirement), "scope": scope, "is_runtime": runtime, "is_optional": optional,
        "is_pinned": pinned, "is_direct": direct, "resolved_package": as_json(resolved), "extra_data": as_json(extra),
    }


def party(role: str, name: str | None = None, email: str | None = None, url: str | None = None, type: str | None = "person", **more: str) -> dict:  # noqa: A002
    return {"type": type, "role": role, "name": name or None, "email": email or None, "url": url or None, **more}


def as_json(value: object) -> str | None:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str) if value else None


def first(*values: object) -> object:
    return next((v for v in values if v not in (None, "", [], {})), None)


def text_of(value: object) -> str | None:
    """A string that isn't blank, trimmed; numbers as text."""
    if isinstance(value, bool) or value is None or isinstance(value, (dict, list)):
        return None
    return str(value).strip() or None


def strings(value: object) -> list[str]:
    """Strings of a string or a list of them."""
    if isinstance(value, (list, tuple)):
        return [s for v in value if (s := text_of(v))]
    return [s] if (s := text_of(value)) else []


def mapping(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def listing(value: object) -> list:
    return value if isinstance(value, list) else []


_MAIL = re.compile(r"^\s*(.*?)\s*<\s*([^<>\s]+@[^<>\s]+)\s*>\s*(?:\((.*?)\))?\s*$")


def person(text: str) -> tuple[str | None, str | None, str | None]:
    """name, e-mail, url of ``Name <mail> (url)``."""
    m = re.match(r"^\s*([^<(]*?)\s*(?:<([^<>]*)>)?\s*(?:\(([^()]*)\))?\s*$", text or "")
    if m is None:
        return (text or "").strip() or None, None, None
    name, mail, url = (x.strip() or None if x else None for x in m.groups())
    if mail is None and name and re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", name):
        name, mail = None, name
    return name, mail, url


def sri(text: str | None) -> tuple[str, str] | None:
    """Algorithm and hex digest of a subresource-integrity string."""
    import base64
    import binascii

    m = re.match(r"(sha1|sha256|sha512|md5)-([A-Za-z0-9+/=]+)", text or "")
    if m is None:
        return None
    try:
        return m.group(1), base64.b64decode(m.group(2)).hex()
    except (binascii.Error, ValueError):
        return None


#: Identifiers of the license list and the keys of their rules.
SPDX_KEYS = dict(x.split("=") for x in (
    "0BSD=bsd-zero AFL-2.1=afl-2.1 AGPL-3.0=agpl-3.0 AGPL-3.0-only=agpl-3.0 AGPL-3.0-or-later=agpl-3.0-plus Apache-2.0=apache-2.0 Artistic-1.0=artistic-1.0 "
    "Artistic-2.0=artistic-2.0 BSD-2-Clause=bsd-simplified BSD-3-Clause=bsd-new BSL-1.0=boost-1.0 CC-BY-4.0=cc-by-4.0 CC0-1.0=cc0-1.0 CDDL-1.0=cddl-1.0 "
    "EPL-1.0=epl-1.0 EPL-2.0=epl-2.0 GPL-1.0-or-later=gpl-1.0-plus GPL-2.0=gpl-2.0 GPL-2.0-only=gpl-2.0 GPL-2.0-or-later=gpl-2.0-plus GPL-3.0=gpl-3.0 "
    "GPL-3.0-only=gpl-3.0 GPL-3.0-or-later=gpl-3.0-plus ISC=isc LGPL-2.1=lgpl-2.1 LGPL-2.1-only=lgpl-2.1 LGPL-2.1-or-later=lgpl-2.1-plus LGPL-3.0=lgpl-3.0 "
    "LGPL-3.0-only=lgpl-3.0 LGPL-3.0-or-later=lgpl-3.0-plus MIT=mit MIT-0=mit-0 MPL-2.0=mpl-2.0 MS-PL=ms-pl PSF-2.0=psf-2.0 Python-2.0=python "
    "Unlicense=unlicense WTFPL=wtfpl-2.0 Zlib=zlib"
).split())
_KEYS = {k.lower(): (v, k) for k, v in SPDX_KEYS.items()}
_ID = re.compile(r"[\w.+-]+")


def license_expression(statement: str | None) -> tuple[str | None, str | None]:
    """Expression by keys and by identifiers, where a statement is made of known identifiers alone."""
    if not statement:
        return None, None
    from ..functions import expressions as ex

    try:
        tree = ex.parse(re.sub(r"\s*/\s*", " OR ", statement.strip()))
    except ex.ExpressionError:
        return None, None
    if any(k not in _KEYS for k in ex.keys(tree)):
        return None, None
    change = lambda s, n: _ID.sub(lambda m: m[0] if m[0] in ("AND", "OR", "WITH") else _KEYS[m[0].lower()][n], s)
    shown = ex.render(tree)
    return change(shown, 0), change(shown, 1)


def xml_root(content: bytes) -> ET.Element:
    """Root with namespaces taken off. Entities aren't expanded."""
    if b"<!ENTITY" in content[:4096]:
        raise ValueError("entities are not read")
    root = ET.fromstring(content)
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def child_text(e: ET.Element | None, *tags: str) -> str | None:
    for t in tags:
        e = None if e is None else e.find(t)
    return None if e is None or e.text is None else e.text.strip() or None


_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def relaxed_json(text: str) -> object:
    """JSON with comments, trailing commas, single quotes and bare keys."""
    bare = _COMMENT.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)
    try:
        return json.loads(bare)
    except json.JSONDecodeError:
        pass
    parts = re.split(r'("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')', bare)
    for k, p in enumerate(parts):
        if k % 2:
            parts[k] = json.dumps(p[1:-1].replace("\\'", "'")) if p[0] == "'" else p
        else:
            parts[k] = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', p)
    joined = "".join(parts)
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", joined))


def decoded(content: bytes) -> str:
    return content.decode("utf-8", "replace").removeprefix("\ufeff")


def yaml_of(text: str) -> object:
    import yaml

    class Plain(yaml.SafeLoader):
        """Dates and versions stay text."""

    Plain.yaml_implicit_resolvers = {
        k: [(tag, regexp) for tag, regexp in v if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:float", "tag:yaml.org,2002:int")]
        for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    return yaml.load(text, Loader=Plain)


FORMS: dict[str, Callable[[bytes], object]] = {
    "none": lambda c: None,
    "bytes": lambda c: c,
    "text": decoded,
    "json": lambda c: json.loads(decoded(c)),
    "jsonc": lambda c: relaxed_json(decoded(c)),
    "toml": lambda c: tomllib.loads(decoded(c)),
    "yaml": lambda c: yaml_of(decoded(c)),
    "xml": xml_root,
}


def bounded(value: object, depth: int = 0) -> object:
    """A value cut to the limits."""
    if depth > MOST_DEPTH:
        return None
    if isinstance(value, str):
        return value[:MOST_CHARS]
    if isinstance(value, dict):
        if depth < MOST_DEPTH:  # what is short or has no parts stays as it is
            return {k: v if v is None or v is True or v is False or (v.__class__ is str and len(v) <= MOST_CHARS) else bounded(v, depth + 1) for k, v in value.items()}
        return {k: bounded(v, depth + 1) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [bounded(v, depth + 1) for v in value[:MOST_ITEMS]]
    return value


def rows_of(reader: Reader, path: str, content: bytes | None) -> list[dict]:
    """The reader's rows with type, datasource, package URL and license expression filled in."""
    try:
        if content is None and reader.form != "none":
            raise ValueError("no content")
        found = reader.read(path, FORMS[reader.form](content))
        found = found if isinstance(found, list) else [found]
    except Exception:  # noqa: BLE001  a manifest is anyone's text: whatever is wrong with it, the row says what it is
        found = [{"primary_language": None}]
    return [_filled(reader, r, k) for k, r in enumerate(r for r in found[:MOST_ITEMS] if r is not None)]


def _filled(reader: Reader, row: dict, place: int) -> dict:
    row = {"type": reader.type, "datasource_id": reader.datasource, "primary_language": reader.language, "is_private": False, "is_virtual": False, **row, "row_pos": place}
    if "purl" not in row:
        row["purl"] = purl(row["type"], row.get("name"), row.get("version"), row.get("namespace"), row.get("qualifiers"))
    if "declared_license_expression" not in row:
        row["declared_license_expression"], row["declared_license_expression_spdx"] = license_expression(row.get("extracted_license_statement"))
    if not isinstance(row.get("extra_data"), (str, type(None))):
        row["extra_data"] = as_json({k: v for k, v in row["extra_data"].items() if v not in (None, "", [], {})})
    for k in LISTS:
        row[k] = [bounded(v) for v in held] if (held := row.get(k)) else []
    for k, v in row.items():
        if isinstance(v, str) and len(v) > MOST_CHARS:
            row[k] = v[:MOST_CHARS]
    return row


def logical_lines(text: str, comment: str = "#") -> Iterable[str]:
    """Lines joined over a backslash at their end, without those that are comments."""
    held = ""
    for line in text.splitlines():
        s = line.rstrip()
        if not held and (not s.strip() or s.lstrip().startswith(comment)):
            continue
        if s.endswith("\\") and not s.endswith("\\\\"):
            held += s[:-1].strip() + " "
            continue
        yield (held + s.strip()).strip()
        held = ""
    if held.strip():
        yield held.strip()


def stanzas(text: str, sign: str = ":") -> list[dict[str, str]]:
    """Paragraphs of ``Key: value`` fields, where an indented line goes on with the field before it. Keys are lower-cased."""
    out: list[dict[str, str]] = []
    now: dict[str, str] = {}
    key = None
    for line in [*text.splitlines(), ""]:
        if not line.strip():
            if now:
                out.append(now)
            now, key = {}, None
        elif line[0] in " \t" and key:
            now[key] += "\n" + line.strip()
        elif sign in line and not line.startswith("#"):
            k, _, v = line.partition(sign)
            key = k.strip().lower()
            now[key] = v.strip()
    return out
