"""Ruby and the languages around it: gems, Bundler, CocoaPods, Chef."""

from __future__ import annotations

import re

from .base import dependency, first, listing, mapping, names, party, person, purl, reads, strings, text_of, yaml_of

_STRING = r"""(?:%[qQ]?[{(\[<]([^})\]>]*)[})\]>]|"((?:\\.|[^"\\])*)"|'((?:\\.|[^'\\])*)')"""
_ONE = re.compile(_STRING)


def quoted(text: str) -> list[str]:
    """String literals of a piece of code, in order."""
    return [re.sub(r"\\(.)", r"\1", next(g for g in m.groups() if g is not None)) for m in _ONE.finditer(text)]


def without_comments(text: str) -> str:
    return "\n".join(re.sub(r"""^((?:[^#"']|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')*)#(?!{).*$""", r"\1", line) for line in text.splitlines())


def _literal(code: str) -> object:
    """Value of a right-hand side: a list of words, of strings, a string, or the code itself."""
    code = code.strip()
    if m := re.match(r"%[wWiI][{(\[<]([^})\]>]*)[})\]>]", code):
        return m[1].split()
    if code.startswith("["):
        return quoted(code)
    found = quoted(re.split(r"\.(?:freeze|strip|chomp)\b|\s+(?:if|unless)\s", code)[0]) if re.match(r"%[qQ]?[{(\[]|[\"']", code) else []
    return found[0] if found else re.sub(r"\.freeze$", "", code.split(" #")[0].strip())


def _statements(text: str) -> list[str]:
    """Lines, where an open bracket or a last comma or operator goes on."""
    out, held = [], ""
    for line in without_comments(text).splitlines():
        held = f"{held} {line.strip()}" if held else line.strip()
        code = _ONE.sub("''", held)
        if code.count("[") + code.count("(") + code.count("{") > code.count("]") + code.count(")") + code.count("}") or code.endswith((",", "\\")):
            continue
        if held:
            out.append(held.rstrip("\\"))
        held = ""
    return out + [held] * bool(held)


def _gem_urls(name: str | None, version: str | None) -> dict:
    if not name:
        return {}
    tail = f"/versions/{version}" if version else ""
    file = f"https://rubygems.org/downloads/{name}-{version}.gem" if version else None
    api = f"https://rubygems.org/api/v2/rubygems/{name}/versions/{version}.json" if version else f"https://rubygems.org/api/v1/versions/{name}.json"
    return {"repository_homepage_url": f"https://rubygems.org/gems/{name}{tail}", "repository_download_url": file, "download_url": file, "api_data_url": api}


def gem_parties(authors: list[str], emails: list[str], role: str = "author") -> list[dict]:
    """One author and one address are one person; otherwise each is a party of its own."""
    if len(authors) == len(emails) == 1:
        return [party(role, authors[0], emails[0])]
    return [*(party(role, a) for a in authors), *(party(role, None, e) for e in emails)]


def _gem(need: list[str], scope: str | None, runtime: bool, extra: dict | None = None) -> dict:
    wanted = ", ".join(need[1:]) or None
    return dependency(purl("gem", need[0]), wanted, scope, runtime, not runtime, False, True, extra)


@reads("gemspec", "gem", r"\.gemspec$", "text", "Ruby", "Gem specification, read without running it")
def gemspec(path: str, text: str) -> dict:
    lines = _statements(text)
    names_of = {m[1]: _literal(m[2]) for s in lines if (m := re.match(r"([A-Za-z_][\w:]*)\s*=\s*(?!=)(.+)$", s))}
    fields: dict[str, object] = {}
    found = []
    for s in lines:
        if m := re.match(r"\w+\.add_(development_|runtime_)?dependency[\s(]+(.+)$", s):
            need = quoted(m[2])
            if need:
                found.append(_gem(need, "development" if m[1] == "development_" else "runtime", m[1] != "development_"))
        elif m := re.match(r"\w+\.(\w+)\s*=\s*(?!=)(.+)$", s):
            value = _literal(m[2])
            key = value if isinstance(value, str) else None
            fields.setdefault(m[1], names_of.get(key, names_of.get(key.rpartition("::")[2], value)) if key else value)
    name, version = text_of(fields.get("name")), text_of(fields.get("version"))
    return {
        "name": name, "version": version, "description": first(text_of(fields.get("description")), text_of(fields.get("summary"))), "homepage_url": text_of(fields.get("homepage")),
        "extracted_license_statement": " AND ".join([*strings(fields.get("license")), *strings(fields.get("licenses"))]) or None,
        "parties": gem_parties([*strings(fields.get("author")), *strings(fields.get("authors"))], strings(fields.get("email"))), "dependencies": found, **_gem_urls(name, version),
    }


@reads("gemfile", "gem", r"(?:^|/)(?:Gemfile|gems\.rb)$|\.gemfile$", "text", "Ruby", "Bundler manifest")
def gemfile(path: str, text: str) -> dict:
    found, sources, groups = [], [], []
    for s in _statements(text):
        if m := re.match(r"source[\s(]+(.+)$", s):
            sources += quoted(m[1])
        elif m := re.match(r"group[\s(]+(.+?)\)?\s+do\b", s):
            groups.append(re.findall(r":(\w+)|['\"](\w+)['\"]", m[1]))
        elif re.match(r".*\bdo\b\s*(?:\|.*\|)?$", s) or re.match(r"(?:if|unless|case)\b", s):
            groups.append(None)
        elif s == "end" and groups:
            groups.pop()
        elif m := re.match(r"gem[\s(]+(.+)$", s):
            head, *rest = re.split(r",\s*(?=:?\w+\s*(?::|=>))", m[1], maxsplit=1)
            need = quoted(head)
            if not need:
                continue
            options = {a or b: c for a, b, c in re.findall(r"(?:(\w+):|:(\w+)\s*=>)\s*['\"]([^'\"]*)['\"]", rest[0] if rest else "")}
            own = re.search(r"(?:group|groups):\s*(\[[^\]]*\]|:\w+)|:groups?\s*=>\s*(\[[^\]]*\]|:\w+)", m[1])
            inside = next((["".join(x) for x in g] for g in reversed(groups) if g), [])
            named = re.findall(r":(\w+)", own[1] or own[2]) if own else inside
            scope = named[0] if named else None
            dev = bool(named) and all(n in ("development", "test") for n in named)
            extra = {k: v for k, v in options.items() if k in ("git", "github", "path", "branch", "ref", "tag", "source", "revision")}
            if "git" in extra or "github" in extra:
                extra |= {"source_type": "GIT", "remote": extra.get("git") or f"https://github.com/{extra['github']}"}
            elif "path" in extra:
                extra["source_type"] = "PATH"
            found.append(_gem(need, scope, not dev, extra or None))
    return {"dependencies": found, "extra_data": {"sources": sources}}


@reads("gemfile_lock", "gem", r"(?:^|/)(?:Gemfile\.lock|gems\.locked)$", "text", "Ruby", "Bundler lockfile")
def gemfile_lock(path: str, text: str) -> dict:
    specs: dict[str, tuple[str, dict]] = {}
    wanted: dict[str, str | None] = {}
    platforms, bundler, section, about = [], None, "", {}
    for line in text.splitlines():
        if re.match(r"^[A-Z][A-Z ]+$", line):
            section, about = line.strip(), {}
        elif m := re.match(r"^  (remote|revision|branch|ref|tag): (.+)$", line):
            about[m[1]] = m[2]
        elif section in ("GEM", "GIT", "PATH") and (m := re.match(r"^    (\S+) \(([^)]+)\)$", line)):
            specs[m[1]] = (m[2], {"source_type": section, **about} if section != "GEM" else {})
        elif section == "DEPENDENCIES" and (m := re.match(r"^  (\S+?)!?(?: \((.+)\))?$", line)):
            wanted[m[1]] = m[2]
        elif section == "PLATFORMS" and line.strip():
            platforms.append(line.strip())
        elif section == "BUNDLED WITH" and line.strip():
            bundler = line.strip()
    local = [n for n, (_, s) in specs.items() if s.get("source_type") == "PATH"]
    name, version = (local[0], specs[local[0]][0]) if local else (None, None)
    found = []
    for n, (v, source) in specs.items():
        if n == name:
            continue
        requirement = wanted.get(n) or v
        found.append(dependency(purl("gem", n, v), requirement, "dependencies", True, False, not wanted.get(n), n in wanted, source or None))
    return {"name": name, "version": version, "dependencies": found, "extra_data": {"platforms": platforms, "bundler_version": bundler}, **_gem_urls(name, version)}


def gem_metadata(d: dict) -> dict:
    """Specification as YAML, as in a built gem."""
    version = text_of(mapping(d.get("version")).get("version")) if isinstance(d.get("version"), dict) else text_of(d.get("version"))
    name = text_of(d.get("name"))
    found = []
    for x in listing(d.get("dependencies")):
        x = mapping(x)
        parts = listing(mapping(x.get("requirement") or x.get("version_requirements")).get("requirements"))
        shown = ", ".join(f"{p[0]} {mapping(p[1]).get('version')}" for p in parts if isinstance(p, list) and len(p) == 2 and mapping(p[1]).get("version") not in (None, "0"))
        dev = str(x.get("type", "")).lstrip(":") == "development"
        found.append(dependency(purl("gem", text_of(x.get("name"))), shown or None, "development" if dev else "runtime", not dev, dev))
    return {
        "name": name, "version": version, "description": first(text_of(d.get("description")), text_of(d.get("summary"))), "homepage_url": text_of(d.get("homepage")),
        "extracted_license_statement": " AND ".join(strings(d.get("licenses") or d.get("license"))) or None, "parties": gem_parties(strings(d.get("authors")), strings(d.get("email"))),
        "dependencies": found, "file_references": [{"path": f} for f in strings(d.get("files"))], **_gem_urls(name, version),
    }


def untagged_yaml(text: str) -> dict:
    return mapping(yaml_of(re.sub(r"!(?:ruby/\S+|binary)[ \t]*", "", text)))


@reads("gem_archive_extracted", "gem", r"(?:^|/)metadata\.gz-extract(?:/metadata)?$", "text", "Ruby", "Specification of an extracted gem")
def gem_extracted(path: str, text: str) -> dict:
    return gem_metadata(untagged_yaml(text))


def _pod(name: str, version: str | None = None) -> str | None:
    base, _, sub = name.partition("/")
    return purl("cocoapods", base, version, None, None, sub or None)


@reads("cocoapods_podfile", "cocoapods", r"(?:^|/)(?:Podfile|[^/]+\.podfile)$", "text", "Objective-C", "CocoaPods Podfile")
def podfile(path: str, text: str) -> dict:
    found = []
    for s in _statements(text):
        if m := re.match(r"pod[\s(]+(.+)$", s):
            head, *rest = re.split(r",\s*:?(?=\w+\s*(?:=>|:))", m[1], maxsplit=1)
            need = quoted(head)
            if not need:
                continue
            options = dict(re.findall(r":?(\w+)\s*(?:=>|:)\s*['\"]([^'\"]*)['\"]", ":" + rest[0] if rest else ""))
            wanted = ", ".join(need[1:]) or options.get("tag") or options.get("branch") or options.get("commit") or options.get("git") or options.get("path")
            exact = bool(need[1:] and re.fullmatch(r"=?\s*\d[\w.-]*", need[1]))
            found.append(dependency(_pod(need[0], need[1].lstrip("= ") if exact else None), wanted, "dependencies", True, False, exact, True, options or None))
    return {"dependencies": found}


@reads("cocoapods_podfile_lock", "cocoapods", names("Podfile.lock"), "yaml", "Objective-C", "CocoaPods lockfile")
def podfile_lock(path: str, d: dict) -> dict:
    wanted = {m[1]: m[2] for x in strings(d.get("DEPENDENCIES")) if (m := re.match(r"(\S+)(?: \((.+)\))?", x))}
    sums, outside = mapping(d.get("SPEC CHECKSUMS")), mapping(d.get("EXTERNAL SOURCES"))
    found = []
    for item in listing(d.get("PODS")):
        head = next(iter(item)) if isinstance(item, dict) else str(item)
        m = re.match(r"(\S+)(?: \(([^)]*)\))?", head)
        if m:
            base = m[1].split("/")[0]
            found.append(dependency(_pod(m[1], m[2]), wanted.get(m[1]) or m[2], "requires" if m[1] not in wanted else "dependencies", True, False, True, m[1] in wanted, mapping(outside.get(base)) or None, {"sha1": text_of(sums.get(base))} if base in sums else None))
    return {"dependencies": found, "sha1": text_of(d.get("PODFILE CHECKSUM")), "extra_data": {"cocoapods": text_of(d.get("COCOAPODS"))}}


def _pod_urls(name: str | None, version: str | None) -> dict:
    return {"repository_homepage_url": f"https://cocoapods.org/pods/{name}"} if name else {}


@reads("cocoapods_podspec", "cocoapods", r"\.podspec$", "text", "Objective-C", "CocoaPods specification, read without running it")
def podspec(path: str, text: str) -> dict:
    fields: dict[str, str] = {}
    found, authors, source = [], [], {}
    heredoc = dict(re.findall(r"\.(\w+)\s*=\s*<<[-~]?'?DESC'?\n(.*?)\n\s*DESC\b", text, re.S))
    for s in _statements(re.sub(r"<<[-~]?'?DESC'?\n.*?\n\s*DESC\b", "''", text, flags=re.S)):
        if m := re.match(r"\w+\.(?:\w+\.)?dependency[\s(]+(.+)$", s):
            need = quoted(m[1])
            if need:
                found.append(dependency(_pod(need[0]), ", ".join(need[1:]) or None, "dependencies"))
        elif m := re.match(r"\w+\.(authors?)\s*=\s*(.+)$", s):
            pairs = re.findall(r"""["']([^"']+)["']\s*=>\s*["']([^"']+)["']""", m[2])
            authors += [party("author", a, b) for a, b in pairs] or [party("author", *person(a)[:2]) for a in quoted(m[2])]
        elif m := re.match(r"\w+\.source\s*=\s*(.+)$", s):
            source = dict(re.findall(r":?(\w+)\s*(?:=>|:)\s*[\"']([^\"']*)[\"']", m[1]))
        elif m := re.match(r"\w+\.(\w+)\s*=\s*(.+)$", s):
            got = re.search(r":type\s*=>\s*[\"']([^\"']+)|type:\s*[\"']([^\"']+)", m[2]) if m[1] == "license" else None
            value = _literal(m[2])
            fields.setdefault(m[1], (got[1] or got[2]) if got else value if isinstance(value, str) else ", ".join(value))
    name, version = fields.get("name"), fields.get("version")
    return {
        "name": name, "version": version, "description": (heredoc.get("description") or fields.get("description") or fields.get("summary") or "").strip() or None, "homepage_url": fields.get("homepage"),
        "extracted_license_statement": fields.get("license"), "parties": authors, "vcs_url": source.get("git"), "download_url": source.get("http"), "dependencies": found, **_pod_urls(name, version),
    }


@reads("cocoapods_podspec_json", "cocoapods", r"\.podspec\.json$", "json", "Objective-C", "CocoaPods specification as JSON")
def podspec_json(path: str, d: dict) -> dict:
    source, stated, people = mapping(d.get("source")), d.get("license"), d.get("authors") or d.get("author")
    listed = [party("author", k, text_of(v)) for k, v in people.items()] if isinstance(people, dict) else [party("author", *person(p)[:2]) for p in strings(people)]
    name = text_of(d.get("name"))
    found = [dependency(_pod(k), ", ".join(strings(v)) or None, "dependencies") for k, v in mapping(d.get("dependencies")).items()]
    return {
        "name": name, "version": text_of(d.get("version")), "description": first(text_of(d.get("description")), text_of(d.get("summary"))), "homepage_url": text_of(d.get("homepage")), "parties": listed,
        "extracted_license_statement": text_of(mapping(stated).get("type")) if isinstance(stated, dict) else text_of(stated), "vcs_url": text_of(source.get("git")), "download_url": text_of(source.get("http")),
        "dependencies": found, "extra_data": {"source": source}, **_pod_urls(name, None),
    }


def _cookbook(d: dict, needs: list[tuple[str, str | None]]) -> dict:
    name, version = text_of(d.get("name")), text_of(d.get("version"))
    page = f"https://supermarket.chef.io/cookbooks/{name}/versions/{version}" if name and version else None
    maintainer, mail = text_of(d.get("maintainer")), text_of(d.get("maintainer_email"))
    return {
        "name": name, "version": version, "description": first(text_of(d.get("description")), text_of(d.get("long_description"))), "extracted_license_statement": text_of(d.get("license")),
        "parties": [party("maintainer", maintainer, mail, None, None)] if maintainer or mail else [], "code_view_url": text_of(d.get("source_url")), "bug_tracking_url": text_of(d.get("issues_url")),
        "dependencies": [dependency(purl("chef", n), w, "dependencies") for n, w in needs], "download_url": page and f"{page}/download", "repository_download_url": page and f"{page}/download",
        "repository_homepage_url": page and f"{page}/", "api_data_url": page and f"https://supermarket.chef.io/api/v1/cookbooks/{name}/versions/{version}",
    }


@reads("chef_cookbook_metadata_json", "chef", names("metadata.json"), "json", "Ruby", "Chef cookbook metadata as JSON")
def chef_json(path: str, d: dict) -> dict | None:
    needs = [(k, text_of(v)) for section in ("dependencies", "depends") for k, v in sorted(mapping(d.get(section)).items())]
    return _cookbook(d, needs)


@reads("chef_cookbook_metadata_rb", "chef", names("metadata.rb"), "text", "Ruby", "Chef cookbook metadata")
def chef_rb(path: str, text: str) -> dict:
    fields, needs = {}, []
    for s in _statements(text):
        m = re.match(r"(\w+)[\s(]+(.+?)\)?$", s)
        values = quoted(m[2]) if m else []
        if values and m[1] == "depends":
            needs.append((values[0], ", ".join(values[1:]) or None))
        elif values:
            fields.setdefault(m[1], values[0])
    return _cookbook(fields, needs)


