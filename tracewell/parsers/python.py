"""Python: pyproject, setup.cfg, setup.py, metadata, requirements, Pipenv, Poetry, uv, PEP 751, pip inspect; Conda, Pixi."""

from __future__ import annotations

import ast
import configparser
import re
from email import message_from_string

from .base import child_text, decoded, dependency, first, listing, mapping, names, party, person, purl, reads, strings, text_of  # noqa: F401


_SEPARATORS = re.compile(r"[-_.]+")


def normal(name: str) -> str:
    return _SEPARATORS.sub("-", name).lower().strip()


def pypi(name: str | None, version: str | None = None) -> str | None:
    return purl("pypi", normal(name), version) if name else None


def _urls(name: str | None, version: str | None) -> dict:
    if not name:
        return {}
    tail = f"/{version}" if version else ""
    return {
        "repository_homepage_url": f"https://pypi.org/project/{name}{tail}",
        "repository_download_url": f"https://pypi.org/packages/source/{name[0]}/{name}/{name}-{version}.tar.gz" if version else None,
        "api_data_url": f"https://pypi.org/pypi/{name}{tail}/json",
    }


_NEED = re.compile(r"^\s*([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)\s*(?:\[([^\]]*)\])?\s*(.*)$", re.S)
_URL_MARKER = re.compile(r"@\s*\S*;")
_COMPARED = re.compile(r"(?:===|==|~=|!=|<=|>=|<|>)")
_PINNED = re.compile(r"={2,3}\s*([^,*\s]+)")


def pep508(text: str) -> dict | None:
    """name, extras, specifiers, marker, url of a requirement; None for what is none."""
    whole, _, marker = text.partition(" ;" if "@" in text and _URL_MARKER.search(text) else ";")
    m = _NEED.match(whole)
    if m is None:
        return None
    rest = m[3].strip()
    url = rest[1:].strip() if rest.startswith("@") else None
    specifiers = None if url else rest.strip("()").strip().replace(" ", "") or None
    if specifiers and not _COMPARED.match(specifiers):
        return None
    return {"name": m[1], "extras": [x.strip() for x in (m[2] or "").split(",") if x.strip()], "specifiers": specifiers, "marker": marker.strip() or None, "url": url}


def _exact(specifiers: str | None) -> str | None:
    m = _PINNED.fullmatch(specifiers or "")
    return m[1] if m else None


def need(text: str, scope: str | None = None, runtime: bool = True, optional: bool = False) -> dict | None:
    r = pep508(text)
    if r is None:
        return None
    version = _exact(r["specifiers"])
    extra = {k: r[k] for k in ("extras", "marker", "url") if r[k]}
    return dependency(pypi(r["name"], version), r["specifiers"], scope, runtime, optional, version is not None, True, extra)


def needs(items: object, scope: str | None = None, runtime: bool = True, optional: bool = False) -> list[dict]:
    return [d for t in strings(items) if (d := need(t, scope, runtime, optional)) is not None]


def _people(value: object, role: str) -> list[dict]:
    out = []
    for x in value if isinstance(value, list) else [value]:
        name, mail = (text_of(x.get("name")), text_of(x.get("email"))) if isinstance(x, dict) else person(x)[:2] if isinstance(x, str) else (None, None)
        if name or mail:
            out.append(party(role, name, mail))
    return out


_URL_FIELDS = (("homepage_url", ("homepage", "home", "home-page")), ("bug_tracking_url", ("issues", "bug tracker", "bugs", "tracker", "bug reports", "issue tracker")), ("vcs_url", ("repository", "source", "source code", "code", "github")), ("code_view_url", ("code view",)))


def _links(pairs: dict) -> dict:
    low = {k.lower(): v for k, v in pairs.items()}
    return {field: text_of(first(*(low.get(k) for k in keys))) for field, keys in _URL_FIELDS}


def _poetry_needs(table: dict, scope: str, runtime: bool, optional: bool = False) -> list[dict]:
    out = []
    for dep, spec in table.items():
        if dep.lower() == "python":
            continue
        wanted = text_of(spec.get("version")) if isinstance(spec, dict) else text_of(spec)
        extra = {k: v for k, v in mapping(spec).items() if k != "version"}
        out.append(dependency(pypi(dep), wanted, scope, runtime, optional or mapping(spec).get("optional") is True, bool(re.fullmatch(r"={0,2}\d[\w.]*", wanted or "") and wanted.startswith("=")), True, extra))
    return out


@reads("pypi_pyproject_toml", "pypi", names("pyproject.toml"), "toml", "Python", "Python project manifest")
def pyproject(path: str, d: dict) -> dict:
    project, poetry = mapping(d.get("project")), mapping(mapping(d.get("tool")).get("poetry"))
    name, version = first(text_of(project.get("name")), text_of(poetry.get("name"))), first(text_of(project.get("version")), text_of(poetry.get("version")))
    found = needs(project.get("dependencies"))
    for extra, items in mapping(project.get("optional-dependencies")).items():
        found += needs(items, extra, True, True)
    for group, items in mapping(d.get("dependency-groups")).items():
        found += needs([x for x in listing(items) if isinstance(x, str)], group, False, True)
    found += _poetry_needs(mapping(poetry.get("dependencies")), "dependencies", True)
    found += _poetry_needs(mapping(poetry.get("dev-dependencies")), "dev-dependencies", False, True)
    for group, g in mapping(poetry.get("group")).items():
        found += _poetry_needs(mapping(mapping(g).get("dependencies")), group, False, True)
    found += needs(mapping(d.get("build-system")).get("requires"), "build", False)
    stated = project.get("license")
    license_text = first(text_of(stated), text_of(mapping(stated).get("text")), text_of(mapping(stated).get("file")), text_of(poetry.get("license")))
    links = {**{k: v for k, v in poetry.items() if k in ("homepage", "repository")}, **mapping(poetry.get("urls")), **mapping(project.get("urls"))}
    return {
        "name": normal(name) if name else None, "version": version, "description": first(text_of(project.get("description")), text_of(poetry.get("description"))),
        "keywords": strings(first(project.get("keywords"), poetry.get("keywords"))), "extracted_license_statement": license_text, **_links(links),
        "parties": [*_people(project.get("authors"), "author"), *_people(poetry.get("authors"), "author"), *_people(project.get("maintainers"), "maintainer"), *_people(poetry.get("maintainers"), "maintainer")],
        "dependencies": found, "extra_data": {"python_requires": text_of(project.get("requires-python")), "classifiers": strings(first(project.get("classifiers"), poetry.get("classifiers")))}, **_urls(name, version),
    }


@reads("pypi_setup_cfg", "pypi", names("setup.cfg"), "text", "Python", "Setuptools configuration")
def setup_cfg(path: str, text: str) -> dict:
    c = configparser.RawConfigParser(strict=False)
    c.read_string(text)
    get = lambda k, s="metadata": c.get(s, k, fallback=None) or c.get(s, k.replace("_", "-"), fallback=None)
    many = lambda s: [x.strip() for x in (s or "").splitlines() if x.strip() and not x.strip().startswith("#")]
    found = needs(many(get("install_requires", "options"))) + needs(many(get("setup_requires", "options")), "setup", False) + needs(many(get("tests_require", "options")), "tests", False, True)
    if c.has_section("options.extras_require"):
        for extra, items in c.items("options.extras_require"):
            found += needs(many(items), extra, True, True)
    links = dict(x.split("=", 1) for x in many(get("project_urls")) if "=" in x)
    name, version = get("name"), get("version")
    out = _links({k.strip(): v.strip() for k, v in links.items()})
    return {
        **out, "name": name, "version": None if (version or "").startswith(("attr:", "file:")) else version, "description": get("description") or get("summary"), "homepage_url": get("url") or get("home_page") or out["homepage_url"],
        "extracted_license_statement": get("license"), "keywords": [k.strip() for k in re.split(r"[,\n]", get("keywords") or "") if k.strip()], "dependencies": found,
        "parties": [party(role, get(role), get(f"{role}_email")) for role in ("author", "maintainer") if get(role) or get(f"{role}_email")],
        "extra_data": {"python_requires": get("python_requires", "options")}, **_urls(name, version),
    }


class _Literals(ast.NodeVisitor):
    """Values of a module that can be read without running it."""

    def __init__(self) -> None:
        self.names: dict[str, object] = {}
        self.call: ast.Call | None = None

    def value(self, node: ast.AST | None) -> object:
        if isinstance(node, ast.Name):
            return self.names.get(node.id)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            a, b = self.value(node.left), self.value(node.right)
            return a + b if type(a) is type(b) and isinstance(a, (str, list)) else None
        if isinstance(node, (ast.List, ast.Tuple)):
            return [self.value(x) for x in node.elts]
        if isinstance(node, ast.Dict):
            return {self.value(k): self.value(v) for k, v in zip(node.keys, node.values, strict=True) if isinstance(k, ast.Constant)}
        if isinstance(node, ast.JoinedStr):
            parts = [self.value(v.value) if isinstance(v, ast.FormattedValue) else v.value for v in node.values if isinstance(v, (ast.FormattedValue, ast.Constant))]
            return "".join(map(str, parts)) if all(isinstance(p, str) for p in parts) else None
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "dict":
            return {k.arg: self.value(k.value) for k in node.keywords if k.arg}
        return node.value if isinstance(node, ast.Constant) else None

    def visit_Assign(self, node: ast.Assign) -> None:  # noqa: N802
        for target in node.targets:
            if isinstance(target, ast.Name):
                self.names[target.id] = self.value(node.value)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        called = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
        if called == "setup" and self.call is None:
            self.call = node
        self.generic_visit(node)


def literals(text: str) -> _Literals:
    seen = _Literals()
    seen.visit(ast.parse(text))
    return seen


@reads("pypi_setup_py", "pypi", names("setup.py", "*_setup.py"), "text", "Python", "Setuptools script, read without running it")
def setup_py(path: str, text: str) -> dict:
    seen = literals(text)
    if seen.call is None:
        return {}
    a: dict = {}
    for k in seen.call.keywords:
        if k.arg is None:
            a |= mapping(seen.value(k.value))
        else:
            a[k.arg] = seen.value(k.value)
    name, version = text_of(a.get("name")), first(text_of(a.get("version")), text_of(seen.names.get("__version__")) if "version" in a else None)
    found = needs(a.get("install_requires")) + needs(a.get("tests_require"), "tests", False, True) + needs(a.get("setup_requires"), "setup", False)
    for extra, items in mapping(a.get("extras_require")).items():
        found += needs(items, text_of(extra), True, True)
    keywords = a.get("keywords")
    links = _links(mapping(a.get("project_urls")))
    return {
        **links, "name": name, "version": version, "description": first(text_of(a.get("description")), text_of(a.get("summary"))), "homepage_url": first(text_of(a.get("url")), links["homepage_url"]), "download_url": text_of(a.get("download_url")),
        "extracted_license_statement": text_of(a.get("license")), "keywords": strings(keywords) if isinstance(keywords, list) else [x.strip() for x in re.split(r"[,\s]+", keywords or "") if x.strip()],
        "parties": [party(role, text_of(a.get(role)), text_of(a.get(f"{role}_email"))) for role in ("author", "maintainer") if text_of(a.get(role)) or text_of(a.get(f"{role}_email"))],
        "dependencies": found, "extra_data": {"python_requires": text_of(a.get("python_requires")), "classifiers": strings(a.get("classifiers"))}, **_urls(name, version),
    }


def core_metadata(text: str) -> dict:
    m = message_from_string(text)
    many = lambda k: [v.strip() for v in m.get_all(k) or [] if v.strip() and v.strip() != "UNKNOWN"]
    one = lambda k: first(*many(k))
    name, version = one("Name"), one("Version")
    found = []
    for item in many("Requires-Dist"):
        extra = re.search(r"extra\s*==\s*['\"]([^'\"]+)", item)
        if (d := need(item, extra[1] if extra else None, True, bool(extra))) is not None:
            found.append(d)
    links = _links(dict(x.split(", ", 1) for x in many("Project-URL") if ", " in x))
    licenses = [c.rpartition(" :: ")[2] for c in many("Classifier") if c.startswith("License ::")]
    keywords = one("Keywords")
    return {
        **links, "name": name, "version": version, "description": one("Summary"), "homepage_url": first(one("Home-page"), links["homepage_url"]), "download_url": one("Download-URL"),
        "extracted_license_statement": first(one("License-Expression"), one("License"), ", ".join(licenses)), "keywords": [k.strip() for k in re.split(r"[,\s]+", keywords or "") if k.strip()],
        "parties": [party(role.lower(), one(role), one(f"{role}-email")) for role in ("Author", "Maintainer") if one(role) or one(f"{role}-email")],
        "dependencies": found, "file_references": [{"path": x} for x in many("License-File")], "extra_data": {"python_requires": one("Requires-Python"), "classifiers": many("Classifier")}, **_urls(name, version),
    }


@reads("pypi_wheel_metadata", "pypi", r"\.dist-info/METADATA$", "text", "Python", "Metadata of an installed package")
def wheel_metadata(path: str, text: str) -> dict:
    return core_metadata(text)


@reads("pypi_sdist_pkginfo", "pypi", names("PKG-INFO"), "text", "Python", "Metadata of a source distribution")
def pkg_info(path: str, text: str) -> dict:
    return core_metadata(text)


@reads("pypi_json", "pypi", names("pypi.json"), "json", "Python", "Answer of the index's JSON service")
def pypi_json(path: str, d: dict) -> dict:
    info = mapping(d.get("info"))
    name, version = text_of(info.get("name")), text_of(info.get("version"))
    files = [u for u in listing(d.get("urls")) if isinstance(u, dict)]
    source = first(*(u for u in files if u.get("packagetype") == "sdist"), *files) or {}
    return {
        "name": name, "version": version, "description": text_of(info.get("summary")), "homepage_url": text_of(info.get("home_page")), "extracted_license_statement": text_of(info.get("license")),
        "download_url": text_of(source.get("url")), "sha256": mapping(source.get("digests")).get("sha256"), "md5": mapping(source.get("digests")).get("md5"), "dependencies": needs(info.get("requires_dist")),
        "parties": [party(r, text_of(info.get(r)), text_of(info.get(f"{r}_email"))) for r in ("author", "maintainer") if text_of(info.get(r))], **_urls(name, version),
    }


@reads("pypi_pip_origin_json", "pypi", names("origin.json"), "json", "Python", "Origin of a cached wheel")
def pip_origin(path: str, d: dict) -> dict:
    url = text_of(d.get("url")) or ""
    m = re.search(r"/([^/]+?)-(\d[^/-]*)(?:-[^/]*\.whl|\.tar\.gz|\.zip)$", url)
    hashes = mapping(mapping(d.get("archive_info")).get("hashes"))
    return {"name": normal(m[1]) if m else None, "version": m[2] if m else None, "download_url": url or None, "sha256": hashes.get("sha256")}


_REMARK = re.compile(r"(?:^|\s)#.*$")
_OPTION = re.compile(r"^(-r|--requirement|-c|--constraint|-i|--index-url|--extra-index-url|-f|--find-links)[ =]\s*(\S+)")
_EDITABLE = re.compile(r"^(?:-e|--editable)[ =]\s*(.+)")
_HASH = re.compile(r"--hash[= ](\S+)")
_FLAG = re.compile(r"\s--\S+(?:[= ]\S+)?")
_EGG = re.compile(r"#egg=([\w.-]+)")
_LINK = re.compile(r"(?:git|hg|svn|bzr)\+|https?://|file:|\.{0,2}/")
#: A name, or one with one plain version, and perhaps a comment: what most lines are.
_PLAIN = re.compile(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:(===?|~=|!=|<=|>=|<|>) *([A-Za-z0-9.]+))?\s*(?:\s#.*)?")


@reads("pip_requirements", "pypi", r"(?:^|/)[^/]*requirements?[^/]*\.(?:txt|in|pip)$|(?:^|/)requirements/[^/]*\.(?:txt|in)$|(?:^|/)requires\.txt$", "text", "Python", "Requirements file")
def requirements(path: str, text: str) -> dict:
    low = path.lower()
    scope = "develop" if "dev" in low else "test" if "test" in low else "docs" if "doc" in low else "install"
    runtime, found, extra = scope == "install", [], {}
    for line in text.replace("\\\n", " ").splitlines():
        if plain := _PLAIN.fullmatch(line):
            name, sign, version = plain.groups()
            pinned = sign in ("==", "===")
            url = f"pkg:pypi/{normal(name)}"
            found.append(dependency(f"{url}@{version}" if pinned else url, sign and sign + version, scope, runtime, not runtime, pinned, True))
            continue
        bare = (_REMARK.sub("", line) if "#" in line else line).strip()
        dashed = bare.startswith("-")
        option = _OPTION.match(bare) if dashed else None
        if option:
            key = {"-r": "requirements_includes", "--requirement": "requirements_includes", "-c": "constraints", "--constraint": "constraints"}.get(option[1], "indexes")
            extra.setdefault(key, []).append(option[2])
            continue
        editable = _EDITABLE.match(bare) if dashed else None
        bare = editable[1] if editable else bare
        if not bare or bare.startswith("-"):
            continue
        more = {"is_editable": True} if editable else {}
        if "--" in bare:
            if hashes := _HASH.findall(bare):
                more["hash_options"] = hashes
            bare = _FLAG.sub("", bare)
        bare = bare.strip()
        if _LINK.match(bare):
            egg = _EGG.search(bare)
            found.append(dependency(pypi(egg[1]) if egg else None, bare, scope, runtime, not runtime, False, True, {**more, "link": bare}))
        elif (r := pep508(bare)) is not None:
            version = _exact(r["specifiers"])
            found.append(dependency(pypi(r["name"], version), bare if r["url"] else r["specifiers"], scope, runtime, not runtime, version is not None, True, {**more, **{k: r[k] for k in ("extras", "marker") if r[k]}}))
    return {"dependencies": found, "extra_data": extra, "purl": None}


@reads("pipfile_lock", "pypi", names("Pipfile.lock"), "json", "Python", "Pipenv lockfile")
def pipfile_lock(path: str, d: dict) -> dict:
    found = []
    for section, scope, runtime in (("default", "install", True), ("develop", "develop", False)):
        for name, entry in sorted(mapping(d.get(section)).items()):
            wanted = entry if isinstance(entry, str) else mapping(entry).get("version")
            if isinstance(wanted, str):
                m = re.match(r"\s*==\s*(\S+)", wanted)
                found.append(dependency(pypi(name, m[1] if m else None), wanted, scope, runtime, False, True))
    return {"sha256": mapping(mapping(d.get("_meta")).get("hash")).get("sha256"), "dependencies": found}


@reads("pipfile", "pypi", names("Pipfile"), "toml", "Python", "Pipenv manifest")
def pipfile(path: str, d: dict) -> dict:
    found = []
    for section, scope, runtime in (("packages", "install", True), ("dev-packages", "develop", False)):
        for name, spec in mapping(d.get(section)).items():
            wanted = spec if isinstance(spec, str) else "*" if spec is True else mapping(spec).get("version")
            if isinstance(wanted, str):
                found.append(dependency(pypi(name), wanted, scope, runtime))
    return {"dependencies": found, "extra_data": {"sources": d.get("source"), "python_version": mapping(d.get("requires")).get("python_version")}}


def _first_sha256(files: object) -> str | None:
    return next((h[7:] for f in listing(files) if isinstance(h := mapping(f).get("hash"), str) and h.startswith("sha256:")), None)


@reads("pypi_poetry_lock", "pypi", names("poetry.lock"), "toml", "Python", "Poetry lockfile")
def poetry_lock(path: str, d: dict) -> dict:
    found = []
    for p in listing(d.get("package")):
        name, version = text_of(p.get("name")), text_of(p.get("version"))
        if not name or not version:
            continue
        inner = [dependency(pypi(k), text_of(v) or text_of(mapping(v).get("version")), "dependencies") for k, v in mapping(p.get("dependencies")).items()]
        for extra, items in mapping(p.get("extras")).items():
            inner += [dependency(pypi(re.split(r"[\s(\[<>=!~;]", t)[0]), t, extra, False) for t in strings(items)]
        resolved = {"type": "pypi", "name": normal(name), "version": version, "sha256": _first_sha256(p.get("files")), "dependencies": inner, "purl": pypi(name, version)}
        optional = p.get("optional") is True
        found.append(dependency(pypi(name, version), None, None, not optional, optional, True, False, None, resolved))
    meta = mapping(d.get("metadata"))
    return {"dependencies": found, "extra_data": {"python_version": text_of(meta.get("python-versions")), "lock_version": text_of(meta.get("lock-version"))}}


@reads("pypi_uv_lock", "pypi", names("uv.lock"), "toml", "Python", "uv lockfile")
def uv_lock(path: str, d: dict) -> dict:
    packages = [p for p in listing(d.get("package")) if isinstance(p, dict)]
    root = first(*(p for p in packages if {"virtual", "editable"} & set(mapping(p.get("source"))))) or {}
    own = {mapping(x).get("name") for x in listing(root.get("dependencies"))}
    dev = {mapping(x).get("name") for items in mapping(root.get("dev-dependencies")).values() for x in listing(items)}
    optional = {mapping(x).get("name") for items in mapping(root.get("optional-dependencies")).values() for x in listing(items)}
    found = []
    for p in packages:
        if p is root:
            continue
        name, version = text_of(p.get("name")), text_of(p.get("version"))
        is_dev = name in dev and name not in own
        found.append(dependency(pypi(name, version), version, "dev" if is_dev else None, not is_dev, name in optional or is_dev, True, name in own | dev | optional, {"source": p.get("source")}))
    return {"name": text_of(root.get("name")), "version": text_of(root.get("version")), "dependencies": found, "extra_data": {"python_requires": text_of(d.get("requires-python")), "lock_version": text_of(d.get("version"))}}


@reads("pypi_pylock_toml", "pypi", r"(?:^|/)pylock(?:\.[^/]+)?\.toml$", "toml", "Python", "PEP 751 lockfile")
def pylock(path: str, d: dict) -> dict:
    packages = [p for p in listing(d.get("packages")) if isinstance(p, dict)]
    needed = {mapping(x).get("name") for p in packages for x in listing(p.get("dependencies"))}
    found = []
    for p in packages:
        name, version = text_of(p.get("name")), text_of(p.get("version"))
        marker = text_of(p.get("marker")) or ""
        group = re.search(r"['\"]([^'\"]+)['\"]\s+in\s+(dependency_groups|extras)", marker)
        optional = bool(group)
        sha = next((mapping(mapping(w).get("hashes")).get("sha256") for w in [p.get("sdist"), *listing(p.get("wheels")), p.get("archive")] if mapping(mapping(w).get("hashes")).get("sha256")), None)
        found.append(dependency(pypi(name, version), version, group[1] if group else None, not (group and group[2] == "dependency_groups"), optional, version is not None, name not in needed, {"marker": marker or None} if marker else None, {"sha256": sha} if sha else None))
    return {"dependencies": found, "extra_data": {"lock_version": text_of(d.get("lock-version")), "python_requires": text_of(d.get("requires-python")), "created_by": text_of(d.get("created-by"))}}


@reads("pypi_inspect_deplock", "pypi", r"pip-inspect\.deplock$", "json", "Python", "pip inspect deplock file")
def pip_inspect(path: str, d: dict) -> dict:
    installed = [x for x in listing(d.get("installed")) if isinstance(x, dict)]
    asked = [x for x in installed if x.get("requested")]
    main = first(*(x for x in asked if x.get("direct_url")), *asked)
    meta = mapping(mapping(main).get("metadata"))
    found = [
        dependency(pypi(m.get("name"), text_of(m.get("version"))), text_of(m.get("version")), None, True, False, True, bool(x.get("requested")))
        for x in installed if x is not main and (m := mapping(x.get("metadata")))
    ]
    name, version = text_of(meta.get("name")), text_of(meta.get("version"))
    return {
        "name": name, "version": version, "description": text_of(meta.get("summary")), "extracted_license_statement": text_of(meta.get("license")), "homepage_url": text_of(meta.get("home_page")),
        "parties": [party("author", text_of(meta.get("author")), text_of(meta.get("author_email")))] if meta.get("author") else [], "dependencies": found, "is_virtual": True,
        "extra_data": {"pip_version": text_of(d.get("pip_version")), "inspect_version": text_of(d.get("version"))}, **_urls(name, version),
    }


def _conda(spec: str, scope: str, runtime: bool = True) -> dict | None:
    channel, _, bare = spec.rpartition("::")
    m = re.match(r"^\s*([A-Za-z0-9_.-]+)\s*(.*)$", bare)
    if m is None:
        return None
    exact = re.fullmatch(r"={1,2}\s*([^\s=<>!,*|]+)(?:=(\S+))?", m[2])
    return dependency(purl("conda", m[1], exact[1] if exact else None, channel.rpartition("/")[2] or None), m[2] or None, scope, runtime, False, bool(exact))


@reads("conda_meta_yaml", "conda", names("meta.yaml", "meta.yml"), "text", None, "Conda recipe")
def conda_recipe(path: str, text: str) -> dict:
    from .base import yaml_of

    sets = dict(re.findall(r"{%-?\s*set\s+(\w+)\s*=\s*['\"]?([^'\"%]+?)['\"]?\s*-?%}", text))
    bare = re.sub(r"{%.*?%}", "", text)
    bare = re.sub(r"{{\s*(\w+)(?:\|\w+)?\s*}}", lambda m: sets.get(m[1], m[1]), bare)
    bare = re.sub(r"{{.*?}}", "x", bare)
    d = mapping(yaml_of(re.sub(r"\s#\s*\[[^\]]*\]\s*$", "", bare, flags=re.M)))
    package, about, source = mapping(d.get("package")), mapping(d.get("about")), d.get("source")
    source = mapping(source[0] if isinstance(source, list) and source else source)
    found = [x for scope, items in mapping(d.get("requirements")).items() for s in strings(items) if (x := _conda(s, scope, scope == "run")) is not None]
    return {
        "name": text_of(package.get("name")), "version": text_of(package.get("version")), "description": text_of(about.get("summary")), "homepage_url": text_of(about.get("home")), "vcs_url": text_of(about.get("dev_url")),
        "extracted_license_statement": text_of(about.get("license")), "download_url": text_of(first(*strings(source.get("url")))), "sha256": text_of(source.get("sha256")), "dependencies": found,
    }


@reads("conda_yaml", "conda", r"(?:^|/)(?:[^/]*conda[^/]*|env|environment[^/]*)\.ya?ml$", "yaml", None, "Conda environment")
def conda_environment(path: str, d: dict) -> dict:
    found = []
    for item in listing(d.get("dependencies")):
        if isinstance(item, dict):
            found += needs(item.get("pip"), "dependencies")
        elif (x := _conda(str(item).replace("=", "==", 1) if re.fullmatch(r"[\w.-]+=[^=<>].*", str(item)) else str(item), "dependencies")) is not None:
            found.append(x)
    return {"name": text_of(d.get("name")), "dependencies": found, "is_private": True, "extra_data": {"channels": strings(d.get("channels"))}}


@reads("conda_meta_json", "conda", r"conda-meta/[^/]+\.json$", "json", None, "Conda installed package metadata JSON")
def conda_installed(path: str, d: dict) -> dict:
    keep = ("requested_spec", "channel", "extracted_package_dir", "package_tarball_full_path", "files")
    size = d.get("size")
    return {
        "name": text_of(d.get("name")), "version": text_of(d.get("version")), "extracted_license_statement": text_of(d.get("license")), "download_url": text_of(d.get("url")),
        "size": size if isinstance(size, int) else None, "md5": text_of(d.get("md5")), "sha256": text_of(d.get("sha256")), "file_references": [{"path": f} for f in strings(d.get("files"))],
        "dependencies": [x for s in strings(d.get("depends")) if (x := _conda(s, "depends")) is not None], "extra_data": {k: d.get(k) for k in keep},
    }


@reads("pixi_toml", "pixi", names("pixi.toml"), "toml", None, "Pixi manifest")
def pixi_toml(path: str, d: dict) -> dict:
    project = mapping(d.get("workspace") or d.get("project") or d.get("package"))
    found = []

    def add(table: object, scope: str, python: bool, optional: bool = False) -> None:
        for name, spec in mapping(table).items():
            wanted = text_of(spec) or text_of(mapping(spec).get("version"))
            found.append(dependency(pypi(name) if python else purl("conda", name), wanted, scope, True, optional, False))

    for table, optional, feature in [(d, False, None), *((f, True, k) for k, f in mapping(d.get("feature")).items())]:
        add(mapping(table).get("dependencies"), feature or "dependencies", False, optional)
        add(mapping(table).get("pypi-dependencies"), feature or "pypi-dependencies", True, optional)
    return {
        "name": text_of(project.get("name")), "version": text_of(project.get("version")), "description": text_of(project.get("description")), "homepage_url": text_of(project.get("homepage")), "vcs_url": text_of(project.get("repository")),
        "extracted_license_statement": text_of(project.get("license")), "parties": [party("author", *person(a)[:2]) for a in strings(project.get("authors"))], "dependencies": found,
        "extra_data": {"channels": project.get("channels"), "platforms": project.get("platforms"), "environments": d.get("environments")},
    }


@reads("pixi_lock", "pixi", names("pixi.lock"), "yaml", None, "Pixi lockfile")
def pixi_lock(path: str, d: dict) -> dict:
    found = []
    for p in listing(d.get("packages")):
        p = mapping(p)
        python = bool(p.get("pypi")) or p.get("kind") == "pypi"
        url = text_of(first(p.get("pypi"), p.get("conda"), p.get("url"))) or ""
        file = url.rpartition("/")[2]
        m = re.match(r"^(.+)-([^-]+)-[^-]+\.(?:conda|tar\.bz2)$", file)
        name, version = text_of(p.get("name")) or (m[1] if m else None), text_of(p.get("version")) or (m[2] if m else None)
        if name:
            found.append(dependency(pypi(name, version) if python else purl("conda", name, version), version, "pypi" if python else "conda", True, False, True, None, None, {"sha256": text_of(p.get("sha256")), "download_url": url or None}))
    return {"dependencies": found, "extra_data": {"lock_version": text_of(d.get("version")), "environments": sorted(mapping(d.get("environments")))}}
