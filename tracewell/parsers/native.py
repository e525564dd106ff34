"""Compiled languages and their build tools: Cargo, Go, Conan, vcpkg, Bazel, Buck, Meson, Nix, opam, Hackage, Hex."""

from __future__ import annotations

import ast
import re

from .base import dependency, first, listing, mapping, names, party, person, purl, reads, stanzas, strings, text_of

# Cargo -------------------------------------------------------------------------------------------------------------


def _crate_urls(name: str | None, version: str | None) -> dict:
    if not name:
        return {}
    api = f"https://crates.io/api/v1/crates/{name}"
    return {"repository_homepage_url": f"https://crates.io/crates/{name}", "repository_download_url": f"{api}/{version}/download" if version else None, "api_data_url": api}


@reads("cargo_toml", "cargo", r"(?:^|/)[Cc]argo\.toml$", "toml", "Rust", "Cargo manifest")
def cargo_toml(path: str, d: dict) -> dict:
    p = mapping(d.get("package"))
    name, version = text_of(p.get("name")), text_of(p.get("version"))
    found = []
    for scope in ("dependencies", "dev-dependencies", "build-dependencies"):
        for dep, spec in mapping(d.get(scope)).items():
            wanted = text_of(spec) if not isinstance(spec, dict) else text_of(spec.get("version"))
            extra = {k: v for k, v in mapping(spec).items() if k != "optional"}
            exact = bool(wanted and re.fullmatch(r"=?\d+\.\d+\.\d+(?:[-+][\w.-]+)?", wanted))
            found.append(dependency(purl("cargo", text_of(mapping(spec).get("package")) or dep), wanted, scope, scope == "dependencies", mapping(spec).get("optional") is True, exact, True, extra or None))
    readme, file = p.get("readme"), text_of(p.get("license-file"))
    references = [{"path": x} for x in dict.fromkeys([*strings(readme), *([file] if file else [])])]
    people = [party("author", *person(a)[:2], type=None) for a in strings(p.get("authors"))]
    urls = _crate_urls(name, version)
    return {
        "name": name, "version": version, "description": re.sub(r"\s*\n\s*", " ", text_of(p.get("description")) or "").strip() or None, "homepage_url": text_of(p.get("homepage")) or urls.get("repository_homepage_url"),
        "vcs_url": text_of(p.get("repository")), "keywords": [*strings(p.get("keywords")), *strings(p.get("categories"))], "extracted_license_statement": text_of(p.get("license")) or file, "parties": people, "dependencies": found,
        "file_references": references,
        "extra_data": {"rust_version": p.get("rust-version"), "rust_edition": p.get("edition"), "documentation_url": p.get("documentation"), "readme_file": readme, "publish": p.get("publish"), "targets": sorted(mapping(d.get("target"))), "workspace": d.get("workspace"), "license_file": file},
        **urls,
    }


@reads("cargo_lock", "cargo", r"(?:^|/)[Cc]argo\.lock$", "toml", "Rust", "Rust Cargo.lock lockfile")
def cargo_lock(path: str, d: dict) -> dict:
    packages = [p for p in listing(d.get("package")) if isinstance(p, dict)]
    root = next((p for p in packages if "source" not in p), packages[0] if packages else {})
    versions: dict[str, list[str]] = {}
    sources = {}
    for p in packages:
        versions.setdefault(p.get("name"), []).append(p.get("version"))
        sources[p.get("name"), p.get("version")] = {k: p[k] for k in ("source", "checksum") if k in p}
    found = []
    for p in packages:
        for item in strings(p.get("dependencies")):
            name, *more = item.split(" ")
            own = versions.get(name, [])
            version = more[0] if more else own[0] if len(own) == 1 else None
            found.append(dependency(purl("cargo", name, version), version, "dependencies", True, False, True, p is root, sources.get((name, version)) or None))
    name, version = text_of(root.get("name")), text_of(root.get("version"))
    return {"name": name, "version": version, "sha256": text_of(root.get("checksum")), "dependencies": found, "primary_language": None if not name else "Rust", "api_data_url": f"https://crates.io/api/v1/crates/{name}/{version}" if name and version else None}


# Go ----------------------------------------------------------------------------------------------------------------


def golang(module: str, version: str | None = None) -> str | None:
    namespace, _, name = module.rpartition("/")
    return purl("golang", name, version, namespace)


def _go_identity(module: str | None) -> dict:
    if not module:
        return {"purl": None}
    namespace, _, name = module.rpartition("/")
    page = f"https://pkg.go.dev/{module}"
    return {"namespace": namespace or None, "name": name, "homepage_url": page, "repository_homepage_url": page, "vcs_url": f"https://{module}.git" if namespace else None, "purl": golang(module)}


def _go_directives(text: str) -> list[tuple[str, list[str], str]]:
    """(directive, fields, comment), with blocks opened."""
    out, block = [], None
    for line in text.splitlines():
        code, _, comment = line.partition("//")
        code = code.strip()
        if block and code == ")":
            block = None
        elif m := re.match(r"(\w+)\s*\($", code):
            block = m[1]
        elif code:
            fields = [f.strip('"`') for f in code.split()]
            out.append((block, fields, comment.strip()) if block else (fields[0], fields[1:], comment.strip()))
    return out


@reads("go_mod", "golang", names("go.mod"), "text", "Go", "Go module")
def go_mod(path: str, text: str) -> dict:
    module, extra, found = None, {}, []
    for kind, f, comment in _go_directives(text):
        if kind == "module" and f:
            module = f[0]
        elif kind in ("go", "toolchain") and f:
            extra[{"go": "go_version"}.get(kind, kind)] = f[0]
        elif kind == "retract":
            extra.setdefault("retract", []).append(" ".join(f))
        elif kind in ("require", "exclude") and len(f) >= 2:
            found.append(dependency(golang(f[0], f[1]), f[1], kind, True, False, False, "indirect" not in comment))
        elif kind == "replace" and "=>" in f:
            at = f.index("=>")
            old, new = f[:at], f[at + 1 :]
            local = new[0].startswith((".", "/"))
            more = {"replaces": old[0], "replaces_version": old[1] if len(old) > 1 else None, "local_path": new[0] if local else None}
            version = new[1] if len(new) > 1 else None
            found.append(dependency(golang(old[0] if local else new[0], version), version, "replace", extra=more))
    return {**_go_identity(module), "dependencies": found, "extra_data": extra}


@reads("go_sum", "golang", names("go.sum"), "text", "Go", "Go checksums")
def go_sum(path: str, text: str) -> dict:
    seen = {}
    for line in text.splitlines():
        f = line.split()
        if len(f) == 3:
            seen.setdefault((f[0], f[1].removesuffix("/go.mod")), f[2])
    return {"dependencies": [dependency(golang(m, v), v, "dependency", True, False, True, None) for m, v in seen], "purl": None}


@reads("go_work", "golang", names("go.work"), "text", "Go", "Go workspace")
def go_work(path: str, text: str) -> dict:
    extra, found = {}, []
    for kind, f, _ in _go_directives(text):
        if kind == "use" and f:
            extra.setdefault("use", []).append(f[0])
        elif kind in ("go", "toolchain") and f:
            extra[{"go": "go_version"}.get(kind, kind)] = f[0]
        elif kind == "replace" and "=>" in f:
            new = f[f.index("=>") + 1 :]
            version = new[1] if len(new) > 1 else None
            found.append(dependency(golang(new[0], version), version, "replace", extra={"replaces": f[0]}))
    return {"dependencies": found, "extra_data": extra, "purl": None}


@reads("go_mod_graph", "golang", r"go\.mod\.graph$|go\.modgraph$", "text", "Go", "Go module graph file")
def go_mod_graph(path: str, text: str) -> dict:
    edges = [f for line in text.splitlines() if len(f := line.split()) == 2]
    cut = lambda s: tuple(s.split("@", 1)) if "@" in s else (s, None)
    root = next((a for a, _ in edges if "@" not in a), None)
    direct = {b for a, b in edges if "@" not in a}
    targets = sorted({b for _, b in edges if b != root})
    found = [dependency(golang(m, v), v, "dependency", True, False, v is not None, b in direct) for b in targets for m, v in [cut(b)]]
    return {**_go_identity(root), "dependencies": found}


@reads("godeps", "golang", names("Godeps.json"), "json", "Go", "Godep dependencies")
def godeps(path: str, d: dict) -> dict:
    found = [dependency(golang(m, text_of(x.get("Rev"))), text_of(x.get("Rev")), "Deps", True, False, True, True, {"comment": x.get("Comment")} if x.get("Comment") else None) for x in listing(d.get("Deps")) if (m := text_of(mapping(x).get("ImportPath")))]
    return {**_go_identity(text_of(d.get("ImportPath"))), "dependencies": found, "extra_data": {"go_version": d.get("GoVersion"), "packages": d.get("Packages")}}


# Conan, vcpkg ------------------------------------------------------------------------------------------------------


def _conan_need(text: str, scope: str, runtime: bool = True) -> dict | None:
    m = re.match(r"([\w.+-]+)/([^@#]+)(?:@([^#]*))?(?:#(\w+))?", text.strip())
    if m is None:
        return None
    version = m[2].strip()
    exact = not re.search(r"[\[\]<>~^*]", version)
    return dependency(purl("conan", m[1], version if exact else None), version, scope, runtime, not runtime, exact, True, {k: v for k, v in (("user_channel", m[3]), ("revision", m[4])) if v})


@reads("conan_conanfile_py", "conan", names("conanfile.py"), "text", "C++", "Conan recipe, read without running it")
def conanfile_py(path: str, text: str) -> dict:
    tree = ast.parse(text)
    recipe = next((c for c in ast.walk(tree) if isinstance(c, ast.ClassDef) and any("ConanFile" in ast.dump(b) for b in c.bases)), None)
    if recipe is None:
        return {}
    fields: dict[str, object] = {}
    for node in recipe.body:
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            try:
                fields[node.targets[0].id] = ast.literal_eval(node.value)
            except ValueError:
                continue
    found = []
    for field, scope, runtime in (("requires", "requires", True), ("build_requires", "build_requires", False), ("tool_requires", "tool_requires", False), ("test_requires", "test_requires", False)):
        value = fields.get(field)
        items = [value] if isinstance(value, str) else [x[0] if isinstance(x, tuple) else x for x in value or []]
        found += [x for t in items if (x := _conan_need(str(t), scope, runtime)) is not None]
    for node in ast.walk(recipe):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("requires", "build_requires", "tool_requires", "test_requires") and node.args and isinstance(node.args[0], ast.Constant):
            if (x := _conan_need(str(node.args[0].value), node.func.attr, node.func.attr == "requires")) is not None:
                found.append(x)
    stated, topics = fields.get("license"), fields.get("topics")
    return {
        "name": text_of(fields.get("name")), "version": text_of(fields.get("version")), "description": text_of(fields.get("description")), "homepage_url": text_of(fields.get("homepage")), "vcs_url": text_of(fields.get("url")),
        "extracted_license_statement": ", ".join(stated) if isinstance(stated, (tuple, list)) else text_of(stated), "keywords": strings(list(topics) if isinstance(topics, (tuple, list)) else topics),
        "parties": [party("author", *person(str(fields["author"]))[:2])] if fields.get("author") else [], "dependencies": found,
    }


@reads("conan_conanfile_txt", "conan", names("conanfile.txt"), "text", "C++", "Conan requirements")
def conanfile_txt(path: str, text: str) -> dict:
    found, section, extra = [], None, {}
    for line in text.splitlines():
        s = line.split("#")[0].strip() if not re.search(r"\w#\w", line) else line.strip()
        if m := re.match(r"\[(\w+)\]$", s):
            section = m[1]
        elif s and section in ("requires", "build_requires", "tool_requires", "test_requires"):
            if (x := _conan_need(s, section, section == "requires")) is not None:
                found.append(x)
        elif s and section:
            extra.setdefault(section, []).append(s)
    return {"dependencies": found, "extra_data": extra}


@reads("conan_lock", "conan", names("conan.lock"), "json", "C++", "Conan lockfile")
def conan_lock(path: str, d: dict) -> dict:
    found = []
    for field, runtime in (("requires", True), ("build_requires", False), ("python_requires", False)):
        found += [{**x, "is_pinned": True, "is_direct": None} for t in strings(d.get(field)) if (x := _conan_need(t.split("%")[0], field, runtime)) is not None]
    for number, node in mapping(mapping(d.get("graph_lock")).get("nodes")).items():
        ref = text_of(mapping(node).get("ref"))
        if ref and number != "0" and (x := _conan_need(ref, "requires")) is not None:
            found.append({**x, "is_pinned": True})
    return {"dependencies": found, "extra_data": {"lock_version": text_of(d.get("version"))}}


@reads("conan_conandata_yml", "conan", r"/conandata\.yml$", "yaml", "C++", "Conan external source metadata")
def conandata(path: str, d: dict) -> list[dict] | dict:
    rows = []
    for version, source in mapping(d.get("sources")).items():
        urls = strings(mapping(source).get("url"))
        patches = mapping(d.get("patches")).get(version)
        rows.append({"version": str(version), "download_url": urls[0] if urls else None, "sha256": text_of(mapping(source).get("sha256")), "extra_data": {"mirror_urls": urls if len(urls) > 1 else None, "patches": patches}})
    return rows or {}


@reads("vcpkg_json", "vcpkg", names("vcpkg.json"), "json", "C++", "vcpkg manifest file")
def vcpkg(path: str, d: dict) -> dict:
    version = first(*(text_of(d.get(k)) for k in ("version", "version-semver", "version-date", "version-string")))
    port = d.get("port-version")
    name = text_of(d.get("name"))
    found = []

    def add(items: object, feature: str | None) -> None:
        for item in listing(items):
            one = {"name": item} if isinstance(item, str) else mapping(item)
            if (n := text_of(one.get("name"))) is not None:
                extra = {k: one[k] for k in ("version>=", "features", "default-features", "host", "platform") if k in one}
                if feature:
                    extra["feature"] = feature
                found.append(dependency(purl("vcpkg", n), text_of(one.get("version>=")) or n, "dependencies", one.get("host") is not True, extra=extra))

    add(d.get("dependencies"), None)
    for feature, x in mapping(d.get("features")).items():
        add(mapping(x).get("dependencies"), feature)
    about = d.get("description")
    full = f"{version}#{port}" if version and isinstance(port, int) and port > 0 else version
    return {
        "name": name, "version": full, "description": "\n".join(strings(about)) or None, "homepage_url": text_of(d.get("homepage")), "extracted_license_statement": text_of(d.get("license")), "is_private": name is None,
        "parties": [party("maintainer", *person(m)[:2]) for m in strings(d.get("maintainers"))], "dependencies": found,
        "extra_data": {k: d.get(k) for k in ("builtin-baseline", "overrides", "supports", "default-features", "configuration")},
    }


# Starlark, Meson, Nix ----------------------------------------------------------------------------------------------


def calls(text: str) -> list[tuple[str, dict]]:
    """Top-level calls of a build file in the Python-like language: name, keyword literals (and ``"0"``, the first
    positional one)."""
    out = []
    for node in ast.parse(text).body:
        value = node.value if isinstance(node, (ast.Expr, ast.Assign)) else None
        if isinstance(value, ast.Call):
            name = ast.unparse(value.func)
            fields = {}
            for key, v in [*[(k.arg, k.value) for k in value.keywords if k.arg], *[("0", a) for a in value.args[:1]]]:
                try:
                    fields[key] = ast.literal_eval(v)
                except ValueError:
                    continue
            out.append((name, fields))
    return out


def _targets(path: str, text: str, kind: str) -> list[dict] | dict:
    rows = []
    for name, f in calls(text):
        if (name.endswith(("_library", "_binary")) or name in ("library", "binary")) and text_of(f.get("name")):
            found = [dependency(None, t, "deps") for t in strings(f.get("deps"))]
            rows.append({"name": text_of(f["name"]), "extracted_license_statement": ", ".join(strings(f.get("licenses"))) or None, "dependencies": found, "extra_data": {"rule": name}})
    return rows or {"name": path.split("/")[-2] if "/" in path else None}


@reads("bazel_build", "bazel", names("BUILD", "BUILD.bazel"), "text", None, "Bazel targets")
def bazel_build(path: str, text: str) -> list[dict] | dict:
    return _targets(path, text, "bazel")


@reads("buck_file", "buck", names("BUCK"), "text", None, "Buck targets")
def buck_file(path: str, text: str) -> list[dict] | dict:
    return _targets(path, text, "buck")


@reads("buck_metadata", "buck", names("METADATA.bzl"), "text", None, "Buck metadata")
def buck_metadata(path: str, text: str) -> dict:
    m = {}
    for node in ast.parse(text).body:
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Dict):
            m |= ast.literal_eval(node.value)
    licenses = m.get("licenses") or m.get("license")
    return {
        "type": text_of(m.get("package_type") or m.get("upstream_type")) or "buck", "name": text_of(m.get("name")), "version": text_of(m.get("version")), "homepage_url": text_of(first(m.get("upstream_address"), m.get("homepage_url"))),
        "extracted_license_statement": ", ".join(strings(licenses)) or None, "parties": [party("maintainer", x, type="organization") for x in strings(m.get("maintainers"))], "download_url": text_of(m.get("download_url")),
        "vcs_url": text_of(m.get("vcs_url")), "sha1": text_of(m.get("download_archive_sha1")), "purl": text_of(m.get("package_url")) or purl("buck", text_of(m.get("name")), text_of(m.get("version"))),
    }


@reads("bazel_module", "bazel", names("MODULE.bazel"), "text", None, "Bazel module")
def bazel_module(path: str, text: str) -> dict:
    own, found, overrides = {}, [], []
    for name, f in calls(text):
        if name == "module":
            own = f
        elif name == "bazel_dep" and text_of(f.get("name")):
            dev = f.get("dev_dependency") is True
            version = text_of(f.get("version"))
            found.append(dependency(purl("bazel", text_of(f["name"]), version), version, "dev" if dev else "dependencies", not dev, dev, version is not None, True, {"repo_name": f.get("repo_name")} if f.get("repo_name") else None))
        elif name.endswith("_override"):
            overrides.append({"kind": name, **f})
    return {"name": text_of(own.get("name")), "version": text_of(own.get("version")), "dependencies": found, "extra_data": {"compatibility_level": own.get("compatibility_level"), "repo_name": own.get("repo_name"), "overrides": overrides}}


@reads("meson_build", "meson", names("meson.build"), "text", None, "Meson project")
def meson(path: str, text: str) -> dict:
    bare = re.sub(r"#[^\n]*", "", text)
    project = re.search(r"\bproject\s*\(((?:[^()]|\([^()]*\))*)\)", bare)
    body = project[1] if project else ""
    words = re.findall(r"'([^']*)'", body.split(":")[0])
    get = lambda k: first(*re.findall(rf"\b{k}\s*:\s*'([^']*)'", body))
    stated = re.search(r"\blicense\s*:\s*\[([^\]]*)\]", body)
    found = []
    for args in re.findall(r"\bdependency\s*\(((?:[^()]|\([^()]*\))*)\)", bare):
        names_ = re.findall(r"^\s*'([^']*)'", args)
        if names_:
            needed = re.search(r"\brequired\s*:\s*(\w+)", args)
            wanted = re.search(r"\bversion\s*:\s*(?:\[)?'([^']*)'", args)
            native = re.search(r"\bnative\s*:\s*true", args)
            found.append(dependency(purl("meson", names_[0]), wanted[1] if wanted else None, "dependencies", not native, bool(needed and needed[1] == "false"), bool(wanted and re.match(r"=?\d|==", wanted[1]))))
    return {"name": words[0] if words else None, "version": get("version"), "extracted_license_statement": get("license") or (" AND ".join(re.findall(r"'([^']*)'", stated[1])) if stated else None), "dependencies": found, "extra_data": {"languages": words[1:], "meson_version": get("meson_version")}}


@reads("nix_flake_nix", "nix", names("flake.nix"), "text", "Nix", "Nix flake")
def flake_nix(path: str, text: str) -> dict:
    bare = re.sub(r"#[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    about = re.search(r'\bdescription\s*=\s*"((?:\\.|[^"\\])*)"', bare)
    found = {}
    for m in re.finditer(r'(?:\binputs\.)?([\w-]+)\.url\s*=\s*"([^"]+)"|([\w-]+)\s*=\s*\{[^{}]*?\burl\s*=\s*"([^"]+)"', bare):
        found.setdefault(m[1] or m[3], m[2] or m[4])
    folder = path.split("/")[-2] if "/" in path else None
    return {"name": folder, "description": about[1] if about else None, "dependencies": [dependency(purl("nix", k), u, "inputs") for k, u in found.items()]}


@reads("nix_flake_lock", "nix", names("flake.lock"), "json", "Nix", "Nix flake lockfile")
def flake_lock(path: str, d: dict) -> dict:
    nodes = mapping(d.get("nodes"))
    root = text_of(d.get("root")) or "root"
    direct = {v for v in mapping(mapping(nodes.get(root)).get("inputs")).values() if isinstance(v, str)}
    found = []
    for name, node in nodes.items():
        locked = mapping(mapping(node).get("locked"))
        if name != root and locked:
            revision = text_of(locked.get("rev"))
            found.append(dependency(purl("nix", name, revision), revision, "inputs", True, False, True, name in direct, {k: locked.get(k) for k in ("type", "owner", "repo", "narHash", "url", "ref") if locked.get(k)}))
    return {"name": path.split("/")[-2] if "/" in path else None, "dependencies": found, "extra_data": {"lock_version": d.get("version")}}


@reads("nix_default_nix", "nix", names("default.nix"), "text", "Nix", "Nix derivation, literal values alone")
def default_nix(path: str, text: str) -> dict:
    bare = re.sub(r"#[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    get = lambda k: first(*re.findall(rf'\b{k}\s*=\s*"((?:\\.|[^"\\$])*)"\s*;', bare))
    name, version = get("pname"), get("version")
    if not name and (whole := get("name")):
        m = re.match(r"(.+?)-(\d[^-]*)$", whole)
        name, version = (m[1], version or m[2]) if m else (whole, version)
    found = []
    for field, runtime in (("buildInputs", True), ("propagatedBuildInputs", True), ("nativeBuildInputs", False)):
        for body in re.findall(rf"\b{field}\s*=\s*(?:with\s+\w+;\s*)?\[([^\]]*)\]", bare):
            found += [dependency(purl("nix", w.rpartition(".")[2]), None, field, runtime) for w in re.findall(r"[A-Za-z_][\w.-]*", body)]
    stated = re.search(r"\blicense\s*=\s*(?:with\s+[\w.]+;\s*)?(?:lib\.|licenses\.|stdenv\.lib\.)*([\w.-]+)", bare)
    return {"name": name, "version": version, "description": get("description"), "homepage_url": get("homepage"), "extracted_license_statement": stated[1] if stated else None, "dependencies": found}


# OCaml, Haskell, Elixir --------------------------------------------------------------------------------------------

_OPAM = re.compile(r'"""(.*?)"""|"((?:\\.|[^"\\])*)"|([\[\](){}])|#[^\n]*|([^\s"\[\](){}]+)', re.S)


def _opam_fields(text: str) -> dict[str, list]:
    """Field values as token lists: ("str", text) or signs and words."""
    out: dict[str, list] = {}
    key, depth = None, 0
    for m in _OPAM.finditer(text):
        if m[4] and depth == 0 and m[4].endswith(":"):
            key = m[4][:-1]
            out[key] = []
            continue
        if m[3]:
            if m[3] == "{" and depth == 0 and out and not out[key] and key is None:
                continue
            depth += 1 if m[3] in "[({" else -1
            depth = max(0, depth)
        if key is not None and (m[1] is not None or m[2] is not None or m[3] or m[4]):
            out[key].append(("str", m[1].strip("\n") if m[1] is not None else re.sub(r"\\(.)", r"\1", m[2])) if m[1] is not None or m[2] is not None else (m[3] or m[4]))
    return out


@reads("opam_file", "opam", r"(?:^|/)opam$|\.opam$", "text", "Ocaml", "opam package")
def opam(path: str, text: str) -> dict:
    section = re.search(r"(?m)^url\s*\{(.*?)^\}", text, re.S)
    f = _opam_fields(re.sub(r"(?m)^(?:url|extra-source\s+\"[^\"]*\")\s*\{.*?^\}", "", text, flags=re.S))
    urls = _opam_fields(section[1]) if section else {}
    every = lambda k, at=f: [t[1] for t in at.get(k, []) if isinstance(t, tuple)]
    one = lambda k: first(*every(k))
    found, tokens = [], f.get("depends", [])
    k = 0
    while k < len(tokens):
        if isinstance(tokens[k], tuple):
            name, wanted = tokens[k][1], []
            if k + 1 < len(tokens) and tokens[k + 1] == "{":
                k += 2
                while k < len(tokens) and tokens[k] != "}":
                    wanted.append(tokens[k][1] if isinstance(tokens[k], tuple) else tokens[k])
                    k += 1
            found.append(dependency(purl("opam", name), " ".join(wanted) or None, "dependency"))
        k += 1
    sums = dict(s.split("=", 1) for s in every("checksum", urls) if "=" in s)
    about = "\n".join(x for x in (one("synopsis"), (one("description") or "").strip()) if x)
    people = [party("author", a) for a in every("authors") or every("author")]
    people += [party("maintainer", *((None, m) if "@" in m else (m, None))) for m in every("maintainer")]
    return {
        "name": one("name"), "version": one("version"), "description": about or None, "homepage_url": one("homepage"), "bug_tracking_url": one("bug-reports"), "vcs_url": one("dev-repo"), "download_url": first(*every("src", urls), *every("archive", urls)),
        "extracted_license_statement": " AND ".join(every("license")) or None, "md5": sums.get("md5"), "sha256": sums.get("sha256"), "sha512": sums.get("sha512"), "parties": people, "dependencies": found, "keywords": [],
        "extra_data": {"tags": every("tags")},
    }


def _cabal_needs(value: str, scope: str | None, runtime: bool, extra: dict | None = None) -> list[dict]:
    found = []
    for item in value.replace("\n", " ").split(","):
        m = re.match(r"\s*([A-Za-z0-9-]+)(?::\S+)?\s*(.*)$", item)
        if m:
            exact = re.fullmatch(r"==\s*([\d.]+)", m[2].strip())
            found.append(dependency(purl("hackage", m[1], exact[1] if exact else None), m[2].strip() or None, scope, runtime, not runtime, bool(exact), True, extra))
    return found


@reads("hackage_cabal", "hackage", r"\.cabal$", "text", "Haskell", "Cabal package")
def cabal(path: str, text: str) -> dict:
    fields, found, section = {}, [], None
    blocks = re.findall(r"(?m)^([ \t]*)([A-Za-z][\w-]*)\s*:[ \t]*(.*(?:\n(?:\1[ \t]+\S.*|[ \t]*\.?[ \t]*(?=\n\1[ \t]+\S)))*)|^(?i:(library|executable|test-suite|benchmark|common|flag|source-repository))\b[ \t]*(\S*)", text)
    for _, key, value, kind, name in blocks:
        if kind:
            section = (kind.lower(), name)
            continue
        low = key.lower()
        body = "\n".join(re.sub(r"^\.$", "", x.strip()) for x in re.sub(r"(?m)^\s*--.*$", "", value).splitlines()).strip()
        if low in ("build-depends", "build-tool-depends", "setup-depends"):
            runtime = section is None or section[0] in ("library", "executable", "common")
            found += _cabal_needs(body, section[0] if section else None, runtime and low == "build-depends", {"component": section[1]} if section and section[1] else None)
        elif section is None:
            fields.setdefault(low, body)
        elif section[0] == "source-repository" and low == "location":
            fields.setdefault("repository", body)
    name, version = fields.get("name"), fields.get("version")
    people = [party(role, *person(p)[:2]) for role in ("author", "maintainer") for p in re.split(r",\s*", fields.get(role, "")) if p.strip()]
    return {
        "name": name, "version": version, "description": "\n".join(x for x in (fields.get("synopsis"), fields.get("description")) if x) or None, "homepage_url": fields.get("homepage"), "bug_tracking_url": fields.get("bug-reports"), "vcs_url": fields.get("repository"),
        "extracted_license_statement": fields.get("license"), "copyright": fields.get("copyright"), "keywords": [c.strip() for c in fields.get("category", "").split(",") if c.strip()], "parties": people, "dependencies": found,
        "file_references": [{"path": x.strip()} for x in re.split(r"[,\n]", fields.get("license-file", "") or fields.get("license-files", "")) if x.strip()],
        "repository_homepage_url": f"https://hackage.haskell.org/package/{name}" if name else None, "repository_download_url": f"https://hackage.haskell.org/package/{name}-{version}/{name}-{version}.tar.gz" if name and version else None,
    }


@reads("hackage_cabal_project", "hackage", names("cabal.project"), "text", "Haskell", "Cabal project")
def cabal_project(path: str, text: str) -> dict:
    bare = re.sub(r"(?m)\s*--.*$", "", text)
    f = dict(re.findall(r"(?m)^([\w-]+):[ \t]*(.*(?:\n[ \t]+\S.*)*)", bare))
    found = _cabal_needs(f.get("constraints", ""), "constraints", True) if f.get("constraints") else []
    found += [dependency(purl("hackage", p), None, "extra-packages") for p in re.findall(r"[A-Za-z][\w-]*", f.get("extra-packages", ""))]
    found += [dependency(purl("generic", loc.rstrip("/").rpartition("/")[2].removesuffix(".git")), loc, "source-repository-package") for loc in re.findall(r"source-repository-package\s*\n(?:\s+.*\n)*?\s+location:\s*(\S+)", bare)]
    return {"dependencies": found, "extra_data": {"packages": f.get("packages", "").split(), "index_state": f.get("index-state")}}


@reads("hackage_stack_yaml", "hackage", names("stack.yaml"), "yaml", "Haskell", "Stack project")
def stack_yaml(path: str, d: dict) -> dict:
    found = []
    for item in listing(d.get("extra-deps")):
        if isinstance(item, str):
            m = re.match(r"([A-Za-z][\w-]*?)-(\d[\d.]*)(?:@.*)?$", item)
            found.append(dependency(purl("hackage", m[1], m[2]) if m else None, item, "extra-deps", True, False, bool(m)))
        else:
            url = text_of(mapping(item).get("git") or mapping(item).get("github") or mapping(item).get("archive"))
            found.append(dependency(purl("generic", (url or "").rpartition("/")[2].removesuffix(".git"), text_of(mapping(item).get("commit"))), url, "extra-deps", True, False, bool(mapping(item).get("commit"))))
    return {"dependencies": found, "extra_data": {"resolver": text_of(d.get("resolver") or d.get("snapshot")), "packages": strings(d.get("packages"))}}


@reads("hex_mix_lock", "hex", names("mix.lock"), "text", "Elixir", "Hex lockfile")
def mix_lock(path: str, text: str) -> dict:
    found = []
    for m in re.finditer(r'"([\w-]+)":\s*\{:(hex|git|path),\s*(?::([\w]+)|"([^"]+)")(?:,\s*"([^"]+)")?(?:,\s*"([0-9a-f]{64})")?', text):
        name, kind = m[3] or m[1], m[2]
        version = m[5]
        found.append(dependency(purl("hex", name, version if kind == "hex" else None), version, "dependencies", True, False, True, None, {"source": kind, "url": m[4]} if m[4] else None, {"sha256": m[6]} if m[6] else None))
    return {"dependencies": found}


# R, Perl, PHP, Kubernetes ------------------------------------------------------------------------------------------


@reads("cran_description", "cran", names("DESCRIPTION"), "text", "R", "R package description")
def cran(path: str, text: str) -> dict:
    f = stanzas(text)[0]
    if "package" not in f:
        raise ValueError("no package")
    found = []
    for field, scope, runtime, optional in (("depends", "dependencies", True, False), ("imports", "imports", True, False), ("linkingto", "linkingto", True, False), ("suggests", "suggests", True, True), ("enhances", "enhances", True, True)):
        for item in f.get(field, "").split(","):
            m = re.match(r"\s*([\w.]+)\s*(?:\(([^)]*)\))?", item)
            if m:
                found.append(dependency(purl("cran", m[1]), m[2], scope, runtime, optional))
    people = [party("maintainer", *person(f["maintainer"])[:2], type=None)] if f.get("maintainer") else []
    people += [party("author", *person(a.strip())[:2], type=None) if "<" in a and "@" in a else party("author", a.strip(), type=None) for a in re.split(r",(?![^\[(]*[\])])", f.get("author", "")) if a.strip()]
    name = f["package"]
    return {
        "name": name, "version": f.get("version"), "description": f.get("description") or f.get("title"), "homepage_url": first(*re.split(r"[,\s]+", f.get("url", ""))), "bug_tracking_url": f.get("bugreports"), "extracted_license_statement": f.get("license"),
        "release_date": first(f.get("date/publication"), f.get("date")), "parties": people, "dependencies": found, "repository_homepage_url": f"https://cran.r-project.org/package={name}", "primary_language": None,
    }


def _cpan(name: str, version: str | None = None) -> str | None:
    return purl("cpan", name.replace("::", "-"), version)


def _cpan_row(d: dict, needs: list[dict]) -> dict:
    links = mapping(d.get("resources"))
    repository, bugs = links.get("repository"), links.get("bugtracker")
    stated = strings(d.get("license"))
    return {
        "name": text_of(d.get("name")), "version": text_of(d.get("version")), "description": text_of(d.get("abstract")), "homepage_url": text_of(links.get("homepage")), "extracted_license_statement": " AND ".join(stated) or None,
        "vcs_url": text_of(mapping(repository).get("url")) or text_of(repository), "code_view_url": text_of(mapping(repository).get("web")), "bug_tracking_url": text_of(mapping(bugs).get("web")) or text_of(bugs),
        "parties": [party("author", *person(a)[:2]) for a in strings(d.get("author"))], "keywords": strings(d.get("keywords")), "dependencies": needs,
    }


@reads("cpan_meta_json", "cpan", names("META.json"), "json", "Perl", "CPAN metadata as JSON")
def cpan_meta_json(path: str, d: dict) -> dict:
    needs = [dependency(_cpan(m), text_of(v), phase, phase == "runtime", kind in ("suggests", "recommends")) for phase, kinds in mapping(d.get("prereqs")).items() for kind, table in mapping(kinds).items() for m, v in mapping(table).items() if m != "perl"]
    return _cpan_row(d, needs)


@reads("cpan_meta_yml", "cpan", names("META.yml"), "yaml", "Perl", "CPAN metadata")
def cpan_meta_yml(path: str, d: dict) -> dict:
    sections = (("requires", "runtime"), ("build_requires", "build"), ("configure_requires", "configure"), ("recommends", "runtime"))
    needs = [dependency(_cpan(m), text_of(v), scope, scope == "runtime", section == "recommends") for section, scope in sections for m, v in mapping(d.get(section)).items() if m != "perl"]
    return _cpan_row(d, needs)


@reads("cpan_manifest", "cpan", names("MANIFEST"), "text", "Perl", "CPAN file list")
def cpan_manifest(path: str, text: str) -> dict:
    return {"file_references": [{"path": x.split()[0]} for x in text.splitlines() if x.strip() and not x.startswith("#")]}


@reads("cpan_makefile", "cpan", names("Makefile.PL"), "text", "Perl", "CPAN build script, read without running it")
def cpan_makefile(path: str, text: str) -> dict:
    get = lambda k: first(*re.findall(rf"['\"]?\b{k}['\"]?\s*=>\s*['\"]([^'\"]+)['\"]", text))
    needs = []
    for key, scope in (("PREREQ_PM", "runtime"), ("BUILD_REQUIRES", "build"), ("TEST_REQUIRES", "test"), ("CONFIGURE_REQUIRES", "configure")):
        for body in re.findall(rf"\b{key}['\"]?\s*=>\s*\{{([^}}]*)\}}", text):
            needs += [dependency(_cpan(m), v or None, scope, scope == "runtime") for m, v in re.findall(r"['\"]?([A-Z][\w:]*)['\"]?\s*=>\s*['\"]?([\w.]*)['\"]?", body)]
    name = get("DISTNAME") or (get("NAME") or "").replace("::", "-") or None
    people = re.search(r"\bAUTHOR['\"]?\s*=>\s*(?:\[([^\]]*)\]|(['\"][^'\"]*['\"]))", text)
    authors = [party("author", *person(a)[:2]) for a in re.findall(r"['\"]([^'\"]+)['\"]", people[1] or people[2])] if people else []
    return {"name": name, "version": get("VERSION"), "description": get("ABSTRACT"), "extracted_license_statement": get("LICENSE"), "parties": authors, "dependencies": needs, "extra_data": {"MIN_PERL_VERSION": get("MIN_PERL_VERSION"), "VERSION_FROM": get("VERSION_FROM")}}


@reads("cpan_dist_ini", "cpan", r"/dist\.ini$", "text", "Perl", "CPAN Perl dist.ini")
def cpan_dist_ini(path: str, text: str) -> dict:
    fields: dict[str, str] = {}
    needs, section = [], ""
    for line in text.splitlines():
        s = re.sub(r"\s;.*$", "", line).strip()
        if not s or s[0] in ";#":
            continue
        if s.startswith("["):
            section = s.strip("[]").strip()
            continue
        k, _, v = (x.strip() for x in s.partition("="))
        if section.lower().startswith("prereqs"):
            tail = section.partition("/")[2].strip().lower()
            scope = next((p for p in ("test", "build", "configure", "develop") if p in tail), "runtime")
            if not k.startswith("-"):
                needs.append(dependency(_cpan(k), v if v not in ("", "0") else None, scope, scope == "runtime"))
        elif not section:
            fields.setdefault(k.lower(), v)
    author = fields.get("author")
    return {
        "name": fields.get("name"), "version": fields.get("version"), "description": fields.get("abstract"), "extracted_license_statement": fields.get("license"), "holder": fields.get("copyright_holder"),
        "parties": [party("author", *person(author)[:2])] if author else [], "dependencies": needs, "extra_data": {k: fields.get(k) for k in ("copyright_holder", "copyright_year")},
    }


def _composer(full: str, version: str | None = None) -> str | None:
    namespace, _, name = full.rpartition("/")
    return purl("composer", name, version, namespace)


@reads("php_composer_json", "composer", r"(?:^|/)(?:[^/]*\.)?composer\.json$|(?:^|/)composer\.[^/]+\.json$", "json", "PHP", "Composer manifest")
def composer_json(path: str, d: dict) -> dict:
    namespace, _, name = (text_of(d.get("name")) or "").rpartition("/")
    found = []
    for section, runtime, optional in (("require", True, False), ("require-dev", False, True), ("provide", True, False), ("conflict", True, True), ("replace", True, True), ("suggest", True, True)):
        found += [dependency(_composer(k), text_of(v), section, runtime, optional, bool(re.fullmatch(r"v?\d+(?:\.\d+)+", text_of(v) or ""))) for k, v in mapping(d.get(section)).items()]
    people = [party("author", text_of(a.get("name")), text_of(a.get("email")), text_of(a.get("homepage"))) for a in listing(d.get("authors")) if isinstance(a, dict)]
    if namespace:
        people.append(party("vendor", namespace))
    stated, support, source, full = strings(d.get("license")), mapping(d.get("support")), mapping(d.get("source")), text_of(d.get("name"))
    return {
        "namespace": namespace or None, "name": name or None, "version": text_of(d.get("version")), "description": text_of(d.get("description")), "homepage_url": text_of(d.get("homepage")), "keywords": strings(d.get("keywords")), "parties": people,
        "extracted_license_statement": " OR ".join(stated) or None, "bug_tracking_url": text_of(support.get("issues")), "code_view_url": text_of(support.get("source")), "vcs_url": text_of(source.get("url")), "dependencies": found,
        "is_private": full is None, "repository_homepage_url": f"https://packagist.org/packages/{full}" if full else None, "api_data_url": f"https://packagist.org/p/packages/{full}.json" if full else None,
        "extra_data": {"type": d.get("type"), "autoload": d.get("autoload"), "repositories": d.get("repositories")},
    }


@reads("php_composer_lock", "composer", r"(?:^|/)(?:[^/]*\.)?composer\.lock$", "json", "PHP", "Composer lockfile")
def composer_lock(path: str, d: dict) -> dict:
    found = []
    for section, runtime in (("packages", True), ("packages-dev", False)):
        for p in listing(d.get(section)):
            p = mapping(p)
            full, version = text_of(p.get("name")), text_of(p.get("version"))
            dist, source = mapping(p.get("dist")), mapping(p.get("source"))
            if full:
                found.append(dependency(_composer(full, version), version, "require" if runtime else "require-dev", runtime, not runtime, True, None, {"source": source.get("reference")} if source else None, {"sha1": dist.get("shasum") or None, "download_url": dist.get("url"), "license": p.get("license")}))
    return {"dependencies": found, "extra_data": {"content_hash": d.get("content-hash"), "plugin_api_version": d.get("plugin-api-version")}}


@reads("helm_chart_yaml", "helm", names("Chart.yaml"), "yaml", "YAML", "Helm chart metadata")
def chart_yaml(path: str, d: dict) -> dict:
    found = []
    for x in listing(d.get("dependencies")):
        x = mapping(x)
        version = text_of(x.get("version"))
        exact = bool(version and re.fullmatch(r"v?\d+\.\d+\.\d+(?:[-+][\w.-]+)?", version))
        extra = {k: x.get(k) for k in ("repository", "condition", "tags", "alias", "import-values", "enabled") if x.get(k)}
        found.append(dependency(purl("helm", text_of(x.get("name")), version if exact else None), version, "dependencies", True, bool(x.get("condition") or x.get("tags")), exact, True, extra))
    people = [party("maintainer", text_of(mapping(m).get("name")), text_of(mapping(m).get("email")), text_of(mapping(m).get("url"))) for m in listing(d.get("maintainers"))]
    sources = strings(d.get("sources"))
    return {
        "name": text_of(d.get("name")), "version": text_of(d.get("version")), "description": text_of(d.get("description")), "homepage_url": text_of(d.get("home")), "vcs_url": sources[0] if sources else None, "keywords": strings(d.get("keywords")),
        "extracted_license_statement": text_of(mapping(d.get("annotations")).get("licenses")), "parties": people, "dependencies": found,
        "extra_data": {k: d.get(k) for k in ("apiVersion", "appVersion", "kubeVersion", "type", "icon", "deprecated", "annotations", "sources")},
    }


@reads("helm_chart_lock", "helm", names("Chart.lock"), "yaml", "YAML", "Helm chart lockfile")
def chart_lock(path: str, d: dict) -> dict:
    found = [dependency(purl("helm", text_of(mapping(x).get("name")), text_of(mapping(x).get("version"))), text_of(mapping(x).get("version")), "dependencies", True, False, True, True, {"repository": mapping(x).get("repository")}) for x in listing(d.get("dependencies"))]
    return {"dependencies": found, "extra_data": {"digest": text_of(d.get("digest")), "generated": text_of(d.get("generated"))}}


