"""npm, Yarn, pnpm, Bun, Bower, Deno."""

from __future__ import annotations

import re
import struct

from .base import dependency, first, listing, mapping, names, party, person, purl, reads, sri, strings, text_of

#: Section, scope facts (runtime, optional).
_NPM_SECTIONS = (("dependencies", True, False), ("devDependencies", False, True), ("peerDependencies", True, False), ("optionalDependencies", True, True))


def npm_purl(full: str, version: str | None = None, type: str = "npm") -> str | None:  # noqa: A002
    namespace, _, name = full.rpartition("/")
    return purl(type, name, version, namespace)


def _split(full: str | None) -> tuple[str | None, str | None]:
    space, _, name = (full or "").rpartition("/")
    return space or None, name or None


def _npm_urls(full: str | None, version: str | None) -> dict:
    if not full:
        return {}
    name = full.rpartition("/")[2]
    tarball = f"https://registry.npmjs.org/{full}/-/{name}-{version}.tgz" if version else None
    api = f"https://registry.npmjs.org/{full.replace('/', '%2f')}" + (f"/{version}" if version else "")
    return {"repository_homepage_url": f"https://www.npmjs.com/package/{full}", "repository_download_url": tarball, "api_data_url": api, "download_url": tarball}


def _vcs(value: object) -> str | None:
    url = text_of(mapping(value).get("url") if isinstance(value, dict) else value)
    if url is None:
        return None
    m = re.fullmatch(r"(?:(github|gitlab|bitbucket):)?([\w.-]+/[\w.-]+)", url)
    if m:
        host = {"gitlab": "gitlab.com", "bitbucket": "bitbucket.org"}.get(m[1], "github.com")
        return f"https://{host}/{m[2]}"
    return url


def _license_text(value: object) -> list[str]:
    """Items of a license field, each as a line of a list."""
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict):
            pairs = [(k, s) for k in ("type", "name", "url") if (s := text_of(item.get(k)))]
            if pairs:
                out.append("- " + "\n  ".join(f"{k}: {v}" for k, v in pairs) + "\n")
        elif (s := text_of(item)) is not None:
            out.append(f"- {s}\n")
    return out


def _people(value: object, role: str) -> list[dict]:
    out = []
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, dict):
            name, mail, url = text_of(item.get("name")), text_of(item.get("email")), text_of(item.get("url") or item.get("web"))
        elif isinstance(item, str) and item.strip():
            name, mail, url = person(item)
        else:
            continue
        if name or mail or url:
            out.append(party(role, name, mail, url))
    return out


@reads("npm_package_json", "npm", names("package.json"), "json", "JavaScript", "npm package manifest")
def package_json(path: str, d: dict) -> dict:
    full, version = text_of(d.get("name")), text_of(d.get("version"))
    namespace, name = _split(full)
    found, optional_peers = [], {k for k, v in mapping(d.get("peerDependenciesMeta")).items() if mapping(v).get("optional") is True}
    for section, runtime, optional in _NPM_SECTIONS:
        for dep, need in sorted(mapping(d.get(section)).items()):
            found.append(dependency(npm_purl(dep), text_of(need), section, runtime, optional or (section == "peerDependencies" and dep in optional_peers)))
    for section in ("bundledDependencies", "bundleDependencies"):
        found += [dependency(npm_purl(dep), None, "bundledDependencies") for dep in strings(d.get(section))]
    bugs = d.get("bugs")
    stated = [*_license_text(d.get("license")), *_license_text(d.get("licenses"))]
    plain = strings(d.get("license"))
    extra = {k: d.get(k) for k in ("engines", "overrides", "os", "cpu", "libc", "deprecated", "hasBin", "workspaces", "packageManager", "resolutions")}
    out = {
        "namespace": namespace, "name": name, "version": version, "description": text_of(d.get("description")), "keywords": strings(d.get("keywords")),
        "homepage_url": text_of(d.get("homepage")), "bug_tracking_url": text_of(mapping(bugs).get("url") if isinstance(bugs, dict) else bugs), "vcs_url": _vcs(d.get("repository")),
        "extracted_license_statement": "".join(stated) or None, "parties": [*_people(d.get("author"), "author"), *_people(d.get("authors"), "author"), *_people(d.get("contributors"), "contributor"), *_people(d.get("maintainers"), "maintainer")],
        "dependencies": found, "is_private": d.get("private") is True, "extra_data": extra, **_npm_urls(full, version),
    }
    dist = mapping(d.get("dist"))
    if (url := text_of(dist.get("tarball"))) is not None:
        out["download_url"] = url
    for algorithm, digest in filter(None, [sri(text_of(dist.get("integrity")))]):
        out[algorithm] = digest
    if not stated or len(plain) == 1:
        from .base import license_expression

        out["declared_license_expression"], out["declared_license_expression_spdx"] = license_expression(plain[0] if plain else None)
    return out


def _is_version(spec: str | None) -> bool:
    return bool(spec and re.fullmatch(r"v?\d+(?:\.\d+)*(?:[-+][\w.+-]+)?", spec))


@reads("npm_package_lock_json", "npm", names("package-lock.json", ".package-lock.json", "npm-shrinkwrap.json"), "json", "JavaScript", "npm lockfile")
def package_lock(path: str, d: dict) -> dict:
    packages = mapping(d.get("packages"))
    root = mapping(packages.get(""))
    full, version = first(text_of(d.get("name")), text_of(root.get("name"))), first(text_of(d.get("version")), text_of(root.get("version")))
    namespace, name = _split(full)
    found: list[dict] = []

    def add(dep: str, entry: dict, direct: bool) -> None:
        spec = text_of(entry.get("version"))
        exact = _is_version(spec)
        link = entry.get("link") is True
        resolved = {k: v for k, v in (("download_url", text_of(entry.get("resolved"))), ("version", spec)) if v}
        if (digest := sri(text_of(entry.get("integrity")))) is not None:
            resolved[digest[0]] = digest[1]
        dev, optional = entry.get("dev") is True, bool(entry.get("optional") or entry.get("devOptional"))
        scope = "devDependencies" if dev else "optionalDependencies" if optional else "dependencies"
        extra = {"link": True, "resolved": text_of(entry.get("resolved"))} if link else None
        found.append(dependency(npm_purl(dep, spec if exact else None), spec, scope, not dev, optional or dev, exact, direct, extra, resolved))

    if packages:
        named = {dep for section, *_ in _NPM_SECTIONS for dep in mapping(root.get(section))}
        for place, entry in packages.items():
            if place and "node_modules/" in place:
                dep = text_of(mapping(entry).get("name")) or place.rpartition("node_modules/")[2]
                add(dep, mapping(entry), place.count("node_modules/") == 1 and dep in named)
    else:
        pending = [(dep, entry, 0) for dep, entry in mapping(d.get("dependencies")).items()]
        while pending:
            dep, entry, level = pending.pop(0)
            add(dep, mapping(entry), level == 0)
            pending += [(k, v, level + 1) for k, v in mapping(mapping(entry).get("dependencies")).items()]
    return {"namespace": namespace, "name": name, "version": version, "dependencies": found, "extra_data": {"lockfile_version": d.get("lockfileVersion")}, **_npm_urls(full, version)}


def _key_name(key: str) -> tuple[str, str]:
    """name and range of ``name@range``, also of scoped names."""
    key = key.strip().strip('"')
    at = key.find("@", 1)
    return (key, "") if at < 0 else (key[:at], key[at + 1 :])


@reads("yarn_lock", "npm", names("yarn.lock"), "text", "JavaScript", "Yarn lockfile")
def yarn_lock(path: str, text: str) -> dict:
    found, extra = [], {}
    if "__metadata:" in text:
        from .base import yaml_of

        for key, entry in mapping(yaml_of(text)).items():
            entry = mapping(entry)
            if key == "__metadata":
                extra = {"lockfile_version": entry.get("version"), "cache_key": entry.get("cacheKey")}
                continue
            name, wanted = _key_name(key.split(",")[0])
            version, resolution = text_of(entry.get("version")), text_of(entry.get("resolution"))
            locator = _key_name(resolution)[1] if resolution else ""
            registry = locator.startswith("npm:")
            more = {k: entry.get(k) for k in ("resolution", "languageName", "linkType", "bin", "dependenciesMeta") if entry.get(k)}
            found.append(dependency(npm_purl(name, version if registry else None), wanted.removeprefix("npm:") if registry else locator or wanted, "dependencies", True, False, registry, False, more))
        return {"dependencies": found, "extra_data": extra}
    for block in re.split(r"\n(?=\S)", text):
        lines = [x for x in block.splitlines() if x.strip() and not x.startswith("#")]
        if not lines or not lines[0].rstrip().endswith(":"):
            continue
        name, wanted = _key_name(lines[0].rstrip()[:-1].split(", ")[0])
        fields = dict(m.groups() for x in lines[1:] if (m := re.match(r'^  (version|resolved|integrity) "?([^"]+)"?$', x)))
        resolved = {"version": fields.get("version"), "download_url": fields.get("resolved")}
        if (digest := sri(fields.get("integrity"))) is not None:
            resolved[digest[0]] = digest[1]
        found.append(dependency(npm_purl(name, fields.get("version")), wanted, "dependencies", True, False, True, False, None, resolved))
    return {"dependencies": found, "extra_data": extra}


@reads("pnpm_lock_yaml", "npm", names("pnpm-lock.yaml", "shrinkwrap.yaml"), "yaml", "JavaScript", "pnpm lockfile")
def pnpm_lock(path: str, d: dict) -> dict:
    importers = mapping(d.get("importers")).values() or [d]
    direct = {dep for i in importers for section, *_ in _NPM_SECTIONS for dep in mapping(mapping(i).get(section))}
    found = []
    for key, entry in mapping(d.get("packages")).items():
        entry, bare = mapping(entry), key.lstrip("/").split("(")[0]
        m = re.fullmatch(r"(@[^/@]+/[^/@]+|[^/@]+)[@/](.+)", bare)
        name, version = (m[1], m[2].split("_")[0]) if m else (text_of(entry.get("name")), text_of(entry.get("version")))
        if not name:
            continue
        digest = sri(text_of(mapping(entry.get("resolution")).get("integrity")))
        dev, optional = entry.get("dev") is True, entry.get("optional") is True
        found.append(dependency(npm_purl(name, version), version, "devDependencies" if dev else None, not dev, optional, True, name in direct, None, {digest[0]: digest[1]} if digest else None))
    return {"dependencies": found, "extra_data": {"lockfile_version": text_of(d.get("lockfileVersion"))}}


@reads("pnpm_workspace_yaml", "npm", names("pnpm-workspace.yaml"), "yaml", "JavaScript", "pnpm workspace yaml file")
def pnpm_workspace(path: str, d: dict) -> dict:
    return {"extra_data": {"workspaces": strings(d.get("packages")), "catalog": d.get("catalog")}}


@reads("bun_lock", "npm", names("bun.lock"), "jsonc", "JavaScript", "Bun text lockfile")
def bun_lock(path: str, d: dict) -> dict:
    spaces = mapping(d.get("workspaces"))
    root = mapping(spaces.get(""))
    kinds = {dep: section for section, *_ in _NPM_SECTIONS for w in spaces.values() for dep in mapping(mapping(w).get(section))}
    needs = {dep: text_of(v) for section, *_ in _NPM_SECTIONS for dep, v in mapping(root.get(section)).items()}
    found = []
    for key, entry in mapping(d.get("packages")).items():
        name, version = _key_name(str(entry[0]) if isinstance(entry, list) and entry else key)
        exact, scope = _is_version(version), kinds.get(key)
        digest = sri(text_of(entry[-1])) if isinstance(entry, list) else None
        found.append(dependency(npm_purl(name, version if exact else None), needs.get(key) or version, scope, scope != "devDependencies", scope in ("devDependencies", "optionalDependencies"), exact, key in kinds, None, {digest[0]: digest[1]} if digest else None))
    namespace, name = _split(text_of(root.get("name")))
    return {"namespace": namespace, "name": name, "version": text_of(root.get("version")), "dependencies": found, "extra_data": {"lockfile_version": d.get("lockfileVersion")}}


@reads("bun_lockb", "npm", names("bun.lockb"), "bytes", "JavaScript", "Bun binary lockfile: version, and the names in its string table")
def bun_lockb(path: str, content: bytes) -> dict:
    head = b"#!/usr/bin/env bun\nbun-lockfile-format-v0\n"
    if not content.startswith(head):
        raise ValueError("no lockfile")
    version = struct.unpack_from("<I", content, len(head))[0]
    tarballs = re.findall(rb"https?://[\w./@%+-]+\.tgz", content)
    found = [dependency(npm_purl(m[1].decode(), m[2].decode()), m[2].decode(), None, True, False, True, None) for t in dict.fromkeys(tarballs) if (m := re.search(rb"/((?:@[^/]+/)?[^/]+)/-/[^/]+?-(\d[^/]*)\.tgz$", t))]
    return {"dependencies": found, "extra_data": {"lockfile_version": version}}


@reads("bower_json", "bower", names("bower.json", ".bower.json"), "json", "JavaScript", "Bower package manifest")
def bower_json(path: str, d: dict) -> dict:
    name = d.get("name") if isinstance(d.get("name"), str) else None
    people = [p for p in (_people(d.get("authors"), "author") or _people(d.get("author"), "author"))]
    found = [dependency(purl("bower", dep), text_of(need), section, section == "dependencies", section != "dependencies") for section in ("dependencies", "devDependencies") for dep, need in mapping(d.get(section)).items()]
    licenses = d.get("license")
    repository = d.get("repository")
    return {
        "name": name, "version": text_of(d.get("version")), "description": text_of(d.get("description")), "keywords": strings(d.get("keywords")), "parties": people,
        "homepage_url": text_of(d.get("homepage")), "vcs_url": _vcs(repository), "extracted_license_statement": " AND ".join(strings(licenses)) or None,
        "is_private": name is None or d.get("private") is True, "dependencies": found, "purl": None if name is None else purl("bower", name, text_of(d.get("version"))),
    }


def _specifier(spec: str) -> tuple[str | None, bool]:
    """Package URL and whether a version is exact, of an import."""
    m = re.fullmatch(r"(jsr|npm):/?((?:@[^/@]+/)?[^/@]+)(?:@([^/]+))?(?:/.*)?", spec)
    if m is None:
        return (purl("generic", spec.rpartition("/")[2], None, None, {"download_url": spec}) if re.match(r"https?://", spec) else None), False
    if m[1] == "npm":
        return npm_purl(m[2]), _is_version(m[3])
    space, _, name = m[2].rpartition("/")
    return purl("generic", name, None, f"jsr.io/{space}"), _is_version(m[3])


@reads("deno_json", "deno", names("deno.json", "deno.jsonc"), "jsonc", "TypeScript", "Deno configuration")
def deno_json(path: str, d: dict) -> dict:
    namespace, name = _split(text_of(d.get("name")))
    version = text_of(d.get("version"))
    found = [dependency(u, spec, "imports", True, False, exact, True, {"import_alias": alias}) for alias, spec in mapping(d.get("imports")).items() if isinstance(spec, str) for u, exact in [_specifier(spec)]]
    extra = {k: d.get(k) for k in ("exports", "importMap", "scopes", "links", "tasks", "lock", "nodeModulesDir", "workspace")}
    return {"namespace": namespace, "name": name, "version": version, "dependencies": found, "extra_data": extra, "purl": purl("generic", name, version, namespace)}


@reads("deno_lock", "deno", names("deno.lock"), "json", "TypeScript", "Deno lockfile")
def deno_lock(path: str, d: dict) -> dict:
    found = []
    direct = {str(x) for x in listing(mapping(d.get("workspace")).get("dependencies"))}
    for kind in ("jsr", "npm"):
        for key, entry in mapping(d.get(kind)).items():
            name, version = _key_name(key)
            version = version.split("_")[0]
            own = any(x.startswith(f"{kind}:{name}@") or x == f"{kind}:{name}" for x in direct)
            url = npm_purl(name, version) if kind == "npm" else purl("generic", name.rpartition("/")[2], version, "jsr.io/" + name.rpartition("/")[0])
            found.append(dependency(url, version, "dependencies", True, False, True, own, None, {"integrity": mapping(entry).get("integrity")}))
    for url, digest in mapping(d.get("remote")).items():
        found.append(dependency(purl("generic", url.rpartition("/")[2] or url, None, None, {"download_url": url}), url, "remote", True, False, True, None, None, {"sha256": digest}))
    return {"dependencies": found, "extra_data": {"lockfile_version": text_of(d.get("version"))}}


