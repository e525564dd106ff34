"""Swift, Dart, Haxe."""

from __future__ import annotations

import re

from .base import dependency, listing, mapping, names, party, purl, reads, strings, text_of


def _repository(url: str | None) -> tuple[str | None, str | None]:
    """namespace (host and path) and name of a repository address."""
    m = re.match(r"^(?:\w+://|git@)(?:[^@/]+@)?([^/:]+)[/:](.+?)(?:\.git)?/?$", url or "")
    if m is None:
        return None, None
    parts = m[2].split("/")
    return "/".join([m[1], *parts[:-1]]), parts[-1]


def _swift(url: str | None, identity: str | None, version: str | None) -> str | None:
    namespace, name = _repository(url)
    return purl("swift", name or identity, version, namespace)


@reads("swift_package_resolved", "swift", r"(?:^|/)\.?[Pp]ackage\.resolved$", "json", "Swift", "Swift Package.resolved lockfile")
def package_resolved(path: str, d: dict) -> dict:
    found = []
    pins = listing(mapping(d.get("object")).get("pins")) if d.get("version") == 1 else listing(d.get("pins"))
    for p in pins:
        p, state = mapping(p), mapping(mapping(p).get("state"))
        url = text_of(p.get("repositoryURL")) or (text_of(p.get("location")) if p.get("kind") == "remoteSourceControl" else None)
        version = text_of(state.get("version")) or text_of(state.get("revision"))
        u = _swift(url, text_of(p.get("package")) or text_of(p.get("identity")), version)
        if u:
            found.append(dependency(u, version, "dependencies", None, False, True, None))
    return {"dependencies": found}


@reads("swift_package_show_dependencies", "swift", r"swift-show-dependencies\.deplock$", "json", "Swift", "Swift show-dependencies deplock file")
def show_dependencies(path: str, d: dict) -> dict:
    found = []
    pending = [(x, 1) for x in listing(d.get("dependencies"))]
    while pending:
        x, level = pending.pop(0)
        x = mapping(x)
        version = text_of(x.get("version"))
        version = None if version == "unspecified" else version
        u = _swift(text_of(x.get("url")), text_of(x.get("identity")) or text_of(x.get("name")), version)
        if u:
            found.append(dependency(u, version, "dependencies", None, False, version is not None, level == 1))
        if level < 50:
            pending += [(c, level + 1) for c in listing(x.get("dependencies"))]
    return {"name": text_of(d.get("name")), "dependencies": found}


@reads("swift_package_manifest_json", "swift", r"(?:^|/)Package\.swift\.(?:json|deplock)$", "json", "Swift", "Swift manifest as JSON")
def manifest_json(path: str, d: dict) -> dict:
    found = []
    for item in listing(d.get("dependencies")):
        for source in [s for kind in ("sourceControl", "scm", "registry") for s in listing(mapping(item).get(kind))]:
            where = mapping(mapping(source).get("location"))
            remote = next(iter(listing(where.get("remote"))), None) or text_of(source.get("location"))
            url = text_of(mapping(remote).get("urlString")) or text_of(remote)
            need = mapping(source.get("requirement"))
            exact = next(iter(strings(need.get("exact"))), None)
            span = mapping(next(iter(listing(need.get("range"))), None))
            shown = exact or (f">={span.get('lowerBound')},<{span.get('upperBound')}" if span else next(iter([*strings(need.get("branch")), *strings(need.get("revision"))]), None))
            found.append(dependency(_swift(url, text_of(source.get("identity")), exact), shown, "dependencies", True, False, exact is not None))
    platforms = [mapping(p).get("platformName") for p in listing(d.get("platforms"))]
    return {"name": text_of(d.get("name")), "dependencies": found, "extra_data": {"platforms": platforms, "tools_version": mapping(d.get("toolsVersion")).get("_version")}}


def _pub(name: str, version: str | None = None) -> str | None:
    return purl("pubspec", name, version)


@reads("pubspec_yaml", "dart", names("pubspec.yaml"), "yaml", "dart", "Dart package manifest")
def pubspec(path: str, d: dict) -> dict:
    name, version = text_of(d.get("name")), text_of(d.get("version"))
    found = []
    for section, runtime in (("dependencies", True), ("dev_dependencies", False), ("dependency_overrides", True), ("environment", True)):
        for dep, spec in mapping(d.get(section)).items():
            if isinstance(spec, dict):
                wanted = text_of(spec.get("version")) or ", ".join(f"{k}: {v if not isinstance(v, dict) else next(iter(v.values()), '')}" for k, v in spec.items())
                extra = {k: v for k, v in spec.items() if k != "version"}
            else:
                wanted, extra = text_of(spec) or "", None
            exact = bool(re.fullmatch(r"\d+\.\d+\.\d+(?:[-+].*)?", wanted))
            found.append(dependency(_pub(dep, wanted if exact else None), wanted, section, runtime, not runtime, exact, True, extra))
    page = f"https://pub.dev/packages/{name}/versions/{version}" if name and version else None
    file = f"https://pub.dartlang.org/packages/{name}/versions/{version}.tar.gz" if name and version else None
    people = strings(d.get("author")) + strings(d.get("authors"))
    keep = ("publish_to", "executables", "screenshots", "funding", "false_secrets", "platforms", "issue_tracker", "documentation", "topics", "ignored_advisories")
    extra = {k: d[k] for k in keep if k in d}
    return {
        "name": name, "version": version, "description": text_of(d.get("description")), "homepage_url": text_of(d.get("homepage")), "vcs_url": text_of(d.get("repository")), "bug_tracking_url": text_of(d.get("issue_tracker")),
        "extracted_license_statement": text_of(d.get("license")), "keywords": strings(d.get("topics")), "parties": [party("author", a, type=None) for a in people], "dependencies": found, "is_private": d.get("publish_to") == "none",
        "download_url": text_of(d.get("archive_url")) or file, "repository_homepage_url": page, "repository_download_url": file, "api_data_url": page and page.replace("pub.dev/", "pub.dev/api/"), "extra_data": extra,
    }


@reads("pubspec_lock", "pubspec", names("pubspec.lock"), "yaml", "dart", "Dart lockfile")
def pubspec_lock(path: str, d: dict) -> dict:
    found = [dependency(_pub(k), text_of(v), "sdk") for k, v in mapping(d.get("sdks")).items()]
    for name, entry in mapping(d.get("packages")).items():
        entry = mapping(entry)
        version, kind = text_of(entry.get("version")), text_of(entry.get("dependency")) or ""
        extra = {k: entry.get(k) for k in ("source", "description", "dependency") if entry.get(k)}
        sha = mapping(entry.get("description")).get("sha256")
        dev = kind == "direct dev"
        found.append(dependency(_pub(name, version), version, kind or None, not dev, dev, True, kind.startswith("direct"), extra, {"type": "pubspec", "name": name, "version": version, "sha256": sha, "is_virtual": True}))
    return {"dependencies": found, "purl": None}


@reads("haxelib_json", "haxe", names("haxelib.json"), "json", "Haxe", "Haxe haxelib.json package manifest")
def haxelib(path: str, d: dict) -> dict:
    name, version = text_of(d.get("name")), text_of(d.get("version"))
    home = f"https://lib.haxe.org/p/{name}" if name else None
    file = f"{home}/{version}/download/" if home and version else None
    found = [dependency(purl("haxe", k, text_of(v)), None, None, True, False, text_of(v) is not None) for k, v in sorted(mapping(d.get("dependencies")).items())]
    return {
        "name": name, "version": version, "description": text_of(d.get("description")), "homepage_url": text_of(d.get("url")), "keywords": strings(d.get("tags")), "extracted_license_statement": text_of(d.get("license")),
        "parties": [party("contributor", c, None, f"https://lib.haxe.org/u/{c}") for c in strings(d.get("contributors"))], "dependencies": found, "download_url": file, "repository_homepage_url": home, "repository_download_url": file,
    }


