"""NuGet: specifications, project files, package lists and locks, central versions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from .base import child_text, dependency, first, mapping, names, party, purl, reads, strings, text_of


def nuget(name: str | None, version: str | None = None) -> str | None:
    return purl("nuget", name, version)


def nuget_urls(name: str | None, version: str | None) -> dict:
    if not name:
        return {}
    tail = f"/{version}" if version else ""
    return {
        "repository_homepage_url": f"https://www.nuget.org/packages/{name}{tail}", "repository_download_url": f"https://www.nuget.org/api/v2/package/{name}{tail}" if version else None,
        "api_data_url": f"https://api.nuget.org/v3/registration3/{name.lower()}/{version}.json" if version else None,
    }


def nuspec_row(root: ET.Element) -> dict:
    m = root.find("metadata") if root.tag != "metadata" else root
    get = lambda *k: child_text(m, *k)
    name, version = get("id"), get("version")
    found = []
    for e in m.findall("dependencies/dependency"):
        found.append(dependency(nuget(e.get("id")), e.get("version"), "dependency"))
    for g in m.findall("dependencies/group"):
        for e in g.findall("dependency"):
            extra = {k: v for k, v in (("framework", g.get("targetFramework")), ("include", e.get("include")), ("exclude", e.get("exclude"))) if v}
            found.append(dependency(nuget(e.get("id")), e.get("version"), "dependency", extra=extra))
    stated, repository = m.find("license"), m.find("repository")
    url = repository.get("url") if repository is not None else None
    vcs = f"{repository.get('type')}+{url}" if url and repository.get("type") else url
    texts = [get("title") if get("title") != name else None, get("summary"), get("description")]
    return {
        "name": name, "version": version, "description": "\n".join(dict.fromkeys(t for t in texts if t)) or None, "homepage_url": get("projectUrl"), "copyright": get("copyright"), "vcs_url": vcs,
        "extracted_license_statement": first(stated.text.strip() if stated is not None and stated.text else None, get("licenseUrl")),
        "parties": [party(role, value) for role, value in (("author", get("authors")), ("owner", get("owners"))) if value], "dependencies": found,
        "extra_data": {
            "license_type": stated.get("type") if stated is not None else None, "license_file": stated.text if stated is not None and stated.get("type") == "file" else None,
            "repository_branch": repository.get("branch") if repository is not None else None, "repository_commit": repository.get("commit") if repository is not None else None, "readme_file": get("readme"), "tags": (get("tags") or "").split(),
        }, **nuget_urls(name, version),
    }


@reads("nuget_nupsec", "nuget", r"\.nuspec$", "xml", None, "NuGet specification")
def nuspec(path: str, root: ET.Element) -> dict:
    return nuspec_row(root)


def _condition(e: ET.Element) -> str | None:
    return e.get("Condition")


@reads("nuget_csproj", "nuget", r"\.(?:cs|vb|fs)proj$", "xml", None, "Project file with package references")
def csproj(path: str, root: ET.Element) -> dict:
    values = {e.tag: (e.text or "").strip() for g in root.findall("PropertyGroup") for e in g if e.text and e.text.strip()}
    fill = lambda s: re.sub(r"\$\((\w+)\)", lambda m: values.get(m[1], m[0]), s) if s else s
    found = []
    for group in root.findall("ItemGroup"):
        for e in group.findall("PackageReference"):
            name = e.get("Include") or e.get("Update")
            wanted = fill(e.get("Version") or child_text(e, "Version"))
            override = fill(e.get("VersionOverride") or child_text(e, "VersionOverride"))
            private = "all" in (e.get("PrivateAssets") or child_text(e, "PrivateAssets") or "").lower()
            extra = {k: v for k, v in (("version_override", override), ("condition", first(_condition(e), _condition(group))), ("private_assets", private)) if v}
            found.append(dependency(nuget(name), wanted, None, not private, False, False, True, extra))
    name = first(*(fill(values.get(k)) for k in ("PackageId", "AssemblyName")), re.sub(r"\.\w+$", "", path.rpartition("/")[2]))
    version = first(*(fill(values.get(k)) for k in ("Version", "PackageVersion", "VersionPrefix")))
    url = values.get("RepositoryUrl")
    expression, file = values.get("PackageLicenseExpression"), values.get("PackageLicenseFile")
    return {
        "name": name, "version": version, "description": first(values.get("Description"), values.get("PackageDescription")), "homepage_url": values.get("PackageProjectUrl"), "copyright": values.get("Copyright"),
        "vcs_url": f"{values['RepositoryType']}+{url}" if url and values.get("RepositoryType") else url, "extracted_license_statement": first(expression, file, values.get("PackageLicenseUrl")),
        "keywords": [k for k in re.split(r"[;\s]+", values.get("PackageTags", "")) if k], "parties": [party("author", values["Authors"])] if values.get("Authors") else [], "dependencies": found,
        "extra_data": {
            "license_type": "expression" if expression else "file" if file else None, "repository_branch": values.get("RepositoryBranch"), "repository_commit": values.get("RepositoryCommit"),
            "readme_file": values.get("PackageReadmeFile"), "icon_file": values.get("PackageIcon"), "target_framework": first(values.get("TargetFramework"), values.get("TargetFrameworks")),
        }, **nuget_urls(name, version),
    }


@reads("nuget_packages_config", "nuget", names("packages.config"), "xml", None, "NuGet package list")
def packages_config(path: str, root: ET.Element) -> dict:
    found = []
    for e in root.findall("package"):
        dev = e.get("developmentDependency") == "true"
        found.append(dependency(nuget(e.get("id"), e.get("version")), e.get("version"), e.get("targetFramework"), not dev, dev, True))
    return {"dependencies": found}


@reads("nuget_packages_lock", "nuget", names("packages.lock.json"), "json", None, "NuGet lockfile")
def packages_lock(path: str, d: dict) -> dict:
    found = []
    for framework, packages in mapping(d.get("dependencies")).items():
        for name, entry in mapping(packages).items():
            version, kind = text_of(mapping(entry).get("resolved")), text_of(mapping(entry).get("type"))
            found.append(dependency(nuget(name, version), text_of(mapping(entry).get("requested")) or version, framework, True, False, True, kind == "Direct", {"type": kind, "content_hash": mapping(entry).get("contentHash")}))
    return {"dependencies": found, "extra_data": {"lock_version": d.get("version")}}


@reads("nuget_project_json", "nuget", names("project.json"), "json", None, "Legacy NuGet project")
def project_json(path: str, d: dict) -> dict:
    found = []
    for scope, table in [(None, d.get("dependencies")), *((f, mapping(x).get("dependencies")) for f, x in mapping(d.get("frameworks")).items())]:
        for name, spec in mapping(table).items():
            wanted = text_of(spec) or text_of(mapping(spec).get("version"))
            found.append(dependency(nuget(name), wanted, scope, extra={k: v for k, v in mapping(spec).items() if k != "version"}))
    name, version = text_of(d.get("title") or d.get("name")), text_of(d.get("version"))
    return {
        "name": name, "version": version, "description": text_of(d.get("description")), "homepage_url": text_of(d.get("projectUrl")), "extracted_license_statement": text_of(d.get("licenseUrl")),
        "parties": [party("author", a) for a in strings(d.get("authors"))], "dependencies": found, **nuget_urls(name, version),
    }


@reads("nuget_project_lock_json", "nuget", names("project.lock.json"), "json", None, "Legacy NuGet project lock")
def project_lock(path: str, d: dict) -> dict:
    found = []
    for group, items in mapping(d.get("projectFileDependencyGroups")).items():
        for item in strings(items):
            name, _, wanted = item.partition(" ")
            found.append(dependency(nuget(name), wanted or None, group or None))
    return {"dependencies": found}


@reads("nuget_deps_json", "nuget", r"\.deps\.json$", "json", None, "Dependencies of a built .NET application")
def deps_json(path: str, d: dict) -> dict:
    libraries = mapping(d.get("libraries"))
    own = next((k for k, v in libraries.items() if mapping(v).get("type") == "project"), None)
    name, _, version = (own or "").partition("/")
    target = mapping(first(*mapping(d.get("targets")).values()))
    direct = set(mapping(mapping(target.get(own)).get("dependencies")))
    found = []
    for key, entry in libraries.items():
        n, _, v = key.partition("/")
        if key != own:
            kind = mapping(entry).get("type")
            found.append(dependency(nuget(n, v), v, text_of(mapping(d.get("runtimeTarget")).get("name")), True, False, True, n in direct, {"type": kind}, {"sha512": mapping(entry).get("sha512") or None}))
    return {"name": name or None, "version": version or None, "dependencies": found}


def _props(root: ET.Element) -> tuple[dict, list[dict]]:
    values = {e.tag: (e.text or "").strip() for g in root.findall("PropertyGroup") for e in g}
    fill = lambda s: re.sub(r"\$\((\w+)\)", lambda m: values.get(m[1], m[0]), s) if s else s
    found = []
    for group in root.findall("ItemGroup"):
        for tag in ("PackageVersion", "GlobalPackageReference", "PackageReference"):
            for e in group.findall(tag):
                condition = first(_condition(e), _condition(group))
                found.append(dependency(nuget(e.get("Include") or e.get("Update")), fill(e.get("Version") or child_text(e, "Version")), tag, extra={"condition": condition} if condition else None))
    return values, found


@reads("nuget_directory_packages_props", "nuget", names("Directory.Packages.props"), "xml", None, "Central package versions")
def packages_props(path: str, root: ET.Element) -> dict:
    values, found = _props(root)
    return {"dependencies": found, "extra_data": {"manage_centrally": values.get("ManagePackageVersionsCentrally"), "transitive_pinning": values.get("CentralPackageTransitivePinningEnabled")}, "purl": None}


@reads("nuget_directory_build_props", "nuget", names("Directory.Build.props"), "xml", None, "Properties shared by projects")
def build_props(path: str, root: ET.Element) -> dict:
    values, found = _props(root)
    return {"dependencies": found, "extra_data": {"properties": values}, "purl": None}
