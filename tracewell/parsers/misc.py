"""Small manifests: ABOUT files, third-party READMEs, Autotools, Git submodules."""

from __future__ import annotations

import configparser
import re

from .base import dependency, first, listing, mapping, names, party, purl, reads, strings, text_of, yaml_of  # noqa: F401


def purl_of_url(url: str | None) -> dict:
    """Identity that a download address shows: type, namespace, name, version."""
    for pattern, kind in (
        (r"https?://registry\.npmjs\.org/(?:(@[^/]+)/)?([^/]+)/-/[^/]+?-(\d[^/]*)\.tgz", "npm"),
        (r"https?://(?:files\.pythonhosted\.org|pypi\.(?:org|python\.org))/packages/(?:source/)?(?:.*/)?()([^/]+?)-(\d[^/-]*)(?:-[^/]*\.whl|\.tar\.gz|\.zip)", "pypi"),
        (r"https?://rubygems\.org/(?:downloads|gems)/()([^/]+?)-(\d[^/]*)\.gem", "gem"),
        (r"https?://github\.com/([^/]+)/([^/]+)/(?:archive/(?:refs/tags/)?|releases/download/)v?([^/]+?)(?:\.zip|\.tar\.gz|/.*)", "github"),
        (r"https?://(?:repo1?\.maven\.org/maven2|repo\.maven\.apache\.org/maven2|repo1\.maven\.org/maven2)/(.+)/([^/]+)/([^/]+)/[^/]+\.(?:jar|war|pom)", "maven"),
    ):
        m = re.match(pattern, url or "")
        if m:
            return {"type": kind, "namespace": (m[1] or "").replace("/", "." if kind == "maven" else "/") or None, "name": m[2], "version": m[3]}
    return {}


@reads("about_file", "about", r"(?i)\.about$", "yaml", None, "ABOUT file")
def about_file(path: str, d: dict) -> dict:
    given = text_of(d.get("purl") or d.get("package_url"))
    m = re.match(r"pkg:([^/]+)/(?:(.+)/)?([^/@?#]+)(?:@([^?#]+))?", given or "")
    found = {"type": m[1], "namespace": m[2], "name": m[3], "version": m[4]} if m else purl_of_url(text_of(d.get("download_url")))
    kind = found.get("type") or text_of(d.get("type"))
    name, version = first(text_of(d.get("name")), found.get("name")), first(text_of(d.get("version")), found.get("version"))
    files = [f for k in ("about_resource", "license_file", "notice_file") for f in strings(d.get(k))]
    for item in listing(d.get("licenses")):
        files += strings(mapping(item).get("file"))
    owner = text_of(d.get("owner"))
    return {
        "type": kind or "about", "namespace": first(found.get("namespace"), text_of(d.get("namespace"))), "name": name, "version": version, "description": text_of(d.get("description")), "homepage_url": first(text_of(d.get("homepage_url")), text_of(d.get("home_url"))),
        "download_url": text_of(d.get("download_url")), "vcs_url": text_of(d.get("vcs_url")), "copyright": text_of(d.get("copyright")), "notice_text": text_of(d.get("notice")), "extracted_license_statement": text_of(d.get("license_expression")),
        "parties": [party("owner", owner)] if owner else [], "file_references": [{"path": f} for f in dict.fromkeys(files)],
        "purl": given or (purl(kind, found.get("name") or name, version, found.get("namespace")) if kind and kind != "about" else None),
    }


#: Fields by the lower-cased keys that name them.
_README_KEYS = {"name": "name", "project": "name", "short name": "name", "version": "version", "copyright": "copyright", "download link": "download_url", "downloaded from": "download_url", "homepage": "homepage_url", "website": "homepage_url", "repo": "homepage_url", "source": "homepage_url", "upstream": "homepage_url", "url": "homepage_url", "license": "extracted_license_statement", "licence": "extracted_license_statement"}


@reads("readme", "readme", r"(?i)(?:^|/)readme\.(?:android|chromium|facebook|google|thirdparty)$", "text", None, "Third-party attribution README files")
def readme(path: str, text: str) -> dict:
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*([^:=]+?)\s*[:=]\s*(.*?)\s*$", line)
        field = _README_KEYS.get(m[1].lower()) if m else None
        if field and m[2]:
            out[field] = m[2]
    if "name" not in out and "/" in path:
        out["name"] = path.split("/")[-2]
    return {**out, "purl": None}


@reads("autotools_configure", "autotools", names("configure", "configure.ac"), "none", None, "Autotools configure script")
def autotools(path: str, _: None) -> dict:
    return {"name": path.split("/")[-2] if "/" in path else None}


def _repository_purl(url: str) -> str | None:
    m = re.match(r"^(?:https?://|git://|ssh://git@|git@)(?:[^@/]+@)?([^/:]+)[/:](.+?)(?:\.git)?/?$", url)
    kind = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}.get(m[1]) if m else None
    if kind is None:
        return None
    namespace, _, name = m[2].rpartition("/")
    return purl(kind, name.lower() if kind != "gitlab" else name, None, namespace.lower() if kind != "gitlab" else namespace)


@reads("gitmodules", "git", names(".gitmodules"), "text", None, "Git submodules manifest")
def gitmodules(path: str, text: str) -> dict:
    c = configparser.RawConfigParser(strict=False)
    c.read_string("\n".join(x.strip() for x in text.splitlines()))
    found = []
    for section in c.sections():
        url = c.get(section, "url", fallback=None)
        if section.startswith("submodule"):
            extra = {k: v for k, v in c.items(section) if v}
            found.append(dependency(_repository_purl(url) if url else None, url, "runtime", True, False, False, True, extra))
    return {"dependencies": found, "purl": None}


