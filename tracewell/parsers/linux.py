"""Distribution packages: Debian, Alpine, Arch, RPM, FreeBSD, os-release, Docker, Windows manifests."""

from __future__ import annotations

import base64
import re
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
from pathlib import Path

from .base import dependency, first, logical_lines, mapping, names, party, person, purl, reads, stanzas, strings, text_of, yaml_of  # noqa: F401

# Debian ------------------------------------------------------------------------------------------------------------

_DEBIAN_NEEDS = (("depends", True, False), ("pre-depends", True, False), ("recommends", True, True), ("suggests", True, True), ("breaks", False, False), ("conflicts", False, False), ("replaces", False, False), ("provides", False, False), ("build-depends", False, False), ("build-depends-indep", False, False), ("build-conflicts", False, False))


def _space(path: str, fields: dict) -> str:
    return "ubuntu" if "ubuntu" in (fields.get("version", "") + fields.get("maintainer", "")).lower() else "debian"


def deb(name: str | None, version: str | None, space: str, arch: str | None = None) -> str | None:
    return purl("deb", name, version, space, {"arch": arch} if arch and arch != "all" else None)


def debian_needs(f: dict, space: str) -> list[dict]:
    found = []
    for field, runtime, optional in _DEBIAN_NEEDS:
        for group in f.get(field, "").split(","):
            choices = [c.strip() for c in group.split("|") if c.strip()]
            for choice in choices:
                m = re.match(r"([\w.+-]+)(?::\w+)?\s*(?:\(([^)]*)\))?\s*(?:\[([^\]]*)\])?", choice)
                if m and not choice.startswith("$"):
                    exact = re.fullmatch(r"=\s*(\S+)", m[2] or "")
                    extra = {k: v for k, v in (("architectures", m[3]), ("alternatives", len(choices) > 1)) if v}
                    found.append(dependency(deb(m[1], exact[1] if exact else None, space), m[2], field, runtime, optional or len(choices) > 1, bool(exact), True, extra))
    return found


def debian_row(f: dict, path: str = "") -> dict:
    space = _space(path, f)
    name, version, arch = first(f.get("package"), f.get("source")), f.get("version"), f.get("architecture")
    source = re.match(r"([\w.+-]+)(?:\s*\(([^)]+)\))?", f.get("source", "")) if f.get("package") else None
    people = [party(role, *person(v)[:2]) for role, v in (("maintainer", f.get("maintainer")), ("original-maintainer", f.get("original-maintainer"))) if v]
    people += [party("uploader", *person(u)[:2]) for u in f.get("uploaders", "").split(",") if u.strip()]
    size = f.get("installed-size", "")
    return {
        "namespace": space, "name": name, "version": version, "qualifiers": {"arch": arch} if arch and arch != "all" else None, "description": f.get("description"), "homepage_url": f.get("homepage"),
        "vcs_url": f.get("vcs-git"), "code_view_url": f.get("vcs-browser"), "keywords": [f["section"]] if f.get("section") else [], "parties": people, "dependencies": debian_needs(f, space),
        "source_packages": [deb(source[1], source[2] or version, space)] if source else [], "purl": deb(name, version, space, arch),
        "extra_data": {"status": f.get("status"), "multi_arch": f.get("multi-arch"), "priority": f.get("priority"), "installed_size_kb": int(size) if size.isdigit() else None, "essential": f.get("essential")},
    }


@reads("debian_control_in_source", "deb", r"(?:^|/)debian/control$", "text", None, "Control file of a Debian source tree")
def debian_control(path: str, text: str) -> list[dict]:
    found = stanzas(text)
    source = next((f for f in found if "source" in f and "package" not in f), {})
    rows = []
    for f in found:
        whole = f if f is source else {**{k: source[k] for k in ("maintainer", "homepage", "section", "priority", "vcs-git", "vcs-browser", "source") if k in source}, **f}
        rows.append(debian_row(whole, path))
    return rows


@reads("debian_control_extracted_deb", "deb", r"control\.tar\.(?:gz|xz)-extract/control$", "text", None, "Control file of an extracted Debian package")
def debian_control_extracted(path: str, text: str) -> dict:
    return debian_row(stanzas(text)[0], path)


@reads("debian_installed_status_db", "deb", r"(?:^|/)var/lib/dpkg/status$", "text", None, "Installed Debian packages")
def debian_status(path: str, text: str) -> list[dict]:
    return [debian_row(f, path) for f in stanzas(text) if "package" in f]


@reads("debian_distroless_installed_db", "deb", r"(?:^|/)var/lib/dpkg/status\.d/[^/]+(?<!\.md5sums)$", "text", None, "Installed package of a distroless image")
def debian_distroless(path: str, text: str) -> dict:
    return debian_row(stanzas(text)[0], path)


def _owner_of(path: str) -> dict:
    base = re.sub(r"\.(?:list|md5sums)$", "", path.rpartition("/")[2])
    name, _, arch = base.partition(":")
    return {"namespace": "debian", "name": name, "qualifiers": {"arch": arch} if arch else None, "purl": deb(name, None, "debian", arch or None)}


@reads("debian_installed_files_list", "deb", r"(?:^|/)var/lib/dpkg/info/[^/]+\.list$", "text", None, "Files of an installed Debian package")
def debian_list(path: str, text: str) -> dict:
    return {**_owner_of(path), "file_references": [{"path": x.strip()} for x in text.splitlines() if x.strip() not in ("", "/.")]}


def _md5_files(text: str) -> list[dict]:
    return [{"path": m[2].lstrip("./"), "md5": m[1]} for line in text.splitlines() if (m := re.match(r"([0-9a-f]{32})\s+\*?(.+)$", line))]


@reads("debian_installed_md5sums", "deb", r"(?:^|/)var/lib/dpkg/(?:info|status\.d)/[^/]+\.md5sums$", "text", None, "Checksums of an installed Debian package")
def debian_md5(path: str, text: str) -> dict:
    return {**_owner_of(path), "file_references": _md5_files(text)}


@reads("debian_md5sums_in_extracted_deb", "deb", r"control\.tar\.(?:gz|xz)-extract/md5sums$", "text", None, "Checksums in an extracted Debian package")
def debian_md5_extracted(path: str, text: str) -> dict:
    m = re.search(r"/([\w.+-]+)_([^/_]+)_([^/_]+)\.deb-extract/", path)
    own = {"namespace": "debian", "name": m[1], "version": m[2], "purl": deb(m[1], m[2], "debian", m[3])} if m else {}
    return {**own, "file_references": _md5_files(text)}


@reads("debian_copyright", "deb", r"(?:^|/)debian/copyright$|(?:^|/)usr/share/doc/[^/]+/copyright$", "text", None, "Debian copyright file")
def debian_copyright(path: str, text: str) -> dict:
    m = re.search(r"usr/share/doc/([^/]+)/copyright$", path)
    found = stanzas(text)
    own = {"namespace": "debian", "name": m[1] if m else None, "purl": deb(m[1], None, "debian") if m else None}
    if not found or "format" not in found[0]:
        return {**own, "notice_text": text.strip() or None}
    licenses = list(dict.fromkeys(f["license"].split("\n")[0] for f in found if f.get("files") and f.get("license")))
    holders = list(dict.fromkeys(x for f in found if f.get("files") for x in f.get("copyright", "").split("\n") if x.strip()))
    return {
        **own, "homepage_url": found[0].get("source"), "extracted_license_statement": " AND ".join(licenses) or None, "copyright": "\n".join(holders) or None,
        "parties": [party("upstream-contact", *person(found[0]["upstream-contact"])[:2])] if found[0].get("upstream-contact") else [], "extra_data": {"upstream_name": found[0].get("upstream-name")},
    }


@reads("debian_source_control_dsc", "deb", r"\.dsc$", "text", None, "Debian source control")
def debian_dsc(path: str, text: str) -> dict:
    body = re.sub(r"-----BEGIN PGP SIGNED MESSAGE-----\n(?:Hash:.*\n)?\n?|-----BEGIN PGP SIGNATURE-----.*", "", text, flags=re.S)
    f = stanzas(body)[0]
    files = [x.split() for x in f.get("checksums-sha256", "").split("\n") if len(x.split()) == 3]
    return {**debian_row({**f, "package": "", "architecture": ""}, path), "file_references": [{"path": n, "size": int(s), "sha256": h} for h, s, n in files]}


def _archive_name(path: str, ending: str) -> dict:
    m = re.match(rf"(.+?)_([^_]+?)(?:_([^_]+))?{ending}$", path.rpartition("/")[2])
    if m is None:
        raise ValueError("no package name")
    space = "ubuntu" if "ubuntu" in m[2] else "debian"
    return {"namespace": space, "name": m[1], "version": m[2], "qualifiers": {"arch": m[3]} if m[3] else None, "purl": deb(m[1], m[2], space, m[3])}


@reads("debian_original_source_tarball", "deb", r"\.orig\.tar\.(?:gz|xz|bz2)$", "none", None, "Upstream source archive of a Debian package")
def debian_orig(path: str, _: None) -> dict:
    return _archive_name(path, r"\.orig\.tar\.\w+")


@reads("debian_source_metadata_tarball", "deb", r"\.debian\.tar\.(?:gz|xz|bz2)$", "none", None, "Debian changes to a source archive")
def debian_tar(path: str, _: None) -> dict:
    return _archive_name(path, r"\.debian\.tar\.\w+")


# Alpine and Arch ---------------------------------------------------------------------------------------------------


def apk(name: str | None, version: str | None = None, arch: str | None = None) -> str | None:
    return purl("apk", name, version, "alpine", {"arch": arch} if arch else None)


def _apk_sha1(text: str) -> str | None:
    return base64.b64decode(text[2:]).hex() if text.startswith("Q1") else text or None


def _apk_needs(items: list[str], scope: str | None, runtime: bool = True) -> list[dict]:
    found = []
    for item in items:
        m = re.match(r"!?([^<>=~]+)([<>=~].*)?$", item)
        if m:
            exact = re.fullmatch(r"=(.+)", m[2] or "")
            found.append(dependency(apk(m[1].strip(), exact[1] if exact else None), m[2], scope, runtime, False, bool(exact)))
    return found


@reads("alpine_installed_db", "alpine", r"(?:^|/)lib/apk/db/installed$", "text", None, "Installed Alpine packages")
def alpine_installed(path: str, text: str) -> list[dict]:
    rows = []
    for block in re.split(r"\n\s*\n", text.strip()):
        one: dict[str, str] = {}
        folder, files = "", []
        for line in block.splitlines():
            k, _, v = line.partition(":")
            if k == "F":
                folder = v
            elif k == "R":
                files.append({"path": f"{folder}/{v}" if folder else v})
            elif k == "Z" and files:
                files[-1]["sha1"] = _apk_sha1(v)
            elif len(k) == 1:
                one[k] = v
        name, version, arch = one.get("P"), one.get("V"), one.get("A")
        if not name:
            continue
        maintainer = person(one["m"]) if one.get("m") else None
        rows.append({
            "namespace": "alpine", "name": name, "version": version, "description": one.get("T"), "homepage_url": one.get("U"), "extracted_license_statement": one.get("L"), "sha1": _apk_sha1(one.get("C", "")),
            "size": int(one["S"]) if one.get("S", "").isdigit() else None, "qualifiers": {"arch": arch} if arch else None, "parties": [party("maintainer", *maintainer[:2])] if maintainer else [],
            "dependencies": _apk_needs(one.get("D", "").split(), "install"), "file_references": files, "source_packages": [apk(one["o"], version)] if one.get("o") else [], "purl": apk(name, version, arch),
            "extra_data": {"providers": one.get("p", "").split(), "provider_priority": one.get("k"), "commit": one.get("c"), "installed_size": one.get("I"), "build_timestamp": one.get("t")},
        })
    return rows


def shell_values(text: str) -> dict[str, str]:
    """Assignments of a shell file with quotes taken off and plain references to earlier ones filled in."""
    values: dict[str, str] = {}
    for m in re.finditer(r"""(?m)^\s*(?:export\s+)?([A-Za-z_]\w*)=("(?:\\.|[^"\\])*"|'[^']*'|\([^)]*\)|[^\s#;]*)""", text):
        raw = m[2]
        body = raw[1:-1] if raw[:1] in "\"'(" and raw else raw
        if not raw.startswith("'"):
            body = re.sub(r"\$\{?(\w+)\}?", lambda r: values.get(r[1], r[0]), body)
        values[m[1]] = re.sub(r"\s+", " ", body).strip()
    return values


@reads("alpine_apkbuild", "alpine", names("APKBUILD"), "text", None, "Alpine build script, read without running it")
def apkbuild(path: str, text: str) -> dict:
    v = shell_values(text)
    version = f"{v['pkgver']}-r{v['pkgrel']}" if v.get("pkgver") and v.get("pkgrel") else v.get("pkgver")
    who = re.search(r"(?m)^#\s*Maintainer:\s*(.+)$", text)
    sums = [line.split() for line in re.sub(r"^\s+", "", v.get("sha512sums", "")).split("  ")]
    return {
        "namespace": "alpine", "name": v.get("pkgname"), "version": version, "description": v.get("pkgdesc"), "homepage_url": v.get("url"), "extracted_license_statement": v.get("license"),
        "parties": [party("maintainer", *person(who[1])[:2])] if who else [], "dependencies": [*_apk_needs(v.get("depends", "").split(), "depends"), *_apk_needs(v.get("makedepends", "").split(), "makedepends", False)],
        "purl": apk(v.get("pkgname"), version), "extra_data": {"sources": v.get("source", "").split(), "checksums": len(sums) if v.get("sha512sums") else None},
    }


def arch_row(f: dict[str, list[str]], datasource: str) -> dict:
    one = lambda k: first(*f.get(k, []))
    name = one("pkgname") or one("pkgbase")
    version = one("pkgver")
    if version and one("pkgrel"):
        version = f"{one('epoch')}:{version}-{one('pkgrel')}" if one("epoch") else f"{version}-{one('pkgrel')}"
    found = []
    for field, runtime, optional in (("depends", True, False), ("depend", True, False), ("optdepends", True, True), ("optdepend", True, True), ("makedepends", False, False), ("makedepend", False, False), ("checkdepends", False, True), ("checkdepend", False, True)):
        for item in f.get(field, []):
            m = re.match(r"([^<>=:\s]+)\s*([<>=]+[^:\s]+)?", item)
            if m:
                exact = re.fullmatch(r"=(.+)", m[2] or "")
                found.append(dependency(purl("alpm", m[1], exact[1] if exact else None, "arch"), m[2], field, runtime, optional, bool(exact)))
    packager = person(one("packager")) if one("packager") else None
    return {
        "datasource_id": datasource, "namespace": "arch", "name": name, "version": version, "description": one("pkgdesc"), "homepage_url": one("url"), "extracted_license_statement": " AND ".join(f.get("license", [])) or None,
        "dependencies": found, "parties": [party("packager", *packager[:2])] if packager else [], "purl": purl("alpm", name, version, "arch", {"arch": one("arch")} if len(f.get("arch", [])) == 1 and one("arch") != "any" else None),
        "extra_data": {"arch": f.get("arch"), "source": f.get("source"), "provides": f.get("provides"), "conflicts": f.get("conflicts")},
    }


def _equals(text: str) -> list[tuple[str, str]]:
    return [(m[1], m[2].strip()) for line in text.splitlines() if (m := re.match(r"\s*([\w-]+)\s*=\s*(.*)$", line)) and not line.lstrip().startswith("#")]


def _grouped(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, v in pairs:
        if v:
            out.setdefault(k, []).append(v)
    return out


def _srcinfo(text: str, datasource: str) -> list[dict]:
    base, rows, now = [], [], None
    for k, v in _equals(text):
        if k == "pkgname":
            now = [(k, v)]
            rows.append(now)
        else:
            (base if now is None else now).append((k, v))
    common = _grouped(base)
    return [arch_row({**common, **_grouped(r)}, datasource) for r in rows] or [arch_row(common, datasource)]


@reads("arch_srcinfo", "alpm", names(".SRCINFO"), "text", None, "Arch source information")
def arch_srcinfo(path: str, text: str) -> list[dict]:
    return _srcinfo(text, "arch_srcinfo")


@reads("arch_aurinfo", "alpm", names(".AURINFO"), "text", None, "Arch user repository information")
def arch_aurinfo(path: str, text: str) -> list[dict]:
    return _srcinfo(text, "arch_aurinfo")


@reads("arch_pkginfo", "alpm", names(".PKGINFO"), "text", None, "Arch package information")
def arch_pkginfo(path: str, text: str) -> dict:
    return arch_row(_grouped(_equals(text)), "arch_pkginfo")


# RPM ---------------------------------------------------------------------------------------------------------------


def rpm(name: str | None, version: str | None = None, arch: str | None = None, space: str | None = None, epoch: str | None = None) -> str | None:
    return purl("rpm", name, version, space, {k: v for k, v in (("arch", arch), ("epoch", epoch)) if v} or None)


#: Tags of a package header.
_TAGS = {1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1004: "summary", 1005: "description", 1009: "size", 1010: "distribution", 1011: "vendor", 1014: "license", 1015: "packager", 1016: "group", 1020: "url", 1022: "arch", 1044: "source_rpm", 1047: "provides", 1048: "require_flags", 1049: "requires", 1050: "require_versions", 1090: "obsoletes", 1116: "dir_indexes", 1117: "base_names", 1118: "dir_names"}


def rpm_header(blob: bytes) -> dict:
    """Fields of a header: index count, store size, then entries (tag, type, offset, count) and the store."""
    entries, size = struct.unpack_from(">II", blob, 0)
    if entries > 65_535 or 8 + 16 * entries + size > len(blob):
        raise ValueError("broken header")
    store = blob[8 + 16 * entries : 8 + 16 * entries + size]
    out: dict = {}
    for k in range(entries):
        tag, kind, at, n = struct.unpack_from(">IIII", blob, 8 + 16 * k)
        if tag not in _TAGS or n > 1_000_000:
            continue
        if kind == 4:
            out[_TAGS[tag]] = list(struct.unpack_from(f">{n}I", store, at))
        elif kind in (6, 8, 9):
            end, found = at, []
            for _ in range(n):
                stop = store.index(b"\0", end)
                found.append(store[end:stop].decode("utf-8", "replace"))
                end = stop + 1
            out[_TAGS[tag]] = found[0] if kind != 8 and found else found
    return out


_SENSE = {2: "<", 4: ">", 8: "=", 10: "<=", 12: ">="}


def rpm_row(h: dict, files: bool = True) -> dict:
    one = lambda k: h[k][0] if isinstance(h.get(k), list) and h[k] else h.get(k)
    name, epoch = one("name"), one("epoch")
    version = "-".join(str(x) for x in (one("version"), one("release")) if x) or None
    low = " ".join(str(one(k) or "") for k in ("vendor", "distribution", "packager")).lower()
    space = next((s for s in ("fedora", "centos", "opensuse", "suse", "redhat", "mageia", "mariner", "amazon", "oracle") if s in low.replace(" ", "")), None)
    found = []
    for n, flag, v in zip(h.get("requires", []), h.get("require_flags", []) or [0] * len(h.get("requires", [])), h.get("require_versions", []) or [""] * len(h.get("requires", [])), strict=False):
        if not n.startswith("rpmlib("):
            sense = _SENSE.get(flag & 14, "")
            found.append(dependency(rpm(n, v if sense == "=" else None, None, space), f"{sense} {v}".strip() or None, "requires", True, False, sense == "=" and bool(v)))
    paths = [{"path": (h["dir_names"][i] + b).lstrip("/")} for b, i in zip(h.get("base_names", []), h.get("dir_indexes", []), strict=False) if i < len(h.get("dir_names", []))] if files else []
    source = one("source_rpm")
    m = re.match(r"(.+)-([^-]+-[^-]+)\.src\.rpm$", source or "")
    people = [party(role, *(person(one(k))[:2]), type=kind) for role, k, kind in (("vendor", "vendor", "organization"), ("packager", "packager", "person"), ("distributor", "distribution", "organization")) if one(k)]
    return {
        "namespace": space, "name": name, "version": f"{epoch}:{version}" if epoch else version, "qualifiers": {"arch": one("arch")} if one("arch") else None, "description": "\n".join(dict.fromkeys(x for x in (one("summary"), one("description")) if x)) or None,
        "homepage_url": one("url"), "extracted_license_statement": one("license"), "parties": people, "keywords": [one("group")] if one("group") and one("group") != "Unspecified" else [], "dependencies": found, "file_references": paths,
        "source_packages": [rpm(m[1], m[2], "src", space)] if m else [], "size": one("size"), "purl": rpm(name, version, one("arch"), space, str(epoch) if epoch else None),
        "extra_data": {"provides": h.get("provides"), "obsoletes": h.get("obsoletes")},
    }


@reads("rpm_archive", "rpm", r"\.(?:rpm|srpm)$", "bytes", None, "RPM package")
def rpm_archive(path: str, content: bytes) -> dict:
    if content[:4] != b"\xed\xab\xee\xdb":
        raise ValueError("no lead")
    at = 96
    entries, size = struct.unpack_from(">II", content, at + 8)
    at += 16 + 16 * entries + size
    at += -at % 8
    return rpm_row(rpm_header(content[at + 8 :]))


@reads("rpm_installed_database_sqlite", "rpm", r"(?:^|/)rpm/rpmdb\.sqlite$", "bytes", None, "Installed RPM packages, SQLite")
def rpm_sqlite(path: str, content: bytes) -> list[dict]:
    with tempfile.TemporaryDirectory() as folder:  # the library reads files; it is gone before the row is handed on
        file = Path(folder) / "db"
        file.write_bytes(content)
        con = sqlite3.connect(f"file:{file}?mode=ro&immutable=1", uri=True)
        try:
            blobs = [r[0] for r in con.execute("select blob from Packages order by hnum")]
        finally:
            con.close()
    return [rpm_row(rpm_header(b)) for b in blobs]


@reads("rpm_installed_database_ndb", "rpm", r"(?:^|/)rpm/Packages\.db$", "bytes", None, "Installed RPM packages, ndb")
def rpm_ndb(path: str, content: bytes) -> list[dict]:
    if content[:4] != b"RpmP":
        raise ValueError("no ndb file")
    rows, pages = [], struct.unpack_from("<I", content, 12)[0]
    for at in range(32, pages * 4096, 16):
        magic, number, block, _ = struct.unpack_from("<IIII", content, at)
        if magic == int.from_bytes(b"Slot", "little") and number:
            place = block * 16
            _, _, _, size = struct.unpack_from("<IIII", content, place)
            rows.append(rpm_row(rpm_header(content[place + 16 : place + 16 + size])))
    return rows


@reads("rpm_installed_database_bdb", "rpm", r"(?:^|/)rpm/Packages$", "bytes", None, "Installed RPM packages, Berkeley hash")
def rpm_bdb(path: str, content: bytes) -> list[dict]:
    """Values of a hash database: pages of a type list their items, large ones lie on chains of overflow pages."""
    order = "<" if struct.unpack_from("<I", content, 12)[0] == 0x061561 else ">"
    if struct.unpack_from(order + "I", content, 12)[0] != 0x061561:
        raise ValueError("no hash database")
    size, last = struct.unpack_from(order + "I", content, 20)[0], struct.unpack_from(order + "I", content, 32)[0]
    rows = []
    for page in range(1, last + 1):
        base = page * size
        if base + 26 > len(content) or content[base + 25] not in (2, 13):
            continue
        n = struct.unpack_from(order + "H", content, base + 20)[0]
        for k in range(1, n, 2):
            item = base + struct.unpack_from(order + "H", content, base + 26 + 2 * k)[0]
            if content[item] != 3:
                continue
            number, total = struct.unpack_from(order + "II", content, item + 4)
            value, seen = bytearray(), 0
            while number and len(value) < total and seen <= last:
                at = number * size
                used, number = struct.unpack_from(order + "H", content, at + 22)[0], struct.unpack_from(order + "I", content, at + 16)[0]
                value += content[at + 26 : at + 26 + used]
                seen += 1
            rows.append(rpm_row(rpm_header(bytes(value[:total]))))
    return rows


@reads("rpm_specfile", "rpm", r"(?i)\.spec$", "text", None, "RPM specfile")
def specfile(path: str, text: str) -> dict:
    macros: dict[str, str] = {}
    tags: dict[str, str] = {}
    found, provides = [], []
    lines = iter(text.splitlines())
    section = ""
    about: list[str] = []
    fill = lambda s: _macros(s, macros)
    for line in lines:
        s = line.strip()
        if m := re.match(r"%(?:define|global)\s+(\S+)\s+(.+)$", s):
            macros.setdefault(m[1], m[2].strip())
            continue
        if re.match(r"%(?:if|else|endif|elif)", s):
            continue
        if m := re.match(r"%(\w+)(?:\s|$)", s):
            section = m[1] if not (m[1] == "description" and s != "%description") else "other"
            continue
        if section == "description":
            about.append(line)
        m = re.match(r"([A-Za-z]\w*)(?:\(([^)]*)\))?\s*:\s*(.*)$", s) if not section else None
        if not m or s.startswith("#"):
            continue
        tag, scope, value = m[1].lower(), m[2], fill(m[3])
        if tag == "buildrequires":
            found += [_spec_need(x, "build", False) for x in _clauses(value)]
        elif tag == "requires":
            found += [_spec_need(x, scope or "runtime", True) for x in _clauses(value)]
        elif tag == "provides":
            provides += _clauses(value)
        else:
            tags.setdefault(tag, value)
            macros.setdefault(tag, value)
    version = tags.get("version")
    release = re.sub(r"%\{\??[^}]*\}", "", tags.get("release", "")) or None
    full = f"{version}-{release}" if version and release else version
    people = [party(k, *person(tags[k])[:2]) for k in ("packager", "vendor") if tags.get(k)]
    return {
        "name": tags.get("name"), "version": version, "description": "\n".join(about).strip() or tags.get("summary"), "homepage_url": tags.get("url"), "extracted_license_statement": tags.get("license"),
        "download_url": tags.get("source") or tags.get("source0"), "parties": people, "dependencies": found, "keywords": [tags["group"]] if tags.get("group") else [], "purl": rpm(tags.get("name"), version),
        "extra_data": {"release": release, "epoch": tags.get("epoch"), "provides": provides, "summary": tags.get("summary"), "evr": full},
    }


def _macros(text: str, values: dict[str, str]) -> str:
    for _ in range(8):
        new = re.sub(r"%\{\??(\w+)\}|%(\w+)", lambda m: values.get(m[1] or m[2], m[0]), text)
        if new == text:
            break
        text = new
    return text


def _clauses(value: str) -> list[str]:
    return [x.strip() for part in value.split(",") for x in re.findall(r"[^\s<>=]+(?:\s*[<>=]+\s*\S+)?", part) if x.strip()]


def _spec_need(text: str, scope: str, runtime: bool) -> dict:
    m = re.match(r"(\S+?)\s*([<>=]+)\s*(\S+)$", text)
    name, wanted = (m[1], f"{m[2]} {m[3]}") if m else (text, None)
    return dependency(rpm(name, m[3] if m and m[2] == "=" else None), wanted, scope, runtime, False, bool(m and m[2] == "="))


@reads("rpm_mariner_manifest", "rpm", r"var/lib/rpmmanifest/container-manifest-2$", "text", None, "RPM Mariner distroless package manifest")
def mariner_manifest(path: str, text: str) -> list[dict]:
    rows = []
    for line in text.splitlines():
        f = line.split("\t")
        if len(f) >= 10:
            rows.append({"namespace": "mariner", "name": f[0], "version": f[1], "qualifiers": {"arch": f[7]} if f[7] else None, "extra_data": {"filename": f[9]}, "purl": rpm(f[0], f[1], f[7], "mariner")})
    return rows


@reads("rpm_package_licenses", "rpm", r"usr/share/licenses/[^/]+/(?:COPYING|LICENSE)[^/]*$", "none", None, "RPM mariner distroless package license files")
def mariner_licenses(path: str, _: None) -> dict:
    name = re.search(r"usr/share/licenses/([^/]+)/", path)[1]
    return {"namespace": "mariner", "name": name, "purl": rpm(name, None, None, "mariner")}


@reads("rpm_yumdb", "rpm", r"var/lib/yum/yumdb/[^/]+/[^/]+/from_repo$", "text", None, "RPM yumdb metadata; ``linux.with_siblings`` adds the keys of files beside it")
def yumdb(path: str, text: str) -> dict:
    folder = path.split("/")[-2]
    m = re.match(r"[0-9a-f]+-(.+)-([^-]+-[^-]+)-([^-]+)$", folder)
    if m is None:
        raise ValueError("no package folder")
    return {"name": m[1], "version": m[2], "qualifiers": {"arch": m[3]}, "is_virtual": True, "extra_data": {"from_repo": text.strip()}, "purl": rpm(m[1], m[2], m[3])}


def with_siblings(rows, files):
    """Yumdb rows with every file of their folder as a key of ``extra_data``: files (path, content). Grouped by folder,
    which bounds a group by the files of one."""
    from pyspark.sql import functions as F

    text = F.trim(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""))
    beside = files.where(F.col("path").contains("/yumdb/")).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("_dir"), F.element_at(F.split("path", "/"), -1).alias("_k"), text.alias("_v"))
    maps = beside.groupBy("_dir").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v"))))).alias("_extra"))
    own = rows.withColumn("_here", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return own.join(maps, F.col("_here") == F.col("_dir"), "left").withColumn("extra_data", F.when(F.col("datasource_id") == "rpm_yumdb", F.coalesce("_extra", "extra_data")).otherwise(F.col("extra_data"))).drop("_here", "_dir", "_extra")


# Others ------------------------------------------------------------------------------------------------------------


@reads("freebsd_compact_manifest", "freebsd", r"\+COMPACT_MANIFEST$", "text", None, "FreeBSD +COMPACT_MANIFEST package manifest")
def freebsd_manifest(path: str, text: str) -> dict:
    d = mapping(yaml_of(text))
    name, version, arch, origin = (text_of(d.get(k)) for k in ("name", "version", "arch", "origin"))
    licenses, logic = strings(d.get("licenses")), text_of(d.get("licenselogic"))
    stated = licenses[0] if licenses and logic == "single" else (" OR " if logic in ("or", "dual") else " AND ").join(licenses)
    maintainer = text_of(d.get("maintainer"))
    qualifiers = {k: v for k, v in (("arch", arch), ("origin", origin)) if v}
    return {
        "name": name, "version": version, "description": text_of(d.get("desc")), "homepage_url": text_of(d.get("www")), "keywords": strings(d.get("categories")), "qualifiers": qualifiers or None,
        "extracted_license_statement": stated or None, "parties": [party("maintainer", None, maintainer)] if maintainer else [],
        "code_view_url": f"https://svnweb.freebsd.org/ports/head/{origin}" if origin else None, "download_url": f"https://pkg.freebsd.org/{arch}/latest/All/{name}-{version}.txz" if arch and name and version else None,
    }


@reads("etc_os_release", "linux-distro", r"(?:etc|usr/lib)/os-release$", "text", None, "Linux OS release metadata file")
def os_release(path: str, text: str) -> dict:
    v = {m[1]: m[2].strip().strip("\"'") for line in text.splitlines() if (m := re.match(r"\s*([A-Z_0-9]+)=(.*)$", line))}
    name, like, pretty = v.get("ID"), v.get("ID_LIKE"), (v.get("PRETTY_NAME") or "").lower()
    if name == "debian":
        namespace, name = "debian", "distroless" if "distroless" in pretty else "debian"
    elif name == "ubuntu" and like:
        namespace = "debian"
    elif (name or "").startswith("fedora") or like == "fedora":
        namespace, name = name, like or name
    else:
        namespace = like
    return {"namespace": namespace, "name": name, "version": v.get("VERSION_ID"), "homepage_url": v.get("HOME_URL"), "bug_tracking_url": v.get("BUG_REPORT_URL"), "extra_data": {"pretty_name": v.get("PRETTY_NAME"), "variant": v.get("VARIANT")}}


_LABEL = re.compile(r"""((?:[^\s=\"'\\]|\\.|"(?:\\.|[^"\\])*"|'[^']*')+)(?:=((?:[^\s\"'\\]|\\.|"(?:\\.|[^"\\])*"|'[^']*')*))?""")


def _unquote(s: str) -> str:
    return re.sub(r"""\\(.)|["']""", lambda m: m[1] or "", s)


@reads("dockerfile", "docker", r"(?i)(?:^|/)(?:dockerfile|containerfile(?:\.core)?)$", "text", "Dockerfile", "Dockerfile or Containerfile OCI image metadata")
def dockerfile(path: str, text: str) -> dict:
    labels: dict[str, str] = {}
    prefix = "org.opencontainers.image."
    for line in logical_lines(text):
        m = re.match(r"(?i)LABEL\s+(.*)$", line)
        if m is None:
            continue
        pairs = [(_unquote(a), _unquote(b or "")) for a, b in _LABEL.findall(m[1])]
        if "=" not in m[1].split()[0] and len(pairs) > 1:
            pairs = [(pairs[0][0], " ".join(_unquote(x) for x in re.split(r"\s+", m[1])[1:]))]
        labels |= {k: v.strip() for k, v in pairs if k.startswith(prefix)}
    get = lambda k: labels.get(prefix + k)
    return {
        "name": get("title"), "version": get("version"), "description": get("description"), "homepage_url": get("url"), "vcs_url": get("source"), "extracted_license_statement": get("licenses"),
        "extra_data": {"oci_labels": labels}, "purl": None,
    }


@reads("microsoft_update_manifest_mum", "windows-update", r"\.mum$", "xml", None, "Microsoft Update Manifest .mum file")
def update_manifest(path: str, root: ET.Element) -> dict:
    identity = root.find("assemblyIdentity")
    a = identity.attrib if identity is not None else {}
    return {
        "name": a.get("name"), "version": a.get("version"), "description": root.get("description"), "copyright": root.get("copyright"), "homepage_url": root.get("supportInformation"),
        "parties": [party("owner", root.get("company"), type="organization")] if root.get("company") else [],
    }
