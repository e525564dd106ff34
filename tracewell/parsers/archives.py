"""Manifests inside archives: Debian packages, gems, NuGet packages, wheels, Alpine packages.

Members are read in memory, each and all together within limits on size and on how far they expand.
"""

from __future__ import annotations

import gzip
import io
import lzma
import tarfile
import zipfile
import zlib

from . import dotnet, linux, python, ruby
from .base import decoded, reads, stanzas, xml_root

MOST_ARCHIVE, MOST_RATIO, MOST_MEMBER = 1 << 30, 100, 32 << 20


def zip_member(content: bytes, wanted) -> tuple[str, bytes] | None:
    """Name and content of the first member that is wanted."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > min(MOST_ARCHIVE, MOST_RATIO * max(len(content), 1)):
            raise ValueError("archive expands too far")
        for i in infos:
            if wanted(i.filename) and i.file_size <= MOST_MEMBER:
                return i.filename, z.read(i)
    return None


def inflated(content: bytes, name: str) -> bytes:
    """A member without its compression, if that isn't beyond the limits."""
    most = min(MOST_ARCHIVE, MOST_RATIO * max(len(content), 1), 4 * MOST_MEMBER)
    if name.endswith(".gz"):
        stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    elif name.endswith(".xz"):
        stream = lzma.LZMAFile(io.BytesIO(content))
    elif name.endswith(".zst"):
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content))
    else:
        stream = io.BytesIO(content)
    out = stream.read(most + 1)
    if len(out) > most:
        raise ValueError("archive expands too far")
    return out


def tar_member(content: bytes, name: str, wanted) -> tuple[str, bytes] | None:
    with tarfile.open(fileobj=io.BytesIO(inflated(content, name))) as t:
        for m in t:
            if m.isfile() and m.size <= MOST_MEMBER and wanted(m.name):
                return m.name, t.extractfile(m).read()
    return None


def ar_members(content: bytes):
    """(name, content) of a Unix archive."""
    if content[:8] != b"!<arch>\n":
        raise ValueError("no ar archive")
    at = 8
    while at + 60 <= len(content):
        name, size = content[at : at + 16].decode("ascii", "replace").strip().rstrip("/"), int(content[at + 48 : at + 58])
        yield name, content[at + 60 : at + 60 + size]
        at += 60 + size + size % 2


@reads("debian_deb", "deb", r"\.u?deb$", "bytes", None, "Debian package")
def deb_archive(path: str, content: bytes) -> dict:
    for name, body in ar_members(content):
        if name.startswith("control.tar"):
            found = tar_member(body, name, lambda n: n.lstrip("./") == "control")
            if found:
                return linux.debian_row(stanzas(decoded(found[1]))[0], path)
    raise ValueError("no control file")


@reads("gem_archive", "gem", r"\.gem$", "bytes", "Ruby", "Gem")
def gem_archive(path: str, content: bytes) -> dict:
    found = tar_member(content, "gem.tar", lambda n: n == "metadata.gz")
    return ruby.gem_metadata(ruby.untagged_yaml(decoded(inflated(found[1], "metadata.gz"))))


@reads("nuget_nupkg", "nuget", r"\.nupkg$", "bytes", None, "NuGet package")
def nupkg(path: str, content: bytes) -> dict:
    row = dotnet.nuspec_row(xml_root(zip_member(content, lambda n: n.endswith(".nuspec") and "/" not in n)[1]))
    extra = row["extra_data"]
    if extra.get("license_file"):
        held = zip_member(content, lambda n: n.replace("\\", "/") == extra["license_file"].replace("\\", "/"))
        row["notice_text"] = decoded(held[1]) if held else None
    return row


@reads("pypi_wheel", "pypi", r"\.whl$", "bytes", "Python", "Wheel")
def wheel(path: str, content: bytes) -> dict:
    return python.core_metadata(decoded(zip_member(content, lambda n: n.endswith(".dist-info/METADATA"))[1]))


@reads("pypi_egg", "pypi", r"\.egg$", "bytes", "Python", "Egg")
def egg(path: str, content: bytes) -> dict:
    return python.core_metadata(decoded(zip_member(content, lambda n: n.endswith("EGG-INFO/PKG-INFO"))[1]))


@reads("alpine_apk_archive", "alpine", r"\.apk$", "bytes", None, "Alpine package")
def apk_archive(path: str, content: bytes) -> dict | list:
    if content[:2] != b"\x1f\x8b":
        return []
    plain, rest = b"", content
    while rest[:2] == b"\x1f\x8b" and len(plain) < MOST_MEMBER:  # signature, control and data follow one another
        d = zlib.decompressobj(31)
        plain += d.decompress(rest, MOST_MEMBER)
        rest = d.unused_data
    at = plain.find(b".PKGINFO\0")
    size = int(plain[at + 124 : at + 135], 8)
    f = linux._grouped(linux._equals(decoded(plain[at + 512 : at + 512 + size])))
    one = lambda k: f.get(k, [None])[0]
    return {
        "namespace": "alpine", "name": one("pkgname"), "version": one("pkgver"), "description": one("pkgdesc"), "homepage_url": one("url"), "extracted_license_statement": one("license"),
        "dependencies": linux._apk_needs(f.get("depend", []), "depend"), "qualifiers": {"arch": one("arch")} if one("arch") else None, "purl": linux.apk(one("pkgname"), one("pkgver"), one("arch")),
    }
