"""SPDX 2.2 (tag-value, RDF) and CycloneDX 1.3 (JSON, XML)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import document, escape_xml, fixed, items, of_rows
from .report import NOTICE, TOOL, Report

# SPDX --------------------------------------------------------------------------------------------------------------

SPDX_NS = "http://spdx.org/rdf/terms#"


def _has(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def spdx_files(report: Report) -> DataFrame:
    """name, sha1, licenses (array of SPDX keys), copyrights (array) of each file; directories aren't listed."""
    files = report.files
    only = files.where(F.col("type") == "file") if "type" in files.columns else files
    licenses = F.array_sort(F.array_distinct(F.col("license_detections.license_expression"))) if "license_detections" in files.columns else F.array().cast("array<string>")
    copyrights = F.array_distinct(F.col("copyrights.copyright")) if "copyrights" in files.columns else F.array().cast("array<string>")
    return only.select(F.concat(F.lit("./"), F.regexp_replace("path", "^[./]+", "")).alias("name"), _has(files, "sha1").alias("sha1"), licenses.alias("licenses"), copyrights.alias("copyrights"))


def verification_code(files: DataFrame) -> DataFrame:
    """One row, code: SHA-1 of the sorted SHA-1 digests, one after another. That is one sequence by definition, so one
    task reads the digests, sorted with spills, and keeps a batch of them at a time."""

    def run(batches):
        h = hashlib.sha1()
        for batch in batches:
            h.update("".join(batch.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["code"])

    digests = files.where("sha1 IS NOT NULL").select("sha1").repartition(1).sortWithinPartitions("sha1")
    return digests.mapInArrow(run, "code string").agg(F.coalesce(F.max("code"), F.lit(hashlib.sha1().hexdigest())).alias("code"))


def _or_none(values: Column, sign: str = "\n") -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, sign)).otherwise("NONE")


def spdx_tag_value(report: Report, name: str = "scan") -> DataFrame:
    """Without files: one line that says so."""
    spark, files = report.spark, spdx_files(report)
    if not files.take(1):
        return fixed(spark, 0, f"# No results for package '{name}'.")
    found = files.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("licenses")))).alias("l"))
    texts = files.select(F.explode("copyrights").alias("c")).where("c IS NOT NULL").distinct()
    edges = texts.agg(F.min("c").alias("first"), F.max("c").alias("last"))
    head = [
        "## Document Information", "SPDXVersion: SPDX-2.2", "DataLicense: CC0-1.0", "SPDXID: SPDXRef-DOCUMENT", f"DocumentName: SPDX Document created by {TOOL}",
        f"DocumentNamespace: http://spdx.org/spdxdocs/{name}", f"DocumentComment: <text>{NOTICE}</text>", "## Creation Information", f"Creator: Tool: {TOOL}", "## Package Information",
        f"PackageName: {name}", "SPDXID: SPDXRef-001", "PackageDownloadLocation: NOASSERTION", "FilesAnalyzed: true",
    ]
    code = of_rows(verification_code(files), 1, F.lit(""), F.concat(F.lit("PackageVerificationCode: "), "code"))
    licenses = F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: F.concat(F.lit("PackageLicenseInfoFromFiles: "), x)), "\n")).otherwise("PackageLicenseInfoFromFiles: NONE")
    body = of_rows(found, 2, F.lit(""), F.concat(F.lit("PackageLicenseConcluded: NOASSERTION\n"), licenses, F.lit("\nPackageLicenseDeclared: NOASSERTION")))
    # A line for each text, sorted with the document; the first and the last carry the mark-up.
    begin, end = F.when(F.col("c") == F.col("first"), "PackageCopyrightText: <text>").otherwise(""), F.when(F.col("c") == F.col("last"), "</text>").otherwise("")
    stated = of_rows(texts.crossJoin(F.broadcast(edges)), 3, F.col("c"), F.concat(begin, "c", end))  # edges: one row
    unstated = of_rows(edges.where("first IS NULL"), 3, F.lit(""), F.lit("PackageCopyrightText: NONE"))
    own = F.when(F.size("licenses") > 0, F.array_join(F.transform("licenses", lambda x: F.concat(F.lit("LicenseInfoInFile: "), x)), "\n")).otherwise("LicenseInfoInFile: NONE")
    text = F.when(F.size("copyrights") > 0, F.concat(F.lit("<text>"), F.array_join("copyrights", "\n"), F.lit("</text>"))).otherwise("NONE")
    ident = F.substring(F.sha1(F.col("name").cast("binary")), 1, 16)
    each = F.concat(
        F.lit("FileName: "), "name", F.lit("\nSPDXID: SPDXRef-"), ident, F.lit("\nFileChecksum: SHA1: "), F.coalesce("sha1", F.lit("")), F.lit("\nLicenseConcluded: NOASSERTION\n"), own, F.lit("\nFileCopyrightText: "), text,
    )
    return document(fixed(spark, 0, *head), code, body, stated, unstated, fixed(spark, 4, "## File Information"), of_rows(files, 5, F.col("name"), each))


def _resource(tag: str, value: str) -> str:
    return f'<spdx:{tag} rdf:resource="{value}"/>'


def spdx_rdf(report: Report, name: str = "scan") -> DataFrame:
    spark, files = report.spark, spdx_files(report)
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>', f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:spdx="{SPDX_NS}">',
        '<spdx:SpdxDocument rdf:about="#SPDXRef-DOCUMENT">', _resource("dataLicense", "http://spdx.org/licenses/CC0-1.0"), f"<rdfs:comment>{NOTICE.replace('"', '&quot;')}</rdfs:comment>", f"<spdx:name>SPDX Document created by {TOOL}</spdx:name>",
        "<spdx:specVersion>SPDX-2.2</spdx:specVersion>", "</spdx:SpdxDocument>", '<spdx:Package rdf:about="#SPDXRef-001">', f"<spdx:name>{name}</spdx:name>", _resource("downloadLocation", SPDX_NS + "noassertion"),
        _resource("licenseConcluded", SPDX_NS + "noassertion"), _resource("licenseDeclared", SPDX_NS + "noassertion"), _resource("licenseInfoFromFiles", SPDX_NS + "none"),
        '<spdx:filesAnalyzed rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">true</spdx:filesAnalyzed>', "<spdx:copyrightText>NONE</spdx:copyrightText>",
    ]
    code = F.concat(F.lit("<spdx:packageVerificationCode><spdx:PackageVerificationCode><spdx:packageVerificationCodeValue>"), "code", F.lit("</spdx:packageVerificationCodeValue></spdx:PackageVerificationCode></spdx:packageVerificationCode>"))
    none = _resource("licenseInfoInFile", SPDX_NS + "none")
    info = F.when(F.size("licenses") > 0, F.array_join(F.transform("licenses", lambda x: F.concat(F.lit("<spdx:licenseInfoInFile>"), escape_xml(x), F.lit("</spdx:licenseInfoInFile>"))), "")).otherwise(none)
    each = F.concat(
        F.lit("<spdx:relationship><spdx:Relationship>" + _resource("relationshipType", SPDX_NS + "relationshipType_contains") + '<spdx:relatedSpdxElement><spdx:File rdf:about="#SPDXRef-'),
        F.substring(F.sha1(F.col("name").cast("binary")), 1, 16), F.lit('"><spdx:fileName>'), escape_xml(F.col("name")), F.lit("</spdx:fileName>" + _resource("licenseConcluded", SPDX_NS + "noassertion")), info,
        F.lit("<spdx:checksum><spdx:Checksum>" + _resource("algorithm", SPDX_NS + "checksumAlgorithm_sha1") + "<spdx:checksumValue>"), F.coalesce("sha1", F.lit("")),
        F.lit("</spdx:checksumValue></spdx:Checksum></spdx:checksum><spdx:copyrightText>"), escape_xml(_or_none(F.col("copyrights"))), F.lit("</spdx:copyrightText></spdx:File></spdx:relatedSpdxElement></spdx:Relationship></spdx:relationship>"),
    )
    return document(
        fixed(spark, 0, *head), of_rows(verification_code(files), 1, F.lit(""), code), of_rows(files, 2, F.col("name"), each), fixed(spark, 3, "</spdx:Package>", "</rdf:RDF>")
    )


# CycloneDX ---------------------------------------------------------------------------------------------------------

_HASHES = (("SHA-1", "sha1"), ("SHA-256", "sha256"), ("SHA-512", "sha512"), ("MD5", "md5"))
_LINKS = (("bom", "api_data_url"), ("issue-tracker", "bug_tracking_url"), ("distribution", "download_url"), ("distribution", "repository_download_url"), ("website", "homepage_url"), ("website", "repository_homepage_url"), ("vcs", "vcs_url"))


def components(packages: DataFrame) -> DataFrame:
    """ref, name, version, description, author, purl, hashes, license, links of each package."""
    c = lambda k: _has(packages, k)
    pairs = lambda table, a, b: F.filter(F.array(*[F.when(c(k).isNotNull(), F.struct(F.lit(n).alias(a), c(k).alias(b))) for n, k in table]), lambda x: x.isNotNull())
    author = F.get(F.filter("parties.name", lambda n: n.isNotNull()), F.lit(0)) if "parties" in packages.columns else F.lit(None).cast("string")
    return packages.select(
        F.coalesce(c("purl"), F.concat(F.lit("component-"), F.substring(F.sha1(F.to_json(F.struct(*packages.columns)).cast("binary")), 1, 12))).alias("ref"), F.coalesce(c("name"), F.lit("unknown")).alias("name"),
        F.coalesce(c("version"), F.lit("unknown")).alias("version"), c("description").alias("description"), author.alias("author"), c("purl").alias("purl"), pairs(_HASHES, "alg", "content").alias("hashes"),
        F.coalesce(c("declared_license_expression_spdx"), c("declared_license_expression")).alias("license"), pairs(_LINKS, "type", "url").alias("links"),
    )


def _dependency_refs(dependencies: DataFrame) -> DataFrame:
    """ref and dependsOn."""
    resolved = F.get_json_object("resolved_package", "$.purl") if "resolved_package" in dependencies.columns else F.lit(None).cast("string")
    return dependencies.select(F.coalesce(_has(dependencies, "purl"), F.concat(F.lit("dependency-"), F.substring(F.sha1(F.to_json(F.struct(*dependencies.columns)).cast("binary")), 1, 12))).alias("ref"), F.array_compact(F.array(resolved)).alias("dependsOn"))


def _serial_line(report: Report, section: int, show) -> DataFrame:
    summed = report.packages.select(F.xxhash64(*report.packages.columns[:4]).alias("h")).agg(F.bit_xor("h").alias("h"), F.count(F.lit(1)).alias("n"))
    s = F.sha1(F.concat_ws("|", F.coalesce("h", F.lit(0)).cast("string"), F.col("n").cast("string")).cast("binary"))
    part = lambda a, n: F.substring(s, a, n)
    return of_rows(summed, section, F.lit(""), show(F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))))


def cyclonedx_json(report: Report, timestamp: str | None = None) -> DataFrame:
    """Without packages and dependencies: the least document that is valid."""
    spark, packages, dependencies = report.spark, report.packages, report.dependencies
    some = lambda df: df is not None and bool(df.take(1))
    if not some(packages) and not some(dependencies):
        return fixed(spark, 0, '{"bomFormat":"CycloneDX","specVersion":"1.3","version":1,"components":[],"dependencies":[]}')
    when = timestamp or report.header.get("end_timestamp") or "1970-01-01T00:00:00Z"
    parts = [fixed(spark, 0, '{"bomFormat":"CycloneDX","specVersion":"1.3"')]
    if packages is not None:
        parts.append(_serial_line(report, 1, lambda s: F.concat(F.lit(',"serialNumber":"'), s, F.lit('"'))))
    parts.append(fixed(spark, 2, f',"version":1,"metadata":{{"timestamp":"{when}","tools":[{{"name":"{TOOL}","version":"{_version()}"}}]}},"components":['))
    if packages is not None:
        c = components(packages)
        licenses = F.when(F.col("license").isNotNull(), F.array(F.struct(F.col("license").alias("expression"))))
        full = lambda k: F.when(F.size(k) > 0, F.col(k))
        shown = F.to_json(F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", "description", "author", F.lit("required").alias("scope"), "purl", full("hashes").alias("hashes"), licenses.alias("licenses"), full("links").alias("externalReferences")))
        parts.append(items(c, 3, F.col("ref"), shown))
    parts.append(fixed(spark, 4, '],"dependencies":['))
    if dependencies is not None:
        d = _dependency_refs(dependencies)
        parts.append(items(d, 5, F.col("ref"), F.to_json(F.struct("ref", "dependsOn"))))
    return document(*parts, fixed(spark, 6, "]}"))


def cyclonedx_xml(report: Report, timestamp: str | None = None) -> DataFrame:
    spark, packages, dependencies = report.spark, report.packages, report.dependencies
    when = timestamp or report.header.get("end_timestamp") or "1970-01-01T00:00:00Z"
    parts = [fixed(spark, 0, '<?xml version="1.0" encoding="UTF-8"?>')]
    if packages is not None:
        parts.append(_serial_line(report, 1, lambda s: F.concat(F.lit('<bom xmlns="http://cyclonedx.org/schema/bom/1.3" serialNumber="'), s, F.lit('" version="1">'))))
    else:
        parts.append(fixed(spark, 1, '<bom xmlns="http://cyclonedx.org/schema/bom/1.3" version="1">'))
    parts.append(fixed(spark, 2, f"<metadata><timestamp>{when}</timestamp><tools><tool><vendor>{TOOL}</vendor><name>{TOOL}</name><version>{_version()}</version></tool></tools></metadata>", "<components>"))
    if packages is not None:
        tag = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{name}>"), escape_xml(v), F.lit(f"</{name}>"))).otherwise("")
        wrap = lambda name, v, body: F.when(F.size(v) > 0, F.concat(F.lit(f"<{name}>"), F.array_join(F.transform(v, body), ""), F.lit(f"</{name}>"))).otherwise("")
        shown = F.concat(
            F.lit('<component type="library" bom-ref="'), escape_xml(F.col("ref")), F.lit('">'), tag("name", F.col("name")), tag("version", F.col("version")), tag("description", F.col("description")), tag("author", F.col("author")),
            F.lit("<scope>required</scope>"), tag("purl", F.col("purl")), wrap("hashes", F.col("hashes"), lambda h: F.concat(F.lit('<hash alg="'), h["alg"], F.lit('">'), escape_xml(h["content"]), F.lit("</hash>"))),
            F.when(F.col("license").isNotNull(), F.concat(F.lit("<licenses><expression>"), escape_xml(F.col("license")), F.lit("</expression></licenses>"))).otherwise(""),
            wrap("externalReferences", F.col("links"), lambda r: F.concat(F.lit('<reference type="'), r["type"], F.lit('"><url>'), escape_xml(r["url"]), F.lit("</url></reference>"))), F.lit("</component>"),
        )
        parts.append(of_rows(components(packages), 3, F.col("ref"), shown))
    parts.append(fixed(spark, 4, "</components>"))
    if dependencies is not None and dependencies.take(1):
        inner = F.array_join(F.transform("dependsOn", lambda p: F.concat(F.lit('<dependency ref="'), escape_xml(p), F.lit('"/>'))), "")
        shown = F.concat(F.lit('<dependency ref="'), escape_xml(F.col("ref")), F.lit('">'), inner, F.lit("</dependency>"))
        parts += [fixed(spark, 5, "<dependencies>"), of_rows(_dependency_refs(dependencies), 6, F.col("ref"), shown), fixed(spark, 7, "</dependencies>")]
    return document(*parts, fixed(spark, 8, "</bom>"))


def _version() -> str:
    from .. import __version__

    return __version__

