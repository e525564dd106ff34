"""Java and its build tools: Maven, Gradle, Ivy facts, OSGi, sbt, Clojure."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from .base import child_text, dependency, first, listing, mapping, names, party, purl, reads, text_of

MAVEN = "https://repo1.maven.org/maven2"


def maven(group: str | None, name: str | None, version: str | None = None, qualifiers: dict | None = None) -> str | None:
    return purl("maven", name, version, group, qualifiers)


def _urls(group: str | None, name: str | None, version: str | None, packaging: str = "jar") -> dict:
    if not (group and name):
        return {}
    home = f"{MAVEN}/{group.replace('.', '/')}/{name}/" + (f"{version}/" if version else "")
    if not version:
        return {"repository_homepage_url": home}
    ending = packaging if packaging in ("war", "ear", "pom", "aar") else "jar"
    return {"repository_homepage_url": home, "repository_download_url": f"{home}{name}-{version}.{ending}", "api_data_url": f"{home}{name}-{version}.pom"}


def _fill(text: str | None, values: dict[str, str]) -> str | None:
    """Property references with the values a POM gives itself; unknown ones stay."""
    for _ in range(8):
        if not text or "${" not in text:
            return text
        new = re.sub(r"\$\{([^}]+)\}", lambda m: values.get(m[1], m[0]), text)
        if new == text:
            return text
        text = new
    return text


@reads("maven_pom", "maven", r"(?:^|/)pom\.xml$|\.pom$", "xml", "Java", "Maven project object model")
def pom(path: str, root: ET.Element) -> dict:
    parent = root.find("parent")
    given = root.find("properties")
    values = {e.tag: (e.text or "").strip() for e in (given if given is not None else [])}
    own = {k: child_text(root, k) for k in ("groupId", "artifactId", "version", "name", "packaging")}
    inherited = {k: child_text(parent, k) for k in ("groupId", "artifactId", "version")}
    group, version = own["groupId"] or inherited["groupId"], own["version"] or inherited["version"]
    base = {"groupId": group, "artifactId": own["artifactId"], "version": version, "packaging": own["packaging"], "name": own["name"]}
    for prefix in ("project.", "pom.", ""):
        values |= {prefix + k: v for k, v in base.items() if v and "${" not in v}
    values |= {f"project.parent.{k}": v for k, v in inherited.items() if v}
    fill = lambda s: _fill(s, values)
    group, name, version = fill(group), fill(own["artifactId"]), fill(version)
    found = []

    def add(items: list[ET.Element], scope: str | None) -> None:
        for e in items:
            g, a, v = (fill(child_text(e, k)) for k in ("groupId", "artifactId", "version"))
            given = child_text(e, "scope") or "compile"
            optional = child_text(e, "optional") == "true"
            exact = None if v is None else not re.search(r"[\[(,)\]$]|SNAPSHOT|LATEST|RELEASE", v)
            qualifiers = {k: fill(child_text(e, k)) for k in ("classifier", "type")}
            extra = {k: x for k, x in qualifiers.items() if x}
            left_out = [":".join(filter(None, (child_text(x, "groupId"), child_text(x, "artifactId")))) for x in e.findall("exclusions/exclusion")]
            found.append(dependency(maven(g, a, v if exact else None, {k: x for k, x in qualifiers.items() if x and (k, x) != ("type", "jar")}), v, scope or given, given in ("compile", "runtime", "provided", "system", "import") if scope is None else False, optional or given == "test", exact, True, {**extra, "exclusions": left_out} if extra or left_out else None))

    add(root.findall("dependencies/dependency"), None)
    add(root.findall("dependencyManagement/dependencies/dependency"), "dependencymanagement")
    licenses = [(child_text(x, "name"), child_text(x, "url"), child_text(x, "comments")) for x in root.findall("licenses/license")]
    stated = "".join("- license:\n" + "".join(f"    {k}: {v}\n" for k, v in zip(("name", "url", "comments"), x) if v) for x in licenses if any(x))
    title, about = fill(own["name"]), fill(child_text(root, "description"))
    scm = {k: fill(child_text(root, "scm", k)) for k in ("connection", "developerConnection", "url")}
    strip = lambda s: re.sub(r"^scm:\w+:", "", s) if s else s
    people = [party("developer", child_text(e, "name"), child_text(e, "email"), child_text(e, "url")) for e in root.findall("developers/developer") if len(e)]
    people += [party("contributor", child_text(e, "name"), child_text(e, "email"), child_text(e, "url")) for e in root.findall("contributors/contributor") if len(e)]
    if (owner := child_text(root, "organization", "name")) is not None:
        people.append(party("owner", owner, None, child_text(root, "organization", "url"), "organization"))
    relocated = root.find("distributionManagement/relocation")
    return {
        "namespace": group, "name": name, "version": version, "description": "\n".join(dict.fromkeys(filter(None, (title, about)))) or None, "homepage_url": fill(child_text(root, "url")),
        "extracted_license_statement": stated or None, "parties": people, "dependencies": found, "vcs_url": strip(scm["connection"]), "code_view_url": scm["url"],
        "bug_tracking_url": child_text(root, "issueManagement", "url"), "source_packages": [s for s in [maven(group, name, version, {"classifier": "sources"})] if s],
        "extra_data": {
            "parent": {k: v for k, v in inherited.items() if v}, "modules": [e.text.strip() for e in root.findall("modules/module") if e.text], "scm_developer_connection": strip(scm["developerConnection"]),
            "relocation": {e.tag: (e.text or "").strip() for e in relocated} if relocated is not None else None, "packaging": own["packaging"] if own["packaging"] not in (None, "jar") else None,
        }, **_urls(group, name, version, own["packaging"] or "jar"),
    }


def _properties(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for line in text.splitlines() if line.strip() and line[0] not in "#!" for k, sep, v in [line.partition("=")] if sep}


@reads("maven_pom_properties", "maven", names("pom.properties"), "text", "Java", "Maven properties of a built archive")
def pom_properties(path: str, text: str) -> dict:
    p = _properties(text)
    group, name, version = p.get("groupId"), p.get("artifactId"), p.get("version")
    return {"namespace": group, "name": name, "version": version, **_urls(group, name, version)}


def manifest_fields(text: str) -> dict[str, str]:
    main = re.sub(r"\r?\n ", "", text).split("\n\n")[0]
    return {k.strip(): v.strip() for line in main.splitlines() for k, sep, v in [line.partition(":")] if sep}


_CLAUSE = re.compile(r'(?:[^,"]|"[^"]*")+')


@reads("java_jar_manifest", "jar", r"META-INF/MANIFEST\.MF$", "text", "Java", "Manifest of a Java archive or an OSGi bundle")
def jar_manifest(path: str, text: str) -> dict:
    f = manifest_fields(text)
    if "Bundle-SymbolicName" in f:
        name = f["Bundle-SymbolicName"].split(";")[0].strip()
        found = []
        for key, kind in (("Require-Bundle", "require-bundle"), ("Import-Package", "import-package")):
            for clause in _CLAUSE.findall(f.get(key, "")):
                head, *rest = clause.split(";")
                options = dict(re.findall(r'([\w-]+):?=\s*"?([^";]*)"?', ";".join(rest)))
                wanted = options.get("bundle-version") or options.get("version")
                optional = options.get("resolution") == "optional"
                found.append(dependency(purl("osgi", head.strip()), wanted, kind, True, optional))
        exported = [c.split(";")[0].strip() for c in _CLAUSE.findall(f.get("Export-Package", ""))]
        return {
            "type": "osgi", "datasource_id": "java_osgi_manifest", "name": name, "version": f.get("Bundle-Version"), "description": f.get("Bundle-Description") or f.get("Bundle-Name"),
            "homepage_url": f.get("Bundle-DocURL"), "extracted_license_statement": f.get("Bundle-License"), "parties": [party("vendor", f["Bundle-Vendor"], type="organization")] if f.get("Bundle-Vendor") else [],
            "dependencies": found, "extra_data": {"exported_packages": exported}, "purl": purl("osgi", name, f.get("Bundle-Version")),
        }
    name, version = first(f.get("Implementation-Title"), f.get("Specification-Title")), first(f.get("Implementation-Version"), f.get("Specification-Version"))
    group = f.get("Implementation-Vendor-Id")
    vendor = first(f.get("Implementation-Vendor"), f.get("Specification-Vendor"))
    return {
        "type": "maven" if group else "jar", "namespace": group, "name": name, "version": version, "parties": [party("vendor", vendor, type="organization")] if vendor else [],
        "extracted_license_statement": f.get("Bundle-License"), "purl": purl("maven" if group else "jar", name, version, group),
    }


_TEST_SCOPE = re.compile(r"test", re.I)
_BUILD_SCOPES = ("annotationProcessor", "kapt", "ksp", "classpath", "compileOnly", "compileOnlyApi", "providedCompile", "developmentOnly")


def _gradle(scope: str, group: str | None, name: str | None, version: str | None, extra: dict | None = None) -> dict:
    test = bool(_TEST_SCOPE.search(scope))
    exact = bool(version and not re.search(r"[\[(,+)\]$]|latest", version))
    return dependency(maven(group, name, version if version and "$" not in version else None), version, scope, not test and scope not in _BUILD_SCOPES, test, exact, True, extra)


@reads("build_gradle", "maven", r"(?:^|/)build\.gradle(?:\.kts)?$|\.gradle(?:\.kts)?$", "text", "Java", "Gradle build script, read without running it")
def build_gradle(path: str, text: str) -> dict:
    bare = re.sub(r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    values = dict(re.findall(r"(?:^|\s)(?:def\s+|val\s+|ext\.)?(\w+)\s*=\s*[\"']([^\"'$]+)[\"']", bare))
    fill = lambda s: re.sub(r"\$\{?(?:\w+\.)*(\w+)\}?", lambda m: values.get(m[1], m[0]), s) if s else s
    found = []
    for block in _blocks(bare, "dependencies"):
        for m in re.finditer(r"(?m)^\s*[\"']?([a-zA-Z]\w*)[\"']?[ \t]*\(?[ \t\n]*(.+?)(?=\n\s*[\"']?[a-zA-Z]\w*[\"']?[ \t]*[(\"' ]|\Z)", block, re.S):
            scope, rest = m[1], m[2]
            if scope in ("exclude", "constraints", "because", "transitive", "force"):
                continue
            for p in re.findall(r"project\(?\s*(?:path\s*[:=]\s*)?[\"']:?([^\"']+)[\"']", rest):
                found.append(_gradle(scope, None, p.split(":")[-1], None, {"project_path": p}))
            rest = re.sub(r"project\([^)]*\)", "", rest)
            rest = re.sub(r"\{[^{}]*\}", "", rest)
            maps = re.findall(r"group\s*[:=]\s*[\"']([^\"']*)[\"']\s*,\s*name\s*[:=]\s*[\"']([^\"']+)[\"'](?:\s*,\s*version\s*[:=]\s*[\"']([^\"']*)[\"'])?", rest)
            found += [_gradle(scope, g, n, fill(v) or None) for g, n, v in maps]
            if not maps:
                for s in re.findall(r"[\"']([^\"'\s]+:[^\"'\s]+)[\"']", rest):
                    parts = fill(s).split("@")[0].split(":")
                    found.append(_gradle(scope, parts[0] or None, parts[1], parts[2] if len(parts) > 2 and parts[2] else None, {"classifier": parts[3]} if len(parts) > 3 else None))
                for alias in re.findall(r"\blibs\.([\w.]+)", rest):
                    found.append(_gradle(scope, None, alias.replace(".", "-"), None, {"catalog_alias": alias}))
    return {"dependencies": found, "purl": None}


def _blocks(text: str, name: str) -> list[str]:
    out = []
    for m in re.finditer(rf"\b{name}\s*\{{", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        out.append(text[m.end() : at - 1])
    return out


@reads("gradle_lockfile", "maven", names("gradle.lockfile", "buildscript-gradle.lockfile"), "text", "Java", "Gradle lockfile")
def gradle_lockfile(path: str, text: str) -> dict:
    found = []
    for line in text.splitlines():
        m = re.match(r"^([^:#\s]+):([^:=\s]+):([^=\s]+)=(\S*)$", line.strip())
        if m:
            found.append(dependency(maven(m[1], m[2], m[3]), m[3], None, True, False, True, None, {"configurations": m[4].split(",")} if m[4] else None))
    return {"dependencies": found, "purl": None}


@reads("gradle_module", "maven", r"\.module$", "json", "Java", "Gradle module metadata")
def gradle_module(path: str, d: dict) -> dict | None:
    if "formatVersion" not in d:
        raise ValueError("no module metadata")
    c = mapping(d.get("component"))
    group, name, version = (text_of(c.get(k)) for k in ("group", "module", "version"))
    seen, files = {}, []
    for v in listing(d.get("variants")):
        for x in listing(mapping(v).get("dependencies")):
            need = mapping(mapping(x).get("version"))
            wanted = text_of(first(need.get("strictly"), need.get("requires"), need.get("prefers")))
            scope = text_of(mapping(v).get("name"))
            seen.setdefault((x.get("group"), x.get("module"), wanted), scope)
        files += [{"path": text_of(f.get("name")), "size": f.get("size"), "sha1": f.get("sha1"), "md5": f.get("md5"), "sha256": f.get("sha256")} for f in listing(mapping(v).get("files")) if isinstance(f, dict)]
    found = [dependency(maven(g, n, w), w, s, "runtime" in (s or "").lower() or "api" in (s or "").lower()) for (g, n, w), s in seen.items()]
    unique = list({f["path"]: f for f in files}.values())
    return {"namespace": group, "name": name, "version": version, "dependencies": found, "file_references": unique, "extra_data": {"attributes": c.get("attributes")}, **_urls(group, name, version)}


@reads("sbt_build", "maven", r"(?:^|/)build\.sbt$", "text", "Scala", "sbt build definition, read without running it")
def build_sbt(path: str, text: str) -> dict:
    bare = re.sub(r"//[^\n]*", "", text)
    values = dict(re.findall(r"(?:lazy\s+)?val\s+(\w+)\s*(?::\s*String\s*)?=\s*\"([^\"]*)\"", bare))
    get = lambda k: first(*re.findall(rf"\b{k}\s*:=\s*\"([^\"]*)\"", bare))
    found = []
    for g, sign, n, v, name, scope in re.findall(r"\"([^\"]+)\"\s*(%{1,3})\s*\"([^\"]+)\"\s*%\s*(?:\"([^\"]+)\"|(\w+))(?:\s*%\s*\"?(\w+)\"?)?", bare):
        version = v or values.get(name)
        test = scope.lower() in ("test", "it")
        found.append(dependency(maven(g, n, version), version, scope.lower() or None, not test and scope.lower() != "provided", test, bool(version and not re.search(r"[+\[(]", version)), True, {"cross_version": True} if len(sign) > 1 else None))
    licenses = re.findall(r"\blicenses\s*\+?[+:]=\s*(?:Seq|List)?\(?\s*\(?\"([^\"]+)\"", bare)
    group, name, version = get("organization"), get("name"), get("version")
    return {"namespace": group, "name": name, "version": version, "description": get("description"), "homepage_url": first(*re.findall(r"homepage\s*:=\s*Some\(url\(\"([^\"]+)\"", bare)), "extracted_license_statement": first(*licenses), "dependencies": found}


_EDN = re.compile(r'[\s,]+|;[^\n]*|#_|("(?:\\.|[^"\\])*")|([\[\](){}])|([^\s,;\[\](){}"]+)')


def edn(text: str) -> list:
    """Forms of an EDN text: strings as ("str", text), other atoms as text, collections as lists that begin with their
    bracket. Limits keep the depth small."""
    stack: list[list] = [[]]
    for m in _EDN.finditer(text):
        if m[1]:
            stack[-1].append(("str", re.sub(r"\\(.)", r"\1", m[1][1:-1])))
        elif m[2] and m[2] in "[({":
            if len(stack) > 60:
                raise ValueError("too deep")
            new: list = [m[2]]
            stack[-1].append(new)
            stack.append(new)
        elif m[2]:
            if len(stack) > 1:
                stack.pop()
        elif m[3]:
            stack[-1].append(m[3])
    return stack[0]


def _pairs(form: object) -> dict:
    items = form[1:] if isinstance(form, list) else []
    return {k if isinstance(k, str) else str(k): v for k, v in zip(items[::2], items[1::2])}


def _s(form: object) -> str | None:
    return form[1] if isinstance(form, tuple) else None


def _clojure(symbol: str, version: str | None, scope: str | None, runtime: bool = True, extra: dict | None = None) -> dict:
    group, _, name = symbol.rpartition("/")
    return dependency(maven(group or name, name, version), version, scope, runtime, not runtime, version is not None, True, extra)


@reads("clojure_deps_edn", "maven", names("deps.edn"), "text", "Clojure", "Clojure dependencies")
def deps_edn(path: str, text: str) -> dict:
    top = _pairs(edn(text)[0])
    found = []

    def add(form: object, scope: str | None, runtime: bool) -> None:
        for symbol, spec in _pairs(form).items():
            at = _pairs(spec)
            extra = {k.lstrip(":"): _s(v) or v for k, v in at.items() if k != ":mvn/version" and isinstance(v, (tuple, str))}
            found.append(_clojure(symbol, _s(at.get(":mvn/version")), scope, runtime, extra))

    add(top.get(":deps"), None, True)
    for alias, form in _pairs(top.get(":aliases")).items():
        for key in (":extra-deps", ":replace-deps", ":deps"):
            add(_pairs(form).get(key), alias.lstrip(":"), False)
    return {"dependencies": found, "purl": None}


@reads("clojure_project_clj", "maven", names("project.clj"), "text", "Clojure", "Leiningen project")
def project_clj(path: str, text: str) -> dict:
    form = next(f for f in edn(text) if isinstance(f, list) and len(f) > 3 and f[1] == "defproject")
    group, _, name = form[2].rpartition("/")
    options = {k: v for k, v in zip(form[4::2], form[5::2]) if isinstance(k, str)}
    found = []

    def add(items: object, scope: str | None, runtime: bool) -> None:
        for item in items[1:] if isinstance(items, list) else []:
            if isinstance(item, list) and len(item) > 1 and isinstance(item[1], str):
                found.append(_clojure(item[1], _s(item[2]) if len(item) > 2 else None, scope, runtime))

    add(options.get(":dependencies"), None, True)
    for profile, p in _pairs(options.get(":profiles")).items():
        add(_pairs(p).get(":dependencies"), profile.lstrip(":"), False)
    stated = _pairs(options.get(":license"))
    return {
        "namespace": group or name, "name": name, "version": _s(form[3]), "description": _s(options.get(":description")), "homepage_url": _s(options.get(":url")), "vcs_url": _s(_pairs(options.get(":scm")).get(":url")),
        "extracted_license_statement": first(_s(stated.get(":name")), _s(stated.get(":spdx-id")), _s(stated.get(":url"))), "dependencies": found,
    }


