"""Readers on small manifests written for the purpose."""

import gzip
import io
import json
import re
import sqlite3
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from tracewell.parsers import READERS, matching_readers, package_data, readers_table
from pyspark.sql import functions as F
from tracewell.parsers.base import person, purl, rows_of, sri
from pyspark.sql import functions as F
from tracewell.parsers.python import pep508


def read(path, content):
    readers = matching_readers(path)
    assert readers, path
    return rows_of(readers[0], path, content if isinstance(content, bytes) else content.encode())


def needs(row):
    return [(d["purl"], d["extracted_requirement"], d["scope"]) for d in row["dependencies"]]


#: path, content, expected fields, expected dependencies (purl, requirement, scope) or None
CASES = [
    ("package.json", '{"name":"@s/n","version":"1.2.3","license":"MIT","author":"Jo <j@x.io> (http://j)","dependencies":{"a":"^1"},"devDependencies":{"b":"2"},"repository":"u/r"}', {"namespace": "@s", "name": "n", "purl": "pkg:npm/%40s/n@1.2.3", "declared_license_expression": "mit", "vcs_url": "https://github.com/u/r"}, [("pkg:npm/a", "^1", "dependencies"), ("pkg:npm/b", "2", "devDependencies")]),
    ("package-lock.json", '{"name":"n","version":"1","packages":{"":{"dependencies":{"a":"^1"}},"node_modules/a":{"version":"1.5.0"},"node_modules/a/node_modules/b":{"version":"git+x"}}}', {"name": "n"}, [("pkg:npm/a@1.5.0", "1.5.0", "dependencies"), ("pkg:npm/b", "git+x", "dependencies")]),
    ("yarn.lock", '# yarn lockfile v1\n\n"@s/a@^1.0", "@s/a@^1.1":\n  version "1.2.0"\n  resolved "https://r/a.tgz"\n', {"type": "npm"}, [("pkg:npm/%40s/a@1.2.0", "^1.0", "dependencies")]),
    ("yarn.lock", '__metadata:\n  version: 6\n\n"a@npm:^1.0":\n  version: 1.0.2\n  resolution: "a@npm:1.0.2"\n', {}, [("pkg:npm/a@1.0.2", "^1.0", "dependencies")]),
    ("pnpm-lock.yaml", "lockfileVersion: '6.0'\ndependencies:\n  a: 1.0.0\npackages:\n  /a@1.0.0:\n    resolution: {integrity: sha512-AAAA}\n  /@s/b@2.0.0(x@1):\n    dev: true\n", {}, [("pkg:npm/a@1.0.0", "1.0.0", None), ("pkg:npm/%40s/b@2.0.0", "2.0.0", "devDependencies")]),
    ("bun.lock", '{"lockfileVersion":1,"workspaces":{"":{"name":"w","dependencies":{"a":"^1"}}},"packages":{"a":["a@1.0.1","",{},"sha512-AA"],},}', {"name": "w"}, [("pkg:npm/a@1.0.1", "^1", "dependencies")]),
    ("pnpm-workspace.yaml", "packages:\n  - 'a/*'\n", {"datasource_id": "pnpm_workspace_yaml"}, []),
    ("bower.json", '{"name":"b","license":["MIT","ISC"],"dependencies":{"j":"1"},"devDependencies":{"q":"2"}}', {"extracted_license_statement": "MIT AND ISC", "is_private": False}, [("pkg:bower/j", "1", "dependencies"), ("pkg:bower/q", "2", "devDependencies")]),
    ("deno.jsonc", '{// c\n"name":"@s/m","version":"1","imports":{"x":"jsr:@std/a@1.0.0","y":"npm:z@^1"},}', {"purl": "pkg:generic/%40s/m@1"}, [("pkg:generic/jsr.io/%40std/a", "jsr:@std/a@1.0.0", "imports"), ("pkg:npm/z", "npm:z@^1", "imports")]),
    ("deno.lock", '{"version":"5","npm":{"z@1.0.0":{"integrity":"x"}},"workspace":{"dependencies":["npm:z@^1"]}}', {}, [("pkg:npm/z@1.0.0", "1.0.0", "dependencies")]),
    ("pyproject.toml", '[project]\nname="A_b"\nversion="1"\nlicense="MIT"\ndependencies=["x>=1","y==2"]\n[project.optional-dependencies]\nt=["z"]\n', {"name": "a-b", "declared_license_expression": "mit"}, [("pkg:pypi/x", ">=1", None), ("pkg:pypi/y@2", "==2", None), ("pkg:pypi/z", None, "t")]),
    ("setup.cfg", "[metadata]\nname = a\nversion = 1\nlicense = MIT\n[options]\ninstall_requires =\n  x>=1\n[options.extras_require]\nt = y\n", {"name": "a", "version": "1"}, [("pkg:pypi/x", ">=1", None), ("pkg:pypi/y", None, "t")]),
    ("setup.py", 'from setuptools import setup\nV = "1." + "2"\nsetup(name="a", version=V, install_requires=["x==1"], author="J", author_email="j@x")\n', {"name": "a", "version": "1.2"}, [("pkg:pypi/x@1", "==1", None)]),
    ("a.dist-info/METADATA", "Metadata-Version: 2.1\nName: a\nVersion: 1\nLicense: MIT\nRequires-Dist: x (>=1)\nRequires-Dist: y; extra == 't'\n\nbody", {"name": "a", "purl": "pkg:pypi/a@1"}, [("pkg:pypi/x", ">=1", None), ("pkg:pypi/y", None, "t")]),
    ("requirements.txt", "# c\nx==1.0 # d\ny[z]>=2 ; python_version<'3'\n-r other.txt\n-e git+https://g/h.git#egg=h\n", {"purl": None}, [("pkg:pypi/x@1.0", "==1.0", "install"), ("pkg:pypi/y", ">=2", "install"), ("pkg:pypi/h", "git+https://g/h.git#egg=h", "install")]),
    ("Pipfile.lock", '{"_meta":{"hash":{"sha256":"ab"}},"default":{"x":{"version":"==1"}},"develop":{"y":{"version":"==2"}}}', {"sha256": "ab"}, [("pkg:pypi/x@1", "==1", "install"), ("pkg:pypi/y@2", "==2", "develop")]),
    ("Pipfile", '[packages]\nx="*"\n[dev-packages]\ny={version=">1"}\nz={git="u"}\n', {}, [("pkg:pypi/x", "*", "install"), ("pkg:pypi/y", ">1", "develop")]),
    ("poetry.lock", '[[package]]\nname="x"\nversion="1"\noptional=true\n[metadata]\nlock-version="2.0"\n', {}, [("pkg:pypi/x@1", None, None)]),
    ("uv.lock", 'version=1\n[[package]]\nname="me"\nversion="0"\nsource={virtual="."}\ndependencies=[{name="x"}]\n[[package]]\nname="x"\nversion="1"\n', {"name": "me"}, [("pkg:pypi/x@1", "1", None)]),
    ("pylock.toml", 'lock-version="1.0"\n[[packages]]\nname="x"\nversion="1"\n', {}, [("pkg:pypi/x@1", "1", None)]),
    ("pip-inspect.deplock", '{"installed":[{"requested":true,"direct_url":{},"metadata":{"name":"me","version":"1"}},{"metadata":{"name":"x","version":"2"}}]}', {"name": "me", "is_virtual": True}, [("pkg:pypi/x@2", "2", None)]),
    ("meta.yaml", '{% set v = "1.0" %}\npackage:\n  name: a\n  version: {{ v }}\nabout:\n  license: MIT\nrequirements:\n  run:\n    - python >=3\n', {"name": "a", "version": "1.0"}, [("pkg:conda/python", ">=3", "run")]),
    ("environment.yml", "name: e\nchannels: [c]\ndependencies:\n  - numpy=1.2\n  - pip:\n    - x==1\n", {"name": "e"}, [("pkg:conda/numpy@1.2", "==1.2", "dependencies"), ("pkg:pypi/x@1", "==1", "dependencies")]),
    ("conda-meta/a-1-0.json", '{"name":"a","version":"1","depends":["b >=2"],"files":["f"],"extracted_package_dir":"/p"}', {"name": "a"}, [("pkg:conda/b", ">=2", "depends")]),
    ("pixi.toml", '[workspace]\nname="w"\n[dependencies]\na="1"\n[pypi-dependencies]\nb="*"\n', {"name": "w"}, [("pkg:conda/a", "1", "dependencies"), ("pkg:pypi/b", "*", "pypi-dependencies")]),
    ("Cargo.toml", '[package]\nname="c"\nversion="1.0.0"\nauthors=["J <j@x>"]\n[dependencies]\na="1.2.3"\nb={version="1",optional=true}\n', {"purl": "pkg:cargo/c@1.0.0"}, [("pkg:cargo/a", "1.2.3", "dependencies"), ("pkg:cargo/b", "1", "dependencies")]),
    ("Cargo.lock", '[[package]]\nname="me"\nversion="1"\ndependencies=["a"]\n[[package]]\nname="a"\nversion="2"\nsource="r"\n', {"name": "me"}, [("pkg:cargo/a@2", "2", "dependencies")]),
    ("go.mod", "module x.io/m\ngo 1.20\nrequire (\n a.io/b v1.0.0\n c.io/d v2.0.0 // indirect\n)\nreplace a.io/b => e.io/f v3.0.0\n", {"namespace": "x.io", "name": "m"}, [("pkg:golang/a.io/b@v1.0.0", "v1.0.0", "require"), ("pkg:golang/c.io/d@v2.0.0", "v2.0.0", "require"), ("pkg:golang/e.io/f@v3.0.0", "v3.0.0", "replace")]),
    ("go.sum", "a.io/b v1.0.0 h1:x=\na.io/b v1.0.0/go.mod h1:y=\n", {}, [("pkg:golang/a.io/b@v1.0.0", "v1.0.0", "dependency")]),
    ("go.work", "go 1.20\nuse ./a\n", {}, []),
    ("go.mod.graph", "m a@v1\na@v1 b@v2\n", {"name": "m"}, [("pkg:golang/a@v1", "v1", "dependency"), ("pkg:golang/b@v2", "v2", "dependency")]),
    ("Godeps/Godeps.json", '{"ImportPath":"x/m","Deps":[{"ImportPath":"a/b","Rev":"r"}]}', {"name": "m"}, [("pkg:golang/a/b@r", "r", "Deps")]),
    ("pom.xml", "<project xmlns='http://maven.apache.org/POM/4.0.0'><parent><groupId>g</groupId><artifactId>p</artifactId><version>2</version></parent><artifactId>a</artifactId><properties><v>3</v></properties><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></project>", {"namespace": "g", "version": "2", "purl": "pkg:maven/g/a@2"}, [("pkg:maven/x/y@3", "3", "test")]),
    ("META-INF/maven/g/a/pom.properties", "groupId=g\nartifactId=a\nversion=1\n", {"purl": "pkg:maven/g/a@1"}, []),
    ("META-INF/MANIFEST.MF", "Bundle-SymbolicName: b.c;singleton:=true\nBundle-Version: 1\nRequire-Bundle: x;bundle-version=\"[1,2)\",y\n", {"datasource_id": "java_osgi_manifest", "name": "b.c"}, [("pkg:osgi/x", "[1,2)", "require-bundle"), ("pkg:osgi/y", None, "require-bundle")]),
    ("build.gradle", "dependencies {\n implementation 'g:n:1.0'\n testImplementation group: 'h', name: 'm', version: '2'\n}\n", {}, [("pkg:maven/g/n@1.0", "1.0", "implementation"), ("pkg:maven/h/m@2", "2", "testImplementation")]),
    ("gradle.lockfile", "# c\ng:n:1=compile\nempty=\n", {}, [("pkg:maven/g/n@1", "1", None)]),
    ("x.module", '{"formatVersion":"1.1","component":{"group":"g","module":"m","version":"1"},"variants":[{"name":"apiElements","dependencies":[{"group":"a","module":"b","version":{"requires":"2"}}]}]}', {"purl": "pkg:maven/g/m@1"}, [("pkg:maven/a/b@2", "2", "apiElements")]),
    ("build.sbt", 'name := "n"\norganization := "o"\nversion := "1"\nlibraryDependencies += "g" %% "a" % "2" % Test\n', {"purl": "pkg:maven/o/n@1"}, [("pkg:maven/g/a@2", "2", "test")]),
    ("deps.edn", '{:deps {g/a {:mvn/version "1"}} :aliases {:t {:extra-deps {h/b {:mvn/version "2"}}}}}', {}, [("pkg:maven/g/a@1", "1", None), ("pkg:maven/h/b@2", "2", "t")]),
    ("project.clj", '(defproject g/a "1" :description "d" :dependencies [[x/y "2"]])', {"purl": "pkg:maven/g/a@1", "description": "d"}, [("pkg:maven/x/y@2", "2", None)]),
    ("a.gemspec", 'Gem::Specification.new do |s|\n s.name = "a"\n s.version = "1"\n s.authors = ["J"]\n s.email = "j@x"\n s.add_dependency "b", "~> 1"\n s.add_development_dependency("c")\nend\n', {"purl": "pkg:gem/a@1"}, [("pkg:gem/b", "~> 1", "runtime"), ("pkg:gem/c", None, "development")]),
    ("Gemfile", 'source "https://r"\ngem "a", "~> 1"\ngroup :test do\n  gem "b"\nend\ngem "c", git: "https://g/c"\n', {}, [("pkg:gem/a", "~> 1", None), ("pkg:gem/b", None, "test"), ("pkg:gem/c", None, None)]),
    ("Gemfile.lock", "GEM\n  remote: https://r/\n  specs:\n    a (1.0)\n\nDEPENDENCIES\n  a (~> 1.0)\n\nBUNDLED WITH\n   2.0\n", {}, [("pkg:gem/a@1.0", "~> 1.0", "dependencies")]),
    ("Podfile", "pod 'A', '~> 1.0'\npod 'B', :git => 'https://g/b'\n", {}, [("pkg:cocoapods/A", "~> 1.0", "dependencies"), ("pkg:cocoapods/B", "https://g/b", "dependencies")]),
    ("Podfile.lock", "PODS:\n  - A (1.0)\nDEPENDENCIES:\n  - A (~> 1.0)\nSPEC CHECKSUMS:\n  A: ff\n", {}, [("pkg:cocoapods/A@1.0", "~> 1.0", "dependencies")]),
    ("A.podspec", "Pod::Spec.new do |s|\n s.name = 'A'\n s.version = '1'\n s.license = { :type => 'MIT' }\n s.author = { 'J' => 'j@x' }\n s.dependency 'B', '~> 2'\nend\n", {"name": "A", "declared_license_expression": "mit"}, [("pkg:cocoapods/B", "~> 2", "dependencies")]),
    ("A.podspec.json", '{"name":"A","version":"1","license":"MIT","dependencies":{"B":["~> 1"]}}', {"purl": "pkg:cocoapods/A@1"}, [("pkg:cocoapods/B", "~> 1", "dependencies")]),
    ("metadata.json", '{"name":"c","version":"1","dependencies":{"d":">= 0"}}', {"purl": "pkg:chef/c@1"}, [("pkg:chef/d", ">= 0", "dependencies")]),
    ("metadata.rb", "name 'c'\nversion '1'\ndepends 'd', '> 1'\n", {"purl": "pkg:chef/c@1"}, [("pkg:chef/d", "> 1", "dependencies")]),
    ("a.nuspec", "<package><metadata><id>A</id><version>1</version><authors>J</authors><dependencies><group targetFramework='f'><dependency id='B' version='2'/></group></dependencies></metadata></package>", {"purl": "pkg:nuget/A@1"}, [("pkg:nuget/B", "2", "dependency")]),
    ("a.csproj", "<Project><PropertyGroup><PackageId>A</PackageId><Version>1</Version></PropertyGroup><ItemGroup><PackageReference Include='B' Version='2'/></ItemGroup></Project>", {"purl": "pkg:nuget/A@1"}, [("pkg:nuget/B", "2", None)]),
    ("packages.config", "<packages><package id='B' version='2' targetFramework='f'/></packages>", {}, [("pkg:nuget/B@2", "2", "f")]),
    ("packages.lock.json", '{"version":1,"dependencies":{"f":{"B":{"type":"Direct","requested":"[1, )","resolved":"2"}}}}', {}, [("pkg:nuget/B@2", "[1, )", "f")]),
    ("project.json", '{"name":"A","version":"1","dependencies":{"B":"2"},"frameworks":{"f":{"dependencies":{"C":{"version":"3"}}}}}', {"purl": "pkg:nuget/A@1"}, [("pkg:nuget/B", "2", None), ("pkg:nuget/C", "3", "f")]),
    ("project.lock.json", '{"projectFileDependencyGroups":{"":["B >= 1"]}}', {}, [("pkg:nuget/B", ">= 1", None)]),
    ("a.deps.json", '{"targets":{"t":{"A/1":{"dependencies":{"B":"2"}}}},"libraries":{"A/1":{"type":"project"},"B/2":{"type":"package"}}}', {"purl": "pkg:nuget/A@1"}, [("pkg:nuget/B@2", "2", None)]),
    ("Directory.Packages.props", "<Project><ItemGroup><PackageVersion Include='B' Version='2'/></ItemGroup></Project>", {}, [("pkg:nuget/B", "2", "PackageVersion")]),
    ("Directory.Build.props", "<Project><ItemGroup><PackageReference Include='B' Version='2'/></ItemGroup></Project>", {}, [("pkg:nuget/B", "2", "PackageReference")]),
    ("debian/control", "Source: s\nMaintainer: J <j@x>\n\nPackage: p\nDepends: a (= 1), b | c\nDescription: d\n", {}, None),
    ("var/lib/dpkg/status", "Package: p\nVersion: 1\nArchitecture: amd64\nDepends: a (>= 2)\n\nPackage: q\nVersion: 2\n", {"purl": "pkg:deb/debian/p@1?arch=amd64"}, [("pkg:deb/debian/a", ">= 2", "depends")]),
    ("usr/share/doc/p/copyright", "Format: x\nSource: http://s\n\nFiles: *\nCopyright: 2001 J\nLicense: MIT\n", {"name": "p", "extracted_license_statement": "MIT", "copyright": "2001 J"}, []),
    ("var/lib/dpkg/info/p.list", "/.\n/usr/bin/p\n", {"name": "p"}, []), ("var/lib/dpkg/info/p:amd64.md5sums", "0" * 32 + "  usr/bin/p\n", {"name": "p"}, []), ("x_1-2.dsc", "Format: 3.0\nSource: x\nVersion: 1-2\nBuild-Depends: a\n", {"name": "x"}, None),
    ("x_1.orig.tar.gz", b"", {"purl": "pkg:deb/debian/x@1"}, []), ("x_1-2.debian.tar.xz", b"", {"purl": "pkg:deb/debian/x@1-2"}, []),
    ("lib/apk/db/installed", "C:Q1AAAA\nP:p\nV:1-r0\nA:x86_64\nL:MIT\nD:so:libc a=1\nF:usr\nR:x\n\nP:q\nV:2\n", {"purl": "pkg:apk/alpine/p@1-r0?arch=x86_64"}, [("pkg:apk/alpine/so:libc", None, "install"), ("pkg:apk/alpine/a@1", "=1", "install")]),
    ("APKBUILD", "# Maintainer: J <j@x>\npkgname=p\npkgver=1\npkgrel=0\nlicense=\"MIT\"\ndepends=\"a b\"\n", {"purl": "pkg:apk/alpine/p@1-r0"}, [("pkg:apk/alpine/a", None, "depends"), ("pkg:apk/alpine/b", None, "depends")]),
    (".SRCINFO", "pkgbase = p\n\tpkgver = 1\n\tpkgrel = 2\n\tdepends = a>=1\npkgname = p\n", {"version": "1-2", "namespace": "arch"}, [("pkg:alpm/arch/a", ">=1", "depends")]), (".PKGINFO", "pkgname = p\npkgver = 1-2\narch = any\ndepend = a\n", {"purl": "pkg:alpm/arch/p@1-2"}, [("pkg:alpm/arch/a", None, "depend")]),
    ("x.spec", "%define v 1\nName: x\nVersion: %{v}\nLicense: MIT\nBuildRequires: a >= 2\nRequires(post): b\n%description\nwords\n%prep\n", {"purl": "pkg:rpm/x@1", "description": "words"}, [("pkg:rpm/a", ">= 2", "build"), ("pkg:rpm/b", None, "post")]),
    ("var/lib/rpmmanifest/container-manifest-2", "n\t1\t2\t3\t4\t5\t6\tx86_64\t8\tf.rpm\nshort\n", {"purl": "pkg:rpm/mariner/n@1?arch=x86_64"}, []), ("usr/share/licenses/p/COPYING", b"", {"name": "p", "namespace": "mariner"}, []),
    ("var/lib/yum/yumdb/b/0a1b-bash-4.1-2.el6-x86_64/from_repo", "base", {"name": "bash", "version": "4.1-2.el6", "is_virtual": True}, []),
    ("x/+COMPACT_MANIFEST", "name: p\nversion: '1.0'\narch: a\norigin: o/p\nlicenses: [A, B]\nlicenselogic: or\nmaintainer: j@x\n", {"purl": "pkg:freebsd/p@1.0?arch=a&origin=o/p", "extracted_license_statement": "A OR B"}, []),
    ("etc/os-release", 'ID=ubuntu\nID_LIKE=debian\nVERSION_ID="20.04"\n', {"namespace": "debian", "name": "ubuntu", "version": "20.04"}, []),
    ("Dockerfile", 'FROM x\nLABEL org.opencontainers.image.title="T t" \\\n  org.opencontainers.image.licenses=MIT\n', {"name": "T t", "declared_license_expression": "mit"}, []),
    ("a.mum", "<assembly xmlns='u' company='C' copyright='K' description='D'><assemblyIdentity name='N' version='1'/></assembly>", {"name": "N", "version": "1", "copyright": "K"}, []),
    ("Package.resolved", '{"version":2,"pins":[{"identity":"a","kind":"remoteSourceControl","location":"https://github.com/o/a.git","state":{"version":"1"}}]}', {}, [("pkg:swift/github.com/o/a@1", "1", "dependencies")]),
    ("swift-show-dependencies.deplock", '{"name":"m","dependencies":[{"name":"a","url":"https://g.com/o/a","version":"1","dependencies":[{"name":"b","url":"https://g.com/o/b","version":"unspecified"}]}]}', {"name": "m"}, [("pkg:swift/g.com/o/a@1", "1", "dependencies"), ("pkg:swift/g.com/o/b", None, "dependencies")]),
    ("Package.swift.json", '{"name":"m","dependencies":[{"sourceControl":[{"identity":"a","location":{"remote":[{"urlString":"https://g.com/o/a"}]},"requirement":{"exact":["1"]}}]}]}', {"name": "m"}, [("pkg:swift/g.com/o/a@1", "1", "dependencies")]),
    ("pubspec.yaml", "name: d\nversion: 1.0.0\npublish_to: none\ndependencies:\n  a: ^1.0.0\n", {"purl": "pkg:dart/d@1.0.0", "is_private": True}, [("pkg:pubspec/a", "^1.0.0", "dependencies")]),
    ("pubspec.lock", "packages:\n  a:\n    dependency: direct main\n    version: '1.0.0'\n", {}, [("pkg:pubspec/a@1.0.0", "1.0.0", "direct main")]),
    ("haxelib.json", '{"name":"h","version":"1","contributors":["j"],"dependencies":{"a":"","b":"2"}}', {"purl": "pkg:haxe/h@1"}, [("pkg:haxe/a", None, None), ("pkg:haxe/b@2", None, None)]),
    ("conanfile.py", 'from conan import ConanFile\nclass C(ConanFile):\n    name = "c"\n    version = "1"\n    requires = "a/1.0"\n    def requirements(self):\n        self.requires("b/[>1]")\n', {"purl": "pkg:conan/c@1"}, [("pkg:conan/a@1.0", "1.0", "requires"), ("pkg:conan/b", "[>1]", "requires")]),
    ("conanfile.txt", "[requires]\na/1.0@u/c\n[options]\nx=1\n", {}, [("pkg:conan/a@1.0", "1.0", "requires")]), ("conan.lock", '{"version":"0.5","requires":["a/1.0#rev%1"]}', {}, [("pkg:conan/a@1.0", "1.0", "requires")]),
    ("r/conandata.yml", 'sources:\n  "1.0":\n    url: [u1, u2]\n    sha256: ab\n', {"version": "1.0", "download_url": "u1", "sha256": "ab"}, []),
    ("vcpkg.json", '{"name":"v","version":"1","port-version":2,"dependencies":["a",{"name":"b","version>=":"3","host":true}]}', {"version": "1#2"}, [("pkg:vcpkg/a", "a", "dependencies"), ("pkg:vcpkg/b", "3", "dependencies")]),
    ("x/BUILD", 'cc_library(name = "l", deps = ["//d"])\n', {"name": "l"}, None), ("x/BUCK", "1\n", {"name": "x"}, []), ("MODULE.bazel", 'module(name="m", version="1")\nbazel_dep(name="a", version="2", dev_dependency=True)\n', {"purl": "pkg:bazel/m@1"}, [("pkg:bazel/a@2", "2", "dev")]),
    ("METADATA.bzl", 'METADATA = {"name": "m", "version": "1", "licenses": ["MIT"]}\n', {"name": "m"}, []), ("meson.build", "project('m', 'c', version: '1', license: 'MIT')\ndependency('zlib', version: '>=1')\n", {"name": "m", "version": "1"}, [("pkg:meson/zlib", ">=1", "dependencies")]),
    ("f/flake.nix", '{ description = "d"; inputs.a.url = "github:o/a"; }', {"name": "f", "description": "d"}, [("pkg:nix/a", "github:o/a", "inputs")]), ("f/flake.lock", '{"root":"root","nodes":{"root":{"inputs":{"a":"a"}},"a":{"locked":{"rev":"r"}}},"version":7}', {}, [("pkg:nix/a@r", "r", "inputs")]),
    ("default.nix", '{ }: mkDerivation { pname = "p"; version = "1"; buildInputs = [ a lib.b ]; }', {"purl": "pkg:nix/p@1"}, [("pkg:nix/a", None, "buildInputs"), ("pkg:nix/b", None, "buildInputs")]),
    ("p.opam", 'opam-version: "2.0"\nname: "p"\nversion: "1"\nlicense: "ISC"\ndepends: [\n "a" {>= "2"}\n "b"\n]\nurl {\n src: "u"\n checksum: "md5=ff"\n}\n', {"purl": "pkg:opam/p@1", "md5": "ff", "download_url": "u"}, [("pkg:opam/a", ">= 2", "dependency"), ("pkg:opam/b", None, "dependency")]),
    ("p.cabal", "name: p\nversion: 1\nlicense: BSD3\nlibrary\n  build-depends: base >=4, text\n", {"purl": "pkg:hackage/p@1"}, [("pkg:hackage/base", ">=4", "library"), ("pkg:hackage/text", None, "library")]),
    ("cabal.project", "packages: .\nconstraints: a == 1\n", {}, [("pkg:hackage/a@1", "== 1", "constraints")]), ("stack.yaml", "resolver: lts-1\nextra-deps:\n  - a-1.0\n", {}, [("pkg:hackage/a@1.0", "a-1.0", "extra-deps")]),
    ("mix.lock", '%{\n  "a": {:hex, :a, "1.0", "' + "0" * 64 + '", [:mix], [], "hexpm"},\n}\n', {}, [("pkg:hex/a@1.0", "1.0", "dependencies")]), ("DESCRIPTION", "Package: r\nVersion: 1\nImports: a (>= 1), b\nMaintainer: J <j@x>\n", {"purl": "pkg:cran/r@1"}, [("pkg:cran/a", ">= 1", "imports"), ("pkg:cran/b", None, "imports")]),
    ("META.json", '{"name":"P-Q","version":"1","license":["perl_5"],"prereqs":{"runtime":{"requires":{"A::B":"1"}}}}', {"name": "P-Q"}, [("pkg:cpan/A-B", "1", "runtime")]), ("META.yml", "name: P\nversion: 1\nrequires:\n  A: 2\n", {"name": "P", "version": "1"}, [("pkg:cpan/A", "2", "runtime")]),
    ("MANIFEST", "a.pl\nb.pm  note\n", {"datasource_id": "cpan_manifest"}, []), ("Makefile.PL", "WriteMakefile(NAME => 'A::B', VERSION => '1', PREREQ_PM => { 'C' => 2 });", {"name": "A-B"}, [("pkg:cpan/C", "2", "runtime")]), ("x/dist.ini", "name = P\nversion = 1\nlicense = MIT\n[Prereqs / TestRequires]\nA = 1\n", {"name": "P"}, [("pkg:cpan/A", "1", "test")]),
    ("composer.json", '{"name":"v/n","license":["MIT","ISC"],"require":{"a/b":"^1"}}', {"namespace": "v", "extracted_license_statement": "MIT OR ISC"}, [("pkg:composer/a/b", "^1", "require")]), ("composer.lock", '{"packages":[{"name":"a/b","version":"1"}]}', {}, [("pkg:composer/a/b@1", "1", "require")]),
    ("Chart.yaml", "name: c\nversion: 1.0.0\ndependencies:\n  - name: a\n    version: 2.0.0\n    condition: x\n", {"purl": "pkg:helm/c@1.0.0"}, [("pkg:helm/a@2.0.0", "2.0.0", "dependencies")]), ("Chart.lock", "dependencies:\n  - name: a\n    version: 2.0.0\n", {}, [("pkg:helm/a@2.0.0", "2.0.0", "dependencies")]),
    ("x.ABOUT", "name: a\nversion: 1\ndownload_url: https://registry.npmjs.org/q/-/q-2.0.tgz\nlicense_file: L\n", {"type": "npm", "purl": "pkg:npm/q@1"}, []), ("lib/README.chromium", "Name: L\nVersion = 2\nLicense: MIT\n", {"name": "L", "version": "2"}, []), ("lib/README.google", "nothing\n", {"name": "lib"}, []),
    ("p/configure.ac", b"", {"name": "p"}, []), (".gitmodules", '[submodule "a"]\n\tpath = a\n\turl = https://github.com/O/A.git\n', {}, [("pkg:github/o/a", "https://github.com/O/A.git", "runtime")]),
    ("a.jar", b"", {"type": "jar"}, []), ("WEB-INF/web.xml", b"", {"datasource_id": "java_war_web_xml"}, []), ("a.dmg", b"", {"type": "dmg"}, []), ("a.exe", b"MZ Nullsoft.NSIS.exehead", {"type": "nsis"}, []),
]


@pytest.mark.parametrize(("path", "content", "fields", "dependencies"), CASES, ids=[f"{k}-{c[0].rpartition('/')[2]}" for k, c in enumerate(CASES)])
def test_manifest(path, content, fields, dependencies):
    row = read(path, content)[0]
    assert {k: row.get(k) for k in fields} == fields
    if dependencies is not None:
        assert needs(row) == dependencies


def test_rows_of_databases():
    assert [r["name"] for r in read("var/lib/dpkg/status", "Package: a\nVersion: 1\n\nPackage: b\nVersion: 2\n")] == ["a", "b"]
    assert read("lib/apk/db/installed", "P:p\nV:1\nF:usr/bin\nR:x\nR:y\n")[0]["file_references"] == [{"path": "usr/bin/x"}, {"path": "usr/bin/y"}]
    two = read("debian/control", "Source: s\nMaintainer: J <j@x>\n\nPackage: p\n")
    assert [r["name"] for r in two] == ["s", "p"] and two[1]["parties"][0]["email"] == "j@x"


def rpm_blob(name="n", version="1"):
    entries, store = [], b""
    for tag, value in ((1000, name), (1001, version), (1002, "2"), (1014, "MIT"), (1022, "x86_64")):
        entries.append((tag, 6, len(store), 1))
        store += value.encode() + b"\0"
    return struct.pack(">II", len(entries), len(store)) + b"".join(struct.pack(">IIII", *e) for e in entries) + store


def test_binary_formats(tmp_path):
    magic = b"\x8e\xad\xe8\x01\0\0\0\0"
    rpm = b"\xed\xab\xee\xdb".ljust(96, b"\0") + magic + struct.pack(">II", 0, 0) + magic + rpm_blob()
    assert read("a.rpm", rpm)[0]["purl"] == "pkg:rpm/n@1-2?arch=x86_64"
    con = sqlite3.connect(tmp_path / "db")
    con.execute("create table Packages(hnum integer primary key, blob blob)")
    con.executemany("insert into Packages(blob) values (?)", [(rpm_blob("a"),), (rpm_blob("b"),)])
    con.commit()
    con.close()
    assert [r["name"] for r in read("var/lib/rpm/rpmdb.sqlite", (tmp_path / "db").read_bytes())] == ["a", "b"]
    blob = rpm_blob("ndb")
    page = bytearray(4096)
    page[:16] = struct.pack("<4sIII", b"RpmP", 0, 1, 1)
    page[32:48] = struct.pack("<4sIII", b"Slot", 1, 256, len(blob) // 16 + 2)
    assert read("var/lib/rpm/Packages.db", bytes(page) + struct.pack("<4sIII", b"BlbS", 1, 0, len(blob)) + blob)[0]["name"] == "ndb"


def tar_of(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def zip_of(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives():
    control = gzip.compress(tar_of(control=b"Package: p\nVersion: 1\nArchitecture: all\n"))
    member = lambda name, body: f"{name:<16}{0:<12}{0:<6}{0:<6}{100644:<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) % 2)
    assert read("p_1_all.deb", b"!<arch>\n" + member("debian-binary", b"2.0\n") + member("control.tar.gz", control))[0]["purl"] == "pkg:deb/debian/p@1"
    spec = b"--- !ruby/object:Gem::Specification\nname: g\nversion: !ruby/object:Gem::Version\n  version: 1.0\nlicenses:\n- MIT\n"
    assert read("g.gem", tar_of(**{"metadata.gz": gzip.compress(spec)}))[0]["purl"] == "pkg:gem/g@1.0"
    assert read("a.nupkg", zip_of(**{"a.nuspec": "<package><metadata><id>A</id><version>1</version><license type='file'>L.txt</license></metadata></package>", "L.txt": "words"}))[0]["notice_text"] == "words"
    assert read("a-1-py3-none-any.whl", zip_of(**{"a-1.dist-info/METADATA": "Name: a\nVersion: 1\n\n"}))[0]["purl"] == "pkg:pypi/a@1"
    bomb = zip_of(**{"x.nuspec": b"0" * 10})[:-30] + b"junk"
    assert read("b.nupkg", bomb)[0]["name" if "name" in read("b.nupkg", bomb)[0] else "type"] in (None, "nuget")


@pytest.mark.parametrize("content", [None, b"", b"\x00\xff\xfe junk {[", b"[]", b"null", b"{}", b"<a/>", "é: [".encode("latin-1")])
def test_every_reader_takes_anything(content):
    """Whatever is wrong, rows say what they are, and nothing is raised."""
    for reader in READERS:
        for row in rows_of(reader, f"x/y/{reader.datasource}", content):
            assert row["type"] and row["datasource_id"] and row["row_pos"] >= 0


def test_helpers():
    assert purl("npm", "n", "1+2", "@s") == "pkg:npm/%40s/n@1%2B2" and purl("x", None) is None and purl("x", "n", None, None, {"b": "2", "a": "1"}) == "pkg:x/n?a=1&b=2"
    assert person("J D <j@x.io> (http://u)") == ("J D", "j@x.io", "http://u") and person("j@x.io") == (None, "j@x.io", None) and person("J") == ("J", None, None)
    assert sri("sha1-3q2+7w==") == ("sha1", "deadbeef") and sri("x") is None
    assert pep508("A.b [x,y] >= 1, <2 ; m") == {"name": "A.b", "extras": ["x", "y"], "specifiers": ">=1,<2", "marker": "m", "url": None}
    assert pep508("n @ https://u/x")["url"] == "https://u/x" and pep508("!!") is None and pep508("two words") is None


def test_table(spark):
    rows = [("a/package.json", '{"name":"x","version":"1"}'), ("a/none.txt", "x"), ("b/go.mod", "module m\n"), ("b/setup.py", None)]
    got = package_data(spark.createDataFrame(rows, "path string, content string")).collect()
    assert sorted((r["path"], r["datasource_id"], r["name"]) for r in got) == [("a/package.json", "npm_package_json", "x"), ("b/go.mod", "go_mod", "m"), ("b/setup.py", "pypi_setup_py", None)]
    assert package_data(spark.createDataFrame(rows, "path string, content string"), datasources=["go_mod"]).count() == 1
    assert readers_table(spark).count() == len(READERS) == len({r.datasource for r in READERS})


def test_plan_reads_manifests_alone(spark):
    files = spark.createDataFrame([("a/package.json", "{}")], "path string, content string")
    plan = package_data(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter") and "Exchange" not in plan


def test_yumdb_folder(spark):
    from tracewell.parsers.linux import with_siblings

    base = "var/lib/yum/yumdb/b/0a-bash-4.1-2-x86_64"
    files = spark.createDataFrame([(f"{base}/from_repo", "base\n"), (f"{base}/reason", "user")], "path string, content string")
    row = with_siblings(package_data(files), files).first()
    assert row["name"] == "bash" and json.loads(row["extra_data"]) == {"from_repo": "base", "reason": "user"}


def test_plain_requirements_and_names_take_the_short_way(monkeypatch):
    from re import _parser

    from tracewell.parsers import python, table

    seen = []
    general = python.pep508
    monkeypatch.setattr(python, "pep508", lambda text: seen.append(text) or general(text))
    found = python.requirements("requirements.txt", "A.b_c == 1.0  # any\n z\nn[x]>=1\nv==1+2\n")["dependencies"]
    assert [(d["purl"], d["extracted_requirement"], d["is_pinned"]) for d in found] == [("pkg:pypi/a-b-c@1.0", "==1.0", True), ("pkg:pypi/z", None, False), ("pkg:pypi/n", ">=1", False), ("pkg:pypi/v@1%2B2", "==1+2", True)]
    assert seen == ["n[x]>=1", "v==1+2"]
    assert len(table._by_name("main.c")[1]) < len(table._compiled()[1]) / 2
    paths = [d + n for d in ("", "a/", "debian/", "x/META-INF/", "x/meta-inf/", "var/lib/dpkg/info/") for n in ("control", "a.list", "module.xml", "MODULE.XML", "requirements.txt", "metadata.gz-extract", "main.c")]
    for p in paths:
        assert table.matching_readers(p) == [r for r in READERS if re.search(r.paths, p)]
    assert table.needed_literals(_parser.parse(r"(?:^|/)[^/]*requirements?[^/]*\.(?:txt|in)$|/requires\.txt$")) == {"requirement", "/requires.txt"}
    assert table.needed_literals(_parser.parse(r"[ab]+(?:x|y?)*$")) == frozenset()


def test_path_filter_keeps_what_some_reader_takes(spark):
    from tracewell.parsers.table import matching_readers, path_filter

    paths = [d + n for d in ("", "a/", "debian/", "x/meta-inf/", "var/lib/dpkg/status.d/", "c1/o2/") for n in ("control", "base", "a.md5sums", "MODULE.XML", "dev-requirements.in", "X.Gemspec", "main.c", "a.txt", "pom.xml")]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r["path"] for r in df.where(path_filter(F.col("path"), list(READERS))).collect()}
    taken = {p for p in paths if matching_readers(p)}
    assert kept >= taken and all(p.endswith("X.Gemspec") for p in kept - taken)  # endings are compared in lower case; Python tests them again
    # an expression tried at every place of each path was most of the filter's time; now it waits for a text it needs
    assert "Contains(" in df.where(path_filter(F.col("path"), list(READERS)))._jdf.queryExecution().optimizedPlan().toString()
