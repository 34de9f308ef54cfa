"""Package manifests and lock files: (path, text) rows in, one row per declared or pinned package out.

Formats that are data (JSON, TOML, XML) are parsed whole and walked by a table
of sections; the others are matched by a table of patterns. A file that cannot
be parsed, a null text and a name of no known format yield no rows.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.arrow import batches

SCHEMA = "path string, kind string, ecosystem string, name string, version string, scope string"
ARROW = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])

#: Groups and packages that only development needs, path parts that say so, names that are no packages.
DEV_GROUPS = {"dev", "test", "testing", "lint", "docs"}
DEV_PATHS = ("test", "dev", "lint", "ci", "doc")
DEV_PACKAGES = set(
    "pytest pytest_asyncio pytest_cov pytest_mock pytest_xdist pytest_httpx pytest_django pytest_flask pytest_benchmark unittest2 nose nose2 tox nox "
    "factory_boy faker hypothesis responses vcrpy moto freezegun time_machine trustme respx aioresponses mypy ruff flake8 black isort pylint pyright "
    "autopep8 yapf pyflakes pycodestyle pydocstyle flake8_bugbear flake8_comprehensions coverage codecov coveralls bandit safety pip_audit sphinx mkdocs "
    "mkdocs_material pdoc pydoc_markdown sphinx_rtd_theme sphinxcontrib_apidoc ipython ipdb debugpy pudb pdb_plus_plus setuptools wheel build twine "
    "hatch hatchling flit flit_core poetry poetry_core maturin pre_commit".split()
)
NO_PHP_PACKAGE = {"php", "php-64bit", "php-ipv6", "hhvm", "composer-plugin-api"}
NO_DART_PACKAGE = {"flutter", "flutter_test", "flutter_localizations"}
GRADLE_SCOPES = {
    "implementation": "production", "api": "production", "compileOnly": "optional", "runtimeOnly": "production", "testImplementation": "dev", "testCompileOnly": "dev",
    "testRuntimeOnly": "dev", "kapt": "build", "ksp": "build", "annotationProcessor": "build", "androidTestImplementation": "dev", "debugImplementation": "dev",
}
MAVEN_SCOPES = {"test": "dev", "provided": "optional"}
REQUIREMENT = re.compile(r"\s*(?P<name>[A-Za-z0-9][\w.\-]*(?:\[[^\]]+\])?)\s*(?P<op>~=|===|==|!=|>=|<=|>|<)?\s*(?P<version>[^\s;#,]*)")

#: Sections of data formats: file name pattern, ecosystem, then (path into the file, scope); a star matches any key.
SECTIONS = [
    ("package.json", "npm", {"dependencies": "production", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}),
    ("composer.json", "composer", {"require": "production", "require-dev": "dev"}),
    ("Pipfile", "pypi", {"packages": "production", "dev-packages": "dev"}),
    ("Cargo.toml", "cargo", {f"{p}{s}": k for p in ("", "target/*/") for s, k in (("dependencies", "production"), ("dev-dependencies", "dev"), ("build-dependencies", "build"))}),
    ("pyproject.toml", "pypi", {"tool/poetry/dependencies": "production", "tool/poetry/group/*/dependencies": "*"}),
]

#: Patterns of line formats: file name pattern, kind, ecosystem, pattern with the groups name and version.
PATTERNS = [
    ("build.gradle*", "declared", "maven", r"(?P<scope>" + "|".join(GRADLE_SCOPES) + r""")\s*\(?\s*['"](?P<name>[^'":]+(?::[^'":]+)?)(?::(?P<version>[^'":]*))?[^'"]*['"]"""),
    ("Dockerfile*", "both", "docker", r"(?im)^[ \t]*FROM\s+(?:--platform=\S+\s+)?(?P<name>[^\s$]+?)(?::(?P<version>[^\s:/$]+))?(?:\s+as\s+\S+)?[ \t]*$"),
    ("*.csproj", "declared", "nuget", r'(?i)<PackageReference\s+Include="(?P<name>[^"]+)"(?:\s+Version="(?P<version>[^"]*)")?'),
    ("mix.exs", "declared", "hex", r'\{:(?P<name>\w+),\s*"(?P<version>[~><=!]*\s*[\d.]+)"(?:,\s*only:\s*:(?P<scope>\w+))?'),
    ("mix.lock", "pinned", "hex", r'"(?P<name>\w+)":\s*\{:hex,\s*:\w+,\s*"(?P<version>[^"]+)"'),
    ("pnpm-lock.yaml", "pinned", "npm", r"['/]?(?P<name>@?[^@\s'/][^@\s']*)@(?P<version>\d+\.\d+[^:\s']*)"),
    ("Gemfile.lock", "pinned", "gem", r"(?m)^    (?P<name>\S+)\s+\((?P<version>[^)]+)\)"),
    ("pubspec.lock", "pinned", "pub", r'(?m)^  (?P<name>[^\s:]+):[ \t]*\n(?:    .*\n)*?    version: "?(?P<version>[^"\s]+)"?'),
]


def _version(spec) -> str:
    return spec if isinstance(spec, str) else str(spec.get("version", "")) if isinstance(spec, dict) else ""


def _at(tree, parts: list[str], seen: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], dict]]:
    """Every mapping that a section's path leads to, with the keys its stars matched."""
    if not isinstance(tree, dict):
        return
    if not parts:
        yield seen, tree
    elif parts[0] == "*":
        for key, sub in tree.items():
            yield from _at(sub, parts[1:], (*seen, key))
    else:
        yield from _at(tree.get(parts[0]), parts[1:], seen)


def _group_scope(group: str) -> str:
    return "dev" if group in DEV_GROUPS else "optional"


def _requirement(line: str) -> tuple[str, str] | None:
    m = REQUIREMENT.match(line)
    return (m["name"], (m["op"] or "") + m["version"]) if m else None


def _pypi_scope(name: str, path: str) -> str:
    base = name.split("[")[0].lower().replace("-", "_")
    return "dev" if base in DEV_PACKAGES or base.startswith("types_") or any(p in path.lower() for p in DEV_PATHS) else "production"


def _from_sections(base: str, tree) -> Iterator[tuple]:
    for pattern, ecosystem, sections in SECTIONS:
        if base != pattern:
            continue
        for where, scope in sections.items():
            for stars, found in _at(tree, where.split("/")):
                for name, spec in found.items():
                    php = ecosystem == "composer" and (name in NO_PHP_PACKAGE or name.startswith("ext-"))
                    if php or (ecosystem == "npm" and not isinstance(spec, str)) or (where == "tool/poetry/dependencies" and name.lower() == "python"):
                        continue
                    yield "declared", ecosystem, name, _version(spec) or ("*" if base == "Pipfile" else ""), _group_scope(stars[-1]) if scope == "*" else scope
    if base == "pyproject.toml":
        project = tree.get("project", {})
        lists = [("production", project.get("dependencies") or [])] + [(_group_scope(g), r or []) for g, r in (project.get("optional-dependencies") or {}).items()]
        for scope, lines in lists:
            for name, version in filter(None, map(_requirement, lines)):
                yield "declared", "pypi", name, version, scope


def _from_locks(base: str, tree) -> Iterator[tuple]:
    """(kind, ecosystem, name, version, scope) of lock files that are data."""
    if base == "package-lock.json":
        modern = {k.split("node_modules/")[-1]: v for k, v in (tree.get("packages") or {}).items() if k.startswith("node_modules/")}
        pins = {k: _version(v) for k, v in modern.items() if isinstance(v, dict)}
        pins = {k: v for k, v in pins.items() if v} or {k: _version(v) for k, v in (tree.get("dependencies") or {}).items() if isinstance(v, dict)}
        found = [("npm", k, v) for k, v in pins.items()]
    elif base == "composer.lock":
        found = [("composer", p.get("name"), (p.get("version") or "").lstrip("v")) for s in ("packages", "packages-dev") for p in tree.get(s) or []]
    elif base == "packages.lock.json":
        found = [("nuget", name, info.get("resolved")) for _, packages in _at(tree, ["dependencies", "*"]) for name, info in packages.items() if isinstance(info, dict)]
    elif base == "Package.resolved":
        pins = tree.get("pins") or (tree.get("object") or {}).get("pins") or []
        for p in pins:
            state, name = p.get("state") or {}, p.get("identity") or p.get("package")
            version = state.get("version") or state.get("revision") or ""
            if name:
                yield "declared", "swift", name, version, "production"
                yield "pinned", "swift", name, version, ""
        return
    else:  # poetry.lock and Cargo.lock
        cargo = base == "Cargo.lock"
        found = [("cargo" if cargo else "pypi", p.get("name", "") if cargo else p.get("name", "").lower(), p.get("version")) for p in tree.get("package") or []]
    for ecosystem, name, version in found:
        if name and version:
            yield "pinned", ecosystem, name, version, ""


def _from_pom(text: str) -> Iterator[tuple]:
    for e in ET.fromstring(text).iter():
        if e.tag.rpartition("}")[2] != "dependency":
            continue
        field = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in e}
        if field.get("artifactId"):
            name = ":".join(filter(None, (field.get("groupId"), field["artifactId"])))
            scope = "optional" if field.get("optional", "").lower() == "true" else MAVEN_SCOPES.get(field.get("scope", "").lower(), "production")
            yield "declared", "maven", name, field.get("version", ""), scope


def _from_blocks(base: str, text: str, path: str) -> Iterator[tuple]:
    """Line formats whose meaning depends on the block a line stands in."""
    block, names = "", []
    for line in text.splitlines():
        s = line.strip()
        if base == "go.mod":
            if s.startswith("require ("):
                block = "require"
            elif s == ")":
                block = ""
            elif (block or s.startswith("require ")) and (m := re.match(r"(?:require\s+)?(\S+)\s+(v\S+)", s)):
                yield "declared", "go", m[1], m[2], "indirect" if block and "// indirect" in line else "production"
                yield "pinned", "go", m[1], m[2], ""
        elif base == "Gemfile":
            if re.match(r"group\s+:(?:development|test)", s):
                block = "dev"
            elif s == "end":
                block = ""
            elif m := re.match(r"""gem\s+['"]([^'"]+)['"]\s*(?:,\s*['"]([^'"]*)['"])?""", s):
                yield "declared", "gem", m[1], m[2] or "", block or "production"
        elif base == "pubspec.yaml":
            if line[:1].strip() and line.rstrip().endswith(":"):
                block = s[:-1]
            elif block in ("dependencies", "dev_dependencies") and (m := re.match(r"\s{2,4}(\S+):\s*(.*)$", line.rstrip())) and m[1] not in NO_DART_PACKAGE:
                yield "declared", "pub", m[1], "" if m[2].startswith("{") else m[2].strip("'^~>=< "), "dev" if block[:3] == "dev" else "production"
        elif base == "yarn.lock":
            if line[:1] not in (" ", "#", "") and s.endswith(":"):
                names = [n[: n.rfind("@")] for n in (p.strip().strip('"') for p in s[:-1].split(",")) if n.rfind("@") > 0]
            elif m := re.match(r'version:?\s+"?([^"\s]+)"?', s):
                for name in names:
                    yield "pinned", "npm", name, m[1], ""
                names = []
        elif s and s[0] not in "#-" and (r := _requirement(s)):  # requirements*.txt
            yield "declared", "pypi", *r, _pypi_scope(r[0], path)


def _from_patterns(base: str, text: str) -> Iterator[tuple]:
    for pattern, kind, ecosystem, regex in PATTERNS:
        if not fnmatchcase(base, pattern):
            continue
        for m in re.finditer(regex, text):
            name, version, scope = m["name"], (m["version"] or "").strip(), m.groupdict().get("scope")
            if ecosystem == "docker":
                if name == "scratch":
                    continue
                version = version or "latest"
            scope = GRADLE_SCOPES[scope] if ecosystem == "maven" else "dev" if scope in ("dev", "test") else "production"
            if kind in ("declared", "both"):
                yield "declared", ecosystem, name, version, scope
            if kind in ("pinned", "both"):
                yield "pinned", ecosystem, name, version, ""


def parse(path: str, text: str) -> list[tuple]:
    """(kind, ecosystem, name, version, scope) rows of one file; pinned rows have no scope."""
    base = path.rpartition("/")[2]
    data = {"package-lock.json", "composer.lock", "packages.lock.json", "Package.resolved", "poetry.lock", "Cargo.lock"}
    try:
        if any(base == s[0] for s in SECTIONS) or base in data:
            is_json = base.endswith(".json") or base in ("composer.lock", "Package.resolved")
            tree = json.loads(text) if is_json else tomllib.loads(text)
            return list((_from_locks if base in data else _from_sections)(base, tree)) if isinstance(tree, dict) else []
        if base == "pom.xml":
            return list(_from_pom(text))
        if base in ("go.mod", "Gemfile", "pubspec.yaml", "yarn.lock") or fnmatchcase(base, "requirements*.txt"):
            return list(_from_blocks(base, text, path))
        return list(_from_patterns(base, text))
    except (ValueError, AttributeError, TypeError, ET.ParseError):  # a broken file, or one whose sections have other types
        return []


def packages(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, ecosystem, name, version, scope) of every manifest and lock file among ``files``; ``kind`` is declared or pinned."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if p is not None and t is not None:
                    yield from (dict(zip(ARROW.names, (p, *r))) for r in parse(p, t))

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(lambda parts: batches(rows(parts), ARROW), SCHEMA)


def inventory(found: DataFrame, *keys: str) -> DataFrame:
    """Declared packages with the version their project's lock files pin, if any: (keys, path, ecosystem, name, version, scope, pinned).

    If lock files disagree the greatest version in code point order is taken.
    """
    pins = found.where("kind = 'pinned'").groupBy(*keys, "ecosystem", F.lower("name").alias("lowered")).agg(F.max("version").alias("pinned"))
    declared = found.where("kind = 'declared'").drop("kind").withColumn("lowered", F.lower("name"))
    return declared.join(pins, [*keys, "ecosystem", "lowered"], "left").drop("lowered")


def conflicts(declared: DataFrame, *keys: str) -> DataFrame:
    """(keys, ecosystem, name, versions): packages declared with more than one version, counted distinct before they are gathered."""
    d = declared.where("version <> ''").select(*keys, "ecosystem", "name", "version").distinct()
    return d.groupBy(*keys, "ecosystem", "name").agg(F.array_sort(F.collect_list("version")).alias("versions")).where(F.size("versions") > 1)


#: Package URL types that differ from the ecosystem's name.
PURL_TYPES = {"go": "golang"}


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """The package URL; a constraint's operators are stripped, an npm scope's at sign is escaped, a Maven group becomes a path."""
    kind = F.lit(None)
    for e, t in PURL_TYPES.items():
        kind = F.when(ecosystem == e, t).otherwise(kind)
    body = F.when((ecosystem == "npm") & name.rlike("^@[^/]+/"), F.regexp_replace(name, "^@+", "%40")).when(ecosystem == "maven", F.regexp_replace(name, "^([^:]*):", "$1/")).otherwise(name)
    clean = F.regexp_replace(F.coalesce(version, F.lit("")), r"^[\^~>=!< ]+", "")
    return F.concat(F.lit("pkg:"), F.coalesce(kind, ecosystem), F.lit("/"), body, F.when(clean != "", F.concat(F.lit("@"), clean)).otherwise(""))


def sbom(components: DataFrame, project: str) -> DataFrame:
    """(project, sbom): one CycloneDX 1.5 JSON document per project, components in order of their package URL.

    One document is one project's; components are made distinct before they are gathered.
    """
    ref = purl(F.col("ecosystem"), F.col("name"), F.coalesce("pinned", "version"))
    version = F.regexp_replace(F.coalesce("pinned", "version"), r"^[\^~>=!< ]+", "")
    scope = F.when(F.col("scope").isin("dev", "optional"), "optional").otherwise("required")
    c = components.select(project, ref.alias("purl"), "name", version.alias("version"), scope.alias("scope")).groupBy(project, "purl").agg(
        F.min("name").alias("name"), F.min("version").alias("version"), F.max("scope").alias("scope")
    )
    item = F.struct(F.col("purl").alias("bom-ref"), F.lit("library").alias("type"), "name", "version", "purl", "scope")
    g = c.groupBy(project).agg(F.array_sort(F.collect_list(item)).alias("components"))
    root = F.struct(F.struct(F.lit("application").alias("type"), F.col(project).cast("string").alias("name"), F.lit("root").alias("bom-ref")).alias("component"))
    links = F.array(F.struct(F.lit("root").alias("ref"), F.transform("components", lambda x: x["bom-ref"]).alias("dependsOn")))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), root.alias("metadata"), "components", links.alias("dependencies"))
    return g.select(project, F.to_json(doc).alias("sbom"))


#: Licences a policy denies or wants looked at, and copyleft ones.
DENIED, REVIEWED = ["AGPL-3.0", "SSPL-1.0"], ["GPL-2.0", "GPL-3.0", "LGPL", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
COPYLEFT = ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL", "LGPL-2.1", "LGPL-3.0"]


def license_risk(licence: Column, allow_unlicensed: bool = False) -> Column:
    """critical if denied, high if to be reviewed or copyleft, medium if unknown, else null."""
    unknown = licence.isNull() | licence.isin("", "UNKNOWN")
    return F.when(unknown, F.lit(None if allow_unlicensed else "medium")).when(licence.isin(DENIED), "critical").when(licence.isin(REVIEWED + COPYLEFT), "high")
