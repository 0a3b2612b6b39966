"""What projects say of themselves: solution and project files, package manifests and lock files."""

from __future__ import annotations

import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# packages


def _pairs(pattern: str) -> Callable[[str], list[tuple[str, str | None]]]:
    found = re.compile(pattern, re.M).findall
    return lambda text: [(a, b or None) for a, b in found(text)]


def _json_dependencies(text: str) -> list[tuple[str, str | None]]:
    """Declared dependencies of a manifest in JSON, and the packages of a lock file in it."""
    data = json.loads(text)
    out: list[tuple[str, str | None]] = []
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "require", "require-dev"):
        for name, value in (data.get(section) or {}).items() if isinstance(data.get(section), dict) else ():
            if isinstance(value, str):
                out.append((name, value))
            elif isinstance(value, dict) and "version" in value:
                out.append((name, value["version"]))
            elif isinstance(value, dict):  # a framework, and its packages
                out += [(n, v.get("resolved")) for n, v in value.items() if isinstance(v, dict)]
    for path, value in (data.get("packages") or {}).items() if isinstance(data.get("packages"), dict) else ():
        if path and isinstance(value, dict):
            out.append((path.rsplit("node_modules/", 1)[-1], value.get("version")))
    for value in [x for k in ("packages", "packages-dev") if isinstance(data.get(k), list) for x in data[k]]:
        out.append((value.get("name"), value.get("version")))
    for section in ("default", "develop"):  # Pipfile.lock
        out += [(n, (v.get("version") or "").lstrip("=") or None) for n, v in (data.get(section) or {}).items() if isinstance(v, dict)]
    return [(n, v) for n, v in out if n]


def _xml_packages(text: str) -> list[tuple[str, str | None]]:
    out = []
    for e in ET.fromstring(text.lstrip("\ufeff")).iter():
        tag = e.tag.rsplit("}", 1)[-1]
        if tag in ("PackageReference", "PackageVersion"):
            version = e.get("Version") or next((c.text for c in e if c.tag.rsplit("}", 1)[-1] == "Version"), None)
            out.append((e.get("Include") or e.get("Update"), version))
        elif tag == "package":
            out.append((e.get("id"), e.get("version")))
        elif tag == "dependency":
            parts = {c.tag.rsplit("}", 1)[-1]: c.text for c in e}
            out.append((":".join(x for x in (parts.get("groupId"), parts.get("artifactId")) if x), parts.get("version")))
    return [(n, v) for n, v in out if n]


_TOML_LOCK = _pairs(r'^\[\[package\]\]\s*\nname\s*=\s*"([^"]+)"\s*\nversion\s*=\s*"([^"]+)"')
#: What reads a manifest, by the end of its lower-cased name.
READERS: list[tuple[str, Callable[[str], list[tuple[str, str | None]]]]] = [
    ("package.json", _json_dependencies), ("package-lock.json", _json_dependencies), ("npm-shrinkwrap.json", _json_dependencies), ("composer.json", _json_dependencies), ("composer.lock", _json_dependencies),
    ("packages.lock.json", _json_dependencies), ("pipfile.lock", _json_dependencies), ("packages.config", _xml_packages), (".csproj", _xml_packages), (".fsproj", _xml_packages), (".vbproj", _xml_packages),
    ("directory.packages.props", _xml_packages), ("pom.xml", _xml_packages), ("cargo.lock", _TOML_LOCK), ("poetry.lock", _TOML_LOCK), ("uv.lock", _TOML_LOCK),
    ("cargo.toml", _pairs(r'^([A-Za-z][\w-]*)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([~^>=<]*\s*\d[^"]*)"')), ("pyproject.toml", _pairs(r'^\s*"([A-Za-z][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~><!]=?\s*([\w.*+-]+))?[^"\n]*",?\s*$')),
    ("yarn.lock", _pairs(r'^"?((?:@[\w.-]+/)?[\w.-]+)@[^\n]*:\n\s+version:?\s+"?([^"\n]+)"?')), ("pnpm-lock.yaml", _pairs(r"^\s{2}['/]*((?:@[\w.-]+/)?[\w.-]+)@([\w.+-]+)[^:\n]*:")),
    ("gemfile.lock", _pairs(r"^ {4}([\w.-]+) \(([^)]+)\)$")), ("gemfile", _pairs(r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?")),
    ("go.mod", _pairs(r"^\s*(?:require\s+)?([\w.-]+\.[a-z]+/[\w./-]+)\s+(v\d[\w.+-]*)")), ("go.sum", _pairs(r"^(\S+) (v[\w.+-]+) h1:")), ("requirements.txt", _pairs(r"^\s*([A-Za-z][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~><!]=\s*([\w.*+-]+))?")),
]


def packages_of(path: str | None, text: str | None) -> list[tuple[str, str | None]]:
    """(package, version) of one manifest or lock file, each once and sorted; one that can't be read has none."""
    name = posixpath.basename(path or "").lower()
    if name.startswith("requirements") and name.endswith(".txt"):
        name = "requirements.txt"
    reader = next((r for end, r in READERS if name == end or end.startswith(".") and name.endswith(end)), None)
    if reader is None or text is None:
        return []
    try:
        return sorted(set(reader(text)), key=lambda x: (x[0], x[1] or ""))
    except (ValueError, ET.ParseError, AttributeError, TypeError):
        return []


def _told(batches: Iterator[pa.RecordBatch], rows_of: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, *r) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for r in rows_of(p, t)]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)


def manifest_packages(texts: DataFrame) -> DataFrame:
    """(path, package, version) of the packages that manifests and lock files name; version is null where none is given."""
    ends = "|".join(re.escape(end) for end, _ in READERS)
    some = texts.where(F.lower("path").rlike(rf"({ends}|(^|/)requirements[^/]*\.txt)$")).select("path", "text")
    return some.mapInArrow(lambda b: _told(b, packages_of, ["path", "package", "version"]), "path string, package string, version string")


# projects

_SOLUTION = re.compile(r'^Project\("\{[^}]*\}"\)\s*=\s*"([^"]*)"\s*,\s*"([^"]*\.\w*proj)"', re.M)


def projects_of(path: str | None, text: str | None) -> list[tuple[str, str]]:
    """(project, directory) of a solution file, or of a project file itself; those that lead out of the tree are left out."""
    low = (path or "").lower()
    if low.endswith(".slnx") and text:
        try:
            found = [(posixpath.splitext(posixpath.basename(p))[0], p) for e in ET.fromstring(text).iter("Project") if (p := (e.get("Path") or "").replace("\\", "/"))]
        except ET.ParseError:
            return []
    elif low.endswith(".sln") and text:
        found = [(n, p.replace("\\", "/")) for n, p in _SOLUTION.findall(text)]
    elif re.search(r"\.(cs|fs|vb)proj$", low):
        return [(posixpath.splitext(posixpath.basename(path))[0], posixpath.dirname(path))]
    else:
        return []
    full = [(n, posixpath.normpath(posixpath.join(posixpath.dirname(path), p))) for n, p in found]
    return sorted({(n, posixpath.dirname(p)) for n, p in full if not p.startswith("..")})


def projects(texts: DataFrame) -> DataFrame:
    """(path, project, directory) of the projects that solution and project files name."""
    some = texts.where(F.lower("path").rlike(r"\.(slnx?|(cs|fs|vb)proj)$")).select("path", "text")
    return some.mapInArrow(lambda b: _told(b, projects_of, ["path", "project", "directory"]), "path string, project string, directory string")


def project_files(files: DataFrame, found: DataFrame, project: str) -> DataFrame:
    """``files`` below a directory of a project, whatever the case of its name; of directories within each other the inner project has the file."""
    dirs = found.select(F.lower("project").alias("project"), "directory").distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    owned = files.select("path", F.posexplode(ancestors).alias("depth", "directory")).join(dirs, "directory")
    inner = owned.groupBy("path").agg(F.max(F.struct("depth", "project")).alias("owner")).where(F.col("owner.project") == project.lower())
    return files.join(inner.select("path"), "path", "left_semi")
