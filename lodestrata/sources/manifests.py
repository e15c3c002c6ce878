"""Names that dependency manifests declare."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.rules import base_name

# Where each JSON manifest lists its dependencies, and the registries.
JSON_TABLES = {"package.json": ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"), "composer.json": ("require", "require-dev")}
ECOSYSTEMS = {"package.json": "npm", "composer.json": "packagist", "requirements.txt": "pypi", "pyproject.toml": "pypi", "go.mod": "go", "Cargo.toml": "crates"}


def _json_names(body: Column, tables: tuple[str, ...]) -> Column:
    parts = [F.coalesce(F.map_keys(F.from_json(F.get_json_object(body, f"$.{t}"), "map<string,string>")), F.array().cast("array<string>")) for t in tables]
    return F.array_distinct(F.concat(*parts))


def _requirement_names(body: Column) -> Column:
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_extract(F.regexp_replace(x, r"\s*#.*$", ""), r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), _python_name))


def _python_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def _go_names(body: Column) -> Column:
    block = F.regexp_extract_all(body, F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9][\w.-]*\.[a-z]+/\S+)\s+v\S+"), F.lit(1))
    return F.array_distinct(block)


@F.pandas_udf(ArrayType(StringType()))
def _toml_names(bodies: pd.Series) -> pd.Series:
    def one(body):
        try:
            tree = tomllib.loads(body or "")
        except tomllib.TOMLDecodeError:
            return None
        project = tree.get("project") or {}
        listed = [*project.get("dependencies", []), *(d for group in (project.get("optional-dependencies") or {}).values() for d in group)]
        tables = [tree.get(t) or {} for t in ("dependencies", "dev-dependencies", "build-dependencies")]
        poetry = ((tree.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}
        heads = [re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)", d) for d in listed if isinstance(d, str)]
        names = [m[1] for m in heads if m]
        names += [k for t in (*tables, poetry) for k in t if k != "python"]
        return sorted({str(n) for n in names if isinstance(n, str)})

    return bodies.map(one)


def declared(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name) of what the manifests among the files (path, body) declare; unreadable ones give nothing."""
    base = F.lower(base_name(F.col("path")))
    kind = F.when(F.lit(False), "")
    for name in ECOSYSTEMS:
        kind = kind.when(base == name.lower(), name)
    rows = files.select("path", "body", kind.alias("kind")).where("kind IS NOT NULL")
    body = F.col("body")
    native = F.when(F.col("kind") == "package.json", _json_names(body, JSON_TABLES["package.json"])).when(F.col("kind") == "composer.json", _json_names(body, JSON_TABLES["composer.json"])).when(F.col("kind") == "requirements.txt", _requirement_names(body)).when(F.col("kind") == "go.mod", _go_names(body))
    toml = rows.where(F.col("kind").endswith(".toml")).select("path", "kind", _toml_names(body).alias("names"))
    plain = rows.where(~F.col("kind").endswith(".toml")).select("path", "kind", native.alias("names"))
    ecosystems = F.create_map(*(F.lit(x) for kv in ECOSYSTEMS.items() for x in kv))
    name = F.col("name")
    out = plain.unionByName(toml).select("path", ecosystems[F.col("kind")].alias("ecosystem"), F.explode("names").alias("name"))
    return out.select("path", "ecosystem", F.when(F.col("ecosystem") == "pypi", _python_name(name)).otherwise(name).alias("name")).distinct()
