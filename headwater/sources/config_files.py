"""YAML configuration: read, check and coerce on the driver (files of a few KB), then hand out DataFrames.

A declarative schema drives one walker. Key presence is kept apart from an explicit null: an absent nested
record becomes an empty one, an explicit null for it is an error. Unknown keys are dropped. Every violation of a
file is reported together; the first file with violations stops ``validate_all``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.functions.rules import PROVENANCE, SCHEMA_VERSION


@dataclass(frozen=True)
class Violation:
    file: str
    path: str
    rule: str
    found: str | None
    expected: str


class ConfigInvalid(ValueError):
    """Carries the violations of one file."""

    def __init__(self, violations: list[Violation]):
        self.violations = violations
        super().__init__("\n".join(f"{v.file}: {v.path}: {v.rule}: found {v.found}, expected {v.expected}" for v in violations))


@dataclass(frozen=True)
class Field:
    kind: Any  # "str" | "int" | "float" | "bool" | "prov" | "scalar" | "free" | dict (record) | ("list"|"map", kind)
    required: bool = False


VALUE = {"value": Field("scalar"), "provenance": Field("prov"), "source": Field("str")}
COUNT = {"value": Field("int"), "provenance": Field("prov"), "source": Field("str")}
AREA = {"value": Field("float"), "provenance": Field("prov"), "source": Field("str")}
POPULATION = COUNT | {"reference_year": Field("int")}
BOX = {k: Field("float") for k in ("min_lon", "max_lon", "min_lat", "max_lat")} | {"provenance": Field("prov"), "source": Field("str")}


def _strings(*names: str) -> dict[str, Field]:
    return {n: Field("str") for n in names}


MUNICIPALITY = _strings("name", "fips_code", "state", "crs") | {"area_km2": Field(AREA), "population": Field(POPULATION), "bounding_box": Field(BOX)}
SOURCE = {
    "description": Field("str"), "provenance": Field("prov"), **_strings("provider", "url", "format", "raw_path", "crs", "reference_date"),
    "reference_year": Field("int"), "checksum_sha256": Field("str"),
}
SHELTER = {
    "id": Field("str", True), **_strings("name", "address"), "lon": Field("float"), "lat": Field("float"), "crs": Field("str"), "capacity": Field(COUNT),
    "accessible": Field("bool"), "operator": Field("str"), "activation_lead_time_hours": Field(VALUE), "notes": Field("str"),
}
SCENARIO = {
    "id": Field("str", True), "label": Field("str", True), "description": Field("str"), "return_period_years": Field("int"),
    "inundation_depth_threshold_m": Field(VALUE), "flood_extent_source": Field("str"), "provenance": Field("prov", True), "notes": Field("str"),
}
EXPERIMENT = {
    "id": Field("str", True), "label": Field("str", True), **_strings("description", "scenario_id", "algorithm", "demand_model"), "seed": Field("int", True),
    "crs": Field("str"), "parameters": Field("free"), "provenance": Field("prov", True), "notes": Field("str"),
}

#: File -> (payload key, kind of the payload), in the order of validation.
FILES: dict[str, tuple[str, Any]] = {
    "municipality": ("municipality", MUNICIPALITY),
    "data_sources": ("sources", ("map", SOURCE)),
    "shelters": ("shelters", ("list", SHELTER)),
    "eligibility": ("eligibility", "free"),
    "scenarios": ("scenarios", ("list", SCENARIO)),
    "experiments": ("experiments", ("list", EXPERIMENT)),
}

_TRUE, _FALSE = {"1", "true", "t", "yes", "y", "on"}, {"0", "false", "f", "no", "n", "off"}
_BAD = object()


def _coerce(kind: str, v: Any) -> Any:
    """The lenient scalar casts; ``_BAD`` where there is none."""
    if kind in ("str", "prov"):
        return v if isinstance(v, str) and (kind == "str" or v in PROVENANCE) else _BAD
    if kind == "scalar":
        return float(v) if isinstance(v, bool) else v if isinstance(v, int | float | str) else _BAD
    if kind == "bool":
        if isinstance(v, bool):
            return v
        if isinstance(v, int | float) and v in (0, 1):
            return bool(v)
        text = v.lower() if isinstance(v, str) else None
        return True if text in _TRUE else False if text in _FALSE else _BAD
    if kind == "int":
        if isinstance(v, float):
            v = int(v) if math.isfinite(v) and v == int(v) else _BAD
        elif isinstance(v, str):
            v = int(v) if re.fullmatch(r"\s*[+-]?\d+\s*", v) else _BAD
        elif isinstance(v, int):
            v = int(v)
        else:
            v = _BAD
        return v if v is _BAD or -(2**63) <= v < 2**63 else _BAD  # columns are 64 bits wide
    if isinstance(v, int | float):
        return float(v)
    try:
        return float(v) if isinstance(v, str) else _BAD
    except ValueError:
        return _BAD


def _walk(kind: Any, v: Any, path: str, add) -> Any:
    if isinstance(kind, dict):
        if not isinstance(v, dict):
            return add(path, "type", v, "record")
        out = {}
        for name, f in kind.items():
            at = f"{path}.{name}" if path else name
            if name not in v:
                if f.required:
                    add(at, "required", None, "a value")
                out[name] = _walk(f.kind, {}, at, add) if isinstance(f.kind, dict) and not f.required else {} if f.kind == "free" else None
            elif v[name] is None and isinstance(f.kind, str) and f.kind != "free" and not f.required:
                out[name] = None
            else:
                out[name] = _walk(f.kind, v[name], at, add)
        return out
    if isinstance(kind, tuple):
        of, inner = kind
        if of == "list":
            return [_walk(inner, x, f"{path}[{i}]", add) for i, x in enumerate(v)] if isinstance(v, list) else add(path, "type", v, "list")
        if not isinstance(v, dict):
            return add(path, "type", v, "map")
        for k in v:
            if not isinstance(k, str):
                add(f"{path}.{k}", "type", k, "string key")
        return {k: _walk(inner, x, f"{path}.{k}", add) for k, x in v.items()}
    if kind == "free":
        return v if isinstance(v, dict) else add(path, "type", v, "map")
    out = _coerce(kind, v)
    if out is _BAD:
        return add(path, "enum" if kind == "prov" else "type", v, " | ".join(PROVENANCE) if kind == "prov" else kind)
    return out


def read_yaml(path: str | Path) -> Any:
    """Exactly one UTF-8 YAML document, parsed safely."""
    return parse_yaml(Path(path).read_text(encoding="utf-8"))


def parse_yaml(text: str) -> Any:
    return yaml.safe_load(text)


def check(name: str, document: Any, file: str | None = None) -> tuple[dict | None, list[Violation]]:
    """(coerced document, violations) of one of the six kinds; the document is None if there are violations."""
    payload, kind = FILES[name]
    found: list[Violation] = []

    def add(path: str, rule: str, v: Any, expected: str) -> None:
        found.append(Violation(file or f"{name}.yaml", path, rule, None if v is None else str(v)[:200], expected))

    out = _walk({"schema_version": Field("str", True), payload: Field(kind, True)}, document, "", add)
    if out and isinstance(out.get("schema_version"), str) and out["schema_version"] != SCHEMA_VERSION:
        add("schema_version", "version", out["schema_version"], SCHEMA_VERSION)
    return (None if found else out), found


def load(name: str, path: str | Path) -> dict:
    """One checked document; FileNotFoundError, yaml errors and ConfigInvalid reach the caller."""
    out, found = check(name, read_yaml(path), str(path))
    if found:
        raise ConfigInvalid(found)
    return out


def load_all(configs_dir: str | Path) -> dict[str, dict]:
    """The six documents in order; the first missing or invalid file raises."""
    return {name: load(name, Path(configs_dir) / f"{name}.yaml") for name in FILES}


def violation_frame(spark: SparkSession, configs_dir: str | Path) -> DataFrame:
    """(file, path, rule, found, expected) over all six files, without stopping at the first."""
    rows: list[Violation] = []
    for name in FILES:
        path = Path(configs_dir) / f"{name}.yaml"
        try:
            rows += check(name, read_yaml(path), path.name)[1]
        except FileNotFoundError:
            rows.append(Violation(path.name, "", "missing", None, "a file"))
        except yaml.YAMLError as e:
            rows.append(Violation(path.name, "", "syntax", str(e)[:200], "one YAML document"))
    return spark.createDataFrame([(v.file, v.path, v.rule, v.found, v.expected) for v in rows], "file string, path string, rule string, found string, expected string")


def _spark_type(kind: Any) -> T.DataType:
    if isinstance(kind, dict):
        return T.StructType([T.StructField(k, _spark_type(f.kind)) for k, f in kind.items()])
    simple = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
    return simple.get(kind, T.StringType())  # scalar and free fields travel as JSON text, see frames()


def _plain(kind: Any, v: Any) -> Any:
    import json

    if isinstance(kind, dict):
        return {k: _plain(f.kind, v[k]) for k, f in kind.items()}
    return json.dumps(v, default=str) if kind in ("scalar", "free") and v is not None else v


def frames(spark: SparkSession, documents: dict[str, dict]) -> dict[str, DataFrame]:
    """One DataFrame per document: a row per record, nested records as structs, free values as VARIANT."""
    out = {}
    for name, doc in documents.items():
        payload, kind = FILES[name]
        body = doc[payload]
        if kind == "free":
            rows, record = [{"rule": k, "body": _plain("free", v)} for k, v in body.items()], {"rule": Field("str"), "body": Field("free")}
        elif isinstance(kind, dict):
            rows, record = [_plain(kind, body)], kind
        elif kind[0] == "map":
            record = {"source_id": Field("str")} | kind[1]
            rows = [_plain(record, {"source_id": k} | v) for k, v in body.items()]
        else:
            rows, record = [_plain(kind[1], v) for v in body], kind[1]
        df = spark.createDataFrame(rows, _spark_type(record))
        for k, f in record.items():
            if f.kind == "free":
                df = df.withColumn(k, F.parse_json(k))
            elif isinstance(f.kind, dict) and any(g.kind == "scalar" for g in f.kind.values()):
                df = df.withColumn(k, F.col(k).withField("value", F.parse_json(F.col(f"{k}.value"))))
        out[name] = df
    return out
