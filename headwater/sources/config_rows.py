"""Configuration documents by the thousand: read, checked and typed by Spark, a document a row.

The schema is that of ``config_files``, which serves one folder of six files on the command line. Here a catalogue of municipalities has one or more
files each, in any store. Only the parsing of one document's text is Python, on the executors; what is inside travels as VARIANT, and
presence, types, lenient casts, labels, versions and defaults are Catalyst expressions over all records at once. Every violation of every file is
a row; nothing comes to the driver.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.rules import PROVENANCE, SCHEMA_VERSION
from headwater.operators.network import checkpointed
from headwater.sources.config_files import _FALSE, _TRUE, FILES, ConfigInvalid, Field, Violation

_FOUND = "struct<path: string, rule: string, found: string, expected: string>"
#: Texts that Python reads as a float, underscores between digits included.
_FLOAT = r"(?i)^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?(?:e[+-]?\d+(?:_\d+)*)?|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)\s*$"

#: The key of a value that JSON cannot hold.
OTHER = "\x01"
#: Longer texts are not remembered.
LONG = 64
_STR, _MAP, _SEQ = (f"tag:yaml.org,2002:{t}" for t in ("str", "map", "seq"))
_PLAIN_TAGS = yaml.resolver.Resolver()


@functools.lru_cache(1 << 16)
def _tag(value: str, implicit: tuple[bool, bool]) -> str:
    return _PLAIN_TAGS.resolve(yaml.ScalarNode, value, implicit)


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The safe loader, in C where it is built in; what a scalar without a tag is depends on its text alone, and is remembered."""

    def resolve(self, kind: type, value: str, implicit: Any) -> str:
        if kind is not yaml.ScalarNode or len(value) > LONG:
            return super().resolve(kind, value, implicit)
        return _tag(value, tuple(implicit))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of all files of a path or glob, each whole in a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _plain(value: Any, path: str, odd: list[str]) -> Any:
    """What JSON can hold: dates, infinities and the like stand under ``OTHER``, so that they are no strings; keys that are not text are noted."""
    if isinstance(value, dict):
        for k in value:
            if not isinstance(k, str):
                odd.append(f"{path}.{k}" if path else str(k))
        return {str(k): _plain(v, f"{path}.{k}" if path else str(k), odd) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v, f"{path}[{i}]", odd) for i, v in enumerate(value)]
    if value is None or isinstance(value, bool | int | str) or isinstance(value, float) and math.isfinite(value):
        return value
    return {OTHER: str(value)}


@functools.lru_cache(1 << 16)
def _scalar(tag: str, value: str) -> str:
    return json.dumps(_plain(yaml.constructor.SafeConstructor().construct_object(yaml.ScalarNode(tag, value)), "", []))


class _Uncommon(Exception):
    """Tags, keys or merges that take the loader's own way."""


def _json(node: yaml.Node) -> str:
    """The JSON of a node whose records have plain text keys and whose lists are plain, as ``_plain`` would have it."""
    if isinstance(node, yaml.ScalarNode):
        return (_scalar if len(node.value) <= LONG else _scalar.__wrapped__)(node.tag, node.value)
    if node.tag == _SEQ and isinstance(node, yaml.SequenceNode):
        return f"[{', '.join([_json(x) for x in node.value])}]"
    if node.tag != _MAP or not isinstance(node, yaml.MappingNode):
        raise _Uncommon
    held = {}
    for k, v in node.value:
        if k.tag != _STR or not isinstance(k, yaml.ScalarNode):
            raise _Uncommon
        held[k.value] = _json(v)
    return f"{{{', '.join([f'{json.dumps(k)}: {v}' for k, v in held.items()])}}}"


def _body(text: str, odd: list[str]) -> str:
    """The JSON of one document."""
    loader = _Loader(text)
    try:
        node = loader.get_single_node()
        try:
            return "null" if node is None else _json(node)
        except (_Uncommon, yaml.YAMLError, RecursionError, ValueError):
            return json.dumps(_plain(loader.construct_document(node), "", odd))
    finally:
        loader.dispose()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):  # documents may be long
            part = batch.slice(start, 256)
            bodies, odds, problems = [], [], []
            for text in part.column("text").to_pylist():
                odd: list[str] = []
                try:
                    body, problem = _body(text or "", odd), None
                except (yaml.YAMLError, RecursionError, ValueError) as e:
                    body, problem = None, str(e)[:200]
                bodies.append(body)
                odds.append(odd)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(bodies, pa.string()), pa.array(odds, pa.list_(pa.string())), pa.array(problems, pa.string())], ["file", "body", "odd", "problem"])


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type; null if there is nothing."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _other(v: Column) -> Column:
    return F.try_variant_get(v, f"$['{OTHER}']", "string")


def _is_record(v: Column, own: Column) -> Column:
    return F.coalesce((own == "OBJECT") & _other(v).isNull(), F.lit(False))


def _text(v: Column) -> Column:
    return F.substring(F.coalesce(_other(v), F.try_variant_get(v, "$", "string"), F.to_json(v)), 1, 200)


def _cast(kind: str, v: Column, own: Column) -> Column:
    """The lenient scalar casts of a value of the kind ``own``; null where there is none."""
    string, text = own == "STRING", F.try_variant_get(v, "$", "string")
    boolean, flag = own == "BOOLEAN", F.try_variant_get(v, "$", "boolean")
    number = ~own.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY", "VOID")
    double = F.try_variant_get(v, "$", "double")
    endless = F.when(_other(v).rlike("^(?:-?inf|nan)$"), _other(v).try_cast("double"))
    if kind in ("str", "prov"):
        return F.when(string & (text.isin(*PROVENANCE) if kind == "prov" else F.lit(True)), text)
    if kind == "scalar":
        return F.when(boolean, F.parse_json(F.when(flag, "1.0").otherwise("0.0"))).when(string | number, v).otherwise(endless.cast("variant"))
    if kind == "bool":
        low = F.lower(text)
        return F.when(boolean, flag).when(number & double.isin(0.0, 1.0), double == 1.0).when(string & low.isin(*_TRUE), True).when(string & low.isin(*_FALSE), False)
    if kind == "int":
        whole = F.when((double == F.floor(double)) & (F.abs(double) < 2.0**63), F.try_variant_get(v, "$", "decimal(38,0)").try_cast("long"))
        return (
            F.when(boolean, flag.cast("long")).when(own == "BIGINT", F.try_variant_get(v, "$", "long")).when(number, whole)
            .when(string & text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.regexp_replace(text, r"\s", "")).try_cast("long"))
        )
    return F.when(boolean, flag.cast("double")).when(number, double).when(string & text.rlike(_FLOAT), F.regexp_replace(text, r"[\s_]", "").try_cast("double")).otherwise(endless)


_NAMES = {"int": "bigint", "float": "double", "bool": "boolean", "scalar": "variant", "free": "variant"}


def _typed(kind: Any) -> str:
    if isinstance(kind, dict):
        return f"struct<{', '.join(f'{k}: {_typed(f.kind)}' for k, f in kind.items())}>"
    return _NAMES.get(kind, "string")


def _broken(where: Column, path: Column, rule: str, found: Column, expected: str) -> Column:
    return F.when(where, F.struct(path.alias("path"), F.lit(rule).alias("rule"), found.alias("found"), F.lit(expected).alias("expected")))


def _all(faults: list[Column]) -> Column:
    """The violations of a record with nulls between them; null where there is none, as in most records."""
    return F.when(F.coalesce(*faults).isNotNull(), F.array(*faults)).cast(f"array<{_FOUND}>")


Held = Callable[[tuple[str, ...]], tuple[Column, Column]]


def _check(kind: Any, required: bool, at: tuple[str, ...], held: Held, path: Column, inside: Column) -> tuple[Column, list[Column]]:
    """(typed value, violations) of a field of a record that is there (``inside``). ``held`` gives the value and its kind at a place."""
    v, own = held(at)
    absent = v.isNull()
    none = F.lit(None).cast("string")
    missing = [_broken(inside & absent, path, "required", none, "a value")] if required else []
    if isinstance(kind, dict):
        record = _is_record(v, own)
        fields, found = [], [*missing, _broken(inside & ~absent & ~record, path, "type", _text(v), "record")]
        for name, f in kind.items():
            value, more = _check(f.kind, f.required, (*at, name), held, F.concat(path, F.lit(f".{name}")), inside & record)
            fields.append(value.alias(name))
            found += more
        return F.struct(*fields), found
    if kind == "free":
        record = _is_record(v, own)
        empty = F.parse_json(F.lit("{}")) if not required else F.lit(None).cast("variant")
        return F.when(record, v).when(absent, empty), [*missing, _broken(inside & ~absent & ~record, path, "type", _text(v), "map")]
    null = F.coalesce(F.is_variant_null(v), F.lit(False))
    value = _cast(kind, v, own)
    wrong = inside & ~absent & value.isNull() & (F.lit(True) if required else ~null)
    rule, expected = ("enum", " | ".join(PROVENANCE)) if kind == "prov" else ("type", kind)
    return value.cast(_typed(kind)), [*missing, _broken(wrong, path, rule, F.when(~null, _text(v)), expected)]


def _places(kind: Any, at: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The places of a record and of all its fields."""
    yield at
    for name, f in kind.items() if isinstance(kind, dict) else ():
        yield from _places(f.kind, (*at, name))


def _staged(df: DataFrame, record: Column, kind: Any) -> tuple[DataFrame, Held]:
    """``df`` with a column for the value at each place of ``record`` and one for its kind, so that each is taken out once."""
    number = {at: i for i, at in enumerate(_places(kind))}
    values = {f"_v{i}": F.variant_get(record, ".".join(["$", *at]), "variant") for at, i in number.items()}
    kinds = {f"_k{i}": _kind(F.col(f"_v{i}")) for i in number.values()}
    return df.withColumns(values).withColumns(kinds), lambda at: (F.col(f"_v{number[at]}"), F.col(f"_k{number[at]}"))


def check(name: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of documents (file, text) of one of the six kinds.

    records: file, place (index in a list, null else), key (of a map, null else), record (a typed struct; for free rules a variant), of
    all files, the broken ones too. violations: file, path, rule, found, expected; all of them, whatever their number. An unreadable text is one
    violation, as is a missing payload; an empty list or map gives no records. Unknown keys are dropped, absent nested records have null fields, an explicit
    null for one is a violation.
    """
    payload, kind = FILES[name]
    source = docs.select(F.col("file").cast("string").alias("file"), F.col("text").cast("string").alias("text"))
    # Parsed once; records and violations are two readings of it.
    parsed = checkpointed(source.mapInArrow(_parse, "file string, body string, odd array<string>, problem string")).withColumn("v", F.parse_json("body"))
    parsed, held = _staged(parsed, F.col("v"), {"schema_version": Field("str", True), payload: Field("free", True)})
    (top, top_kind), (body, body_kind), at = held(()), held((payload,)), F.lit(payload)
    there = _is_record(top, top_kind)
    stated, faults = _check("str", True, ("schema_version",), held, F.lit("schema_version"), there)
    faults = [
        _broken(F.col("problem").isNotNull(), F.lit(""), "syntax", F.col("problem"), "one YAML document"),
        _broken(F.col("problem").isNull() & ~there, F.lit(""), "type", _text(F.col("v")), "record"),
        *faults, _broken(there & (stated != SCHEMA_VERSION), F.lit("schema_version"), "version", stated, SCHEMA_VERSION),
        _broken(there & body.isNull(), at, "required", F.lit(None).cast("string"), "a value"),
    ]
    shape = "ARRAY" if isinstance(kind, tuple) and kind[0] == "list" else "OBJECT"
    fits = F.coalesce(body_kind == "ARRAY", F.lit(False)) if shape == "ARRAY" else _is_record(body, body_kind)
    of = "list" if shape == "ARRAY" else "record" if isinstance(kind, dict) else "map"
    faults.append(_broken(there & ~body.isNull() & ~fits, at, "type", _text(body), of))
    whole = _all(faults)
    if isinstance(kind, tuple) and kind[0] == "map" or kind == "free":
        keys = F.transform(F.filter("odd", lambda p: p.rlike(rf"^{payload}\.[^.\[]+$")), lambda p: F.struct(p.alias("path"), F.lit("type").alias("rule"), F.substring_index(p, ".", -1).alias("found"), F.lit("string key").alias("expected")))
        whole = F.concat(F.coalesce(whole, F.array().cast(f"array<{_FOUND}>")), keys)
    files = parsed.select("file", body.alias("body"), fits.alias("fits"), whole.alias("faults"))
    none = F.lit(None)
    fit = files.where("fits")
    if isinstance(kind, dict):
        each, record = fit.select("file", none.cast("int").alias("place"), none.cast("string").alias("key"), F.col("body").alias("r"), at.alias("at")), kind
    elif shape == "ARRAY":
        items = fit.select("file", F.posexplode(F.variant_get("body", "$", "array<variant>")).alias("place", "r"))
        each, record = items.select("file", "place", none.cast("string").alias("key"), "r", F.concat(at, F.lit("["), F.col("place").cast("string"), F.lit("]")).alias("at")), kind[1]
    else:
        items = fit.select("file", F.explode(F.variant_get("body", "$", "map<string,variant>")).alias("key", "r"))
        each, record = items.select("file", none.cast("int").alias("place"), "key", "r", F.concat(at, F.lit("."), "key").alias("at")), kind[1] if isinstance(kind, tuple) else None
    if record is None:  # free rules: any value goes
        checked = each.select("file", "place", "key", F.col("r").alias("record"), F.array().cast(f"array<{_FOUND}>").alias("faults"))
    else:
        each, held = _staged(each, F.col("r"), record)
        value, found = _check(record, False, (), held, F.col("at"), F.lit(True))
        checked = each.select("file", "place", "key", value.alias("record"), _all(found).alias("faults"))
    # The outer form: for a plain explode Spark adds a filter on its array and moves it below the staged columns, which are then taken out again for each use.
    broken = files.select("file", F.explode_outer("faults").alias("x")).unionByName(checked.select("file", F.explode_outer("faults").alias("x")))
    return checked.drop("faults"), broken.where("x is not null").select("file", "x.*")


def load(name: str, docs: DataFrame) -> DataFrame:
    """The records, if no file has a violation; else ``ConfigInvalid`` with the first hundred, by file and path."""
    records, broken = check(name, docs)
    first = broken.orderBy("file", "path", "rule").take(100)
    if first:
        raise ConfigInvalid([Violation(*r) for r in first])
    return records


def valid(name: str, docs: DataFrame) -> DataFrame:
    """The records of the files that have no violation: one bad file stops only itself."""
    records, broken = check(name, docs)
    return records.join(broken.select("file").distinct(), "file", "left_anti")
