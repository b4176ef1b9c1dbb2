"""Documents a row at a time against the walker that checks one file."""

import copy
import random

import pytest
import yaml

from headwater.sources import config_files as cf
from headwater.sources import config_rows as cr

GOOD = {
    "municipality": {"name": "N", "fips_code": "01", "area_km2": {"value": 5, "provenance": "derived", "source": None}, "population": {"value": "7", "reference_year": 2020.0}, "bounding_box": {"min_lon": "-1.5", "max_lon": True}},
    "sources": {"a": {"format": "csv", "reference_year": " 1990 ", "provenance": "observed"}, "b": {}},
    "shelters": [{"id": "T1", "lon": 1, "lat": "2e1", "accessible": "no", "capacity": {"value": 3.0}, "activation_lead_time_hours": {"value": "soon"}}, {"id": "T2", "accessible": 1}],
    "eligibility": {"r": {"x": 1}, "s": None},
    "scenarios": [{"id": "a", "label": "b", "provenance": "observed", "inundation_depth_threshold_m": {"value": True}, "return_period_years": "10"}],
    "experiments": [{"id": "a", "label": "b", "provenance": "derived", "seed": "42", "parameters": {"p": [1, 2]}, "extra": 0}],
}
VALUES = [None, True, False, 0, 1, 2, 7.0, 7.5, -3, 2**62, 2**70, 1e30, float("inf"), float("nan"), "", "x", "yes", "OFF", "1", " 12 ", "1_000", "1.5", "1e3", "nan", "1d", "observed", "Observed", "1.0", [], [1], {}, {"value": 1}, {"id": 3}]


def places(node, path=()):
    yield path
    for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        yield from places(v, (*path, k))


def mutated(rnd, doc):
    doc = copy.deepcopy(doc)
    for _ in range(rnd.randint(0, 3)):
        *head, last = rnd.choice([p for p in places(doc) if p] or [("schema_version",)])
        at = doc
        for k in head:
            at = at[k]
        if rnd.random() < 0.3:
            at.pop(last, None) if isinstance(at, dict) else at.pop(last)
        else:
            at[last] = copy.deepcopy(rnd.choice(VALUES))
    return doc


def plain(kind, v):
    """A typed record as the walker has it."""
    if v is None:
        return None
    if isinstance(kind, dict):
        return {k: plain(f.kind, v[k]) for k, f in kind.items()}
    if kind in ("scalar", "free"):
        return v.toPython() if hasattr(v, "toPython") else v
    return v


@pytest.mark.parametrize("name", sorted(cf.FILES))
def test_equals_the_walker(spark, name):
    payload, kind = cf.FILES[name]
    rnd, docs = random.Random(name), {}
    for i in range(150):
        docs[str(i)] = mutated(rnd, {"schema_version": "1.0", payload: GOOD[payload]})
    rows = [(i, yaml.safe_dump(d)) for i, d in docs.items()]
    records, broken = cr.check(name, spark.createDataFrame(rows, "file string, text string"))
    got, held = {}, {}
    for r in broken.collect():
        got.setdefault(r["file"], []).append((r["path"], r["rule"], r["expected"]))
    for r in records.collect():
        held.setdefault(r["file"], []).append(r)
    for i, text in rows:
        out, found = cf.check(name, cf.parse_yaml(text))
        assert sorted(got.get(i, [])) == sorted((v.path, v.rule, v.expected) for v in found), text
        if out is None:
            continue
        body, mine = out[payload], held.get(i, [])
        if kind == "free":
            assert {r["key"] for r in mine} == set(body)
        elif isinstance(kind, dict):
            assert same(plain(kind, mine[0]["record"]), body)
        elif kind[0] == "map":
            assert {r["key"] for r in mine} == set(body) and all(same(plain(kind[1], r["record"]), body[r["key"]]) for r in mine)
        else:
            assert [r["place"] for r in sorted(mine, key=lambda r: r["place"])] == list(range(len(body)))
            assert all(same(plain(kind[1], r["record"]), body[r["place"]]) for r in mine)


def same(a, b):
    if isinstance(b, dict):
        return isinstance(a, dict) and a.keys() == b.keys() and all(same(a[k], b[k]) for k in b)
    return a == b or a != a and b != b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and float(a) == float(b)


def test_unreadable_odd_and_empty_texts(spark):
    rows = [("a", "a: [1"), ("b", "x: 1\n---\ny: 2\n"), ("c", None), ("d", ""), ("e", "just text"), ("f", 'schema_version: "1.0"\nshelters: []\n'), ("g", 'schema_version: "1.0"\nshelters:\n- {id: 2020-01-01}\n')]
    records, broken = cr.check("shelters", spark.createDataFrame(rows, "file string, text string"))
    assert sorted((r["file"], r["path"], r["rule"]) for r in broken.collect()) == [
        ("a", "", "syntax"), ("b", "", "syntax"), ("c", "", "type"), ("d", "", "type"), ("e", "", "type"), ("g", "shelters[0].id", "type")
    ]
    assert {r["file"] for r in records.collect()} == {"g"}
    assert cr.valid("shelters", spark.createDataFrame(rows, "file string, text string")).count() == 0
    records, broken = cr.check("shelters", spark.createDataFrame([], "file string, text string"))
    assert records.count() == broken.count() == 0


def test_keys_that_are_no_text(spark):
    _, broken = cr.check("data_sources", spark.createDataFrame([("a", 'schema_version: "1.0"\nsources:\n  1: {}\n  b: {}\n')], "file string, text string"))
    assert [(r["path"], r["rule"], r["expected"]) for r in broken.collect()] == [("sources.1", "type", "string key")]


def test_files_and_failures(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(yaml.safe_dump({"schema_version": "1.0", "scenarios": GOOD["scenarios"]}))
    (tmp_path / "b.yaml").write_text(yaml.safe_dump({"schema_version": "2.0", "scenarios": GOOD["scenarios"]}))
    docs = cr.documents(spark, str(tmp_path))
    assert docs.count() == 2 and cr.valid("scenarios", docs).select("record.id").collect()[0][0] == "a"
    assert cr.load("scenarios", docs.where("file like '%a.yaml'")).count() == 1
    with pytest.raises(cf.ConfigInvalid, match="schema_version"):
        cr.load("scenarios", docs)


def test_kinds_are_taken_out_once(spark):
    """A filter that Spark infers for an exploded array must not take every place out of the records again."""
    _, broken = cr.check("experiments", spark.createDataFrame([("a", "x: 1")], "file string, text string"))
    plan = broken._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SchemaOfVariant.schemaOfVariant(") <= 20  # 14 places of a record, 3 of a file, and the filter of files


@pytest.mark.parametrize(
    "text",
    [
        "a: &x {p: 1}\nb: {<<: *x, q: 2}\nc: [*x, *x]\n", "a: 1\na: 2\n", "1: a\n'1': b\nnull: c\n", "? [a]\n: 1\n", "a: !!set {x, y}\n", "a: !!omap [x: 1]\n", "a: !!binary aGk=\n", "a: !!str 5\nb: !!int '7'\n",
        "a: !!int x\n", "a: !other 1\n", "&a [*a]\n", "a: 2020-01-01\nb: .inf\nc: 0x1F\nd: 1_000\ne: 1e3\nf: ~\ng: 'yes'\nh: yes\n", "a: =\n", "=: 1\n", "- é\n- \"\\u2028\"\n", "a: " + "x" * 300, "", "a: [1", "x: 1\n---\ny: 2\n", "\x00", "a: b: c", "'a': " + "[" * 50 + "]" * 50,
    ],
)
def test_json_is_that_of_the_safe_loader(text):
    def of(f):
        odd = []
        try:
            return f(odd), odd
        except (yaml.YAMLError, RecursionError, ValueError) as e:
            return type(e), str(e)[:200]

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    assert of(lambda odd: cr._body(text, odd)) == of(lambda odd: cr.json.dumps(cr._plain(yaml.load(text, Loader=loader), "", odd)))
