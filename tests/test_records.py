import json
from collections import Counter

from wardline.sources import records

TEXTS = [
    '{"id": 1, "results": [{"a": 1}, {"a": "x", "b": {"c": [1, 2, null]}}, 7, []], "odd key": true}',
    '{"id": "2", "results": {"a": 1}, "a.b": 1.5, "a": {"b": 2}}',
    '{"id": null, "results": []}',
    "[1, [2, [3]]]", "null", '"text"', "{broken", '{"id": 3,}', "", "  \n", None, '{"id": 99999999999}', "{}",
]


def walked(value, path="$"):
    """(path, kind) of a value and all it holds, in plain Python."""
    if isinstance(value, dict):
        yield path, "OBJECT"
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}" if k.isidentifier() else f'{path}[{{"key":{json.dumps(k)}}}]')
    elif isinstance(value, list):
        yield path, "ARRAY"
        for v in value:
            yield from walked(v, f"{path}[]")
    else:
        yield path, "VOID" if value is None else "BOOLEAN" if isinstance(value, bool) else "STRING" if isinstance(value, str) else "BIGINT" if isinstance(value, int) else "DECIMAL"


def loads(text):
    try:
        return [json.loads(text)] if text and text.strip() else []
    except ValueError:
        return []


def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, value string").repartition(3)


def test_fields_of_ragged_records_and_rejects(spark):
    good, bad = records.parsed_records(table(spark))
    assert sorted(r["value"] for r in bad.collect()) == sorted(["{broken", '{"id": 3,}']) and good.columns == ["i", "record"]
    want = Counter(x for t in TEXTS for v in loads(t) for x in walked(v))
    got = {(r["path"], r["kind"]): r["n"] for r in records.record_fields(good).collect()}
    assert got == want
    assert records.record_fields(good.limit(0)).collect() == []


def test_entries_and_columns(spark):
    good, _ = records.parsed_records(table(spark))
    entries = records.record_entries(good.select("i", "record"), "$.results")
    rows = records.record_columns(entries.drop("record"), {"a": ("$.a", "int"), "c": ("$.b.c[1]", "int")}, "entry").drop("entry").collect()
    assert sorted((r["i"], r["place"], r["a"], r["c"], tuple(r["unfit"])) for r in rows) == [(0, 0, 1, None, ()), (0, 1, None, 2, ("a",)), (0, 2, None, None, ()), (0, 3, None, None, ())]
    ids = {r["i"]: (r["id"], r["unfit"]) for r in records.record_columns(good, {"id": ("$.id", "int")}).drop("record").collect()}
    assert ids[0] == (1, []) and ids[1] == (2, []) and ids[2] == (None, []) and ids[11] == (None, ["id"]) and ids[4] == (None, [])
