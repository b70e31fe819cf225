"""Predicates against a plain reading of their rules, with nulls, mismatched types, NaN and nested values."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.predicates import compile_clause
from folioflow.operators.query import Collection, Engine
from folioflow.operators.errors import IndexRequired, UndeclaredReference
from folioflow.plans import FieldClause, GroupClause, adapters

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("year", T.IntegerType()), T.StructField("status", T.StringType()),
        T.StructField("paid", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("who", T.StructType([T.StructField("name", T.StringType())])),
    ]
)
ROWS = [
    (i, a, y, s, p, t, w)
    for i, (a, y, s, p, t, w) in enumerate(
        (a, y, s, p, t, w)
        for a in (None, 0.0, -0.0, math.nan, math.inf, 100.0)
        for y, s, p in ((None, None, None), (2024, "", True), (2025, "open", False), (2024, "paid", True))
        for t, w in ((None, None), (["x", None], ("ann",)), (["y"], (None,)))
    )
]


def kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "null" if v is None else "other"


def read(row, path):
    names = [f.name for f in SCHEMA]
    head, *rest = path.split(".")
    v = row[names.index(head)] if head in names else None
    for p in rest:
        v = v[0] if isinstance(v, tuple) and p == "name" else v[int(p)] if isinstance(v, list) and p.isdigit() and int(p) < len(v) else None
    return v


def same(a, b):
    return kind(a) == kind(b) and a == b


def less(a, op, b):
    if kind(a) != kind(b) or kind(a) not in ("number", "string"):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def holds(row, c):
    if isinstance(c, GroupClause):
        return (any if c.how == "or" else all)(holds(row, x) for x in c.clauses)
    v, op, x = read(row, c.path), c.op, c.value
    if op in ("==", "!="):
        return same(v, x) == (op == "==")
    if op in ("<", "<=", ">", ">="):
        return less(v, op, x)
    if op == "in":
        return any(same(v, y) or (isinstance(v, float) and isinstance(y, float) and math.isnan(v) and math.isnan(y)) for y in x) if isinstance(x, list) else False
    if op == "contains":
        return x in v if isinstance(v, str) and isinstance(x, str) else any(same(x, y) for y in v) if isinstance(v, list) else False
    if op == "startsWith":
        return isinstance(v, str) and isinstance(x, str) and v.startswith(x)
    return isinstance(x, list) and len(x) == 2 and less(v, ">=", x[0]) and less(v, "<=", x[1])


VALUES = [None, 0, 100.0, math.nan, math.inf, 2024, "", "open", "2024", True, False]


def clause(rng, depth=0):
    if depth < 2 and rng.random() < 0.25:
        return GroupClause(rng.choice(["or", "and"]), tuple(clause(rng, depth + 1) for _ in range(rng.randint(0, 3))))
    path, op = rng.choice(["amount", "year", "status", "paid", "tags", "who.name", "none", "tags.0"]), rng.choice(["==", "!=", "<", "<=", ">", ">=", "in", "contains", "startsWith", "between"])
    value = rng.choice(VALUES)
    if op == "in" and rng.random() < 0.9:
        value = rng.sample(VALUES, rng.randint(0, 4))
    if op == "between" and rng.random() < 0.9:
        value = [rng.choice(VALUES), rng.choice(VALUES)]
    return FieldClause(path, op, value)


def test_random_clauses_equal_plain_reading(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rng = random.Random(11)
    clauses = [clause(rng) for _ in range(120)]
    out = df.select("id", *[compile_clause(df, c).alias(f"c{k}") for k, c in enumerate(clauses)]).collect()
    for row in out:
        for k, c in enumerate(clauses):
            assert row[f"c{k}"] is not None
            assert row[f"c{k}"] == holds(ROWS[row["id"]], c), (c, ROWS[row["id"]])


def test_groups_commute_and_empty_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    a, b = FieldClause("status", "==", "open"), FieldClause("amount", ">", 1)
    ids = lambda c: {r["id"] for r in df.where(compile_clause(df, c)).select("id").collect()}
    assert ids(GroupClause("or", (a, b))) == ids(GroupClause("or", (b, a)))
    assert ids(GroupClause("or", ())) == set()
    assert len(ids(GroupClause("and", ()))) == len(ROWS)


def test_plan_and_errors(spark):
    e = Engine()
    e.add(Collection("c", spark.createDataFrame(ROWS, SCHEMA), "id", "id", indexes=(("status", "year"),)))
    q = e.query("c").where("status", "==", "open").filter(lambda df: F.col("year") > 1).order_by("year", "desc").limit(3)
    plan = q.to_plan()
    assert plan["clauses"][1] == {"type": "filter", "fn": "[function]"} and plan["orderBy"] == [{"field": "year", "direction": "desc"}] and plan["limit"] == 3
    assert q.count() == 18 and len(q.to_array()) == 3
    with pytest.raises(UndeclaredReference):
        e.query("c").join("status", "x")
    with pytest.raises(IndexRequired):
        e.lazy("c").where("amount", ">", 1).to_df()
    assert e.lazy("c").where("status", "==", "paid").where("year", "==", 2024).limit(5).count() == 5
    rows, cursor = e.query("c").page_after(None, 10)
    assert [r["id"] for r in rows] == list(range(10)) and cursor == 9
    assert sum(1 for _ in e.query("c").pages()) == len(ROWS)


def test_adapters_round_trip(spark):
    e = Engine()
    e.add(Collection("c", spark.createDataFrame(ROWS, SCHEMA), "id", "id"))
    state = {"columnFilters": [{"id": "status", "value": ["open", "paid"]}], "sorting": [{"id": "year", "desc": True}], "pagination": {"pageIndex": 1, "pageSize": 5}}
    assert adapters.to_table_state(adapters.from_table_state(e.query("c"), state)) == state
    assert adapters.coerce("true") is True and adapters.coerce("1.5") == 1.5 and adapters.coerce("1x") == "1x" and adapters.coerce("") == ""
    with pytest.raises(ValueError):
        adapters.from_params(e.query("c"), {"where": "a:like:b"})
