"""Differences: of collections by id, of records field by field, as JSON patches; and import plans.

All of it is Columns and joins. A field that only one side has counts as null on the other; structs are compared field by
field (paths a.b), lists by place (a[0]), anything else as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import column_at

POLICIES = ("merge", "replace", "insert-only")
CHANGE = "array<struct<path:string,type:string,from:string,to:string>>"


def _fields(live: DataFrame, candidate: DataFrame, id_col: str) -> list[str]:
    """Fields of either side, those of the live side first."""
    return [c for c in dict.fromkeys([*live.columns, *candidate.columns]) if c != id_col]


def _side(df: DataFrame, name: str, id_col: str, columns: list[str], types: dict) -> DataFrame:
    values = [(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in columns]
    return df.select(F.col(id_col).alias(f"_{name}_id"), F.struct(*values).alias(name))


def collection_diff(live: DataFrame, candidate: DataFrame, id_col: str = "id", columns: list[str] | None = None, unchanged: bool = False) -> DataFrame:
    """id, change (added, modified, deleted, unchanged), fields_changed, and both sides as structs old and new.

    One full outer join on the id; fields are compared null-safe on the JVM. By default the fields of both sides count.
    """
    columns = columns or _fields(live, candidate, id_col)
    types = {f.name: f.dataType for f in [*candidate.schema.fields, *live.schema.fields]}
    joined = _side(live, "old", id_col, columns, types).join(_side(candidate, "new", id_col, columns, types), F.col("_old_id") == F.col("_new_id"), "full_outer")
    differ = [F.when(~F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`")), F.lit(c)) for c in columns]
    changed = F.filter(F.array(*differ), lambda x: x.isNotNull()) if differ else F.array().cast("array<string>")
    kind = F.when(F.col("_old_id").isNull(), "added").when(F.col("_new_id").isNull(), "deleted").when(F.size("_changed") > 0, "modified").otherwise("unchanged")
    out = joined.withColumn("_changed", changed).withColumn("change", kind)
    fields = F.when(F.col("change") == "modified", F.col("_changed")).otherwise(F.array().cast("array<string>")).alias("fields_changed")
    out = out.select(F.coalesce("_old_id", "_new_id").alias(id_col), "change", fields, "old", "new")
    return out if unchanged else out.where("change <> 'unchanged'")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: how many were added, modified, deleted."""
    return diff.agg(*[F.count(F.when(F.col("change") == k, 1)).alias(k) for k in ("added", "modified", "deleted")])


def json_of(value: Column) -> Column:
    """A value as JSON text; null stays null."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.substring(whole, 2, F.length(whole) - 2))


def _change(path: Column, old: Column, new: Column) -> Column:
    kind = F.when(old.isNull(), "added").when(new.isNull(), "removed").otherwise("changed")
    return F.struct(path.alias("path"), kind.alias("type"), json_of(old).alias("from"), json_of(new).alias("to"))


def changes(old: Column, new: Column, t: T.DataType, path: Column | str = "") -> Column:
    """Array of changes (path, type, from, to as JSON) between two values of one type."""
    at, root = (F.lit(path), path == "") if isinstance(path, str) else (path, False)
    if isinstance(t, T.StructType):
        inner = [changes(old.getField(f.name), new.getField(f.name), f.dataType, F.concat(at, F.lit(f.name if root else f".{f.name}"))) for f in t.fields]
        whole = F.array(_change(at, old, new)).cast(CHANGE)
        both = F.concat(*inner) if inner else F.array().cast(CHANGE)
        if root:
            return both
        return F.when(old.isNull() & new.isNull(), F.array().cast(CHANGE)).when(old.isNull() | new.isNull(), whole).otherwise(both)
    if isinstance(t, T.ArrayType):
        n = F.greatest(F.coalesce(F.size(old), F.lit(0)), F.coalesce(F.size(new), F.lit(0)))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        each = F.transform(places, lambda i: changes(F.get(old, i), F.get(new, i), t.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(old.eqNullSafe(new), F.array().cast(CHANGE)).when(old.isNull() | new.isNull(), F.array(_change(at, old, new)).cast(CHANGE)).otherwise(F.flatten(each))
    same = F.to_json(F.array(old)).eqNullSafe(F.to_json(F.array(new))) if isinstance(t, T.MapType) else old.eqNullSafe(new)
    return F.when(same, F.array().cast(CHANGE)).otherwise(F.array(_change(at, old, new)).cast(CHANGE))


def field_diffs(diff: DataFrame) -> DataFrame:
    """The modified rows of a collection_diff with field_diffs: (path, type added / removed / changed, from, to)."""
    modified = diff.where("change = 'modified'")
    return modified.withColumn("field_diffs", changes(F.col("old"), F.col("new"), diff.schema["old"].dataType))


def format_changes(found: Column) -> Column:
    """Changes as text: a line each, + added, - removed, ~ changed; (no changes) if there are none."""

    def line(c):
        added, removed = F.concat(F.lit("+ "), c["path"], F.lit(": "), c["to"]), F.concat(F.lit("- "), c["path"], F.lit(": "), c["from"])
        return F.when(c["type"] == "added", added).when(c["type"] == "removed", removed).otherwise(F.concat(F.lit("~ "), c["path"], F.lit(": "), c["from"], F.lit(" → "), c["to"]))

    return F.when(F.size(found) == 0, "(no changes)").otherwise(F.array_join(F.transform(found, line), "\n"))


def vault_diff(live: dict[str, tuple[DataFrame, str]], candidate: dict[str, tuple[DataFrame, str]], collections: list[str] | None = None, unchanged: bool = False) -> DataFrame:
    """collection, id, change, fields_changed (top-level names), field_diffs over all collections (DataFrame, id) of either side.

    Names that start with _ are left out; a collection that one side lacks is all added or all deleted. Ids become text.
    """
    parts = []
    for name in sorted({*live, *candidate}):
        if name.startswith("_") or (collections is not None and name not in collections):
            continue
        (a, key), (b, other) = live.get(name, (None, None)), candidate.get(name, (None, None))
        if a is None:
            a, key = b.limit(0), other
        elif b is None:
            b, other = a.limit(0), key
        found = collection_diff(a, b if other == key else b.withColumnRenamed(other, key), key, unchanged=unchanged)
        fields = F.when(F.col("change") == "modified", changes(F.col("old"), F.col("new"), found.schema["old"].dataType)).otherwise(F.array().cast(CHANGE))
        parts.append(found.select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"), "change", "fields_changed", fields.alias("field_diffs")))
    return reduce(DataFrame.unionByName, parts)


def format_vault_diff(diff: DataFrame, detail: str = "full") -> DataFrame:
    """Column line: the counts; one line a changed record with one-line; and a line a changed field with full.

    The lines are in the order of `place` (0 for the counts, then collection and id); nothing is gathered in one task.
    """
    count = diff.agg(*[F.count(F.when(F.col("change") == k, 1)).alias(k) for k in ("added", "modified", "deleted")])
    head = F.format_string("%d added · %d modified · %d deleted", "added", "modified", "deleted")
    out = count.select(F.lit(0).alias("place"), F.lit("").alias("collection"), F.lit("").alias("id"), head.alias("line"))
    if detail == "count":
        return out
    sign = F.when(F.col("change") == "added", "+").when(F.col("change") == "deleted", "-").otherwise("~")
    record = F.concat_ws(" ", sign, F.concat("collection", F.lit("/"), "id"))
    if detail == "one-line":
        line = F.when(F.col("change") == "modified", F.concat(record, F.lit(" ("), F.array_join("fields_changed", ", "), F.lit(")"))).otherwise(record)
    else:
        line = F.when(F.col("change") == "modified", F.concat(record, F.lit("\n"), format_changes(F.col("field_diffs")))).otherwise(record)
    return out.unionByName(diff.where("change <> 'unchanged'").select(F.lit(1).alias("place"), "collection", "id", line.alias("line")))


def import_plan(live: DataFrame, candidate: DataFrame, policy: str, id_col: str = "id") -> DataFrame:
    """The collection after an import: merge adds and changes, replace also deletes, insert-only adds. Fields of both sides stay."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    diff = collection_diff(live, candidate, id_col, unchanged=True)
    if policy == "replace":
        diff = diff.where("change <> 'deleted'")
    new = F.col("change") == "added" if policy == "insert-only" else F.col("change").isin("added", "modified")
    return diff.withColumn("_row", F.when(new, F.col("new")).otherwise(F.col("old"))).select(id_col, "_row.*")


def patch_json(old: Column, new: Column, t: T.StructType) -> Column:
    """JSON patch (add, remove, replace) from one struct to another: structs field by field, lists and other values whole."""

    def steps(a, b, t, path):
        for f in t.fields:
            x, y, at = a.getField(f.name), b.getField(f.name), f"{path}/{f.name.replace('~', '~0').replace('/', '~1')}"
            if isinstance(f.dataType, T.StructType):
                inside = F.filter(F.array(*steps(x, y, f.dataType, at)), lambda s: s.isNotNull())
                yield F.when(x.isNotNull() & y.isNotNull(), F.nullif(F.array_join(inside, ", "), F.lit(""))).otherwise(step(x, y, at))
            else:
                yield step(x, y, at)

    def step(x, y, at):
        head = lambda op: F.lit(f'{{"op": "{op}", "path": "{at}"')
        value = F.concat(F.lit(', "value": '), json_of(y), F.lit("}"))
        added, replaced = F.concat(head("add"), value), F.concat(head("replace"), value)
        return F.when(x.eqNullSafe(y), F.lit(None).cast("string")).when(x.isNull(), added).when(y.isNull(), F.concat(head("remove"), F.lit("}"))).otherwise(replaced)

    found = F.filter(F.array(*steps(old, new, t, "")), lambda s: s.isNotNull())
    return F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]"))


def reverse_deltas(writes: DataFrame, columns: list[str], id_col: str = "id", version: str = "_v") -> DataFrame:
    """id, version, path, value: what a write replaced, field by field (JSON of the old value, null if there was none)."""
    before = writes.select(F.col(id_col).alias("_id"), (F.col(version) + 1).alias("_next"), F.struct(*columns).alias("_old"))
    both = writes.join(before, (F.col(id_col) == F.col("_id")) & (F.col(version) == F.col("_next")))
    one = lambda c: F.when(~F.col(f"_old.`{c}`").eqNullSafe(F.col(f"`{c}`")), F.struct(F.lit(c).alias("path"), json_of(F.col(f"_old.`{c}`")).alias("value")))
    found = both.select(id_col, version, F.explode(F.filter(F.array(*[one(c) for c in columns]), lambda x: x.isNotNull())).alias("_d"))
    return found.select(id_col, version, "_d.path", "_d.value")


def reconstruct(current: DataFrame, deltas: DataFrame, version: int, id_col: str = "id", at: str = "_v") -> DataFrame:
    """Records as of a version, from the current ones and reverse deltas (id, version, path, value).

    The value of a field is what the first later write of that field replaced: one aggregate (min_by) an id and field.
    """
    first = deltas.where(F.col(at) > version).groupBy(id_col, "path").agg(F.min_by(F.struct("value"), at).alias("_was"))
    back = first.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("path", "_was"))).alias("_back"))  # one entry a field
    joined = current.join(back.withColumnRenamed(id_col, "_id"), F.col(id_col) == F.col("_id"), "left")

    def field(c):
        was = F.try_element_at("_back", F.lit(c))
        kind = current.schema[c].dataType.simpleString()
        old = F.from_json(F.concat(F.lit('{"x":'), was["value"], F.lit("}")), f"x {kind}")["x"]
        return F.when(was.isNotNull(), old).otherwise(column_at(current.schema, c)).alias(c)

    return joined.select(id_col, *[field(c) for c in current.columns if c != id_col])
