"""Lookup joins over declared references, dictionary joins, and integrity of references.

A join is left and one-to-one: the target row whose id, as a string, equals the key, as a string, becomes a struct under the
alias, or null. Ids and keys of one kind are compared as they are, which is the same and keeps bucketing and statistics of
use. Of several target rows with one id the last one wins. A key that is not a string or a number refers to nothing. Mode
strict fails on a key without target, warn and cascade give null.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import JoinLeg
from .errors import DanglingReference, RowCeiling
from .predicates import column_at, fresh, kind_of_type, type_at
from .shared import checkpointed

#: The usual ceiling of a join side, for max_rows="default"; beyond WARN of a ceiling a warning is given.
DEFAULT_MAX_ROWS, WARN = 50_000, 0.8
#: The nested-loop strategy broadcasts target sides of at most so many rows; others are left to Catalyst.
NESTED_ROWS = 100_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_key(df: DataFrame, path: str):
    """The field as a lookup key, null where it cannot be one."""
    t = type_at(df.schema, path)
    if kind_of_type(t) not in ("string", "number"):
        return F.lit(None).cast("string")
    column = column_at(df.schema, path)
    if isinstance(t, (T.DoubleType, T.FloatType)):  # 1.0 is written 1
        column = F.when((column == F.floor(column)) & (F.abs(column) < 1e15), column.cast("long").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


def _native(left: DataFrame, path: str, right: DataFrame, id_col: str) -> bool:
    """Both sides hold whole numbers, or both text: equal as they are exactly where equal as strings."""
    a, b = type_at(left.schema, path), type_at(right.schema, id_col)
    return (isinstance(a, _WHOLE) and isinstance(b, _WHOLE)) or (isinstance(a, T.StringType) and isinstance(b, T.StringType))


def _keys(left: DataFrame, path: str, right: DataFrame, id_col: str):
    """The key of the left and the id of the right, in a form in which they can be compared."""
    if _native(left, path, right, id_col):
        return column_at(left.schema, path), column_at(right.schema, id_col)
    return as_key(left, path), as_key(right, id_col)


def last_per_id(right: DataFrame, id_col: str, seq: str | None) -> DataFrame:
    """The last row of each id, by the order of seq, or of the scan; partial aggregates keep one row an id and task."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    rows = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("row"), order.alias("order"))
    return rows.groupBy(F.col(f"row.`{id_col}`").alias("id")).agg(F.max_by("row", "order").alias("row")).select("row.*")


def check_rows(df: DataFrame, ceiling: int | str | None, side: str) -> None:
    """Fails beyond a ceiling, warns from 80 % of it on; reads one row beyond the ceiling at most."""
    if ceiling is None:
        return
    ceiling = DEFAULT_MAX_ROWS if ceiling == "default" else ceiling
    found = df.limit(ceiling + 1).count()
    if found > ceiling:
        raise RowCeiling(f"the {side} side of the join has more than {ceiling} rows")
    if found >= WARN * ceiling:
        warnings.warn(f"the {side} side of the join has {found} rows, near its ceiling of {ceiling}", stacklevel=3)


def lookup_join(left: DataFrame, right: DataFrame, leg: JoinLeg, id_col: str = "id", seq: str | None = None, unique: bool = False) -> DataFrame:
    """Attaches the target struct under the alias; unique: the target ids are known to be, which saves an aggregate."""
    check_rows(left, leg.max_rows, "left")
    check_rows(right, leg.max_rows, "right")
    if leg.mode == "strict":
        require_targets(left, right, leg.path, id_col)
    target = right if unique else last_per_id(right, id_col, seq)
    mine, theirs = _keys(left, leg.path, right, id_col)
    key, at, row = (fresh(left, n) for n in ("_key", "_target", "_row"))
    whole = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    target = target.select(theirs.alias(at), whole.alias(row)).where(F.col(at).isNotNull())
    if leg.strategy == "hash":
        target = target.hint("shuffle_hash")
    elif leg.strategy == "nested" and target.limit(NESTED_ROWS + 1).count() <= NESTED_ROWS:
        target = target.hint("broadcast")
    joined = left.withColumn(key, mine).join(target, F.col(key) == F.col(at), "left")
    return joined.withColumn(leg.alias, F.col(row)).drop(key, at, row)


def require_targets(left: DataFrame, right: DataFrame, path: str, id_col: str = "id") -> None:
    """Fails if a key that is not null has no target; one row is enough to know."""
    found = dangling(left, right, path, id_col, "_value").select("_value").limit(1).collect()
    if found:
        raise DanglingReference(f"{path!r} refers to {found[0]['_value']!r}, which is not there")


def dangling(left: DataFrame, right: DataFrame, path: str, id_col: str = "id", value: str = "_key") -> DataFrame:
    """Rows of left, with their key as `value`, whose key is not null and has no target, or is of no kind that can be a key."""
    mine, theirs = _keys(left, path, right, id_col)
    key = fresh(left, "_own")
    keyed = left.where(column_at(left.schema, path).isNotNull()).withColumn(key, mine)
    targets = right.select(theirs.alias("_target")).where("_target is not null")
    found = keyed.join(targets, F.col(key) == F.col("_target"), "left_anti")
    return found.withColumn(value, F.col(key).cast("string")).drop(key)


def dictionary_join(left: DataFrame, dictionary: DataFrame, path: str, alias: str, locales: tuple[str, ...] = ()) -> DataFrame:
    """Attaches {key, labels, one field a locale} of a dictionary (key, labels map), or null."""
    key, at, row = (fresh(left, n) for n in ("_key", "_target", "_row"))
    fields = [F.col("key"), F.col("labels"), *[F.try_element_at("labels", F.lit(x)).alias(x) for x in locales]]
    entries = dictionary.dropDuplicates(["key"]).select(F.col("key").alias(at), F.struct(*fields).alias(row))
    joined = left.withColumn(key, as_key(left, path)).join(entries, F.col(key) == F.col(at), "left")
    return joined.withColumn(alias, F.col(row)).drop(key, at, row)


def integrity_report(collections: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str]]) -> DataFrame:
    """(collection, id, field, target, value) of every reference (collection, field, target) that does not hold."""
    parts = []
    for name, path, target in references:
        (df, id_col), (to, to_id) = collections[name], collections[target]
        lost = dangling(df, to, path, to_id, "_value")
        row = F.lit(name).alias("collection"), F.col(id_col).cast("string").alias("id"), F.lit(path).alias("field")
        parts.append(lost.select(*row, F.lit(target).alias("target"), F.col("_value").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def cascade_delete(collections: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str, str]], name: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Ids (column id) that go when rows of `name` go: strict referrers fail, cascading ones follow, until none is added.

    A round is one semi join a reference; cycles end because ids that are gone already are not added again. Each round's
    ids are written to the checkpoint folder, so that plans stay short however deep references go.
    """
    gone = {name: checkpointed(ids.select(F.col("id").cast("string").alias("id")).distinct())}
    fresh_ids = dict(gone)
    while fresh_ids:
        found: dict[str, DataFrame] = {}
        for source, path, target, mode in references:
            if target not in fresh_ids:
                continue
            df, id_col = collections[source]
            keyed = df.select(F.col(id_col).cast("string").alias("id"), as_key(df, path).alias("_key"))
            hit = keyed.join(fresh_ids[target].withColumnRenamed("id", "_key"), "_key", "left_semi").select("id")
            if source in gone:
                hit = hit.join(gone[source], "id", "left_anti")
            if mode == "strict" and not hit.isEmpty():
                raise DanglingReference(f"{source}.{path} still refers to {target}")
            if mode == "cascade":
                found[source] = found[source].union(hit) if source in found else hit
        fresh_ids = {s: f for s, hits in found.items() if not (f := checkpointed(hits.distinct())).isEmpty()}
        for s, f in fresh_ids.items():
            gone[s] = gone[s].union(f) if s in gone else f
    return gone
