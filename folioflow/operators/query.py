"""The query builder: an immutable plan over one collection, compiled to one lazy DataFrame.

Order of effect: clauses, order, offset, limit, joins. count, aggregate and group_by use the clauses only. A sort puts
nulls last upwards and first downwards; keys of kinds without an order (booleans, arrays, structs) do not sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ColumnClause, FieldClause, GroupClause, JoinLeg, OrderKey, Plan
from .errors import IndexRequired, UndeclaredReference
from .joins import dictionary_join, lookup_join
from .predicates import COMPARABLE, apply_clauses, column_at, kind_of_type, type_at
from .reducers import MAX_GROUPS, Reducer, group_rows, reduce_rows


@dataclass(frozen=True)
class Collection:
    """A named DataFrame: its id, its order of arrival if it has one, its references and dictionaries."""

    name: str
    df: DataFrame
    id_col: str = "id"
    seq: str | None = None
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # field -> (collection, mode)
    dictionaries: dict[str, str] = field(default_factory=dict)  # field -> dictionary
    indexes: tuple = ()  # names, or tuples of names
    unique: bool = True  # ids are known to be unique

    def get(self, id_value) -> DataFrame:
        """The row of an id, or none; the id reaches the scan as a filter."""
        return self.df.where(F.col(self.id_col) == F.lit(id_value))

    def get_many(self, ids: DataFrame) -> DataFrame:
        """ids (column id) with the row of each as a struct, null where there is none."""
        return lookup_join(ids, self.df, JoinLeg("id", "row", self.name), self.id_col, self.seq, self.unique)

    def find_by_digest(self, path: str, value: str, stored: str | None = None) -> DataFrame:
        """Rows whose field has the digest of a value; stored names a column that holds digests already."""
        digest = F.col(stored) if stored else F.sha2(column_at(self.df.schema, path).cast("string"), 256)
        return self.df.where(digest == F.sha2(F.lit(value), 256))


class Catalog(dict):
    """Things by name; those that are declared by a function are made when they are first asked for."""

    def __init__(self):
        super().__init__()
        self.builders: dict[str, Callable] = {}

    def __missing__(self, name: str):
        if name not in self.builders:
            raise KeyError(name)
        self[name] = self.builders[name]()
        return self[name]


class Engine:
    """Collections and dictionaries by name."""

    def __init__(self):
        self.collections, self.dictionaries = Catalog(), Catalog()

    def declare(self, name: str, build: Callable[[], Collection]) -> None:
        """A collection that is read when a query first needs it."""
        self.collections.builders[name] = build

    def add(self, collection: Collection) -> Collection:
        for path, ref in collection.references.items():
            known = self.collections.get(collection.name)
            if known and known.references.get(path, ref) != ref:
                raise ValueError(f"{collection.name}.{path} is declared as another reference")
        self.collections[collection.name] = collection
        return collection

    def query(self, name: str) -> Query:
        return Query(self, self.collections[name], Plan())

    def scan(self, name: str) -> Query:
        """As query, but its joins come before reducers."""
        return Query(self, self.collections[name], Plan(), scanning=True)

    def lazy(self, name: str) -> Query:
        """As query, but every field it touches must be indexed, and rows without the sort key drop out."""
        return Query(self, self.collections[name], Plan(), indexed=True)


@dataclass(frozen=True)
class Query:
    engine: Engine
    source: Collection
    plan: Plan
    scanning: bool = False
    indexed: bool = False

    def _with(self, **parts) -> Query:
        return replace(self, plan=self.plan.adding(**parts))

    def where(self, path: str, op: str, value) -> Query:
        return self._with(clauses=(FieldClause(path, op, value),))

    def filter(self, build: Callable[[DataFrame], Column]) -> Query:
        return self._with(clauses=(ColumnClause(build),))

    def or_(self, build: Callable[[Query], Query]) -> Query:
        return self._group("or", build)

    def and_(self, build: Callable[[Query], Query]) -> Query:
        return self._group("and", build)

    def _group(self, how: str, build) -> Query:
        inner = build(replace(self, plan=Plan()))  # its order, page and joins do not count
        return self._with(clauses=(GroupClause(how, inner.plan.clauses),))

    def order_by(self, path: str, direction: str = "asc") -> Query:
        return self._with(order=(OrderKey(path, direction == "desc"),))

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def join(self, path: str, alias: str, strategy: str | None = None, max_rows: int | str | None = None) -> Query:
        if path in self.source.dictionaries:
            return self._with(joins=(JoinLeg(path, alias, self.source.dictionaries[path], dictionary=True),))
        declared = self.source.references.get(path)
        if declared is None:  # a path into an earlier alias belongs to that alias's collection
            head, _, rest = path.partition(".")
            leg = next((j for j in self.plan.joins if j.alias == head and not j.dictionary), None)
            declared = self.engine.collections[leg.target].references.get(rest) if leg else None
        if declared is None:
            raise UndeclaredReference(f"{self.source.name}.{path} is not a declared reference")
        return self._with(joins=(JoinLeg(path, alias, declared[0], declared[1], strategy, max_rows),))

    def to_plan(self) -> dict:
        return self.plan.to_dict()

    def _filtered(self) -> DataFrame:
        if self.indexed:
            self._require_indexes()
        return apply_clauses(self.source.df, self.plan.clauses)

    def _touched(self) -> set[str]:
        def of(clauses):
            for c in clauses:
                if isinstance(c, FieldClause):
                    yield c.path
                elif isinstance(c, GroupClause):
                    yield from of(c.clauses)

        return {*of(self.plan.clauses), *(o.path for o in self.plan.order)}

    def _require_indexes(self) -> None:
        have = {p for i in self.source.indexes for p in ((i,) if isinstance(i, str) else i)}
        if missing := self._touched() - have:
            raise IndexRequired(f"no index covers {', '.join(sorted(missing))}")

    def _paged(self) -> DataFrame:
        df = self._filtered()
        keys = []
        for o in self.plan.order:
            sortable = kind_of_type(type_at(df.schema, o.path))
            if sortable in COMPARABLE or (self.indexed and sortable == "boolean"):
                column = column_at(df.schema, o.path)
                keys.append(column.desc_nulls_first() if o.descending else column.asc_nulls_last())
                if self.indexed:
                    df = df.where(column.isNotNull())
        if self.plan.order and self.source.seq:
            keys.append(F.col(self.source.seq).asc())
        if keys:
            df = df.orderBy(*keys)
        if self.plan.offset:
            df = df.offset(self.plan.offset)
        return df if self.plan.limit is None else df.limit(self.plan.limit)

    def _joined(self, df: DataFrame) -> DataFrame:
        for leg in self.plan.joins:
            if leg.dictionary:
                df = dictionary_join(df, self.engine.dictionaries[leg.target], leg.path, leg.alias)
            else:
                to = self.engine.collections[leg.target]
                df = lookup_join(df, to.df, leg, to.id_col, to.seq, to.unique)
        return df

    def to_df(self) -> DataFrame:
        return self._joined(self._paged())

    def to_array(self) -> list:
        return self.to_df().collect()

    def first(self):
        found = self.limit(1).to_array()
        return found[0] if found else None

    def count(self) -> int:
        """Rows of the clauses; a lazy query counts its page."""
        return (self._paged() if self.indexed else self._filtered()).count()

    def pages(self):
        """Rows one by one, a partition at a time in memory."""
        return self._joined(self._filtered()).toLocalIterator(prefetchPartitions=True)

    def page(self, cursor, n: int) -> DataFrame:
        """The next n rows with ids beyond the cursor (None: from the start), in order of id, joins attached."""
        df, key = self._filtered(), self.source.id_col
        return self._joined((df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(n))

    def page_after(self, cursor, n: int) -> tuple[list, object]:
        """The rows of a page, and the next cursor (None at the end)."""
        rows, key = self.page(cursor, n + 1).collect(), self.source.id_col
        return rows[:n], rows[n - 1][key] if len(rows) > n else None

    def list(self, locale: str | None = None, fallback: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
        """to_df in one locale: localised fields (maps locale -> text) become text."""
        from ..functions.i18n import apply_locale

        df = self.to_df()
        return df if locale is None else apply_locale(df, [*fields], locale, fallback)

    def _reducible(self) -> DataFrame:
        return self._joined(self._filtered()) if self.scanning else self._filtered()

    def aggregate(self, spec: dict[str, Reducer]) -> DataFrame:
        return reduce_rows(self._reducible(), spec)

    def group_by(self, path: str, spec: dict[str, Reducer], label: tuple | None = None, max_groups: int | None = MAX_GROUPS) -> DataFrame:
        """Grouped reducers; label: (locale, fallbacks) adds <field>Label from the field's dictionary."""
        out = group_rows(self._reducible(), path, spec, self.source.seq, max_groups)
        if label and path in self.source.dictionaries:
            from ..functions.i18n import with_label

            out = with_label(out, path, self.engine.dictionaries[self.source.dictionaries[path]], *label)
        return out
