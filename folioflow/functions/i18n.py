"""Localised text and dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_text(texts: Column, locale: str, fallback: tuple[str, ...] = (), field: str = "", strict: bool = True) -> Column:
    """A map locale -> text in one locale: empty counts as missing, then the fallbacks ('any': the first that is not empty)."""
    if locale == "raw":
        return texts
    full = lambda c: F.nullif(c, F.lit(""))
    ways = []
    for x in (locale, *fallback):
        ways.append(F.get(F.filter(F.map_values(texts), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)) if x == "any" else full(F.try_element_at(texts, F.lit(x))))
    if not strict:
        return F.coalesce(*ways)
    return F.when(texts.isNull(), F.lit(None)).otherwise(F.coalesce(*ways, F.raise_error(F.lit(f"no text of {field!r} in {locale!r}"))))


def apply_locale(df: DataFrame, fields: list[str], locale: str, fallback: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({f: resolve_text(F.col(f), locale, fallback, f) for f in fields})


def missing_locales(texts: Column, locales: tuple[str, ...], required="all") -> Column:
    """Locales that a required text lacks; required: all, any, or a list of locales."""
    wanted = locales if required in ("all", "any") else tuple(required)
    lack = F.filter(F.array(*[F.lit(x) for x in wanted]), lambda x: F.coalesce(F.try_element_at(texts, x), F.lit("")) == "")
    return F.when(F.size(lack) < len(wanted), F.array().cast("array<string>")).otherwise(lack) if required == "any" else lack


def label_of(labels: Column, locale: str, fallback: tuple[str, ...] = ()) -> Column:
    """A dictionary label: an empty label is one; none in any locale is null."""
    return F.coalesce(*[F.try_element_at(labels, F.lit(x)) for x in (locale, *fallback)])


def with_label(df: DataFrame, field: str, dictionary: DataFrame, locale: str, fallback: tuple[str, ...] = ()) -> DataFrame:
    """Adds <field>Label by a left join on the dictionary (key, labels)."""
    labels = dictionary.select(F.col("key").alias("_key"), label_of(F.col("labels"), locale, fallback).alias(f"{field}Label"))
    return df.join(labels, F.col(field) == F.col("_key"), "left").drop("_key")


def dictionary_put(dictionary: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (key, labels) replace or join those of the same key."""
    return dictionary.join(entries, "key", "left_anti").unionByName(entries)


def dictionary_rename(dictionary: DataFrame, old: str, new: str, referrers: list[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """The dictionary and its referrers (DataFrame, field) with a key renamed."""
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    return dictionary.withColumn("key", to("key")), [df.withColumn(f, to(f)) for df, f in referrers]


def map_of(pairs: dict[str, Column]) -> Column:
    return F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[0]), kv[1]], pairs.items(), []))
