"""Edits of a tag store: one row (path, tags) per tracks, tags normalised, each once, in order.

An edit gives a new store; tracks that have no tag left have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(tag: Column | str) -> Column:
    return F.lower(F.trim(F.col(tag) if isinstance(tag, str) else tag))


def store(rows: DataFrame, key: str = "path") -> DataFrame:
    """The store of rows (key, tag)."""
    named = rows.select(key, normal("tag").alias("tag")).where("tag <> ''")
    return named.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def rows(tags: DataFrame, key: str = "path") -> DataFrame:
    return tags.select(key, F.explode("tags").alias("tag"))


def add(tags: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """With rows (key, tag) added."""
    return store(rows(tags, key).unionByName(new.select(key, "tag")), key)


def remove(tags: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Without rows (key, tag)."""
    return store(rows(tags, key).join(gone.select(key, normal("tag").alias("tag")), [key, "tag"], "left_anti"), key)


def remove_everywhere(tags: DataFrame, tag: str) -> DataFrame:
    return tags.withColumn("tags", F.array_remove("tags", normal(F.lit(tag)))).where(F.size("tags") > 0)


def clear(tags: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """Without the tags of some tracks (key)."""
    return tags.join(keys.select(key), key, "left_anti")


def search(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.array_contains("tags", normal(F.lit(tag))))


def all_tags(tags: DataFrame, key: str = "path") -> DataFrame:
    return rows(tags, key).select("tag").distinct()
