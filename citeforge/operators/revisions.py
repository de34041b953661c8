"""Revisions of a manuscript, and who belongs to a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous(rows: DataFrame, family: list[str], order: list, key: str) -> DataFrame:
    """(key, previous): the revision before each one of its family; those without one leave."""
    last = F.lag(key).over(Window.partitionBy(*family).orderBy(*order))
    return rows.select(key, last.alias("previous")).where("previous is not null")


def diff(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(essay_id, key, change): added, removed, same or changed; of equal keys in a revision the last line counts, then the label last by name."""
    last = lines.groupBy("essay_id", "key").agg(F.max_by("label", F.struct("line", "label")).alias("label"))
    now = pairs.join(last, "essay_id").select("essay_id", "key", "label")
    was = pairs.join(last.withColumnsRenamed({"essay_id": "previous", "label": "was"}), "previous").select("essay_id", "key", "was")
    change = F.when(F.col("was").isNull(), "added").when(F.col("label").isNull(), "removed").when(F.col("label") == F.col("was"), "same").otherwise("changed")
    return now.join(was, ["essay_id", "key"], "full_outer").select("essay_id", "key", change.alias("change"))


def class_members(essays: DataFrame, members: DataFrame) -> DataFrame:
    """(essay_id, class_id): two equi-joins, as an OR of both conditions would compare every pair."""
    own = essays.join(members.select("class_id").distinct(), "class_id", "left_semi").select("essay_id", "class_id")
    through = essays.where("class_id is null").drop("class_id").join(members, "user_id").select("essay_id", "class_id")
    return own.unionByName(through).distinct()
