"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Snapshot


def component_changes(old: Snapshot, new: Snapshot) -> DataFrame:
    """(unique_name, component_type, change): added, deleted, or modified where the code hash differs. All types count; one full outer join serves the three."""
    a = old.components.select("unique_name", F.col("component_type").alias("t0"), F.col("code_hash").alias("h0"), F.lit(True).alias("in_old"))
    b = new.components.select("unique_name", F.col("component_type").alias("t1"), F.col("code_hash").alias("h1"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), F.lit("added")).when(F.col("in_new").isNull(), F.lit("deleted")).when(F.col("h0") != F.col("h1"), F.lit("modified"))
    both = a.join(b, "unique_name", "full_outer").withColumn("change", change).where("change is not null")
    return both.select("unique_name", F.when(F.col("in_new"), F.col("t1")).otherwise(F.col("t0")).alias("component_type"), "change")


def relation_changes(old: DataFrame, new: DataFrame, strict_types: bool = False) -> DataFrame:
    """(source, target, association, strength, change): added or deleted relations. Relations of one strength are the same whatever their type, unless strict_types."""
    key = ["source", "target", "strength", *(["association"] if strict_types else [])]
    a = old.select(*key, *([] if strict_types else [F.col("association").alias("a0")]), F.lit(True).alias("in_old"))
    b = new.select(*key, *([] if strict_types else [F.col("association").alias("a1")]), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer").where("in_old is null or in_new is null")
    association = F.col("association") if strict_types else F.coalesce("a1", "a0")
    return both.select("source", "target", association.alias("association"), "strength", F.when(F.col("in_old").isNull(), F.lit("added")).otherwise(F.lit("deleted")).alias("change"))


def key_relation_components(components: DataFrame, relations: DataFrame) -> DataFrame:
    """(unique_name) of the ends of changed relations that were neither added nor deleted themselves."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("unique_name")).distinct()
    return ends.join(components.where("change in ('added', 'deleted')").select("unique_name"), "unique_name", "left_anti")


def all_changes(components: DataFrame, key_relations: DataFrame) -> DataFrame:
    """(unique_name, change) of component changes and key_relation."""
    return components.select("unique_name", "change").unionByName(key_relations.withColumn("change", F.lit("key_relation")))


def in_change(changes: DataFrame, change: str, names: DataFrame) -> DataFrame:
    """The names that have this change."""
    return names.join(changes.where(F.col("change") == change).select("unique_name"), "unique_name", "left_semi")
