"""Owners: the base component that each component belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Snapshot, is_base


def nodes(snapshot: Snapshot) -> DataFrame:
    """(unique_name, component_type, modifiers, base): base is the component itself if it is of a base type, else its nearest ancestor of one; null if there is none within the snapshot's depth.

    parent_name alone leads to the owner; names aren't parsed. One join per level.
    """
    comps = snapshot.components.select("unique_name", "component_type", "modifiers", "parent_name")
    own = F.when(is_base(F.col("component_type")), F.col("unique_name"))
    out = comps.withColumn("base", own).withColumn("up", F.when(F.col("base").isNull(), F.col("parent_name"))).drop("parent_name")
    owners = comps.select(F.col("unique_name").alias("owner"), own.alias("owner_base"), F.col("parent_name").alias("next"))
    for _ in range(snapshot.depth):
        out = out.join(owners, F.col("up") == F.col("owner"), "left")
        out = out.select("unique_name", "component_type", "modifiers", F.coalesce("base", "owner_base").alias("base"), F.when(F.coalesce("base", "owner_base").isNull(), F.col("next")).alias("up"))
    return out.drop("up")


def base_of(snapshot: Snapshot) -> DataFrame:
    """(unique_name, base) of the components that have one; the others are dropped."""
    return nodes(snapshot).where("base is not null").select("unique_name", "base")
