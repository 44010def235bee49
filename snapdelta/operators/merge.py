"""Two snapshots as one; the newer row wins as a whole, nulls included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Snapshot


def merge(old: Snapshot, new: Snapshot) -> Snapshot:
    """The new components, and the old ones that are gone; children of both, the new ones first; references of the row that won."""
    gone = old.components.join(new.components.select("unique_name"), "unique_name", "left_anti")
    refs = old.refs.join(new.components.select("unique_name"), "unique_name", "left_anti")
    return Snapshot(
        new.components.unionByName(gone.select(*new.components.columns)),
        new.refs.unionByName(refs.select(*new.refs.columns)),
        merged_children(old.children, new.children),
        max(old.depth, new.depth),
    )


def merged_children(old: DataFrame, new: DataFrame) -> DataFrame:
    lost = old.join(new.select("parent", "child"), ["parent", "child"], "left_anti")
    both = new.withColumn("era", F.lit(0)).unionByName(lost.select("parent", "child", "place").withColumn("era", F.lit(1)))
    order = Window.partitionBy("parent").orderBy("era", "place", "child")
    return both.select("parent", "child", (F.row_number().over(order) - 1).alias("place"))


def existing_children(snapshot: Snapshot) -> DataFrame:
    """Children that are components of the snapshot themselves."""
    return snapshot.children.join(snapshot.components.select(F.col("unique_name").alias("child")), "child", "left_semi").select("parent", "child", "place")
