"""The part of the merged snapshot that a change touches, its grouping and colours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Snapshot, is_base, package_path
from .hierarchy import base_of

PALETTE = "f0fffa f0fffd f9fff0 f0f1ff fff0ff f0f8ff f0ffff fffaf0 f5f5dc f8f4ff f5f5dc f8f8ff f8f8f9 e7e8ee fdecd5".split()
DEFAULT_COLOR = "#E0E0E0"


def changed_bases(merged: Snapshot, changes: DataFrame, files: Iterable[str] = (), owners: DataFrame | None = None) -> DataFrame:
    """(unique_name) of the base components of everything changed; with files, of what lies in them according to the merged rows. Changed members without a base component are dropped. Neighbours that didn't change aren't selected."""
    names = changes.select("unique_name").distinct()
    files = sorted(files)
    if files:
        names = names.join(merged.components.where(F.col("source_file").isin(files)).select("unique_name"), "unique_name", "left_semi")
    owned = base_of(merged) if owners is None else owners.where("base is not null").select("unique_name", "base")
    return names.join(owned, "unique_name").select(F.col("base").alias("unique_name")).distinct()


def without_base(merged_owners: DataFrame, changes: DataFrame) -> DataFrame:
    """(unique_name) of what changed but belongs to no base component, so that no diagram shows it."""
    return changes.select("unique_name").distinct().join(merged_owners.where("base is not null").select("unique_name"), "unique_name", "left_anti")


def diagram_nodes(components: DataFrame, names: DataFrame) -> DataFrame:
    """The selected components' rows, with their package as text."""
    return components.join(names, "unique_name", "left_semi").withColumn("package_path", package_path(F.col("package")))


def base_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_base(F.col("component_type")))


def drawable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a name, and no parenthesis in the unique one."""
    return nodes.where(F.col("name").isNotNull() & ~F.col("unique_name").contains("("))


def drawable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are drawable_nodes()."""
    named = drawable_nodes(nodes).select("unique_name")
    kept = edges.join(named.toDF("source"), "source", "left_semi").join(named.toDF("target"), "target", "left_semi")
    return kept.select(*edges.columns)


def groups(nodes: DataFrame, by: Column | None = None) -> DataFrame:
    """(package_path, size, members): nodes by package, or by another grouping column, members sorted; one group for F.lit(...)."""
    key = F.col("package_path") if by is None else by
    return nodes.groupBy(key.alias("package_path")).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("unique_name")).alias("members"))


def package_colors(packages: DataFrame) -> DataFrame:
    """(package_path, color): colours of the palette in turn, in order of the packages' names. One row a package is sorted, not the nodes."""
    place = F.row_number().over(Window.orderBy("package_path")) - 1
    colors = F.array(*(F.lit("#" + c) for c in PALETTE))
    return packages.select("package_path").distinct().select("package_path", F.element_at(colors, place % len(PALETTE) + 1).alias("color"))


def with_color(rows: DataFrame, colors: DataFrame) -> DataFrame:
    return rows.join(colors, "package_path", "left").withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOR)))


def node_flags(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds change: added, else deleted, else modified, else unchanged."""
    order = F.min(F.when(F.col("change") == "added", 0).when(F.col("change") == "deleted", 1).when(F.col("change") == "modified", 2).otherwise(3)).alias("rank")
    ranked = changes.groupBy("unique_name").agg(order)
    return nodes.join(ranked, "unique_name", "left").withColumn("change", F.element_at(F.array(*map(F.lit, ("added", "deleted", "modified", "unchanged"))), F.coalesce("rank", F.lit(3)) + 1)).drop("rank")


def edge_flags(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds change to relations: added, else deleted, else unchanged, by source, target and strength."""
    first = changes.groupBy("source", "target", "strength").agg(F.min("change").alias("change"))
    return edges.join(first, ["source", "target", "strength"], "left").withColumn("change", F.coalesce("change", F.lit("unchanged"))).select(*edges.columns, "change")
