"""The driver's tables as two component snapshots.

Parts are base components of their brand's package, line items the members of their part. A member refers to the part
of the next line of its order; a part extends, or implements, the next part of its brand. Old and new snapshot leave
out different parts and orders; in the new one some members' hashes and modifiers differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..model import COLUMNS, Snapshot


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_name")
    kinds = F.array(*map(F.lit, ("CLASS", "INTERFACE", "STRUCT")))
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    return part.select(
        "p_partkey",
        F.col("p_brand").alias("pkg"),
        F.concat_ws(".", "p_brand", name).alias("unique_name"),
        name.alias("name"),
        F.element_at(kinds, (F.col("p_size") % 3 + 1).cast("int")).alias("component_type"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), name, F.lit(".java")).alias("source_file"),
        F.col("p_size").cast("int").alias("code_hash"),
        F.col("p_name").alias("comment"),
    )


def lines(spark: SparkSession, sf_dir: str, owners: DataFrame) -> DataFrame:
    """Members as numbers, with the package of their part: l_partkey, l_orderkey, l_linenumber, flag, code_hash, pkg.

    One row per part, order and line number; line items that share them are one member. All of it is on the part's
    partition: names are made of the numbers where they are asked for, not shuffled. flag is below, at, or above A and
    R, so that the greatest number stands for the greatest text.
    """
    text = F.col("l_returnflag")
    flag = F.when(text < "A", 0).when(text == "A", 1).when(text < "R", 2).when(text == "R", 3).when(text > "R", 4)
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey is not null and l_orderkey is not null")
    line = line.select("l_partkey", "l_orderkey", "l_linenumber", flag.alias("flag"), "l_quantity").repartition("l_partkey")
    grouped = line.groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("flag").alias("flag"), F.floor(F.max("l_quantity")).cast("int").alias("code_hash"))
    return grouped.join(owners.select(F.col("p_partkey").alias("l_partkey"), "pkg").distinct(), "l_partkey")


def part_name(pkg: Column, key: Column) -> Column:
    return F.concat_ws(".", pkg, F.concat(F.lit("P"), key.cast("string")))


def member_name() -> Column:
    return F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))


def member_type() -> Column:
    return F.element_at(F.array(*map(F.lit, ("FIELD", "METHOD", "CONSTRUCTOR"))), (F.col("l_linenumber") % 3 + 1).cast("int"))


def modifier() -> Column:
    return F.when(F.col("flag") == 1, F.lit("private")).when(F.col("flag") == 3, F.lit("protected")).otherwise(F.lit("public"))


def new_modifier(old: Column) -> Column:
    return F.when(F.col("l_orderkey") % 11 != 0, old).when(old == "private", F.lit("public")).otherwise(F.lit("private"))


def new_hash() -> Column:
    return (F.col("code_hash") + F.when(F.col("l_orderkey") % 7 == 0, 1).otherwise(0)).cast("int")


def named(rows: DataFrame) -> DataFrame:
    """The lines with their names and texts, as they are in the old snapshot."""
    parent = part_name(F.col("pkg"), F.col("l_partkey"))
    file = F.concat(F.lit("/"), "pkg", F.lit("/P"), F.col("l_partkey").cast("string"), F.lit(".java"))
    return rows.select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        parent.alias("parent_name"),
        "pkg",
        file.alias("source_file"),
        "code_hash",
        F.concat_ws(".", parent, member_name()).alias("unique_name"),
        member_name().alias("name"),
        member_type().alias("component_type"),
        modifier().alias("modifier"),
    )


def typed(base: DataFrame) -> DataFrame:
    """(unique_name, kind, target): each part's reference to the next part of its brand."""
    order = Window.partitionBy("pkg").orderBy("p_partkey")
    lead = base.select("p_partkey", "unique_name", F.lead("unique_name").over(order).alias("target"), F.lead("component_type").over(order).alias("t")).where("target is not null")
    return lead.select("p_partkey", "unique_name", F.when(F.col("t") == "INTERFACE", F.lit("implementation")).otherwise(F.lit("extension")).alias("kind"), "target")


def components(base: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """The rows of COLUMNS of parts, and of named lines."""
    text = F.lit(None).cast("string")
    package = F.struct(F.col("pkg").alias("path"), F.col("pkg").alias("name")).alias("package")
    no_modifiers = F.array().cast("array<string>")
    rows = base.select("unique_name", F.col("name").alias("component_name"), "name", "component_type", text.alias("parent_name"), package, "source_file", no_modifiers.alias("modifiers"), "code_hash", text.alias("code_fragment"), "comment")
    if inner is None:
        return rows.select(*COLUMNS)
    held = inner.select("unique_name", F.col("name").alias("component_name"), "name", "component_type", "parent_name", package, "source_file", F.array("modifier").alias("modifiers"), "code_hash", fragment().alias("code_fragment"), text.alias("comment"))
    return rows.unionByName(held).select(*COLUMNS)


def fragment() -> Column:
    return F.when(F.col("component_type") == "METHOD", F.concat("name", F.lit("()"))).otherwise(F.col("name"))


def _snapshot(base: DataFrame, inner: DataFrame) -> Snapshot:
    line = inner.select("unique_name", "l_orderkey", "l_linenumber")
    following = inner.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("parent_name").alias("target"))
    simple = line.join(following, ["l_orderkey", "l_linenumber"]).select("unique_name", F.lit("simple").alias("kind"), "target").distinct()
    place = F.row_number().over(Window.partitionBy("parent_name").orderBy("unique_name")) - 1
    children = inner.join(base.select(F.col("unique_name").alias("parent_name")), "parent_name", "left_semi").select(F.col("parent_name").alias("parent"), F.col("unique_name").alias("child"), place.alias("place"))
    return Snapshot(components(base, inner), simple.unionByName(typed(base).drop("p_partkey")), children, depth=1)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """(old, new), each on its own; plans.table_diff compares the same two without joining names."""
    base = parts(spark, sf_dir)
    inner = named(lines(spark, sf_dir, base)).persist(StorageLevel.MEMORY_AND_DISK)  # both snapshots read it several times
    old = _snapshot(base.where("p_partkey % 20 <> 0"), inner.where("l_orderkey % 10 <> 0"))
    newer = inner.where("l_orderkey % 10 <> 1").withColumn("code_hash", new_hash()).withColumn("modifier", new_modifier(F.col("modifier")))
    return old, _snapshot(base.where("p_partkey % 20 <> 1"), newer)
