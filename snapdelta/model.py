"""The data model: component snapshots as flat tables, associations and component types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TYPES = ("CLASS", "INTERFACE", "STRUCT", "ENUM", "ANNOTATION")
METHOD_TYPES = ("METHOD", "CONSTRUCTOR")
PARAMETER_TYPES = ("METHOD_PARAMETER_COMPONENT", "CONSTRUCTOR_PARAMETER_COMPONENT")
FIELD_TYPES = ("FIELD", "ENUM_CONSTANT", "INTERFACE_CONSTANT")
VARIABLE_TYPES = (*FIELD_TYPES, "LOCAL", *PARAMETER_TYPES)


@dataclass(frozen=True)
class Association:
    """How strongly two components are tied, and how the tie is drawn."""

    strength: int
    link: str
    forward: str
    backward: str


ASSOCIATIONS = {
    "SPECIALIZATION": Association(8, "--", "|>", "<|"),
    "REALIZATION": Association(8, "-.-", "|>", "<|"),
    "COMPOSITION": Association(6, "-", "*", "*"),
    "AGGREGATION": Association(6, "-", "o", "o"),
    "ASSOCIATION": Association(3, "--", ">", "<"),
    "WEAK_ASSOCIATION": Association(1, "--", ">", "<"),
    "NONE": Association(-1, "-", "", ""),
}
MULTIPLICITIES = {"NONE": "", "ZERO_TO_MANY": "0..*", "ZERO_TO_ONE": "0..1"}

COMPONENT_SCHEMA = (
    "unique_name string, component_name string, name string, component_type string, parent_name string, "
    "package struct<path: string, name: string>, source_file string, modifiers array<string>, children array<string>, "
    "code_hash int, code_fragment string, comment string, refs array<struct<kind: string, target: string>>"
)
#: Columns of the flat components table.
COLUMNS = ("unique_name", "component_name", "name", "component_type", "parent_name", "package", "source_file", "modifiers", "code_hash", "code_fragment", "comment")


@dataclass(frozen=True)
class Snapshot:
    """One version of the entities, all tables flat and lazy.

    components: COLUMNS; refs: unique_name, kind (simple, extension, implementation), target; children: parent, child,
    place (their order). depth: how many owners a member may have to climb to its base component.
    """

    components: DataFrame
    refs: DataFrame
    children: DataFrame
    depth: int = 4

    @staticmethod
    def of(rows: DataFrame, depth: int = 4) -> Snapshot:
        """From rows with the nested refs and children of COMPONENT_SCHEMA."""
        refs = rows.select("unique_name", F.explode("refs").alias("ref")).select("unique_name", "ref.kind", "ref.target").distinct()
        children = rows.select(F.col("unique_name").alias("parent"), F.posexplode("children").alias("place", "child")).select("parent", "child", "place")
        return Snapshot(rows.select(*COLUMNS), refs, children, depth)

    @staticmethod
    def rows(spark: SparkSession, rows: list[dict], depth: int = 4) -> Snapshot:
        """From dictionaries; what is left out is null, or empty for lists, and 0 for code_hash."""
        filled = [{"modifiers": [], "children": [], "refs": [], "code_hash": 0, "component_name": r.get("unique_name"), "name": r.get("unique_name")} | r for r in rows]
        return Snapshot.of(spark.createDataFrame(filled, COMPONENT_SCHEMA), depth)


def is_base(kind: Column) -> Column:
    return kind.isin(*BASE_TYPES)


def is_method(kind: Column) -> Column:
    return kind.isin(*METHOD_TYPES)


def is_variable(kind: Column) -> Column:
    return kind.isin(*VARIABLE_TYPES)


def association_value(association: Column, attribute: str) -> Column:
    """strength, link, forward or backward of an association column, by a chain of comparisons; null for an unknown one."""
    out = F.lit(None)
    for name, a in ASSOCIATIONS.items():
        out = F.when(association == name, F.lit(getattr(a, attribute))).otherwise(out)
    return out


def strength(association: Column) -> Column:
    return association_value(association, "strength").cast("int")


def package_path(package: Column) -> Column:
    """The package's path, or its name if the path is empty; nothing for no package."""
    return F.when(package.isNull(), F.lit("")).when(F.coalesce(package["path"], F.lit("")) != "", package["path"]).otherwise(F.coalesce(package["name"], F.lit("")))


def references(refs: DataFrame, kind: str | None = None) -> DataFrame:
    """References of one kind, or all."""
    return refs if kind is None else refs.where(F.col("kind") == kind)
