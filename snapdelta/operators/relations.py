"""Edges between base components: extraction from references, and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIELD_TYPES, METHOD_TYPES, PARAMETER_TYPES, Snapshot, is_base, is_method, strength
from .hierarchy import nodes

PRIVATE = ("private", "protected")


def relevant(kind: Column) -> Column:
    """Components whose references can become edges."""
    return is_base(kind) | is_method(kind) | (kind == "FIELD")


def member_association(kind: Column, modifiers: Column) -> Column:
    """What a reference from a member says of its owner; null if nothing."""
    hidden = F.arrays_overlap(modifiers, F.array(*map(F.lit, PRIVATE)))
    field = F.when(F.coalesce(hidden, F.lit(False)), F.lit("COMPOSITION")).otherwise(F.lit("AGGREGATION"))
    return F.when(kind == FIELD_TYPES[0], field).when(kind.isin(*METHOD_TYPES), F.lit("WEAK_ASSOCIATION")).when(kind.isin(*PARAMETER_TYPES), F.lit("ASSOCIATION"))


def candidates(snapshot: Snapshot, owners: DataFrame | None = None) -> DataFrame:
    """Every edge that a reference gives, before equal strengths collapse: source, target, association, strength, multiplicity, origin, phase.

    References of a base component count if they extend or implement; those of a member are its owner's, whatever
    their kind. Targets are rolled up to their base; unknown ones, and the source itself, are dropped. owners: the
    snapshot's hierarchy.nodes(), where they are kept already.
    """
    known = nodes(snapshot) if owners is None else owners
    ends = known.where("base is not null").select(F.col("unique_name").alias("target"), F.col("base").alias("target_base"))
    held = snapshot.refs.join(known.where(relevant(F.col("component_type")) & F.col("base").isNotNull()), "unique_name")
    base = is_base(F.col("component_type"))
    kind = F.when(F.col("kind") == "extension", F.lit("SPECIALIZATION")).when(F.col("kind") == "implementation", F.lit("REALIZATION"))
    typed = held.withColumn("association", F.when(base, kind).otherwise(member_association(F.col("component_type"), F.col("modifiers"))))
    phase = F.when(~base, F.lit(2)).when(F.col("kind") == "implementation", F.lit(1)).otherwise(F.lit(0))
    typed = typed.where(F.col("association").isNotNull() & (F.col("target") != F.col("base"))).select("target", F.col("base").alias("source"), "association", F.col("unique_name").alias("origin"), phase.alias("phase"))
    edges = typed.join(ends, "target").where("source <> target_base")
    return edges.select("source", F.col("target_base").alias("target"), "association", strength(F.col("association")).alias("strength"), F.lit("").alias("multiplicity"), "origin", "phase")


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per source, target and strength: the first by origin, phase and association."""
    first = F.min(F.struct("origin", "phase", "association", "multiplicity")).alias("first")
    return edges.groupBy("source", "target", "strength").agg(first).select("source", "target", "first.association", "strength", "first.multiplicity")


def extract(snapshot: Snapshot, owners: DataFrame | None = None) -> DataFrame:
    """The relations of a snapshot: source, target, association, strength, multiplicity."""
    return collapse(candidates(snapshot, owners))


def inserted(rows: DataFrame) -> DataFrame:
    """Relations from given rows (source, target, association[, multiplicity, place]): missing associations are NONE; of equal strengths the one of least place, then name, stays."""
    have = set(rows.columns)
    rows = rows.withColumn("association", F.coalesce("association", F.lit("NONE"))).withColumn("strength", strength(F.col("association")))
    rows = rows.withColumn("multiplicity", F.coalesce("multiplicity", F.lit("")) if "multiplicity" in have else F.lit(""))
    return collapse(rows.withColumn("origin", F.col("place") if "place" in have else F.lit(0)).withColumn("phase", F.lit(0)))


def strongest(relations: DataFrame) -> DataFrame:
    """The strongest relation of each pair."""
    order = F.struct("strength", "association", "multiplicity")
    return relations.groupBy("source", "target").agg(F.max(order).alias("top")).select("source", "target", "top.association", "top.strength", "top.multiplicity")


def between(relations: DataFrame, source: str, target: str) -> DataFrame:
    return strongest(relations.where((F.col("source") == source) & (F.col("target") == target)))


def of(relations: DataFrame, source: str) -> DataFrame:
    return relations.where(F.col("source") == source)


def of_type(relations: DataFrame, association: str) -> DataFrame:
    return relations.where(F.col("association") == association)


def distinct(relations: DataFrame) -> DataFrame:
    return relations.select("source", "target", "association").distinct()


def among(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations both of whose ends are in names (unique_name)."""
    kept = relations.join(names.select(F.col("unique_name").alias("source")), "source", "left_semi")
    return kept.join(names.select(F.col("unique_name").alias("target")), "target", "left_semi").select(*relations.columns)


def out_of(relations: DataFrame, names: DataFrame) -> DataFrame:
    """The strongest relations that begin in names."""
    return strongest(relations.join(names.select(F.col("unique_name").alias("source")), "source", "left_semi"))


def has(relations: DataFrame, source: str) -> bool:
    return not of(relations, source).isEmpty()


def related(relations: DataFrame, source: str, target: str) -> bool:
    return not relations.where((F.col("source") == source) & (F.col("target") == target)).isEmpty()


def contains(relations: DataFrame, source: str, target: str, association: str) -> bool:
    """Whether a relation of that strength (not type) is there."""
    return not relations.where((F.col("source") == source) & (F.col("target") == target) & (F.col("strength") == strength(F.lit(association)))).isEmpty()


def size(relations: DataFrame) -> int:
    return relations.count()


def with_reverse(top: DataFrame) -> DataFrame:
    """Each strongest relation beside the strongest one of the opposite direction, or NONE: columns reverse_association, reverse_strength, reverse_multiplicity."""
    back = top.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("association").alias("ra"), F.col("strength").alias("rs"), F.col("multiplicity").alias("rm"))
    both = top.join(back, ["source", "target"], "left")
    return both.select("source", "target", "association", "strength", "multiplicity", F.coalesce("ra", F.lit("NONE")).alias("reverse_association"), F.coalesce("rs", F.lit(-1)).alias("reverse_strength"), F.coalesce("rm", F.lit("")).alias("reverse_multiplicity"))


def flagged(both: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds forth and back to the rows of with_reverse(): added, else deleted, else null, of the relation and of its reverse."""
    flags = changes.groupBy("source", "target", "strength").agg(F.min("change").alias("flag"))
    forth = both.join(flags.withColumnRenamed("flag", "forth"), ["source", "target", "strength"], "left")
    back = flags.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("strength").alias("reverse_strength"), F.col("flag").alias("back"))
    return forth.join(back, ["source", "target", "reverse_strength"], "left")


def describe(relations: DataFrame) -> DataFrame:
    """A line of text for each relation."""
    return relations.withColumn("line", F.format_string("%s -[%s %s]-> %s", "source", "association", "strength", "target"))
