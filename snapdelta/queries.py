"""Catalogue of the engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, text
from .operators import changes, hierarchy, relations, select
from .oracle import ORACLE
from .plans import output, render
from .plans.config import Config, Placement, light_scheme
from .plans.diff import Diff, Model
from .plans.plugins import Augmenter, ClassDecorator, InsertionPoint, Plugins
from .plans.table_diff import TableDiff
from .sources import files, tables

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
EDGE = ("source", "target", "association", "strength")
FILTER = ("/Brand#11/P1.java", "/Brand#12/P12.java")


def _diff(f: Callable[[Diff], DataFrame], **how: bool) -> Query:
    return lambda spark, sf_dir: f(TableDiff(spark, sf_dir, **{"shared": False} | how))


def _model(f: Callable[[Model], DataFrame], plugins: Plugins | None = None) -> Query:
    return lambda spark, sf_dir: f(Model(TableDiff(spark, sf_dir), plugins=plugins))


def _text(f: Callable) -> Query:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", f(F.col("text")).alias("text"))


def _changed(kind: str) -> Query:
    return _diff(lambda d: d.component_changes.where(F.col("change") == kind).select("unique_name", "component_type"))


def _relations_changed(kind: str) -> Query:
    return _diff(lambda d: d.relation_changes.where(F.col("change") == kind).select(*EDGE))


def _of_least(d: Diff) -> DataFrame:
    least = d.new_bases.agg(F.min("unique_name").alias("source"))
    return d.new_relations.join(F.broadcast(least), "source").select(*EDGE)  # one row


def _mutual(d: Diff) -> DataFrame:
    both = relations.with_reverse(relations.strongest(d.new_relations))
    return both.where("reverse_association <> 'NONE'").select("source", "target", "association", "reverse_association")


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = tables.parts(spark, sf_dir).agg(F.min("source_file"), F.max("source_file")).first()
    return Model(TableDiff(spark, sf_dir), {*FILTER, *filter(None, ends)}).names


def _summary(m: Model) -> DataFrame:
    return output.diagram_summary(m, Config(placement=Placement.ONE_PER_GROUP))


def _headers(m: Model) -> DataFrame:
    rows = select.node_flags(m.nodes, m.node_changes).join(m.diff.child_counts, "unique_name", "left")
    return rows.select("unique_name", render.class_header(light_scheme()).alias("header"))


def _children(m: Model) -> DataFrame:
    return render.child_lines(m.diff.members, m.nodes, light_scheme()).select("parent", "child", "is_field", "line")


class _Interfaces(Augmenter):
    """Adds all interfaces, and notes every node's type."""

    only_bases = True

    def augment(self, diff: Diff, names: DataFrame) -> DataFrame:
        more = diff.merged_bases.where("component_type = 'INTERFACE'").select("unique_name")
        return names.union(more)

    def metadata(self, nodes: DataFrame):
        return F.create_map(F.lit("type"), F.lower("component_type"))


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files, of languages by turns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ending = F.element_at(F.array(*map(F.lit, (".java", ".py", ".txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("content"), "doc_id")


def _files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted are all files; the old snapshot has the even documents, the new one those divisible by three."""
    rows = _source_files(spark, sf_dir)
    return files.missing_files(rows, rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"))


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(path: str, content: str) -> list[dict]:
        if "#" in content:
            raise ValueError("not a source file")
        return []

    read = files.parsed(_source_files(spark, sf_dir), parse)
    return files.warnings(files.failures(read, read))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the files in known languages, one a file, with a member."""

    def parse(path: str, content: str) -> list[dict]:
        folder, _, name = path.rpartition("/")
        base = {"unique_name": path, "name": name, "component_type": "CLASS", "package": {"path": folder, "name": folder}, "source_file": path, "modifiers": [], "children": [f"{path}.size"], "code_hash": len(content), "refs": []}
        return [base, {**base, "unique_name": f"{path}.size", "component_type": "FIELD", "parent_name": path, "children": []}]

    found = files.snapshot(files.parsed(files.of_languages(_source_files(spark, sf_dir)), parse))
    owned = found.components.join(hierarchy.base_of(found), "unique_name").join(found.children.selectExpr("child unique_name", "parent", "place"), "unique_name", "left")
    return owned.select("unique_name", "component_type", "code_hash", "base", "parent", "place")


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations given as rows: line items from part to supplier, with a multiplicity."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kinds = F.array(*map(F.lit, ("SPECIALIZATION", "REALIZATION", "COMPOSITION", "AGGREGATION", "ASSOCIATION", "WEAK_ASSOCIATION", "NONE")), F.lit(None))
    many = F.element_at(F.array(*map(F.lit, ("", "0..1", "0..*"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = line.select(F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("target"), F.element_at(kinds, (F.col("l_linenumber") % 8 + 1).cast("int")).alias("association"), many.alias("multiplicity"))
    return relations.inserted(rows.select("*", F.lit(0).alias("place")))


def _multiplicity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of edges with multiplicities, both ends drawn."""
    both = relations.with_reverse(relations.strongest(_inserted(spark, sf_dir)))
    nodes = both.select(F.explode(F.array("source", "target")).alias("unique_name")).distinct().withColumn("package_path", F.lit(""))
    none = both.select("source", "target", "strength", F.lit("added").alias("change")).where("source = 'P7'")
    return render.edge_lines(both, nodes, none, light_scheme())


def _marked(c: Column) -> Column:
    """Names that end with 3 get parentheses."""
    return F.when(F.endswith(c, F.lit("3")), F.concat(c, F.lit("()"))).otherwise(c)


def _drawable(m: Model) -> DataFrame:
    """Edges between nodes with names, none of which has a parenthesis."""
    nodes = m.nodes.select(_marked(F.col("unique_name")).alias("unique_name"), F.when(F.col("code_hash") % 5 != 0, F.col("name")).alias("name"))
    edges = m.edges.select(_marked(F.col("source")).alias("source"), _marked(F.col("target")).alias("target"), "association", "strength")
    return select.drawable(edges, nodes)


def _modifier_lines(m: Model) -> DataFrame:
    """Members drawn with static and abstract modifiers."""
    own = F.when(F.col("code_hash") % 2 == 0, F.array_append("modifiers", "static")).otherwise(F.col("modifiers"))
    own = F.when(F.col("code_hash") % 3 == 0, F.array_append(own, "abstract")).otherwise(own)
    return render.child_lines(m.diff.members.withColumn("modifiers", own), m.nodes, {**light_scheme(), "added_component_color": "#abcdef"}).select("parent", "child", "line")


class _Note(ClassDecorator):
    point = InsertionPoint.BOTTOM

    def lines(self, style: dict[str, str]) -> Column:
        return F.array(F.concat(F.lit("note "), "component_type"), F.lit(None), F.lit(""))


class _First(ClassDecorator):
    order = 1
    point = InsertionPoint.BOTTOM

    def lines(self, style: dict[str, str]) -> Column:
        return F.array(F.lit("first\n"))


def _decorated(m: Model) -> DataFrame:
    blocks = render.class_blocks(m, light_scheme())
    return blocks.select("unique_name", F.substring_index("block", " first\n", -1).alias("end"))


def _diagram(m: Model) -> DataFrame:
    return output.diagrams(m, Config(metadata_only=True)).select("json")


def _interfaces(d: Diff) -> DataFrame:
    keys = d.key_relations.withColumn("change", F.lit("key_relation"))
    return changes.in_change(keys, "key_relation", d.merged_bases.where("component_type = 'INTERFACE'").select("unique_name"))


QUERIES: dict[str, Query] = {
    "component_change_summary": _diff(lambda d: d.component_changes.groupBy("change", "component_type").agg(F.count(F.lit(1)).alias("n"))),
    **{f"components_{c}": _changed(c) for c in ("added", "deleted", "modified")},
    "base_of_component": _diff(lambda d: d.merged_owners.where("base is not null").select("unique_name", "base")),
    "relations_all": _diff(lambda d: d.new_relations.select(*EDGE)),
    "relations_specialization": _diff(lambda d: relations.of_type(d.new_relations, "SPECIALIZATION").select(*EDGE)),
    "relations_realization": _diff(lambda d: relations.of_type(d.new_relations, "REALIZATION").select(*EDGE)),
    "relations_association": _diff(lambda d: d.new_relations.where("association not in ('SPECIALIZATION', 'REALIZATION', 'NONE')").select(*EDGE)),
    "relations_strongest": _diff(lambda d: relations.strongest(d.new_relations).select(*EDGE)),
    "relations_of_component": _diff(_of_least),
    "relations_mutual": _diff(_mutual),
    "relations_added": _relations_changed("added"),
    "relations_deleted": _relations_changed("deleted"),
    "relations_changed_strictly": _diff(lambda d: d.relation_changes.select(*EDGE, "change"), strict_types=True),
    "key_relation_components": _diff(lambda d: d.key_relations),
    "change_counts": _diff(lambda d: d.change_counts()),
    "merged_components": _diff(lambda d: d.merged.components.select("unique_name", "component_type", "parent_name", "source_file", "code_hash")),
    "merged_children": _diff(lambda d: d.members.select("parent", "child")),
    "merged_relations": _diff(lambda d: d.merged_relations.select(*EDGE)),
    "diagram_nodes": _model(lambda m: m.nodes.select("unique_name", "component_type", "package_path")),
    "diagram_nodes_filtered": _filtered,
    "diagram_edges": _model(lambda m: m.edges.select(*EDGE)),
    "edge_change_flags": _model(lambda m: select.edge_flags(m.edges.select(*EDGE), m.diff.relation_changes)),
    "node_change_flags": _model(lambda m: select.node_flags(m.nodes, m.node_changes).select("unique_name", "change")),
    "package_groups": _model(lambda m: select.groups(m.nodes).withColumn("members", F.array_join("members", ","))),
    "package_colors": _model(lambda m: m.colors),
    "diagram_summary": _model(_summary),
    "class_children_display": _model(_children),
    "class_headers": _model(_headers),
    "diagram_ids": _model(lambda m: m.nodes.select("unique_name", text.qualified_id(F.col("package_path"), F.col("unique_name")).alias("id"))),
    "edge_lines": _model(lambda m: render.model_lines(m, light_scheme())),
    "class_blocks": _model(lambda m: render.class_blocks(m, light_scheme())),
    "component_json": _model(lambda m: output.component_json(m.nodes, m.node_refs)),
    "relation_json": _model(lambda m: output.relation_json(m.edges)),
    "diagram_json": _model(_diagram),
    "diagram_text": _model(lambda m: render.document(m, light_scheme())),
    "augmented_nodes": _model(lambda m: m.nodes.select("unique_name", F.element_at("augmentations", "type").alias("note")), Plugins(augmenters=(_Interfaces(),))),
    "decorated_ends": _model(_decorated, Plugins(class_decorators=(_Note(), _First()))),
    "modifier_lines": _model(_modifier_lines),
    "edges_drawable": _model(_drawable),
    "relations_inserted": _inserted,
    "multiplicity_lines": _multiplicity_lines,
    "relations_described": _diff(lambda d: relations.describe(d.new_relations).select("line")),
    "relations_distinct": _diff(lambda d: relations.distinct(d.new_relations)),
    "relations_out_of_added": _diff(lambda d: relations.out_of(d.new_relations, d.base_changes.where("change = 'added'").select("unique_name")).select(*EDGE)),
    "interfaces_of_key_relations": _diff(_interfaces),
    "changes_without_base": _diff(lambda d: d.without_new_base),
    "groups_by_type": _model(lambda m: select.groups(m.nodes, F.col("component_type")).selectExpr("package_path type", "size", "array_join(members, ',') members")),
    "groups_condensed": _model(lambda m: select.groups(m.nodes, F.lit("all")).selectExpr("package_path type", "size")),
    "diagram_summary_condensed": _model(lambda m: output.diagram_summary(m, Config(max_components=10))),
    "nodes_with_default_color": _model(lambda m: select.with_color(m.nodes.select("unique_name", "package_path"), m.colors.where("color <> '#f0f8ff'"))),
    "source_files_parsed": _parsed,
    "files_of_language": lambda spark, sf_dir: files.of_languages(_source_files(spark, sf_dir), ["python"]).select("path"),
    "change_set_json": _model(lambda m: output.change_set_json(m)),
    "files_filter_missing": _files_missing,
    "compile_warnings": _warnings,
    "text_comment_stripped": _text(lambda c: text.comment_marks_removed(F.concat(F.lit("/** "), c, F.lit(" */")))),
    "text_brackets": _text(text.brackets),
    "text_normalized": _text(text.normalized),
    "text_wrapped": _text(lambda c: text.wrapped(text.normalized(c))),
    "text_bolded": _text(lambda c: text.bold_lines(text.wrapped(text.normalized(c)))),
    "text_truncated": _text(text.shortened),
    "compressed_text": _text(lambda c: codec.decompressed(codec.compressed(c))),
    "text_html_stripped": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_text(F.col("html")).alias("text")),
    "doc_text": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.documentation(F.col("html")).alias("text")),
}
