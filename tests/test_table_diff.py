"""The comparison of the driver's tables row by row against the general one, which joins names."""

import pytest
from pyspark.sql import functions as F

from snapdelta.operators import merge
from snapdelta.plans import render
from snapdelta.plans.config import light_scheme
from snapdelta.plans.diff import Diff, Model
from snapdelta.plans.table_diff import TableDiff
from snapdelta.queries import QUERIES
from snapdelta.sources import tables


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """Line items that repeat, have no part, no order, no flag or an unknown one, and few parts, so that pairs of parts share many edges."""
    folder = str(tmp_path_factory.mktemp("odd"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 30").withColumn("p_brand", F.when(F.col("p_partkey") != 7, F.concat(F.lit("B"), F.col("p_partkey") % 3)))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 600")
    key = F.when(F.col("l_linenumber") % 6 != 5, F.col("l_partkey") % 35)
    order = F.when(F.col("l_orderkey") % 50 != 13, F.col("l_orderkey"))
    flag = F.when(F.col("l_suppkey") % 4 == 0, F.lit(None)).when(F.col("l_suppkey") % 4 == 1, F.lit("AB")).otherwise(F.col("l_returnflag"))
    line = line.withColumns({"l_partkey": key, "l_orderkey": order, "l_returnflag": flag})
    part.write.parquet(f"{folder}/part.parquet")
    line.union(line.where("l_suppkey % 3 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


TABLES = {
    **{k: (lambda d, k=k: getattr(d, k)) for k in ("component_changes", "base_changes", "relation_changes", "key_relations", "old_relations", "new_relations", "merged_relations", "old_owners", "new_owners", "merged_owners", "members", "child_counts", "merged_bases", "new_bases", "base_refs", "without_new_base")},
    "components": lambda d: d.merged.components,
    "refs": lambda d: d.merged.refs,
    "children": lambda d: merge.existing_children(d.merged),
    "bases": lambda d: d.changed_bases(),
    "bases of files": lambda d: d.changed_bases(["/B1/P1.java", "/B2/P2.java", "/Brand#1/P7.java"]),
    "counts": lambda d: d.change_counts(),
}


def test_equals_the_general_comparison(spark, odd):
    whole, by_row = Diff(*tables.snapshots(spark, odd)), TableDiff(spark, odd)
    for name, table in TABLES.items():
        expected = rows(table(whole))
        assert expected, name
        assert rows(table(by_row)) == expected, name
    strict = rows(Diff(*tables.snapshots(spark, odd), strict_types=True).relation_changes)
    assert rows(TableDiff(spark, odd, strict_types=True).relation_changes) == strict
    spark.catalog.clearCache()


@pytest.mark.parametrize(("name", "most"), [("relations_all", 6), ("change_counts", 12), ("merged_components", 3), ("merged_children", 3), ("base_of_component", 3)])
def test_names_are_not_joined(spark, sf_dir, name, most):
    """Shuffles in the plan, those of the small parts included."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most, plan
    assert "InMemoryTableScan" not in plan  # read once, not kept


@pytest.mark.parametrize("name", ["change_set_json", "diagram_json"])
def test_long_lists_are_sorted_without_a_comparator(spark, sf_dir, name):
    """array_sort() calls a function for each comparison."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "sort_array(collect_" in plan and "array_sort(collect_" not in plan
    spark.catalog.clearCache()


def test_edges_beside_their_reverse_equal_the_joined_ones(spark, odd):
    for strict in (False, True):
        whole, by_row = Diff(*tables.snapshots(spark, odd), strict_types=strict), TableDiff(spark, odd, strict_types=strict)
        expected = rows(whole.paired)
        assert any("NONE" not in x for x in expected) and any("'added'" in x for x in expected) and any("'deleted'" in x for x in expected)
        assert rows(by_row.paired) == expected == rows(TableDiff(spark, odd, strict_types=strict, shared=False).paired)
    spark.catalog.clearCache()


def moved(plan):
    """Hash exchanges outside the tables that are kept."""
    found, inside = 0, None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        inside = None if inside is not None and depth <= inside else inside
        inside = depth if inside is None and "InMemoryRelation" in line else inside
        found += inside is None and "Exchange hashpartitioning" in line
    return found


def test_edges_are_moved_to_their_ends_only(spark, sf_dir):
    """Edges to their source and to their target, and nodes twice; all kept tables are read where they lie."""
    plan = QUERIES["edge_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert moved(plan) <= 4, plan
    spark.catalog.clearCache()


def test_a_text_in_rows_is_whole_and_in_order(spark, odd, monkeypatch):
    (expected,) = [r.diagram for r in render.documents(Model(Diff(*tables.snapshots(spark, odd))), light_scheme()).collect()]
    assert [r.diagram for r in QUERIES["diagram_text"](spark, odd).collect()] == [expected]
    monkeypatch.setattr(render, "PIECE", 1000, raising=False)
    monkeypatch.setattr(render, "TOGETHER", 100, raising=False)
    got = [r.diagram for r in QUERIES["diagram_text"](spark, odd).collect()]
    assert len(got) > 10 and "".join(got) == expected
    longest = max(len(x.encode()) for x in got)
    assert longest < 3000, longest  # a class's block or the opening may be longer than a piece, and is a row alone
    kept = render.pieces(Model(TableDiff(spark, odd)), light_scheme())
    parts = sorted((r.part, r.place, r.diagram) for r in kept.collect())
    assert "".join(x[2] for x in parts) == expected and len({x[:2] for x in parts}) == len(parts) and parts[-1][0] > 0
    spark.catalog.clearCache()
