"""Changes, relations, merging, selection: the fixtures CD, RD, RE, RS, SE of FIXTURES.md."""

import pytest

from snapdelta.model import Snapshot
from snapdelta.operators import merge, relations, select
from snapdelta.plans.diff import Diff, Model

TYPES = ["FIELD", "METHOD", "CONSTRUCTOR", "CLASS", "INTERFACE", "STRUCT", "LOCAL", "METHOD_PARAMETER_COMPONENT"]


def c(name, kind="CLASS", parent=None, **more):
    return {"unique_name": name, "component_type": kind, "parent_name": parent, **more}


def ref(target, kind="simple"):
    return {"kind": kind, "target": target}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def edges(spark, *components):
    return rows(relations.extract(Snapshot.rows(spark, list(components))), "source", "target", "association")


def changes(spark, old, new):
    d = Diff(Snapshot.rows(spark, old, depth=1), Snapshot.rows(spark, new, depth=1))
    return d, rows(d.component_changes, "unique_name", "change")


def test_every_type_is_added_and_deleted(spark):
    all_ = [c(f"x{k}", k) for k in TYPES]
    assert {x[1] for x in changes(spark, [], all_)[1]} == {"added"}
    assert [x[1] for x in changes(spark, all_, [])[1]] == ["deleted"] * len(TYPES)


def test_modified_by_hash(spark):
    assert changes(spark, [c("A", code_hash=101)], [c("A", code_hash=202)])[1] == [("A", "modified")]
    assert changes(spark, [c("A", code_hash=101)], [c("A", code_hash=101)])[1] == []
    assert changes(spark, [], [])[1] == []


BASE = [c("S"), c("A"), c("A.w", "FIELD", "A")]
REF = [c("S"), c("A", refs=[ref("S")]), c("A.w", "FIELD", "A", refs=[ref("S")])]


def test_relation_changes(spark):
    d, _ = changes(spark, BASE, REF)
    assert rows(d.relation_changes, "source", "target", "change") == [("A", "S", "added")]
    d, _ = changes(spark, REF, BASE)
    assert rows(d.relation_changes, "source", "target", "change") == [("A", "S", "deleted")]
    assert rows(d.changes.where("change = 'key_relation'"), "unique_name") == [("A",), ("S",)]
    d, _ = changes(spark, [], REF[1:])
    assert d.relation_changes.isEmpty()


@pytest.mark.parametrize(
    ("components", "expected"),
    [
        ([c("a", "STRUCT"), c("a.f", "FIELD", "a", modifiers=["private"], refs=[ref("b")]), c("b", "STRUCT")], "COMPOSITION"),
        ([c("a", "STRUCT"), c("a.f", "FIELD", "a", modifiers=["protected"], refs=[ref("b")]), c("b", "STRUCT")], "COMPOSITION"),
        ([c("a", "STRUCT"), c("a.f", "FIELD", "a", modifiers=["public"], refs=[ref("b")]), c("b", "STRUCT")], "AGGREGATION"),
        ([c("a"), c("a.m", "METHOD", "a", refs=[ref("b")]), c("b")], "WEAK_ASSOCIATION"),
        ([c("a", refs=[ref("b", "extension")]), c("b")], "SPECIALIZATION"),
        ([c("a", refs=[ref("b", "implementation")]), c("b", "INTERFACE")], "REALIZATION"),
        ([c("a", refs=[ref("b")]), c("b")], None),
        ([c("a", refs=[ref("gone", "extension")])], None),
        ([c("a", refs=[ref("a", "extension")])], None),
        ([c("a"), c("a.f", "FIELD", "a", refs=[ref("a")])], None),
    ],
)
def test_extraction(spark, components, expected):
    assert edges(spark, *components) == ([("a", "b", expected)] if expected else [])


def test_targets_and_owners_roll_up(spark):
    got = edges(spark, c("a"), c("a.m", "METHOD", "a"), c("a.m.l", "METHOD", "a.m", refs=[ref("b.f")]), c("b"), c("b.f", "FIELD", "b"))
    assert got == [("a", "b", "WEAK_ASSOCIATION")]


def test_two_strengths_stay(spark):
    got = edges(spark, c("A"), c("A.b", "FIELD", "A", refs=[ref("B")]), c("A.m", "METHOD", "A", refs=[ref("B")]), c("B"))
    assert got == [("A", "B", "AGGREGATION"), ("A", "B", "WEAK_ASSOCIATION")]


def given(spark, *triples):
    return relations.inserted(spark.createDataFrame(list(triples), "source string, target string, association string"))


def test_relation_store(spark):
    store = given(spark, ("A", "B", "ASSOCIATION"), ("A", "B", "AGGREGATION"))
    assert relations.distinct(store).count() == 2 == relations.size(store)
    assert rows(relations.strongest(store), "association") == [("AGGREGATION",)] == rows(relations.between(store, "A", "B"), "association")
    assert relations.has(store, "A") and not relations.has(store, "B")
    assert relations.related(store, "A", "B") and not relations.related(store, "B", "A")
    assert relations.contains(store, "A", "B", "COMPOSITION") and not relations.contains(store, "A", "B", "NONE")
    assert rows(relations.of_type(store, "ASSOCIATION"), "target") == [("B",)]
    assert relations.of(store, "A").count() == 2
    assert relations.describe(relations.strongest(store)).first().line == "A -[AGGREGATION 6]-> B"
    chain = given(spark, ("A", "B", None), ("B", "C", None), ("A", "C", None))
    names = spark.createDataFrame([("A",), ("C",)], "unique_name string")
    assert rows(relations.among(chain, names), "source", "target", "association") == [("A", "C", "NONE")]
    assert rows(relations.out_of(chain, names.where("unique_name = 'A'")), "target") == [("B",), ("C",)]


def test_strict_types(spark):
    old = [c("A"), c("A.f", "FIELD", "A", modifiers=["private"], refs=[ref("B")]), c("B")]
    new = [c("A"), c("A.f", "FIELD", "A", modifiers=["public"], refs=[ref("B")]), c("B")]
    a, b = Snapshot.rows(spark, old), Snapshot.rows(spark, new)
    assert Diff(a, b).relation_changes.isEmpty()
    assert rows(Diff(a, b, strict_types=True).relation_changes, "association", "change") == [("AGGREGATION", "added"), ("COMPOSITION", "deleted")]


def test_merge_takes_whole_rows_and_unites_children(spark):
    old = Snapshot.rows(spark, [c("A", comment="old", children=["A.x", "A.y"]), c("A.x", "FIELD", "A"), c("gone")])
    new = Snapshot.rows(spark, [c("A", children=["A.z"]), c("A.z", "FIELD", "A")])
    m = merge.merge(old, new)
    assert rows(m.components, "unique_name") == [("A",), ("A.x",), ("A.z",), ("gone",)]
    assert m.components.where("unique_name = 'A'").first().comment is None
    assert rows(m.children, "place", "child") == [(0, "A.z"), (1, "A.x"), (2, "A.y")]
    assert rows(merge.existing_children(m), "child") == [("A.x",), ("A.z",)]


def names(model):
    return [r[0] for r in rows(model.names, "unique_name")]


def model(spark, old, new, files=()):
    return Model(Diff(Snapshot.rows(spark, old, depth=1), Snapshot.rows(spark, new, depth=1)), files)


def test_selection(spark):
    assert names(model(spark, BASE, [])) == ["A", "S"]
    child = [c("A"), c("S", refs=[ref("A", "extension")])]
    assert names(model(spark, child, [*child, c("A.w", "FIELD", "A")])) == ["A"]
    files = [c("S", source_file="strawbs.java"), c("A", source_file="animal.java")]
    assert names(model(spark, files, [], ["animal.java"])) == ["A"]
    assert names(model(spark, [], [c("x.f", "FIELD", "nowhere")])) == []
    assert model(spark, [], []).empty()


def test_groups_and_colors(spark):
    m = model(spark, [], [c("a.A", package={"path": "a", "name": "a"}), c("b.B", package={"path": "", "name": "b"}), c("C")])
    assert rows(select.groups(m.nodes), "package_path", "size") == [("", 1), ("a", 1), ("b", 1)]
    colors = rows(m.colors, "package_path", "color")
    assert [x[1] for x in colors] == ["#" + x for x in select.PALETTE[:3]]
    many = spark.createDataFrame([(f"p{i:02}",) for i in range(16)], "package_path string")
    assert len({x[1] for x in rows(select.package_colors(many), "package_path", "color")[:1] + rows(select.package_colors(many), "package_path", "color")[15:]}) == 1
    assert select.with_color(many.limit(1), select.package_colors(many.limit(0))).first().color == select.DEFAULT_COLOR
