"""A comparison of two snapshots as lazy tables, and the part of it that is drawn."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..model import Snapshot
from ..operators import changes, hierarchy, merge, relations, select
from .config import Config
from .plugins import Plugins, ordered


def _updated(notes: Column, more: Column) -> Column:
    """Both maps in one; of a key in both, the second's value."""
    return F.map_concat(F.map_filter(notes, lambda k, _: ~F.map_contains_key(more, k)), more)


class Diff:
    """Every table is built when asked for first, and is a plan only: nothing runs.

    Tables that several others are made of are marked to be kept, in memory or on the executors' disks; what is lost
    with an executor is computed again. release() lets go of them.
    """

    def __init__(self, old: Snapshot, new: Snapshot, strict_types: bool = False):
        self.held: list[DataFrame] = []
        self.old, self.new, self.strict_types = self._kept(old), self._kept(new), strict_types

    def _kept(self, snapshot: Snapshot) -> Snapshot:
        return Snapshot(self.keep(snapshot.components), self.keep(snapshot.refs), self.keep(snapshot.children), snapshot.depth)

    def keep(self, table: DataFrame) -> DataFrame:
        self.held.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def release(self) -> None:
        for table in self.held:
            table.unpersist()

    @cached_property
    def merged(self) -> Snapshot:
        return self._kept(merge.merge(self.old, self.new))

    @cached_property
    def merged_bases(self) -> DataFrame:
        """The merged components of base types."""
        return select.base_nodes(self.merged.components)

    @cached_property
    def new_bases(self) -> DataFrame:
        return select.base_nodes(self.new.components)

    @cached_property
    def base_refs(self) -> DataFrame:
        return self.merged.refs.join(self.merged_bases.select("unique_name"), "unique_name", "left_semi").select(*self.merged.refs.columns)

    @cached_property
    def members(self) -> DataFrame:
        """(parent, child, place, n, component_type, name, code_fragment, modifiers, code_hash, change) of the merged children that exist; n: how many their parent has."""
        owned = merge.existing_children(self.merged)
        many = owned.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        rows = self.merged.components.select("unique_name", "component_type", "name", "code_fragment", "modifiers", "code_hash")
        held = owned.join(many, "parent").withColumnRenamed("child", "unique_name").join(rows, "unique_name")
        return select.node_flags(held, self.component_changes).withColumnRenamed("unique_name", "child")

    #: Columns of keyed_members that tell the parent, and by which the rows lie together already.
    member_keys: tuple[str, ...] = ()

    @property
    def keyed_members(self) -> DataFrame:
        """The members with member_keys."""
        return self.members

    @cached_property
    def child_counts(self) -> DataFrame:
        """(unique_name, n): how many existing children a component has, if any."""
        return merge.existing_children(self.merged).groupBy(F.col("parent").alias("unique_name")).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def old_owners(self) -> DataFrame:
        return self.keep(hierarchy.nodes(self.old))

    @cached_property
    def new_owners(self) -> DataFrame:
        return self.keep(hierarchy.nodes(self.new))

    @cached_property
    def merged_owners(self) -> DataFrame:
        return self.keep(hierarchy.nodes(self.merged))

    @cached_property
    def old_relations(self) -> DataFrame:
        return self.keep(relations.extract(self.old, self.old_owners))

    @cached_property
    def new_relations(self) -> DataFrame:
        return self.keep(relations.extract(self.new, self.new_owners))

    @cached_property
    def merged_relations(self) -> DataFrame:
        return self.keep(relations.extract(self.merged, self.merged_owners))

    @cached_property
    def component_changes(self) -> DataFrame:
        return self.keep(changes.component_changes(self.old, self.new))

    @cached_property
    def base_changes(self) -> DataFrame:
        """The changes of components of base types."""
        return select.base_nodes(self.component_changes)

    @cached_property
    def relation_changes(self) -> DataFrame:
        return self.keep(changes.relation_changes(self.old_relations, self.new_relations, self.strict_types))

    @cached_property
    def paired(self) -> DataFrame:
        """The strongest merged relations beside their reverse, see relations.with_reverse(), with forth and back, see relations.flagged()."""
        return relations.flagged(relations.with_reverse(relations.strongest(self.merged_relations)), self.relation_changes)

    @cached_property
    def changes(self) -> DataFrame:
        return changes.all_changes(self.component_changes, self.key_relations)

    @cached_property
    def key_relations(self) -> DataFrame:
        """(unique_name); ends of relations are base components, so only their changes are looked at."""
        return changes.key_relation_components(self.base_changes, self.relation_changes)

    def changed_bases(self, files: Iterable[str] = ()) -> DataFrame:
        """(unique_name), see select.changed_bases()."""
        return select.changed_bases(self.merged, self.changes, files, self.merged_owners)

    @cached_property
    def without_new_base(self) -> DataFrame:
        """(unique_name) of what changed but has no base component in the new snapshot."""
        return select.without_base(self.new_owners, self.changes)

    def change_counts(self) -> DataFrame:
        """(change, n) for the log."""
        return self.changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


class Model:
    """What is drawn: the base components that a change touches, and the edges among them."""

    def __init__(self, diff: Diff, files: Iterable[str] = (), plugins: Plugins | None = None, enable_augmenters: bool = True):
        self.diff, self.files, self.plugins, self.augmented = diff, frozenset(files), plugins or Plugins(), enable_augmenters

    @cached_property
    def names(self) -> DataFrame:
        """(unique_name); augmenters have their say before edges are chosen."""
        out = self.diff.changed_bases(self.files)
        if self.augmented:
            for augmenter in ordered(self.plugins.augmenters):
                out = augmenter.augment(self.diff, out).select("unique_name").distinct()
        return self.diff.keep(out)

    def without_base(self) -> DataFrame:
        """(unique_name) of the changed members that no diagram shows, as they have no base component; their count is for the log."""
        return select.without_base(self.diff.merged_owners, self.diff.changes)

    @property
    def only_bases(self) -> bool:
        """Whether all nodes are base components, so that members need not be looked at for them."""
        return not self.augmented or all(a.only_bases for a in self.plugins.augmenters)

    @cached_property
    def nodes(self) -> DataFrame:
        out = select.diagram_nodes(self.diff.merged_bases if self.only_bases else self.diff.merged.components, self.names)
        notes = F.create_map().cast("map<string,string>")
        if self.augmented:
            for augmenter in ordered(self.plugins.augmenters):
                if (more := augmenter.metadata(out)) is not None:
                    notes = _updated(notes, more)
        return self.diff.keep(out.withColumn("augmentations", notes))

    @property
    def node_changes(self) -> DataFrame:
        return self.diff.base_changes if self.only_bases else self.diff.component_changes

    @property
    def node_refs(self) -> DataFrame:
        return self.diff.base_refs if self.only_bases else self.diff.merged.refs

    @cached_property
    def edges(self) -> DataFrame:
        return relations.among(self.diff.merged_relations, self.names)

    @cached_property
    def colors(self) -> DataFrame:
        return select.package_colors(self.nodes)

    def empty(self) -> bool:
        return self.names.isEmpty()


def compare(old: Snapshot, new: Snapshot, config: Config | None = None, plugins: Plugins | None = None) -> Model:
    config = config or Config()
    return Model(Diff(old, new, config.strict_types), config.files_filter, plugins, config.enable_augmenters)
