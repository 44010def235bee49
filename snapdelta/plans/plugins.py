"""What users may add: nodes and metadata before edges are chosen, lines in classes, lines in diagrams.

Plug-ins work on DataFrames and columns, so they stay inside the plan. They run in order of order, then class name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame

if TYPE_CHECKING:
    from .diff import Diff


class InsertionPoint(Enum):
    TOP = "top"
    AFTER_FIELDS = "after fields"
    AFTER_METHODS = "after methods"
    BOTTOM = "bottom"


class Augmenter:
    order = 100
    #: Whether augment() selects base components only; then members are not searched for the names.
    only_bases = False

    def augment(self, diff: Diff, names: DataFrame) -> DataFrame:
        """The selected names (unique_name), and more, or fewer."""
        return names

    def metadata(self, nodes: DataFrame) -> Column | None:
        """A map<string, string> put on every node, or None."""
        return None


class ClassDecorator:
    order = 100
    point = InsertionPoint.TOP

    def lines(self, style: dict[str, str]) -> Column | None:
        """An array of lines, from the columns of a node; null and empty ones are left out."""
        return None


class DiagramDecorator:
    order = 100

    def lines(self, style: dict[str, str]) -> list[str | None] | None:
        return None


@dataclass(frozen=True)
class Plugins:
    augmenters: tuple[Augmenter, ...] = ()
    class_decorators: tuple[ClassDecorator, ...] = ()
    diagram_decorators: tuple[DiagramDecorator, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)


def ordered(plugins: tuple) -> list:
    return sorted(plugins, key=lambda p: (p.order, f"{type(p).__module__}.{type(p).__qualname__}"))
