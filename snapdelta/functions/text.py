"""Text functions, column to column."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DOC_LIMIT = 800
#: Bytes of text that a worker unpacks at once; bounds its memory, not what is read.
CHUNK = 1 << 20
_BLOCKS = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = {"script", "style"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        if tag in _BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain(html: str) -> str:
    """The text of an HTML document or fragment, white space collapsed."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return re.sub(r"[ \t\n\f\r]+", " ", "".join(parser.parts)).strip(" ")


def mapped(f: Callable, to: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """f over the values that aren't null; what is unpacked into Python objects at once is about CHUNK bytes, or one value."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(array):
                done = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
                yield pa.array([None if (v := x.as_py()) is None else f(v) for x in array.slice(at, upto - at)], to)
                at = upto

    return run


def arrow_function(run: Callable, to: str, c: Column) -> Column:
    def typed(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(arrays)

    typed.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(typed, to)(c)


def html_text(c: Column) -> Column:
    """Tags removed, entities resolved; the one text function that needs Python."""
    return arrow_function(mapped(plain, pa.string()), "string", c)


def comment_marks_removed(c: Column) -> Column:
    """In this order: /*, then */, then *."""
    for mark in ("/*", "*/", "*"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def brackets(c: Column) -> Column:
    return F.translate(c, "()", "[]")


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\f\r]+", " "))


def wrapped(c: Column, width: int | Column = 80) -> Column:
    """Lines of at most width characters, broken at spaces; longer words stay whole."""
    pattern = F.lit(rf"(.{{1,{width}}})(?: |$)") if isinstance(width, int) else F.format_string("(.{1,%d})(?: |$)", width)
    return F.rtrim(F.regexp_replace(c, pattern, F.lit("$1\n")), F.lit("\n"))


def bold_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\r?\n"), lambda x: F.concat(F.lit("**"), x, F.lit("**"))), "\n")


def shortened(c: Column, limit: int = DOC_LIMIT) -> Column:
    """Texts of limit characters or more lose their end; all but empty ones get a line end."""
    cut = F.concat(F.trim(F.substring(c, 1, limit - 3)), F.lit("...\n"))
    return F.when(c == "", c).when(F.length(c) < limit, F.concat(c, F.lit("\n"))).otherwise(cut)


def documentation(c: Column, width: int | Column = 80) -> Column:
    """The whole chain: HTML, comment marks, brackets, spaces, wrapping, bold lines."""
    return bold_lines(wrapped(normalized(brackets(comment_marks_removed(html_text(F.trim(c))))), width))


def diagram_id(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("-"))


def qualified_id(package: Column, name: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) == "", diagram_id(name)).otherwise(F.concat_ws(".", package, diagram_id(name)))


def ids_removed(svg: Column, ids: Column) -> Column:
    """Every id of an array taken out of a text, one after the other."""
    return F.aggregate(ids, svg, lambda text, name: F.replace(text, name, F.lit("")))
