"""Every query of the engine against its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from snapdelta.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"change", "component_type", "n"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_diagram_text_has_every_class_and_edge(spark, sf_dir):
    (diagram,) = QUERIES["diagram_text"](spark, sf_dir).first()
    blocks = [r.block for r in QUERIES["class_blocks"](spark, sf_dir).collect()]
    lines = [r.line for r in QUERIES["edge_lines"](spark, sf_dir).collect()]
    assert blocks and lines and sum(map(len, blocks)) + sum(map(len, lines)) < len(diagram)
    assert all(b in diagram for b in blocks) and set(lines) <= {f"{x}\n" for x in diagram.split("\n")}
