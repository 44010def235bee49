"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")

#: Text that is unpacked into Python objects at once, in characters; bounds a worker's memory, not what is read.
CHUNK_CHARS = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that and the context's own are unset, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own_folder = tempfile.mkdtemp(prefix="snapdelta-")
        atexit.register(shutil.rmtree, own_folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own_folder)
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows lie in the shared folder and outlive the executors that made them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like checkpoint(), as a compressed column table: for results that are wide or read by column."""
    spark = df.sparkSession
    path = f"{_written(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _written(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/written-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the tables that written() made in this application: to be called once its results are saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(float))
        at, done = 0, 0.0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, upto - at)
            done, at = float(sizes[upto - 1]), upto


def text_key(*columns: str) -> Column:
    """A 128-bit name of the given columns' values, for rows that carry no key of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return F.md5(F.concat_ws("\x01", *parts))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each item, place of each item in its row) for rows of these lengths laid end to end."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
    return rows, np.arange(len(rows)) - np.repeat(starts, lengths)


def trigrams(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of <word>, laid end to end, and how many each word has (its letters, one at least)."""
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    if len(points) < 3:
        return np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=np.int64)
    code = points.copy()
    code[:-1] = code[:-1] * np.uint64(0x9E3779B1) + points[1:]
    code[:-2] = code[:-2] * np.uint64(0x85EBCA6B) + points[2:]
    ends = np.cumsum(lengths)
    keep = np.ones(len(points), dtype=bool)
    keep[ends - 1] = False
    keep[ends - 2] = lengths < 3
    code = code[keep]
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return (code % np.uint64(size)).astype(np.int64), np.maximum(lengths - 2, 1)


def words(text: str) -> list[str]:
    """The text's words in lower case."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of words() begin and end in the text."""
    low = text.lower()
    return [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]
