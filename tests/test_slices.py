"""Python functions over texts unpack a slice of a batch at a time."""

import gzip

import pyarrow as pa

from snapdelta.functions import codec, text
from snapdelta.plans import render


def test_a_batch_is_unpacked_in_slices(monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 10)
    values = ["<p>aaaa", None, "", "b" * 30, "c", None, "d"]
    got = list(text.mapped(text.plain, pa.string())(iter([pa.array(values), pa.array([], pa.string())])))
    assert [len(x) for x in got] == [3, 1, 3]
    assert [v for x in got for v in x.to_pylist()] == ["aaaa", None, "", "b" * 30, "c", None, "d"]


def test_bytes_are_unpacked_in_slices(monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 2)
    got = list(text.mapped(codec._gzip, pa.binary())(iter([pa.array([b"ab", b"cd", None])])))
    assert [len(x) for x in got] == [1, 2]
    assert gzip.decompress(got[1][0].as_py()) == b"cd"


def test_texts_are_packed_in_rows():
    def packed(most, *batches):
        made = [pa.RecordBatch.from_arrays([pa.array([3] * len(b), pa.int32()), pa.array(b, pa.string())], names=["part", "fragment"]) for b in batches]
        return [tuple(r.values()) for x in render._packed(most)(iter(made)) for r in x.to_pylist()]

    assert packed(4, ["ab", "cd", "e"], [], ["fghijk", "l"], ["m"]) == [(3, 0, "abcd"), (3, 1, "e"), (3, 2, "fghijk"), (3, 3, "lm")]
    assert packed(4, ["abcdef"], ["", "g"]) == [(3, 0, "abcdef"), (3, 1, "g")]
    assert packed(3, ["é", "é"]) == [(3, 0, "é"), (3, 1, "é")] and packed(9, []) == [] == packed(9)
