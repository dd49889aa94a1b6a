"""Bodies come to Python in bounded slices."""

import pyarrow as pa

from chunkloom.operators import chunking


def test_slices_bound_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(chunking, "ROWS", 5)
    monkeypatch.setattr(chunking, "BYTES", 100)
    bodies = [b"x" * n for n in (10, 90, 1, 500, 0, 60, 60)] + [None] * 12
    got = list(chunking.slices([pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])]))
    assert [b for s in got for b in s.column(0).to_pylist()] == bodies
    assert all(s.num_rows <= 5 and (s.num_rows == 1 or sum(len(b or b"") for b in s.column(0).to_pylist()) <= 100) for s in got)
