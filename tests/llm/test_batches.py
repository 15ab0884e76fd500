import gc

import numpy as np
import pyarrow as pa

from tableprobe.llm import batches as module
from tableprobe.llm.batches import copied, tidy


def test_copies_hold_the_rows_in_order_and_no_older_batch():
    """While a batch is read, the bytes of the one before are free, even if its last part is still held."""
    before, size, seen = pa.total_allocated_bytes(), 8_000_000, []

    def source():
        for n in (1, 0, 1, 1):
            gc.collect()
            assert pa.total_allocated_bytes() - before < size / 10
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * size // 8)), pa.nulls(n * size // 8, pa.string())], names=["n", "t"])

    for part in copied(source(), 30_000):
        assert part.num_rows <= 30_000
        seen.append(part.column("n").to_numpy().copy())
    assert np.array_equal(np.concatenate(seen), np.tile(np.arange(size // 8), 3))


def test_memory_is_given_back_when_the_work_is_over(monkeypatch):
    """After the last batch, and also if nobody asks for it."""
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000))], names=["n"])
    calls = []
    monkeypatch.setattr(module, "give_back", lambda: calls.append(1))

    def work(batches):
        for b in batches:
            held = pa.array(b.column("n").to_pylist())
            yield pa.RecordBatch.from_arrays([held], names=["n"])

    assert [b.num_rows for b in map(lambda b: b.slice(0, 5), tidy(work)(iter([batch])))] == [5]
    assert len(calls) == 1
    part = tidy(work)(iter([batch, batch]))
    next(part)
    part.close()
    assert len(calls) == 2


def test_give_back():
    module.give_back()
