"""What the Arrow stages have in common."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from quern.llm import shared


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_task_gives_its_memory_back():
    kept, seen = [], []

    def run(batches):
        for b in batches:
            made = [bytes(800) for _ in range(250_000)]
            kept.extend(made[::500])  # in between, as the entries of a cache are
            del made
            seen.append(held_mb())
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    assert [b.num_rows for b in shared.released(run)(iter([batch]))] == [1]
    assert held_mb() < seen[0] - 100


def test_memory_is_given_back_after_an_error(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))

    def run(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(shared.released(run)(iter([1])))
    assert calls == [1]
