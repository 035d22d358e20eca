import re
from pathlib import Path

import numpy as np

from millrace.llm.common import frugal


def _held_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()).group(1)) // 1024


def test_a_worker_gives_freed_memory_back():
    kept, seen = [], []

    def run(batches):
        for batch in batches:
            parts = [np.ones(10_000) for _ in range(2000)]
            kept.append(np.ones(10_000))  # what lies behind the freed parts holds the heap's end in place
            del parts
            seen.append(_held_mb())
            yield batch * 2

    before = _held_mb()
    assert list(frugal(run)(iter([1, 2]))) == [2, 4]
    assert seen[0] - before > 100 and _held_mb() - before < 40
