"""Second stripes of the collocations: few rows, and every entry in one part."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geopatch.llm import collocations


@pytest.mark.parametrize("hot", [{}, {"en": {b"w1", b"w2"}}])
def test_rows_do_not_grow_with_prefixes(hot):
    rng = random.Random(1)
    words = [f"w{min(rng.randrange(4000), rng.randrange(4000))}" if rng.random() < 0.8 else "w1" for _ in range(20000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(words)])], names=["lang", "text"])
    bits = 1 << 10
    rows = list(collocations.pair_stripes(lambda: np.full(bits // 64, 2**64 - 1, np.uint64), bits, hot)(iter([batch])))
    assert sum(b.num_rows for b in rows) <= collocations.PARTS < len(set(words))
    found, parts = Counter(), {}
    for r in (r for b in rows for r in b.to_pylist()):
        for prefix, follow, count in zip(r["prefix"], r["next"], r["count"], strict=True):
            for x, n in zip(follow, count, strict=True):
                found[f"{prefix} {x}"] += n
                parts.setdefault(prefix, set()).add(r["part"])
    assert found == Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
    assert (len(parts["w1"]) > 100) == bool(hot) and len(parts["w7"]) == 1
