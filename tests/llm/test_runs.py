"""Repeats travel as runs of windows, not as one number per window."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd

from moodmill.llm import anchors, suffix_dedup

SHARD = ["sig", "part", "content", "doc_id", "start", "last_doc", "last_start"]


def test_a_span_found_in_one_place_is_one_run():
    rng = random.Random(3)
    a, b = (bytes(rng.randrange(97, 123) for _ in range(n)) for n in (180, 60))
    rows = [
        (1, 0, a, 1, 0, 4, 7),  # stands twice
        (2, 0, a[:120], 2, 5, 2, 5),  # inside of another, which comes later
        (2, 0, b[:30] + a[:150], 3, 0, 3, 0),
        (3, 0, a[:110], 6, 0, 6, 0),  # once only
    ]
    found = pd.concat(suffix_dedup.first_strings(iter([pd.DataFrame(rows, columns=SHARD)])))
    runs = {r.digest: (list(r.ends), list(r.first_doc), list(r.first_start)) for r in found.itertuples()}
    md5 = lambda x: hashlib.md5(x).digest()
    assert runs == {
        md5(a): ([81], [1], [0]),
        # 30 windows of its own, then those of the text before, less their number
        md5(b[:30] + a[:150]): ([30, 51, 81], [3, 2, 3], [0, 5 - 30, 0]),
    }


def test_covered_symbols_of_runs():
    gone = anchors.covered(12, np.array([1, 7]), np.array([3, 8]), 3)
    assert np.flatnonzero(gone).tolist() == [1, 2, 3, 4, 7, 8, 9]
