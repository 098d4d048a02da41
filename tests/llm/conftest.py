from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import words  # noqa: E402


@pytest.fixture(scope="session")
def edges():
    """Rows of every awkward kind: nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(3)
    base = words(rng, 60)
    near = " ".join([*base.split(" ")[:-1], "changed"])
    rows = [(i, words(rng, rng.randint(1, 80)), ("en", "de", None)[i % 3], ("a", "b", None)[i % 3]) for i in range(1, 25)]
    rows += [(30, base, "en", "a"), (31, near, "en", "a"), (32, base.upper(), "en", "b"), (33, base, None, None)]
    rows += [(40, None, "en", "a"), (41, "", "de", "b"), (42, "  \n\t ", None, None), (43, "one", "en", "a"), (44, "...!?", "en", "a")]
    rows += [(50, words(rng, 30_000), "en", "a"), (51, "\u00e9\u4e2d\u6587 " * 40, "zh", "c"), (51, "\u00e9\u4e2d\u6587 " * 40, "zh", "c"), (52, "tie tie tie tie tie tie", "en", "a"), (53, "tie tie tie tie tie tie", "en", "a")]
    rows += [(None, words(rng, 20), "en", "a"), (None, base, None, None)]
    return rows
