"""Every stretch that counts as a leak holds a seed."""

import itertools

import pyarrow as pa
import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import decontaminate as D
from barloom.llm.common import TextBlock


@pytest.mark.parametrize("size", range(13, 21))
def test_all_placements_of_substitutions_are_found(size):
    item = [f"w{k}" for k in range(size)]
    index = D.build_index([(1, " ".join(item))])
    texts = [" ".join("changed" if k in gone else w for k, w in enumerate(item)) for gone in itertools.combinations(range(size), size // 5)]
    found = D.hits_of(TextBlock(pa.array(texts)), index, D._filters(index), D.LEAST, D.SHARE)
    assert [r[0] for r in found] == list(range(len(texts))) and all(r[4] == size for r in found)


def test_longer_stretches_follow():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in D.MASKS]
    for size in range(21, 26):
        seeds = [sum(1 << (a + i) for i in m) for m in masks for a in range(size - m[-1])]
        for gone in itertools.combinations(range(size), size // 5):
            hole = sum(1 << k for k in gone)
            assert any(not s & hole for s in seeds)
