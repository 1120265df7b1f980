"""Packing: the library's ids, whole and gapless sequences, few of them, and the parts of the search."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import packing
from barloom.llm.common import TextBlock
from tests.llm.test_operators import awkward

ODD = ["<|endoftext|>x<|startoftext|> y", "it's we'll I'M they've", "a\x1cb\x1dc d e\x85f", "é ́x İSTANBUL ΣΑΣ ς", "12 3four５", "日本語 한국어 한", "x" * 9000, "word " * 9000]


@pytest.fixture(scope="module")
def rows():
    return awkward() + [(400 + i, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x")] * 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.model_path())


@pytest.mark.parametrize(("size", "block"), [(4096, 4000), (128, 40)])
def test_whole_and_gapless(spark, rows, library, size, block):
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    packed = packing.pack(docs, size=size, keep_ids=True, block=block).persist()
    got = packed.collect()
    want = []
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), size)):
            part = np.array(ids[lo : lo + size], "<u4")
            want.append((d, k, lo, len(part), zlib.crc32(part.tobytes()), part.tolist()))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for held in bins.values():
        at = 0
        for offset, length, _ in sorted(held, key=lambda x: x[0]):
            assert offset == at
            at += length
        assert at <= size
    lengths = np.array([w[3] for w in want])
    assert len(bins) <= packing.least_bins(lengths, size) + 2 + len(lengths) // 100
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert whole == {s: [i for _, _, ids in sorted(held, key=lambda x: x[0]) for i in ids] for s, held in bins.items()}
    packed.unpersist()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).collect() == []
    assert [r.length for r in packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [1]


def test_every_code_point_keeps_its_ids(library):
    """Cutting at white space and between kinds changes no id, whatever stands beside the cut."""
    own = packing.Encoder(packing.model_path())
    marks = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} {c}b\n{c}{c} a{c} 1{c}2 '{c} .{c},{c}S" for c in marks]
    assert [x.tolist() for x in own.encode(TextBlock(pa.array(texts)))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ascii_neighbours_keep_their_ids(library):
    own, rng = packing.Encoder(packing.model_path()), random.Random(4)
    texts = ["".join(rng.choice("aBst'rREvelmdD09.,!-<|> \n_\x1c\u00e9\u0301\u00c9") for _ in range(40)) for _ in range(4000)] + ["<|ENDOFTEXT|> A", "A<|endoftext|>s"]
    assert [x.tolist() for x in own.encode(TextBlock(pa.array(texts)))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def fits(bins, lengths, size):
    return len(bins) == len(lengths) and (np.bincount(bins, lengths) <= size).all() and len(np.unique(bins)) == bins.max() + 1


def test_genetic_steps_keep_all_pieces():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = int(rng.integers(5, 60))
        lengths = rng.integers(1, size, int(rng.integers(1, 80)))
        people = packing.populate(lengths, size, 4, rng)
        assert all(fits(p, lengths, size) for p in people)
        if len(people) > 1:
            child = packing.crossover(people[0], people[1], lengths, size, rng)
            assert fits(child, lengths, size) and fits(packing.mutate(child, lengths, size, rng), lengths, size)
        out = packing.evolve(people, lengths, size, 10, rng)
        assert packing.fitness(out[0], lengths, size) >= max(packing.fitness(p, lengths, size) for p in people)
        assert out[0].max() + 1 >= packing.least_bins(lengths, size)


def test_injected_bins_stay_whole():
    size, lengths = 10, np.array([6, 4, 7, 3, 5, 5, 9, 2, 8])
    one = np.array([0, 0, 1, 1, 2, 2, 3, 4, 4])
    two = np.array([0, 1, 2, 2, 1, 3, 4, 5, 6])
    child = packing.crossover(one, two, lengths, size, np.random.default_rng(1))
    whole = [set(np.flatnonzero(one == b)) for b in range(5)]
    assert fits(child, lengths, size) and any(set(np.flatnonzero(child == b)) in whole for b in range(child.max() + 1))


@pytest.mark.parametrize("seed", [0, 2, 4, 7, 9, 11, 16])
def test_evolution_finds_what_best_fit_misses(seed):
    """Random pieces that longest-first best fit packs into one bin too many."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(20, 101, 120)
    people = packing.populate(lengths, 150, 8, rng)
    out = packing.evolve(people, lengths, 150, 600, rng)
    assert out[0].max() + 1 == packing.least_bins(lengths, 150) == people[0].max()


def test_least_bins_is_a_bound():
    assert packing.least_bins(np.array([6, 6, 6]), 10) == 3
    assert packing.least_bins(np.array([7, 7, 4, 4]), 10) == 3
    assert packing.least_bins(np.array([5, 5]), 10) == 1
