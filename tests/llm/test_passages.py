"""Operator 8: words of passages that documents share, and long periodic texts."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from barloom.llm import suffix_dedup


def shared_words(rows, passage):
    words = [re.findall(r"[^ \t-\r]+", t or "") for _, t in rows]
    holders = collections.defaultdict(set)
    for i, w in enumerate(words):
        for p in range(len(w) - passage + 1):
            holders[tuple(w[p : p + passage])].add(i)
    out = []
    for w in words:
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - passage + 1):
            if len(holders[tuple(w[p : p + passage])]) > 1:
                hit[p : p + passage] = True
        out.append(int(hit.sum()))
    return out


@pytest.mark.parametrize("split", [1000, 6])
def test_shared_words_match_brute_force(spark, split):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    parts = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = [w for _ in range(rng.randrange(6)) for w in (rng.choice(parts) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randrange(25))])]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(900, None), (901, ""), (902, "so " * 80), (903, "so " * 70 + "it " * 40), (904, rows[3][1]), (905, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.remove_repeats(frame, 64, 24, split, 5000, passage=15).collect()}
    want = shared_words(rows, 15)
    assert [got[i] for i, _ in rows] == want and sum(want)


def test_periodic_text_is_cut_into_pieces(spark, monkeypatch):
    text = "abcdefghij" * 30_000
    rows = [(1, text), (2, "z" + text[3:200_000] + "y"), (3, "q" * 399), (4, "w" * 401)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), split=4).collect()}
    assert got[1].n_removed == len(text) and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (199_997, 1, hashlib.sha256(b"zy").hexdigest())
    assert got[3].n_removed == 0 and got[4].n_removed == 401


def test_other_columns_do_not_clash(spark):
    frame = spark.createDataFrame([(1, "a" * 500, 7, 8), (2, None, 7, 8)], "doc_id long, text string, uid long, keys long")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame).collect()} == {1: 500, 2: 0}


def pieces_of_copies(rng, n):
    """Distinct pieces of 549 bytes, most of them cut from shared text."""
    text = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz      ,.", k=n // 3))
    out = {text[a : a + 549]: None for a in (rng.randrange(len(text) - 549) for _ in range(n // 549))}
    return list(out)


@pytest.mark.parametrize("packed", [63, 0])
def test_classes_from_ranks_equal_those_from_common_prefixes(monkeypatch, packed):
    monkeypatch.setattr(suffix_dedup, "_PACKED", packed)
    rng = random.Random(3)
    for pieces, size in ((pieces_of_copies(rng, 40_000), 400), ([b"ab" * 300, b"ba" * 300, b"b" + bytes(500), bytes(450)], 400), ([bytes(9), b"\0\1" * 5, bytes(8)], 7)):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        padded = data.tobytes() + bytes(2 * len(data) + 16)
        for h, rank in suffix_dedup.doublings(data, len(data)) if data.all() else ():
            starts = [padded[p : p + h] for p in range(len(data))]
            first = {}
            for i, x in enumerate(sorted(starts), 1):
                first.setdefault(x, i)
            assert rank[: len(data)].tolist() == [first[x] for x in starts]
        array = suffix_dedup.suffix_array(data)
        common = suffix_dedup.kasai(data, array, size)
        windows = np.array([len(p) - size + 1 for p in pieces])
        at, kinds, count = suffix_dedup.repeated_windows(pieces, windows, size)
        place = np.empty(len(data), np.int64)
        place[array] = np.arange(len(data))
        order = np.argsort(place[at])
        fresh = [common[a + 1 : b + 1].min() < size for a, b in zip(place[at][order], place[at][order][1:])]
        assert kinds[order].tolist() == np.cumsum([0, *fresh]).tolist() and len(set(kinds.tolist())) < len(at)
        assert count.tolist() == np.bincount(kinds)[kinds].tolist()


def test_a_blocks_classes_cost_few_sorts():
    pieces = pieces_of_copies(random.Random(4), 1 << 18)
    windows = np.full(len(pieces), 150)
    eight = suffix_dedup.eight_bytes(np.frombuffer(b"".join(pieces), np.uint8))

    def least(work):
        took = []
        for _ in range(5):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: suffix_dedup.repeated_windows(pieces, windows, 400)) < 6 * least(lambda: np.argsort(eight, kind="stable"))
