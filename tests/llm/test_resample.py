"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import resample
from tests.llm.test_operators import LOW, awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def plain(rows, target, n, buckets, least, percent, seed):
    hashed = [(d, runs(t, n)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, (_, fs) in hashed:
        s.update(zlib.crc32(f.encode()) % buckets for f in fs)
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in runs(text, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, (words, fs) in hashed:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=str)


TARGET = ["the market price of the bar", None, "", "token42 volume open close river stone stone", "é ß 日本 The"]


@pytest.mark.parametrize(("n", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (3, 97, 5, 50), (2, 1000, 0, 100)])
def test_equals_plain(spark, n, buckets, least, percent):
    rows = awkward() + [(None, "no id " * 30, "x")] + [(7, "same words " * 20, "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, weight int")
    got = sorted((tuple(r) for r in resample.resample(docs, target, n, buckets, least, percent).collect()), key=str)
    want = plain([(d, t) for d, t, _ in rows], TARGET, n, buckets, least, percent, resample.SEED)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    ids = [(r[4], r[0]) for r in sorted(got, key=lambda r: r[4] or 10**9) if r[4]]
    assert ids == sorted(((r[4], r[0]) for r in want if r[4]), key=lambda x: x[0])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = docs.select("text")
    assert resample.resample(docs, none).collect() == []
    one = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    assert resample.resample(one, none, percent=100).first()["rank"] == 1


def test_pieces_of_a_long_text():
    data = b"one two,three " * 50 + b"x" * 500
    assert [w for part in resample.word_pieces(data, 16) for w in part] == b" ".join(data.split()).replace(b",", b" ").split()
    for n in (1, 2, 4):
        ring, whole = resample.Ring(n), resample.Ring(n)
        cut = [c for part in resample.word_pieces(data, 16) for c in ring.feed(part)]
        assert cut == whole.feed([w for part in resample.word_pieces(data) for w in part])
