"""The pipeline's near-dedup stage against brute force over shingle sets."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from barloom.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if near(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(sets))]


def edited():
    """Texts with copies of 0.6 to 0.97 similarity, and awkward rows."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60, 300))]
        rows.append((i, " ".join(base)))
        for part in (0.005, 0.01, 0.02, 0.03, 0.05):
            i += 1
            rows.append((i, " ".join(word() if rng.random() < part else w for w in base)))
        i += 1
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  TWO"), (9004, "one two three"), (9005, "a " * 500), (9006, "a " * 400)]
    return rows


def test_stage_matches_brute_force(spark):
    rows = edited()
    sets = [shingles(t) for _, t in rows]
    root = groups(sets)
    want = {rows[k][0] for k in range(len(rows)) if root[k] == k}
    assert 60 < len(want) < len(rows) - 60
    docs = spark.createDataFrame([(i, t, "junk") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"x{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text + " end"), (2, "a text of its own that no other row has"), (None, text), (None, "null id and a text of its own"), (3, text.upper())]
    out = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text), rows[3], rows[5]], key=str)


def test_keys_meet_as_often_as_reckoned():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(300):  # pairs of 90 with 80 in common: 0.8
        h = rng.integers(0, 2**63, 100, dtype=np.uint64)
        sets += [np.sort(h[:90]), np.sort(h[10:])]
    keys = similar.band_keys(np.concatenate(sets), np.arange(0, 90 * 600 + 1, 90))
    same = (keys[::2] == keys[1::2]).sum(axis=1)
    assert same.min() > 0 and abs(same.mean() / similar.BANDS - 0.8**similar.ROWS) < 0.01


@pytest.mark.parametrize("limit", [7, 40])
def test_large_coarse_groups_are_split_exactly(spark, limit):
    """Chains of ever more edited copies: neighbours are near, ends are not, and groups hang together by single links."""
    rng = random.Random(17)
    rows, i = [], 0
    for base in range(4):
        words = [f"b{base}w{k}" for k in range(120)]
        for step in range(60):
            rows.append((i, " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([1, 1, 2, 4, 9])):
                words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            i += 1
    rng.shuffle(rows)
    sets = [shingles(t) for _, t in sorted(rows)]
    root = groups(sets)
    want = [k for k in range(len(rows)) if root[k] == k]
    assert 8 < len(want) < 120
    out = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limit=limit)
    assert sorted(r.doc_id for r in out.collect()) == want


def test_links_between_groups():
    sets = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 3, 30)]
    inner = [(k, k % 2, s.tobytes()) for k, s in enumerate(sets)]
    found = similar.links_between([(9, 0, sets[0].tobytes()), (8, 5, sets[2].tobytes())], inner)
    near = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    assert (9, 1) in found and not any(node == 9 and k % 2 == 0 for node, k in found)
    assert {k % 2 for node, k in found if node == 8} == {k % 2 for k, s in enumerate(sets) if near(sets[2], s)}


def test_identities_have_128_bits(spark):
    """Nodes that agree in either half of their digest stay two; rows are told apart by 16 bytes."""
    import pyarrow as pa

    nodes = np.array([[7, 1], [7, 2], [8, 2], [8, 2]], np.uint64)
    values = similar.wide(nodes)
    assert [len(v) for v in values.to_pylist()] == [16] * 4 and (similar.narrow(values.slice(1, 3)) == nodes[1:]).all()
    assert len(similar.narrow(values.slice(0, 0))) == 0
    batches = [pa.record_batch([pa.array([5] * len(part)), similar.wide(part)], names=["key", "node"]) for part in (nodes[:2], nodes[2:])]
    links = [(a, b) for batch in similar.chains(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert links == [(values[0].as_py(), values[1].as_py()), (values[1].as_py(), values[2].as_py())]
    sets = np.arange(12, dtype=np.uint64)
    found = similar.digests(sets, np.array([0, 4, 8, 8, 12]))
    assert found.shape == (4, 2) and all(len(set(found[:, k].tolist())) == 4 for k in (0, 1))
    keys = spark.createDataFrame([(1, "a"), (None, "1:a"), (11, ""), (1, None), (None, None)], "doc_id long, text string")
    keys = [bytes(r[0]) for r in keys.select(similar.row_key("doc_id", "text")).collect()]
    assert len(set(keys)) == 5 and {len(k) for k in keys} == {16}


def simhash(shingled):
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingled]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_alone_finds_what_its_radius_holds(spark, monkeypatch):
    """Without min-wise keys the stage still joins near texts of few differing bits, by chains and exactly."""
    rows = edited()
    sets = [shingles(t) for _, t in rows]
    prints = [simhash(s) for s in sets]
    coarse = list(range(len(rows)))
    for _ in rows:  # to the end of every chain
        before = list(coarse)
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    coarse[a] = coarse[b] = min(coarse[a], coarse[b])
        if coarse == before:
            break
    want = set()
    for c in set(coarse):
        own = [k for k in range(len(rows)) if coarse[k] == c]
        root = groups([sets[k] for k in own])
        want |= {k for i, k in enumerate(own) if root[i] == i}
    want = {rows[k][0] for k in want} - {9001}  # texts without words are one node from the start
    assert len(want) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = similar.prints
    monkeypatch.setattr(similar, "prints", lambda *a: plain(*a).withColumn("keys", F.array().cast("array<long>")))
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(want)


def test_simhash_links_join_all_within_the_radius(spark):
    """Equal fingerprints of different nodes, chains of steps of four bits, five bits apart; no fingerprint, no link."""
    prints = [0, 0b1111, 0b11111111, -1, -1, -1 ^ 0b11111, None, 1 << 40 | 0x5A5A5A5A5A << 8]
    rows = [(bytes([k]) * 16, p) for k, p in enumerate(prints)]
    found = [(r.a[0], r.b[0]) for r in similar.simhash_links(spark.createDataFrame(rows, "node binary, fp long").withColumn("keys", F.array().cast("array<long>"))).collect()]
    root = {k: k for k in range(len(rows))}
    for _ in root:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert list(root.values()) == [0, 0, 0, 3, 3, 5, 6, 7]


def test_near_simhashes_of_a_block_are_linked():
    """Every candidate passes the SimHash: of one key those within 28 bits, of different keys none, over batches and among copies."""
    import pyarrow as pa

    low = lambda n: (1 << n) - 1
    rows = [(1, 0), (1, 0), (1, low(28)), (2, low(29)), (2, 0), (3, 0), (4, low(28)), *((5, low(k)) for k in range(0, 60, 2))]
    rows = sorted(rows)
    batches = [pa.record_batch([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], names=["key", "fp"]) for part in (rows[:1], rows[1:4], rows[4:4], rows[4:20], rows[20:])]
    links = {frozenset(x) for batch in similar.block_links(iter(batches)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x[0] != x[1]}
    assert frozenset((0, low(28))) in links and frozenset((0, low(29))) not in links
    joined, size = {0}, 0
    while len(joined) > size:
        size = len(joined)
        joined |= {v for link in links if link & joined for v in link}
    assert joined == {low(k) for k in range(0, 60, 2)}


def test_no_pair_skips_the_simhash(spark, monkeypatch):
    """Copies that share keys but have far fingerprints are no candidates."""
    rows = [(k, " ".join(f"x{j}" for j in range(k % 2, 60 + k % 2))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [0]
    plain = similar.prints
    monkeypatch.setattr(similar, "prints", lambda *a: plain(*a).withColumn("fp", F.when(F.col("doc_id") % 2 == 0, F.lit(0)).otherwise(F.lit(-1)).cast("long")))
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == [0, 1]


def test_a_worker_stays_small():
    """Four MB of texts, long or short, take a worker a few tens of MB, however many rows come at once."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    for length, rows in ((400, 2000), (8, 10_000)):
        texts = [" ".join(rng.choices(words, k=length)) for _ in range(rows)]
        batch = pa.record_batch([pa.array([b"0" * 16] * rows), pa.array(range(rows)), pa.array(texts)], names=["row", "doc_id", "text"])
        tracemalloc.start()
        out = list(similar.prints(Rows())(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(b.num_rows for b in out) == rows and peak < 80 << 20, peak >> 20


def test_small_tables_have_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the tables of a few rows between the steps are no files of a row each."""
    from barloom.llm import common, components

    monkeypatch.setattr(common, "FILE_ROWS", 30)
    files, plain = {}, common.materialize

    def counted(df, name, *rows):
        out = plain(df, name, *rows)
        files.setdefault(name, []).append((len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = [(4 * k + j, " ".join(f"t{k}w{i}" for i in range(60)) + " x" * j) for k in range(40) for j in range(4)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(r.doc_id for r in out.collect()) == [4 * k for k in range(40)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    most = max(spark.sparkContext.defaultParallelism, -(-4 * len(rows) // 30))
    assert len(files["links"]) > 1 and max(n for name in files.keys() - {"prints", "roots"} for n, _ in files[name]) <= most < 61, files
