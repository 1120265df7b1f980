"""Near-duplicates by SimHash, min-wise keys and exact Jaccard similarity of word shingles (the pipeline's stage).

Two texts are near where their sets of five-word shingles have a Jaccard similarity of at
least 0.8; groups are the components of that relation, and one row of each group stays.

1. Rows with equal shingle sets become one node. Sets and rows are told apart by 128 bits.
2. Each node has a SimHash, the bits that over half of its shingles' hashes have. A pair at
   0.8 differs in 9.7 of 64 bits on average, and in over ``WIDE`` bits with probability 9.5e-9
   (1.1e-6 where a bit differs with 3 in 16, as for sets of 4 and 5). SimHashes are compared
   bit-sliced, as in operator 9: all with all up to ``simhash.RADIUS`` bits, and up to ``WIDE``
   bits, a radius that no search of all with all can have, in blocks.
3. Nodes of one block share a key: each of ``BANDS`` keys is made of ``ROWS`` minima of the
   shingles' hashes. A pair of similarity s shares no key with probability
   (1 - s^ROWS)^BANDS: 1.1e-6 at 0.8, below 1e-15 from 0.87 on. Nodes whose SimHashes are
   near by either search are joined to coarse groups, which may well be too large.
4. Every coarse group is sent to one task with its shingle sets, each once. There the
   similarities are computed exactly, in integers, from postings: a node is compared with
   all nodes not yet linked, and those that it links leave the postings.
5. A coarse group of over ``LIMIT`` nodes is dealt over several tasks. Each finds the groups
   of its part; their first nodes are compared in the same way, which joins the parts of a
   large group. What is left are the nodes outside the largest group so found: they are
   compared with all nodes of the coarse group, part by part. So no task holds more than
   ``LIMIT`` nodes twice, and no near pair of two groups goes unseen.

Defined cases: null text counts as empty; texts without words are near each other only; a
text of fewer than five words is one shingle; of a group the row with the smallest doc_id
stays (null comes last), of rows that share it the one with the smallest digest, and of
rows equal in doc_id and text any one; an empty table stays empty; a very long text is
one slice in one task. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, TextBlock, materialize, mix, slices
from .components import connected_components, join_spread
from .simhash import SEED, bucket_links, links, majority_bits, shingle_hashes

SHINGLE = 5
#: Similarity of at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
ROWS, BANDS = 8, 75
WIDE = 28
LIMIT = 5_000
_MINIMA = np.random.default_rng(SEED).integers(1, 2**31, (ROWS * BANDS, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WEIGHTS = np.random.default_rng(SEED + 1).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.array([0, 0x9E3779B97F4A7C15], np.uint64)
_CHUNK = 1 << 15  # hashes at a time, so that they stay in the cache


def sets_of(block: TextBlock, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every document, rising, and where each document's begin (n + 1 entries)."""
    hashes, count = shingle_hashes(block, shingle)
    doc = np.repeat(np.arange(block.n), count)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=block.n))))


def digests(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set (n x 2); equal sets have equal numbers."""
    halves = []
    with np.errstate(over="ignore"):
        for salt in _SALTS:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ salt), dtype=np.uint64)))
            halves.append(mix(sums[begins[1:]] - sums[begins[:-1]]))
    return np.column_stack(halves)


def wide(pairs: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as values of 16 bytes."""
    offsets = np.arange(0, 16 * len(pairs) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(pairs), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs, np.uint64).tobytes())])


def narrow(values: pa.Array) -> np.ndarray:
    """Values of 16 bytes as rows of two 64-bit numbers."""
    values = values.cast(pa.binary(16)) if len(values) else pa.array([], pa.binary(16))
    raw = values.buffers()[1]
    return np.frombuffer(raw, np.uint64, 2 * len(values), 16 * values.offset).reshape(-1, 2) if len(values) else np.zeros((0, 2), np.uint64)


def band_keys(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """BANDS keys for each of the sets, none of which is empty."""
    n = len(begins) - 1
    low = np.full((len(_MINIMA), n), 0xFFFFFFFF, np.uint32)
    halves = (hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32))
    for lo in range(0, len(hashes), _CHUNK):
        hi = min(lo + _CHUNK, len(hashes))
        i, j = np.searchsorted(begins, lo, side="right") - 1, np.searchsorted(begins, hi, side="left")
        at = np.maximum(begins[i:j] - lo, 0)
        parts = [h[lo:hi] for h in halves]
        for k, (a, c) in enumerate(_MINIMA):
            found = np.minimum.reduceat((parts[k % 2] ^ c) * a, at)
            np.minimum(low[k, i:j], found, out=low[k, i:j])
    keys = np.empty((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band, weights in enumerate(_WEIGHTS):  # one at a time: the minima as 64 bits of all are many times the texts
            mixed = mix(low[band * ROWS : (band + 1) * ROWS].astype(np.uint64)) * weights[:, None]
            keys[:, band] = mix(mixed.sum(axis=0, dtype=np.uint64))
    return keys


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): row is a digest of the other two."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(row_key(id_col, text_col).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def row_key(id_col: str, text_col: str):
    """16 bytes of a sha256 of id and text: at this width no two of any corpus's rows are taken for each other."""
    named = F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def prints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, node, fp, keys) of each row; a row without words has neither SimHash nor keys."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, STAGE_BYTES):
                hashes, begins = sets_of(TextBlock(batch.column(2)), shingle)
                size = np.diff(begins)
                some = np.flatnonzero(size)
                keys = band_keys(hashes, np.append(begins[some], len(hashes))) if len(some) else np.zeros((0, BANDS), np.uint64)
                offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))
                fp = pa.array(majority_bits(hashes, size).view(np.int64), mask=size == 0)
                yield pa.record_batch([batch.column(0), batch.column(1), wide(digests(hashes, begins)), fp, lists], names=["row", "doc_id", "node", "fp", "keys"])

    return rows.mapInArrow(run, "row binary, doc_id long, node binary, fp long, keys array<long>")


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in order of both -> links (a, b) that join the SimHashes of one key within ``WIDE`` bits."""

    def fresh():
        for batch in batches:
            key, fp = (batch.column(i).to_numpy() for i in (0, 1))
            some = np.ones(len(key), bool)
            some[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])  # copies are compared once
            yield pa.record_batch([pa.array(np.zeros(int(some.sum()), np.int32)), pa.array(key[some]), pa.array(fp[some])], names=["which", "key", "fp"])

    return bucket_links(fresh(), WIDE)


def simhash_links(seen: DataFrame, about: int | None = None) -> DataFrame:
    """Links (a, b) that join all nodes whose SimHashes a chain of steps joins, each within the radius, or within ``WIDE`` bits in a block; seen: written (node, fp, keys), of about so many rows."""
    some = seen.where("fp IS NOT NULL")
    by_print = materialize(some.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints", about)
    keyed = some.select(F.explode("keys").alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    in_blocks = keyed.mapInArrow(lambda batches: block_links(batches), "a long, b long")
    near = materialize(links(by_print.select("fp")).unionByName(in_blocks).where("a <> b").distinct(), "near", about and 2 * about)
    ends = [by_print.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node")).hint("merge") for end in ("a", "b")]
    different = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return different.unionByName(chained(some.select(F.col("fp").alias("key"), "node").distinct()))


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order of both -> links (a, b) between neighbours of one key."""
    key, node = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), narrow(batch.column(1))
        before_key, before = np.roll(keys, 1), np.roll(nodes, 1, axis=0)
        same = before_key == keys
        before[0], same[0] = (nodes[0], False) if key is None else (node, key == keys[0])
        key, node = keys[-1], nodes[-1]
        same &= (before != nodes).any(axis=1)
        yield pa.record_batch([wide(before[same]), wide(nodes[same])], names=["a", "b"])


def chained(keyed: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes of one key; keyed: (key, node)."""
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(chains, "a binary, b binary")


def exact_groups(sets: list[np.ndarray], near: tuple[int, int] = NEAR) -> np.ndarray:
    """For each set the index of the first of its group: the closure of pairs with similarity of at least near[0] / near[1]."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    begins = np.concatenate(([0], np.cumsum(size)))
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    top = int(token.max()) + 1 if len(token) else 0
    root, alive = np.arange(n), np.ones(n, bool)

    def postings():
        keep = alive[owner]
        order = np.argsort(token[keep], kind="stable")
        return owner[keep][order], np.concatenate(([0], np.cumsum(np.bincount(token[keep], minlength=top))))

    holders, bounds = postings()
    held = n
    for seed in range(n):
        if not alive[seed]:
            continue
        alive[seed] = False
        stack = [seed]
        while stack:
            v = stack.pop()
            own = token[begins[v] : begins[v + 1]]
            lo, many = bounds[own], bounds[own + 1] - bounds[own]
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            met, common = np.unique(holders[at], return_counts=True)
            hit = met[alive[met] & (common * sum(near) >= near[0] * (size[met] + size[v]))]
            alive[hit] = False
            root[hit] = seed
            stack += hit.tolist()
            left = int(alive.sum()) if len(hit) > held // 4 else held
            if left * 2 < held:  # take out what is linked already
                holders, bounds = postings()
                held = left
    return root


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (coarse, part, node, shingles) in order of the first two -> (node, root), where root is another node."""
    now, held = None, {}

    def close():
        nodes = sorted(held)
        root = exact_groups([np.frombuffer(held[k], np.uint64) for k in nodes])
        moved = [(k, nodes[r]) for k, r in zip(nodes, root.tolist(), strict=True) if nodes[r] != k]
        return pa.record_batch([pa.array([m[i] for m in moved], pa.binary()) for i in (0, 1)], names=["node", "root"])

    for batch in batches:
        for coarse, part, node, shingles in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (coarse, part) != now:
                if len(held) > 1:
                    yield close()
                now, held = (coarse, part), {}
            held[node] = shingles
    if len(held) > 1:
        yield close()


def links_between(outer: list[tuple], inner: list[tuple], near: tuple[int, int] = NEAR) -> list[tuple]:
    """Of each outer (node, group, shingles) one near inner node of each other group."""
    sets = [np.frombuffer(x[2], np.uint64) for x in inner]
    size = np.array([len(x) for x in sets], np.int64)
    names: dict = {}
    group = np.array([names.setdefault(x[1], len(names)) for x in inner], np.int64)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], np.repeat(np.arange(len(inner)), size)[order]
    out = []
    for node, own, data in outer:
        these = np.frombuffer(data, np.uint64)
        lo = np.searchsorted(tokens, these)
        many = np.searchsorted(tokens, these, side="right") - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        met, common = np.unique(holder[at], return_counts=True)
        hit = met[(common * sum(near) >= near[0] * (size[met] + len(these))) & (group[met] != names.get(own, -1))]
        _, first = np.unique(group[hit], return_index=True)
        out += [(node, inner[k][0]) for k in hit[first].tolist()]
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (coarse, part, of, outside, node, group, shingles) in order of the first three -> links (node, root) between groups."""
    now, held = None, ([], [])

    def close():
        found = links_between(held[1], held[0]) if held[0] and held[1] else []
        return pa.record_batch([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["node", "root"])

    for batch in batches:
        for coarse, part, of, outside, node, group, shingles in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (coarse, part, of) != now:
                yield close()
                now, held = (coarse, part, of), ([], [])
            held[outside].append((node, group, shingles))
    yield close()


def shingle_sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (coarse, part, node, text) -> (coarse, part, node, shingles): the set's hashes as bytes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, STAGE_BYTES):
                hashes, begins = sets_of(TextBlock(batch.column(3)), shingle)
                held = [hashes[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.record_batch([*batch.columns[:3], pa.array(held, pa.binary())], names=["coarse", "part", "node", "shingles"])

    return rows.mapInArrow(run, "coarse binary, part int, node binary, shingles binary")


def dealt(rows: DataFrame, limit: int, salt: int, about: int | None = None) -> DataFrame:
    """Rows (coarse, node, ...) with the ``part`` of their coarse group, at most about ``limit`` nodes each, and how many ``parts`` there are."""
    sizes = materialize(rows.groupBy("coarse").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / limit).cast("int")), "sizes", about)
    return join_spread(rows, sizes, "coarse").withColumn("part", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("parts")).cast("int"))


def groups_of(parts: DataFrame) -> DataFrame:
    """(node, root) within each part of (coarse, part, node, shingles)."""
    return parts.select("coarse", "part", "node", "shingles").repartition("coarse", "part").sortWithinPartitions("coarse", "part").mapInArrow(settle, "node binary, root binary")


def across(parts: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """More links (node, root) of coarse groups in several parts, so that with ``found`` their components are exact.

    parts: written (coarse, part, parts, node, shingles) of such groups only; found: written links within the parts.
    """
    firsts = materialize(parts.join(found.select("node"), "node", "left_anti").select("coarse", "node", "shingles"), "firsts")
    joined = materialize(found.unionByName(groups_of(dealt(firsts, limit, 2))), "joined")
    roots = connected_components(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("root").alias("group"))
    # sets stay where they are written until it is known who meets whom
    named = materialize(parts.drop("shingles").join(roots, "node", "left").withColumn("group", F.coalesce("group", "node")), "grouped")
    sizes = named.groupBy("coarse", "group").agg(F.count("*").alias("m"))
    largest = materialize(sizes.groupBy("coarse").agg(F.max(F.struct("m", "group"))["group"].alias("largest"), F.sum("m").alias("n")), "largest")
    named = materialize(join_spread(named, largest, "coarse").withColumn("outside", F.col("group") != F.col("largest")), "outside")
    outside = materialize(dealt(named.where("outside").select("coarse", "node"), limit, 3).select("coarse", "node", F.col("part").alias("of"), F.col("parts").alias("many")), "others")
    many = materialize(outside.groupBy("coarse").agg(F.max("many").alias("many"), F.count("*").alias("n")), "many")
    # who is outside meets every part, in the share that it was dealt to; every node meets each of those shares
    these = named.join(outside.select("node", "of"), "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sizes = many.drop("n").join(largest.select("coarse", "n"), "coarse")
    all_nodes = join_spread(named.join(many.select("coarse"), "coarse", "left_semi"), materialize(sizes, "shares"), "coarse").withColumn("of", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    columns = ["coarse", "part", "of", "node", "group"]
    rows = all_nodes.select(*columns, F.lit(0).alias("outside")).unionByName(these.select(*columns, F.lit(1).alias("outside")))
    rows = rows.join(parts.select("node", "shingles"), "node").select("coarse", "part", "of", "outside", "node", "group", "shingles")
    return joined.unionByName(rows.repartition("coarse", "part", "of").sortWithinPartitions("coarse", "part", "of").mapInArrow(compare, "node binary, root binary"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row of each group of near-duplicates; all columns stay."""
    rows = keyed_rows(docs, id_col, text_col)
    seen = materialize(prints(rows), "prints")
    n = seen.count()
    coarse = connected_components(simhash_links(seen, n).distinct(), about=2 * n)
    coarse = materialize(coarse.union(coarse.select(F.col("root").alias("node"), "root").distinct()), "coarse", n)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    nodes = materialize(seen.groupBy("node").agg(best), "nodes", n)
    wanted = materialize(nodes.join(coarse, "node").select(F.col("best.row").alias("row"), "node", F.col("root").alias("coarse")), "wanted", n)
    wanted = materialize(dealt(wanted, limit, 1, n), "dealt", n)
    # both joins of texts are shuffles at every size: the small side grows with the corpus, and a plan that
    # broadcasts it on small inputs says nothing of large ones
    held = shingle_sets(rows.join(wanted.select("row", "coarse", "part", "node").hint("merge"), "row").select("coarse", "part", "node", "text"))
    large = wanted.where("parts > 1").select("node", "coarse", "part", "parts")
    split = large.limit(1).count() > 0
    if split:  # the sets are read again
        held = materialize(held, "sets")
    roots = materialize(groups_of(held), "roots")
    if split:
        sets = held.join(large.select("node", "parts"), "node")
        found = roots.join(large.select("node"), "node", "left_semi")
        more = materialize(across(sets, materialize(found, "found"), limit), "links")
        ends = connected_components(more.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = roots.join(large.select("node"), "node", "left_anti").unionByName(ends)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")
    first = named.groupBy("root").agg(F.min("best").alias("first"))
    # from a written table both sides of the last join are plain shuffles, which Spark splits where a node is hot
    classes = materialize(named.join(first, "root").select("node", F.col("first.row").alias("stays")), "classes", n)
    away = seen.join(classes, "node").where("row <> stays").select(F.col("row").alias("__row")).distinct()
    out = docs.withColumn("__row", row_key(id_col, text_col)).join(away.hint("merge"), "__row", "left_anti")
    if seen.groupBy("row").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["__row"])
    return out.select(*docs.columns)
