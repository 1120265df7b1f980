"""SentencePiece encoding and decoding over a lattice of pieces (operator 7).

The model file gives the pieces; the encoder is this module's. A text is cut where no
piece can cross (before a run of blanks, around line breaks); each such word becomes a
lattice: every substring of bounded length is an edge if it equals a piece. A path of a
merge-order model is its encoding exactly when every two neighbouring pieces stay apart
when encoded by themselves, so the fold over end positions keeps, for each prefix, the one
edge whose piece stays apart from the last piece of the prefix before it. A character
without a piece falls back to its UTF-8 bytes.

``encode`` folds each distinct word once in each worker (a bounded cache).
``lattice_encode`` is the same lattice in relations: substrings exploded, equi-joined to
the piece table, edges grouped by word and folded with the higher-order ``aggregate``.

Defined cases: a null or empty text has no pieces; U+2581 in a text decodes as a blank, as
the model family defines; texts of any length, with or without blanks, are folded whole;
equal rows each appear; a null doc_id is passed on. A very long text is one task's work.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, texts, worker_cache

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
CACHED_WORDS = 300_000
CACHED_PAIRS = 1_000_000
LONGEST_CACHED = 48
_UNITS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTER_UNITS = re.compile(f"{BLANK}*[{_LETTER}]+|{BLANK}*[^{BLANK}\n{_LETTER}]+|{BLANK}+|\n")
_MIXED = re.compile(f"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{BLANK}][{_LETTER}]")


@dataclass(frozen=True)
class Pieces:
    """Piece tables of one model file."""

    rank: dict[str, int]  # of ordinary pieces: lower merges first
    ids: dict[str, int]  # of ordinary pieces that encode to themselves
    byte_ids: tuple[int, ...]
    unknown: int
    surface: tuple[bytes, ...]
    longest: int
    letters_apart: bool  # no piece goes on across the edge of a run of letters, but for leading blanks


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    order = sorted(plain, key=lambda i: (-model.get_score(i), i))
    rank = {names[i]: k for k, i in enumerate(order)}
    byte_ids = [-1] * 256
    surface = [b""] * n
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(names[i][3:5], 16)] = i
            surface[i] = bytes([int(names[i][3:5], 16)])
        elif i in rank or names[i] in rank:
            surface[i] = names[i].replace(BLANK, " ").encode()
    ids = {names[i]: i for i in plain if len(names[i]) == 1 or merge(names[i], rank) == [names[i]]}
    return Pieces(rank, ids, tuple(byte_ids), model.unk_id(), tuple(surface), max(map(len, rank), default=1), not any(map(_MIXED.search, rank)))


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """Merge order applied literally: the best-ranked neighbouring pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Folder(dict):
    """word -> its ids as int32 bytes; missing words are folded on demand, the memory is bounded."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.apart: dict[tuple[str, str], bool] = {}
        self.packed = {p: np.int32(i).tobytes() for p, i in pieces.ids.items()}
        self.prefixes = {p[:n] for p in pieces.ids for n in range(1, len(p) + 1)}
        self.units = _LETTER_UNITS if pieces.letters_apart else _UNITS

    def stays_apart(self, pair: tuple[str, str]) -> bool:
        if len(self.apart) >= CACHED_PAIRS:
            self.apart.clear()
        known = self.apart[pair] = merge(pair[0] + pair[1], self.pieces.rank) == [*pair]
        return known

    def path(self, word: str) -> list[str]:
        """Pieces of one word: the fold over its lattice, from each start over the edges it begins."""
        packed, prefixes, known = self.packed, self.prefixes, self.apart
        n = len(word)
        last = [""] * (n + 1)
        for start in range(n):
            before = last[start]
            for end in range(start + 1, n + 1):
                edge = word[start:end]
                if edge not in prefixes and end > start + 1:
                    break
                if not last[end] and (edge in packed or end == start + 1):
                    pair = (before, edge)
                    if not start or (known[pair] if pair in known else self.stays_apart(pair)):
                        last[end] = edge
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def bytes_of(self, piece: str) -> bytes:
        """Ids of one piece, or of the bytes of a character that has none."""
        raw = [self.pieces.byte_ids[b] for b in piece.encode()]
        return np.array(raw if min(raw) >= 0 else [self.pieces.unknown], np.int32).tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self.packed
        found = b"".join([packed[p] if p in packed else self.bytes_of(p) for p in self.path(word)])
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        units = self.units.findall(BLANK + text.replace(" ", BLANK))
        return np.frombuffer(b"".join(map(self.__getitem__, units)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.pieces.surface.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


def folder(path: str) -> Folder:
    """The worker's Folder for this model file."""
    store = worker_cache()
    key = ("pieces", path)
    if key not in store:
        store[key] = Folder(load(path))
    return store[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip: encoded and decoded again, one row per document."""
    path = path or model_path()

    def make():
        fold = folder(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            ids = [fold.encode(t) for t in rows]
            back = [fold.decode(i.tolist()) for i in ids]
            counts = np.array([len(i) for i in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.record_batch(
                [
                    batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([b == t.encode() for b, t in zip(back, rows, strict=True)]),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

        return work

    return map_slices(texts(docs), make, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: texts from ids; bytes that are no UTF-8 become U+FFFD, a null list an empty text."""
    path = path or model_path()

    def run(batches):
        fold = folder(path)
        for batch in batches:
            out = [fold.decode(i or []).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, start, stop, piece): substrings of bounded length that are pieces, and every single character."""
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.char_length("word")))).alias("stop"))
    edges = spans.select("word", "start", "stop", F.col("word").substr(F.col("start") + 1, F.col("stop") - F.col("start")).alias("piece"))
    single = edges.where("stop = start + 1")
    return edges.where("stop > start + 1").join(F.broadcast(table), "piece", "left_semi").select(single.columns).union(single)


def lattice_encode(words: DataFrame, path: str | None = None) -> DataFrame:
    """(word, pieces) of distinct words by relations alone but for one check of piece pairs.

    The piece table is broadcast: a model file bounds it. Neighbouring edges give the pairs
    whose staying apart decides; the distinct pairs are checked once each. Edges and pairs
    are grouped by word, and a fold over the edges in order of their ends keeps one edge an
    end, as the worker's fold does.
    """
    path = path or model_path()
    spark: SparkSession = words.sparkSession
    pieces = load(path)
    table = spark.createDataFrame([(p,) for p in pieces.ids], "piece string")
    words = words.where("word is not null and word <> ''").select("word").distinct()
    edges = lattice(words, table, pieces.longest)
    left, right = edges.select("word", F.col("piece").alias("a"), F.col("stop").alias("mid")), edges.select("word", F.col("piece").alias("b"), F.col("start").alias("mid"))
    met = left.join(right, ["word", "mid"]).select("word", "a", "b").distinct()

    def check(batches):
        fold = folder(path)
        for batch in batches:
            apart = [fold.stays_apart(pair) for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(apart, pa.bool_()))

    apart = met.select("a", "b").distinct().mapInArrow(check, "a string, b string")
    good = met.join(apart, ["a", "b"]).groupBy("word").agg(F.collect_set(F.struct("a", "b")).alias("good"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("stop", "start", "piece"))).alias("edges"))

    def step(last: Column, edge: Column, known: Column) -> Column:
        """last: piece that ends at each position so far, the empty string at 0."""
        before = F.try_element_at(last, edge["start"])
        fits = before.isNotNull() & ~F.map_contains_key(last, edge["stop"]) & ((edge["start"] == 0) | F.array_contains(known, F.struct(before.alias("a"), edge["piece"].alias("b"))))
        return F.when(fits, F.map_concat(last, F.create_map(edge["stop"], edge["piece"]))).otherwise(last)

    empty = F.create_map(F.lit(0), F.lit("")).cast("map<int,string>")
    known = F.coalesce("good", F.array().cast("array<struct<a:string,b:string>>"))
    folded = grouped.join(good, "word", "left").select("word", F.aggregate("edges", empty, lambda last, e: step(last, e, known)).alias("last"))
    # walk back from the end: at most one piece a character
    walk = F.aggregate(
        F.sequence(F.lit(1), F.char_length("word")), F.struct(F.char_length("word").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, _: F.when(s["at"] > 0, F.struct((s["at"] - F.char_length(F.element_at("last", s["at"]))).alias("at"), F.concat(F.array(F.element_at("last", s["at"])), s["out"]).alias("out"))).otherwise(s),
    )
    return folded.select("word", walk["out"].alias("pieces"))
