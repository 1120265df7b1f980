"""Secret scan (operator 3): keyword prefilter, anchored patterns, checksums.

One Aho-Corasick automaton runs over the lower-cased bytes of many documents at a time.
Only where it reports a keyword is a pattern tried, anchored at that byte. Runs of hex
digits have no keyword; any run of 24 holds two neighbouring multiples of 12, so looking
at every twelfth byte finds all places where a run can be.

Kinds: assign, access and hex as their patterns say; ``github`` and ``npm`` tokens are
reported only if their last six characters are the base-62 CRC-32 of the body.

Defined cases: a null text counts as empty; an empty text gives zero counts and empty
spans; equal rows each appear; a null doc_id is passed on; offsets are code points, the
end exclusive. A very long text is one slice in one task. Other columns of the input are
ignored (or kept, by ``redact``), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, TextBlock, _byte_table, map_slices, slices, texts

KINDS = ("assign", "access", "hex", "github", "npm")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {
    0: ("password", "passwd", "secret", "token", "api_key", "apikey"),
    1: ("akia",),
    3: ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    4: ("npm_",),
}
_HEX_BYTES = _byte_table(b"0123456789abcdef")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of the body in six base-62 digits, the way checked tokens end."""
    rest, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        out.append(_DIGITS[digit])
    return bytes(out[::-1])


def _accept(kind: int, found: re.Match[bytes]) -> bool:
    if kind == 0:
        return len(found[2]) >= LEAST_VALUE
    if kind == 1:
        return found.end() - found.start() >= LEAST_ACCESS
    return base62_crc(found[1]) == found[2]


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            out.add_word(word, (len(word) - 1, kind))
    out.make_automaton()
    return out


def spans_of(block: TextBlock, machine) -> list[list[tuple[int, int, int]]]:
    """For each document its spans (start, kind, end) in code points, in that order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(block.n)]
    data, offsets = block.bytes.tobytes(), block.offsets
    patterns = {0: _ASSIGN, 1: _ACCESS, 3: _GITHUB, 4: _NPM}
    found: list[tuple[int, int, int]] = []
    hits: dict[int, list[int]] = {k: [] for k in patterns}
    for end, (back, kind) in machine.iter(data.translate(_LOWER).decode("latin-1")):
        hits[kind].append(end - back)
    for kind, at in hits.items():
        if not at:
            continue
        at = np.unique(at)
        limit = offsets[block.owner(at) + 1]
        past, match = 0, patterns[kind].match
        for start, stop in zip(at.tolist(), limit.tolist(), strict=True):
            if start >= past and (m := match(data, start, stop)):
                past = m.end()
                if _accept(kind, m):
                    found.append((start, kind, past))
    twelfth = _HEX_BYTES[block.bytes[::12]]
    near = np.flatnonzero(twelfth[:-1] & twelfth[1:]) * 12
    if len(near):
        begin, limit = offsets[block.owner(near)], offsets[block.owner(near) + 1]
        past = 0
        for at, low, stop in zip(near.tolist(), begin.tolist(), limit.tolist(), strict=True):
            if at < past:
                continue
            low = max(low, past)
            while at > low and _HEX_BYTES[data[at - 1]]:
                at -= 1
            past = _HEX.match(data, at, stop).end()
            if past - at >= LEAST_HEX:
                found.append((at, 2, past))
    if found:
        starts, kinds, ends = (np.array(x, np.int64) for x in zip(*found, strict=True))
        chars = np.concatenate(([0], np.cumsum((block.bytes & 0xC0) != 0x80)))
        doc = block.owner(starts)
        base = chars[offsets[doc]]
        for i in np.lexsort((kinds, starts)).tolist():
            out[doc[i]].append((int(chars[starts[i]] - base[i]), int(kinds[i]), int(chars[ends[i]] - base[i])))
    return out


def _joined(spans: list[tuple[int, int, int]], kinds: range | tuple[int, ...]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k in kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked: one row per document."""

    def make():
        machine = automaton()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = spans_of(TextBlock(batch.column(1)), machine)
            count = [np.array([sum(k == kind for _, k, _ in r) for r in rows], np.int64) for kind in range(len(KINDS))]
            empty = hashlib.sha256(b"").hexdigest()
            base = [hashlib.sha256(_joined(r, (0, 1, 2)).encode()).hexdigest() if r else empty for r in rows]
            spans = [_joined(r, range(len(KINDS))) for r in rows]
            return pa.record_batch(
                [batch.column(0), pa.array(count[0]), pa.array(count[1]), pa.array(count[2]), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(count[3] + count[4])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"],
            )

        return work

    return map_slices(texts(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans as one) and, if there, n_chars recounted."""
    kept = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, past = [], 0
        for start, _, end in spans:
            if start >= past:
                parts += [text[past:start], mark]
            past = max(past, end)
        return "".join([*parts, text[past:]])

    def run(batches):
        machine = automaton()
        for whole in batches:
            for batch in slices(whole, STAGE_BYTES, text_col):
                at = batch.schema.get_field_index(text_col)
                column = batch.column(at)
                rows = spans_of(TextBlock(column), machine)
                if any(rows):
                    new = [cleaned(t, r) if r else t for t, r in zip(column.to_pylist(), rows, strict=True)]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(new, column.type))
                yield batch

    out = kept.mapInArrow(run, kept.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
