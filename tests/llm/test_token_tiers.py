"""Operator 10: the cut into pre-tokens against the library's, and the two tiers."""

import random

import numpy as np
import pyarrow as pa

from barloom.llm import token_counts
from barloom.llm.common import TextBlock


def odd_texts(n=4000):
    rng = random.Random(13)
    signs = ["a", "Z", "é", "日", "ß", "1", "²", "٣", " ", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "'", "'", "'s", "'re", "'ll", "'ve", "'S", "!", "_", "-", "😀", "́", "\x00", "r", "e", "l", "v", "t", "m", "d"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_cut_is_the_librarys():
    own = token_counts.Splitter(token_counts.model_path())
    texts = odd_texts() + ["", " ", "  x", "x  ", "don't 'twas 're '", "a\n 's", "''s", "'s's", "x 's", "'", "' ", "'l"]
    block = TextBlock(pa.array(texts, pa.string()))
    points, offsets, begins, _ = own.split(block)
    ends = np.append(begins[1:], len(points))
    doc = np.searchsorted(offsets, begins, side="right") - 1
    got = [[] for _ in texts]
    for d, a, b in zip(doc.tolist(), begins.tolist(), ends.tolist()):
        got[d].append(token_counts.text_of(points, a, b))
    cut = own.tokenizer.pre_tokenizer.pre_tokenize_str
    for text, mine in zip(texts, got):
        assert mine == [text[a:b] for _, (a, b) in cut(text)], text


def test_length_table_probes_past_collisions():
    keys = np.array([5, 5 + 64, 5 + 128, 6, 63, 127, 0], np.uint64)
    table = token_counts.LengthTable.of(keys, np.arange(1, 8))
    assert table.find(np.append(keys, np.array([5 + 192, 7, 1], np.uint64))).tolist() == [1, 2, 3, 4, 5, 6, 7, 0, 0, 0]
    assert token_counts.LengthTable.of(np.zeros(0, np.uint64), np.zeros(0, np.int64)).find(keys).tolist() == [0] * 7


def test_counts_do_not_depend_on_the_tiers(spark):
    texts = odd_texts(300) + ["the cat <|endoftext|> the  cat", None, "", "the cat sat on the mat " * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokenizer = token_counts.Splitter(token_counts.model_path()).tokenizer
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for table in (0, 3, 50_000):
        rows = token_counts.count(frame, table=table).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == want
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)
