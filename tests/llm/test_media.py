"""Operator 2: what ``compress`` writes holds every means of the format and is read back."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from barloom.llm import webp


def rows_of(text):
    return np.frombuffer(webp.payload_of(text.encode()), np.uint8).reshape(-1, 64, 3)[: webp.STRIP_ROWS]


def images():
    rng, dice = np.random.default_rng(6), random.Random(6)
    ramp = np.cumsum(rng.integers(0, 5, (40, 64, 3)), axis=1)
    grey = rng.integers(0, 200, (30, 64, 1))
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randrange(2, 9))) for _ in range(60)]
    return {
        "noise": rng.integers(0, 256, (20, 64, 3)), "one": np.full((3, 64, 3), 32), "ramp": ramp % 256, "rows": np.repeat(rng.integers(0, 256, (1, 64, 3)), 50, axis=0),
        "drift": np.cumsum(rng.integers(-2, 3, (50, 64, 3)), axis=0) % 256, "tinted": np.concatenate([grey, grey + rng.integers(0, 3, grey.shape), grey // 2], axis=2) % 256,
        "few": rng.integers(0, 256, (9, 3))[rng.integers(0, 9, (40, 64))], "two": rng.integers(0, 256, (2, 3))[rng.integers(0, 2, (40, 64))], "narrow": rng.integers(0, 256, (1, 64, 3)),
        "words": rows_of(" ".join(dice.choice(words) for _ in range(3000))), "twice": rows_of("some line of words, of a length by three\n" * 900), "mixed": rows_of("".join(chr(dice.randrange(32, 900)) for _ in range(4000))),
    }


def used(data, monkeypatch):
    """The means that a file's decoding calls on."""
    seen = set()

    with monkeypatch.context() as m:
        for name, what in (("undo_predictor", "predictor"), ("cross_colour", "cross"), ("undo_palette", "palette"), ("_number_at", "number"), ("_cache_place", "cache")):
            plain = getattr(webp, name)
            m.setattr(webp, name, lambda *a, _p=plain, _w=what: (seen.add(_w) if _w != "number" or len(a[1]) else None, _p(*a))[1])
        pixels = webp.decode(data)
    return pixels, seen


def test_every_means_is_written_and_read(monkeypatch):
    every = set()
    for name, image in images().items():
        image = image.astype(np.uint8)
        pixels, seen = used(webp.compress(image), monkeypatch)
        assert (pixels[..., 1:] == image).all() and (pixels[..., 0] == 255).all(), name
        every |= seen
    assert every == {"predictor", "cross", "palette", "number", "cache"}


def test_documents_are_read_back(sf):
    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    size = stored = 0
    for text in texts:
        payload = webp.payload_of((text or "").encode())
        media = webp.write_strips(payload)
        assert webp.read_strips(media)[..., 1:].tobytes() == payload
        size, stored = size + len(payload), stored + len(media)
    assert stored < 0.6 * size


def test_files_side_by_side_are_those_written_alone(monkeypatch):
    """Many short texts share each step of the coding, and each file stays its own: of any transform, size and number of strips."""
    dice = random.Random(8)
    given = [im.astype(np.uint8).tobytes() for im in images().values()]
    given += [webp.payload_of(" ".join(dice.choice(["so", "it", "goes", "on", "\u00e9t\u00e9"]) for _ in range(dice.randrange(60))).encode()) for _ in range(250)]
    given += [webp.payload_of(b""), webp.payload_of(b"x" * 192 * 600), webp.payload_of(bytes(dice.randrange(256) for _ in range(192 * 300)))]
    dice.shuffle(given)
    alone = [webp.write_strips(payload) for payload in given]
    assert webp.write_all(given) == alone and webp.write_all([]) == []
    for payload, media in zip(given, alone, strict=True):
        assert webp.read_strips(media)[..., 1:].tobytes() == payload
    plain, calls = webp.matches, []
    monkeypatch.setattr(webp, "matches", lambda *a: (calls.append(1), plain(*a))[1])
    webp.write_all([webp.payload_of(b"a short text of its own: %d" % k) for k in range(512)])
    assert len(calls) <= 2 + 512 * 64 // webp.TOGETHER  # not one for each text
    with monkeypatch.context() as m:
        m.setattr(webp, "TOGETHER", 1)
        assert webp.write_all(given) == alone


@pytest.mark.parametrize("most", [15, 7])
def test_code_lengths_fill_the_code_space(most):
    rng = np.random.default_rng(3)
    for n in (2, 3, 19, 100):
        counts = np.floor(rng.pareto(0.4, n) * 3).astype(np.int64)
        if n > 1 << most:
            continue
        lengths = webp.lengths_of(counts, most)
        some = lengths[lengths > 0]
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= most
        if len(some) > 1:
            assert sum(2.0**-x for x in some.tolist()) == 1


def test_cut_streams_are_refused():
    good = webp.compress(images()["words"].astype(np.uint8))
    for keep in (30, 100, len(good) // 2, len(good) - 40):
        body = good[20:keep]
        with pytest.raises(ValueError):
            webp.decode(good[:16] + len(body).to_bytes(4, "little") + body)


def test_reading_takes_few_calls():
    """Prefix codes are read from one number each, short distances known by width: calls for a short file, counted."""
    import cProfile
    import pstats

    dice = random.Random(2)
    words = ["".join(dice.choice("abcdefghij") for _ in range(dice.randrange(2, 9))) for _ in range(90)]
    files = [webp.write_strips(webp.payload_of(" ".join(dice.choice(words) for _ in range(300)).encode())) for _ in range(20)]
    webp.read_strips(files[0])
    profile = cProfile.Profile()
    profile.enable()
    for media in files:
        webp.read_strips(media)
    profile.disable()
    calls = {f"{name}": n for (_, _, name), (_, n, *_) in pstats.Stats(profile).stats.items()}
    assert calls["sixteen"] == calls["_read_pixels"] and calls["<method 'append' of 'list' objects>"] > 0
    assert calls["read_prefix"] == 5 * calls["_read_pixels"]
