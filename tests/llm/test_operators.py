"""Each operator against a brute-force version, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("barloom.llm.queries")

from barloom.llm import class_model, decontaminate, pieces, quality, secrets, simhash, suffix_dedup, token_counts, url_rules, webp
from barloom.llm.common import TextBlock
from barloom.llm.components import connected_components

WORDS = "the of and secret token price market bar volume open close river stone light green".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward():
    """(doc_id, text, junk): nulls, empties, repeats, long and odd texts, and a column that clashes with inner names."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randrange(1, 60)) + rng.choice(["", ".\nThe end", "  \t x", " É é ß 日本"])) for i in range(60)]
    base = sentence(rng, 80)
    rows += [(100 + i, base) for i in range(6)] + [(110 + i, base + f" tail{i}") for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two three four"), (205, "a " * 3000), (206, base.upper()), (207, "x" * 1500), (208, "é" * 300)]
    rows += [(60, "repeated id"), (60, "repeated id")]
    return [(i, t, "junk") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), "doc_id long, text string, uid string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


# ---- operator 1


def test_url_parts_and_listed_rules(spark):
    urls = [None, "no/en/", "HTTP://A.Example.NET/en/x?y#z", "a://b://c", "x://net", "x://net/", "x://Fr.ORG/fr/", "x://example.com/de/\nq#", "://", "x://host#/a", "x://notnet/", "x://m.example.com/de/?x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in url_rules.judge(pages, labels).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(len(h + p), h + p, v) for h, p, v in url_rules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[1], want[2])


def test_mined_rules_are_those_of_brute_force(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(240):
        words = rng.sample(["casino", "win", "news", "daily", "shop", "blog"], 3)
        bad = {"casino", "win"} <= set(words) or rng.random() < 0.05
        rows.append((i, f"http://{'-'.join(words)}.example.info/p{i}"))
        marks.append((i, 0 if bad else 1, 0))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    sets = [frozenset(re.findall("[a-z0-9]+", u.lower())) for _, u in rows]
    bad = [q == 0 for _, q, _ in marks]
    base, found = sum(bad) / len(bad), set()
    items = sorted({t for s in sets for t in s})
    frequent = [t for t in items if sum(t in s for s in sets) >= 0.05 * len(sets)]
    for k in range(1, 6):
        for combo in itertools.combinations(frequent, k):
            hit = [b for s, b in zip(sets, bad) if s >= set(combo)]
            if hit and sum(hit) >= 0.05 * len(sets) and sum(hit) / len(hit) >= 0.6 and sum(hit) / len(hit) / base >= 1.5:
                found.add(frozenset(combo))
    found = {r for r in found if not any(o < r for o in found)}
    rules, items = url_rules.mine(pages, labels, 0.05, 0.6, 1.5)
    of = collections.defaultdict(list)
    for r in items.collect():
        of[r.item].append(r.token)
    # a rule asks for any token of each of its items
    assert {frozenset(c) for r in rules.collect() for c in itertools.product(*(of[i] for i in r["items"]))} == found and found
    for r in url_rules.judge(pages, labels, min_support=0.05, min_confidence=0.6, min_lift=1.5).collect():
        assert (r.verdict == "block") == any(sets[r.page_id] >= rule for rule in found)


def test_url_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    plan = url_rules.judge(pages, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- operator 2


@pytest.mark.parametrize("size", [(1, 1), (7, 5), (33, 12)])
@pytest.mark.parametrize("colours", [1, 2, 4, 13, 200])
def test_webp_round_trips_with_every_means(size, colours):
    rng = np.random.default_rng(colours)
    w, h = size
    image = rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (h, w))]
    blocks = (-(-h >> 2), -(-w >> 2))
    modes, elements, groups = rng.integers(0, 14, blocks), rng.integers(0, 256, (*blocks, 4), dtype=np.uint8), rng.integers(0, 3, blocks)
    for steps in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0)):
        for cache in (0, 4):
            data = webp.encode(image, steps, modes, elements, 2, cache, True, groups if cache and 3 not in steps else None)
            assert (webp.decode(data) == image).all()


def test_every_predictor_inverts():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (9, 10, 4), dtype=np.uint8)
    for mode in range(14):
        modes = np.full((3, 3), mode)
        assert (webp.decode(webp.encode(image, (0,), modes)) == image).all()


def test_damaged_webp_is_refused():
    good = webp.compress(np.zeros((2, 64, 3), np.uint8) + np.arange(64, dtype=np.uint8)[None, :, None])
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + good[4:])
    with pytest.raises(ValueError):
        webp.decode(good[:16] + (8).to_bytes(4, "little") + good[20:28])


def test_media_rows(docs, empty):
    rows = by_id(webp.store(docs, keep_media=True).collect())
    for i, text, _ in awkward():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = next(x for x in rows[i] if x.payload_sha256 == hashlib.sha256(payload).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert len({x.feature for i in range(100, 106) for x in rows[i]}) == 1
    assert webp.store(empty).count() == 0


def test_long_text_takes_several_strips():
    payload = webp.payload_of(bytes(range(256)) * 8000)
    media = webp.write_strips(payload)
    assert media.count(b"WEBPVP8L") == -(-len(payload) // (192 * webp.STRIP_ROWS)) > 2 and webp.read_strips(media)[..., 1:].tobytes() == payload


# ---- operator 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts():
    rng = random.Random(11)
    bits = ["password = abcdef1", "TOKEN:'x'", "token=token=abcdefgh", "api_key: \"Zz9/+=-.", "apikey=short", "AKIA" + "A1B2" * 4, "AKIAAKIA" + "Q" * 14, "f" * 23, "0123456789abcdef" * 2, "deadbeef" * 3 + "g", "é", " ", "\n", "passwd  =  'abcdefgh'", "ſecret=abcdefgh", "secretsecret=abcdefgh"]
    return [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(1, 14)))) for i in range(200)]


def test_secret_spans_match_brute_force(spark, docs, empty):
    body = "AbCdEfGhIjKlMnOpQrStUvWxYz0123"
    good, bad = "ghp_" + body + secrets.base62_crc(body.encode()).decode(), "ghp_" + body + "000000"
    rows = secret_texts() + [(1000, f"key {good} and {bad}"), (1001, None), (1002, "")]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        spans = base_spans(text or "")
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, want.split(","))) <= set(out[i].spans.split(","))
    assert out[1000].spans == f"github:4:{4 + len(good)}" and out[1000].n_checked == 1
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty).count() == 0


def test_redaction_takes_secrets_out(spark):
    rows = [(i, t, len(t)) for i, t in secret_texts()] + [(900, None, None), (901, "nothing here", 12)]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert len(out) == len(rows)
    for i, text, _ in rows:
        if not base_spans(text or ""):
            assert out[i].text == text
        else:
            assert "[SECRET]" in out[i].text and out[i].n_chars == len(out[i].text)


# ---- operator 4


def test_base_scores_and_clusters(spark, docs, empty):
    rows = [(r.doc_id, (r.text or "").translate(LOW)) for r in docs.collect()]
    counts = collections.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*SPLIT.findall(text), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, text in rows:
        tokens = [*SPLIT.findall(text), None]
        want[i].append((len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    got = class_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert any((r.n_tokens, r.n_known) == w[:2] and abs(r.base_score - w[2]) < 1e-6 for w in want[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0
    assert class_model.score(empty).count() == 0


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    truth = np.arange(12) % 2  # words of two kinds that alternate
    counts = np.zeros((13, 13))
    for a in range(12):
        for b in range(12):
            counts[a, b] = rng.poisson(50 if truth[a] != truth[b] else 1)
    found = class_model.exchange(counts, 12, classes=2)[:12]
    assert len({tuple(found[truth == k]) for k in (0, 1)}) == 2 and all(len(set(found[truth == k])) == 1 for k in (0, 1))


def test_transitions_help(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["red", "blue", "old"]) + " " + rng.choice(["cat", "dog", "hen"]) for _ in range(30))
    rows = class_model.score(spark.createDataFrame([(i, text()) for i in range(120)], "doc_id long, text string")).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


# ---- operator 5


def test_quality_learns_and_keeps(spark):
    rng = random.Random(9)
    good = lambda: "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    bad = lambda: "\n".join(" | ".join(rng.choice(WORDS) + "%%" for _ in range(8)) for _ in range(rng.randrange(1, 6)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(240)] + [(1000, None), (1001, ""), (1002, "\n\n"), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.predicted == int(r.doc_id % 4 != 0) for r in out if r.doc_id is not None and r.doc_id < 240)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in out if r.predicted}
    neutral = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in neutral} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    per_doc = np.array([1, 4, 3])
    unary, move = rng.normal(size=8), rng.normal(size=(2, 2))
    ahead, back = quality.messages(unary, move, per_doc)
    got, at = quality.sigmoid(ahead + back), 0
    for n in per_doc:
        mass = np.zeros((n, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            weight = math.exp(sum(unary[at + t] * s for t, s in enumerate(states)) + sum(move[a, b] for a, b in zip(states, states[1:])))
            for t, s in enumerate(states):
                mass[t, s] += weight
        assert np.allclose(got[at : at + n], mass[:, 1] / mass.sum(axis=1))
        at += n


# ---- operator 6


def plain_tokens(text):
    return [t for t in (re.sub(r"[^0-9A-Za-z\u0080-\U0010ffff]", "", w).lower() for w in SPLIT.findall(text)) if t]


def test_leaks_match_brute_force(spark, docs, empty):
    rng = random.Random(21)
    items = [(i, sentence(rng, n)) for i, n in enumerate((30, 25, 40, 13, 7, 3))] + [(90, None), (91, ""), (92, "...")]
    texts = []
    for i in range(80):
        item = rng.choice(items[:6])[1].split()
        kind = i % 4
        if kind == 1:
            item = [w if k % 9 else "changed" for k, w in enumerate(item)]
        if kind == 2:
            item = [w.upper() + "," for w in item[: max(1, len(item) // 2)]]
        body = item if kind < 3 else []
        texts.append((i, sentence(rng, rng.randrange(20)) + " " + " ".join(body) + " " + sentence(rng, rng.randrange(20))))
    texts += [(500, None), (501, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    want = set()
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = plain_tokens(text or ""), plain_tokens(item or "")
        for shift in range(-len(b) + 1, len(a)):
            lo, hi = max(0, -shift), min(len(b), len(a) - shift)
            equal = [a[k + shift] == b[k] for k in range(lo, hi)]
            best = max(((y - x, sum(equal[x:y])) for x in range(len(equal)) for y in range(x + 1, len(equal) + 1) if sum(equal[x:y]) >= 0.8 * (y - x) - 1e-9), default=(0, 0))
            if best[0] >= 13 or (len(b) >= 5 and best[0] == len(b) == best[1]):
                want.add((d, i))
    assert set(got) == want and want
    assert decontaminate.leaks(docs, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    clean = {r.doc_id for r in decontaminate.keep_clean(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _ in want}


# ---- operator 7


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def piece_texts():
    rng = random.Random(13)
    odd = ["", " ", "  a  b\n\nc\td ", "ﬁ Å x　y", "🎉🎉  \n x", "a" * 200, "    def f(x):\n        return 1", "12345 6.7", "é" * 20, "<s> </s> <0x0A>", "\x00\x01 \r\n", "今天天气很好 русский العربية", "http://www.example.com/foo_bar?x=1&y=2"]
    return odd + ["".join(rng.choice("abetin THhe.\n,1é") for _ in range(rng.randrange(200))) for _ in range(100)]


def test_pieces_are_the_librarys(spark, docs, empty):
    model = library()
    rows = list(enumerate(piece_texts())) + [(999, None), (998, "a▁b")]
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: r for r in encoded.collect()}
    for i, text in rows:
        assert out[i].ids == model.encode(text or ""), text
        assert out[i].n_tokens == len(out[i].ids) and out[i].round_trip == (text is None or "▁" not in text)
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").replace("▁", " ").encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert pieces.encode(docs).count() == docs.count() and pieces.encode(empty).count() == 0


def test_relational_lattice_gives_the_same_pieces(spark):
    words = [f"▁{w}" for w in ("the", "market", "erblionthe", "unbelievably", "aaaa", "naïve", "x")] + ["Thand", "...", "ing"]
    fold = pieces.folder(pieces.model_path())
    got = {r.word: r.pieces for r in pieces.lattice_encode(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: fold.path(w) for w in words}


# ---- operator 8


def repeats(rows, size):
    raw = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(b[p : p + size] for _, b in raw for p in range(len(b) - size + 1))
    out = collections.defaultdict(list)
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if counts[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i].append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [4000, 8])
def test_repeats_match_brute_force(spark, split):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30, 160))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(7)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 300), (1003, "x" * 500), (1004, "x" * 500), (1005, "é" * 90), (1006, parts[0] * 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats(rows, 64)
    got = suffix_dedup.remove_repeats(frame, 64, 24, split, 5000, keep_bytes=True).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_at_production_size(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = repeats(rows, 400)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id] for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_ranks_and_common_prefixes():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(700))
    rank = suffix_dedup.refine(np.frombuffer(data, np.uint8), 32)
    padded = data + bytes(64)
    order = sorted(range(len(data)), key=lambda i: padded[i : i + 32])
    assert [rank[i] for i in order] == sorted(rank[: len(data)])
    assert all((rank[i] == rank[j]) == (padded[i : i + 32] == padded[j : j + 32]) for i, j in zip(order, order[1:]))
    array = sorted(range(len(data)), key=lambda i: data[i:])
    common = suffix_dedup.kasai(data, array)
    for k in range(1, len(array)):
        a, b = data[array[k - 1] :], data[array[k] :]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0a", b"abc"])
def test_chained_common_prefixes_and_window_classes(letters):
    rng = random.Random(letters)
    for n in (1, 2, 30, 300):
        data = bytes(rng.choice(letters) for _ in range(n)) * rng.choice([1, 3])
        array = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8))
        assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        whole = suffix_dedup.kasai(data, array)
        for most, chain in ((1, 256), (20, 7), (20, 256), (400, 64)):
            assert suffix_dedup.kasai(data, array, most, chain).tolist() == np.minimum(whole, most).tolist()
        size = 5
        pieces_of = [p for p in dict.fromkeys(data[i : i + size + rng.randrange(9)] for i in range(0, len(data), 4)) if len(p) >= size]
        if not pieces_of:
            continue
        at, kinds, count = suffix_dedup.repeated_windows(pieces_of, np.array([len(p) - size + 1 for p in pieces_of]), size)
        joined = b"".join(pieces_of)
        windows = [joined[i : i + size] for i in at.tolist()]
        often = collections.Counter(windows)
        assert count.tolist() == [often[w] for w in windows]
        assert len(set(zip(windows, kinds.tolist()))) == len(often) == len(set(kinds.tolist()))


# ---- operator 9


def simhash_of(text):
    import xxhash

    words = SPLIT.findall((text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash_components(docs, empty, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [simhash_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    want = collections.Counter((i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(i for k, (i, _) in enumerate(rows) if least[find(k)] == i)


def test_bit_sliced_distances():
    rng = np.random.default_rng(8)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    values[50:90] = values[0] ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64))
    for radius in (0, 1, 3, 4, 9):
        for q in values[:60:7].tolist():
            found = simhash.lanes_of(simhash.within(simhash.bit_planes(values), q, radius), len(values))
            assert found.tolist() == np.flatnonzero(np.bitwise_count(values ^ np.uint64(q)) <= radius).tolist()
    a, b = simhash.forest(values, 4)
    assert len(a) < len(values) and (np.bitwise_count(a ^ b) <= 4).all()


def test_bands_catch_every_pair_within_the_radius():
    rng = random.Random(2)
    masks = simhash.band_masks(6, 4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (100, 102), (-5, 7), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: -5 for i in range(41)} | {101: 100, 102: 100}  # roots themselves are not listed


# ---- operator 10


def test_token_counts_are_the_librarys(spark, docs, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.model_path())
    texts = piece_texts() + ["a<|endoftext|>b <|endoftext|>", " \x1c x  y  \n\n z's DON'T it'll", "١٢٣ abc½ ²", "\x85a​ b", "x  ", "word " * 600, None]
    out = {r.doc_id: r for r in token_counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        n = len(model.encode(text or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((text or "").encode()), n, n > 512), text
    assert token_counts.count(docs).count() == docs.count() and token_counts.count(empty).count() == 0


# ---- shared


def test_runs_never_cross_documents():
    block = TextBlock(pa.array(["ab", "", None, "cd e", " "]))
    starts, ends = block.runs(block.bytes != 32)
    assert [(a, b) for a, b in zip(starts.tolist(), ends.tolist())] == [(0, 2), (2, 4), (5, 6)] and block.owner(starts).tolist() == [0, 3, 3]
