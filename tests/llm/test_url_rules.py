"""Operator 1: rules against brute force where tokens go together, long urls, and small tables."""

import itertools
import random
import re
import time

from barloom.llm import url_rules


def tables(spark, rows):
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(rows)], "page_id long, url string, item string")
    return pages, spark.createDataFrame([(i, int(not b), 0) for i, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")


def brute_force(rows, support, confidence, lift, floor):
    sets = [frozenset(re.findall("[a-z0-9]+", u.lower())) for u, _ in rows]
    base = sum(b for _, b in rows) / len(rows)
    least = max(floor, support * len(rows))
    frequent = [t for t in sorted({t for s in sets for t in s}) if sum(b and t in s for s, (_, b) in zip(sets, rows)) >= least]
    found = set()
    for k in range(1, len(frequent) + 1):
        for combo in itertools.combinations(frequent, k):
            hit = [b for s, (_, b) in zip(sets, rows) if s >= set(combo)]
            if hit and sum(hit) >= least and sum(hit) / len(hit) >= confidence and sum(hit) / len(hit) / base >= lift:
                found.add(frozenset(combo))
    return {r for r in found if not any(o < r for o in found)}


def test_tokens_that_go_together(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = rng.sample(["red", "blue", "pill", "news", "shop"], 3)
        if "pill" in words:
            words += ["buy", "now"]  # always with pill: one item
        rows.append((f"http://x{i}.info/{'/'.join(words)}", {"pill", "red"} <= set(words) and rng.random() < 0.9 or rng.random() < 0.03))
    want = brute_force(rows, 0.05, 0.6, 1.5, 5)
    assert any(len(r) > 1 for r in want)
    pages, labels = tables(spark, rows)
    test = pages.union(spark.createDataFrame([(900, "http://q.info/red/now", ""), (901, "http://q.info/red", ""), (902, None, ""), (903, "buy RED", "")], pages.schema))
    got = {r.page_id: r.verdict for r in url_rules.judge(test, labels, min_support=0.05).collect()}
    for i, url in [(r.page_id, r.url) for r in test.collect()]:
        words = set(re.findall("[a-z0-9]+", (url or "").lower()))
        assert (got[i] == "block") == any(r <= words for r in want), url
    assert got[900] == got[903] == "block" and got[901] == got[902] == "allow"


def test_long_repeated_url_ends(spark):
    long = "http://bad.info/" + "-".join(f"t{i}" for i in range(40))
    rows = [(long, True)] * 10 + [(f"http://fine{i}.info/{i % 7}", False) for i in range(90)]
    began = time.time()
    pages, labels = tables(spark, rows)
    got = url_rules.judge(pages, labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(10))
    assert time.time() - began < 60


def test_no_rule_by_chance(spark):
    rng = random.Random(1)
    rows = [(f"http://h{i}.info/w{rng.randrange(30)}", i % 12 == 0) for i in range(98)]
    pages, labels = tables(spark, rows)
    assert {r.verdict for r in url_rules.judge(pages, labels).collect()} == {"allow"}
    assert {r.verdict for r in url_rules.judge(pages, labels.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_repeated_labels_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "http://a.info/x"), (None, "http://a.info/x"), (1, "http://b.info/y")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert len(url_rules.judge(pages, labels).collect()) == 3
