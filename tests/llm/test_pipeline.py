"""The stages one after the other, each against the one before, and on awkward tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from barloom.llm import decontaminate, quality, secrets
from barloom.llm.common import table
from test_similar import groups, shingles


def kept_by_similarity(rows):
    """Of each group of similarity 0.8 the row with the smallest id, by brute force."""
    rows = sorted(rows)
    root = groups([shingles(t) for _, t in rows])
    return {rows[k][0] for k in range(len(rows)) if root[k] == k}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names and out.schema == docs.schema.__class__(out.schema.fields)
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        if name.startswith("quality"):
            gone = {r.doc_id for r in quality.classify(docs, table(spark, sf, "labels")).where("predicted = 0").collect()}
        elif name.startswith("simhash"):
            # the stage's rule is similarity, not a distance of fingerprints
            gone = before - kept_by_similarity([(r.doc_id, r.text) for r in docs.collect()])
        elif name.startswith("benchmark"):
            gone = {r.doc_id for r in decontaminate.leaks(docs, table(spark, sf, "benchmark")).collect()}
        else:
            gone = set()
        assert after == before - gone
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


AWKWARD = [
    (1, "clean words about rivers and stones, and a token = abcdef123456 in them", "x"), (2, None, "x"), (3, "", None), (None, "words without an id stand here for once", "x"),
    (4, " \n ", "x"), (5, "a " * 5000, "x"), (6, "same text in two rows of one id, word for word again", "x"), (6, "same text in two rows of one id, word for word again", "x"), (6, "another text under the id of two others, not like them at all", "x"),
]


def awkward(spark, rows=AWKWARD):
    # names that the operators use inside
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), j, 1) for i, t, j in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string, node int").repartition(3)


@pytest.mark.parametrize("place", range(5))
def test_awkward_rows(spark, sf, place):
    name, stage = corpus_pipeline.STAGES[place]
    docs = awkward(spark)
    out = stage(spark, docs, sf)
    rows = out.collect()
    if place < 4:
        assert out.columns == docs.columns
    if name.startswith("simhash"):
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 6, 6] and sum(r.doc_id is None for r in rows) == 1
        assert len({r.text for r in rows if r.doc_id == 6}) == 2
    elif not name.startswith("quality"):
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in AWKWARD)
    if name.startswith("secret"):
        of = {r.doc_id: r.text for r in rows if r.doc_id in (1, 2, 3)}
        assert "[SECRET]" in of[1] and "abcdef123456" not in of[1] and of[2] is None and of[3] == ""
    if place < 4:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == docs.columns
    else:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_without_labels_and_benchmark_all_stay(spark, sf):
    docs = awkward(spark)
    assert quality.keep_good(docs, table(spark, sf, "labels").limit(0)).count() == len(AWKWARD)
    assert decontaminate.keep_clean(docs, table(spark, sf, "benchmark").limit(0)).count() == len(AWKWARD)
    assert secrets.redact(docs).count() == len(AWKWARD)


def test_many_benchmark_blocks_give_the_same_leaks(spark, sf):
    docs, benchmark = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    whole = sorted(map(tuple, decontaminate.leaks(docs, benchmark).collect()))
    size = benchmark.selectExpr("sum(octet_length(text)) AS n").first().n
    assert whole == sorted(map(tuple, decontaminate.leaks(docs, benchmark, block_bytes=size // 3 + 1).collect())) and whole
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, benchmark, block_bytes=size // 3 + 1).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {r[0] for r in whole}


def test_registered_queries_have_stable_columns():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [f"op{i}" for i in range(1, 14)] == sorted({n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}, key=lambda n: int(n[2:]))
    assert "pipeline" in names
