"""Empty tables, null and repeated ids, and columns named like the ones used inside, for every stage and operator on documents."""

import pytest

import corpus_pipeline
from vectrail.llm import automaton, capfilters, contamination, jaccard, language, licenses, lines, packing, quality, substrings

SF_DIR = "/root/testdata/sf0.001"
CLASHES = ["n_lines", "n_dropped", "measure", "__id", "own_id", "own_cut", "score", "predicted", "row_key", "key", "id", "label", "bin", "component_id"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def odd(spark):
    texts = ["one two three four five six seven", None, "", "one two three four five six seven", "wörds " * 60, "a\nb\n" + "shared line that is long enough to count " * 2]
    rows = [(None if k % 4 == 3 else k % 5, t) for k, t in enumerate(texts * 3)]
    return spark.createDataFrame([r + tuple(f"{c}{i}" for c in CLASHES) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_pass_clashing_columns_on(spark, name, stage):
    docs = odd(spark)
    given = {tuple(r)[2:] for r in docs.collect()}
    done = stage(spark, docs, SF_DIR)
    rows = done.collect()
    assert rows
    if stage is not corpus_pipeline.pack:
        assert done.columns == docs.columns
        assert {tuple(r)[2:] for r in rows} <= given


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_no_documents(spark, name, stage):
    assert stage(spark, odd(spark).where("false"), SF_DIR).count() == 0


def operators(spark):
    bench = spark.createDataFrame([(1, "five words make one item here"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    yield "language", lambda d: language.predict_languages(d, language.fit_languages(d.withColumn("lang", d.label), key=d.doc_id))
    yield "quality", lambda d: quality.score_quality(d, quality.fit_quality(d, labels))
    yield "substrings", substrings.remove_repeats
    yield "jaccard", jaccard.similar_groups
    yield "packing", packing.pack
    yield "lines", lines.dedup_lines
    yield "contamination", lambda d: contamination.find_leaks(d, bench)
    yield "automaton", automaton.score_texts
    yield "licenses", licenses.scan_licenses


@pytest.mark.parametrize("at", range(9))
def test_operators_on_odd_tables(spark, at):
    name, run = list(operators(spark))[at]
    docs = odd(spark)
    rows = run(docs).count()
    assert name == "contamination" or rows >= docs.count()
    assert run(docs.where("false")).count() == 0


def test_cap_filters_take_string_labels(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.01]), (3, "b", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "a", None)]
    vectors = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.near_vectors(vectors).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}
    assert capfilters.near_vectors(vectors.where("false")).count() == 0
