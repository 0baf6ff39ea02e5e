import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.functions import chunk as c
from vectrail.operators import corpora


def greedy(pieces, cost, budget):
    """The definition, spelled out piece by piece."""
    out, used = [], 0
    for piece in pieces:
        price = cost(piece)
        if out and used + price <= budget:
            out[-1].append(piece)
            used += price
        else:
            out.append([piece])
            used = price
    return [" ".join(chunk) for chunk in out]


def word_cost(word):
    return (len(word) + 1) // 4


def of_words(text, budget):
    return greedy(text.split(), word_cost, budget)


def of_paragraphs(text, budget):
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    return greedy(paragraphs, lambda p: max(1, (len(p) + 1) // 4), budget)


def chunked(spark, texts, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    return [r.c for r in df.select("i", column(F.col("text")).alias("c")).orderBy("i").collect()]


rng = random.Random(7)
TEXTS = [
    "", "   ", "a", "ab cd", " abc  def ", "a " * 400, "x" * 700 + " y z " + "w" * 2000,
    "😀😀😀 😀 😀😀😀😀 " * 40, "non breaking and\x1cseparators here", "x" * 3000,
    ("abc " * 5 + "d" * 520 + " e ") * 20,
    " ".join("q" * rng.randint(1, 30) for _ in range(2500)),
    " ".join("q" * rng.choice([1, 2, 3, 6, 7, 8, 10, 11]) for _ in range(1500)),
    "word " * 3000,
    "word " * 60000,
    " ".join("q" * rng.choice([1, 5, 30, 250, 255, 259, 270, 511, 515, 1023, 1027]) for _ in range(600)),
    "one\n\ntwo\n\n\n\nthree " + "long " * 50 + "\n\n" + "end",
]


@pytest.mark.parametrize("budget", [1, 2, 3, 5, 32, 63, 64, 65, 127, 128, 129, 191, 256, 513, 2560, 20480, 20481])
def test_word_chunks(spark, budget):
    want = [of_words(t, budget) for t in TEXTS]
    assert chunked(spark, TEXTS, lambda x: c.word_chunks(x, budget)) == want
    assert chunked(spark, TEXTS, lambda x: c.pack_words(x, budget)) == want


@pytest.mark.parametrize("budget", [1, 4, 64, 1000])
def test_paragraph_chunks(spark, budget):
    want = [of_paragraphs(t, budget) for t in TEXTS]
    assert chunked(spark, TEXTS, lambda x: c.paragraph_chunks(x, budget)) == want


@pytest.mark.parametrize("budget", [1, 7, 128])
def test_fixed_chunks(spark, budget):
    width = budget * 4
    want = [[t[i : i + width] for i in range(0, len(t), width)] for t in TEXTS]
    assert chunked(spark, TEXTS, lambda x: c.fixed_chunks(x, budget)) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet="ab \n\t é😀", max_size=300), min_size=20, max_size=40),
    budget=st.integers(1, 12),
)
def test_word_chunks_of_arbitrary_text(spark, texts, budget):
    want = [of_words(t, budget) for t in texts]
    assert chunked(spark, texts, lambda x: c.word_chunks(x, budget)) == want


def test_chunks_joined_give_back_the_words(spark):
    for text, chunks in zip(TEXTS, chunked(spark, TEXTS, lambda x: c.word_chunks(x, 128))):
        assert " ".join(chunks) == " ".join(text.split())


def test_null_and_useless_budgets_give_nothing(spark):
    df = spark.createDataFrame([(None,)], "text string")
    for function in (c.word_chunks, c.paragraph_chunks, c.fixed_chunks):
        assert df.select(function(F.col("text"), 5)).first()[0] == []
        assert df.select(function(F.lit("some text"), 0)).first()[0] == []


def test_budgets_must_be_positive(spark):
    df = spark.createDataFrame([("t", "a", 1)], "title string, article string, doc_id int")
    for budget in (0, -100):
        with pytest.raises(ValueError):
            corpora.news_chunks(df, budget, "doc_id")
    with pytest.raises(ValueError):
        corpora.sample_documents(df, 0, "doc_id")
    with pytest.raises(ValueError):
        corpora.dataset_chunks({"unknown": df}, 128)


def test_encyclopedia_articles_part_only_after_the_title(spark):
    text = "\n\n".join(["paragraph " * 20] * 10)
    df = spark.createDataFrame([(1, "Title", text)], "doc_id int, title string, text string")
    chunks = [r.chunk for r in corpora.article_chunks(df, 16, "doc_id").orderBy("chunk_index").collect()]
    assert len(chunks) == 2 and chunks[0] == "Title"


def test_sample_counts_documents_before_empty_ones_fall_out(spark):
    rows = [(1, "", ""), (2, "t", "b"), (3, "u", "c")]
    df = spark.createDataFrame(rows, "doc_id int, title string, abstract string")
    sample = corpora.paper_chunks(corpora.sample_documents(df, 2, "doc_id"), 128, "doc_id")
    assert [r.doc_id for r in sample.collect()] == [2]


def test_cap_skips_documents_without_words(spark):
    rows = [(1, "", " "), (2, "t", "b c"), (3, "u", "c")]
    df = spark.createDataFrame(rows, "doc_id int, title string, article string")
    capped = corpora.capped_chunks(df, "cc_news", 128, 2).collect()
    assert [(r.doc_id, r.chunk) for r in capped] == [(2, "t b c"), (3, "u c")]


def test_categories(spark):
    rows = [(1, ["cs.CL cs.LG"]), (2, ["cs.LG"]), (3, None)]
    df = spark.createDataFrame(rows, "id int, categories array<string>")
    ids = lambda found: sorted(r.id for r in found.collect())
    assert ids(corpora.filter_categories(df, ["cs.LG"])) == [2]
    assert ids(corpora.filter_categories(df, ["cs.LG"], split_tokens=True)) == [1, 2]
    assert ids(corpora.filter_categories(df, None)) == [1, 2, 3]


@pytest.mark.parametrize("empty", [0, 70, 2000])
def test_a_cap_cleans_only_the_documents_it_needs(spark, monkeypatch, empty):
    """The first documents may hold no text: the search goes on behind them, and never over all of a large corpus."""
    cleaned = spark.sparkContext.accumulator(0)
    plain = corpora.clean_latex

    @F.udf("string")
    def seen(text):
        cleaned.add(1)
        return text

    monkeypatch.setattr(corpora, "clean_latex", lambda c: plain(seen(c)))
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") >= empty, F.lit("Title")).alias("title"),
        F.when(F.col("id") >= empty, F.lit("some words")).alias("abstract"),
    )
    got = corpora.capped_chunks(df, "arxiv", 128, 20)
    assert sorted(r.doc_id for r in got.collect()) == list(range(empty, empty + 20))
    if empty < 100:
        assert 0 < cleaned.value < 3000


def test_a_cap_beyond_the_corpus_gives_all(spark):
    df = spark.createDataFrame([(1, None, None), (2, "t", "a b"), (2, "t", "c"), (3, " ", "")], "doc_id int, title string, article string")
    assert sorted(r.doc_id for r in corpora.capped_chunks(df, "cc_news", 128, 50).collect()) == [2, 2]
    assert corpora.capped_chunks(df.limit(0), "cc_news", 128, 5).collect() == []
    assert corpora.sampled_chunks(df, "cc_news", 128, 5).collect() == []
