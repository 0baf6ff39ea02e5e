import pytest
from pyspark.sql import functions as F

from vectrail.functions import text as t


def evaluate(spark, value, function):
    rows = spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("x"))
    return rows.first().x


@pytest.mark.parametrize("length", [0, 1, 3, 4, 7, 4096])
@pytest.mark.parametrize("unit", ["k", " ", "𝔄"])
def test_token_estimates_follow_the_number_of_code_points(spark, unit, length):
    assert evaluate(spark, unit * length, t.estimate_tokens) == length // 4
    assert evaluate(spark, unit * length, t.estimate_tokens_min1) == (max(1, length // 4) if length else 0)


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("[[outer|[[inner]]]]", "[[inner]]"),  # one pass: the inner link is left
        ("see [[an open link", "see [[an open link"),
        ("[[mill {{dated|1802}} race|sluice]] gate", "sluice gate"),
        ("[[weir|low weir {{fact}}]]", "low weir"),
        ("stray }} and {{ marks", "stray }} and {{ marks"),
        ("ford  and ferry", "ford and ferry"),
        ("lock\x1d\x1fkeeper\x0b", "lock keeper"),
        ("=== towpath == bridge ===", "towpath == bridge"),
        ("== a == then text", "== a == then text"),  # a heading is the whole text
        ("[[🜁|𝔄ir]] and '''𝕏'''", "𝔄ir and 𝕏"),
        ("it''''s", "its"),
        ("barge<!-- two\nlines -->s", "barges"),
        ("[https://canal.example] ends", "ends"),
        (None, ""),
    ],
)
def test_wiki_cleaner(spark, text, cleaned):
    assert evaluate(spark, text, t.clean_wiki) == cleaned


@pytest.mark.parametrize(
    "text, cleaned",
    [(None, ""), ("  a \n b ", "a b"), (r"\textit{steep} \beta slope", "steep beta slope"), (r"\emph{} \1", r"\1")],
)
def test_latex_cleaner(spark, text, cleaned):
    assert evaluate(spark, text, t.clean_latex) == cleaned


# Language names and their codes.
@pytest.mark.parametrize(
    "name, code",
    [
        ("en", "en"), ("english", "en"), ("simple", "simple"), ("es", "es"), ("Spanish", "es"),
        ("fr", "fr"), ("french", "fr"), ("de", "de"), (" German ", "de"), ("invalid", "en"), ("", "en"),
    ],
)
def test_language_codes(spark, name, code):
    assert evaluate(spark, name, t.language_code) == code


# Kilobytes and their tokens.
@pytest.mark.parametrize("kb, tokens", [(0.5, 128), (1.0, 256), (2.0, 512), (10.0, 2560), (80.0, 20480)])
def test_kb_to_tokens(spark, kb, tokens):
    assert spark.range(1).select(t.kb_to_tokens(F.lit(kb))).first()[0] == tokens


@pytest.mark.parametrize(
    "title, body, document",
    [("t", "b", "t\n\nb"), ("t", "", "t"), (None, "b", "b"), ("", None, None), (None, None, None)],
)
def test_compose(spark, title, body, document):
    row = spark.createDataFrame([(title, body)], "t string, b string")
    assert row.select(t.compose_document(F.col("t"), F.col("b"))).first()[0] == document


@pytest.mark.parametrize("text, blank", [(None, True), ("", True), (" \t \x1f", True), (" x ", False)])
def test_blank(spark, text, blank):
    assert evaluate(spark, text, t.is_blank) is blank


def test_preview(spark):
    assert evaluate(spark, "a" * 101, t.preview) == "a" * 100 + "..."
    assert evaluate(spark, "short", t.preview) == "short"
    assert evaluate(spark, "short", lambda c: t.preview(c, always_dots=True)) == "short..."


def test_title_line(spark):
    assert evaluate(spark, "A title\nand text.", t.has_title_line) is True
    assert evaluate(spark, "A sentence.", t.has_title_line) is False
    assert evaluate(spark, "x" * 100, t.has_title_line) is False
