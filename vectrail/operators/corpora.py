"""Corpora to chunks: composition, category filter, sampling, dispatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import explode_chunks, fixed_chunks, paragraph_chunks, word_chunks
from ..functions.text import (
    clean_latex,
    clean_wiki,
    compose_document,
    estimate_tokens,
    estimate_tokens_min1,
)
from ..session import spread
from ..sources.corpus import check_budget
from .limits import first_rows

# The names datasets go by.
NEWS, PAPERS, ENCYCLOPEDIA = "cc_news", "arxiv", "wikipedia"


# Growth of the part of a corpus in which a capped number of documents with a text is looked for.
STEP = 4


def filter_categories(
    papers: DataFrame, categories: Sequence[str] | None, split_tokens: bool = False
) -> DataFrame:
    """keep papers with any of the categories; none given keeps all.

    Matching is by whole element. ``split_tokens`` first parts elements that hold several
    categories joined by spaces.
    """
    if not categories:
        return papers
    given = F.col("categories")
    if split_tokens:
        given = F.flatten(F.transform(given, lambda c: F.split(c, " ")))
    return papers.filter(F.arrays_overlap(given, F.lit(sorted(set(categories)))))


def _documents(df: DataFrame, title, body, keep: Sequence[str]) -> DataFrame:
    """Title and body, cleaned once in a projection of their own, then composed.

    Documents without any text stay null: they explode into no chunks, and filtering them
    here would make Catalyst clean every text a second time below the filter.
    """
    cleaned = df.select(*keep, title.alias("_title"), body.alias("_body"))
    return cleaned.select(
        *keep, compose_document(F.col("_title"), F.col("_body")).alias("document")
    )


def news_chunks(df: DataFrame, budget: int, *keep: str) -> DataFrame:
    """Compose title and article, chunk by words."""
    check_budget(budget)
    documents = _documents(df, F.col("title"), F.col("article"), keep)
    return explode_chunks(documents, word_chunks(F.col("document"), budget), *keep)


def paper_chunks(df: DataFrame, budget: int, *keep: str) -> DataFrame:
    """Clean title and abstract, compose, chunk by words."""
    check_budget(budget)
    documents = _documents(df, clean_latex(F.col("title")), clean_latex(F.col("abstract")), keep)
    return explode_chunks(documents, word_chunks(F.col("document"), budget), *keep)


def article_chunks(df: DataFrame, budget: int, *keep: str) -> DataFrame:
    """Clean title and text, compose, chunk by paragraphs.

    Cleaning has already taken the blank lines out of the text, so the only paragraph
    break left lies between title and text.
    """
    check_budget(budget)
    documents = _documents(df, clean_wiki(F.col("title")), clean_wiki(F.col("text")), keep)
    return explode_chunks(documents, paragraph_chunks(F.col("document"), budget), *keep)


def fixed_width_chunks(df: DataFrame, text: str, budget: int, *keep: str) -> DataFrame:
    """G3 over a table."""
    check_budget(budget)
    return explode_chunks(df, fixed_chunks(F.col(text), budget), *keep)


CHUNKERS = {NEWS: news_chunks, PAPERS: paper_chunks, ENCYCLOPEDIA: article_chunks}
TOKEN_ESTIMATES = {
    NEWS: estimate_tokens,
    PAPERS: estimate_tokens,
    ENCYCLOPEDIA: estimate_tokens_min1,
}


def sample_documents(df: DataFrame, max_documents: int, order: str) -> DataFrame:
    """The first documents by ``order``, counted before empty ones fall out."""
    check_budget(max_documents, "max_documents")
    return first_rows(df, max_documents, order)


def capped_chunks(
    df: DataFrame, dataset: str, budget: int, max_chunks: int, doc_id: str = "doc_id"
) -> DataFrame:
    """The first ``max_chunks`` chunks in document order.

    Every composed document yields at least one chunk, so ``max_chunks`` of them that hold a text are
    enough. They are looked for among the first documents by key, four times as many in each step until
    they are found: only these are read whole and cleaned, however large the corpus.
    """
    check_budget(max_chunks, "max_chunks")
    title, body, clean = {
        NEWS: ("title", "article", lambda c: c),
        PAPERS: ("title", "abstract", clean_latex),
        ENCYCLOPEDIA: ("title", "text", clean_wiki),
    }[dataset]
    has_text = compose_document(clean(F.col(title)), clean(F.col(body))).rlike(r"(?U)[^\s\x1c-\x1f]")
    total, taken = df.count(), max_chunks
    while True:
        found = first_rows(df, taken, doc_id).filter(has_text)
        if taken >= total or found.count() >= max_chunks:
            break
        taken *= STEP
    chunks = CHUNKERS[dataset](first_rows(found, max_chunks, doc_id), budget, doc_id)
    return first_rows(chunks, max_chunks, doc_id, "chunk_index")


def sampled_chunks(
    df: DataFrame, dataset: str, budget: int, max_chunks: int, doc_id: str = "doc_id"
) -> DataFrame:
    """At most ``max_chunks`` chunks of the first ``max_chunks // 10`` documents."""
    check_budget(max_chunks, "max_chunks")
    if max_chunks < 10:
        return CHUNKERS[dataset](df.limit(0), budget, doc_id)
    first = sample_documents(df, max_chunks // 10, doc_id)
    return first_rows(CHUNKERS[dataset](first, budget, doc_id), max_chunks, doc_id, "chunk_index")


def dataset_chunks(sources: dict[str, DataFrame], budget: int, doc_id: str = "doc_id") -> DataFrame:
    """Chunks of one or several datasets, tagged by name and with their token estimate."""
    parts = []
    for name, df in sources.items():
        if name not in CHUNKERS:
            raise ValueError(f"unknown dataset: {name}")
        chunks = CHUNKERS[name](spread(df), budget, doc_id)
        parts.append(
            chunks.withColumns(
                {"dataset": F.lit(name), "tokens": TOKEN_ESTIMATES[name](F.col("chunk"))}
            )
        )
    if not parts:
        raise ValueError("no dataset given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
