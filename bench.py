"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     measured runs per query after one warm-up; the fastest counts (default 2)
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from vectrail.functions.chunk import explode_chunks, word_chunks
from vectrail.functions.embed import embed_hash, embed_query
from vectrail.operators import ann
from vectrail.operators import search as ops
from vectrail.plans import QUERIES
from vectrail.plans.inputs import table
from vectrail.session import local_session, new_scratch, spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "chunk_words",
    "chunk_paragraphs",
    "chunk_fixed",
    "corpus_news_chunks",
    "corpus_arxiv_chunks",
    "corpus_wiki_chunks",
    "corpus_report",
    "clean_wiki",
    "message_envelope",
    "parse_message",
    "normalize_embedding_message",
    "search_corpus",
    "search_text",
    "topk_cosine",
    "topk_cosine_batch",
    "unprocessed_batch",
    "reconcile_stages",
    "stage_latency",
    "run_metrics",
    "upsert_touch_updated_at",
    "upsert_last_wins",
    "insert_if_absent",
    "route_by_table",
    "stream_embed_store",
    "stream_insert_if_absent",
    "stream_incremental_embed",
]


def materialize(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int = RUNS) -> float:
    action()
    best = float("inf")
    for _ in range(runs):
        begin = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - begin)
    return round(best, 3)


def main() -> None:
    spark = local_session(CPUS, memory="16g", shuffle_partitions=int(CPUS))
    documents = spread(table(spark, SF_DIR, "documents").select("doc_id", "text"), "doc_id")
    chunks = explode_chunks(documents, word_chunks(F.col("text"), 128), "doc_id")

    def embedded(dim):
        return chunks.select("doc_id", "chunk_index", embed_hash(F.col("chunk"), dim).alias("embedding"))

    seconds, rates = {}, {}
    n_chunks, n_tokens = chunks.agg(F.count("*"), F.sum(F.shiftright(F.length("chunk"), 2))).first()

    seconds["chunk_only"] = timed(lambda: materialize(chunks))
    rates["chunk_chunks_per_s"] = round(n_chunks / seconds["chunk_only"])
    rates["chunk_tokens_per_s"] = round(n_tokens / seconds["chunk_only"])
    for dim in (64, 384):
        seconds[f"chunk_and_embed_{dim}"] = timed(lambda: materialize(embedded(dim)))
        rates[f"embed_{dim}_chunks_per_s"] = round(n_chunks / seconds[f"chunk_and_embed_{dim}"])

    stored = new_scratch(spark, "bench-vectors")
    embedded(64).select(F.format_string("%09d:%06d", "doc_id", "chunk_index").alias("id"), "embedding").write.parquet(stored)
    vectors = spark.read.parquet(stored)
    query = embed_query(spark, "artificial intelligence machine learning", 64)
    seconds["stored_topk_1"] = timed(lambda: ops.top_k(vectors, query, 10, "id").collect())
    hundred = vectors.orderBy("id").limit(100).select(F.col("id").alias("query_id"), "embedding")
    seconds["stored_topk_100"] = timed(
        lambda: materialize(ops.top_k_many(hundred, vectors, 10, "query_id", "id"))
    )

    source = table(spark, SF_DIR, "embeddings")
    begin = time.perf_counter()
    index = ann.build_index(source, new_scratch(spark, "bench-ivf"), "vec_id", lists=20)
    seconds["ivf_build"] = round(time.perf_counter() - begin, 3)
    asked = source.filter("vec_id % 20 = 0").select(source.vec_id.alias("query_id"), "embedding")
    pairs = lambda probes: {(r.query_id, r.vec_id) for r in index.search_many(asked, 10, "query_id", probes=probes).collect()}
    exact = pairs(20)
    seconds["ivf_search_many"] = timed(lambda: pairs(5))
    rates["ivf_queries"] = asked.count()
    for probes in (1, 5, 10):
        rates[f"ivf_recall_at_10_probes_{probes}"] = round(len(pairs(probes) & exact) / len(exact), 4)

    for name in HEADLINE:
        seconds[name] = timed(lambda: materialize(QUERIES[name](spark, SF_DIR)))
    rates["incremental_embed_messages_per_s"] = round(
        table(spark, SF_DIR, "documents").count() / seconds["stream_incremental_embed"]
    )

    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
