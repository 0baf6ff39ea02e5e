import gzip
import json
import warnings

import pytest
from pyspark.sql import functions as F

from vectrail.plans import files as plans
from vectrail.schemas import LOG
from vectrail.sources import corpus, files, log


def test_news_folder_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        corpus.news(spark, f"{folder}/absent")
    with pytest.raises(FileNotFoundError):
        corpus.news(spark, folder)
    with pytest.raises(FileNotFoundError):
        corpus.papers(spark, f"{folder}/absent")
    with pytest.raises(ValueError):
        corpus.check_budget(-100)


def test_news_files_by_position(spark, folder):
    for n in range(3):
        spark.createDataFrame([(f"t{n}", "a", 1)], "title string, article string, extra int").coalesce(1).write.parquet(
            f"{folder}/part={n}"
        )
    titles = lambda df: sorted(r.title for r in df.collect())
    assert titles(corpus.news_files(spark, folder, None)) == ["t0", "t1", "t2"]
    assert titles(corpus.news_files(spark, folder, [0, 2])) == ["t0", "t2"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert titles(corpus.news_files(spark, folder, [1, 9])) == ["t1"]
        assert corpus.news_files(spark, folder, [-1]).count() == 0
    assert len([w for w in seen if "file index" in str(w.message)]) == 2
    assert corpus.news(spark, folder).columns == ["title", "article"]


def test_file_subset_when_parts_are_missing(spark, folder):
    """A part may be missing, in several files or of no number."""
    ids = [None, -3, *range(2, 40)]
    rows = [(i, f"text {i}") for i in ids if i is None or i % 4]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        files = corpus.news(spark, plans.news_folder(spark, folder)).inputFiles()
        everything = {r.title for r in plans.scan_parquet_corpus(spark, folder).collect()}
        subset = sorted(r.title for r in plans.scan_file_subset(spark, folder).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len([f for f in files if "/part=1/" in f]) > 1  # no task gathers a part
    assert everything == {None if i is None else f"Document {i}" for i, _ in rows}
    assert subset == sorted(f"Document {i}" for i, _ in rows if i is not None and i > 0 and i % 4 == 1)


def test_papers_skip_bad_lines(spark, folder):
    with gzip.open(f"{folder}/p.jsonl.gz", "wt", encoding="utf-8") as out:
        out.write(json.dumps({"id": "1", "title": "é", "abstract": "x", "categories": ["a b"], "other": 1}) + "\n")
        out.write('{"id": "2", "title": \n')
        out.write(json.dumps({"id": "3"}) + "\n")
    got = {r.id: r for r in corpus.papers(spark, folder).collect()}
    assert set(got) == {"1", "3"} and got["1"].title == "é" and got["3"].abstract is None


def test_articles_prune_to_one_folder(spark, folder):
    rows = [("t", "x", "u", "20231101", l) for l in ("en", "fr", "simple")] + [("o", "x", "u", "20200101", "fr")]
    spark.createDataFrame(rows, "title string, text string, url string, date string, lang string").write.partitionBy(
        "date", "lang"
    ).parquet(f"{folder}/dump")
    french = corpus.articles(spark, f"{folder}/dump", "French")
    assert [tuple(r) for r in french.collect()] == [("t", "x", "u")]
    plan = french._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "(lang" in plan.split("PartitionFilters")[1]
    assert corpus.articles(spark, f"{folder}/dump", "klingon").count() == 1


def test_text_documents(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("\n This is a smoke test.\nSecond line \n\n")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    got = files.text_documents(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r.file, r.text) for r in got] == [("a.txt", "one"), ("b.TXT", "This is a smoke test.\nSecond line")]


def test_ndjson(spark, tmp_path):
    records = [{"k": 5, "body": "five"}, {"body": "none"}, {"k": "", "body": "empty"}, {"k": "n", "body": 5}, {"k": "b", "body": " "}]
    lines = [json.dumps(r) for r in records] + ["", "  ", "{bad", "[1]"]
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    (tmp_path / "y.jsonl").write_text(json.dumps({"k": "z", "body": "zed"}))
    (tmp_path / "z.json").write_text(json.dumps({"k": "no", "body": "no"}))
    got = {r.text: r.id for r in files.ndjson(spark, str(tmp_path), "body", "k").collect()}
    assert set(got) == {"five", "none", "empty", "zed"} and got["five"] == "5" and got["zed"] == "z"
    assert len(got["none"]) == 32 and got["none"] != got["empty"]


def test_ndjson_files_of_one_name_give_their_own_messages(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jsonl").write_text(json.dumps({"text": "equal"}))
    read = lambda: sorted(r.id for r in files.ndjson(spark, str(tmp_path / "*")).collect())
    assert len(set(read())) == 2 and read() == read()


def test_lines(spark, tmp_path):
    (tmp_path / "x").write_text("one\n\n  two \n \n")
    assert sorted(r.text for r in files.lines(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_embedding_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"embedding": [1, 2], "model_name": "m", "metadata": {"dimension": 2}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"embedding": []}))
    (tmp_path / "c.json").write_text(json.dumps({"model_name": "m"}))
    got = files.embedding_files(spark, str(tmp_path)).collect()
    assert [(r.file, r.embedding) for r in got] == [("a.json", [1.0, 2.0])]


def test_bounded_read_of_a_log(spark, folder):
    rows = spark.range(30).select(
        F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("offset"),
        F.lit("k").alias("key"), F.when(F.col("id") == 3, "plain").otherwise('{"id": "a", "text": "x"}').alias("value"),
        F.timestamp_seconds("id").alias("timestamp"),
    )
    log.write_files(rows, folder)
    back = log.batch(spark, folder, topic="t")
    assert back.schema.simpleString() == LOG.simpleString()
    got = log.read_bounded(back, 4).collect()
    assert [(r.partition, r.offset) for r in got] == [(0, 0), (0, 3), (0, 6), (0, 9)]
    assert got[0].text == "x" and got[1].id is None and got[1].value == "plain"
    assert log.batch(spark, folder, topic="other").count() == 0


def test_keys_keep_to_their_partition(spark):
    rows = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 5).alias("k"), "id")
    placed = log.to_log(rows, F.col("k"), F.lit("v"), "t", F.col("id"), F.current_timestamp())
    assert placed.select("key", "partition").distinct().count() == 5
