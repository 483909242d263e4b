import math
import os
from datetime import datetime

import duckdb
import pytest

from hedgerow import catalog
from hedgerow.kernel.policy import FORMATTING
from hedgerow.operators import html
from hedgerow.sources import files
from hedgerow.streaming import trends

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("pages", "documents", "events"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(found, columns):
    def plain(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(([plain(r[c]) for c in columns] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    relation = duck.sql(catalog.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    theirs = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert rows([r.asDict() for r in df.collect()], columns) == rows(theirs, columns)


def test_partitioning_changes_nothing(spark):
    one = {tuple(r) for r in catalog.sanitize_pages(spark, DATA).collect()}
    many = catalog.pages(spark, DATA).repartition(7).select("page_id", "url", html.process("html", catalog.PAGES).alias("r"))
    assert one == {(r["page_id"], r["url"], r["r"]["html"], len(r["r"]["discards"])) for r in many.collect()}


def test_nulls_and_plain_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "plain"), (3, "<b>x"), (4, "")], "id int, html string")
    assert {r["id"]: r["html"] for r in html.sanitize_plain(df, "html", FORMATTING).collect()} == {1: "", 2: "plain", 3: "<b>x</b>", 4: ""}
    empty = df.where("id < 0")
    assert html.audit(empty, "html", FORMATTING).count() == 0 and html.tokens(empty, "html").count() == 0


def test_stream_is_as_batch(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    clean = trends.sanitize_stream(stream, "html", FORMATTING)
    q = clean.writeStream.format("memory").queryName("cleaned").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in source.withColumn("html", html.sanitize("html", FORMATTING)).collect()}
    assert {tuple(r) for r in spark.table("cleaned").collect()} == batch


def test_late_rows_are_not_counted(spark, tmp_path):
    schema = "ts timestamp, html string"
    for k, times in enumerate((["10:05"], ["12:30"], ["12:40"], ["10:10"], ["15:00"])):
        rows = [(datetime.fromisoformat(f"2024-05-01 {t}:00"), "<script>x</script>") for t in times]
        path = str(tmp_path / "in")
        files.write_pages(spark.createDataFrame(rows, schema).coalesce(1), path, "append")
        for f in set(os.listdir(path)) - (known if k else set()):
            os.utime(f"{path}/{f}", (1_700_000_000 + 10 * k,) * 2)
        known = set(os.listdir(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = trends.violation_trends(stream, "ts", "html", FORMATTING)
    q = found.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["window_start"].hour, r["element"], r["n"]) for r in spark.table("late").collect()) == [(10, "script", 1), (12, "script", 2)]
    batch = trends.violation_trends(spark.read.parquet(path), "ts", "html", FORMATTING)
    assert sorted((r["window_start"].hour, r["n"]) for r in batch.collect()) == [(10, 2), (12, 2), (15, 1)]


def test_files_and_tables(spark, tmp_path):
    for name, text in (("a.html", "<b>one\ntwo"), ("b.html", "two"), ("c.html", "")):
        (tmp_path / name).write_text(text)
    found = files.read_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["html"] for r in found.collect()} == {"a.html": "<b>one\ntwo", "b.html": "two"}
    clean = found.select(html.sanitize("html", FORMATTING).alias("html"))
    files.write_pages(clean, str(tmp_path / "out"))
    assert {r["html"] for r in files.read_pages(spark, str(tmp_path / "out")).collect()} == {"<b>one\ntwo</b>", "two"}
    stream = files.stream_pages(spark, str(tmp_path / "out"), clean.schema)
    assert stream.isStreaming and stream.columns == ["html"]
