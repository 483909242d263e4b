import pyarrow as pa
import pytest

from hedgerow.operators import html as H


@pytest.mark.parametrize("sizes", [[], [0], [1], [H.PIECE * 3], [10] * 10_000, [H.PIECE * 2, 1, 1, H.PIECE * 2, 0], [900] * 3000])
def test_pieces_are_all_rows_in_order_and_bounded(sizes):
    column = pa.array(["x" * n for n in sizes], pa.string())
    found = list(H._pieces(column))
    assert [x for p in found for x in p.to_pylist()] == column.to_pylist()
    assert all(len(p) <= 1 or p.nbytes <= H.PIECE for p in found)


def test_a_batch_is_not_held_as_objects(spark):
    """5,000 pages of one batch, each with the number of results that are there when it is taken apart."""

    class Held(list):
        live = 0

        def __init__(self, *a):
            super().__init__(*a)
            Held.live += 1

        def __del__(self):
            Held.live -= 1

    rows = spark.range(5000, numPartitions=1).selectExpr("id", "repeat('x', 1024) as html")
    found = rows.select("id", H._mapped("html", "array<int>", lambda x: Held([Held.live, len(x)]), pa.list_(pa.int32())).alias("r")).collect()
    assert sorted(r["id"] for r in found) == list(range(5000)) and {r["r"][1] for r in found} == {1024}
    assert max(r["r"][0] for r in found) <= H.PIECE // 1024


def test_filters_in_the_kernel_are_those_of_all_rows(spark):
    from pyspark.sql import functions as F

    from hedgerow import catalog

    pages = [(1, '<!doctype html><p class=x id="y">a<!-- c --><a href="/b" rel=r>b</a><br></p>'), (2, None), (3, "<script>1</script><A HREF=z><td>"), (4, "plain")]
    rows = spark.createDataFrame(pages, "page_id int, html string")
    same = lambda a, b: a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    events = H.events(rows, "html", balance=False).where("kind = 'open'")
    assert same(H.opened(rows, "html"), events.select("page_id", "seq", F.col("name").alias("element")))
    clean = rows.withColumn("html", H.sanitize("html", catalog.PLAIN))
    assert same(H.opened(rows, "html", catalog.PLAIN), H.opened(clean, "html"))
    attributes = events.select("page_id", "seq", F.col("name").alias("element"), F.posexplode("attrs").alias("pos", "a")).select("page_id", "seq", "element", "pos", "a.name", "a.value")
    assert same(H.attributes(rows, "html"), attributes)
    assert same(H.attributes(rows, "html", "a"), attributes.where("element = 'a'"))
    assert same(H.tokens(rows, "html", "COMMENT", "DIRECTIVE"), H.tokens(rows, "html").where("kind in ('COMMENT', 'DIRECTIVE')"))


def test_pages_are_audited_once(spark):
    from hedgerow import catalog

    for name in ("discard_counts", "discard_rollup", "discard_approx_pages", "tag_histogram"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
