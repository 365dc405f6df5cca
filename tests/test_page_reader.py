"""Pages are read in one pass outside the compiled projection, in bounded batches, whatever their bytes."""

from pyspark.sql import functions as F

from lotlens.session import bound_batches
from lotlens.sources import listing_pages


def test_no_rule_runs_as_an_expression_of_its_own(spark):
    rows = spark.createDataFrame([(1, "<b>")], "page_id int, html string")
    plan = listing_pages.with_payload(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract" not in plan and "transform" not in plan


def test_bytes_that_are_no_text_spoil_no_other_field(spark):
    html = b'\xff\xfe <span>Marka</span><span class="product-properties__i-value">KIA</span>'
    rows = spark.createDataFrame([(1, bytearray(html))], "page_id int, b binary").select("page_id", F.col("b").cast("string").alias("html"))
    assert listing_pages.with_payload(rows).first().raw == {"make": "KIA"}


def test_batches_are_bounded_and_never_widened(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for held, want in (("5000", "5000"), ("100000000", "16777216")):
        spark.conf.set(name, held)
        bound_batches(spark, listing_pages.BATCH_BYTES)
        assert spark.conf.get(name) == want
    spark.conf.set(name, before)
