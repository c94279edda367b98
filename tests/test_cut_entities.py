"""Queries over pages whose titles were cut off inside an entity, against their SQL forms."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scrivana.functions import text as T
from scrivana.plans import catalog

QUERIES = ["book_texts", "file_texts", "book_chapters"]


def test_closed_entities(spark):
    text = "<p>caf&eacute; &#x41;&#66; a&ampb &copy 2 &ampfoo; &nosuch; &amp;lt; c &amp</p>"
    got = spark.createDataFrame([(text,)], "h string").select(T.strip_html_full(F.col("h"), closed=True), T.strip_html_full(F.col("h"))).first()
    assert got[0] == "café AB a&ampb &copy 2 &ampfoo; &nosuch; &lt; c &amp"
    assert got[1] == "café AB a&b © 2 &foo; &nosuch; &lt; c &"


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tmp_path, name):
    pages = [(k, f"<title>noise&&&amp</title><h1>a &copy {k} &amp</h1><p>R&amp;D &copy; &middot; b</p>") for k in range(16)]
    spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.sql(catalog.oracle_sql()[name])
    ours = catalog.queries()[name](spark, str(tmp_path)).select(*theirs.columns).collect()
    assert sorted(map(tuple, ours), key=str) == sorted(theirs.fetchall(), key=str)
