"""The router over a stream gives what it gives in batch."""

from amberline.operators import retrieval, routing
from amberline.streaming.router import route_stream


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(0, "https://x.org/contact", "contact", "contact the office by phone"), (1, "https://x.org/news", "news", "family gathering event"), (2, "https://x.org/more", "more", "other words here")], "k int, url string, title string, text string")
    index = retrieval.build(retrieval.corpus(pages, "k", "url", "title", "text"))
    asked = spark.createDataFrame([(1, "contact office"), (2, "should I change my dose"), (3, "pizza")], "query_id long, query string")
    asked.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in")
    query = route_stream(index, stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    query.awaitTermination(120)
    got = {r["query_id"]: r["kind"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["query_id"]: r["kind"] for r in routing.answers(index, asked).collect()}
