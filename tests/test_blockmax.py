"""The search with block maxima against the search of all postings."""

import random

import pytest
from pyspark.sql import functions as F

from amberline.operators import blockmax, retrieval


@pytest.mark.parametrize("seed,common", [(1, 0), (2, 5)])
def test_block_maxima_lose_nothing(spark, tmp_path, seed, common):
    """``common`` words stand in most chunks, so that their weight is not positive before it is mended."""
    rng = random.Random(seed)
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    texts = [" ".join([*(rng.choices(words[150 * (i // 300) // 3 :: 3], k=rng.randint(1, 30))), *(f"commonword{c}" for c in "abcde"[:common] if rng.random() < 0.9)]) for i in range(600)]
    df = spark.createDataFrame([(i, f"u{i}", "t", t) for i, t in enumerate(texts)], "k int, url string, title string, text string")
    index = retrieval.build(retrieval.corpus(df, "k", "url", "title", "text"))
    asked = [" ".join(rng.choices(words, k=3)) for _ in range(12)] + [words[3], "nothingknown", "", "commonworda commonwordb", texts[5], f"{words[9]} {words[9]} commonworda"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    stored = blockmax.store(index, f"{tmp_path}/index", block=20)
    for k in (3, 10):
        want = sorted(map(tuple, retrieval.search(index, queries, k).select("query_id", "rank", "ord", F.round("score", 7)).collect()))
        for held in (stored, blockmax.load(spark, f"{tmp_path}/index")):
            got, blocks = blockmax.search(held, queries, k, first=2)
            assert sorted(map(tuple, got.select("query_id", "rank", "ord", F.round("score", 7)).collect())) == want
    read = {r["read"]: r["n"] for r in blockmax.search(stored, queries, 3, first=2)[1].groupBy("read").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert read[False] > 0.3 * (read[True] + read[False])  # blocks that were passed over
