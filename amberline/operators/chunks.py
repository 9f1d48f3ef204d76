"""Packing of content blocks into chunks, one fold over the blocks of a page: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions.text import split_oversized, word_count

LEAST, MOST = 200, 500
PIECE = "array<struct<section:string,body:string>>"


def packed(blocks: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Chunks ``(section, body)`` of a page's blocks, in order.

    A heading closes the open chunk and names what follows. A text of more than ``most`` words closes
    it too and is cut into pieces of that size; one that would not fit opens a new chunk. A chunk of
    ``least`` words or more is closed.
    """
    none = F.array().cast(PIECE)
    start = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("buffer"), F.lit(0).cast("long").alias("words"), none.alias("out"))

    def closed(a: Column) -> Column:
        made = F.array(F.struct(a["section"].alias("section"), F.array_join(a["buffer"], "\n").alias("body")))
        return F.when(F.size(a["buffer"]) > 0, F.concat(a["out"], made)).otherwise(a["out"])

    def state(section: Column, buffer: Column, words: Column, out: Column) -> Column:
        return F.struct(section.alias("section"), buffer.alias("buffer"), words.cast("long").alias("words"), out.alias("out"))

    empty, zero = F.array().cast("array<string>"), F.lit(0)

    def step(a: Column, b: Column) -> Column:
        n, text = b["n"], F.array(b["text"])
        section = a["section"]
        pieces = F.transform(split_oversized(b["text"], most), lambda p: F.struct(section.alias("section"), p.alias("body")))
        full = a["words"] + n > most
        buffer, words, out = F.when(full, text).otherwise(F.concat(a["buffer"], text)), F.when(full, n).otherwise(a["words"] + n), F.when(full, closed(a)).otherwise(a["out"])
        last = F.array(F.struct(section.alias("section"), F.array_join(buffer, "\n").alias("body")))
        return (
            F.when(b["kind"] == "heading", state(b["text"], empty, zero, closed(a)))
            .when(n > most, state(section, empty, zero, F.concat(closed(a), pieces)))
            .when(words >= least, state(section, empty, zero, F.concat(out, last)))
            .otherwise(state(section, buffer, words, out))
        )

    counted = F.transform(blocks, lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), word_count(b["text"]).alias("n")))
    return F.aggregate(counted, start, step, closed)


def chunked(pages: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``chunk_id, url, title, section, text, body, word_count`` of ``pages(url, title, blocks)``; n in url#n counts from 0."""
    each = pages.select("url", "title", F.posexplode(packed(F.col("blocks"), least, most)).alias("n", "c"))
    header = F.concat_ws(" — ", "title", F.nullif(F.col("c.section"), F.lit("")))
    return each.select(
        F.concat_ws("#", "url", F.col("n").cast("string")).alias("chunk_id"), "url", "title", F.col("c.section").alias("section"),
        F.concat(header, F.lit("\n\n"), F.col("c.body")).alias("text"), F.col("c.body").alias("body"), word_count(F.col("c.body")).alias("word_count"),
    )
