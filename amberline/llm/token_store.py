"""Token ids in a content-addressed store.

Files, all Parquet, under one folder:

* ``kind=chunk``: ``key`` (sha256 of the ids) and ``body`` (the ids, little-endian, two bytes each if
  the vocabulary allows, else four); each distinct chunk once.
* ``recipes``: one row per document in ascending doc_id: ``shard``, ``doc_id``, ``n_tokens``, the
  keys and lengths of its chunks in order, and the Merkle root over these keys.
* ``manifest``: per shard its rows, its ids, the position of its first id, and the Merkle root over
  its recipes' roots.
* ``total``: one row: the number of shards, documents and ids, the Merkle root over the shards' roots, and the bytes of an id.

A chunk ends where a rolling hash of the last ids says so, so equal passages give equal chunks
wherever they stand. Reading back verifies the reconstruction from the top down and raises at the
first fault: the manifest against ``total``, each shard's rows, ids and root against the manifest,
each recipe against its root, each chunk against its key; a recipe whose chunk is not there raises
too. The chunks' checksums are joined by the linearity of crc32, so bodies are never shuffled twice.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.llm.bpe_automaton import byte_symbols
from amberline.llm.common import shared_dir, slices, text_or_empty

LEAST, MEAN_BITS, MOST, ROLL = 128, 9, 4096, 8
#: Words, their codes and the objects around them that a Python worker holds; beyond this it starts afresh.
CACHE_BYTES, ENTRY_BYTES = 160 << 20, 220
#: Documents in a shard.
SHARD_DOCS = 1 << 15
#: Keys that a writer remembers as already sent; beyond this it starts afresh and repeats are dropped later.
SENT_KEYS = 200_000
#: What shows that blanks are not all single spaces and single line ends; in a text that is not ASCII other blanks do, too.
ODD_BLANKS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
OTHER_BLANK = re.compile(r"[^\S \n]")
#: Marks that are neither letters, numbers, blanks nor part of a contraction, after a Latin letter or a digit and before a blank; and how they are set apart.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TAILS = (r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([" + "".join(f"\\{m}" for m in MARKS) + r"]+)( |$)", "\\1 \f\\2\\3")
#: New words encoded in one call.
JOINED = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def id_type(size: int) -> np.dtype:
    """What an id of a vocabulary of this size is stored as."""
    return np.dtype("<u2") if size <= 65536 else np.dtype("<u4")


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    Where all blank runs of a text are one space or one line end, the pre-tokenizer of a byte-level
    file always cuts before that blank, so words can be encoded apart with the blank before them.
    Other texts, and texts that hold a special token, are encoded in one call.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        read = json.loads(spec)
        pre = read.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not read.get("normalizer")
        self.special = [t["content"] for t in read["added_tokens"]]
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.forget()
        self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        space = byte_symbols()[0x20]
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True

    def forget(self) -> None:
        #: A word that is looked up for the first time takes the next number; ``codes`` holds the ids by number.
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.codes: list[bytes] = []
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        data = np.array(list(chain.from_iterable(got)), dtype=self.dtype).tobytes()
        ends = list(accumulate([len(x) * self.dtype.itemsize for x in got], initial=0))
        return [data[x:y] for x, y in zip(ends, ends[1:])]

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Words after a space are joined and encoded in one call: a token that begins with the space's symbol begins a word."""
        spaced = [p for p in words if p[:1] not in ("\r", "\n", "\f")]
        others = [p for p in words if p[:1] in ("\r", "\n", "\f")]
        fresh = dict(zip(others, self.whole([p.lstrip("\r\f") for p in others])))
        runs = [" " + " ".join(spaced[i : i + JOINED]) for i in range(0, len(spaced), JOINED)]
        for i in range(0, len(runs), 256):
            got = self.tokenizer.encode_batch_fast(runs[i : i + 256], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable([e.ids for e in got])), dtype=self.dtype)
            edges = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.dtype.itemsize).tolist()
            data, part = ids.tobytes(), spaced[i * JOINED : (i + 256) * JOINED]
            if len(edges) != len(part) + 1:
                raise ValueError("the tokenizer did not begin a token at each word")
            fresh.update(zip(part, [data[x:y] for x, y in zip(edges, edges[1:])]))
        return fresh

    def regular(self, text: str) -> bool:
        """Whether all blank runs are one space or one line end between words, so that words can be encoded apart."""
        if not self.by_word or not text or any(s in text for s in self.special):
            return False
        if any(b in text for b in ODD_BLANKS) or text[0] in " \n" or text[-1] in " \n":
            return False
        return text.isascii() or not OTHER_BLANK.search(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.forget()
        apart = [self.regular(t) for t in texts]
        out = iter(self.by_words([t for t, a in zip(texts, apart) if a]))
        whole = iter(self.whole([t for t, a in zip(texts, apart) if not a]))
        return [next(out if a else whole) for a in apart]

    def by_words(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the texts into words, each standing for itself with the space before it, or with its own line end,
        and numbers the distinct ones; only these are looked up, and their ids are dealt to their places. Marks at the end
        of a word are a word of their own to the pre-tokenizer, and so they are here, after a form feed."""
        if not texts:
            return []
        marked = pa.array(["\r" + t for t in texts], pa.large_string())  # no text cut here has a carriage return or a form feed
        cut = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(marked, "\n", " \n"), *TAILS), " ")
        ends = np.asarray(cut.offsets)
        words = cut.values.dictionary_encode()
        try:
            at = list(map(self.numbers.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
            new = list(islice(reversed(self.numbers), len(self.numbers) - len(self.codes)))[::-1]
            fresh = self.encoded(new)
            self.codes += [fresh[p] for p in new]
        except BaseException:
            self.forget()  # no number without its code
            raise
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        own = [self.codes[a] for a in at]
        width, flat = self.dtype.itemsize, np.frombuffer(b"".join(own), self.dtype)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        first, word = np.cumsum(sizes) - sizes, np.asarray(words.indices)
        took = sizes[word]
        before = np.cumsum(took) - took
        data = flat[np.repeat(first[word] - before, took) + np.arange(took.sum())].tobytes()
        bounds = (np.append(before, took.sum())[ends] * width).tolist()
        return [data[x:y] for x, y in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """One encoder a Python worker, which keeps the words it knows from task to task."""
    return Encoder(spec)


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document of a run of ids; document k is ``ids[bounds[k]:bounds[k + 1]]``."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    x ^= x >> np.uint64(29)
    roll = np.zeros(len(x), np.uint64)
    for k in range(ROLL):
        roll[k:] += x[: len(x) - k] * np.uint64(pow(0x100000001B3, k, 1 << 64))
    marks = np.flatnonzero((roll * MIX) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    lo, hi = np.searchsorted(marks, bounds[:-1]), np.searchsorted(marks, bounds[1:])
    out = []
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo.tolist(), hi.tolist()):
        ends, at = [], a
        for m in marks[i:j].tolist() if b - a > LEAST else []:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < b:
                at = m
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        out.append([*ends, b])
    return out


def merkle(keys: list[bytes]) -> bytes:
    """Root of a binary tree of sha256; an odd last node moves up as it is."""
    level = keys or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


JOURNAL = "kind string, part int, key binary, doc_id long, n_tokens long, body binary, sizes binary"


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> str:
    """Encode ``docs(doc_id, text)`` and write the store to ``path``.

    Null texts are empty and hold the end id only. Rows with a null doc_id come first, equal ids
    are ordered by their Merkle roots. Extra columns are not read. An empty table writes no rows.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())  # its size is set by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        end, width, sent = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize, set()
        number = 0  # deals recipes, so that neither copies nor rows of one doc_id gather
        for batch in slices(batches, "text", 4 << 20):
            runs = [ids + end for ids in own.encode(batch.column("text").to_pylist())]
            bounds = np.cumsum([0, *(len(r) // width for r in runs)])
            data = b"".join(runs)
            ends = cut_points(np.frombuffer(data, own.dtype), bounds)
            rows: list[tuple] = []
            for doc, a, b, cuts in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), ends):
                keys, at, sizes = [], a, []
                for e in cuts:
                    body = data[at * width : e * width]
                    key = hashlib.sha256(body).digest()
                    if key not in sent:
                        sent.add(key)
                        rows.append(("chunk", int.from_bytes(key[:4], "little", signed=True), key, None, e - at, body, None))
                    keys.append(key)
                    sizes.append(e - at)
                    at = e
                root, number = merkle(keys), number + 1
                rows.append(("recipe", (zlib.crc32(root) + number) & 0x7FFFFFFF, root, doc, b - a, b"".join(keys), np.array(sizes, "<i4").tobytes()))
            if len(sent) > SENT_KEYS:
                sent.clear()
            types = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "part", "key", "doc_id", "n_tokens", "body", "sizes"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # keys of one partition, whose size Spark bounds
        for batch in batches:
            keep = []
            for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist()):
                keep.append(kind == "recipe" or key not in seen)
                if kind == "chunk":
                    seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    journal = source.mapInArrow(encode, JOURNAL).repartition("part")
    journal.mapInArrow(once, JOURNAL).drop("part").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    recipes = spark.read.schema(STORE).parquet(f"{path}/store").where("kind = 'recipe'")
    ordered = recipes.select("doc_id", F.col("key").alias("root"), "n_tokens", F.col("body").alias("keys"), "sizes")
    shards = max(1, -(-recipes.count() // SHARD_DOCS))
    ordered = ordered.repartitionByRange(shards, "doc_id", "root").sortWithinPartitions("doc_id", "root")  # the root also parts rows of one doc_id
    ordered.withColumn("shard", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    rows = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    facts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    # one row a shard: a window over all of them is small whatever the corpus
    first = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    roots = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "root").select("shard", "root").mapInArrow(_shard_roots, "shard int, root binary")
    facts.withColumn("first", first).join(roots, "shard").write.parquet(f"{path}/manifest")
    size = Tokenizer.from_str(held.value).get_vocab_size()
    totals(spark, path).withColumn("width", F.lit(id_type(size).itemsize)).write.parquet(f"{path}/total")
    return path


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row over the manifest: ``n_shards``, ``n_docs``, ``n_ids``, ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("n_docs", "n_ids", "root")))]
        yield pa.RecordBatch.from_pydict({"n_shards": [len(rows)], "n_docs": [sum(r[0] for r in rows)], "n_ids": [sum(r[1] for r in rows)], "root": [merkle([r[2] for r in rows])]})

    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return shards.repartition(1).sortWithinPartitions("shard").mapInArrow(run, TOTAL)  # one row a shard


MANIFEST = "shard int, n_docs long, n_ids long, first long, root binary"
TOTAL = "n_shards long, n_docs long, n_ids long, root binary"
#: Bytes of an id in the chunks, in the same table as the total.
WIDTH = "width int"
STORE = "key binary, doc_id long, n_tokens long, body binary, sizes binary, kind string"
RECIPE = "doc_id long, root binary, n_tokens long, keys binary, sizes binary, shard int"


def _shard_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A Merkle root per shard; the rows of a shard come together and in order. 32 bytes a row are held."""
    shard, held = None, []
    done: list[tuple[int, bytes]] = []
    for batch in batches:
        for s, r in zip(batch.column("shard").to_pylist(), batch.column("root").to_pylist()):
            if s != shard and held:
                done.append((shard, merkle(held)))
                held = []
            shard = s
            held.append(r)
    if held:
        done.append((shard, merkle(held)))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())], names=["shard", "root"])


@functools.cache
def _zero_bytes_tables() -> list[np.ndarray]:
    """For each power of two, tables (4 x 256) of what that many zero bytes after a message do to its crc32."""

    def tables(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1:
                        out[byte, value] ^= columns[8 * byte + bit]
        return out

    # of one zero byte: crc32 without its initial and final complement
    columns = [zlib.crc32(b"\0", (1 << k) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(32)]
    out = []
    for _ in range(48):
        out.append(tables(columns))
        columns = [int(_apply(out[-1], np.array([c], np.uint32))[0]) for c in columns]
    return out


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What chunks with these checksums add, by xor, to the crc32 of a message in which ``after`` bytes follow them."""
    out, after = crc.astype(np.uint32), after.astype(np.int64)
    for k, table in enumerate(_zero_bytes_tables()):
        if not (after >> k).any():
            break
        out = np.where(after >> k & 1, _apply(table, out), out)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the files alone.

    Raises if the store is not whole (see above). An empty store gives no rows.
    """
    nothing = (0, 0, 0, merkle([]))
    *listed, width = spark.read.schema(f"{TOTAL}, {WIDTH}").parquet(f"{path}/total").first() or (*nothing, 2)
    dtype = np.dtype(f"<u{width}")
    if tuple(listed) != tuple(totals(spark, path).first() or nothing):
        raise ValueError("the manifest does not match its total")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column("key").to_pylist(), batch.column("body").to_pylist()
            for key, body in zip(keys, bodies):
                if hashlib.sha256(body).digest() != key:
                    raise ValueError(f"chunk {key.hex()} does not match its key")
            crc = [zlib.crc32(np.frombuffer(b, dtype).astype("<u4").tobytes()) for b in bodies]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(b) // width for b in bodies], pa.int64()), pa.array(crc, pa.int64())], names=["key", "size", "crc"])

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the documents of whole shards, each led by its line of the manifest."""
        shard, wanted, at, roots = None, None, 0, []
        names = ["shard", "doc_id", "n_tokens", "root", "keys", "sizes", "n_docs", "first"]

        def close() -> None:
            if wanted is not None and (len(roots), at - wanted[2], merkle(roots)) != (wanted[0], wanted[1], wanted[3]):
                raise ValueError(f"the recipes of shard {shard} do not match the manifest")

        for batch in batches:
            out: list[tuple] = []
            for s, doc, n, root, keys, sizes, n_docs, first in zip(*(batch.column(c).to_pylist() for c in names)):
                if n_docs is not None:
                    close()
                    shard, wanted, at, roots = s, (n_docs, n, first, root), first, []
                    continue
                if s != shard:
                    raise ValueError(f"shard {s} is not in the manifest")
                own = [keys[i : i + 32] for i in range(0, len(keys), 32)]
                if merkle(own) != root:
                    raise ValueError(f"recipe of document {doc} does not match its root")
                after = n - np.cumsum(np.frombuffer(sizes, "<i4").astype(np.int64))
                out += [(doc, at, n, k, a) for k, a in zip(own, after.tolist())]
                at += n
                roots.append(root)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "start", "n_tokens", "key", "after"])
        close()

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("crc").null_count:
                lost = next(k for k, c in zip(batch.column("key").to_pylist(), batch.column("crc").to_pylist()) if c is None)
                raise ValueError(f"chunk {lost.hex()} is not in the store")
            crc = crc_before(np.asarray(batch.column("crc")).astype(np.uint32), np.asarray(batch.column("after")) * 4)
            kept = [batch.column(c) for c in ("doc_id", "start", "n_tokens", "size")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "size", "part"])

    chunks = spark.read.schema(STORE).parquet(f"{path}/store").where("kind = 'chunk'").select("key", "body").mapInArrow(sums, "key binary, size long, crc long")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = spark.read.schema(RECIPE).parquet(f"{path}/recipes").select("shard", "doc_id", "n_tokens", "root", "keys", "sizes", null("long", "n_docs"), null("long", "first"))
    heads = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", null("long", "doc_id"), F.col("n_ids").alias("n_tokens"), "root", null("binary", "keys"), null("binary", "sizes"), "n_docs", "first")
    # a shard's head comes before its recipes, which come in the order in which they were numbered
    shards = rows.unionByName(heads).repartition("shard").sortWithinPartitions("shard", F.desc_nulls_last("n_docs"), "doc_id", "root")
    # each chunk is met under one row of its key and sum; a chunk that many documents share is spread by AQE's skew join
    parts = shards.mapInArrow(refs, "doc_id long, start long, n_tokens long, key binary, after long").join(chunks, "key", "left")
    parts = parts.select("doc_id", "start", "n_tokens", "key", "after", "size", "crc").mapInArrow(shifted, "doc_id long, start long, n_tokens long, size long, part long")
    # every document holds its end id, so its start is its own
    whole = parts.groupBy("start", "doc_id", "n_tokens").agg(F.sum("size").alias("size"), F.bit_xor("part").alias("ids_crc32"))
    checked = F.when(F.col("size") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe lacks chunks")).cast("long"))
    return whole.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    path = write(spark, docs, tokenizer, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}", end_id)
    return read(spark, path)
