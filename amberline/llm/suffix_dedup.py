"""Removal of passages that an earlier document holds, by suffix arrays built in two stages.

Routing. The 8-byte grams of a 50-byte string have a least hash; equal strings have equal least
hashes. A maximal run of strings with one least hash is a segment (50 bytes and what the run adds),
and segments are dealt to buckets by that hash, so all places of a string meet in one bucket, and a
string is in one segment only. A writer sends each distinct segment of a slice once, with its least
document; whatever else in the slice repeats it is removed at once. So a passage that all documents
share reaches its bucket once a slice.

Suffix array. In a bucket, segments with no string that may recur are set aside by a hashed count.
The others, each distinct one once, are joined to one text. Suffixes that are smaller than their
successor are sorted directly, by eight bytes at a time and as deep as LENGTH bytes; the others are
induced by one scan of the buckets of first bytes in order: the suffix before a placed suffix goes
next into the bucket of its own first byte. Common prefixes of neighbours in the array then give runs
of equal strings; each run has a least document, and the string is removed wherever a document is
larger than it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.llm.common import flat, slices, stage, text_or_empty

LENGTH, GRAM = 50, 8  # a gram is one eight-byte number
WINDOW = LENGTH - GRAM + 1
#: Most strings in one segment; a longer run of one least hash is cut, which routing does not mind.
RUN = 512
SLICE_BYTES = 2 << 20
#: Text bytes of the input for each bucket; segments of a bucket hold about three times as much.
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 12 << 20
#: Partitions of the buckets at most; beyond, several buckets follow each other in one.
PARTITIONS = 1 << 15
#: Bytes of pieces hashed at once.
BLOCK = 1 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_at(text: np.ndarray, order: str = ">") -> np.ndarray:
    """The eight bytes from each position as one number, without a copy."""
    return np.ndarray(shape=(max(0, len(text) - 7),), dtype=f"{order}u8", buffer=text.data, strides=(1,))


def least_hashes(text: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string of ``text``, the least hash of its grams."""
    h = words_at(text, "<") * M1
    h ^= h >> np.uint64(31)
    h *= M2
    reach = 1
    while reach * 2 <= WINDOW:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    rest = WINDOW - reach
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings and least hash of each segment; strings never cross a document's end."""
    none = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    low = least_hashes(text)
    valid = np.ones(len(low), bool)
    for k in range(1, LENGTH):  # strings that begin in the last bytes of a document
        at = starts[1:] - k
        at = at[(at >= starts[:-1]) & (at < len(low))]
        valid[at] = False
    edge = np.ones(len(low), bool)
    edge[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    begin = starts[:-1]
    edge[begin[begin < len(low)]] = True
    head = np.flatnonzero(edge)
    size = np.diff(np.append(head, len(low)))
    keep = valid[head]
    head, size = head[keep], size[keep]
    if (size > RUN).any():
        parts = -(-size // RUN)
        back = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        total = np.repeat(size, parts)
        head = np.repeat(head, parts) + back * RUN
        size = np.minimum(total - back * RUN, RUN)
    return head, size, low[head]


def gather(text: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ``text`` from ``head``, ``size`` of each, in one run."""
    body = memoryview(np.ascontiguousarray(text)).cast("B")
    return np.frombuffer(b"".join([body[a:b] for a, b in zip(head.tolist(), (head + size).tolist())]), np.uint8)


def content_hash(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece of ``data``: a sum of hashed bytes with a weight for the place in the piece."""
    out, at = [], 0
    for first, last in blocks(size, BLOCK):
        own = size[first:last]
        ends = np.cumsum(own)
        x = (data[at : at + ends[-1]].astype(np.uint64) + np.uint64(1)) * M1
        x ^= ranges(np.zeros(len(own), np.int64), own).view(np.uint64) * M2
        x *= M1
        x ^= x >> np.uint64(29)
        x *= M2
        out.append(np.add.reduceat(x, ends - own))
        at += int(ends[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def distinct(data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, whether it is the first of its content (least document, then earliest), and the number of that first.

    Contents are compared byte by byte; pieces whose hashes agree but whose bytes do not stay apart.
    """
    n = len(size)
    key = content_hash(data, size)
    order = np.lexsort((np.arange(n), doc, size, key))
    same = np.zeros(n, bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (size[order][1:] == size[order][:-1])
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(n)))]
    head = np.cumsum(size) - size
    first = np.arange(n)
    copy = order[same]
    if len(copy):
        mine, theirs = gather(data, head[copy], size[copy]), gather(data, head[leader[same]], size[copy])
        ends = np.cumsum(size[copy])
        equal = np.logical_and.reduceat(mine == theirs, ends - size[copy])
        first[copy[equal]] = leader[same][equal]
    return first == np.arange(n), first


def pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for t in dtypes:
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(np.frombuffer(body, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of ``text`` in order, by their first ``depth`` bytes at least; equal ones stand together."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # stage one: suffixes smaller than their successor; equal neighbours are as what follows them
    change = np.append(text[1:] != text[:-1], True)
    next_change = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    following = np.append(text, 0)[next_change + 1]
    small = (text[next_change] < following) & (next_change < n - 1)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    word = words_at(padded)
    own = np.flatnonzero(small)
    key = word[own].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    own, key = own[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    for at in range(8, depth, 8):
        tie = ~new
        tie[:-1] |= ~new[1:]
        rows = np.flatnonzero(tie)
        if not len(rows):
            break
        part, group = own[rows], np.cumsum(new)[rows]
        key = word[part + at].astype(np.uint64)
        order = np.lexsort((key, group))
        own[rows] = part[order]
        key = key[order]
        new[rows[1:]] |= key[1:] != key[:-1]
    # stage two: induce the others, one bucket of first bytes after the other
    starts = np.searchsorted(text[own], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def scan(placed: np.ndarray, byte: int, same: bool) -> np.ndarray:
        """Put what is before ``placed`` into later buckets; return what goes into this one."""
        before = placed[placed > 0] - 1
        before = before[~small[before]]
        first = text[before]
        up = before[first > byte]
        byte_of = text[up]
        order = np.argsort(byte_of, kind="stable")
        up, cuts = up[order], np.searchsorted(byte_of[order], np.arange(257))
        for b in np.unique(byte_of).tolist():
            induced[b].append(up[cuts[b] : cuts[b + 1]])
        return before[first == byte] if same else before[:0]

    if not small[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, byte, True)
        direct = own[starts[byte] : starts[byte + 1]]
        if len(direct):
            out.append(direct)
            scan(direct, byte, False)
        induced[byte] = []
    return np.concatenate(out)


def equal_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of the suffixes at a and at b, pair by pair, counted up to ``depth`` bytes."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    word = words_at(padded)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        x = (word[a[live] + at].astype(np.uint64)) ^ (word[b[live] + at].astype(np.uint64))
        full = x == 0
        bits = np.frexp((x[~full] >> np.uint64(8)).astype(np.float64))[1] + 8  # bit length, to the byte
        bits = np.where(x[~full] < 256, np.frexp(x[~full].astype(np.float64))[1], bits)
        out[live[~full]] = at + (64 - bits) // 8
        live = live[full]
    out[live] = depth
    return np.minimum(out, depth)


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of M1 and of its inverse, as many as a block of pieces needs."""
    n = BLOCK + RUN + LENGTH
    return np.multiply.accumulate(np.full(n, M1)), np.multiply.accumulate(np.full(n, pow(int(M1), -1, 1 << 64), np.uint64))


def string_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each LENGTH-byte string of each piece, piece after piece."""
    out = []
    begin = 0
    for first, last in blocks(size, BLOCK):
        own = size[first:last]
        part = data[begin : begin + int(own.sum())]
        begin += len(part)
        power, back = (p[: len(part)] for p in powers())
        x = (part.astype(np.uint64) + np.uint64(1)) * M2
        total = np.append(np.uint64(0), np.cumsum((x ^ (x >> np.uint64(29))) * power, dtype=np.uint64))
        head = np.cumsum(own) - own
        at = ranges(head, own - LENGTH + 1)
        out.append((total[at + LENGTH] - total[at]) * back[at])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def blocks(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, first = np.cumsum(size), 0
    while first < len(size):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right"))
        last = max(last, first + 1)
        yield first, last
        first = last


def recurring(h: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once: each round settles those that share a slot with their equal."""
    hit = np.zeros(len(h), bool)
    live = np.arange(len(h), dtype=np.int64)
    bits = max(10, int(len(h)).bit_length() + 1)
    winner = np.zeros(1 << bits, np.int32)
    turn = 0
    while len(live):
        turn += 1
        salt = np.uint64(turn * int(M2) % (1 << 64))
        slot = (((h[live] ^ (h[live] >> np.uint64(32))) * M1 + salt) * M2) >> np.uint64(64 - bits)
        winner[slot] = live
        best = winner[slot].astype(np.int64)
        same = h[best] == h[live]
        twin = same & (best != live)
        hit[live[twin]] = True
        hit[best[twin]] = True
        live = live[~same]
    return hit


def reduce_bucket(data: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, shift: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed spans (document, start, end) of the segments of one bucket. ``doc >> shift`` is a document's rank."""
    n = size - LENGTH + 1
    hit = recurring(string_hashes(data, size))
    begin = np.cumsum(n) - n
    some = np.logical_or.reduceat(hit, begin) if len(n) else np.zeros(0, bool)
    # of the segments with a recurring string, what lies between the first and the last such string
    at = np.flatnonzero(hit)
    piece = np.searchsorted(begin, at, side="right") - 1
    new = np.append(True, piece[1:] != piece[:-1]) if len(at) else np.zeros(0, bool)
    first = at[new] - begin[some]
    last = at[np.append(new[1:], True)] - begin[some] if len(at) else first
    head = (np.cumsum(size) - size)[some] + first
    doc, start, size = doc[some], start[some] + first, last - first + LENGTH
    data = gather(data, head, size)
    lead, of = distinct(data, size, doc)
    text, owner, strings = data[np.repeat(lead, size)], doc[lead], size[lead] - LENGTH + 1
    places = ranges(np.cumsum(size[lead]) - size[lead], strings)  # where a whole string begins in text
    doc_at = np.full(len(text), -1, np.int64)
    doc_at[places] = np.repeat(np.arange(len(owner)), strings)
    order = suffix_array(text)
    order = order[doc_at[order] >= 0]
    run = np.append(True, equal_prefix(text, order[:-1], order[1:]) < LENGTH) if len(order) else np.zeros(0, bool)
    holder = owner[doc_at[order]]
    least = np.minimum.reduceat(holder, np.flatnonzero(run)) if len(order) else holder
    removed = np.zeros(len(text), bool)
    removed[order] = least[np.cumsum(run) - 1] >> shift < holder >> shift
    # every segment: as its first, or wholly if its document's rank is larger than the first's
    number = np.cumsum(lead) - 1
    head = (np.cumsum(size[lead]) - size[lead])[number[of]]
    flags = removed[ranges(head, size - LENGTH + 1)] | np.repeat(doc >> shift > doc[of] >> shift, size - LENGTH + 1)
    where = ranges(start, size - LENGTH + 1)
    who = np.repeat(doc, size - LENGTH + 1)
    where, who = where[flags], who[flags]
    return join_spans(who, where, where + LENGTH)


def ranges(head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """head, head + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(head - (ends - size), size)


def join_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document and start, those that touch or overlap as one."""
    if not len(doc):
        return doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    edge = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(edge) - 1
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * room) - group * room  # of one document only
    edge[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(edge)
    return doc[head], start[head], reach[np.append(head[1:], len(doc)) - 1]


def deal(key: np.ndarray, n: int) -> np.ndarray:
    return (((key.astype(np.uint64) ^ (key.astype(np.uint64) >> np.uint64(32))) * M2) >> np.uint64(33)).astype(np.int64) % n


def parts(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number that occurs, and its places in order."""
    order = np.argsort(number, kind="stable")
    own = number[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
    for a, b in zip(heads, np.append(heads[1:], len(own))):
        yield int(own[a]), order[a:b]


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """``(doc_id, text, key)``, keys naming one text each, and by how many bits to shift a key for its rank.

    Where ids are unique and not null they are keys and ranks. Otherwise distinct pairs of doc_id
    (null last) and hash of the text are numbered; a key holds the first number of its doc_id, which
    is the rank, and in its last bits the number from there.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.col("doc_id"))
    odd = plain.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return plain, 0
    hashed = plain.withColumn("h", F.xxhash64("text"))
    ids = hashed.select("doc_id", "h").distinct().withColumn("last", F.col("doc_id").isNull())
    ids = stage(spark, ids.repartitionByRange("last", "doc_id", "h").sortWithinPartitions("last", "doc_id", "h").withColumn("part", F.spark_partition_id()), "ids")
    before = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    own = F.row_number().over(W.partitionBy("part").orderBy("last", "doc_id", "h"))
    ids = stage(spark, ids.join(before, "part").select(F.col("doc_id").alias("i"), F.col("h").alias("g"), (F.col("before") + own).alias("number")), "ids")
    first = ids.groupBy(F.col("i").alias("j")).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    shift = int(first.agg(F.max("n")).first()[0]).bit_length()
    ids = ids.join(first, F.col("i").eqNullSafe(F.col("j"))).select("i", "g", (F.shiftleft("first", shift) + F.col("number") - F.col("first")).alias("number"))
    on = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    return hashed.join(ids, on).select("doc_id", "text", F.col("number").alias("key")), shift


def deduplicated(spark: SparkSession, docs: DataFrame, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, and ``kept`` (the bytes left) if ``texts``.

    Null texts are empty; texts under LENGTH bytes stay whole. Rows with one doc_id are cut by rows
    with a smaller one and not by each other; null counts as one doc_id, larger than all others.
    Texts of any length are cut as a whole. Extra columns are not read; an empty table gives no rows.
    """
    source, shift = numbered(spark, docs)
    volume = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, n_groups = max(1, -(-volume // BUCKET_BYTES)), max(1, -(-volume // GROUP_BYTES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            text, starts = flat(batch.column("text"))
            ids = np.asarray(batch.column("key")).astype(np.int64)
            head, strings, low = segments(text, starts)
            size = strings + LENGTH - 1
            row = np.searchsorted(starts, head, side="right") - 1
            doc, at = ids[row], head - starts[row]
            data = gather(text, head, size)
            lead, of = distinct(data, size, doc)
            copy = ~lead & (doc >> shift > doc[of] >> shift)
            out = []
            if copy.any():
                spans = join_spans(doc[copy], at[copy], at[copy] + size[copy])
                out.append((int(deal(ids[:1], n_buckets)[0]), None, pack(*(x.astype("<i8") for x in spans))))
            for b, own in parts(np.where(copy, n_buckets, deal(low, n_buckets))):
                if b < n_buckets:
                    blob = pack(gather(text, head[own], size[own]), *(np.diff(x[own], prepend=0).astype(t) for x, t in ((size, "<i2"), (doc, "<i8"), (at, "<i4"))))
                    out.append((b, blob, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.binary(), pa.binary()])], names=["bucket", "segments", "spans"])

    def dealt(spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        doc, start, end = spans
        out = [(g, pack(doc[own].astype("<i8"), start[own].astype("<i4"), end[own].astype("<i4"))) for g, own in parts(deal(doc, n_groups))]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["group", "spans"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            parts = [unpack(b, "u1", "<i2", "<i8", "<i4") for b in held]
            held.clear()
            data = np.concatenate([p[0] for p in parts])
            size, doc, at = (np.concatenate([np.cumsum(p[k], dtype=np.int64) for p in parts]) for k in (1, 2, 3))
            parts.clear()
            yield dealt(reduce_bucket(data, size, doc, at, shift))

        for batch in batches:
            for b, blob, spans in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segments", "spans"))):
                if b != now and held:
                    yield from finish()
                now = b
                if blob is not None:
                    held.append(blob)
                if spans is not None:
                    yield dealt(tuple(unpack(spans, "<i8", "<i8", "<i8")))
        if held:
            yield from finish()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            text, starts = flat(batch.column("text"))
            key = np.asarray(batch.column("key")).astype(np.int64)
            doc = batch.column("doc_id")
            out = []
            null, doc = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0)).astype(np.int64)
            for g, own in parts(deal(key, n_groups)):
                size = np.diff(starts)[own]
                out.append((g, pack(gather(text, starts[own], size), size.astype("<i8"), key[own], doc[own], null[own].astype("u1"))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["group", "docs"])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def remove(docs: pa.Table, spans: pa.Table) -> pa.Table:
        cut = [unpack(b, "<i8", "<i4", "<i4") for b in spans.column("spans").to_pylist()]
        who, a, b = (np.concatenate(c).astype(np.int64) for c in zip(*cut)) if cut else (np.zeros(0, np.int64),) * 3
        who, a, b = join_spans(who, a, b)
        rows: list[tuple] = []
        for blob in docs.column("docs").to_pylist():
            text, size, key, doc, null = unpack(blob, "u1", "<i8", "<i8", "<i8", "u1")
            ends = np.cumsum(size)
            lo, hi = np.searchsorted(who, key, side="left"), np.searchsorted(who, key, side="right")
            for k in range(len(size)):
                body = text[ends[k] - size[k] : ends[k]].tobytes()
                spans_here = list(zip(a[lo[k] : hi[k]].tolist(), b[lo[k] : hi[k]].tolist()))
                edges = [0, *(x for s in spans_here for x in s), len(body)]
                left = b"".join([body[i:j] for i, j in zip(edges[::2], edges[1::2])])
                row = (None if null[k] else int(doc[k]), len(body), len(body) - len(left), len(spans_here), hashlib.sha256(left).hexdigest())
                rows.append((*row, left) if texts else row)
        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    keyed = source.select("key", "text")
    buckets = keyed.mapInArrow(route, "bucket int, segments binary, spans binary").repartition(int(min(n_buckets, PARTITIONS)), "bucket").sortWithinPartitions("bucket")
    cuts = buckets.mapInArrow(reduce, "group int, spans binary")
    packs = source.select("key", "doc_id", "text").mapInArrow(packed, "group int, docs binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return packs.groupBy("group").cogroup(cuts.groupBy("group")).applyInArrow(remove, schema)
