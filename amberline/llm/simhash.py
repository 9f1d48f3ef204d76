"""SimHash near-duplicate groups, candidates by pigeonring filtering.

A fingerprint is cut into a ring of ``max_bits + 1`` segments. If two fingerprints differ in at
most ``max_bits`` bits, some segment starts a chain whose first l segments differ in at most
l * max_bits / (max_bits + 1) bits together, for every l (the strong pigeonhole form on a ring):
0 bits in the first segment, at most 1 in the first two, at most 2 in the first three, and so on.
The first two links of the chain are an exact key: the first segment as it is and the second with
at most one bit flipped. So one side files its own two-segment keys, the other side also the keys
with one bit of the second segment flipped, and only rows that meet under a key go on to the longer
chain tests and then to the full Hamming count.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import connected_components, drop, freeing, hidden, raw_bytes, settle, slices, stage, stage_at, text_or_empty, trim

SEED = 42
#: Base rows of a key beyond which its bucket is split into blocks.
HOT_KEY = 4096


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprint(text: bytes, width: int) -> int:
    """A bit is 1 if it is 1 in more than half of the shingle hashes; no words give 0."""
    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    rows = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(rows), 65536):
        ones += np.unpackbits(rows[first : first + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``fp`` (the 64 bits as a signed long) of each row of ``docs``."""
    source = docs.select(*carry, text_or_empty().alias(hidden(carry, "text")))
    schema = docs.select(*carry).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1, 4 << 20):
            made = [fingerprint(t, width) for t in raw_bytes(batch.column(-1))]
            fp = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=schema.names)

    return source.mapInArrow(run, schema)


def ring(max_bits: int) -> tuple[list[int], list[int]]:
    """Widths and offsets of the segments."""
    m = max_bits + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return widths, [sum(widths[:i]) for i in range(m)]


def neighbours(key: Column, max_bits: int) -> Column:
    """The keys that differ from ``key`` in one bit of the second segment."""
    widths, _ = ring(max_bits)
    m = len(widths)
    flips = lambda i: F.array(*(key.bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(widths[(i + 1) % m])))
    out = flips(m - 1)
    for i in range(m - 1):
        out = F.when(F.shiftrightunsigned(key, 56) == i, flips(i)).otherwise(out)
    return out


def ring_keys(nodes: DataFrame, max_bits: int, flipped: bool = True) -> DataFrame:
    """Rows ``(key, fp, own)``: per segment its own two-segment key, and those with one bit of the second flipped."""
    widths, offsets = ring(max_bits)
    m = len(widths)
    rows = []
    for i in range(m):
        j = (i + 1) % m
        first = F.shiftrightunsigned("fp", offsets[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))
        second = F.shiftrightunsigned("fp", offsets[j]).bitwiseAND(F.lit((1 << widths[j]) - 1))
        key = F.shiftleft(F.lit(i).cast("long"), 56).bitwiseOR(F.shiftleft(first.cast("long"), widths[j])).bitwiseOR(second.cast("long"))
        rows.append(F.struct(key.alias("key"), F.lit(True).alias("own")))
        if flipped:
            rows += [F.struct(key.bitwiseXOR(F.lit(1 << b).cast("long")).alias("key"), F.lit(False).alias("own")) for b in range(widths[j])]
    return nodes.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.key", "fp", "r.own")


def _chain_ok(start: np.ndarray, diff: np.ndarray, max_bits: int) -> np.ndarray:
    """The longer chain tests (three segments and up), then the full count."""
    widths, offsets = ring(max_bits)
    m = len(widths)
    ok = np.bitwise_count(diff) <= max_bits
    masks = np.array([((1 << w) - 1) << o for w, o in zip(widths, offsets)], dtype=np.uint64)
    for length in range(3, m):
        cover = np.zeros(m, np.uint64)
        for k in range(length):
            cover |= np.roll(masks, -k)
        ok &= np.bitwise_count(diff & cover[start]) <= length * max_bits // m
    return ok


def _forest(fps: np.ndarray, own: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one large bucket: each search step compares one row with all rows not yet reached."""
    left = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            diff = fps[left] ^ fps[at]
            hit = _chain_ok(np.full(len(left), start), diff, max_bits) & (own[left] | own[at])
            found = left[hit]
            out += [(int(fps[at]), int(fps[x])) for x in found]
            queue += found.tolist()
            left = left[~hit]
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, own: np.ndarray, max_bits: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that share a key; ``keys`` is sorted. Large buckets give a spanning forest, small ones their pairs."""
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[head, len(keys)])
    useful = (size > 1) & (np.add.reduceat(own.astype(np.int64), head) > 0)
    left, right = [], []
    room = np.repeat(np.where(useful & (size <= small), head + size, 0), size)  # end of a row's small bucket
    row = np.arange(len(keys))
    live = row[room > 0]
    for step in range(1, small):
        live = live[live + step < room[live]]
        if not len(live):
            break
        a, b = live, live + step
        keep = (own[a] | own[b]) & (fps[a] != fps[b])
        a, b = a[keep], b[keep]
        ok = _chain_ok((keys[a] >> np.uint64(56)).astype(np.int64), fps[a] ^ fps[b], max_bits)
        left.append(fps[a][ok])
        right.append(fps[b][ok])
    for k in np.flatnonzero(useful & (size > small)):
        part = slice(head[k], head[k] + size[k])
        order = np.lexsort((~own[part], fps[part]))
        f, o = fps[part][order], own[part][order]
        first = np.r_[True, f[1:] != f[:-1]]  # a row's own key comes before its flipped ones
        pairs = _forest(f[first], o[first], int(keys[head[k]] >> np.uint64(56)), max_bits)
        if pairs:
            p = np.array(pairs, dtype=np.uint64)
            left.append(p[:, 0])
            right.append(p[:, 1])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def links(spark: SparkSession, nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges ``(src, dst)`` between distinct fingerprints, enough to connect all that differ in at most ``max_bits`` bits.

    A bucket with over HOT_KEY rows, own or flipped, is split: its rows are dealt to blocks, and its
    own rows, with which every pair has to do, are copied to each block, so that all pairs still meet.
    Own rows of a key are flipped rows of its neighbours, so counts of own rows by key give the
    flipped ones too. They are added up, not joined: Spark sizes an exploded table by the rows before
    it, and would broadcast it.
    """
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be 1 to 15")
    keyed = ring_keys(nodes, max_bits)
    own = stage(spark, ring_keys(nodes, max_bits, flipped=False).groupBy("key").count(), "ownkeys")
    flips = own.select(F.explode(neighbours(F.col("key"), max_bits)).alias("key"), "count", F.lit(0).alias("own"))
    rows = own.select("key", "count", F.lit(1).alias("own")).union(flips).groupBy("key").agg(F.sum("count").alias("rows"), F.max("own").alias("own"))
    hot = rows.where((F.col("own") == 1) & (F.col("rows") > HOT_KEY))  # a key without own rows has no pairs
    hot = stage(spark, hot.select("key", F.ceil(F.col("rows") / HOT_KEY).cast("int").alias("blocks")), "hotkeys")
    if hot.limit(1).count():
        keyed = keyed.join(hot, "key", "left").select(
            "key", "fp", "own", F.coalesce("blocks", F.lit(1)).alias("blocks")
        )
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        keyed = keyed.select(
            "key", "fp", "own",
            F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))).alias("block"),
        )
    else:
        keyed = keyed.withColumn("block", F.lit(0))
    ordered = keyed.repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            keys, fps, own, block = (np.concatenate(x) for x in zip(*parts))
            a, b = bucket_links(_regroup(keys, block) if block.any() else keys, fps, own, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            part = (
                np.asarray(batch.column("key")).view(np.uint64), np.asarray(batch.column("fp")).view(np.uint64),
                batch.column("own").to_numpy(zero_copy_only=False), np.asarray(batch.column("block")),
            )
            if not len(part[0]):
                continue
            last = np.flatnonzero((part[0] != part[0][-1]) | (part[3] != part[3][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:  # all but the last bucket are complete
                yield from emit([*held, tuple(x[:cut] for x in part)])
                held = []
            elif held and (held[-1][0][-1] != part[0][0] or held[-1][3][-1] != part[3][0]):
                yield from emit(held)
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield from emit(held)

    return ordered.mapInArrow(run, "src long, dst long").distinct()


def _regroup(keys: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Keys that also differ by block; the segment stays in the top byte, which is all that the link test reads of a key."""
    new = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])]).astype(np.uint64)
    return (keys & np.uint64(0xFF << 56)) | new


def components(spark: SparkSession, docs: DataFrame, width: int = 4, max_bits: int = 4, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, ``fp`` and ``component_id``: the smallest doc_id that links reach from a row.

    Null and empty texts have fingerprint 0 and link like any other. Exact copies share a
    fingerprint and meet as one node. A null doc_id never is the smallest; a group of only such
    rows has a null component_id. Extra columns are ignored; an empty table gives no rows.
    """
    carry = carry or ["doc_id"]
    made = stage(spark, fingerprints(docs, width, carry), "fingerprints")
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(spark, links(spark, nodes.select("fp"), max_bits))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select(*carry, "fp", "component_id")


# Similarity groups: texts whose sets of shingles have at least a given Jaccard similarity, found exactly.

WORDS64 = 4
BITS = 64 * WORDS64
#: Rows that the order of shingles is taken from, and shingles that it ranks; neither changes a result.
SAMPLE, RANKED = 16384, 1 << 16
#: Rows of a bucket up to which all its pairs are candidates at once.
SMALL = 8
#: Bits in which the fingerprints of candidates of the first step may differ; it changes no result.
RING_BITS = 4
SKETCH = [f"b{k}" for k in range(WORDS64)]
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingles of a text as ascending 64-bit hashes, made from hashes of its words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * M1 + own[k : len(own) - width + 1 + k]
    total = (total ^ (total >> np.uint64(29))) * M2
    return np.unique(total ^ (total >> np.uint64(32)))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def parity(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, the parity of the count of shingles in each bin: two sets differ in no fewer shingles than bits."""
    return np.packbits((np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long."""
    ones = np.zeros(64, np.int64)
    for first in range(0, len(shingles), 65536):
        ones += np.unpackbits(shingles[first : first + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def ring_pairs(spark: SparkSession, nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(src, dst)`` of ``nodes(node, fp)`` that pigeonring over their fingerprints names.

    The least node of a fingerprint stands for it: with the other nodes of the same one, and with those that ``links`` finds for others.
    """
    by_fp = stage(spark, nodes.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    same = nodes.join(by_fp, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda fp, name: by_fp.select(F.col("fp").alias(fp), F.col("least").alias(name))
    other = links(spark, by_fp.select("fp"), max_bits).join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b")
    return same.union(other).select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()


class Jaccard:
    """Tests of J >= p / q in whole numbers, on sets that are ordered by (times met in a sample, hash).

    Two such sets meet in their first n - ceil(n p / q) + 1 shingles. At the first one that both
    have, no more than the rest of either can follow, so what ``near`` and ``close`` refuse in every
    common bucket is not similar.
    """

    def __init__(self, similarity: float):
        share = Fraction(str(similarity))
        if not 0 < share <= 1:
            raise ValueError("similarity must be over 0 and at most 1")
        self.p, self.q = share.numerator, share.denominator
        self.hashes, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rank(self, hashes: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.times = hashes[order], times[order]

    def prefix(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if len(self.hashes) and n:
            at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
            shingles = shingles[np.argsort(np.where(self.hashes[at] == shingles, self.times[at], 0), kind="stable")]
        return shingles[: n + 1 + (-n * self.p // self.q)] if n else shingles

    def enough(self, common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether ``common`` shingles of two sets of together ``sizes`` give J >= p / q."""
        return (self.p + self.q) * common >= self.p * sizes

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.q * min(len(a), len(b)) < self.p * max(len(a), len(b)):
            return False
        return bool(self.enough(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)))

    def near(self, size: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """By sizes and places only."""
        ok = self.enough(np.minimum(size[a] - place[a], size[b] - place[b]), size[a] + size[b])
        return ok & (self.q * np.minimum(size[a], size[b]) >= self.p * np.maximum(size[a], size[b]))

    def sketched(self) -> Column:
        """The same bound on the sketches of a pair ``size_a, b0_a, ..., size_b, b0_b, ...``, in SQL."""
        apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in SKETCH[1:]), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
        both = F.col("size_a") + F.col("size_b")
        return (self.p + self.q) * F.floor((both - apart) / 2) >= self.p * both

    def close(self, size: np.ndarray, place: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """By sketches too."""
        ok = self.near(size, place, a, b)
        both, live = size[a] + size[b], np.flatnonzero(ok)
        other = bits[b] if np.ndim(b) == 0 else bits[b[live]]
        apart = np.bitwise_count(bits[a[live]] ^ other).sum(axis=1, dtype=np.int64)
        ok[live] = self.enough((both[live] - apart) // 2, both[live])
        return ok

    def forest(self, own: np.ndarray, node: np.ndarray, *row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Close pairs that span all close pairs among these rows; a pair needs one row that the block owns."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(node))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            for at in queue:
                hit = self.close(*row, left, at) & (own[left] | own[at])
                found, left = left[hit], left[~hit]
                out.append((np.full(len(found), node[at]), node[found]))
                queue += found.tolist()
                if not len(left):
                    break
        return tuple(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (zip(*out) if out else ([], [])))

    def nearest(self, own: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
        """For each row outside the most frequent root, the close row of another root whose sketch differs least for their sizes."""
        _, group, count = np.unique(root, return_inverse=True, return_counts=True)
        for at in np.flatnonzero(group != count.argmax()):
            other = np.flatnonzero((root != root[at]) & (own | own[at]))
            other = other[self.close(size, place, bits, other, at)] if len(other) else other
            if len(other):
                apart = np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1, dtype=np.int64)
                yield node[at], node[other[np.argmin(apart / (size[other] + size[at]))]]

    def across(self, own: np.ndarray, node: np.ndarray, root: np.ndarray, *row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All close pairs of rows with different roots."""
        for at in range(len(node) - 1):
            later = np.arange(at + 1, len(node))
            later = later[(root[later] != root[at]) & (own[later] | own[at])]
            found = later[self.close(*row, later, at)] if len(later) else later
            if len(found):
                yield np.full(len(found), node[at]), node[found]


#: A bucket is the rows of a key and a block; rows come sorted by key, block and node.
_BUCKET = "key long, block int, own boolean, node long, size long, place long"
_COLUMNS = ["key", "block", "own", "node", "size", "place"]


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Heads of buckets and columns ``names`` of whole buckets of more than one node; a node that came more than once counts once."""
    held: list[list[np.ndarray]] = []

    def whole(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        cols = [np.concatenate(c) for c in zip(*parts)]
        new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
        keep = new | np.r_[True, cols[3][1:] != cols[3][:-1]]
        cols, new = [c[keep] for c in cols], new[keep]
        alone = new & np.r_[new[1:], True]
        return np.flatnonzero(new[~alone]), [c[~alone] for c in cols]

    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held and (held[-1][0][-1] != part[0][0] or held[-1][1][-1] != part[1][0]):
            yield whole(held)
            held = []
        last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:  # all but the last bucket are complete
            yield whole([*held, [c[:cut] for c in part]])
            held = []
        held.append([c[cut:] for c in part])
    if held:
        yield whole(held)


def similar_groups(spark: SparkSession, docs: DataFrame, ident: list[str], width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``ident`` columns and ``root`` of each row of ``docs``: rows that chains of similar texts connect share a root.

    ``ident`` are columns of which equal values mean equal texts. Two texts are similar if the
    Jaccard similarity of their sets of shingles is at least ``similarity``. First candidates come from
    pigeonring over SimHash fingerprints of these sets. A bit distance only estimates a similarity, so an exact
    join finds the rest: there candidates meet under a shingle of their prefixes (see Jaccard), and those that links connect
    by then are left out. Each candidate is verified on both texts before it links. In a
    bucket of over SMALL texts only a forest of candidates is verified first, then the likeliest
    candidate of each text that is still apart (most texts of a group then share a root), and a last
    round takes all candidates that are apart even so. Null texts are empty; texts without words form one
    group; an empty table gives no rows; columns besides ``ident`` and ``text`` are not read.
    """
    test = Jaccard(similarity)
    own = ["node", "size", *SKETCH]
    source = docs.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(ident)), text_or_empty().alias("text"))
    keyed_by = source.columns[:-1]
    schema = source.drop("text").schema.add("node", "long").add("size", "long")
    for b in [*SKETCH, "fp"]:
        schema = schema.add(b, "long")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("near_duplicates")
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingle_set(t, width) for t in raw_bytes(batch.column("text"))]
            bits = np.stack([parity(x) for x in sets], axis=1)
            made = [pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, bits), pa.array(list(map(set_fingerprint, sets)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)
        trim()

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for t in raw_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width).view(np.int64))], names=["key"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # texts that this task has sent last, so that their copies are not sent again
        for batch in slices(batches, "text", 1 << 20):
            made = []
            for t in raw_bytes(batch.column("text")):
                shingles = shingle_set(t, width)
                node, first = _node(shingles), test.prefix(shingles)
                if len(met) > 1 << 16:
                    met.clear()
                if node not in met:
                    met.add(node)
                    made.append((first.view(np.int64), np.full(len(first), node), np.full(len(first), len(shingles)), np.arange(len(first))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*made)], names=["key", "node", "size", "place"])
        trim()

    pair = lambda x, y: [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))]

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of small buckets as (src, dst), and the rows of larger ones with null there."""
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("own", pa.bool_()), ("node", pa.int64()), ("size", pa.int64()), ("place", pa.int64())])
        for head, cols in _buckets(batches, _COLUMNS):
            if not len(head):
                continue
            key, _, mine, node, *row = cols
            size = np.diff(np.r_[head, len(key)])
            room = np.repeat(np.where(size <= SMALL, head + size, 0), size)
            live, found = np.flatnonzero(room), []
            for step in range(1, SMALL):
                live = live[live + step < room[live]]
                if not len(live):
                    break
                a = live[mine[live] | mine[live + step]]
                a = a[test.near(*row, a, a + step)]
                found.append((node[a], node[a + step]))
            if found and sum(len(a) for a, _ in found):
                a, b = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([*pair(a, b), *(pa.nulls(len(a), k) for k in schema.types[2:])], schema=schema)
            large = np.flatnonzero(np.repeat(size > SMALL, size))
            if len(large):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(large), k) for k in schema.types[:2]), *(pa.array(c[large], t) for c, t in zip(cols, schema.types[2:]))], schema=schema)

    def large_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, (key, _, mine, node, size, place, *bits) in _buckets(batches, [*_COLUMNS, *SKETCH]):
            bits = np.stack(bits, axis=1).view(np.uint64) if len(head) else bits
            for a, z in zip(head, np.r_[head[1:], len(key)].astype(np.int64)):
                x, y = test.forest(mine[a:z], node[a:z], size[a:z], place[a:z], bits[a:z])
                if len(x):
                    yield pa.RecordBatch.from_arrays(pair(x, y), names=["src", "dst"])

    def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, (key, _, mine, node, size, place, root, *bits) in _buckets(batches, [*_COLUMNS, "root", *SKETCH]):
            bits = np.stack(bits, axis=1).view(np.uint64) if len(head) else bits
            for a, z in zip(head, np.r_[head[1:], len(key)].astype(np.int64)):
                if (root[a:z] != root[a]).any():
                    found = list(test.nearest(mine[a:z], node[a:z], root[a:z], size[a:z], place[a:z], bits[a:z]))
                    if found:
                        yield pa.RecordBatch.from_arrays(pair(*np.array(found, np.int64).T), names=["src", "dst"])

    def last_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, (key, _, mine, node, size, place, root, *bits) in _buckets(batches, [*_COLUMNS, "root", *SKETCH]):
            bits = np.stack(bits, axis=1).view(np.uint64) if len(head) else bits
            for a, z in zip(head, np.r_[head[1:], len(key)].astype(np.int64)):
                if (root[a:z] != root[a]).any():
                    for x, y in test.across(mine[a:z], node[a:z], root[a:z], size[a:z], place[a:z], bits[a:z]):
                        yield pa.RecordBatch.from_arrays(pair(x, y), names=["src", "dst"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            src, dst = batch.column("src").to_pylist(), batch.column("dst").to_pylist()
            for k, ends in enumerate(zip(src, dst)):
                for at, name in zip(ends, ("text_a", "text_b")):
                    if at not in sets:
                        if len(sets) > 256:
                            sets.clear()
                        sets[at] = shingle_set(batch.column(name)[k].as_buffer().to_pybytes(), width)
                a, b = (sets[x] if x in sets else shingle_set(batch.column(n)[k].as_buffer().to_pybytes(), width) for x, n in zip(ends, ("text_a", "text_b")))
                keep.append(test.similar(a, b))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    def both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
        """``pairs(src, dst)`` with the other columns of ``table(node, ...)`` for each end."""
        for end, mark in (("src", "a"), ("dst", "b")):
            pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{mark}") for c in table.columns if c != "node")), end)
        return pairs

    made = stage(spark, source.mapInArrow(named, schema), "nodes")
    nodes = stage(spark, made.groupBy("node").agg(*(F.any_value(c).alias(c) for c in [*own[1:], "fp"]), F.min(F.struct(*keyed_by)).alias("first")), "nodes")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        needed = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        needed = nodes.join(needed, "node", "left_semi").select("node", "first.*")
        texts = source.join(needed, keyed_by).groupBy("node").agg(F.any_value("text").alias("text"))
        texts, path = stage_at(spark, texts, f"{name}-texts")
        # merged: a file of texts that compress well is far smaller than what a broadcast of it would hold
        links = stage(spark, both_ends(pairs, texts.hint("merge")).select("src", "dst", "text_a", "text_b").mapInArrow(verify, "src long, dst long"), name)
        drop(spark, path)
        return links

    def sketched(pairs: DataFrame) -> DataFrame:
        return both_ends(pairs.distinct(), nodes.select(*own)).where(test.sketched()).select("src", "dst")

    def apart(pairs: DataFrame) -> DataFrame:
        """``pairs`` whose ends no chain of links connects so far."""
        for end in ("src", "dst"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        return pairs.where(F.coalesce("src_root", "src") != F.coalesce("dst_root", "dst")).select("src", "dst")

    edges = verified(stage(spark, sketched(ring_pairs(spark, nodes.select("node", "fp"), RING_BITS)), "ring"), "ring-links")
    labels = connected_components(spark, edges)
    every = max(1, made.count() // SAMPLE)
    sample = source.where(F.pmod(F.xxhash64(*keyed_by), F.lit(every)) == 0)
    sample = stage(spark, sample.dropDuplicates(keyed_by).select("text"), "sample")
    often = sample.mapInArrow(all_shingles, "key long").groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(RANKED).toArrow()
    test.rank(np.array(often.column("key").to_numpy(), np.int64).view(np.uint64), np.array(often.column("count").to_numpy(), np.int64))
    kind = "key long, node long, size long, place long"
    hot = sample.mapInArrow(keys, kind).groupBy("key").count().where(F.col("count") * every > HOT_KEY)
    hot = stage(spark, hot.select("key", F.ceil(F.col("count") * every / HOT_KEY).cast("int").alias("blocks")), "hotkeys")
    keyed = source.select("text").mapInArrow(keys, kind)
    if hot.limit(1).count():
        spread = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = spread.withColumn("own", F.pmod("node", F.col("blocks")) == F.col("block"))
    else:
        keyed = keyed.withColumns({"block": F.lit(0), "own": F.lit(True)})
    bucketed = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    # by node within a key: a dense group then has the same first row under each key, and the same links
    met, met_at = stage_at(spark, bucketed(keyed.select(*_COLUMNS)).mapInArrow(first_round, f"src long, dst long, {_BUCKET}"), "met")
    large = met.where("src is null").select(*_COLUMNS)
    if large.limit(1).count():
        large, large_at = stage_at(spark, large.join(nodes.select("node", *SKETCH).hint("merge"), "node"), "large")
        dense = bucketed(large.select(*_COLUMNS, *SKETCH)).mapInArrow(large_buckets, "src long, dst long")
        pairs = stage(spark, apart(sketched(met.where("src is not null").select("src", "dst")).union(dense).distinct()), "pairs")
        drop(spark, met_at)
        edges = edges.union(verified(pairs, "links"))
        labels = connected_components(spark, edges)
        for take in (likeliest, last_round):
            rooted = large.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            found = bucketed(rooted.select(*_COLUMNS, "root", *SKETCH)).mapInArrow(take, "src long, dst long")
            more = stage(spark, found.distinct().join(pairs, ["src", "dst"], "left_anti"), "pairs")
            if more.limit(1).count():
                pairs, edges = pairs.union(more), edges.union(verified(more, "links"))
                labels = connected_components(spark, edges)
        drop(spark, large_at)
    else:
        pairs = stage(spark, apart(sketched(met.where("src is not null").select("src", "dst"))), "pairs")
        drop(spark, met_at)
        labels = connected_components(spark, edges.union(verified(pairs, "links")))
    named_by = [F.col(k).alias(c) for k, c in zip(keyed_by, ident)]
    return made.join(labels, "node", "left").select(*named_by, F.coalesce("root", "node").alias("root"))


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` of which no similar row comes before: by doc_id (null last), then by a hash of the text.

    Equal rows count as one, of which one stays. Null texts are empty, and texts without words are
    one group. Extra columns pass through, whatever their names; an empty table gives no rows.
    """
    at, h = hidden(docs.columns, "at"), hidden(docs.columns, "hash")
    keyed = docs.withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), h: F.xxhash64(text_or_empty())})
    with freeing(spark):  # what a step has shuffled goes as it ends, not with the stage
        groups = similar_groups(spark, keyed.select(at, h, "text"), [at, h], width, similarity)
    first = groups.groupBy("root").agg(F.min(F.struct(at, h)).alias("m")).select("m.*").distinct()
    return keyed.join(first, [at, h], "left_semi").dropDuplicates([at, h]).select(*docs.columns)
