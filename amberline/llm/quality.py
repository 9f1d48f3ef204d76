"""Quality rules by weak supervision: rules vote or abstain, EM estimates how reliable each vote is.

Each rule looks at one measure of a text and votes good, bad, or abstains. A document is its
pattern of votes; there are at most 3 ** len(RULES) patterns, so all that EM needs of the corpus
is one count per pattern. A two-class model with a table P(vote | class) per rule is fitted to
these counts, and a document is kept if the posterior probability of the good class is at least
``keep_at``. The base rule of ``base_failed`` rejects on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import hidden, raw_bytes, settle, slices, stage, text_or_empty, trim

SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_REPEAT_PERCENT, WINDOW = 10, 20, 5
GOOD, ABSTAIN, BAD = 2, 1, 0
KEEP_AT = 0.5
#: Before any document is seen, a bad vote is expected to hit this share of good documents; the
#: expectation weighs PRIOR times as much as the votes cast on them, whatever the size of the corpus.
FALSE_ALARM, PRIOR = 0.01, 1.0
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
#: A rule: measure per unit, good up to (inclusive), bad from (inclusive). Between them it abstains.
RULES = [
    ("symbols", "n_symbols", "n_words", 0.02, 0.1),
    ("symbol_chars", "n_symbols", "word_chars", 0.005, 0.02),
    ("repeats", "n_repeat_words", "n_words", 0.05, 0.2),
    ("lines", "n_dup_lines", "n_lines", 0.1, 0.4),
    ("capitals", "n_upper", "word_chars", 0.15, 0.5),
    ("marks", "n_marks", "n_words", 0.1, 0.5),
]
#: Mean word length: good and tolerated ranges.
LENGTH_GOOD, LENGTH_FAIR = (3.0, 9.0), (2.0, 14.0)
SIZE_GOOD, SIZE_FAIR = 30, BASE_WORDS
N_RULES = len(RULES) + 2
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_UPPER, _MARKS = bytes(range(65, 91)), b"!?"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    one = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == n:
        return 0
    gram = one  # exact ids of word runs, one word longer each time, or at once if five ids fit 63 bits
    bits = max(1, (len(ids) - 1).bit_length())
    if bits * window <= 63:
        gram = one[: n - window + 1].copy()
        for k in range(1, window):
            gram = (gram << bits) | one[k : n - window + 1 + k]
    else:
        for k in range(1, window):
            gram = np.unique((gram[: n - k] << bits) | one[k:], return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text. Words are runs without the six ASCII blanks; line ends are ``\\n``."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * (len(MEASURES) - 1) + (1,)
    chars = len(text) - len(text.translate(None, _BLANKS))
    points = len(text.decode()) if not text.isascii() else len(text)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(_BLANKS))
        else:
            seen.add(line)
    count = lambda of: len(text) - len(text.translate(None, of))
    return (n, points - chars, count(SYMBOLS), dup, repeat_words(words), count(_UPPER), count(_MARKS), len(lines))


def votes(values: np.ndarray) -> np.ndarray:
    """Votes of all rules: rows of ``values`` hold MEASURES."""
    by = {name: values[:, k].astype(float) for k, name in enumerate(MEASURES)}
    out = []
    for _, top, unit, good, bad in RULES:
        share = by[top] / np.maximum(by[unit], 1)
        out.append(np.where(share <= good, GOOD, np.where(share >= bad, BAD, ABSTAIN)))
    mean = by["word_chars"] / np.maximum(by["n_words"], 1)
    inside = lambda r: (mean >= r[0]) & (mean <= r[1])
    out.append(np.where(inside(LENGTH_GOOD), GOOD, np.where(inside(LENGTH_FAIR), ABSTAIN, BAD)))
    out.append(np.where(by["n_words"] >= SIZE_GOOD, GOOD, np.where(by["n_words"] >= SIZE_FAIR, ABSTAIN, BAD)))
    return np.stack(out, axis=1)


def pattern_of(values: np.ndarray) -> np.ndarray:
    """One integer per row that holds all its votes."""
    return (votes(values) * 3 ** np.arange(N_RULES)).sum(axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """Posterior probability of the good class by pattern.

    EM on a two-class model with one chance P(bad | class) per rule, over votes that are cast:
    an abstention says nothing. It starts from the reading that a document with any bad vote is
    probably bad. P(bad | bad) is smoothed by one pseudo-vote. P(bad | good) is the mean of a Beta
    distribution that starts at FALSE_ALARM and takes in all votes, so that a rule which errs more
    often is found out; the class in which a rule votes bad less often is called good.
    """
    if not len(patterns):
        return {}
    vote = (patterns[:, None] // 3 ** np.arange(N_RULES)) % 3
    bad, cast, weight = vote == BAD, vote != ABSTAIN, counts.astype(float)
    good = np.where(bad.any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        chance = []
        for p, expected, prior in ((1 - good, 0.5, 0.0), (good, FALSE_ALARM, PRIOR)):
            w = (weight * p)[:, None]
            said = (w * cast).sum(axis=0)
            pseudo = prior * said + 1.0
            chance.append(((w * bad).sum(axis=0) + expected * pseudo) / (said + pseudo))
        on_good = np.minimum(chance[1], chance[0])
        on_bad = np.clip(chance[0], 1e-6, 1 - 1e-6)
        share = np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99)
        odds = np.log(share / (1 - share)) + np.where(
            bad, np.log(on_good / on_bad), np.where(cast, np.log((1 - on_good) / (1 - on_bad)), 0.0)
        ).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return {int(p): float(g) for p, g in zip(patterns, good)}


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, MEASURES and ``pattern`` of each row of ``docs``."""
    source = docs.select(*carry, text_or_empty().alias(hidden(carry, "text")))
    schema = docs.select(*carry).schema
    for name in [*MEASURES, "pattern"]:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("quality")
        for batch in slices(batches, -1, 2 << 20):
            values = np.array([measure(t) for t in raw_bytes(batch.column(-1))], dtype=np.int64).reshape(-1, len(MEASURES))
            own = [pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own, pa.array(pattern_of(values))], names=[*carry, *MEASURES, "pattern"])

    return source.mapInArrow(run, schema)


def posteriors(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``(pattern, p_good)``. The collected table has at most 3 ** N_RULES rows whatever the corpus."""
    got = rows.groupBy("pattern").count().orderBy("pattern").collect()
    fitted = fit(np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.int64))
    return spark.createDataFrame(list(fitted.items()), "pattern long, p_good double")


def base_failed() -> F.Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def judged(spark: SparkSession, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Measures, ``base_failed``, ``p_good`` and ``kept`` per row of ``docs``.

    Null and empty texts have no words and fail the base rule. Equal rows get equal results; an
    empty table gives no rows; columns not in ``carry`` are ignored.
    """
    rows = stage(spark, measured(docs, carry or ["doc_id"]), "quality")
    table = F.broadcast(posteriors(spark, rows))  # at most 3 ** N_RULES rows
    return rows.join(table, "pattern", "left").select(
        *(carry or ["doc_id"]), *MEASURES[:5], base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") >= KEEP_AT)).alias("kept"), "p_good",
    )


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    Two passes over the texts: one counts vote patterns, the next measures again and filters, so
    that no text is shuffled and rows need no key. Null and empty texts fail the base rule; equal
    rows share their fate; columns pass through, whatever their names; an empty table gives no rows.
    """
    counts = measured(docs, []).select("pattern")
    table = {int(r[0]): float(r[1]) for r in posteriors(spark, counts).collect()}
    schema, columns = docs.schema, docs.columns
    source = docs.withColumn(hidden(docs.columns, "text"), text_or_empty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("quality")
        for batch in slices(batches, -1, 2 << 20):
            values = np.array([measure(t) for t in raw_bytes(batch.column(-1))], dtype=np.int64)
            failed = (values[:, 0] < BASE_WORDS) | (100 * values[:, 4] > BASE_REPEAT_PERCENT * values[:, 0])
            good = np.array([table.get(int(p), 0.0) >= KEEP_AT for p in pattern_of(values)])
            keep = pa.array(~failed & good)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=columns).filter(keep)
        trim()

    return source.mapInArrow(run, schema)
