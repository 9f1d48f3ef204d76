"""Column functions on text and URLs; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the tokenizer, and its token pattern.
STOPWORDS = """
a an and are as at be but by for from has have he her his i in into is it its
my of on or our she that the their them they this to was we were what when where
which who will with you your
how do does did done can could would should i'm i've there here about into any
""".split()
TOKEN = "[a-z0-9]+"
BLANK = r"(?U)\s"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(c: Column) -> Column:
    """Strings without surrounding white space; nothing left is null."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """Only white space (or nothing), and not null."""
    return F.coalesce(c.rlike(rf"^{BLANK}*$"), F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def _any_of(words: list[str]) -> str:
    """A pattern of words, those with one first letter together."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (w[0], -len(w), w)):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())


#: A token of two characters or more that is no stop word, found in one search: a run is tried at its start only.
KEPT = rf"(?<![a-z0-9])(?!(?:{_any_of([w for w in STOPWORDS if w.isalnum()])})(?![a-z0-9]))[a-z0-9]{{2,}}+"


def tokens(c: Column) -> Column:
    """Lower-case letter-digit runs of two characters or more that are no stop words; repeats stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(KEPT), F.lit(0))


def split_oversized(c: Column, most: int = 500) -> Column:
    """Pieces of ``most`` words each, single-spaced."""
    w = words(c)
    pieces = F.transform(F.sequence(F.lit(1), F.size(w), F.lit(most)), lambda i: F.array_join(F.slice(w, i, F.lit(most)), " "))
    return F.when(F.size(w) > 0, pieces).otherwise(F.array().cast("array<string>"))


def url_slug(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"^/+|/+$", "")
    return F.regexp_replace(F.when(path == "", "index").otherwise(path), "[^A-Za-z0-9._-]+", "_")


def host(c: Column) -> Column:
    """Host and port in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def canonical_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def trim_quote(c: Column, budget: int = 90) -> Column:
    """The text if it has at most ``budget`` words, else its first words up to the last sentence end among them."""
    w = words(c)
    head = F.array_join(F.slice(w, 1, budget), " ")
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.size(w) <= budget, strip(c)).otherwise(F.when(cut != "", cut).otherwise(head))


def answer_urls(c: Column) -> Column:
    """URLs of a text without the punctuation that follows them."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s()]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);:]+$", ""))


def months_before(yymm: Column, reference: int = 9706) -> Column:
    """Months from a YYMM number of the 1900s to ``reference``; null if it is no such date, negative if it is later."""
    v = yymm.try_cast("long")
    year, month = F.floor(v / 100), v % 100
    valid = (month >= 1) & (month <= 12) & (year >= 0) & (year <= 99)
    return F.when(valid, F.lit(reference // 100 * 12 + reference % 100) - (year * 12 + month))


def age_floor(c: Column, floor: float = 5) -> Column:
    return F.when(c > floor, c)


def age_band(c: Column, null_label: str | None = "(missing)") -> Column:
    """20-29 to 70-79, then 80-99; left-closed. Others get ``null_label``."""
    out = None
    for low in range(20, 80, 10):
        test, label = (c >= low) & (c < low + 10), f"{low}-{low + 9}"
        out = F.when(test, label) if out is None else out.when(test, label)
    out = out.when((c >= 80) & (c < 100), "80-99")
    return out.otherwise(F.lit(null_label))


def segment_label(c: Column) -> Column:
    """Text without surrounding blanks, blank and null as "(missing)"."""
    return F.coalesce(blank_to_null(c), F.lit("(missing)"))


def number_label(c: Column) -> Column:
    """A number as a label: whole numbers without decimals; null as "(missing)"."""
    return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string")), F.lit("(missing)"))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to 1.2e-7: a rational Chebyshev fit (fixed values)."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + F.lit(k)
    return t * F.exp(-x * x + poly)
