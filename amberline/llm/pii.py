"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four strict patterns and always stay. Looser candidates (written-out addresses,
numbers without a plus sign, identity numbers) are looked at by four labelers that vote yes, no, or
abstain: a format pattern, a gazetteer of prefixes and endings, the words before the span, and the
look of its digits. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is per kind, without labels. Its posteriors then train the final span classifier, a
naive Bayes model over features of the span and its surroundings. A candidate is added if both the
posterior and the classifier are at least ADD_AT and it touches no base span.

The tables that reach the driver hold vote patterns and feature values, whose number is fixed by the
code, not by the corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm.common import hidden, stage, text_or_empty

KINDS = ["email", "ip", "card", "phone", "id"]
# What the base patterns match. Runs are possessive and start at a run's first
# character or where the last match ended, which finds the same spans in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Candidates beyond the base patterns: kind, pattern, and what a text must match to be looked at.
LOOSE = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{2,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,63}+){1,4}+", r"[\[(](?:at|AT)[\])]"),
    ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]{3,4}[ .-][0-9]{3,4}"),
    ("id", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]-[0-9]{2}-[0-9]"),
]
FORMAT = {"email": r"[\[(](?:dot|DOT)[\])]", "phone": r"^(?:\([0-9]{3}\) |[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$", "id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "phone": r"^\(?(?:[2-9][0-8][0-9]|0[1-9])",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
NEAR_YES = {
    "email": r"(?i)mail|contact|write|reach|correo|courriel|kontakt",
    "phone": r"(?i)phone|call|tel\b|tel\.|mobile|fax|cell|telefon|téléphone|teléfono|llam|appel|ruf",
    "id": r"(?i)ssn|social|security|identi|passport|tax",
}
NEAR_NO = r"(?i)version|invoice|order|isbn|issn|price|total|page|figure|table|doi|seed|\$|€"
NEAR = 32
VOTES = 4
ROUNDS, ADD_AT = 25, 0.9

SPANS = "array<struct<start:int,end:int,s:string>>"
Spans = Column  # of type SPANS


def found(text: Column, pattern: str, block: int = 256) -> Spans:
    """Leftmost matches with their code-point offsets.

    Matches and the gaps between them come from the same search; offsets are running sums of their
    lengths, formed in blocks so that long lists stay cheap.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPANS)

    def body(pairs: Column) -> Column:
        def within(part: Column) -> Column:
            first = F.struct(F.lit(0).alias("at"), none.alias("out"))

            def add(a: Column, x: Column) -> Column:
                start = a["at"] + F.length(x["g"])
                end = start + F.length(x["h"])
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("s")))).alias("out"))

            return F.aggregate(part, first, add)

        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(block))
        parts = F.transform(starts, lambda b: within(F.slice(pairs, b, F.lit(block))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))

        def shift(a: Column, p: Column) -> Column:
            moved = F.transform(p["out"], lambda x: F.struct((x["start"] + a["at"]).alias("start"), (x["end"] + a["at"]).alias("end"), x["s"].alias("s")))
            return F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(parts, start, shift)["out"])

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    return bound(pairs, lambda p: F.when(F.size(p) > 0, body(p)).otherwise(none))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Spans]:
    """Strict spans per kind; a text that cannot match is not searched."""
    none = F.array().cast(SPANS)

    def spans(pattern: str, possible: Column, keep) -> Spans:
        return F.when(possible, F.filter(found(text, pattern), keep)).otherwise(none)

    size = lambda x: F.length(digits(x["s"]))
    return {
        "email": spans(EMAIL, F.contains(text, F.lit("@")), lambda x: F.lit(True)),
        "ip": spans(IP, text.rlike(r"[0-9]\.[0-9]"), lambda x: x["s"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": spans(CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda x: size(x).between(16, 19) & F.coalesce(luhn(digits(x["s"])), F.lit(False))),
        "phone": spans(PHONE, F.contains(text, F.lit("+")), lambda x: size(x).between(8, 15)),
    }


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def candidates(text: Column, base: Column) -> Column:
    """Looser spans that touch no base span: kind number, offsets, votes as one pattern, and span features."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,votes:int,features:array<int>>>")
    clear = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    yes_no = lambda c: F.when(c, 2).otherwise(0)

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[.,;:!?)]"), 3).otherwise(4)

    def of(kind: str, pattern: str, possible: str) -> Column:
        def row(x: Column) -> Column:
            before = F.substring(text, F.greatest(x["start"] - NEAR + 1, F.lit(1)), F.least(x["start"], F.lit(NEAR)))
            after = F.substring(text, x["end"] + 1, F.lit(1))
            near = F.when(before.rlike(NEAR_YES[kind]), 2).when(before.rlike(NEAR_NO), 0).otherwise(1)
            same = F.when(x["s"].rlike(r"([0-9])(?:[^0-9]*\1){6}"), 0).otherwise(1)
            votes = [yes_no(x["s"].rlike(FORMAT[kind])), yes_no(x["s"].rlike(GAZETTEER[kind])), near, same]
            number = reduce(lambda a, b: a + b, [v * 3**k for k, v in enumerate(votes)]) + KINDS.index(kind) * 3**VOTES
            shape = F.length(digits(x["s"])) if kind != "email" else F.size(F.split(x["s"], r"[\[(]"))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), number.alias("votes"),
                F.array(F.least(shape, F.lit(20)), side(F.substring(before, -1, 1)), side(after), near).alias("features"),
            )

        return F.when(text.rlike(possible), F.transform(F.filter(found(text, pattern), clear), row)).otherwise(none)

    return F.concat(*(of(*x) for x in LOOSE))


def em(rows: DataFrame) -> DataFrame:
    """``(votes, p)``: posterior of each vote pattern, per kind, from ``rows(kind, votes, n)``.

    A two-coin model: labeler j says yes with chance a_j on personal data and b_j on other spans.
    Beta priors (8, 2) and (2, 8) name the classes; abstentions say nothing. All rounds run inside
    one expression over the list of a kind's patterns, at most 3 ** VOTES of them.
    """
    vote = lambda r, j: F.pmod(F.floor(r["votes"] / 3**j).cast("int"), F.lit(3))

    def posterior(r: Column, st: Column) -> Column:
        odds = F.log(st["prior"] / (1 - st["prior"]))
        for j in range(VOTES):
            a, b = st["a"][j], st["b"][j]
            odds = odds + F.when(vote(r, j) == 2, F.log(a / b)).when(vote(r, j) == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def total(list_: Column, of) -> Column:
        return F.aggregate(list_, F.lit(0.0), lambda s, x: s + of(x))

    def step(list_: Column, st: Column) -> Column:
        scored = F.transform(list_, lambda r: F.struct(r["votes"].alias("votes"), r["n"].cast("double").alias("n"), posterior(r, st).alias("p")))

        def update(x: Column) -> Column:
            chances = []
            for share, yes, no in ((lambda r: r["p"], 8.0, 2.0), (lambda r: 1 - r["p"], 2.0, 8.0)):
                said = [total(x, lambda r, j=j: F.when(vote(r, j) == 2, r["n"] * share(r)).otherwise(0.0)) for j in range(VOTES)]  # noqa: B023
                cast = [total(x, lambda r, j=j: F.when(vote(r, j) != 1, r["n"] * share(r)).otherwise(0.0)) for j in range(VOTES)]  # noqa: B023
                chances.append(F.array(*((s + yes) / (c + yes + no) for s, c in zip(said, cast))))
            prior = (total(x, lambda r: r["n"] * r["p"]) + 1) / (total(x, lambda r: r["n"]) + 2)
            return F.struct(prior.alias("prior"), chances[0].alias("a"), chances[1].alias("b"))

        return bound(scored, update)

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * VOTES).alias("a"), F.array(*[F.lit(0.2)] * VOTES).alias("b"))
    lists = rows.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("list"))
    fitted = lists.withColumn("st", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda st, _: step(F.col("list"), st)))
    return fitted.select("st", F.explode("list").alias("r")).select("r.votes", posterior(F.col("r"), F.col("st")).alias("p"))


def lookup(values: dict[int, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (int(k), float(v))])
    return F.coalesce(F.try_element_at(table, key.cast("int")), F.lit(default))


def train(found_rows: DataFrame) -> tuple[dict[int, float], dict[int, float]]:
    """Posterior by vote pattern, and the classifier's log odds by feature number, from ``found_rows(c)`` with candidates."""
    each = found_rows.select(F.explode("candidates").alias("c")).select("c.*")
    posterior = {r["votes"]: r["p"] for r in em(each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))).collect()}
    p = lookup(posterior, F.col("votes"), 0.0)
    soft = each.select("kind", p.alias("p"), F.posexplode(F.concat("features", F.array(F.lit(0)))).alias("f", "v"))
    number = feature_number(F.col("kind"), F.col("f"), F.col("v"))
    counts = soft.groupBy("kind", number.alias("number"), "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {(r["kind"], y): r[y] for r in counts for y in ("yes", "no") if r["f"] == 4}
    odds = {}
    for r in counts:
        yes, no = total[r["kind"], "yes"], total[r["kind"], "no"]
        if r["f"] == 4:  # the constant feature: the prior
            odds[r["number"]] = math.log((yes + 1) / (no + 1))
        else:
            odds[r["number"]] = math.log((r["yes"] + 1) / (yes + 8)) - math.log((r["no"] + 1) / (no + 8))
    return posterior, odds


def feature_number(kind: Column, f: Column, v: Column) -> Column:
    return (kind * 5 + f) * 32 + v


def added(cands: Column, posterior: dict[int, float], odds: dict[int, float]) -> Column:
    """The candidates that both the aggregated votes and the classifier accept."""

    def accept(c: Column) -> Column:
        score = lookup(odds, feature_number(c["kind"], F.lit(4), F.lit(0)), 0.0)
        for f in range(4):
            score = score + lookup(odds, feature_number(c["kind"], F.lit(f), c["features"][f]), 0.0)
        return (lookup(posterior, c["votes"], 0.0) >= ADD_AT) & (1 / (1 + F.exp(-score)) >= ADD_AT)

    return F.filter(cands, accept)


def tagged(base: dict[str, Spans]) -> Column:
    def of(number: int) -> Column:
        return F.transform(base[KINDS[number]], lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*map(of, range(4)))


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def spotted(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, ``base`` spans by kind and start, and ``candidates``."""
    text = docs.select(*carry, text_or_empty().alias("_text"))
    based = text.withColumn("base", tagged(base_spans(F.col("_text"))))
    return based.select(*carry, "base", candidates(F.col("_text"), F.col("base")).alias("candidates"))


def scanned(spark: SparkSession, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry``, base counts and digest, and all spans of each row of ``docs``.

    Offsets are code points, ends exclusive. Null texts are empty and have no spans. Rows are
    independent, so repeated rows agree; extra columns are not read; an empty table gives no rows.
    """
    carry = carry or ["doc_id"]
    rows = stage(spark, spotted(docs, carry), "pii")
    posterior, odds = train(rows)
    every = F.array_sort(F.concat("base", plain(added(F.col("candidates"), posterior, odds))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return rows.select(*carry, *(count(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"))


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; ``n_chars``, where there is one, follows.

    The first pass fits the labelers and the classifier to the candidates, the second rewrites
    texts. Rows without spans stay as they are, null texts too; long texts are searched whole.
    Overlapping spans become one, named after the first. Rows are independent, so repeated rows agree.
    Extra columns pass through, whatever their names; an empty table gives no rows.
    """
    base, found_ = hidden(docs.columns, "base"), hidden(docs.columns, "spans")
    posterior, odds = train(stage(spark, spotted(docs, []).select("candidates"), "pii"))
    text = F.col("text")
    based = docs.withColumn(base, tagged(base_spans(text_or_empty())))
    spans = F.concat(base, plain(added(candidates(text_or_empty(), F.col(base)), posterior, odds)))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(a: Column, x: Column) -> Column:
        piece = F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(F.get(names, x["kind"])), F.lit("]")))
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], piece).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))
        )

    whole = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    done = based.withColumn(found_, by_start).withColumn("text", F.when(F.size(found_) > 0, F.aggregate(found_, start, cut, whole)).otherwise(text))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(found_) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
