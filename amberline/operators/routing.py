"""Question routing: refuse, escalate or answer, with texts and citations, as columns of a questions table.

The refusal test runs first and does not depend on retrieval: a question that asks for medical
advice is never answered.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.functions.text import answer_urls, trim_quote
from amberline.operators import retrieval
from amberline.operators.staging import staged

# Thresholds of the confidence gate.
OVERLAP, COVERAGE, SCORE, TOP_K = 0.35, 0.5, 1.0, 3

# What marks a question as asking for medical advice. Any of the direct patterns does;
# so does one of the person patterns together with one of the clinical patterns.
DIRECT = [
    r"\bdos(?:e|es|age|ing)\b",
    r"\bhow (?:much|many)\b.*\b(?:give|take|dose|mg|medication|medicine)\b",
    r"\bwhat (?:medication|medicine|drug|dose|dosage|treatment|surgery)\b",
    r"\bwhich\b.{0,40}\b(?:medication|medicine|drug|treatment|surgery)\b",
    r"\bwhich (?:doctor|specialist|clinic)\b.*\b(?:should|best|right)\b",
    r"\bshould (?:i|we|he|she|my|our|they)\b.*\b(?:take|give|start|stop|switch|increase|decrease|wean|try|see|test|operate|do)\b",
    r"\b(?:stop|start|change|increase|decrease|wean)\b.*\b(?:medication|medicine|dose|drug|treatment)\b",
    r"\bis (?:it|this) (?:safe|okay|ok|normal|dangerous|serious)\b",
    r"\bdiagnos\w*\b",
    r"\bprognos\w*\b",
    r"\blife expectancy\b",
    r"\bhow long\b.*\b(?:live|survive)\b",
    r"\bwhat (?:does|do)\b.*\b(?:scan|mri|ct|eeg|result|results|symptom|symptoms)\b.*\bmean\b",
    r"\binterpret\b.*\b(?:scan|mri|result|results|symptom)\b",
    r"\bwill (?:my|our|he|she|they)\b.*\b(?:be (?:ok|okay|fine|alright)|get worse|be cured|recover|die)\b",
    r"\bhome remedy\b|\bnatural (?:cure|remedy|treatment)\b",
]
PERSON = [
    r"\b(?:my|our|his|her|their|the)\s+(?:child|kid|children|son|daughter|baby|babies|newborn|infant|toddler|husband|wife|mom|mother|dad|father|partner|patient)\b",
    r"\b(?:i|we)\s+(?:have|has|got|am|are|was|were)\b",
]
CLINICAL = [
    r"\b(?:seizure|seizures|rash|swelling|swollen|cloudy|bulging|glaucoma|pressure|pain|fever|vomit|vomiting|bleeding|bruis|lump|spasm|twitch|stroke|weakness|"
    r"numb|headache|migraine|symptom|symptoms|birthmark|port[-\s]?wine|stain|mri|ct|eeg|scan|scans|x[-\s]?ray|ultrasound|biopsy|leptomeningeal|"
    r"calcification|side effect|side[-\s]?effects)\b",
    r"\b(?:medication|medications|medicine|medicines|drug|drugs|dose|doses|dosage|dosing|mg|milligram|steroid|steroids|aspirin|anticonvulsant|anti[-\s]?seizure|"
    r"surgery|operation|operate|laser|treatment|treatments|therapy|chemo|radiation|prescri\w*|inject\w*|vaccine|supplement)\b",
    r"\b(?:should|safe|okay|ok to|normal|worried|worry|concern\w*|dangerous|serious|risk|emergency|need to|have to|is it|are they|will (?:he|she|they|my))\b",
]

REFUSAL = (
    "I can't give advice about one person's diagnosis, symptoms, medicines or treatment. Please bring this question to your own clinical team, "
    "and call your local emergency number if care may be needed right away.\n\n- Clinical care: {clinical_title} ({clinical_url})\n- Contact: {contact_title} ({contact_url})"
)
ESCALATION = "I could not find a page that covers this, and I don't want to guess.\n\n- Contact: {contact_title} ({contact_url})"
POINTER = "This comes from the pages cited above, as of the day they were read. For anything about your own care, please talk with your clinical team."


def any_of(c: Column, patterns: list[str]) -> Column:
    """Unicode-aware, case-insensitive search; a dot stops at line feeds only."""
    return reduce(lambda a, b: a | b, [c.rlike(f"(?iUd){p}") for p in patterns])


def asks_advice(question: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    return any_of(q, DIRECT) | (any_of(q, PERSON) & any_of(q, CLINICAL))


def below_confidence(results: Column, overlap: Column, coverage: Column, score: Column) -> Column:
    return (results == 0) | (overlap < OVERLAP) | (coverage < COVERAGE) | (score < SCORE)


def render(template: str, fields: dict[str, Column]) -> Column:
    out: Column = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


@dataclass(frozen=True)
class Contacts:
    """Titles and URLs for the templates, used where the corpus has no such page."""

    title: str = "Contact us"
    url: str = "https://example.org/contact"


def find_pages(chunks: DataFrame, fallback: Contacts = Contacts()) -> DataFrame:
    """One row: the first page, in corpus order, whose URL speaks of contact, and of clinical care, null where there is none.

    ``contact_fields`` and ``clinical_fields`` are what templates name: the page, or else the fallback, which is never cited.
    """
    low = F.lower("url")
    first = lambda *parts: F.min_by(F.struct("title", "url"), F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), F.col("ord")))
    own = chunks.agg(first("contact").alias("contact"), first("clinical-care", "care-network", "care_network").alias("care"), first("clinical").alias("any"))
    own = own.select("contact", F.coalesce("care", "any", "contact").alias("clinical"))
    default = F.struct(F.lit(fallback.title).alias("title"), F.lit(fallback.url).alias("url"))
    return own.select("contact", "clinical", F.coalesce("contact", default).alias("contact_fields"), F.coalesce("clinical", "contact", default).alias("clinical_fields"))


def signals(index: retrieval.Index, questions: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Per question: ``advice``, and for the others results, top score, overlap and coverage."""
    asked = questions.withColumn("advice", asks_advice(F.col("query")))
    open_ = asked.where(~F.col("advice")).select("query_id", "query")
    hits = search(index, questions) if hits is None else hits
    top = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))
    out = asked.join(top, "query_id", "left").join(retrieval.best_overlap(index, open_, TOP_K, hits), "query_id", "left").join(retrieval.coverage(index, open_), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(*questions.columns, "advice", F.coalesce("results", F.lit(0)).alias("results"), zero("top_score"), zero("overlap"), zero("coverage"))


def search(index: retrieval.Index, questions: DataFrame) -> DataFrame:
    """The best chunks of the questions that do not ask for advice, written once."""
    return staged(retrieval.search(index, questions.where(~asks_advice(F.col("query"))).select("query_id", "query"), TOP_K), "hits")


def routed(found: DataFrame) -> DataFrame:
    gate = below_confidence(F.col("results"), F.col("overlap"), F.col("coverage"), F.col("top_score"))
    return found.withColumn("kind", F.when(F.col("advice"), "refusal").when(gate, "escalation").otherwise("answer"))


def extracts(index: retrieval.Index, hits: DataFrame) -> DataFrame:
    """Quoted text and citations from the first two distinct pages of the best chunks."""
    hits = hits.join(index.chunks, "ord")
    page = F.row_number().over(W.partitionBy("query_id", "url").orderBy("rank"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    used = hits.withColumn("_p", page).where("_p = 1").withColumn("_n", place).where("_n <= 2")
    part = F.concat(F.lit('From "'), F.coalesce(F.col("section") if "section" in index.chunks.columns else F.col("title"), F.col("title")), F.lit('":\n'), trim_quote(F.col("body") if "body" in index.chunks.columns else F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("_n", part.alias("part"), "title", "url")))  # two at most
    return used.groupBy("query_id").agg(rows.alias("r")).select(
        "query_id", F.concat(F.array_join("r.part", "\n\n"), F.lit("\n\n" + POINTER)).alias("extract"), F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("cited")
    )


def answers(index: retrieval.Index, questions: DataFrame, fallback: Contacts = Contacts()) -> DataFrame:
    """``query_id, query, kind, text, citations`` and the signals of each question."""
    hits = search(index, questions)
    way = routed(signals(index, questions, hits))
    pages = F.broadcast(find_pages(index.chunks, fallback))  # one row
    out = way.join(extracts(index, hits), "query_id", "left").join(pages)
    fields = {f"{p}_{f}": F.col(f"{p}_fields")[f] for p in ("contact", "clinical") for f in ("title", "url")}
    text = F.when(F.col("kind") == "refusal", render(REFUSAL, fields)).when(F.col("kind") == "escalation", render(ESCALATION, fields)).otherwise(F.col("extract"))
    cites = F.when(F.col("kind") == "refusal", F.array_distinct(F.array_compact(F.array("clinical", "contact")))).when(F.col("kind") == "escalation", F.array_compact(F.array("contact"))).otherwise(F.col("cited"))
    return out.select(*questions.columns, "kind", text.alias("text"), cites.alias("citations"), "top_score", "overlap", "coverage")


def citation_check(text: Column, retrieved: Column) -> Column:
    """A written answer stands if it cites a URL and all that it cites were retrieved; else it is escalated."""
    urls = answer_urls(text)
    return F.when((F.size(urls) > 0) & (F.size(F.array_except(urls, retrieved)) == 0), "answer").otherwise("escalation")


def formatted(kind: Column, text: Column, citations: Column) -> Column:
    """Label, text and the distinct sources, in order."""
    sources = F.array_distinct(F.transform(citations, lambda c: F.concat(F.lit("- "), c["title"], F.lit(": "), c["url"])))
    tail = F.when(F.size(citations) > 0, F.concat(F.lit("\n\nSources:\n"), F.array_join(sources, "\n"))).otherwise("")
    return F.concat(F.lit("["), F.upper(kind), F.lit("]\n"), text, tail)
