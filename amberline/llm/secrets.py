"""Secret scan by assignment-aware lexing.

Three base patterns are taken as they are. Beyond them a lexer reads source and configuration syntax
into name-literal pairs and assignments of names to names: ``name = "literal"``, ``"name": "literal"``,
``name => literal``, ``--name=literal``, ``name := literal``, ``"a" + other``, ``target["name"] = "literal"``,
``call("name", "literal")``, ``key="name" value="literal"``, ``name: name`` with ``value: literal`` on the next
line, ``<name>literal</name>`` and block scalars (``name: |``). Quoted literals may hold escapes. What a
name stands for is carried along: a literal counts for every name that it reaches through
assignments. A literal is a secret if some name it reaches is sensitive and its own look (length,
mixture, entropy, no placeholder) is that of a key, or of a passphrase where the name asks for one.

All patterns advance without going back over what they have read, so time is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from amberline.llm.common import hidden, slices, text_or_empty

KINDS = ["assign", "access", "hex", "named"]
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Sensitivity of the words of a name; pairs of words are looked up joined.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "credential": 0.9,
    "credentials": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0,
    "authkey": 1.0, "bearer": 0.8, "auth": 0.6,
}
STEMS = ("passw", "pwd", "passphrase", "secret", "token", "credential", "key", "bearer", "auth")
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|dummy|sample|^x+$|^\*+$|^(.)\1*$|^[<$%{].*[>}%]$")
LEAST_SCORE, LEAST_LENGTH = 0.5, 8
LITERAL = r"""(?:"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>(?:[^`\\\n]|\\.)*+)`|(?P<bare>[A-Za-z0-9+/_.~$-]++=*+))"""
WORD = r"(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)"
GAP = r"[ \t]*+"
OPERATOR = r"(?::=|=>|=(?!=)|:(?!:))"
#: A name starts where a run of its characters starts, after dashes, dots and digits at most.
PAIR = re.compile(rf"""(?P<quote>["']?)(?<![A-Za-z0-9_.-])[.0-9-]*+{WORD}(?P=quote){GAP}{OPERATOR}{GAP}{LITERAL}""")
MORE = re.compile(rf"{GAP}[+.]{GAP}{LITERAL}")
#: Other shapes, and what a text must hold to have one.
SHAPES = [
    ("[", re.compile(rf"""\[{GAP}(?P<quote>["']){WORD}(?P=quote){GAP}\]{GAP}(?::=|=>|=(?!=)){GAP}{LITERAL}""")),
    ("(", re.compile(rf"""\({GAP}(?P<quote>["']){WORD}(?P=quote){GAP},{GAP}{LITERAL}""")),
    ("value", re.compile(rf"""\b(?:name|key|id){GAP}={GAP}(?P<quote>["']){WORD}(?P=quote)[ \t]++value{GAP}={GAP}{LITERAL}""")),
    ("value", re.compile(rf"""\bname:{GAP}(?P<quote>["']?){WORD}(?P=quote){GAP}\n{GAP}value:{GAP}{LITERAL}""")),
    ("</", re.compile(rf"""<{WORD}(?:[ \t][^<>\n]*+)?>(?P<bare>[^<>\n]++)</(?P=name){GAP}>""")),
    ("|", re.compile(rf"""(?m)^(?P<indent>{GAP}){WORD}{GAP}:{GAP}[|>][+-]?{GAP}\n(?P=indent)[ \t]++(?P<bare>[^\s][^\n]*+)""")),
    (">", re.compile(rf"""(?m)^(?P<indent>{GAP}){WORD}{GAP}:{GAP}>[+-]?{GAP}\n(?P=indent)[ \t]++(?P<bare>[^\s][^\n]*+)""")),
]
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+\Z")
#: Names whose literals may be several words, and words that show a message instead.
PHRASED = ("passphrase", "password", "passwd", "pwd")
MESSAGE = re.compile(r"(?i)\b(?:enter|please|your|must|forgot|invalid|wrong|the|a|is|are|not|for|of|to|new|old)\b")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    return max([WEIGHTS.get(w, 0.0) for w in words] + [WEIGHTS.get(a + b, 0.0) for a, b in zip(words, words[1:])], default=0.0)


def look(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a key, from 0 to 1; with ``phrase`` it may also be four words or more."""
    n = len(value)
    if n < LEAST_LENGTH or PLACEHOLDER.search(value):
        return 0.0
    if " " in value and not (phrase and len(value.split()) >= 4 and not MESSAGE.search(value)):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, entropy / 4.0) * (0.4 if kinds < 2 else 1.0)


def lex(text: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, str]]]:
    """Literals with the name each is assigned to, and assignments of a name to a name."""
    literals: dict[tuple[str, int, int], str] = {}
    copies = []

    def keep(name: str, part: re.Match) -> None:
        kind = next(k for k in ("dq", "sq", "bq", "bare") if part.groupdict().get(k) is not None)
        value = part[kind].strip()
        start = part.start(kind) + len(part[kind]) - len(part[kind].lstrip())
        literals[name, start, start + len(value)] = value
        if kind == "bare" and NAME.match(value.lstrip("$")):
            copies.append((name, value.lstrip("$")))

    at = 0
    while m := PAIR.search(text, at):
        part = m
        while part:
            keep(m["name"], part)
            at = part.end()
            part = MORE.match(text, at)
    for mark, shape in SHAPES:
        if mark in text:
            for m in shape.finditer(text):
                keep(m["name"], m)
    return [(name, value, a, b) for (name, a, b), value in literals.items()], copies


def named_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name and look like a key."""
    low = text.lower()
    if not any(c in text for c in "=:,<") or not any(s in low for s in STEMS):
        return []
    literals, copies = lex(text)
    weight = {name: sensitivity(name) for name in {x[0] for x in literals} | {y for c in copies for y in c}}
    into: dict[str, list[str]] = {}
    for name, source in copies:
        into.setdefault(name, []).append(source)
    todo = sorted(weight, key=weight.get, reverse=True)  # the highest weight a name reaches settles first
    for start in todo:
        stack = [start]
        while stack:
            for source in into.get(stack.pop(), ()):
                if weight[source] < weight[start]:
                    weight[source] = weight[start]
                    stack.append(source)
    phrased = {name for name in weight if any(w in name.lower() for w in PHRASED)}
    found = {(a, b) for name, value, a, b in literals if weight[name] * look(value, name in phrased) >= LEAST_SCORE}
    return [("named", a, b) for a, b in sorted(found)]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by start and then by kind. Added spans that a base span holds are left out."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    added, at, reach = [], 0, -1
    for span in sorted(named_spans(text), key=order):
        while at < len(base) and base[at][1] <= span[1]:
            reach = max(reach, base[at][2])
            at += 1
        if span[2] > reach:
            added.append(span)
    return base, sorted(base + added, key=order)


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scanned(spark: SparkSession, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, counts and digest of base spans, and all spans of each row of ``docs``.

    Offsets count code points. Null texts are empty and have no spans. Rows are independent; extra
    columns are ignored; an empty table gives no rows.
    """
    carry = carry or ["doc_id"]
    source = docs.select(*carry, text_or_empty().alias(hidden(carry, "text")))
    schema = docs.select(*carry).schema
    for name, kind in [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")]:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1, 8 << 20):
            rows = []
            for text in batch.column(-1).to_pylist():
                base, spans = scan(text)
                n = Counter(s[0] for s in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=schema.names)

    return source.mapInArrow(run, schema)
