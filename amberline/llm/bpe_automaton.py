"""BPE by a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the token sequences that BPE can produce. It is
built by one merge gadget per rule, in rank order. Before the first rule one state has a loop for
every base symbol. All arcs of a token enter one state, ``enter[token]``, so a rule u v -> w, with
q = enter[u] and an arc v out of q, does this:

* arcs of u are led to a copy of q that lacks the arc v (q itself, if only u enters it);
* each state that has an arc u also gets an arc w, into the state that v enters.

A word has exactly one accepted path whose labels spell it, and so has each of its prefixes. So one
pass from the left fixes, for each prefix, the state that its path ends in: the last token is the one
token that ends there and for which the state before it has an arc. Tokens are found by the
transitions of a trie over bytes; both tables are arrays, and many words walk them side by side.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from amberline.llm.common import hidden, settle, slices, text_or_empty, trim

END = "</w>"
#: Pieces, their codes and the objects around them that a Python worker holds; beyond this it starts afresh.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 350
#: Bytes of words that walk the tables together; a longer word walks in steps of its own.
BLOCK = 1 << 18


class Automaton:
    """``enter[token]``: the state after a token. ``arcs[row[token]]``: packed bits, the states that have an arc for it;
    tokens with the same arcs share a row."""

    def __init__(self, vocab: dict[str, int], enter: np.ndarray, arcs: np.ndarray, row: np.ndarray):
        self._set(vocab, enter, arcs, row)

    def _set(self, vocab: dict[str, int], enter: np.ndarray, arcs: np.ndarray, row: np.ndarray) -> None:
        self.vocab, self.enter, self.arcs, self.row = vocab, enter, arcs, row
        self.label = {i: t for t, i in vocab.items()}

    @functools.cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Node and byte to node (0 is none, 1 the root), the inner and the final token that a node spells or -1, and the
        most bytes of a token. Nodes without children come last and have no row. Only workers need it."""
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        nodes: dict[tuple[int, int], int] = {}
        ends = []
        for t, i in self.vocab.items():
            at, text = 1, t.removesuffix(END)
            for c in text:
                at = nodes.setdefault((at, byte_of[c]), len(nodes) + 2)
            ends.append((at, t.endswith(END), i, len(text)))
        own = np.array([(*k, v) for k, v in nodes.items()], np.int64).reshape(-1, 3)
        parents = np.unique(own[:, 0])  # the root is the least
        place = np.zeros(len(nodes) + 2, np.int64)
        place[parents] = np.arange(1, len(parents) + 1)
        leaves = np.flatnonzero(place[1:] == 0) + 1
        place[leaves] = np.arange(len(parents) + 1, len(nodes) + 2)
        step = np.zeros((len(parents) + 1, 256), np.int32)
        step[place[own[:, 0]], own[:, 1]] = place[own[:, 2]]
        inner, final = (np.full(len(nodes) + 2, -1, np.int32) for _ in range(2))
        for at, last, i, _ in ends:
            (final if last else inner)[place[at]] = i
        return step, inner, final, max([e[3] for e in ends], default=1)

    def __getstate__(self):
        return self.vocab, self.enter, self.row, self.arcs.shape, zlib.compress(self.arcs.tobytes(), 1)

    def __setstate__(self, state):
        vocab, enter, row, shape, arcs = state
        self._set(vocab, enter, np.frombuffer(zlib.decompress(arcs), np.uint8).reshape(shape), row)

    def encode(self, word: bytes) -> list[int]:
        return self.encode_all([word])[0]

    def encode_all(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word; its last byte carries the end mark."""
        out: list[list[int]] = []
        first, held = 0, 0
        for k, w in enumerate(words):
            if k > first and held + len(w) > BLOCK:
                out += self._block(words[first:k])
                first, held = k, 0
            held += len(w)
        return out + self._block(words[first:]) if first < len(words) else out

    def _tokens(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """All tokens at the places ``begin`` of ``data`` whose words end at ``stop``: their begins, ends and numbers."""
        step, inner, final, longest = self.trie
        node, end, found = np.ones(len(begin), np.int32), begin, []
        for _ in range(longest):
            live = np.flatnonzero((end < stop) & (node < len(step)))
            node = step[node[live], data[end[live]]]
            live, node = live[node > 0], node[node > 0]
            if not len(live):
                break
            begin, stop, end = begin[live], stop[live], end[live] + 1
            token = np.where(end == stop, final[node], inner[node])
            hit = token >= 0
            found.append((begin[hit], end[hit], token[hit]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3

    def _block(self, words: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in words], np.int64)
        if size.max(initial=0) > BLOCK:
            return [self._long(w) for w in words]
        data = np.frombuffer(b"".join(words), np.uint8)
        head = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start, end, token = self._tokens(data, np.arange(len(data)), (head + size)[word])
        of = word[start]
        # a word of n bytes has n + 1 places between them, and words lie one after the other
        start, end = start + of, end + of
        depth = end - (head + np.arange(len(words)))[of]
        order = np.argsort(depth, kind="stable")
        start, end, token = start[order], end[order], token[order]
        cuts = np.searchsorted(depth[order], np.arange(1, int(size.max(initial=0)) + 2)).tolist()
        state, back, last = (np.zeros(len(data) + len(words), np.int64) for _ in range(3))
        for a, b in zip(cuts, cuts[1:]):
            s, t, e = state[start[a:b]], token[a:b], end[a:b]
            ok = (self.arcs[self.row[t], s >> 3] >> (s & 7)) & 1 == 1
            t, e = t[ok], e[ok]
            state[e], last[e], back[e] = self.enter[t], t, start[a:b][ok]
        at, live, got = head + size + np.arange(len(words)), np.arange(len(words)), []
        stop = head + np.arange(len(words))
        while len(live := live[at[live] > stop[live]]):
            got.append((live, last[at[live]]))
            at[live] = back[at[live]]
            if not (at[live] < head[live] + size[live] + live).all():
                raise ValueError("no accepted path spells a word")
        if not got:
            return [[] for _ in words]
        of, ids = (np.concatenate(x[::-1]) for x in zip(*got))  # last tokens were met first
        order = np.argsort(of, kind="stable")
        ids, cuts = ids[order].tolist(), np.searchsorted(of[order], np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, word: bytes) -> list[int]:
        """One word in pieces: tokens are found BLOCK places at a time, the states before them stay."""
        n = len(word)
        data = np.frombuffer(word, np.uint8)
        state, last, back = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)
        enter, arcs, row = self.enter, self.arcs, self.row
        reached = np.zeros(n + 1, bool)
        reached[0] = True
        for first in range(0, n, BLOCK):
            places = np.arange(first, min(n, first + BLOCK))
            start, end, token = self._tokens(data, places, np.full(len(places), n))
            order = np.argsort(start, kind="stable")  # a place's state is settled before its tokens are tried
            for a, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist()):
                s = int(state[a])
                if reached[a] and arcs[row[t], s >> 3] >> (s & 7) & 1:
                    state[e], last[e], back[e], reached[e] = enter[t], t, a, True
        out, at = [], n
        if not reached[n]:
            raise ValueError("no accepted path spells a word")
        while at:
            out.append(int(last[at]))
            at = int(back[at])
        return out[::-1]

    def decode(self, ids: list[int], labels: dict[int, str] | None = None) -> str:
        """The labels of the arcs, joined by a space: the vocabulary declares no decoder."""
        extra = labels or {}
        return " ".join(self.label.get(i) or extra[i] for i in ids)


def build(vocab: dict[str, int], merges: list[tuple[str, str]]) -> Automaton:
    """Compile merges, lowest rank first."""
    size = max(vocab.values(), default=0) + 1
    made = {u + v for u, v in merges}
    base = [vocab[t] for t in vocab if t not in made]
    room = 1024
    arcs = np.zeros((size, room // 8), np.uint8)
    enter = np.full(size, -1, np.int64)
    arcs[base, 0] |= 1  # state 0: the start, where base symbols loop
    enter[base] = 0
    users = np.zeros(size + 2, np.int64)
    users[0] = len(base) + 1  # the start itself keeps state 0
    states, known, n_known = 1, np.zeros(size, np.int64), len(base)
    known[:n_known] = base
    for u_text, v_text in merges:
        u, v, w = vocab[u_text], vocab[v_text], vocab[u_text + v_text]
        q = int(enter[u])
        if q < 0 or enter[v] < 0 or not arcs[v, q >> 3] >> (q & 7) & 1:
            continue  # no accepted sequence has u before v
        into = int(enter[v])
        if users[q] > 1 or u == v:
            if states == room:
                arcs = np.concatenate([arcs, np.zeros_like(arcs)], axis=1)
                room *= 2
            column = known[:n_known]
            bit = (arcs[column, q >> 3] >> (q & 7)) & 1
            arcs[column, states >> 3] |= bit << np.uint8(states & 7)
            users[q] -= 1
            enter[u], q = states, states
            users[states] = 1
            states += 1
        arcs[v, q >> 3] &= np.uint8(255 ^ (1 << (q & 7)))
        arcs[w] |= arcs[u]
        if enter[w] < 0:
            known[n_known] = w
            n_known += 1
            enter[w] = into
            users[into] += 1
    width = (states + 7) // 8
    rows: dict[bytes, int] = {}
    row = np.array([rows.setdefault(arcs[t, :width].tobytes(), len(rows)) for t in range(size)], np.int32)
    return Automaton(vocab, enter.astype(np.int32), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width), row)


def load(path: str) -> tuple[Automaton, tuple[tuple[str, int], ...], tuple[str, dict[int, str]]]:
    """The automaton of a tokenizer file, its added tokens by name and id, and what the library makes of single characters."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
        raise ValueError("a BPE file with word ends is needed")
    added = tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    extra = {name for name, _ in added}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    return build({t: i for t, i in model["vocab"].items() if t not in extra}, merges), added, characters(text)


@functools.cache
def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte value: itself where printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest, own = iter(range(256)), set(shown)
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


#: The contractions of the vocabulary file's word pattern, and the blanks of Unicode's White_Space.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() also splits at these, which the pattern takes as symbols.
ODD = "\x1c\x1d\x1e\x1f"


def ranges(points: list[int]) -> str:
    """A character class of ascending code points."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def characters(spec: str) -> tuple[str, dict[int, str]]:
    """The word pattern with the library's own letters and numbers, and the characters that its normalizer treats otherwise than Python.

    Unicode versions differ, so every code point of the planes that hold letters is asked once. In
    "xc#" a letter is drawn to the x before it, a symbol to the # after it, and a number to neither.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    points = [c for c in [*range(0x80, 0x40000), *range(0xE0000, 0xE1000)] if not 0xD800 <= c <= 0xDFFF]
    kinds: dict[str, list[int]] = {"letter": list(range(0x61, 0x7B)), "number": list(range(0x30, 0x3A))}
    other: dict[int, str] = {}
    split = library.pre_tokenizer.pre_tokenize_str
    for first in range(0, len(points), 1 << 12):
        part = points[first : first + (1 << 12)]
        cut = {a: z for _, (a, z) in split(" ".join(f"x{chr(c)}#" for c in part))}
        for k, c in enumerate(part):  # four places each: x, the character, #, blank
            if cut[4 * k] == 4 * k + 2:
                kinds["letter"].append(c)
            elif cut.get(4 * k + 1) == 4 * k + 2:
                kinds["number"].append(c)
        normal = library.normalizer.normalize_str("|".join(map(chr, part))).split("|")
        if len(normal) == len(part):
            other |= {c: n for c, n in zip(part, normal) if n != lowered(chr(c)) and not chr(c).isspace()}
    kinds["letter"] = sorted(kinds["letter"] + list(range(0x41, 0x5B)))
    letters, numbers = ranges(kinds["letter"]), ranges(kinds["number"])
    return rf"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{BLANKS}{letters}{numbers}]+", other


def lowered(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # one sigma, wherever it stands
    return text.lower()


class Codec:
    """Whole texts to ids as text, and back to the labels, with a bounded store of pieces already seen."""

    def __init__(self, automaton: Automaton, added: tuple[tuple[str, int], ...], characters: tuple[str, dict[int, str]]):
        self.automaton, self.added = automaton, dict(added)
        self.words, self.other = re.compile(characters[0]), characters[1]
        self.rare = re.compile(f"[{ranges(sorted(self.other))}]") if self.other else None
        self.split_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.number = {i: str(i) for i in automaton.label}
        self.known: dict[str, tuple[str, str]] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        """Codes of pieces that are not known: their words are encoded together."""
        cut = {p: [p] if p.isalpha() and p.isascii() else self.words.findall(p) for p in pieces}
        words = list({w for c in cut.values() for w in c})
        codes = {}
        for w, ids in zip(words, self.automaton.encode_all([w.encode() for w in words])):
            codes[w] = " ".join([self.number[i] for i in ids]), self.automaton.decode(ids)
        for p, c in cut.items():
            self.known[p] = code = codes[c[0]] if len(c) == 1 else (" ".join([codes[w][0] for w in c]), " ".join([codes[w][1] for w in c]))
            self.held += ENTRY_BYTES + 2 * len(p) + len(code[0]) + len(code[1])

    def pieces(self, text: str) -> list[str]:
        """The blank-separated pieces of a text without added tokens; no word spans a blank."""
        if self.rare and not text.isascii() and self.rare.search(text):
            text = text.translate(self.other)
        text = lowered(text)
        return self.words.findall(text) if any(c in text for c in ODD) else text.split()

    def parts(self, text: str) -> list[str | tuple[str, str]]:
        """Pieces, and between them added tokens with their codes."""
        if self.split_added is None or "<|" not in text:
            return self.pieces(text)
        parts, at = [], 0
        for m in self.split_added.finditer(text):
            parts += self.pieces(text[at : m.start()])
            parts.append((str(self.added[m[0]]), m[0]))
            at = m.end()
        return parts + self.pieces(text[at:])

    def encode_all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by a space, labels joined by a space."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known, cut = self.known, [self.parts(t) for t in texts]
        missing: set[str] = set()
        for parts in cut:
            missing.update(p for p in filterfalse(known.__contains__, parts) if isinstance(p, str))
        self.learn(missing)
        out = []
        for parts in cut:
            codes = [c for c in [known[p] if isinstance(p, str) else p for p in parts] if c[0]]
            ids = " ".join([c[0] for c in codes])
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join([c[1] for c in codes])))
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        return self.encode_all([text])[0]

    def leave(self) -> None:
        """Lets go of what can be made again."""
        self.known.clear()
        self.held = 0
        self.automaton.__dict__.pop("trie", None)


_SENT: dict[tuple[str, str], Broadcast] = {}


def sent(spark: SparkSession, path: str) -> Broadcast:
    """The tables of a tokenizer file, sent once an application; the driver keeps no copy. Their size is set by the vocabulary."""
    key = spark.sparkContext.applicationId, path
    if key not in _SENT:
        _SENT.clear()
        _SENT[key] = spark.sparkContext.broadcast(load(path))
        trim()
    return _SENT[key]


@functools.lru_cache(maxsize=1)
def codec(held: Broadcast) -> Codec:
    """One codec a Python worker, which keeps the pieces it knows from task to task."""
    return Codec(*held.value)


def coded(spark: SparkSession, docs: DataFrame, path: str, carry: list[str], digests: bool = True) -> DataFrame:
    """``carry`` columns, ``n_tokens``, and sha256 digests of ids and of the decoded text, or the two texts themselves.

    Null texts count as empty; an empty text has no ids and decodes to an empty text. Rows are
    independent, so repeated rows and ids are fine; very long texts and words pass through in
    blocks; columns not in ``carry`` are not read; an empty table gives no rows.
    """
    held = sent(spark, path)
    source = docs.select(*carry, text_or_empty().alias(hidden(carry, "text")))
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = docs.select(*carry).schema.add("n_tokens", "long").add(names[0], "string").add(names[1], "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held)
        settle("tokens", own.leave)
        for batch in slices(batches, -1, 2 << 20):
            n, *texts = zip(*own.encode_all(batch.column(-1).to_pylist()))
            if digests:
                texts = [[hashlib.sha256(t.encode()).hexdigest() for t in c] for c in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in texts)], names=schema.names
            )
        trim()  # the worker lives on for tasks of other stages

    return source.mapInArrow(run, schema)
