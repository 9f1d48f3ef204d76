"""Training-data operators against brute force, and their odd inputs."""

import copy
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from amberline.llm import bpe_automaton, common, mixing, pii, quality, secrets, simhash, suffix_dedup, token_store, toxicity, vptree

ODD = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, "\n \t\n"), (5, "one two three four five six seven eight nine ten eleven"), (5, "same id, other text"),
    (None, "no id, mail a.b@c.de, call +1 (555) 123-4567 now"), (6, "é" * 70 + "\x00\U0001f600 ñ"), (7, "word " * 30000), (8, "1.2.3.4 " * 2000 + "999.1.1.1"), (9, "password = hunter22\ntoken: 'abcdef0123456789abcdef0123456789'"), (1, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"src{k % 2}" if k else None, len(t or ""), "x", "y") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, fp string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def empty(docs):
    return docs.limit(0)


# toxicity


def test_toxicity_on_held_out_rows(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.scored(spark, spark.read.parquet(f"{base}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    bad, good = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    assert len(bad) > 5 and np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.95  # area under the curve
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got.select("doc_id", "held_out").collect())


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, 0), (None, 1), (7, None), (1, 1)], "doc_id long, toxic int")
    got = toxicity.scored(spark, odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.scored(spark, odd, labels.where("toxic = 0")).count() == len(ODD)
    assert toxicity.scored(spark, empty(odd), labels).count() == 0


# personal data


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii_base_spans(spark, docs, texts):
    rnd = random.Random(3)
    parts = ["a", "@", "b.c", ".", "1", "25", "4111111111111111", " ", "-", "+1 ", "(555) ", "1.2.3.4", "%_", "é", "\U0001f600", "\n", "x@y.zz", "999"]
    made = {10**6 + i: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for i in range(400)}
    made |= {2 * 10**6: "9" * 30000, 2 * 10**6 + 1: "a" * 30000 + "@", 2 * 10**6 + 2: "x@y.zz " * 3000}
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    for r in pii.scanned(spark, both).collect():
        spans = base_pii((texts | made)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(shown(spans).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in spans) for k in pii.KINDS[:4]]
        assert set(shown(spans).split(",")) <= {"", *r["spans"].split(",")}


def test_pii_votes_add_spans(spark):
    seen = [(i, f"please call me, my phone is ({438 + i % 5}) 555-{1000 + i} ok") for i in range(60)] + [(100 + i, f"invoice 111 111 1111 total {i}") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.scanned(spark, spark.createDataFrame(seen, "doc_id long, text string")).collect()}
    assert all("phone" in got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_pii_odd_rows(spark, odd):
    assert pii.scanned(spark, odd).count() == len(ODD) and pii.scanned(spark, empty(odd)).count() == 0
    out = pii.redacted(spark, odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    row = out.where("doc_id is null").first()
    assert row["text"] == "no id, mail [EMAIL], call [PHONE] now" and row["n_chars"] == len(row["text"])
    assert pii.redacted(spark, empty(odd)).count() == 0


def test_pii_main_path_has_no_python(spark, docs):
    plan = pii.redacted(spark, docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# secrets


def base_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_base_spans(spark, docs, texts, odd):
    rnd = random.Random(5)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef", "x1/y", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "é", "\n", "ſecret=", "toKen=abcdef"]
    made = {10**6 + i: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for i in range(500)}
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    for r in secrets.scanned(spark, both).collect():
        spans = base_secrets((texts | made)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(shown(spans).encode()).hexdigest(), r["doc_id"]
        assert set(shown(spans).split(",")) <= {"", *r["spans"].split(",")}
    assert secrets.scanned(spark, odd).count() == len(ODD) and secrets.scanned(spark, empty(odd)).count() == 0


def test_secrets_follow_constants():
    text = 'raw = "aB3$kk29xQzP"\nmiddle = raw\nconfig.db_password = middle\ncolor = "aB3$kk29xQzQ"\nauth_key = "changeme-example"\n'
    _, spans = secrets.scan(text)
    assert [text[a:b] for k, a, b in spans if k == "named"] == ["aB3$kk29xQzP"]
    assert secrets.scan("a = b\nb = a\npassphrase = a\nb = 'Zx91!kkQw7'")[1]


SHAPES = [
    (r'db_password = "aB3$\"kk29xQzP"', r'aB3$\"kk29xQzP'), ('os.environ["SECRET_KEY"] = "aB3kk29xQzP7"', "aB3kk29xQzP7"), ('define("DB_PASSWORD", "aB3kk29xQzP7");', "aB3kk29xQzP7"),
    ("<password>aB3kk29xQzP7</password>", "aB3kk29xQzP7"), ("signing_key: |\n  aB3kk29xQzP7\nother: 1", "aB3kk29xQzP7"), ("run --auth-token=aB3kk29xQzP7", "aB3kk29xQzP7"),
    ('<add key="ApiSecret" value="aB3kk29xQzP7"/>', "aB3kk29xQzP7"), ("- name: DB_PASSWORD\n  value: aB3kk29xQzP7", "aB3kk29xQzP7"), ('passphrase = "correct horse battery staple"', "correct horse battery staple"),
    ('passphrase = "Please enter your own words"', None), ('colour = "aB3kk29xQzP7"', None), ("<title>aB3kk29xQzP7</title>", None), ('password_hint = "example example"', None),
]


@pytest.mark.parametrize("text,value", SHAPES)
def test_secret_shapes(text, value):
    found = [text[a - 2 : b - 2] for _, a, b in secrets.scan("x\n" + text)[1]]
    assert any(value in x for x in found) if value else not found


def test_pairs_against_a_plain_scanner():
    """The pattern of pairs finds what a search from every place finds, on texts without escapes or other shapes."""
    plain = re.compile(r"""(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)(?P=quote)[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([A-Za-z0-9+/_.~$-]+=*))""")
    rnd = random.Random(12)
    for _ in range(3000):
        t = "".join(rnd.choice(["ab", "k_1", "=", ":", " ", '"', "'", "\n", "zz9", "\t", "=>", ":="]) for _ in range(rnd.randint(1, 14)))
        at, want = 0, set()
        while m := plain.search(t, at):
            group = next(k for k in (3, 4, 5) if m[k] is not None)
            want.add((m["name"], m[group].strip()))
            at = m.end()
        assert {(x[0], x[1]) for x in secrets.lex(t)[0]} == want, t


def test_secret_scan_is_linear():
    import time

    for text in ("key: x " + "w" * 1_000_000, 'secret="' * 100_000, "password" + " " * 500_000 + "x", "a.b-" * 250_000 + "key=", '["' * 300_000 + "token=", "<key" * 200_000, "key:|\n " * 150_000, "token = a + " * 80_000):
        began = time.process_time()
        secrets.scan(text)
        assert time.process_time() - began < 20, text[:20]


# SimHash


def test_simhash_against_all_pairs(spark, docs, texts):
    def print_of(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            return 0
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    more = {10**6 + i: t[: len(t) - 3 * i] for i, t in enumerate(list(texts.values())[:40])} | {2 * 10**6: "", 2 * 10**6 + 1: None, 2 * 10**6 + 2: "a b", 2 * 10**6 + 3: "İ A B C d"}
    every = texts | more
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    prints = {i: print_of(t) for i, t in every.items()}
    root = {i: i for i in every}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(every)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for r in simhash.components(spark, both).collect():
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == find(r["doc_id"])


def test_dense_and_hot_buckets(spark, monkeypatch):
    rnd = random.Random(1)
    prints = list({sum(1 << b for b in rnd.sample(range(18), rnd.randint(0, 3))) - (1 << 63) * 0 for _ in range(900)} | {rnd.getrandbits(63) for _ in range(200)})
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {p: p for p in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(prints, dtype=np.uint64)
    for k, p in enumerate(prints):
        for q in array[:k][np.bitwise_count(array[:k] ^ np.uint64(p)) <= 4].tolist():
            a, b = find(p), find(q)
            root[max(a, b)] = min(a, b)
    for hot in (simhash.HOT_KEY, 50):
        monkeypatch.setattr(simhash, "HOT_KEY", hot)
        found = {r["node"]: r["root"] for r in common.connected_components(spark, simhash.links(spark, nodes, 4)).collect()}
        assert all(found.get(p, p) == find(p) for p in prints)


def test_no_table_of_unknown_size_is_broadcast(spark, monkeypatch):
    """Before, keys with a bit flipped were broadcast at the estimated size of the table that they explode, and texts at that of their file."""
    plans, staged = {}, simhash.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "stage", lambda s, df, name: (plans.setdefault(name, plan(df)), staged(s, df, name))[1])
    rows = [(k, " ".join(f"w{k // 2}x{j}" for j in range(40)) + f" y{k}") for k in range(40)]
    kept = simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(range(0, 40, 2))
    assert all("BroadcastHashJoin" not in plans[name] for name in ("hotkeys", "ring-links", "links"))


def test_similar_groups(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(300)]
        near = list(base)
        near[rnd.randrange(300)] = word()
        far = base[:150] + [word() for _ in range(150)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far)), (10 * k + 3, " ".join(base))]
    kept = {r["doc_id"] for r in simhash.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(10 * k in kept for k in range(60)) == 60 and sum(10 * k + 2 in kept for k in range(60)) == 60
    assert not any(10 * k + 3 in kept for k in range(60)) and sum(10 * k + 1 in kept for k in range(60)) <= 2


def test_similar_groups_are_exact(spark, monkeypatch):
    rnd = random.Random(3)
    rows, shared = [], [f"s{k}" for k in range(60)]
    for k in range(60):
        base = shared[: 60 * (k % 2)] + [f"w{rnd.randrange(10**6)}" for _ in range(240)]
        for edits in (0, 2, 3, 5, 6, 7, 8, 9, 12):  # J of about 0.95 down to 0.6
            near = list(base)
            for at in rnd.sample(range(60, len(near)), edits):
                near[at] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(near)))
    base = [f"b{k}" for k in range(80)]
    for k in range(40):  # one group in which many pairs are just under and over 0.8
        near = list(base)
        for at in rnd.sample(range(80), 1 + k % 2):
            near[at] = f"x{rnd.randrange(10**6)}"
        rows.append((len(rows), " ".join(near)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity, hot in ((0.7, 4096), (0.8, 4096), (0.8, 10), (0.95, 4096)):
        monkeypatch.setattr(simhash, "HOT_KEY", hot)
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for j in range(len(rows)):
            for i in range(j):
                common_ = len(sets[i] & sets[j])
                if common_ >= similarity * (len(sets[i]) + len(sets[j]) - common_) - 1e-9:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        found = {}
        for r in simhash.similar_groups(spark, docs, ["doc_id"], 5, similarity).collect():
            found.setdefault(r["root"], set()).add(r["doc_id"])
        expected = {}
        for k in range(len(rows)):
            expected.setdefault(find(k), set()).add(k)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values())), similarity


def test_simhash_odd_rows(spark, odd):
    assert simhash.components(spark, odd).count() == len(ODD) and simhash.components(spark, empty(odd)).count() == 0
    kept = simhash.keep_first(spark, odd)
    assert kept.columns == odd.columns and 0 < kept.count() < len(ODD)
    assert simhash.keep_first(spark, empty(odd)).count() == 0


# suffix arrays


@pytest.mark.parametrize("n,symbols", [(1, 2), (2, 1), (60, 1), (300, 2), (2000, 3), (3000, 256)])
def test_suffix_array(n, symbols):
    t = np.random.default_rng(n).integers(0, symbols, n).astype(np.uint8)
    array, body = suffix_dedup.suffix_array(t), t.tobytes()
    assert sorted(array.tolist()) == list(range(n))
    keys = [body[i : i + 50] for i in array]
    assert keys == sorted(keys)
    for i, j, got in zip(array[:-1], array[1:], suffix_dedup.equal_prefix(t, array[:-1], array[1:])):
        if max(i, j) + 50 <= n:
            assert got == next((k for k in range(50) if body[i + k] != body[j + k]), 50)


def brute_removal(rows):
    first = {}
    for i, t in sorted(rows):
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_passages(spark, docs, texts, monkeypatch):
    for name, size in (("BUCKET_BYTES", 60_000), ("SLICE_BYTES", 50_000), ("GROUP_BYTES", 80_000)):
        monkeypatch.setattr(suffix_dedup, name, size)
    more = {10**6: "x" * 3000, 10**6 + 1: "x" * 49, 10**6 + 2: "y" + "x" * 800, 10**6 + 3: None, 10**6 + 4: "é" * 60, 10**6 + 5: "ab" * 700, 10**6 + 6: "b" + "ab" * 600}
    want = brute_removal([(i, (t or "").encode()) for i, t in (texts | more).items()])
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = suffix_dedup.deduplicated(spark, both).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_passages_odd_rows(spark, odd):
    got = suffix_dedup.deduplicated(spark, odd, texts=True).collect()
    assert len(got) == len(ODD) and suffix_dedup.deduplicated(spark, empty(odd)).count() == 0
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_rows_of_one_id_do_not_cut_each_other(spark):
    a, b = "first passage that is surely longer than fifty bytes in all", "wholly different words, which also run over fifty bytes, as they must"
    rows = [(5, f"x {a}"), (5, f"y {a}"), (3, b), (None, f"z {a}"), (None, f"w {a} {b}"), (None, "v " + "own words of a row without an id, over fifty bytes"), (None, "u " + "own words of a row without an id, over fifty bytes"), (7, a), (7, a)]
    got = suffix_dedup.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in got)
    assert left == sorted([(False, 5, f"x {a}"), (False, 5, f"y {a}"), (False, 3, b), (True, 0, "z"), (True, 0, "w "), (True, 0, rows[5][1]), (True, 0, rows[6][1]), (False, 7, ""), (False, 7, "")])


# token ids


def test_token_store_round_trip(spark, docs, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = {10**6: None, 10**6 + 1: "", 10**6 + 2: "a  b\n\n c\t<|endoftext|> d", 10**6 + 3: "x" * 9000, 10**6 + 4: " lead", 10**6 + 5: "a\x1cb c"}
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id long, text string")).unionAll(docs.select(F.col("doc_id") + 5000, "text"))
    every = texts | more | {i + 5000: x for i, x in texts.items()}
    store = token_store.write(spark, both, path, f"file://{tmp_path}/store")
    got = sorted(map(tuple, token_store.read(spark, store).collect()))
    start = 0
    for (doc, at, n, crc), i in zip(got, sorted(every), strict=True):
        ids = [*t.encode(every[i] or "", add_special_tokens=False).ids, 0]
        assert (doc, at, n, crc) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    stored = spark.read.parquet(f"{store}/store").where("kind = 'chunk'")
    assert stored.count() == stored.select("key").distinct().count()
    assert stored.agg(F.sum("n_tokens")).first()[0] < start - sum(1 for _ in texts) * 50  # copies are stored once
    shards = spark.read.parquet(f"{store}/manifest")
    assert shards.agg(F.sum("n_ids")).first()[0] == start


@pytest.fixture(scope="module")
def small_store(spark, docs, tmp_path_factory):
    before, token_store.SHARD_DOCS = token_store.SHARD_DOCS, 8
    yield token_store.write(spark, docs.where("doc_id < 30"), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path_factory.mktemp('t')}/store")
    token_store.SHARD_DOCS = before


def damaged(spark, path, to, **changed):
    """A copy of a store in which the named parts are changed."""
    for part in ("store", "recipes", "manifest", "total"):
        df = changed.get(part, lambda d: d)(spark.read.parquet(f"{path}/{part}"))
        (df.write.partitionBy("kind") if part == "store" else df.write).parquet(f"{to}/{part}")
    return f"file://{to}"


def longest_recipe(spark, store):
    return spark.read.parquet(f"{store}/recipes").orderBy(F.desc(F.length("keys")), "doc_id").first()


DAMAGE = {
    "changed chunk": ("does not match its key", "store", lambda d, r: d.withColumn("body", F.when(F.col("key") == F.lit(bytes(r["keys"][:32])), F.concat("body", F.lit(b"\0\0"))).otherwise(F.col("body")))),
    "lost chunk": ("is not in the store", "store", lambda d, r: d.where((F.col("kind") == "recipe") | (F.col("key") != F.lit(bytes(r["keys"][:32]))))),
    "lost recipe": ("do not match the manifest", "recipes", lambda d, r: d.where(F.col("doc_id") != r["doc_id"])),
    "lost shard": ("do not match the manifest", "recipes", lambda d, r: d.where(F.col("shard") != r["shard"])),
    "swapped chunks": ("does not match its root", "recipes", lambda d, r: d.withColumn("keys", F.when(F.col("doc_id") == r["doc_id"], F.concat(F.expr("substring(keys, 33, 32)"), F.expr("substring(keys, 1, 32)"), F.expr("substring(keys, 65)"))).otherwise(F.col("keys")))),
    "lost line of the manifest": ("does not match its total", "manifest", lambda d, r: d.where(F.col("shard") != r["shard"])),
    "changed start": ("do not match the manifest", "manifest", lambda d, r: d.withColumn("n_docs", F.col("n_docs") + F.when(F.col("shard") == r["shard"], 1).when(F.col("shard") == (r["shard"] + 1) % 2, -1).otherwise(0))),
}


@pytest.mark.parametrize("name", sorted(DAMAGE))
def test_token_store_notices_damage(spark, small_store, tmp_path, name):
    says, part, change = DAMAGE[name]
    recipe = longest_recipe(spark, small_store)
    assert len(recipe["keys"]) >= 64 and spark.read.parquet(f"{small_store}/manifest").count() >= 2
    with pytest.raises(Exception, match=says):
        token_store.read(spark, damaged(spark, small_store, tmp_path, **{part: lambda d: change(d, recipe)})).collect()


def test_undamaged_store(spark, small_store, tmp_path):
    assert token_store.read(spark, damaged(spark, small_store, tmp_path)).count() == spark.read.parquet(f"{small_store}/recipes").count() > 8


def test_encoder_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_BYTES", 2000)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = token_store.Encoder(f.read())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"alpha{k % 7} beta{k} gamma\n\u0558x\ua7cb delta" for k in range(200)]
    for _ in range(3):
        for first in range(0, 200, 40):
            part = texts[first : first + 40]
            assert [np.frombuffer(c, own.dtype).tolist() for c in own.encode(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert len(own.codes) == len(own.numbers) < 120


def test_encoder_learns_words_without_their_marks():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = token_store.Encoder(f.read())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words, marks = ["sol", "déjà", "x9", "don't", "\u0558x", "Ġy", "é\u0301"], ["", ",", "...", "?!", "').", "_", "'"]
    texts = [f"{a}{m} {b}{m}\n{a}{m}" for a in words for b in words for m in marks] + [f"{m} {a}" for a in words for m in marks[1:]]
    assert [np.frombuffer(c, own.dtype).tolist() for c in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(own.codes) < len(words) * len(marks) * 2


def test_token_store_odd_rows(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_store.round_trip(spark, odd, path).count() == len(ODD)
    assert token_store.round_trip(spark, empty(odd), path).count() == 0


def test_joined_checksums():
    rnd = random.Random(4)
    for _ in range(50):
        parts = [rnd.randbytes(rnd.randint(0, 400)) for _ in range(rnd.randint(1, 5))]
        after = np.cumsum([0, *(len(p) for p in parts[::-1])])[:-1][::-1]
        crc = np.array([zlib.crc32(p) for p in parts], np.uint32)
        assert int(np.bitwise_xor.reduce(token_store.crc_before(crc, after))) == zlib.crc32(b"".join(parts))


# the automaton


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.Codec(*bpe_automaton.load(public_tokenizers.path("word_bpe_49k.json")))


def test_automaton_equals_the_library(codec, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(6)
    pieces = [w.removesuffix("</w>") for w in list(codec.automaton.vocab)[::41]]
    made = ["", " ", "<|endoftext|> hi<|startoftext|>", "İ ΣΑΣ ẞ ǅ", "a" * 500, "don't 123 　x\x1cy\x85z", "日本語 é\U0001f389"]
    made += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))) for _ in range(800)]
    made += ["".join(rnd.choice("abcde 'é1\U0001f600") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    for x in [*list(texts.values())[:60], *made]:
        ids = t.encode(x, add_special_tokens=False).ids
        n, shown_ids, decoded = codec.encode(x)
        assert (n, shown_ids, decoded) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)), x


def test_all_kinds_of_characters(codec):
    """Letters and numbers are the library's, whatever Unicode version the other libraries have."""
    import regex

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c % 97 == 0 or bool(regex.match(r"\p{L}", chr(c))) != chr(c).isalpha())]
    assert len(points) > 11_000
    texts = [f"a{chr(c)}1 {chr(c)}# {chr(c)}" for c in points]
    library = t.encode_batch(texts, add_special_tokens=False)
    wrong = [hex(c) for c, e, (_, ids, _) in zip(points, library, codec.encode_all(texts)) if " ".join(map(str, e.ids)) != ids]
    assert not wrong, wrong[:20]


def test_long_words_walk_alike(codec, monkeypatch):
    rnd = random.Random(9)
    words = [bytes(rnd.choice(b"abcdeirnst\xc3\xa9") for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    at_once = codec.automaton.encode_all(words)
    monkeypatch.setattr(bpe_automaton, "BLOCK", 7)
    assert codec.automaton.encode_all(words) == at_once == [codec.automaton._long(w) for w in words]


def test_codec_forgets_by_bytes(codec, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "CACHE_BYTES", 1000)
    own = copy.copy(codec)
    own.known, own.held = {}, 0
    for k in range(50):
        assert own.encode(f"some{k} words{k}, here") == codec.encode(f"some{k} words{k}, here") and len(own.known) < 8


def test_small_automaton():
    vocab = {s: i for i, s in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab</w>", "aab</w>", "aa</w>"])}
    a = bpe_automaton.build(vocab, [("a", "a"), ("a", "b</w>"), ("a", "a</w>"), ("aa", "b</w>")])
    spell = lambda w: [a.label[t] for t in a.encode(w.encode())]
    assert spell("aaa") == ["aa", "a</w>"] and spell("aaaa") == ["aa", "aa</w>"] and spell("aaab") == ["aa", "ab</w>"] and spell("aab") == ["aab</w>"]


def test_codes_odd_rows(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe_automaton.coded(spark, odd, path, ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert bpe_automaton.coded(spark, empty(odd), path, ["doc_id"]).count() == 0


# mixing


def test_mix_hits_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5900, "b").otherwise("c").alias("source"))
    n = {r["source"]: r["n"] for r in mixing.mixed(spark, docs, weights={"a": 0.25, "b": 0.25, "c": 0.5}).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(n["a"] - 1500) < 200 and abs(n["b"] - 1500) < 200 and abs(n["c"] - 3000) < 250  # deviations are about 39, 39 and 55
    assert mixing.mixed(spark, docs, weights={"b": 1.0}).where("source <> 'b'").count() == 0
    assert mixing.mixed(spark, docs, weights={}).count() == 0


def test_large_rates(spark):
    draws = spark.range(2000).select(mixing.copies(F.col("id"), F.lit(700.0), 3).alias("n"))
    mean, var = draws.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - 700) < 3 and 600 < var < 800


def test_mix_is_the_same_in_any_partitioning(spark, odd):
    rows = lambda d: sorted((str(r["doc_id"]), r["copy"], r["place"]) for r in mixing.mixed(spark, d, detail=True).collect())
    assert rows(odd) == rows(odd.repartition(5)) and mixing.mixed(spark, empty(odd)).count() == 0
    assert mixing.mixed(spark, odd).columns == odd.columns


def test_rows_without_a_key_draw_apart(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("s").alias("source"))
    n = {r["text"]: r["n"] for r in mixing.mixed(spark, docs).groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(sum(n.values()) - 4000) < 300 and max(n.values()) > 2 and len(n) < 3000
    assert mixing.mixed(spark, docs, detail=True).select("place").distinct().count() > 3500


def test_a_worker_keeps_the_state_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_SETTLED", [])
    gone = []
    for owner in ("a", "a", "b", "c", "a"):
        common.settle(owner, lambda owner=owner: gone.append(owner))
    assert gone == ["a", "b", "c"]
    common.settle("d")
    assert gone == ["a", "b", "c", "a"] and common._SETTLED == []


# nearest neighbours


def test_nearest_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 300)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)).round(1)
    x[700:720] = x[0]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] * 12), (1100, [float("inf")] * 12), (None, rows[1][1]), (2000, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(spark, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 900, 100):
        d = [(float(vptree.distances(x[q : q + 1], x[i : i + 1])[0, 0]), i) for i in range(900) if i != q]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(sorted(d)[:10])]
    assert set(got) == set(range(0, 900, 100))
    assert vptree.nearest(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("x", [np.eye(1400), np.ones((5000, 3)), np.concatenate([np.eye(600), np.eye(600)])])
def test_ties_and_equal_vectors(x):
    tree = vptree.Tree.grown(np.arange(len(x)), x, leaf=16)
    own = np.arange(0, len(x), 200)
    ids, d = tree.search(own, x[own], 5)
    for q, found, away in zip(own, ids, d):
        every = sorted((float(vptree.distances(x[q : q + 1], x[i : i + 1])[0, 0]), i) for i in range(len(x)) if i != q)[:5]
        assert [(a, i) for a, i in zip(away.tolist(), found.tolist())] == every


def test_a_bound_leaves_out_only_what_is_beyond_it():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6)) + rng.integers(0, 12, (3000, 1)) * 4
    own, tree = np.arange(0, 3000, 30), vptree.Tree.grown(np.arange(3000), x, leaf=32)
    ids, d = tree.search(own, x[own], 8)
    free, limit = tree.compared, d[:, 3]
    told_ids, told = tree.search(own, x[own], 8, limit=limit)
    assert tree.compared - free < free < len(own) * 3000
    for at in range(len(own)):
        within = d[at] <= limit[at]
        assert told_ids[at][: within.sum()].tolist() == ids[at][within].tolist() and told[at][: within.sum()].tolist() == d[at][within].tolist()


def test_repeated_ids_spans_and_more_shards_than_rows(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 40)
    monkeypatch.setattr(vptree, "SPAN_QUERIES", 1)
    monkeypatch.setattr(vptree, "BLOCK_QUERIES", 1)
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=3).round(1).tolist()) for i in rng.integers(0, 12, 500)]  # an id stands on some forty rows
    rows += [(k, [float(k + 1)] * 5) for k in range(4)]  # fewer rows of this length than asked for
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(spark, df, k=10, every=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 4, 8}
    for q, found in got.items():
        asks = np.array([min(v for i, v in rows if i == q)])
        d = sorted((float(vptree.distances(asks, np.array([v]))[0, 0]), i) for i, v in rows if i != q and len(v) == asks.shape[1])[:10]
        assert sorted(found) == [(place + 1, i, s) for place, (s, i) in enumerate(d)]


def test_relaxed_search_keeps_most_neighbours():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 6
    x = np.concatenate([c + rng.normal(size=(100, 8)) for c in centres])
    tree = vptree.Tree.grown(np.arange(len(x)), x, leaf=32)
    own, q = np.arange(0, 4000, 40), x[::40]
    exact, relaxed = tree.search(own, q, 10)[0], tree.search(own, q, 10, 0.7)[0]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed)]) >= 0.9


# quality


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    cover = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    lines, earlier, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        dup += line in earlier and bool(re.search(r"[^\x20\x09-\x0D]", line))
        earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_measures(texts):
    made = ["", "\n\n", "a b c d e a b c d e", "x\x0bx x x x x x", "é é é é é é é", "a\n b\na\n b\n", " ".join(str(i % 700) for i in range(5000))]
    rnd = random.Random(8)
    made += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    made.append(" ".join([*(str(i) for i in range(9000)), *(str(i) for i in range(500))]))  # ids of five words need more than 63 bits
    for t in [*texts.values(), *made]:
        assert quality.measure((t or "").encode())[:5] == brute_quality(t)


def plain_em(rows, rounds=100):
    """The fit of quality document by document, in plain Python."""
    rules = range(quality.N_RULES)
    good = [0.1 if quality.BAD in r else 0.95 for r in rows]
    for _ in range(rounds):
        on = []
        for weights, expected, prior in (([1 - g for g in good], 0.5, 0.0), (good, quality.FALSE_ALARM, quality.PRIOR)):
            said = [sum(w for r, w in zip(rows, weights) if r[j] != quality.ABSTAIN) for j in rules]
            hits = [sum(w for r, w in zip(rows, weights) if r[j] == quality.BAD) for j in rules]
            on.append([(h + expected * (prior * n + 1)) / (n + prior * n + 1) for h, n in zip(hits, said)])
        share = min(max(sum(good) / len(rows), 0.01), 0.99)
        new = []
        for r in rows:
            odds = math.log(share / (1 - share))
            for j in rules:
                b, g = min(max(on[0][j], 1e-6), 1 - 1e-6), min(on[0][j], on[1][j])
                odds += math.log(g / b) if r[j] == quality.BAD else math.log((1 - g) / (1 - b)) if r[j] == quality.GOOD else 0
            new.append(1 / (1 + math.exp(-odds)))
        if max(abs(a - b) for a, b in zip(new, good)) < 1e-9:
            return new
        good = new
    return good


def test_quality_fit_against_documents_one_by_one():
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.8  # one rule errs on 6 % of the good documents
    on_good, on_bad = np.array([0.002, 0.002, 0.06, 0.01, 0.0, 0.005, 0.0, 0.01]), np.array([0.7, 0.6, 0.6, 0.4, 0.5, 0.6, 0.3, 0.4])
    bad = rng.random((3000, quality.N_RULES)) < np.where(truth[:, None], on_good, on_bad)
    cast = rng.random(bad.shape) < 0.9
    rows = np.where(cast, np.where(bad, quality.BAD, quality.GOOD), quality.ABSTAIN)
    patterns, counts = np.unique((rows * 3 ** np.arange(quality.N_RULES)).sum(axis=1), return_counts=True)
    fitted = quality.fit(patterns, counts)
    got = [fitted[int(p)] for p in (rows * 3 ** np.arange(quality.N_RULES)).sum(axis=1)]
    assert np.abs(np.array(got) - plain_em(rows.tolist())).max() < 1e-6
    assert np.mean((np.array(got) >= quality.KEEP_AT) == truth) > 0.97
    only = fitted[int((np.where(np.arange(quality.N_RULES) == 2, quality.BAD, quality.GOOD) * 3 ** np.arange(quality.N_RULES)).sum())]
    assert only >= quality.KEEP_AT  # a bad vote of the rule that errs does not decide on its own


def test_quality_agrees_with_labels(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    rows = quality.judged(spark, spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").select("kept", "quality", "base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1


def test_quality_stage_and_query_agree(spark, docs, odd):
    kept = {r["doc_id"] for r in quality.judged(spark, docs).where("kept").collect()}
    assert kept == {r["doc_id"] for r in quality.keep_good(spark, docs).collect()}
    assert quality.judged(spark, odd).count() == len(ODD) and quality.judged(spark, empty(odd)).count() == 0
    assert quality.keep_good(spark, odd).columns == odd.columns and quality.keep_good(spark, empty(odd)).count() == 0


def test_wide_ids_are_read_as_they_were_written(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = json.loads(open(path, encoding="utf-8").read())
    first = max(spec["model"]["vocab"].values()) + len(spec["added_tokens"]) + 1
    spec["model"]["vocab"] |= {f"never-{k}": first + k for k in range(20000)}  # no merge leads to them
    (tmp_path / "wide.json").write_text(json.dumps(spec))
    own = docs.where("doc_id < 20")
    read = token_store.read(spark, token_store.write(spark, own, str(tmp_path / "wide.json"), f"file://{tmp_path}/wide"))
    assert spark.read.parquet(f"{tmp_path}/wide/total").first()["width"] == 4
    again = token_store.read(spark, token_store.write(spark, own, path, f"file://{tmp_path}/narrow"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, again.collect())) and read.count() == own.count()
