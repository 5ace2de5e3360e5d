"""Conversation repair, importance resampling and language identification against brute force on hard small tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pipeweave.llm import common, conversations, languages, registry, resampling

TURNS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def make_turns(seed=5, n=40, longest=6):
    r = random.Random(seed)
    texts = ["Yes.", "And so on", "", " \t", "Why?", "Go on!  ", "No.", None, "one. two"]
    out = []
    for c in range(n):
        out += [(c, t if r.random() > 0.1 else r.choice([None, t + 3]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)) for t in range(r.randrange(1, longest))]
    out += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hello."), (None, 2, "assistant", "Hello.")]
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def judged(rows):
    """(turn, role, text, fault) in order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], digest(v[1], v[2])))
    out, seen = [], set()
    for t, role, text in rows:
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def cheapest(rows):
    """All edits of all rows with up to two insertions at each place, by exhaustive search over (cost, initials)."""
    best = (2 * len(rows), "D" * len(rows), [])

    def walk(i, cost, initials, out, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r[:1] in tuple("sua") else "x" for r, _ in out)):
            best = min(best, (cost, initials, out))
        if not re.fullmatch("s?(ua)*u?", "".join(r[:1] if r[:1] in tuple("sua") else "x" for r, _ in out)):
            return
        if inserted < 2:
            for r in ("user", "assistant"):
                walk(i, cost + 5, initials + "I", [*out, (r, "")], inserted + 1)
        if i < len(rows):
            _, role, text, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            walk(i + 1, cost + 2, initials + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                walk(i + 1, cost + more, initials + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    walk(i + 1, cost + more + 1, initials + "R", [*out, (r, text)], 0)

    walk(0, 0, "", [], 0)
    return best


def expected(turns):
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t, role, text))
    out = {}
    for c, rows in by.items():
        rows = judged(rows)
        cost, audit, kept = cheapest(rows)
        numbers = [t for t, *_ in rows if t is not None]
        faults = Counter(f for *_, f in rows)
        initials = [r[:1] for _, r, *_ in rows]
        out[c] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                  sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def repaired(spark, turns, **how):
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("clash") for c in ("digest", "part", "fault", "cost", "identity", "copies")}).repartition(3)
    out = conversations.repair(df, **how)
    hashes = {r[0]: r[1] for r in conversations.digests(out.turns).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in out.summary.collect()}


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_repair_is_the_cheapest(spark, block):
    turns = make_turns()
    assert repaired(spark, turns, block=block) == expected(turns)


def test_a_conversation_crosses_tasks_and_blocks(spark):
    r = random.Random(8)
    turns = [(7, t, r.choice(["user", "user", "assistant", "system", "tool"]), r.choice([f"Turn {t}.", f"Turn {t}", "", "Twice.", f"{t}?"])) for t in range(3000)]
    turns += [(c, t, "user", f"{c} {t}.") for c in (1, 9) for t in range(3)]
    small, whole = repaired(spark, turns, block=50), repaired(spark, turns)
    assert small == whole and len(small) == 3
    shortest = conversations.make_shortest()
    rows = judged([(t, role, x) for c, t, role, x in turns if c == 7])
    classes = "".join((v[1][:1] if v[1][:1] in tuple("sua") else "x") + {"blank": "!", "duplicate": "!", "truncated": "~", "": "."}[v[3]] for v in rows)
    paths = shortest(classes, "start")
    assert small[7][5:7] == min(paths[q] for q in conversations.FINAL if q in paths)


def test_damage_and_empty_conversations(spark, tmp_path):
    rows = make_turns(seed=2, n=300, longest=5)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    text = lambda v: " " if v is None else str(v)
    kept, ids = [], {r[0] for r in rows}
    for c, t, role, x in rows:
        kind = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        role, x = text(role), text(x)
        role = "user" if kind == 4 else role
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        kept += [(c, t, role, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ids} | expected(kept)
    got = {r[0]: tuple(r)[1:] for r in registry.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want


def test_no_conversations(spark):
    assert repaired(spark, []) == {}


SCHEMA = "doc_id bigint, text string"
WORDS = ["alpha", "Beta", "GAMMA", "d4", "élan", "straße", "x_y", "a-b", "日本"]


def drawn(docs, target, longest, buckets, percent=10, least=20):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def feats(t):
        w = found(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)), Counter(b for _, x in target for b in feats(x))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in feats(x))
        rows.append([i, len(found(x)), len(feats(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(long_enough[:percent * len(long_enough) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, longest):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randrange(60)))) for i in range(200)] + [(i % 3, "same words " * 15) for i in range(9)] + [(None, None), (None, "one"), (500, ""), (501, "long " * 20000)]
    target = [(0, "alpha beta gamma " * 5), (1, None)]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("clash") for c in ("words", "row", "rank", "score", "place")}).repartition(3)
    got = resampling.resample(df, spark.createDataFrame(target, SCHEMA), longest=longest, buckets=100, percent=30).collect()
    assert sorted(map(tuple, got), key=repr) == drawn(docs, target, longest, 100, 30)


def test_resampling_of_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(nothing, nothing).count() == 0
    one = spark.createDataFrame([(1, "few words")], SCHEMA)
    assert [r["rank"] for r in resampling.resample(one, nothing).collect()] == [None]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((dict(zip(names, r)) for r in found.fetchall()), key=repr)
    assert sorted(({c: r[c] for c in names} for r in df.collect()), key=repr) == want and sorted(names) == sorted(df.columns)


LANGS = {"aa": ["ola", "mundo", "casa", "você"], "bb": ["hello", "world", "house", "thing"], "cc": ["привет", "мир", "дом"]}


def language_docs():
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(LANGS[x], k=r.randrange(3, 40))), x) for i, x in enumerate(r.choices(list(LANGS), k=200))]
    return [*rows, (900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "HELLO WORLD " * 40000, None), (904, "日本", None), (None, "Casa mundo casa", None), (906, "Casa mundo casa", "aa"), (906, "Casa mundo casa", "aa")]


def test_language_id(spark):
    rows = language_docs()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in ("order_", "n", "k", "c", "score", "lang_pred")}).repartition(3)
    model = languages.fit(df, train=common.fold("doc_id", 5) != 0, per_language=60, landmarks=30)
    assert model.languages == ["aa", "bb", "cc"] and model.n_landmarks <= 30
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, r.score) for r in languages.predict(df, model).collect())
    assert len(out) == len(rows) and all(0 <= s <= 1 for *_, s in out)
    found = dict((i, p) for i, p, _ in out)
    assert all(found[i] == x for i, t, x in rows if t and i is not None and i < 900)
    assert [found[i] for i in (900, 901, 902, 903, -1, 906)] == ["und", "und", "und", "bb", "aa", "aa"] and found[904] in model.languages
    again = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, r.score) for r in languages.predict(df.repartition(2), model).collect())
    assert [x[:2] for x in again] == [x[:2] for x in out] and all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(out, again))


def test_kernel_values_are_those_of_sets(spark):
    import numpy as np

    df = spark.createDataFrame(language_docs(), "doc_id bigint, text string, lang string")
    model = languages.fit(df, per_language=60, landmarks=30)
    texts = ["Casa, mundo casa", "hello", "привет hello", "a" * 30]
    presence, held = languages.make_presence(model.letters, model.trie), np.unpackbits(model.held, axis=1, count=model.n_landmarks)
    fold = lambda t: [model.letters.get(c.lower(), 1) if c.isalpha() else 0 for c in t]
    place = {0: ()}
    for _ in range(languages.LONGEST):
        for r, line in enumerate(model.trie[:-1]):
            place |= {to: (*place[r], c) for c, to in enumerate(line) if to != len(model.trie) - 1 and r in place}
    rows = {runs: row for row, runs in place.items()}
    kernel = np.concatenate([k for k, _ in languages.make_kernel(model)(texts)])
    for t, line in zip(texts, kernel):
        c = fold(t)
        own = {tuple(c[i:i + n]) for n in range(1, languages.LONGEST + 1) for i in range(len(c) - n + 1)} & set(rows)
        assert own == {place[i] for i in np.flatnonzero(presence(t)[0])}
        for k, value in enumerate(line):
            theirs = {place[i] for i in np.flatnonzero(held[:, k])}
            assert value == pytest.approx(len(own & theirs) / math.sqrt(max(len(own), 1) * len(theirs)), abs=1e-5)


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in languages.predict(df, languages.fit(df)).collect()} == {("und", 0.0)}
    assert languages.predict(df.where("false"), languages.fit(df.where("false"))).count() == 0
