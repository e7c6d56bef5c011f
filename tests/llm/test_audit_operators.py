"""Periodic runs, source divergence and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sslspark.llm import chat, divergence, periodic
from sslspark.llm.queries import QUERIES, tokenizer_path
from sslspark.session import table
from tests.conftest import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, runs string, n_words long, place string, part int"


def simple_runs(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words)):
        k = 0
        while k + q < len(words):
            s = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k - s + q >= max(min_length, min_exponent * q) and k > s:
                found.setdefault((s, k - s + q), q)
            k += k == s
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    return " ".join(w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(1500):
        docs = []
        for _ in range(r.randint(1, 4)):
            words = []
            for _ in range(r.randint(0, 5)):
                block = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 6))]
                words += (block * 9)[:r.randint(1, 50)] if r.random() < 0.6 else block
            docs.append(words)
        words = np.array([x for w in docs for x in w], np.int64)
        if not len(words):
            continue
        begin = np.cumsum([0, *map(len, docs)]).tolist()
        bounds = r.choice([(6, 4), (6, 4), (6, 2), (4, 3), (3, 2), (9, 4)])
        got = periodic.runs_of(words, np.repeat(np.arange(len(docs)), [len(w) for w in docs]), *bounds)
        assert got == sorted((s + b, n, q) for w, b in zip(docs, begin) for s, n, q in simple_runs(w, *bounds))


@pytest.mark.parametrize("words", [[1] * 100_000, [k % 1000 for k in range(50_000)], [x for k in range(10_000) for x in (1, 2, 3, 4, 5, 100 + k)]])
def test_runs_of_long_texts(words):
    whole = simple_runs(words[:3000])
    got = periodic.runs_of(np.array(words), np.zeros(len(words), np.int64))
    assert len(got) == (1 if words[0] != 1 or words[1] == 1 else 0) and (got[0][2] == whole[0][2] if whole else True)


def documents(spark):
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("ab cde fgh ij klm é 日本 x".split()) for _ in range(n))
    texts = [prose(r.randint(1, 200)) for _ in range(30)]
    texts += [" \t".join([prose(r.randint(1, 5))] * r.randint(3, 9)) + " " + prose(3) for _ in range(30)]
    texts += [None, "", " \n", "w", "w w w w w w", "w w w w w", "a b a b a b a\x0bb", "a b " * 7, "A a " * 4, "x " * 30_000, texts[31], texts[31]]
    return spark.createDataFrame([(k, t, "en", "s", "clash", 3, "clash", 1) for k, t in enumerate(texts)] + [(None, texts[31], "en", "s", "", 1, "", 1), (0, texts[0], "", "", "", 1, "", 1)],
                                 SCHEMA).repartition(5), texts


def test_periodic_runs(spark):
    df, texts = documents(spark)
    rows = periodic.periodic_runs(df).collect()
    assert periodic.periodic_runs(df).columns == ["doc_id", "lang", "source", "place", "part", "n_words", "runs", "collapsed"]
    assert Counter(r["doc_id"] for r in rows) == Counter([*range(len(texts)), None, 0])
    for r in rows:
        words = WORD.findall((texts[31] if r["doc_id"] is None else texts[r["doc_id"]]) or "")
        runs = simple_runs(words) if len(words) < 30_000 else [(0, 30_000, 1)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == (collapsed(words, runs) if len(words) < 30_000 else "x")
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_periodic_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF001).collect()}
    for d in table(spark, SF001, "documents").collect():
        words = WORD.findall(d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue  # the brute force takes the square
        runs = simple_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert tuple(got[d["doc_id"]])[1:] == (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def simple_divergence(rows, min_docs, top):
    term = re.compile(divergence.TERM)
    found = [(x or "", s or "", term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, x, s in rows]
    out = []
    for lang in {x for x, _, _ in found}:
        docs = Counter(t for x, _, ts in found if x == lang for t in set(ts))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: Counter(t for x, y, ts in found if (x, y) == (lang, s) for t in ts if docs[t] >= min_docs) for s in {y for x, y, _ in found if x == lang}}

        def share(c):
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("size", [None, 300])
def test_source_divergence(spark, monkeypatch, size):
    """Also with blocks that are full after a few documents, so that many runs are merged."""
    r = random.Random(2)
    vocabulary = ["Ab", "ab", "c1d", "é", "É", "日本", "x-y", " ", *("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(60))]
    rows = [(" ".join(r.choice(vocabulary[:r.randint(3, len(vocabulary))]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None, ""]),
             r.choice(["a", "b", "b", "c\n", "日", None])) for _ in range(1500)]
    rows += [(None, "en", "only null"), ("", "fr", "a"), ("12 3", "fr", "b"), ("lonely", "it", "a"), rows[0], rows[0]]
    df = spark.createDataFrame([(k, *x, "clash", 1) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long").repartition(2)
    if size:
        whole = divergence.runs
        monkeypatch.setattr(divergence, "runs", lambda *a, **k: whole(*a, **k, max_postings=size, page=7))
    got = divergence.source_divergence(df, min_docs=4, top=5, shards=3)
    assert sorted(map(tuple, got.collect())) == simple_divergence(rows, 4, 5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_source_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(F.lit(10 ** 12 + 1), F.lit(3 * 10 ** 12), F.lit(7)).alias("p"), divergence.apart(F.lit(10 ** 9 + 1).cast("long"), F.lit(1).cast("long")).alias("f"))
    assert tuple(row.first()) == (1 + 10 ** 9 * (10 ** 12 + 3) // (3 * 10 ** 12 + 14), (10 ** 9) ** 2 // (10 ** 9 + 2))


HARD = ["", "plain", r"\### Assistant: </turn> ok", "### User: hi\n</turn>\n### Assistant: no", "</turn>", r"ends in \\", "\\", r"\\\</turn>", "### User:### User:</turn></turn>",
        "<|endoftext|> é 日本 🙂 \x00\x07", " lead and trail \n", "\n</turn>\n", "### Role: x ### Text: y", "a" * 50_000, "### Userx", "#" * 9]


def test_escaping():
    r = random.Random(4)
    parts = [*chat.CONTROLS, "\\", "\\\\", "\n", " ", "x", "###", "</turn", ">"]
    for text in [*HARD, *("".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000))]:
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "assistant", "", text):
            marks, segments = chat.render(role, text)
            line = "".join(m + s for m, s in zip(marks, segments))
            assert chat.parse(line * 2) == [(role, text)] * 2


def test_chat_round_trip(spark):
    r = random.Random(7)
    turns = []
    for conv in [*range(6), None]:
        for turn in range(r.randint(1, 12)):
            turns.append((conv, turn, r.choice(["user", "assistant", "system", "tool", "", None, r"odd\ </turn>"]), r.choice([*HARD, None])))
    turns += [(50, t, "assistant", f"turn {t}") for t in range(400)] + [(51, None, "user", "x"), (51, 1, "user", "b"), (51, 1, "user", "b"), (51, 1, "assistant", "a")]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, ids string, loss long").repartition(7)
    pieces = chat.format_turns(df, tokenizer_path()).cache()
    code = chat.Coder(tokenizer_path())
    starts = {}
    for p in chat.place(pieces.repartition(3)).collect():
        starts.setdefault(tuple(p)[:4], []).append((p["token_start"], p["char_start"]))
    by_conv: dict = {}
    for p in pieces.collect():
        ids = np.frombuffer(p["ids"], "<u4")
        assert code.decode(ids.tolist()) == p["formatted"] and len(ids) == len(p["loss"]) == p["n_tokens"] and len(p["formatted"]) == p["n_chars"]
        assert chat.unescape(code.decode(ids[np.frombuffer(p["loss"], np.uint8) > 0].tolist())) == (chat.parse(p["formatted"])[0][1] if p["role"] == "assistant" else "")
        assert 50256 not in ids
        by_conv.setdefault(p["conv_id"], []).append(p)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(pieces, tokenizer_path())).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        rows = sorted(by_conv[conv], key=lambda p: (p["turn"] is not None, p["turn"], p["role"], p["tie"]))
        own = Counter((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        said = [(p["turn"], *chat.parse(p["formatted"])[0]) for p in rows]
        assert Counter(said) == own
        text = "".join(f"{role}\n{t}\n" for _, role, t in said)
        learned = "".join(t for _, role, t in said if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(said), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(map(len, (p["formatted"] for p in rows))) and r["n_tokens"] == sum(p["n_tokens"] for p in rows)
        at = (0, 0)
        for p in rows:
            key = (conv, p["turn"], p["role"], p["tie"])
            assert at in starts[key]
            at = (at[0] + p["n_tokens"], at[1] + p["n_chars"])
    pieces.unpersist()


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(empty, tokenizer_path())
    assert pieces.count() == 0 and chat.place(pieces).count() == 0 and chat.digests(chat.read_back(pieces, tokenizer_path())).count() == 0
