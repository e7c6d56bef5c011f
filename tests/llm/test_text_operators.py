"""Packing, SimHash, substrings and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sslspark.llm import common, fingerprints, packing, simhash, substrings
from sslspark.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, uid string, key string, n long"


def documents(spark):
    """A passage shared by many, exact and near copies, odd white space, empty, null and long texts, clashing columns."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randint(1, 90)) for _ in range(40)]
    texts += [prose(20) + " " + passage + "\n" + prose(15) for _ in range(30)]
    copy = prose(120)
    texts += [copy] * 8 + [copy.replace(copy.split()[k], "x", 1) for k in range(5)]
    texts += ["", None, " ", "\t\n", "One two", "don't  stop \n\n now, it's.\n x <|endoftext|> y", "ends with space ", " a", " a  b",
              "w " * 3000, "1234 5,6;7 héé!! A\tB\x0bC", "日本語のテキスト" * 50]
    rows = [(k, t, "en", "s", "clash", "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-2], rows[0]], SCHEMA), texts


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer
    df, texts = docs
    placed = packing.place(packing.tokenise(df.repartition(5, "doc_id"), tokenizer_path()))
    rows = packing.pieces(placed, 64).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["length"] <= 64
        at += r["length"]
    encode = Tokenizer.from_file(tokenizer_path()).encode
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["sequence_id"], r["offset"])):
        got.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = np.array(encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        times = 2 if k in (0, len(texts) - 2) else 1
        data = b"".join(bytes(r["ids"]) for r in got[k])
        assert data == ids.tobytes() * times, t
        assert all(r["doc_tokens"] == len(ids) for r in got[k])
        for r in got[k]:
            assert bytes(r["ids"]) == ids[r["start"]:r["start"] + r["length"]].tobytes()
    windows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed, 64).collect()}
    stream = b"".join(bytes(r["ids"]) for r in rows)
    assert windows == {k: stream[256 * k:256 * k + 256] for k in range(-(-len(stream) // 256))}


def test_packing_empty(spark, docs):
    df, _ = docs
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def simple_simhash(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash_fingerprints_and_components(spark, docs):
    df, texts = docs
    found = {r["doc_id"]: r for r in simhash.simhash_dedup(df).collect()}
    fps = np.array([simple_simhash(t) for t in texts], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in fps:
        label = np.where(near, label[None, :], len(fps)).min(1)
    for k in range(len(texts)):
        assert np.int64(found[k]["fp"]).view(np.uint64) == fps[k]
        assert found[k]["component_id"] == label[k]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.tolist()))
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, d), (None, c), (9, e), (None, e)]
    kept = simhash.one_of_each(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, _row long").repartition(3))
    assert kept.columns == ["doc_id", "text", "_row"]
    assert sorted(((x[0], x[1]) for x in kept.collect()), key=lambda x: x[1]) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e)], key=lambda x: x[1])


@pytest.mark.parametrize("max_block", [2048, 4])
def test_simhash_links_of_a_dense_group(spark, max_block):
    """Hundreds of fingerprints near one another, with blocks cut again when they are large."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2 ** 63, 40, dtype=np.int64)
    dense = np.array([base[0] ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in r.integers(0, 62, (300, 3))])
    chain = [int(base[1])]
    for k in range(12):
        chain.append(chain[-1] ^ (0b111 << 5 * k))
    values = sorted({*base.tolist(), *dense.tolist(), *chain})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {x["node"]: x["root"] for x in common.connected_components(simhash.links(fps, 3, max_block=max_block)).collect()}
    x = np.array(values, np.int64)
    near = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64)) <= 3
    label = np.arange(len(x))
    for _ in range(40):
        label = np.where(near, label[None, :], len(x)).min(1)
    assert [got.get(v, v) for v in values] == x[label].tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}
    assert common.connected_components(edges.limit(0)).count() == 0


def simple_substrings(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("max_group", [4096, 3])
def test_substrings(spark, docs, max_group):
    df, texts = docs
    texts = [*texts, texts[-2], texts[0]]
    rows = substrings.digests(substrings.dedup_substrings(df, max_group=max_group)).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    ids = [*range(len(texts) - 2), len(texts) - 4, 0]
    assert got == sorted((k, *x) for k, x in zip(ids, simple_substrings(texts, 35), strict=True))
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_substring_spans(spark):
    a, b = "a " * 5 + " ".join(f"w{k}" for k in range(50)), " ".join(f"w{k}" for k in range(10, 60))
    rows = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substrings.dedup_substrings(rows).collect()}
    assert got == {1: [(15, 55)], 2: [(0, 40)]}


def test_fingerprints(spark, docs):
    df, texts = docs
    got = {r["doc_id"]: r for r in fingerprints.edited_and_next(df.dropDuplicates(["doc_id"])).collect()}
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, theirs = (fingerprints.sketch(x.encode()) for x in (t, edited, nxt))
        assert r["fingerprint"] == fingerprints.as_text(own) and r["edited_fingerprint"] == fingerprints.as_text(other)
        assert r["near_edited"] == fingerprints.likeness(own, other) and r["near_next"] == fingerprints.likeness(own, theirs)
    assert len({got[k]["fingerprint"] for k, t in enumerate(texts) if t == texts[70]}) == 1
    assert fingerprints.edited_and_next(df.limit(0)).count() == 0
    assert fingerprints.edited_and_next(df.where("doc_id = 3")).first()["near_next"] == 1.0


def test_fingerprint_estimates():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(20_000)]
    part = long[3_000:6_000]
    a, b = (fingerprints.sketch(" ".join(x).encode()) for x in (long, part))
    assert fingerprints.containment(a, b) == 1.0  # every kept shingle of the part is in the whole
    assert abs(fingerprints.likeness(a, b) - 0.15) < 0.03
    assert len(fingerprints.sketch(b"")) == 0 and len(fingerprints.sketch(b"one two")) == 1
    assert fingerprints.likeness(a[:0], b[:0]) == 1.0 and fingerprints.likeness(a[:0], b) == 0.0
    assert (fingerprints.from_text(fingerprints.as_text(b)) == b).all()


def test_merged_fingerprints(spark, docs):
    df, _ = docs
    prints = fingerprints.fingerprint_documents(df).join(df.select("doc_id", (F.col("doc_id") % 2).alias("part")).distinct(), "doc_id")
    whole = fingerprints.merge(prints.withColumn("part", F.lit(0)), ["part"])
    parts = fingerprints.merge(prints, ["part"])
    assert [r["containment"] for r in fingerprints.containment_of_groups(parts, ["part"], whole).collect()] == [1.0, 1.0]
    assert parts.select("hash").distinct().count() == whole.count()


def test_fingerprints_of_string_null_and_repeated_ids(spark):
    texts = {"doc-00a": "a b c d e f", "doc-00b": "g h i j k l m", "doc-0": "x", "doc-00a1": "a b c d e f g"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)
    order = sorted(texts)
    for r in fingerprints.edited_and_next(df).collect():
        after = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(texts[r["doc_id"]]) // 2
        edited = texts[r["doc_id"]][:len(texts[r["doc_id"]]) - half] + after[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    odd = spark.createDataFrame([(None, "a b c"), (None, "d"), (1, "e"), (1, "f"), (1, "e")], "doc_id long, text string")
    found = fingerprints.edited_and_next(odd)
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == ["1", "1", "1", "None", "None"]


def test_merged_sketch_is_that_of_the_union(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (5, 6, 7, 300, 8, 5)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, part int")
    prints = fingerprints.fingerprint_documents(df).withColumn("part", F.lit(0))
    got = {x["hash"] for x in fingerprints.merge(prints, ["part"]).collect()}
    below = [h for t in texts for h in fingerprints.sketch(t.encode()).tolist() if h < (1 << 64) // 8]
    assert got == {f"{h:016x}" for h in below}
    short = fingerprints.sketch(b"a b c d e")
    if short[0] >= (1 << 64) // 8:
        assert fingerprints.containment(short, short) == 1.0
        assert fingerprints.containment(short, fingerprints.sketch(texts[3].encode())) == 0.0


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


def test_lines_of_large_keys_are_not_merged_into_few_tasks(spark):
    """Comparing lines costs far more than their bytes tell, so the tasks are not merged by bytes; the links stay the same."""
    from sslspark.llm import lines
    groups = [f"{g} quick brown foxes {g * 7} jump over the lazy dogs of the {g * g} villages" for g in range(100, 112)]
    docs = spark.createDataFrame([(g * 100 + k, text[:30] + chr(97 + k) + text[31:]) for g, text in enumerate(groups) for k in range(24)], "doc_id long, text string")
    rows = lines._lines(docs, "doc_id", "text", 20)
    per_line = rows.groupBy("line").agg(F.min("uid").alias("uid"), F.min("short").alias("short"), F.count("*").alias("n"))
    links = lines.links(docs, per_line, "doc_id", "text", 20, 2048)
    assert links.rdd.getNumPartitions() >= lines.TASKS
    assert lines.dedup_lines(docs).where("n_removed = 1").count() == 12 * 23


def test_distance_work_grows_with_the_edits_not_the_length():
    """Long lines that differ everywhere are told apart in a few steps for each edit allowed."""
    import sys

    from sslspark.llm import lines
    r = random.Random(12)
    a = "".join(r.choice("abcdefgh") for _ in range(3000))
    b = "x" + "".join(r.sample(a[1:-1], 2998)) + "y"
    copy = "z" + a[1:700] + a[701:2000] + "zz" + a[2000:-1] + "z"  # five edits: as far as is allowed here
    steps = 0

    def trace(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return trace

    k = 5
    sys.settrace(trace)
    try:
        assert not lines.within(a, b, k)
    finally:
        sys.settrace(None)
    assert steps < len(a)
    assert lines.within(a, copy, k) and not lines.within(a, copy, k - 1)


def test_one_of_each_does_not_shuffle_the_texts(spark):
    """What stays is a bit for each row, so the texts are read where they lie as long as it is small; the rows stay the same."""
    r = random.Random(13)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(2000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 2000, t) for k, t in enumerate(texts[:500])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        kept = simhash.one_of_each(docs)
        assert kept.columns == ["doc_id", "text"]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(x["doc_id"] for x in kept.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
