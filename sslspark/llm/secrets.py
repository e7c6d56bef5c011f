"""Secret scans with a random forest that removes false positives.

Candidates are values assigned to a telling name, strings with a known
beginning, and long strings of letters and digits, each one whole, however
long it is.  For each one the forest
sees its length and mix of characters, how usual its character transitions are
in the corpus, how much of it dictionary words cover, what its path looks like
and which words stand beside it.  Transitions and dictionary are counted over
the whole corpus; the forest is fitted on a bounded number of labelled findings.

Defined cases: null and empty texts have no candidates; equal findings in
repeated rows get equal answers; with labelled findings of one kind only every
finding gets that kind, with none every candidate is kept with probability 0.5;
an empty table gives no rows; a null path is an empty one; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sslspark.llm.common import stored

#: The name may end a longer one (``DB_PASSWORD``, ``client_secret``) and stand in quotes, as in JSON.
ASSIGNED = re.compile(r"""(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s*[:=](?:[ \t]*|\s{0,3})(?:"([^"\n]{8,})"|'([^'\n]{8,})'|["']?([^\s"']{8,}))""")
KNOWN = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,})\b")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{14,}")
NAME = re.compile(r"[A-Za-z0-9_-]")
SAMPLE_PATH = re.compile(r"(?i)test|example|sample|doc|fixture|mock")
FEATURES = ["size", "digits", "upper", "variety", "transitions", "worst_transition", "coverage", "path_depth", "path_sample", "before", "after"]
CLASSES = 64


def _classes() -> np.ndarray:
    """Class of each byte: letters without case, digits, marks, white space, the rest by their low bits."""
    table = np.arange(256) % 16 + 48
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[48:58] = np.arange(10) + 1
    table[65:91] = table[97:123] = np.arange(26) + 11
    for k, mark in enumerate(b"._-+/=,:;\"'"):
        table[mark] = 37 + k
    return table.astype(np.int64)


def corpus_counts(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, frozenset[str]]:
    """Log probabilities of character transitions and the ``words`` most
    frequent lower-case words (4 to 10 letters): both bounded, from all texts."""
    word = re.compile(rb"(?<![a-z])[a-z]{4,10}(?![a-z])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs, seen = _classes(), np.zeros(CLASSES * CLASSES, np.int64), Counter()

        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([k.decode() for k in c], pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    c = table[np.frombuffer(text, np.uint8)]
                    pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
                    seen.update(word.findall(text.lower()))
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"key": pa.array([f"#{k}" for k in at], pa.string()), "n": pa.array(pairs[at], pa.int64())})

    counts = stored(docs.select(text_col).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    table = np.ones((CLASSES, CLASSES))
    for r in counts.where(F.col("key").startswith("#")).collect():  # CLASSES squared rows at most
        table.ravel()[int(r["key"][1:])] += r["n"]
    common = counts.where(~F.col("key").startswith("#")).orderBy(F.desc("n"), "key").limit(words).collect()
    return np.log(table / table.sum(1, keepdims=True)), frozenset(r["key"] for r in common)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(10, len(low) - at), 3, -1):
            if low[at:at + n] in dictionary:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)``, without overlaps; the more telling kind first.
    Of a long run that holds another finding, what is left beside it (and
    beside the finding's name) counts like a run of its own."""
    assigned = {m.start(m.lastindex): m for m in ASSIGNED.finditer(text)}
    found = [(*m.span(m.lastindex), "assigned") for m in assigned.values()]
    found += [(*m.span(), "known") for m in KNOWN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for f in sorted(found, key=lambda f: (f[0], {"known": 0, "assigned": 1}[f[2]], -f[1])):
        if not out or f[0] >= out[-1][1]:
            begin = f[0]
            if f[0] in assigned:
                begin, least = assigned[f[0]].start(), taken[-1][1] if taken else 0
                while begin > least and NAME.match(text[begin - 1]):
                    begin -= 1
            out.append(f)
            taken.append((begin, f[1]))
    k = 0
    for m in LONG.finditer(text):
        at, end = m.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < end:
            out += _run(text, at, taken[j][0])
            at = max(at, taken[j][1])
            j += 1
        out += _run(text, at, end)
    return sorted(out)


def _run(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
    m = LONG.fullmatch(text[a:b]) if b > a else None
    return [(a, b, "long")] if m else []


def _word(side: list[str], k: int) -> str:
    return re.sub(r"[^\w]+", "", side[k]).lower()[:20] if side else ""


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", words: int = 20_000) -> DataFrame:
    """One row for each candidate: ``<id>, start, length, kind, value, left,
    right`` (the words beside it) and the features that don't need labels."""
    kind_, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    log_p, dictionary = corpus_counts(docs, text_col, words)
    names = [id_col, "start", "length", "kind", "value", "left", "right", *FEATURES[:9]]
    kinds = [arrow_kind, pa.int64(), pa.int64(), *[pa.string()] * 4, *[pa.float64()] * 9]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _classes()
        for batch in batches:
            out = []
            for doc, text, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, kind in candidates(text or ""):
                    v = text[a:b]
                    c = table[np.frombuffer(v.encode(), np.uint8)]
                    steps = log_p[c[:-1], c[1:]]
                    left, right = text[max(0, a - 60):a].split(), text[b:b + 60].split()
                    near = [w for w in left if re.search(r"\w", w)]
                    out.append((doc, a, b - a, kind, v, _word(near, -1), _word([w for w in right if re.search(r"\w", w)], 0), float(b - a),
                                sum(map(str.isdigit, v)) / len(v), sum(map(str.isupper, v)) / len(v), len(set(v)) / len(v),
                                float(steps.mean()), float(steps.min()), coverage(v, dictionary),
                                float((path or "").count("/")), float(bool(SAMPLE_PATH.search(path or "")))))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    feature_kinds = ", ".join(f"{f} double" for f in FEATURES[:9])
    return docs.select(id_col, text_col, path_col).mapInArrow(
        run, f"`{id_col}` {kind_}, start long, length long, kind string, value string, left string, right string, {feature_kinds}")


def _odds(labelled: DataFrame, side: str, words: int) -> dict[str, float]:
    """Smoothed log odds of a secret for the ``words`` most frequent neighbours."""
    rows = (labelled.groupBy(side).agg(F.sum("label").alias("p"), F.count("*").alias("n")).orderBy(F.desc("n"), side).limit(words).collect())
    return {r[side]: math.log((r["p"] + 0.5) / (r["n"] - r["p"] + 0.5)) for r in rows if r["n"] > 1}


def fit(labelled: DataFrame, seed: int = 11, trees: int = 30, depth: int = 6, neighbours: int = 2_000):
    """Fit on ``labelled`` findings (with ``label`` 1 or 0, a bounded sample):
    a function that appends ``probability`` to findings."""
    labelled = stored(labelled, "labelled")
    shares = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        only = float(next(iter(shares), 0.5))
        return lambda rows: rows.withColumn("probability", F.lit(only))
    spark = labelled.sparkSession
    odds = {"before": ("left", _odds(labelled, "left", neighbours)), "after": ("right", _odds(labelled, "right", neighbours))}
    tables = {f: (side, spark.createDataFrame([*o.items()] or [("", 0.0)], f"{side} string, {f} double")) for f, (side, o) in odds.items()}

    def featured(rows: DataFrame) -> DataFrame:
        for f, (side, t) in tables.items():  # ``neighbours`` rows at most
            rows = rows.join(F.broadcast(t), side, "left").fillna(0.0, [f])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)

    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(featured(labelled).withColumn("label", F.col("label").cast("double")))
    return lambda rows: (model.transform(featured(rows)).withColumn("probability", vector_to_array("probability")[1])
                         .drop("features", "rawPrediction", "prediction", "before", "after"))


def rule_label(kind: str = "kind", value: str = "value"):
    """Labels for findings where no reviewer's are at hand: known beginnings
    and assigned values that mix letters and digits are secrets, numbers and
    strings of words are not; others stay unlabelled."""
    mixed = F.col(value).rlike("[A-Za-z]") & F.col(value).rlike("[0-9]")
    return (F.when(F.col(kind) == "known", 1).when((F.col(kind) == "assigned") & mixed & (F.length(value) >= 12), 1)
            .when(~F.col(value).rlike("[A-Za-z]"), 0).when(F.col("digits") < 0.1, 0))


def bounded(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """About ``limit`` rows, chosen by hash; all if there are fewer."""
    n = rows.count()
    share = min(1.0, limit / max(1, n))
    return rows.where(F.xxhash64(F.lit("sample"), *keys) <= F.lit(int(share * (2 ** 64 - 2 ** 12)) - 2 ** 63))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         fit_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Findings of ``docs`` with ``probability, is_secret``.  ``labelled`` are
    findings with a ``label``; without it the findings' own rule labels are
    used, of about ``fit_rows`` of them."""
    found = stored(findings(docs, id_col, text_col, path_col), "findings")
    if labelled is None:
        labelled = bounded(found.withColumn("label", rule_label()).where("label IS NOT NULL"), fit_rows, id_col, "start", "value")
    return fit(labelled)(found).withColumn("is_secret", F.col("probability") >= threshold)
