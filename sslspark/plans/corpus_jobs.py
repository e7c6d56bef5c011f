"""JOB1-3, JOB6 and JOB11 as one call each, with their sinks.

Each function declares the whole plan from the operators and returns its
tables; with a ``sink`` folder they are written there (Parquet) and the tables
returned are read back, so later steps don't compute them again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sslspark.constants import OOD, UNLABELLED
from sslspark.operators import aggs, encode, lookup, metrics, policies, split
from sslspark.sources import io

__all__ = ["prepare_corpus", "build_ssl_tables", "annotate_ood", "evaluate_run", "augmentation_round_trip", "Prepared", "Annotated", "Evaluated"]


def _saved(df: DataFrame, sink: str | None, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    if sink is None:
        return df
    path = f"{sink.rstrip('/')}/{name}"
    io.write_split(df, path, partition_by)
    return df.sparkSession.read.schema(df.select(*[c for c in df.columns if c not in partition_by], *partition_by).schema).parquet(path).select(*df.columns)


def _report(df: DataFrame, tasks: Sequence[str], vocab: DataFrame, key: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """AGG3 per task, and for each of the ``values`` of ``key`` if given."""
    lng = df.unpivot([key] if key else [], list(tasks), "task", "label_id")
    if key is None:
        return aggs.label_report(lng, vocab)
    both = F.concat_ws("|", key, "task").alias("task")
    named = vocab.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))
    rep = aggs.label_report(lng.select(both, "label_id"), named.select(both, "label", "label_id"))
    at = F.split("task", r"\|", 2)
    return rep.select(at[0].alias(key), at[1].alias("task"), "label", "n")


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    report: DataFrame   # split, task, label, n


def prepare_corpus(df: DataFrame, spaces: Mapping[str, Sequence[str]], id_col: str = "original_index", test_frac: float = 0.3,
                   seed: int = 0, sink: str | None = None) -> Prepared:
    """JOB1: keep rows with a label in some space (PRJ5), null the others
    (PRJ6), take the test set stratified by the number of labels (PRJ7, WIN1),
    the rest by an anti-join (JOI2), and report the labels of both (AGG3).
    ``sink`` gets ``train``, ``test`` (SRC8) and ``report``."""
    tasks = list(spaces)
    rows = encode.null_out_of_space(encode.in_label_space(df, spaces), spaces)
    rows = split.stratified_test_split(rows.withColumn("n_labels", encode.count_labels_per_row(tasks)), "n_labels", id_col, test_frac, seed=seed)
    test = _saved(rows.filter("split = 'test'").drop("split"), sink, "test")
    train = _saved(lookup.anti_join(rows.drop("split"), test, id_col), sink, "train")
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    vocab = encode.label_vocab(df.sparkSession, spaces)
    return Prepared(train, test, _saved(_report(encode.encode_labels(both, spaces), tasks, vocab, "split", ("train", "test")), sink, "report"))


def build_ssl_tables(df: DataFrame, spaces: Mapping[str, Sequence[str]], task: str | Sequence[str], text_col: str = "text",
                     sink: str | None = None) -> DataFrame:
    """JOB2: encoded labels with the unlabelled sentinel (PRJ2, PRJ4), checked
    (PRJ12), and each row's role (PRJ8).  For one task the label is ``lab``; for
    several each keeps its name, and a row is labelled where every task is, out
    of distribution where some task says so, else unlabelled.  ``sink`` gets
    ``tables``, one folder for each role."""
    tasks = [task] if isinstance(task, str) else list(task)
    rows = encode.null_out_of_space(encode.in_label_space(df, spaces), spaces)
    cols = ["lab"] if isinstance(task, str) else tasks
    rows = rows.withColumns({c: encode.encode_label(t, spaces[t]) for c, t in zip(cols, tasks, strict=True)})
    rows = encode.validate(encode.fill_sentinel(rows, cols), [text_col, *cols])
    if len(cols) == 1:
        rows = encode.assign_role(rows, cols[0])
    else:
        some = F.array(*cols)
        worst = (F.when(F.exists(some, lambda c: c == OOD), F.lit(OOD)).when(F.exists(some, lambda c: c == UNLABELLED), F.lit(UNLABELLED))
                 .otherwise(F.lit(0)))
        rows = encode.assign_role(rows.withColumn("_worst", worst), "_worst").drop("_worst")
    return _saved(rows, sink, "tables", ["role"])


@dataclass(frozen=True)
class Annotated:
    rows: DataFrame     # the corpus, labels of its tasks rewritten
    before: DataFrame   # task, label, n
    after: DataFrame


def annotate_ood(corpus: DataFrame, scores: Mapping[str, DataFrame], vocab: DataFrame, id_col: str = "row_id", probs_col: str = "probs",
                 tau: float = 0.9, sink: str | None = None) -> Annotated:
    """JOB3: for each task of ``scores`` (its own rows ``<id>, probs``), unlabelled
    rows of the corpus's column of that name whose confidence is below ``tau``
    become out-of-distribution (THR1); rows without a score keep their label.
    One join for each task, no re-read of the corpus.  ``sink`` gets the rewritten
    ``corpus`` and both reports (AGG3)."""
    tasks = list(scores)
    rows = corpus
    for t in tasks:
        own = scores[t].select(id_col, F.col(probs_col).alias("_probs"))
        joined = policies.ood_by_confidence(rows.join(own, id_col, "left"), "_probs", t, tau, out="_new")
        rows = joined.withColumn(t, F.when(F.col("_probs").isNull(), F.col(t)).otherwise(F.col("_new")).cast("int")).drop("_probs", "_new")
    rows = _saved(rows.select(*corpus.columns), sink, "corpus")
    before, after = (_report(d, tasks, vocab) for d in (corpus, rows))
    return Annotated(rows, _saved(before, sink, "before"), _saved(after, sink, "after"))


@dataclass(frozen=True)
class Evaluated:
    predictions: DataFrame   # the rows with truth_name, pred_name, mismatch
    confusion: DataFrame
    per_class: DataFrame
    summary: DataFrame       # accuracy, balanced accuracy, loss where there are logits


def evaluate_run(df: DataFrame, names: Sequence[str], truth: str = "truth", pred: str = "pred", logits: str | None = None,
                 keep: Sequence[str] = (), sink: str | None = None) -> Evaluated:
    """JOB6: decoded truth and prediction with the mismatch flag (PRJ3, PRJ11,
    SRC9), the confusion matrix (AGG4), precision, recall and F1 (AGG7), and one
    row of accuracy, balanced accuracy (AGG5, AGG6) and, with logits, loss (AGG8)."""
    rows = df.select(*keep, truth, pred, encode.decode_label(truth, names).alias("truth_name"), encode.decode_label(pred, names).alias("pred_name"),
                     encode.flag_mismatch(truth, pred).alias("mismatch"))
    summary = metrics.accuracy(df, truth, pred).join(F.broadcast(metrics.balanced_accuracy(df, truth, pred)))
    if logits is not None:
        summary = summary.join(F.broadcast(metrics.eval_loss(df, logits, truth)))
    if sink is not None:
        io.write_predictions(df, f"{sink.rstrip('/')}/mismatches", truth, pred, keep)
    return Evaluated(_saved(rows, sink, "predictions"), _saved(metrics.confusion_matrix(df, truth, pred), sink, "confusion"),
                     _saved(metrics.precision_recall_f1(df, truth, pred), sink, "per_class"), _saved(summary, sink, "summary"))


def augmentation_round_trip(corpus: DataFrame, folder: str, augment: Callable[[str, str], None], names: Sequence[str],
                            id_col: str = "original_index", text_col: str = "text") -> DataFrame:
    """JOB11: the texts go out as ``id|id|text`` (SRC6), ``augment(source, target)``
    writes its lines for each id from one folder to the other, the lines come
    back in order (SRC7), and the k-th one of an id is its k-th variant column
    beside the corpus row (JOI1)."""
    source, target = f"{folder.rstrip('/')}/out", f"{folder.rstrip('/')}/in"
    io.export_pipe(corpus, source, id_col, text_col)
    augment(source, target)
    lines = io.import_pipe(corpus.sparkSession, target).withColumnRenamed("original_index", id_col)
    return lookup.attach_augmentations(corpus, lines, id_col, "line_no", "sentence", names)
