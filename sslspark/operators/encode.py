"""Label spaces, label encoding and row-level projections (PRJ1-14).

Vocabularies are tiny and fixed in code, so label <-> id lookups are
literal maps / arrays inside the projection: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sslspark.constants import OOD, UNLABELLED, VIEW_PRESETS
from sslspark.functions.keys import hash_bit

__all__ = [
    "label_vocab", "encode_label", "encode_labels", "decode_label", "drop_missing", "fill_sentinel",
    "in_label_space", "null_out_of_space", "count_labels_per_row", "role_of", "assign_role",
    "select_views", "mtl_labels", "flag_mismatch", "validate", "restrict_to", "label_id_map",
]


def label_vocab(spark: SparkSession, spaces: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ1: ``(task, label, label_id)`` with id = position in the list."""
    rows = [(t, lab, i) for t, labs in spaces.items() for i, lab in enumerate(labs)]
    return spark.createDataFrame(rows, "task string, label string, label_id int")


def label_id_map(labels: Sequence[str]) -> Column:
    return F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])


def encode_label(col, labels: Sequence[str]) -> Column:
    """PRJ2: label string -> id; ``'ood'`` -> -100 always (trap T4);
    unknown or null -> null (the reference coerces unknown strings to NaN, T5)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c == F.lit("ood"), F.lit(OOD))
            .otherwise(F.element_at(label_id_map(labels), c)).cast("int"))


def encode_labels(df: DataFrame, spaces: Mapping[str, Sequence[str]], suffix: str = "") -> DataFrame:
    """PRJ2 over several task columns in one projection."""
    return df.withColumns({f"{t}{suffix}": encode_label(t, labs) for t, labs in spaces.items()})


def decode_label(col, labels: Sequence[str]) -> Column:
    """PRJ3: id -> label string (null for sentinels / out of range)."""
    c = F.col(col) if isinstance(col, str) else col
    arr = F.array(*[F.lit(x) for x in labels])
    return F.when((c >= 0) & (c < len(labels)), F.element_at(arr, (c + 1).cast("int")))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """PRJ4: drop rows with nulls in ``cols`` (all columns when None — the
    reference's multi-task rule, trap T22)."""
    return df.na.drop(how=how, subset=list(cols) if cols is not None else None)


def fill_sentinel(df: DataFrame, cols: Sequence[str], value: int = UNLABELLED) -> DataFrame:
    """PRJ4: null labels -> sentinel (default unlabelled, -200)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)).cast("int") for c in cols})


def in_label_space(df: DataFrame, spaces: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ5: keep rows holding at least one in-space label in any task (one pass)."""
    cond = None
    for t, labs in spaces.items():
        c = F.coalesce(F.col(t).isin(list(labs)), F.lit(False))
        cond = c if cond is None else (cond | c)
    return df.filter(cond)


def null_out_of_space(df: DataFrame, spaces: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ6: out-of-space labels -> null."""
    return df.withColumns({t: F.when(F.col(t).isin(list(labs)), F.col(t)) for t, labs in spaces.items()})


def count_labels_per_row(tasks: Sequence[str]) -> Column:
    """PRJ7: number of non-null task labels per row."""
    return sum((F.col(t).isNotNull().cast("int") for t in tasks), F.lit(0)).cast("int")


def role_of(label_col) -> Column:
    c = F.col(label_col) if isinstance(label_col, str) else label_col
    return (F.when(c >= 0, F.lit("labelled"))
            .when(c == OOD, F.lit("ood"))
            .when(c == UNLABELLED, F.lit("unlabelled")))


def assign_role(df: DataFrame, label_col: str, out: str = "role") -> DataFrame:
    """PRJ8: labelled / unlabelled / ood from the sentinels."""
    return df.withColumn(out, role_of(label_col))


def select_views(df: DataFrame, alg: str, id_col: str, role_col: str = "role",
                 text_col: str = "text", preset: str = "single_task", seed: int = 0) -> DataFrame:
    """PRJ9: weak / strong views per policy.

    Each row holds a 3-tuple of texts: labelled rows ``(text, null, null)``;
    unlabelled rows the preset views (T6).  The random strong-view pick of the
    reference (one of views 1..2, or a shuffle of both) is made deterministic:
    ``md5(id:seed)`` decides.  Missing views are real NULLs.
    """
    v = VIEW_PRESETS[preset]
    is_ulb = F.col(role_col) == F.lit("unlabelled")
    v0 = F.when(is_ulb, F.col(v[0])).otherwise(F.col(text_col))
    v1 = F.when(is_ulb, F.col(v[1]))
    v2 = F.when(is_ulb, F.col(v[2]))
    pick = hash_bit(id_col, seed, 2)  # 0 -> view 1, 1 -> view 2
    s_one = F.when(pick == 0, v1).otherwise(v2)
    s_other = F.when(pick == 0, v2).otherwise(v1)
    none = F.lit(None).cast("string")
    if alg in ("fullysupervised", "supervised", "pseudolabel", "vat"):
        weak, s1, s2 = v0, none, none
    elif alg in ("pimodel", "meanteacher", "mixmatch"):
        weak, s1, s2 = v0, F.when(is_ulb, v0), none
    elif alg in ("comatch", "remixmatch"):
        weak, s1, s2 = v0, s_one, s_other
    elif alg == "defixmatch":
        # labelled rows get a strong view too; theirs is null as views are absent
        weak, s1, s2 = v0, s_one, none
    else:
        weak, s1, s2 = v0, s_one, none
    return df.withColumns({"text_w": weak, "text_s": s1, "text_s2": s2})


def mtl_labels(task_col: str, relation_col: str) -> Column:
    """PRJ10: struct(task_id, relation_id)."""
    return F.struct(F.col(task_col).cast("int").alias("task_id"),
                    F.col(relation_col).cast("int").alias("relation_id"))


def flag_mismatch(truth, pred) -> Column:
    """PRJ11: truth differs from prediction (null-safe)."""
    t = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    return ~t.eqNullSafe(p)


def validate(df: DataFrame, required: Sequence[str], task: str | None = None,
             known_tasks: Sequence[str] | None = None) -> DataFrame:
    """PRJ12: schema-only check (no data scan); raises ValueError."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    if task is not None and known_tasks is not None and task not in known_tasks:
        raise ValueError(f"unknown task {task!r}")
    return df


def restrict_to(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """PRJ13: non-null, non-empty, allowed values."""
    c = F.col(col)
    return df.filter(c.isNotNull() & (c != "") & c.isin(list(allowed)))
