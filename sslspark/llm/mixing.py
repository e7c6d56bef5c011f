"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic).  Raking scales the
cells' token weights so that their sums meet the target share of every source,
then of every language, then of every topic, again and again until all three
hold.  A document's sampling probability is its cell's fitted weight over its
tokens, scaled so that the largest is 1: the expected token shares of the
sample are the targets.  The draw is a hash of the id and the text, so it can be
repeated.

Only cells are iterated on, never rows; every few rounds they are written to
the shared folder and give the driver one number.

Defined cases: null and empty levels are one level; null texts have no tokens;
cells without tokens have probability 1 (they carry no weight); equal rows get
the same draw; an empty table gives no rows; targets that no weights can meet
(a level without tokens, or conflicting margins) end at ``max_rounds`` with the
largest relative error in ``residual``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sslspark.llm.common import free, stored

DIMS = ("source", "lang", "topic")


def topic(text: str = "text") -> Column:
    """A coarse topic from the form of the whole text; the first rule that holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("License"), "licensed").when(t.contains("!!"), "loud")
            .when(t.contains("***") | t.contains("%%%"), "marks").otherwise("prose"))


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares ``<dim>, target``: the observed token shares raised to
    ``power`` (1 keeps them, 0 makes all levels equal), adding up to 1."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).where("n > 0").select(dim, F.pow("n", F.lit(power)).alias("target"))
    total = sums.agg(F.sum("target")).first()[0] or 1.0
    return sums.select(dim, (F.col("target") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], max_rounds: int = 60, tolerance: float = 1e-8, stride: int = 5) -> tuple[DataFrame, float]:
    """``cells(*dims, tokens)`` with ``weight`` appended, and the residual."""
    names = list(targets)
    base = cells
    for d in names:
        base = base.join(targets[d].withColumnRenamed("target", f"t_{d}"), d, "left").fillna(0.0, [f"t_{d}"])
    cur, error = stored(base.withColumn("weight", F.col("tokens").cast("double")), "cells"), 0.0
    for _ in range(0, max_rounds, stride):
        step = cur
        for d in names * stride:  # a window, as a join with its own sums would double the plan each time
            total = F.sum("weight").over(Window.partitionBy(d))
            step = step.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{d}") / total).otherwise(0.0))
        cur = stored(step, "cells")
        gaps = [cur.groupBy(d).agg(F.sum("weight").alias("s"), F.first(f"t_{d}").alias("t"))
                .select(F.max(F.abs(F.when(F.col("t") > 0, F.col("s") / F.col("t") - 1).otherwise(F.col("s")))).alias("e")) for d in names[:-1]]
        both = gaps[0] if gaps else None
        for g in gaps[1:]:
            both = both.unionByName(g)
        error = (both.agg(F.max("e")).first()[0] or 0.0) if both is not None else 0.0
        if error <= tolerance:
            break
    return cur.select(*names, "tokens", "weight"), error


def draw(key: str, text_col: str = "text") -> Column:
    """A number in [0, 1) from an id and its text: 52 bits of their MD5, so that
    different texts with one id, or without an id, are drawn apart."""
    own = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    text = F.concat(F.lit("mix:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), own)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, power: dict[str, float], dims: tuple[str, ...] = DIMS, key: str = "doc_id", text_col: str = "text",
        targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with ``probability, kept, residual`` appended (columns of these
    names are replaced).  ``dims`` are
    columns of ``docs``; ``topic`` is made from the text where it is missing.
    ``targets`` gives a margin's shares, ``power`` tempers the observed ones."""
    docs = docs.drop("probability", "kept", "residual")
    level = {d: F.coalesce(F.col(d).cast("string"), F.lit("")) if d in docs.columns else topic(text_col) for d in dims}
    own = {d: free(docs.columns, d) for d in dims}
    keyed = docs.select("*", *[c.alias(own[d]) for d, c in level.items()])
    cells = stored(docs.select(*[c.alias(d) for d, c in level.items()], tokens(text_col).alias("n"))
                   .groupBy(*dims).agg(F.sum("n").alias("tokens")), "counts")
    aims = {d: (targets or {}).get(d) if (targets or {}).get(d) is not None else tempered(cells, d, power.get(d, 1.0)) for d in dims}
    fitted, residual = rake(cells, aims)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    top = fitted.agg(F.max(ratio)).first()[0] or 1.0
    chance = stored(fitted.select(*[F.col(d).alias(own[d]) for d in dims], F.coalesce(ratio / F.lit(top), F.lit(1.0)).alias("probability")), "chances")
    return (keyed.join(chance, list(own.values())).drop(*own.values())
            .withColumns({"kept": draw(key, text_col) < F.col("probability"), "residual": F.lit(float(residual))}))


def oracle_sql(power: dict[str, float], rounds: int = 40) -> str:
    """DuckDB twin of ``mix`` on ``documents``, with the rounds written out."""
    rule = ("CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, 'License') THEN 'licensed' WHEN contains(x, '!!') THEN 'loud'"
            " WHEN contains(x, '***') OR contains(x, '%%%') THEN 'marks' ELSE 'prose' END")
    parts = [
        "d0 AS (SELECT doc_id, COALESCE(source, '') AS source, COALESCE(lang, '') AS lang, COALESCE(text, '') AS x FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, x, {rule} AS topic, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM d0)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(SUM(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"]
    for dim in DIMS:
        parts.append(f"a_{dim} AS (SELECT {dim}, pow(SUM(tokens), {power.get(dim, 1.0)}) AS p FROM c GROUP BY {dim} HAVING SUM(tokens) > 0)")
        parts.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, p / SUM(p) OVER () AS t FROM a_{dim})")
    parts.append("w0 AS MATERIALIZED (SELECT c.*, t_source.t AS ts, t_lang.t AS tl, t_topic.t AS tt, tokens AS w FROM c"
                 " JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(rounds):
        for dim, t in zip(DIMS, ("ts", "tl", "tt"), strict=True):
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * {t} / SUM(w) OVER (PARTITION BY {dim}) AS w) FROM w{n})")
            n += 1
    parts.append(f"p AS (SELECT *, (w / tokens) / MAX(w / tokens) OVER () AS probability FROM w{n} WHERE tokens > 0)")
    u = "CAST(('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR) || ':' || md5(x)), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"
    return ("WITH " + ",\n".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS BIGINT) AS tokens, round(COALESCE(probability, 1.0), 6) AS probability,
       {u} < COALESCE(probability, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)""")
