"""DuckDB twins of the fixtures (CTE bodies), used only by the oracle SQL.

``with_ctes("scored", extra=...)`` returns a ``WITH ...`` prefix holding the
named fixture and everything it depends on.
"""

from __future__ import annotations

from sslspark.plans.fixtures import (
    ALLOWED_REGIONS, BATCH_ROWS, CONTEXT_SPACES, IMB_GAMMA, K_SCORED, PROTO_T,
)


def _lst(values) -> str:
    return "[" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SOFTMAX_OF = "list_transform({e}, lambda x: x / list_sum({e}))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "emb": ((), "SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label, "
                "CAST(embedding AS DOUBLE[]) AS emb FROM embeddings"),
    "protos": (("emb",), """SELECT label, list(v ORDER BY pos) AS proto FROM (
        SELECT label, pos, avg(v) AS v FROM (
          SELECT label, unnest(range(1, len(emb) + 1)) AS pos, unnest(emb) AS v FROM emb) GROUP BY label, pos)
        GROUP BY label"""),
    "protos_strong": (("emb",), """SELECT label, list(v ORDER BY pos) AS proto FROM (
        SELECT label, pos, sum(v * w) / sum(w) AS v FROM (
          SELECT label, row_id % 4 + 1 AS w, unnest(range(1, len(emb) + 1)) AS pos, unnest(emb) AS v FROM emb)
          GROUP BY label, pos)
        GROUP BY label"""),
    "scored": (("emb", "protos"), f"""SELECT row_id, batch_id, label_true, role, label_id, logits,
          list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM (
        SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
          SELECT e.row_id, CAST(floor(e.row_id / {BATCH_ROWS}) AS BIGINT) AS batch_id, e.label AS label_true,
                 CASE WHEN e.row_id % 5 = 0 THEN 'labelled' ELSE 'unlabelled' END AS role,
                 CAST(CASE WHEN e.row_id % 5 = 0 THEN e.label ELSE -200 END AS INTEGER) AS label_id,
                 list(list_dot_product(e.emb, p.proto) / (sqrt(list_dot_product(e.emb, e.emb))
                      * sqrt(list_dot_product(p.proto, p.proto))) / {PROTO_T} ORDER BY p.label) AS logits
          FROM emb e, protos p GROUP BY e.row_id, e.label))"""),
    "scored_strong": (("emb", "protos_strong"), f"""SELECT row_id, batch_id, label_true, role, label_id, logits,
          list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM (
        SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
          SELECT e.row_id, CAST(floor(e.row_id / {BATCH_ROWS}) AS BIGINT) AS batch_id, e.label AS label_true,
                 CASE WHEN e.row_id % 5 = 0 THEN 'labelled' ELSE 'unlabelled' END AS role,
                 CAST(CASE WHEN e.row_id % 5 = 0 THEN e.label ELSE -200 END AS INTEGER) AS label_id,
                 list(list_dot_product(e.emb, p.proto) / (sqrt(list_dot_product(e.emb, e.emb))
                      * sqrt(list_dot_product(p.proto, p.proto))) / {PROTO_T} ORDER BY p.label) AS logits
          FROM emb e, protos_strong p GROUP BY e.row_id, e.label))"""),
    "scored_long": (("scored",), """SELECT row_id, batch_id, label_true, role, label_id,
          CAST(generate_subscripts(probs, 1) - 1 AS INTEGER) AS class_id, unnest(probs) AS p FROM scored"""),
    "imbalanced": (("scored",), f"""SELECT * EXCLUDE (_rk) FROM (
        SELECT *, row_number() OVER (PARTITION BY label_true ORDER BY md5(concat_ws(':', row_id, 42)), row_id) AS _rk
        FROM scored) WHERE _rk <= floor((SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))
          * pow(1.0 / {IMB_GAMMA}, label_true / {K_SCORED - 1}.0) + 1e-9)"""),
    "contexts": ((), """SELECT o.o_orderkey AS original_index, concat_ws(' ', o.o_orderstatus, c.c_name) AS text,
          r.r_name AS location, n.n_name AS cell_line, c.c_mktsegment AS cell_type,
          o.o_orderpriority AS organ, o.o_orderstatus AS disease,
          'Y' || CAST(year(o.o_orderdate) AS VARCHAR) AS species, o.o_orderstatus AS relation
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "contexts_in_space": (("contexts",), "SELECT original_index, text, relation, "
        + ", ".join(f"CASE WHEN {t} IN {_in(v)} THEN {t} END AS {t}" for t, v in CONTEXT_SPACES.items())
        + " FROM contexts WHERE " + " OR ".join(f"coalesce({t} IN {_in(v)}, false)" for t, v in CONTEXT_SPACES.items())),
    "corpus": ((), """SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "variant_lines": ((), "SELECT conv_id AS original_index, turn AS line_no, text AS sentence FROM conversations"),
    "interactions": ((), """SELECT l.l_orderkey, l.l_linenumber, 'S#' || CAST(l.l_suppkey AS VARCHAR) AS subj,
          'C#' || CAST(o.o_custkey AS VARCHAR) AS obj, r.r_name AS species
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "entity_nations": ((), """SELECT 'S#' || CAST(s_suppkey AS VARCHAR) AS entity, s_nationkey AS nk FROM supplier
        UNION ALL SELECT 'C#' || CAST(c_custkey AS VARCHAR) AS entity, c_nationkey AS nk FROM customer"""),
    "species_primary": (("entity_nations",), f"""SELECT e.entity, r.r_name AS species_full FROM entity_nations e
        JOIN nation n ON e.nk = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        WHERE r.r_name IN {_in(ALLOWED_REGIONS)}"""),
    "species_fallback": (("entity_nations",), """SELECT e.entity, [rn.r_name, rp.r_name] AS species
        FROM entity_nations e
        JOIN nation nn ON nn.n_nationkey = (e.nk + 1) % 25 JOIN region rn ON nn.n_regionkey = rn.r_regionkey
        JOIN nation np ON np.n_nationkey = (e.nk + 24) % 25 JOIN region rp ON np.n_regionkey = rp.r_regionkey"""),
    "rounds": ((), """SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS acc,
          CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round_no
        FROM events GROUP BY CAST(ts AS DATE)"""),
}


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """``WITH`` prefix for the named fixtures (dependencies first) plus extra CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
