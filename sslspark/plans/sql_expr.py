"""DuckDB expression builders mirroring ``sslspark.functions.arrays``.

Only the oracle uses these; they return SQL text.
"""

from __future__ import annotations

_n = [0]


def _v(prefix: str = "v") -> str:
    _n[0] += 1
    return f"{prefix}{_n[0]}"


def asum(x: str) -> str:
    return f"list_sum({x})"


def exps(x: str, T: float = 1.0) -> str:
    a, m = _v(), f"list_max({x})"
    return f"list_transform({x}, lambda {a}: exp(({a} - {m}) / {float(T)}))"


def softmax(x: str, T: float = 1.0) -> str:
    e = exps(x, T)
    b = _v()
    return f"list_transform({e}, lambda {b}: {b} / list_sum({e}))"


def log_softmax(x: str, T: float = 1.0) -> str:
    a = _v()
    return (f"list_transform({x}, lambda {a}: ({a} - list_max({x})) / {float(T)} - ln(list_sum({exps(x, T)})))")


def conf(p: str) -> str:
    return f"list_max({p})"


def argmax(p: str) -> str:
    return f"CAST(list_position({p}, list_max({p})) - 1 AS INTEGER)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def norm(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / ({norm(a)} * {norm(b)}))"


def zip_with(a: str, b: str, body: str) -> str:
    """body uses {x} and {y}."""
    x, y = _v("x"), _v("y")
    return f"list_transform(list_zip({a}, {b}), lambda {x}: {body.format(x=x + '[1]', y=x + '[2]')})"


def transform(a: str, body: str) -> str:
    x = _v("x")
    return f"list_transform({a}, lambda {x}: {body.format(x=x)})"


def sharpen(p: str, T: float) -> str:
    q = transform(p, "pow({x}, " + str(1.0 / T) + ")")
    return transform(q, "{x} / list_sum(" + q.replace("{", "{{").replace("}", "}}") + ")")


def normalise_sum(q: str) -> str:
    return transform(q, "{x} / list_sum(" + q.replace("{", "{{").replace("}", "}}") + ")")


def element(arr: str, idx0: str) -> str:
    return f"{arr}[({idx0}) + 1]"


def ce_hard(logits: str, label: str) -> str:
    return f"(-({log_softmax(logits)})[({label}) + 1])"


def ce_soft(logits: str, target: str) -> str:
    return f"(-{dot(target, log_softmax(logits))})"


def entropy(p: str) -> str:
    return "(-list_sum(" + transform(p, "CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0.0 END") + "))"


def one_hot(label: str, K: int) -> str:
    i = _v("i")
    return f"list_transform(range(0, {K}), lambda {i}: CASE WHEN {i} = ({label}) THEN 1.0 ELSE 0.0 END)"


def smooth_label(label: str, K: int, eps: float) -> str:
    i = _v("i")
    return (f"list_transform(range(0, {K}), lambda {i}: CASE WHEN {i} = ({label}) THEN {1.0 - eps} "
            f"ELSE {eps / (K - 1)} END)")


def long_of(arr: str) -> str:
    """select-list fragment: class_id, value from an array (unnest pair)."""
    return f"CAST(generate_subscripts({arr}, 1) - 1 AS INTEGER) AS class_id, unnest({arr}) AS v"


def hash_beta(key: str, seed, alpha: float) -> str:
    """Twin of ``functions.keys.hash_beta`` (alpha up to 1)."""
    from sslspark.functions.keys import BETA_TRIES
    t, x = _v("t"), _v("x")
    u = [f"pow((('0x' || substr(md5(concat_ws(':', {key}, {seed}, {t}, {part})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0, {1 / alpha!r})" for part in (0, 1)]
    tries = f"list_transform(range(0, {BETA_TRIES}), lambda {t}: CASE WHEN {u[0]} + {u[1]} <= 1 THEN {u[0]} / ({u[0]} + {u[1]}) END)"
    return f"coalesce(list_filter({tries}, lambda {x}: {x} IS NOT NULL)[1], 0.5)"
