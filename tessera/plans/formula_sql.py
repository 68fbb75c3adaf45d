"""A formula as DuckDB SQL, written from the operators' definitions alone: what the engine's results are compared with.

Every node of the formula's graph is a column; the columns of one depth make a common table expression over those of the
depth before. Nothing is shared with the planner but the parser.
"""

from __future__ import annotations

from tessera.plans.formula import Node, parse

COLUMNS = ("open", "high", "low", "close", "volume", "turnover", "open_interest", "vwap")
NAN, INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


def _quotient(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {b} = 0 THEN CASE WHEN {a} IS NULL THEN NULL WHEN isnan({a}) OR {a} = 0 THEN {NAN} WHEN {a} > 0 THEN {INF} ELSE -{INF} END END"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {_frame(n)} = {int(n)} THEN {value} END"


def _lag(x: str, n: float) -> str:
    order = "OVER (PARTITION BY vt_symbol ORDER BY datetime)"
    return f"lag({x}, {int(n)}) {order}" if n > 0 else f"lead({x}, {int(-n)}) {order}" if n else x


def _finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def _spread(x: str, n: int) -> str:
    """Population deviation of what is not NaN; infinite values make it NaN."""
    here = _frame(n)
    return (
        f"CASE WHEN count(CASE WHEN isinf({x}) THEN 1 END) {here} > 0 THEN {NAN} WHEN count({_finite(x)}) {here} = 0 AND count({x}) {here} > 0 THEN {NAN} "
        f"ELSE stddev_pop({_finite(x)}) {here} END"
    )


def _corr(x: str, y: str, n: int) -> str:
    here = _frame(n)
    x, y = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    odd = f"count(CASE WHEN NOT isfinite({x}) OR NOT isfinite({y}) THEN 1 END) {here}"
    both = f"CASE WHEN isfinite({x}) AND isfinite({y}) THEN"
    fx, fy = f"{both} {x} END", f"{both} {y} END"
    deviations = f"(stddev_pop({fx}) {here} * stddev_pop({fy}) {here})"
    return f"CASE WHEN {odd} > 0 THEN {NAN} WHEN {deviations} = 0 THEN {NAN} ELSE covar_pop({fx}, {fy}) {here} / {deviations} END"


def _power(x: str, e: str) -> str:
    return f"CASE WHEN {x} > 0 THEN power({x}, {e}) WHEN {x} < 0 THEN -power(-({x}), {e}) ELSE 0.0 END"


def _weighted(x: str, n: int) -> str:
    n = int(n)
    return _full(x, n, f"({' + '.join(f'{k + 1} * {_lag(x, k)}' for k in range(n))}) / {n * (n + 1) / 2}")


def _place(x: str, n: int, which: str) -> str:
    return _full(x, n, f"CAST(list_position(list({x}) {_frame(n)}, {which}({x}) {_frame(n)}) AS DOUBLE)")


def _mean(x: str, n: int) -> str:
    here, some = _frame(n), f"CASE WHEN NOT isnan({x}) THEN {x} END"
    return f"CASE WHEN count({some}) {here} = 0 AND count({x}) {here} > 0 THEN {NAN} ELSE avg({some}) {here} END"


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY datetime, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0 END"


def _signed(x: str, e: str) -> str:
    whole = f"CASE WHEN {x} > 0 THEN power({x}, {e}) WHEN {x} < 0 AND {e} = floor({e}) THEN -power(-({x}), {e}) ELSE 0.0 END"
    return f"CASE WHEN isnan({whole}) OR ({whole}) IS NULL THEN 0.0 ELSE {whole} END"


#: Name of an operator to its SQL; arguments are column names, constants numbers.
OPERATORS = {
    "+": lambda a, b: f"{a} + {b}", "-": lambda a, b: f"{a} - {b}", "*": lambda a, b: f"{a} * {b}", "/": _quotient,
    **{op: (lambda sql: lambda a, b: f"CAST(CAST({a} {sql} {b} AS INT) AS DOUBLE)")(op.replace("==", "=").replace("!=", "<>")) for op in ("<", "<=", ">", ">=", "==", "!=")},
    "where": lambda c, a, b: f"CASE WHEN {c} <> 0 THEN {a} ELSE {b} END",
    "quesval": lambda t, x, a, b: f"CASE WHEN {t} < {x} THEN {a} ELSE {b} END",
    "quesval2": lambda t, x, a, b: f"CASE WHEN {x} < {t} THEN {a} ELSE {b} END",
    "mix": lambda a, b, w: f"{a} * {w} + {b} * (1 - {w})",
    "less": lambda a, b: f"least({a}, {b})", "greater": lambda a, b: f"greatest({a}, {b})",
    "log": lambda x: f"CASE WHEN isnan({x}) THEN {NAN} WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN -{INF} WHEN {x} < 0 THEN {NAN} END",
    "abs": lambda x: f"abs({x})", "sign": lambda x: f"CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 ELSE 0.0 END",
    "pow1": _power, "pow2": _signed,
    "ts_delay": _lag, "ts_delta": lambda x, n: f"{x} - {_lag(x, n)}",
    "ts_min": lambda x, n: f"min({x}) {_frame(n)}", "ts_max": lambda x, n: f"max({x}) {_frame(n)}",
    "ts_argmax": lambda x, n: _place(x, n, "max"), "ts_argmin": lambda x, n: _place(x, n, "min"),
    "ts_sum": lambda x, n: _full(x, n, f"sum({x}) {_frame(n)}"), "ts_mean": _mean, "ts_std": _spread,
    "ts_product": lambda x, n: _full(x, n, f"product({x}) {_frame(n)}"), "ts_decay_linear": _weighted,
    "ts_corr": _corr, "ts_cov": lambda x, y, n: f"({_corr(x, y, n)}) * ({_spread(x, n)}) * ({_spread(y, n)})",
    "cs_rank": _rank, "cs_sum": lambda x: f"coalesce(sum({x}) OVER (PARTITION BY datetime), 0.0)",
    "cs_mean": lambda x: f"avg({x}) OVER (PARTITION BY datetime)",
}


def formula_sql(text: str, source: str = "panel") -> str:
    """CTEs, without WITH, of which the last is ``q(datetime, vt_symbol, v)``."""
    depth: dict[Node, int] = {}
    steps: list[list[str]] = []
    names: dict[Node, str] = {}

    def put(at: int, sql: str) -> str:
        while len(steps) <= at:
            steps.append([])
        name = f"c{sum(map(len, steps))}"
        steps[at].append(f"{sql} AS {name}")
        return name

    def column(node) -> str:
        if not isinstance(node, Node):
            return f"CAST({node!r} AS DOUBLE)" if isinstance(node, float) else repr(node)
        if node.op == "column":
            depth[node] = -1
            return node.args[0]
        if node in names:
            return names[node]
        inner = [column(a) for a in node.args]
        at = 1 + max([depth[a] for a in node.args if isinstance(a, Node)], default=-1)
        constants = [a if isinstance(a, float) else i for a, i in zip(node.args, inner, strict=True)]
        if node.op == "ts_rank":
            x, n = inner[0], int(node.args[1])
            seen = put(at, f"list({x}) {_frame(n)}")
            many = put(at, f"count({x}) {_frame(n)}")
            at += 1
            sql = f"CASE WHEN {many} = {n} THEN (len(list_filter({seen}, lambda e: e < {x})) + len(list_filter({seen}, lambda e: e <= {x})) + 1) / {2.0 * n} END"
        elif node.op == "cs_scale":
            total = put(at, f"sum(abs({inner[0]})) OVER (PARTITION BY datetime)")
            at += 1
            sql = f"CASE WHEN {total} = 0 THEN 0.0 ELSE {_quotient(inner[0], total)} END"
        else:
            sql = OPERATORS[node.op](*(constants if node.op.startswith("ts_") else inner))
        names[node], depth[node] = put(at, sql), at
        return names[node]

    last = column(parse(text, COLUMNS))
    ctes, before = [], source
    for i, made in enumerate(steps):
        ctes.append(f"s{i} AS (SELECT *, {', '.join(made)} FROM {before})")
        before = f"s{i}"
    return ",\n".join([*ctes, f"q AS (SELECT datetime, vt_symbol, {last} AS v FROM {before})"])
