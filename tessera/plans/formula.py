"""Factor formulas: text to a shared expression graph to DataFrame columns in few partition-aligned stages."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross, rolling, smoothing
from tessera.functions import numeric as N
from tessera.functions.rolling import Clock, Shared
from tessera.plans.scratch import settle


#: Window operators that one plan may hold; then the columns so far are written to the shared folder and read again.
DEPTH = 40


class FormulaError(ValueError):
    """A formula that does not parse, with the place in it."""


@dataclass(frozen=True)
class Node:
    """``op`` over ``args``: nodes or numbers. ``kind`` says what rows a value depends on: its own, its symbol's, its date's."""

    op: str
    args: tuple
    kind: str = field(compare=False)


#: name: (kind, builder, number of columns, number of constants). Kinds: row, ts, cs, fold.
FUNCTIONS = {
    "ts_delay": ("ts", rolling.delay, 1, 1), "ts_min": ("ts", rolling.lowest, 1, 1), "ts_max": ("ts", rolling.highest, 1, 1),
    "ts_argmax": ("ts", rolling.argmax, 1, 1), "ts_argmin": ("ts", rolling.argmin, 1, 1), "ts_rank": ("ts", rolling.rank, 1, 1),
    "ts_sum": ("ts", rolling.total, 1, 1), "ts_mean": ("ts", rolling.mean, 1, 1), "ts_std": ("ts", rolling.std, 1, 1),
    "ts_slope": ("ts", rolling.slope, 1, 1), "ts_rsquare": ("ts", rolling.rsquare, 1, 1), "ts_resi": ("ts", rolling.resi, 1, 1),
    "ts_quantile": ("ts", rolling.quantile, 1, 2), "ts_corr": ("ts", rolling.corr, 2, 1), "ts_cov": ("ts", rolling.cov, 2, 1),
    "ts_delta": ("ts", rolling.delta, 1, 1), "ts_decay_linear": ("ts", rolling.decay, 1, 1), "ts_product": ("ts", rolling.product, 1, 1),
    "ts_less": ("row", N.less, 2, 0), "ts_greater": ("row", N.greater, 2, 0), "ts_log": ("row", N.ln, 1, 0), "ts_abs": ("row", N.absolute, 1, 0),
    "cs_rank": ("cs", cross.rank, 1, 0), "cs_mean": ("cs", cross.mean, 1, 0), "cs_std": ("cs", cross.std, 1, 0),
    "cs_sum": ("cs", cross.total, 1, 0), "cs_scale": ("cs", cross.scale, 1, 0), "cs_demean_by": ("cs", cross.demean, 1, 1),
    "less": ("row", N.less, 2, 0), "greater": ("row", N.greater, 2, 0), "log": ("row", N.ln, 1, 0), "abs": ("row", N.absolute, 1, 0),
    "sign": ("row", N.sign, 1, 0), "quesval": ("row", N.quesval, 4, 0), "quesval2": ("row", N.quesval2, 4, 0),
    "pow1": ("row", N.pow1, 2, 0), "pow2": ("row", N.pow2, 2, 0), "where": ("row", N.where, 3, 0), "mix": ("row", N.mix, 3, 0),
    "ta_rsi": ("fold", smoothing.rsi, 1, 1), "ta_atr": ("fold", smoothing.atr, 3, 1),
}

#: Shorter names, as in the literature.
ALIASES = {
    "rank": "cs_rank", "scale": "cs_scale", "delay": "ts_delay", "delta": "ts_delta", "sum": "ts_sum", "mean": "ts_mean", "std": "ts_std",
    "corr": "ts_corr", "cov": "ts_cov", "argmax": "ts_argmax", "argmin": "ts_argmin", "product": "ts_product", "min": "ts_min", "max": "ts_max",
}
#: Names that stand for formulas; adv<n> is the mean volume of n rows.
SHORTHAND = {"returns": "close / ts_delay(close, 1) - 1", "mid": "(high + low) / 2"}
_ROW = {
    "+": lambda a, b: N.lit(a) + N.lit(b), "-": lambda a, b: N.lit(a) - N.lit(b), "*": lambda a, b: N.lit(a) * N.lit(b), "/": N.div,
    "<": lambda a, b: (N.lit(a) < N.lit(b)).cast("int"), "<=": lambda a, b: (N.lit(a) <= N.lit(b)).cast("int"),
    ">": lambda a, b: (N.lit(a) > N.lit(b)).cast("int"), ">=": lambda a, b: (N.lit(a) >= N.lit(b)).cast("int"),
    "==": lambda a, b: (N.lit(a) == N.lit(b)).cast("int"), "!=": lambda a, b: (N.lit(a) != N.lit(b)).cast("int"),
}
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_FOLD = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


def parse(text: str, columns) -> Node | float:
    """The graph of a formula over the named columns. Only arithmetic, comparisons, names, numbers and known calls parse."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"{text!r}: {e.msg} at {e.offset}") from None

    def fail(node, what):
        raise FormulaError(f"{text!r}: {what} at {getattr(node, 'col_offset', 0) + 1}")

    def build(node):
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        if isinstance(node, ast.Name):
            if node.id in columns:
                return Node("column", (node.id,), "row")
            if node.id in SHORTHAND:
                return parse(SHORTHAND[node.id], columns)
            if node.id.startswith("adv") and node.id[3:].isdigit():
                return parse(f"ts_mean(volume, {node.id[3:]})", columns)
            fail(node, f"unknown name {node.id!r}")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = build(node.operand)
            return inner if isinstance(node.op, ast.UAdd) else -inner if isinstance(inner, float) else Node("*", (inner, -1.0), "row")
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return operate(node, _OPERATORS[type(node.op)], build(node.left), build(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _OPERATORS:
            return operate(node, _OPERATORS[type(node.ops[0])], build(node.left), build(node.comparators[0]))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name = ALIASES.get(node.func.id, node.func.id)
            if name not in FUNCTIONS:
                fail(node, f"unknown function {node.func.id!r}")
            kind, _, n_columns, n_constants = FUNCTIONS[name]
            args = tuple(build(a) for a in node.args)
            if len(args) != n_columns + n_constants:
                fail(node, f"{node.func.id} takes {n_columns + n_constants} arguments")
            if any(isinstance(a, Node) for a in args[n_columns:]):
                fail(node, f"{node.func.id} needs constants after its first {n_columns} arguments")
            return Node(name, args, kind)
        fail(node, f"{type(node).__name__} is not allowed")

    def operate(node, op, a, b):
        if isinstance(a, str) or isinstance(b, str):
            fail(node, "text is no operand")
        if isinstance(a, float) and isinstance(b, float):
            if op in _FOLD and (op != "/" or b):
                return _FOLD[op](a, b)
        return Node(op, (a, b), "row")

    return build(tree)


def _children(node):
    return [a for a in node.args if isinstance(a, Node)]


def evaluate(panel: DataFrame, formulas: Mapping[str, str | Column], clock: Clock = Clock(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``panel`` (or its ``keep`` columns) with one column for each formula; a value may be a ready Column instead of text.

    Equal sub-formulas of all formulas are computed once. Operators over a symbol's rows and those over a date's rows
    take turns: all that can be computed under one partitioning is, before the data are dealt out by the other, so the
    number of shuffles is that of the deepest formula, not the sum over formulas. Rows may come in any order.
    """
    base = list(panel.columns)
    keep = tuple(base) if keep is None else keep
    roots = {name: f if isinstance(f, Column) else parse(f, set(base)) for name, f in formulas.items()}
    order: list[Node] = []
    uses: dict[Node, int] = {}

    def visit(node):
        if not isinstance(node, Node):
            return
        uses[node] = uses.get(node, 0) + 1
        if uses[node] == 1:
            for child in _children(node):
                visit(child)
            order.append(node)

    for root in roots.values():
        visit(root)
    have: dict[Node, str] = {}
    waiting = [n for n in order if n.kind != "row"]

    def ready(node) -> bool:
        return node in have or node.kind == "row" and all(ready(c) for c in _children(node))

    def column(node) -> Column:
        if not isinstance(node, Node):
            return N.lit(node)
        if node in have:
            return F.col(have[node])
        if node.op == "column":
            return F.col(f"`{node.args[0]}`").cast("double")
        if node.op in _ROW:
            return _ROW[node.op](*(column(a) for a in node.args))
        return FUNCTIONS[node.op][1](*(column(a) if isinstance(a, Node) else a for a in node.args))

    def constants(node):
        return [int(a) if isinstance(a, float) and a == int(a) else a for a in node.args[FUNCTIONS[node.op][2] :]]

    def still(nodes, wanted) -> set[Node]:
        """Materialised nodes that the wanted ones read."""
        out, stack = set(), list(wanted)
        while stack:
            n = stack.pop()
            if n in have:
                out.add(n)
            else:
                stack += _children(n)
        return out

    def staged(df: DataFrame, wanted: list[Node], later: list[Node]) -> DataFrame:
        """``df`` with the wanted row-local nodes as columns, and what they build on where an expression would repeat it.

        Division, conditions and powers name an operand several times, so operands that are no plain column become
        columns first, one projection for each level of nesting. Columns that nothing reads any more are dropped.
        """
        levels: dict[Node, int] = {}

        def level(n) -> int:
            if not isinstance(n, Node) or n in have or n.op == "column":
                return 0
            if n not in levels:
                levels[n] = 1 + max((level(a) for a in n.args), default=0)
            return levels[n]

        for n in wanted:
            level(n)
        roots_ = [r for r in roots.values() if isinstance(r, Node)]
        needed = set(wanted) | {a for n in levels if n.op not in ("+", "-", "*") for a in _children(n)} | {n for n in levels if uses[n] > 1}
        for depth in sorted({levels[n] for n in needed & levels.keys()}):
            new = {n: f"_x{len(have) + i}" for i, n in enumerate(n for n in levels if levels[n] == depth and n in needed)}
            live = still(have, roots_ + later + [n for n in levels if n not in have])
            columns = base + [have[n] for n in live] + ([clock.position] if positioned else [])
            df = df.select(*(f"`{c}`" for c in columns), *(column(n).alias(name) for n, name in new.items()))
            have.update(new)
        return df

    df, mode, idle, depth = panel, "ts", 0, 0
    positioned = False
    while waiting:
        now = [n for n in waiting if n.kind == mode and all(ready(c) for c in _children(n))]
        if not now:
            idle += 1
            if idle > 3:
                raise AssertionError("formulas depend on themselves")
            mode = {"ts": "cs", "cs": "fold", "fold": "ts"}[mode]
            continue
        idle = 0
        if mode == "ts" and not positioned:
            df = df.withColumn(clock.position, clock.number())
            positioned = True
        df = staged(df, [a for n in now for a in _children(n)], waiting)
        new = {n: f"_v{len(have) + i}" for i, n in enumerate(now)}
        arguments = {n: [column(a) for a in n.args[: FUNCTIONS[n.op][2]]] for n in now}
        if mode == "fold":
            df = _folded(df, [(new[n], FUNCTIONS[n.op][1], arguments[n], constants(n)) for n in now], clock)
        else:
            shared = Shared(clock.symbol, clock.time, clock.position)
            first = shared if mode == "ts" else clock.time
            made = [FUNCTIONS[n.op][1](first, *arguments[n], *constants(n)).alias(new[n]) for n in now]
            before = df.columns
            if shared.definitions:
                df = df.select("*", *(c.alias(name) for name, c in shared.definitions.items()))
            df = df.select(*(f"`{c}`" for c in before), *made)
            depth += 1 if mode == "ts" else 1 + sum(n.op == "cs_rank" for n in now)  # each rank has an order of its own
        have |= new
        waiting = [n for n in waiting if n not in new]
        if depth >= DEPTH and waiting:
            df, depth = settle(df, "formulas"), 0
    df = staged(df, [a for r in roots.values() if isinstance(r, Node) and r not in have for a in _children(r)], [])
    return df.select(*(f"`{c}`" for c in keep), *((r if isinstance(r, Column) else column(r)).alias(name) for name, r in roots.items()))


def _folded(df: DataFrame, jobs, clock: Clock) -> DataFrame:
    """Recursive operators: one pass over each symbol's rows in time order."""
    staged = df.select("*", *(x.alias(f"{name}_{i}") for name, _, args, _ in jobs for i, x in enumerate(args)))
    plan = [(name, fn, [f"{name}_{i}" for i in range(len(args))], constants) for name, fn, args, constants in jobs]
    time = clock.time

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time, kind="stable")
        for name, fn, inputs, constants in plan:
            rows[name] = fn(*(rows[i].to_numpy("float64") for i in inputs), *constants)
        return rows.drop(columns=[i for _, _, inputs, _ in plan for i in inputs])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {name} double" for name, *_ in plan)
    return staged.groupBy(clock.symbol).applyInPandas(run, schema)
