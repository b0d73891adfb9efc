"""Factor expressions as text.

A sum of products of factors, where a factor is a number, a column, a call or
something in parentheses, perhaps with a minus. Calls name an operator; the last
numbers of a rolling operator are its window. Operators of text are the loose
ones: rolling ones need only half their window, and undefined ratios and
correlations are 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from factorloom.plans.graph import Node, call, compile_factors, field, node

FIELDS = ("open", "high", "low", "close", "volume", "vwap", "returns")
UNARY = ("abs", "neg", "sign", "log1p", "sqrt_abs")
BINARY = ("add", "sub", "mul", "safe_div")
#: The rolling operators of one argument, and what they are.
ROLLING = ("ts_mean", "ts_std", "ts_rank", "ts_delta", "ts_max", "ts_min", "ts_decay_linear")
ROLLING_PAIR = ("ts_corr",)
DAILY = ("cs_rank", "cs_zscore")
DEFAULT_WINDOW = 10

#: Expressions that the search starts from.
TEMPLATES = (
    "ts_corr(cs_rank(close), cs_rank(volume), 10)",
    "ts_corr(open, volume, 10)",
    "ts_corr(high, volume, 10)",
    "ts_corr(low, volume, 5)",
    "ts_corr(vwap, volume, 20)",
    "ts_corr(close, volume, 5)",
    "ts_delta(close, 5) * -1",
    "ts_delta(close, 10) * -1",
    "ts_delta(close, 20)",
    "ts_rank(returns, 5)",
    "ts_rank(returns, 20)",
    "ts_rank(volume, 20)",
    "cs_rank(ts_std(returns, 20)) * -1",
    "ts_decay_linear(ts_delta(close, 5), 10)",
    "ts_decay_linear(ts_delta(volume, 5), 10)",
    "ts_decay_linear(returns, 20)",
    "cs_rank(ts_mean(close, 10) / close - 1)",
    "cs_rank(ts_mean(close, 5) / close - 1)",
    "cs_rank(close / ts_mean(close, 20) - 1)",
    "ts_std(returns, 10)",
    "ts_std(returns, 20) * -1",
    "ts_std(close / ts_mean(close, 5) - 1, 10)",
    "ts_max(high, 10) / close - 1",
    "close / ts_min(low, 10) - 1",
    "ts_max(high, 20) / ts_min(low, 20) - 1",
    "cs_rank(vwap / close - 1)",
    "ts_delta(vwap, 5) * -1",
    "ts_corr(vwap, ts_mean(volume, 10), 10)",
    "cs_zscore(volume / ts_mean(volume, 20))",
    "ts_rank(volume / ts_mean(volume, 10), 5)",
)

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|(.))", re.S)
_SYMBOLS = {"+": "add", "-": "sub", "*": "mul", "/": "safe_div"}


class ParseError(ValueError):
    """The text is no expression."""


def loose(op: str, args: list[Node], window: int) -> Node:
    """A text operator's node in the graph."""
    half, two = max(1, window // 2), max(2, window // 2)
    if op == "ts_mean":
        return Node("ts_mean", tuple(args), (window, half))
    if op == "ts_std":
        return Node("ts_std", tuple(args), (window, two))
    if op in ("ts_max", "ts_min"):
        return Node(op, tuple(args), (window, half))
    if op == "ts_delta":
        return Node("ts_delta", tuple(args), (window,))
    if op == "ts_rank":
        return Node("loose_range", tuple(args), (window,))
    if op == "ts_decay_linear":
        return Node("loose_decay", tuple(args), (window,))
    if op == "ts_corr":
        return Node("loose_corr", tuple(args), (window,))
    return Node({"cs_rank": "cs_rank_raw"}.get(op, op), tuple(args))


def parse(text: str) -> Node:
    """The expression that a text says; raises ``ParseError``.

    Missing arguments have defaults: close, for a second one volume (ts_corr)
    or 1 (arithmetic); a window is 10. Numbers among the arguments of other
    operators are constants.
    """
    tokens = []
    for m in _TOKEN.finditer(text):
        if m[1]:
            tokens.append(("number", m[1]))
        elif m[2]:
            tokens.append(("name", m[2]))
        elif m[3].strip():
            tokens.append(("sign", m[3]))
    at = 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise ParseError(f"{text!r} ends too early")
        at += 1
        return tokens[at - 1]

    def expect(sign: str) -> None:
        if take()[1] != sign:
            raise ParseError(f"{text!r}: {sign} is missing")

    def binary(operand, signs: str):
        left = operand()
        while peek() in signs and peek():
            op = _SYMBOLS[take()[1]]
            left = Node(op, (left, operand()))
        return left

    def total() -> Node:
        return binary(product, "+-")

    def product() -> Node:
        return binary(factor, "*/")

    def factor() -> Node:
        kind, value = take()
        if value == "-":
            inner = factor()
            return node(-inner.numbers[0]) if inner.op == "const" else -inner
        if value == "(":
            inner = total()
            expect(")")
            return inner
        if kind == "number":
            return node(float(value))
        if kind != "name":
            raise ParseError(f"{text!r}: {value} isn't expected")
        if peek() != "(":
            return field(value)
        take()
        args: list[Node] = []
        while peek() != ")":
            args.append(total())
            if peek() != ")":
                expect(",")
        take()
        return made(value, args)

    def made(name: str, args: list[Node]) -> Node:
        window = DEFAULT_WINDOW
        if name in ROLLING + ROLLING_PAIR and args and args[-1].op == "const":
            window = int(args.pop().numbers[0])
            if window < 1:
                raise ParseError(f"{text!r}: a window is at least 1")
        pair = name in ROLLING_PAIR or name in BINARY
        if name not in ROLLING + ROLLING_PAIR + BINARY + UNARY + DAILY:
            raise ParseError(f"{text!r}: no operator {name}")
        if len(args) > 1 + pair:
            raise ParseError(f"{text!r}: {name} takes {1 + pair} arguments")
        rest = [field("close"), field("volume") if name in ROLLING_PAIR else node(1.0)]
        return loose(name, args + rest[len(args) : 1 + pair], window)

    found = total()
    if at < len(tokens):
        raise ParseError(f"{text!r}: {peek()} isn't expected")
    return found


_LOOSE_NAMES = {"loose_range": "ts_rank", "loose_decay": "ts_decay_linear", "loose_corr": "ts_corr", "cs_rank_raw": "cs_rank"}


def to_text(x: Node) -> str:
    """An expression's text, which parses to itself."""
    if x.op == "field":
        return str(x.numbers[0])
    if x.op == "const":
        return repr(x.numbers[0])
    name = _LOOSE_NAMES.get(x.op, x.op)
    parts = [to_text(a) for a in x.args]
    if name in ROLLING + ROLLING_PAIR:
        parts.append(str(x.numbers[0]))
    return f"{name}({', '.join(parts)})"


def apply_expression(panel: DataFrame, text: str, name: str, asset: str = "asset", date: str = "date") -> DataFrame:
    """``panel`` with a column for an expression."""
    return compile_factors(panel, {name: parse(text)}, asset, date)
