"""The expression language: text, to a tree, to a Spark column. Nothing is evaluated as Python.

Nulls follow SQL: an operand that is null makes the value null (``??`` replaces it, ``== nil`` asks for it), and a
filter drops what is not true. Division by zero gives null. ``#`` is the element in ``filter``, ``map``, ``all``,
``any`` and ``count``; ``#acc`` the accumulator in ``reduce``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import RequestError

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)(?!\w)|(?P<name>[A-Za-z_]\w*|\#acc|\#)
    |(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<op>\*\*|==|!=|<=|>=|&&|\|\||\?\?|\.\.|[-+*/%<>!?:()\[\],.]))""",
    re.X,
)
#: Binding strength of the binary operators.
BINDS = {
    "?": 1, "??": 2, "or": 3, "||": 3, "and": 4, "&&": 4, "==": 5, "!=": 5, "<": 6, "<=": 6, ">": 6, ">=": 6, "in": 6,
    "not": 6, "contains": 6, "startsWith": 6, "endsWith": 6, "matches": 6, "..": 7, "+": 8, "-": 8, "*": 9, "/": 9,
    "%": 9, "**": 11,
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Scope:
    """What names mean: columns, constants, lookup tables, the columns that ``total(...)`` was worked out as, and fitted
    models. A lookup table is a mapping, whose values may be vectors (``ref``), or for ``range_label`` a list of ranges."""

    columns: Mapping[str, Column]
    constants: Mapping[str, object] = field(default_factory=dict)
    lookups: Mapping[str, Mapping] = field(default_factory=dict)
    totals: Callable[[Column], Column] | None = None
    element: Column | None = None
    accumulator: Column | None = None
    models: Mapping[str, Mapping] = field(default_factory=dict)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RequestError(f"expression {text!r}: unexpected {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokens(text), 0

    def fail(self, why: str) -> RequestError:
        return RequestError(f"expression {self.text!r}: {why}")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if value is not None and token[1] != value:
            raise self.fail(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] != "text" else ""

    def parse(self) -> tuple:
        tree = self.expression(0)
        if self.tokens[self.at][0] != "end":
            raise self.fail(f"unexpected {self.peek()!r}")
        return tree

    def expression(self, least: int) -> tuple:
        left = self.prefix()
        while (op := self.peek()) in BINDS and BINDS[op] > least:
            self.take()
            if op == "?":
                if_true = self.expression(0)
                self.take(":")
                left = ("if", left, if_true, self.expression(0))
            elif op == "not":
                self.take("in")
                left = ("unary", "not", ("binary", "in", left, self.expression(BINDS["in"])))
            else:
                right = self.expression(BINDS[op] - (op == "**"))
                left = ("binary", {"&&": "and", "||": "or"}.get(op, op), left, right)
        return left

    def prefix(self) -> tuple:
        kind, value = self.take()
        if kind == "number":
            return ("value", float(value) if re.search("[.eE]", value) else int(value))
        if kind == "text":
            body = value[1:-1]
            return ("value", body if value[0] == "`" else re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), body))
        if value in ("-", "+"):
            return ("unary", value, self.expression(10))
        if value in ("!", "not"):
            return ("unary", "not", self.expression(5 if value == "not" else 10))
        if value == "(":
            tree = self.expression(0)
            self.take(")")
            return self.suffix(tree)
        if value == "[":
            return self.suffix(("list", self.items("]")))
        if kind == "name":
            if value in ("true", "false", "nil"):
                return ("value", {"true": True, "false": False, "nil": None}[value])
            if self.peek() == "(":
                self.take()
                return self.suffix(("call", value, self.items(")")))
            return self.suffix(("name", value))
        raise self.fail(f"unexpected {value!r}")

    def items(self, end: str) -> list[tuple]:
        out = []
        while self.peek() != end:
            out.append(self.expression(0))
            if self.peek() != end:
                self.take(",")
        self.take(end)
        return out

    def suffix(self, tree: tuple) -> tuple:
        while self.peek() in ("[", "."):
            if self.take()[1] == "[":
                index = self.expression(0)
                self.take("]")
                tree = ("index", tree, index)
            else:
                tree = ("member", tree, self.take()[1])
        return tree


def reads(tree: tuple) -> set[str]:
    """Names of the columns that a tree reads."""
    if tree[0] == "name":
        return {tree[1]} - {"#", "#acc"}
    out: set[str] = set()
    for part in tree[1:]:
        for x in part if isinstance(part, list) else [part]:
            if isinstance(x, tuple):
                out |= reads(x)
    return out


def compile_expression(text: str, scope: Scope) -> Column:
    return _column(Parser(text).parse(), scope)


def literal(value: object) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    return F.lit(value)


def _column(tree: tuple, s: Scope) -> Column:
    kind = tree[0]
    if kind == "value":
        return F.lit(tree[1])
    if kind == "name":
        return _name(tree[1], s)
    if kind == "list":
        return F.array(*(_column(x, s) for x in tree[1]))
    if kind == "if":
        return F.when(_column(tree[1], s), _column(tree[2], s)).otherwise(_column(tree[3], s))
    if kind == "unary":
        inner = _column(tree[2], s)
        return {"-": lambda: -inner, "+": lambda: inner, "not": lambda: ~inner}[tree[1]]()
    if kind == "index":
        return F.get(_column(tree[1], s), _column(tree[2], s).cast("int"))
    if kind == "member":
        if tree[1] == ("name", "params"):
            if tree[2] not in s.constants:
                raise RequestError(f"no parameter {tree[2]!r}")
            return literal(s.constants[tree[2]])
        return _column(tree[1], s)[tree[2]]
    if kind == "binary":
        return _binary(tree[1], tree[2], tree[3], s)
    return _call(tree[1], tree[2], s)


def _name(name: str, s: Scope) -> Column:
    if name == "#" and s.element is not None:
        return s.element
    if name == "#acc" and s.accumulator is not None:
        return s.accumulator
    if name in s.columns:
        return s.columns[name]
    if name in s.constants:
        return literal(s.constants[name])
    raise RequestError(f"no field {name!r}")


def _binary(op: str, a: tuple, b: tuple, s: Scope) -> Column:
    if op in ("==", "!=") and ("value", None) in (a, b):
        inner = _column(b if a == ("value", None) else a, s)
        return inner.isNull() if op == "==" else inner.isNotNull()
    x, y = _column(a, s), _column(b, s)
    if op == "in":
        return F.array_contains(y, x) if b[0] != "binary" else x.between(*(_column(t, s) for t in b[2:]))
    if op == "..":
        return F.sequence(x, y)
    if op == "matches":
        return x.rlike(b[1]) if b[0] == "value" else F.rlike(x, y)
    simple: dict[str, Callable[[], Column]] = {
        "+": lambda: F.concat(x, y) if _is_text(a) or _is_text(b) else x + y,
        "-": lambda: x - y,
        "*": lambda: x * y,
        "/": lambda: F.try_divide(x, y),
        "%": lambda: F.try_mod(x, y),
        "**": lambda: F.pow(x, y),
        "==": lambda: x == y,
        "!=": lambda: x != y,
        "<": lambda: x < y,
        "<=": lambda: x <= y,
        ">": lambda: x > y,
        ">=": lambda: x >= y,
        "and": lambda: x & y,
        "or": lambda: x | y,
        "??": lambda: F.coalesce(x, y),
        "contains": lambda: F.contains(x, y),
        "startsWith": lambda: F.startswith(x, y),
        "endsWith": lambda: F.endswith(x, y),
    }
    return simple[op]()


def _is_text(tree: tuple) -> bool:
    return tree[0] == "value" and isinstance(tree[1], str) or tree[0] == "call" and tree[1] in ("string", "lower", "upper", "trim", "join", "replace")


def _valid(v: Column) -> Column:
    """Elements of a vector that take part: neither null nor NaN."""
    return F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def _sum(v: Column) -> Column:
    return F.aggregate(_valid(v), F.lit(0.0), lambda t, x: t + x.cast("double"))


def _mean(v: Column) -> Column:
    return F.try_divide(_sum(v), F.size(_valid(v)))


def _sd(v: Column) -> Column:
    m, n = _mean(v), F.size(_valid(v))
    squares = F.aggregate(_valid(v), F.lit(0.0), lambda t, x: t + (x - m) * (x - m))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def _median(v: Column) -> Column:
    ordered, n = F.array_sort(_valid(v).cast("array<double>")), F.size(_valid(v))
    low, high = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum over the positions that both vectors have a value at."""
    each = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(_valid(each), F.lit(0.0), lambda t, x: t + x)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_valid(v), F.lit(0.0), lambda t, x: t + x * x))


def _ratio(over: Callable[[Column, Column], Column], under: Callable[[Column, Column], Column]) -> Callable:
    """A set similarity: sizes of what is shared and of a base; null where the base is empty."""
    return lambda a, b: F.try_divide(over(a, b).cast("double"), under(a, b))


def _both(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _xor(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def _hill(x: Column, k: Column, n: Column) -> Column:
    return F.when((x >= 0) & (k > 0), F.try_divide(F.pow(x, n), F.pow(x, n) + F.pow(k, n)))


def _place(v: Column, best: Callable[[Column], Column]) -> Column:
    """Position from 0 of the first largest or smallest element."""
    return F.nullif(F.array_position(v, best(_valid(v))), F.lit(0)) - 1


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": lambda x, *n: F.round(x, 0) if not n else F.round(x, n[0]),
    "int": lambda x: x.cast("bigint"), "float": lambda x: x.cast("double"), "string": lambda x: x.cast("string"),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "log": lambda x: F.when(x > 0, F.log(x)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)), "exp": F.exp, "pow": F.pow, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "atan2": F.atan2, "pi": lambda: F.lit(math.pi), "e": lambda: F.lit(math.e), "hill": _hill,
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else F.array_max(x[0]),
    "min": lambda *x: F.least(*x) if len(x) > 1 else F.array_min(x[0]),
    "sum": _sum, "mean": _mean, "median": _median, "len": F.size,
    "keys": F.map_keys, "values": F.map_values, "concat": F.concat, "sort": F.array_sort, "uniq": F.array_distinct,
    "join": lambda v, *sep: F.array_join(v.cast("array<string>"), ""), "trim": F.trim, "lower": F.lower, "upper": F.upper,
    "replace": F.replace, "hasPrefix": F.startswith, "hasSuffix": F.endswith,
    "toJSON": lambda x: F.to_json(F.struct(x.alias("value"))),
    "fromJSON": lambda x: F.from_json(x.cast("string"), "map<string,string>"), "now": F.current_timestamp, "date": F.to_date,
    "weekday": lambda d: F.weekday(d) + 1, "month_index": lambda d: F.year(d) * 12 + F.month(d) - 1,
    "to_day": lambda d: F.unix_date(F.to_date(d)),
    "has_any": F.arrays_overlap, "has_all": lambda a, b: F.size(F.array_except(b, a)) == 0,
    "has_none": lambda a, b: ~F.arrays_overlap(a, b), "popcount": lambda a: F.when(a.isNotNull(), F.size(a)),
    "set_union": lambda a, b: F.array_sort(F.array_union(a, b)), "set_intersect": lambda a, b: F.array_sort(F.array_intersect(a, b)),
    "set_diff": lambda a, b: F.array_sort(F.array_except(a, b)), "set_xor": _xor,
    "jaccard": _ratio(_both, lambda a, b: F.size(F.array_union(a, b))),
    "dice": _ratio(lambda a, b: 2 * _both(a, b), lambda a, b: F.size(a) + F.size(b)),
    "overlap": _ratio(_both, lambda a, b: F.least(F.size(a), F.size(b))),
    "hamming": lambda a, b: F.size(_xor(a, b)),
    "vsum": _sum, "vmean": _mean, "vmin": lambda v: F.array_min(_valid(v)), "vmax": lambda v: F.array_max(_valid(v)),
    "norm": _norm, "vcount": lambda v: F.size(_valid(v)), "vsd": _sd,
    "dot": lambda a, b: _pairs(a, b, lambda x, y: x * y), "dist": lambda a, b: F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y))),
    "cosine": lambda a, b: F.try_divide(_pairs(a, b, lambda x, y: x * y), _norm(a) * _norm(b)),
    "argmax": lambda v: _place(v, F.array_max), "argmin": lambda v: _place(v, F.array_min),
    "vcenter": lambda v: F.transform(v, lambda x: x - _mean(v)),
    "vzscore": lambda v: F.transform(v, lambda x: F.try_divide(x - _mean(v), _sd(v))),
    "vnormalize": lambda v: F.transform(v, lambda x: F.try_divide(x, _norm(v))),
}
ELEMENTWISE = {"filter": F.filter, "map": F.transform, "all": F.forall, "any": F.exists}


def _call(name: str, args: list[tuple], s: Scope) -> Column:
    if name in ELEMENTWISE or name == "count":
        inner = lambda x: _column(args[1], replace(s, element=x))
        v = _column(args[0], s)
        return F.size(F.filter(v, inner)) if name == "count" else ELEMENTWISE[name](v, inner)
    if name == "reduce":
        step = lambda t, x: _column(args[1], replace(s, element=x, accumulator=t)).cast("double")
        return F.aggregate(_column(args[0], s), (_column(args[2], s) if len(args) > 2 else F.lit(0)).cast("double"), step)
    if name in BOUND:
        return BOUND[name](args, s)
    if name == "total":
        if s.totals is None:
            raise RequestError("total(...) isn't available here")
        return s.totals(_column(args[0], s))
    if name == "split":
        return F.split(_column(args[0], s), re.escape(_constant(args[1])))
    if name == "join":
        return F.array_join(_column(args[0], s).cast("array<string>"), _constant(args[1]) if len(args) > 1 else "")
    if name == "indexOf":
        return F.instr(_column(args[0], s), _constant(args[1])) - 1
    if name == "date_trunc":
        return F.date_trunc(_constant(args[0]), _column(args[1], s))
    if name == "round" and len(args) > 1:
        return F.round(_column(args[0], s), int(_constant(args[1])))
    if name not in FUNCTIONS:
        raise RequestError(f"no function {name!r}")
    return FUNCTIONS[name](*(_column(a, s) for a in args))


def _constant(tree: tuple) -> object:
    if tree[0] != "value":
        raise RequestError("a constant is needed here")
    return tree[1]


def _lookup(args: list[tuple], s: Scope) -> Column:
    """``lookup(table, key)``: a miss is an error unless a third argument says what it gives."""
    name = str(_constant(args[0]) if args[0][0] == "value" else args[0][1])
    if name not in s.lookups:
        raise RequestError(f"no lookup table {name!r}")
    found = s.lookups[name]
    if not found:
        raise RequestError(f"lookup table {name!r} is empty")
    table = F.create_map(*(F.lit(x) for pair in found.items() for x in pair))
    key = _column(args[1], s)
    got = F.try_element_at(table, key)
    if len(args) > 2:
        return F.coalesce(got, _column(args[2], s))
    miss = F.raise_error(F.concat(F.lit(f"lookup {name}: no key "), key.cast("string")))
    return F.when(key.isNotNull() & got.isNull(), miss.cast("string").cast(_kind(found))).otherwise(got)


def _table(args: list[tuple], s: Scope) -> object:
    name = str(_constant(args[0]) if args[0][0] == "value" else args[0][1])
    if name not in s.lookups:
        raise RequestError(f"no lookup table {name!r}")
    return s.lookups[name]


def _range_label(args: list[tuple], s: Scope) -> Column:
    """``range_label(table, x)``: the label of the range that holds x; null for a null x, the third argument or null where
    none does. A range is (from, to, label): half open for numbers, both ends in for dates (ISO text); null is no bound."""
    x, out = _column(args[1], s), None
    for low, high, label in _table(args, s):
        dated = isinstance(low, str) or isinstance(high, str)
        low, high = (None if v is None else F.lit(v).cast("date") if dated else F.lit(v) for v in (low, high))
        inside = F.lit(True) if low is None else x >= low
        if high is not None:
            inside &= x <= high if dated else x < high
        out = F.when(inside, label) if out is None else out.when(inside, label)
    other = _column(args[2], s) if len(args) > 2 else F.lit(None).cast("string")
    return F.when(x.isNotNull(), other if out is None else out.otherwise(other))


def _reference(args: list[tuple], s: Scope) -> Column:
    """``ref(table, key)``: a reference vector; a key that the table lacks is an error, a null key gives null."""
    found, key = _table(args, s), _column(args[1], s).cast("string")
    vectors = F.create_map(*(x for k, v in found.items() for x in (F.lit(str(k)), F.array(*(F.lit(float(e)) for e in v)))))
    miss = F.raise_error(F.concat(F.lit("ref: no key "), key)).cast("array<double>")
    got = F.try_element_at(vectors, key)
    return F.when(key.isNotNull(), F.coalesce(got, miss))


def _model(args: list[tuple], s: Scope) -> Mapping:
    name = str(_constant(args[0]) if args[0][0] == "value" else args[0][1])
    if name not in s.models:
        raise RequestError(f"no fitted model {name!r}")
    return s.models[name]


def _coefficient(args: list[tuple], s: Scope) -> Column:
    """``coef(fit, term)``, or with a third argument that statistic of the term: se, t, z, p, lower, upper."""
    fit, term = _model(args, s), str(_constant(args[1]))
    if term not in fit["coefficients"]:
        raise RequestError(f"coef: no term {term!r}; one of {sorted(fit['coefficients'])}")
    if len(args) < 3 or _constant(args[2]) in ("coef", "estimate"):
        return F.lit(float(fit["coefficients"][term]))
    found = fit.get(str(_constant(args[2])))
    if not isinstance(found, (list, tuple)):
        raise RequestError(f"coef: the fit has no {_constant(args[2])!r} by term")
    value = found[list(fit["coefficients"]).index(term)]
    return F.lit(None if value is None else float(value)).cast("double")


def _response(args: list[tuple], s: Scope) -> Column:
    """``response(fit, channel, spend)``: what a media-mix fit expects of a channel at a steady spend: the channel's
    coefficient times its saturation curve."""
    fit, channel = _model(args, s), str(_constant(args[1]))
    terms = fit["coefficients"]
    if channel not in terms:
        raise RequestError(f"response: no channel {channel!r}")
    steady = _column(args[2], s).cast("double")  # carry-over weights add up to 1
    if f"{channel}.half" in terms:
        steady = _hill(steady, F.lit(float(terms[f"{channel}.half"])), F.lit(float(terms[f"{channel}.shape"])))
    return float(terms[channel]) * steady


def _swept(args: list[tuple], s: Scope) -> Column:
    """``sweep_axis(fit, axis)``: the value at which a sweep found the fit."""
    at = _model(args, s).get("swept", {})
    axis = str(_constant(args[1]))
    if axis not in at:
        raise RequestError(f"sweep_axis: the fit has no axis {axis!r}")
    return literal(at[axis])


def _result(args: list[tuple], s: Scope) -> Column:
    """``result(slot, name)``: a number of a finished request of the same batch."""
    values, name = _model(args, s), str(_constant(args[1]))
    if name not in values:
        raise RequestError(f"result: no {name!r}")
    return literal(values[name])


def _duration(args: list[tuple], s: Scope) -> Column:
    """``duration("1h30m")``: an interval, of hours, minutes, seconds and milliseconds."""
    text = str(_constant(args[0]))
    sizes = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6}
    found = re.findall(r"(\d+(?:\.\d+)?)(ms|us|h|m|s)", text)
    if "".join(a + b for a, b in found) != text.lstrip("-") or not found:
        raise RequestError(f"duration: {text!r} isn't one")
    seconds = sum(float(n) * sizes[u] for n, u in found) * (-1 if text.startswith("-") else 1)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


#: Functions that read what a request binds: tables, fitted models, results.
BOUND: dict[str, Callable[[list[tuple], Scope], Column]] = {
    "lookup": _lookup, "range_label": _range_label, "ref": _reference, "coef": _coefficient, "response": _response,
    "sweep_axis": _swept, "result": _result, "duration": _duration,
}


def _kind(found: Mapping) -> str:
    values = [*found.values()]
    if all(isinstance(v, bool) for v in values):
        return "boolean"
    if all(isinstance(v, int) for v in values):
        return "bigint" if any(abs(v) >> 31 for v in values) else "int"
    return "double" if all(isinstance(v, (int, float)) for v in values) else "string"
