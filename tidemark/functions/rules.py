"""The rule language: text to a Column that is true or false, never null.

    or < and < not < comparison;  comparisons: < <= > >= == !=, ``path matches "re"`` (search), ``path in [..]``;
    terms: literals, dotted paths, len(path).

An absent operand makes a comparison true if its path is optional and false if it is required. Operands of different
kinds (number, text, boolean) compare as false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'\s*(?:(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<op><=|>=|==|!=|<|>|\(|\)|\[|\]|,)|(?P<word>[A-Za-z_][\w.]*))')


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Literal:
    value: object

    @property
    def kind(self) -> str:
        return "bool" if isinstance(self.value, bool) else "text" if isinstance(self.value, str) else "number"


@dataclass(frozen=True)
class Path:
    name: str
    length: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected text at {at}: {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.rest = tokens(text)

    def peek(self) -> str | None:
        return self.rest[0][1] if self.rest else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if not self.rest or want is not None and self.rest[0][1] != want:
            raise RuleError(f"expected {want or 'a term'}, found {self.peek()!r}")
        return self.rest.pop(0)

    def chain(self, word: str, below) -> object:
        parts = [below()]
        while self.peek() == word:
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Logic(word, tuple(parts))

    def expression(self) -> object:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self) -> object:
        if self.peek() == "not":
            self.take()
            return Logic("not", (self.negation(),))
        if self.peek() == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        return self.comparison()

    def term(self) -> object:
        kind, text = self.take()
        if kind == "num":
            return Literal(Decimal(text))
        if kind == "str":
            return Literal(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if text in ("true", "false"):
            return Literal(text == "true")
        if kind != "word":
            raise RuleError(f"unexpected {text!r}")
        if text == "len" and self.peek() == "(":
            self.take()
            inner = self.take()[1]
            self.take(")")
            return Path(inner, True)
        return Path(text)

    def comparison(self) -> object:
        left = self.term()
        _, op = self.take()
        if op == "matches":
            return Compare(op, left, self.term())
        if op == "in":
            self.take("[")
            values = []
            while self.peek() != "]":
                values.append(self.term())
                if self.peek() == ",":
                    self.take()
            self.take("]")
            return Compare(op, left, tuple(values))
        if op not in ("<", "<=", ">", ">=", "==", "!="):
            raise RuleError(f"unknown comparison {op!r}")
        return Compare(op, left, self.term())


def parse(text: str) -> object:
    p = _Parser(text)
    out = p.expression()
    if p.rest:
        raise RuleError(f"unexpected {p.peek()!r}")
    return out


def _kind(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "text" if isinstance(t, T.StringType) else "number" if isinstance(t, T.NumericType) else "other"


def compile_rule(rule: str | object, schema: T.StructType, optional: set[str] = frozenset()) -> Column:
    """A Column for the rule over rows of ``schema``; ``optional``: the paths that may be absent."""
    tree = parse(rule) if isinstance(rule, str) else rule

    def type_of(path: Path) -> T.DataType:
        t: T.DataType = schema
        for part in path.name.split("."):
            if not isinstance(t, T.StructType) or part not in t.names:
                raise RuleError(f"no field {path.name}")
            t = t[part].dataType
        return t

    def operand(x: object) -> tuple[Column, str, bool | None]:
        """Column, kind and, for a path, whether it is optional."""
        if isinstance(x, Literal):
            return F.lit(x.value), x.kind, None
        c, t = F.col(x.name), type_of(x)
        if x.length:
            c = F.char_length(c) if isinstance(t, T.StringType) else F.when(c.isNotNull(), F.size(c))
            return c, "number", x.name in optional
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            raise RuleError(f"{x.name} is compared through len() or one of its fields")
        return c, _kind(t), x.name in optional

    return build(tree, operand)


def build(tree: object, operand) -> Column:
    """A Column for a parsed rule; ``operand(term)``: Column, kind and, for a path, whether it may be absent."""

    def compare(node: Compare) -> Column:
        left, kind, opt = operand(node.left)
        absent, vacuous = left.isNull(), bool(opt)
        if node.op == "matches":
            if kind != "text" or not isinstance(node.right, Literal):
                raise RuleError("matches needs a text path and a pattern")
            if re.search(r"\\z|\(\?<?[=!]", node.right.value):
                raise RuleError("pattern uses look-around or \\z")
            result = left.rlike(node.right.value)
        elif node.op == "in":
            values = [v.value for v in node.right if v.kind == kind]
            result = left.isin(*values) if values else F.lit(False)
        else:
            right, other, opt2 = operand(node.right)
            absent, vacuous = absent | right.isNull(), bool(opt or opt2)
            result = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[node.op] if kind == other else F.lit(False)
        return F.when(absent, F.lit(vacuous)).otherwise(result)

    def whole(node: object) -> Column:
        if isinstance(node, Compare):
            return compare(node)
        parts = [whole(p) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out

    return whole(tree)


def violations(df: DataFrame, rules: dict[str, str], optional: set[str] = frozenset()) -> DataFrame:
    """``df`` with ``errors``: the names of the rules a row breaks, in the order of ``rules``."""
    broken = [F.when(~compile_rule(r, df.schema, optional), F.lit(name)) for name, r in rules.items()]
    return df.withColumn("errors", F.filter(F.array(*broken), lambda x: x.isNotNull()))
