"""The filter-expression language, compiled to Columns.

A value is a number or a string, with null for unknown, and a truth of its own: unknown is false, but ``!`` of it is true, a
present tag is true even if 0, and ``&&`` and ``||`` are one level, read from the left. No Python runs on the data.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<tag>\[[A-Za-z][A-Za-z0-9]\])|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>&&|\|\||==|!=|=~|!~|>=|<=|[-+*/%&|^~!<>(),]))""")

# What names stand for in POSIX bracket expressions.
_POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": "0-9a-fA-F"}


@dataclass
class Value:
    col: Column
    kind: str  # "num" or "str"
    truth: Column | None = None

    def true(self) -> Column:
        if self.truth is not None:
            return F.coalesce(self.truth, F.lit(False))
        known = (self.col != 0) if self.kind == "num" else self.col.isNotNull()
        return F.coalesce(known, F.lit(False))


class FilterError(ValueError):
    pass


class _Parser:
    """Precedence from the loosest: logic, equality and match, order, |, ^, &, sum, product, unary."""

    def __init__(self, text: str, names: Mapping[str, Column], types: Mapping[str, str], tags: Column | None):
        self.names, self.types, self.tags, self.tokens, self.k = names, types, tags, [], 0
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.k][1] if self.k < len(self.tokens) and self.tokens[self.k][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if (op := self.peek()) in ops:
            self.k += 1
            return op
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FilterError(f"{op} expected")

    def logic(self) -> Value:
        left = self.equality()
        while op := self.take("&&", "||"):
            right = self.equality()
            t = left.true() & right.true() if op == "&&" else left.true() | right.true()
            left = Value(t.cast("double"), "num", t)
        return left

    def equality(self) -> Value:
        left = self.order()
        while op := self.take("==", "!=", "=~", "!~"):
            if op in ("=~", "!~"):
                right = self.order()
                hit = F.coalesce(F.rlike(left.col.cast("string"), self._regex(right)), F.lit(False))
                t = hit if op == "=~" else ~hit
            else:
                right = self.order()
                same = F.lit(False) if left.kind != right.kind else left.col == right.col
                t = same if op == "==" else ~same
            left = Value(t.cast("double"), "num", t)
        return left

    def _regex(self, v: Value) -> Column:
        out = v.col
        for k, s in _POSIX.items():
            out = F.replace(out, F.lit(f"[:{k}:]"), F.lit(s))
        return out

    def order(self) -> Value:
        left = self.bits(0)
        while op := self.take(">=", "<=", ">", "<"):
            right = self.bits(0)
            if left.kind != right.kind:
                raise FilterError("numbers and strings can't be ordered")
            t = {">": left.col > right.col, "<": left.col < right.col, ">=": left.col >= right.col, "<=": left.col <= right.col}[op]
            left = Value(t.cast("double"), "num", t)
        return left

    def bits(self, level: int) -> Value:
        if level == 3:
            return self.sum()
        left = self.bits(level + 1)
        while op := self.take("|^&"[level]):
            right = self.bits(level + 1)
            a, b = (self._number(x).cast("long") for x in (left, right))
            left = Value({"|": a.bitwiseOR(b), "^": a.bitwiseXOR(b), "&": a.bitwiseAND(b)}[op].cast("double"), "num")
        return left

    def _number(self, v: Value) -> Column:
        if v.kind != "num":
            raise FilterError("a number is expected")
        return v.col

    def sum(self) -> Value:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            a, b = self._number(left), self._number(right)
            left = Value(a + b if op == "+" else a - b, "num")
        return left

    def product(self) -> Value:
        left = self.unary()
        while op := self.take("*", "/", "%"):
            right = self.unary()
            a, b = self._number(left), self._number(right)
            if op == "*":
                out = a * b
            elif op == "/":  # by zero: an infinity, or unknown for 0 / 0
                big = F.lit(float("inf"))
                out = F.when(b == 0, F.when(a > 0, big).when(a < 0, -big)).otherwise(F.try_divide(a, b))
            else:
                out = F.try_mod(a.cast("long"), b.cast("long")).cast("double")
            left = Value(out, "num")
        return left

    def unary(self) -> Value:
        if op := self.take("!", "-", "+", "~"):
            v = self.unary()
            if op == "!":
                t = ~v.true()
                return Value(t.cast("double"), "num", t)
            a = self._number(v)
            return Value({"-": -a, "+": a, "~": F.bitwise_not(a.cast("long")).cast("double")}[op], "num")
        return self.atom()

    def atom(self) -> Value:
        if self.take("("):
            v = self.logic()
            self.need(")")
            return v
        if self.k >= len(self.tokens) or self.tokens[self.k][0] == "op":
            raise FilterError("a value is expected")
        kind, text = self.tokens[self.k]
        self.k += 1
        if kind == "num":
            return Value(F.lit(float(int(text, 16) if text[:2].lower() == "0x" else text)), "num")
        if kind == "str":
            s = F.lit(re.sub(r"\\(.)", r"\1", text[1:-1]))
            return Value(s, "str", F.lit(True))
        if kind == "tag":
            if self.tags is None:
                raise FilterError("there are no tags")
            v = F.try_element_at(self.tags, F.lit(text[1:-1]))
            return Value(v, "str", v.isNotNull())
        if self.take("("):
            return self.call(text)
        if text not in self.names:
            raise FilterError(f"unknown name {text}")
        kind = self.types.get(text, "num")
        col = self.names[text]
        return Value(col.cast("double") if kind == "num" else col, kind, None if kind == "num" else col.isNotNull())

    def call(self, name: str) -> Value:
        args = [self.logic()]
        while self.take(","):
            args.append(self.logic())
        self.need(")")
        a = args[0]
        if name == "length":
            return Value(F.octet_length(a.col.cast("string")).cast("double"), "num")
        if name in ("min", "max", "avg"):
            text = a.col.cast("string")
            codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
            n = F.length(text)
            total = F.aggregate(codes, F.lit(0.0), lambda x, y: x + y)
            return Value(F.when(n > 0, {"min": F.array_min(codes).cast("double"), "max": F.array_max(codes).cast("double"), "avg": total / n}[name]), "num")
        if name == "exists":
            t = a.col.isNotNull()
            return Value(t.cast("double"), "num", t)
        if name == "default":
            b = args[1]
            return Value(F.coalesce(a.col, b.col), a.kind, F.when(a.col.isNotNull(), a.true()).otherwise(b.true()))
        maths = {"exp": F.exp, "log": F.log, "sqrt": F.sqrt}
        if name in maths or name == "pow":
            out = F.pow(self._number(a), self._number(args[1])) if name == "pow" else maths[name](self._number(a))
            return Value(F.when(~F.isnan(out), out), "num")
        raise FilterError(f"unknown function {name}")


def compiled(text: str, names: Mapping[str, Column], types: Mapping[str, str] | None = None, tags: Column | None = None) -> Value:
    """The expression's value and truth. types: "str" for names of strings, else numbers."""
    p = _Parser(text, names, types or {}, tags)
    v = p.logic()
    if p.k != len(p.tokens):
        raise FilterError(f"unexpected {p.tokens[p.k][1]!r}")
    return v


def predicate(text: str, names: Mapping[str, Column], types: Mapping[str, str] | None = None, tags: Column | None = None) -> Column:
    return compiled(text, names, types, tags).true()


def alignment_names() -> tuple[dict[str, Column], dict[str, str]]:
    """Names of an alignment's fields over the columns of sources.sam."""
    from strandloom.functions.strings import FLAG_NAMES
    from strandloom.operators.cigar import end_position, parse, query_length, ref_length

    c = F.col
    names = {"flag": c("flag"), "mapq": c("mapq"), "pos": c("pos") + 1, "qname": c("qname"), "rname": c("rname"), "mrname": c("rnext"), "rnext": c("rnext"), "pnext": c("pnext") + 1, "mpos": c("pnext") + 1, "tlen": c("tlen"), "seq": c("seq"), "qual": c("qual"), "cigar": c("cigar"), "ncigar": F.size(parse(c("cigar"))), "qlen": query_length(c("cigar")), "rlen": ref_length(c("cigar")), "endpos": end_position(c("pos"), c("cigar"), c("flag"))}
    clips = F.aggregate(F.filter(parse(c("cigar")), lambda x: x["op"] == "S"), F.lit(0).cast("long"), lambda a, x: a + x["len"])
    names["sclen"] = clips
    for k, n in enumerate(FLAG_NAMES):
        names[f"flag.{n.lower()}"] = c("flag").bitwiseAND(1 << k)
    return names, {k: "str" for k in ("qname", "rname", "mrname", "rnext", "seq", "qual", "cigar")}
