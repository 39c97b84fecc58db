"""Chat formatting: a small, sandboxed template language compiled to Python closures, applied to conversations.

Language: text, `{{ expression }}`, `{% for x in expression %} ... {% endfor %}`, `{% if e %} ... {% else %} ...
{% endif %}` and `{% generation %} ... {% endgeneration %}`, which marks what a model should learn. Expressions: string
and integer literals, names, `a.key` (keys of mappings only), `+ == != and or not`, parentheses, `| filter(args)`.
Templates reach nothing but the values they are given and FILTERS.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


class TemplateError(ValueError):
    pass


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any
    args: tuple


@dataclass(frozen=True)
class Emit:
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def escape(text: str, controls: str) -> str:
    """Backslashes are doubled, and the i-th character of controls becomes a backslash and the i-th letter."""
    out = text.replace("\\", "\\\\")
    for letter, c in zip("abcdefghijklmnopqrstuvwxyz", controls, strict=False):
        out = out.replace(c, "\\" + letter)
    return out


def unescape(text: str, controls: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else controls[ord(m[1]) - 97], text, flags=re.S)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": escape,
    "upper": lambda x: x.upper(),
    "lower": lambda x: x.lower(),
    "trim": lambda x: x.strip(),
    "default": lambda x, other: x or other,
    "length": len,
}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}

_LEXER = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|(),]))""", re.S)
_ESCAPED = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression; `or` binds least, filters most."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _LEXER.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (0, None)
        return None if kind == 1 else value

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> Any:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def level(self, n: int) -> Any:
        levels = (("or",), ("and",), ("==", "!="), ("+",))
        if n == len(levels):
            return self.unary()
        tree = self.level(n + 1)
        while op := self.take(*levels[n]):
            tree = Binary(op, tree, self.level(n + 1))
        return tree

    def unary(self) -> Any:
        if self.take("not"):
            return Not(self.unary())
        tree = self.atom()
        while op := self.take(".", "|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
            if kind != 3:
                raise TemplateError(f"a name has to follow {op!r}")
            self.at += 1
            if op == ".":
                tree = Key(tree, name)
                continue
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.level(0))
                    if self.peek() != ")":
                        self.need(",")
            tree = Filter(name, tree, tuple(args))
        return tree

    def atom(self) -> Any:
        if self.take("("):
            tree = self.level(0)
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(value))
        if kind == 3:
            return Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        body: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                body.append(Emit(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(body), word
                if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                    over = _Expression(m[2]).whole()
                    body.append(For(m[1], over, block("endfor")[0]))
                elif word == "if":
                    test = _Expression(rest).whole()
                    then, end = block("else", "endif")
                    body.append(If(test, then, block("endif")[0] if end == "else" else ()))
                elif word == "generation":
                    body.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"cannot read {part!r}")
            elif part:
                body.append(Emit(Const(part)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    return block()[0]


def fold(node: Any) -> Any:
    """The tree with all that is constant computed: operators, filters, tests; neighbouring constant text is joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if out and isinstance(y, Emit) and isinstance(out[-1], Emit) and isinstance(y.of, Const) and isinstance(out[-1].of, Const):
                    out[-1] = Emit(Const(str(out[-1].of.value) + str(y.of.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        both = isinstance(left, Const) and isinstance(right, Const)
        return Const(BINARY[node.op](left.value, right.value)) if both else Binary(node.op, left, right)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Filter):
        of, args = fold(node.of), tuple(map(fold, node.args))
        if all(isinstance(x, Const) for x in (of, *args)):
            return Const(FILTERS[node.name](of.value, *(x.value for x in args)))
        return Filter(node.name, of, args)
    if isinstance(node, Key):
        return Key(fold(node.of), node.key)
    if isinstance(node, Emit):
        return Emit(fold(node.of))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


class Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env[n]
    if isinstance(node, Key):
        return lambda env, of=_value(node.of), k=node.key: _member(of(env), k)
    if isinstance(node, Not):
        return lambda env, of=_value(node.of): not of(env)
    if isinstance(node, Binary):
        if node.op in ("and", "or"):
            a, b = _value(node.left), _value(node.right)
            return (lambda env: a(env) and b(env)) if node.op == "and" else (lambda env: a(env) or b(env))
        return lambda env, f=BINARY[node.op], a=_value(node.left), b=_value(node.right): f(a(env), b(env))
    return lambda env, f=FILTERS[node.name], of=_value(node.of), args=tuple(map(_value, node.args)): f(of(env), *(x(env) for x in args))


def _member(of: Any, key: str) -> Any:
    if not isinstance(of, dict):
        raise TemplateError(f".{key}: not a mapping")
    return of[key]


def _writer(nodes: tuple) -> Callable[[dict, Output], None]:
    steps = [_step(x) for x in nodes]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Any) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.of, Const):
            return lambda env, out, t=str(node.of.value): out.write(t)
        return lambda env, out, of=_value(node.of): out.write(str(of(env)))
    if isinstance(node, If):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, For):
        over, body, name = _value(node.over), _writer(node.body), node.name

        def loop(env: dict, out: Output) -> None:
            for x in over(env):
                body(env | {name: x}, out)

        return loop
    body = _writer(node.body)

    def generation(env: dict, out: Output) -> None:
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generation


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (text, spans under generation, in code points)."""
    write = _writer(fold(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


# --- conversations

#: Characters with which this template's control strings begin; inside roles and texts they are escaped.
CONTROLS = "#<:"
TEMPLATE = (
    '{% for m in messages %}### {{ m.role | escape("#<:") }}: {% if m.role == "assistant" %}{% generation %}'
    '{{ m.text | escape("#<:") }}{% endgeneration %}{% else %}{{ m.text | escape("#<:") }}{% endif %}</turn>\n{% endfor %}'
)
_TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, list[dict]]]:
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    for key, group in groupby(rows, key=lambda r: r[0]):
        yield key, [{"role": role or "", "text": text or ""} for _, role, text in group]


def format_conversations(rows: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id_col, n_turns, formatted, spans (start, end of what is under generation).

    Turns go by turn_col, nulls first, and then by role and text; repeated rows are turns of their own. Null roles and
    texts are empty; null ids make one conversation. Other columns are ignored; no rows give no rows. A partition
    streams through its conversations, so a task holds one at a time.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")]
    ordered = rows.select(*cols).repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    id_type = to_arrow_type(rows.schema[id_col].dataType)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def batch(done: list) -> pa.RecordBatch:
            ids, ns, texts, spans = zip(*done, strict=True)
            spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(ns, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span)], names=["id", "n_turns", "formatted", "spans"])

        done, size = [], 0
        for key, messages in _sorted_groups(batches):
            text, spans = render(messages)
            done.append((key, len(messages), text, spans))
            size += len(text)
            if size > 1 << 22:
                yield batch(done)
                done, size = [], 0
        if done:
            yield batch(done)

    return ordered.mapInArrow(run, f"id {kind}, n_turns long, formatted string, spans array<struct<start: long, end: long>>").withColumnRenamed("id", id_col)


def read_back(text: str, controls: str = CONTROLS) -> list[tuple[str, str]]:
    """(role, text) of the turns in a text that TEMPLATE gave."""
    turns, at = [], 0
    while at < len(text):
        if not (m := _TURN.match(text, at)):
            raise TemplateError(f"no turn at {at}")
        turns.append((unescape(m[1], controls), unescape(m[2], controls)))
        at = m.end()
    return turns


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted texts say, read back from them alone: digests of the turns and of what is under the mask."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]], CONTROLS) for s in spans)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learnt)]
                out.append((len(turns), hashed[0], len(learnt), hashed[1], len(text)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col(id_col).alias("id"), "formatted", "spans").mapInArrow(run, schema).withColumnRenamed("id", id_col)
