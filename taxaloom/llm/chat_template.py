"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %} / {% elif %} / {% else %}``,
``{% set name = expression %}`` and ``{% generation %} ... {% endgeneration %}`` around what a model should learn.
Expressions know literals, names, fields (``m.role`` or ``m['role']``), ``+`` and ``~``, comparisons, ``and``, ``or``,
``not``, ``in``, the filters ``trim``, ``upper``, ``lower``, ``length``, ``escape``, and ``loop.index0``, ``loop.first``,
``loop.last``. There are no calls, no attributes of Python objects and no way to reach one: fields are looked up in
dictionaries only.

Compilation parses into a syntax tree, folds what is constant (expressions of literals, branches that can
never or always be taken, neighbouring text) and turns each node into a closure. A closure yields pieces with a
flag for "inside a generation block", so a conversation renders turn by turn and is never held whole.

Control strings inside a text are escaped: ``\\`` becomes ``\\\\`` and the first character of a control string is put
behind a ``\\``, so no control string can stand in a text, and ``unescape`` restores it.

Conversations are rows sorted by conv_id and turn within a partition; rows stream and results are running
digests, so a conversation of any length takes bounded memory. It is one task's work, since a digest over turns
in order cannot be divided.

Cases: NULL text or role is empty; ties of turn order by role, then text; repeated rows each are a turn; a NULL
turn comes first; NULL conv_id is a conversation of its own; other columns are ignored; an empty table gives
only what the query adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the default template.
TURN_OPEN, TURN_CLOSE, HEAD_END, END = "<|turn|>", "<|/turn|>", "<|text|>", "</s>"
CONTROL = (TURN_OPEN, TURN_CLOSE, HEAD_END, END, "[INST]", "[/INST]")
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|/turn|>"
    "{% if loop.last %}</s>{% endif %}"
    "{% endfor %}"
)

_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0] if m[0] == "\\" else "\\" + m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: x.strip(),
    "upper": lambda x: x.upper(),
    "lower": lambda x: x.lower(),
    "length": len,
    "escape": escape,
}

TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<sign>==|!=|<=|>=|[-+~<>|.\[\]()]))"
)
COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
WORDS = {"true": True, "false": False, "none": None}
KEYWORDS = {"and", "or", "not", "in"}


class TemplateError(ValueError):
    pass


# ---- expressions: trees of tuples ("const", value), ("name", n), ("field", e, key), ("op", f, e...), ("and"|"or", a, b)


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*found, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def accept(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"{value} expected, {self.tokens[self.at][1]!r} found")

    def whole(self) -> tuple:
        tree = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.accept("or"):
            tree = _fold(("or", tree, self.both()))
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.accept("and"):
            tree = _fold(("and", tree, self.negated()))
        return tree

    def negated(self) -> tuple:
        if self.accept("not"):
            return _fold(("op", lambda a: not a, self.negated()))
        return self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while sign := self.accept(*COMPARE):
            tree = _fold(("op", COMPARE[sign], tree, self.joined()))
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while sign := self.accept("+", "~", "-"):
            join = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: f"{a}{b}"}[sign]
            tree = _fold(("op", join, tree, self.filtered()))
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.accept("|"):
            name = self.tokens[self.at][1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = _fold(("op", FILTERS[name], tree))
        return tree

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            tree = ("const", unescape(value[1:-1]))
        elif kind == "number":
            tree = ("const", int(value))
        elif kind == "name" and value not in KEYWORDS:
            tree = ("const", WORDS[value]) if value in WORDS else ("name", value)
        elif value == "(":
            tree = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while sign := self.accept(".", "["):
            kind, key = self.tokens[self.at]
            if kind != ("name" if sign == "." else "text"):
                raise TemplateError("a field is a name or a quoted name")
            self.at += 1
            tree = ("field", tree, key if sign == "." else unescape(key[1:-1]))
            if sign == "[":
                self.need("]")
        return tree


def _fold(tree: tuple) -> tuple:
    """A constant where all parts are."""
    kind, *parts = tree
    if kind == "op" and all(p[0] == "const" for p in parts[1:]):
        return ("const", parts[0](*(p[1] for p in parts[1:])))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return tree


def _closure(tree: tuple) -> Callable[[dict], object]:
    kind, *parts = tree
    if kind == "const":
        value = parts[0]
        return lambda scope: value
    if kind == "name":
        name = parts[0]

        def look(scope: dict) -> object:
            if name not in scope:
                raise TemplateError(f"no name {name!r}")
            return scope[name]

        return look
    if kind == "field":
        of, key = _closure(parts[0]), parts[1]

        def field(scope: dict) -> object:
            held = of(scope)
            if not isinstance(held, dict) or key not in held:
                raise TemplateError(f"no field {key!r}")
            return held[key]

        return field
    if kind == "op":
        f, *args = parts[0], *map(_closure, parts[1:])
        return lambda scope: f(*[a(scope) for a in args])
    a, b = map(_closure, parts)
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


# ---- statements: ("text", s), ("show", e), ("set", name, e), ("if", [(e, body)...]), ("for", name, e, body), ("learn", body)

PIECES = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)


def parse(source: str) -> list[tuple]:
    """The folded syntax tree of a template."""
    body: list[tuple] = []
    stack: list[tuple[str, list, object]] = []  # keyword, the body around it, what it has so far
    at = 0
    for m in PIECES.finditer(source):
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("show", _Expression(m[1]).whole()))
            continue
        if m[2] is None:
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            name, _, over = rest.partition(" in ")
            stack.append(("for", body, (name.strip(), _Expression(over).whole())))
            body = []
        elif word == "if":
            stack.append(("if", body, [[_Expression(rest).whole(), None]]))
            body = []
        elif word in ("elif", "else") and stack and stack[-1][0] == "if":
            stack[-1][2][-1][1] = body
            stack[-1][2].append([_Expression(rest).whole() if word == "elif" else ("const", True), None])
            body = []
        elif word == "set":
            name, _, value = rest.partition("=")
            body.append(("set", name.strip(), _Expression(value).whole()))
        elif word == "generation":
            stack.append(("generation", body, None))
            body = []
        elif word.startswith("end") and stack and stack[-1][0] == word[3:]:
            kind, around, held = stack.pop()
            if kind == "for":
                around.append(("for", *held, _merged(body)))
            elif kind == "if":
                held[-1][1] = body
                around.extend(_branches([(test, _merged(inner)) for test, inner in held]))
            else:
                around.append(("learn", _merged(body)))
            body = around
        else:
            raise TemplateError(f"unexpected {word!r}")
    if stack:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return _merged([*body, ("text", source[at:])])


def _branches(branches: list[tuple]) -> list[tuple]:
    """Branches up to the first that is always taken, without those never taken."""
    kept = []
    for test, body in branches:
        if test[0] == "const" and not test[1]:
            continue
        if test[0] == "const" and not kept:
            return body
        kept.append((test, body))
        if test[0] == "const":
            break
    return [("if", kept)] if kept else []


def _merged(body: list[tuple]) -> list[tuple]:
    """Constants shown as text, and neighbouring text as one."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "show" and node[1][0] == "const":
            node = ("text", str(node[1][1]))
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)
    return out


Pieces = Iterator[tuple[str, bool]]


def _block(body: list[tuple], learn: bool) -> Callable[[dict], Pieces]:
    steps = [_step(node, learn) for node in body]

    def run(scope: dict) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, learn: bool) -> Callable[[dict], Pieces]:
    kind, *parts = node
    if kind == "text":
        piece = (parts[0], learn)
        return lambda scope: iter((piece,))
    if kind == "show":
        value = _closure(parts[0])
        return lambda scope: iter(((str(value(scope)), learn),))
    if kind == "set":
        name, value = parts[0], _closure(parts[1])

        def assign(scope: dict) -> Pieces:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "learn":
        return _block(parts[0], True)
    if kind == "if":
        tests = [(_closure(test), _block(body, learn)) for test, body in parts[0]]

        def choose(scope: dict) -> Pieces:
            for test, body in tests:
                if test(scope):
                    return body(scope)
            return iter(())

        return choose
    name, over, body = parts[0], _closure(parts[1]), _block(parts[2], learn)

    def loop(scope: dict) -> Pieces:
        items = iter(over(scope))
        item, index = next(items, loop), 0  # `loop` itself marks the end
        while item is not loop:
            following = next(items, loop)
            inner = scope | {name: item, "loop": {"index0": index, "first": index == 0, "last": following is loop}}
            yield from body(inner)
            item, index = following, index + 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from messages to pieces of text, each with whether it is to be learnt."""
    block = _block(parse(source), False)
    return lambda messages: block({"messages": messages})


# ---- reading back the default format

_MARKS = re.compile(r"\\.|<\|turn\|>|<\|/turn\|>|<\|text\|>|</s>", re.S)


def parse_turn(output: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    marks = {m[0]: m for m in _MARKS.finditer(output) if m[0][0] != "\\"}
    role = output[marks[TURN_OPEN].end() : marks[HEAD_END].start()]
    return unescape(role), unescape(output[marks[HEAD_END].end() : marks[TURN_CLOSE].start()])


def turns_of(pieces: Pieces) -> Iterator[tuple[str, str, int, int, bool]]:
    """Rendered turns as (text, learnt part, code points, where the learnt part starts, whether it is a turn).

    A turn ends where its close mark stands; what follows the last one is no turn. What is learnt of a turn is one stretch.
    """
    held, learnt, size, at = [], [], 0, 0
    for text, learn in pieces:
        if learn:
            if not learnt:
                at = size
            learnt.append(text)
        size += len(text)
        held.append(text)
        if not learn and len(held) > 1 and text.startswith((TURN_CLOSE, TURN_CLOSE + END)):
            yield "".join(held), "".join(learnt), size, at, True
            held, learnt, size, at = [], [], 0, 0
    if size:
        yield "".join(held), "".join(learnt), size, at, False


SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
ROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def digest(conv_id: int | None, pieces: Pieces) -> tuple:
    """A conversation read back from its rendered pieces."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = formatted = 0
    for output, learnt, size, _, is_turn in turns_of(pieces):
        formatted += size
        if is_turn:
            role, text = parse_turn(output)
            turns.update(f"{role}\n{text}\n".encode())
            n += 1
        plain = unescape(learnt)
        loss_chars += len(plain)
        loss.update(plain.encode())
    return conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted


def rendered(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, pos, formatted, and the code points [learn_from, learn_to) a model learns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv_id, messages in _conversations(batches):
            last: list | None = None  # the turn before, which what follows the last turn belongs to
            for output, learnt, _, start, is_turn in turns_of(render(messages)):
                if not is_turn and last is not None:
                    last[2] += output
                    continue
                if last is not None:
                    yield row(last)
                last = [conv_id, 0 if last is None else last[1] + 1, output, start, start + len(learnt)]
            if last is not None:
                yield row(last)

    def row(values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, values)}, schema=shape)

    names = ["conv_id", "pos", "formatted", "learn_from", "learn_to"]
    shape = pa.schema(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]))
    return _sorted(conversations).mapInArrow(
        run, "conv_id long, pos long, formatted string, learn_from long, learn_to long"
    )


def digests(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(template), []
        for conv_id, messages in _conversations(batches):
            rows.append(digest(conv_id, render(messages)))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)

    return _sorted(conversations).mapInArrow(run, SCHEMA)


def _sorted(conversations: DataFrame) -> DataFrame:
    kept = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation with its messages, as rows arrive."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text")))

    for conv_id, group in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, ({"role": role, "text": text} for _, role, text in group)
