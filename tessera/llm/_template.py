"""A sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes a value, ``{# ... #}`` nothing, and ``{% ... %}`` holds for/else, if/elif/else, set and
generation, whose body is what a model is to learn. A hyphen inside a tag's edge strips white space beside it;
the line feed after a block tag and spaces before one that begins a line go, as chat templates expect.

Expressions have literals, names, ``a.b`` and ``a[b]`` of the given data, slices, arithmetic, ``~``, comparisons,
``in``, ``is`` tests, boolean operators, ``x if c else y``, filters and a few methods of strings. Nothing else can be
reached: names are those of the data, members are keys of dictionaries and items of lists, numbers alone are multiplied.

A text is cut into tokens, parsed into a syntax tree, constant parts of the tree are evaluated, and each node becomes a
closure. Closures of statements are generators of (text, learnt), so a long conversation never has to be one string.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


class TemplateError(ValueError):
    """A template that can't be parsed, or data that it can't render."""


class Undefined:
    """What a missing name or member is; it may be tested or replaced, but not written."""

    def __bool__(self) -> bool:
        return False


UNDEFINED = Undefined()


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator, test, filter or method of FUNCTIONS over arguments."""

    function: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Both:
    """and, or: the second is evaluated only where the first doesn't decide."""

    stop: bool
    left: Any
    right: Any


@dataclass(frozen=True)
class Items:
    values: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _member(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key, UNDEFINED)
    if isinstance(x, (list, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else UNDEFINED
    return UNDEFINED


def _slice(x: Any, first: Any, last: Any) -> Any:
    return x[first:last] if isinstance(x, (list, str)) else UNDEFINED


def _times(a: Any, b: Any) -> Any:
    if not all(isinstance(x, (int, float)) for x in (a, b)):
        raise TemplateError("only numbers are multiplied")
    return a * b


def shown(x: Any) -> str:
    if isinstance(x, str):
        return x
    if isinstance(x, Undefined):
        raise TemplateError("an undefined value is written")
    return {None: "none", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else json.dumps(x, ensure_ascii=False)


def _fail(message: Any) -> Any:
    raise TemplateError(shown(message))


_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def guard(text: str) -> str:
    """The text without control strings: ``<|`` becomes ``<\\|``, and what looks like that gets one backslash more."""
    return _OPEN.sub(r"<\1\\|", text) if "|" in text else text


def unguard(text: str) -> str:
    """What guard() was given."""
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text) if "|" in text else text


def guard_line(text: str) -> str:
    """guard() for a text that must stay on one line."""
    return guard(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(text))


FUNCTIONS: dict[str, Callable] = {
    **{k: f for k, f in (("+", operator.add), ("-", operator.sub), ("*", _times), ("/", operator.truediv), ("//", operator.floordiv), ("%", operator.mod))},
    **{k: f for k, f in (("==", operator.eq), ("!=", operator.ne), ("<", operator.lt), ("<=", operator.le), (">", operator.gt), (">=", operator.ge))},
    "~": lambda a, b: shown(a) + shown(b),
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "not": operator.not_,
    "neg": operator.neg,
    "member": _member,
    "slice": _slice,
    "is defined": lambda x: not isinstance(x, Undefined),
    "is none": lambda x: x is None,
    "is string": lambda x: isinstance(x, str),
    "is number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "is mapping": lambda x: isinstance(x, dict),
    "is iterable": lambda x: isinstance(x, (list, str, dict)),
    "|trim": lambda x: shown(x).strip(),
    "|upper": lambda x: shown(x).upper(),
    "|lower": lambda x: shown(x).lower(),
    "|length": len,
    "|first": lambda x: _member(x, 0),
    "|last": lambda x: _member(x, -1),
    "|join": lambda x, by="": shown(by).join(map(shown, x)),
    "|default": lambda x, other="": other if isinstance(x, Undefined) else x,
    "|replace": lambda x, old, new: shown(x).replace(old, new),
    "|tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "|string": shown,
    "|guard": lambda x: guard(shown(x)),
    "|guard_line": lambda x: guard_line(shown(x)),
    **{f".{m}": (lambda m: lambda x, *a: getattr(x, m)(*a) if isinstance(x, str) else _fail(f"{m} of what is no string"))(m) for m in ("strip", "lstrip", "rstrip", "upper", "lower", "startswith", "endswith", "split")},
    "raise_exception": _fail,
}
#: Functions with an effect, which aren't evaluated beforehand.
_LATE = {"raise_exception"}
_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_END = {"{{": re.compile(r"(-?)\}\}"), "{%": re.compile(r"(-?)%\}"), "{#": re.compile(r"(-?)#\}")}
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>//|==|!=|<=|>=|[-+*/%~<>()\[\].,:|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _expression_end(source: str, at: int, kind: str) -> re.Match:
    """The tag's end; strings inside may hold what looks like one."""
    while True:
        m = _END[kind].search(source, at)
        if m is None:
            raise TemplateError(f"line {source.count(chr(10), 0, at) + 1}: a tag isn't closed")
        inside = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "", source[at : m.start()])
        if kind == "{#" or not re.search("['\"]", inside):
            return m
        quote = re.search("['\"]", inside)[0]
        close = source.find(quote, m.end())
        if close < 0:
            return m
        m2 = _END[kind].search(source, close)
        if m2 is None:
            return m
        if not re.search("['\"]", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "", source[at : m2.start()])):
            return m2
        raise TemplateError(f"line {source.count(chr(10), 0, at) + 1}: a string isn't closed")


def pieces(source: str) -> Iterator[tuple[str, str, int]]:
    """(kind, content, line) of texts ("") and tags ("{{", "{%")."""
    at, strip, block = 0, False, False
    while at <= len(source):
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if strip:
            text = text.lstrip()
        elif block and text.startswith("\n"):
            text = text[1:]
        if m is None:
            if text:
                yield "", text, 0
            return
        kind = m[0][:2]
        if m[0].endswith("-"):
            text = text.rstrip()
        elif kind != "{{":
            bare = text.rstrip(" \t")
            text = bare if bare.endswith("\n") or not bare and (at == 0 or block) else text
        if text:
            yield "", text, 0
        end = _expression_end(source, m.end(), kind)
        if kind != "{#":
            yield kind, source[m.end() : end.start()], source.count("\n", 0, m.start()) + 1
        at, strip, block = end.end(), bool(end[1]), kind != "{{"


class _Expression:
    """A parser of one tag's tokens; each level of precedence is a method."""

    def __init__(self, text: str, line: int):
        self.line, self.tokens, at = line, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise TemplateError(f"line {line}: {text[at:at + 20]!r} isn't understood")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def fail(self) -> None:
        raise TemplateError(f"line {self.line}: unexpected {self.tokens[self.at][1] if self.at < len(self.tokens) else 'end of tag'!r}")

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail()

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            self.fail()
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        x = self.choice()
        self.done()
        return x

    def done(self) -> None:
        if self.at < len(self.tokens):
            self.fail()

    def choice(self) -> Any:
        x = self.either()
        while self.take("if"):
            test = self.either()
            x = Choice(test, x, self.choice() if self.take("else") else Const(""))
        return x

    def either(self) -> Any:
        x = self.all()
        while self.take("or"):
            x = Both(True, x, self.all())
        return x

    def all(self) -> Any:
        x = self.negated()
        while self.take("and"):
            x = Both(False, x, self.negated())
        return x

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        x = self.joined()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                x = Apply(op, (x, self.joined()))
            elif self.take("not"):
                self.need("in")
                x = Apply("not in", (x, self.joined()))
            elif self.take("is"):
                no, test = self.take("not"), self.name()
                found = Apply("not", (Apply("is defined", (x,)),)) if test == "undefined" else Apply(f"is {test}", (x,))
                if found.function not in FUNCTIONS:
                    raise TemplateError(f"line {self.line}: no test {test!r}")
                x = Apply("not", (found,)) if no else found
            else:
                return x

    def _left(self, level: Callable, *ops: str) -> Any:
        x = level()
        while op := self.take(*ops):
            x = Apply(op, (x, level()))
        return x

    def joined(self) -> Any:
        return self._left(self.sum, "~")

    def sum(self) -> Any:
        return self._left(self.product, "+", "-")

    def product(self) -> Any:
        return self._left(self.signed, "*", "/", "//", "%")

    def signed(self) -> Any:
        return Apply("neg", (self.signed(),)) if self.take("-") else self.postfix()

    def arguments(self) -> tuple:
        out = []
        if not self.take("("):
            return ()
        while not self.take(")"):
            if out:
                self.need(",")
            out.append(self.choice())
        return tuple(out)

    def postfix(self) -> Any:
        x = self.atom()
        while True:
            if self.take("."):
                key = self.name()
                called = self.at < len(self.tokens) and self.tokens[self.at] == ("op", "(")
                if called and f".{key}" not in FUNCTIONS:
                    raise TemplateError(f"line {self.line}: no method {key!r}")
                x = Apply(f".{key}", (x, *self.arguments())) if called else Apply("member", (x, Const(key)))
            elif self.take("["):
                first = Const(None) if self.take(":") else self.choice()
                if self.tokens[self.at - 1] == ("op", ":") or self.take(":"):
                    last = Const(None) if self.tokens[self.at : self.at + 1] == [("op", "]")] else self.choice()
                    x = Apply("slice", (x, first, last))
                else:
                    x = Apply("member", (x, first))
                self.need("]")
            elif self.take("|"):
                key = f"|{self.name()}"
                if key not in FUNCTIONS:
                    raise TemplateError(f"line {self.line}: no filter {key[1:]!r}")
                x = Apply(key, (x, *self.arguments()))
            else:
                return x

    def atom(self) -> Any:
        if self.take("("):
            x = self.choice()
            self.need(")")
            return x
        if self.take("["):
            out = []
            while not self.take("]"):
                if out:
                    self.need(",")
                out.append(self.choice())
            return Items(tuple(out))
        if self.at == len(self.tokens) or self.tokens[self.at][0] == "op":
            self.fail()
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        words = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
        if value in words:
            return Const(words[value])
        if value == "raise_exception":
            return Apply(value, self.arguments())
        return Name(value)


class _Statements:
    """The parser of a template's pieces into statements."""

    def __init__(self, source: str):
        self.left = list(pieces(source))
        self.left.reverse()

    def body(self, *ends: str) -> tuple[tuple, str, _Expression | None]:
        """(statements, the tag that ended them, what follows its first word)."""
        out: list = []
        while self.left:
            kind, content, line = self.left.pop()
            if not kind:
                out.append(Text(content))
                continue
            e = _Expression(content, line)
            if kind == "{{":
                out.append(Write(e.whole()))
                continue
            word = e.name()
            if word in ends:
                return tuple(out), word, e
            out.append(self.statement(word, e))
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(out), "", None

    def statement(self, word: str, e: _Expression) -> Any:
        if word == "set":
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "generation":
            e.done()
            return Generation(self.body("endgeneration")[0])
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.whole()
            body, end, _ = self.body("else", "endfor")
            return For(name, over, body, self.body("endfor")[0] if end == "else" else ())
        if word == "if":
            return self.condition(e)
        e.at -= 1
        e.fail()

    def condition(self, e: _Expression) -> If:
        test = e.whole()
        yes, end, more = self.body("elif", "else", "endif")
        no = (self.condition(more),) if end == "elif" else self.body("endif")[0] if end == "else" else ()
        return If(test, yes, no)


def parse(source: str) -> tuple:
    return _Statements(source).body()[0]


def _plain(x: Any) -> bool:
    return isinstance(x, Const)


def fold(x: Any) -> Any:
    """The tree with its constant parts evaluated: constant expressions, branches that are never taken, texts side by side."""
    if isinstance(x, tuple):
        out: list = []
        for y in map(fold, x):
            for z in y if isinstance(y, tuple) else (y,):
                if isinstance(z, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + z.text)
                elif not (isinstance(z, Text) and not z.text):
                    out.append(z)
        return tuple(out)
    if isinstance(x, Apply):
        args = tuple(map(fold, x.args))
        if all(map(_plain, args)) and x.function not in _LATE:
            try:
                return Const(FUNCTIONS[x.function](*(a.value for a in args)))
            except Exception:  # noqa: BLE001 - an error belongs to the rendering that reaches it
                return Apply(x.function, args)
        return Apply(x.function, args)
    if isinstance(x, Items):
        values = tuple(map(fold, x.values))
        return Const([v.value for v in values]) if all(map(_plain, values)) else Items(values)
    if isinstance(x, (Choice, If)):
        test = fold(x.test)
        if _plain(test):
            return fold(x.yes if test.value else x.no)
        return replace(x, test=test, yes=fold(x.yes), no=fold(x.no))
    if isinstance(x, Both):
        left = fold(x.left)
        if _plain(left):
            return left if bool(left.value) is x.stop else fold(x.right)
        return Both(x.stop, left, fold(x.right))
    if isinstance(x, Write):
        value = fold(x.value)
        return Text(shown(value.value)) if _plain(value) and not isinstance(value.value, Undefined) else Write(value)
    if isinstance(x, For):
        over = fold(x.over)
        if _plain(over) and not over.value:
            return fold(x.otherwise)
        return For(x.name, over, fold(x.body), fold(x.otherwise))
    if isinstance(x, Set):
        return Set(x.name, fold(x.value))
    if isinstance(x, Generation):
        return Generation(fold(x.body))
    return x


def _nodes(x: Any) -> Iterator[Any]:
    if isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)
    elif hasattr(x, "__dataclass_fields__"):
        yield x
        for f in fields(x):
            yield from _nodes(getattr(x, f.name))


def _value(x: Any) -> Callable[[dict], Any]:
    """The closure of an expression."""
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        return lambda env, n=x.name: env.get(n, UNDEFINED)
    if isinstance(x, Items):
        values = [_value(v) for v in x.values]
        return lambda env: [v(env) for v in values]
    if isinstance(x, Choice):
        test, yes, no = _value(x.test), _value(x.yes), _value(x.no)
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(x, Both):
        left, right, stop = _value(x.left), _value(x.right), x.stop

        def both(env: dict) -> Any:
            a = left(env)
            return a if bool(a) is stop else right(env)

        return both
    f, args = FUNCTIONS[x.function], [_value(a) for a in x.args]

    def applied(env: dict) -> Any:
        try:
            return f(*(a(env) for a in args))
        except TemplateError:
            raise
        except Exception as e:  # noqa: BLE001
            raise TemplateError(f"{x.function.lstrip('|.')}: {e}") from e

    return applied


def _with_last(values: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(values)
    for x in it:
        for y in it:
            yield x, False
            x = y
        yield x, True


Chunks = Iterator[tuple[str, bool]]


def _body(nodes: tuple) -> Callable[[dict], Chunks]:
    """The closure of statements."""
    steps = [_step(x) for x in nodes]

    def run(env: dict) -> Chunks:
        for s in steps:
            yield from s(env)

    return steps[0] if len(steps) == 1 else run


def _step(x: Any) -> Callable[[dict], Chunks]:
    if isinstance(x, Text):
        return lambda env, chunk=(x.text, False): iter((chunk,))
    if isinstance(x, Write):
        value = _value(x.value)
        return lambda env: iter(((shown(value(env)), False),))
    if isinstance(x, Set):
        name, value = x.name, _value(x.value)

        def put(env: dict) -> Chunks:
            env[name] = value(env)
            return iter(())

        return put
    if isinstance(x, Generation):
        body = _body(x.body)
        return lambda env: ((text, True) for text, _ in body(env))
    if isinstance(x, If):
        test, yes, no = _value(x.test), _body(x.yes), _body(x.no)
        return lambda env: yes(env) if test(env) else no(env)
    over, body, otherwise, name = _value(x.over), _body(x.body), _body(x.otherwise), x.name

    def loop(env: dict) -> Chunks:
        values = over(env)
        if isinstance(values, (Undefined, str)) or not isinstance(values, Iterable):
            raise TemplateError("for needs a list")
        size = len(values) if isinstance(values, list) else UNDEFINED
        inner, n = dict(env), 0
        for item, last in _with_last(values):
            inner[name] = item
            inner["loop"] = {"index0": n, "index": n + 1, "first": n == 0, "last": last, "length": size}
            n += 1
            yield from body(inner)
        if not n:
            yield from otherwise(env)

    return loop


class Template:
    """A compiled template. ``streams`` tells whether it passes through ``messages`` once, from first to last."""

    def __init__(self, source: str, names: tuple[str, ...] = ("messages",)):
        self.tree = fold(parse(source))
        given = {*names, "loop", *(x.name for x in _nodes(self.tree) if isinstance(x, (For, Set)))}
        for x in _nodes(self.tree):
            if isinstance(x, Name) and x.name not in given:
                raise TemplateError(f"no variable {x.name!r}")
            if isinstance(x, Apply) and x.function not in FUNCTIONS:
                raise TemplateError(f"no function {x.function!r}")
        loops = [x for x in self.tree if isinstance(x, For) and x.over == Name("messages")]
        uses = sum(isinstance(x, Name) and x.name == "messages" for x in _nodes(self.tree))
        length = any(isinstance(x, Apply) and x.args[-1:] == (Const("length"),) and x.args[0] == Name("loop") for x in _nodes(self.tree))
        bound = any(isinstance(x, (For, Set)) and x.name == "messages" for x in _nodes(self.tree))
        self.streams = uses == len(loops) <= 1 and not length and not bound
        self.run = _body(self.tree)

    def chunks(self, messages: Iterable[dict], **variables: Any) -> Chunks:
        """(text, whether it is to be learnt), one after the other; messages may be an iterator if the template streams."""
        return self.run(variables | {"messages": messages if self.streams else list(messages)})

    def render(self, messages: Iterable[dict], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans to learn, one for each written value."""
        out, spans, at = [], [], 0
        for text, learnt in self.chunks(messages, **variables):
            if learnt and text:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


__all__ = ["Template", "TemplateError", "fold", "guard", "guard_line", "parse", "unguard", "unguard_line"]
