"""A sandboxed template language: text with {{ expressions }} and {% statements %}, compiled to Python closures.

    {{ turn.text | escape }}   {% if turn.role == "user" %} .. {% elif .. %} .. {% else %} .. {% endif %}
    {% for turn in turns %} .. {% endfor %}   {% set name = .. %}   {% generation %} .. {% endgeneration %}   {# comment #}

Expressions have strings, integers, true, false, none, names, .fields of dictionaries, [ ], + ~ == != < > <= >= in, not,
and, or, a if b else c, and filters after |. Names give only what the caller passes, fields only items of dictionaries,
filters only functions of the compiler: there is no way from a template to Python's attributes or calls. `loop` has
index, index0, first and last. What a generation block renders is told as a span of the output.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from typing import Any

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,()\[\]=]))""", re.S)
TAG = re.compile(r"\{#.*?#\}|\{\{.*?\}\}|\{%.*?%\}", re.S)
# Escapes in strings.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class TemplateError(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Expressions as tuples: (kind, parts...)."""

    def __init__(self, source: str):
        self.rest = tokens(source)[::-1]

    def peek(self, *values: str) -> bool:
        return self.rest[-1][0] in ("op", "name") and self.rest[-1][1] in values

    def take(self, *values: str) -> str:
        kind, value = self.rest.pop()
        if values and value not in values:
            raise TemplateError(f"expected {' or '.join(values)}, not {value!r}")
        return value

    def done(self, tree: tuple) -> tuple:
        if self.rest[-1][0] != "end":
            raise TemplateError(f"{self.rest[-1][1]!r} is too much")
        return tree

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            self.take("else")
            tree = ("if", test, tree, self.whole())
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.peek("and"):
            self.take()
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        tree = self.sum()
        if self.peek(*COMPARE, "in"):
            return ("compare", self.take(), tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.piped()
        while self.peek("+", "~", "-"):
            tree = ("sum", self.take(), tree, self.piped())
        return tree

    def piped(self) -> tuple:
        tree = self.path()
        while self.peek("|"):
            self.take()
            tree = ("filter", self.take(), tree)
        return tree

    def path(self) -> tuple:
        kind, value = self.rest.pop()
        if kind == "num":
            tree: tuple = ("value", int(value))
        elif kind == "str":
            tree = ("value", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif value == "(":
            tree = self.whole()
            self.take(")")
        elif kind == "name" and value in ("true", "false", "none"):
            tree = ("value", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            tree = ("name", value)
        else:
            raise TemplateError(f"expected a value, not {value!r}")
        while self.peek(".", "["):
            if self.take() == ".":
                tree = ("item", tree, ("value", self.take()))
            else:
                tree = ("item", tree, self.whole())
                self.take("]")
        return tree


def parse(source: str) -> list[tuple]:
    """The template as a list of nodes: (text, s), (put, e), (if, [(e or None, nodes)]), (for, name, e, nodes), (set, name, e), (generation, nodes)."""
    root: list[tuple] = []
    open_: list[tuple[str, list[tuple], Any]] = [("", root, None)]
    at = 0
    for m in [*TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if text:
            open_[-1][1].append(("text", text))
        if m is None:
            break
        at = m.end()
        body = m[0][2:-2].strip()
        if m[0][1] == "#":
            continue
        if m[0][1] == "{":
            p = Parser(body)
            open_[-1][1].append(("put", p.done(p.whole())))
            continue
        word, _, rest = body.partition(" ")
        here = open_[-1][1]
        if word == "if":
            p = Parser(rest)
            arms = [(p.done(p.whole()), [])]
            here.append(("if", arms))
            open_.append(("if", arms[0][1], arms))
        elif word in ("elif", "else"):
            if open_[-1][0] != "if":
                raise TemplateError(f"{word} outside if")
            arms = open_.pop()[2]
            p = Parser(rest) if word == "elif" else None
            arms.append((p.done(p.whole()) if p else None, []))
            open_.append(("if", arms[-1][1], arms))
        elif word == "for":
            p = Parser(rest)
            name = p.take()
            p.take("in")
            body_nodes: list[tuple] = []
            here.append(("for", name, p.done(p.whole()), body_nodes))
            open_.append(("for", body_nodes, None))
        elif word == "set":
            p = Parser(rest)
            name = p.take()
            p.take("=")
            here.append(("set", name, p.done(p.whole())))
        elif word == "generation":
            inner: list[tuple] = []
            here.append(("generation", inner))
            open_.append(("generation", inner, None))
        elif word in ("endif", "endfor", "endgeneration"):
            if open_.pop()[0] != word[3:]:
                raise TemplateError(f"{word} has no beginning")
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not closed")
    return root


def fold(tree: tuple, filters: dict[str, Callable]) -> tuple:
    """Expressions of constants become their value."""
    if tree[0] in ("value", "name"):
        return tree
    parts = [fold(x, filters) if isinstance(x, tuple) else x for x in tree[1:]]
    tree = (tree[0], *parts)
    if all(x[0] == "value" for x in parts if isinstance(x, tuple)) and tree[0] != "item":
        return ("value", expression(tree, filters)({}))
    if tree[0] == "if" and parts[0][0] == "value":
        return parts[1] if parts[0][1] else parts[2]
    return tree


def fold_nodes(nodes: list[tuple], filters: dict[str, Callable]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "put":
            tree = fold(node[1], filters)
            node = ("text", show(tree[1])) if tree[0] == "value" else ("put", tree)
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold(test, filters) if test else None
                if test and test[0] == "value":
                    if not test[1]:
                        continue
                    test = None
                arms.append((test, fold_nodes(body, filters)))
                if test is None:
                    break
            if not arms:
                continue
            if arms[0][0] is None:
                for inner in arms[0][1]:
                    out.append(inner)
                continue
            node = ("if", arms)
        elif kind == "for":
            node = ("for", node[1], fold(node[2], filters), fold_nodes(node[3], filters))
        elif kind == "set":
            node = ("set", node[1], fold(node[2], filters))
        elif kind == "generation":
            node = ("generation", fold_nodes(node[1], filters))
        if node[0] == "text" and out and out[-1][0] == "text":
            node = ("text", out.pop()[1] + node[1])
        if node != ("text", ""):
            out.append(node)
    return out


def show(value: Any) -> str:
    return "" if value is None else str(value)


def get(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def expression(tree: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "value":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        return lambda env, f=filters[tree[1]], a=expression(tree[2], filters): f(a(env))
    a, b = (expression(x, filters) for x in (tree[1:3] if isinstance(tree[1], tuple) else tree[2:4])) if len(tree) > 2 else (expression(tree[1], filters), None)
    if kind == "item":
        return lambda env: get(a(env), b(env))
    if kind == "not":
        return lambda env: not a(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "if":
        c = expression(tree[3], filters)
        return lambda env: b(env) if a(env) else c(env)
    if kind == "sum":
        if tree[1] == "~":
            return lambda env: show(a(env)) + show(b(env))
        return (lambda env: a(env) + b(env)) if tree[1] == "+" else (lambda env: a(env) - b(env))
    if tree[1] == "in":
        return lambda env: a(env) in (b(env) or ())
    return lambda env, f=COMPARE[tree[1]]: f(a(env), b(env))


def closure(nodes: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, Callable[[str], None], Callable[[bool], None]], None]:
    """A function of (names, write, mark); mark is called with True and False around what a generation block writes."""
    steps = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda env, write, mark, s=node[1]: write(s))
        elif kind == "put":
            steps.append(lambda env, write, mark, e=expression(node[1], filters): write(show(e(env))))
        elif kind == "set":

            def put(env, write, mark, n=node[1], e=expression(node[2], filters)):
                env[n] = e(env)

            steps.append(put)
        elif kind == "generation":

            def generate(env, write, mark, body=closure(node[1], filters)):
                mark(True)
                body(env, write, mark)
                mark(False)

            steps.append(generate)
        elif kind == "if":
            arms = [(expression(test, filters) if test else None, closure(body, filters)) for test, body in node[1]]

            def choose(env, write, mark, arms=arms):
                for test, body in arms:
                    if test is None or test(env):
                        body(env, write, mark)
                        return

            steps.append(choose)
        else:

            def repeat(env, write, mark, n=node[1], e=expression(node[2], filters), body=closure(node[3], filters)):
                outer = {k: env[k] for k in (n, "loop") if k in env}
                items = list(e(env) or ())
                for i, x in enumerate(items):
                    env[n] = x
                    env["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
                    body(env, write, mark)
                for k in (n, "loop"):
                    env.pop(k, None)
                env.update(outer)

            steps.append(repeat)

    def run(env, write, mark):
        for step in steps:
            step(env, write, mark)

    return run


class Template:
    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.nodes = fold_nodes(parse(source), filters or {})
        self.run = closure(self.nodes, filters or {})

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it that generation blocks made (without empty ones)."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        length, start = 0, 0

        def write(s: str) -> None:
            nonlocal length
            parts.append(s)
            length += len(s)

        def mark(begins: bool) -> None:
            nonlocal start
            if begins:
                start = length
            elif length > start:
                spans.append((start, length))

        self.run(dict(names), write, mark)
        return "".join(parts), spans
