"""XPath over pages that are no well-formed XML: expressions compiled to closures over node sets in document order.

Beside XPath 1.0 (axes, predicates with positions, unions, arithmetic, its string, number and set functions) there
are the steps allText(), html(), outerHtml() and num(), the axes following-sibling-one and preceding-sibling-one,
the comparisons ^= $= *= ~= and !~ of strings, and substring-before-last, substring-after-last, first. An attribute
that is empty counts as missing. A visit budget ends expressions that would look at a page's nodes quadratically.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from .markup import TEXT, Node, squeeze

MOST_VISITS = 2_000_000

Value = list | str | float | bool
#: (node, position, size, visits left): what an expression is evaluated for.
Expr = Callable[[Node, int, int, list], Value]

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|('[^']*'|\"[^\"]*\")|([A-Za-z_][\w-]*)|(//|::|\.\.|!=|<=|>=|\^=|\$=|\*=|~=|!~|[/.@\[\](),|+\-*=<>]))")
_AXES = frozenset("ancestor ancestor-or-self child descendant descendant-or-self following following-sibling following-sibling-one parent preceding preceding-sibling preceding-sibling-one self attribute".split())
_TAKEN = {"allText": lambda n: squeeze(n.text()), "html": Node.html, "outerHtml": Node.outer, "num": lambda n: (re.findall(r"\d*\.?\d+", n.text()) or [""])[0]}


class XPathError(ValueError):
    """An expression that can't be compiled, or a page on which it costs too much."""


def _axis(name: str, n: Node) -> list[Node]:
    """Nodes on an axis, nearest first."""
    def up() -> list[Node]:
        out, p = [], n.parent
        while p is not None and p.parent is not None:
            out.append(p)
            p = p.parent
        return out

    tree = n.tree
    if n.tag[:1] == "@":
        return {"parent": [n.parent], "self": [n]}.get(name, [n.parent, *_axis("ancestor", n.parent)] if name.startswith("ancestor") else [])
    if name == "child":
        return n.children
    if name in ("descendant", "descendant-or-self"):
        return tree[n.order + (name == "descendant") : n.end]
    if name == "self":
        return [n]
    if name == "parent":
        return [n.parent] if n.parent is not None else []
    if name in ("ancestor", "ancestor-or-self"):
        return up() if name == "ancestor" else [n, *up()]
    if name == "following":
        return tree[n.end :]
    if name == "preceding":
        return [x for x in reversed(tree[1 : n.order]) if x.end <= n.order]
    kin = n.parent.children if n.parent else [n]
    at = next(i for i, x in enumerate(kin) if x is n)
    side = kin[at + 1 :] if name.startswith("following") else kin[:at][::-1]
    return [x for x in side if x.tag != TEXT][:1] if name.endswith("-one") else side


def _string(v: Value) -> str:
    if isinstance(v, list):
        return v[0].text() if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v) if math.isfinite(v) else ("Infinity" if v > 0 else "-Infinity")
    return v


def _number(v: Value) -> float:
    if isinstance(v, bool | float):
        return float(v)
    try:
        return float(_string(v).strip())
    except ValueError:
        return math.nan


def _true(v: Value) -> bool:
    return bool(v) and not (isinstance(v, float) and math.isnan(v))


def _compare(op: str, a: Value, b: Value) -> bool:
    """Of node sets, whether any nodes compare so."""
    if isinstance(a, list) and not isinstance(b, bool):
        return any(_compare(op, n.text(), b) for n in a)
    if isinstance(b, list) and not isinstance(a, bool):
        return any(_compare(op, a, n.text()) for n in b)
    if op in ("^=", "$=", "*=", "~=", "!~"):
        x, y = _string(a), _string(b)
        return {"^=": x.startswith, "$=": x.endswith, "*=": x.__contains__, "~=": lambda p: re.search(p, x) is not None, "!~": lambda p: re.search(p, x) is None}[op](y)
    if op in ("=", "!="):
        kind = _true if isinstance(a, bool) or isinstance(b, bool) else _number if isinstance(a, float) or isinstance(b, float) else _string
        return (kind(a) == kind(b)) == (op == "=")
    x, y = _number(a), _number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _substring(s: str, start: float, length: float = math.inf) -> str:
    if math.isnan(start) or math.isnan(length):
        return ""
    begin = math.floor(start + 0.5)
    end = begin + (length if math.isinf(length) else math.floor(length + 0.5))
    return s[int(max(begin, 1)) - 1 : None if math.isinf(end) else int(max(end, 1)) - 1]


#: Functions of evaluated arguments; their least and most number.
_FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "count": (1, 1, lambda v: float(len(v))),
    "concat": (2, 99, lambda *v: "".join(map(_string, v))),
    "contains": (2, 2, lambda a, b: _string(b) in _string(a)),
    "starts-with": (2, 2, lambda a, b: _string(a).startswith(_string(b))),
    "ends-with": (2, 2, lambda a, b: _string(a).endswith(_string(b))),
    "substring": (2, 3, lambda s, *n: _substring(_string(s), *map(_number, n))),
    "substring-before": (2, 2, lambda a, b: _string(a).partition(_string(b))[0] if _string(b) in _string(a) else ""),
    "substring-after": (2, 2, lambda a, b: _string(a).partition(_string(b))[2]),
    "substring-before-last": (2, 2, lambda a, b: _string(a).rpartition(_string(b))[0]),
    "substring-after-last": (2, 2, lambda a, b: _string(a).rpartition(_string(b))[2] if _string(b) in _string(a) else ""),
    "string-length": (1, 1, lambda v: float(len(_string(v)))),
    "normalize-space": (1, 1, lambda v: squeeze(_string(v))),
    "string": (1, 1, _string),
    "number": (1, 1, _number),
    "boolean": (1, 1, _true),
    "not": (1, 1, lambda v: not _true(v)),
    "sum": (1, 1, lambda v: float(sum(_number(n.text()) for n in v))),
    "floor": (1, 1, lambda v: float(math.floor(_number(v)))),
    "ceiling": (1, 1, lambda v: float(math.ceil(_number(v)))),
    "round": (1, 1, lambda v: float(math.floor(_number(v) + 0.5))),
    "true": (0, 0, lambda: True),
    "false": (0, 0, lambda: False),
}
_PLACES = {"position": lambda n, i, k, b: float(i), "last": lambda n, i, k, b: float(k), "first": lambda n, i, k, b: i == 1}


def _in_order(nodes: list[Node]) -> list[Node]:
    seen: dict[int, Node] = {}
    for n in nodes:
        seen.setdefault(id(n), n)
    return sorted(seen.values(), key=lambda n: (n.order, n.tag[:1] == "@"))


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if m is None:
                raise XPathError(f"not an XPath: {text}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((("number", "string", "name", "sign")[kind - 1], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        """The next sign or name; strings and numbers are never taken for one."""
        i = self.at + ahead
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] in ("sign", "name") else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens) or want is not None and self.tokens[self.at][1] != want:
            raise XPathError(f"not an XPath: {self.text}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    #: Operators, loosest first.
    LEVELS = (("or",), ("and",), ("=", "!=", "^=", "$=", "*=", "~=", "!~"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def expr(self, level: int = 0) -> Expr:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.expr(level + 1)
        while self.peek() in self.LEVELS[level]:
            left = self._binary(self.take(), left, self.expr(level + 1))
        return left

    @staticmethod
    def _binary(op: str, a: Expr, b: Expr) -> Expr:
        if op == "or":
            return lambda *c: _true(a(*c)) or _true(b(*c))
        if op == "and":
            return lambda *c: _true(a(*c)) and _true(b(*c))
        if op in ("+", "-", "*", "div", "mod"):
            def run(*c) -> float:
                x, y = _number(a(*c)), _number(b(*c))
                if op in ("div", "mod") and (y == 0 or math.isinf(x)):
                    return math.copysign(math.inf, x) if op == "div" and x else math.nan
                return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: math.fmod(x, y)}[op]()

            return run
        return lambda *c: _compare(op, a(*c), b(*c))

    def unary(self) -> Expr:
        if self.peek() == "-":
            self.take()
            inner = self.unary()
            return lambda *c: -_number(inner(*c))
        first = self.path()
        if self.peek() != "|":
            return first
        parts = [first]
        while self.peek() == "|":
            self.take()
            parts.append(self.path())

        def union(*c) -> list:
            found = [p(*c) for p in parts]
            if not all(isinstance(f, list) for f in found):
                raise XPathError(f"a union of what are no nodes: {self.text}")
            return _in_order([n for f in found for n in f])

        return union

    def _is_call(self) -> bool:
        return self.kind() == "name" and self.peek(1) == "(" and self.peek() not in ("text", "node", "comment", *_TAKEN)

    def path(self) -> Expr:
        """A location path, or a value that one may begin at."""
        if self.kind() in ("number", "string"):
            kind, token = self.tokens[self.at]
            self.at += 1
            value = float(token) if kind == "number" else token[1:-1]
            return lambda *c: value
        start: Expr | None = None
        steps: list = []
        if self.peek() == "(" or self._is_call():
            start = self._primary()
            filters = self._predicates()
            if filters:
                steps.append(filters)
            if self.peek() not in ("/", "//"):
                return self._located(start, steps) if steps else start
        elif self.peek() in ("/", "//"):
            start = lambda n, i, k, b: [n.tree[0]]
            if self.peek() == "/" and not (self.at + 1 < len(self.tokens) and (self.tokens[self.at + 1][0] == "name" or self.peek(1) in ("@", ".", "..", "*"))):
                self.take()
                return start
        if start is None:
            start = lambda n, i, k, b: [n]
            steps.append(self._step())
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                steps.append(("descendant-or-self", lambda n: True, []))
            steps.append(self._step())
        return self._located(start, steps)

    def _primary(self) -> Expr:
        if self.peek() == "(":
            self.take()
            inner = self.expr()
            self.take(")")
            return inner
        name = self.take()
        self.take("(")
        args: list[Expr] = []
        while self.peek() != ")":
            args.append(self.expr())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        if name in _PLACES and not args:
            return _PLACES[name]
        if name in ("string", "number", "string-length", "normalize-space") and not args:
            args = [lambda n, i, k, b: [n]]
        least, most, f = _FUNCTIONS.get(name, (1, 0, None))
        if not least <= len(args) <= most:
            raise XPathError(f"unsupported function {name} of {len(args)} arguments: {self.text}")
        if name in ("count", "sum"):
            def of_nodes(*c):
                v = args[0](*c)
                if not isinstance(v, list):
                    raise XPathError(f"{name} of what are no nodes: {self.text}")
                return f(v)

            return of_nodes
        return lambda *c: f(*(a(*c) for a in args))

    def _predicates(self) -> list[Expr]:
        out = []
        while self.peek() == "[":
            self.take()
            out.append(self.expr())
            self.take("]")
        return out

    def _step(self):
        """(axis, test, predicates), or (how to take, predicates) of steps that turn nodes into text."""
        if self.peek() == "..":
            self.take()
            return "parent", lambda n: True, self._predicates()
        if self.peek() == ".":
            self.take()
            return "self", lambda n: True, self._predicates()
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.take()
            if axis not in _AXES:
                raise XPathError(f"unsupported axis {axis}: {self.text}")
            self.take("::")
        if self.kind() not in ("name", "sign") or self.kind() == "sign" and self.peek() != "*":
            raise XPathError(f"not an XPath: {self.text}")
        name = self.take()
        if self.peek() == "(":
            self.take()
            self.take(")")
            if name in _TAKEN:
                return _TAKEN[name], self._predicates()
            if name not in ("text", "node", "comment"):
                raise XPathError(f"unsupported node type {name}: {self.text}")
            return axis, {"text": lambda n: n.tag == TEXT, "node": lambda n: True, "comment": lambda n: False}[name], self._predicates()
        low = name.lower()
        if axis == "attribute":
            return axis, (lambda n: True) if name == "*" else (lambda n: n.tag == "@" + low), self._predicates()
        return axis, (lambda n: n.tag not in (TEXT, "")) if name == "*" else (lambda n: n.tag == low), self._predicates()

    def _located(self, start: Expr, steps: list) -> Expr:
        def kept(nodes: list, filters: list[Expr], budget: list) -> list:
            for f in filters:
                size, left = len(nodes), []
                for i, n in enumerate(nodes, 1):
                    v = f(n, i, size, budget)
                    if v == i if isinstance(v, float) else _true(v):
                        left.append(n)
                nodes = left
            return nodes

        def run(node: Node, i: int, k: int, budget: list) -> list:
            now = start(node, i, k, budget)
            if not isinstance(now, list):
                raise XPathError(f"a path from what are no nodes: {self.text}")
            for step in steps:
                if isinstance(step, list):  # predicates of a whole set
                    now = kept(now, step, budget)
                    continue
                if len(step) == 2:  # of equal places, so that order stays
                    new = []
                    for n in now:
                        made = Node("@", {}, n, step[0](n))
                        made.order, made.tree = n.order, n.tree
                        new.append(made)
                    now = kept(new, step[1], budget)
                    continue
                axis, test, filters = step
                found: list[Node] = []
                for n in now:
                    if axis == "attribute":
                        nodes = []
                        for key, v in n.attrs.items():
                            a = Node("@" + key, {}, n, v)
                            a.order, a.tree = n.order, n.tree
                            if v and test(a):
                                nodes.append(a)
                        budget[0] -= 1
                    else:
                        nodes = _axis(axis, n)
                        budget[0] -= len(nodes)
                        nodes = [x for x in nodes if test(x)]
                    if budget[0] < 0:
                        raise XPathError(f"more than {MOST_VISITS} visits: {self.text}")
                    found += kept(nodes, filters, budget)
                now = _in_order(found) if len(now) > 1 or axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling") else found
            return now

        return run


def compile_xpath(text: str) -> Expr:
    p = _Parser(text)
    try:
        out = p.expr()
    except RecursionError:
        raise XPathError(f"too deep an XPath: {text[:80]}") from None
    if p.at != len(p.tokens):
        raise XPathError(f"not an XPath: {text}")
    return out


def evaluate(expr: Expr, scope: Node) -> Value:
    return expr(scope, 1, 1, [MOST_VISITS])


def nodes(expr: Expr, scope: Node) -> list[Node]:
    v = evaluate(expr, scope)
    return v if isinstance(v, list) else []


def values(expr: Expr, scope: Node) -> list[str]:
    """Texts of what an expression finds, in document order; blank ones are left out."""
    v = evaluate(expr, scope)
    if not isinstance(v, list):
        return [_string(v)] if _string(v).strip() else []
    return [t for n in v if (t := n.data.strip() if n.tag == TEXT or n.tag[:1] == "@" else squeeze(n.text()))]


_STEP = re.compile(r"(//|/)?(\*|[A-Za-z][\w-]*)((?:\[[^\]]*\])*)")
_BODY = re.compile(r"(\d+|last\(\))|@([\w-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?|contains\(\s*@([\w-]+)\s*,\s*(?:'([^']+)'|\"([^\"]+)\")\s*\)")


def to_selector(text: str) -> str | None:
    """The selector that finds what a plain path does (children, descendants, one place, attributes), else None."""
    at, out = 0, ""
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None or not out and m[1] != "//" or out and m[1] is None:
            return None
        step, attributes = m[2].lower(), False
        for body in re.findall(r"\[([^\]]*)\]", m[3]):
            b = _BODY.fullmatch(body.strip())
            if b is None or b[1] and (attributes or ":" in step) or '"' in (b[3] or b[6] or ""):
                return None
            if b[1]:
                kind = "child" if m[2] == "*" else "of-type"
                step += f":last-{kind}" if b[1] == "last()" else f":nth-{kind}({b[1]})"
                continue
            attributes = True
            name, same, part = b[2] or b[5], b[3] if b[3] is not None else b[4], b[6] or b[7]
            if same == "":
                return None
            pattern = "(?s)." if same is None and part is None else re.escape(part) if part else f"^{re.escape(same)}\\Z"
            step += f'[{name}~="{pattern}"]'
        out += step if not out else f"{' > ' if m[1] == '/' else ' '}{step}"
        at = m.end()
    return out or None
