"""HTML as a tree in document order, and selectors compiled before the first page is read.

Nothing here recurses over a page, so that its depth is no limit: nodes lie in one list, and what is below a node
is the slice from its place to its end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from html.parser import HTMLParser

#: Elements without content; elements that end, unclosed, where one of these begins; what ends a
#: paragraph; and what such an end never reaches beyond.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table select div section article nav body html".split())
TEXT = "#text"


class Node:
    """An element, a text or, in XPath, an attribute (its tag begins with @)."""

    __slots__ = ("tag", "attrs", "parent", "children", "data", "order", "end", "tree", "_elements")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, data: str = ""):
        self.tag, self.attrs, self.parent, self.data, self.children, self._elements = tag, attrs, parent, data, [], None

    def elements(self) -> list[Node]:
        if self._elements is None:
            self._elements = [c for c in self.children if c.tag != TEXT]
        return self._elements

    def below(self) -> list[Node]:
        """Elements under this one, in document order."""
        return [n for n in self.tree[self.order + 1 : self.end] if n.tag != TEXT]

    def place(self) -> int:
        return self.parent.elements().index(self) if self.parent else 0

    def text(self) -> str:
        if self.tag == TEXT or self.tag[:1] == "@":
            return self.data
        return "".join(n.data for n in self.tree[self.order : self.end] if n.tag == TEXT and n.parent.tag not in ("script", "style"))

    def own_text(self) -> str:
        return " ".join(c.data for c in self.children if c.tag == TEXT)

    def outer(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == TEXT:
                out.append(n.data if n.parent.tag in ("script", "style") else escape(n.data, False))
            else:
                out.append(f"<{n.tag}{''.join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())}>")
                if n.tag not in VOID:
                    todo.append(f"</{n.tag}>")
                    todo.extend(reversed(n.children))
        return "".join(out)

    def html(self) -> str:
        return "".join(c.outer() for c in self.children) if self.tag != TEXT else escape(self.data, False)


class _Builder(HTMLParser):
    """Elements in document order; what the next element ends by its kind is ended there, the rest with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree: list[Node] = []
        self.at = self._add("", {}, None)

    def _add(self, tag: str, attrs: dict, parent: Node | None, data: str = "") -> Node:
        node = Node(tag, attrs, parent, data)
        node.order, node.tree = len(self.tree), self.tree
        self.tree.append(node)
        if parent is not None:
            parent.children.append(node)
        return node

    def _end(self, fits: Callable[[str], bool]) -> None:
        node = self.at
        while node.parent is not None:
            if fits(node.tag):
                self.at = node.parent
                return
            if node.tag in SCOPE:
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        self._end(lambda t: tag in ENDED_BY.get(t, ()))
        if tag in ENDS_P:
            self._end(lambda t: t == "p")
        node = self._add(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self._add(TEXT, {}, self.at, data)


def parse(html: str) -> Node:
    """The root of a page: what can't be read as markup is text."""
    b = _Builder()
    b.feed(html)
    b.close()
    for n in reversed(b.tree):
        n.end = n.children[-1].end if n.children else n.order + 1
    return b.tree[0]


def squeeze(text: str) -> str:
    return " ".join(text.split())


# --- selectors ------------------------------------------------------------------------------------------

Test = Callable[[Node], bool]
#: Steps of one selector: what links each to the step before, and the tests of its element.
Chain = list[tuple[str, list[Test]]]

_NAME = re.compile(r"[\w-]+")
_ATTR = re.compile(r"\s*(\^?)([\w:-]+)\s*(?:([!^$*~]?=)\s*(.*?)\s*)?", re.S)
_NTH = re.compile(r"\s*(?:([+-]?\d*)n\s*([+-]\s*\d+)?|([+-]?\d+))\s*", re.I)


def _closing(s: str, at: int, close: str) -> int:
    """Place of the bracket that closes the one before at; quoted text doesn't count."""
    opens, depth, quote = {")": "(", "]": "["}[close], 1, ""
    for i in range(at, len(s)):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == opens:
            depth += 1
        elif c == close:
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"unclosed bracket in selector: {s}")


def _attribute(body: str) -> Test:
    m = _ATTR.fullmatch(body)
    if m is None or m[1] and m[3]:
        raise ValueError(f"unsupported attribute selector: [{body}]")
    key, op = m[2].lower(), m[3]
    if m[1]:
        return lambda n: any(k.startswith(key) for k in n.attrs)
    if op is None:
        return lambda n: key in n.attrs
    want = m[4][1:-1] if len(m[4]) > 1 and m[4][0] == m[4][-1] and m[4][0] in "'\"" else m[4]
    if op == "~=":
        pattern = re.compile(want)
        return lambda n: key in n.attrs and pattern.search(n.attrs[key]) is not None
    low = want.lower()
    if op == "!=":
        return lambda n: n.attrs.get(key, "").strip().lower() != low or key not in n.attrs
    holds = {"=": lambda v: v.strip() == low, "^=": lambda v: v.startswith(low), "$=": lambda v: v.endswith(low), "*=": lambda v: low in v}[op]
    return lambda n: key in n.attrs and holds(n.attrs[key].lower())


def _nth(arg: str) -> tuple[int, int]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg)
    m = _NTH.fullmatch(arg)
    if m is None:
        raise ValueError(f"unsupported place: {arg}")
    if m[3]:
        return 0, int(m[3])
    return int({"": "1", "+": "1", "-": "-1"}.get(m[1], m[1])), int((m[2] or "0").replace(" ", ""))


def _counted(step: int, first: int, of_type: bool, last: bool) -> Test:
    def test(n: Node) -> bool:
        kin = [x for x in n.parent.elements() if not of_type or x.tag == n.tag] if n.parent else [n]
        k = len(kin) - kin.index(n) if last else kin.index(n) + 1
        return k == first if not step else (k - first) % step == 0 and (k - first) // step >= 0

    return test


def _pseudo(name: str, arg: str | None) -> Test:
    ends = {"first-child": (False, False), "last-child": (False, True), "first-of-type": (True, False), "last-of-type": (True, True)}
    if name in ends:
        return _counted(0, 1, *ends[name])
    if name in ("only-child", "only-of-type"):
        return lambda n, t=name.endswith("type"): sum(not t or x.tag == n.tag for x in n.parent.elements()) == 1 if n.parent else True
    if name == "empty":
        return lambda n: all(c.tag == TEXT and not c.data.strip() for c in n.children)
    if name == "root":
        return lambda n: n.parent is not None and n.parent.parent is None
    if arg is None:
        raise ValueError(f"unsupported pseudo class: {name}")
    if name.startswith("nth-"):
        of_type, last = name.endswith("of-type"), name.startswith("nth-last-")
        if name not in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type"):
            raise ValueError(f"unsupported pseudo class: {name}")
        return _counted(*_nth(arg), of_type, last)
    if name in ("eq", "lt", "gt"):
        k = int(arg)
        return {"eq": lambda n: n.place() == k, "lt": lambda n: n.place() < k, "gt": lambda n: n.place() > k}[name]
    if name == "not":
        inner = compile_selector(arg)
        return lambda n: not any(fits(n, c, len(c) - 1, None) for c in inner)
    if name == "has":
        inner = compile_selector(arg, relative=True)
        return lambda n: any(fits(x, c, len(c) - 1, n) for c in inner for x in ((n.parent.elements() if n.parent else []) if c[0][0] in "+~" else n.below()))
    want = squeeze(arg.strip("'\"")).lower()
    texts = {"contains": lambda n: squeeze(n.text()), "containsown": lambda n: squeeze(n.own_text()), "containswholetext": Node.text, "containswholeowntext": lambda n: "".join(c.data for c in n.children if c.tag == TEXT)}
    if name.lower() not in texts:
        raise ValueError(f"unsupported pseudo class: {name}")
    get = texts[name.lower()]
    return lambda n: want in get(n).lower()


def _compound(s: str, at: int) -> tuple[list[Test], int]:
    """Tests of one element from s[at] on, and where they end."""
    tests: list[Test] = []
    while at < len(s):
        c = s[at]
        m = _NAME.match(s, at + 1) if c in "#.:" else None
        if c in "#." and m:
            name = m[0]
            tests.append((lambda n, v=name: n.attrs.get("id") == v) if c == "#" else (lambda n, v=name.lower(): v in n.attrs.get("class", "").lower().split()))
            at = m.end()
        elif c == ":" and m:
            at, arg = m.end(), None
            if s[at : at + 1] == "(":
                end = _closing(s, at + 1, ")")
                at, arg = end + 1, s[at + 1 : end]
            tests.append(_pseudo(m[0], arg))
        elif c == "[":
            end = _closing(s, at + 1, "]")
            tests.append(_attribute(s[at + 1 : end]))
            at = end + 1
        elif c == "*" and not tests:
            tests.append(lambda n: True)
            at += 1
        elif not tests and (m := re.compile(r"[A-Za-z][\w-]*").match(s, at)):
            tests.append(lambda n, v=m[0].lower(): n.tag == v)
            at = m.end()
        else:
            break
    return tests, at


def compile_selector(s: str, relative: bool = False) -> list[Chain]:
    """Chains of a selector, one for each part between commas; ValueError for what isn't supported.

    Steps are parted by blanks, >, + or ~, and hold tag, *, #id, .class, [k] [^k] [k=v] (!= ^= $= *=, ~= a pattern;
    values in any case), :first/last/only-child, the same of-type, :nth-child and its kin with an+b, :eq :lt :gt
    (place among siblings, from 0), :not, :has (also relative), :contains, :containsOwn, :empty and :root.
    """
    out: list[Chain] = []
    chain: Chain = []
    at, s = 0, s.strip()
    link = " "
    if not s:
        raise ValueError("empty selector")
    while True:
        m = re.compile(r"\s*([>+~])?\s*").match(s, at)
        if m[1] and (chain or relative):
            link, at = m[1], m.end()
        elif m[1]:
            raise ValueError(f"nothing before {m[1]} in selector: {s}")
        else:
            at = m.end()
        tests, end = _compound(s, at)
        if not tests:
            raise ValueError(f"unsupported selector: {s}")
        chain.append((link, tests))
        link, at = " ", end
        if at >= len(s):
            return [*out, chain]
        if m := re.compile(r"\s*,\s*").match(s, at):
            out.append(chain)
            chain, at = [], m.end()
        elif not re.compile(r"\s|[>+~]").match(s, at):
            raise ValueError(f"unsupported selector: {s}")


def fits(node: Node, chain: Chain, k: int, scope: Node | None) -> bool:
    """Whether an element ends the first k + 1 steps; scope: what a relative chain begins at."""
    link, tests = chain[k]
    if node.parent is None or not all(t(node) for t in tests):
        return False
    if k == 0 and scope is None:
        return True
    reached = (lambda x: x is scope) if k == 0 else (lambda x: fits(x, chain, k - 1, scope))
    if link in "+~":
        kin = node.parent.elements()
        before = kin[: kin.index(node)]
        return any(reached(x) for x in (before[-1:] if link == "+" else before))
    up = node.parent
    while up is not None:
        if reached(up):
            return True
        if link == ">":
            return False
        up = up.parent
    return False


def find(scope: Node, chains: list[Chain]) -> list[Node]:
    """Elements below scope that a selector finds, in document order."""
    return [n for n in scope.below() if any(fits(n, c, len(c) - 1, None) for c in chains)]
