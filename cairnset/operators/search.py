"""Query languages over items with strings: three grammars, one tree, compiled to one predicate over an item's row.

A tree becomes a boolean column, so a query is a filter on one scan: no join, no shuffle, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: A function in a query: its argument to a predicate over the item's row.
Function = Callable[[str], Column]
#: Is there an indexed string with this start.
Hinter = Callable[[str], bool]

OPERATORS = {"+": "union", "-": "difference", "/": "intersect", "^": "symmetric difference"}


@dataclass(frozen=True)
class Leaf:
    text: str
    kind: int

    def __str__(self) -> str:
        before, after = {text.EXACT: '""', text.PREFIX: " *", text.SUFFIX: "* ", text.SUBSTRING: "**"}[self.kind & 15]
        return (before + self.text + after).strip(" ") if self.kind & 15 != text.EXACT else f'"{self.text}"'


@dataclass(frozen=True)
class Call:
    name: str
    argument: str

    def __str__(self) -> str:
        return f"${self.name}[{self.argument}]"


@dataclass(frozen=True)
class Node:
    operator: str
    left: Tree
    right: Tree


Tree = Leaf | Call | Node | None


@dataclass(frozen=True)
class Terms:
    """A flat query: all of ``wanted``, none of ``unwanted``."""

    wanted: tuple[Leaf | Call, ...]
    unwanted: tuple[Leaf | Call, ...]

    def __str__(self) -> str:
        return " ".join([*map(str, self.wanted), *(f"-{t}" for t in self.unwanted)])


def _plain(s: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", s)


def _decorated(s: str) -> Leaf:
    """``"x"`` exact, ``*x`` suffix, ``x*`` prefix, ``*x*`` and ``x`` substring."""
    if s.startswith('"'):
        return Leaf(s[1:].removesuffix('"'), text.EXACT)
    front, back = s.startswith("*"), len(s) > 1 and s.endswith("*")
    bare = s.removeprefix("*").removesuffix("*")
    return Leaf(bare, text.SUBSTRING if front == back else text.SUFFIX if front else text.PREFIX)


def _long_enough(terms: list[tuple[bool, Leaf | Call]], least: int) -> Terms:
    kept = [(minus, t) for minus, t in terms if isinstance(t, Call) or len(t.text.encode()) >= least]
    return Terms(tuple(t for minus, t in kept if not minus), tuple(t for minus, t in kept if minus))


def parse_terms(q: str, least: int = 0) -> Terms:
    """Terms between spaces; a minus right before a term subtracts it; a backslash escapes; terms of fewer bytes than ``least`` go."""
    found = re.finditer(r"(?s)(-*)((?:\\.|[^ \\-])(?:\\.|[^ \\])*)", q)
    return _long_enough([(bool(m[1]), _decorated(_plain(m[2]))) for m in found], least)


_TERM = re.compile(r'(?s)(-\s*)?(?:"((?:\\.|[^"\\])+)"|\$([A-Za-z0-9]+)\[((?:\\.|[^\]\\])*)\]|(\*?)((?:\\.|[^\s\\*])+)(\*?))(?=\s|$)')


def parse_function_terms(q: str, functions: set[str], least: int = 0) -> Terms:
    """As ``parse_terms``, with ``$name[argument]``; the minus may stand apart; a malformed term is skipped, and an unknown function."""
    terms: list[tuple[bool, Leaf | Call]] = []
    at = 0
    while at < len(q):
        if q[at].isspace():
            at += 1
        elif m := _TERM.match(q, at):
            at, minus = m.end(), m[1] is not None
            if m[2] is not None:
                terms.append((minus, Leaf(_plain(m[2]), text.EXACT)))
            elif m[3] is None:
                kind = text.SUBSTRING if bool(m[5]) == bool(m[7]) else text.SUFFIX if m[5] else text.PREFIX
                terms.append((minus, Leaf(_plain(m[6]), kind)))
            elif m[3] in functions:
                terms.append((minus, Call(m[3], _plain(m[4]))))
        else:
            at = re.compile(r"(?s)(?:\\.|[^\s\\])+|\\?").match(q, at).end() or at + 1
    return _long_enough(terms, least)


def _fold(tokens: Iterator[str | Leaf | Call]) -> Tree:
    """All operators bind alike and to the left; a missing one is an intersection, a surplus one and surplus brackets go."""
    tree, operator = None, None
    for token in tokens:
        if token == ")":
            break
        if isinstance(token, str) and token in OPERATORS:
            operator = operator or (token if tree is not None else None)
            continue
        operand = _fold(tokens) if token == "(" else token
        if operand is not None:
            tree = operand if tree is None else Node(operator or "/", tree, operand)
            operator = None
    return tree


def _balanced(tokens: Iterator[str | Leaf | Call]) -> Iterator[str | Leaf | Call]:
    depth = 0
    for token in tokens:
        depth += (token == "(") - (token == ")")
        if depth < 0:
            depth = 0
            continue
        yield token


def parse_infix(q: str, functions: set[str]) -> Tree:
    """Infix operators, brackets and ``$name[argument]``; strings end at a space, an operator or a bracket and match in any case."""

    def tokens() -> Iterator[str | Leaf | Call]:
        for m in re.finditer(r"(?s)(?P<space> +)|(?P<sign>[-+/^()])|\$(?P<name>[^\[ ]*)(?P<arg>\[(?:\\.|[^\]\\])*\]?)?|(?P<word>(?:\\.|[^-+/^()$ \\])+)", q):
            if m["sign"]:
                yield m["sign"]
            elif m["name"] is not None:
                if m["arg"] is None or m["name"] not in functions:
                    yield Call("", "")
                else:
                    yield Call(m["name"], _plain(m["arg"][1:].removesuffix("]")))
            elif m["word"]:
                leaf = _decorated(_plain(m["word"]))
                yield Leaf(leaf.text, leaf.kind | text.NO_CASE)

    return _fold(_balanced(tokens()))


def parse_hinted(q: str, hinter: Hinter = lambda s: False) -> Tree:
    """Infix without functions; ``?`` for ``*``. A string goes on over a space for as long as the hinter knows the longer string,
    and holds operator signs that don't follow a space."""

    def tokens() -> Iterator[str | Leaf | Call]:
        at = 0
        while at < len(q):
            c = q[at]
            if c == " ":
                at += 1
            elif c in OPERATORS or c in "()":
                at += 1
                yield c
            elif m := re.compile(r'(?s)\??"(?:\\.|[^"\\])*"?\??').match(q, at):
                at = m.end()
                yield Leaf(*text.normalize(_plain(m[0])))
            else:
                word = re.compile(r"(?s)(?:\\.|[^ ()\\])+|\\")
                end = word.match(q, at).end()
                while q[end : end + 1] == " " and (m := word.match(q, end + 1)) and q[end + 1] not in OPERATORS and hinter(_plain(q[at : m.end()]).strip("?")):
                    end = m.end()
                whole, at = _plain(q[at:end]), end
                yield Leaf(*text.normalize(whole))

    return _fold(_balanced(tokens()))


def structure(tree: Tree) -> str:
    """Canonical rendering of an infix tree."""
    if isinstance(tree, Node):
        return f"({structure(tree.left)} {tree.operator} {structure(tree.right)})"
    return f"({tree})" if isinstance(tree, Call) and tree.name else "()" if not isinstance(tree, Leaf) else f'("{tree.text}")'


def predicate(tree: Tree, strs: Column, functions: dict[str, Function] | None = None) -> Column:
    """The tree over an item's row. An unknown function is an empty set."""
    if isinstance(tree, Node):
        a, b = predicate(tree.left, strs, functions), predicate(tree.right, strs, functions)
        return {"+": a | b, "-": a & ~b, "/": a & b, "^": a != b}[tree.operator]
    if isinstance(tree, Leaf):
        return F.coalesce(text.any_matches(strs, tree.text, tree.kind), F.lit(False))
    if isinstance(tree, Call) and tree.name in (functions or {}):
        return F.coalesce(functions[tree.name](tree.argument), F.lit(False))
    return F.lit(False)


def terms_predicate(terms: Terms, strs: Column, functions: dict[str, Function] | None = None) -> Column:
    """All wanted terms and no unwanted one; nothing without a wanted one."""
    if not terms.wanted:
        return F.lit(False)
    wanted = reduce(Column.__and__, [predicate(t, strs, functions) for t in terms.wanted])
    return reduce(lambda c, t: c & ~predicate(t, strs, functions), terms.unwanted, wanted)


def leaves(tree: Tree) -> list[Leaf]:
    if isinstance(tree, Node):
        return leaves(tree.left) + leaves(tree.right)
    return [tree] if isinstance(tree, Leaf) else []


def with_strings(tree: Tree, texts: Iterator[str]) -> Tree:
    """The tree with other texts in its leaves, in order."""
    if isinstance(tree, Node):
        left = with_strings(tree.left, texts)
        return Node(tree.operator, left, with_strings(tree.right, texts))
    return Leaf(next(texts), tree.kind) if isinstance(tree, Leaf) else tree


def hints(items: DataFrame, tree: Tree, functions: dict[str, Function] | None = None) -> DataFrame:
    """``leaf, c``: characters that may follow a leaf's text so that the whole query still finds an item.

    An item's row gives all continuations of its strings; that the query with the longer leaf still holds is
    judged in the same row, since an item matches by its own strings only.
    """
    out, all_leaves = None, leaves(tree)
    for k, leaf in enumerate(all_leaves):
        s, q = F.col("_s"), leaf.text
        hay = F.lower(s) if leaf.kind & text.NO_CASE else s
        needle = q.lower() if leaf.kind & text.NO_CASE else q
        # every place where the text stands, and what comes after it
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s) - len(q), F.lit(1))), lambda i: (F.substr(hay, i, F.lit(len(q))) == needle) & (F.length(s) >= i + len(q)))
        if leaf.kind & (text.PREFIX | text.EXACT):
            places = F.filter(places, lambda i: i == 1)
        rows = items.withColumn("_s", F.explode("strs")).withColumn("_i", F.explode(places)).withColumn("c", F.substr(hay, F.col("_i") + len(q), F.lit(1)))
        # the longer leaf holds in this row (it does at this place, if the kind allows text after it)
        grown = F.exists("strs", lambda t: text.matches(t, F.concat(F.lit(q), F.col("c")), leaf.kind))
        rest = _predicate_but(tree, k, grown, F.col("strs"), functions)
        found = rows.where(rest).select(F.lit(k).alias("leaf"), "c").distinct()
        out = found if out is None else out.union(found)
    return out


def _predicate_but(tree: Tree, place: int, given: Column, strs: Column, functions: dict[str, Function] | None) -> Column:
    """The tree's predicate with ``given`` for its leaf number ``place``."""
    count = iter(range(1 << 30))

    def walk(t: Tree) -> Column:
        if isinstance(t, Node):
            a = walk(t.left)
            b = walk(t.right)
            return {"+": a | b, "-": a & ~b, "/": a & b, "^": a != b}[t.operator]
        if isinstance(t, Leaf) and next(count) == place:
            return given
        return predicate(t, strs, functions)

    return walk(tree)


class ItemSet:
    """A query over items (``item_id, strs``, more columns): ids or rows in ascending order. Updating it parses anew; nothing runs before rows are asked for."""

    def __init__(self, items: DataFrame, q: str, language: str = "infix", functions: dict[str, Function] | None = None, hinter: Hinter = lambda s: False, most: int | None = None, keep: Column | None = None):
        self.items, self.language, self.functions, self.hinter, self.most, self.keep = items, language, functions or {}, hinter, most, keep
        self.update(q)

    def parse(self, q: str) -> Tree | Terms:
        names = set(self.functions)
        return {"terms": lambda: parse_function_terms(q, names) if names else parse_terms(q), "infix": lambda: parse_infix(q, names), "hinted": lambda: parse_hinted(q, self.hinter)}[self.language]()

    def update(self, q: str) -> ItemSet:
        self.tree = self.parse(q)
        return self

    def matching(self) -> DataFrame:
        compiled = terms_predicate if isinstance(self.tree, Terms) else predicate
        rows = self.items.where(compiled(self.tree, F.col("strs"), self.functions))
        return rows if self.keep is None else rows.where(self.keep)

    def ids(self) -> DataFrame:
        found = self.matching().select("item_id").orderBy("item_id")
        return found if self.most is None else found.limit(self.most)

    def rows(self) -> DataFrame:
        found = self.matching().orderBy("item_id")
        return found if self.most is None else found.limit(self.most)

    def size(self) -> int:
        return self.matching().count()
