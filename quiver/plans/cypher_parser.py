"""Cypher text to a tree.  Expressions are tuples (kind, ...); clauses are dataclasses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quiver.catalog import GraphError, suggest

_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/
    |(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<num>(?:\d+\.\d+|\d+|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<quoted>`[^`]*`)
    |(?P<name>[^\W\d]\w*)
    |(?P<param>\$\w+)
    |(?P<op>\.\.|<=|>=|<>|!=|=~|\+=|\|\||[-+*/%^=<>(){}\[\],.:;|])""",
    re.X | re.S,
)
CLAUSES = ("MATCH", "OPTIONAL", "WHERE", "UNWIND", "WITH", "RETURN", "ORDER", "SKIP", "LIMIT", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "CALL", "DROP", "UNION")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "percentile", "percentilecont"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphError(f"unexpected {text[at]!r} at {at}", "syntax")
        if m.lastgroup:
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, ("end", "", len(text))]


@dataclass
class NodePattern:
    var: str | None = None
    labels: list[list[str]] = field(default_factory=list)  # conjunction of alternatives
    props: dict = field(default_factory=dict)


@dataclass
class EdgePattern:
    var: str | None = None
    types: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)
    direction: str = "both"
    hops: tuple[int, int | None] | None = None  # variable length


@dataclass
class PathPattern:
    var: str | None
    nodes: list[NodePattern]
    edges: list[EdgePattern]


@dataclass
class Match:
    patterns: list[PathPattern]
    where: tuple | None = None
    optional: bool = False


@dataclass
class Unwind:
    expr: tuple
    var: str


@dataclass
class Item:
    expr: tuple
    alias: str


@dataclass
class Projection:
    items: list[Item] | None  # None: *
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    where: tuple | None = None
    final: bool = True


@dataclass
class Call:
    name: str
    args: list
    yields: list[tuple[str, str]]
    where: tuple | None = None


@dataclass
class Create:
    patterns: list[PathPattern]


@dataclass
class Merge:
    pattern: PathPattern
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class SetClause:
    items: list  # (var, prop, expr) | (var, "+=" or "=", expr) | (var, ":", labels)


@dataclass
class Remove:
    items: list


@dataclass
class Delete:
    vars: list[str]
    detach: bool


@dataclass
class Ddl:
    action: str
    kind: str
    name: str | None
    type_name: str | None = None
    props: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    lenient: bool = False


@dataclass
class Query:
    clauses: list
    union: tuple[str, Query] | None = None


def name_of(e: tuple) -> str:
    """The default column name of an expression."""
    if e[0] == "var":
        return e[1]
    if e[0] == "prop":
        return f"{name_of(e[1])}.{e[2]}"
    if e[0] == "call":
        return f"{e[1]}({', '.join(map(name_of, e[2]))})"
    if e[0] == "star":
        return "*"
    if e[0] == "lit":
        return str(e[1])
    return f"${e[1]}" if e[0] == "param" else "expr"


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    # tokens --------------------------------------------------------------
    @property
    def token(self):
        return self.tokens[self.at]

    def fail(self, wanted: str):
        kind, text, at = self.token
        raise GraphError(f"expected {wanted}, got {text or 'the end'!r} at {at}", "syntax")

    def word(self, *names: str) -> bool:
        """The next words, in any case, are these."""
        for i, n in enumerate(names):
            t = self.tokens[min(self.at + i, len(self.tokens) - 1)]
            if t[0] != "name" or t[1].upper() != n:
                return False
        return True

    def take_word(self, *names: str) -> bool:
        if self.word(*names):
            self.at += len(names)
            return True
        return False

    def op(self, text: str) -> bool:
        return self.token[0] == "op" and self.token[1] == text

    def take(self, text: str) -> bool:
        if self.op(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(repr(text))

    def need_word(self, name: str) -> None:
        if not self.take_word(name):
            self.fail(name)

    def name(self) -> str:
        kind, text, _ = self.token
        if kind not in ("name", "quoted"):
            self.fail("a name")
        self.at += 1
        return text[1:-1] if kind == "quoted" else text

    # query ---------------------------------------------------------------
    def parse(self) -> Query:
        q = self.query()
        self.take(";")
        if self.token[0] != "end":
            word = self.token[1]
            raise GraphError(f"unexpected {word!r} at {self.token[2]}", "syntax", suggest(word.upper(), CLAUSES))
        return q

    def query(self) -> Query:
        clauses = []
        while True:
            if self.take_word("OPTIONAL", "MATCH"):
                clauses.append(self.match(True))
            elif self.take_word("MATCH"):
                clauses.append(self.match(False))
            elif self.take_word("UNWIND"):
                e = self.expr()
                self.need_word("AS")
                clauses.append(Unwind(e, self.name()))
            elif self.take_word("WITH"):
                clauses.append(self.projection(False))
            elif self.take_word("RETURN"):
                clauses.append(self.projection(True))
            elif self.take_word("CALL"):
                clauses.append(self.call())
            elif self.word("CREATE") and self._ddl_follows():
                clauses.append(self.create_ddl())
            elif self.take_word("CREATE"):
                clauses.append(Create(self.patterns()))
            elif self.take_word("MERGE"):
                merge = Merge(self.pattern())
                while self.take_word("ON"):
                    create = self.take_word("CREATE")
                    if not create:
                        self.need_word("MATCH")
                    self.need_word("SET")
                    (merge.on_create if create else merge.on_match).extend(self.set_items())
                clauses.append(merge)
            elif self.take_word("SET"):
                clauses.append(SetClause(self.set_items()))
            elif self.take_word("REMOVE"):
                items = [self.remove_item()]
                while self.take(","):
                    items.append(self.remove_item())
                clauses.append(Remove(items))
            elif self.word("DETACH", "DELETE") or self.word("DELETE"):
                detach = self.take_word("DETACH")
                self.need_word("DELETE")
                names = [self.name()]
                while self.take(","):
                    names.append(self.name())
                clauses.append(Delete(names, detach))
            elif self.word("DROP"):
                clauses.append(self.drop_ddl())
            else:
                break
        if not clauses:
            word = self.token[1]
            raise GraphError(f"expected a clause, got {word or 'the end'!r}", "syntax", suggest(word.upper(), CLAUSES))
        if self.take_word("UNION"):
            return Query(clauses, ("all" if self.take_word("ALL") else "distinct", self.query()))
        return Query(clauses)

    def match(self, optional: bool) -> Match:
        patterns = self.patterns()
        return Match(patterns, self.expr() if self.take_word("WHERE") else None, optional)

    def patterns(self) -> list[PathPattern]:
        out = [self.pattern()]
        while self.take(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> PathPattern:
        var = None
        if self.token[0] in ("name", "quoted") and self.tokens[self.at + 1][1] == "=":
            var = self.name()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.op("-") or self.op("<"):
            edges.append(self.edge())
            nodes.append(self.node())
        return PathPattern(var, nodes, edges)

    def labels(self) -> list[list[str]]:
        groups = []
        while self.take(":"):
            groups.append([self.name()])
            while self.take("|"):
                self.take(":")
                groups[-1].append(self.name())
        return groups

    def node(self) -> NodePattern:
        self.need("(")
        var = self.name() if self.token[0] in ("name", "quoted") else None
        node = NodePattern(var, self.labels(), self.map_entries() if self.op("{") else {})
        self.need(")")
        return node

    def edge(self) -> EdgePattern:
        left = self.take("<")
        self.need("-")
        e = EdgePattern()
        if self.take("["):
            e.var = self.name() if self.token[0] in ("name", "quoted") else None
            groups = self.labels()
            e.types = [t for g in groups for t in g]
            if self.take("*"):
                e.hops = self.hop_range()
            e.props = self.map_entries() if self.op("{") else {}
            self.need("]")
        self.need("-")
        right = self.take(">")
        e.direction = "in" if left and not right else "out" if right and not left else "both"
        return e

    def hop_range(self) -> tuple[int, int | None]:
        low = int(self.number()) if self.token[0] == "num" else None
        if self.take(".."):
            high = int(self.number()) if self.token[0] == "num" else None
            return (1 if low is None else low), high
        return (1, None) if low is None else (low, low)

    def number(self):
        text = self.token[1]
        self.at += 1
        return float(text) if re.search(r"[.eE]", text) else int(text)

    def map_entries(self) -> dict:
        self.need("{")
        out = {}
        while not self.op("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            if not self.take(","):
                break
        self.need("}")
        return out

    def projection(self, final: bool) -> Projection:
        p = Projection(None, self.take_word("DISTINCT"), final=final)
        if not self.take("*"):
            p.items = [self.item()]
            while self.take(","):
                p.items.append(self.item())
        if self.take_word("ORDER"):
            self.need_word("BY")
            while True:
                e = self.expr()
                down = self.take_word("DESC") or self.take_word("DESCENDING")
                if not down:
                    self.take_word("ASC") or self.take_word("ASCENDING")
                p.order.append((e, down))
                if not self.take(","):
                    break
        if self.take_word("SKIP"):
            p.skip = self.expr()
        if self.take_word("LIMIT"):
            p.limit = self.expr()
        if not final and self.take_word("WHERE"):
            p.where = self.expr()
        return p

    def item(self) -> Item:
        e = self.expr()
        return Item(e, self.name() if self.take_word("AS") else name_of(e))

    def call(self) -> Call:
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        args = []
        if self.take("("):
            while not self.op(")"):
                args.append(self.expr())
                if not self.take(","):
                    break
            self.need(")")
        yields = []
        if self.take_word("YIELD"):
            while True:
                y = self.name()
                yields.append((y, self.name() if self.take_word("AS") else y))
                if not self.take(","):
                    break
        return Call(name, args, yields, self.expr() if self.take_word("WHERE") else None)

    def set_items(self) -> list:
        out = []
        while True:
            var = self.name()
            if self.op(":"):
                out.append((var, ":", self.labels()))
            elif self.take("."):
                prop = self.name()
                self.need("=")
                out.append((var, prop, self.expr(), "."))
            elif self.take("+="):
                out.append((var, "+=", self.expr()))
            else:
                self.need("=")
                out.append((var, "=", self.expr()))
            if not self.take(","):
                return out

    def remove_item(self):
        var = self.name()
        if self.op(":"):
            return (var, ":", self.labels())
        self.need(".")
        return (var, ".", self.name())

    # schema --------------------------------------------------------------
    def _ddl_follows(self) -> bool:
        kinds = ("INDEX", "CONSTRAINT", "VECTOR", "FULLTEXT", "TEXT", "RANGE", "POINT", "LOOKUP")
        t = self.tokens[self.at + 1]
        return t[0] == "name" and t[1].upper() in kinds

    def create_ddl(self) -> Ddl:
        self.need_word("CREATE")
        kind = "range"
        for k in ("VECTOR", "FULLTEXT", "TEXT", "RANGE", "POINT", "LOOKUP"):
            if self.take_word(k):
                kind = k.lower()
        constraint = self.take_word("CONSTRAINT")
        if not constraint:
            self.need_word("INDEX")
        d = Ddl("create", "constraint" if constraint else kind, None)
        if not self.word("IF") and not self.word("FOR") and not self.word("ON"):
            d.name = self.name()
        d.lenient = self.take_word("IF", "NOT", "EXISTS")
        if not self.take_word("FOR"):
            self.need_word("ON")
        if self.take("("):
            if self.token[0] in ("name", "quoted"):
                self.name()
            groups = self.labels()
            self.need(")")
            if self.take("-") and self.take("["):
                if self.token[0] in ("name", "quoted"):
                    self.name()
                groups = self.labels()
                self.need("]")
                self.need("-")
                self.take(">")
                self.node()
            d.type_name = groups[0][0] if groups else None
        self.take_word("ON") or self.take_word("REQUIRE") or self.take_word("ASSERT")
        self.take_word("EACH")
        if self.take("(") or self.take("["):
            while not (self.op(")") or self.op("]")):
                d.props.append(self._owned())
                self.take(",")
            self.at += 1
        elif self.token[0] in ("name", "quoted"):
            d.props.append(self._owned())
        if self.take_word("IS"):
            d.options["require"] = "unique" if self.take_word("UNIQUE") else "not_null" if self.take_word("NOT", "NULL") else "node_key" if self.take_word("NODE", "KEY") else self.fail("UNIQUE, NOT NULL or NODE KEY")
        if self.take_word("OPTIONS"):
            d.options |= {k: v for k, v in self.map_entries().items()}
        return d

    def _owned(self) -> str:
        name = self.name()
        return self.name() if self.take(".") else name

    def drop_ddl(self) -> Ddl:
        self.need_word("DROP")
        kind = "constraint" if self.take_word("CONSTRAINT") else "index"
        if kind == "index":
            self.need_word("INDEX")
        d = Ddl("drop", kind, self.name())
        d.lenient = self.take_word("IF", "EXISTS")
        return d

    # expressions ---------------------------------------------------------
    def expr(self) -> tuple:
        return self._left(("OR",), lambda: self._left(("XOR",), lambda: self._left(("AND",), self._not)))

    def _left(self, words, below) -> tuple:
        e = below()
        while True:
            for w in words:
                if self.take_word(w):
                    e = ("bin", w, e, below())
                    break
            else:
                return e

    def _not(self) -> tuple:
        return ("not", self._not()) if self.take_word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        e = self.additive()
        whole = None
        while True:
            for o in ("<=", ">=", "<>", "!=", "=~", "=", "<", ">"):
                if self.take(o):
                    right = self.additive()
                    one = ("bin", "<>" if o == "!=" else o, e, right)
                    whole, e = (one if whole is None else ("bin", "AND", whole, one)), right
                    break
            else:
                break
        e = whole or e
        while True:
            if self.take_word("IS"):
                negated = self.take_word("NOT")
                self.need_word("NULL")
                e = ("isnull", e, negated)
            elif self.take_word("IN"):
                e = ("in", e, self.additive())
            elif self.take_word("STARTS"):
                self.need_word("WITH")
                e = ("bin", "STARTS", e, self.additive())
            elif self.take_word("ENDS"):
                self.need_word("WITH")
                e = ("bin", "ENDS", e, self.additive())
            elif self.take_word("CONTAINS"):
                e = ("bin", "CONTAINS", e, self.additive())
            else:
                return e

    def _ops(self, ops, below) -> tuple:
        e = below()
        while self.token[0] == "op" and self.token[1] in ops:
            o = self.token[1]
            self.at += 1
            e = ("bin", o, e, below())
        return e

    def additive(self) -> tuple:
        return self._ops(("+", "-", "||"), lambda: self._ops(("*", "/", "%"), self.power))

    def power(self) -> tuple:
        e = self.unary()
        return ("bin", "^", e, self.power()) if self.take("^") else e

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        self.take("+")
        return self.postfix()

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.op(".") and self.tokens[self.at + 1][0] in ("name", "quoted"):
                self.need(".")
                e = ("prop", e, self.name())
            elif self.take("["):
                e = ("index", e, self.expr())
                self.need("]")
            elif e[0] == "var" and self.op("{"):
                e = self.map_projection(e)
            elif e[0] == "var" and self.op(":"):
                e = ("haslabel", e, self.labels())
            else:
                return e

    def map_projection(self, e: tuple) -> tuple:
        self.need("{")
        entries = []
        while not self.op("}"):
            if self.take("."):
                entries.append(("*", None) if self.take("*") else ("prop", self.name()))
            else:
                key = self.name()
                entries.append(("key", key, self.expr()) if self.take(":") else ("key", key, ("var", key)))
            if not self.take(","):
                break
        self.need("}")
        return ("project", e, entries)

    def atom(self) -> tuple:
        kind, text, _ = self.token
        if kind == "num":
            return ("lit", self.number())
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "param":
            self.at += 1
            return ("param", text[1:])
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            return self.list_or_comprehension()
        if self.op("{"):
            return ("map", self.map_entries())
        if self.take_word("CASE"):
            return self.case()
        for w, v in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.word(w):
                self.at += 1
                return ("lit", v)
        if kind == "name" and text.lower() in ("any", "all", "none", "single") and self.tokens[self.at + 1][1] == "(":
            self.at += 2
            var = self.name()
            self.need_word("IN")
            xs = self.expr()
            self.need_word("WHERE")
            p = self.expr()
            self.need(")")
            return ("quantifier", text.lower(), var, xs, p)
        name = self.name()
        start = self.at
        dotted = name
        while self.op(".") and self.tokens[self.at + 1][0] == "name":
            self.at += 1
            dotted += "." + self.name()
        if self.op("(") and (dotted == name or dotted.split(".")[0] in ("vector", "genai", "db", "apoc", "gds")):
            self.need("(")
            distinct = self.take_word("DISTINCT")
            args = []
            if self.take("*"):
                args = [("star",)]
            while not self.op(")"):
                args.append(self.expr())
                if not self.take(","):
                    break
            self.need(")")
            return ("call", dotted, args, distinct)
        self.at = start
        return ("var", name)

    def list_or_comprehension(self) -> tuple:
        if self.token[0] in ("name", "quoted") and self.tokens[self.at + 1][0] == "name" and self.tokens[self.at + 1][1].upper() == "IN":
            mark = self.at
            var = self.name()
            self.need_word("IN")
            xs = self.expr()
            where = self.expr() if self.take_word("WHERE") else None
            body = self.expr() if self.take("|") else ("var", var)
            if self.take("]"):
                return ("comprehension", var, xs, where, body)
            self.at = mark
        items = []
        while not self.op("]"):
            items.append(self.expr())
            if not self.take(","):
                break
        self.need("]")
        return ("list", items)

    def case(self) -> tuple:
        subject = None if self.word("WHEN") else self.expr()
        branches = []
        while self.take_word("WHEN"):
            c = self.expr()
            self.need_word("THEN")
            branches.append((c, self.expr()))
        other = self.expr() if self.take_word("ELSE") else None
        self.need_word("END")
        return ("case", subject, branches, other)


def parse(text: str) -> Query:
    return Parser(text).parse()


def children(e: tuple):
    """Direct sub-expressions."""
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            yield x
        elif isinstance(x, list):
            for y in x:
                if isinstance(y, tuple):
                    if y and isinstance(y[0], str) and len(y) > 1 and y[0] in ("key",):
                        yield y[2]
                    elif y and isinstance(y[0], tuple):
                        yield from y
                    elif y and isinstance(y[0], str):
                        yield y
        elif isinstance(x, dict):
            yield from x.values()


def aggregates(e: tuple) -> list[tuple]:
    """The outermost aggregate calls in an expression."""
    if e[0] == "call" and e[1].lower() in AGGREGATES:
        return [e]
    return [a for c in children(e) for a in aggregates(c)]


def variables(e: tuple) -> set[str]:
    out = {e[1]} if e[0] == "var" else set()
    for c in children(e):
        out |= variables(c)
    return out - ({e[1]} if e[0] == "comprehension" else {e[2]} if e[0] == "quantifier" else set())
