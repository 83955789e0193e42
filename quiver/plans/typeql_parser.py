"""TypeQL text to a tree of stages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quiver.catalog import GraphError

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<var>\$[\w-]+)
    |(?P<ann>@[\w-]+)
    |(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<time>\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?)?)
    |(?P<num>\d+\.\d+|\d+)
    |(?P<name>[^\W\d](?:[\w]|-(?=\w))*!?)
    |(?P<op>==|!=|<=|>=|->|\.\.|[-+*/%<>=(){}\[\],;:.?])""",
    re.X,
)
COMPARE = ("==", "!=", "<=", ">=", "<", ">", "like", "contains")
REDUCERS = ("count", "sum", "max", "min", "mean", "median", "std", "list")


@dataclass
class Statement:
    kind: str  # isa, has, rel, compare, let, not, or, sub, label, is
    args: dict


@dataclass
class Stage:
    kind: str
    args: dict = field(default_factory=dict)


def tokenize(text: str):
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphError(f"unexpected {text[at]!r} at {at}", "syntax")
        if m.lastgroup:
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, ("end", "", len(text))]


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at, self.anonymous = text, tokenize(text), 0, 0

    @property
    def token(self):
        return self.tokens[self.at]

    def fail(self, wanted: str):
        raise GraphError(f"expected {wanted}, got {self.token[1] or 'the end'!r} at {self.token[2]}", "syntax")

    def is_(self, *texts: str) -> bool:
        return self.token[0] in ("name", "op") and self.token[1] in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(repr(text))

    def next(self, *kinds: str) -> str:
        if self.token[0] not in kinds:
            self.fail(" or ".join(kinds))
        self.at += 1
        return self.tokens[self.at - 1][1]

    def var(self) -> str:
        return self.next("var")[1:]

    def fresh(self) -> str:
        self.anonymous += 1
        return f"_{self.anonymous}"

    # stages --------------------------------------------------------------
    def query(self) -> list[Stage]:
        stages = []
        while self.token[0] != "end":
            word = self.next("name")
            if word == "end":
                self.take(";")
                continue
            if word in ("define", "redefine"):
                stages.append(self.define())
            elif word == "undefine":
                raise GraphError("undefine is not supported", "unsupported")
            elif word in ("get", "rule"):
                raise GraphError(f"{word!r} is of an older language version", "unsupported")
            elif word == "with":
                raise GraphError("functions are stored, not called", "unsupported")
            elif word in ("match", "insert", "put", "update", "delete"):
                stages.append(Stage(word, {"patterns": self.patterns() if word != "delete" else self.deletions()}))
            elif word == "select":
                names = [self.var()]
                while self.take(","):
                    names.append(self.var())
                stages.append(Stage("select", {"vars": names}))
                self.take(";")
            elif word == "distinct":
                stages.append(Stage("distinct"))
                self.take(";")
            elif word in ("limit", "offset"):
                stages.append(Stage(word, {"n": int(self.next("num"))}))
                self.take(";")
            elif word == "sort":
                keys = []
                while True:
                    v = self.var()
                    keys.append((v, self.take("desc") or not (self.take("asc") or True)))
                    if not self.take(","):
                        break
                stages.append(Stage("sort", {"keys": keys}))
                self.take(";")
            elif word == "reduce":
                stages.append(self.reduce())
            elif word == "fetch":
                stages.append(Stage("fetch", {"doc": self.document()}))
                self.take(";")
            elif word == "fun":
                stages.append(self.function())
            else:
                raise GraphError(f"unknown stage {word!r}", "syntax")
        return stages

    def reduce(self) -> Stage:
        items, groups = [], []
        while True:
            target = self.var()
            self.need("=")
            f = self.next("name")
            if f not in REDUCERS:
                raise GraphError(f"unknown reducer {f!r}; supported: {', '.join(REDUCERS)}", "unknown_function")
            source = None
            if self.take("("):
                source = self.var()
                self.need(")")
            items.append((target, f, source))
            if not self.take(","):
                break
        if self.take("groupby"):
            groups.append(self.var())
            while self.take(","):
                groups.append(self.var())
        self.take(";")
        return Stage("reduce", {"items": items, "groups": groups})

    def function(self) -> Stage:
        start = self.tokens[self.at - 1][2]
        name = self.next("name")
        while self.token[0] != "end" and not self.take("return"):
            self.at += 1
        while self.token[0] != "end" and not self.take(";"):
            self.at += 1
        return Stage("fun", {"name": name, "body": self.text[start : self.token[2] if self.token[0] != "end" else len(self.text)].strip()})

    def document(self) -> dict:
        self.need("{")
        out = {}
        while not self.is_("}"):
            key = self.next("str", "name")
            key = key[1:-1] if key[0] in "\"'" else key
            self.need(":")
            if self.is_("{"):
                out[key] = ("doc", self.document())
            elif self.take("["):
                if self.is_("match"):
                    sub = Parser.__new__(Parser)
                    sub.text, sub.tokens, sub.at, sub.anonymous = self.text, self.tokens, self.at, self.anonymous + 100
                    stages = []
                    while not sub.is_("]"):
                        stages += sub.one_stage()
                    self.at, self.anonymous = sub.at, sub.anonymous
                    out[key] = ("fetch", stages)
                else:
                    v = self.var()
                    self.need(".")
                    out[key] = ("list", v, self.next("name"))
                self.need("]")
            else:
                out[key] = ("expr", self.expression())
            if not self.take(","):
                break
        self.need("}")
        return out

    def one_stage(self) -> list[Stage]:
        """The next stage of a nested query; its end is the closing bracket."""
        mark = self.at
        depth, at = 0, self.at
        while not (depth == 0 and self.tokens[at][1] == "]"):
            depth += {"[": 1, "{": 1, "(": 1, "]": -1, "}": -1, ")": -1}.get(self.tokens[at][1], 0)
            at += 1
        part = Parser.__new__(Parser)
        part.text, part.at, part.anonymous = self.text, 0, self.anonymous
        part.tokens = [*self.tokens[mark:at], ("end", "", self.tokens[at][2])]
        stages = part.query()
        self.at = at
        return stages

    # patterns ------------------------------------------------------------
    def patterns(self) -> list[Statement]:
        out: list[Statement] = []
        while self.token[0] == "var" or self.is_("not", "let", "(", "{") or (self.token[0] == "name" and self.tokens[self.at + 1][1] == "("):
            out += self.statement()
            self.take(";")
        return out

    def block(self) -> list[Statement]:
        self.need("{")
        out = self.patterns()
        self.need("}")
        return out

    def statement(self) -> list[Statement]:
        if self.take("not"):
            return [Statement("not", {"body": self.block()})]
        if self.is_("{"):
            branches = [self.block()]
            while self.take("or"):
                branches.append(self.block())
            return [Statement("or", {"branches": branches})]
        if self.take("let"):
            v = self.var()
            self.need("=")
            return [Statement("let", {"var": v, "expr": self.expression()})]
        if self.is_("(") or self.token[0] == "name":
            relation = self.next("name") if self.token[0] == "name" else None
            v = self.fresh()
            out = [Statement("rel", {"var": v, "type": relation, "players": self.players()})]
            if self.take("isa", "isa!"):
                exact = self.tokens[self.at - 1][1] == "isa!"
                out.append(Statement("isa", {"var": v, "type": self.next("name", "var"), "exact": exact}))
            return out + self.constraints(v)
        v = self.var()
        for op in COMPARE:
            if self.take(op):
                return [Statement("compare", {"left": ("var", v), "op": op, "right": self.expression()})]
        if self.token[0] == "op" and self.token[1] in "+-*/%":
            left = self.expression_from(("var", v))
            op = self.next("op", "name")
            return [Statement("compare", {"left": left, "op": op, "right": self.expression()})]
        return self.constraints(v)

    def constraints(self, v: str) -> list[Statement]:
        out = []
        while True:
            if self.take("isa", "isa!"):
                exact = self.tokens[self.at - 1][1] == "isa!"
                kind = self.next("name", "var")
                out.append(Statement("isa", {"var": v, "type": kind, "exact": exact}))
                if self.is_("("):
                    out.append(Statement("rel", {"var": v, "type": None, "players": self.players()}))
                elif self.token[0] in ("str", "num", "time") or self.is_("true", "false"):
                    out.append(Statement("compare", {"left": ("var", v), "op": "==", "right": self.expression()}))
            elif self.take("has"):
                out += self.has(v)
            elif self.take("links"):
                out.append(Statement("rel", {"var": v, "type": None, "players": self.players()}))
            elif self.take("sub", "sub!"):
                exact = self.tokens[self.at - 1][1] == "sub!"
                out.append(Statement("sub", {"var": v, "type": self.next("name"), "exact": exact}))
            elif self.take("label"):
                out.append(Statement("label", {"var": v, "type": self.next("name")}))
            elif self.take("is"):
                out.append(Statement("is", {"var": v, "other": self.var()}))
            else:
                return out
            self.take(",")

    def has(self, v: str) -> list[Statement]:
        if self.token[0] == "var":
            raise GraphError("has needs an attribute type: has T $v", "syntax")
        kind = self.next("name")
        if self.token[0] == "var":
            return [Statement("has", {"var": v, "type": kind, "attr": self.var()})]
        op = next((o for o in COMPARE if self.take(o)), "==")
        a = self.fresh()
        return [Statement("has", {"var": v, "type": kind, "attr": a}), Statement("compare", {"left": ("var", a), "op": op, "right": self.expression()})]

    def players(self) -> list[tuple[str | None, str]]:
        self.need("(")
        out = []
        while not self.is_(")"):
            if self.token[0] == "name":
                role = self.next("name")
                self.need(":")
                out.append((role, self.var()))
            else:
                out.append((None, self.var()))
            if not self.take(","):
                break
        self.need(")")
        return out

    def deletions(self) -> list:
        out = []
        while self.token[0] == "var" or self.is_("has", "links"):
            if self.take("has"):
                attr = self.var()
                self.need("of")
                out.append(("has", attr, self.var()))
            elif self.take("links"):
                players = self.players()
                self.need("of")
                out.append(("links", players, self.var()))
            else:
                out.append(("thing", self.var()))
            self.take(";")
        return out

    # expressions ---------------------------------------------------------
    def expression(self):
        return self._sum(None)

    def expression_from(self, first):
        return self._sum(first)

    def _sum(self, first):
        e = self._product(first)
        while self.is_("+", "-"):
            e = (self.next("op"), e, self._product(None))
        return e

    def _product(self, first):
        e = first or self._atom()
        while self.is_("*", "/", "%"):
            e = (self.next("op"), e, self._atom())
        return e

    def _atom(self):
        kind, text, _ = self.token
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("-"):
            return ("-", ("lit", 0), self._atom())
        self.at += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "num":
            return ("lit", float(text) if "." in text else int(text))
        if kind == "time":
            return ("time", text)
        if kind == "var":
            if self.is_(".") and self.tokens[self.at + 1][0] == "name":
                self.take(".")
                return ("attr", text[1:], self.next("name"))
            return ("var", text[1:])
        if text in ("true", "false"):
            return ("lit", text == "true")
        if kind == "name" and self.take("("):
            args = []
            while not self.is_(")"):
                args.append(self.expression())
                if not self.take(","):
                    break
            self.need(")")
            return ("call", text, args)
        self.at -= 1
        self.fail("an expression")

    # schema --------------------------------------------------------------
    def annotations(self) -> dict:
        out = {}
        while self.token[0] == "ann":
            name, args = self.next("ann")[1:], []
            if self.take("("):
                while not self.take(")"):
                    kind, text, _ = self.token
                    self.at += 1
                    if text not in (",",):
                        args.append(text[1:-1] if kind == "str" else (float(text) if "." in text else int(text)) if kind == "num" else text)
            out[name] = args
        return out

    def define(self) -> Stage:
        out = []
        while self.token[0] == "name" and self.token[1] not in ("match", "insert", "end"):
            kind = self.next("name")
            if kind == "fun":
                out.append(self.function())
                continue
            name = self.next("name") if kind in ("entity", "relation", "attribute") else kind
            item = {"kind": kind if name != kind else None, "name": name, "annotations": self.annotations(), "sub": None, "value": None, "owns": [], "relates": [], "plays": []}
            self.take(",")
            while not self.take(";"):
                word = self.next("name")
                if word == "sub":
                    item["sub"] = self.next("name")
                elif word == "value":
                    item["value"] = (self.next("name"), self.annotations())
                elif word == "owns":
                    owned = self.next("name")
                    many = self.take("[") and (self.take("]") or True)
                    item["owns"].append((owned, self.annotations() | ({"card": [0, "..", None]} if many else {})))
                elif word == "relates":
                    role = self.next("name")
                    if self.take("["):
                        self.need("]")
                    special = self.next("name") if self.take("as") else None
                    item["relates"].append((role, special, self.annotations()))
                elif word == "plays":
                    relation = self.next("name")
                    self.need(":")
                    item["plays"].append((relation, self.next("name"), self.annotations()))
                else:
                    self.fail("sub, value, owns, relates or plays")
                item["annotations"] |= self.annotations()
                self.take(",")
            out.append(item)
        return Stage("define", {"items": out})


def parse(text: str) -> list[Stage]:
    return Parser(text).query()


def script(text: str) -> list[list[Stage]]:
    """Blocks of a script: each starts at define, insert, put, or a match after a finished block."""
    blocks: list[list[Stage]] = []
    for s in parse(text):
        fresh = s.kind in ("define", "fun") or not blocks or (s.kind in ("match", "insert", "put") and blocks[-1][-1].kind in ("define", "insert", "put", "update", "delete", "fetch", "fun") and not (s.kind in ("insert", "put") and blocks[-1][-1].kind == "match"))
        if fresh:
            blocks.append([])
        blocks[-1].append(s)
    return blocks
