"""Expression trees to Columns: one compiler for reads, writes and predicates.

Values stay JVM-side: every function is a built-in or a composition of them.
Decisions where dialects differ: `=` in WHERE is null-safe (null = null), inline
maps use plain equality; STARTS/ENDS WITH are literal; integer / integer is
integer division and x / 0 is null; size() works on lists and strings;
timestamp() is epoch seconds; toInteger/toFloat give null on bad text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.catalog import GraphError, suggest


@dataclass
class Element:
    """A bound node or relationship: columns by property, the ids in `_id`."""

    kind: str  # node, edge
    columns: dict[str, str]
    types: list[str]


@dataclass
class Value:
    column: str


@dataclass
class Path:
    """Edge ids and node ids of a path, as array columns."""

    edges: str
    nodes: str


#: Name of the variable that has the number of rows a row stands for, where a scope was counted before it is joined on.
WEIGHT = "_weight"


@dataclass
class Scope:
    frame: DataFrame
    vars: dict[str, Any] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    graph: Any = None
    null_safe: bool = True


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(v) -> Column:
    if isinstance(v, (list, tuple)):
        return F.array(*map(literal, v)) if v else F.array().cast("array<string>")
    if isinstance(v, dict):
        return F.struct(*(literal(x).alias(k) for k, x in v.items()))
    return F.lit(v)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Functions of plain Columns.
SIMPLE = {
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "sign": F.signum, "exp": F.exp, "log": F.log,
    "coalesce": F.coalesce, "rand": lambda: F.rand(), "datetime": F.current_timestamp, "timestamp": lambda: F.unix_timestamp(), "exists": lambda x: x.isNotNull(),
    "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.try_cast("boolean"), "tofloat": lambda x: x.try_cast("double"), "tointeger": lambda x: x.try_cast("double").try_cast("long"),
    "replace": lambda s, a, b: F.replace(s, a, b), "left": lambda s, n: F.left(s, n), "right": lambda s, n: F.right(s, n),
    "head": lambda xs: F.get(xs, F.lit(0)), "last": lambda xs: F.try_element_at(xs, F.lit(-1)), "range": lambda a, b, *s: F.sequence(a.cast("long"), b.cast("long"), *[x.cast("long") for x in s]),
    "vector.similarity": _cosine, "similarity": _cosine, "vector.distance": lambda a, b: 1 - _cosine(a, b), "vector.l2": l2,
    "vector.similarity.cosine": _cosine, "levenshtein": F.levenshtein,
}
OTHER = ("id", "elementid", "labels", "type", "length", "size", "substring", "split", "round", "keys", "nodes", "relationships", "startnode", "endnode", "genai.vector.encode", "count", "sum", "avg", "min", "max", "collect", "stdev", "percentile")


class Compiler:
    def __init__(self, scope: Scope, bound: dict[str, Column] | None = None, swapped: dict | None = None):
        self.scope, self.local, self.swapped = scope, bound or {}, swapped or {}

    def inner(self, **local) -> Compiler:
        return Compiler(self.scope, self.local | local, self.swapped)

    def type_of(self, c: Column) -> T.DataType | None:
        try:
            return self.scope.frame.select(c.alias("_")).schema[0].dataType
        except Exception:  # a lambda variable has no type outside its lambda
            return None

    def __call__(self, e: tuple) -> Column:
        if self.swapped and repr(e) in self.swapped:
            return self.swapped[repr(e)]
        return getattr(self, "on_" + e[0])(*e[1:])

    # atoms ---------------------------------------------------------------
    def on_lit(self, v):
        return literal(v)

    def on_param(self, name):
        if name not in self.scope.params:
            raise GraphError(f"parameter ${name} is not given", "missing_parameter", suggest(name, self.scope.params))
        return literal(self.scope.params[name])

    def on_var(self, name):
        if name in self.local:
            return self.local[name]
        v = self.scope.vars.get(name)
        if v is None:
            raise GraphError(f"variable {name!r} is not bound", "unbound", suggest(name, self.scope.vars))
        if isinstance(v, Element):
            return self.whole(v)
        if isinstance(v, Path):
            return F.struct(F.col(quoted(v.nodes)).alias("nodes"), F.col(quoted(v.edges)).alias("edges"))
        return F.col(quoted(v.column))

    def whole(self, v: Element) -> Column:
        """A whole element: its id, type and properties."""
        key = F.col(quoted(v.columns["_id"]))
        parts = [key.alias("_id"), self.type_name(v).alias("_type")]
        parts += [F.col(quoted(v.columns[c])).alias(c) for c in ("_src", "_dst") if c in v.columns]
        parts += [F.col(quoted(c)).alias(p) for p, c in v.columns.items() if not p.startswith("_")]
        return F.when(key.isNotNull(), F.struct(*parts))

    def type_name(self, v: Element) -> Column:
        if "_type" in v.columns:
            return F.col(quoted(v.columns["_type"]))
        from quiver.ids import id_type

        out = F.lit(None).cast("string")
        number = id_type(F.col(quoted(v.columns["_id"])))
        for t in v.types:
            out = F.when(number == self.scope.graph.catalog.types[t].type_id, t).otherwise(out)
        return out

    def on_prop(self, e, name):
        if e[0] == "var" and e[1] not in self.local:
            v = self.scope.vars.get(e[1])
            if isinstance(v, Element):
                if name in v.columns:
                    return F.col(quoted(v.columns[name]))
                if "_ext" in v.columns:
                    return F.col(quoted(v.columns["_ext"]))[name]
                return F.lit(None)
        c = self(e)
        kind = self.type_of(c)
        if isinstance(kind, T.StructType) and name not in kind.names:
            return F.lit(None)
        return c.getField(name)

    def on_haslabel(self, e, groups):
        v = self.scope.vars.get(e[1])
        if not isinstance(v, Element):
            raise GraphError(f"{e[1]!r} is no node", "unbound")
        kind = "entity" if v.kind == "node" else "relation"
        return self.type_name(v).isin(self.scope.graph.catalog.resolve(groups, kind) or [""])

    # operators -----------------------------------------------------------
    def on_not(self, e):
        return ~self(e)

    def on_neg(self, e):
        return -self(e)

    def on_isnull(self, e, negated):
        v = self.scope.vars.get(e[1]) if e[0] == "var" else None
        c = F.col(quoted(v.columns["_id"])) if isinstance(v, Element) else self(e)
        return c.isNotNull() if negated else c.isNull()

    def _ids(self, a, b):
        """Elements compare by id."""
        out = []
        for e in (a, b):
            v = self.scope.vars.get(e[1]) if e[0] == "var" and e[1] not in self.local else None
            out.append(F.col(quoted(v.columns["_id"])) if isinstance(v, Element) else self(e))
        return out

    def on_bin(self, o, a, b):
        x, y = self._ids(a, b) if o in ("=", "<>") else (self(a), self(b))
        if o == "=":
            return x.eqNullSafe(y) if self.scope.null_safe else x == y
        if o == "<>":
            return ~x.eqNullSafe(y) if self.scope.null_safe else x != y
        simple = {
            "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "AND": lambda: x & y, "OR": lambda: x | y, "XOR": lambda: x.cast("boolean") != y.cast("boolean"),
            "STARTS": lambda: x.startswith(y), "ENDS": lambda: x.endswith(y), "CONTAINS": lambda: F.contains(x, y), "=~": lambda: F.rlike(x, y),
            "-": lambda: x - y, "*": lambda: x * y, "%": lambda: F.try_mod(x, y), "^": lambda: F.pow(x, y), "||": lambda: F.concat(x.cast("string"), y.cast("string")),
        }
        if o in simple:
            return simple[o]()
        left, right = self.type_of(x), self.type_of(y)
        if o == "/":
            if isinstance(left, _INTEGRAL) and isinstance(right, _INTEGRAL):
                return F.when(y != 0, F.call_function("div", x, y))
            return F.try_divide(x, y)
        if isinstance(left, T.ArrayType) or isinstance(right, T.ArrayType):
            return F.concat(x if isinstance(left, T.ArrayType) else F.array(x), y if isinstance(right, T.ArrayType) else F.array(y))
        if isinstance(left, T.StringType) or isinstance(right, T.StringType):
            return F.concat(x.cast("string"), y.cast("string"))
        return x + y

    def on_in(self, e, xs):
        return F.array_contains(self(xs), self(e)) if xs[0] != "list" else self(e).isin(*[self(x) for x in xs[1]]) if xs[1] else F.lit(False)

    def on_case(self, subject, branches, other):
        out = None
        for c, v in branches:
            cond = self(c) if subject is None else self(subject) == self(c)
            out = F.when(cond, self(v)) if out is None else out.when(cond, self(v))
        return out if other is None else out.otherwise(self(other))

    # lists and maps ------------------------------------------------------
    def on_list(self, items):
        return F.array(*map(self, items))

    def on_map(self, entries):
        return F.struct(*(self(v).alias(k) for k, v in entries.items()))

    def on_project(self, e, entries):
        v = self.scope.vars.get(e[1])
        fields: dict[str, Column] = {}
        for x in entries:
            if x[0] == "*":
                fields |= {p: F.col(quoted(c)) for p, c in v.columns.items() if not p.startswith("_")} if isinstance(v, Element) else {}
            elif x[0] == "prop":
                fields[x[1]] = self.on_prop(e, x[1])
        fields |= {x[1]: self(x[2]) for x in entries if x[0] == "key"}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    def on_index(self, xs, i):
        c, at = self(xs), self(i)
        kind = self.type_of(c)
        if isinstance(kind, (T.StructType, T.MapType)):
            return c.getField(i[1])
        at = at.cast("int")
        return F.when(at < 0, F.try_element_at(c, F.when(at < 0, at).otherwise(-1))).otherwise(F.get(c, at))

    def on_comprehension(self, var, xs, where, body):
        c = self(xs)
        if where is not None:
            c = F.filter(c, lambda x: F.coalesce(self.inner(**{var: x})(where), F.lit(False)))
        return c if body == ("var", var) else F.transform(c, lambda x: self.inner(**{var: x})(body))

    def on_quantifier(self, kind, var, xs, p):
        c, test = self(xs), lambda x: F.coalesce(self.inner(**{var: x})(p), F.lit(False))
        if kind == "any":
            return F.exists(c, test)
        if kind == "none":
            return ~F.exists(c, test)
        if kind == "all":
            return F.forall(c, test)
        return F.size(F.filter(c, test)) == 1

    # functions -----------------------------------------------------------
    def on_call(self, name, args, distinct=False):
        f = name.lower()
        v = self.scope.vars.get(args[0][1]) if args and args[0][0] == "var" and args[0][1] not in self.local else None
        if f in ("id", "elementid", "type", "labels", "keys", "startnode", "endnode") and isinstance(v, Element):
            key = F.col(quoted(v.columns["_id"]))
            if f in ("id", "elementid"):
                return key if f == "id" else key.cast("string")
            if f in ("startnode", "endnode"):
                return F.col(quoted(v.columns["_src" if f == "startnode" else "_dst"]))
            if f == "type":
                return self.type_name(v)
            if f == "labels":
                out = F.array().cast("array<string>")
                for t in v.types:
                    out = F.when(self.type_name(v) == t, F.array(*(F.lit(s) for s in sorted(self.scope.graph.catalog.supertypes(t))))).otherwise(out)
                return F.when(key.isNotNull(), out)
            return F.array_compact(F.array(*(F.when(F.col(quoted(c)).isNotNull(), F.lit(p)) for p, c in sorted(v.columns.items()) if not p.startswith("_"))))
        if isinstance(v, Path) and f in ("nodes", "relationships", "length"):
            return F.col(quoted(v.nodes)) if f == "nodes" else F.col(quoted(v.edges)) if f == "relationships" else F.size(F.col(quoted(v.edges)))
        cols = [self(a) for a in args]
        if f in SIMPLE:
            return SIMPLE[f](*cols)
        if f in ("length", "size"):
            return F.size(cols[0]) if isinstance(self.type_of(cols[0]), (T.ArrayType, T.MapType)) else F.length(cols[0])
        if f == "substring":
            start = cols[1].cast("int") + 1
            return F.substring(cols[0], start, cols[2].cast("int") if len(cols) > 2 else F.length(cols[0]))
        if f == "split":
            return F.split(cols[0], re.escape(args[1][1]) if args[1][0] == "lit" else F.concat(F.lit("\\Q"), cols[1], F.lit("\\E")))
        if f == "round":
            digits = args[1][1] if len(args) > 1 else 0
            return F.round(cols[0], digits)
        if f == "keys":
            kind = self.type_of(cols[0])
            if isinstance(kind, T.MapType):
                return F.map_keys(cols[0])
            return F.array(*(F.lit(n) for n in sorted(kind.names))) if isinstance(kind, T.StructType) else F.json_object_keys(cols[0])
        if f == "genai.vector.encode":
            encoder = getattr(self.scope.graph, "encoder", None)
            if encoder is None:
                raise GraphError("genai.vector.encode is disabled; give the graph an encoder", "disabled")
            return encoder(cols[0])
        raise GraphError(f"unknown function {name!r}; supported: {', '.join(sorted([*SIMPLE, *OTHER]))}", "unknown_function", suggest(f, [*SIMPLE, *OTHER]))

    def aggregate(self, e: tuple) -> Column:
        """An aggregate call to an aggregate Column; sum of nothing is 0, collect drops nulls."""
        _, name, args, distinct = e
        f = name.lower()
        weight = self.scope.vars.get(WEIGHT)  # the number of rows that a row stands for
        if not args or args[0] == ("star",):
            return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(quoted(weight.column)), F.lit(0).cast("long"))
        v = self.scope.vars.get(args[0][1]) if args[0][0] == "var" and args[0][1] not in self.local else None
        c = F.col(quoted(v.columns["_id"])) if isinstance(v, Element) and f == "count" else self(args[0])
        if f == "count":
            if weight is not None and not distinct:
                return F.coalesce(F.sum(F.when(c.isNotNull(), F.col(quoted(weight.column)))), F.lit(0).cast("long"))
            return F.count_distinct(c) if distinct else F.count(c)
        if f == "collect":
            return F.collect_set(c) if distinct else F.collect_list(c)
        if f in ("sum", "avg"):
            out = (F.sum_distinct(c) if distinct else F.sum(c)) if f == "sum" else F.avg(c) if not distinct else F.aggregate(F.collect_set(c), F.lit(0.0), lambda s, x: s + x) / F.count_distinct(c)
            return F.coalesce(out, F.lit(0)) if f == "sum" else out
        if f in ("percentile", "percentilecont"):
            return F.percentile(c, self(args[1]))
        return {"min": F.min, "max": F.max, "stdev": F.stddev_samp}[f](c)
