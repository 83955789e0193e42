"""Cypher to DataFrames.

Each clause turns a scope (a frame and the variables bound in it) into the next.
A pattern is a chain of equi-joins of label and edge views; Catalyst chooses the
join strategies, pushes filters into the scans and prunes columns.  Three
rewrites need the catalog and happen here: labels to concrete types, an
anonymous end that needs no scan, and trails to reachability where the number of
paths cannot be seen in the result.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver.catalog import GraphError
from quiver.functions.expressions import WEIGHT, Compiler, Element, Path, Scope, Value, quoted
from quiver.graph import BOTH, Graph, turned
from quiver.operators import traverse
from quiver.plans import cypher_parser as ast

WRITES = (ast.Create, ast.Merge, ast.SetClause, ast.Remove, ast.Delete, ast.Ddl)
_plans: OrderedDict = OrderedDict()


def parsed(graph: Graph, text: str) -> ast.Query:
    key = (id(graph.catalog), graph.catalog.version, text)
    if key not in _plans:
        _plans[key] = ast.parse(text)
        if len(_plans) > 512:
            _plans.popitem(last=False)
    return _plans[key]


def is_write(q: ast.Query) -> bool:
    return any(isinstance(c, WRITES) for c in q.clauses) or (q.union is not None and is_write(q.union[1]))


def weighed(a: tuple) -> bool:
    """An aggregate that can be had from rows that stand for several."""
    name = a[1].lower()
    return name in ("count", "min", "max") or (name == "collect" and bool(a[3]))


def asked(e: tuple, props: dict) -> None:
    """Add the properties of each variable that an expression reads; None where it reads the whole."""
    if e[0] == "prop" and e[1][:1] == ("var",):
        have = props.setdefault(e[1][1], set())
        if have is not None:
            have.add(e[2])
        return
    if e[0] == "call" and e[1].lower() == "count" and e[2] and e[2][0][0] == "var":
        props.setdefault(e[2][0][1], set())
        return
    if e[0] == "var":
        props[e[1]] = None
    for v in ast.variables(e) if e[0] in ("comprehension", "quantifier") else ():
        props[v] = None
    for c in ast.children(e):
        asked(c, props)


class Reader:
    def __init__(self, graph: Graph, params: dict | None = None, null_safe: bool = True):
        self.graph, self.params, self.null_safe, self.names = graph, params or {}, null_safe, 0

    def fresh(self, base: str = "_v") -> str:
        self.names += 1
        return f"{base}{self.names}"

    def scope(self, frame: DataFrame, variables: dict) -> Scope:
        return Scope(frame, variables, self.params, self.graph, self.null_safe)

    def start(self) -> Scope:
        return self.scope(self.graph.spark.range(1).select(F.lit(1).alias("_unit")), {})

    # query ---------------------------------------------------------------
    def run(self, q: ast.Query) -> DataFrame:
        scope = self.start()
        for i, c in enumerate(q.clauses):
            scope = self.clause(scope, c, q.clauses[i + 1 :])
        out = scope.frame
        if q.union:
            other = self.run(q.union[1])
            if sorted(out.columns) != sorted(other.columns):
                raise GraphError(f"UNION needs equal columns: {out.columns} and {other.columns}", "union")
            out = out.unionByName(other)
            if q.union[0] == "distinct":
                out = out.distinct()
        return out

    def clause(self, scope: Scope, c, later) -> Scope:
        if isinstance(c, ast.Match):
            return self.match(self.gathered(scope, c, later), c, self.blind(c, later))
        if isinstance(c, ast.Unwind):
            name = self.fresh("_u")
            column = Compiler(scope)(c.expr)
            return self.scope(scope.frame.select("*", F.explode(column).alias(name)), scope.vars | {c.var: Value(name)})
        if isinstance(c, ast.Projection):
            return self.project(scope, c)
        if isinstance(c, ast.Call):
            from quiver.operators.procedures import call

            return call(self, scope, c)
        raise GraphError(f"{type(c).__name__} is no read clause", "write")

    @staticmethod
    def blind(match: ast.Match, later) -> bool:
        """Nothing that follows can see how many paths lead to a row."""
        if not later or not isinstance(later[0], ast.Projection):
            return False
        p = later[0]
        if p.items is None:
            return False
        used = [a for i in p.items for a in ast.aggregates(i.expr)]
        if not used:
            return p.distinct
        return all(a[1].lower() in ("min", "max") or (a[1].lower() in ("count", "collect") and a[3] and a[2] and a[2][0] != ("star",)) for a in used)

    def gathered(self, scope: Scope, match: ast.Match, later) -> Scope:
        """The scope by what is still asked for, each row with the number of rows that it stands for.

        Two patterns that meet in a node would be joined pair by pair only for the
        pairs to be counted; so the first is counted before it meets the second.
        """
        rest, p = [match], None
        for c in later:
            if not isinstance(c, ast.Match):
                p = c
                break
            rest.append(c)
        if not scope.vars or not isinstance(p, ast.Projection) or p.items is None or any(m.optional for m in rest):
            return scope
        shown = [i.expr for i in p.items] + [e for e, _ in p.order]
        used = [a for e in shown for a in ast.aggregates(e)]
        if not used or not all(weighed(a) for a in used):
            return scope
        props: dict[str, set | None] = {}  # None: the whole element
        for e in [*shown, *([p.where] if p.where else []), *(m.where for m in rest if m.where)]:
            asked(e, props)
        for path in (x for m in rest for x in m.patterns):
            for x in (*path.nodes, *path.edges):
                if x.var:
                    props.setdefault(x.var, set())
                    if props[x.var] is not None:
                        props[x.var] |= set(x.props)
                for e in x.props.values():
                    asked(e, props)
            if path.var:
                props[path.var] = None
        kept = {v: scope.vars[v] for v in props if v in scope.vars}
        if any(not isinstance(v, Element) or props[k] is None for k, v in kept.items()) or not set(scope.vars) - set(kept) - {WEIGHT}:
            return scope
        # Ids and the properties asked for are the keys, so rows that share an id by fault stay apart.
        slim = {k: Element(v.kind, {c: n for c, n in v.columns.items() if c in props[k] or c.startswith("_")}, v.types) for k, v in kept.items()}
        keys = [quoted(n) for v in slim.values() for n in v.columns.values()]
        kinds = [scope.frame.schema[n].dataType for v in slim.values() for n in v.columns.values()]
        if any(isinstance(t, (T.MapType, T.VariantType)) for t in kinds):
            return scope
        rows = F.sum(quoted(scope.vars[WEIGHT].column)) if WEIGHT in scope.vars else F.count(F.lit(1))
        frame = scope.frame.groupBy(*keys).agg(rows.alias(WEIGHT)).filter(F.col(WEIGHT) > 0)
        return self.scope(frame, slim | {WEIGHT: Value(WEIGHT)})

    # patterns ------------------------------------------------------------
    def node_scan(self, scope: Scope, p: ast.NodePattern, var: str) -> tuple[DataFrame, Element]:
        types = self.graph.catalog.resolve(p.labels)
        view = self.graph.view(types)
        frame = view.select(*(F.col(quoted(c)).alias(f"{var}.{c}") for c in view.columns))
        element = Element("node", {c: f"{var}.{c}" for c in view.columns}, types)
        inner = self.scope(frame, {var: element})
        return self.inline(inner, var, p.props).frame, element

    def inline(self, scope: Scope, var: str, props: dict) -> Scope:
        """{k: v} in a pattern: plain equality, so null never matches."""
        compiler = Compiler(scope)
        for k, e in props.items():
            if not ast.variables(e):
                scope = self.scope(scope.frame.filter(compiler.on_prop(("var", var), k) == Compiler(scope)(e)), scope.vars)
        return scope

    def late_props(self, scope: Scope, var: str, props: dict) -> Scope:
        for k, e in props.items():
            if ast.variables(e):
                compiler = Compiler(scope)
                scope = self.scope(scope.frame.filter(compiler.on_prop(("var", var), k) == compiler(e)), scope.vars)
        return scope

    def bind_node(self, scope: Scope, p: ast.NodePattern, key: Column | None, needed: bool) -> tuple[Scope, str]:
        """Join a node to the scope; key: its id if an edge leads to it."""
        var = p.var or self.fresh("_n")
        have = scope.vars.get(var)
        if isinstance(have, Element):
            mine = F.col(quoted(have.columns["_id"]))
            frame = scope.frame if key is None else scope.frame.filter(mine == key)
            if p.labels:
                types = self.graph.catalog.resolve(p.labels)
                frame = frame.filter(Compiler(scope).type_name(have).isin(types or [""]))
            out = self.inline(self.scope(frame, scope.vars), var, p.props)
            return self.late_props(out, var, p.props), var
        if isinstance(have, Value):  # a whole node carried as a value: join it by its id
            inner = ast.NodePattern(self.fresh("_n"), p.labels, p.props)
            same = F.col(quoted(have.column))["_id"]
            out, name = self.bind_node(scope, inner, same, True)
            return self.scope(out.frame if key is None else out.frame.filter(same == key), out.vars | {var: out.vars[name]}), var
        if key is not None and not needed and not p.labels and not p.props and not self.graph.catalog.policies:
            name = f"{var}._id"
            return self.scope(scope.frame.withColumn(name, key), scope.vars | {var: Element("node", {"_id": name}, self.graph.node_types())}), var
        frame, element = self.node_scan(scope, p, var)
        if key is not None:
            joined = scope.frame.join(frame, key == F.col(quoted(element.columns["_id"])))
        elif scope.frame.columns != ["_unit"]:
            joined = scope.frame.crossJoin(frame)
        else:
            joined = frame
        out = self.scope(joined, scope.vars | {var: element})
        return self.late_props(out, var, p.props), var

    def match(self, scope: Scope, m: ast.Match, blind: bool) -> Scope:
        if m.optional:
            return self.optional(scope, m)
        singles: list[tuple[str, set]] = []
        for path in m.patterns:
            scope = self.path(scope, path, m, blind, singles)
        frame = scope.frame
        for i, (a, ta) in enumerate(singles):  # no edge twice in one MATCH
            for b, tb in singles[:i]:
                if ta & tb:
                    frame = frame.filter(F.col(quoted(a)) != F.col(quoted(b)))
        scope = self.scope(frame, scope.vars)
        if m.where is not None:
            scope = self.scope(scope.frame.filter(Compiler(scope)(m.where)), scope.vars)
        return scope

    def path(self, scope: Scope, path: ast.PathPattern, m: ast.Match, blind: bool, singles: list) -> Scope:
        used = set().union(*(ast.variables(e) for n in path.nodes for e in n.props.values()), set()) | (ast.variables(m.where) if m.where else set())
        scope, here = self.bind_node(scope, path.nodes[0], None, True)
        edge_parts, node_parts = [], [F.array(F.col(quoted(scope.vars[here].columns["_id"])))]
        for e, n in zip(path.edges, path.nodes[1:]):
            key = F.col(quoted(scope.vars[here].columns["_id"]))
            types = self.graph.catalog.resolve([e.types] if e.types else [], "relation")
            var = e.var or self.fresh("_r")
            if e.hops is None:
                if e.var and isinstance(scope.vars.get(e.var), Element):
                    raise GraphError(f"relationship {e.var!r} is bound already", "rebound")
                view = turned(self.graph.view(types, edges=True), e.direction)
                frame = view.select(*(F.col(quoted(c)).alias(f"{var}.{c}") for c in view.columns))
                element = Element("edge", {c: f"{var}.{c}" for c in view.columns}, types)
                frame = self.inline(self.scope(frame, {var: element}), var, e.props).frame
                scope = self.scope(scope.frame.join(frame, key == F.col(quoted(f"{var}._src"))), scope.vars | {var: element})
                scope = self.late_props(scope, var, e.props)
                singles.append((f"{var}._id", set(types)))
                far = F.col(quoted(f"{var}._dst"))
                edge_parts.append(F.array(F.col(quoted(f"{var}._id"))))
            else:
                scope, far, ids, nodes = self.hops(scope, e, types, here, var, n, blind and not e.var and not path.var)
                if ids is not None:
                    edge_parts.append(ids)
                    node_parts.append(nodes)
            seen = n.var is not None
            scope, here = self.bind_node(scope, n, far, seen or (n.var in used))
            if e.hops is None:
                node_parts.append(F.array(F.col(quoted(scope.vars[here].columns["_id"]))))
        if path.var:
            a, b = f"{path.var}.edges", f"{path.var}.nodes"
            edges = F.concat(*edge_parts) if edge_parts else F.array().cast("array<long>")
            scope = self.scope(scope.frame.withColumn(a, edges).withColumn(b, F.concat(*node_parts)), scope.vars | {path.var: Path(a, b)})
        return scope

    def hops(self, scope: Scope, e: ast.EdgePattern, types: list[str], here: str, var: str, end: ast.NodePattern, blind: bool):
        low, high = e.hops
        view = self.graph.view(types, edges=True)
        if e.props:
            element = Element("edge", {c: c for c in view.columns}, types)
            view = self.inline(self.scope(view, {var: element}), var, e.props).frame
        edges = turned(self.graph.visible(view.select("_id", "_src", "_dst")), e.direction)
        key = scope.vars[here].columns["_id"]
        if blind and low <= 1:
            # Only distinct ends are seen: reachability, whose cost does not grow with the paths.
            top = high if high is not None else traverse.MAX_HOPS
            starts = scope.frame.select(F.col(quoted(key)).alias("_id")).distinct()
            found = traverse.ends(starts, edges, low, top, e.direction == BOTH).select(F.col("start").alias(f"{var}.from"), F.col("node").alias(f"{var}.to"))
            frame = scope.frame.join(found, F.col(quoted(key)) == F.col(quoted(f"{var}.from")))
            return self.scope(frame, scope.vars), F.col(quoted(f"{var}.to")), None, None
        frame = traverse.trails(scope.frame, edges, low, high, quoted(key))
        renamed = frame.select(*(quoted(c) for c in scope.frame.columns), F.col("_end").alias(f"{var}.to"), F.col("_depth").alias(f"{var}.depth"), F.col("_edges").alias(f"{var}.ids"), F.col("_nodes").alias(f"{var}.nodes"))
        ids, nodes = F.col(quoted(f"{var}.ids")), F.col(quoted(f"{var}.nodes"))
        variables = scope.vars | ({e.var: Value(f"{var}.ids")} if e.var else {})
        return self.scope(renamed, variables), F.col(quoted(f"{var}.to")), ids, F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0)))

    def optional(self, scope: Scope, m: ast.Match) -> Scope:
        """All or nothing: the whole pattern, left-joined on the nodes it shares with the scope."""
        named = {n.var for p in m.patterns for n in p.nodes if n.var}
        shared = [v for v in named if isinstance(scope.vars.get(v), Element)]
        mine = ast.variables(m.where) if m.where else set()
        outer = mine - named - {e.var for p in m.patterns for e in p.edges if e.var}
        right = self.match(self.start(), ast.Match(m.patterns, None if outer else m.where), False)
        prefix = self.fresh("_o")
        frame = right.frame.select(*(F.col(quoted(c)).alias(f"{prefix}.{c}") for c in right.frame.columns))

        def moved(v):
            if isinstance(v, Element):
                return Element(v.kind, {p: f"{prefix}.{c}" for p, c in v.columns.items()}, v.types)
            return Path(f"{prefix}.{v.edges}", f"{prefix}.{v.nodes}") if isinstance(v, Path) else Value(f"{prefix}.{v.column}")

        inner = {k: moved(v) for k, v in right.vars.items()}
        on = [F.col(quoted(scope.vars[v].columns["_id"])) == F.col(quoted(inner[v].columns["_id"])) for v in shared]
        both = {**inner, **scope.vars}
        if outer:
            probe = self.scope(scope.frame.crossJoin(frame), both)
            on.append(Compiler(probe)(m.where))
        joined = scope.frame.join(frame, reduce(Column.__and__, on) if on else F.lit(True), "left")
        return self.scope(joined, both)

    # projections ---------------------------------------------------------
    def project(self, scope: Scope, p: ast.Projection) -> Scope:
        items = p.items
        if items is None:
            items = [ast.Item(("var", v), v) for v in sorted(scope.vars) if not v.startswith("_")]
        names = [i.alias for i in items]
        if len(set(names)) < len(names):
            raise GraphError(f"repeated column name in {names}", "duplicate_column")
        grouped = any(ast.aggregates(i.expr) for i in items)
        if grouped or any(ast.aggregates(e) for e, _ in p.order):
            scope, items = self.group(scope, items, p)
        if p.final:
            return self.returned(scope, items, p)
        # WITH: elements stay elements, everything else becomes a value.
        variables, columns = {}, []
        compiler = self.compiler(scope)
        for i in items:
            v = scope.vars.get(i.expr[1]) if i.expr[0] == "var" else None
            if isinstance(v, (Element, Path)):
                moved = {}
                for prop, c in (v.columns.items() if isinstance(v, Element) else (("edges", v.edges), ("nodes", v.nodes))):
                    moved[prop] = f"{i.alias}.{prop}"
                    columns.append(F.col(quoted(c)).alias(moved[prop]))
                variables[i.alias] = Element(v.kind, moved, v.types) if isinstance(v, Element) else Path(**moved)
            else:
                name = f"{i.alias}=" if any(i.alias == c for c in scope.frame.columns) else i.alias
                columns.append(compiler(i.expr).alias(name))
                variables[i.alias] = Value(name)
        order = self.order_columns(scope, items, p)
        frame = scope.frame.select(*columns, *(c.alias(f"_o{k}") for k, (c, _) in enumerate(order)))
        if p.distinct:
            frame = frame.drop(*(f"_o{k}" for k in range(len(order)))).distinct()
            if order:
                raise GraphError("ORDER BY after WITH DISTINCT must follow in the next clause", "distinct_order")
        frame = self.sliced(frame, [(F.col(f"_o{k}"), down) for k, (_, down) in enumerate(order)], p).drop(*(f"_o{k}" for k in range(len(order))))
        out = self.scope(frame, variables)
        if p.where is not None:
            out = self.scope(out.frame.filter(Compiler(out)(p.where)), out.vars)
        return out

    def group(self, scope: Scope, items, p: ast.Projection):
        """Implicit GROUP BY: items without aggregates are the keys."""
        compiler = Compiler(scope)
        keys, extra, variables, swapped = [], [], {}, {}
        calls = {repr(a): a for e in [i.expr for i in items] + [e for e, _ in p.order] for a in ast.aggregates(e)}
        key_items = [i.expr for i in items if not ast.aggregates(i.expr)]
        aliases = {i.alias for i in items}
        key_items += [e for e, _ in p.order if not ast.aggregates(e) and not (e[0] == "var" and e[1] in aliases) and e not in key_items and not any(e[:1] == ("prop",) and e[1] == k for k in key_items)]
        for n, e in enumerate(key_items):
            v = scope.vars.get(e[1]) if e[0] == "var" else None
            if isinstance(v, Element):  # group by id, carry the rest
                name = {"_id": f"_k{n}._id"}
                keys.append(F.col(quoted(v.columns["_id"])).alias(name["_id"]))
                for prop, c in v.columns.items():
                    if prop != "_id":
                        name[prop] = f"_k{n}.{prop}"
                        extra.append(F.first(quoted(c)).alias(name[prop]))
                variables[e[1]] = Element(v.kind, name, v.types)
            else:
                keys.append(compiler(e).alias(f"_k{n}"))
                swapped[repr(e)] = f"_k{n}"
                if e[0] == "var":
                    variables[e[1]] = Value(f"_k{n}")
        made = []
        for n, (r, a) in enumerate(calls.items()):
            made.append(compiler.aggregate(a).alias(f"_a{n}"))
            swapped[r] = f"_a{n}"
        frame = scope.frame.groupBy(*keys).agg(*made, *extra) if made or extra else scope.frame.select(*keys).distinct()
        out = self.scope(frame, variables)
        out.swapped = {r: F.col(quoted(c)) for r, c in swapped.items()}
        return out, items

    def compiler(self, scope: Scope) -> Compiler:
        return Compiler(scope, swapped=getattr(scope, "swapped", None))

    def order_columns(self, scope: Scope, items, p: ast.Projection):
        by_alias = {i.alias: i.expr for i in items}
        compiler = self.compiler(scope)

        def resolved(e):
            return by_alias[e[1]] if e[0] == "var" and e[1] in by_alias else e

        return [(compiler(resolved(e)), down) for e, down in p.order]

    def sliced(self, frame: DataFrame, order, p: ast.Projection) -> DataFrame:
        if order:
            frame = frame.orderBy(*(c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in order))
        if p.skip is not None:
            frame = frame.offset(self.count_of(p.skip))
        return frame.limit(self.count_of(p.limit)) if p.limit is not None else frame

    def count_of(self, e: tuple) -> int:
        if e[0] == "lit":
            return int(e[1])
        if e[0] == "param":
            return int(self.params[e[1]])
        return int(self.graph.spark.range(1).select(Compiler(self.start())(e)).first()[0])

    def returned(self, scope: Scope, items, p: ast.Projection) -> Scope:
        compiler = self.compiler(scope)
        columns = [compiler(i.expr).alias(i.alias) for i in items]
        order = self.order_columns(scope, items, p)
        if p.distinct and order:
            shown = {i.alias for i in items} | {ast.name_of(i.expr) for i in items}
            for e, _ in p.order:
                if not (e[0] == "var" and e[1] in shown) and e not in [i.expr for i in items]:
                    raise GraphError("RETURN DISTINCT can only be ordered by returned columns", "distinct_order")
            frame = scope.frame.select(*columns).distinct()
            place = {repr(i.expr): i.alias for i in items} | {repr(("var", i.alias)): i.alias for i in items}
            frame = self.sliced(frame, [(F.col(quoted(place[repr(e)])), down) for e, down in p.order], p)
        else:
            hidden = [c.alias(f"_o{k}") for k, (c, _) in enumerate(order)]
            frame = scope.frame.select(*columns, *hidden)
            if p.distinct:
                frame = frame.distinct()
            frame = self.sliced(frame, [(F.col(f"_o{k}"), down) for k, (_, down) in enumerate(order)], p).drop(*(f"_o{k}" for k in range(len(order))))
        return self.scope(frame, {i.alias: Value(i.alias) for i in items})


def cypher(graph: Graph, text: str, params: dict | None = None, null_safe: bool = True) -> DataFrame:
    """The result of a reading query as a DataFrame."""
    began, q = time.time(), parsed(graph, text)
    if is_write(q):
        raise GraphError("this query writes; use quiver.operators.write.execute", "write")
    out = Reader(graph, params, null_safe).run(q)
    limit = graph.catalog.settings.get("max_rows")
    if limit:
        out = out.limit(int(limit))
    most = graph.catalog.settings.get("max_bytes")
    if most and int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > int(most):
        raise GraphError(f"the estimate is above the {most} bytes that this role may read; add a label, a property filter or LIMIT", "max_bytes")
    graph.audit.append({"language": "cypher", "query": text, "seconds": time.time() - began, "columns": out.columns})
    return out


def cypher_json(graph: Graph, text: str, params: dict | None = None) -> DataFrame:
    """One JSON object for each row."""
    out = cypher(graph, text, params)
    return out.select(F.to_json(F.struct(*(F.col(quoted(c)) for c in out.columns))).alias("row"))


def check(text: str) -> dict:
    try:
        return {"ok": True, "writes": is_write(ast.parse(text))}
    except GraphError as e:
        return {"ok": False, "error": str(e), "code": e.code, "suggestions": list(e.suggestions)}


def columns(text: str) -> list[str]:
    last = ast.parse(text).clauses[-1]
    return [i.alias for i in last.items or []] if isinstance(last, ast.Projection) else []


def explain(graph: Graph, text: str, params: dict | None = None, mode: str = "formatted") -> str:
    frame = cypher(graph, text, params)
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def diagnose(graph: Graph, text: str, params: dict | None = None) -> list[dict]:
    """Rows left after each element of the patterns: where a query becomes empty."""
    rows = []
    for c in ast.parse(text).clauses:
        if not isinstance(c, ast.Match):
            continue
        for path in c.patterns:
            for n in range(len(path.edges) + 1):
                part = ast.Match([ast.PathPattern(None, path.nodes[: n + 1], path.edges[:n])])
                reader = Reader(graph, params)
                rows.append({"step": n, "pattern": path.nodes[n].labels, "edge": path.edges[n - 1].types if n else None, "rows": reader.match(reader.start(), part, False).frame.count()})
        if c.where is not None:
            reader = Reader(graph, params)
            rows.append({"step": "where", "rows": reader.match(reader.start(), c, False).frame.count()})
    return rows


