"""Set-based writes: a query's bindings become frames of new, changed and deleted rows.

Graphs are immutable.  execute() gives a new version whose changed frames are
unions, joins and anti-joins of the old ones; all clauses see the whole set of
bindings at once.  Counters tell what changed; history is logged for tracked
types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver import ids
from quiver.catalog import GraphError, data_type
from quiver.functions.expressions import Compiler, Element, Scope, quoted
from quiver.graph import Graph, dense_ids
from quiver.operators.history import log_change
from quiver.operators.traverse import FEW, _cut
from quiver.plans import cypher_parser as ast
from quiver.plans.cypher import Reader, cypher, is_write

_NAMES = {T.LongType: "long", T.IntegerType: "int", T.DoubleType: "double", T.BooleanType: "bool", T.StringType: "string", T.FloatType: "real", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz", T.DecimalType: "decimal"}


#: Bytes of texts in a new type's nodes up to which they are sent to all tasks.
SENT_BYTES = 8 << 20


def sent(rows: DataFrame, n: int) -> DataFrame:
    """New nodes, to be broadcast if they are few and short: else the many edges of each would meet in one task."""
    plain = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if n > FEW or not all(isinstance(f.dataType, plain) for f in rows.schema):
        return rows
    texts = [F.coalesce(F.sum(F.octet_length(quoted(f.name))), F.lit(0)) for f in rows.schema if isinstance(f.dataType, T.StringType)]
    return F.broadcast(rows) if not texts or sum(rows.agg(*texts).first()) <= SENT_BYTES else rows


def kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return "int[]" if isinstance(kind.elementType, (T.LongType, T.IntegerType)) else "text[]" if isinstance(kind.elementType, T.StringType) else "vector(1)"
    return _NAMES.get(type(kind), "string")


class Writer(Reader):
    def __init__(self, graph: Graph, params: dict | None = None):
        super().__init__(graph.version(), params)
        self.count: dict[str, int] = {}
        self.removed: dict[str, str] = {}  # labels that REMOVE named and SET may replace
        self.touched: set[str] = set()  # types with new or changed rows, whose constraints are checked

    def add(self, counter: str, n: int) -> None:
        self.count[counter] = self.count.get(counter, 0) + n

    # schema on write -----------------------------------------------------
    def ensure_type(self, labels: list[list[str]], kind: str = "entity") -> str:
        """The most specific label; unknown labels are made, each below the one before."""
        names = [n for g in labels for n in g]
        if not names:
            raise GraphError("a label is needed to create a node", "label_needed")
        for i, n in enumerate(names):
            if n not in self.graph.catalog.types:
                self.graph.catalog.create_type(n, kind, [names[i - 1]] if i else [])
                self.add("labels_added", 1)
        catalog = self.graph.catalog
        best = max(names, key=lambda n: len(catalog.supertypes(n)))
        if any(not catalog.is_subtype(best, n) for n in names):
            raise GraphError(f"labels {names} are not on one line of inheritance", "label_conflict")
        if catalog.types[best].abstract:
            raise GraphError(f"{best!r} is abstract", "abstract")
        return best

    def ensure_property(self, type_name: str, prop: str, kind: T.DataType) -> T.DataType:
        """Declare a property that is met first; a conflicting scalar widens it to string."""
        known = self.graph.catalog.types[type_name].properties.get(prop)
        if known is None:
            self.graph.catalog.add_property(type_name, prop, kind_name(kind))
            return data_type(kind_name(kind))
        have = data_type(known.data_type)
        numeric = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.DecimalType)
        if type(have) is type(kind) or isinstance(kind, T.NullType) or (isinstance(have, (T.DoubleType, T.FloatType, T.DecimalType, T.LongType)) and isinstance(kind, numeric)) or isinstance(have, T.ArrayType):
            return have
        for t in self.graph.catalog.subtypes(type_name):
            self.graph.catalog.types[t].properties[prop].data_type = "string"
            for store in (self.graph.nodes, self.graph.edges):
                if t in store and prop in store[t].columns:
                    store[t] = store[t].withColumn(prop, F.col(prop).cast("string"))
        self.graph.catalog._changed()
        return T.StringType()

    def next_local(self, store: dict, type_name: str) -> int:
        if type_name not in store:
            return 1
        top = store[type_name].agg(F.max("_id")).first()[0]
        return 1 if top is None else ids.id_local(top) + 1

    def union(self, store: dict, type_name: str, rows: DataFrame, edges: bool, n: int | None = None) -> None:
        old = store.get(type_name)
        if old is None and not edges and n is not None:
            rows = sent(rows, n)
        self.touched.add(type_name)
        if type_name in self.graph.tracked:
            log_change(self.graph, rows, "i", edges)
        store[type_name] = rows if old is None else old.unionByName(rows, allowMissingColumns=True)

    # clauses -------------------------------------------------------------
    def run(self, q: ast.Query) -> DataFrame | None:
        scope, result = self.start(), None
        for i, c in enumerate(q.clauses):
            if isinstance(c, ast.Create):
                for p in c.patterns:
                    scope = self.create(scope, p)
            elif isinstance(c, ast.Merge):
                scope = self.merge(scope, c)
            elif isinstance(c, ast.SetClause):
                scope = self.set(scope, c.items)
            elif isinstance(c, ast.Remove):
                scope = self.remove(scope, c.items)
            elif isinstance(c, ast.Delete):
                self.delete(scope, c)
            elif isinstance(c, ast.Ddl):
                self.ddl(c)
            else:
                scope = self.clause(scope, c, q.clauses[i + 1 :])
                if isinstance(c, ast.Projection) and c.final:
                    result = scope.frame
        if self.removed:
            raise GraphError("REMOVE n:Old stands with SET n:New, which renames the type", "relabel")
        self.check_constraints()
        self.graph.counters = self.count | {"contains_updates": bool(sum(self.count.values()))}
        return result

    def values(self, scope: Scope, type_name: str, props: dict) -> list[Column]:
        out = []
        for k, e in props.items():
            c = Compiler(scope)(e)
            kind = self.ensure_property(type_name, k, scope.frame.select(c.alias("_")).schema[0].dataType)
            out.append((k, c.cast(kind)))
        return out

    def create(self, scope: Scope, path: ast.PathPattern) -> Scope:
        names = []
        for n in path.nodes:
            var = n.var or self.fresh("_n")
            names.append(var)
            if isinstance(scope.vars.get(var), Element):
                continue
            t = self.ensure_type(n.labels)
            scope = self.new_element(scope, var, t, n.props, self.graph.nodes, None)
            self.add("nodes_created", self.made)
        for e, a, b in zip(path.edges, names, names[1:]):
            if len(e.types) != 1:
                raise GraphError("a relationship is created with one type", "type_needed")
            if e.direction == "in":
                a, b = b, a
            if e.types[0] not in self.graph.catalog.types:
                self.graph.catalog.create_type(e.types[0], "relation")
            self.check_roles(scope, e.types[0], a, b)
            ends = [F.col(quoted(scope.vars[x].columns["_id"])) for x in (a, b)]
            scope = self.new_element(scope, e.var or self.fresh("_r"), e.types[0], e.props, self.graph.edges, ends)
            self.add("relationships_created", self.made)
        return scope

    def check_roles(self, scope: Scope, relation: str, a: str, b: str) -> None:
        for ordinal, var in enumerate((a, b)):
            role = next((r for r in self.graph.catalog.types[relation].roles.values() if r.ordinal == ordinal), None)
            if role and role.player in self.graph.catalog.types:
                allowed = self.graph.catalog.subtypes(role.player)
                if not set(scope.vars[var].types) & set(allowed):
                    raise GraphError(f"{relation}.{role.name} is played by {role.player}, not {scope.vars[var].types}", "wrong_player")

    def new_element(self, scope: Scope, var: str, t: str, props: dict, store: dict, ends) -> Scope:
        values = self.values(scope, t, props)
        for p in self.graph.catalog.types[t].properties.values():
            if p.required and p.name not in props:
                raise GraphError(f"{t}.{p.name} is required", "required")
        columns = {"_id": f"{var}._id"} | ({"_src": f"{var}._src", "_dst": f"{var}._dst"} if ends else {}) | {k: f"{var}.{k}" for k, _ in values}
        frame = scope.frame
        if ends:
            frame = frame.withColumn(columns["_src"], ends[0]).withColumn(columns["_dst"], ends[1])
        for k, c in values:
            frame = frame.withColumn(columns[k], c)
        numbered = dense_ids(_cut(frame), "_local", self.next_local(store, t))
        frame = _cut(numbered.withColumn(columns["_id"], ids.make_id(0, self.graph.catalog.types[t].type_id, F.col("_local"))).drop("_local"))
        rows = frame.select(*(F.col(quoted(c)).alias(p) for p, c in columns.items()))
        self.made = rows.count()
        self.add("properties_set", self.made * len(values))
        self.union(store, t, rows, ends is not None, self.made)
        return self.scope(frame, scope.vars | {var: Element("edge" if ends else "node", columns, [t])})

    def merge(self, scope: Scope, m: ast.Merge) -> Scope:
        """Bindings that match stay; for the others the pattern is created, once for equal bindings."""
        path, row = m.pattern, self.fresh("_row")
        base = _cut(dense_ids(_cut(scope.frame), row, 0))
        outer = self.scope(base, scope.vars)
        for n in path.nodes:
            if n.labels and not isinstance(scope.vars.get(n.var), Element):
                self.ensure_type(n.labels)
        for e in path.edges:
            for t in e.types:
                if t not in self.graph.catalog.types:
                    self.graph.catalog.create_type(t, "relation")
        for n in path.nodes:
            if n.labels:
                t = self.ensure_type(n.labels)
                self.values(outer, t, n.props)
        matched = self.match(self.scope(base, scope.vars), ast.Match([path]), False)
        matched = self.scope(_cut(matched.frame), matched.vars)
        rest = self.scope(_cut(base.join(matched.frame.select(row).distinct(), row, "left_anti")), scope.vars)
        keys = [Compiler(rest)(e).alias(f"_m{i}") for i, e in enumerate(e for part in (*path.nodes, *path.edges) for e in part.props.values())]
        bound = [F.col(quoted(rest.vars[n.var].columns["_id"])).alias(f"_b{i}") for i, n in enumerate(path.nodes) if isinstance(rest.vars.get(n.var), Element)]
        created = None
        if not rest.frame.isEmpty():
            one = rest.frame.select("*", *keys, *bound)
            names = [f"_m{i}" for i in range(len(keys))] + [c for c in one.columns if c.startswith("_b") and c[2:].isdigit()]
            one = one.dropDuplicates(names) if names else one.limit(1)
            created = self.create(self.scope(_cut(one), rest.vars), path)
            if m.on_create:
                created = self.set(created, m.on_create)
        if m.on_match and not matched.frame.isEmpty():
            matched = self.set(matched, m.on_match)
        if created is None:
            return self.scope(matched.frame.drop(row), matched.vars)
        # What is left is found again in the new version, so that every binding has its elements.
        return self.match(self.scope(base.drop(row), scope.vars), ast.Match([path]), False)

    def changed(self, store: dict, type_name: str, changes: DataFrame, props: list[str]) -> None:
        """Replace properties of the rows with the ids of changes (_id, props)."""
        old = store[type_name]
        for p in props:
            if p not in old.columns:
                old = old.withColumn(p, F.lit(None).cast(data_type(self.graph.catalog.types[type_name].properties[p].data_type)))
        new = changes.select(F.col("_id"), F.lit(True).alias("_hit"), *(F.col(quoted(p)).alias(f"_new_{p}") for p in props))
        joined = old.join(new, "_id", "left")
        out = joined.select(*(F.when(F.col("_hit"), F.col(quoted(f"_new_{c}"))).otherwise(F.col(quoted(c))).alias(c) if c in props else F.col(quoted(c)) for c in old.columns))
        if type_name in self.graph.tracked:
            log_change(self.graph, out.join(changes.select("_id"), "_id", "left_semi"), "u", type_name in self.graph.edges)
        store[type_name] = out
        self.touched.add(type_name)

    def check_constraints(self) -> None:
        """Every constraint on a type with new or changed rows holds, over its whole hierarchy."""
        catalog = self.graph.catalog
        for rule in catalog.constraints:
            if rule["type"] in catalog.types and self.touched & set(catalog.subtypes(rule["type"])):
                self.holds(rule["type"], rule["props"], rule["rule"])

    def holds(self, type_name: str, props: list[str], rule: str | None) -> None:
        """Raise if a rule does not hold; policies hide no row from it."""
        catalog, kind = self.graph.catalog, self.graph.catalog.types[type_name].kind
        store = self.graph.nodes if kind == "entity" else self.graph.edges
        frames = [store[t].select(*(F.col(quoted(p)) if p in store[t].columns else F.lit(None).alias(p) for p in props)) for t in catalog.subtypes(type_name) if t in store]
        if not frames:
            return
        frame = reduce(DataFrame.unionByName, frames)
        if rule in ("unique", "node_key") and not frame.dropna(subset=props).groupBy(*map(quoted, props)).count().filter("count > 1").isEmpty():
            raise GraphError(f"{type_name}{props} is not unique", "constraint")
        if rule in ("not_null", "node_key") and not frame.filter(reduce(Column.__or__, [F.col(quoted(p)).isNull() for p in props])).isEmpty():
            raise GraphError(f"{type_name}{props} has nulls", "constraint")

    def set(self, scope: Scope, items) -> Scope:
        for item in items:
            var, op = item[0], item[1]
            v = scope.vars.get(var)
            if not isinstance(v, Element):
                raise GraphError(f"{var!r} is no element", "unbound")
            if op == ":":
                self.relabel(v, item[2], self.removed.pop(var, None))
                continue
            props = {op: item[2]} if len(item) == 4 else dict(item[2][1]) if item[2][0] == "map" else {k: ("lit", x) for k, x in self.params[item[2][1]].items()} if item[2][0] == "param" else None
            if props is None:
                raise GraphError("SET n = needs a map or a parameter", "syntax")
            columns = dict(v.columns)
            compiler = Compiler(scope)
            frame = scope.frame
            values = {k: compiler(e) for k, e in props.items()}
            if op == "=" and len(item) == 3:  # replaces: what is not given goes
                values |= {p: F.lit(None) for p in v.columns if not p.startswith("_") and p not in values}
            for t in v.types:
                store = self.graph.nodes if v.kind == "node" else self.graph.edges
                if t not in store:
                    continue
                cast = {k: c.cast(self.ensure_property(t, k, frame.select(c.alias("_")).schema[0].dataType)) for k, c in values.items()}
                key = F.col(quoted(v.columns["_id"]))
                rows = frame.filter(Compiler(scope).type_name(v) == t).select(key.alias("_id"), *(c.alias(k) for k, c in cast.items()))
                # Of several bindings of an element the greatest values hold, whatever the order of rows.
                rows = _cut(rows.groupBy("_id").agg(F.max(F.struct(*cast)).alias("_v")).select("_id", "_v.*") if cast else rows.distinct())
                n = rows.count()
                if n:
                    self.add("properties_set", n * len(props))
                    self.changed(store, t, rows, list(cast))
            for k, c in values.items():
                columns[k] = v.columns.get(k, f"{var}.{k}")
                frame = frame.withColumn(columns[k], c)
            scope = self.scope(frame, scope.vars | {var: Element(v.kind, columns, v.types)})
        return scope

    def relabel(self, v: Element, labels, old: str | None) -> None:
        """SET n:New after REMOVE n:Old renames the type, for all its instances at once; ids do not change."""
        target, catalog = labels[0][0], self.graph.catalog
        if all(catalog.is_subtype(t, target) for t in v.types if target in catalog.types) and target in catalog.types:
            return
        if old is not None and old in catalog.types and target not in catalog.types:
            renamed = self.graph.rename_type(old, target)
            self.graph.catalog, self.graph.nodes, self.graph.edges = renamed.catalog, renamed.nodes, renamed.edges
            v.types[:] = [target if t == old else t for t in v.types]
            self.add("labels_added", 1)
            self.add("labels_removed", 1)
            return
        raise GraphError(f"an element's type is part of its id; {target!r} can only be set by renaming the type", "relabel")

    def remove(self, scope: Scope, items) -> Scope:
        for var, op, what in items:
            if op == ".":
                scope = self.set(scope, [(var, what, ("lit", None), ".")])
            else:
                self.removed[var] = what[0][0]
        return scope

    def delete(self, scope: Scope, d: ast.Delete) -> None:
        for var in d.vars:
            v = scope.vars.get(var)
            if not isinstance(v, Element):
                raise GraphError(f"{var!r} is no element", "unbound")
            gone = _cut(scope.frame.select(F.col(quoted(v.columns["_id"])).alias("_id")).filter("_id is not null").distinct())
            if v.kind == "edge":
                self.add("relationships_deleted", self.drop_rows(self.graph.edges, v.types, gone, "_id"))
                continue
            hit = 0
            for t in list(self.graph.edges):
                for end in ("_src", "_dst"):
                    touched = self.graph.edges[t].join(gone, self.graph.edges[t][end] == gone["_id"], "left_semi")
                    if not d.detach and not touched.isEmpty():
                        raise GraphError("the node still has relationships; use DETACH DELETE", "has_relationships")
                    if d.detach:
                        hit += self.drop_rows(self.graph.edges, [t], gone, end)
            if hit:
                self.add("relationships_deleted", hit)
            self.add("nodes_deleted", self.drop_rows(self.graph.nodes, v.types, gone, "_id"))

    def drop_rows(self, store: dict, types, gone: DataFrame, column: str) -> int:
        n = 0
        for t in types:
            if t in store:
                old, keys = store[t], gone.withColumnRenamed("_id", "_gone")
                dropped = old.join(keys, old[column] == keys["_gone"], "left_semi")
                hit = dropped.count()
                if hit:
                    if t in self.graph.tracked:
                        log_change(self.graph, dropped, "d", store is self.graph.edges)
                    store[t] = old.join(keys, old[column] == keys["_gone"], "left_anti")
                    n += hit
        return n

    # schema --------------------------------------------------------------
    def ddl(self, d: ast.Ddl) -> None:
        catalog, known = self.graph.catalog, self.graph.catalog.indexes
        if d.action == "drop":
            if d.name not in known and not d.lenient:
                raise GraphError(f"no index or constraint {d.name!r}", "unknown_index")
            gone = known.pop(d.name, None)
            if gone and gone["kind"] == "constraint":
                self.release(gone)
            return
        name = d.name or f"{d.kind}_{d.type_name}_{'_'.join(d.props)}".lower()
        if name in known:
            if d.lenient:
                return
            raise GraphError(f"index {name!r} exists", "duplicate_index")
        if d.type_name and d.type_name not in catalog.types:
            catalog.create_type(d.type_name)
        options = {k: (v[1] if isinstance(v, tuple) and v[0] == "lit" else str(v)) for k, v in d.options.items()}
        if d.kind == "constraint":
            self.constrain(d, options.get("require"))
        known[name] = {"kind": d.kind, "type": d.type_name, "props": d.props, "options": options}
        self.add("constraints_added" if d.kind == "constraint" else "indexes_added", 1)

    def constrain(self, d: ast.Ddl, rule: str | None) -> None:
        """Check the rule on what is there, over the whole hierarchy, and keep it."""
        catalog = self.graph.catalog
        for p in d.props:
            if p not in catalog.types[d.type_name].properties:
                catalog.add_property(d.type_name, p, "string")
        self.holds(d.type_name, d.props, rule)
        for t in catalog.subtypes(d.type_name):
            for p in d.props:
                catalog.types[t].properties[p].unique |= rule in ("unique", "node_key")
                catalog.types[t].properties[p].required |= rule in ("not_null", "node_key")
        catalog.constraints.append({"type": d.type_name, "props": d.props, "rule": rule})

    def release(self, gone: dict) -> None:
        """Forget a dropped constraint; a property keeps what other constraints ask of it."""
        catalog = self.graph.catalog
        rule = gone["options"].get("require")
        match = {"type": gone["type"], "props": gone["props"], "rule": rule}
        if match in catalog.constraints:
            catalog.constraints.remove(match)
        for t in catalog.subtypes(gone["type"]) if gone["type"] in catalog.types else ():
            for p in gone["props"]:
                still = {c["rule"] for c in catalog.constraints if p in c["props"] and c["type"] in catalog.types and catalog.is_subtype(t, c["type"])}
                known = catalog.types[t].properties[p]
                if rule in ("unique", "node_key"):
                    known.unique = bool(still & {"unique", "node_key"})
                if rule in ("not_null", "node_key"):
                    known.required = bool(still & {"not_null", "node_key"})


def writable(graph: Graph) -> None:
    """Raise if the role applied to the graph may only read."""
    if graph.catalog.settings.get("read_only") == "True":
        raise GraphError("this role may only read", "read_only")


def execute(graph: Graph, text: str, params: dict | None = None) -> tuple[Graph, DataFrame | None]:
    """Run any query: the graph after it and its rows (None without RETURN)."""
    q = ast.parse(text)
    if not is_write(q):
        return graph, cypher(graph, text, params)
    writable(graph)
    w = Writer(graph, params)
    rows = w.run(q)
    w.graph.audit.append({"language": "cypher", "query": text, "writes": True})
    return w.graph, rows


# the same by function ----------------------------------------------------
def create_nodes(graph: Graph, type_name: str, rows: DataFrame) -> Graph:
    """Rows as new nodes of a type; columns are properties."""
    return _create(graph, type_name, rows, None)


def create_edges(graph: Graph, type_name: str, rows: DataFrame) -> Graph:
    """Rows (_src, _dst, properties...) as new edges; roles are checked."""
    new = _create(graph, type_name, rows, ("_src", "_dst"))
    bad = new.check_integrity().filter(F.col("kind") == "wrong_player")
    if not bad.isEmpty():
        raise GraphError(f"wrong player in {type_name}: {bad.first()['detail']}", "wrong_player")
    return new


def _create(graph: Graph, type_name: str, rows: DataFrame, ends) -> Graph:
    writable(graph)
    w = Writer(graph)
    store = w.graph.edges if ends else w.graph.nodes
    kinds = {p: w.ensure_property(type_name, p, rows.schema[p].dataType) for p in rows.columns if p not in ("_src", "_dst")}
    numbered = dense_ids(_cut(rows), "_local", w.next_local(store, type_name))
    made = _cut(numbered.select(ids.make_id(0, w.graph.catalog.get(type_name).type_id, F.col("_local")).alias("_id"), *(ends or ()), *(F.col(p).cast(k).alias(p) for p, k in kinds.items())))
    n = made.count()
    w.union(store, type_name, made, bool(ends), n)
    w.check_constraints()
    w.graph.counters = {"relationships_created" if ends else "nodes_created": n}
    return w.graph


def set_props(graph: Graph, type_name: str, rows: DataFrame) -> Graph:
    """Rows (_id, properties...) replace the properties they name."""
    writable(graph)
    w = Writer(graph)
    store = w.graph.edges if type_name in w.graph.edges else w.graph.nodes
    props = [c for c in rows.columns if c != "_id"]
    for p in props:
        w.ensure_property(type_name, p, rows.schema[p].dataType)
    w.changed(store, type_name, rows, props)
    w.check_constraints()
    return w.graph


def delete(graph: Graph, rows: DataFrame, detach: bool = False) -> Graph:
    """Delete the nodes or edges whose _id is in rows."""
    writable(graph)
    w = Writer(graph)
    n = w.drop_rows(w.graph.edges, list(w.graph.edges), rows, "_id")
    for t in list(w.graph.edges):
        for end in ("_src", "_dst"):
            if detach:
                n += w.drop_rows(w.graph.edges, [t], rows, end)
            elif not w.graph.edges[t].join(rows.withColumnRenamed("_id", end), end, "left_semi").isEmpty():
                raise GraphError("a node still has relationships", "has_relationships")
    w.graph.counters = {"relationships_deleted": n, "nodes_deleted": w.drop_rows(w.graph.nodes, list(w.graph.nodes), rows, "_id")}
    return w.graph


def enable_history(graph: Graph, *types: str) -> Graph:
    """Log changes of these types and their subtypes from now on; their rows are logged as they are."""
    new = graph.version()
    for t in types:
        for s in new.catalog.subtypes(t):
            new.tracked.add(s)
            if s in new.nodes or s in new.edges:
                log_change(new, new.nodes[s] if s in new.nodes else new.edges[s], "i", s in new.edges)
    return new
