"""TypeQL over DataFrames.

Instances are nodes; a relation instance is a node too, with rows in the players
frame (rel_id, role, player_id); an attribute is a node of an attribute type
with its value in `val`, interned by value; ownership is a frame (owner_id,
attr_id).  match builds one frame for each group of patterns that share
variables and crosses the groups; each later stage is one DataFrame step, in the
order written.  A stage `match` after others joins what it matches to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiver import ids
from quiver.catalog import Catalog, GraphError, data_type
from quiver.operators.traverse import _cut
from quiver.plans import typeql_parser as ast

#: Value types and the declared type names that hold them.
VALUE_TYPES = {"string": "string", "integer": "long", "long": "long", "double": "double", "decimal": "decimal", "boolean": "bool", "date": "date", "datetime": "timestamp_ntz", "datetime-tz": "timestamp", "duration": "string"}


class Store:
    """The frames of a TypeQL database."""

    def __init__(self, spark, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog()
        self.instances: DataFrame = spark.createDataFrame([], "_id long, type string")
        self.attributes: dict[str, DataFrame] = {}  # type -> (_id, val)
        self.owned: dict[str, DataFrame] = {}  # attribute type -> (owner_id, attr_id)
        self.players: DataFrame = spark.createDataFrame([], "rel_id long, role string, player_id long")
        self.owns: dict[str, dict[str, dict]] = {}
        self.next: dict[str, int] = {}
        # Mapped attributes with their values, as long as the owned frame beside them is the one in use.
        self.direct: dict[str, tuple[DataFrame, DataFrame]] = {}

    # mapping of tables ---------------------------------------------------
    def map_instances(self, type_name: str, frame: DataFrame, key: str, attributes: dict[str, str]) -> Store:
        """A table as instances; columns become owned attributes, interned by value."""
        t = self.catalog.get(type_name)
        rows = frame.select(ids.make_id(0, t.type_id, F.col(key)).alias("_id"), *(F.col(c).alias(a) for a, c in attributes.items()))
        self.instances = self.instances.unionByName(rows.select("_id", F.lit(type_name).alias("type")))
        for a in attributes:
            # An attribute's id is made of its value, so equal values are one attribute without a lookup.
            name = F.xxhash64(F.lit(a), F.col(a))
            values = rows.filter(F.col(a).isNotNull()).select(name.alias("_id"), F.col(a).alias("val")).distinct()
            self.attributes[a] = values if a not in self.attributes else self.attributes[a].unionByName(values).distinct()
            owned = rows.filter(F.col(a).isNotNull()).select(F.col("_id").alias("owner_id"), name.alias("attr_id"))
            valued = rows.filter(F.col(a).isNotNull()).select(F.col("_id").alias("owner_id"), name.alias("attr_id"), F.col(a).alias("val"))
            old, known = self.owned.get(a), self.direct.get(a)
            self.owned[a] = owned if old is None else old.unionByName(owned)
            if old is None:
                self.direct[a] = self.owned[a], valued
            elif known and known[0] is old:
                self.direct[a] = self.owned[a], known[1].unionByName(valued)
        return self

    def values_of(self, a: str) -> DataFrame:
        """owner_id, attr_id, val: from the mapped rows themselves, or by the interned values once they have changed."""
        known = self.direct.get(a)
        if known and known[0] is self.owned[a]:
            return known[1]
        return self.owned[a].join(self.attributes[a], F.col("attr_id") == F.col("_id")).select("owner_id", "attr_id", "val")

    def map_relation(self, type_name: str, frame: DataFrame, key: str, players: dict[str, tuple[str, str]]) -> Store:
        """A table as relation instances; players: role -> (player type, key column)."""
        t = self.catalog.get(type_name)
        me = ids.make_id(0, t.type_id, F.col(key))
        self.instances = self.instances.unionByName(frame.select(me.alias("_id"), F.lit(type_name).alias("type")))
        for role, (player, column) in players.items():
            self.players = self.players.unionByName(frame.select(me.alias("rel_id"), F.lit(role).alias("role"), ids.make_id(0, self.catalog.get(player).type_id, F.col(column)).alias("player_id")))
        return self

    def views(self) -> dict[str, DataFrame]:
        """The mapping of attributes and roles as frames."""
        attributes = [(t.name, t.value) for t in self.catalog.types.values() if t.kind == "attribute"]
        roles = [(t.name, r.name, r.parent) for t in self.catalog.types.values() for r in t.roles.values()]
        owns = [(t, a) for t, xs in self.owns.items() for a in xs]
        make = self.spark.createDataFrame
        return {"attribute": make(attributes, "attribute string, value string"), "role": make(roles, "relation string, role string, parent string"), "owns": make(owns, "type string, attribute string")}

    def fresh(self, type_name: str) -> int:
        self.next[type_name] = self.next.get(type_name, 0) + 1
        return ids.make_id(0, self.catalog.get(type_name).type_id, self.next[type_name])

    def copy(self) -> Store:
        import copy

        new = copy.copy(self)
        new.attributes, new.owned, new.next = dict(self.attributes), dict(self.owned), dict(self.next)
        new.catalog, new.owns = copy.deepcopy(self.catalog), copy.deepcopy(self.owns)
        return new

    def ownable(self, type_name: str) -> dict[str, dict]:
        return reduce(lambda a, s: self.owns.get(s, {}) | a, self.catalog.supertypes(type_name), {})

    def role_names(self, role: str) -> list[str]:
        """A role with the roles that specialise it."""
        out, todo = [], [role]
        while todo:
            r = todo.pop()
            if r not in out:
                out.append(r)
                todo += [x.name for t in self.catalog.types.values() for x in t.roles.values() if x.parent == r]
        return out


def vars_of(s: ast.Statement) -> set[str]:
    a = s.args
    out = {a[k] for k in ("var", "attr", "other") if isinstance(a.get(k), str)}
    out |= {p for _, p in a.get("players", [])}
    for k in ("left", "right", "expr"):
        out |= _expr_vars(a[k]) if k in a else set()
    for b in [a["body"]] if "body" in a else a.get("branches", []):
        out |= {v for x in b for v in vars_of(x)}
    if s.kind == "isa" and a["type"].startswith("$"):
        out.add(a["type"][1:])
    return out


def _expr_vars(e) -> set[str]:
    if e[0] in ("var", "attr"):
        return {e[1]}
    parts = e[2] if e[0] == "call" else e[1:]
    return {v for x in parts if isinstance(x, tuple) for v in _expr_vars(x)}


class Matcher:
    def __init__(self, store: Store):
        self.store, self.names = store, 0

    def components(self, patterns: list[ast.Statement]) -> list[list[ast.Statement]]:
        groups: list[tuple[set, list]] = []
        for p in patterns:
            mine, stay = (vars_of(p), [p]), []
            for g in groups:
                if g[0] & mine[0]:
                    mine = (mine[0] | g[0], g[1] + mine[1])
                else:
                    stay.append(g)
            groups = [*stay, mine]
        return [sorted(g[1], key=lambda s: patterns.index(s)) for g in groups]

    def match(self, patterns: list[ast.Statement]) -> DataFrame:
        frames = [self.group(g) for g in self.components(patterns)]
        return reduce(DataFrame.crossJoin, frames)

    def group(self, patterns: list[ast.Statement]) -> DataFrame:
        """Columns by variable: ids of things; of attributes `v` (id) and `v=` (value); `v#` types."""
        frame = None
        order = {"isa": 0, "rel": 1, "has": 2, "sub": 0, "label": 0, "let": 3, "is": 3, "compare": 4, "or": 5, "not": 6}
        todo = sorted(patterns, key=lambda s: order[s.kind])
        attributes = {s.args["attr"]: s.args["type"] for s in patterns if s.kind == "has"}
        for s in todo:
            if s.kind == "isa" and s.args["var"] in attributes and not s.args["type"].startswith("$"):
                continue  # the ownership says it
            frame = getattr(self, "on_" + s.kind)(frame, s.args)
        return frame

    def join(self, frame: DataFrame | None, other: DataFrame) -> DataFrame:
        if frame is None:
            return other
        shared = [c for c in other.columns if c in frame.columns]
        return frame.join(other, shared) if shared else frame.crossJoin(other)

    def on_isa(self, frame, a):
        catalog, kind = self.store.catalog, a["type"]
        if kind.startswith("$"):
            rows = self.store.instances.select(F.col("_id").alias(a["var"]), F.col("type").alias(kind[1:] + "#"))
            return self.join(frame, rows)
        t = catalog.get(kind)
        names = [kind] if a["exact"] else catalog.subtypes(kind)
        if t.kind == "attribute":
            frames = [self.store.attributes[n].select(F.col("_id").alias(a["var"]), F.col("val").alias(a["var"] + "=")) for n in names if n in self.store.attributes]
            if not frames:
                raise GraphError(f"no values of {kind!r}", "unknown_type")
            return self.join(frame, reduce(DataFrame.unionByName, frames))
        rows = self.store.instances.filter(F.col("type").isin(names)).select(F.col("_id").alias(a["var"]))
        return self.join(frame, rows)

    def on_has(self, frame, a):
        names = [n for n in self.store.catalog.subtypes(a["type"]) if n in self.store.owned]
        if not names:
            rows = self.store.spark.createDataFrame([], f"`{a['var']}` long, `{a['attr']}` long, `{a['attr']}=` string")
            return self.join(frame, rows)
        frames = [self.store.values_of(n).select(F.col("owner_id").alias(a["var"]), F.col("attr_id").alias(a["attr"]), F.col("val").alias(a["attr"] + "=")) for n in names]
        return self.join(frame, reduce(DataFrame.unionByName, frames))

    def on_rel(self, frame, a):
        catalog, rel = self.store.catalog, a["var"]
        rows, used = None, []
        for i, (role, var) in enumerate(a["players"]):
            part = self.store.players.select(F.col("rel_id").alias(rel), F.col("role").alias(f"_role{self.names}_{i}"), F.col("player_id").alias(var))
            if role is not None:
                part = part.filter(F.col(f"_role{self.names}_{i}").isin(self.store.role_names(role)))
            if rows is not None and var in rows.columns:
                part = part.withColumnRenamed(var, "_same")
                rows = rows.join(part, rel).filter(F.col("_same") == F.col(var)).drop("_same")
            else:
                rows = part if rows is None else rows.join(part, rel)
            for j, other in used:  # no player twice in one role
                if other != var:
                    rows = rows.filter(~((F.col(f"_role{self.names}_{i}") == F.col(f"_role{self.names}_{j}")) & (F.col(var) == F.col(other))))
            used.append((i, var))
        rows = rows.drop(*(f"_role{self.names}_{i}" for i in range(len(a["players"]))))
        self.names += 1
        if a["type"]:
            allowed = catalog.subtypes(a["type"])
            rows = rows.join(self.store.instances.filter(F.col("type").isin(allowed)).select(F.col("_id").alias(rel)), rel, "left_semi")
        return self.join(frame, rows)

    def on_sub(self, frame, a):
        found = self.store.catalog.subtypes(a["type"]) if not a["exact"] else [n for n, t in self.store.catalog.types.items() if a["type"] in t.parents]
        return self.join(frame, self.store.spark.createDataFrame([(n,) for n in found], f"`{a['var']}#` string"))

    def on_label(self, frame, a):
        return self.join(frame, self.store.spark.createDataFrame([(a["type"],)], f"`{a['var']}#` string"))

    def on_let(self, frame, a):
        return frame.withColumn(a["var"] + "=", self.value(frame, a["expr"]))

    def on_is(self, frame, a):
        return frame.filter(F.col(a["var"]) == F.col(a["other"]))

    def on_compare(self, frame, a):
        x, y = self.value(frame, a["left"]), self.value(frame, a["right"])
        return frame.filter({"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "like": lambda: F.rlike(x, y), "contains": lambda: F.contains(F.lower(x), F.lower(y))}[a["op"]]())

    def _inner(self, frame, body) -> tuple[DataFrame, list[str]]:
        outer = set(frame.columns)
        inner = self.match([s for s in body if s.kind != "compare" or not (vars_of(s) - {v for t in body if t.kind != "compare" for v in vars_of(t)})])
        late = [s for s in body if s.kind == "compare" and vars_of(s) - {v for t in body if t.kind != "compare" for v in vars_of(t)}]
        shared = [c for c in inner.columns if c in outer and not c.endswith("=")]
        if late:
            key = "_row"
            numbered = frame.withColumn(key, F.monotonically_increasing_id())
            joined = self.join(numbered, inner.drop(*(c for c in inner.columns if c in outer and c not in shared)))
            for s in late:
                joined = self.on_compare(joined, s.args)
            return joined, [c for c in frame.columns]
        return inner, shared

    def on_not(self, frame, a):
        inner, on = self._inner(frame, a["body"])
        return frame.join(inner.select(*(F.col(f"`{c}`") for c in on)).distinct(), on, "left_anti")

    def on_or(self, frame, a):
        parts = []
        for b in a["branches"]:
            if frame is None:
                raise GraphError("an or block needs variables bound outside it", "unbound")
            if all(s.kind == "compare" for s in b):
                part = frame
                for s in b:
                    part = self.on_compare(part, s.args)
            else:
                inner, on = self._inner(frame, b)
                part = frame.join(inner.select(*(F.col(f"`{c}`") for c in on)).distinct(), on, "left_semi")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts).distinct()

    # expressions ---------------------------------------------------------
    def value(self, frame: DataFrame, e) -> Column:
        if e[0] == "lit":
            return F.lit(e[1])
        if e[0] == "time":
            return F.lit(e[1]).cast("timestamp_ntz" if "T" in e[1] else "date")
        if e[0] == "var":
            name = e[1] + "=" if e[1] + "=" in frame.columns else e[1] + "#" if e[1] + "#" in frame.columns else e[1]
            if name not in frame.columns:
                raise GraphError(f"variable ${e[1]} is not bound", "unbound")
            return F.col(f"`{name}`")
        if e[0] == "call":
            args = [self.value(frame, x) for x in e[2]]
            known = {"round": F.round, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "length": F.length}
            if e[1] not in known:
                raise GraphError(f"unknown function {e[1]!r}; functions are stored, not called", "unknown_function")
            return known[e[1]](*args)
        x, y = self.value(frame, e[1]), self.value(frame, e[2])
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[e[0]]()


REDUCE = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "std": F.stddev_samp, "list": F.collect_list}


def read(store: Store, stages: list[ast.Stage]) -> DataFrame:
    m = Matcher(store)
    frame, order = None, []
    for s in stages:
        a = s.args
        if s.kind == "match":
            found = m.match(a["patterns"])
            frame = found if frame is None else m.join(frame, found.drop(*(c for c in found.columns if c in frame.columns and c.endswith("=") and c[:-1] in found.columns)))
        elif s.kind == "select":
            for v in a["vars"]:
                m.value(frame, ("var", v))
            frame = frame.select(*(F.col(f"`{c}`") for c in frame.columns if c.rstrip("=#") in a["vars"]))
        elif s.kind == "distinct":
            frame = frame.distinct()
        elif s.kind == "sort":
            order = [(v, down) for v, down in a["keys"]]
            frame = _sorted(m, frame, order)
        elif s.kind == "limit":
            frame = frame.limit(a["n"])
        elif s.kind == "offset":
            frame = _sorted(m, frame, order).offset(a["n"]) if order else frame.offset(a["n"])
        elif s.kind == "reduce":
            aggregates = []
            for target, f, v in a["items"]:
                c = F.count(F.lit(1)) if f == "count" and v is None else F.count(F.col(f"`{v}`") if v in frame.columns else m.value(frame, ("var", v))) if f == "count" else REDUCE[f](m.value(frame, ("var", v)))
                aggregates.append(c.alias(target + "="))
            groups = [F.col(f"`{c}`") for c in frame.columns if c.rstrip("=#") in a["groups"]]
            frame, order = frame.groupBy(*groups).agg(*aggregates), []
        elif s.kind == "fetch":
            frame = fetch(store, m, frame, a["doc"])
            order = []
    if order and all(any(c.rstrip("=#") == v for c in frame.columns) for v, _ in order):
        frame = _sorted(m, frame, order)
    return named(frame)


def _sorted(m: Matcher, frame: DataFrame, order) -> DataFrame:
    keys = [m.value(frame, ("var", v)) for v, _ in order]
    return frame.orderBy(*(c.desc_nulls_last() if down else c.asc_nulls_last() for c, (_, down) in zip(keys, order)))


def named(frame: DataFrame) -> DataFrame:
    """Values under their variables' names; ids only of variables without a value."""
    out = {}
    for c in frame.columns:
        v = c.rstrip("=#")
        if not v.startswith("_") and (c != v or v not in out):
            out[v] = F.col(f"`{c}`").alias(v)
    return frame.select(*out.values())


def _owned_values(store: Store, attr: str) -> DataFrame:
    frames = [store.owned[n].join(store.attributes[n], F.col("attr_id") == F.col("_id")).select("owner_id", "val") for n in store.catalog.subtypes(attr) if n in store.owned]
    return reduce(DataFrame.unionByName, frames) if frames else store.spark.createDataFrame([], "owner_id long, val string")


def fetch(store: Store, m: Matcher, frame: DataFrame, doc: dict) -> DataFrame:
    """Each row as a document: nested documents are structs, lists are sorted arrays."""
    frame = frame.withColumn("_row", F.monotonically_increasing_id())
    frame = _cut(frame)
    frame, columns = _document(store, m, frame, doc)
    return frame.select(*(c.alias(k) for k, c in columns.items()))


def _document(store: Store, m: Matcher, frame: DataFrame, doc: dict):
    columns: dict[str, Column] = {}
    for key, x in doc.items():
        m.names += 1
        name = f"_f{m.names}"
        if x[0] == "doc":
            frame, inner = _document(store, m, frame, x[1])
            columns[key] = F.struct(*(c.alias(k) for k, c in inner.items()))
        elif x[0] == "list":
            values = _owned_values(store, x[2]).groupBy("owner_id").agg(F.sort_array(F.collect_list("val")).alias(name)).withColumnRenamed("owner_id", x[1])
            frame = frame.join(values, x[1], "left")
            columns[key] = F.coalesce(F.col(name), F.array())
        elif x[0] == "fetch":
            inner = read_nested(store, frame, x[1])
            rows = inner.groupBy("_row").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in inner.columns if c != "_row"))).alias(name))
            frame = frame.join(rows, "_row", "left")
            columns[key] = F.coalesce(F.col(name), F.array())
        elif x[1][0] == "attr":
            values = _owned_values(store, x[1][2]).groupBy("owner_id").agg(F.min("val").alias(name)).withColumnRenamed("owner_id", x[1][1])
            frame = frame.join(values, x[1][1], "left")
            columns[key] = F.col(name)
        else:
            columns[key] = m.value(frame, x[1])
    return frame, columns


def read_nested(store: Store, outer: DataFrame, stages: list[ast.Stage]) -> DataFrame:
    m = Matcher(store)
    frame = outer.select(*(F.col(f"`{c}`") for c in outer.columns if not c.startswith("_f")))
    for s in stages:
        if s.kind == "match":
            found = m.match(s.args["patterns"])
            frame = m.join(frame, found.drop(*(c for c in found.columns if c in frame.columns and c.endswith("="))))
        elif s.kind == "fetch":
            frame, columns = _document(store, m, frame, s.args["doc"])
            frame = frame.select("_row", *(c.alias(k) for k, c in columns.items()))
        elif s.kind == "sort":
            frame = _sorted(m, frame, s.args["keys"])
        elif s.kind in ("limit", "offset"):
            raise GraphError("limit inside a nested fetch is not supported", "unsupported")
    return frame


# schema -----------------------------------------------------------------
def define(store: Store, items: list) -> None:
    """Idempotent, with forward references: types, then parents, values, roles, ownerships, plays."""
    catalog = store.catalog
    items = [i for i in items if isinstance(i, dict)]
    for i in items:
        if i["name"] not in catalog.types:
            kind = i["kind"]
            if kind is None:
                raise GraphError(f"unknown type {i['name']!r}", "unknown_type")
            catalog.create_type(i["name"], kind, abstract="abstract" in i["annotations"])
        elif "abstract" in i["annotations"]:
            catalog.types[i["name"]].abstract = True
    for i in items:
        if i["sub"]:
            catalog.add_parent(i["name"], i["sub"])
    for i in items:
        t = catalog.types[i["name"]]
        if i["value"]:
            if i["value"][0] not in VALUE_TYPES:
                raise GraphError(f"unknown value type {i['value'][0]!r}; supported: {', '.join(VALUE_TYPES)}", "bad_type")
            t.value = i["value"][0]
            catalog.constraints.append({"type": i["name"], "annotations": i["value"][1] | i["annotations"]})
        for role, special, notes in i["relates"]:
            if role not in t.roles:
                catalog.add_role(i["name"], role, "", parent=special)
    for i in items:
        for owned, notes in i["owns"]:
            catalog.get(owned)
            store.owns.setdefault(i["name"], {})[owned] = notes
        for relation, role, _ in i["plays"]:
            line = [r for s in catalog.supertypes(relation) for r in catalog.types[s].roles]
            if role not in line:
                raise GraphError(f"{relation!r} has no role {role!r}", "unknown_role")
            plays = catalog.types[i["name"]].plays
            if f"{relation}:{role}" not in plays:
                plays.append(f"{relation}:{role}")
    catalog._changed()


def dump(store: Store) -> str:
    """The schema as a define block that defines it again."""
    note = lambda notes: "".join(f" @{k}" + (f"({', '.join(map(_shown, v))})" if v else "") for k, v in notes.items())
    lines = ["define"]
    for t in store.catalog.types.values():
        parts = [f"{t.kind} {t.name}" + (" @abstract" if t.abstract else "")] + [f"sub {p}" for p in t.parents]
        if t.value:
            kept = next((c["annotations"] for c in store.catalog.constraints if c.get("type") == t.name and "annotations" in c), {})
            parts.append(f"value {t.value}" + note({k: v for k, v in kept.items() if k != "abstract"}))
        own = set(t.roles) - {r for p in t.parents for r in store.catalog.types[p].roles}
        parts += [f"relates {r}" + (f" as {t.roles[r].parent}" if t.roles[r].parent else "") for r in t.roles if r in own]
        parts += [f"owns {a}" + note(n) for a, n in store.owns.get(t.name, {}).items()] + [f"plays {p}" for p in t.plays]
        lines.append(", ".join(parts) + ";")
    return "\n".join(lines)


def _shown(v) -> str:
    return f'"{v}"' if isinstance(v, str) and v != ".." else "" if v is None else str(v)


# writes -----------------------------------------------------------------
def _known_attributes(store: Store, a: str) -> DataFrame:
    return store.attributes.get(a, store.spark.createDataFrame([], T.StructType([T.StructField("_id", T.LongType()), T.StructField("val", _value_type(store, a))])))


def _value_type(store: Store, a: str) -> T.DataType:
    value = next((store.catalog.types[s].value for s in store.catalog.supertypes(a) if store.catalog.types[s].value), "string")
    return data_type(VALUE_TYPES[value])


def _notes(store: Store, a: str) -> dict:
    out = {}
    for s in store.catalog.supertypes(a):
        for c in store.catalog.constraints:
            if c.get("type") == s and "annotations" in c:
                out = c["annotations"] | out
    return out


def insert(store: Store, patterns: list[ast.Statement], bound: DataFrame | None) -> Store:
    """Instances, then roles, then ownerships, for every row of bound at once."""
    new = store.copy()
    m = Matcher(new)
    rows = bound if bound is not None else new.spark.range(1).select(F.lit(1).alias("_unit"))
    rows = _cut(rows.withColumn("_ins", F.monotonically_increasing_id()))
    types: dict[str, str] = {}
    for s in patterns:
        if s.kind == "isa":
            types[s.args["var"]] = s.args["type"]
        elif s.kind == "rel" and s.args["type"]:
            types.setdefault(s.args["var"], s.args["type"])
    for v, t in types.items():
        kind = new.catalog.get(t)
        if kind.abstract:
            raise GraphError(f"{t!r} is abstract", "abstract")
        if kind.kind == "attribute" or v in rows.columns:
            continue
        from quiver.graph import dense_ids

        top = new.instances.filter(F.col("type") == t).agg(F.max("_id")).first()[0]
        first = 1 + (0 if top is None else ids.id_local(top))
        numbered = dense_ids(rows, "_local", first)
        rows = _cut(numbered.withColumn(v, ids.make_id(0, kind.type_id, F.col("_local"))).drop("_local"))
        new.instances = new.instances.unionByName(rows.select(F.col(v).alias("_id"), F.lit(t).alias("type")))
    for s in patterns:
        if s.kind == "rel":
            relation = types.get(s.args["var"])
            line = new.catalog.types[relation].roles if relation else {}
            for role, v in s.args["players"]:
                player = types.get(v)
                allowed = [r for r in line if player and any(p.split(":")[1] == r or p.split(":")[1] in [x for x in line if line[x].parent == r] for x in new.catalog.supertypes(player) for p in new.catalog.types[x].plays)]
                chosen = role or next((r for r in allowed), next(iter(line), None))
                if chosen is None or (line and chosen not in line):
                    raise GraphError(f"{relation!r} has no role {role!r}", "unknown_role")
                if role and player and line and not any(p.split(":")[1] in (role, line[role].parent) for x in new.catalog.supertypes(player) for p in new.catalog.types[x].plays):
                    raise GraphError(f"{player!r} does not play {role!r}", "wrong_player")
                new.players = new.players.unionByName(rows.select(F.col(s.args["var"]).alias("rel_id"), F.lit(chosen).alias("role"), F.col(v).alias("player_id")))
    values = {s.args["left"][1]: s.args["right"] for s in patterns if s.kind == "compare" and s.args["op"] == "=="}
    for s in patterns:
        if s.kind != "has":
            continue
        a, v, owner = s.args["type"], s.args["attr"], s.args["var"]
        t = types.get(owner)
        if t and a not in new.ownable(t):
            raise GraphError(f"{t!r} does not own {a!r}", "not_owned")
        c = m.value(rows, values[v]) if v in values else F.col(f"`{v}=`")
        given = _cut(rows.select(F.col(owner).alias("owner_id"), c.cast(_value_type(new, a)).alias("val")))
        _check_values(new, a, given)
        name = F.xxhash64(F.lit(a), F.col("val"))
        fresh = given.select(name.alias("_id"), "val").distinct()
        new.attributes[a] = _known_attributes(new, a).unionByName(fresh).distinct()
        owned = given.select("owner_id", name.alias("attr_id"))
        new.owned[a] = owned if a not in new.owned else new.owned[a].unionByName(owned)
        _check_ownership(new, t, a)
    return new


def _check_values(store: Store, a: str, given: DataFrame) -> None:
    notes = _notes(store, a)
    if "values" in notes and not given.filter(~F.col("val").isin(notes["values"])).isEmpty():
        raise GraphError(f"{a!r} must be one of {notes['values']}", "values")
    if "range" in notes:
        low, high = ([x for x in notes["range"] if x != ".."] + [None, None])[:2]
        bad = F.lit(False)
        bad = bad | (F.col("val") < low) if low is not None else bad
        bad = bad | (F.col("val") > high) if high is not None else bad
        if not given.filter(bad).isEmpty():
            raise GraphError(f"{a!r} is out of range {notes['range']}", "range")


def _check_ownership(store: Store, t: str | None, a: str) -> None:
    notes = store.ownable(t).get(a, {}) if t else {}
    if "key" in notes or "unique" in notes:
        if not store.owned[a].distinct().groupBy("attr_id").count().filter("count > 1").isEmpty():
            raise GraphError(f"{t}.{a} is a key and repeats", "key")
    card = notes.get("card")
    top = card[-1] if card and isinstance(card[-1], int) else 1 if "key" in notes else None
    if top is not None and not store.owned[a].groupBy("owner_id").count().filter(F.col("count") > top).isEmpty():
        raise GraphError(f"{t} owns more than {top} {a}", "card")


def delete(store: Store, what: list, bound: DataFrame) -> Store:
    new = store.copy()
    for w in what:
        if w[0] == "thing":
            gone = _cut(bound.select(F.col(w[1]).alias("_gone")).distinct())
            new.instances = new.instances.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
            new.players = new.players.join(gone, F.col("rel_id") == F.col("_gone"), "left_anti").join(gone, F.col("player_id") == F.col("_gone"), "left_anti")
            for a in new.owned:
                new.owned[a] = new.owned[a].join(gone, F.col("owner_id") == F.col("_gone"), "left_anti")
        elif w[0] == "has":
            gone = _cut(bound.select(F.col(w[2]).alias("owner_id"), F.col(w[1]).alias("attr_id")).distinct())
            for a in new.owned:
                new.owned[a] = new.owned[a].join(gone, ["owner_id", "attr_id"], "left_anti")
        else:
            for _, p in w[1]:
                gone = _cut(bound.select(F.col(w[2]).alias("rel_id"), F.col(p).alias("player_id")).distinct())
                new.players = new.players.join(gone, ["rel_id", "player_id"], "left_anti")
    return new


def update(store: Store, patterns: list[ast.Statement], bound: DataFrame) -> Store:
    """update $x has a v: replaces all values of a."""
    new = store.copy()
    for s in patterns:
        if s.kind == "has" and s.args["type"] in new.owned:
            gone = _cut(bound.select(F.col(s.args["var"]).alias("owner_id")).distinct())
            new.owned[s.args["type"]] = new.owned[s.args["type"]].join(gone, "owner_id", "left_anti")
    return insert(new, patterns, bound)


def run(store: Store, text: str) -> tuple[Store, DataFrame | None]:
    """Run a script; the store after it and the rows of its last block."""
    result = None
    for block in ast.script(text):
        kinds = [s.kind for s in block]
        if kinds[0] == "fun":
            store.catalog.functions[block[0].args["name"]] = block[0].args["body"]
            continue
        if kinds[0] == "define":
            store = store.copy()
            for i in block[0].args["items"]:
                if isinstance(i, ast.Stage):
                    store.catalog.functions[i.args["name"]] = i.args["body"]
            define(store, block[0].args["items"])
            continue
        write = next((i for i, k in enumerate(kinds) if k in ("insert", "put", "update", "delete")), None)
        if write is None:
            result = read(store, block)
            continue
        bound = None
        for s in block[:write]:
            if s.kind == "match":
                found = Matcher(store).match(s.args["patterns"])
                bound = found if bound is None else Matcher(store).join(bound, found)
        patterns = block[write].args["patterns"]
        if kinds[write] == "put":
            if Matcher(store).match(patterns).isEmpty():
                store = insert(store, patterns, bound)
        elif kinds[write] == "insert":
            store = insert(store, patterns, bound)
        elif kinds[write] == "update":
            store = update(store, patterns, bound)
        else:
            store = delete(store, patterns, bound)
        result = None
    return store, result


def typeql(store: Store, text: str) -> DataFrame:
    """The rows of a reading query."""
    return read(store, ast.parse(text))


def explain(store: Store, text: str, mode: str = "formatted") -> str:
    """The plan of a reading query."""
    frame = typeql(store, text)
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def check(text: str) -> dict:
    try:
        return {"ok": True, "stages": [s.kind for s in ast.parse(text)]}
    except GraphError as e:
        return {"ok": False, "error": str(e), "code": e.code}
