"""The catalog of a graph: types with multiple inheritance, properties, roles and rules.

It lives on the driver and is small; frames() shows it as DataFrames.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from quiver.ids import MAX_TYPE


class GraphError(ValueError):
    """An error with a code and suggestions."""

    def __init__(self, message: str, code: str = "invalid", suggestions: tuple[str, ...] = ()):
        super().__init__(message + (f" (did you mean {', '.join(suggestions)}?)" if suggestions else ""))
        self.code, self.suggestions = code, suggestions


#: Declared type names and the Spark types that hold them.
TYPE_NAMES = {
    "string": T.StringType(), "text": T.StringType(), "str": T.StringType(), "uuid": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(),
    "long": T.LongType(), "bigint": T.LongType(), "int8": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "float8": T.DoubleType(), "real": T.FloatType(), "float4": T.FloatType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "datetime": T.TimestampType(), "timestamptz": T.TimestampType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(),
    "numeric": T.DecimalType(38, 10), "decimal": T.DecimalType(38, 10),
    "text[]": T.ArrayType(T.StringType()), "int[]": T.ArrayType(T.LongType()), "bigint[]": T.ArrayType(T.LongType()),
    "duration": T.DayTimeIntervalType(),
}


def data_type(name: str) -> T.DataType:
    known = TYPE_NAMES.get(name.strip().lower())
    if known is None and re.fullmatch(r"vector\(\d+\)", name.strip().lower()):
        return T.ArrayType(T.FloatType())
    if known is None:
        raise GraphError(f"unsupported data type {name!r}; supported: {', '.join(sorted(TYPE_NAMES))}, vector(n)", "bad_type")
    return known


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def suggest(name: str, known) -> tuple[str, ...]:
    """The three nearest names within half the length of the name."""
    near = sorted((edit_distance(name.lower(), k.lower()), k) for k in known)
    return tuple(k for d, k in near if d <= max(2, len(name) // 2))[:3]


@dataclass
class Property:
    name: str
    data_type: str
    required: bool = False
    key: bool = False
    unique: bool = False
    card: tuple[int, int | None] = (0, 1)
    values: tuple = ()
    span: tuple = ()
    iri: str | None = None


@dataclass
class Role:
    name: str
    player: str
    ordinal: int
    card: tuple[int, int | None] = (0, None)
    parent: str | None = None


@dataclass
class GraphType:
    name: str
    type_id: int
    kind: str  # entity, relation, attribute
    parents: list[str] = field(default_factory=list)
    abstract: bool = False
    properties: dict[str, Property] = field(default_factory=dict)
    roles: dict[str, Role] = field(default_factory=dict)
    value: str | None = None
    iri: str | None = None
    plays: list[str] = field(default_factory=list)


class Catalog:
    def __init__(self):
        self.types: dict[str, GraphType] = {}
        self.policies: dict[str, str] = {}
        self.indexes: dict[str, dict] = {}
        self.embeddings: dict[tuple[str, str], dict] = {}
        self.rules: list[dict] = []
        self.constraints: list[dict] = []
        self.functions: dict[str, str] = {}
        self.prefixes: dict[str, str] = {}
        self.settings: dict[str, str] = {}
        self.agents: dict[str, dict] = {}
        self.version = 0
        self._labels: dict | None = None

    # types ---------------------------------------------------------------
    def _changed(self) -> None:
        self.version += 1
        self._labels = None

    def get(self, name: str) -> GraphType:
        found = self.types.get(name)
        if found is None:
            raise GraphError(f"unknown type {name!r}", "unknown_type", suggest(name, self.types))
        return found

    def create_type(self, name: str, kind: str = "entity", parents=(), abstract: bool = False) -> GraphType:
        if name in self.types:
            raise GraphError(f"type {name!r} exists", "duplicate_type")
        if kind not in ("entity", "relation", "attribute"):
            raise GraphError(f"kind must be entity, relation or attribute, not {kind!r}")
        if len(self.types) >= MAX_TYPE:
            raise GraphError("too many types")
        for p in parents:
            if self.get(p).kind != kind:
                raise GraphError(f"parent {p!r} is of another kind", "kind_mismatch")
        made = GraphType(name, 1 + max((t.type_id for t in self.types.values()), default=0), kind, list(parents), abstract)
        for p in parents:
            made.properties |= {k: Property(**(asdict(v))) for k, v in self.types[p].properties.items()}
            made.roles |= self.types[p].roles
        self.types[name] = made
        self._changed()
        return made

    def add_parent(self, name: str, parent: str) -> None:
        if name in self.supertypes(parent):
            raise GraphError(f"{parent!r} below {name!r} would be a cycle", "cycle")
        mine, theirs = self.get(name), self.get(parent)
        if mine.kind != theirs.kind:
            raise GraphError(f"parent {parent!r} is of another kind", "kind_mismatch")
        if parent not in mine.parents:
            mine.parents.append(parent)
            for sub in self.subtypes(name):
                for p in theirs.properties.values():
                    self.types[sub].properties.setdefault(p.name, Property(**asdict(p)))
            self._changed()

    def drop_type(self, name: str, cascade: bool = False) -> list[str]:
        below = [s for s in self.subtypes(name) if s != name]
        if below and not cascade:
            raise GraphError(f"{name!r} has subtypes {', '.join(below)}", "has_subtypes")
        gone = [name, *below]
        for g in gone:
            del self.types[g]
        for t in self.types.values():
            t.parents = [p for p in t.parents if p not in gone]
        self._changed()
        return gone

    def rename_type(self, name: str, new: str) -> None:
        if new in self.types:
            raise GraphError(f"type {new!r} exists", "duplicate_type")
        t = self.get(name)
        self.types = {(new if k == name else k): v for k, v in self.types.items()}
        t.name = new
        for x in self.types.values():
            x.parents = [new if p == name else p for p in x.parents]
            for r in x.roles.values():
                if r.player == name:
                    r.player = new
        self._changed()

    def add_property(self, type_name: str, name: str, kind: str, required: bool = False, key: bool = False, **more) -> None:
        if not kind.lower().startswith("vector"):
            data_type(kind)
        for sub in self.subtypes(type_name):
            self.types[sub].properties[name] = Property(name, kind, required, key, **more)
        self._changed()

    def add_role(self, relation: str, name: str, player: str, ordinal: int | None = None, card=(0, None), parent: str | None = None) -> None:
        t = self.get(relation)
        if t.kind != "relation":
            raise GraphError(f"{relation!r} is no relation", "kind_mismatch")
        for sub in self.subtypes(relation):
            roles = self.types[sub].roles
            roles[name] = Role(name, player, len(roles) if ordinal is None else ordinal, card, parent)
        self._changed()

    def add_rule(self, relation: str, characteristic: str, target: str | None = None) -> None:
        self.get(relation)
        self.rules.append({"relation": relation, "characteristic": characteristic, "target": target})
        self._changed()

    # inheritance ---------------------------------------------------------
    def _children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {n: [] for n in self.types}
        for t in self.types.values():
            for p in t.parents:
                out[p].append(t.name)
        return out

    def labels(self) -> list[dict]:
        """Interval labels: one row for each root path of a type; containment is inheritance."""
        if self._labels is None:
            children, rows = self._children(), []

            def walk(name: str, at: int, depth: int, path: tuple[str, ...]) -> int:
                if name in path:
                    raise GraphError(f"inheritance cycle at {name!r}", "cycle")
                row = {"type_id": self.types[name].type_id, "name": name, "path_id": len(rows), "lft": at, "depth": depth}
                rows.append(row)
                at += 1024
                for c in sorted(children[name]):
                    at = walk(c, at, depth + 1, (*path, name))
                row["rgt"] = at
                return at + 1024

            at = 0
            for root in sorted(n for n, t in self.types.items() if not t.parents):
                at = walk(root, at, 0, ())
            self._labels = rows
        return self._labels

    def subtypes(self, name: str, proper: bool = False) -> list[str]:
        self.get(name)
        mine = [r for r in self.labels() if r["name"] == name]
        found = {r["name"] for r in self.labels() if any(m["lft"] <= r["lft"] and r["rgt"] <= m["rgt"] for m in mine)}
        return sorted(found - ({name} if proper else set()), key=lambda n: self.types[n].type_id)

    def supertypes(self, name: str) -> list[str]:
        out, todo = [], [name]
        while todo:
            n = todo.pop(0)
            if n not in out:
                out.append(n)
                todo += self.get(n).parents
        return out

    def is_subtype(self, sub: str, of: str) -> bool:
        return of in self.supertypes(sub)

    def concrete(self, name: str) -> list[str]:
        return [s for s in self.subtypes(name) if not self.types[s].abstract]

    def resolve(self, groups: list[list[str]], kind: str = "entity") -> list[str]:
        """Concrete types that carry, of each group of alternatives, at least one label.

        Unknown labels match nothing.
        """
        found = {n for n, t in self.types.items() if t.kind == kind and not t.abstract}
        for alternatives in groups:
            found &= {c for a in alternatives if a in self.types for c in self.concrete(a)}
        return sorted(found, key=lambda n: self.types[n].type_id)

    def by_id(self, type_id: int) -> GraphType:
        return next(t for t in self.types.values() if t.type_id == type_id)

    # frames --------------------------------------------------------------
    def frames(self, spark) -> dict:
        """The catalog as DataFrames: type, type_parent, type_label, property, role."""
        rows = {
            "type": ([(t.type_id, t.name, t.kind, t.abstract, t.iri) for t in self.types.values()], "type_id int, name string, kind string, abstract boolean, iri string"),
            "type_parent": ([(t.type_id, self.types[p].type_id) for t in self.types.values() for p in t.parents], "type_id int, parent_id int"),
            "type_label": ([(r["type_id"], r["path_id"], r["lft"], r["rgt"], r["depth"]) for r in self.labels()], "type_id int, path_id int, lft long, rgt long, depth int"),
            "property": ([(t.name, p.name, p.data_type, p.required, p.key, p.iri) for t in self.types.values() for p in t.properties.values()], "type string, name string, data_type string, required boolean, key boolean, iri string"),
            "role": ([(t.name, r.name, r.player, r.ordinal, r.parent) for t in self.types.values() for r in t.roles.values()], "relation string, name string, player string, ordinal int, parent string"),
        }
        return {k: spark.createDataFrame(v, s) for k, (v, s) in rows.items()}

    # persistence ---------------------------------------------------------
    def to_json(self) -> str:
        return json.dumps({"types": {k: asdict(v) for k, v in self.types.items()}} | {k: getattr(self, k) for k in ("policies", "indexes", "rules", "constraints", "functions", "prefixes", "settings", "agents", "version")} | {"embeddings": [[*k, v] for k, v in self.embeddings.items()]})

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw, out = json.loads(text), cls()
        for k, v in raw.pop("types").items():
            v["properties"] = {n: Property(**p) for n, p in v["properties"].items()}
            v["roles"] = {n: Role(**r) for n, r in v["roles"].items()}
            out.types[k] = GraphType(**v)
        out.embeddings = {(a, b): v for a, b, v in raw.pop("embeddings")}
        for k, v in raw.items():
            setattr(out, k, v)
        return out
