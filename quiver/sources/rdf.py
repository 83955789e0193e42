"""RDF: Turtle / N-Triples in, N-Triples out, and the mapping onto a typed graph.

Schema triples (classes, subclasses, object properties, domains, ranges) become
types and roles on the driver; facts are mapped by joins of the triples frame.
What has no place in the graph is kept as overflow with a reason.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver import ids
from quiver.catalog import GraphError
from quiver.graph import Graph, cut, dense_ids

#: Vocabulary addresses.
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
XSD_TYPES = {"integer": "long", "int": "int", "long": "long", "decimal": "decimal", "double": "double", "float": "double", "boolean": "bool", "date": "date", "dateTime": "timestamp"}
SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s]*>)
    |(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\")
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[a-zA-Z][\w-]*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w.-]*\w|\[\s*\])
    |(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?))
    |(?P<name>[^\W\d_]?[\w-]*:[\w.-]*\w|[^\W\d_]?[\w-]*:|true\b|false\b|a\b|PREFIX\b|BASE\b)
    |(?P<op>[.;,])""",
    re.X | re.S,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def _text(raw: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPE.get(m[1], m[1]), raw)


def parse(document: str, prefixes: dict[str, str] | None = None) -> list[tuple]:
    """Triples (s, p, o, kind, datatype, lang) of a Turtle or N-Triples document."""
    prefixes, base, tokens, at = {} if prefixes is None else prefixes, "", [], 0
    while at < len(document):
        m = _TOKEN.match(document, at)
        if not m:
            raise GraphError(f"unexpected {document[at : at + 20]!r} at {at}", "syntax")
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    tokens.append(("end", ""))
    out, i, blanks = [], 0, 0

    def term(i):
        nonlocal blanks
        kind, text = tokens[i]
        if kind == "iri":
            iri = text[1:-1]
            return (iri if re.match(r"[\w+.-]+:", iri) else base + iri, "iri", None, None), i + 1
        if kind == "blank":
            if text.startswith("["):
                blanks += 1
                text = f"_:anon{blanks}"
            return (text, "blank", None, None), i + 1
        if kind in ("str", "long"):
            value = _text(text[3:-3] if kind == "long" else text[1:-1])
            if tokens[i + 1][0] == "lang":
                return (value, "literal", None, tokens[i + 1][1][1:]), i + 2
            if tokens[i + 1][0] == "type":
                (datatype, *_), i = term(i + 2)
                return (value, "literal", datatype, None), i
            return (value, "literal", None, None), i + 1
        if kind == "num":
            return (text, "literal", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None), i + 1
        if kind == "name" and text in ("true", "false"):
            return (text, "literal", XSD + "boolean", None), i + 1
        if kind == "name" and text == "a":
            return (RDF + "type", "iri", None, None), i + 1
        if kind == "name" and ":" in text:
            prefix, local = text.split(":", 1)
            if prefix not in prefixes:
                raise GraphError(f"unknown prefix {prefix!r}", "unknown_prefix")
            return (prefixes[prefix] + local, "iri", None, None), i + 1
        raise GraphError(f"unexpected {text!r}", "syntax")

    while tokens[i][0] != "end":
        kind, text = tokens[i]
        if (kind == "lang" and text in ("@prefix", "@base")) or (kind == "name" and text in ("PREFIX", "BASE")):
            if text.strip("@").lower() == "prefix":
                prefixes[tokens[i + 1][1][:-1]] = tokens[i + 2][1][1:-1]
                i += 3
            else:
                base = tokens[i + 1][1][1:-1]
                i += 2
            i += tokens[i][1] == "."
            continue
        (subject, *_), i = term(i)
        while True:
            (predicate, *_), i = term(i)
            while True:
                (o, k, datatype, lang), i = term(i)
                out.append((subject, predicate, o, k, datatype, lang))
                if tokens[i][1] != ",":
                    break
                i += 1
            if tokens[i][1] != ";":
                break
            while tokens[i][1] == ";":
                i += 1
            if tokens[i][1] == ".":
                break
        if tokens[i][1] != ".":
            raise GraphError(f"expected '.', got {tokens[i][1]!r}", "syntax")
        i += 1
    return out


_LINE = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\")(?:\^\^<([^>]*)>|@([\w-]+))?\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples files as triples, read and split in parallel."""
    line = spark.read.text(path).filter(F.rlike("value", F.lit(_LINE)))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    raw = part(3)
    kind = F.when(raw.startswith("<"), "iri").when(raw.startswith("_:"), "blank").otherwise("literal")
    bare = lambda c: F.regexp_replace(c, r"^[<\"]|[>\"]$", "")
    return line.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(kind == "blank", raw).otherwise(bare(raw)).alias("o"), kind.alias("o_kind"), F.nullif(part(4), F.lit("")).alias("datatype"), F.nullif(part(5), F.lit("")).alias("lang"))


def local(iri: str) -> str:
    return re.split(r"[#/:]", iri.rstrip("/#"))[-1]


def load(graph: Graph, document: str) -> tuple[Graph, dict]:
    new = graph.version()
    return load_triples(new, graph.spark.createDataFrame(parse(document, new.catalog.prefixes), SCHEMA))


def load_triples(graph: Graph, triples: DataFrame) -> tuple[Graph, dict]:
    """Map triples onto types, nodes and edges; (graph, report)."""
    new, spark = graph.version(), graph.spark
    catalog = new.catalog
    triples = triples.distinct()
    tbox = triples.filter(F.col("p").isin(RDF + "type", RDFS + "subClassOf", RDFS + "domain", RDFS + "range") & ((F.col("p") != RDF + "type") | F.col("o").startswith(OWL) | F.col("o").startswith(RDFS)))
    schema = [tuple(r)[:3] for r in tbox.collect()]  # schema size, not data size
    classes = {s for s, p, o in schema if p == RDF + "type" and o in (OWL + "Class", RDFS + "Class")} | {x for s, p, o in schema if p == RDFS + "subClassOf" for x in (s, o)}
    links = {s for s, p, o in schema if p == RDF + "type" and o in (OWL + "ObjectProperty", OWL + "TransitiveProperty", OWL + "SymmetricProperty")}
    for c in sorted(classes):
        if local(c) not in catalog.types:
            catalog.create_type(local(c)).iri = c
    for s, p, o in schema:
        if p == RDFS + "subClassOf":
            catalog.add_parent(local(s), local(o))
    for link in sorted(links):
        name = local(link)
        if name not in catalog.types:
            catalog.create_type(name, "relation").iri = link
            ends = {p: next((o for s, q, o in schema if s == link and q == RDFS + p), None) for p in ("domain", "range")}
            catalog.add_role(name, "subject", local(ends["domain"]) if ends["domain"] in classes else "", 0)
            catalog.add_role(name, "object", local(ends["range"]) if ends["range"] in classes else "", 1)
    for s, p, o in schema:
        if p == RDF + "type" and o in (OWL + "TransitiveProperty", OWL + "SymmetricProperty"):
            catalog.add_rule(local(s), local(o))
    facts = triples.join(tbox, ["s", "p", "o"], "left_anti")
    typed = facts.filter((F.col("p") == RDF + "type") & F.col("o").isin(sorted(classes)))
    # A subject of several classes belongs to the deepest.
    depth = {c: len(catalog.supertypes(local(c))) for c in classes}
    rank = F.coalesce(*(F.when(F.col("o") == c, F.lit(d)) for c, d in sorted(depth.items())), F.lit(0)) if depth else F.lit(0)
    known = typed.groupBy("s").agg(F.max_by("o", F.struct(rank, F.col("o"))).alias("class"))
    # Subjects are numbered densely above the ids in use, so two of them never share an id; those that are known keep theirs.
    first = 1 + max((ids.id_local(top) for f in new.nodes.values() if (top := f.agg(F.max("_id")).first()[0]) is not None), default=0)
    old = new.iris.select(F.col("iri").alias("s"), ids.id_local(F.col("_id")).alias("_old")) if new.iris is not None else spark.createDataFrame([], "s string, _old long")
    known = cut(dense_ids(cut(known), "_new", first).join(old, "s", "left").select("s", "class", F.coalesce("_old", "_new").alias("_local")))
    number = F.lit(None).cast("long")
    for c in sorted(classes):
        number = F.when(F.col("class") == c, ids.make_id(0, catalog.types[local(c)].type_id, F.col("_local"))).otherwise(number)
    known = known.select("s", "class", number.alias("_id"))
    names = [r[0] for r in facts.filter(F.col("o_kind") == "literal").join(known, "s", "left_semi").select("p").distinct().collect()]
    for c in sorted(classes):
        t = local(c)
        mine = known.filter(F.col("class") == c).select("s", "_id")
        values = facts.filter(F.col("o_kind") == "literal").join(mine, "s").withColumn("name", F.concat(F.regexp_extract("p", r"([^#/]+)$", 1), F.coalesce(F.concat(F.lit("@"), "lang"), F.lit(""))))
        here = values.groupBy("name").agg(F.max("datatype").alias("datatype"), F.count_distinct("datatype").alias("n")).collect()
        for r in here:
            kind = XSD_TYPES.get(local(r["datatype"]), "string") if r["datatype"] and r["n"] == 1 else "string"
            if r["name"] not in catalog.types[t].properties:
                catalog.add_property(t, r["name"], kind)
        columns = sorted(r["name"] for r in here)
        wide = values.groupBy("_id").pivot("name", columns).agg(F.min("o")) if columns else None
        base = mine.select("_id", F.col("s").alias("_iri"))
        from quiver.catalog import data_type

        frame = base if wide is None else base.join(wide, "_id", "left")
        frame = frame.select("_id", *(F.col(f"`{n}`").try_cast(data_type(catalog.types[t].properties[n].data_type)).alias(n) for n in columns), F.struct(F.col("_iri").alias("iri")).alias("_ext"))
        new.nodes[t] = frame.drop("_ext") if t not in new.nodes else new.nodes[t].unionByName(frame.drop("_ext"), allowMissingColumns=True)
    new.iris = known.select("_id", F.col("s").alias("iri")) if new.iris is None else new.iris.unionByName(known.select("_id", F.col("s").alias("iri"))).distinct()
    edge_count = 0
    for link in sorted(links):
        t = local(link)
        pairs = facts.filter((F.col("p") == link) & (F.col("o_kind") != "literal")).select("s", "o")
        ends = pairs.join(known.select("s", F.col("_id").alias("_src")), "s").join(known.select(F.col("s").alias("o"), F.col("_id").alias("_dst")), "o")
        top = new.edges[t].agg(F.max("_id")).first()[0] if t in new.edges else None
        numbered = dense_ids(cut(ends.select("_src", "_dst").distinct()), "_local", 1 if top is None else ids.id_local(top) + 1)
        frame = cut(numbered.select(ids.make_id(0, catalog.types[t].type_id, F.col("_local")).alias("_id"), "_src", "_dst"))
        new.edges[t] = frame if t not in new.edges else new.edges[t].unionByName(frame)
        edge_count += frame.count()
    # Overflow: facts of unknown subjects, links to unknown objects, unmapped predicates.
    mapped = F.col("p").isin(sorted(links))
    is_type = (F.col("p") == RDF + "type") & F.col("o").isin(sorted(classes))
    subjects = known.select("s", F.lit(True).alias("_known"))
    objects = known.select(F.col("s").alias("o"), F.lit(True).alias("_object"))
    rest = facts.filter(~is_type).join(subjects, "s", "left").join(objects, "o", "left")
    reason = F.when(F.col("_known").isNull(), "untyped subject").when((F.col("o_kind") != "literal") & ~mapped, "unmapped predicate").when((F.col("o_kind") != "literal") & F.col("_object").isNull(), "untyped object")
    new.overflow = rest.withColumn("reason", reason).filter("reason is not null").select("s", "p", "o", "o_kind", "datatype", "lang", "reason")
    report = {"classes": len(classes), "relations": len(links), "nodes": known.count(), "edges": edge_count, "properties": len(names), "overflow": new.overflow.count()}
    return new, report


def dump(graph: Graph) -> DataFrame:
    """The graph as N-Triples lines (column `line`): schema, nodes, properties, edges, overflow."""
    from functools import reduce

    spark, catalog = graph.spark, graph.catalog
    iri_of = lambda t: catalog.types[t].iri or f"urn:quiver:{t}"
    lines = []
    for t in catalog.types.values():
        kind = OWL + ("ObjectProperty" if t.kind == "relation" else "Class")
        lines.append(f"<{iri_of(t.name)}> <{RDF}type> <{kind}> .")
        lines += [f"<{iri_of(t.name)}> <{RDFS}subClassOf> <{iri_of(p)}> ." for p in t.parents]
        for r in t.roles.values():
            if r.player in catalog.types and r.ordinal < 2:
                lines.append(f"<{iri_of(t.name)}> <{RDFS}{('domain', 'range')[r.ordinal]}> <{iri_of(r.player)}> .")
    frames = [spark.createDataFrame([(x,) for x in lines], "line string")]
    names = graph.iris.select("_id", "iri") if graph.iris is not None else spark.createDataFrame([], "_id long, iri string")
    bracket = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    for t, frame in graph.nodes.items():
        have = frame.join(names, "_id", "left").withColumn("_s", bracket(F.coalesce("iri", F.concat(F.lit("urn:quiver:node:"), "_id"))))
        frames.append(have.select(F.concat_ws(" ", "_s", F.lit(f"<{RDF}type>"), F.lit(f"<{iri_of(t)}>"), F.lit(".")).alias("line")))
        for p in catalog.types[t].properties.values():
            if p.name in frame.columns:
                prop, _, lang = p.name.partition("@")
                datatype = next((x for x, k in XSD_TYPES.items() if k == p.data_type), None)
                tail = f'"@{lang}' if lang else f'"^^<{XSD}{datatype}>' if datatype else '"'
                frames.append(have.filter(F.col(f"`{p.name}`").isNotNull()).select(F.concat(F.col("_s"), F.lit(f' <{p.iri or "urn:quiver:" + prop}> "'), escape(F.col(f"`{p.name}`")), F.lit(tail + " .")).alias("line")))
    for t, frame in graph.edges.items():
        ends = frame.join(names.select(F.col("_id").alias("_src"), F.col("iri").alias("_a")), "_src", "left").join(names.select(F.col("_id").alias("_dst"), F.col("iri").alias("_b")), "_dst", "left")
        end = lambda n, c: bracket(F.coalesce(n, F.concat(F.lit("urn:quiver:node:"), c)))
        frames.append(ends.select(F.concat_ws(" ", end(F.col("_a"), F.col("_src")), F.lit(f"<{iri_of(t)}>"), end(F.col("_b"), F.col("_dst")), F.lit(".")).alias("line")))
    if graph.overflow is not None:
        o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), "lang"), F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit("")))).when(F.col("o_kind") == "iri", bracket(F.col("o"))).otherwise(F.col("o"))
        s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(bracket(F.col("s")))
        frames.append(graph.overflow.select(F.concat_ws(" ", s, bracket(F.col("p")), o, F.lit(".")).alias("line")))
    return reduce(DataFrame.unionByName, frames)


def mapping_report(graph: Graph) -> DataFrame:
    """Overflow triples by reason."""
    if graph.overflow is None:
        return graph.spark.createDataFrame([], "reason string, n long")
    return graph.overflow.groupBy("reason").agg(F.count("*").alias("n"))
