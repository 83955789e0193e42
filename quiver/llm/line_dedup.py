"""Line dedup: near-equal lines by MinHash over character shingles; DataFrame functions only.

A line's set holds the hashes of its SHINGLE characters from every character on
(UTF-16 units; a line of fewer is one shingle).  Lines are near-equal if
100 * intersection >= 80 * union of their sets.

1. Signature: the least hash of the set under each of 21 orders (the hash turned
   by a mask).  A band is three of them, and there are seven.  Two lines at
   similarity 0.8 share a band with probability 0.99 or more (0.97, if they have
   ten shingles in all).
2. Banding: in each bucket of a band every line is paired with LEADERS lines of it, the
   least under as many orders of the ids.
3. Estimate: of a pair that is verified at least AGREE of the 21 minima agree, by
   their last BITS.  At similarity 0.8 that misses one pair in 10,000 or fewer; lines
   whose minima are fewer than SPREAD shingles are verified whatever it says.
4. Verification: exact Jaccard similarity of each pair's sets.
5. Distributed union-find over the verified pairs.  In a bucket that then still
   holds several components the lines that are like another one are compared in
   cells of about CELL x CELL lines, with estimate and similarity in the join's
   condition: first those outside of the largest component with it, where one
   link is enough, then what is left with all others outside.
6. Of each component the first line by (doc_id, text, position) is kept, the
   others are removed.

Equal lines have one id (a 64-bit hash) and need no pairs, however many they
are.  Lines of white space only are left alone.

Nulls: a null text has no lines and stays null; a null doc_id sorts after all
ids.  Rows with the same doc_id and the same text (null ids, too) are one
document: their lines are cut alike; rows that share a doc_id, or have none, but
differ in text are documents of their own.  Ties of doc_id go by a hash of the
text.  An empty text has one blank line.  A very long line is one row of
shingles at a time; a document's removed positions are one row.  An empty table
gives an empty result.  Other columns are carried; `n_lines` and `n_removed` are
replaced if they were there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import order_key, shuffle_partitions, written
from quiver.llm.components import components

SHINGLE = 7
#: Shingles that are hashed in one row.
STRIDE = 16
BANDS, ROWS = 7, 3
#: Masks of the orders: each turns other leading bits, so their least hashes lie in other regions.
MASKS = [((i * 0x9E3779B97F4A7C15 & (1 << 59) - 1) | (int(f"{i:05b}"[::-1], 2) << 59)) - (int(f"{i:05b}"[::-1], 2) >> 4 << 64) for i in range(BANDS * ROWS)]
#: Their upper halves, as ints.
HALVES = [m >> 32 for m in MASKS]
#: A sketch has the last BITS of each minimum, FIELDS of them in its first half.
BITS, FIELDS = 5, 11
#: Minima that agree in a pair that is verified, if each line's minima are SPREAD shingles or more.
AGREE, SPREAD = 9, 12
PERCENT = 80
LEADERS = 2
#: Lines of a bucket in each side of a cell, about; sketches are compared in larger ones.
CELL, SKETCHES = 512, 2048
#: Bits of the filter that keeps most lines which are in no bucket from being moved.
MOST_FILTER_BITS = 1 << 25


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _starts(units: Column) -> Column:
    """First bytes, from 1, of the shingles of a line's UTF-16 units; one at least."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - (2 * SHINGLE - 1)), F.lit(2))


def _shingle(units: Column, i: Column) -> Column:
    return F.xxhash64(F.substring(units, i, F.lit(2 * SHINGLE)))


def _hashes(line: Column) -> Column:
    """Hashes of the character shingles of a line by place, repeats and all."""
    # The array of one binds the encoded line, so it is not encoded again for each shingle.
    each = F.transform(F.array(_units(line)), lambda u: F.transform(_starts(u), lambda i: _shingle(u, i)))
    return F.get(each, F.lit(0))


def shingles(line: Column) -> Column:
    """Distinct hashes of the character shingles of a line."""
    return F.array_distinct(_hashes(line))


def _once(df: DataFrame, *columns: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """df.select(*keep, *columns), each of the columns worked out once a row.

    Generated code puts a projection off to where it is used, which can be inside the
    loop of an explode or over the matches of a join.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def _lines(documents: DataFrame) -> DataFrame:
    """doc, row, pos, line of each line that is not blank; row tells rows of one doc_id apart."""
    split = _once(documents, order_key("doc_id").alias("doc"), F.xxhash64("text").alias("row"), F.split("text", "\n").alias("lines"))
    return split.select("doc", "row", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _strides(units: DataFrame) -> DataFrame:
    """id, h0, h1, ..: the hashes of the shingles of (id, units), STRIDE neighbours a row.

    So there are as many fewer rows to aggregate.  Places beyond the last start are the last one again.
    """
    last = F.greatest(F.lit(1), F.octet_length("units") - (2 * SHINGLE - 1))
    each = units.select("id", "units", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * STRIDE))).alias("i"))
    return each.select("id", *(_shingle(F.col("units"), F.least(F.col("i") + 2 * j, F.col("last"))).alias(f"h{j}") for j in range(STRIDE)))


def line_keys(lines: DataFrame) -> DataFrame:
    """id, the band keys and the sketch (s0, s1) of each distinct line."""
    each = _strides(_once(lines, F.xxhash64("line").alias("id"), _units(F.col("line")).alias("units")))
    # The upper half of a hash is enough to tell it.
    each = each.select("id", *(F.shiftright(f"h{j}", 32).cast("int").alias(f"h{j}") for j in range(STRIDE)))
    least = each.groupBy("id").agg(*(F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(STRIDE)))).alias(f"m{i}") for i, m in enumerate(HALVES)))
    keys = (F.xxhash64(F.lit(i), *(f"m{i + BANDS * j}" for j in range(ROWS))).alias(f"k{i}") for i in range(BANDS))
    return least.select("id", *keys, *_sketch())


def _sketch() -> list[Column]:
    """s0, s1: the last BITS of each minimum; s0 is negative if few shingles hold all the minima."""
    last = [F.col(f"m{i}").bitwiseAND(F.lit((1 << BITS) - 1)).cast("long") for i in range(BANDS * ROWS)]
    parts = last[:FIELDS], last[FIELDS:]
    packed = [reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(f, BITS * i) for i, f in enumerate(part))) for part in parts]
    held = F.size(F.array_distinct(F.array(*(F.col(f"m{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(HALVES)))))
    return [F.when(held < SPREAD, packed[0].bitwiseOR(F.lit(-1 << 63))).otherwise(packed[0]).alias("s0"), packed[1].alias("s1")]


def _alike(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether at least AGREE of the minima agree, by their last BITS, or there are few shingles."""
    lowest = F.lit(sum(1 << BITS * i for i in range(FIELDS)))

    def unlike(x: Column, y: Column) -> Column:
        both = x.bitwiseXOR(y)
        any_bit = reduce(lambda p, q: p.bitwiseOR(q), (F.shiftrightunsigned(both, i) for i in range(1, BITS)), both)
        return F.bit_count(any_bit.bitwiseAND(lowest))

    return (x0.bitwiseOR(y0) < 0) | (unlike(x0, y0) + unlike(x1, y1) <= BANDS * ROWS - AGREE)


def signatures(lines: DataFrame) -> DataFrame:
    """doc, pos, id, the band keys and the sketch of each line."""
    return lines.select("doc", "pos", F.xxhash64("line").alias("id")).join(line_keys(lines), "id")


def _similar(x: Column, y: Column, n_x: Column, n_y: Column) -> Column:
    """Whether two lines' sets, of n_x and n_y shingles, reach the threshold; x and y are the hashes with repeats.

    What x alone has is distinct whether x is or not.  It costs about half of an
    intersection, which keeps the common hashes in a second set.
    """
    common = n_x - F.size(F.array_except(x, y))
    return (100 + PERCENT) * common >= PERCENT * (n_x + n_y)


def _verified(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets reach the threshold."""
    left = told.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("n").alias("n_a"))
    right = told.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("n").alias("n_b"))
    # Sizes rule pairs out before the sets are made.
    met = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return met.filter(_similar(_hashes(F.col("x")), _hashes(F.col("y")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _wanted(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line of the lines with those ids.

    A bitmap of the ids, 16 bits for each up to MOST_FILTER_BITS, is sent to all
    tasks (its size is bounded by that); beyond, it lets more lines pass to the join.
    """
    bits = 1 << 15
    wanted = 16 * ids.count()
    while bits < wanted and bits < MOST_FILTER_BITS:
        bits *= 2
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = ids.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = lines.select(F.xxhash64("line").alias("id"), "line").withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "word")
    found = found.filter(F.col("bits").bitwiseAND(one) != 0).select("id", "line")
    # An inner join: a semi join would be pushed below the bitmap and move every line.
    return found.join(ids.hint("shuffle_hash"), "id").groupBy("id").agg(F.min("line").alias("line"))


def _parts(n: Column, cell: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / cell)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _crowded(crowd: DataFrame) -> DataFrame:
    """The members (key, size, id, s0, s1) of each bucket whose sketch is like that of another one."""
    dealt = crowd.withColumn("parts", _parts(F.col("size"), SKETCHES)).withColumn("place", F.pmod(F.xxhash64("id", F.lit(9)), "parts").cast("int"))
    left = dealt.select("key", F.col("place").alias("i"), _every("parts").alias("j"), "id", "s0", "s1")
    right = dealt.select("key", _every("parts").alias("i"), F.col("place").alias("j"), F.col("id").alias("to"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    same = (left["key"] == right["key"]) & (left["i"] == right["i"]) & (left["j"] == right["j"])
    like = _alike(F.col("s0"), F.col("s1"), F.col("t0"), F.col("t1"))
    return left.join(right.hint("shuffle_hash"), same & (F.col("id") != F.col("to")) & like, "left_semi").select("key", "id", "s0", "s1").distinct()


def _between(members: DataFrame, near: DataFrame, told: DataFrame) -> DataFrame:
    """Links between the components of `near` among the members (key, id, s0, s1) of each bucket."""
    placed = components(near).select(F.col("node").alias("id"), "component")
    classed = written(members.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id")), "line-members")
    inside = classed.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = inside.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("classes")).filter("classes > 1")
    facts = largest.select("key", F.col("top.component").alias("largest"), _parts(F.col("all") - F.col("top.n"), CELL).alias("outer"), _parts(F.col("top.n"), CELL).alias("inner"))
    dealt = written(classed.join(facts, "key").join(told, "id").withColumn("h", F.xxhash64("id", F.lit(9))), "line-groups")
    cell, cells = ("key", "i", "j"), shuffle_partitions(told.sparkSession)
    fields = "component", "largest", "n", "s0", "s1", "line"

    def meet(left: DataFrame, right: DataFrame, of: str, how: str) -> DataFrame:
        """Near-equal lines of different components, met in cells; lines are dealt out as text, their shingles are hashed where they meet."""
        x = left.select("key", F.pmod("h", "outer").cast("int").alias("i"), _every(of).alias("j"), *fields)
        y = right.select("key", _every("outer").alias("i"), F.pmod("h", of).cast("int").alias("j"), *fields)
        x, y = (_once(side.repartition(cells, *cell), F.struct(*fields[:-1], _hashes(F.col("line")).alias("hashes")).alias(name), keep=cell) for side, name in ((x, "x"), (y, "y")))
        sizes = (100 * F.col("x.n") >= PERCENT * F.col("y.n")) & (100 * F.col("y.n") >= PERCENT * F.col("x.n"))
        same = (x["key"] == y["key"]) & (x["i"] == y["i"]) & (x["j"] == y["j"])
        like = _alike(F.col("x.s0"), F.col("x.s1"), F.col("y.s0"), F.col("y.s1"))
        return x.join(y.hint("shuffle_hash"), same & (F.col("x.component") != F.col("y.component")) & sizes & like & _similar(F.col("x.hashes"), F.col("y.hashes"), F.col("x.n"), F.col("y.n")), how)

    outer = dealt.filter("component <> largest")
    # One line of the largest component is enough to join it; what has joined it need not meet its like.
    joined = written(meet(outer, dealt.filter("component = largest"), "inner", "left_semi").select("key", "x.component", "x.largest").distinct(), "line-joined")
    others = meet(outer.join(joined.select("key", "component"), ["key", "component"], "left_anti"), outer, "outer", "inner")
    links = others.select(F.col("x.component").alias("a"), F.col("y.component").alias("b"))
    return links.unionByName(joined.select(F.col("component").alias("a"), F.col("largest").alias("b"))).distinct()


def line_links(lines: DataFrame, signed: DataFrame) -> DataFrame:
    """Verified pairs (a, b) of ids of near-equal lines (between groups: of the least ids of their components)."""
    facts = *(f"k{i}" for i in range(BANDS)), "s0", "s1"
    return _links(lines, signed.groupBy("id").agg(*(F.min(k).alias(k) for k in facts)))


def _links(lines: DataFrame, signed: DataFrame) -> DataFrame:
    keys = [f"k{i}" for i in range(BANDS)]
    dealt = signed.select("id", "s0", "s1", F.explode(F.array_distinct(F.array(*keys))).alias("key")).repartition("key")
    turned = [F.col("id").bitwiseXOR(F.lit(m)) for m in MASKS[:LEADERS]]
    leaders = dealt.groupBy("key").agg(F.count("*").alias("size"), *(F.min(t).alias(f"l{i}") for i, t in enumerate(turned))).filter("size > 1")
    leads = [(F.col(f"l{i}") == t).alias(f"l{i}") for i, t in enumerate(turned)]
    held = written(dealt.join(leaders.hint("shuffle_hash"), "key").select("key", "size", "id", "s0", "s1", *leads), "line-buckets")
    heads = held.groupBy("key").agg(*(F.min(F.when(F.col(f"l{i}"), F.col(c))).alias(f"{c}_{i}") for i in range(LEADERS) for c in ("id", "s0", "s1")))
    lead = F.array(*(F.struct(*(F.col(f"{c}_{i}").alias(c) for c in ("id", "s0", "s1"))) for i in range(LEADERS)))
    met = held.join(heads.select("key", lead.alias("lead")).hint("shuffle_hash"), "key").select("id", "s0", "s1", F.explode("lead").alias("to")).filter(F.col("id") != F.col("to.id"))
    met = met.filter(_alike(F.col("s0"), F.col("s1"), F.col("to.s0"), F.col("to.s1")))
    pairs = written(met.select(F.greatest("id", "to.id").alias("a"), F.least("id", "to.id").alias("b")).distinct(), "line-pairs")
    # The leaders have been compared with all; two others or more are left to compare.
    others = held.filter(~reduce(lambda x, y: x | y, (F.col(f"l{i}") for i in range(LEADERS))))
    members = written(_crowded(others.filter("size > 2")), "line-crowds")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct(), "line-ids")
    told = written(_wanted(lines, ids).select("id", "line", F.size(shingles(F.col("line"))).alias("n")), "line-candidates")
    near = written(_verified(pairs, told), "line-near")
    return near.unionByName(written(_between(members, near, told), "line-rest"))


def removed_lines(documents: DataFrame) -> DataFrame:
    """doc, row, removed (sorted positions) of the documents that lose lines."""
    lines = _lines(documents)
    placed = written(lines.select("doc", "row", "pos", F.xxhash64("line").alias("id")), "line-places")
    signed = written(line_keys(lines), "line-signatures")
    merged = components(_links(lines, signed)).select(F.col("node").alias("id"), F.col("component").alias("class"))
    # Counts by line, then first places by line and by class of those that are not alone: common lines are aggregated before they meet.
    often = placed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(None).cast("long").alias("class"))
    often = often.unionByName(merged).groupBy("id").agg(F.coalesce(F.min("class"), F.col("id")).alias("class"))
    placed = written(placed.join(often, "id"), "line-repeats")
    first = placed.groupBy("id", "class").agg(F.min(F.struct("doc", "row", "pos")).alias("first"))
    kept = first.groupBy("class").agg(F.min("first").alias("kept"))
    gone = placed.join(kept, "class").filter("struct(doc, row, pos) <> kept")
    return gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def line_dedup(documents: DataFrame) -> DataFrame:
    """documents with n_lines, n_removed and the text that is left; other columns as they are."""
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    gone = written(removed_lines(documents), "line-removed")
    # One byte a line up to the last removed one, so that a line is looked up by its place.
    marks = F.transform("removed", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, -1).otherwise(F.get("removed", i - 1)) - 1), F.lit("1")))
    gone = gone.select(F.col("doc").alias("_line_doc"), F.col("row").alias("_line_row"), F.size("removed").alias("_line_gone"), F.array_join(marks, "").cast("binary").alias("_line_mark"))
    keyed = documents.select(*names, order_key("doc_id").alias("_line_doc"), F.xxhash64("text").alias("_line_row"))
    joined = keyed.join(gone.hint("shuffle_hash"), ["_line_doc", "_line_row"], "left")
    lines = F.split("text", "\n")
    one = F.lit("1").cast("binary")
    left = F.array_join(F.filter(lines, lambda _, i: F.substring(F.col("_line_mark"), i + 1, F.lit(1)) != one), "\n")
    return joined.select(
        *(c for c in names if c != "text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("_line_gone", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
