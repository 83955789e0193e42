"""N-gram Jaccard join of documents with token-combination prefixes.

A document's set holds the hashes of its distinct shingles of K words (A-Z
lower-cased); two documents link when 100 * intersection >= 80 * union.

Documents with equal sets are one node (a 64-bit key of the set), however many
they are; everything below works on nodes.  Of linked sets of n and m tokens at
most spare(n) = n - ceil(0.8 n) tokens of the first are not in the second, so in
any order the first T common tokens lie within the first spare + T of each.

1. Candidates.  In the order of the hash, each node gives its first
   spare(n) + need(n) tokens, need(n) being 4 + n / 16 (0.8 n at most).  A node
   of which fewer than need(n) of these are met in another node links with
   nothing.  Tokens repeated within a chunk are settled there, so a common token
   is one row a chunk, however many documents hold it.
2. The sets of the candidates are written; the texts are read no more.
3. Token classes.  A token of FREQUENT candidates or more is frequent (at most
   MOST_FREQUENT of them, so the list that is sent to all has a proven bound;
   any choice of the class is right, it only decides the cost).  The order now
   puts rare tokens first.  Where the prefix of spare + need tokens is rare, each
   of its tokens is indexed by itself, and a pair must meet need times, the less
   of both.  Where it reaches the frequent class, a pair must meet once: if its
   first common token is rare, there; else all its common tokens are frequent,
   and the prefix is extended to 0.6 n + 3 tokens less 3 for each rare one: at
   most a + b tokens of the two prefixes are not common, each parts two runs of
   three common neighbours, and 3 a + 2 b <= 0.6 n, so both sets have a run of
   three in common.  The combinations of three neighbouring frequent tokens are
   indexed (of two, with 0.4 n + 2 less 2, for sets of eight tokens or fewer).
4. A list of at most FREQUENT nodes gives all its pairs.  A longer one gives each
   node one representative, so it stays linear.  Pairs that meet often enough and
   each node's likeliest representative are verified on the whole sets.
5. Distributed union-find.  Long lists that then still hold several components
   form groups; in each the nodes outside of the largest component are compared
   with all others, block by block, by exact overlap counts.  Blocks are bounded
   by tokens, a block pair is a task's unit, and only links that join components
   come out.  So no link between components is missed, and no pairs are listed.

Nulls: a null text, or one without words, has the empty set and links with
nothing; a null doc_id sorts after all ids.  Fewer than K words make one
shingle of them all.  Repeated rows are documents of their own, linked if not
empty.  A very long text is scanned in chunks; its set is one row.  An empty
table gives an empty result.  Other columns are not read, whatever their names.
Set equality is that of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import MAX_LONG, order_key, shuffle_partitions, written
from quiver.llm.components import components
from quiver.llm.words import mix, runs, scan_documents, shingle_hashes

K = 5
PERCENT = 80
#: Tokens of so many candidates are frequent, and lists of more nodes are long.
FREQUENT = 8
MOST_FREQUENT = 1 << 20
#: Tokens of a block of nodes that are compared at once, and of a chunk of prefixes.
BLOCK = 1 << 18
CHUNK_TOKENS = 1 << 17
#: Nodes that a task remembers as done; forgotten ones only cost repeated rows.
REMEMBER = 1 << 16
#: Bits of the filter that keeps most sets which are no candidates from being moved.
MOST_FILTER_BITS = 1 << 26
_BUCKET = 1 << 15
_U = np.uint64
DOCUMENT, TOKEN, SETTLED, HITS = 0, 1, 2, 3


def spare(n):
    return n * (100 - PERCENT) // 100


def need(n):
    return np.minimum(4 + n // 16, n - spare(n))


def need_column(n: Column) -> Column:
    return F.least(4 + F.floor(n / 16), n - F.floor(n * (100 - PERCENT) / 100))


def shingle_set(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's words."""
    if not len(hashes):
        return np.empty(0, _U)
    if len(hashes) < k:
        whole = shingle_hashes(hashes, len(hashes))
        return mix(whole ^ _U(0xA5A5 + len(hashes)))
    return np.unique(shingle_hashes(hashes, k))


def node_of(tokens: np.ndarray) -> int:
    """Key of a set (a signed long)."""
    total = np.add.reduce(mix(tokens ^ _U(0x51ED27)), dtype=_U)
    return int(mix(np.asarray([total ^ (_U(len(tokens)) << _U(40))]))[0].view(np.int64))


def _slices(batch, column: int = 0, size: int = 1 << 21):
    """(first row, texts) of a batch, about `size` bytes at a time."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4).astype(np.int64)) if batch.num_rows else np.empty(0)
    part = np.cumsum(sizes) // size
    for _, s, e in zip(*runs(part)):
        # bytes.lower changes A-Z only
        yield int(s), [t.lower() if t else t for t in batch.column(column).slice(s, e - s).to_pylist()]


def _sets(batch):
    """(row, tokens) of each row of a batch that has words."""
    for first, texts in _slices(batch):
        for hashes, owner in scan_documents(texts):
            for who, s, e in zip(*runs(owner)):
                yield first + int(who), shingle_set(hashes[s:e])


class Remembered:
    """Nodes that a task has met; bounded, and forgetting is harmless."""

    def __init__(self):
        self.nodes: set[int] = set()

    def new(self, node: int) -> bool:
        if node in self.nodes:
            return False
        if len(self.nodes) >= REMEMBER:
            self.nodes.clear()
        self.nodes.add(node)
        return True


def _rows(names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)


FIRST = ["kind", "key", "node", "n"]


def settle(tokens: np.ndarray, node: np.ndarray):
    """(token, node, settled) rows, one a token, and each node's hits, of a chunk with distinct nodes."""
    order = np.argsort(tokens, kind="stable")
    tokens, node = tokens[order], node[order]
    token, start, end = runs(tokens)
    several = end - start > 1
    hit = np.repeat(several, end - start)
    nodes, hits = np.unique(node[hit], return_counts=True)
    return token, node[start], several, nodes, hits


def _first(batches):
    """Rows of documents, prefix tokens and settled hits; doc is null but for documents."""
    seen = Remembered()
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        node = np.zeros(batch.num_rows, np.int64)
        held, size = [], 0

        def out():
            token, owner, several, nodes, hits = settle(np.concatenate([t for _, t in held]), np.repeat(np.asarray([x for x, _ in held], np.int64), [len(t) for _, t in held]))
            kind = np.concatenate([np.where(several, SETTLED, TOKEN), np.full(len(nodes), HITS)])
            key = np.concatenate([token.view(np.int64), mix(nodes.view(_U)).view(np.int64)])
            counts = np.concatenate([np.zeros(len(token), np.int64), hits])
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(key), pa.array(np.concatenate([owner, nodes])), pa.array(counts), pa.nulls(len(key), pa.int64())], names=[*FIRST, "doc"])

        for who, tokens in _sets(batch):
            n[who], node[who] = len(tokens), node_of(tokens)
            if len(tokens) >= 4 and seen.new(int(node[who])):
                prefix = tokens[: spare(len(tokens)) + int(need(len(tokens)))]
                held.append((int(node[who]), prefix))
                size += len(prefix)
            if size > CHUNK_TOKENS:
                yield out()
                held, size = [], 0
        if held:
            yield out()
        doc = batch.column(1)
        spread = mix(np.arange(batch.num_rows, dtype=_U) ^ node.view(_U)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(spread), pa.array(node, mask=n == 0), pa.array(n), doc], names=[*FIRST, "doc"])


def _hits(batches):
    """Sorted by key: which tokens are met in several nodes; rows of documents pass.

    Of a token that goes on in the next batch only one row is kept, or the
    knowledge that it is repeated.
    """
    held = None  # (key, node or None where the token is known to be repeated)
    for batch in batches:
        kind, key, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        other = (kind == DOCUMENT) | (kind == HITS)
        rest = batch.filter(pa.array(other))
        yield pa.RecordBatch.from_arrays([rest.column(i) for i in (0, 2, 3, 4)], names=["kind", "node", "n", "doc"])
        kind, key, node = kind[~other], key[~other], node[~other].astype(np.int64)
        if held is not None:
            known = held[1] is None
            key = np.concatenate([[held[0]], key])
            node = np.concatenate([[0 if known else held[1]], node])
            kind = np.concatenate([[SETTLED if known else TOKEN], kind])
        if not len(key):
            continue
        _, start, end = runs(key)
        group = np.repeat(np.arange(len(start)), end - start)
        several = np.bincount(group, weights=(node != node[start][group]) | (kind == SETTLED)) > 0
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (kind[:-1] == SETTLED)
        hit = several[group] & (kind == TOKEN) & fresh
        nodes, counts = np.unique(node[hit], return_counts=True)
        held = (int(key[-1]), None if several[-1] else int(node[-1]))
        if len(nodes):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), HITS, np.int8)), pa.array(nodes), pa.array(counts), pa.nulls(len(nodes), pa.int64())], names=["kind", "node", "n", "doc"])


def _filter_bits(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the nodes, 16 bits for each up to MOST_FILTER_BITS; beyond that it lets more pass."""
    wanted = 16 * nodes.count()
    bits = _BUCKET
    while bits < wanted and bits < MOST_FILTER_BITS:
        bits *= 2
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    found = nodes.select(F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(F.lit(_BUCKET - 1)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in found:
        bitmap[r["bucket"] * (_BUCKET // 8) : (r["bucket"] + 1) * (_BUCKET // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bitmap, bits


_P = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """xxhash64 of long columns, as Spark computes it."""
    turn = lambda v, r: (v << _U(r)) | (v >> _U(64 - r))
    h = _U(seed) + _P[4] + _U(8)
    h = h ^ (turn(x.view(_U) * _P[1], 31) * _P[0])
    h = turn(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> _U(33))) * _P[1]
    h = (h ^ (h >> _U(29))) * _P[2]
    return (h ^ (h >> _U(32))).view(np.int64)


def _wanted_sets(bitmap: np.ndarray, bits: int):
    def run(batches):
        seen = Remembered()
        for batch in batches:
            rows, size = [], 0

            def out():
                return _rows(["node", "tokens"], ([r[0] for r in rows], pa.int64()), ([r[1] for r in rows], pa.binary()))

            for _, tokens in _sets(batch):
                node = node_of(tokens)
                slot = int(xxhash_long(np.asarray([node], np.int64))[0]) % bits
                if not bitmap[slot >> 3] >> (slot & 7) & 1 or not seen.new(node):
                    continue
                rows.append((node, tokens.tobytes()))
                size += 8 * len(tokens)
                if size > 4 << 20:
                    yield out()
                    rows, size = [], 0
            if rows:
                yield out()

    return run


def _blobs(batches, tokens_at: int = 1, size: int = 1 << 22):
    """(columns before the tokens, token arrays) of a batch, about `size` bytes at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            yield [part.column(i).to_numpy(zero_copy_only=False) for i in range(tokens_at)], [np.frombuffer(x, _U) for x in part.column(tokens_at).to_pylist()]


def _token_counts(batches):
    held, size = [], 0

    def out():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    for _, sets in _blobs(batches):
        held += sets
        size += sum(map(len, sets))
        if size > 1 << 21:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def combinations(often: np.ndarray, width: int) -> np.ndarray:
    """Keys of `width` neighbouring tokens."""
    out = mix(often ^ _U(width))
    for i in range(1, width):
        out = mix(out[:-1] * _P[0] + often[i:])
    return out


def index_entries(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, tokens that may be common from there, times that a pair must meet) of a set."""
    n = len(tokens)
    if n < 4:  # such sets link only with equal ones
        return np.empty(0, _U), np.empty(0, np.int64), 1
    place = np.searchsorted(frequent, tokens)
    common = frequent[np.minimum(place, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare, often = tokens[~common], tokens[common]
    times = int(need(n))
    prefix = spare(n) + times
    if len(rare) >= prefix:
        keys = rare[:prefix]
        # Later tokens of the prefix only count meetings: an earlier one may be common.
        return keys, n - np.maximum(0, np.arange(prefix) - (times - 1)), times
    keys = [rare[: spare(n) + 1]]
    left = [n - np.arange(len(keys[0]))]
    if len(rare) <= spare(n):
        for width in ([3] if n >= 8 else []) + ([2] if n <= 8 else []):
            length = n * (100 - PERCENT) * width // 100 + width - width * len(rare)
            keys.append(combinations(often[: max(width, length)], width) if len(often) >= width else np.empty(0, _U))
            left.append(np.full(len(keys[-1]), n - len(rare)))
    return np.concatenate(keys), np.concatenate(left), 1


ENTRY = ["key", "node", "n", "left", "times"]


def _entries(frequent: np.ndarray):
    def run(batches):
        for (nodes,), sets in _blobs(batches):
            parts = [index_entries(tokens, frequent) for tokens in sets]
            size = [len(p[0]) for p in parts]
            if sum(size):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(np.repeat(nodes, size)), pa.array(np.repeat([len(s) for s in sets], size).astype(np.int32)),
                        pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)), pa.array(np.repeat([p[2] for p in parts], size).astype(np.int32)),
                    ],
                    names=ENTRY,
                )

    return run


def may_link(n, left, m, right):
    return (100 + PERCENT) * np.minimum(left, right) >= PERCENT * (n + m)


MET = ["a", "b", "times", "star"]


def _meet(batches):
    """Pairs (a, b) of short lists, and (node, representative) of long ones; sorted by (key, n, node)."""
    names = (*MET,)
    short = FREQUENT
    held = None  # the rows of the last key so far, FREQUENT + 1 at most
    tail = None  # (key, representative, its n, last n) of a long list that goes on

    def batch_of(a, b, times, star):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(times).astype(np.int32)), pa.array(np.concatenate(star))], names=names)

    def stars(node, n, key):
        """Edges of a part of a long list, going on from tail."""
        nonlocal tail
        a, b = [], []
        if tail is None or tail[0] != key:
            tail = [key, int(node[0]), int(n[0]), int(n[0])]
            node, n = node[1:], n[1:]
        at = 0
        while at < len(node):
            # Sizes too far apart end the reach of all that came before, or of the representative.
            if PERCENT * int(n[at]) > 100 * tail[3]:
                tail[1:] = [int(node[at]), int(n[at]), int(n[at])]
                at += 1
                continue
            top = int(np.searchsorted(n, 100 * tail[2] // PERCENT, side="right"))
            if top <= at:  # a new representative, linked with the one before
                a.append(node[at : at + 1])
                b.append(np.asarray([tail[1]]))
                tail[1:] = [int(node[at]), int(n[at]), int(n[at])]
                at += 1
                continue
            step = np.flatnonzero(PERCENT * n[at + 1 : top].astype(np.int64) > 100 * n[at : top - 1].astype(np.int64))
            if len(step):
                top = at + 1 + int(step[0])
            a.append(node[at:top])
            b.append(np.full(top - at, tail[1]))
            tail[3] = int(n[top - 1])
            at = top
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            return [a], [b], [np.ones(len(a))], [np.ones(len(a), bool)]
        return None

    def pairs(table, starts, ends):
        """All pairs that may link of many short lists at once."""
        key, node, n, left, times = table
        out = ([], [], [], [])
        for apart in range(1, short):
            at = np.concatenate([np.arange(s, e - apart) for s, e in zip(starts, ends) if e - s > apart] or [np.empty(0, np.int64)]) if apart == 1 else at[key[np.minimum(at + apart, len(key) - 1)] == key[at]]
            at = at[at + apart < len(key)]
            at = at[key[at + apart] == key[at]]
            if not len(at):
                break
            ok = at[may_link(n[at].astype(np.int64), left[at], n[at + apart].astype(np.int64), left[at + apart])]
            x, y = node[ok], node[ok + apart]
            out[0].append(np.minimum(x, y))
            out[1].append(np.maximum(x, y))
            out[2].append(np.minimum(times[ok], times[ok + apart]))
            out[3].append(np.zeros(len(ok), bool))
        return out

    for batch in _then_none(batches):
        if batch is None:
            table, last = held, True
        else:
            table, last = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], False
            if held is not None:
                table = [np.concatenate(x) for x in zip(held, table)]
        held = None
        if table is None or not len(table[0]):
            continue
        fresh = np.ones(len(table[0]), bool)
        fresh[1:] = (table[0][1:] != table[0][:-1]) | (table[1][1:] != table[1][:-1])
        table = [x[fresh] for x in table]
        key, start, end = runs(table[0])
        size = end - start
        going = tail is not None and tail[0] == int(key[0])
        if not last:
            if size[-1] <= short and not (going and len(key) == 1):
                held = [x[start[-1] :] for x in table]
                key, start, end, size = key[:-1], start[:-1], end[:-1], size[:-1]
        out = ([], [], [], [])
        is_long = size > short
        if going and len(key):
            is_long[0] = True
        for i in np.flatnonzero(is_long):
            found = stars(table[1][start[i] : end[i]], table[2][start[i] : end[i]], int(key[i]))
            for x, y in zip(out, found or ()):
                x += y
        pick = ~is_long & (size > 1)
        for x, y in zip(out, pairs(table, start[pick], end[pick])):
            x += y
        if out[0]:
            yield batch_of(*out)


def _then_none(batches):
    yield from batches
    yield None


def _verify(batches):
    for batch in batches:
        ok = []
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Common tokens of each left with each right set."""
    one, two = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(one, two)
    rows = np.repeat(np.arange(len(left)), [len(x) for x in left])
    cols = np.repeat(np.arange(len(right)), [len(x) for x in right])

    def places(tokens, owner):
        at = np.searchsorted(shared, tokens)
        hit = shared[np.minimum(at, len(shared) - 1)] == tokens
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    total = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return total
    (at, rows), (bt, cols) = places(one, rows), places(two, cols)
    for s in range(0, len(shared), step):
        a, b = slice(*np.searchsorted(at, [s, s + step])), slice(*np.searchsorted(bt, [s, s + step]))
        x, y = np.zeros((len(left), step), np.float32), np.zeros((step, len(right)), np.float32)
        x[rows[a], at[a] - s] = 1
        y[bt[b] - s, cols[b]] = 1
        total += x @ y
    return total


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links that join components of a block of nodes with those of another; not more than there are components."""
    found = []
    if left.num_rows and right.num_rows:
        (nodes, groups), (others, classes) = ([t.column(c).to_numpy() for c in ("node", "component")] for t in (left, right))
        sets, peers = ([np.frombuffer(x, _U) for x in t.column("tokens").to_pylist()] for t in (left, right))
        n, m = (np.asarray([len(x) for x in s], np.float64) for s in (sets, peers))
        common = overlaps(sets, peers)
        similar = (100 + PERCENT) * common >= PERCENT * (n[:, None] + m[None, :])
        similar &= groups[:, None] != classes[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(similar)):
            x, y = find(int(groups[i])), find(int(classes[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(nodes[i]), int(others[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _between(stars: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of `near` whose nodes share long lists (joined by stars)."""
    placed = components(near).select("node", "component")
    group = components(near.unionByName(stars.select("a", "b"))).select("node", F.col("component").alias("super"))
    members = written(group.join(placed, "node", "left").select("super", "node", F.coalesce("component", "node").alias("component")).join(sets.select("node", F.length("tokens").alias("bytes")), "node"), "jaccard-members")
    inside = members.groupBy("super", "component").agg(F.sum("bytes").alias("bytes"))
    largest = inside.groupBy("super").agg(F.max(F.struct("bytes", "component")).alias("top"), F.sum("bytes").alias("all"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = lambda size: F.ceil(size / (8.0 * BLOCK)).cast("int")
    facts = largest.select("super", F.col("top.component").alias("largest"), blocks(F.col("all") - F.col("top.bytes")).alias("outer"), blocks(F.col("all")).alias("whole"))
    dealt = members.join(facts, "super").select("super", "node", "component", "largest", "outer", "whole", F.xxhash64("node", F.lit(9)).alias("h"))

    def cell(kept, i, j, *names):
        return kept.select("super", i.alias("i"), j.alias("j"), "node", "component").join(sets, "node").select("super", "i", "j", "node", "component", "tokens").toDF(*names, "node", "component", "tokens")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cell(dealt.filter("component <> largest"), F.pmod("h", "outer").cast("int"), every("whole"), "s", "i", "j")
    right = cell(dealt, every("outer"), F.pmod("h", "whole").cast("int"), "t", "k", "l")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy("s", "i", "j").cogroup(right.groupBy("t", "k", "l")).applyInArrow(_compare, "a long, b long")


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each row."""
    parts = shuffle_partitions(documents.sparkSession)
    docs = documents.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc"))
    first = written(
        docs.mapInArrow(_first, "kind byte, key long, node long, n long, doc long").repartition(parts, "key").sortWithinPartitions("key", "node")
        .mapInArrow(_hits, "kind byte, node long, n long, doc long"),
        "jaccard-first",
    )
    placed = first.filter(f"kind = {DOCUMENT}").select("doc", "node", "n")
    size, hits = F.max(F.when(F.col("kind") == DOCUMENT, F.col("n"))), F.sum(F.when(F.col("kind") == HITS, F.col("n")))
    wanted = written(first.filter("node is not null").groupBy("node").agg(size.alias("n"), hits.alias("hits")).filter(F.col("hits") >= need_column(F.col("n"))).select("node"), "jaccard-wanted")
    found = docs.select("text").mapInArrow(_wanted_sets(*_filter_bits(wanted)), "node long, tokens binary")
    sets = written(found.join(wanted.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens")), "jaccard-sets")
    counted = sets.mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    frequent = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    frequent = np.sort(frequent.astype(np.int64).view(_U))
    met = (
        sets.mapInArrow(_entries(frequent), "key long, node long, n int, left int, times int").repartition(parts, "key").sortWithinPartitions("key", "n", "node")
        .mapInArrow(_meet, "a long, b long, times int, star boolean").groupBy("a", "b", "times", "star").agg(F.count("*").alias("met"))
    )
    met = written(met.filter("star or met >= times"), "jaccard-met")
    stars = met.filter("star")
    best = stars.groupBy("a").agg(F.max(F.struct("met", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    near = written(links(met.filter("not star").select("a", "b").unionByName(best).distinct(), sets), "jaccard-near")
    rest = written(_between(stars, near, sets), "jaccard-rest")
    merged = components(near.unionByName(rest))
    # The least doc_id of each node, then of each class: copies are counted before they meet.
    least = placed.filter("node is not null").groupBy("node").agg(F.min(order_key("doc")).alias("least")).join(merged, "node", "left")
    least = least.withColumn("class", F.coalesce("component", "node"))
    top = least.groupBy("class").agg(F.min("least").alias("top"))
    named = least.join(top, "class").select("node", "top")
    component = F.coalesce("top", order_key("doc"))
    return placed.join(named, "node", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component < MAX_LONG, component).otherwise(F.col("doc")).alias("component_id"))
