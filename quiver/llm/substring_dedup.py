"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans.

A word is removed if it lies in a window of WINDOW words whose word sequence
also starts earlier, by (doc_id, start), anywhere in the corpus.

A broadcast of the automaton of every shard to every document costs shards x
documents and has no size bound for a corpus that is its own reference, so each
shard's automaton meets only the passages that can match it:

1. Each window is named by its *anchor*, the smallest hash of its runs of
   ANCHOR words.  Equal windows have equal anchors, at equal offsets.  A run of
   windows with one anchor occurrence is a passage (one row per about 7 words).
2. Passages are sharded by anchor.  One whose content (and anchor) also starts
   earlier is removed as it stands; one whose anchor is not shared is dropped.
3. Anchors with several contents (near copies, common lines) fetch their words.
   Each shard builds a suffix automaton over its passages in corpus order, so
   a state's first end position is the first occurrence in the corpus, and
   streams the same passages for matching statistics: a match of WINDOW words
   that ends first at an earlier place is a span to remove.  Anchors with more
   than HOT contents are sharded further by the content of each window.
4. The spans of a document are joined to its text and cut out.

Nulls: a null text has no words; a null doc_id sorts after all ids.  Rows with the
same doc_id and the same text (null ids, too) count as one place and are cut
alike; rows that share a doc_id, or have none, but differ in text are documents
of their own, in the order of a hash of the text.  A very long text is scanned in
chunks.  An empty table gives an empty result.  Other columns are not read.
Passages are equal if two independent 64-bit hashes are, a window in an automaton
if the 64-bit hashes of its 20 words are, in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import order_key, shuffle_partitions, written
from quiver.llm.words import mix, run_hashes, runs, scan_documents, shingle_hashes

WINDOW = 20
ANCHOR = 8
HOT = 4096
_U = np.uint64
PASSAGES = "anchor long, content long, again long, doc long, row long, first int, last int, settled boolean"
#: Repeated doc_ids that are sent to all tasks, at most; more are joined by a shuffle.
MOST_REPEATS = 1 << 18


def _leftmost_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of g."""
    best, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(g[left] <= g[right], left, right)
        have += step
    return best


def passages(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(anchor hash, two content hashes, first window, last window) of one document's words."""
    if len(hashes) < window:
        return None
    g = shingle_hashes(hashes, anchor)
    at = _leftmost_minimum(g, window - anchor + 1)
    where, first, end = runs(at)
    place = mix((where - first).astype(_U))
    content, again = (run_hashes(hashes, first, end + window - 1, window, lane) ^ place for lane in (0, 1))
    return g[where], content, again, first, end - 1


def _emit_passages(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for hashes, owner in scan_documents(batch.column(1).to_pylist()):
                parts = []
                for who, s, e in zip(*runs(owner)):
                    found = passages(hashes[s:e], window, anchor)
                    if found is not None:
                        n = len(found[0])
                        parts.append((*found, np.full(n, ids[who], np.int64), np.full(n, rows[who], np.int64)))
                if not parts:
                    continue
                key, content, again, first, last, doc, row = map(np.concatenate, zip(*parts))
                # Copies inside the chunk: all but the earliest are settled here.
                order = np.lexsort((first, row, doc, again, content, key))
                k, c, g, d, r, f = (x[order] for x in (key, content, again, doc, row, first))
                same = np.zeros(len(k), bool)
                same[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (g[1:] == g[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
                settled = same & ((d > d[head]) | (r != r[head]) | (f > f[head]))
                k = np.where(settled, mix(d.view(_U) ^ mix(f.astype(_U))), k)  # they need no shard: spread them
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64)), pa.array(c.view(np.int64)), pa.array(g.view(np.int64)), pa.array(d), pa.array(r), pa.array(f.astype(np.int32)), pa.array(last[order].astype(np.int32)), pa.array(settled)],
                    names=["anchor", "content", "again", "doc", "row", "first", "last", "settled"],
                )

    return run


def _judge(batches):
    """Sorted passages of one shard -> removed ones (kind 0), those for an automaton (1, 2).

    The rows come sorted by (anchor, content, again, doc, row, first).  Of an anchor that
    goes on in the next batch only the first row of each content is carried,
    and no more than HOT of those: beyond, the anchor is known to be hot.
    """
    carry, known_hot = None, False

    def judge(table, fresh, hot):
        """fresh: first row of the table that has not been judged; hot: its first anchor is hot already."""
        key, content, again, doc, row, first, last, settled = table
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        head = new_key.copy()
        head[1:] |= (content[1:] != content[:-1]) | (again[1:] != again[:-1])
        at = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        group = np.cumsum(new_key) - 1
        contents = np.bincount(group, weights=head).astype(np.int64)
        if hot:
            contents[0] += HOT
        contents = contents[group]
        removed = settled | (~head & ((doc > doc[at]) | (row != row[at]) | (first > first[at])))
        removed[:fresh] = False
        return head & ~settled, removed, contents

    def batch_of(table, pick, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(table[i][pick]) for i in (3, 4, 5, 6, 0)] + [pa.array(kind.astype(np.int8))], names=["doc", "row", "first", "last", "anchor", "kind"]
        )

    for batch in _and_none(batches):
        if batch is None:
            table, fresh = carry, len(carry[0]) if carry else 0
        else:
            table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            fresh = len(carry[0]) if carry else 0
            if carry is not None:
                table = [np.concatenate(x) for x in zip(carry, table)]
        if table is None or not len(table[0]):
            continue
        head, removed, contents = judge(table, fresh, known_hot)
        tail = int(np.searchsorted(table[0], table[0][-1])) if batch is not None else len(head)
        hot_tail = batch is not None and contents[-1] > HOT
        done = head & (contents > 1)
        if not hot_tail:
            done[tail:] = False
        if known_hot and (batch is not None or fresh):
            done[: fresh] = False
        pick = np.flatnonzero(done | removed)
        if len(pick):
            yield batch_of(table, pick, np.where(removed, 0, np.where(contents > HOT, 2, 1))[pick])
        if batch is not None:
            keep = np.flatnonzero(head & (np.arange(len(head)) >= tail))
            if hot_tail:
                keep = keep[-1:]
            carry, known_hot = [x[keep] for x in table], hot_tail


def _and_none(batches):
    yield from batches
    yield None


def _fetch_words(window: int):
    """Documents with their mixed passages -> the words of each passage."""

    def run(batches):
        for batch in batches:
            ids, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            wanted = batch.column(2).to_pylist()
            for hashes, owner in scan_documents(batch.column(1).to_pylist()):
                rows = ([], [], [], [], [])
                for who, s, e in zip(*runs(owner)):
                    words = hashes[s:e]
                    for want in wanted[who]:
                        first, last, key = want["first"], want["last"], want["anchor"]
                        if last + window > len(words):
                            continue
                        if want["kind"] == 1:
                            spans = [(first, last + window, key)]
                        else:  # each window by itself, spread by its content
                            at = np.arange(first, last + 1)
                            spread = run_hashes(words, at, at + window, window, 1).view(np.int64)
                            spans = [(int(i), int(i) + window, int(h)) for i, h in zip(at, spread)]
                        for a, b, shard in spans:
                            rows[0].append(shard)
                            rows[1].append(int(ids[who]))
                            rows[2].append(int(row[who]))
                            rows[3].append(a)
                            rows[4].append(words[a:b].tobytes())
                if rows[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())], names=["shard", "doc", "row", "first", "words"]
                    )

    return run


class Automaton:
    """Suffix automaton over passages of word hashes, added in corpus order.

    Each state keeps the first end position of its substrings: the passage and
    the offset at which they were first completed.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.seen = [-1], [0], [(-1, -1)]

    def _state(self, moves, link, length, seen) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.seen.append(seen)
        return len(self.next) - 1

    def add(self, words, passage: int) -> list[int]:
        """Add a passage; the state after each word."""
        moves, link, length, seen = self.next, self.link, self.length, self.seen
        last, states = 0, []
        for at, word in enumerate(words):
            known = moves[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                states.append(last)
                continue
            if known is None:
                new = self._state({}, 0, length[last] + 1, (passage, at))
            else:
                new = -1
            p = last
            while p != -1 and word not in moves[p]:
                moves[p][word] = new
                p = link[p]
            if p == -1:
                last = new
            else:
                q = moves[p][word]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                else:
                    clone = self._state(dict(moves[q]), link[q], length[p] + 1, seen[q])
                    while p != -1 and moves[p].get(word) == q:
                        moves[p][word] = clone
                        p = link[p]
                    link[q] = clone
                    if new == -1:
                        last = clone
                    else:
                        link[new] = clone
                        last = new
            states.append(last)
        return states

    def first_end(self, state: int, width: int) -> tuple[int, int]:
        """Passage and offset where the last width words at state were first completed."""
        link, length = self.link, self.length
        while length[link[state]] >= width:
            state = link[state]
        return self.seen[state]


def _match(window: int):
    def shard(places, words):
        """Spans of one shard; passages by (doc, row, first)."""
        automaton, spans = Automaton(), []
        for i, passage in enumerate(words):
            states = automaton.add(np.frombuffer(passage, _U).tolist(), i)
            doc, row, first = places[i]
            start = None
            for at in range(window - 1, len(states)):
                who, end = automaton.first_end(states[at], window)
                place = first + at - window + 1
                earlier = (*places[who][:2], places[who][2] + end - window + 1) < (doc, row, place)
                if earlier and start is None:
                    start = place
                elif not earlier and start is not None:
                    spans.append((doc, row, start, place - 1))
                    start = None
            if start is not None:
                spans.append((doc, row, start, first + len(states) - window))
        return spans

    def run(batches):
        # Sorted by (shard, doc, row, first): one shard's passages at a time.
        now, places, held, known = None, [], [], set()
        done = []

        def ready():
            cols = list(zip(*done)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "row", "first", "last"])

        for batch in batches:
            for key, doc, row, first, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != now:
                    done += shard(places, held)
                    now, places, held, known = key, [], [], set()
                if len(words) == 8 * window:
                    # A single window that has been met needs no place in the automaton, so a
                    # window that many passages share takes no memory for each.
                    if words in known:
                        done.append((doc, row, first, first))
                        continue
                    known.add(words)
                places.append((doc, row, first))
                held.append(words)
            if len(done) > 10000:
                yield ready()
                done = []
        done += shard(places, held)
        yield ready()

    return run


def _cut(window: int, texts: bool):
    def run(batches):
        for batch in batches:
            spans = batch.column(3).to_pylist()
            rows = []
            for text, removed in zip(batch.column(2).to_pylist(), spans):
                words = (text or b"").split()
                n = len(words)
                if removed:
                    edge = np.zeros(n + 1, np.int64)
                    for span in removed:
                        if span["first"] < n:
                            edge[span["first"]] += 1
                            edge[min(n, span["last"] + window)] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
            n, gone, digest, kept = zip(*rows) if rows else ([], [], [], [])
            columns = [batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _rows(documents: DataFrame) -> DataFrame:
    """doc, row, text, doc_id: row is 0 where doc_id names one row, else a hash of the text."""
    docs = documents.select(order_key("doc_id").alias("doc"), F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    repeats = documents.select(F.col("doc_id").cast("long").alias("doc")).filter("doc is not null").groupBy("doc").count().filter("count > 1").select("doc")
    n = repeats.count()
    row = F.col("doc_id").isNull()
    if n:
        marked = repeats.withColumn("repeated", F.lit(True))
        docs = docs.join(F.broadcast(marked) if n <= MOST_REPEATS else marked, "doc", "left")
        row = row | F.col("repeated").isNotNull()
    return docs.select("doc", F.when(row, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("row"), "text", "doc_id")


def substring_dedup(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row of documents."""
    parts = shuffle_partitions(documents.sparkSession)
    docs = _rows(documents)
    judged = written(
        docs.select("doc", "text", "row").mapInArrow(_emit_passages(window, anchor), PASSAGES)
        .repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "again", "doc", "row", "first")
        .mapInArrow(_judge, "doc long, row long, first int, last int, anchor long, kind byte"),
        "substring-judged",
    )
    mixed = judged.filter("kind > 0").groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last", "anchor", "kind")).alias("want"))
    dealt = docs.repartition(parts, "doc", "row")
    spans = (
        dealt.join(mixed.hint("shuffle_hash"), ["doc", "row"]).select("doc", "text", "want", "row")
        .mapInArrow(_fetch_words(window), "shard long, doc long, row long, first int, words binary")
        .repartition(parts, "shard").sortWithinPartitions("shard", "doc", "row", "first")
        .mapInArrow(_match(window), "doc long, row long, first int, last int")
    )
    removed = (
        spans.unionByName(judged.filter("kind = 0").select("doc", "row", "first", "last"))
        .groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return dealt.join(removed.hint("shuffle_hash"), ["doc", "row"], "left").select("doc", "doc_id", "text", "spans").mapInArrow(_cut(window, texts), schema)
