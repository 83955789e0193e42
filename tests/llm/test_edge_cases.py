"""Cases that a hash, a key or a bound could get wrong, and whole queries against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from test_text_operators import kept_by_brute_force, words_of


def thue_morse(letters, n=11):
    word = letters[0]
    for _ in range(n):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


#: Words whose polynomial hashes modulo 2**64 are equal for every odd base.
TWINS = [thue_morse("ab"), thue_morse("ba")]


def test_words_of_two_letters_do_not_collide():
    from quiver.llm.words import SPACE, same_bytes, scan, word_hashes

    texts = [w.encode() for n in (3, 8, 9, 10, 11) for w in (thue_morse("ab", n), thue_morse("ba", n))]
    found = [h for *_, hashes in scan(texts, SPACE) for h in hashes.tolist()]
    assert len(set(found)) == len(texts)
    rng = random.Random(1)
    words = [bytes(rng.choices(b"abc", k=rng.choice([1, 7, 8, 9, 16, 17, 700]))) for _ in range(300)] * 2
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    other = np.asarray([words.index(w) for w in words])
    assert same_bytes(data, starts, ends, other).all()
    assert not same_bytes(data, starts, ends, np.roll(other, 1))[[w != v for w, v in zip(words, [words[-1], *words])]].any()


def test_run_hashes_tell_runs_apart():
    from quiver.llm.words import run_hashes

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 3, 3000), np.asarray([c == "a" for c in thue_morse("ab", 10)], int)]).astype(np.uint64)
    first = np.arange(0, len(values) - 32, 1)
    end = first + rng.integers(20, 33, len(first))
    for lane in (0, 1):
        found = run_hashes(values, first, end, 20, lane)
        runs = [values[a:b].tobytes() for a, b in zip(first, end)]
        assert len(set(found.tolist())) == len(set(runs))
        assert len(set(zip(found.tolist(), runs))) == len(set(runs))


def test_twin_words_in_documents(spark):
    from quiver.llm.jaccard_join import jaccard_components
    from quiver.llm.substring_dedup import substring_dedup

    filler = [f"w{i}" for i in range(30)]
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, " ".join([*filler[:10], TWINS[0], *filler[10:]])), (4, " ".join([*filler[:10], TWINS[1], *filler[10:]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as first", "0 as node")
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup(frame).collect()} == kept_by_brute_force(rows)
    assert {r.doc_id: r.component_id for r in jaccard_components(frame).collect()} == {i: i for i in (1, 2, 3, 4)}


def test_twin_words_are_encoded_apart():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quiver.llm import bpe

    vocabulary = bpe.Vocabulary(bpe.tokenizer_text(public.path("byte_bpe_50k.json")))
    table, tokenizer = bpe.WordTable(vocabulary), Tokenizer.from_str(vocabulary.text)
    for i, rows in table.encode_texts(TWINS):
        assert [x for r in rows.tolist() for x in table.ids[r]] == tokenizer.encode(TWINS[i], add_special_tokens=False).ids


def test_a_task_of_bpe_holds_few_words_and_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    import tracemalloc

    import pyarrow as pa

    from quiver.llm import bpe

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(500)).encode() for _ in range(400)]
    batch = pa.record_batch([pa.array(range(400)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    run = bpe.encode(Rows(), bpe.tokenizer_text(public.path("byte_bpe_50k.json"))).run
    tracemalloc.start()
    try:
        assert sum(part.num_rows for part in run(iter([batch]))) == 400
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_line_signatures_take_all_shingles_in_few_rows(spark):
    from quiver.llm import line_dedup as m

    rng = random.Random(9)
    lines = ["", "\U0001f600" * 9, *("".join(rng.choices("abc \u00e9", k=n)) for n in range(1, 41))]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    rows = m._strides(frame.select("id", m._units(m.F.col("line")).alias("units"))).collect()
    want = {r.id: set(r.all) for r in frame.select("id", m.shingles(m.F.col("line")).alias("all")).collect()}
    got = {i: [r for r in rows if r.id == i] for i in want}
    assert {i: {h for r in x for h in r[1:]} for i, x in got.items()} == want
    assert all(8 * (len(x) - 1) < max(1, len(lines[i].encode("utf-16-be")) // 2 - m.SHINGLE + 1) for i, x in got.items())


def test_substring_dedup_keeps_rows_without_ids_apart(spark):
    from quiver.llm.substring_dedup import substring_dedup

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (2, c), (2, b), (2, c)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    # The copy of a goes; of b's two rows the one with an id comes first; both rows of (2, c) are one.
    assert got == [(False, 1, 0), (False, 2, 0), (False, 2, 0), (False, 2, 0), (True, 0, 40), (True, 0, 40)]


def line_sets(line):
    units = line.encode("utf-16-be")
    return {units[i : i + 14] for i in range(0, max(1, len(units) - 12), 2)}


def kept_lines(rows):
    """Kept text of each distinct (doc_id, text) row, by comparing all lines."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())))
    places = [(i, p, line) for i, r in enumerate(order) for p, line in enumerate(r[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)]
    distinct = sorted({x for *_, x in places})
    sets, root = {x: line_sets(x) for x in distinct}, {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            common = len(sets[x] & sets[y])
            if common and 100 * common >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    seen, gone = set(), set()
    for i, p, line in places:
        if find(line) in seen:
            gone.add((i, p))
        seen.add(find(line))
    return {r: "\n".join(x for p, x in enumerate(r[1].split("\n")) if (i, p) not in gone) for i, r in enumerate(order)}


def test_line_dedup_end_to_end(spark):
    """URLs, CJK, tabs, code, templates, short lines, null and repeated ids, ties, a long line and many lines."""
    from quiver.llm.line_dedup import line_dedup

    rng = random.Random(12)
    cjk = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40)) for _ in range(4)]
    lines = ["https://example.com/alpha/page1", "https://example.com/totally/different/thing", "2024-01-01\t17\ttea", "2024-01-01\t99\tcoffee", "self.assertEqual(a, 1)", "self.assertEqual(b.value, [2])", "x", "x", "\U0001f600\U0001f601 ok", "aaaa" * 300, "aaaa" * 301]
    lines += [*cjk, cjk[0][:20] + cjk[1][20:], cjk[2] + "。"]
    template = "order {} of {} was sent to {} on the usual way and paid for by {} within a day"
    for _ in range(40):
        words = [f"n{rng.randrange(10**6)}" for _ in range(4)]
        lines += [template.format(*words), template.format(*words) + "."]
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(3000))
    lines += [long, long + " tail", *(f"line {i} {rng.randrange(10**9)}" for i in range(300))]
    rng.shuffle(lines)
    rows = [(i // 2, "\n".join(lines[k : k + 12])) for i, k in enumerate(range(0, len(lines), 12))]
    rows += [(None, "kept once\nalpha beta gamma"), (None, "kept once\nanother one here"), (None, None), (7, ""), (8, " \n\t"), (9, None), rows[3], rows[4]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'kept' as n_lines", "1 as row", "2 as pos", "'l' as line")
    want = kept_lines(rows)
    out = line_dedup(frame)
    assert [c for c in out.columns if c in ("row", "pos", "line")] == ["row", "pos", "line"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_removed) for r in out.collect())
    kept = sorted((r[0] is None, r[0] or 0, want.get(r) or "", (r[1] or "").count("\n") - want[r].count("\n") if r in want and want[r] else -1) for r in rows)
    missed = sum(a[:3] != b[:3] for a, b in zip(got, kept))
    assert len(got) == len(kept) and missed <= 1, [(a, b) for a, b in zip(got, kept) if a[:3] != b[:3]]


def test_line_recall_on_templates(spark):
    """Two near-equal lines in each of many families that share most of their words."""
    from quiver.llm.line_dedup import removed_lines
    from pyspark.sql import functions as F

    found = []
    for seed in (1, 2):
        rng = random.Random(seed)
        frame = [f"common{i}" for i in range(24)]
        lines = []
        for _ in range(150):
            own = [f"o{rng.randrange(10**6)}" for _ in range(6)]
            both = [*frame[:12], *own, *frame[12:]]
            lines += [" ".join(both), " ".join([*both[:-1], "commonX"])]
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        gone = removed_lines(docs).agg(F.sum(F.size("removed"))).first()[0] or 0
        sets = [line_sets(x) for x in lines]
        root = list(range(len(lines)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(lines)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
        found.append(gone / sum(root[i] != i for i in range(len(lines))))
    assert min(found) >= 0.95 and max(found) <= 1, found


def test_topk_with_extreme_components(spark):
    """Scores in whole numbers of any size; those beyond a long are the nearest long."""
    from quiver.llm.bitsliced_topk import exact_topk

    rows = [(0, [0.0, 1e7, 0.0, 0.0]), (1, [1e8, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, [-1e300, 3.0, 0.0, 0.0]), (4, [5e-324, -0.0, -5e-324, 1e18]), (5, [1e18, 1e18, 1e18, 1e18]), (6, [2.0, 2.0, 2.0, 2.0]), (7, [2.0, 2.0, 2.0, 2.0]), (7, [9.0, 2.0, 2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "'x' as asks", "2 as score")
    best = {}
    for i, v in rows:
        best[i] = min(best.get(i, v), v)
    whole = {i: [1024 * a // b for a, b in (x.as_integer_ratio() for x in v)] for i, v in best.items()}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    got = {}
    for r in exact_topk(frame, frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in whole:
        scores = sorted(((clip(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(scores[:10])]


def test_search_ties_lengths_and_repeated_rows(spark):
    from quiver.llm.multi_index_hash import ann

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0]) for i in range(15)] + [(100, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as place")
    got = {}
    for r in ann(frame, frame.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[100]) == [(i, 100 + i, 0.0) for i in range(1, 11)]
    d = {i: np.sqrt(((np.asarray(v) - np.asarray(rows[0][1])) ** 2).sum()) for i, v in rows[1:60]}
    exact = sorted(d, key=lambda i: (d[i], i))[:10]
    assert len({i for _, i, _ in got[0]} & set(exact)) >= 9


def test_the_log_is_streamed_edited_and_regenerated(spark):
    from quiver.llm import chat_format as m

    rows = [(1, 0, "user", "a" * 300), (1, 1, "assistant", "\U0001f600b" * 200), (1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (2, 0, "tool", ""), (3, 5, "user", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'y' as m", "2 as step")
    events = m.to_events(frame)
    ops = {r["op"] for r in events.collect()}
    assert ops == {"start", "delta", "edit", "regenerate"}
    per = events.filter("op = 'delta'").groupBy("conv_id", "seq").count()
    assert 1 < per.agg({"count": "max"}).first()[0] <= m.PIECES + 1
    turns = {r.conv_id: m.parse(r.formatted)[0] for r in m.format_events(events).collect()}
    assert turns == {1: [(r[2], r[3]) for r in sorted(rows[:4], key=lambda r: (r[1], r[3]))], 2: [("tool", "")], 3: [("user", "x" * 100_000)]}


def test_jaccard_counts_and_groups_against_brute_force(spark, monkeypatch):
    """Families of near copies in every block size, with null ids and clashing columns."""
    from quiver.llm import jaccard_join as m

    monkeypatch.setattr(m, "BLOCK", 1 << 9)
    rng = random.Random(31)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, rows[0][1]), (None, "a b c"), (500, "a b c"), (501, "A b C"), (502, None), (503, "")]
    rows += [(600 + i, " ".join(rng.choices(["p", "q", "r"], k=rng.randrange(4, 12)))) for i in range(25)]
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda x: x[0].lower(), x) for x in words_of(text)]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    want = sorted((doc is None, doc or 0, len(sets[i]), ids.get(find(i), doc)) for i, (doc, _) in enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as n", "2 as kind")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in m.jaccard_components(frame).collect())
    assert got == want


def test_digests_of_kept_lines(spark):
    from quiver.llm.line_dedup import digest, line_dedup

    rows = [(1, "one line\nof text"), (2, None)]
    out = {r.doc_id: r for r in digest(line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[1].kept_sha256 == hashlib.sha256(b"one line\nof text").hexdigest() and out[2].n_lines == 0


def test_very_long_documents_are_one_chain(monkeypatch):
    """The forward pass goes on over the cuts of a document, and does not over its end."""
    from quiver.llm import language_id as m

    emission, move = np.random.default_rng(6).normal(size=(9, 3)), np.random.default_rng(7).normal(size=(3, 3))
    whole = m.forward_backward(emission, np.asarray([0]), np.asarray([9]), move)[2]
    first = m.forward_backward(emission[:4], np.asarray([0]), np.asarray([4]), move)[2]
    assert np.allclose(m.forward_backward(emission[4:], np.asarray([0, 3]), np.asarray([3, 5]), move, first)[0].sum(axis=1), 1)
    assert np.allclose(m.forward_backward(emission[4:], np.asarray([0]), np.asarray([5]), move, first)[2], whole)
    a, b = [x.encode() for x in ("the thing", "oui eux")]
    model = m.Crf(["a", "b"]).fit([a * 20, b * 20], np.asarray([0, 1]))
    texts = [(a + b" ") * 200_000, b"oui", (b + b" ") * 150_000]
    want = model.posteriors(texts)
    monkeypatch.setattr(m, "CHAIN", 100_000)
    got = model.posteriors(texts)
    assert (got[1] == want[1]).all() and np.allclose(got[0], want[0], rtol=1e-3, atol=0.5)


def test_line_similarity_takes_hashes_with_repeats(spark):
    """Lines of repeated shingles are compared as sets; sixteen shingles are hashed in a row."""
    from quiver.llm import line_dedup as m

    rng = random.Random(13)
    lines = ["a" * 400, "a" * 7, "", "abab" * 30, "baba" * 31, *("".join(rng.choices("ab", k=n)) for n in range(8, 60, 3))]
    lines += [x + y for x, y in zip(lines, "ab" * 20)]
    told = spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("n", m.F.size(m.shingles(m.F.col("line"))))
    x, y = (told.select(*(m.F.col(c).alias(f"{c}_{s}") for c in told.columns)) for s in "xy")
    like = m._similar(m._hashes(m.F.col("line_x")), m._hashes(m.F.col("line_y")), m.F.col("n_x"), m.F.col("n_y"))
    sets = [line_sets(line) for line in lines]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)}
    assert {tuple(r) for r in x.crossJoin(y).filter(like).select("id_x", "id_y").collect()} == want and len(want) > len(lines)
    assert m._strides(told.select("id", m._units(m.F.col("line")).alias("units"))).filter("id = 0").count() == 25
