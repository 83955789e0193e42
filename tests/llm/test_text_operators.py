"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(9)) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(1, 160))
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 7 == 3 and texts:
            words = texts[rng.randrange(len(texts))].split() or ["x"]
            words[rng.randrange(len(words))] = "Edit"
        texts.append(" ".join(words))
    texts += ["", "  \n ", "one", "a b c d", "a b c d", "same word " * 60, texts[0], texts[0]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return [*rows, (900, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_by_brute_force(rows, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring_dedup(spark, docs, monkeypatch, hot):
    from quiver.llm import substring_dedup as m

    monkeypatch.setattr(m, "HOT", hot)
    got = {r[0]: tuple(r)[1:] for r in m.substring_dedup(docs).collect()}
    assert got == kept_by_brute_force(corpus())
    assert sum(v[1] for v in got.values()) > 0
    assert m.substring_dedup(empty(spark)).count() == 0


def test_substring_dedup_long_word_and_repeated_rows(spark):
    from quiver.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{i}" for i in range(50)) + " " + "x" * 3_000_000
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 51), (True, 0, 51)]


def test_automaton_finds_first_places():
    from quiver.llm.substring_dedup import Automaton

    rng = random.Random(4)
    for _ in range(100):
        passages = [[rng.randrange(3) for _ in range(rng.randrange(4, 12))] for _ in range(4)]
        automaton, first = Automaton(), {}
        for i, p in enumerate(passages):
            states = automaton.add(p, i)
            for end in range(2, len(p)):
                key = tuple(p[end - 2 : end + 1])
                first.setdefault(key, (i, end))
                assert automaton.first_end(states[end], 3) == first[key]


def test_mixing_meets_its_targets(spark, docs):
    from quiver.llm.mixing import mix, schedule_rows

    clash = docs.withColumn("size", docs["n_chars"]).withColumn("target", docs["n_chars"])
    mixed = mix(clash).collect()
    assert len(mixed) == docs.count()
    by_source = {}
    for r in mixed:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r["size"] == len(words_of({x[0]: x[1] for x in corpus()}[r.doc_id]))
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        assert sum(r.taken for r in rows) == int(rows[0].target)
    ordered = schedule_rows(mix(docs), 3)
    positions = [r.position for r in ordered.collect()]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert mix(empty(spark)).count() == 0


def test_mixing_caps_are_filled_by_weight(spark):
    from quiver.llm.mixing import targets

    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in targets(sized).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(2010)


def test_jaccard_components(spark, docs):
    from quiver.llm.jaccard_join import jaccard_components

    sets = {}
    for doc_id, text, *_ in corpus():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        sets[doc_id] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    least = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}
    assert len(set(least.values())) < len(sets)
    assert jaccard_components(empty(spark)).count() == 0


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """Common passages and a group of near copies whose tokens are all frequent."""
    from quiver.llm import jaccard_join as m

    monkeypatch.setattr(m, "FREQUENT", 3)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"o{i}x{k}" for k in range(rng.choice([2, 8, 14, 40]))] + passage)) for i in range(25)]
    base = [f"b{i}" for i in range(80)]
    for i in range(25, 50):
        copy = list(base)
        copy[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in range(6):
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    got = {r.doc_id: r.component_id for r in m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_line_dedup(spark):
    from quiver.llm.line_dedup import digest, line_dedup

    long = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer at noon today again"
    near = long.replace("noon", "dusk")
    rows = [(1, f"{long}\nfirst line of its own\n\nshort", "x"), (2, f"second text here\n{near}", "y"), (3, long, "z"), (4, None, None), (5, "", "e"), (6, "short", "s"), (7, "unique words stay as they are", "u")]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()}
    assert out[1].text == rows[0][1] and out[1].n_removed == 0 and out[1].n_lines == 4
    assert out[2].text == "second text here" and out[2].n_removed == 1
    assert out[3].text == "" and out[6].text == "" and out[4].text is None and out[5].text == ""
    assert out[7].text == rows[6][1] and out[1].removed == "x"
    assert digest(line_dedup(spark.createDataFrame(rows, "doc_id long, text string, removed string"))).count() == 7
    assert line_dedup(empty(spark)).count() == 0


def test_line_links_against_all_pairs(spark):
    """High recall: nearly all pairs over the threshold are joined, none below it is linked."""
    from pyspark.sql import functions as F

    from quiver.llm.line_dedup import _lines, line_links, shingles, signatures

    rng = random.Random(3)
    lines = []
    for _ in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(8, 40))]
        lines.append(" ".join(base))
        base[rng.randrange(len(base))] = "changed"
        lines.append(" ".join(base))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    whole = _lines(docs)
    sets = {r[0]: set(r[1]) for r in whole.select(F.xxhash64("line"), shingles(F.col("line"))).collect()}
    want = {(max(a, b), min(a, b)) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in line_links(whole, signatures(whole)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and want


def test_components(spark):
    from quiver.llm.components import components

    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def variants(rng, groups):
    """Pairs of lines of which one word of many differs."""
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(15, 40))]
        yield " ".join(base)
        base[rng.randrange(len(base))] = "changed"
        yield " ".join(base)


def sets_of(docs):
    from pyspark.sql import functions as F

    from quiver.llm.line_dedup import _lines, shingles

    whole = _lines(docs)
    return whole, {r[0]: set(r[1]) for r in whole.select(F.xxhash64("line"), shingles(F.col("line"))).collect()}


def test_line_bands_keep_their_recall(spark):
    """The bands alone meet 0.989 of the pairs at similarity 0.8, more of those above."""
    from quiver.llm.line_dedup import signatures

    docs = spark.createDataFrame(list(enumerate(variants(random.Random(5), 1500))), "doc_id long, text string")
    whole, sets = sets_of(docs)
    keys = {r.doc: (r.id, {(i, r[f"k{i}"]) for i in range(6)}) for r in signatures(whole).collect()}
    near = found = 0
    for i in range(0, 3000, 2):
        (a, x), (b, y) = keys[i], keys[i + 1]
        if 0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) <= 0.88:
            near += 1
            found += bool(x & y)
    assert near > 400 and found >= 0.98 * near, (near, found)


def test_line_buckets_are_compared_whole(spark):
    """Every near-equal pair of one bucket ends in one component, also those unlike the bucket's ends."""
    from pyspark.sql import functions as F

    from quiver.llm.components import components
    from quiver.llm.line_dedup import CELL, line_links, signatures

    docs = spark.createDataFrame(list(enumerate(variants(random.Random(6), CELL))), "doc_id long, text string")
    whole, sets = sets_of(docs)
    signed = signatures(whole).withColumn("k0", F.lit(1).cast("long"))  # all lines share a bucket
    root = {r.node: r.component for r in components(line_links(whole, signed)).collect()}
    ids = [r.id for r in signed.orderBy("doc").collect()]
    want = [(a, b) for a, b in zip(ids[::2], ids[1::2]) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(want) > 300 and all(root.get(a, a) == root.get(b, b) for a, b in want)


def test_line_shingles_cover_long_runs(spark):
    """No character is outside of the shingles: lines that open alike are not equal."""
    from quiver.llm.line_dedup import line_dedup

    run = "".join(chr(0x4E00 + i) for i in range(60))
    lines = ["https://example.com/news/1", "https://example.com/about/contact", "self.assertEqual(first, 1)", "self.assertEqual(second.value, 2)", "2024-01-01\t17\ttea", "2024-01-01\t99\tcoffee and more", run[:40], run[:10] + run[40:]]
    rows = [(i, x, 0) for i, x in enumerate(lines)] + [(100, run, 0), (101, "x" + run, 1)]
    out = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert out == {r[0]: r[2] for r in rows}


def test_unlike_lines_of_a_bucket_are_not_verified(spark, monkeypatch):
    """Of the lines that share a bucket only those whose minima agree are read and compared; their links are all found."""
    from pyspark.sql import functions as F

    from quiver.llm import line_dedup as m
    from quiver.llm.components import components

    rng = random.Random(8)
    lines = list(variants(rng, 20)) + [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    whole, sets = sets_of(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    signed = m.signatures(whole).withColumn("k0", F.lit(1).cast("long"))  # all lines share a bucket
    made, written = {}, m.written
    monkeypatch.setattr(m, "written", lambda df, name: made.setdefault(name, written(df, name)))
    root = {r.node: r.component for r in components(m.line_links(whole, signed)).collect()}
    ids = [r.id for r in signed.orderBy("doc").collect()]
    want = [(a, b) for a, b in zip(ids[:40:2], ids[1:40:2]) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(want) > 10 and all(root.get(a, a) == root.get(b, b) for a, b in want)
    assert made["line-candidates"].count() <= 60
