"""Learned operators on held-out rows, exact search, tokens and chat against their references."""

import hashlib
import json
import random

import numpy as np
import pytest


def test_bitsliced_topk(spark):
    from quiver.llm.bitsliced_topk import exact_topk

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(120, 16)).astype(np.float32)
    vectors[50] = vectors[51]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist(), 1), (200, None, 1), (201, [float("nan")] * 16, 1), (202, [], 1), (203, [1.0, 2.0], 1), (300, [0.0] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    whole = {i: np.floor(v.astype(float) * 1024).astype(int) for i, v in enumerate(vectors)} | {300: np.zeros(16, int)}
    got = {}
    for r in exact_topk(frame, frame.filter("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in [i for i in whole if i % 10 == 0]:
        best = sorted(((int(whole[q] @ v), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:10]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(best)]
    assert 203 not in got and 200 not in got
    assert exact_topk(frame.limit(0), frame.limit(0)).count() == 0


def test_multi_index_hash(spark):
    from quiver.llm.multi_index_hash import ann

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 32), (902, [float("inf")] * 32), (903, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hit = total = 0
    got = {}
    for r in ann(frame, frame.filter("vec_id % 50 = 0 and vec_id < 600")).collect():
        got.setdefault(r.query_id, []).append(r)
    for q, rs in got.items():
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        rs.sort(key=lambda r: r["rank"])
        assert [r.score for r in rs] == sorted(r.score for r in rs)
        assert all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in rs)
        hit += len({r.vec_id for r in rs} & set(np.argsort(d)[:10].tolist()))
        total += 10
    assert len(got) == 12 and hit >= 0.9 * total
    few = frame.filter("vec_id < 4")
    assert ann(few, few).count() == 12
    assert ann(frame.limit(0), frame.limit(0)).count() == 0


def test_pigeonhole_reaches_every_code():
    from quiver.llm.multi_index_hash import MultiIndex

    codes = np.random.default_rng(2).integers(0, 256, (300, 8), dtype=np.uint8)
    index = MultiIndex(codes)
    for radius in (0, 7, 8, 20, 27):
        for q in range(10):
            d = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(d <= radius).tolist()


def _labelled(n=400, seed=5):
    rng = random.Random(seed)
    plain, bad = [f"{a}{b}" for a in ("lo", "mi", "ta", "ru", "se") for b in ("ner", "vin", "dak", "pol")], ["scum", "vile", "rot"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=rng.randrange(5, 60))
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    from quiver.llm.toxicity import toxicity

    docs, labels = _labelled()
    frame = spark.createDataFrame([*docs, (-1, None), (-2, ""), (None, "scum")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert held and sum(p == y for p, y in held) >= 0.95 * len(held)
    none = toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(frame.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_language_id(spark):
    from quiver.llm.language_id import language_id

    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "wha", "oth"], "bb": ["eux", "ille", "çon", "oui"]}
    rows = []
    for i in range(300):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang))
    rows += [(1001, None, "aa"), (1002, "123 !!", "bb"), (1003, "", None), (None, "theing", None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang as lang_pred")).collect()}
    assert all(got[i].lang_pred == "und" for i in (1001, 1002, 1003)) and got[None].lang_pred == "aa"
    held = [r for r in rows[:300] if got[r[0]].held_out]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = spark.createDataFrame([(1, "word")], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    assert language_id(nothing).first().lang_pred == "und"


def test_crf_labels_code_switched_words():
    from quiver.llm.language_id import Crf

    rng = random.Random(9)
    make = lambda parts, n: " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))
    a, b = ["the", "ing", "oth"], ["eux", "ille", "oui"]
    texts = [make(a if i % 2 else b, 40).encode() for i in range(60)]
    model = Crf(["b", "a"]).fit(texts, np.asarray([i % 2 for i in range(60)]))
    total, count = model.posteriors([(make(a, 30) + " " + make(b, 10)).encode(), b""])
    assert count.tolist() == [40, 0] and total[0, 1] == pytest.approx(30, abs=1.5)


def test_forward_backward_is_exact():
    from itertools import product

    from quiver.llm.language_id import forward_backward

    rng = np.random.default_rng(3)
    emission, move = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    spans = [(0, 4), (4, 5), (5, 7)]
    posterior, expected, _ = forward_backward(emission, np.asarray([s for s, _ in spans]), np.asarray([e for _, e in spans]), move)
    want, pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for s, e in spans:
        paths = list(product(range(3), repeat=e - s))
        weights = np.asarray([np.exp(sum(emission[s + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            for i, y in enumerate(p):
                want[s + i, y] += w
            for x, y in zip(p, p[1:]):
                pairs[x, y] += w
    assert np.allclose(posterior, want) and np.allclose(expected, pairs)


TEXTS = ["Hello world", "it's we'LL they'll  x\n\n y\t'd 'save  nb　 <|endoftext|> a\U0001f600b ''s 1'2s's \r\n ", "", None, "   ", "ّ²Ⅻ' s​　zz'REs \x1c\x85", "a" * 5000, "é" * 300 + " naïve", "<|endoftext|><|endoftext|>", "'", "'s", " 's", "x'", "\n", "\n\n a"]


def test_bpe_matches_the_library(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quiver.llm import bpe

    monkeypatch.setattr(bpe, "TABLE", 8)
    text = bpe.tokenizer_text(public.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "null id")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as ids"), text, outputs=True).collect()
    tokenizer = Tokenizer.from_str(text)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert by[i].ids == ids and by[i].n_tokens == len(ids), repr(t)
        assert by[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(got), text).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), text).count() == 0


def test_bpe_splits_like_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from quiver.llm import bpe

    vocabulary = bpe.Vocabulary(bpe.tokenizer_text(public.path("byte_bpe_50k.json")))
    tokenizer, table = Tokenizer.from_str(vocabulary.text), bpe.WordTable(vocabulary)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab1 \n\t'é　!.stredvml ²\U0001f600")) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
    def same(texts):
        found = dict(table.encode_texts(texts))
        for i, t in enumerate(texts):
            ids = [x for r in found.get(i, np.empty(0, int)).tolist() for x in table.ids[r]]
            assert ids == tokenizer.encode(t, add_special_tokens=False).ids

    same()


def test_chat_format(spark):
    from quiver.llm import chat_format as m

    rows = [(1, 1, "assistant", "b\\<|x"), (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nno"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "z"), (3, None, "user\nx", "late"), (3, 2, "assistant", "ok")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as seq", "'y' as op")
    formatted = m.format_events(m.to_events(frame))
    turns = {r.conv_id: m.parse(r.formatted)[0] for r in formatted.collect()}
    assert turns[1] == [("user", rows[1][3]), ("assistant", "b\\<|x")] and turns[2] == [("", ""), ("", "")]
    assert turns[None] == [("assistant", "z")] and turns[3] == [("user\nx", "late"), ("assistant", "ok")]
    back = {r.conv_id: r for r in m.read_back(formatted).collect()}
    assert back[1].loss_chars == 5 and back[1].loss_sha256 == hashlib.sha256(b"b\\<|x").hexdigest() and back[2].loss_chars == 0
    assert m.read_back(m.format_events(m.to_events(frame.limit(0)))).count() == 0


def test_chat_fold():
    from quiver.llm.chat_format import fold

    log = [("start", 0, "user", "hi"), ("start", 1, "assistant", ""), ("delta", 1, "assistant", "he"), ("delta", 1, "assistant", "y"), ("start", 2, "user", "?"), ("regenerate", 1, "assistant", "new"), ("edit", 0, "user", "HI"), ("delta", 5, "tool", "t")]
    assert fold(log) == [["user", "HI"], ["assistant", "new"], ["tool", "t"]]


def test_queries_are_named():
    from quiver.llm.queries import oracle_sql, queries

    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)] and set(oracle_sql()) <= set(queries())
    assert json.dumps(oracle_sql())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_text_operators import corpus

    rows = [(i, t and t.replace("0", "a"), "en", s, n) for i, t, _, s, n in corpus(n=40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0
        if name == "n-gram Jaccard join":
            assert docs.count() == docs.select("doc_id").distinct().count()
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """A change of the label of any one text changes what is counted; shards give one model whatever the partitions."""
    from quiver.llm import toxicity as m

    docs, labels = _labelled(700, seed=9)
    # One word that only the texts past any small sample have.
    docs = [(i, f"{text} zorb" if i % 7 == 0 else text) for i, text in docs]
    labels = [(i, 1 if i % 7 == 0 else y) for i, y in labels]
    monkeypatch.setattr(m, "SHARD", 100)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    counted, count = [], m._count
    monkeypatch.setattr(m, "_count", lambda rows: counted.append((count(rows), rows.count())) or counted[-1][0])
    model, again = m.train(frame, known), m.train(frame.repartition(3), known.repartition(5))
    (hits, sizes), n = counted[0]
    assert sizes.sum() == n and n > 450
    want, of = m.frequencies([t.lower().encode() for _, t in docs], np.asarray([y for _, y in labels]))
    assert of.sum() == 700 and (hits <= want).all() and hits.sum() > 0.6 * want.sum()
    assert (model.table == again.table).all() and (model.small() == again.small()).all() and (model.thresholds == again.thresholds).all()
    p = model.probabilities([t.encode() for _, t in docs])
    assert np.mean((p >= 0.5) == np.asarray([y for _, y in labels])) >= 0.95
