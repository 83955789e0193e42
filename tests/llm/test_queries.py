"""The registered queries and the pipeline against versions in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from test_edge_cases import kept_lines
from test_text_operators import kept_by_brute_force, words_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_query(spark, rows):
    from quiver.llm.queries import queries

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries()["op1_substring_dedup"](spark, SMALL).collect()}
    assert got == kept_by_brute_force(rows)


def test_op7_query(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from quiver.llm.queries import queries

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[doc] = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in queries()["op7_bpe"](spark, SMALL).collect()} == want


def test_op8_query_on_held_out_rows(spark):
    from quiver.llm.queries import queries

    got = {r.doc_id: r for r in queries()["op8_language_id"](spark, SMALL).collect()}
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang is not null").select("doc_id", "lang").collect()}
    held = [i for i in known if got[i].held_out and got[i].lang_pred != "und"]
    assert held and sum(got[i].lang_pred == known[i] for i in held) >= 0.95 * len(held)


def test_pooling_against_a_loop():
    from quiver.llm.toxicity import FILTERS, WIDTHS, TextCnn

    rng = np.random.default_rng(4)
    model = TextCnn()
    size = [1, 2, 5, 9]
    x = rng.normal(size=(sum(size), 8)).astype(np.float32)
    ends = np.cumsum(size)
    starts = ends - size
    pooled, places = model.pool(x, starts, ends, where=True)
    for t, (s, e) in enumerate(zip(starts, ends)):
        column = 0
        for j, f in enumerate(model.filters):
            for c in range(FILTERS):
                answers = []
                for i in range(s, e):
                    answers.append(float(model.bias[j][c]) + sum(float(x[i + o] @ f[o][:, c]) for o in range(len(f)) if i + o < e))
                assert pooled[t, column] == pytest.approx(max(answers), abs=1e-5)
                assert places[j][t, c] == s + int(np.argmax(answers))
                column += 1
    assert pooled.shape == (4, FILTERS * len(WIDTHS))


def test_thresholds_against_a_loop():
    from quiver.llm.toxicity import TextCnn

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["pela", "rosk", "vim", "tund", "lorra"], k=rng.randrange(1, 9))).encode() for _ in range(120)]
    labels = np.asarray([t.count(b"rosk") > 1 for t in texts], np.int64)
    model = TextCnn().fit(texts, labels)
    weights = np.where(labels == 1, 1.0, 2.0)
    model.calibrate(texts, labels, weights, least=10**9)  # one threshold for all
    logits, _ = model.score(texts)

    def f1(cut):
        told = logits > cut
        return 2 * (weights * told * labels).sum() / ((weights * told).sum() + (weights * labels).sum())

    best = max(f1(z - 1e-6) for z in logits)
    assert f1(model.thresholds[-1]) == pytest.approx(best, abs=1e-9)
    p = model.probabilities(texts)
    assert ((p >= 0.5) == (logits >= model.thresholds[-1])).all()


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def one_of_each(rows):
    least = {r[0]: r[0] for r in rows}
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    for _ in rows:
        before = dict(least)
        for i in sets:
            for j in sets:
                common = len(sets[i] & sets[j])
                if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
        if least == before:
            break
    return [r for r in rows if least[r[0]] == r[0]]


def copies(rows):
    """Copies of each (doc_id, text, source) in the mix."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {r[0]: len(words_of(r[1])) for r in rows}
    source = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in names}
    left, target, still = sum(source.values()), {}, list(names)
    while still:
        level = left / sum(weight[s] for s in still)
        full = [s for s in still if 3 * source[s] < level * weight[s]]
        for s in full or still:
            target[s] = 3 * source[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        still = [s for s in still if s not in target]
    out = []
    for s in names:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        at = 0
        for _ in range(3):
            for r in mine:
                if size[r[0]] and at < int(target[s] + 1e-9):
                    out.append(r)
                at += size[r[0]]
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from test_text_operators import corpus
    from tokenizers import Tokenizer

    data = [(i, t and t.replace("0", "a"), "en", s, n) for i, t, _, s, n in corpus(seed=5, n=40)]
    data += [(700, "one own line here\n" + data[3][1], "en", "s9", 1), (701, None, None, None, None), (702, "", "en", "s0", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = [(r.doc_id, r.text, r.source) for r in pipeline.keep_languages(spark, docs, str(tmp_path)).collect()]
    assert {r[0] for r in told} == {i for i, t, *_ in data if t and re.search(r"[^\W\d_]", t)}
    cut = kept_lines([r[:2] for r in told])
    told = [(i, cut[i, t], s) for i, t, s in told if words_of(cut[i, t])]
    mixed = copies(one_of_each(told))
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i, len(ids), sha(",".join(map(str, ids))), sha(t)) for i, t, _ in mixed for ids in [tokenizer.encode(t, add_special_tokens=False).ids])
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == want
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
