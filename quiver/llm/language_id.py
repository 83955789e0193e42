"""Language ID of documents with a linear-chain conditional random field over words.

Words are runs of letters of the lower-cased text.  A word's emission scores
come from hashed features: the word itself (lexicon), its prefixes and suffixes
(affixes) and its byte n-grams.  With learned transitions between languages,
forward-backward gives each word's posterior over languages, so a passage in
another language is labelled as such; a document's language is the one with
most posterior words, and its score is their share.

Training: forward-backward gradients on segments of SEGMENT words, Adagrad over
all of them at once.  The training sample is bounded: about SAMPLE documents for
each language, picked by a hash of id and text; everything else sees all rows.

A document of more than CHAIN words is labelled in parts: the forward pass goes
on over a cut, the backward pass starts anew there, so only words near a cut see
less of what follows.

Nulls: a text that is null, empty or without a letter is `und` with score 0; so
is every text if there is nothing to learn from.  A null doc_id is carried.
Repeated rows get equal results.  Ties go to the language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import held_out, release_memory
from quiver.llm.words import NOT_LETTER, mix, runs, scan

SAMPLE = 120
#: Words of one document that are held at once; see the docstring.
CHAIN = 4_000_000
SEGMENT = 32
DIM = 1 << 16
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3)
_U = np.uint64
_CACHE = 1 << 17


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature bucket) pairs of words given by their bytes."""
    n, size = len(starts), ends - starts
    who, what = [np.arange(n)], [mix(hashes ^ _U(1))]
    bytes_at = lambda at: data[at].astype(_U)
    for k in AFFIXES:
        pick = np.flatnonzero(size >= k)
        head, tail = np.full(len(pick), 100 + k, _U), np.full(len(pick), 200 + k, _U)
        for j in range(k):
            head = (head << _U(8)) ^ bytes_at(starts[pick] + j)
            tail = (tail << _U(8)) ^ bytes_at(ends[pick] - k + j)
        who += [pick, pick]
        what += [mix(head), mix(tail)]
    for k in GRAMS:
        count = np.maximum(size - k + 1, 0)
        owner = np.repeat(np.arange(n), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        gram = np.full(len(owner), 300 + k, _U)
        for j in range(k):
            gram = (gram << _U(8)) ^ bytes_at(at + j)
        who.append(owner)
        what.append(mix(gram))
    return np.concatenate(who), (np.concatenate(what) & _U(DIM - 1)).astype(np.int64)


def forward_backward(emission: np.ndarray, starts: np.ndarray, ends: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None):
    """Posteriors of each word, the expected transition counts and the last word's forward vector.

    emission: log scores (words x labels); sequences are [start, end) spans.
    All sequences advance together, longest first.  before: the forward vector
    of the word before the first sequence, if that one goes on from it.
    """
    labels = emission.shape[1]
    order = np.argsort(starts - ends, kind="stable")
    last = int(ends[-1]) - 1 if len(ends) else -1
    starts, length = starts[order], (ends - starts)[order]
    score = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(score), np.empty_like(score)
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    now = None
    for t, n in enumerate(active):
        at = starts[:n] + t
        now = score[at] if t == 0 else (now[:n] @ move) * score[at]
        if t == 0 and before is not None:
            goes_on = int(np.flatnonzero(order == 0)[0])
            now[goes_on] *= before @ move
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    expected = np.zeros((labels, labels))
    after = np.empty((0, labels), score.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        now = np.ones((n, labels), score.dtype)
        m = len(after)
        if m:
            into = after * score[at[:m] + 1]
            now[:m] = into @ move.T
            weight = (alpha[at[:m]] * now[:m]).sum(axis=1, keepdims=True)
            expected += (alpha[at[:m]] / weight).T @ into * move
        now /= now.sum(axis=1, keepdims=True)
        beta[at] = now
        after = now
    posterior = alpha * beta
    posterior /= posterior.sum(axis=1, keepdims=True)
    return posterior, expected, alpha[last] if last >= 0 else None


class Crf:
    def __init__(self, languages: list[str]):
        self.languages = languages
        self.weights = np.zeros((DIM, len(languages)), np.float32)
        self.transition = np.zeros((len(languages), len(languages)))
        self.cache = None

    def fit(self, texts: list[bytes], gold: np.ndarray, rounds: int = 25, rate: float = 0.5, decay: float = 1e-6) -> Crf:
        """gold[i]: index of the language of text i; each of its words has that label."""
        labels = len(self.languages)
        who, what, words, owners, base = [], [], [], [], 0
        known: dict[int, int] = {}
        for data, starts, ends, owner, hashes in scan(texts, NOT_LETTER):
            distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            number = np.fromiter((known.setdefault(h, len(known)) for h in distinct.tolist()), np.int64, len(distinct))
            fresh = np.flatnonzero(number >= base)
            w, f = word_features(data, starts[first[fresh]], ends[first[fresh]], distinct[fresh])
            who.append(number[fresh][w])
            what.append(f)
            base = len(known)
            words.append(number[inverse])
            owners.append(owner)
        if not words:
            return self
        who, what, words, owners = (np.concatenate(x).astype(np.int32) for x in (who, what, words, owners))
        known.clear()
        label = gold[owners]
        _, begin, end = runs(owners.astype(np.int64) * (1 << 32) + (np.arange(len(owners)) - np.searchsorted(owners, owners)) // SEGMENT)
        # Every language weighs alike, however many words its sample has.
        weight = (len(label) / np.maximum(1, np.bincount(label, minlength=labels)) / labels)[label][:, None]
        hot = np.eye(labels)[label]
        square, square_move = np.full(self.weights.shape, 1e-8), np.full(self.transition.shape, 1e-8)
        inner = np.ones(len(label), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)
        seen = np.zeros_like(self.transition)
        np.add.at(seen, (label[at - 1], label[at]), 1)
        for _ in range(rounds):
            emission = np.stack([np.bincount(who, self.weights[what, j], minlength=base) for j in range(labels)], axis=1)
            posterior, expected, _ = forward_backward(emission[words], begin, end, self.transition)
            miss = (hot - posterior) * weight / len(label)
            by_word = np.stack([np.bincount(words, miss[:, j], minlength=base) for j in range(labels)], axis=1)
            step = np.stack([np.bincount(what, by_word[who, j], minlength=DIM) for j in range(labels)], axis=1) - decay * self.weights
            square += step**2
            self.weights += (rate * step / np.sqrt(square)).astype(np.float32)
            move = (seen - expected) / len(label) - 1e-3 * self.transition
            square_move += move**2
            self.transition += 0.1 * move / np.sqrt(square_move)
        return self

    def emissions(self, data, starts, ends, hashes) -> np.ndarray:
        """Scores of each word; those of recent words come from a direct-mapped cache."""
        if self.cache is None:
            self.cache = np.zeros(_CACHE, _U), np.zeros((_CACHE, len(self.languages)), np.float32)
        tags, scores = self.cache
        slot = (hashes & _U(_CACHE - 1)).astype(np.int64)
        miss = np.flatnonzero(tags[slot] != hashes)
        out = scores[slot]
        if len(miss):
            distinct, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[first]
            who, what = word_features(data, starts[at], ends[at], distinct)
            weights = self.weights[what]
            fresh = np.stack([np.bincount(who, weights[:, j], minlength=len(distinct)) for j in range(weights.shape[1])], axis=1).astype(np.float32)
            out[miss] = fresh[inverse]
            tags[slot[at]], scores[slot[at]] = distinct, fresh
        return out

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Summed word posteriors of each text, and its number of words."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        held, size, before = [], 0, None

        def settle():
            nonlocal before
            emission, owner = (np.concatenate(x) for x in zip(*held))
            who, begin, end = runs(owner)
            posterior, _, before = forward_backward(emission, begin, end, self.transition.astype(np.float32), before)
            total[who] += np.add.reduceat(posterior, begin, axis=0)
            count[who] += end - begin

        for data, starts, ends, owner, hashes in scan(texts, NOT_LETTER):
            if not len(owner):
                continue
            # Between documents, or inside a very long one.
            if size > CHAIN // 4 and (held[-1][1][-1] != owner[0] or size > CHAIN):
                same = held[-1][1][-1] == owner[0]
                settle()
                held, size = [], 0
                before = before if same else None
            held.append((self.emissions(data, starts, ends, hashes), owner))
            size += len(owner)
        if held:
            settle()
        return total, count


def train(documents: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """Fit on about `sample` documents of each language among the rows given."""
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))))
    dice = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.filter(dice < share[F.col("lang")]).select("lang", F.lower("text").cast("binary").alias("text")).collect()
    languages = sorted(counts)
    picked.sort(key=lambda r: (r["lang"], bytes(r["text"])))
    model = Crf(languages).fit([bytes(r["text"]) for r in picked], np.asarray([languages.index(r["lang"]) for r in picked], np.int64))
    del picked
    release_memory()
    return model


def identify(documents: DataFrame, model: Crf | None) -> DataFrame:
    """documents with lang_pred and score; the model never sees lang, source or doc_id."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    if model is None:
        return documents.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = documents.select(*kept).schema
    out = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double"

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total, count = model.posteriors(texts)
            best = total.argmax(axis=1) if len(total) else np.zeros(0, int)
            found = count > 0
            lang = [model.languages[b] if f else "und" for b, f in zip(best, found)]
            share = np.where(found, total[np.arange(len(best)), best] / np.maximum(1, count), 0.0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.clip(share, 0, 1), pa.float64())], names=[*kept, "lang_pred", "score"])

    letters = F.when(has_letter, F.lower("text")).cast("binary").alias("_letters")
    return documents.select(*kept, letters).mapInArrow(run, out)


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    model = train(documents.filter(~held_out()))
    return identify(documents.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


