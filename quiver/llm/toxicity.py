"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are runs of letters of the lower-cased text.  A word's embedding is the
sum of two rows of a table, at two hashes of the word, so two words are only
confused if both hashes collide.  Filters of several widths slide over the whole
text, max pooling keeps each filter's strongest answer, and a logistic layer
scores the document.  Everything is trained in numpy with Adam.

The first embedding dimension starts from the smoothed log odds of its bucket
between toxic and other training texts, the others from small noise.

Thresholds are calibrated by language: the language is guessed from function
words of the text itself (the lang column is never read), and on training rows
kept from the fit each language's threshold is the one with the best F1; the
score is the logistic of the distance to it, so 0.5 is the threshold.

Every labelled text is learned from, on the executors: three quarters of them (by
a hash of the id) give the document frequencies and the gradients, the others the
thresholds.  Gradients are followed in shards of about SHARD texts, all from the
same start; the model is the mean of the shards' (a row of the table: of those that
changed it), added up as whole numbers, so that the order of tasks does not matter.
Thresholds come from counts of answers in steps of 1 / STEPS.  What is sent to the
driver is bounded by BUCKETS and by the steps.  Every text is scored as a whole.

Nulls: a null or empty text has no words and gets the score of the bias alone.
Without training rows of both classes every score is 0.  Repeated rows get
equal results.  A null doc_id is carried, is not held out and has no label.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import discard, held_out, written, written_paths
from quiver.llm.words import NOT_LETTER, mix, runs, scan

SHARD = 4096
STEPS = 1024
UNIT = 1 << 24
#: Bits of the filter that keeps most texts without a label from being moved.
MOST_FILTER_BITS = 1 << 25
BUCKETS = 1 << 17
WIDTH = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
_U = np.uint64

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with are from this by on at an or which",
    "fr": "le la les des et est pour dans que qui une du au sur pas plus par il elle",
    "de": "der die und das ist ein eine nicht mit auf den dem von zu als auch sich",
    "es": "el los las por con una para es se del al lo como pero su sus y",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_GUESS = 1 << 16


def _guess_table() -> np.ndarray:
    table = np.zeros(_GUESS, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for _, _, _, _, h in scan([words.encode()], NOT_LETTER):
            table[(h & _U(_GUESS - 1)).astype(np.int64)] = i + 1
    return table


_TABLE = _guess_table()


def guess(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Counts of function words by text and language."""
    code = _TABLE[(hashes & _U(_GUESS - 1)).astype(np.int64)]
    hit = code > 0
    return np.bincount(owner[hit] * len(LANGUAGES) + code[hit] - 1, minlength=texts * len(LANGUAGES)).reshape(texts, -1)


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(hashes)
    return (h & _U(BUCKETS - 1)).astype(np.int32), ((h >> _U(32)) & _U(BUCKETS - 1)).astype(np.int32)


class TextCnn:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = [rng.normal(0, 0.1, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3 / len(f)
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.shift = np.float32(-1.0)
        self.thresholds = np.zeros(len(LANGUAGES) + 1)

    def pool(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False):
        """Max-pooled filter answers of each text; x: embeddings of consecutive texts."""
        pooled, places = [], []
        texts = len(starts)
        owner = np.repeat(np.arange(texts), ends - starts)
        for f, b in zip(self.filters, self.bias):
            # Texts shorter than the filter read zeros past their end.
            answer = np.zeros((len(x), FILTERS), np.float32)
            answer += b
            answer += x @ f[0]
            for o in range(1, len(f)):
                part = x[o:] @ f[o]
                part[owner[o:] != owner[:-o]] = 0
                answer[:-o] += part
            best = np.maximum.reduceat(answer, starts, axis=0)
            pooled.append(best)
            if where:
                hit = answer == best[owner]
                at = np.full((texts, FILTERS), -1)
                rows, cols = np.nonzero(hit)
                at[owner[rows[::-1]], cols[::-1]] = rows[::-1]
                places.append(at)
        return np.concatenate(pooled, axis=1), places

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.shift

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> TextCnn:
        self.learn(*frequencies(texts, labels))
        return self.descend(texts, labels, epochs=epochs, batch=batch, rate=rate, seed=seed)

    def learn(self, hits: np.ndarray, texts: np.ndarray) -> None:
        """The log odds of the buckets; hits: texts by column, class and bucket, texts: those of either class."""
        whole = max(int(texts.sum()), 1)
        for hit in hits:
            # Smoothed toward the class shares: a word without evidence has odds 0.
            rate_of = [(h + 4.0 * share) / (share * whole) for h, share in zip(hit, np.maximum(texts / whole, 1e-9))]
            odds = np.log(rate_of[1] / rate_of[0])
            self.table[:, 0] += np.where(hit.sum(axis=0) >= 3, odds / 2, 0).astype(np.float32)

    def small(self) -> np.ndarray:
        """All that is learned but the table, in rows as wide as the table's."""
        flat = np.concatenate([p.ravel() for p in (*self.filters, *self.bias, self.out)] + [[self.shift]])
        return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)

    def move(self, rows: np.ndarray, change: np.ndarray) -> None:
        """Add a change to rows of the table or, from BUCKETS on, of small()."""
        table = rows < BUCKETS
        self.table[rows[table]] += change[table].astype(np.float32)
        rest = self.small()
        rest[rows[~table] - BUCKETS] += change[~table]
        flat, at = rest.ravel(), 0
        for p in (*self.filters, *self.bias, self.out):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.shift = np.float32(flat[at])

    def descend(self, texts: list[bytes], labels: np.ndarray, classes: tuple[float, float] = (1.0, 1.0), epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> TextCnn:
        """Follow the gradients; a text counts by its class."""
        parts = [(o, h) for _, _, _, o, h in scan(texts, NOT_LETTER)]
        if not parts:
            return self
        owner, hashes = (np.concatenate(x) for x in zip(*parts))
        one, two = buckets(hashes)
        who, starts, ends = runs(owner)
        y = labels[who].astype(np.float32)
        weight_of = np.asarray(classes, np.float32)[labels[who]]
        params = [*self.filters, *self.bias, self.out]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        rng, step = np.random.default_rng(seed), 0
        for _ in range(max(epochs, -(-120 * batch // len(who)))):  # 120 steps at least
            order = rng.permutation(len(who))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                size = ends[pick] - starts[pick]
                begin = np.cumsum(size) - size
                at = np.repeat(starts[pick] - begin, size) + np.arange(size.sum())
                a, b = one[at], two[at]
                x = self.table[a] + self.table[b]
                pooled, places = self.pool(x, begin, begin + size, where=True)
                p = 1 / (1 + np.exp(-np.clip(self.logits(pooled), -30, 30)))
                g = weight_of[pick] * (p - y[pick]) / len(pick)
                grads_out = np.maximum(pooled, 0).T @ g
                up = g[:, None] * self.out * (pooled > 0)
                grads_f, grads_b, gx = [], [], np.zeros_like(x)
                text = np.repeat(np.arange(len(pick)), size)
                for j, f in enumerate(self.filters):
                    u = up[:, j * FILTERS : (j + 1) * FILTERS]
                    gf = np.zeros_like(f)
                    for o in range(len(f)):
                        place = places[j] + o
                        fits = place < len(x)
                        fits &= text[np.minimum(place, len(x) - 1)] == np.arange(len(pick))[:, None]
                        rows, cols = np.nonzero(fits & (u != 0))
                        source, weight = place[rows, cols], u[rows, cols]
                        np.add.at(gf[o].T, cols, weight[:, None] * x[source])
                        np.add.at(gx, source, weight[:, None] * f[o][:, cols].T)
                    grads_f.append(gf)
                    grads_b.append(u.sum(axis=0))
                step += 1
                for param, grad, (m, v) in zip(params, [*grads_f, *grads_b, grads_out], state):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad**2 - v)
                    param -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
                self.shift -= np.float32(rate * 5 * g.sum())
                rows = np.flatnonzero(np.abs(gx).sum(axis=1))
                for column in (a, b):
                    np.add.at(self.table, column[rows], -2.0 * gx[rows])
        return self

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text; long texts pool over their chunks."""
        n = len(texts)
        best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        counts = np.zeros((n, len(LANGUAGES)), np.int64)
        for _, _, _, owner, hashes in scan(texts, NOT_LETTER):
            if not len(owner):
                continue
            one, two = buckets(hashes)
            who, starts, ends = runs(owner)
            pooled, _ = self.pool(self.table[one] + self.table[two], starts, ends)
            np.maximum.at(best, who, pooled)
            counts += guess(owner, hashes, n)
        language = np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), len(LANGUAGES))
        return self.logits(best), language

    def calibrate(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, least: int = 20) -> None:
        """The threshold with the best weighted F1, for each guessed language."""
        logits, language = self.score(texts)
        self.cut(logits, language, labels * weights, weights, labels, 1 - labels, least)

    def cut(self, logits: np.ndarray, language: np.ndarray, toxic: np.ndarray, whole: np.ndarray, ones: np.ndarray, others: np.ndarray, least: int = 20) -> None:
        """The thresholds; toxic and whole: weights of the toxic and of all texts with an answer, ones and others: their counts by class."""

        def best(pick):
            z, t, w = logits[pick], toxic[pick], whole[pick]
            order = np.argsort(-z, kind="stable")
            z, t, w = z[order], t[order], w[order]
            f1 = 2 * np.cumsum(t) / (np.cumsum(w) + t.sum())
            i = int(f1.argmax())
            return float(z[i] + z[i + 1]) / 2 if i + 1 < len(z) else float(z[i]) - 0.1

        self.thresholds[:] = best(slice(None)) if ones.any() else logits.max(initial=0.0) + 1
        for i in range(len(LANGUAGES)):
            pick = language == i
            if ones[pick].sum() >= least and others[pick].sum() >= least:
                self.thresholds[i] = best(pick)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        logits, language = self.score(texts)
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[language], -30, 30)))


def frequencies(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a word in each bucket, by column of the table and class, and the texts of either class that have words."""
    hits, sizes = np.zeros((2, 2, BUCKETS), np.int64), np.zeros(2, np.int64)
    parts = [(o, h) for _, _, _, o, h in scan(texts, NOT_LETTER)]
    if parts:
        owner, hashes = (np.concatenate(x) for x in zip(*parts))
        sizes += np.bincount(labels[np.unique(owner)], minlength=2)
        for hit, column in zip(hits, buckets(hashes)):
            key = np.unique(owner.astype(np.int64) * BUCKETS + column)
            hit += np.bincount(labels[key // BUCKETS] * BUCKETS + key % BUCKETS, minlength=2 * BUCKETS).reshape(2, -1)
    return hits, sizes


def _read(batch) -> tuple[list[bytes], np.ndarray]:
    return batch.column("text").to_pylist(), batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)


def _count(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """frequencies() of all rows."""

    def run(batches):
        whole = np.zeros(4 * BUCKETS + 2, np.int64)
        for batch in batches:
            hits, sizes = frequencies(*_read(batch))
            whole += np.concatenate([hits.ravel(), sizes])
        slots = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(whole[slots])], names=["slot", "n"])

    found = rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(4 * BUCKETS + 2, np.int64)
    whole[found["slot"].to_numpy()] = found["n"].to_numpy()
    return whole[:-2].reshape(2, 2, BUCKETS), whole[-2:]


def _descend(rows: DataFrame, model: TextCnn, sizes: np.ndarray) -> None:
    """Move the model by the mean of the changes that the shards make."""
    shards = -(-int(sizes.sum()) // SHARD)
    classes = tuple(float(sizes.sum()) / 2 / max(int(n), 1) for n in sizes)
    epochs = 4 if shards == 1 else 2

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("place", "ascending")])
        moved = copy.deepcopy(model).descend(*_read(shard), classes=classes, epochs=epochs)
        change = np.rint(np.concatenate([moved.table - model.table, moved.small() - model.small()]).astype(np.float64) * UNIT).astype(np.int64)
        # All shards count for what is not of the table.
        slots = np.flatnonzero(change.any(axis=1) | (np.arange(len(change)) >= BUCKETS))
        return pa.table({"slot": pa.array(slots.astype(np.int32))} | {f"d{i}": pa.array(change[slots, i]) for i in range(WIDTH)})

    fields = [f"d{i}" for i in range(WIDTH)]
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(shards, 1)))).withColumn("place", F.xxhash64("text"))
    made = placed.groupBy("shard").applyInArrow(run, "slot int, " + ", ".join(f"{f} long" for f in fields))
    found = made.groupBy("slot").agg(F.count("*").alias("n"), *(F.sum(f).alias(f) for f in fields)).toArrow()
    mean = np.stack([found[f].to_numpy() for f in fields], axis=1) / UNIT / found["n"].to_numpy()[:, None]
    model.move(found["slot"].to_numpy(), mean)


def _cut(rows: DataFrame, model: TextCnn) -> None:
    """Set the model's thresholds by the answers to all rows."""

    def run(batches):
        for batch in batches:
            texts, labels = _read(batch)
            logits, language = model.score(texts)
            step = np.floor(np.clip(logits, -30, 30) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(step), pa.array(labels)], names=["language", "step", "toxic"])

    told = rows.mapInArrow(run, "language int, step int, toxic long")
    found = told.groupBy("language", "step").agg(F.sum("toxic").alias("ones"), F.count("*").alias("n")).orderBy("language", "step").toArrow()
    if found.num_rows:
        language, step, ones, n = (found[c].to_numpy() for c in ("language", "step", "ones", "n"))
        model.cut((step + 0.5) / STEPS, language, ones, n, ones, n - ones)


def _among(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that may have one of the doc_ids: a bitmap of at most MOST_FILTER_BITS is sent to all tasks, so other texts are not moved."""
    bits = 1 << 15
    wanted = 16 * known.count()
    while bits < wanted and bits < MOST_FILTER_BITS:
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = known.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(one) != 0).select("doc_id", "text")


def train(documents: DataFrame, labels: DataFrame) -> TextCnn | None:
    """Fit on all of the labelled rows given; without rows of both classes there is no model."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    text = F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text")
    labelled = _among(documents.select("doc_id", "text"), known).join(known.hint("shuffle_hash"), "doc_id")
    rows = written(labelled.select(F.col("doc_id").cast("long"), F.col("toxic").cast("long"), text), "toxicity-rows")
    path = written_paths()[-1]
    # A quarter sets the thresholds.
    kept = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    fitted = rows.filter(~kept)
    hits, sizes = _count(fitted)
    model = None
    if sizes.all():
        model = TextCnn()
        model.learn(hits, sizes)
        _descend(fitted, model, sizes)
        _cut(rows.filter(kept), model)
    discard(path)
    return model


def score(documents: DataFrame, model: TextCnn | None) -> DataFrame:
    """documents (doc_id, text, held_out) -> doc_id, held_out, score, predicted."""
    if model is None:
        return documents.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def run(batches):
        for batch in batches:
            p = model.probabilities(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.lower("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: labels are learned from rows that are not held out."""
    model = train(documents.filter(~held_out()), labels.filter(~held_out()))
    return score(documents.select("doc_id", "text", held_out().alias("held_out")), model)
