"""BPE encoding and decoding through tables of distinct words.

1. Split: texts are cut into the tokenizer's words (pre-tokens) by vectorised
   character classes that are asked of the tokenizer itself; texts with special
   tokens or characters beyond the basic plane are cut by the tokenizer.
2. Distinct words: a task keeps a table of the distinct words of its documents;
   each is encoded once, when it is first met.  The table is emptied beyond
   TABLE words, which bounds memory and changes no result.  Texts are taken from
   a batch in portions of about PORTION bytes, and a task gives its memory back
   when it starts and ends, since workers go on from task to task.
3. Join back by position: a text is a sequence of row numbers of the table, and
   its ids are the rows' ids in that order.
4. Decode: the ids of each row are joined to the pieces of the vocabulary (the
   id-to-piece table, 50,257 rows, small by definition), and a text is the
   sequence of its rows' pieces.

The table belongs to a task, not to the corpus: a corpus-wide table that is
shuffled by word and joined back to blocks of documents was built and measured
first; the README has its figures.  There is no shuffle, so no key is hot and a
lost executor costs its own tasks only.

Nulls: a null text is empty and has no ids; a null doc_id is carried.  Repeated
rows are encoded each.  An empty table gives an empty result.  Words are told
apart by their bytes; the hash only groups them.  A very long text is cut at no
place, a word of it may be as long as the text.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import release_memory
from quiver.llm.words import same_bytes, word_hashes

LETTER, NUMBER, OTHER, WHITE, EDGE = 0, 1, 2, 3, 4
#: Words of a table (about 500 bytes each), characters that are cut at once, and bytes of texts that are read at once.
TABLE = 1 << 16
CHUNK = 1 << 18
PORTION = 1 << 20


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def character_classes(tokenizer) -> np.ndarray:
    """The class of each basic-plane character, as the pre-tokenizer treats it."""
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    classes = np.full(0x10000, WHITE, np.int8)
    for kind, like in ((LETTER, "b"), (NUMBER, "1"), (OTHER, "!")):
        text = "".join(f"{like}{chr(c)}{like}\n" for c in codes)
        starts = np.zeros(len(text) + 1, bool)
        starts[[s for _, (s, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
        joined = ~starts[1::4][: len(codes)] & ~starts[2::4][: len(codes)]
        classes[np.asarray(codes)[joined]] = kind
    return classes


def word_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of the words of texts of basic-plane characters; EDGE parts texts."""
    n = len(codes)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    white = kind == WHITE
    # White space before a word: its last character stands apart, and joins the word if it is a space.
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kind[1:] != EDGE))
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    # Contractions: an apostrophe that starts a word, then s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((codes[:-1] == 0x27) & start[: n - 1] & (kind[1:] == LETTER))
    if len(quote):
        padded = np.concatenate([codes, [0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            end = at + size
            start[end] = True
    return np.flatnonzero(start[:n])


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable Latin-1 characters stand for themselves, the
    other bytes in order for the characters from 256 on."""
    from tokenizers import pre_tokenizers

    known = set(pre_tokenizers.ByteLevel.alphabet())
    plain = [b for b in range(256) if chr(b) in known]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabulary:
    """What a task needs of a tokenizer: classes, special tokens and pieces."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.text = text
        # Its pre-tokenizer is all that a task needs of it.
        self.bare = json.dumps(json.loads(text) | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})
        tokenizer = Tokenizer.from_str(text)
        self.classes = character_classes(tokenizer)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        byte, vocabulary = byte_alphabet(), tokenizer.get_vocab()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = token.encode() if token in self.special else bytes(byte[c] for c in token)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "text"}

    def splitter(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.bare).pre_tokenizer

    def encoder(self):
        """Encodes one word: ids are ranks of the merges, as they are in this vocabulary."""
        import tiktoken

        special = set(self.special.values())
        ranks = {p: i for i, p in enumerate(self.pieces) if i not in special}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def special_parts(self, text: str):
        """(part, is special): added tokens are taken out first, as the tokenizer does."""
        parts = [(text, False)]
        for token in self.special:
            cut = []
            for part, special in parts:
                if special:
                    cut.append((part, True))
                    continue
                for i, piece in enumerate(part.split(token)):
                    cut += ([(token, True)] if i else []) + ([(piece, False)] if piece else [])
            parts = cut
        return parts


class WordTable:
    """A task's distinct words with their ids; texts become sequences of its rows."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pre, self.encode = vocabulary, vocabulary.splitter(), vocabulary.encoder()
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.ids: list[list[int]] = []
        self.size: list[int] = []
        self.decimal: list[str] = []
        self.decoded: list[bytes] = []

    def _add(self, ids: list[int]) -> int:
        pieces = self.vocabulary.pieces
        self.ids.append(ids)
        self.size.append(len(ids))
        self.decimal.append("," + ",".join(map(str, ids)))
        self.decoded.append(b"".join([pieces[i] for i in ids]))
        return len(self.ids) - 1

    def rows_of(self, words: list[str]) -> list[int]:
        """Rows of words that are given as strings (the slow path)."""
        out = []
        for word in words:
            special = self.vocabulary.special.get(word)
            key = word.encode() if special is None else word  # a special token is no word
            row = self.row.get(key)
            if row is None:
                row = self.row[key] = self._add([special] if special is not None else self.encode(word))
            out.append(row)
        return out

    def slow(self, text: str) -> list[int]:
        words = []
        for part, special in self.vocabulary.special_parts(text):
            words += [part] if special else [part[s:e] for _, (s, e) in self.pre.pre_tokenize_str(part)]
        return self.rows_of(words)

    def fast(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of texts of basic-plane characters, all at once."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.vocabulary.classes[codes]
        ends = np.cumsum([len(t) + 1 for t in texts])
        kind[ends[:-1] - 1] = EDGE  # the newlines that part the texts
        starts = word_starts(codes, kind)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800)
        offsets = np.concatenate([[0], np.cumsum(width)])
        begin, end = offsets[starts], offsets[np.concatenate([starts[1:], [len(codes)]])]
        inside = kind[starts] != EDGE
        owner = np.searchsorted(ends, starts, side="right")[inside]
        begin, end = begin[inside], end[inside]
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        _, first, inverse = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        row, get = np.empty(len(first), np.int64), self.row.get
        words = [raw[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist())]
        for i, word in enumerate(words):
            found = get(word)
            if found is None:
                found = self.row[word] = self._add(self.encode(word.decode()))
            row[i] = found
        rows = row[inverse]
        # The bytes of every word are compared: another word with the same hash is looked up by itself.
        for i in np.flatnonzero(~same_bytes(data, begin, end, first[inverse])).tolist():
            rows[i] = self.rows_of([raw[begin[i] : end[i]].decode()])[0]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode_texts(self, texts: list[str]):
        """(position, rows) of each text."""
        held, size = [], 0

        def ready():
            nonlocal held, size
            found = self.fast([texts[i] for i in held])
            done = list(zip(held, found))
            held, size = [], 0
            return done

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(self.ids) > TABLE:
                if held:
                    yield from ready()
                self.clear()
            if any(token in text for token in self.vocabulary.special) or max(text) > "\uffff":
                yield i, np.asarray(self.slow(text), np.int64)
                continue
            held.append(i)
            size += len(text)
            if size >= CHUNK:
                yield from ready()
        if held:
            yield from ready()


def portions(texts: pa.Array) -> list[tuple[int, int]]:
    """(first, end) of runs of rows of about PORTION bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(sizes // PORTION)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)]))


def encode(documents: DataFrame, tokenizer: str, outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row (and ids, decoded).

    tokenizer: the tokenizer's JSON text.
    """
    vocabulary = Vocabulary(tokenizer)
    empty = hashlib.sha256(b"").hexdigest()

    def texts_of(column):
        return [t and t.decode("utf-8", "replace") for t in column.to_pylist()]

    def encoded(table, ids_of, texts):
        n, digest, back = [0] * len(texts), [empty] * len(texts), [empty] * len(texts)
        ids: list = [[] for _ in texts]
        decoded = [""] * len(texts)
        for i, rows in table.encode_texts(texts):
            at = rows.tolist()
            n[i] = sum([table.size[r] for r in at])
            digest[i] = hashlib.sha256("".join([table.decimal[r] for r in at])[1:].encode()).hexdigest()
            text = b"".join([table.decoded[r] for r in at])
            back[i] = hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()
            if outputs:
                ids[i], decoded[i] = list(chain.from_iterable(table.ids[r] for r in at)), text.decode("utf-8", "replace")
        columns = [ids_of, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if outputs:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        release_memory()
        table = WordTable(vocabulary)
        for batch in batches:
            for first, end in portions(batch.column(1)):
                yield encoded(table, batch.column(0).slice(first, end - first), texts_of(batch.column(1).slice(first, end - first)))
        table.clear()
        release_memory()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) -> doc_id, decoded: each id joined to its piece."""
    piece = Vocabulary(tokenizer).pieces

    def run(batches):
        for batch in batches:
            texts = [b"".join([piece[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")
