"""BPE encoding and decoding with a published byte-level vocabulary.

Encoding needs no merge queue. The longest vocabulary entry at each place of a word comes from an Aho-Corasick automaton;
a token is appended if the merges would leave it and its left neighbour apart, which the pair table answers; if not, the
next shorter token is tried, and when none is left the last token is taken back. Every (place, dead end) is visited at
most once, so the work is linear in the word, and the result is exactly that of applying the merges by rank.

Decoding looks tokens up in one blob of bytes by an offset table.

Null texts count as empty and give no token. Texts of any length are encoded whole. Rows are independent, so repeated
rows give equal results, and only the named columns are read: other columns, whatever their names, are not carried along.
"""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import Memo, gather, slices, text

#: Fixed value: the published pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text of ASCII characters, on character sets that match much faster.
SPLIT_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable bytes are themselves, the others follow from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Tokens in merge order ("ranks": the 256 bytes first), their ids, halves and the pairs that merge into one.

    Its size is that of the vocabulary file, tens of thousands of entries, whatever the input; it is sent to the tasks.
    """

    path: str
    words: list[bytes]
    ids: list[int]
    halves: list[tuple[int, int]]
    merged: dict[tuple[int, int], int]
    reachable: list[bool]
    added: dict[str, int]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a ``tokenizers`` file of a byte-level BPE model without normalizer."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], byte_letters()
        if model["type"] != "BPE" or data["normalizer"] or data["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary")
        spell = sorted(letters, key=letters.get)
        words, ids, halves = [bytes([b]) for b in range(256)], [model["vocab"][c] for c in spell], [(b, b) for b in range(256)]
        rank, merged = {c: letters[c] for c in spell}, {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            joint = left + right
            if joint not in rank:
                rank[joint] = len(words)
                words.append(words[rank[left]] + words[rank[right]])
                ids.append(model["vocab"][joint])
                halves.append((rank[left], rank[right]))
                merged[rank[left], rank[right]] = rank[joint]
        vocabulary = cls(path, words, ids, halves, merged, [True] * len(words), {t["content"]: t["id"] for t in data["added_tokens"]})
        vocabulary.reachable = [vocabulary.stays_apart(*halves[r], below=r) if r >= 256 else True for r in range(len(words))]
        return vocabulary

    def stays_apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging never joins across the border of two neighbouring tokens (before the merge of rank ``below``).

        Undo the merges on both sides of the border, latest first; at each moment the two tokens that touch must not
        have a merge that comes before the merge which was undone last.
        """
        limit = len(self.words) if below is None else below
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit, left, last = left, self.halves[left][1], left
                if left == last:  # a single byte: the other side goes on
                    limit, right, last = right + 1, self.halves[right][0], right
                    if right == last:
                        return True
            else:
                limit, right, last = right + 1, self.halves[right][0], right
                if right == last:
                    limit, left, last = left, self.halves[left][1], left
                    if left == last:
                        return True


class Encoder:
    """Encodes texts of one task; everything it keeps is bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lengths = [len(w) for w in vocabulary.words]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        rank = {w: r for r, w in enumerate(vocabulary.words) if vocabulary.reachable[r]}
        for word, r in rank.items():
            self.automaton.add_word(word.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.shorter = [next((rank[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in rank), -1) for w in vocabulary.words]
        self.packed = [np.uint32(i).tobytes() for i in vocabulary.ids]
        self.apart = Memo(lambda pair: vocabulary.stays_apart(*pair), 120_000)
        self.pieces = Memo(self.encode_piece, 150_000)
        self.pattern, self.ascii = regex.compile(SPLIT), regex.compile(SPLIT_ASCII)
        self.added = {s: np.uint32(i).tobytes() for s, i in vocabulary.added.items() if s}
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None

    def ranks(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        size, lengths, shorter, apart = len(data), self.lengths, self.shorter, self.apart
        longest = [0] * size
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank  # ends ascend, so the longest comes last
        tokens: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < size:
            if at + lengths[token] not in dead and (not tokens or apart[tokens[-1], token]):
                tokens.append(token)
                at += lengths[token]
                token = longest[at] if at < size else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = tokens.pop()
                at -= lengths[token]
        return tokens

    def encode_piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[r] for r in self.ranks(piece.encode())])

    def split(self, part: str) -> list[str]:
        return (self.ascii if part.isascii() else self.pattern).findall(part)

    def encode(self, whole: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not self.marks or not self.marks.search(whole):
            return b"".join(map(self.pieces.__getitem__, self.split(whole)))
        borders = [(m.start(), m.end()) for m in self.marks.finditer(whole)]
        parts = [whole[a[1] : b[0]] for a, b in pairwise([(0, 0), *borders, (len(whole), 0)])]
        plain = (b"".join(map(self.pieces.__getitem__, self.split(p))) for p in parts)
        marks = [self.added[whole[a:b]] for a, b in borders] + [b""]
        return b"".join(chain.from_iterable(zip(plain, marks, strict=True)))


class Decoder:
    """All tokens' bytes in one blob; token i is ``blob[offsets[i] : offsets[i + 1]]``."""

    def __init__(self, vocabulary: Vocabulary):
        by_id = dict(zip(vocabulary.ids, vocabulary.words, strict=True)) | {i: s.encode() for s, i in vocabulary.added.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, packed: bytes) -> str:
        """The text; bytes that are no UTF-8 become replacement marks, unknown ids nothing."""
        ids = np.frombuffer(packed, "<u4")
        data, _ = gather(self.offsets, self.blob, ids[ids < len(self.offsets) - 1].astype(np.int64))
        return data.tobytes().decode("utf-8", "replace")


_built: dict = {}


def once(kind: type, sent: Broadcast):
    """One encoder or decoder for each worker process and vocabulary, not for each task."""
    key = kind, sent.value.path
    if key not in _built:
        _built[key] = kind(sent.value)
    return _built[key]


def encoded(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, ids)."""
    encoder = once(Encoder, sent)
    for batch in slices(batches):
        packed = pa.array(map(encoder.encode, batch.column(1).to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["key", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, ids) to (key, ids, text)."""
    decoder = once(Decoder, sent)
    for batch in slices(batches):
        texts = pa.array(map(decoder.decode, batch.column(1).to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["key", "ids", "text"])


def _broadcast(df: DataFrame, path: str) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))


def _keyed(rows: DataFrame, function: Callable, columns: str, id_col: str) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(function, f"key {kind}, {columns}").withColumnRenamed("key", id_col)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``ids``, the token ids packed as little-endian unsigned 32-bit integers."""
    sent = _broadcast(docs, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("key"), text(text_col).alias("text"))
    return _keyed(rows, lambda batches: encoded(batches, sent), "ids binary", id_col)


def decode(tokens: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: ``id_col``, ``ids`` and ``text``. Null ids give the empty text."""
    sent = _broadcast(tokens, vocabulary_path)
    rows = tokens.select(F.col(id_col).alias("key"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _keyed(rows, lambda batches: decoded(batches, sent), "ids binary, text string", id_col)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass over the rows: ``id_col``, ``ids`` and the decoded ``text``."""
    sent = _broadcast(docs, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("key"), text(text_col).alias("text"))
    return _keyed(rows, lambda batches: decoded(encoded(batches, sent), sent), "ids binary, text string", id_col)


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Digests of ids and decoded text of every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs, vocabulary_path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
