"""Context-triggered piecewise hashing: fingerprints that stay alike where texts are alike.

A rolling hash of the last eight bytes ends a chunk wherever its low ``k`` bits are zero, so borders depend on the text
near them and not on places. Each chunk becomes one letter. The block size 2^k is the largest that is at most a 32nd of
the length; texts that repeat themselves take a larger one if there are over 256 borders, or a smaller one if there are
under 12. The fingerprint holds the letters for that block size, its double and its fourfold:
``k:letters of k:letters of k + 1:letters of k + 2``. Fingerprints are compared at the block sizes that both hold; their
likeness is the best of these. That of two signatures is 1 - d / (sum of lengths), where d is the edit distance with
insertions and deletions of the letters, runs of one letter cut to three; without a common run of four letters (or of
all letters, if one has fewer) it is 0. Equal fingerprints have likeness 1.

Null texts count as empty; the empty text has the fingerprint ``0:::``. Texts are read whole. Documents follow each other
by ascending id, null ids first, and repeated ids by text; the last is followed by the first, and a single document by
itself. Columns but id and text are not read.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stocklens.llm.common import in_order, slices, text, written

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SHARE, MOST, LEAST, SIZES, RUN = 32, 256, 12, 3, 4
REPEATED = re.compile(r"(.)\1{3,}")
_TABLE = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)  # any fixed numbers do
_FACTOR = 0x9E3779B1


def rolling(data: bytes) -> np.ndarray:
    """A hash of the eight bytes up to each place (fewer at the start), by doubling the window three times."""
    h = _TABLE[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4):
        factor = np.uint32(pow(_FACTOR, step, 1 << 32))
        longer = h.copy()
        longer[step:] += h[:-step] * factor
        h = longer
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _letters(h: np.ndarray, borders: np.ndarray) -> str:
    """One letter for each chunk; a chunk ends with a border, the last one with the text."""
    starts = np.concatenate([[0], borders + 1])
    starts = starts[starts < len(h)]
    sums = np.add.reduceat(h, starts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return LETTERS[(sums >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    if not data:
        return "0:::"
    h = rolling(data)
    k = max(0, (len(data) // SHARE).bit_length() - 1)
    while k and len(np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)) < LEAST:
        k -= 1
    places = np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)
    while len(places) > MOST and k < 32:
        k += 1
        places = places[h[places] & np.uint32((1 << k) - 1) == 0]
    signatures = []
    for size in range(k, k + SIZES):
        places = places[h[places] & np.uint32((1 << min(32, size)) - 1) == 0]
        signatures.append(_letters(h, places))
    return f"{k}:{':'.join(signatures)}"


def _padded(signatures: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in signatures])
    out = np.full((len(signatures), max(lengths.max(initial=0), RUN)), fill, np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(signatures).encode(), np.uint8)
    return out, lengths


def likeness_of(a: list[str], b: list[str], at_once: int = 200) -> np.ndarray:
    """Likeness of signatures, pair by pair: all pairs' edit distances advance together, row by row."""
    out = np.zeros(len(a))
    if not a:
        return out
    a, b = ([REPEATED.sub(r"\1\1\1", s) for s in side] for side in (a, b))
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], kind="stable")
    for k in range(0, len(a), at_once):  # pairs of like lengths together
        some = order[k : k + at_once].tolist()
        out[some] = _together([a[i] for i in some], [b[i] for i in some])
    return out


def _together(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    (left, n_left), (right, n_right) = _padded(a, 254), _padded(b, 255)
    same = left[:, :, None] == right[:, None, :]
    common = same[:, : 1 - RUN, : 1 - RUN].copy()
    for k in range(1, RUN):
        common &= same[:, k : k + common.shape[1], k : k + common.shape[2]]
    related = common.any(axis=(1, 2))
    for k in np.flatnonzero(np.minimum(n_left, n_right) < RUN).tolist():
        related[k] = bool(a[k] and b[k]) and (a[k] in b[k] or b[k] in a[k])
    chosen = np.flatnonzero(related)
    if not len(chosen):
        return out
    same, n_left, n_right = same[chosen], n_left[chosen], n_right[chosen]
    along = np.arange(same.shape[2] + 1, dtype=np.int16)
    row = np.broadcast_to(along, (len(chosen), len(along)))
    distance = np.zeros(len(chosen), np.int16)
    for i in range(1, same.shape[1] + 1):
        now = np.empty_like(row, shape=row.shape)
        now[:, 0] = i
        now[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + np.where(same[:, i - 1], 0, 2))
        row = np.minimum.accumulate(now - along, axis=1) + along
        ends = np.flatnonzero(n_left == i)
        distance[ends] = row[ends, n_right[ends]]
    out[chosen] = 1 - distance / (n_left + n_right)
    return out


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair: the best over the block sizes that both have."""
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    at, left, right = [], [], []
    for k in np.flatnonzero(out == 0).tolist():
        (size_a, *both_a), (size_b, *both_b) = a[k].split(":"), b[k].split(":")
        shift = int(size_a) - int(size_b)
        for x, y in zip(both_a[max(0, -shift) :], both_b[max(0, shift) :], strict=False):
            at.append(k)
            left.append(x)
            right.append(y)
    np.maximum.at(out, at, likeness_of(left, right)) if at else None
    return out


def edit(whole: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of the following text."""
    half = len(whole) // 2
    return whole[: len(whole) - half] + following[:half]


COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list[int | None], texts: list[str], prints: list[str]) -> list[pa.Array]:
    """Columns of the result for documents that are followed by one more, the last of the lists."""
    edited = [edit(t, n).encode() for t, n in zip(texts, texts[1:], strict=False)]
    edited_prints = [fingerprint(e) for e in edited]
    own = prints[:-1]
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array(own, pa.string()),
        pa.array(edited_prints, pa.string()),
        pa.array(likeness(own, edited_prints)),
        pa.array(likeness(own, prints[1:])),
    ]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every document, without any exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edited texts, with the likeness to the edited text and to the next document.

    Documents are dealt by ranges of ids and texts, once. Each range leaves its first and last text; a second step compares every
    last text with the first of the next range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [*(c.split()[0] for c in COLUMNS.split(", ")), "part", "first", "text"]

        def edge(key: int | None, whole: str, first: bool) -> pa.RecordBatch:
            none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            rest = [pa.array([part], pa.int32()), pa.array([first]), pa.array([whole], pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *none, *rest], names=names)

        ids, texts, prints = [], [], []
        for batch in slices(batches):
            some = batch.column(1).to_pylist()
            if not ids and len(some):
                yield edge(batch.column(0)[0].as_py(), some[0], True)
            ids, texts = ids + batch.column(0).to_pylist(), texts + some
            prints = prints + [fingerprint(t.encode()) for t in some]
            if len(ids) > 1:
                n = len(ids) - 1
                none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.bool_(), pa.string())]
                yield pa.RecordBatch.from_arrays([*_compared(ids, texts, prints), *none], names=names)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if ids:
            yield edge(ids[0], texts[0], False)

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for key, whole, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prints = [fingerprint(whole.encode()), fingerprint(following.encode())]
                yield pa.RecordBatch.from_arrays(_compared([key, None], [whole, following], prints), names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    found = written(in_order(rows).mapInArrow(run, f"{COLUMNS}, part int, first boolean, text string"), "compared")
    firsts = found.filter("first").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")  # one row of numbers per range
    after = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    lasts = found.filter("not first").select("doc_id", "text", "part").join(after, "part")
    edges = lasts.join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")
    return found.filter("part is null").drop("part", "first", "text").unionByName(edges.mapInArrow(join_edges, COLUMNS))
