"""Periodic runs of words: longest common extensions from a difference cover, on a harmonic grid.

A run is a stretch of words with smallest period q, at least ``max(LEAST, REPEATS * q)`` words long, that no neighbouring
word extends with that period. All runs of a document are found, and documents are collapsed by dropping of each run all
words after its first q.

* **Grid.** A run of period p has words p apart equal over a stretch of at least three times p places, so it holds three
  multiples of p in a row at which the next p-th word is equal. Only such places are looked at: n/p for each p, or
  n log n in all. The run's end is one longest common extension to the right, its start is found by bisecting the p
  places before with further ones. A multiple of the smallest period gives the same stretch; the smallest is kept.
* **Extensions.** Of all suffixes, only those at places in a difference cover modulo t are sorted, by their first t words
  and then by doubling. Any two places reach sampled ones together within t words; these words are compared one by one,
  and what follows is the least of the neighbours' common prefixes between the two ranks, from a sparse table. Documents
  with no place to look at are not sorted at all.

Rows are independent. Null and empty texts have no words, no runs and the digests of the empty text; repeated rows give
equal results; an empty table gives no rows; of runs with equal exponents the first start, then the shortest period is
named. Columns but id and text are not read. A document is worked on as a whole, in about 500 bytes a word at most.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import slices, split_words, text

LEAST, REPEATS = 6, 4
#: Perfect difference sets by modulus; every residue is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Grid places that are looked at together.
PLACES = 1 << 21


def cover_for(words: int) -> int:
    """The modulus: the more words, the fewer of their suffixes are sampled."""
    return 7 if words < 1 << 19 else 13 if words < 1 << 21 else 31 if words < 1 << 23 else 57


class Extensions:
    """Longest common extensions of places of one document, for documents that lie one after another in ``words``.

    ``words`` are numbers from 0; each document ends with a number that occurs nowhere else. ``document`` has the number
    of the document of every place.
    """

    def __init__(self, words: np.ndarray, document: np.ndarray, modulus: int | None = None):
        self.modulus = t = modulus or cover_for(len(words))
        cover = np.array(COVERS[t])
        self.words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * t)])
        member = np.zeros(t, bool)
        member[cover] = True
        residue = np.arange(t)
        both = member[(residue[:, None, None] + residue) % t] & member[(residue[None, :, None] + residue) % t]
        self.shift = both.argmax(axis=2)  # of two residues: how far to where both are sampled
        self.places = np.flatnonzero(member[np.arange(len(words)) % t])
        self.number = np.zeros(len(words) + 1, np.int64)  # place -> number of the sample
        self.number[self.places] = np.arange(len(self.places))
        order, ranks = self._sort(document)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        common = self._neighbours(self.places[order], ranks)
        largest = int(np.bincount(document[self.places]).max(initial=1)) if len(self.places) else 1
        self.table = [common]
        while 2 << (len(self.table) - 1) < largest:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            wider = last.copy()
            np.minimum(last[:-half], last[half:], out=wider[: len(last) - half])
            self.table.append(wider)
        self.table = np.stack(self.table)

    def _sort(self, document: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Order of the samples, by document and then by suffix; and their ranks by the first t, 2t, 4t, ... words."""
        t, at = self.modulus, self.places
        keys, room = [document[at].astype(np.int64)], 63 - int(document[-1] if len(document) else 0).bit_length()
        bits = int(self.words[-1]).bit_length()
        for k in range(t):
            if room < bits:
                keys.append(np.zeros(len(at), np.int64))
                room = 63
            keys[-1] = keys[-1] << bits | self.words[at + k]
            room -= bits
        order = np.lexsort(keys[::-1])
        first = np.ones(len(order), bool)
        if len(order):
            first[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = head
        ranks, step = [rank], t
        while True:
            last = np.append(first[1:], True)
            open_ = np.flatnonzero(~(first & last))  # places in the order whose rank several samples share
            if not len(open_):
                return order, ranks
            some = order[open_]
            behind = rank[self.number[at[some] + step]]
            inner = np.lexsort([behind, head[open_]])
            order[open_] = some[inner]
            behind = behind[inner]
            first = first.copy()
            first[open_[1:]] |= (behind[1:] != behind[:-1]) | (open_[1:] != open_[:-1] + 1)
            head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            rank = np.empty(len(order), np.int64)
            rank[order] = head
            ranks.append(rank)
            step *= 2

    def _neighbours(self, at: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Words that each sample's suffix has in common with the next one's in their order; 0 for the last."""
        a, b = at[:-1], at[1:]
        common = np.zeros(max(len(at), 1), np.int64)
        long = np.flatnonzero(ranks[0][self.number[a]] == ranks[0][self.number[b]])
        done = np.zeros(len(long), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            x, y = self.number[a[long] + done], self.number[b[long] + done]
            done += np.where(ranks[level][x] == ranks[level][y], self.modulus << level, 0)
        common[long] = done
        some = np.arange(len(a))
        for _ in range(self.modulus):
            some = some[self.words[a[some] + common[some]] == self.words[b[some] + common[some]]]
            common[some] += 1
        return common

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on; pairs of different places of one document."""
        far = self.shift[a % self.modulus, b % self.modulus]
        out, some = far.copy(), np.arange(len(a))
        for k in range(int(far.max(initial=0))):
            some = some[far[some] > k]
            equal = self.words[a[some] + k] == self.words[b[some] + k]
            out[some[~equal]] = k
            some = some[equal]
        some = np.flatnonzero(out == far)
        x, y = self.rank[self.number[a[some] + far[some]]], self.rank[self.number[b[some] + far[some]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out[some] += np.minimum(self.table[level, low], self.table[level, high - (1 << level.astype(np.int64))])
        return out


def grid(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) where a run may hold the place, a multiple of the period from the document's start."""
    periods = lengths // REPEATS
    document = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(document)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    times = (lengths[document] - 1) // period - 2
    ends = np.cumsum(times)
    at = 0
    while at < len(period):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
        n = times[at:to]
        step = np.repeat(period[at:to], n)
        within = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(starts[document[at:to]], n) + within * step
        kept = np.flatnonzero(words[place] == words[place + step])
        for further in (1, 2):
            p, s = place[kept], step[kept]
            kept = kept[words[p + further * s] == words[p + (further + 1) * s]]
        yield np.repeat(document[at:to], n)[kept], place[kept], step[kept]
        at = to


def _starts(extend: Extensions, place: np.ndarray, period: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The first of at most ``period`` places up to ``place`` from which the words on to ``place`` recur after ``period``."""
    low, high = np.maximum(begin, place - period + 1), place.copy()
    while len(some := np.flatnonzero(low < high)):
        middle = (low[some] + high[some]) // 2
        reaches = extend(middle, middle + period[some]) >= place[some] - middle
        high[some[reaches]] = middle[reaches]
        low[some[~reaches]] = middle[~reaches] + 1
    return low


def find_runs(words: np.ndarray, lengths: np.ndarray, modulus: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs (document, start, length, period) by document, start and period of documents one after another in ``words``."""
    words, lengths = np.asarray(words, np.int64), np.asarray(lengths, np.int64)
    starts = np.cumsum(lengths) - lengths
    found = list(grid(words, starts, lengths))
    document, place, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if not len(document):
        return document, place, place, period
    # the documents that have such places, each followed by a number of its own
    some, document = np.unique(document, return_inverse=True)
    sizes = lengths[some] + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(some)), sizes)
    within = np.arange(len(owner)) - begins[owner]
    last = within == lengths[some][owner]
    packed = np.where(last, words.max() + 1 + owner, words[np.minimum(starts[some][owner] + within, len(words) - 1)])
    extend = Extensions(packed, owner, modulus)
    place = place - starts[some][document] + begins[document]
    reach = extend(place, place + period)
    kept = reach > 2 * period
    document, place, period, end = document[kept], place[kept], period[kept], (place + reach)[kept]
    order = np.lexsort([place, end, period])
    p, e = period[order], end[order]
    order = order[np.concatenate([[True], (p[1:] != p[:-1]) | (e[1:] != e[:-1])])[: len(order)]]
    document, place, period, end = document[order], place[order], period[order], end[order]
    start = _starts(extend, place, period, begins[document])
    end = end + period
    kept = end - start >= np.maximum(LEAST, REPEATS * period)
    document, start, end, period = document[kept], start[kept], end[kept], period[kept]
    order = np.lexsort([period, end, start])
    s, e = start[order], end[order]
    order = order[np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(order)]]
    order = order[np.lexsort([period[order], start[order]])]
    return some[document[order]], start[order] - begins[document[order]], (end - start)[order], period[order]


def repeat_tail(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The contract's test of periods: by the digest of the id, the end of one text in ten repeats a stretch of it.

    Texts without id stay as they are.
    """
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _best(start: list[int], length: list[int], period: list[int]) -> tuple[int, int, int, int]:
    """The run of the greatest length/period; of equal ones the first, as runs come by start and period."""
    k = 0
    for i in range(1, len(start)):
        if length[i] * period[k] > length[k] * period[i]:
            k = i
    return start[k], length[k], period[k], 1000 * length[k] // period[k]


def collapse(docs: DataFrame, edit: Callable[[int | None, np.ndarray], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "digest") -> DataFrame:
    """Runs of every document, and its text without what they repeat.

    doc_id, n_runs, and start, length, period and exponent_milli of the run with the greatest exponent; then digests of
    all runs and of the collapsed text (``out="digest"``), or ``runs`` (an array of start, length, period) and
    ``collapsed`` themselves (``out="text"``). ``edit`` may change the words of a document before, given as numbers.
    """
    whole = out == "text"
    last = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if whole else "runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            distinct, words, borders = split_words(batch.column(1))
            names = distinct.to_pylist()
            empty = np.array([not name for name in names] + [False])
            kept = ~empty[words]
            lengths = np.add.reduceat(np.append(kept, False), borders[:-1]) * (borders[1:] > borders[:-1]) if batch.num_rows else np.zeros(0, np.int64)
            words = words[kept].astype(np.int64)
            ids = batch.column(0).to_pylist()
            ends = np.cumsum(lengths)
            if edit:
                words = np.concatenate([np.zeros(0, np.int64), *(edit(ids[k], words[ends[k] - lengths[k] : ends[k]]) for k in range(len(ids)))])
            document, start, length, period = find_runs(words, lengths)
            change = np.zeros(len(words) + 1, np.int64)
            base = (ends - lengths)[document]
            np.add.at(change, base + start + period, 1)
            np.add.at(change, base + start + length, -1)
            stays = np.cumsum(change)[:-1] == 0
            first = np.searchsorted(document, np.arange(len(ids) + 1))
            columns = [[], [], [], [], [], [], []]
            start, length, period, numbers = start.tolist(), length.tolist(), period.tolist(), np.array(names, object)
            for k in range(len(ids)):
                a, b = first[k], first[k + 1]
                some = slice(ends[k] - lengths[k], ends[k])
                runs = list(zip(start[a:b], length[a:b], period[a:b], strict=True))
                left = " ".join(numbers[words[some][stays[some]]])
                best = _best(start[a:b], length[a:b], period[a:b]) if runs else (None,) * 4
                if whole:
                    ends_with = ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left)
                else:
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    ends_with = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
                for column, value in zip(columns, (b - a, *best, *ends_with), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + ([pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()] if whole else [pa.string()] * 2)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *(("runs", "collapsed") if whole else ("runs_sha256", "collapsed_sha256"))])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, {last}")
