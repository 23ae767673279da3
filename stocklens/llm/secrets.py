"""Secret scans: fixed patterns and character Markov models.

Three patterns find secrets of known shape. Any other long run of key-like characters, or what the patterns leave of one,
is judged by two character Markov models, one of random strings and one of ordinary identifiers: it is a secret if the log-likelihood ratio of the two is
high enough, in sum and for each character. Both models are trained from fixed labelled strings, drawn at random over the
usual alphabets or put together from the parts below, and from all documents: words that no pattern matches (ordinary)
and the values that patterns match (random). Pairs of characters are summed up by Spark.

Null texts count as empty and have no span. Texts are scanned whole; spans are code points, the end exclusive. Rows are
independent, so repeated rows give equal results; an empty table gives no rows, and of equal starts the kind listed first
comes first. UUIDs name things and open nothing, so they are cut out as well and give no span. Columns but id and text are not read, and ``redact`` keeps them all.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import slices, text

KINDS = ("assign", "access", "hex", "random")
#: The patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
LEAST = 20
#: Fixed format of identifiers that name and do not open anything; they are no candidates.
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words that identifiers are put together from.
PARTS = """account action active admin amount application async available balance batch begin block boolean buffer build
cache call cancel change check child clear client close collection color column commit config connect context
control copy create current customer date debug default description device directory double element email entry
error event expected export factory field file filter first float folder frame function global handler header
height history identifier image index info initial insert instance integer internal invoice item language last
layout level library limit link list loader location lock logger maximum member memory method minimum model
month name network notification number object offset open option output owner package parameter parent parse
path pattern payload percent period pointer position prefix previous priority process product project property
provider query queue random read record reference register release remove report request reset response result
return root route row schedule schema scope search section select server service session shape shared signature
single size snapshot sort source stack state static status store stream string submit suffix summary symbol
system table task template test time timeout title total trace transaction tree type unique update upload user
validate value variable version view visible weight widget width worker wrapper write""".split()
#: Words of documents count as ordinary from this length on.
LEAST_WORD = 4
#: Bytes of text that are looked at together; counting pairs of characters takes some 40 times as many.
SLICE = 1 << 20
#: The number of a character by its byte; 0 for others and for a start.
_CODES = np.zeros(256, np.int64)
_CODES[list(CHARACTERS.encode())] = np.arange(1, len(CHARACTERS) + 1)
#: A candidate is a secret from this log-likelihood ratio on, in sum and for each character.
LEAST_SUM, LEAST_MEAN = 10.0, 0.45


def base_spans(whole: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all pattern matches, sorted."""
    low = whole.lower()
    found = []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(whole) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in whole:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(whole)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(whole)]
    return sorted(found)


def random_strings(count: int = 4000, seed: int = 5) -> list[str]:
    """Labelled random: strings over the alphabets of keys."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", CHARACTERS[:62], CHARACTERS[:62] + "+/", CHARACTERS[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", CHARACTERS[26:62]]
    return ["".join(np.array(list(alphabets[k % len(alphabets)]))[rng.integers(0, len(alphabets[k % len(alphabets)]), rng.integers(16, 64))]) for k in range(count)]


def identifiers(count: int = 8000, seed: int = 6) -> list[str]:
    """Labelled ordinary: identifiers, paths, dates and numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        parts = [PARTS[i] for i in rng.integers(0, len(PARTS), rng.integers(2, 6))]
        number = str(rng.integers(0, 10 ** int(rng.integers(1, 5)))) if rng.random() < 0.3 else ""
        match k % 7:
            case 0:
                out.append("_".join(parts) + number)
            case 1:
                out.append(parts[0] + "".join(map(str.title, parts[1:])) + number)
            case 2:
                out.append("-".join(parts) + number)
            case 3:
                out.append("_".join(map(str.upper, parts)) + number)
            case 4:
                out.append("/" + "/".join(parts) + number)
            case 6:
                out.append(_in_order(rng))
            case 5:
                day = f"{rng.integers(1990, 2035)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
                out.append("/".join([parts[0], day, str(rng.integers(0, 10**9)), "=" * int(rng.integers(4, 20)), "-" * int(rng.integers(4, 20)), "_" * 8, "0" * int(rng.integers(2, 12))]))
    return out


def _in_order(rng: np.random.Generator) -> str:
    """Alphabets and digits in their order, from some place on."""
    upper, lower, digits = CHARACTERS[:26], CHARACTERS[26:52], CHARACTERS[52:62]
    parts = [[upper, lower, digits, digits][i] for i in rng.permutation(4)[: int(rng.integers(1, 4))]]
    return "".join(parts)[int(rng.integers(0, 6)) :]


def pair_counts(texts: list[str], least: int = 1) -> np.ndarray:
    """How often a character follows another, or (in row 0) begins a run, over all runs of ``least`` characters or more."""
    n = len(CHARACTERS) + 1
    codes = _CODES[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)]
    inside = codes > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    lengths = edges[1::2] - edges[::2]
    firsts, chars = np.cumsum(lengths) - lengths, codes[inside].astype(np.int64)
    before = np.concatenate([[0], chars[:-1]])[: len(chars)]
    before[firsts] = 0
    kept = np.repeat(lengths >= least, lengths)
    return np.bincount(before[kept] * n + chars[kept], minlength=n * n).reshape(n, n)


class Markov:
    """Log-likelihood ratio of random to ordinary for each pair of neighbouring characters, from the counts of pairs."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5):
        a, b = (np.log((counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)) for counts in (random, ordinary))
        self.ratio = a - b

    def sum(self, word: str) -> float:
        codes = np.concatenate([[0], _CODES[np.frombuffer(word.encode(), np.uint8)]])
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def is_secret(self, word: str) -> bool:
        if word.isdigit() or len(set(word)) < 8:
            return False
        total = self.sum(word)
        return total >= LEAST_SUM and total >= LEAST_MEAN * len(word)


def train(docs: DataFrame, text_col: str = "text") -> Markov:
    """Models from the fixed strings and from all documents, of which only sums by pair of characters reach the driver."""
    n = len(CHARACTERS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n, n), np.int64)
        for batch in slices(batches, size=SLICE):
            values, rest = [], []
            for whole in batch.column(0).to_pylist():
                at = 0
                for start, kind, end in base_spans(whole):
                    values.append(whole[start:end] if kind else ASSIGN.match(whole, start)[2])
                    rest.append(whole[at:start])
                    at = max(at, end)
                rest.append(whole[at:])
            sums[0] += pair_counts(rest, LEAST_WORD)
            sums[1] += pair_counts(values)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums.ravel()[found], pa.int64())], names=["pair", "times"])

    counts = docs.select(text(text_col).alias("text")).mapInArrow(run, "pair bigint, times bigint")
    rows = counts.groupBy("pair").agg(F.sum("times").alias("times")).toPandas()
    sums = np.zeros(2 * n * n)
    sums[rows["pair"].to_numpy(int)] = rows["times"].to_numpy(float)
    ordinary, random = sums.reshape(2, n, n)
    return Markov(_both(pair_counts(random_strings()), random), _both(pair_counts(identifiers()), ordinary))


def _both(fixed: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Sums of both; those of documents weigh as much as those of the fixed strings at most, so the table's size does not tell."""
    return fixed + found * min(1.0, fixed.sum() / max(1.0, found.sum()))


def spans(whole: str, model: Markov | None) -> list[tuple[int, int, int]]:
    """Pattern matches and what the models call random of the candidates between and around them; sorted.

    What patterns match is cut out of a candidate first; every piece of ``LEAST`` characters or more is judged alone.
    """
    base = base_spans(whole)
    if model is None:
        return base
    more, k = [], 0
    for m in CANDIDATE.finditer(whole):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        at, n = m.start(), k
        while n < len(base) and base[n][0] < m.end():
            more += _random(whole, at, base[n][0], model)
            at, n = max(at, base[n][2]), n + 1
        more += _random(whole, at, m.end(), model)
    return sorted(base + more)


def _random(whole: str, start: int, end: int, model: Markov) -> list[tuple[int, int, int]]:
    """What the models call random of a piece, without the identifiers in it."""
    if end - start < LEAST:
        return []
    found, at = [], start
    for a, b in [*(m.span() for m in UUID.finditer(whole, start, end)), (end, end)]:
        if a - at >= LEAST and model.is_secret(whole[at:a]):
            found.append((at, 3, a))
        at = b
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the patterns' kinds, digest of their spans, and all spans of every document."""
    model = train(docs, text_col)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            found = [spans(t, model) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(4)]
            digests = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts[:3], pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string()), counts[3]], names=names
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")


def without_spans(whole: str, found: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, _, end in found:
        if start >= at:
            parts += [whole[at:start], mark]
        at = max(at, end)
    return "".join([*parts, whole[at:]])


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The documents, each span of a secret (overlapping ones together) replaced by ``mark``; null texts stay null."""
    model = train(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            clean = [t if t is None else without_spans(t, spans(t, model), mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
