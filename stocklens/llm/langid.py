"""Language identification of mixed-language text: script ranges, n-gram scores of words, Viterbi over words.

A word's script, told by the code point ranges below, leaves only the languages that were seen in that script. These are
scored by the logarithms of n-gram probabilities (one to four letters, word borders included). Viterbi then labels the
words of a document with the best path of languages, where each switch costs a penalty; runs of one label are spans. The
language of a document is that of its frame, if it begins and ends in one language that has a fifth of the letters or
more, because what stands between is then a quotation; else the label with the most letters. The score is the share of
its letters.

Models are counted over all labelled documents outside the held-out fold.

Texts that are null or have no letter are ``und`` with score 0 and no span. Texts are read whole; words are split at
ASCII white space. A word is scored in pieces where its script changes, and every 8 letters in scripts written without
spaces; a span counts the words it begins, ends or goes on in, so two spans may share one. Rows without language do not train. Letters of a script no language was seen in are neutral; a text of
such letters only gets the commonest labelled language with score 0. If no row can train, everything with letters
is ``und``. Rows are independent; columns but those named are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import gather, held_out, split_words, text, together

#: First code points of script blocks; letters between two belong to the earlier one.
SCRIPTS = {
    "latin": (0x0041, 0x1E00, 0x2C60, 0xA720, 0xAB30, 0xFF21), "greek": (0x0370, 0x1F00), "cyrillic": (0x0400, 0x1C80, 0x2DE0, 0xA640),
    "armenian": (0x0531,), "hebrew": (0x0590, 0xFB1D), "arabic": (0x0600, 0x0750, 0x08A0, 0xFB50, 0xFE70), "syriac": (0x0700,), "devanagari": (0x0900, 0xA8E0),
    "bengali": (0x0980,), "gurmukhi": (0x0A00,), "gujarati": (0x0A80,), "oriya": (0x0B00,), "tamil": (0x0B80,), "telugu": (0x0C00,), "kannada": (0x0C80,),
    "malayalam": (0x0D00,), "sinhala": (0x0D80,), "thai": (0x0E00,), "lao": (0x0E80,), "tibetan": (0x0F00,), "myanmar": (0x1000,), "georgian": (0x10A0, 0x1C90, 0x2D00),
    "hangul": (0x1100, 0x3130, 0xA960, 0xAC00), "ethiopic": (0x1200, 0x2D80, 0xAB00), "khmer": (0x1780,), "mongolian": (0x1800,), "kana": (0x3040, 0x31F0, 0xFF66),
    "han": (0x2E80, 0x3400, 0x4E00, 0xF900, 0x20000), "other": (0x0000, 0x02B0, 0x0500, 0x1380, 0x1A00, 0x2000, 0x2E00, 0xA000, 0xA980, 0xD7FC, 0xE000, 0xFE00, 0xFFA0, 0x10000, 0x323B0),
}
BUCKETS = 1 << 16
ORDERS = 4
#: Languages that a task counts before it hands the sums on.
HELD = 256
#: A language is a candidate in a script that has this share of its letters or more.
LEAST_SHARE = 0.01
SWITCH = 12.0
#: A language at both ends of a text is the text's if it has this share of the letters.
FRAME_SHARE = 0.2
NEVER = -30.0
#: Scripts written without spaces, by number, and the letters that a piece of such a run has.
UNSPACED = np.array([False, *(name in ("thai", "lao", "tibetan", "myanmar", "khmer", "kana", "han") for name in SCRIPTS)])
PIECE = 8
OTHER = list(SCRIPTS).index("other") + 1


@lru_cache(maxsize=1)
def letter_scripts() -> np.ndarray:
    """The number of the script (from 1) of every code point that is a letter, else 0."""
    starts = sorted((start, number) for number, blocks in enumerate(SCRIPTS.values(), start=1) for start in blocks)
    every = np.arange(0x110000)
    numbers = np.array([n for _, n in starts], np.uint8)[np.searchsorted([s for s, _ in starts], every, side="right") - 1]
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, numbers, 0).astype(np.uint8)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: n-gram buckets and which of them count (both by order and place), where words start, letters, scripts."""
    lowered = pc.utf8_lower(words)
    lengths = pc.utf8_length(lowered).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1  # one border in front of every word
    points = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.uint32)
    inside = np.ones(len(points), bool)
    inside[starts] = inside[-1] = False
    points[inside] = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    scripts = letter_scripts()[points]
    points[scripts == 0] = 0
    letter = points > 0
    buckets, counts = np.zeros((ORDERS, len(points)), np.int32), np.zeros((ORDERS, len(points)), bool)
    for n in range(1, ORDERS + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        mixed = np.full(size, 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ points[k : k + size]) * np.uint32(0x01000193)
            mixed ^= mixed >> np.uint32(15)
        valid = letter[:size] | letter[n - 1 :] if n > 1 else letter.copy()
        for k in range(1, n - 1):
            valid &= letter[k : k + size]
        buckets[n - 1, :size], counts[n - 1, :size] = mixed % BUCKETS, valid
    letters = np.add.reduceat(letter, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    first = np.flatnonzero(letter)
    at = np.searchsorted(first, starts)
    script = np.where(letters > 0, scripts[first[np.minimum(at, len(first) - 1)]] if len(first) else 0, 0)
    return buckets, counts, starts, letters, script


def _pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words cut where the script changes, and in scripts without spaces into ``PIECE`` letters; and the number of pieces of each."""
    ones = np.ones(len(words), np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points) or points.max() < 0x0370:  # nothing but Latin letters
        return words, ones
    scripts = letter_scripts()[points]
    scripts = np.where(scripts == OTHER, 0, scripts)  # modifier letters and such go with the letters around
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    at = np.flatnonzero(scripts)
    word, script = np.repeat(np.arange(len(words)), lengths)[at], scripts[at]
    fresh = np.concatenate([[True], word[1:] != word[:-1]])[: len(at)]
    begins = fresh | np.concatenate([[True], script[1:] != script[:-1]])[: len(at)]
    place = np.arange(len(at))
    within = place - np.maximum.accumulate(np.where(begins, place, 0)) if len(at) else place
    cut = (begins & ~fresh) | (UNSPACED[script] & (within > 0) & (within % PIECE == 0))
    if not cut.any():
        return words, ones
    starts = np.cumsum(lengths) - lengths
    cuts: dict[int, list[int]] = {}
    for number, point in zip(word[cut].tolist(), (at - starts[word])[cut].tolist(), strict=True):
        cuts.setdefault(number, [0]).append(point)
    out = []
    for number, whole in enumerate(words.to_pylist()):
        some = cuts.get(number)
        out += [whole[a:b] for a, b in zip(some, [*some[1:], None], strict=True)] if some else [whole]
        ones[number] = len(some) if some else 1
    return pa.array(out, pa.string()), ones


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, the pieces of all texts as numbers of them, where each text's begin, each piece's word, where each text's words begin."""
    distinct, words, borders = split_words(texts)
    pieces, counts = _pieces(distinct)
    if len(pieces) == len(distinct):
        return distinct, words, borders, np.arange(len(words)), borders
    chosen, ends = gather(np.concatenate([[0], np.cumsum(counts)]), np.arange(len(pieces)), words)
    return pieces, chosen, np.concatenate([[0], ends])[borders], np.repeat(np.arange(len(words)), counts[words]), borders


@dataclass
class Model:
    """Languages, weights by n-gram bucket and language, allowed languages by script, and the commonest language."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray
    common: int

    def score_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language (at most 0, all 0 where nothing is known), and letters by word."""
        buckets, counts, starts, letters, script = _grams(words)
        by_place = np.zeros((buckets.shape[1], len(self.languages)), np.float32)
        for n in range(ORDERS):
            at = np.flatnonzero(counts[n])
            by_place[at] += self.weights[buckets[n, at]]
        scores = np.add.reduceat(by_place, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)), np.float32)
        allowed = self.allowed[script]
        scores = np.where(allowed, scores, np.float32(-1e9))
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), np.float32(NEVER))
        scores[~allowed.any(axis=1)] = 0
        return scores, letters


def viterbi(scores: np.ndarray, words: np.ndarray, borders: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of labels over the words of all documents, which advance together, the longest first."""
    lengths = np.diff(borders)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = borders[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
    labels = np.zeros(len(words), np.int32)
    best_before, stayed = np.zeros(len(words), np.int32), np.zeros((len(words), scores.shape[1]), bool)
    value = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        at = starts[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            switched = now[np.arange(n), best] - penalty
            keep = now >= switched[:, None]
            best_before[at], stayed[at] = best, keep
            now = np.where(keep, now, switched[:, None])
        value[:n] = now + scores[words[at]]
    current = value.argmax(axis=1).astype(np.int32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        if t:
            kept = stayed[at, current[:n]]
            current[:n] = np.where(kept, current[:n], best_before[at])
    return labels


def _counted(docs: DataFrame) -> DataFrame:
    """Counts of n-gram buckets (n > 0) and of letters by script (n = 0) for each language; ``docs`` has lang and text."""

    def rows(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (grams, scripts) in sums.items():
            found, seen = np.flatnonzero(grams), np.flatnonzero(scripts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(found) + len(seen)), pa.string()),
                    pa.array(np.concatenate([found, seen]), pa.int64()),
                    pa.array(np.repeat([False, True], [len(found), len(seen)])),
                    pa.array(np.concatenate([grams[found], scripts[seen]]), pa.int64()),
                ],
                names=["lang", "number", "script", "times"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in together(batches):
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                words, chosen, *_ = _split(batch.column(1).filter(pc.equal(langs, lang)))
                buckets, counts, starts, letters, script = _grams(words)
                times = np.bincount(chosen, minlength=len(words))
                by_place = np.repeat(times, np.diff(np.append(starts, buckets.shape[1])))
                if lang not in sums and len(sums) >= HELD:
                    yield from rows(sums)
                    sums = {}
                grams, scripts = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)))
                for n in range(ORDERS):
                    grams += np.bincount(buckets[n, counts[n]], weights=by_place[counts[n]], minlength=BUCKETS).astype(np.int64)
                scripts += np.bincount(script, weights=letters * times, minlength=len(SCRIPTS) + 1).astype(np.int64)
        yield from rows(sums)

    counted = docs.mapInArrow(run, "lang string, number bigint, script boolean, times bigint")
    return counted.groupBy("lang", "number", "script").agg(F.sum("times").alias("times"))


def train(docs: DataFrame, smooth: float = 0.5) -> Model | None:
    """The model of all labelled documents outside the held-out fold.

    Only counts reach the driver: at most ``BUCKETS`` and the number of scripts for each language.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id"))
    rows = _counted(labelled.select(F.col("lang").cast("string").alias("lang"), text("text").alias("text"))).toPandas()
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    number = rows["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy()
    is_script = rows["script"].to_numpy(bool)
    grams, letters = np.full((BUCKETS, len(languages)), smooth), np.zeros((len(SCRIPTS) + 1, len(languages)))
    grams[rows["number"].to_numpy()[~is_script], number[~is_script]] += rows["times"].to_numpy()[~is_script]
    letters[rows["number"].to_numpy()[is_script], number[is_script]] += rows["times"].to_numpy()[is_script]
    logs = np.log(grams / grams.sum(axis=0))
    share = letters / np.maximum(letters.sum(axis=0), 1)
    share[0] = 0
    return Model(languages, (logs - logs.max(axis=1, keepdims=True)).astype(np.float32), share >= LEAST_SHARE, int(letters.sum(axis=0).argmax()))


def predict(docs: DataFrame, model: Model | None, penalty: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (language, first word, words) of every document."""
    sent: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "spans"]
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value or Model(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros((len(SCRIPTS) + 1, 1), bool), 0)
        count, languages = len(model.languages), np.array(model.languages, object)
        for batch in together(batches):
            distinct, words, borders, word_of, word_borders = _split(batch.column(1))
            scores, letters = model.score_words(distinct)
            labels = viterbi(scores, words, borders, penalty)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(borders))
            known = np.where(scores.any(axis=1) | (count == 1), letters, 0)
            mass = np.bincount(doc * count + labels, weights=known[words], minlength=batch.num_rows * count).reshape(-1, count)
            every = np.bincount(doc, weights=letters[words], minlength=batch.num_rows)
            best = np.where(mass.any(axis=1), mass.argmax(axis=1), model.common)
            some = np.flatnonzero(np.diff(borders) > 0)
            first, last = labels[borders[some]], labels[borders[some + 1] - 1]
            framed = (first == last) & (mass[some, first] >= FRAME_SHARE * np.maximum(every[some], 1))
            best[some[framed]] = first[framed]
            score = mass[np.arange(batch.num_rows), best] / np.maximum(every, 1)
            # a run of one label is a span; texts without letter have none
            begins = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])) if len(words) else np.zeros(0, np.int64)
            begins_in = doc[begins]
            first_word, last_word = word_of[begins], word_of[np.append(begins[1:], len(words)) - 1] if len(words) else begins
            sizes = last_word - first_word + 1
            kept = every[begins_in] > 0
            offsets = np.concatenate([[0], np.cumsum(np.bincount(begins_in[kept], minlength=batch.num_rows))])
            parts = [pa.array(languages[labels[begins[kept]]].tolist(), pa.string()), pa.array((first_word - word_borders[begins_in])[kept], pa.int64()), pa.array(sizes[kept], pa.int64())]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(span)))
            predicted = pa.array(np.where(every > 0, languages[best], "und").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), predicted, pa.array(np.where(every > 0, score, 0.0)), spans], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, spans array<struct<lang: string, first_word: bigint, words: bigint>>")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document, with a model trained on the other folds."""
    return predict(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")
