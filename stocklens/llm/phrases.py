"""Collocations: phrases that occur often, ranked by how much more often than their parts would make them (Toivonen).

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. All counts are per
language. Phrases of up to ``LONGEST`` words that occur ``least`` times or more are mined exactly:

1. **Sample.** One document in ``SAMPLE`` (by digest of id and text) proposes phrases that are frequent there at a
   lowered threshold. Proposals are a filter of fixed size at most (``FILTER_BITS``), by hash of language and phrase.
2. **Full pass.** Over all documents, every word is counted, and every phrase whose two parts of one word less are both
   proposed: the proposed phrases and their negative border. Counts are summed by 64-bit hash, so rows stay short though
   most of the border is rare. A hash that reaches ``least`` is hot; a phrase with another hash is not frequent.
3. **Expansion.** A hot phrase that was not proposed is a border failure: longer phrases around it may have been missed.
   A further pass counts, with the phrase itself as key and so exactly, what is hot, and what the pass before could not
   count: phrases whose two parts are hot or counted in this very pass. As it follows its own new phrases up to the
   greatest length, it closes the set: parts of a frequent phrase are frequent, so they are hot or counted now, and so is
   the phrase itself.

Clashing hashes only make the passes count more. Only phrases that are frequent are joined with those of their parts. The
best of each language are picked in two steps, within parts of the phrases and among what these leave.

Null texts count as empty, a null language as ``und``; a null id is as good as any. Repeated rows count each time. Ties go
by the greater count, then by the phrase's bytes; an empty table gives no rows. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stocklens.llm.common import text, together, written

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
SAMPLE = 8
#: The filter of proposed phrases has at most so many bits (16 MB); two of each phrase are set.
FILTER_BITS = 1 << 27
#: Letters that are lowered, and what ends a piece.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ;:,!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Documents are counted together in batches of about so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: A task of the last pass reads so many splits at most.
SPLITS = 8
COUNTS = "lang string, size int, phrase string, f bigint"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of non-null texts: distinct words, all words as numbers of them, the text of each, and the piece of each."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes() if texts.buffers()[2] else b""
    offsets = offsets - offsets[0]
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    dot = data == ord(".")
    inside = ~dot & (data != ord(" "))
    before = np.concatenate([[False], inside[:-1]])[: len(data)]
    begins = inside & ~before
    borders = offsets[:-1][offsets[:-1] < len(data)]  # a text begins a word, whatever is before
    begins[borders] = inside[borders]
    starts = np.flatnonzero(begins)
    letters = np.concatenate([[0], np.cumsum(inside)])
    places = np.append(letters[starts], letters[-1])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
    owner = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(dot)[starts] + owner if len(starts) else starts  # both only grow, so a change of either changes it
    return words.dictionary, words.indices.to_numpy().astype(np.int64), owner, piece


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * _STEP + words * _MIX
        return mixed ^ (mixed >> np.uint64(32))


class Filter:
    """A set of hashes that may hold more than was put in, never less; two bits a member."""

    def __init__(self, bits: int = 1 << 16):
        self.words = np.zeros(bits >> 6, np.uint64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.uint64(len(self.words) * 64 - 1)
        return (hashes & last).astype(np.int64), ((hashes >> np.uint64(35)) & last).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
        return out

    def with_hashes(self, rows: DataFrame) -> "Filter":
        """This filter and the column ``hash`` of ``rows``, put together by Spark: at most a filter's words reach the driver."""
        last, out = len(self.words) * 64 - 1, Filter(len(self.words) * 64)
        place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(last)), F.shiftrightunsigned("hash", 35).bitwiseAND(F.lit(last))))
        bits = rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
        found = bits.toPandas()
        out.words[:] = self.words
        out.words[found["word"].to_numpy(np.int64)] |= found["bits"].to_numpy(np.int64).view(np.uint64)
        return out


class Batch:
    """The words of some documents, and their phrases of growing length at the places where they begin."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.names, self.words, owner, self.piece = words_of(texts)
        self.texts = self.names.to_pylist()
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy().astype(np.int64)[owner]
        with np.errstate(over="ignore"):
            salt = word_hashes(self.langs) * _STEP
            self.hashes = word_hashes(self.texts)[self.words] ^ salt[self.lang]
        self.number = self.lang * max(len(self.texts), 1) + self.words

    def fits(self, places: np.ndarray, size: int) -> np.ndarray:
        """Which of the places have ``size`` words left in their piece."""
        ends = np.minimum(places + size, len(self.words)) - 1
        return (places + size <= len(self.words)) & (self.piece[ends] == self.piece[places])

    def phrase(self, place: int, size: int) -> str:
        return " ".join([self.texts[w] for w in self.words[place : place + size].tolist()])

    def counted(self, langs: np.ndarray, size: int, phrases: pa.Array | list[str], times: np.ndarray) -> pa.RecordBatch:
        """Rows of ``COUNTS``; the languages as numbers."""
        lang = pa.array(self.langs, pa.string()).take(pa.array(langs, pa.int64()))
        phrase = pa.array(phrases, pa.string()) if isinstance(phrases, list) else phrases.cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), size, np.int32)), phrase, pa.array(times, pa.int64())], names=["lang", "size", "phrase", "f"])


def _hash_counts(docs: DataFrame, phrase_places) -> DataFrame:
    """hash and times: of what ``phrase_places`` yields for each batch, arrays of hashes, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in together(batches, BATCH_ROWS, BATCH_BYTES):
            found = list(phrase_places(Batch(texts.column(1), texts.column(0))))
            distinct, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(times, pa.int64())], names=["hash", "times"])

    return docs.select("lang", "text").mapInArrow(run, "hash bigint, times bigint").groupBy("hash").agg(F.sum("times").alias("times"))


def propose(docs: DataFrame, least: int, longest: int = LONGEST, sample: int = SAMPLE) -> Filter:
    """Phrases of up to ``longest - 1`` words that are frequent in the sample at a threshold lowered by two deviations."""
    some = docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(sample)) == 0)
    expected = least / sample
    lowered = max(2, int(expected - 2 * expected**0.5))
    words = written(_hash_counts(some, lambda batch: [batch.hashes]).filter(F.col("times") >= lowered).select("hash"), "words")
    known = sized(words.count()).with_hashes(words)

    def of_known_words(batch: Batch) -> Iterator[np.ndarray]:
        good = known.has(batch.hashes)
        places, hashes = np.flatnonzero(good), batch.hashes[good]
        for size in range(2, longest):
            fits = batch.fits(places, size)
            fits[fits] = good[places[fits] + size - 1]
            places = places[fits]
            hashes = extended(hashes[fits], batch.hashes[places + size - 1])
            yield hashes
        if longest <= 2:
            yield hashes[:0]

    phrases = written(_hash_counts(some, of_known_words).filter(F.col("times") >= lowered).select("hash"), "phrases")
    members = words.unionByName(phrases)
    return sized(members.count()).with_hashes(members)


def sized(members: int) -> Filter:
    """An empty filter with 32 bits a member, if that is no more than ``FILTER_BITS``."""
    return Filter(min(FILTER_BITS, 1 << max(16, (32 * members).bit_length())))


def steps(batch: Batch, proposed: Filter, hot: Filter | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the places of phrases to go on from, their hashes, whether the full pass counts them, and, as numbers
    into the size before, where their first and their last part are.

    Without ``hot`` phrases grow from proposed parts, as in the full pass; with it, from parts that are hot or that the
    full pass did not count.
    """
    places, hashes, border = np.arange(len(batch.words)), batch.hashes, np.ones(len(batch.words), bool)
    yield 1, places, hashes, border, places
    for size in range(2, longest + 1):
        known = border & proposed.has(hashes)
        good = known if hot is None else ~border | hot.has(hashes)
        slot = np.full(len(batch.words) + 1, -1, np.int64)
        slot[places[good]] = np.flatnonzero(good)
        at = np.flatnonzero(good)
        at = at[batch.fits(places[at], size)]
        behind = slot[places[at] + 1]
        at, behind = at[behind >= 0], behind[behind >= 0]
        places, border = places[at], known[at] & known[behind]
        hashes = extended(hashes[at], batch.hashes[places + size - 1])
        yield size, places, hashes, border, at


def hot_hashes(docs: DataFrame, proposed: Filter, least: int, longest: int = LONGEST) -> DataFrame:
    """The full pass: hashes that words, proposed phrases and their border together have ``least`` times or more."""

    def counted(batch: Batch) -> Iterator[np.ndarray]:
        for _, _, hashes, _, _ in steps(batch, proposed, None, longest):
            yield hashes

    return _hash_counts(docs, counted).filter(F.col("times") >= least).select("hash")


def summed(batches: Iterator[pa.RecordBatch], rows: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The batches' counts added up over a task; what has more than ``rows`` different keys is handed on in between."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2 * rows:
            table = _sum(held)
            if table.num_rows > rows:
                yield from table.to_batches()
                held, size = [], 0
            else:
                held, size = table.to_batches(), table.num_rows
    if held:
        yield from _sum(held).to_batches()


def _sum(held: list[pa.RecordBatch]) -> pa.Table:
    names = held[0].schema.names
    table = pa.Table.from_batches(held).group_by(names[:3], use_threads=False).aggregate([("f", "sum")])
    return pa.table([table.column(n) for n in (*names[:3], "f_sum")], names=names)


def count(docs: DataFrame, proposed: Filter, hot: Filter, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase and f: exact counts of hot phrases, and of those that the full pass did not count.

    Size 0 is the number of all words of a language.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in together(batches, BATCH_ROWS, BATCH_BYTES):
            batch = Batch(texts.column(1), texts.column(0))
            yield batch.counted(np.arange(len(batch.langs)), 0, [""] * len(batch.langs), np.bincount(batch.lang, minlength=len(batch.langs)))
            number = batch.number
            for size, places, hashes, border, at in steps(batch, proposed, hot, longest):
                if size > 1:
                    number = number[at] * len(batch.texts) + batch.words[places + size - 1]
                wanted = ~border | hot.has(hashes)
                distinct, first, times = np.unique(number[wanted], return_index=True, return_counts=True)
                if size < longest:
                    number = np.where(wanted, np.searchsorted(distinct, number), len(distinct))  # unwanted ones do not grow
                some = places[wanted][first]
                phrases = batch.names.take(pa.array(batch.words[some])) if size == 1 else [batch.phrase(place, size) for place in some.tolist()]
                yield batch.counted(batch.lang[some], size, phrases, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(counted(batches))

    # hot phrases recur in every split, so a task sums up some splits before the shuffle, as many as leave no core idle
    splits = docs.rdd.getNumPartitions()
    some = docs.select("lang", "text").coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS)))
    return some.mapInArrow(run, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """All phrases (lang, size, phrase, f) that occur ``least`` times or more; with size 0, the words of each language.

    ``docs`` has id, lang and text, without nulls in the last two.
    """
    proposed = propose(docs, least, longest, sample)
    hashes = written(hot_hashes(docs, proposed, least, longest), "hot")
    hot = sized(hashes.count()).with_hashes(hashes)
    counts = count(docs, proposed, hot, longest)
    return written(counts.filter((F.col("f") >= least) | (F.col("size") == 0)), "frequent")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of two words or more.

    A phrase is dropped if a longer frequent one around it occurs at least ``share`` hundredths as often.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text(text_col).alias("text"))
    mined = mine(rows, least, longest, sample)
    parts = mined.filter("size between 1 and %d" % (longest - 1)).select("lang", "phrase", "f")
    phrases = mined.filter("size >= 2")
    # the most frequent of the phrases one word longer; longer ones still are no more frequent than one of these
    around = (
        phrases.filter("size >= 3")
        .select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    kept = phrases.join(around, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {int(share)} * f").drop("longer")
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    words = mined.filter("size = 0").select("lang", F.col("f").alias("n"))
    wide = "cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    scored = cuts.join(words, "lang").withColumn("score", F.expr(wide))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The whole rule in SQL; DuckDB compares texts by bytes and has 128-bit integers.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS size),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM words, sizes WHERE len(w) >= size),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY ALL),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= 100),
inner_parts AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, size, s, unnest(range(1, size - s + 2)) AS i FROM candidates, (SELECT unnest([2, 3, 4]) AS s) WHERE s < size) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase) WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.a),
cuts AS (SELECT *, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, k, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= 2000
"""
