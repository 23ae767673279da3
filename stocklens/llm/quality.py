"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, of which only the document has a label. Every passage is encoded
from its characters and words by a learned layer, a learned gated attention weighs the passages of a document against
each other, and a logistic layer scores the weighted sum of their encodings.

The model is fitted by Adam on a sample of the labelled documents outside the held-out fold: about ``SAMPLE`` of them by
digest of their ids, all if there are fewer, of each at most ``SAMPLE_PASSAGES`` passages spread evenly, so that what
the fit needs is bounded. Scoring reads every passage of every text.

Null and empty texts are one passage without words, scored like any other. Several labels of one document are averaged,
0.5 counts as 1; of several texts of one id, one trains; null labels and labels of unknown documents do not train. Without any label all
scores are 0.5; an empty table gives no rows. Sums are taken in an order that does not depend on the batch, so equal texts
score equally bit by bit, alone or among others. Columns but those named are not read, and ``keep_good`` keeps them all.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import held_out, slices, split_words, text

PASSAGE = 64
SAMPLE, SAMPLE_PASSAGES = 6_000, 32
THRESHOLD = 0.3
ENCODING, GATE = 16, 8

#: Byte classes; every byte of a word is in one of them.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "quote": b"\"'`()",
    "code": b"<>[]{}=+/\\_-", "sign": b"#$%&*@^~", "bar": b"|", "control": bytes([*range(32), 127]), "wide": bytes(range(128, 256)),
}
#: Features of a passage: shares of the byte classes, then these.
OF_WORDS = "capitals letterless stopped titled signed long short length repeated distinct words".split()
_CLASS = np.zeros(256, np.uint8)
for _number, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members)] = _number


def _word_features(words: pa.Array) -> np.ndarray:
    """Of distinct words: bytes by class, then capitals, letterless, stopped, titled, signed, long, short and the length."""
    names = list(CLASSES)
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    out = np.zeros((len(words), len(names) + 8), np.float32)
    for number in range(len(names)):
        out[:, number] = np.diff(np.concatenate([[0], np.cumsum(kind == number)])[offsets])
    upper, lower, wide = (out[:, names.index(n)] for n in ("upper", "lower", "wide"))
    signs = sum(out[:, names.index(n)] for n in ("sign", "bang", "bar", "code"))
    size = np.diff(offsets)
    first = np.where(size > 0, kind[np.minimum(offsets[:-1], max(len(kind) - 1, 0))] if len(kind) else 255, 255)
    last = np.where(size > 0, kind[offsets[1:] - 1] if len(kind) else 255, 255)
    flags = [(upper > 1) & (lower == 0), upper + lower + wide == 0, last == names.index("stop"), (first == names.index("upper")) & (lower > 0), signs > 0, size > 24, size < 4, size / 10]
    out[:, len(names) :] = np.stack(flags, axis=1)
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of non-null texts, and the number of passages of each text, one at least."""
    distinct, words, borders = split_words(texts)
    by_word = _word_features(distinct)
    empty = by_word[:, -1] == 0  # white space at either end of a text
    kept = ~empty[words]
    counts = np.bincount(np.repeat(np.arange(len(texts)), np.diff(borders))[kept], minlength=len(texts))
    words = words[kept]
    bags = np.maximum(1, -(-counts // PASSAGE))
    bag_of = np.repeat(np.arange(len(texts)), bags)
    within = np.arange(len(bag_of)) - np.repeat(np.cumsum(bags) - bags, bags)
    starts = (np.cumsum(counts) - counts)[bag_of] + within * PASSAGE
    size = np.minimum(PASSAGE, counts[bag_of] - within * PASSAGE)
    sums = np.zeros((len(bag_of), by_word.shape[1] + 2), np.float64)
    full = np.flatnonzero(size > 0)
    if len(full):
        passage = np.repeat(np.arange(len(bag_of)), size)
        sums[full, :-2] = np.add.reduceat(by_word[words], starts[full], axis=0)
        inside = passage[1:] == passage[:-1]
        sums[:, -2] = np.bincount(passage[1:][inside & (words[1:] == words[:-1])], minlength=len(bag_of))
        pairs = np.unique(passage * np.int64(len(distinct) + 1) + words)
        sums[:, -1] = np.bincount(pairs // (len(distinct) + 1), minlength=len(bag_of))
    some = np.maximum(size, 1)[:, None]
    bytes_of = np.maximum(sums[:, : len(CLASSES)].sum(axis=1, keepdims=True), 1)
    return np.concatenate([sums[:, : len(CLASSES)] / bytes_of, sums[:, len(CLASSES) :] / some, np.log2(1 + size)[:, None] / 6], axis=1).astype(np.float32), bags


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` summed column by column, so that a row's result does not depend on how many rows there are."""
    out = np.zeros((len(x), *w.shape[1:]))
    for column, weights in zip(np.ascontiguousarray(x.T), w, strict=True):
        out += np.multiply.outer(column, weights)
    return out


def _within_bags(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


@dataclass
class Model:
    """Gated attention over encoded passages; ``weights`` holds the layers by name."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        starts = np.cumsum(bags) - bags
        x = np.clip((x.astype(np.float64) - self.mean) / self.spread, -8, 8)
        encoded = np.tanh(_times(x, w["encode"]) + w["encode_bias"])
        tanh, gate = np.tanh(_times(encoded, w["tanh"])), 1 / (1 + np.exp(-_times(encoded, w["gate"])))
        raw = _times(tanh * gate, w["attend"])
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), bags))
        attention = raw / np.repeat(_within_bags(raw, starts), bags)
        pooled = _within_bags(attention[:, None] * encoded, starts)
        score = 1 / (1 + np.exp(-(_times(pooled, w["score"]) + w["score_bias"])))
        return {"x": x, "encoded": encoded, "tanh": tanh, "gate": gate, "attention": attention, "pooled": pooled, "score": score, "starts": starts}

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, bags)
        error = (f["score"] - y) / len(y)
        out = {"score": f["pooled"].T @ error, "score_bias": error.sum(keepdims=True)}
        pooled = np.repeat(error[:, None] * w["score"], bags, axis=0)
        d_attention = (pooled * f["encoded"]).sum(axis=1)
        mean = np.repeat(_within_bags(f["attention"] * d_attention, f["starts"]), bags)
        raw = f["attention"] * (d_attention - mean)
        out["attend"] = (f["tanh"] * f["gate"]).T @ raw
        both = raw[:, None] * w["attend"]
        d_tanh, d_gate = both * f["gate"] * (1 - f["tanh"] ** 2), both * f["tanh"] * f["gate"] * (1 - f["gate"])
        out["tanh"], out["gate"] = f["encoded"].T @ d_tanh, f["encoded"].T @ d_gate
        encoded = pooled * f["attention"][:, None] + d_tanh @ w["tanh"].T + d_gate @ w["gate"].T
        encoded *= 1 - f["encoded"] ** 2
        out["encode"], out["encode_bias"] = f["x"].T @ encoded, encoded.sum(axis=0)
        return {k: g + decay * w[k] for k, g in out.items()}

    def score(self, texts: pa.Array) -> np.ndarray:
        """Scores to nine places; equal texts score equally whatever else is in the batch."""
        return self.forward(*passages(texts))["score"].round(9) if len(texts) else np.zeros(0)


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-5, seed: int = 1) -> Model:
    """Adam on the logistic loss; ``bags`` has the passage features of each labelled document."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    n = every.shape[1]
    layers = {"encode": (n, ENCODING), "encode_bias": (ENCODING,), "tanh": (ENCODING, GATE), "gate": (ENCODING, GATE), "attend": (GATE,), "score": (ENCODING,), "score_bias": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape) if "bias" not in k else np.zeros(shape) for k, shape in layers.items()}
    model = Model(every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64) + 1e-3, weights)
    first, second, step = {k: np.zeros(s) for k, s in layers.items()}, {k: np.zeros(s) for k, s in layers.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            gradients = model.gradients(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), labels[some], decay)
            step += 1
            for k, g in gradients.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                speed = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[k] = weights[k] - speed * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on a sample of the labelled documents; only the features of their passages reach the driver."""
    one = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    total = one.count()
    chosen = one.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_003)) * max(total, 1) < sample * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bags = passages(batch.column(2))
            parts = np.split(x, np.cumsum(bags)[:-1]) if len(bags) else []
            spread = [p[np.unique(np.linspace(0, len(p) - 1, min(len(p), SAMPLE_PASSAGES)).astype(int))] for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in spread], pa.binary())], names=["doc_id", "quality", "bag"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id bigint, quality int, bag binary")
    # of an id that several rows have, one bag, so that the rows on the driver are as many as the ids chosen
    one_each = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bag").alias("bag"))
    found = one_each.toPandas().sort_values("doc_id")  # in an order that does not depend on tasks
    if not len(found):
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, len(CLASSES) + len(OF_WORDS)) for b in found["bag"]]
    return fit(bags, found["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(batch.column(1)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, with a model fitted on the other folds."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, with all columns, that score at least ``threshold``."""
    model = train(docs, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = model.score(pc.fill_null(batch.column(at), "")) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema) if model else docs.filter(F.lit(threshold <= 0.5))
