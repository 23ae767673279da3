"""Helpers that the operators share: text bytes, two-generation caches, folders every executor can read."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but these bytes; ``bytes.split`` and this class agree.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that are longer are not kept in a ``Memo``.
LONGEST_KEY = 128


class Memo(dict):
    """A function's results by argument, bounded to two generations of ``size`` entries.

    ``map(memo.__getitem__, keys)`` runs without a Python frame for every known key. Entries in use outlive a change of
    generation, because a lookup in the older one copies the entry to the newer.
    """

    def __init__(self, function: Callable, size: int = 400_000):
        super().__init__()
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self.store(key, value)
        return value

    def store(self, key, value) -> None:
        if isinstance(key, (str, bytes)) and len(key) > LONGEST_KEY:
            return  # long pieces are rarely met again, and would make the bound on entries no bound on bytes
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def short_batches(spark: SparkSession, rows: int = 500) -> SparkSession:
    """Let Spark hand documents to Python in shorter batches, unless the session says how many.

    Ten thousand documents, the default, are tens of megabytes in the JVM and again in Python, for every running task.
    """
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(rows))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``; local sessions may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = "file://" + tempfile.mkdtemp(prefix="stocklens-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 250, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Shorter batches: at most ``rows`` rows and about ``size`` bytes, but one row at least.

    A worker process outlives its task; memory that Arrow holds but does not use goes back in between.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def together(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows or ``size`` bytes, put together from shorter ones or cut from longer ones."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, rows, size):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of non-null texts, the words of all texts as numbers of them, and where each text's begin (and end).

    Words are split at ASCII white space; white space at either end of a text gives an empty word.
    """
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return words.dictionary, words.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)])


def gather(offsets: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``values[offsets[i]:offsets[i + 1]]`` of all chosen i; with the end of each in the result."""
    starts = offsets[chosen]
    lengths = offsets[chosen + 1] - starts
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return values[places], ends


def in_order(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of id and text, and sorted by both within each.

    The beginning of the text is part of the range, so that an id that many rows have, or null, fills many ranges.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), F.col(id_col), F.left(F.col(text_col), F.lit(64)))
    return dealt.sortWithinPartitions(id_col, text_col)


def utf8(column: str | Column) -> Column:
    """The bytes of a text, empty for null."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")).cast("binary")


def text(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(text(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")).cast("binary")) % 5 == 0


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", parts: int = 256) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique, when one key may hold a large share of ``left``.

    Keys that hold more than 1/``parts`` of the rows of ``left`` are fewer than ``parts``, so their rows of ``right`` are
    broadcast; all others take an ordinary join. ``left`` is read three times and should be a table.
    """
    total = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * parts > total).select(key, F.lit(True).alias("_hot"))
    tagged = left.join(F.broadcast(hot), key, "left")
    few = F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi"))
    return (
        tagged.filter("_hot").drop("_hot").join(few, key, how)
        .unionByName(tagged.filter("_hot is null").drop("_hot").join(right, key, how))
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): node and label, the smallest node reachable from it.

    Each round gives every node the smallest label of itself and its neighbours and then that label's own label, so the
    rounds grow with the logarithm of the longest way, not with the way. Every round is a written table.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        lower = written(labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label")), "labels")
        roots = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = written(join_hot(lower, roots, "label").select("node", F.least("label", "root").alias("label")), "labels")
        changed = jumped.withColumnRenamed("label", "now").join(labels, "node").filter("now <> label").limit(1).count()
        labels = jumped
        if not changed:
            return labels
