"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a digest of their ids and queue up, if need be several times over. A copy's
virtual finish time is the words of its source up to its end, divided by the source's target; copies are taken in the
order of finish times until the total budget is used up, the last one in part. So all sources run out of their targets
at the same time, each within a document of it.

Targets share the budget by weight; a source's target stops at ``copies`` times its size, and what it cannot use is
shared again by weight until none is above.

Running sums are distributed: documents are cut into many ranges of the shuffle order and ranges are summed up first, so
no task holds a whole source, however large. Only ids, sources and sizes are shuffled, never texts.

Null and empty texts have size zero and nothing is taken of them. A null source is a source of its own, the last one.
Null ids are shuffled as the empty text. Repeated rows are documents of their own. An empty table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.llm.common import WORD, partitions, text, unused, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(column: str) -> Column:
    return F.regexp_count(text(column), F.lit(WORD)).cast("bigint")


def shuffled(id_col: str, seed: str = "mix") -> Column:
    """The digest that orders a source's documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), text(F.col(id_col).cast("string"))).cast("binary"))


def targets(sizes: DataFrame, share: float = 1.5, copies: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, place (from 0), weight and target of every source; ``sizes`` has source and source_size.

    One row per source: with sources ordered by the weight unit at which each is full, the level at which the rest of
    the budget meets the rest of the weights is a running sum.
    """
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = (
        placed.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.col("source_size") * F.lit(copies))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    )
    earlier = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("full_at", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    levels = filled.withColumn("level", level).withColumn("full", F.col("full_at") <= F.col("level"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(final * F.col("weight"))
    return levels.withColumn("target", target).select("source", "source_size", "place", "weight", "target")


@dataclass
class Cut:
    """The last copy taken, by its place in the order of all copies, and the words taken of it."""

    key: tuple
    words: int


KEY = ["finish", "place", "shuffle", "id_text", "size", "copy"]


def _copies(queued: DataFrame, copies: int) -> DataFrame:
    number = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    return queued.select("*", number).withColumn("finish", _finish(F.col("copy")))


def _finish(copy: Column) -> Column:
    return F.when(F.col("target") > 0, (F.col("source_size") * copy + F.col("upto")).cast("double") / F.col("target"))


def _cut(queued: DataFrame, budget: int, copies: int, steps: int) -> Cut | None:
    """Find the copy at which the budget ends: sums of ranges of finish times, then a running sum over one range."""
    dealt = _copies(queued, copies).filter("size > 0 and finish is not null")
    dealt = dealt.withColumn("range", F.least(F.floor(F.col("finish") * steps), F.lit(2 * steps)).cast("bigint"))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("words"))
    upto = sums.withColumn("upto_range", F.sum("words").over(Window.orderBy("range")))
    at = upto.filter(F.col("upto_range") >= budget).orderBy("range").limit(1).collect()
    if not at:
        return None
    left = budget - (at[0]["upto_range"] - at[0]["words"])
    order = Window.orderBy(*KEY)
    inside = dealt.filter(F.col("range") == at[0]["range"]).select(*KEY).withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.filter(F.col("sum") >= left).orderBy("sum").limit(1).collect()[0]
    return Cut(tuple(last[k] for k in KEY), left - (last["sum"] - last["size"]))


def mix(docs: DataFrame, share: float = 1.5, copies: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, copies counted) of every document."""
    spark = docs.sparkSession
    steps = 4 * partitions(spark)
    cell = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("bigint") * steps / (1 << 32)).cast("int")
    sized = written(
        docs.select("doc_id", text(F.col("doc_id").cast("string")).alias("id_text"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), shuffled("doc_id").alias("shuffle"))
        .withColumn("cell", cell),
        "sized",
    )
    cells = written(sized.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), share, copies, weights)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("before", before).drop("words").alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("place", "c.source", "cell", "before", "source_size", "target")
    inner = Window.partitionBy("source", "cell").orderBy("shuffle", "id_text", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = written(
        sized.withColumn("within", F.sum("size").over(inner)).alias("d")
        .join(placed.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.cell") == F.col("p.cell")))
        .select("doc_id", "id_text", "d.source", "size", "shuffle", "place", "source_size", "target", (F.col("before") + F.col("within")).alias("upto")),
        "queued",
    )
    total = cells.agg(F.sum("words").alias("n")).first()["n"] or 0
    cut = _cut(queued, int(total * share), copies, steps)

    def taken(number: int) -> Column:
        whole = F.when(_finish(F.lit(number)).isNull(), 0).otherwise(F.col("size"))
        if cut is None:
            return whole
        here = F.struct(_finish(F.lit(number)).alias("finish"), "place", "shuffle", "id_text", "size", F.lit(number).alias("copy"))
        kinds = {"finish": "double", "size": "bigint"}
        there = F.struct(*(F.lit(v).cast(kinds.get(k, "string" if isinstance(v, str) else "int")).alias(k) for k, v in zip(KEY, cut.key, strict=True)))
        return F.when(_finish(F.lit(number)).isNull(), 0).when(here < there, F.col("size")).when(here == there, cut.words).otherwise(0)

    sums = sum((taken(n) for n in range(1, copies)), taken(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", sums.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, with all columns: each as often as it was taken whole, a last part of half or more included.

    Rows without id are not told apart by an id: they are taken as often as all of them are on average, rounded.
    """
    id_of, times, copy = unused(docs, "_id", "_times", "_copy")
    share = F.sum(F.col("taken") / F.col("size")) / F.count("*")
    taken = mix(docs, **settings).filter("size > 0").groupBy(F.col("doc_id").alias(id_of)).agg(F.round(share).cast("int").alias(times))
    joined = docs.join(taken.filter(F.col(times) > 0).hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_of))).filter(word_count("text") > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id_text, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST(place % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2 * source_size AS most,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget FROM s
), l AS (
  SELECT *, most / weight AS full_at,
    (budget - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, place, source_size, budget,
    CASE WHEN full_at <= level THEN most ELSE max(CASE WHEN full_at > level THEN level END) OVER () * weight END AS target FROM l
), q AS (
  SELECT d.*, t.place, t.source_size, t.target, t.budget,
    sum(d.size) OVER (PARTITION BY t.place ORDER BY d.shuffle, d.id_text, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (source_size * copy + CAST(upto AS DOUBLE)) / target AS finish FROM q, (VALUES (0), (1)) AS n(copy) WHERE target > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, shuffle, id_text, size, copy ROWS UNBOUNDED PRECEDING) AS total FROM c
), k AS (
  SELECT shuffle, id_text, place, size, upto,
    CAST(sum(greatest(0, least(size, floor(budget) - (total - size)))) AS BIGINT) AS taken
  FROM r GROUP BY ALL
)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k ON q.shuffle = k.shuffle AND q.id_text = k.id_text AND q.place = k.place AND q.size = k.size AND q.upto = k.upto
"""
