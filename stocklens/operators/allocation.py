"""First come, first served allocation of limited stock, without running a group in one task.

Claims (carts, cart additions) arrive in order, each asks for some units of one or more items, and a claim is accepted
only when all its items still have enough left after the claims accepted before it. A rejected claim takes nothing, so
a running total alone does not answer it, and one item or report may carry a large share of all claims.

The claims are therefore settled in rounds over all items at once. In a round, a claim is

* rejected, if one of its items has too little left already, and then, among the others,
* accepted, if it fits even when every earlier open claim is accepted.

The earliest open claim always meets one of the two, and the outcome is exactly that of serving the claims one by one. An
item that has enough for all its open claims decides nothing any more, so its lines leave. What is still open hangs
together only through scarce items: claims and items are a graph whose connected components have no unit in common, so
each component is served in order by itself, and many at a time. A chain of claims that wait for each other is one such
component and needs no round per link. Rounds go on without labels as long as each leaves half of
the lines at most, since a label step moves every waiting line as a round does. Components of more than ``GROUP_LINES``
lines take a further round too, which cuts them, because every round takes claims, and with them items that have run out
or have enough, out of the graph (rounds are few in practice: Blelloch, Fineman and Shun, "Greedy sequential maximal independent set and matching are parallel on
average", 2012).

Components are found by labels: each claim takes the smallest label of the claims that it shares an item with, and then
that label's own label, so the steps grow with the logarithm of the longest chain. Totals and smallest labels of a hot
item are split as well: claims get a chunk number that grows with their order, values per (item, chunk) are made first,
and what is known of an item goes back to its lines by (item, chunk).
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.session import WorkTables

#: So many open lines, a few megabytes, may be served by one task.
GROUP_LINES = 100_000


def number_claims(claims: DataFrame, order: list[str], work: WorkTables, name: str, chunks: int | None = None) -> DataFrame:
    """``claims``, one row each, with ``claim_no``: a long that grows with ``order``; a table, so the numbers stay.

    The claims are cut into chunks, whose numbers are the high bits. Without a number of ``chunks``, AQE sizes them by
    their bytes; joined neighbours keep the order.
    """
    placed = claims.repartitionByRange(*([chunks] if chunks else []), *order).sortWithinPartitions(*order)
    return work.keep(placed.withColumn("claim_no", F.monotonically_increasing_id()), name)


def allocate(
    lines: DataFrame, capacity: DataFrame, chunks: int | None = None, group_lines: int = GROUP_LINES,
    work: WorkTables | None = None, numbered: bool = False,
) -> DataFrame:
    """Decide every claim; returns ``(claim, accepted)``.

    ``lines``: ``claim``, ``arrival`` (any sortable value, the same on all lines of a claim), ``item``, ``units``. A claim
    may name an item once. ``capacity``: ``item``, ``units``; an item that is missing there has nothing to give. With
    ``numbered``, claims are numbers of :func:`number_claims` and need no ``arrival``; others get such numbers for the
    rounds, which then move a long instead of names and times.

    The open lines of a round and all verdicts are tables in the shared folder; the lines of the round before are removed.
    """
    spark = lines.sparkSession
    work = work or WorkTables(spark, "allocation")
    stock = capacity.select("item", F.col("units").cast("bigint").alias("free"))
    order = [] if numbered else ["arrival"]
    asked = lines.select("claim", *order, "item", F.col("units").cast("bigint").alias("units"))
    names = None
    if not numbered:
        asked = work.keep(asked, "asked")
        if asked.count() > group_lines:
            claims = asked.filter("claim is not null").groupBy("claim").agg(F.min("arrival").alias("arrival"))
            names = number_claims(claims, ["arrival", "claim"], work, "names", chunks).drop("arrival")
            asked = asked.drop("arrival").join(names, "claim").select(F.col("claim_no").alias("claim"), "item", "units")
            order = []
    if not order:
        asked = asked.withColumn("chunk", F.shiftright("claim", 33).cast("int"))
    open_lines = work.keep(asked.join(stock, "item", "left").withColumn("free", F.coalesce("free", F.lit(0))), "open-0")
    work.remove("asked")
    decided = open_lines.select("claim", F.lit(None).cast("boolean").alias("accepted")).schema
    verdicts, step, before = "verdicts" if names is None else "numbered", 0, None
    while not order and (still_open := open_lines.count()) > group_lines:
        if still_open == before:
            raise ValueError("every claim needs a non-null id and units")
        before, step = still_open, step + 1
        hopeless = open_lines.filter(F.col("units") > F.col("free")).select("claim").distinct()
        hopeless = work.keep(hopeless.withColumn("accepted", F.lit(False)), f"{verdicts}/step={step}-hopeless")
        judged = work.keep(_judged(open_lines.join(hopeless, "claim", "left_anti")), f"judged-{step}")
        work.keep(judged.filter("accepted").select("claim", "accepted").distinct(), f"{verdicts}/step={step}")
        waiting = work.keep(_scarce(judged), f"waiting-{step}")
        work.remove(f"open-{step - 1}")
        work.remove(f"judged-{step}")
        # a round costs less than the labels, as long as it settles much
        if (left := waiting.count()) > group_lines and 2 * left > still_open:
            grouped = _components(waiting, work, f"labels-{step}")
            # fewer than lines / group_lines labels
            large = grouped.groupBy("label").count().filter(F.col("count") > group_lines).select("label", F.lit(True).alias("large"))
            grouped = work.keep(grouped.join(F.broadcast(large), "label", "left"), f"grouped-{step}")
            work.remove(f"labels-{step}")
            work.keep(_serve(grouped.filter("large is null").repartition("label")), f"{verdicts}/step={step}-groups")
            waiting = grouped.filter("large").drop("label", "large")
        open_lines = work.keep(waiting, f"open-{step}")
        work.remove(f"waiting-{step}")
        work.remove(f"grouped-{step}")
    work.keep(_serve(open_lines.withColumn("label", F.lit(0)).coalesce(1), *order), f"{verdicts}/step={step + 1}")
    found = spark.read.schema(decided).option("recursiveFileLookup", "true").parquet(f"{work.root}/{verdicts}")
    if names is None:
        return found
    named = work.keep(names.join(found.withColumnRenamed("claim", "claim_no"), "claim_no").select("claim", "accepted"), "verdicts")
    work.remove("names")
    work.remove(verdicts)
    return named


def _of_item(lines: DataFrame, **sums: Column) -> DataFrame:
    """``lines`` with aggregates over all lines of their item: by (item, chunk), then over the chunks of the item.

    An aggregate's name says how the chunks' values are put together: ``low`` is their least, any other their sum.
    """
    item = Window.partitionBy("item")
    parts = lines.groupBy("item", "chunk").agg(*(value.alias(name) for name, value in sums.items()))
    whole = parts.select("item", "chunk", *((F.min(n) if n == "low" else F.sum(n)).over(item).alias(n) for n in sums))
    return lines.repartition("item", "chunk").join(whole, ["item", "chunk"])


def _scarce(judged: DataFrame) -> DataFrame:
    """The waiting lines after a round, less those of items that have enough for all who wait."""
    taken = F.sum(F.when(F.col("accepted"), F.col("units")).otherwise(0))
    wanted = F.sum(F.when(F.col("accepted").isNull(), F.col("units")).otherwise(0))
    left = F.col("free") - F.col("taken")
    lines = _of_item(judged, taken=taken, wanted=wanted).filter(F.col("accepted").isNull() & ((F.col("wanted") > left) | F.col("units").isNull()))
    return lines.withColumn("free", left).drop("taken", "wanted", "accepted")


def _components(lines: DataFrame, work: WorkTables, name: str) -> DataFrame:
    """``lines`` with ``label``, the same for all claims that items connect; every step is a table."""
    labelled, step = work.keep(lines.withColumn("label", F.col("claim")), f"{name}/lines-0"), 0
    while True:
        near = _of_item(labelled, low=F.min("label")).groupBy("claim").agg(F.min("label").alias("label"), F.min("low").alias("low"))
        near = work.keep(near.select("claim", "label", "low"), f"{name}/near-{step}")
        # a label is the claim that gave it, and takes that claim's label
        roots = near.select(F.col("claim").alias("low"), F.col("low").alias("root"))
        jumped = near.join(roots, "low", "left").select("claim", F.least("low", "root").alias("to"), (F.col("low") < F.col("label")).alias("moved"))
        moved = work.keep(jumped, f"{name}/moved-{step}")
        if moved.filter("moved").isEmpty():
            return labelled
        following = work.keep(labelled.drop("label").join(moved.select("claim", F.col("to").alias("label")), "claim"), f"{name}/lines-{step + 1}")
        for old in (f"{name}/lines-{step}", f"{name}/near-{step}", f"{name}/moved-{step}"):
            work.remove(old)
        labelled, step = following, step + 1


def _judged(open_lines: DataFrame) -> DataFrame:
    """One round over claims that are not hopeless: the lines with ``accepted``, per claim true, or null when it must wait.

    The rows are partitioned by item and chunk on purpose: after a join on the item Spark would otherwise keep a hot
    item in one task.
    """
    lines = open_lines.repartition("item", "chunk")
    earlier_chunks = Window.partitionBy("item").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy("item", "chunk").orderBy("claim").rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        lines.groupBy("item", "chunk")
        .agg(F.sum("units").alias("chunk_units"))
        .withColumn("earlier_units", F.coalesce(F.sum("chunk_units").over(earlier_chunks), F.lit(0)))
        .select("item", "chunk", "earlier_units")
    )
    fits = F.col("units").isNotNull() & (F.col("earlier_units") + F.col("upto") <= F.col("free"))
    late = lines.withColumn("upto", F.sum("units").over(in_chunk)).join(earlier, ["item", "chunk"]).filter(~F.coalesce(fits, F.lit(False)))
    waiting = late.select("claim").distinct().withColumn("waits", F.lit(True))
    return open_lines.join(waiting, "claim", "left").withColumn("accepted", F.when(F.col("waits").isNull(), True)).drop("waits")


def _serve(lines: DataFrame, *order: str) -> DataFrame:
    """Serve the claims of each ``label`` one after the other, the labels of a partition one after the other as well.

    All lines of a label are in one partition. What is held at a time is the items of one label.
    """
    kind = lines.schema["claim"].dataType.simpleString()

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict = {}
        group, claim, wanted, out = None, None, {}, []

        def close() -> None:
            if wanted:
                fits = all(left[item] >= units for item, units in wanted.items())
                out.append((claim, fits))
                for item, units in wanted.items() if fits else ():
                    left[item] -= units

        for batch in batches:
            for label, name, item, units, free in zip(batch["label"], batch["claim"], batch["item"], batch["units"], batch["free"], strict=True):
                if name != claim or label != group:
                    close()
                    claim, wanted = name, {}
                if label != group:
                    group, left = label, {}
                left.setdefault(item, free)
                wanted[item] = units
            if out:
                yield pd.DataFrame(out, columns=["claim", "accepted"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["claim", "accepted"])

    ordered = lines.select("label", "claim", F.to_json(F.struct("item")).alias("item"), "units", "free", *order)
    return ordered.sortWithinPartitions("label", *order, "claim").drop(*order).mapInPandas(serve, f"claim {kind}, accepted boolean")
