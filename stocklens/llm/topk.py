"""Exact top-k search by inner product, term at a time.

Vectors become sparse rows of whole numbers, floor(scale * x). Queries and candidates are dealt into groups, and every
group of queries meets every group of candidates in one cell of a grid. The cells are the partitions of one shuffle: no
side is joined or broadcast, so nothing but two counts reaches the driver, whatever the size.

A task streams the candidates of a cell past its queries, both in blocks of bounded size. A block of candidates is kept
as postings: for each dimension (term) the rows with a non-zero weight and those weights. For every term of its rows, a
block of queries scatters query weight times posting weights into a dense array of scores; partition selection takes each
query's best of the block, and the bests of all blocks are merged. Every score is computed: nothing is skipped, and no
pair but the k best of a block leaves a task. Scores are numbers of 64 bits, or of 32 where none can need more.

Vectors that are null, empty, or hold a null or non-finite component take no part, neither as query nor as candidate;
nor do rows without id. Shorter vectors count as zero in the missing dimensions. Ties go to the smaller id. Repeated ids
are rows of their own: each row of an id that asks gets its own results (ranked together under that id, row by row), and
no row of the same id is its candidate. Weights must fit 32 bits. Columns but id and vector are not read.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stocklens.llm.common import partitions, written

#: Rows of a block of queries and of one of candidates (up to half more at the end of a cell): the score array of a task
#: has their product, and twice that fits a core's cache.
QUERY_ROWS, CANDIDATE_ROWS = 64, 4096

#: Blocks of queries in a cell, which a task holds at once, and pairs of blocks that meet in it, which are its work.
CELL_QUERIES, CELL_PAIRS = 128, 512

#: Partitions at most; beyond that, several cells follow each other in one.
MOST_PARTS = 4096


def sparse(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and weights (array of bigint) of the vectors that take part."""
    parts = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & (F.size(parts) > 0) & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    weights = F.transform(parts, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), weights.alias("weights"))


def _grid(rows: DataFrame, query_blocks: int, candidate_blocks: int) -> DataFrame:
    """cell, asks, row, vec_id and weights: cell by cell the rows that ask, then the candidates by id.

    A row goes by the hash of its number, so that one id may have very many. Rows that ask are in the cells of their group
    with all groups of candidates, candidates in the cells of theirs with all groups of queries.
    """
    query_groups = -(-query_blocks // CELL_QUERIES)
    wanted = max(-(-candidate_blocks * -(-query_blocks // query_groups) // CELL_PAIRS), -(-partitions(rows.sparkSession) // query_groups))
    candidate_groups = min(candidate_blocks, wanted)

    def group(count: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    asking = rows.filter("asks").select(group(query_groups).alias("of"), every(candidate_groups).alias("meets"), F.lit(True).alias("asks"), "row", "vec_id", "weights")
    candidates = rows.select(every(query_groups).alias("of"), group(candidate_groups).alias("meets"), F.lit(False).alias("asks"), "row", "vec_id", "weights")
    both = asking.unionByName(candidates).select((F.col("of") * candidate_groups + F.col("meets")).alias("cell"), "asks", "row", "vec_id", "weights")
    dealt = both.repartitionById(min(query_groups * candidate_groups, MOST_PARTS), "cell")
    return dealt.sortWithinPartitions("cell", F.desc("asks"), "vec_id", "row")


def _matrix(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of the rows of one block, shorter vectors filled up with zeros."""
    weights = rows.column("weights")
    lengths = weights.value_lengths().to_numpy()
    out = np.zeros((len(lengths), lengths.max()), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = weights.flatten().to_numpy()
    return rows.column("vec_id").to_numpy(), out


def _meetings(batches: Iterator[pa.RecordBatch], query_rows: int, candidate_rows: int) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """The blocks of queries of a cell with each block of its candidates; batches may begin and end inside cells."""
    cell, asking, blocks, held = None, [], [], []

    def rest() -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
        if held:
            yield blocks, pa.concat_batches(held)

    for batch in batches:
        cells, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asks"))
        changes = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
        for start, end in pairwise([0, *changes.tolist(), len(cells)] if len(cells) else []):
            part = batch.slice(start, end - start)
            if cells[start] != cell:
                yield from rest()
                cell, asking, blocks, held = cells[start], [], [], []
            if asks[start]:
                asking.append(part)
                continue
            if asking:
                whole = pa.concat_batches(asking)
                asking, blocks = [], [whole.slice(at, query_rows) for at in range(0, whole.num_rows, query_rows)]
            if blocks:
                held.append(part)
            while sum(x.num_rows for x in held) * 2 >= 3 * candidate_rows:
                whole = pa.concat_batches(held)
                yield blocks, whole.slice(0, candidate_rows)
                held = [whole.slice(candidate_rows)]
    yield from rest()


def _postings(weights: np.ndarray, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the rows with a non-zero weight and those weights; if that is most rows, all weights without rows."""
    out = []
    for column in np.ascontiguousarray(weights.T, dtype=kind):
        rows = np.flatnonzero(column)
        out.append((None, column) if 2 * len(rows) >= len(column) else (rows, column[rows]))
    return out


def _largest(weights: np.ndarray) -> np.ndarray:
    """The largest size of a weight by term."""
    return np.maximum(weights.max(axis=0).astype(float), -weights.min(axis=0).astype(float))


def best_of_block(
    queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], k: int, kind: type = np.int64
) -> list[tuple[int, int, int, int]]:
    """(query row, query id, candidate id, score) of each query's k best, best first. ``ids`` ascend; ``kind`` holds all scores."""
    query_ids, query_weights = queries[0], queries[1].astype(kind)
    scores = np.zeros((len(query_ids), len(ids)), kind)
    products = np.empty_like(scores)
    for asked, (rows, posting) in zip(query_weights.T, postings, strict=False):
        if rows is None:
            scores += np.multiply(asked[:, None], posting, out=products)
        else:
            for q in np.flatnonzero(asked):
                scores[q, rows] += asked[q] * posting
    out = []
    firsts, ends = (np.searchsorted(ids, query_ids, side) for side in ("left", "right"))
    for q, asks in enumerate(query_ids.tolist()):
        others, values = ids, scores[q]
        if firsts[q] < ends[q]:
            others, values = (np.delete(x, slice(firsts[q], ends[q])) for x in (others, values))
        keep = np.arange(len(values))
        if len(values) > k:
            least = np.partition(values, len(values) - k)[len(values) - k]
            keep = np.flatnonzero(values >= least)
            above = values[keep] > least
            keep = np.concatenate([keep[above], keep[~above][:k]])
        order = keep[np.lexsort((others[keep], -values[keep]))][:k]
        out += [(q, asks, *best) for best in zip(others[order].tolist(), values[order].tolist(), strict=True)]
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every row where ``is_query`` holds."""
    usable = sparse(vectors, id_col, vector_col, scale)
    rows = written(usable.select("vec_id", "weights", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    n_candidates, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    # Every block of queries meets every block of candidates: the stated search is exhaustive.
    grid = _grid(rows, max(1, -(-n_queries // query_rows)), max(1, -(-n_candidates // candidate_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, queries = None, []
        for blocks, block in _meetings(batches, query_rows, candidate_rows):
            if blocks is not known:
                known, queries = blocks, [(x.column("row").to_numpy(), _matrix(x)) for x in blocks]
                large = _largest(_matrix(pa.concat_batches(blocks))[1])
            ids, weights = _matrix(block)
            terms = min(weights.shape[1], len(large))
            kind = np.int32 if large[:terms] @ _largest(weights)[:terms] < 2**30 else np.int64  # short numbers are faster
            postings = _postings(weights, kind)
            for numbers, asking in queries:
                if found := best_of_block(asking, ids, postings, k, kind):
                    at, *columns = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (numbers[at], *columns)], ["query_row", "query_id", "vec_id", "score"])

    bests = grid.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return bests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
