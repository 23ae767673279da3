"""SimHash near-dedup: fingerprints of whole texts, linked at few differing bits through BK-trees.

A fingerprint has one bit for each bit of the 64-bit hashes of a text's word shingles: the bit that over half of them
have. Fingerprints link at ``radius`` or fewer differing bits, and linked ones form components.

Search. Distinct fingerprints only take part, so exact copies cost nothing. Two of them within the radius agree in one
of ``radius + 1`` bands of bits; each band's value is the shard of a BK-tree, where a child's key is its Hamming distance
to the parent and a search follows keys within the radius of its own distance only. A shard of more than ``shard``
fingerprints is split by the same rule over the bits that its members may still differ in; after four such levels
members differ in 14 bits at most, so no shard can exceed 2^14 of them, however many near copies the table holds. Trees
stay in the task that holds their shard: the trees of all shards grow with the input and have no bound to broadcast under.

A shard reports its local components as trees of small degree, never as pairs, and components join up by rounds.

Null and empty texts have fingerprint zero, linked like any other. Texts of fewer words than a shingle are one shingle.
Repeated rows share a component. Null document ids take part but are never a component's id, unless it has no other.
Columns besides id and text are not read by ``fingerprints`` and ``near_copies``; ``dedup`` keeps them all.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stocklens.llm.common import components, join_hot, slices, unused, utf8, written

SEED = 42
BITS = 64
LEVELS = 4


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def band_masks(radius: int, levels: int = LEVELS) -> list[list[tuple[int, int]]]:
    """(parent's number, mask of equal bits) by level: each mask adds one of ``radius + 1`` parts of the other bits."""
    tree, parents = [], [(0, 0)]
    for _ in range(levels):
        level = []
        for number, (_, mask) in enumerate(parents):
            free = [b for b in range(BITS) if not mask >> b & 1]
            for part in np.array_split(free, radius + 1):
                level.append((number, mask | sum(1 << int(b) for b in part)))
        tree.append(level)
        parents = level
    return tree


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


class Tree:
    """A BK-tree whose nodes are numbered in the order of insertion."""

    def __init__(self, radius: int):
        self.radius, self.keys, self.children = radius, [], []

    def insert(self, key: int) -> list[int]:
        """Add a key and return the earlier nodes within the radius."""
        found, radius, number = [], self.radius, len(self.keys)
        if number:
            walk = [0]
            while walk:
                node = walk.pop()
                distance = (self.keys[node] ^ key).bit_count()
                if distance <= radius:
                    found.append(node)
                children = self.children[node]
                for edge in range(max(0, distance - radius), distance + radius + 1):
                    if edge in children:
                        walk.append(children[edge])
            node = 0
            while True:
                children, distance = self.children[node], (self.keys[node] ^ key).bit_count()
                if distance not in children:
                    children[distance] = number
                    break
                node = children[distance]
        self.keys.append(key)
        self.children.append({})
        return found


def shard_links(keys: list[int], radius: int, fan: int = 16) -> list[tuple[int, int]]:
    """Links of a shard's local components: each member with an earlier one, none with more than ``fan`` later ones."""
    tree, root = Tree(radius), list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for number, key in enumerate(keys):
        for other in tree.insert(key):
            a, b = find(number), find(other)
            root[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for number in range(len(keys)):
        members.setdefault(find(number), []).append(keys[number])
    return [(m[k], m[(k - 1) // fan]) for m in members.values() for k in range(1, len(m))]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in rows sorted by (number, value); a shard may go on in the next batch."""
    names = ["a", "b"]
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        starts = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) + 1
        held = rows[:, starts[-1] if len(starts) else 0 :]
        yield from _some_links(rows[:, : rows.shape[1] - held.shape[1]], radius, names)
    if held is not None:
        yield from _some_links(held, radius, names)


def _some_links(rows: np.ndarray, radius: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    if not rows.shape[1]:
        return
    starts = np.concatenate([[0], np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) + 1, [rows.shape[1]]])
    shards = np.flatnonzero(np.diff(starts) > 1)
    keys = rows[2]
    found = [x for s in shards for x in shard_links(keys[starts[s] : starts[s + 1]].view(np.uint64).tolist(), radius)]
    if found:
        pairs = np.array(found, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)


def links(distinct: DataFrame, radius: int = 2, shard: int = 256) -> DataFrame:
    """Links (a, b) that connect all fingerprints of a component; ``distinct`` has each fingerprint once, as fp."""
    found, rows = [], distinct.select("fp", F.lit(0).alias("number"))
    tree = band_masks(radius)
    for depth, level in enumerate(tree):
        children: dict[int, list[tuple[int, int]]] = {}
        for number, (parent, mask) in enumerate(level):
            children.setdefault(parent, []).append((number, signed(mask)))
        options: Column = F.array(*(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(m).alias("mask")) for n, m in children[p])) for p in sorted(children)))
        rows = rows.select("fp", F.explode(options[F.col("number")]).alias("band")).select(
            "fp", F.col("band.number").alias("number"), F.col("fp").bitwiseAND(F.col("band.mask")).alias("value")
        )
        small = rows
        if depth + 1 < len(tree):
            rows = written(rows, "bands")
            large = written(rows.groupBy("number", "value").count().filter(F.col("count") > shard).drop("count"), "large")
            small = rows.join(large, ["number", "value"], "left_anti")
            rows = rows.join(large, ["number", "value"], "left_semi").drop("value")
        ordered = small.select(F.col("number").cast("bigint"), "value", "fp").repartition("number", "value").sortWithinPartitions("number", "value", "fp")
        found.append(written(ordered.mapInArrow(lambda batches: _links(batches, radius), "a bigint, b bigint"), "links"))
        if depth + 1 < len(tree) and large.isEmpty():
            break
    joined = found[0]
    for more in found[1:]:
        joined = joined.unionByName(more)
    return joined.distinct()


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, label (the component's smallest fp) and component_id (its smallest id) of every document."""
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct, radius))
    labelled = written(
        distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled"
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = join_hot(labelled, smallest, "label").select("fp", "label", "component_id")
    return join_hot(marked, written(named, "named"), "fp").select("doc_id", "fp", "label", "component_id")


def dedup(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all columns: of the rows of the smallest id, one of the smallest fingerprint.

    A component without any id keeps one of its rows of the smallest fingerprint.
    """
    found = near_copies(docs, shingle, radius)
    kept_id, print_of, print_kept = unused(docs, "_kept", "_print", "_print_kept")
    of = F.pandas_udf(lambda texts: texts.map(lambda t: fingerprint(bytes(t), shingle)), "bigint")
    is_first = F.col("doc_id") == F.col("component_id")
    ids = found.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias("times"), F.max(is_first).alias("first"))
    kept = written(ids.filter("first"), "kept")
    # The ids to keep grow with the input, so they are never broadcast.
    one, several = (
        docs.join(kept.filter(which).select(kept_id).hint("merge"), F.col("doc_id") == F.col(kept_id), "left_semi") for which in ("times = 1", "times > 1")
    )
    # Rows that share an id are told apart by their fingerprints. Null-safe comparison keeps Spark from asking for
    # fingerprints that are not null below the join with the ids, which would compute them for all documents again and
    # make the two shuffles of the texts differ, of which one now serves both.
    firsts = found.filter(is_first).groupBy("label").agg(F.min("doc_id").alias(kept_id), F.min("fp").alias(print_kept)).drop("label")
    firsts = firsts.join(kept.filter("times > 1").select(kept_id).hint("merge"), kept_id, "left_semi")
    same = (F.col("doc_id") == F.col(kept_id)) & F.col(print_of).eqNullSafe(F.col(print_kept))
    several = several.withColumn(print_of, of(utf8("text"))).join(firsts.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", print_of]).drop(print_of)
    alone = found.filter("doc_id is null and component_id is null and fp = label").select(F.col("fp").alias(print_kept)).distinct()
    without = docs.filter("doc_id is null").withColumn(print_of, of(utf8("text"))).join(alone, F.col(print_of).eqNullSafe(F.col(print_kept)), "left_semi")
    return one.unionByName(several).unionByName(without.dropDuplicates([print_of]).drop(print_of))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return near_copies(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
