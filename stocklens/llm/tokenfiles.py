"""Token ids of documents in binary files of patched frame-of-reference blocks.

File format (little endian), one file for a run of documents in ascending id order::

    "SLTOKEN1" | n_docs u64 | n_ids u64 | size of the id blocks u64 | size of the length blocks u64
    id blocks | length blocks (ids of each document) | document ids i64 * n_docs | null flags u8 * n_docs
    index: starts of the id blocks u64 * ceil(n_ids / 1024), then of the length blocks u64 * ceil(n_docs / 1024)

Files are written and read through Arrow's file systems, so a folder may be on any store that it knows by its address. A
folder of files has a manifest, written by Spark, that lists the files of committed tasks in order; files of lost or
repeated attempts have other names, are in no manifest and are never read.

Null texts count as empty: such documents hold the end id only. Null document ids come first. Repeated ids each keep
their own entry; among them the order follows the text. Other columns are not read. An empty table gives no file.
"""

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stocklens.llm import pfor
from stocklens.llm.common import Memo, gather, in_order, partitions, split_words, text, together

MAGIC = b"SLTOKEN1"
HEAD = np.dtype([("magic", "S8"), ("docs", "<u8"), ("ids", "<u8"), ("id_bytes", "<u8"), ("length_bytes", "<u8")])
#: A file is closed at the end of the batch of documents that brings it to this many ids.
FILE_IDS = 4_000_000


#: Fixed value: how the vocabulary with word ends splits a lower-cased text into pieces (two Latin-1 spaces spelt out).
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x{85}\x{a0}\p{L}\p{N}]+)"

#: The same for words of ASCII characters, on character sets that match much faster.
PIECES_ASCII = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+)"


class WordEncoder:
    """Encodes with the ``tokenizers`` library and asks it about each distinct piece of text once.

    For tokenizers with word ends that drop white space and lower-case: a text's ids are those of its words between
    ASCII white space, and a word of Latin-1 characters has the ids of its lower-cased pieces. The library encodes many
    new pieces in one call; where a piece ends, its last token carries the word end. Any other word, and any word with a
    special token, goes to the library as it is. Words and pieces are split and numbered by Arrow.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = Memo(self.single, 350_000)
        self.others = Memo(self.single, 50_000)
        self.end = b"" if end_id is None else np.uint32(end_id).tobytes()
        special = (regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.other = "|".join([r"[^\x{00}-\x{ff}]", *special])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str], at_once: int = 1000) -> dict[str, bytes]:
        """Ids of new pieces."""
        groups, found = [new[k : k + at_once] for k in range(0, len(new), at_once)], {}
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            packed = ids.tobytes()
            found |= {piece: packed[start:end] for piece, start, end in zip(group, [0, *ends], ends, strict=False)}
        return found

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of distinct words."""
        other = pc.match_substring_regex(words, self.other)
        plain = pc.utf8_lower(pc.if_else(other, "", words))
        mixed = pc.invert(pc.utf8_is_alpha(plain))  # letters only are one piece
        for of_kind, pattern in ((pc.string_is_ascii(plain), PIECES_ASCII), (pc.invert(pc.string_is_ascii(plain)), PIECES)):
            chosen_words = pc.and_(mixed, of_kind)
            parts = pc.replace_substring_regex(plain.filter(chosen_words), pattern, r"\1 ")
            if pattern is PIECES:
                parts = pc.replace_substring_regex(parts, r"[\x{85}\x{a0}]", " ")
            plain = pc.replace_with_mask(plain, chosen_words, parts)
        split, chosen, borders = split_words(plain)
        distinct = split.to_pylist()
        fresh = self.learn([p for p in distinct if p and p not in self.pieces and p not in self.pieces.old])
        packed = [fresh[p] if p in fresh else self.pieces[p] if p else b"" for p in distinct]
        for item in fresh.items():
            self.pieces.store(*item)
        ids, ends = gather(*_runs(packed), chosen)
        offsets = np.concatenate([[0], ends])[borders]
        at = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        if not len(at):
            return offsets, ids
        extra_offsets, extra = _runs(list(map(self.others.__getitem__, words.take(pa.array(at)).to_pylist())))
        order = np.arange(len(words))
        order[at] = len(words) + np.arange(len(at))
        whole = np.concatenate([offsets, offsets[-1] + extra_offsets[1:]])
        ids, ends = gather(whole, np.concatenate([ids, extra]), order)
        return np.concatenate([[0], ends]), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        words, chosen, borders = split_words(texts)
        offsets, ids = self.encode_words(words)
        if self.end:
            offsets, ids = np.append(offsets, offsets[-1] + 1), np.append(ids, np.frombuffer(self.end, "<u4"))
            chosen = np.insert(chosen, borders[1:], len(words))
            borders = borders + np.arange(len(borders))
        ids, ends = gather(offsets, ids, chosen)
        return ids, np.diff(np.concatenate([[0], ends])[borders])


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int | None) -> WordEncoder:
    """One encoder for each worker process, so that tasks find the pieces of earlier tasks."""
    return WordEncoder(path, end_id)


def _runs(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]), np.frombuffer(b"".join(packed), "<u4")


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, share: float) -> bytes:
    blocks, starts = pfor.pack(ids, share)
    lengths, length_starts = pfor.pack(counts.astype(np.uint32), share)
    head = np.zeros(1, HEAD)
    head["magic"], head["docs"], head["ids"], head["id_bytes"], head["length_bytes"] = MAGIC, len(counts), len(ids), len(blocks), len(lengths)
    keys, nulls = np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(x.tobytes() for x in (head, blocks, lengths, keys, nulls, starts, length_starts))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each, and all ids."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[: HEAD.itemsize].view(HEAD)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a token file")
    docs, n_ids, at = int(head["docs"]), int(head["ids"]), HEAD.itemsize
    sizes = [int(head["id_bytes"]), int(head["length_bytes"]), 8 * docs, docs, 8 * -(-n_ids // pfor.BLOCK), 8 * -(-docs // pfor.BLOCK)]
    parts = []
    for size in sizes:
        parts.append(raw[at : at + size])
        at += size
    blocks, lengths, keys, nulls, starts, length_starts = parts
    ids = pfor.unpack(blocks, np.frombuffer(starts.tobytes(), "<u8"))
    counts = pfor.unpack(lengths, np.frombuffer(length_starts.tobytes(), "<u8")).astype(np.int64)
    doc_ids = [None if none else key for key, none in zip(np.frombuffer(keys.tobytes(), "<i8").tolist(), nulls.tolist(), strict=True)]
    return doc_ids, counts, ids


def write_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 1, share: float = 0.95,
    file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the files of ``docs`` below ``folder`` and return their manifest: part, number, path, n_docs, n_ids.

    Documents are dealt to tasks by ranges of their ids; each task sorts, encodes and writes its own range.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = word_encoder(tokenizer_path, end_id)
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        keys, counts, ids, held = [], [], [], 0

        def close():
            name = f"{part:06d}-{number:05d}-{uuid.uuid4().hex}.tokens"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(keys, np.concatenate(counts), np.concatenate(ids), share))
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": f"{folder}/{name}", "n_docs": len(keys), "n_ids": held}], schema=manifest)

        for batch in together(batches):
            some, each = encoder.encode(batch.column(1))
            keys += batch.column(0).to_pylist()
            counts.append(each)
            ids.append(some)
            held += len(some)
            if held >= file_ids:
                yield close()
                keys, counts, ids, held, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    files = in_order(rows).mapInArrow(run, "part int, number int, path string, n_docs bigint, n_ids bigint")
    files.write.parquet(f"{folder}/manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest")


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids (packed, 32 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = pafs.FileSystem.from_uri(path)
                with files.open_input_stream(name) as source:
                    keys, counts, ids = read_file(source.read())
                ends = np.cumsum(counts)
                data = ids.astype("<u4", copy=False).tobytes()
                for k in range(0, len(keys), 1000):
                    some = slice(k, k + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[some], pa.int64()),
                            pa.array(start + ends[some] - counts[some], pa.int64()),
                            pa.array(counts[some], pa.int64()),
                            pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends[some].tolist(), counts[some].tolist(), strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(partitions(spark), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """Write and read back: doc_id, start, n_tokens, ids_crc32."""
    manifest = write_files(docs, folder, tokenizer_path)
    read = read_files(docs.sparkSession, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
