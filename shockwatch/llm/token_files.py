"""Token ids as Arrow IPC files of fixed-size-list batches: written, read back, and opened at random.

A file holds a part of the corpus, in ascending doc_id order, as equal-length sequences: record batches
with a fixed-size list of ids (uint16 where every id of the vocabulary fits, else uint32) and one of masks
(uint8, 1 for a token, 0 for the padding of the last sequence). Documents follow one another without gaps; a second file beside it names them (doc_id,
start in the file, length). As all values of a batch lie in one aligned buffer, a memory map gives any
sequence as a view (``Sequences``), without a copy and without reading the others.

Ranges of doc_id, cut at quantiles of the id column alone, become one task each; an id so frequent that
several cuts fall on it is spread over their ranges by checksum. Texts are encoded before the shuffle,
ids sorted within their range and streamed to files of about FILE_TOKENS. Files get names of their own
per attempt and are moved into place when complete; only the stored list of finished tasks counts, and
starts are summed up from it, so a lost executor leaves neither gaps nor double documents.

Defined cases: a null text is empty and has the end id only; null ids come first; rows with equal ids
stand in order of the stored ids' checksum, then bytes, and repeated rows each count; a document of any length stays in
one file, over as many batches as it needs; an empty table writes no file and gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shockwatch.session import run_dir

from .common import buckets_for, store, text_of
from .packing import WordIds
from .tokens import by_bytes

LENGTH, BATCH = 2048, 256
FILE_TOKENS, FILE_DOCS, INDEX_ROWS = 16 << 20, 1 << 20, 1 << 16
FIRST = -(1 << 63)
GROUP = 1024
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The narrowest of two and four bytes that holds every id."""
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(max(ids, default=0), end_id) < 1 << 16 else "<u4"


def layout(length: int, kind: str) -> pa.Schema:
    ids = pa.from_numpy_dtype(np.dtype(kind))
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.uint8(), length))])


class StoredIds(WordIds):
    """Token ids of texts in the width of the files; line ends part words as spaces do."""

    def __init__(self, path: str, kind: str):
        self.narrow = kind == "<u2"
        super().__init__(path)

    def stored(self, ids: bytes) -> bytes:
        return memoryview(ids).cast("H")[::2].tobytes() if self.narrow else ids

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        return map(self.stored, super().encoded(texts))

    def run(self, letters: str) -> bytes:
        return self.stored(super().run(letters))

    def batch(self, texts: list[str]) -> list[bytes]:
        return super().batch([text.replace("\n", " ") for text in texts] if self.by_word else texts)


@lru_cache(maxsize=1)
def stored_ids(path: str, kind: str) -> StoredIds:
    """One per Python worker, as in ``packing.word_ids``."""
    return StoredIds(path, kind)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, cuts: np.ndarray, kind: str) -> DataFrame:
    """Every document's ids, end id included, with the range it belongs to."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = stored_ids(tokenizer_path, kind), np.asarray([end_id], kind).tobytes()
        for batch in batches:
            at = 0
            for texts in by_bytes(batch.column("text").to_pylist()):
                ids = [packed + end for packed in words.batch(texts)]
                keys = batch.column("doc_id").slice(at, len(ids))
                order = keys.fill_null(FIRST).to_numpy()
                tie = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
                low, high = np.searchsorted(cuts, order, "left"), np.searchsorted(cuts, order, "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low + (tie * (high - low + 1) >> 32), pa.int32()), keys, pa.array(tie), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "tie", "ids"])
                at += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text")).mapInArrow(
        encode, "part int, doc_id long, tie long, ids binary")


class TokenFile:
    """One pair of files in the making."""

    def __init__(self, folder: str, length: int, kind: str):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.name, self.length = uuid.uuid4().hex, length
        self.paths = {f"{path}/.{self.name}.{kind}.open": f"{path}/{self.name}.{kind}" for kind in ("arrow", "docs")}
        self.files.create_dir(path, recursive=True)
        self.sinks = [self.files.open_output_stream(p, compression=None) for p in self.paths]
        self.ids, self.docs = (ipc.new_file(s, schema) for s, schema in zip(
            self.sinks, (layout(length, kind), INDEX), strict=True))
        self.held, self.used, self.kind = np.zeros(BATCH * length, kind), 0, kind
        self.index: list[tuple] = []
        self.tokens = self.documents = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.tokens, len(ids)))
        if len(self.index) == INDEX_ROWS:
            self.flush_index()
        self.tokens += len(ids)
        self.documents += 1
        while len(ids):
            taken = min(len(ids), len(self.held) - self.used)
            self.held[self.used:self.used + taken] = ids[:taken]
            self.used, ids = self.used + taken, ids[taken:]
            if self.used == len(self.held):
                self.flush()

    def flush(self) -> None:
        size = -(-self.used // self.length) * self.length
        self.held[self.used:size] = 0
        columns = (self.held[:size], (np.arange(size) < self.used).astype(np.uint8))
        self.ids.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in columns], schema=layout(self.length, self.kind)))
        self.used = 0

    def flush_index(self) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*self.index, strict=True)], schema=INDEX))
        self.index = []

    def close(self, part: int, number: int) -> pa.RecordBatch:
        if self.used:
            self.flush()
        if self.index:
            self.flush_index()
        for writer in (self.ids, self.docs, *self.sinks):
            writer.close()
        for made, name in self.paths.items():
            self.files.move(made, name)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "name": [self.name],
            "documents": [self.documents], "tokens": [self.tokens]})


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Write the corpus below ``folder``; the stored list of files, with the first position of each.

    part, number, name, documents, tokens, first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    width = max(buckets_for(docs.count()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / width for i in range(1, width)]
    kind = id_type(tokenizer_path, end_id)
    found = docs.agg(F.percentile_approx(key, shares, 20 * width).alias("cuts")).first()["cuts"] if shares else None

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, part, number = None, None, 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id")), batch.column("ids"), strict=True)
            for own, doc_id, ids in rows:
                if open_file and (own != part or open_file.tokens >= FILE_TOKENS or open_file.documents >= FILE_DOCS):
                    yield open_file.close(part, number)
                    open_file, number = None, number + 1 if own == part else 0
                if open_file is None:
                    open_file, part = TokenFile(folder, length, kind), own
                open_file.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
        if open_file:
            yield open_file.close(part, number)

    ranged = encoded(docs, tokenizer_path, end_id, np.array(found or [], np.int64), kind).repartitionById(width, "part")
    files = store(ranged.sortWithinPartitions("part", "doc_id", "tie", "ids").select("part", "doc_id", "ids").mapInArrow(
        save, "part int, number int, name string, documents long, tokens long"), "ids-files")
    return store(with_first(files), "ids-starts")


def with_first(files: DataFrame) -> DataFrame:
    """Tokens before each file: summed inside groups of parts, and over the groups."""
    def before(*keys: str) -> Window:
        return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(window: Window) -> F.Column:
        return F.coalesce(F.sum("tokens").over(window), F.lit(0))

    group = F.expr(f"part div {GROUP}")
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).withColumn("_group", group)
    groups = parts.groupBy("_group").agg(F.sum("tokens").alias("tokens")).select(
        "_group", sum_before(before("_group")).alias("_groups_before"))
    parts = parts.select("part", "_group", sum_before(before("_group", "part")).alias("_parts_before"))
    return files.withColumn("_before", sum_before(before("part", "number"))).join(parts, "part").join(groups, "_group").select(
        *files.columns, (F.col("_before") + F.col("_parts_before") + F.col("_groups_before")).alias("first"))


def documents(folder: str, name: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The index of a file, batch by batch, with the checksum of every document's ids."""
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{name}.arrow") as source, files.open_input_file(f"{path}/{name}.docs") as index:
        reader, named = ipc.open_file(source), ipc.open_file(index)
        at, held = 0, memoryview(b"")
        for number in range(named.num_record_batches):
            rows, sums = named.get_batch(number), []
            for length in rows.column("length").to_pylist():
                left, found = 4 * length, 0
                while left:
                    if not held:
                        batch = reader.get_batch(at)
                        ids, mask = (batch.column(c).flatten().to_numpy() for c in ("ids", "mask"))
                        tokens = int(mask.sum())
                        if not mask[:tokens].all() or at + 1 < reader.num_record_batches and tokens < len(mask):
                            raise ValueError(f"{name}: a mask with gaps in batch {at}")
                        held, at = memoryview(ids[:tokens].astype("<u4")).cast("B"), at + 1
                    taken = min(left, len(held))
                    found = zlib.crc32(held[:taken], found)
                    held, left = held[taken:], left - taken
                sums.append(found)
            yield rows, sums
        if held or at < reader.num_record_batches:
            raise ValueError(f"{name}: ids that belong to no document")


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the listed files."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for rows, sums in documents(folder, name):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), pa.array(rows.column("start").to_numpy() + first), rows.column("length"),
                         pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("name", "first").repartition(width).mapInArrow(
        load, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Sequences:
    """The sequences of local files by number, as views of the memory maps."""

    def __init__(self, paths: list[str]):
        self.readers = [ipc.open_file(pa.memory_map(path)) for path in paths]
        sizes = [(r.num_record_batches - 1) * BATCH + r.get_batch(r.num_record_batches - 1).num_rows for r in self.readers]
        self.ends = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence."""
        if not 0 <= number < len(self):
            raise IndexError(number)
        file = int(np.searchsorted(self.ends, number, "right"))
        inside = number - (int(self.ends[file - 1]) if file else 0)
        batch = self.readers[file].get_batch(inside // BATCH)
        length, row = batch.schema.field("ids").type.list_size, inside % BATCH
        ids, mask = (batch.column(c).flatten().to_numpy()[row * length:(row + 1) * length] for c in ("ids", "mask"))
        return ids, mask


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Write all documents to the shared folder and report what the files hold, a row per document."""
    spark = docs.sparkSession
    folder = f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read(spark, write(docs, folder, tokenizer_path, end_id, length), folder)
