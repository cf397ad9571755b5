"""Token files: a corpus' ids in document order, coded block by block for decoding in parallel.

Texts are sorted by range of their ids and tokenised there; a task's ids are cut into blocks as they
come, and its counts by id go with them. One frequency table over all counts is shared by all blocks,
which are then coded each for itself (``rans``). A folder of token files holds ``table`` (one row) and
``blocks`` (one frame a row, with the number of its first id); Spark commits both, so lost executors
leave no half files, and any task can decode any block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder
from .rans import Decoder, Documents, Frame, Table, crc32_joined, encode_blocks, table_of
from .wordtokens import batch_tokenizer

END = 1
_INDEX = ("doc_id", "null", "start", "size")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Cutter:
    """Gathers documents' ids and gives them out in blocks, with the documents that reach into each."""

    def __init__(self, block: int) -> None:
        self.block, self.made, self.total = block, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.held = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        starts = self.total + np.append(0, np.cumsum(sizes)[:-1])
        self.docs += zip([d or 0 for d in doc_ids], [d is None for d in doc_ids], starts.tolist(), sizes.tolist(), strict=True)
        self.ids.append(ids)
        self.total += len(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._out(self.held // self.block)

    def rest(self) -> Iterator[tuple]:
        if self.held:
            yield from self._out(1)

    def _out(self, full: int) -> Iterator[tuple]:
        flat = np.concatenate(self.ids)
        starts = np.array([d[2] for d in self.docs])
        for k in range(full):
            part = flat[k * self.block : (k + 1) * self.block]
            low = self.made * self.block
            docs = self.docs[np.searchsorted(starts, low, side="right") - 1 : np.searchsorted(starts, low + len(part))]
            yield self.made, part, docs
            self.made += 1
        self.ids = [flat[full * self.block :]]
        self.held = len(self.ids[0])
        self.docs = self.docs[max(0, int(np.searchsorted(starts, self.made * self.block, side="right")) - 1) :] if self.held else []


def _numbers(values: list, kind: str) -> bytes:
    return np.array(values, kind).tobytes()


def token_blocks(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, block: int) -> DataFrame:
    """``part, block, n, ids, doc_id, null, start, size`` of each block of ids, in the order of the
    documents within the range ``part``; ``start`` counts from the range's first id. One row of each
    range with ``block`` -1 holds, in ``ids``, its counts by id."""
    names = ["part", "block", "n", "ids", *_INDEX]
    schema = "part int, block int, n long, ids binary, " + ", ".join(f"{c} binary" for c in _INDEX)
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens, cutter = TaskContext.get().partitionId(), batch_tokenizer(path), _Cutter(block)
        size = max(tokens.size, end_id + 1)
        counts, wide = np.zeros(size, np.int64), "<u2" if size <= 1 << 16 else "<u4"

        def row(found: tuple) -> tuple:
            number, ids, held = found
            return (part, number, len(ids), ids.astype(wide).tobytes(), *(_numbers([d[i] for d in held], k) for i, k in enumerate(("<i8", "u1", "<i8", "<i8"))))

        for batch in batches:
            # A few hundred texts at a time are Python objects, fewer where they are long.
            texts, at = batch.column(1), 0
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0))
            while at < len(batch):
                upto = min(len(batch), at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 2000]), 6_000_000))))
                ids, per = tokens.ids([t.as_py() and t.as_py().encode() for t in texts[at:upto]])
                ids, per = np.insert(ids, np.cumsum(per), end_id), per + 1
                counts += np.bincount(ids, minlength=size)
                rows = [row(b) for b in cutter.add(batch.column(0)[at:upto].to_pylist(), ids, per)]
                if rows:
                    yield rows_batch(rows)
                at = upto
        rows = [row(b) for b in cutter.rest()]
        if cutter.total:
            rows.append((part, -1, cutter.total, zlib.compress(counts.astype("<i8").tobytes(), 1), b"", b"", b"", b""))
            yield rows_batch(rows)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Ties of the id fall by the text: one id can't fill a range alone.
    keys = ["doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END,
    block: int = 65_536, lanes: int = 128, every: int = 256,
) -> None:
    """Writes the ids of all texts, each with ``end_id`` after it, in ascending order of the ids.

    Null texts are empty: one id. Rows of one id, copies among them, follow each other, in the order of a hash of
    their texts; null ids come first. An empty table gives a table and no blocks. Other columns are
    not read. A folder that exists is an error. What is sent to the driver is the table's counts (a number for each id of
    the vocabulary) and nothing of the corpus.
    """
    spark = docs.sparkSession
    path, tokens = path.rstrip("/"), tokenizer_path or default_path()
    if not (0 < block <= 1 << 24 and 0 < lanes <= 1 << 12 and every > 0):
        raise ValueError("blocks of 1 to 2**24 ids, 1 to 2**12 lanes and a positive distance of checkpoints")
    own = f"{shared_folder(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    found = token_blocks(docs, id_col, text_col, tokens, end_id, block)
    found.write.option("compression", "zstd").parquet(own)
    held = spark.read.schema(found.schema).parquet(own)
    ranges = held.where("block = -1")

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for c in batch.column(0):
                own_counts = np.frombuffer(zlib.decompress(c.as_py()), "<i8")
                total = own_counts.copy() if total is None else total + own_counts
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64()), pa.array(np.full(len(at), len(total)), pa.int64())], ["id", "n", "size"])

    counted = ranges.select("ids").mapInArrow(by_id, "id long, n long, size long").groupBy("id").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    rows = counted.collect()  # one row for each id of the vocabulary at most
    counts = np.zeros(rows[0]["size"] if rows else 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    table = table_of(counts)
    spark.createDataFrame([(table.scale, bytearray(table.freq.astype("<u4").tobytes()), table.crc, int(counts.sum()))], "scale int, freq binary, crc long, n long").coalesce(1).write.parquet(f"{path}/table")
    # One row for each range: its first id's number among all.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = ranges.select("part", "n").select(F.col("part").alias("p"), before.alias("first"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 32):
                group = batch.slice(at, 32).to_pydict()
                blocks, starts = [], []
                for k in range(len(group["n"])):
                    ids = np.frombuffer(group["ids"][k], "<u2" if len(group["ids"][k]) == 2 * group["n"][k] else "<u4").astype(np.uint32)
                    first = group["first"][k]
                    doc_id, null, start, size = (np.frombuffer(group[c][k], t) for c, t in zip(_INDEX, ("<i8", "u1", "<i8", "<i8"), strict=True))
                    blocks.append((ids, Documents(doc_id, null, start + first, size)))
                    starts.append(first + group["block"][k] * block)
                frames = encode_blocks(blocks, table, lanes, every)
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(group["n"], pa.int64()), pa.array(frames, pa.binary())], ["start", "n", "frame"])

    blocks = held.where("block >= 0").join(F.broadcast(firsts), F.col("part") == F.col("p")).drop("p", "part")
    blocks.select("block", "n", "ids", *_INDEX, "first").mapInArrow(code, "start long, n long, frame binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    """The shared frequency table of a folder, tested against its checksum."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/table").select("scale", "freq", "crc").collect()
    table = Table(np.frombuffer(bytes(rows[0]["freq"]), "<u4").astype(np.uint32), rows[0]["scale"])
    if len(rows) != 1 or table.crc != rows[0]["crc"]:
        raise ValueError("the frequency table's checksum is wrong")
    return table


def _parts(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """What each block holds of each document: ``doc_id, start, size, at, n, crc`` (and ``ids``)."""
    table = read_table(spark, path)
    names = ["doc_id", "start", "size", "at", "n", "crc"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table)
        for batch in batches:
            for first in range(0, len(batch), 32):
                frames = [Frame(f.as_py(), decoder.crc) for f in batch.column(1).slice(first, 32)]
                columns: list[list] = [[] for _ in names]
                for low, f, ids in zip(batch.column(0).slice(first, 32).to_pylist(), frames, decoder.blocks(frames), strict=True):
                    data = memoryview(ids.astype("<u4").tobytes())
                    begin, end = np.maximum(f.docs.start - low, 0), np.minimum(f.docs.start + f.docs.size - low, f.n)
                    columns[0] += [None if null else d for d, null in zip(f.docs.doc_id.tolist(), f.docs.null.tolist(), strict=True)]
                    columns[1] += f.docs.start.tolist()
                    columns[2] += f.docs.size.tolist()
                    columns[3] += (begin + low - f.docs.start).tolist()
                    columns[4] += (end - begin).tolist()
                    columns[5] += [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                    if with_ids:
                        columns[6] += [ids[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    blocks = spark.read.schema("start long, n long, frame binary").parquet(f"{path.rstrip('/')}/blocks").select("start", "frame")
    return blocks.mapInArrow(run, "doc_id long, start long, size long, at long, n long, crc long" + (", ids array<int>" if with_ids else ""))


def _crc_of_parts(parts: list) -> int:
    """crc32 of a document from those of its parts: a few for each document that blocks cut."""
    out = 0
    for p in parts:
        out = crc32_joined(out, p["crc"], 4 * p["n"])
    return out


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the decoded files.

    ``start`` is the number of ids before the document, ``n_tokens`` counts its decoded ids, the end id
    among them. Only documents that blocks cut are gathered, by their parts' checksums. A wrong
    checksum is an error.
    """
    parts = _parts(spark, path, False)
    whole = parts.where("n = size").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut_ones = parts.where("n < size").groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return whole.unionByName(cut_ones.select("doc_id", "start", "n_tokens", F.udf(lambda parts: _crc_of_parts(parts), "long")("parts").alias("ids_crc32")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, decoded. A document's ids are one row."""
    parts = _parts(spark, path, True)
    grouped = parts.groupBy("start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return grouped.select("doc_id", "start", "n_tokens", F.flatten("parts.ids").alias("ids"))


def read_range(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """``start, ids`` of the stretches with the ids number ``first`` to ``stop - 1`` of all, in as many rows as
    there are segments. Only blocks that hold some are read, and only their segments between checkpoints decoded.
    An empty or outside range gives no rows."""
    table = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table)
        for batch in batches:
            for low, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = Frame(data.as_py(), decoder.crc)
                step = f.every * f.lanes
                ks = range(max(0, first - low) // step, -(-min(stop - low, f.n) // step))
                out = [(low + k * step, ids) for k, ids in zip(ks, decoder.segments([(f, k) for k in ks]), strict=True)]
                out = [(max(s, first), ids[max(0, first - s) : stop - s]) for s, ids in out]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int32()))], ["start", "ids"])

    blocks = spark.read.schema("start long, n long, frame binary").parquet(f"{path.rstrip('/')}/blocks")
    return blocks.where((F.col("start") < stop) & (F.col("start") + F.col("n") > first) & F.lit(first < stop)).select("start", "frame").mapInArrow(run, "start long, ids array<int>")


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Writes token files of ``docs`` in the shared folder, reads them back and tells each document."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return document_digests(spark, path)
