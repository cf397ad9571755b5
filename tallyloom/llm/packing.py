"""Best-fit packing: bounded-space online best-fit over documents' token pieces.

Tasks tokenise whole texts. Full pieces are sequences of their own. The rest is dealt by its place in
the written table into even groups, and each group is packed online, piece by piece as they come: a
fixed number of open bins in a bitset keyed by free space, the tightest bin that fits takes the
piece, and when all bins are open and none fits, the fullest is closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokenizing import default_path, tokenizer

END = 0


class OpenBins:
    """Bins by free space; ``bits`` has bit f set while some open bin has f tokens free."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        level = self.levels[free]
        bin_no = level.pop()
        if not level:
            self.bits ^= 1 << free
        return bin_no

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of at most ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, bin_no = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            if not self.levels[left]:
                self.bits |= 1 << left
            self.levels[left].append(bin_no)
        else:
            self.open -= 1
        return bin_no, self.capacity - free


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    tokenizer_path: str | None = None, keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each document's pieces.

    A document is its text's ids and then id 0; null and empty texts are that one id. Only longer
    documents are cut, into pieces of ``capacity`` ids, the first of which may be shorter.
    """
    path = tokenizer_path or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([END], "<u4"))
                first = len(ids) % capacity or min(capacity, len(ids))
                ends = range(first, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = 0 if k == 0 else end - capacity
                    part = ids[start:end]
                    for column, value in zip(rows, (doc_id, k, start, end - start, zlib.crc32(part.tobytes()), part), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names[: len(types)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None,
    keep_ids: bool = False, most_open: int = 64, pieces_per_group: int = 25_000,
) -> DataFrame:
    """Each document's pieces with ``sequence_id`` and ``offset``: their place in packed sequences.

    At most ``most_open`` sequences of a group are open at a time. No sequence holds more than ``capacity`` tokens and its pieces follow each other without gaps
    from 0. Null and empty texts are one token. Repeated rows, also of one id, are packed one by
    one; null ids stay null. An empty table gives no sequences; other columns are not read.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, tokenizer_path, keep_ids))
    rest = pieces.where(F.col("length") < capacity)
    groups = -(-rest.count() // pieces_per_group) or 1
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A row's place in the written table: the same on every reading, and another for each copy.
    rest = rest.withColumn("arrival", F.monotonically_increasing_id())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, group, bins = TaskContext.get().partitionId() << 40, None, None
        for batch in batches:
            places = []
            for g, length in zip(batch["group"].tolist(), batch["length"].tolist(), strict=True):
                if g != group:
                    first, group, bins = first + (bins.made if bins else 0), g, OpenBins(capacity, most_open)
                bin_no, offset = bins.place(length)
                places.append((first + bin_no, offset))
            yield batch.drop(columns=["group", "arrival"]).assign(sequence_id=[s for s, _ in places], offset=[o for _, o in places])

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("arrival"), F.lit(groups)))
    dealt = dealt.repartition(tasks, "group").sortWithinPartitions("group", "arrival")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    packed = dealt.mapInPandas(pack, ", ".join([*fields, "sequence_id long", "offset long"]))
    full = pieces.where(F.col("length") >= capacity)
    full = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences: ``sequence_id, n_tokens, ids, doc_ids``, pieces in their order.

    A sequence has ``capacity`` tokens at most, so its row is bounded. Null texts, copies and empty
    tables are as in ``pack_documents``.
    """
    placed = pack_documents(docs, keep_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return grouped.select("sequence_id", "n_tokens", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
