"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white space characters, as a regex class body.
SPACE = " \\t\\n\\x0B\\f\\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, as in tests on one machine, a temporary folder takes its place.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Later steps start from that table: they survive lost executors, nothing is computed twice, and
    the planner knows the true size.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and no later step reads, and the shuffle files of ended steps with them:
    Spark removes those when the driver's garbage is collected, which a small job may never come to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(unquote(folder))
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that the table doesn't have, in any case: each with as many
    underscores more as that takes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_column(text: Column) -> Column:
    """The maximal runs of non-space characters of a text, as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def row_key(doc_id: Column, text: Column) -> Column:
    """What identifies a row: its id and a digest of its text. Rows equal in both are copies."""
    return F.struct(doc_id.alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))


def merge_spans(spans: Column) -> Column:
    """Sorted array of ``(start, end)`` with overlapping and touching ones merged."""
    last = lambda seen: F.get(seen, F.size(seen) - 1)

    def step(seen: Column, x: Column) -> Column:
        grown = F.struct(last(seen)["start"].alias("start"), F.greatest(last(seen)["end"], x["end"]).alias("end"))
        apart = F.size(seen) == 0
        return (
            F.when(apart | F.coalesce(last(seen)["end"] < x["start"], F.lit(True)), F.concat(seen, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))))
            .otherwise(F.concat(F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))), F.array(grown)))
        )

    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def spread(left: DataFrame, right: DataFrame, key: str, n: str, total: int, row: list[str], hot_share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equality join on ``key``, with hot keys dealt over many tasks by ``salt``.

    ``right`` has one row for each key and, in ``n``, the key's number of rows on the left. Keys with
    a ``hot_share``-th of all ``total`` rows or more are hot: there are ``hot_share`` of them at most,
    whatever the data, so their list is broadcast. Left rows of a hot key get a salt from a hash of
    ``row``; its right row is there once for each salt. Join on ``key`` and ``salt``.
    """
    salts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.col(n) * hot_share >= max(total, hot_share)
    keys = right.where(hot).select(F.col(key).alias("__hot"))
    salted = left.join(F.broadcast(keys), F.col(key) == F.col("__hot"), "left")
    salted = salted.withColumn("salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*row), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    each = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted, right.withColumn("salt", F.explode(each))


# -- vectorised work inside tasks ------------------------------------------------------------

#: Multiplier of the rolling hash. Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(_INVERSE, n)
        return self


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), vectorised."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for many ranges, from one running sum.

    Equal contents give equal hashes wherever they stand.
    """
    p = POWERS.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p.up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * p.down[starts] + (ends - starts).astype(np.uint64))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def byte_words(data: np.ndarray, is_space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array: the maximal runs of other than ``is_space``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_space[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array with a line feed after each, and each one's start (and the end)."""
    texts = [t or b"" for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), starts


def chunks(texts: list[bytes | None], most_bytes: int = 4_000_000):
    """Runs of consecutive texts with about ``most_bytes`` together, as (first index, texts)."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"") + 1
        if held >= most_bytes:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]
