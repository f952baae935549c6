"""Helpers that the operators share: checkpoint folder, fresh column names, text arrays."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LONG, STRING, BOOL, DOUBLE = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    """A struct type, made without a session (type strings need one)."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``); a temporary one where none is set and the master is local.

    On a cluster a folder of one machine is of no use to the others, so that a missing setting is an error there.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if given:
        if current is None:
            sc.setCheckpointDir(given)
        return given
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder at once, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (case ignored)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text; null becomes empty."""
    return [b if b is not None else b"" for b in texts.cast(pa.large_binary()).to_pylist()]


#: Rows and bytes of an Arrow batch; whole texts are long, and a task holds a batch on either side at once.
BATCH_ROWS, BATCH_BYTES = 400, 4 << 20
#: Bits of the sets that go to all tasks, at most: 16 MB as words of 64.
SET_BITS = 1 << 27


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have the session send at most ``rows`` rows and ``BATCH_BYTES`` bytes to Python at once; smaller settings stay.

    Plans are run after the call that makes them returns, so the settings can't be put back here.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


#: What tasks of an operator remember beyond their end, by the operator: how to drop it. And whose turn it is.
FORGET: dict[str, Callable[[], None]] = {}
_TURN = [""]


def turn(step: str) -> None:
    """Tasks call this at their start: where a Python worker did another step before, memory that is free or that other
    operators remember goes back to the machine. Workers are used again for the whole session, and all steps share them."""
    if _TURN[0] == step:
        return
    for name, forget in FORGET.items():
        if name != step:
            forget()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
    _TURN[0] = step


class Members:
    """A bit set of long values (hashes) that is broadcast: tells for sure what is no member, and else likely what is.

    It has 16 bits for each value, but no more than ``most``; beyond that it lets more through, never less. Joined by
    words of 64 bits, so that rows are tested by Spark's own expressions.
    """

    def __init__(self, values: DataFrame, column: str, most: int = SET_BITS):
        n = values.count()
        self.bits = min(1 << max(6, most.bit_length() - 1), 1 << max(12, (16 * n).bit_length()))
        at = F.pmod(F.col(column), F.lit(self.bits))
        words = values.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {self.bits}) & 63 AS int))")).alias("bits"))
        self.words = checkpointed(words)

    def array(self) -> np.ndarray:
        """The set as an array of words of 64 bits, for ``held_bits``; it comes to the driver, ``most`` bits at most."""
        words = self.words.toArrow()
        out = np.zeros(self.bits >> 6, np.int64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return out

    def _joined(self, rows: DataFrame, column: str, how: str) -> DataFrame:
        word, held = (fresh(c, rows.columns) for c in ("set_word", "set_bits"))
        at = F.pmod(F.col(column), F.lit(self.bits))
        member = (F.shiftright(at, 6) == F.col(word)) & (F.getbit(held, at.bitwiseAND(63).cast("int")) == 1)
        return rows.join(F.broadcast(self.words.toDF(word, held)), member, how)  # of ``SET_BITS`` at most

    def those_in(self, rows: DataFrame, column: str) -> DataFrame:
        return self._joined(rows, column, "left_semi")

    def those_out(self, rows: DataFrame, column: str) -> DataFrame:
        return self._joined(rows, column, "left_anti")


def held_bits(members: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a set (``Members.array``) has each of the values, or lets it through."""
    at = values & (64 * len(members) - 1)
    return (members[at >> 6] >> (at & 63) & 1).astype(bool)


#: Rows of a table below which no key can be too much for one task.
FEW = 100_000


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a table of one row for each key, ``count`` of which add up to ``total`` at most.

    Keys with more than a thousandth of the total, of which there are fewer than a thousand, are joined by broadcast, so
    that no task gets more of one key than that. Both sides are read twice: they should be written tables. Where the
    total is small a plain join does. how: inner or left.
    """
    if total <= FEW:
        return rows.join(one, keys, how)
    limit = total // 1000
    hot = one.where(F.col(count) > limit)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(one.where(F.col(count) <= limit), keys, how))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
