"""What the operators share: words, Arrow batches bounded by bytes, reading tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.scratch import Scratch, numbered, shared_folder  # noqa: F401  (re-exported to the operators)
from lodegraph.shipping import ARROW_ROWS, BATCH_BYTES, bounded_arrow, ship  # noqa: F401  (re-exported to the operators)

#: ASCII white space; a word is a longest run of other characters.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(text_or_empty(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def word_count(text: str | Column) -> Column:
    """Number of words, without making them: a word starts where a space is followed by none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which the strings of a column sum to about `limit` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, n in enumerate(sizes):
            if k > start and total + n > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


#: Bytes of results after which a Python worker gives memory back that it has freed.
GIVE_BACK = 16 << 20


def give_back() -> None:
    """Returns freed memory to the machine: workers live on between tasks, and so would the peak of each."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6"), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by workers that hold little: batches come in bounded, and freed memory goes back."""

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for made in work(batches):
            size += made.nbytes
            yield made
            if size > GIVE_BACK:
                give_back()
                size = 0
        give_back()

    bounded_arrow(df.sparkSession)
    return df.mapInArrow(frugal, schema)


#: Bits, as a power of two, of a field that marks hashes: 8 MB to each worker at any number of them.
FIELD_BITS = 26


def bit_table(hashes: DataFrame, scratch: Scratch, name: str, bits: int = FIELD_BITS) -> DataFrame:
    """A field with a bit set at the low `bits` bits of each hash (the table's one long column), as rows (__field, __bits) of
    32,768 bits. A field too full just thins less."""
    at = hashes.select((F.col(hashes.columns[0]).bitwiseAND((1 << bits) - 1)).alias("at"))
    return scratch.save(at.groupBy(F.shiftright("at", 15).alias("__field")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("__bits")), name)


def bit_field(hashes: DataFrame, scratch: Scratch, name: str, bits: int = FIELD_BITS) -> np.ndarray:
    """The same as bytes, for Python workers."""
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in bit_table(hashes, scratch, name, bits).toLocalIterator():
        out[r["__field"]] = np.frombuffer(r["__bits"], np.uint8)
    return out.reshape(-1)


def apart(df: DataFrame, hash_: Column, table: DataFrame, bits: int = FIELD_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash may be one of the table's (those all, few others), and the others; nothing is shuffled. The table is
    broadcast: it has 2^(bits - 3) bytes at most."""
    at = hash_.bitwiseAND((1 << bits) - 1)
    place = at.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(7)).bitwiseAND(1) == 1
    met = (F.shiftright(at, 15) == F.col("__field")) & bit
    return df.join(F.broadcast(table), met, "left_semi"), df.join(F.broadcast(table), met, "left_anti")


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with those of its columns renamed that an operator's own would clash with, and what renames them back."""
    taken = {n.lower() for n in names}
    own = {c: f"__aside{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(own), lambda out: out.withColumnsRenamed({v: k for k, v in own.items()})
