"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else by the context's own setting. Machines could not share one that
    is made up here, so it is an error if neither is set; on a single machine a folder of the warehouse will do."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and (set_ := context._jsc.sc().getCheckpointDir()).isDefined():
        at = set_.get()
    if not at and context.master.partition("[")[0] == "local":
        at = f"{spark.conf.get('spark.sql.warehouse.dir')}/.sparkloom"
        context.setCheckpointDir(at)
    if not at:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return at.rstrip("/")


#: Rows of a small table that go to one file.
ROWS_PER_FILE = 250_000


def stored(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, and is computed once. rows: about
    how many it has at most, if known; few rows after a shuffle go to few files, not to one for each partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{tag}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """Only doc_id and text (null: empty) and what is asked for: other columns, whatever their names, do not get in the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.strip().split(" ", 1) for x in schema.split(",") if x.strip())])


def _row_bytes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row of a column takes."""
    kind = column.type
    if pa.types.is_struct(kind):
        return sum((_row_bytes(column.field(k)) for k in range(kind.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_list(kind):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if not pa.types.is_list(kind):
            return np.diff(at)
        inside = np.concatenate([[0], np.cumsum(_row_bytes(column.values))])
        return inside[at[1:]] - inside[at[:-1]]
    return np.full(len(column), 8, np.int64)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes, or one row, so that what Python makes of a part stays small wherever long
    texts stand. What has been freed goes back to the system, since idle workers keep what they have."""
    if not batch.num_rows:
        return
    total = np.cumsum(sum((_row_bytes(c) for c in batch.columns), np.zeros(batch.num_rows, np.int64)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
    if total[-1] > most:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op (associative) over the beginnings of an array, in rounds that double the reach of each."""

    def rounds(x: Column) -> Column:
        reaches = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda r: r < F.size(x))
        return F.aggregate(reaches, x, lambda done, r: F.transform(done, lambda v, i: F.when(i >= r, op(v, F.get(done, i - r))).otherwise(v)))

    return let(x, rounds)


def components(edges: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches.

    Alternating large-star and small-star rounds: every round is one grouping by node whose rows shrink to a star per
    component; nothing is collected. A round's edges are written to the shared folder, which cuts the lineage. Hot
    nodes are safe: the smallest neighbour is a pre-aggregated min, joined back to the rows."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    last, n = None, e.count()
    for _ in range(most_rounds):  # a few more than the logarithm of the longest path
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u points to the smallest of u's neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u itself, point to the smallest
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = stored(e, tag, 2 * n)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head()
        n = now[0]
        if last == tuple(now):
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of a Bloom filter: 16 for each value that it is made for, but no more than 32 MB, whatever the input.
MOST_BLOOM = 1 << 28


def bloom_room(values: int) -> int:
    """The filter's bits, a power of two."""
    return min(MOST_BLOOM, 1 << max(16, (16 * values - 1).bit_length()))


def _bloom_bits(x: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each 64-bit value."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x & np.uint64(room - 1), (x >> np.uint64(32)) & np.uint64(room - 1)


def bloom(rows: DataFrame, room: int, name: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: batch.column(0).to_numpy()) -> np.ndarray:
    """The filter of the 64-bit names of rows (their first column, if not told otherwise), as bytes. Its parts come as words
    with their bits set, at most room / 64 rows."""
    schema = arrow_schema("word long, bits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.concatenate(_bloom_bits(name(batch), room))
            word, value = (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], schema=schema)

    words = rows.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(room // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def in_bloom(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the filter holds each value: always where it was put in, rarely else."""
    bits = (filter_[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) for b in _bloom_bits(x, 8 * len(filter_)))
    return (next(bits) & next(bits) & 1).view(bool)
