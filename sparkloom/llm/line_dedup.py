"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line, stripped and with A-Z lower-cased; a key of at least MIN_CHARS code points that at least two
documents hold loses its lines everywhere but in the smallest doc_id that holds it (the owner).

State: the table of (key, document) pairs is exact; the reference counts (key, refs, owner, last) are its aggregate; a
cuckoo filter per shard of the keys holds those that are shared. A batch probes the filters first, so that only lines
that may be shared (and a few in ten thousand others) meet the exact table, which decides. `LineStore` keeps the state
between batches: inserting documents and deleting them changes counts, owners and filters of the keys they touch, so
dedup stays reversible; `report` and `dedup` insert their documents into a store of their own. A shard's filter that gets
too full is built anew from the exact counts, and all are when the keys need more shards.

Scale: keys are 128-bit digests; counting is a pre-aggregated group-by, so a line that a third of the documents hold is
no hot task; the join with the exact table has one row a key on one side, whose hot partitions AQE splits. Filters take
2.6 bytes a shared key and are broadcast up to FILTER_BYTES together; beyond that the exact join runs without them. A very
long text is held by one task.

Edge cases: null or empty texts are one empty line; a null doc_id counts as the largest one; rows with one doc_id are
one document, though each gets its row; an empty table gives no rows; other columns are ignored by `report` and carried by
`dedup`, which keeps null texts null.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, slices, stored

MIN_CHARS = 10
#: Keys of a shard, and bytes of filters that may be broadcast.
SHARD_KEYS, FILTER_BYTES = 1 << 20, 64 << 20
#: Segments of a store's log before they are made one.
MOST_SEGMENTS = 16
LAST_ID = (1 << 63) - 1
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip(_STRIP).lower()
    n = len(key)
    return key if n >= MIN_CHARS and (n >= 4 * MIN_CHARS or len(key.decode()) >= MIN_CHARS) else None


def digest(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    hi, lo = x >> 64, x & 0xFFFFFFFFFFFFFFFF
    return hi - (1 << 64) if hi >> 63 else hi, lo - (1 << 64) if lo >> 63 else lo


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. Keys are (k1, k2) digests: k1 picks the first bucket, k2 the fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def of_size(cls, keys: int) -> "Cuckoo":
        need = max(1, int(keys / (0.8 * cls.SLOTS)) + 1)
        return cls(np.zeros((1 << (need - 1).bit_length(), cls.SLOTS), np.uint16))

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.uint64)
        print_ = np.where(print_ == 0, np.uint64(1), print_)
        first = (k1.astype(np.uint64) >> np.uint64(8)) & self.mask
        return print_.astype(np.uint16), first, self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))) & self.mask

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        f, a, b = self._places(k1, k2)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        """The filter with the keys; a larger one must be built where this one is too full (OverflowError)."""
        f, a, b = self._places(k1, k2)
        left = np.arange(len(f))
        for bucket in (a, b):  # what fits without moving anything, all at once
            order = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[order]
            fresh = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else np.zeros(0, int)
            slots = self.table[at]
            free = np.cumsum(slots == 0, 1) == (rank + 1)[:, None]
            free &= slots == 0
            ok = free.any(1)
            self.table[at[ok], free[ok].argmax(1)] = f[order[ok]]
            left = order[~ok]
        rng = np.random.default_rng(0)
        for i in left:
            self._kick(f[i], int(a[i]), rng)
        return self

    def _kick(self, print_: np.uint16, bucket: int, rng: np.random.Generator) -> None:
        for _ in range(self.KICKS):
            if (free := np.flatnonzero(self.table[bucket] == 0)).size:
                self.table[bucket, free[0]] = print_
                return
            slot = int(rng.integers(self.SLOTS))
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
            bucket = int(self._other(np.array([bucket], np.uint64), np.array([print_], np.uint16))[0])
            if (free := np.flatnonzero(self.table[bucket] == 0)).size:
                self.table[bucket, free[0]] = print_
                return
        raise OverflowError("the filter is too full")

    def has_room(self, more: int) -> bool:
        """Whether so many more keys leave it no fuller than of_size makes it."""
        return np.count_nonzero(self.table) + more <= 0.8 * self.table.size

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        """Without the keys, which must have been inserted."""
        f, a, b = self._places(k1, k2)
        for print_, *both in zip(f, a, b, strict=True):
            for bucket in both:
                if (at := np.flatnonzero(self.table[bucket] == print_)).size:
                    self.table[bucket, at[0]] = 0
                    break
        return self

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> "Cuckoo":
        size = len(k1)
        while True:
            try:
                return cls.of_size(size).insert(k1, k2)
            except OverflowError:
                size = size * 2 + 8

    def pack(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Cuckoo":
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_pairs(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc): each document's keys, once a row of docs."""
    schema = arrow_schema("k1 long, k2 long, doc long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                k1, k2, doc = [], [], []
                for d, text in zip(part["doc"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    for key in {x for line in text.split(b"\n") if (x := line_key(line)) is not None}:
                        hi, lo = digest(key)
                        k1.append(hi)
                        k2.append(lo)
                        doc.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1, k2, doc)], schema=schema)

    return _rows(docs).mapInArrow(run, "k1 long, k2 long, doc long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def reference_counts(pairs: DataFrame) -> DataFrame:
    """(k1, k2, refs, owner, last): how many pairs a key has, and its smallest and largest document."""
    return pairs.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.min("doc").alias("owner"), F.max("doc").alias("last"))


def filters(shared: DataFrame, n: int) -> DataFrame:
    """(shard, table): a cuckoo filter for each of n shards of the shared keys (k1, k2)."""
    schema = arrow_schema("shard int, table binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in _runs(b))
        for shard, parts in itertools.groupby(rows, key=lambda r: r[0]):
            each = list(parts)
            table = Cuckoo.build(np.concatenate([r[1] for r in each]), np.concatenate([r[2] for r in each])).pack()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([table], pa.binary())], schema=schema)

    dealt = shared.select(_shard(n).alias("shard"), "k1", "k2").repartition(n, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, table binary")


def _shards(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def _shard(n: int) -> F.Column:
    return F.pmod(F.col("k1"), F.lit(n)).cast("int")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch's runs of one shard each."""
    shard, k1, k2 = (batch[c].to_numpy() for c in ("shard", "k1", "k2"))
    edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else []
    for a, b in itertools.pairwise(edges):
        yield int(shard[a]), k1[a:b], k2[a:b]


def probe(pairs: DataFrame, tables: dict[int, bytes]) -> DataFrame:
    """The pairs whose key a filter holds: all the shared ones and a few others."""
    sent, n = pairs.sparkSession.sparkContext.broadcast(tables), max(tables, default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: Cuckoo.unpack(x) for k, x in sent.value.items()}
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            shard, hit = np.mod(k1, n), np.zeros(len(k1), bool)
            for s, table in own.items():
                if (at := np.flatnonzero(shard == s)).size:
                    hit[at] = table.contains(k1[at], k2[at])
            yield batch.filter(pa.array(hit))

    return pairs.mapInArrow(run, pairs.schema)


def _cut(text: bytes, drops: list[int] | None) -> tuple[bytes, int, int]:
    """The text that stays, its lines before, and those dropped."""
    lines = text.split(b"\n")
    if not drops:
        return text, len(lines), 0
    gone = set(zip(drops[::2], drops[1::2], strict=True))
    kept = [x for x in lines if (key := line_key(x)) is None or digest(key) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def find_drops(docs: DataFrame) -> DataFrame:
    """(doc, drops) of one batch, by a store of its own."""
    store = LineStore(docs.sparkSession, 1)
    return store.drops(store.insert(docs))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    schema = arrow_schema("doc_id long, n_lines long, n_dropped long, kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, t, x in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), part["drops"].to_pylist(), strict=True):
                    text, n, gone = _cut(t, x)
                    out.append((d, n, gone, hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = _rows(docs).withColumn("doc_id", F.nullif("doc", F.lit(LAST_ID)))
    return rows.join(find_drops(docs), "doc", "left").select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup(docs: DataFrame, drops: DataFrame | None = None) -> DataFrame:
    """docs without the lines that they lose; n_chars (if there) follows the text, the other columns stay."""
    names, drops = docs.columns, find_drops(docs) if drops is None else drops
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("rest"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"))
    rows = packed.join(drops, "doc", "left").select("rest", "text", "drops")
    out = rows.select("rest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = [t if t is None or not x else _cut(t.encode(), x)[0].decode() for t, x in zip(part["text"].to_pylist(), part["drops"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["rest"], pa.array(text, pa.string())], names=["rest", "text"])

    return rows.mapInArrow(run, out.schema).select(*[F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in names])


_COUNTS = ["k1", "k2", "refs", "owner", "last"]


class LineStore:
    """Line dedup over batches: insert documents, delete them again, and dedup any documents against the state.

    The state is a log of segments, to which a batch only adds. Inserted documents add their pairs, and a delta of the
    counts: sums, minima and maxima of the segments' rows make a key's counts. Deleted documents add their ids, and new
    counts of the keys they held, which stand for all rows before them. Only keys that a batch touches are counted, and
    change filters. After MOST_SEGMENTS the log is made one segment again, so a key has that many rows at most."""

    def __init__(self, spark: SparkSession, shards: int = 16):
        self.spark, self.shards, self.shared, self.epoch = spark, shards, 0, 0
        self._pairs: list[DataFrame] = []
        self._counts: list[DataFrame] = []
        self._gone: list[DataFrame] = []
        self.filters = spark.createDataFrame([], "shard int, table binary")

    def _segment(self, rows: DataFrame, tag: str, anew: bool = False) -> DataFrame:
        return stored(rows.withColumns({"epoch": F.lit(self.epoch), "anew": F.lit(anew)}), tag)

    def pairs(self) -> DataFrame:
        """(k1, k2, doc) of the documents that are in."""
        all_ = _union(self._pairs) if self._pairs else self.spark.createDataFrame([], "k1 long, k2 long, doc long, epoch int")
        if self._gone:
            gone = _union(self._gone).groupBy("doc").agg(F.max("epoch").alias("gone"))
            all_ = all_.join(gone, "doc", "left").where("gone is null or gone <= epoch")
        return all_.select("k1", "k2", "doc")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(k1, k2, refs, owner, last) of the keys that documents hold, or of some of them."""
        if not self._counts:
            return self.spark.createDataFrame([], "k1 long, k2 long, refs long, owner long, last long")
        rows = _union(self._counts)
        rows = rows if keys is None else rows.join(keys.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
        if len(self._counts) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max(F.when(F.col("anew"), F.col("epoch"))).alias("since"), F.collect_list(F.struct("epoch", "refs", "owner", "last")).alias("x"))
            rows = rows.withColumn("x", F.filter("x", lambda x: x["epoch"] >= F.coalesce("since", F.lit(0))))
            rows = rows.select("k1", "k2", F.aggregate("x", F.lit(0).cast("long"), lambda n, x: n + x["refs"]).alias("refs"), F.array_min("x.owner").alias("owner"), F.array_max("x.last").alias("last"))
        return rows.where("refs > 0").select(*_COUNTS)

    def insert(self, docs: DataFrame) -> DataFrame:
        """Add documents; those whose id is there already are replaced. Returns their pairs."""
        if self._pairs:
            self.delete(_rows(docs).select(F.col("doc").alias("doc_id")).distinct())
        self.epoch += 1
        new = self._segment(line_pairs(docs).distinct(), "line-pairs")
        delta = self._segment(reference_counts(new.select("k1", "k2", "doc")), "line-counts")
        self._change(delta, new)
        return new.select("k1", "k2", "doc")

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents with these doc_ids (null: the one without): their lines stop counting, and what they owned passes on."""
        ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc")).distinct()
        touched = stored(self.pairs().join(ids, "doc", "left_semi").select("k1", "k2").distinct(), "touched")
        if touched.isEmpty():  # documents without lines that count are in no table
            return
        self.epoch += 1
        self._gone.append(self._segment(ids, "gone"))
        left = reference_counts(self.pairs().join(touched, ["k1", "k2"], "left_semi"))
        self._change(self._segment(touched.join(left, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("refs", F.lit(0)).alias("refs"), "owner", "last"), "line-counts", anew=True))

    def _change(self, segment: DataFrame, new: DataFrame | None = None) -> None:
        """Add a segment of counts (and of pairs), and bring the filters up to date with the keys in it."""
        before = self._counts
        was = self.counts(segment).where("owner < last").select("k1", "k2") if before else None
        self._counts = [*before, segment]
        self._pairs += [] if new is None else [new]
        now = self.counts(segment).where("owner < last").select("k1", "k2")
        if was is None:
            change = now.withColumn("add", F.lit(True))
        else:
            was, now = stored(was, "was"), stored(now, "now")
            change = now.join(was, ["k1", "k2"], "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, ["k1", "k2"], "left_anti").withColumn("add", F.lit(False)))
        change = stored(change, "shared-lines")
        self.shared += change.agg(F.coalesce(F.sum(F.when(F.col("add"), 1).otherwise(-1)), F.lit(0))).head()[0]
        if was is None or _shards(self.shared) > self.shards:
            if (need := _shards(self.shared)) > self.shards:
                self.shards = max(need, 2 * self.shards)  # doubled, so that all filters are seldom built anew
            self.filters = stored(filters(change.select("k1", "k2") if was is None else self._shared_keys(), self.shards), "filters")
        else:
            self.filters = stored(self._updated(change), "filters")
        if len(self._counts) > MOST_SEGMENTS:
            self.epoch += 1
            self._pairs, self._counts = [self._segment(self.pairs(), "line-pairs")], [self._segment(self.counts(), "line-counts")]
            self._gone = []

    def _shared_keys(self) -> DataFrame:
        return self.counts().where("owner < last").select("k1", "k2")

    def _updated(self, change: DataFrame) -> DataFrame:
        """The filters after keys have become shared (add) or no longer are; one that has no room is built anew from the exact counts."""
        n = self.shards
        empty = Cuckoo.of_size(0).pack()

        def update(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            out, add = new[~new["add"]], new[new["add"]]
            table = Cuckoo.unpack(old["table"].iloc[0] if len(old) else empty)
            table.delete(out["k1"].to_numpy(), out["k2"].to_numpy())
            try:
                packed = table.insert(add["k1"].to_numpy(), add["k2"].to_numpy()).pack() if table.has_room(len(add)) else None
            except OverflowError:
                packed = None
            return pd.DataFrame({"shard": [key[0]], "table": [packed]})

        shards = [r.shard for r in change.select(_shard(n).alias("shard")).distinct().collect()]  # one number a shard
        touched, rest = self.filters.where(F.col("shard").isin(shards)), self.filters.where(~F.col("shard").isin(shards))
        tables = stored(touched.groupBy("shard").cogroup(change.withColumn("shard", _shard(n)).groupBy("shard")).applyInPandas(update, "shard int, table binary"), "changed-filters")
        full = [r.shard for r in tables.where("table is null").select("shard").collect()]
        done = rest.unionByName(tables.where("table is not null"))
        return done.unionByName(filters(self._shared_keys().where(_shard(n).isin(full)), n)) if full else done

    def drops(self, pairs: DataFrame) -> DataFrame:
        """(doc, drops): the keys that documents lose, of their pairs, as k1, k2, k1, k2 ..."""
        if (self.filters.agg(F.sum(F.length("table"))).head()[0] or 0) <= FILTER_BYTES:
            tables = {r.shard: bytes(r.table) for r in self.filters.collect()}  # bounded by FILTER_BYTES
            pairs = probe(pairs, {k: tables.get(k, Cuckoo.of_size(0).pack()) for k in range(self.shards)})
        if len(self._counts) > 1:
            pairs = stored(pairs, "probed")
        counts = self.counts(pairs if len(self._counts) > 1 else None).where("owner < last")
        lost = pairs.join(counts.select("k1", "k2", "owner"), ["k1", "k2"]).where("owner < doc")
        return lost.groupBy("doc").agg(F.flatten(F.collect_list(F.array("k1", "k2"))).alias("drops"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """The documents, which must be inserted, without the lines that other documents own."""
        return dedup(docs, self.drops(line_pairs(docs).distinct()))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, owner IS NOT NULL AND owner < doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
