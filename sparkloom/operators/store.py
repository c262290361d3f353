"""A sealed store of relations: rows in numbered slots, each bound to its table, slot and revision.

A blob that is changed, moved to another slot or table, or put back at an older revision does not open: reading it is an
error, as the revision that a slot must have is kept beside the store, not in it. There is no hiding of which slots are
read: a scan reads all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relation import pinned, row_ids


class Tampered(RuntimeError):
    """A slot's blob is not the one that was written there last."""


class Store:
    #: Empty slots of a new table.
    SPARE = 100

    def __init__(self, spark: SparkSession, key: bytes):
        self.spark, self.key = spark, key
        self.blobs: dict[str, DataFrame] = {}  # (slot, sealed), as an untrusted party holds them
        self.revisions: dict[str, DataFrame] = {}  # (slot, revision)

    def create(self, name: str, rel: DataFrame) -> None:
        """A table of the relation's rows in the order of (key, payload), and SPARE empty slots behind them."""
        if name in self.blobs:
            raise ValueError(f"there is a table {name!r}")
        numbered = row_ids(rel).select(F.col("id").alias("slot"), F.lit(True).alias("is_real"), "key", "payload")
        n = numbered.count()
        empty = self.spark.range(n, n + self.SPARE).select(F.col("id").alias("slot"), F.lit(False).alias("is_real"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("payload"))
        rows = numbered.unionByName(empty).withColumn("revision", F.lit(0).cast("long"))
        self.blobs[name] = pinned(self._sealed(name, rows))
        self.revisions[name] = pinned(rows.select("slot", "revision"))

    def drop(self, name: str) -> None:
        del self.blobs[name], self.revisions[name]

    def tables(self) -> list[str]:
        return sorted(self.blobs)

    def _bound(self, name: str) -> Column:
        return F.concat_ws("/", F.lit(name), "slot", "revision")

    def _sealed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select("slot", F.aes_encrypt(F.concat_ws(":", F.col("is_real").cast("int"), "key", "payload"), F.lit(self.key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), self._bound(name)).alias("sealed"))

    def _opened(self, name: str, where: Column | None = None) -> DataFrame:
        """(slot, is_real, key, payload); a blob that does not open raises, on the executor that meets it."""
        blobs = self.blobs[name] if where is None else self.blobs[name].where(where)
        plain = F.try_aes_decrypt("sealed", F.lit(self.key), F.lit("GCM"), F.lit("DEFAULT"), self._bound(name)).cast("string")
        at = self.revisions[name].join(blobs, "slot", "left" if where is None else "inner").select("slot", F.explode(F.array(plain)).alias("x"))
        x = F.split(F.coalesce("x", F.raise_error(F.concat(F.lit(f"tampered: {name}/"), F.col("slot").cast("string")))), ":")
        return at.select("slot", x.alias("x")).select("slot", (F.col("x")[0] == "1").alias("is_real"), F.col("x")[1].cast("long").alias("key"), F.col("x")[2].cast("long").alias("payload"))

    def scan(self, name: str, real: bool = True) -> DataFrame:
        """All slots; those with rows only, if not told otherwise. A missing slot raises, too."""
        rows = self._opened(name)
        return rows.where("is_real").select("key", "payload") if real else rows

    def read(self, name: str, slot: int) -> tuple[bool, int, int]:
        """(is_real, key, payload) of a slot."""
        try:
            row = self._opened(name, F.col("slot") == slot).head()
        except Exception as e:
            if "tampered" in str(e):
                raise Tampered(f"{name}/{slot}") from None
            raise
        if row is None:
            raise KeyError(slot)
        return row.is_real, row.key, row.payload

    def write(self, name: str, rows: DataFrame) -> None:
        """Put rows (slot, is_real, key, payload) into their slots, each at its next revision; the others stay as they are."""
        now = self.revisions[name].join(rows, "slot").select("slot", "is_real", "key", "payload", (F.col("revision") + 1).alias("revision"))
        now = pinned(now)
        self.blobs[name] = pinned(self.blobs[name].join(now, "slot", "left_anti").unionByName(self._sealed(name, now)))
        self.revisions[name] = pinned(self.revisions[name].join(now, "slot", "left_anti").unionByName(now.select("slot", "revision")))
