"""Relations at rest under authenticated encryption, row by row or in chunks, and joins on deterministically encrypted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound to each blob; a blob sealed under another text does not unseal.
AAD = "sparkloom relation"


def _encrypt(data: Column, key: bytes, aad: str) -> Column:
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad))


def _decrypt(data: Column, key: bytes, aad: str) -> Column:
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def seal(rel: DataFrame, key: bytes, aad: str = AAD) -> DataFrame:
    """(sealed): a blob per row, with a fresh nonce."""
    return rel.select(_encrypt(F.concat_ws(":", "key", "payload"), key, aad).alias("sealed"))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select of costly columns, each computed once: no filter on them is moved below, where it would compute them again."""
    names = [f"c{k}" for k in range(len(columns))]
    return df.select(F.explode(F.array(F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)]))).alias("x")).select(*[f"x.{n}" for n in names])


def unseal(sealed: DataFrame, key: bytes, aad: str = AAD) -> DataFrame:
    """The relation; blobs that were changed, or sealed under another key or text, give no row."""
    text = _once(sealed, _decrypt(F.col("sealed"), key, aad).cast("string")).where("c0 is not null").select(F.split("c0", ":").alias("x"))
    return text.select(F.col("x")[0].cast("long").alias("key"), F.col("x")[1].cast("long").alias("payload"))


def rows_of_chunk(chunk_kb: int) -> int:
    """Rows of 8 bytes that a chunk of so many kB has. A single blob for any relation is not offered: a blob must fit a task."""
    if chunk_kb <= 0:
        raise ValueError("a chunk has at least 1 kB")
    return chunk_kb * 1024 // 8


def seal_chunks(rows: DataFrame, key: bytes, per_chunk: int = 1000, aad: str = AAD) -> DataFrame:
    """(part, chunk, sealed): rows (key, payload) in blobs of per_chunk rows, the last of a part with fewer. A chunk's blob is
    bound to its part and number. Rows are dealt out by hash and sorted, so that their numbers, and thus their chunks, are the
    same when a lost task runs again."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "payload").repartition(parts, "key", "payload").sortWithinPartitions("key", "payload")
    at = F.monotonically_increasing_id()
    numbered = dealt.select("key", "payload", F.shiftright(at, 33).alias("part"), F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / per_chunk).alias("chunk"))
    packed = numbered.groupBy("part", "chunk").agg(F.array_join(F.collect_list(F.concat_ws(":", "key", "payload")), ",").alias("x"))
    return packed.select("part", "chunk", F.aes_encrypt(F.col("x"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _bound(aad)).alias("sealed"))


def _bound(aad: str) -> Column:
    return F.concat_ws("/", F.lit(aad), "part", "chunk")


def unseal_chunks(sealed: DataFrame, key: bytes, aad: str = AAD) -> DataFrame:
    """The rows of all chunks; a changed blob, or one at another chunk's place, gives none."""
    plain = F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(aad)).cast("string")
    row = _once(sealed, plain).where("c0 is not null").select(F.explode(F.split("c0", ",")).alias("r")).select(F.split("r", ":").alias("r"))
    return row.select(F.col("r")[0].cast("long").alias("key"), F.col("r")[1].cast("long").alias("payload"))


def sealed_bytes(sealed: DataFrame) -> DataFrame:
    return sealed.agg(F.sum(F.octet_length("sealed")).cast("long").alias("bytes"))


def deterministic(rel: DataFrame, key: bytes) -> DataFrame:
    """Keys encrypted so that equal keys have equal ciphertexts. Leaks equality and frequency, by design."""
    padded = F.lpad(F.col("key").cast("string"), 64, "0")
    return _once(rel, F.aes_encrypt(padded, F.lit(key), F.lit("ECB")), F.col("payload")).toDF("key", "payload")


def deterministic_join(r: DataFrame, s: DataFrame, key: bytes) -> DataFrame:
    """Rows of the join on encrypted keys, with the key decrypted, once for each row of R."""
    plain = F.aes_decrypt("key", F.lit(key), F.lit("ECB")).cast("string").cast("long")
    left = _once(deterministic(r, key), F.col("key"), F.col("payload"), plain).toDF("key", "r_payload", "plain")
    right = deterministic(s, key).withColumnRenamed("payload", "s_payload")
    return left.hint("shuffle_hash").join(right, "key").select(F.col("plain").alias("key"), "r_payload", "s_payload")


def modular_count(r: DataFrame, s: DataFrame, p: int = 29) -> DataFrame:
    """(matches): pairs with keys equal modulo p, counted modulo p. Residues are counted on each side; no pair is made."""
    of = lambda rel, name: rel.groupBy(F.pmod("key", F.lit(p)).alias("residue")).agg(F.count("*").alias(name))
    return of(r, "a").join(of(s, "b"), "residue").agg(F.pmod(F.coalesce(F.sum(F.pmod("a", F.lit(p)) * F.pmod("b", F.lit(p))), F.lit(0)), F.lit(p)).cast("long").alias("matches"))


def equal_modulo(x: Column, y: Column, p: int = 29) -> Column:
    """1 if equal modulo p, else 0."""
    return F.when(F.pmod(x - y, F.lit(p)) == 0, 1).otherwise(0)


def batch_difference(a: Column, b: Column, p: int = 29) -> Column:
    """Of two arrays, slot by slot: 0 where equal modulo p, else 1."""
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: 1 - equal_modulo(z["x"], z["y"], p))
