"""Queries of the join operators over the tables of a folder, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relation import as_relation, row_ids, scratch
from ..operators import index, joins, output, partition, sealing
from ..operators.store import Store
from ..sources import generators
from . import pipeline

KEY = b"0123456789abcdef"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _relation(spark: SparkSession, sf_dir: str, table: str, key: str, payload: str) -> DataFrame:
    return as_relation(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, payload), key, payload)


def _pk_fk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _relation(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), _relation(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")


def _many(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _relation(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), _relation(spark, sf_dir, "events", "user_id", "event_id")


def _skewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _relation(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = r.count()
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return r, as_relation(e, F.floor((F.col("event_id") % n) * (F.col("event_id") % n) / n), "event_id")


def _query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_R = "SELECT o_orderkey AS key, o_custkey AS payload FROM orders"
_S = "SELECT l_orderkey AS key, l_suppkey AS payload FROM lineitem"
_RM = "SELECT o_custkey AS key, o_orderkey AS payload FROM orders"
_SM = "SELECT user_id AS key, event_id AS payload FROM events"
_SK = "SELECT ((event_id % n) * (event_id % n)) // n AS key, event_id AS payload FROM events, (SELECT count(*) AS n FROM customer)"
_ROWS = "SELECT r.key, r.payload AS r_payload, s.payload AS s_payload FROM ({r}) r JOIN ({s}) s ON r.key = s.key"
_COUNT = "SELECT count(*) AS matches FROM ({r}) r JOIN ({s}) s ON r.key = s.key"


def _add_joins() -> None:
    for name, strategy in joins.STRATEGIES.items():
        if strategy.keys == "many":
            _query(f"join_{name}_rows", _ROWS.format(r=_R, s=_S))(lambda spark, d, n=name: joins.join_rows(n, *_pk_fk(spark, d)))
            _query(f"join_{name}_count", _COUNT.format(r=_R, s=_S))(lambda spark, d, n=name: joins.join_count(n, *_pk_fk(spark, d)))
            _query(f"join_{name}_many", _ROWS.format(r=_RM, s=_SM))(lambda spark, d, n=name: joins.join_rows(n, *_many(spark, d)))
        else:
            _query(f"join_{name}_rows", _ROWS.format(r=_R, s=_S))(lambda spark, d, n=name: joins.join_rows(n, *_pk_fk(spark, d)))
    for name in ("radix_histogram", "radix_split", "parallel_sort_merge", "hash_shared"):
        _query(f"join_{name}_skewed", _COUNT.format(r="SELECT c_custkey AS key, c_nationkey AS payload FROM customer", s=_SK))(lambda spark, d, n=name: joins.join_count(n, *_skewed(spark, d)))
        for percent in (1, 50):
            _query(f"join_{name}_selectivity_{percent}", _COUNT.format(r=f"{_R} WHERE o_orderkey % 100 < {percent}", s=_S))(lambda spark, d, n=name, p=percent: joins.join_count(n, _pk_fk(spark, d)[0].where(F.col("key") % 100 < p), _pk_fk(spark, d)[1]))


_add_joins()


@_query("join_sorted_inputs", _COUNT.format(r=_R, s=_S))
def _(spark, d):
    return joins.join_count("parallel_sort_merge", *(partition.range_partition(x, 16) for x in _pk_fk(spark, d)))


@_query("join_concise_checksum", f"WITH r AS (SELECT key, min(payload) AS p FROM ({_RM}) GROUP BY key) SELECT count(*) AS matches, CAST(sum((p + s.payload) % 4294967296) AS BIGINT) AS checksum FROM r JOIN ({_SM}) s ON r.key = s.key")
def _(spark, d):
    return joins.checksum(joins.concise(*_many(spark, d)))


@_query("join_carry_last_many", f"SELECT s.key, r.p AS r_payload, s.payload AS s_payload FROM (SELECT key, max(payload) AS p FROM ({_RM}) GROUP BY key) r JOIN ({_SM}) s ON r.key = s.key")
def _(spark, d):
    return joins.carry_last(*_many(spark, d))


_PADDED = f"""
WITH r AS (SELECT key, payload, (row_number() OVER (ORDER BY key, payload) - 1) // 1875 AS chunk FROM ({_R})), one AS (SELECT chunk, key, min(payload) AS r_payload FROM r GROUP BY 1, 2),
c AS (SELECT unnest(range(0, (SELECT max(chunk) + 1 FROM r))) AS chunk)
SELECT r_payload IS NOT NULL AS is_real, c.chunk, CASE WHEN r_payload IS NOT NULL THEN s.key END AS key, r_payload, CASE WHEN r_payload IS NOT NULL THEN s.payload END AS s_payload
FROM ({_S}) s CROSS JOIN c LEFT JOIN one ON one.chunk = c.chunk AND one.key = s.key
"""


@_query("join_padded_output", _PADDED)
def _(spark, d):
    return joins.padded(*_pk_fk(spark, d))


@_query("join_blocked_pairs", f"WITH r AS (SELECT *, (row_number() OVER (ORDER BY key, payload) - 1) // 3750 AS b FROM ({_R})), s AS (SELECT *, (row_number() OVER (ORDER BY key, payload) - 1) // 3750 AS b FROM ({_S})) SELECT r.b AS r_block, s.b AS s_block, count(*) AS matches FROM r JOIN s ON r.key = s.key GROUP BY 1, 2")
def _(spark, d):
    return joins.blocked(*_pk_fk(spark, d)).groupBy("r_block", "s_block").agg(F.count("*").alias("matches"))


@_query("join_radix_split_hot", _ROWS.format(r="SELECT c_custkey AS key, c_nationkey AS payload FROM customer", s=_SK))
def _(spark, d):
    return joins.radix_split(*_skewed(spark, d), most=20)


@_query("join_blocked_output", f"""
WITH r AS (SELECT *, (row_number() OVER (ORDER BY key, payload) - 1) // 3750 AS r_block FROM ({_RM})), b AS (SELECT DISTINCT r_block FROM r)
SELECT r.key IS NOT NULL AS is_real, b.r_block, r.key, r.payload AS r_payload, CASE WHEN r.key IS NOT NULL THEN s.payload END AS s_payload FROM ({_SM}) s CROSS JOIN b LEFT JOIN r ON r.r_block = b.r_block AND r.key = s.key
""")
def _(spark, d):
    return joins.blocked_output(*_many(spark, d))


@_query("join_real_rows", _ROWS.format(r=_R, s=_S))
def _(spark, d):
    return joins.real_rows(joins.padded(*_pk_fk(spark, d))).select("key", "r_payload", "s_payload")


@_query("three_way_join", "SELECT user_id AS key, event_id AS payload FROM customer JOIN orders ON c_custkey = o_custkey JOIN events ON c_custkey = user_id")
def _(spark, d):
    return pipeline.three_way(*_three(spark, d))


def _three(spark, d):
    return _relation(spark, d, "customer", "c_custkey", "c_nationkey"), _relation(spark, d, "orders", "o_custkey", "o_orderkey"), _relation(spark, d, "events", "user_id", "event_id")


@_query("join_as_relation", f"SELECT r.key, r.payload FROM ({_R}) r JOIN ({_S}) s ON r.key = s.key")
def _(spark, d):
    return joins.as_built(joins.join_rows("RHO", *_pk_fk(spark, d)))


@_query("join_as_text", f"SELECT r.payload || ' ' || s.payload AS line FROM ({_R}) r JOIN ({_S}) s ON r.key = s.key")
def _(spark, d):
    return joins.as_text(joins.join_rows("RHO", *_pk_fk(spark, d)))


@_query("join_size", f"SELECT count(*) * 24 AS bytes FROM ({_R}) r JOIN ({_S}) s ON r.key = s.key")
def _(spark, d):
    return joins.size_in_bytes(joins.join_rows("RHO", *_pk_fk(spark, d)))


@_query("relation_page", f"SELECT * FROM ({_S}) ORDER BY key, payload LIMIT 20 OFFSET 100")
def _(spark, d):
    return joins.page(_pk_fk(spark, d)[1], 100, 20)


@_query("radix_partition_sizes", f"SELECT key & 127 AS pid, count(*) AS n, min(key) AS low, max(key) AS high FROM ({_S}) GROUP BY 1")
def _(spark, d):
    return partition.radix_partition(_pk_fk(spark, d)[1]).groupBy("pid").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@_query("radix_histogram", f"SELECT key & 127 AS pid, count(*) AS n FROM ({_S}) GROUP BY 1")
def _(spark, d):
    return partition.histogram(_pk_fk(spark, d)[1])


@_query("radix_prefix_sum", f"SELECT pid, n, CAST(coalesce(sum(n) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT key & 127 AS pid, count(*) AS n FROM ({_S}) GROUP BY 1)")
def _(spark, d):
    return partition.prefix_sum(partition.histogram(_pk_fk(spark, d)[1]))


@_query("radix_histogram_high_bits", f"SELECT (key >> 7) & 127 AS pid, count(*) AS n FROM ({_S}) GROUP BY 1")
def _(spark, d):
    return partition.histogram(_pk_fk(spark, d)[1], 7, 7)


@_query("range_partition_order", "SELECT 0 AS violations")
def _(spark, d):
    """Range partitions are in order, within and one after another."""
    rows = partition.range_partition(_many(spark, d)[1], 16).select(F.monotonically_increasing_id().alias("at"), "key")
    bounds = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return bounds.alias("a").join(bounds.alias("b"), F.expr("a.part < b.part and a.high > b.low")).agg(F.count("*").alias("violations"))


@_query("index_equal_range", f"SELECT * FROM ({_S}) WHERE key >= 100 AND key < 200")
def _(spark, d):
    return index.equal_range(_pk_fk(spark, d)[1], 100, 200)


@_query("index_bounds", f"SELECT 'lower' AS bound, * FROM (SELECT * FROM ({_SM}) WHERE key >= 77 ORDER BY key, payload LIMIT 1) UNION ALL SELECT 'upper', * FROM (SELECT * FROM ({_SM}) WHERE key > 77 ORDER BY key, payload LIMIT 1)")
def _(spark, d):
    rel = _many(spark, d)[1]
    return index.lower_bound(rel, 77).select(F.lit("lower").alias("bound"), "*").unionByName(index.upper_bound(rel, 77).select(F.lit("upper").alias("bound"), "*"))


@_query("index_changes", f"SELECT key, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY payload) AS k FROM ({_SM}) WHERE key <> 5) WHERE NOT (key = 6 AND k = 1) UNION ALL SELECT 5, 1")
def _(spark, d):
    rel = index.erase_one(index.erase(_many(spark, d)[1], 5), 6)
    return index.insert(rel, spark.createDataFrame([(5, 1)], "key long, payload long"))


@_query("radix_two_pass", f"SELECT key & 127 AS pid1, (key >> 7) & 127 AS pid2, count(*) AS n FROM ({_S}) GROUP BY 1, 2")
def _(spark, d):
    return partition.two_pass(_pk_fk(spark, d)[1])


@_query("group_block_sizes", f"SELECT key, count(*) FILTER (t = 0) AS height, count(*) FILTER (t = 1) AS width, count(*) FILTER (t = 0) * count(*) FILTER (t = 1) AS cells FROM (SELECT key, 0 AS t FROM ({_RM}) UNION ALL SELECT key, 1 FROM ({_SM})) GROUP BY key")
def _(spark, d):
    return partition.block_sizes(*_many(spark, d))


@_query("expand_rows", f"SELECT key, payload, CAST(unnest(range(0, payload % 4)) AS BIGINT) AS copy FROM ({_R})")
def _(spark, d):
    return partition.expand(_pk_fk(spark, d)[0].withColumn("weight", F.col("payload") % 4), "weight").select("key", "payload", "copy")


@_query("distribute_rows", f"SELECT g.i AS place, r.payload, r.key IS NOT NULL AS is_real FROM (SELECT unnest(range(0, 2 * (SELECT count(*) FROM orders))) AS i) g LEFT JOIN ({_R}) r ON r.key * 2 = g.i")
def _(spark, d):
    r = _pk_fk(spark, d)[0]
    return partition.distribute(r.select((F.col("key") * 2).alias("place"), "payload"), "place", 2 * r.count()).select("place", "payload", "is_real")


@_query("stable_size_filter", f"SELECT CASE WHEN payload % 3 = 0 THEN key END AS key, CASE WHEN payload % 3 = 0 THEN payload END AS payload, payload % 3 = 0 AS is_real FROM ({_S})")
def _(spark, d):
    return partition.stable_size_filter(_pk_fk(spark, d)[1], F.col("payload") % 3 == 0)


@_query("order_violations", "SELECT count(*) AS violations FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE before > user_id")
def _(spark, d):
    return partition.order_violations(_relation(spark, d, "events", "user_id", "event_id"), "payload")


@_query("row_ids", f"SELECT key, payload, row_number() OVER (ORDER BY key, payload) - 1 AS id FROM ({_RM})")
def _(spark, d):
    return row_ids(_many(spark, d)[0])


@_query("generate_primary", "SELECT range + 1 AS key, range AS payload FROM range(100000)")
def _(spark, d):
    return generators.primary_keys(spark, 100_000)


@_query("generate_foreign", "SELECT range % 30000 + 1 AS key, range AS payload FROM range(100000)")
def _(spark, d):
    return generators.foreign_keys(spark, 100_000, 30_000)


@_query("generate_foreign_selective", "SELECT CASE WHEN range < 90000 THEN range % 30000 + 1 ELSE 1 + (range - 90000) * 3 END AS key, range AS payload FROM range(100000)")
def _(spark, d):
    return generators.foreign_keys_selective(spark, 100_000, 30_000)


@_query("generate_primary_selective", "SELECT CAST(floor(1 + range * 100.0 / 40) AS BIGINT) AS key, range AS payload FROM range(100000)")
def _(spark, d):
    return generators.primary_keys_selective(spark, 100_000, 40)


@_query("generate_foreign_from_primary", "SELECT key, payload FROM (SELECT range + 1 AS key, range AS payload FROM range(3000)) p, range(4) g WHERE g.range * 3000 + payload < 10000")
def _(spark, d):
    return generators.foreign_keys_from(generators.primary_keys(spark, 3000), 10_000, 3000)


@_query("generate_from_list", "SELECT [5, 7, 11][range % 3 + 1] AS key, range AS payload FROM range(1000)")
def _(spark, d):
    return generators.keys_from_list(spark, 1000, [5, 7, 11])


@_query("generate_uniform", "SELECT 200000 AS n, 0 AS outside, true AS even")
def _(spark, d):
    """Keys are in the domain, and none of 100 slices is off its share by five standard deviations."""
    keys = generators.uniform_keys(spark, 200_000, 10_000)
    slices = keys.groupBy(F.floor(F.col("key") / 100).alias("slice")).agg(F.count("*").alias("n"), F.count(F.when((F.col("key") < 0) | (F.col("key") >= 10_000), 1)).alias("outside"))
    return slices.agg(F.sum("n").cast("int").alias("n"), F.sum("outside").cast("int").alias("outside"), F.bool_and(F.abs(F.col("n") - 2000) < 5 * 2000**0.5).alias("even"))


@_query("generate_from_file", f"SELECT key, 0 AS payload FROM ({_S})")
def _(spark, d):
    path = f"{scratch(spark)}/keys-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    output.write_keys(_pk_fk(spark, d)[1], path)
    return generators.keys_from_file(spark, path)


@_query("zipf_drawn", "SELECT 100000 AS n, true AS close")
def _(spark, d):
    """The drawn keys' distribution over the ranks is within the Kolmogorov-Smirnov bound (0.1 %) of the law's."""
    n, most = 100_000, 5000
    drawn = generators.zipf_keys(spark, n, most, 0.75).groupBy("key").agg(F.count("*").alias("n"))
    law = generators.zipf_cdf(spark, most, 0.75).withColumn("key", generators.zipf_key(F.col("rank"), most))
    ranked = law.join(drawn, "key", "left").select("rank", "cdf", F.coalesce("n", F.lit(0)).alias("n"))
    steps = ranked.alias("a").join(ranked.where("rank % 50 = 0").select(F.col("rank").alias("upto"), F.col("cdf").alias("want")), F.expr("rank <= upto")).groupBy("upto", "want").agg(F.sum("n").alias("n"))
    return steps.agg(F.max(F.when(F.col("upto") == most, F.col("n"))).cast("int").alias("n"), F.bool_and(F.abs(F.col("n") / n - F.col("want")) < 1.95 / n**0.5).alias("close"))


@_query("zipf_distribution", "SELECT range AS rank, round(sum(1 / pow(range, 0.75)) OVER (ORDER BY range) / (SELECT sum(1 / pow(range, 0.75)) FROM range(1, 20001)), 9) AS cdf FROM range(1, 20001)")
def _(spark, d):
    return generators.zipf_cdf(spark, 20_000, 0.75).select("rank", F.round("cdf", 9).alias("cdf"))


@_query("zipf_join", "SELECT 50000 AS matches")
def _(spark, d):
    return joins.join_count("RHO", generators.primary_keys(spark, 10_000), generators.zipf_keys(spark, 50_000, 10_000, 0.99)).select(F.col("matches"))


@_query("seal_roundtrip_join", _ROWS.format(r=_R, s=_S))
def _(spark, d):
    """Both relations rest sealed in chunks of 1000 rows."""
    return joins.join_rows("RHO", *(sealing.unseal_chunks(sealing.seal_chunks(x, KEY), KEY) for x in _pk_fk(spark, d)))


@_query("seal_rows_roundtrip_join", _ROWS.format(r=_R, s=_S))
def _(spark, d):
    return joins.join_rows("RHO", *(sealing.unseal(sealing.seal(x, KEY), KEY) for x in _pk_fk(spark, d)))


@_query("sealed_bytes", f"SELECT CAST(sum(length(key || ':' || payload) + 28) AS BIGINT) AS bytes FROM ({_S})")
def _(spark, d):
    """What is sealed, and 28 bytes a blob for nonce and tag."""
    return sealing.sealed_bytes(sealing.seal(_pk_fk(spark, d)[1], KEY))


@_query("seal_chunk_sizes", f"SELECT count(*) AS n, true AS fit FROM ({_S})")
def _(spark, d):
    """Chunks of 2 kB: none has more rows than that, and all rows are there."""
    chunks = sealing.seal_chunks(_pk_fk(spark, d)[1], KEY, sealing.rows_of_chunk(2))
    opened = sealing.unseal_chunks(chunks, KEY)
    return opened.agg(F.count("*").alias("n")).join(chunks.agg(F.bool_and(F.octet_length("sealed") <= 256 * 24 + 28).alias("fit")))


@_query("store_scan", _R)
def _(spark, d):
    store = Store(spark, KEY)
    store.create("orders", _pk_fk(spark, d)[0])
    return store.scan("orders")


@_query("store_write", f"SELECT k - 1 AS slot, k <> 1 AS is_real, CASE WHEN k = 1 THEN 0 WHEN k <= 10 THEN -k + 1 ELSE key END AS key, CASE WHEN k <= 10 THEN 0 ELSE payload END AS payload FROM (SELECT *, row_number() OVER (ORDER BY key, payload) AS k FROM ({_R})) UNION ALL SELECT n + range, false, 0, 0 FROM range(100), (SELECT count(*) AS n FROM orders)")
def _(spark, d):
    """Slots 0 to 9 written anew, slot 0 emptied; spare slots stay."""
    store = Store(spark, KEY)
    store.create("orders", _pk_fk(spark, d)[0])
    store.write("orders", spark.range(10).select(F.col("id").alias("slot"), (F.col("id") > 0).alias("is_real"), (-F.col("id")).alias("key"), F.lit(0).cast("long").alias("payload")))
    return store.scan("orders", real=False)


@_query("sealed_join", f"SELECT r.key, r.payload FROM ({_R}) r JOIN ({_S}) s ON r.key = s.key")
def _(spark, d):
    return sealing.unseal(pipeline.sealed_join(*(sealing.seal(x, KEY) for x in _pk_fk(spark, d)), KEY), KEY)


@_query("sealed_three_way_join", "SELECT user_id AS key, event_id AS payload FROM customer JOIN orders ON c_custkey = o_custkey JOIN events ON c_custkey = user_id")
def _(spark, d):
    return sealing.unseal(pipeline.sealed_three_way(*(sealing.seal(x, KEY) for x in _three(spark, d)), KEY), KEY)


@_query("seal_chunks", f"SELECT s.key, s.payload FROM ({_R}) r JOIN ({_S}) s ON r.key = s.key")
def _(spark, d):
    out = joins.join_rows("RHO", *_pk_fk(spark, d)).select("key", F.col("s_payload").alias("payload"))
    return sealing.unseal_chunks(sealing.seal_chunks(out, KEY), KEY)


@_query("unseal_wrong_aad", f"SELECT * FROM ({_R}) WHERE false")
def _(spark, d):
    return sealing.unseal(sealing.seal(_pk_fk(spark, d)[0], KEY), KEY, "another relation")


@_query("deterministic_join", _ROWS.format(r=_R, s=_S))
def _(spark, d):
    return sealing.deterministic_join(*_pk_fk(spark, d), KEY)


@_query("modular_count", f"SELECT CAST(sum(a.n * b.n) % 29 AS BIGINT) AS matches FROM (SELECT key % 29 AS k, count(*) AS n FROM ({_R}) GROUP BY 1) a JOIN (SELECT key % 29 AS k, count(*) AS n FROM ({_S}) GROUP BY 1) b ON a.k = b.k")
def _(spark, d):
    return sealing.modular_count(*_pk_fk(spark, d))


@_query("batch_equality", "SELECT CASE WHEN (a[i + 1] - b[i + 1]) % 29 = 0 THEN 0 ELSE 1 END AS difference, i AS slot FROM (SELECT [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] AS a, [1, 1, 3, 6, 2, 9, 34, 8, 3, 11] AS b), range(10) AS t(i)")
def _(spark, d):
    one = spark.range(1).select(F.array(*map(F.lit, range(1, 11))).alias("a"), F.array(*map(F.lit, (1, 1, 3, 6, 2, 9, 34, 8, 3, 11))).alias("b"))
    return one.select(F.posexplode(sealing.batch_difference(F.col("a"), F.col("b"))).alias("slot", "difference")).select(F.col("slot").cast("long").alias("slot"), "difference")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join_rows("RHO", *_pk_fk(spark, sf_dir))
