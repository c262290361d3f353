import csv
import glob
import json
import os
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.functions.relation import row_ids
from sparkloom.operators import index, joins, output, partition, sealing, sorted_tables
from sparkloom.operators.store import Store, Tampered
from sparkloom.plans import queries, workload
from sparkloom.plans.memory import lambert_w, plan, plan_chunks
from sparkloom.sources import generators
from sparkloom.streaming import probe

R, S = [(0, 1), (0, 2), (1, 3), (5, 4)], [(0, 10), (0, 11), (1, 12), (7, 13), (1, 12)]


def _relation(spark, rows):
    return spark.createDataFrame(rows, "key long, payload long")


@pytest.mark.parametrize("name", [n for n, x in joins.STRATEGIES.items() if x.keys == "many"])
def test_many_to_many(spark, name):
    expected = Counter((k, p, q) for k, p in R for l, q in S if k == l)
    assert Counter(map(tuple, joins.join_rows(name, _relation(spark, R), _relation(spark, S)).collect())) == expected


@pytest.mark.parametrize(("name", "pick"), [("concise", min), ("carry_last", max), ("padded", min)])
def test_at_most_one_partner(spark, name, pick):
    best = {k: pick(p for j, p in R if j == k) for k, _ in R}
    assert Counter(map(tuple, joins.join_rows(name, _relation(spark, R), _relation(spark, S)).collect())) == Counter((k, best[k], q) for k, q in S if k in best)


def test_padded_output_has_a_size_of_its_own(spark):
    assert joins.padded(_relation(spark, R), _relation(spark, S), 2).count() == 2 * len(S)
    assert joins.padded(_relation(spark, []), _relation(spark, S), 2).count() == 0


def test_unknown_strategy():
    with pytest.raises(ValueError, match="radix_histogram"):
        joins.strategy("nothing")


@pytest.mark.parametrize(("r", "s", "percent"), [(100, 1000, 50), (100, 1030, 7), (10, 5, 100), (100, 1000, 0)])
def test_expected_matches(spark, r, s, percent):
    fk = generators.foreign_keys_selective(spark, s, generators.domain_of_selectivity(r, percent))
    assert joins.join_count("RHO", generators.primary_keys(spark, r), fk).head()[0] == generators.expected_matches(r, s, percent)


def test_keys_from_file(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("12\n -3x\n\nabc\n+7\n")
    assert sorted(x.key for x in generators.keys_from_file(spark, str(tmp_path / "keys.txt")).collect()) == [-3, 0, 0, 7, 12]


def test_seal_round_trip_and_tampering(spark):
    rel, key = _relation(spark, R), b"0123456789abcdef"
    sealed = sealing.seal(rel, key)
    assert Counter(map(tuple, sealing.unseal(sealed, key).collect())) == Counter(R)
    assert sealing.unseal(sealed, b"fedcba9876543210").count() == sealing.unseal(sealed, key, "other").count() == 0
    assert Counter(map(tuple, sealing.unseal_chunks(sealing.seal_chunks(rel, key, 2), key).collect())) == Counter(R)


def test_memory_plan():
    assert abs(lambert_w(1) - 0.5671432904) < 1e-9
    p = plan(1_000_000, 65)
    assert (p.chunks - 1) * p.chunk_rows < p.rows <= p.chunks * p.chunk_rows and p.chunk_rows * (48 + np.log2(p.chunk_rows) / 8) <= 1 << 20
    assert plan_chunks(10, 65) == 1 < plan_chunks(1_000_000, 65)
    with pytest.raises(ValueError, match="exceed"):
        plan_chunks(10, 64)


def test_order_violations(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 2, 1, 5, 4])], "place long, key long")
    assert partition.order_violations(rows, "place", width=2).head()[0] == 2


def test_entry_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def _hot(spark):
    rng = random.Random(1)
    r = [(rng.choice([1, 1, 2, rng.randint(0, 30)]), k) for k in range(90)]
    s = [(rng.choice([1, 1, 1, rng.randint(0, 30)]), k) for k in range(200)]
    return r, s, Counter((k, p, q) for k, p in r for j, q in s if j == k)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_hot_keys_are_split(spark):
    r, s, want = _hot(spark)
    got = joins.radix_split(_relation(spark, r), _relation(spark, s), most=10)
    assert Counter(map(tuple, got.collect())) == want
    assert "salt" in _plan(got) and "ShuffledHashJoin [key" in _plan(got)
    dealt = joins.radix_split(_relation(spark, r), _relation(spark, s), most=10).groupBy().count()  # the salt is part of what rows are dealt by
    assert any("hashpartitioning(key" in x and "salt" in x for x in _plan(dealt).split("\n"))
    assert Counter(map(tuple, joins.nested_blocks(_relation(spark, r), _relation(spark, s), most=7).collect())) == want
    assert Counter(map(tuple, joins.sort_expand_align(_relation(spark, r), _relation(spark, s), parts=3).collect())) == want


def test_row_ids_of_hot_and_sparse_keys(spark):
    r = [(7, k) for k in range(300)] + [((k * k) << 40, -k) for k in range(300)] + [(7, 5)]
    got = sorted(map(tuple, row_ids(_relation(spark, r).repartition(5)).collect()), key=lambda x: x[2])
    assert got == [(k, p, i) for i, (k, p) in enumerate(sorted(r))]


def test_padded_outputs_are_bounded(spark):
    r = _relation(spark, [(k, k) for k in range(100)])
    assert joins.padded(r, _relation(spark, S), 1, most_chunks=4).count() == 4 * len(S)
    assert joins.real_rows(joins.blocked_output(r, _relation(spark, S), 30)).count() == joins.join_count("RHO", r, _relation(spark, S)).head()[0]


def test_ciphers_run_once(spark):
    rel, key = _relation(spark, R), b"0123456789abcdef"
    sealed = sealing.seal(rel, key)
    for df, most in ((sealing.unseal(sealed, key), 1), (sealing.unseal_chunks(sealing.seal_chunks(rel, key), key), 1)):
        text = _plan(df)
        assert text.count("try_aes_decrypt") + text.count("aesDecrypt") <= 2 * most and "Filter (isnotnull(split" not in text
    joined = sealing.deterministic_join(rel, _relation(spark, S), key)
    assert Counter(map(tuple, joined.collect())) == Counter((k, p, q) for k, p in R for j, q in S if j == k)
    assert _plan(joined).count("aesEncrypt") == 2 and _plan(joined).count("aesDecrypt") == 1


def test_chunks_are_bound_to_their_place(spark):
    key = b"0123456789abcdef"
    chunks = sealing.seal_chunks(_relation(spark, [(k, k) for k in range(50)]), key, 5)
    held = chunks.collect()
    assert all(len(r.sealed) <= 5 * 6 + 28 for r in held) and len(held) >= 10
    moved = spark.createDataFrame([(a.part, a.chunk, b.sealed) for a, b in zip(held, held[1:] + held[:1])], chunks.schema)
    assert sealing.unseal_chunks(moved, key).count() == 0
    with pytest.raises(ValueError, match="kB"):
        sealing.rows_of_chunk(0)


def test_store(spark):
    store = Store(spark, b"0123456789abcdef")
    store.create("a", _relation(spark, R))
    store.create("b", _relation(spark, S))
    with pytest.raises(ValueError, match="there is"):
        store.create("a", _relation(spark, R))
    assert store.tables() == ["a", "b"] and store.scan("a", real=False).count() == len(R) + 100
    assert Counter(map(tuple, store.scan("a").collect())) == Counter(R) and store.read("a", 1) == (True, *sorted(R)[1])
    old = store.blobs["a"]
    store.write("a", spark.createDataFrame([(1, True, 50, 60)], "slot long, is_real boolean, key long, payload long"))
    assert store.read("a", 1) == (True, 50, 60) and store.read("a", 0) == (True, *sorted(R)[0]) and store.read("a", 80) == (False, 0, 0)
    new, store.blobs["a"] = store.blobs["a"], old  # an older blob put back
    with pytest.raises(Tampered):
        store.read("a", 1)
    store.blobs["a"] = new.withColumn("slot", 3 - new["slot"])  # blobs at other slots
    with pytest.raises(Tampered):
        store.read("a", 1)
    store.blobs["a"] = store.blobs["b"]
    with pytest.raises(Tampered):
        store.read("a", 0)
    store.drop("a")
    assert store.tables() == ["b"]


def test_index(spark):
    rel = _relation(spark, S)
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert index.exists(rel, 7) and not index.exists(rel, 8) and index.count_of(rel, 1) == 2
    assert rows(index.lower_bound(rel, 1)) == {(1, 12): 1} and rows(index.upper_bound(rel, 1)) == {(7, 13): 1} and rows(index.upper_bound(rel, 7)) == {}
    assert rows(index.erase_one(rel, 1)) == Counter(S) - Counter([(1, 12)]) and rows(index.erase(rel, 1)) == Counter(x for x in S if x[0] != 1)
    assert rows(index.erase_one(rel, 8)) == Counter(S)


def test_sorted_tables_join_without_shuffle_or_sort(spark, tmp_path):
    for name, made in (("r_sorted", R), ("s_sorted", S)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sorted_tables.save_sorted(_relation(spark, made), name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted_tables.join_sorted(spark, "r_sorted", "s_sorted")
        assert Counter(map(tuple, got.collect())) == Counter((k, p, q) for k, p in R for j, q in S if j == k)
        assert "SortMergeJoin" in _plan(got) and "Exchange" not in _plan(got) and "Sort [" not in _plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("r_sorted", "s_sorted"):
            spark.sql(f"DROP TABLE {name}")


def test_writers(spark, tmp_path):
    output.write_relation(_relation(spark, R).coalesce(1), f"{tmp_path}/rel")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/rel").collect()) == sorted(["#KEY, VAL", *(f"{k}, {p}" for k, p in R)])
    output.write_pairs(joins.join_rows("RHO", _relation(spark, R), _relation(spark, S)), f"{tmp_path}/pairs")
    assert Counter(r.value for r in spark.read.text(f"{tmp_path}/pairs").collect()) == Counter(f"{p} {q}" for k, p in R for j, q in S if j == k)


def test_stream_of_chunks(spark, tmp_path):
    for k, part in enumerate((S[:2], S[2:])):
        _relation(spark, part).coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    query = probe.probe(_relation(spark, R), probe.read_chunks(spark, f"{tmp_path}/s/*")).writeStream.format("memory").queryName("probed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert Counter(map(tuple, spark.table("probed").collect())) == Counter((k, p, q) for k, p in R for j, q in S if j == k)


def test_workload(spark, tmp_path, monkeypatch):
    w = workload.JoinWorkload.of_options(r_rows=100, s_rows=1030, selectivity=7)
    metrics = w.run(spark)
    assert metrics.matches == generators.expected_matches(100, 1030, 7) and metrics.phases["join"] and metrics.phases["partition"]
    assert workload.JoinWorkload.of_options(r_rows=50, s_rows=300, skew=0.9, selectivity=1).run(spark).matches == 300
    assert workload.JoinWorkload.of_options(r_rows=50, s_rows=300, sort_r=True, sort_s=True, algorithm="PSM").run(spark).matches == 300
    assert workload.JoinWorkload.of_options(r_rows=50, s_rows=100, three_way=True).run(spark).matches == 200
    assert sealing.unseal_chunks(workload.JoinWorkload.of_options(r_rows=50, s_rows=100, seal=True).rows(spark), b"0123456789abcdef").count() == 100
    assert workload.JoinWorkload.of_options(dataset="cache-fit").s_rows == 5_242_880 and workload.JoinWorkload.of_options(r_mb=1).r_rows == 131_072
    for bad in ({"dataset": "L", "r_rows": 5}, {"dataset": "none"}, {"selectivity": 101}, {"algorithm": "none"}, {"r_rows": 0}):
        with pytest.raises(ValueError):
            workload.JoinWorkload.of_options(**bad)
    for _ in range(2):
        workload.append_csv(f"{tmp_path}/out.csv", w, metrics, 4)
    assert [r["matches"] for r in csv.DictReader(open(f"{tmp_path}/out.csv"))] == [str(metrics.matches)] * 2
    assert json.loads(json.dumps(metrics.as_dict()))["algorithm"] == "RHO"
    assert vars(workload.parser().parse_args(["-a", "CHT", "-d", "L", "--three-way-join", "--sort-r"]))["three_way"]


def test_shuffled_keeps_the_rows(spark):
    rel = generators.primary_keys(spark, 100)
    assert Counter(map(tuple, generators.shuffled(rel).collect())) == Counter(map(tuple, rel.collect()))
    assert [r.key for r in generators.shuffled(rel).collect()] != [r.key for r in rel.collect()]


def test_padded_rows_make_no_dummies(spark):
    got = joins.join_rows("padded", _relation(spark, R), _relation(spark, S))
    assert Counter(map(tuple, got.collect())) == Counter((k, min(p for j, p in R if j == k), q) for k, q in S if k in dict(R))
    assert "Join" in _plan(got) and "Generate" not in _plan(got) and "Union" not in _plan(got)
    dummies = [tuple(x) for x in joins.padded(_relation(spark, R), _relation(spark, S), 2).where("not is_real").collect()]
    assert Counter(dummies) == {(False, 0, None, None, None): 3, (False, 1, None, None, None): 3}


def _tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_real_rows_query_makes_no_dummies(spark, tmp_path):
    d = _tables(spark, tmp_path, orders=spark.createDataFrame([(k, 100 + k) for k in range(4000)], "o_orderkey long, o_custkey long"), lineitem=spark.createDataFrame([(k * 7, k) for k in range(900)], "l_orderkey long, l_suppkey long"))
    got = queries.QUERIES["join_real_rows"](spark, d)
    assert Counter(map(tuple, got.collect())) == Counter((k * 7, 100 + k * 7, k) for k in range(900) if k * 7 < 4000)
    assert "Join" in _plan(got) and "Generate" not in _plan(got) and "Union" not in _plan(got)


def _same_as_sql(spark, name, d):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{d}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}/*.parquet'")
    got = queries.QUERIES[name](spark, d)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    return len(want)


def test_blocked_output_of_many_blocks_is_its_sql(spark, tmp_path):
    orders = spark.range(3750 * 65).selectExpr("id AS o_orderkey", "id % 90000 AS o_custkey")
    d = _tables(spark, tmp_path, orders=orders, events=spark.createDataFrame([(0, 1), (0, 2), (89_999, 3), (90_000, 4)], "user_id long, event_id long"))
    assert _same_as_sql(spark, "join_blocked_output", d) == 4 * 65 + 2 * 2 + 1


def test_blocked_output_keeps_matches_without_payload(spark):
    got = joins.blocked_output(_relation(spark, [(0, None), (1, 2)]), _relation(spark, [(0, 5), (3, 6)]), 1)
    assert Counter(map(tuple, got.collect())) == {(True, 0, 0, None, 5): 1, (False, 0, None, None, None): 1, (False, 1, None, None, None): 2}


def test_padded_output_of_many_chunks_is_its_sql(spark, tmp_path):
    orders = spark.range(1875 * 65).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey")
    d = _tables(spark, tmp_path, orders=orders, lineitem=spark.createDataFrame([(0, 1), (0, 2), (121_874, 3), (121_875, 4)], "l_orderkey long, l_suppkey long"))
    assert _same_as_sql(spark, "join_padded_output", d) == 4 * 65


def test_dummies_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE_ROWS", 3)
    r, s = [(k, -k) for k in range(10)], [(k % 13, k) for k in range(50)]
    want = Counter((True, c, k, -k, q) if k < 10 and k // 4 == c else (False, c, None, None, None) for k, q in s for c in range(3))
    assert Counter(map(tuple, joins.padded(_relation(spark, r), _relation(spark, s), 4).collect())) == want


def test_dummies_are_slots_of_a_range(spark):
    r, s = [(k, -k) for k in range(12)], [(1, k) for k in range(30)] + [(9, 30), (99, 31)]  # chunk 0 has nearly all matches, chunk 1 none
    got = joins.padded(_relation(spark, r), _relation(spark, s), 4)
    assert Counter(map(tuple, got.collect())) == Counter((True, c, k, -k, q) if k < 12 and k // 4 == c else (False, c, None, None, None) for k, q in s for c in range(3))
    plan = _plan(got.where("not is_real"))
    assert "Range" in plan and "Generate" not in plan and "RoundRobinPartitioning" not in plan
