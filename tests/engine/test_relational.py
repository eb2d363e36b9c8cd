"""Small fixtures with known results for each relational operator."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import encodings
from brindle.functions.distance import cosine, l2, negative_dot
from brindle.operators import relational as R
from brindle.operators import graph, vector
from brindle.plans import catalogue
from brindle.plans.sql import GroupQuery, run_group_query, run_sql
from brindle.sources import tables
from brindle.streaming import events

# Small tables whose results are known.
ORDERS = [(1, 50, 10), (2, 150, 20), (3, 200, 5), (4, 80, 15), (5, 300, 8)]


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ORDERS, tables.schema(id="INT32", price="INT64", quantity="INT32"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan_filter_project(orders):
    assert rows(orders.filter(R.compare("price", ">", 100)).select("price")) == [(150,), (200,), (300,)]
    for op, want in ((">", 3), ("<", 1), (">=", 4), ("<=", 2), ("=", 1), ("!=", 4), ("<>", 4)):
        assert orders.filter(R.compare("price", op, 80)).count() == want


def test_three_valued_logic(spark):
    d = spark.createDataFrame([(1,), (9,), (None,)], "v int")
    assert d.filter(~(F.col("v") > 5)).count() == 1  # not true of null
    assert d.filter(F.col("v").isNull()).count() == 1
    big = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v bigint")
    assert big.filter(R.compare("v", "=", 2**53 + 1)).count() == 1


def test_sort_limit_and_nulls(spark, orders):
    assert [r[1] for r in rows(R.sort(orders, ("price", True)))] == [50, 80, 150, 200, 300]
    assert [r[1] for r in rows(R.sort(orders, ("price", False)))] == [300, 200, 150, 80, 50]
    assert len(rows(R.top(orders, 2, ("id", True)))) == 2 and R.top(orders, 0, ("id", True)).count() == 0
    d = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert rows(R.sort(d, ("v", True))) == [(None,), (1,), (2,)] and rows(R.sort(d, ("v", False))) == [(2,), (1,), (None,)]
    assert "TakeOrderedAndProject" in R.top(orders, 2, ("price", True))._jdf.queryExecution().toString()


def test_groups(spark):
    # Fixed values.
    d = spark.createDataFrame([("USA", 100), ("UK", 200), ("USA", 150), ("UK", 50), ("USA", 50)], "nation string, price bigint")
    assert dict(rows(R.aggregate(d, {"s": ("sum", "price")}, ["nation"]))) == {"USA": 300, "UK": 250}
    n = spark.createDataFrame([("a", -5), ("a", -2), ("b", None), ("c", 3), ("c", None)], "k string, v int")
    got = {r[0]: r[1:] for r in rows(R.aggregate(n, {"lo": ("min", "v"), "hi": ("max", "v"), "s": ("sum", "v"), "c": ("count", "v"), "n": ("count", "*")}, ["k"]))}
    assert got == {"a": (-5, -2, -7, 2, 2), "b": (None, None, None, 0, 1), "c": (3, 3, 3, 1, 2)}
    assert rows(R.aggregate(n, {"n": ("count", "*")})) == [(5,)]
    assert rows(R.aggregate(n, {"n": ("count", "*")}, ["k"], "n > 1").select("k").orderBy("k")) == [("a",), ("c",)]


def test_joins(spark):
    # Fixed values.
    o = spark.createDataFrame([(101, 1, 500), (102, 2, 300), (103, 1, 200), (104, 3, 100), (105, None, 1)], "order_id int, cust_id int, price bigint")
    c = spark.createDataFrame([(1, "alice"), (2, "bob"), (None, "nobody")], "id bigint, name string")
    got = R.equi_join(o, c, "cust_id", "id")
    assert len(got.columns) == 5 and sorted(r[0] for r in rows(got)) == [101, 102, 103]
    assert R.equi_join(o, c, "cust_id", "id", null_safe=True).count() == 4
    assert sorted(rows(R.salted_join(o, c, "cust_id", "id"))) == sorted(rows(got))
    assert R.equi_join(o, c, "cust_id", "id", "left").count() == 5 and R.equi_join(o, c, "cust_id", "id", "full").count() == 6


def test_salted_joins_copy_hot_keys_alone(spark, monkeypatch):
    """Copies of all right rows were 32 times the table, and broadcast as if there were none."""
    monkeypatch.setattr(R, "HOT_ROWS", 50)
    left = spark.createDataFrame([(i, 1 if i < 100 else i % 40 if i < 190 else None) for i in range(200)], "id int, k int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(30)] + [(1, "again"), (None, "none")], "key bigint, name string")
    for how in ("inner", "left"):
        assert sorted(rows(R.salted_join(left, right, "k", "key", how=how)), key=str) == sorted(rows(R.equi_join(left, right, "k", "key", how)), key=str)
    joined = R.salted_join(left, right, "k", "key")
    copies = [n for n in str(joined._jdf.queryExecution().executedPlan()).splitlines() if "Join" in n]
    assert copies and all("SortMergeJoin" in n for n in copies)


def test_range_and_overlap_joins(spark):
    r = np.random.default_rng(4)
    points = [(i, float(v)) for i, v in enumerate(r.uniform(-50, 50, 120))] + [(900, None), (901, 10.0)]
    bounds = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(r.uniform(-60, 60, 60), r.uniform(-2, 30, 60), strict=True))] + [(900, None, 3.0), (901, 10.0, 10.0)]
    p, b = spark.createDataFrame(points, "id int, v double"), spark.createDataFrame(bounds, "bid int, low double, high double")
    want = sorted((i, j) for i, v in points for j, lo, hi in bounds if v is not None and lo is not None and lo <= v <= hi)
    for width in (0.7, 10, 500):
        got = R.range_join(p, b, "v", "low", "high", width)
        assert sorted(rows(got.select("id", "bid"))) == want and got.columns == ["id", "v", "bid", "low", "high"]
    assert sorted(rows(R.theta_join(p, b, F.col("v").between(F.col("low"), F.col("high"))).select("id", "bid"))) == want
    spans = [(i, i % 3, int(s), int(s + n)) for i, (s, n) in enumerate(zip(r.integers(-50, 50, 60), r.integers(0, 25, 60), strict=True))]
    d = spark.createDataFrame(spans, "id int, k int, s int, e int")
    want = sorted((a[0], c[0]) for a in spans for c in spans if a[1] == c[1] and max(a[2], c[2]) <= min(a[3], c[3]))
    for width in (1, 7, 1000):
        assert sorted(rows(R.overlap_join(d, d, "k", "s", "e", width).select("l.id", "r.id"))) == want


def test_full_cells_of_range_joins_are_dealt_out(spark, monkeypatch):
    """A cell was one task's, though its pairs grow with the square of its rows."""
    monkeypatch.setattr(R, "CELL_ROWS", 20)
    monkeypatch.setattr(R, "TASK_PAIRS", 2000)
    p = spark.createDataFrame([(i, float(i % 7) if i < 150 else None if i < 155 else 40.0 + i) for i in range(200)] + [(900, 3.0)] * 2, "id int, v double")
    b = spark.createDataFrame([(i, i % 5 - 0.5, i % 5 + 1.5) for i in range(60)] + [(70, 5.0, None), (71, 4.0, 3.0)], "bid int, low double, high double")
    want = sorted(rows(R.theta_join(p, b, F.col("v").between(F.col("low"), F.col("high"))).select("id", "bid")))
    for width in (2, 50):
        got = R.range_join(p, b, "v", "low", "high", width)
        assert sorted(rows(got.select("id", "bid"))) == want and got.columns == ["id", "v", "bid", "low", "high"]
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        sizes = [n for n in got.rdd.glom().map(len).collect() if n]
        assert len(sizes) > 2 and max(sizes) < 0.7 * len(want)


def test_numbering_by_ranges(spark):
    d = spark.createDataFrame([(v * 7 % 1009,) for v in range(1, 1009)], "v int").repartition(7)
    assert sorted(rows(encodings.numbered(d, "v", "n"))) == [(v, v - 1) for v in range(1, 1009)]
    assert encodings.numbered(d.limit(0), "v", "n").count() == 0


def test_results_do_not_depend_on_partitions(spark, orders):
    want = sorted(rows(R.aggregate(orders.coalesce(1), {"s": ("sum", "price")}, ["quantity"])))
    assert sorted(rows(R.aggregate(orders.repartition(5), {"s": ("sum", "price")}, ["quantity"]))) == want


def test_sql_and_the_group_form(spark, tmp_path):
    d = spark.createDataFrame([(1, 200, 1), (1, 150, 2), (2, 300, 1), (2, 50, 1), (3, 10, 1)], "nation int, price bigint, quantity int")
    tables.write(d, str(tmp_path / "orders.parquet"))
    base = str(tmp_path)
    assert sorted(rows(run_group_query(spark, base, "SELECT sum(price) FROM orders WHERE price > 100 GROUP BY nation"))) == [(1, 350), (2, 300)]
    assert rows(run_group_query(spark, base, "select count(price) from orders where price > 1000 group by nation")) == []
    assert len(rows(run_group_query(spark, base, "select nation, min(price) from orders group by nation"))) == 3
    assert GroupQuery.parse("select count() from t where a <> -3 group by b").where == ("a", "<>", -3)
    for wrong in ("select price from orders", "select price, sum(quantity) from orders group by nation", "select median(price) from orders group by nation"):
        with pytest.raises(ValueError):
            GroupQuery.parse(wrong)
    assert GroupQuery.parse("select count(*) from t where a = 'it''s > 3' group by b").where == ("a", "=", "it's > 3")
    d.createOrReplaceTempView("orders")
    assert rows(spark.sql("SELECT count(*) FROM orders WHERE NOT nation = 1 AND price > 20")) == [(2,)]


def test_run_sql_counts_rows(spark):
    assert rows(run_sql(spark, "/root/testdata/sf0.001", "SELECT count() FROM nation;")) == [(25,)]


def test_run_sql_leaves_text_and_views_alone(spark):
    d = "/root/testdata/sf0.001"
    assert rows(run_sql(spark, d, "SELECT 'count( )' AS a, count( ) AS n FROM region -- count()")) == [("count( )", 5)]
    spark.range(3).createOrReplaceTempView("nation")
    assert rows(run_sql(spark, d, "SELECT count() FROM nation JOIN documents ON doc_id = n_nationkey")) == [(25,)]
    assert spark.table("nation").count() == 3 and not spark.catalog.tableExists("documents")
    spark.catalog.dropTempView("nation")


# Storage.


def test_parquet_round_trip_codecs_and_statistics(spark, tmp_path):
    d = spark.createDataFrame([(10, "alice"), (None, None), (30, "charlie"), (None, "bob"), (50, "")], tables.schema(id="INT32", name="STRING"))
    for codec, want in (("NONE", "UNCOMPRESSED"), ("SNAPPY", "SNAPPY"), ("ZSTD", "ZSTD")):
        path = str(tmp_path / f"{codec}.parquet")
        tables.write(d.coalesce(1), path, codec)
        assert sorted(rows(spark.read.parquet(path)), key=str) == sorted(rows(d), key=str)
        stats = {r["column"]: r for r in tables.row_groups(spark, path).collect()}
        assert stats["id"]["codec"] == want and (stats["id"]["low"], stats["id"]["high"], stats["id"]["nulls"]) == ("10", "50", 2)


def test_row_groups_are_skipped(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    tables.write(spark.range(400_000).withColumn("v", F.xxhash64("id")).coalesce(1), path, row_group_bytes=1 << 18, sort_by=["id"])
    groups = tables.row_groups(spark, path).filter("column = 'id'")
    assert groups.count() > 3
    kept = groups.filter(tables.might_match(F.col("low").cast("long"), F.col("high").cast("long"), "<", F.lit(100))).count()
    assert kept == 1
    plan = tables.scan(spark, str(tmp_path), "t", ["v"], "id < 100")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), LessThan(id,100)]" in plan


def test_other_formats_keep_nulls_and_odd_text(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "quoted", line\nand more', 0.1), (None, None, None), (3, "", float("inf")), (4, "\\N ü\\", -0.0)], "i bigint, s string, x double")
    for form in tables.FORMATS:
        tables.save(d, str(tmp_path / form), form)
        back = tables.load(spark, str(tmp_path / form), form, d.schema)
        assert sorted(rows(back), key=str) == sorted(rows(d), key=str), form


def test_footers_are_read_without_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write(spark.range(1000).repartition(3), path)
    groups = tables.row_groups(spark, path)
    assert groups.agg(F.sum("n_rows")).first()[0] == 1000 and groups.select("file").distinct().count() == 3
    assert "ReadSchema: struct<path:string>" in groups._jdf.queryExecution().toString()
    pruned = tables.pruned_groups(spark, path, "id", ">", 10**6).first()
    assert pruned["total"] == pruned["skipped"] == 3


def test_tables_by_range_have_many_files(spark, tmp_path, monkeypatch):
    """One task wrote the whole table."""
    monkeypatch.setattr(tables, "FILE_ROWS", 300)
    d = spark.range(1000).withColumn("v", F.xxhash64("id")).orderBy("v")
    tables.write_ranges(d, str(tmp_path / "t"), "id")
    groups = [(int(r["low"]), int(r["high"]), r["n_rows"]) for r in tables.row_groups(spark, str(tmp_path / "t")).filter("column = 'id'").collect()]
    assert len(groups) == 4 and sum(n for *_, n in groups) == 1000 and max(n for *_, n in groups) < 500
    groups.sort()
    assert all(a[1] < b[0] for a, b in zip(groups, groups[1:]))
    assert sorted(rows(spark.read.parquet(str(tmp_path / "t")))) == sorted(rows(d))
    tables.write_ranges(d.limit(0), str(tmp_path / "none"), "id")
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_registered_row_groups_are_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 1000)
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    n, top = lines.count(), lines.agg(F.max("l_orderkey")).first()[0]
    assert tables.row_groups(spark, catalogue._grouped(spark, d)).select("file").distinct().count() == -(-n // 1000) > 1
    assert [tuple(r)[3:] for r in catalogue.QUERIES["row_group_footers"](spark, d).collect()] == [(n, 0, "SNAPPY")]
    assert rows(catalogue.QUERIES["zone_map_pruning"](spark, d)) == [(True, lines.filter(F.col("l_orderkey") < top // 10).count())]


def test_might_match(spark):
    one = spark.range(1)
    for op, v, want in ((">", 10, False), (">", 9, True), (">=", 10, True), ("<", 1, False), ("<=", 1, True), ("=", 11, False), ("=", 5, True), ("!=", 5, True), ("like", 5, True)):
        assert one.select(tables.might_match(F.lit(1), F.lit(10), op, F.lit(v))).first()[0] is want, (op, v)
    assert one.select(tables.might_match(F.lit(None).cast("int"), F.lit(10), ">", F.lit(50))).first()[0] is False
    assert one.select(tables.might_match(F.lit(5), F.lit(5), "<>", F.lit(5))).first()[0] is False


def test_hash_partitions(spark, tmp_path):
    d = spark.range(1000).select(F.col("id").cast("int"), (F.col("id") * 100).alias("price"))
    tables.write_partitioned(d, str(tmp_path / "p"), "id", 4)
    back = spark.read.parquet(str(tmp_path / "p"))
    sizes = dict(rows(back.groupBy("partition_id").count()))
    assert sum(sizes.values()) == 1000 and all(200 < n < 300 for n in sizes.values())
    assert back.filter("partition_id <> pmod(id, 4)").count() == 0
    with pytest.raises(Exception, match="partitioning key is null"):
        spark.createDataFrame([(None,)], "id int").select(tables.partition_id(F.col("id"), 4)).collect()


def test_large_hash_partitions_have_many_files(spark, tmp_path, monkeypatch):
    """A partition was one task's, however large."""
    monkeypatch.setattr(tables, "FILE_ROWS", 100)
    d = spark.range(1000).select("id", (F.col("id") * 100).alias("price"))
    tables.write_partitioned(d, str(tmp_path / "p"), "id", 4)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(rows(back.select("id", "price"))) == sorted(rows(d)) and back.filter("partition_id <> pmod(id, 4)").count() == 0
    for i in range(4):
        assert len(list((tmp_path / "p" / f"partition_id={i}").glob("*.parquet"))) == 3
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 150


def test_bucketed_tables_join_without_a_shuffle(spark):
    for name in ("bucketed_a", "bucketed_b"):
        tables.write_bucketed(spark.range(1000).withColumn("v", F.col("id")), name, "id", 4, "overwrite")
    joined = spark.table("bucketed_a").hint("merge").join(spark.table("bucketed_b"), "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


# Encodings.


def numbered(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def test_dictionary(spark):
    d = numbered(spark, ["USA", "UK", "USA", "USA", "UK", None], "string")
    codes = encodings.dictionary(d, "i", "v")
    assert [r[1] for r in sorted(rows(codes))] == ["USA", "UK", None]
    encoded = encodings.dictionary_encode(d, "i", "v")
    assert [r[1] for r in sorted(rows(encoded))] == [0, 1, 0, 0, 1, 2]
    assert sorted(rows(encodings.dictionary_decode(encoded, codes, "i", "v"))) == sorted(rows(d))


@pytest.mark.parametrize("values", [[1, 1, 1, 2, 2, 3, 3, 3, 3], [], [7], [1, None, None, 1]])
def test_run_lengths(spark, values):
    d = numbered(spark, values, "int")
    runs = encodings.rle_encode(d, "i", "v")
    want = []
    for v in values:
        if want and want[-1][0] == v:
            want[-1][1] += 1
        else:
            want.append([v, 1])
    assert [list(r[1:]) for r in sorted(rows(runs), key=lambda r: r[0])] == want
    assert [r[1] for r in sorted(rows(encodings.rle_decode(runs, "v")), key=lambda r: r[0])] == values


@pytest.mark.parametrize("values", [[1000, 1000, 1001, 1002, 1003, 1005, 1010], [], [5], [-(2**40), 2**40]])
def test_deltas(spark, values):
    d = numbered(spark, values, "bigint")
    deltas = encodings.delta_encode(d, "i", "v")
    assert [r[1] for r in sorted(rows(deltas))] == [v - (values[k - 1] if k else 0) for k, v in enumerate(values)]
    assert sorted(rows(encodings.delta_decode(deltas, "i", "v"))) == sorted(rows(d))


# Vectors.


def test_distances(spark):
    d = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = rows(d.select(l2(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("b")), negative_dot(F.col("a"), F.col("b"))))
    assert got[0] == (5.0, pytest.approx(1 - 16 / math.sqrt(5 * 52)), -16.0)
    assert got[1][0] == 1.0 and math.isnan(got[1][1]) and got[1][2] == 0.0
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(l2(F.col("a"), F.col("b"))).collect()


def vectors(spark, n=400, dim=16):
    g = np.random.default_rng(1)
    x = (g.standard_normal((n, dim)) * g.uniform(0.2, 3, (n, 1))).astype(np.float32)
    x[7] = x[3]  # a tie
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_exact_neighbours(spark, metric):
    x, base = vectors(spark)
    q = x[3].astype(float)
    y = x.astype(float)
    d = {"l2": np.sqrt(((y - q) ** 2).sum(1)), "cosine": 1 - y @ q / (np.linalg.norm(y, axis=1) * np.linalg.norm(q)), "dot": -(y @ q)}[metric]
    want = sorted(range(len(d)), key=lambda i: (round(float(d[i]), 9), i))[:10]
    got = rows(vector.knn(base, q.tolist(), 10, metric).orderBy("rank"))
    assert [r[1] for r in got] == want and [r[2] for r in got] == sorted(r[2] for r in got)
    many = rows(vector.knn_join(base, base.filter("vec_id in (3, 11)"), 10, metric).filter("query_id = 3").orderBy("rank"))
    assert [r[2] for r in many] == want


def test_neighbour_bounds(spark):
    x, base = vectors(spark, 20)
    assert vector.knn(base, x[0].tolist(), 0).count() == 0
    assert vector.knn(base, x[0].tolist(), 50).count() == 20


def test_inverted_file_recall(spark):
    x, base = vectors(spark, 800)
    index = vector.build_ivf(base)
    hits = 0
    for i in (0, 50, 100, 150):
        exact = {r[1] for r in rows(vector.knn(base, x[i].tolist(), 10))}
        hits += len(exact & {r[1] for r in rows(index.search(spark, x[i].tolist(), 10))})
        assert exact == {r[1] for r in rows(index.search(spark, x[i].tolist(), 10, probes=len(index.centres)))}
    stored = [r["id"] for block in index.rows(spark).collect() for r in block["list"]]
    assert hits >= 36 and sorted(stored) == list(range(800))


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_inverted_file_many_queries(spark, metric, monkeypatch):
    x, base = vectors(spark, 1500)
    base = base.unionByName(spark.createDataFrame([(9000, None)], base.schema)).repartition(3)
    queries = base.filter("vec_id % 50 = 0")
    monkeypatch.setattr(vector, "BASE_BLOCK", 40)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    index = vector.build_ivf(base, metric=metric)
    assert 20 < len(index.centres) < 60 and 1 <= index.probes <= len(index.centres)
    got = rows(index.search_many(queries, 10).drop("distance"))
    assert sorted(r[:2] for r in got) == [(i, r) for i in range(0, 1500, 50) for r in range(1, 11)]
    exact = sorted(rows(vector.knn_join(base, queries, 10, metric).drop("distance")))
    assert len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in exact}) >= 0.9 * len(exact)
    assert exact == sorted(rows(index.search_many(queries, 10, probes=len(index.centres)).drop("distance")))
    one = rows(vector.knn(base, x[50].tolist(), 10, metric).orderBy("rank"))
    assert [r[1] for r in one] == [v for q, _, v in exact if q == 50]
    assert vector.build_ivf(base.limit(0), metric=metric).search_many(queries, 10).count() == 0
    assert vector.knn_join(base.limit(0), queries, 10, metric).count() == 0 and vector.knn_join(base, queries.limit(0), 10, metric).count() == 0


def test_searches_look_at_few_cells(spark):
    """Vectors in clear groups: a search reads the folders of some cells alone."""
    g = np.random.default_rng(2)
    middles = g.standard_normal((40, 16)) * 10
    base = spark.createDataFrame([(i, (middles[i % 40] + g.standard_normal(16)).tolist()) for i in range(2000)], "vec_id bigint, embedding array<float>")
    index = vector.build_ivf(base)
    assert index.probes * 4 < len(index.centres)
    found = {(r[0], r[2]) for r in rows(index.search_many(base.filter("vec_id % 50 = 0"), 10))}
    exact = {(r[0], r[2]) for r in rows(vector.knn_join(base, base.filter("vec_id % 50 = 0"), 10))}
    assert len(found & exact) >= 0.95 * len(exact)


def test_graph_of_a_few_vectors():
    g = np.random.default_rng(6)
    x = g.standard_normal((100, 8)).astype(np.float32)
    built = graph.Graph(x, m=4, ef=50)
    assert set(built.links[0]) == set(range(100))
    for layer, links in enumerate(built.links):
        assert all(len(n) <= (4 if layer else 8) and len(set(n.tolist())) == len(n) and i not in n for i, n in links.items())
        assert set(links) <= set(built.links[max(0, layer - 1)])
    same = graph.Graph.of(x, *built.tables())
    for q in g.standard_normal((30, 8)):
        exact = np.argsort(((x - q) ** 2).sum(1), kind="stable")[:5].tolist()
        found = built.search(q, 5, 50)
        assert len(set(found) & set(exact)) >= 4 and found == same.search(q, 5, 50)
        assert found == sorted(found, key=lambda i: float(((x[i] - q) ** 2).sum()))
    assert graph.Graph(x[:0]).search(x[0], 5) == [] and graph.Graph(x[:1]).search(x[0], 5) == [0] and built.search(x[0], 0) == []


def test_neighbours_are_diverse():
    """Of two that are close to each other only the closer is a neighbour, while others are left."""
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]], np.float32)
    built = graph.Graph(x, m=2, ef=10)
    assert built._diverse(x[0], [1, 2, 3, 4], 3).tolist() == [1, 3, 4] and built._diverse(x[0], [1, 2, 3], 3).tolist() == [1, 3, 2]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_graphs_of_shards(spark, metric, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 400)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 8)
    _, base = vectors(spark, 1000)
    base = base.unionByName(spark.createDataFrame([(9000, None)], base.schema)).repartition(3)
    queries = base.filter("vec_id % 50 = 0")
    index = graph.build_graph(base, metric=metric)
    stored = spark.read.parquet(index.path).collect()
    assert len(stored) == 3 and sorted(i for r in stored for i in r["ids"]) == list(range(1000))
    got = rows(index.search_many(queries, 10, ef=100))
    exact = {(r[0], r[2]): r[3] for r in rows(vector.knn_join(base, queries, 10, metric))}
    assert len(got) == len(exact) == 200
    hits = [(r[3], exact[r[0], r[2]]) for r in got if (r[0], r[2]) in exact]
    assert len(hits) >= 0.9 * len(exact) and all(a == pytest.approx(b) for a, b in hits)
    assert graph.build_graph(base.limit(0), metric=metric).search_many(queries, 10).count() == 0


def test_blocks_are_compared_in_small_matrices(monkeypatch):
    """A block of queries by a block of vectors was one matrix, and several copies of it."""
    g, shapes, rough = np.random.default_rng(3), [], vector._rough
    x, q = g.standard_normal((300, 8)), g.standard_normal((70, 8))
    args = (np.arange(300), x, np.arange(70) * 2, q, 5)
    whole = {m: vector.nearest(*args, m) for m in ("l2", "cosine", "dot")}
    monkeypatch.setattr(vector, "MATRIX", 3000)
    monkeypatch.setattr(vector, "_rough", lambda x, q, m: shapes.append((len(q), len(x))) or rough(x, q, m))
    for m, want in whole.items():
        assert all(np.array_equal(a, b) for a, b in zip(vector.nearest(*args, m), want, strict=True))
    assert shapes and max(a * b for a, b in shapes) <= 3000 and sum(a for a, _ in shapes) == 210


def test_copies_of_queries_are_not_broadcast(spark):
    _, base = vectors(spark, 200)
    plan = vector.knn_join(base, base.filter("vec_id % 50 = 0"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_queries_of_cells_are_not_broadcast(spark):
    """A query is in a block of each cell that it asks; the planner saw the size of their compressed files."""
    _, base = vectors(spark, 400)
    index = vector.build_ivf(base)
    found = index.search_many(base.filter("vec_id % 50 = 0"), 5)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_queries_are_given_out_in_small_batches(monkeypatch):
    monkeypatch.setattr(vector, "PLACED", 40)
    x = np.random.default_rng(3).standard_normal((100, 4)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "v"])
    out = list(vector._placer(x[:20].astype(float), 7, "l2", 0.0, True)(iter([batch])))
    assert max(map(len, out)) <= 40 and sum(map(len, out)) == 700
    got = pa.Table.from_batches(out)
    assert got["id"].to_pylist() == np.repeat(np.arange(100), 7).tolist()
    assert got["cell"].to_numpy().reshape(100, 7).tolist() == vector._cell_order(x.astype(float), x[:20].astype(float), 7).tolist()


def test_samples_are_the_least_hashes(spark):
    """The driver was sent a whole sample by each task."""
    d = spark.range(5000).select("id", F.array(F.col("id").cast("float")).alias("v")).repartition(8)
    want = [r["v"] for r in d.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(1000).collect()]
    assert [r["v"] for r in vector._least_hashes(d, 5000, 1000, 5)] == want
    assert [r["v"] for r in vector._least_hashes(d, 10**9, 1000, 5)] == want  # too few by a wrong count: all are sorted
    assert len(vector._least_hashes(d, 5000, 9000, 5)) == 5000


def test_graphs_are_few(spark, monkeypatch):
    """Each query is asked of every graph, whose number grew with the rows."""
    monkeypatch.setattr(graph, "SHARD_ROWS", 50)
    monkeypatch.setattr(graph, "SHARDS", 4)
    _, base = vectors(spark, 600)
    index = graph.build_graph(base)
    stored = spark.read.parquet(index.path).collect()
    assert len(stored) == 4 and sorted(i for r in stored for i in r["ids"]) == list(range(600))
    queries = base.filter("vec_id % 50 = 0")
    found = {(r[0], r[2]) for r in rows(index.search_many(queries, 10, ef=100))}
    exact = {(r[0], r[2]) for r in rows(vector.knn_join(base, queries, 10))}
    assert len(found) == len(exact) == 120 and len(found & exact) >= 0.9 * len(exact)


def test_graphs_are_asked_one_at_a_time():
    """A batch of graphs and queries was made Python objects as a whole."""
    x = np.random.default_rng(3).standard_normal((90, 4)).astype(np.float32)
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("dim", pa.int32()), ("entry", pa.int32()), ("layers", pa.list_(pa.binary())), ("asked", pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float32()))])))])
    stored = []
    for i in range(0, 90, 30):
        entry, layers = graph.Graph(x[i : i + 30]).tables()
        stored.append({"ids": list(range(i, i + 30)), "vectors": x[i : i + 30].tobytes(), "dim": 4, "entry": entry, "layers": [layer.tobytes() for layer in layers], "asked": [{"id": j, "v": x[j].tolist()} for j in (3, 40)]})
    out = list(graph._asker("l2", 0.0, 5, 40)(iter([pa.RecordBatch.from_pylist(stored, schema=kind)])))
    assert [b.num_rows for b in out] == [10, 10, 10]  # a batch for each graph and block of queries
    got = pa.Table.from_batches(out).to_pylist()
    best = {q: sorted((r["distance"], r["vec_id"]) for r in got if r["query_id"] == q)[:5] for q in (3, 40)}
    for q, near in best.items():
        assert [i for _, i in near] == np.argsort(((x.astype(float) - x[q]) ** 2).sum(1), kind="stable")[:5].tolist() and near[0] == (0, q)


def test_vectors_of_different_lengths_are_errors(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        vector.knn_join(d, d, 1).collect()


def test_registered_searches_take_every_fiftieth_vector(spark):
    d = "/root/testdata/sf0.1"
    want = {r[0] for r in spark.read.parquet(f"{d}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
    for ann, exact in (("ann_knn", "knn_many_l2"), ("ann_cosine", "knn_many_cosine"), ("ann_dot", "knn_many_dot")):
        exact = {(r["query_id"], r["vec_id"]) for r in catalogue.QUERIES[exact](spark, d).collect()}
        found = {(r["query_id"], r["vec_id"]) for r in catalogue.QUERIES[ann](spark, d).collect()}
        assert {q for q, _ in found} == want and len(found) == len(exact) == 10 * len(want)
        assert len(found & exact) / len(exact) >= 0.9


def test_whole_joins_and_sorts(spark):
    d = "/root/testdata/sf0.001"
    run = lambda name: rows(catalogue.QUERIES[name](spark, d))
    lines, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "customer"))
    joined = run("inner_join_1n_whole")
    assert len(joined) == lines.count() and max(r[0] for r in joined) >= 100
    assert run("pushdown_scan_agg_value")[0][0] == lines.filter("l_quantity < 24").count()
    suppliers = run("sort_multi_whole")
    assert suppliers == sorted(suppliers, key=lambda r: (r[0], -r[2], r[1])) and len(suppliers) == spark.read.parquet(f"{d}/supplier.parquet").count()
    nations = run("sort_nulls_whole")
    assert nations == sorted(nations, key=lambda r: (-1 if r[1] is None else r[1], r[0])) and len(nations) == 25
    assert [r[0] for r in run("hidden_sort_key_whole")] == [r["c_name"] for r in sorted(customers.collect(), key=lambda r: (-r["c_acctbal"], r["c_custkey"]))]


# Streaming.


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = events.windowed_totals(events.read_events(spark, str(tmp_path / "in")), late="400 days")
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r[0], r[1], r[2], round(r[3], 4))
    assert sorted(map(key, spark.table("totals").collect())) == sorted(map(key, events.windowed_totals(source).collect()))


def test_streams_of_sliding_windows_and_sessions(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    for name, plan in (("sliding", lambda d: events.windowed_totals(d, late="400 days", slide="20 minutes")), ("gaps", lambda d: events.sessions(d, late="400 days"))):
        stream = plan(events.read_events(spark, str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
        assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, plan(source).collect())), name


def test_sessions(spark):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r[0], r[3]) for r in rows(events.sessions(d))) == [(1, 1), (1, 2), (2, 1)]


def test_asof(spark):
    a = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id int, k string, t int")
    b = spark.createDataFrame([("k", 2, 20), ("k", 5, 50)], "k string, t int, v int")
    assert sorted((r["id"], r["asof_v"]) for r in R.asof_join(a, b, "k", "t", "t", "v").collect()) == [(1, 50), (2, None), (3, None)]
