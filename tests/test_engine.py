"""Semantics on small and generated tables: the expected rows are written out."""

import pytest
from pyspark.sql import functions as F

from millrace import catalog, types
from millrace.functions import scalar
from millrace.operators import aggregates, dml, joins, paths, scan, sketches, sorting, windows
from millrace.sources import generators, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types():
    assert types.sql_type("varchar(20)")[1] == 20 and types.sql_type("NUMERIC(10, 2)")[0].simpleString() == "double"
    assert types.sql_type("numeric(10,2)", exact_decimals=True)[0].simpleString() == "decimal(10,2)"
    assert types.sql_type("double precision")[0].simpleString() == "double" and types.sql_type("vector(3)")[1] == 3
    for bad in ("json", "vector", "int[]"):
        with pytest.raises(ValueError):
            types.sql_type(bad)


def test_vectors_have_their_length(spark):
    schema = types.Schema((types.ColumnDef("v", "vector(3)"), types.ColumnDef("n", "int", default=7)))
    ok = spark.sql("SELECT array(1.0D, 2.0D, 3.0D) AS v")
    assert rows(schema.conform(ok)) == [([1.0, 2.0, 3.0], 7)]
    with pytest.raises(Exception, match="takes vectors of 3"):
        schema.conform(spark.sql("SELECT array(1.0D) AS v")).collect()


def test_group_aggregates_on_mock_table(spark):
    t = generators.mock(spark, "mock_agg_input_small")
    got = rows(t.groupBy("v4").agg(F.count("*"), F.sum("v2"), F.min("v1"), F.max("v1")).orderBy("v4"))
    assert got == [(k, 100, 100 * 100 * k + 4950, 0, 9) for k in range(10)]
    assert rows(aggregates.aggregate(t, ["v5"], having=F.col("n") > 5, n=F.count("*"))) == [(233, 1000)]


def test_null_groups_on_mock_table(spark):
    t = generators.mock(spark, "mock_table_4")
    assert sorted(rows(t.groupBy("colG").count()), key=str) == sorted([(None, 20), (1, 20), (2, 20), (3, 20), (4, 20)], key=str)
    assert t.where("colH IS NULL").count() == 10


def test_aggregates_of_nothing(spark):
    t = generators.mock(spark, "empty_table")
    assert rows(t.agg(F.count("*"), F.count("colA"), F.sum("colA"), F.min("colA"), aggregates.count_or_null("colA"))) == [(0, 0, None, None, None)]
    assert rows(t.groupBy("colA").count()) == []


def test_mock_tables_have_their_sizes(spark):
    for name, (n, _) in generators.MOCK.items():
        if n <= 100_000:
            assert generators.mock(spark, name).count() == n
    assert sorted(rows(generators.mock(spark, "mock_table_1", shuffled=True))) == [(i, i * 100) for i in range(100)]


def test_distributions(spark):
    t = generators.test_tables(spark)
    assert t["test_1"].count() == 1000 and rows(t["test_1"].agg(F.min("colB"), F.max("colB"))) == [(0, 9)]
    assert 0 < t["test_2"].where("colB IS NULL").count() < 40
    z = generators.generated(spark, 20_000, {"z": generators.zipf(100, 1.5, 3)})
    got = dict(rows(z.groupBy("z").count()))
    assert min(got) >= 1 and max(got) <= 100 and got[1] > got[2] > got[5]


def test_retail_keys_hold_and_cascade(spark):
    t = generators.retail(spark, warehouses=4, products=20, customers=30, orders=50)
    assert t["inventory"].count() == 80 and t["order_items"].count() == 250
    assert t["order_items"].select("order_id", "product_id").distinct().count() == 250
    keys = [dml.ForeignKey(*k) for k in generators.RETAIL_KEYS]
    for k in keys:
        assert t[k.child].join(t[k.parent], t[k.child][k.column] == t[k.parent][k.key], "left_anti").count() == 0
    after, gone = dml.delete_cascade(t, keys, "customers", F.col("id") == 3)
    n = t["orders"].where("customer_id = 3").count()
    assert gone["customers"].count() == 1 and gone["orders"].count() == n and gone["order_items"].count() == 5 * n and gone["shipments"].count() == n
    for k in keys:
        assert after[k.child].join(after[k.parent], after[k.child][k.column] == after[k.parent][k.key], "left_anti").count() == 0


def test_restrict_and_set_null(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    c = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "k int, p int")
    with pytest.raises(dml.RestrictError):
        dml.delete_cascade({"p": p, "c": c}, [dml.ForeignKey("p", "id", "c", "p", "RESTRICT")], "p", F.col("id") == 1)
    after, gone = dml.delete_cascade({"p": p, "c": c}, [dml.ForeignKey("p", "id", "c", "p", "SET_NULL")], "p", F.col("id") == 1)
    assert sorted(rows(after["c"]), key=str) == [(10, None), (11, 2), (12, None)] and list(gone) == ["p"]


def test_self_reference_stops(spark):
    t = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "id int, boss int")
    after, gone = dml.delete_cascade({"t": t}, [dml.ForeignKey("t", "id", "t", "boss")], "t", F.col("id") == 3)
    assert sorted(rows(after["t"])) == [(1, 0), (2, 1)]
    assert sorted(r[0] for r in rows(gone["t"])) == [3, 4, 5]


def test_changes_on_null_predicates(spark):
    t = spark.createDataFrame([(1, 5), (2, None)], "id int, v int")
    assert rows(dml.delete(t, F.col("v") > 1)) == [(2, None)]
    assert sorted(rows(dml.update(t, F.col("v") > 1, v=F.col("id") + 10, id=F.col("v")))) == [(2, None), (5, 11)]
    assert dml.affected(t, F.col("v") > 1) == 1


def test_keys_are_numbered_on(spark):
    t = spark.createDataFrame([(7, "a")], "id int, s string")
    new = spark.createDataFrame([(None, s) for s in "dcb"] + [(20, "z")], "id int, s string")
    assert sorted(rows(dml.with_keys(t, new, "id", ["s"]))) == [(20, "z"), (21, "b"), (22, "c"), (23, "d")]
    empty = t.limit(0)
    assert sorted(rows(dml.with_keys(empty, new.where("id is null"), "id", ["s"]))) == [(1, "b"), (2, "c"), (3, "d")]


def test_null_order(spark):
    t = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    order = lambda **k: [r[0] for r in rows(sorting.sort(t, [sorting.order_key("v", **k)]))]
    assert order() == [None, 1, 2] and order(descending=True) == [2, 1, None]
    assert order(nulls="last") == [1, 2, None] and order(descending=True, nulls="first") == [None, 2, 1]
    assert len(rows(sorting.limit(t, -1))) == 3 and len(rows(sorting.limit(t, 2, 2))) == 1


def test_window_frames(spark):
    t = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2)], "v int, p int")
    got = sorted(rows(t.select("v", F.sum("v").over(windows.over(["p"], ["v"])).alias("s"), F.rank().over(windows.over([], ["v"])).alias("r"))))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 4, 3), (3, 3, 4)]
    assert sorted(rows(windows.top_per_group(t, ["p"], ["v"], 1, ties=True))) == [(1, 1), (1, 1), (3, 2)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "m")], "k int, y string")
    assert sorted(rows(joins.join(a, b, ["k"]))) == [(1, "a", "p"), (1, "a", "q")]
    assert joins.join(a, b, ["k"], "full").count() == 5 and joins.join(a, b, kind="cross").count() == 9
    assert joins.join(a, b, ["k"], "anti").count() == 2 and joins.natural_join(a, b).columns == ["k", "x", "y"]
    assert sorted(rows(joins.salted_join(a, b, ["k"], 3, "left").select("x", "y")), key=str) == sorted([("a", "p"), ("a", "q"), ("b", None), ("n", None)], key=str)
    with pytest.raises(ValueError):
        joins.salted_join(a, b, ["k"], 3, "right")


def test_hops_on_mock_graph(spark):
    g = generators.mock(spark, "mock_graph")
    got = paths.k_hops(g, 2)
    assert got.count() == 100 and rows(got.where("src = dst").agg(F.min("distance"), F.max("distance"))) == [(2, 2)]


def test_scalars(spark):
    t = spark.createDataFrame([(7, 0), (7, 2), (None, 1)], "a int, b int")
    assert rows(t.select(scalar.safe_div(F.col("a"), F.col("b")), scalar.safe_mod(F.col("a"), F.col("b")))) == [(None, None), (3.5, 1), (None, None)]
    with pytest.raises(TypeError):
        scalar.upper(F.lit(1), "int")
    with pytest.raises(Exception, match="square root"):
        t.select(scalar.checked_sqrt(F.lit(-1.0))).collect()
    got = rows(t.limit(1).select(scalar.format_timestamp(scalar.epoch(F.lit(86_400))), scalar.format_timestamp(scalar.parse_timestamp(F.lit("2024-02-03"))), scalar.vector(F.lit(1), F.lit(2))))
    assert got == [("1970-01-02 00:00:00", "2024-02-03 00:00:00", [1.0, 2.0])]


def test_sketches(spark):
    t = generators.mock(spark, "mock_agg_input_big")
    n = sketches.merge_distinct(sketches.distinct_sketch(t, ["v4"], "v2")).first()["n_distinct"]
    assert abs(n - 10_000) < 500
    s = sketches.CountMin.of(t, "v1", 64, 4)
    assert rows(s.top(t, "v1", 3)) == [(0, 1000), (1, 1000), (2, 1000)]
    assert rows(s.merge(s).top(t, "v1", 1)) == [(0, 2000)]
    with pytest.raises(ValueError):
        s.merge(sketches.CountMin.of(t, "v1", 32, 4))
    with pytest.raises(ValueError):
        sketches.CountMin(0, 1, s.cells)


def test_plans(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    explain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = explain(scan.lookup(li, "l_orderkey", [7]).select("l_quantity"))
    assert "PushedFilters: [" in p and "l_orderkey" in p and "l_comment" not in p and "l_tax" not in p
    assert "TakeOrderedAndProject" in explain(sorting.top_n(li, ["l_orderkey"], 5))
    assert "WindowGroupLimit" in explain(windows.top_per_group(li, ["l_partkey"], [F.desc("l_tax")], 2))
    never = li.join(li.where("1 = 2").select(F.col("l_orderkey").alias("k")), F.col("l_orderkey") < F.col("k"), "left").groupBy("l_returnflag").count()
    assert "Join" not in explain(never)


def test_database_round_trip(spark, tmp_path):
    w = catalog.Warehouse(spark, f"file://{tmp_path}")
    db = w.create_database("shop")
    assert rows(w.show_databases()) == [("shop",)]
    with pytest.raises(catalog.CatalogError):
        w.create_database("shop")
    w.create_database("shop", if_not_exists=True)
    c = types.ColumnDef
    db.create_table("customers", types.Schema((c("id", "int"), c("name", "varchar(20)", False), c("level", "int", default=1)), ("id",)))
    db.create_table("orders", types.Schema((c("id", "int"), c("customer_id", "int")), ("id",)))
    db.create_table("orders", types.Schema((c("id", "int"),)), if_not_exists=True)
    with pytest.raises(catalog.CatalogError):
        db.create_table("orders", types.Schema((c("id", "int"),)))
    assert db.insert("customers", spark.createDataFrame([("b",), ("a",)], "n string"), ["name"]) == 2
    assert rows(db.table("shop.customers").orderBy("id")) == [(1, "a", 1), (2, "b", 1)]
    with pytest.raises(catalog.CatalogError, match="unique id"):
        db.insert("customers", spark.createDataFrame([(1, "x", 1)], "i int, n string, l int"))
    with pytest.raises(catalog.CatalogError, match="not null name"):
        db.insert("customers", spark.createDataFrame([(9, None, 1)], "i int, n string, l int"))
    db.insert("orders", spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "i int, c int"))
    db.execute_ddl("REGISTER_FK customers.id orders.customer_id CASCADE")
    db.execute_ddl("CREATE UNIQUE INDEX by_name ON customers USING btree (name)")
    assert db.update("customers", F.col("id") == 2, level=F.col("level") + 4) == 1
    assert rows(db.sql("SELECT o.id, c.level FROM shop.orders o JOIN customers c ON o.customer_id = c.id WHERE c.id = 2")) == [(3, 5)]
    assert db.delete("customers", F.col("name") == "a") == 3
    assert rows(db.table("orders")) == [(3, 2)] and rows(db.table("customers")) == [(2, "b", 5)]
    assert db.delete("customers", F.col("id") == 77) == 0
    assert rows(db.describe("customers"))[0] == ("id", "int", "NO", "PRI", None, "auto_increment")
    assert sorted(r[0] for r in rows(db.show_tables())) == ["customers", "orders"] and db.show_tables().columns == ["Tables_in_shop"]
    assert "Scan" in db.explain("SELECT * FROM customers")
    with pytest.raises(catalog.CatalogError, match="unique name"):  # by the index
        db.insert("customers", spark.createDataFrame([("b",)], "n string"), ["name"])
    db.execute_ddl("DROP TABLE orders")
    db.drop_table("orders", if_exists=True)
    with pytest.raises(catalog.CatalogError):
        db.table("orders")
    w.drop_database("shop")
    assert rows(w.show_databases()) == []


def test_inserts_append_and_writers_conflict(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(catalog, "PARTS", 3)
    monkeypatch.setattr(catalog, "KEPT", 4)
    db = catalog.Warehouse(spark, f"file://{tmp_path}").create_database("d")
    db.create_table("t", types.Schema((types.ColumnDef("a", "int"), types.ColumnDef("b", "varchar(5)"))))
    add = lambda v: db.insert("t", spark.createDataFrame([(v, "x")], "a int, b string"))
    add(1)
    first = {f for f in os.listdir(f"{tmp_path}/d/t")}
    add(2)
    assert first < set(os.listdir(f"{tmp_path}/d/t")) and len(db.state()[1]["t"]["parts"]) == 2  # what was there stays
    add(3)
    add(4)
    assert len(db.state()[1]["t"]["parts"]) == 1 and sorted(r.a for r in db.table("t").collect()) == [1, 2, 3, 4]
    number, tables = db.state()
    add(5)
    with pytest.raises(catalog.ConflictError):
        db._publish(number, tables)
    assert db.table("t").count() == 5 and len(db._numbers()) <= 5
    assert not [f for f in os.listdir(f"{tmp_path}/d/_state") if f.startswith("_") or "tmp" in f]


def test_a_crash_before_the_state_is_published_changes_nothing(spark, tmp_path, monkeypatch):
    db = catalog.Warehouse(spark, f"file://{tmp_path}").create_database("d")
    c = types.ColumnDef
    for name in ("p", "q"):
        db.create_table(name, types.Schema((c("id", "int"), c("up", "int"))))
        db.insert(name, spark.createDataFrame([(1, 1), (2, 2)], "id int, up int"))
    db.register_foreign_key("p", "id", "q", "up")
    monkeypatch.setattr(catalog.Database, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        db.delete("p", F.col("id") == 1)
    assert db.table("p").count() == db.table("q").count() == 2
    monkeypatch.undo()
    assert db.delete("p", F.col("id") == 1) == 2 and db.table("p").count() == db.table("q").count() == 1


def test_cascades_beyond_the_depth_raise(spark):
    n = dml.MAX_DEPTH + 2
    tables = {f"t{i}": spark.createDataFrame([(1, 1)], "id int, up int") for i in range(n)}
    keys = [dml.ForeignKey(f"t{i}", "id", f"t{i + 1}", "up") for i in range(n - 1)]
    with pytest.raises(dml.DepthError):
        dml.delete_cascade(tables, keys, "t0", F.col("id") == 1)
    after, _ = dml.delete_cascade(tables, keys[:-1], "t0", F.col("id") == 1)
    assert after[f"t{n - 2}"].count() == 0


def test_exports(spark, tmp_path):
    t = spark.createDataFrame([(1, "it's", 1.5), (2, None, None)], "id int, s string, d double")
    sinks.dump_sql(t, "t", str(tmp_path / "dump"), batch=1)
    text = [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert sorted(text) == sorted(["DROP TABLE IF EXISTS t;", "CREATE TABLE t (id INTEGER, s VARCHAR, d DOUBLE);", "BEGIN;", "INSERT INTO t (id, s, d) VALUES (1, 'it''s', 1.5);", "INSERT INTO t (id, s, d) VALUES (2, NULL, NULL);", "COMMIT;"])
    for kind in ("csv", "json", "parquet", "orc"):
        sinks.export(t, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    log = str(tmp_path / "log")
    sinks.log_changes(log, "t", "insert", t)
    sinks.log_changes(log, "t", "delete", t.limit(1))
    assert rows(sinks.read_changes(spark, log).groupBy("event").agg(F.count("*"), F.min("is_intact")).orderBy("event")) == [("delete", 1, True), ("insert", 2, True)]
    assert sinks.rotate_log(spark, log) == 2
    sinks.log_changes(log, "t", "update", t)
    assert sinks.purge_log(spark, log, 9) == 1 and rows(sinks.read_changes(spark, log).groupBy("event", "segment").count()) == [("update", 2, 2)]


def test_stream_to_table(spark, sf, tmp_path):
    from millrace.streaming import running

    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(source)
    counts = running.windowed_counts(running.follow(spark, source), "ts", "event_type", "1 day", "1 hour")
    running.to_table(counts.select(F.col("window.start").alias("day"), "event_type", "n"), str(tmp_path / "out"), str(tmp_path / "state"))
    n = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0 < n <= 1000


def test_observed_remove_sets(spark):
    from millrace.operators.sets import ObservedRemoveSet

    frame = lambda *pairs: spark.createDataFrame(list(pairs), "value string, tag int")
    a, b = ObservedRemoveSet(frame(("x", 1), ("y", 2))), ObservedRemoveSet(frame(("x", 3)))
    values = lambda s: sorted(r.value for r in s.elements().collect())
    gone = a.remove(frame(("x", 0), ("z", 0)))
    assert values(gone) == ["y"] and values(gone.merge(a)) == ["y"] and values(a.merge(gone)) == ["y"]
    assert values(gone.merge(b)) == values(b.merge(gone)) == ["x", "y"]  # the other addition wasn't seen
    assert values(gone.merge(b).remove(frame(("x", 0)))) == ["y"] and values(gone.add(frame(("x", 4)))) == ["x", "y"]
    assert sorted(rows(gone.contains(frame(("x", 0), ("y", 0))))) == [("x", False), ("y", True)]
    assert values(gone.merge(gone)) == ["y"]
