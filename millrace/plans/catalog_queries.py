"""Definitions, changes, exports and errors as queries: each works on a database of its own in the shared folder."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import CatalogError, Database, Warehouse
from millrace.operators import dml
from millrace.operators.sets import ObservedRemoveSet
from millrace.plans.registry import query
from millrace.sources import generators, sinks
from millrace.sources.staging import place
from millrace.sources.tables import load
from millrace.types import ColumnDef, Schema


def _database(spark: SparkSession, name: str = "shop") -> Database:
    return Warehouse(spark, place(spark, "warehouse")).create_database(name)


def _nations(spark: SparkSession, sf_dir: str, rule: str = "CASCADE") -> Database:
    """Regions and their nations, with a foreign key."""
    region, nation = load(spark, sf_dir, "region", "nation")
    db = _database(spark)
    db.create_table("region", Schema((ColumnDef("id", "int"), ColumnDef("name", "varchar(25)", False)), ("id",)))
    db.create_table("nation", Schema((ColumnDef("id", "int"), ColumnDef("name", "varchar(25)"), ColumnDef("region_id", "int"), ColumnDef("level", "int", default=1)), ("id",)))
    db.insert("region", region.select("r_regionkey", "r_name"))
    db.insert("nation", nation.select("n_nationkey", "n_name", "n_regionkey"), ["id", "name", "region_id"])
    db.execute_ddl(f"REGISTER_FK region.id nation.region_id {rule}")
    return db


def _fails(action, kind: type[Exception]) -> bool:
    try:
        action()
    except kind:
        return True
    return False


# ---- definition -------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_id, 1 AS level FROM nation")
def ddl_create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE with types, keys and defaults, filled by INSERT ... SELECT."""
    return _nations(spark, sf_dir).table("nation")


@query("SELECT * FROM (VALUES ('create again', TRUE), ('if not exists', FALSE), ('drop absent', TRUE), ('if exists', FALSE), ('dropped', TRUE)) t(step, failed)")
def ddl_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, schema = _database(spark), Schema((ColumnDef("id", "int"),))
    db.create_table("t", schema)
    steps = [
        ("create again", _fails(lambda: db.create_table("T", schema), CatalogError)),
        ("if not exists", _fails(lambda: db.create_table("t", schema, if_not_exists=True), CatalogError)),
        ("drop absent", _fails(lambda: db.drop_table("u"), CatalogError)),
        ("if exists", _fails(lambda: db.execute_ddl("DROP TABLE IF EXISTS u"), CatalogError)),
    ]
    db.execute_ddl("DROP TABLE t;")
    return spark.createDataFrame([*steps, ("dropped", _fails(lambda: db.table("t"), CatalogError))], "step string, failed boolean")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def ddl_create_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index orders the files that are written from then on; a lookup reads them by their statistics."""
    db = _nations(spark, sf_dir)
    db.execute_ddl("CREATE INDEX by_region ON nation USING btree (region_id, id)")
    db.update("nation", F.col("level") == 1, level=F.lit(2))
    return db.table("nation").where("region_id = 2").select("id", "name")


@query("SELECT * FROM (VALUES ('none yet', FALSE), ('twice', TRUE), ('other case', FALSE), ('null', FALSE)) t(step, failed)")
def ddl_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark)
    db.create_table("t", Schema((ColumnDef("a", "varchar(9)"),)))
    db.execute_ddl("CREATE UNIQUE INDEX one ON t (a)")
    add = lambda v: _fails(lambda: db.insert("t", spark.createDataFrame([(v,)], "a string")), CatalogError)
    return spark.createDataFrame([(n, add(v)) for n, v in (("none yet", "x"), ("twice", "x"), ("other case", "X"), ("null", None))], "step string, failed boolean")


@query("SELECT * FROM (VALUES ('left'), ('right')) t(\"Database\")")
def ddl_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE and DROP DATABASE, SHOW DATABASES."""
    w = Warehouse(spark, place(spark, "warehouse"))
    for name in ("left", "middle", "Right"):
        w.create_database(name)
    w.drop_database("middle")
    return w.show_databases()


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def ddl_qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("SELECT n.name AS n_name, r.name AS r_name FROM shop.nation n JOIN shop.region r ON n.region_id = r.id")


@query("SELECT * FROM (VALUES ('null name', 'not null name: 1'), ('key twice', 'unique id: 1'), ('key taken', 'unique id: 1'), ('right', 'none')) t(step, broken)")
def ddl_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)

    def broken(rows: list) -> str:
        try:
            db.insert("region", spark.createDataFrame(rows, "id int, name string"))
        except CatalogError as e:
            return str(e)
        return "none"

    steps = [("null name", [(90, None)]), ("key twice", [(91, "a"), (91, "b")]), ("key taken", [(0, "c")]), ("right", [(92, "d")])]
    return spark.createDataFrame([(n, broken(rows)) for n, rows in steps], "step string, broken string")


@query("SELECT * FROM (VALUES ('id', 'int', 'NO', 'PRI', NULL, 'auto_increment'), ('name', 'varchar(25)', 'YES', '', NULL, ''), ('region_id', 'int', 'YES', '', NULL, ''), ('level', 'int', 'YES', '', '1', '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).describe("nation")


@query("SELECT * FROM (VALUES ('nation'), ('region')) t(\"Tables_in_shop\")")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).show_tables()


@query("SELECT TRUE AS scans, TRUE AS joins, TRUE AS pushes")
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _nations(spark, sf_dir).explain("SELECT n.name FROM nation n JOIN region r ON n.region_id = r.id WHERE n.id < 9")
    return spark.createDataFrame([("Scan parquet" in text, "Join" in text, "PushedFilters" in text)], "scans boolean, joins boolean, pushes boolean")


# ---- changes ----------------------------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM region WHERE r_regionkey = 1) + (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS gone, (SELECT count(*) FROM region WHERE r_regionkey <> 1) AS regions, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS nations")
def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    return spark.createDataFrame([(db.delete("region", F.col("id") == 1), db.table("region").count(), db.table("nation").count())], "gone long, regions long, nations long")


@query("SELECT TRUE AS refused, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS nations")
def fk_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir, "RESTRICT")
    refused = _fails(lambda: db.delete("region", F.col("id") == 1), dml.RestrictError)
    return spark.createDataFrame([(refused, db.table("region").count(), db.table("nation").count())], "refused boolean, regions long, nations long")


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS region_id FROM nation")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir, "SET_NULL")
    db.delete("region", F.col("id") == 1)
    return db.table("nation").select("id", "region_id")


@query("SELECT * FROM (VALUES (1, 'scan', 0), (2, 'delete', 0), (3, 'lookup', 0), (4, 'insert', 1), (5, 'scan', 1), (6, 'lookup', 1), (7, 'delete', 1), (8, 'scan', 0), (9, 'lookup', 0)) t(step, action, n)")
def empty_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark)
    db.create_table("t1", Schema((ColumnDef("v1", "int"),)))
    scan, lookup = lambda: db.table("t1").count(), lambda: db.table("t1").where("v1 = 1").count()
    steps = [("scan", scan()), ("delete", db.delete("t1", F.lit(True)))]
    db.create_index("t1", "t1v1", ["v1"])
    steps += [("lookup", lookup()), ("insert", db.insert("t1", spark.createDataFrame([(1,)], "v int"))), ("scan", scan()), ("lookup", lookup())]
    steps += [("delete", db.delete("t1", F.lit(True))), ("scan", scan()), ("lookup", lookup())]
    return spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(steps, 1)], "step int, action string, n int")


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_name) + (SELECT max(r_regionkey) FROM region) AS INT), n_name FROM nation")
def append_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended rows without a key are numbered on; old rows stay where they lie."""
    db = _nations(spark, sf_dir)
    db.insert("region", load(spark, sf_dir, "nation")[0].select("n_name"), ["name"])
    return db.table("region")


# ---- exports and change log -------------------------------------------------------------------------------------------------


def _exported(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    rows = part.select("p_partkey", "p_name", "p_size", F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"))
    path = place(spark, kind) + "/out"
    sinks.export(rows, path, kind)
    reader = spark.read.schema(rows.schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


PARTS = "SELECT p_partkey, p_name, p_size, CASE WHEN p_size > 10 THEN p_retailprice END AS price FROM part"


@query(PARTS)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "csv")


@query(PARTS)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "json")


@query(PARTS)
def export_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exported(spark, sf_dir, "orc")


@query("SELECT * FROM (SELECT 2 AS segment, 'update' AS event, count(*) AS n, TRUE AS intact FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 3, 'delete', count(*), TRUE FROM nation WHERE n_regionkey = 3)")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three segments, of which the first is purged."""
    (nation,) = load(spark, sf_dir, "nation")
    path = place(spark, "log") + "/events"
    for number, event in enumerate(("insert", "update", "delete"), 1):
        sinks.rotate_log(spark, path)
        sinks.log_changes(path, "nation", event, nation.where(F.col("n_regionkey") == number))
    sinks.purge_log(spark, path, 2)
    return sinks.read_changes(spark, path).groupBy("segment", "event").agg(F.count("*").alias("n"), F.bool_and("is_intact").alias("intact"))


# ---- names and errors -------------------------------------------------------------------------------------------------------


@query("SELECT n_name, N_NATIONKEY AS n_key FROM NATION WHERE N_RegionKey = 2")
def case_insensitive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    (nation,) = load(spark, sf_dir, "nation")
    return nation.where(F.col("N_RegionKey") == 2).select(F.col("n_NAME").alias("n_name"), F.col("N_NATIONKEY").alias("n_key"))


@query("SELECT * FROM (VALUES ('ambiguous column'), ('unknown column'), ('unknown table'), ('aggregate in where'), ('window in where'), ('column not grouped'), ('window without order'), ('union of other widths'), ('subquery of two columns')) t(what)")
def rejected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that have no meaning are refused before they run."""
    for name, df in zip(("region", "nation"), load(spark, sf_dir, "region", "nation")):
        df.createOrReplaceTempView(name)
    texts = {
        "ambiguous column": "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey",
        "unknown column": "SELECT nothing FROM region",
        "unknown table": "SELECT 1 FROM no_such_table_here",
        "aggregate in where": "SELECT r_name FROM region WHERE max(r_regionkey) > 1",
        "window in where": "SELECT r_name FROM region WHERE rank() OVER (ORDER BY r_name) > 1",
        "column not grouped": "SELECT r_name, count(*) FROM region GROUP BY r_regionkey",
        "window without order": "SELECT rank() OVER () FROM region",
        "union of other widths": "SELECT 1 UNION ALL SELECT 1, 2",
        "subquery of two columns": "SELECT (SELECT r_regionkey, r_name FROM region)",
        "right": "SELECT r_name FROM region",
    }
    refused = [(n,) for n, text in texts.items() if _fails(lambda text=text: spark.sql(text).schema, AnalysisException)]
    return spark.createDataFrame(refused, "what string")


@query("SELECT * FROM (VALUES ('sqrt of a minus', TRUE), ('sqrt', FALSE), ('division by zero', FALSE)) t(what, failed)")
def scalar_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions import scalar

    one = spark.range(1)
    tries = {"sqrt of a minus": scalar.checked_sqrt(F.col("id") - 1.0), "sqrt": scalar.checked_sqrt(F.col("id") + 4.0), "division by zero": scalar.safe_div(F.col("id") + 1, F.col("id"))}
    return spark.createDataFrame([(n, _fails(lambda c=c: one.select(c).collect(), Exception)) for n, c in tries.items()], "what string, failed boolean")


# ---- computed tables --------------------------------------------------------------------------------------------------------

#: What the mock tables hold, over their row numbers.
POOP, INNOCENT = "💩", "😇"


@query(f"""SELECT i || '-{POOP}' AS "colC", repeat('{INNOCENT}', CAST(i % 8 AS INT)) AS "colD", CASE WHEN i % 2 = 0 THEN CAST(i AS INT) END AS "colE", CAST(nullif(i % 5, 0) AS INT) AS "colG", CASE WHEN i % 10 <> 0 THEN repeat('{POOP}', CAST(i % 3 + 1 AS INT)) END AS "colH" FROM range(100) t(i)""")
def mock_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables with strings and nulls, side by side by row number."""
    columns = {c: e for n in ("__mock_table_2", "__mock_table_3", "__mock_table_4") for c, e in generators.MOCK[n][1].items() if c != "colF"}
    return spark.range(100).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


@query(f"SELECT CAST((i + 2) % 10 AS INT) AS v1, CAST(count(*) AS BIGINT) AS n, CAST(min(i) AS INT) AS low, CAST(max((i + 50) % 100) AS INT) AS high, CAST(sum(i // 1000) AS BIGINT) AS total, max(repeat('{POOP}', CAST(i % 16 + 1 AS INT))) AS longest FROM range(10000) t(i) GROUP BY (i + 2) % 10")
def mock_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = generators.mock(spark, "__mock_agg_input_big")
    return big.groupBy("v1").agg(F.count("*").alias("n"), F.min("v2").alias("low"), F.max("v3").alias("high"), F.sum("v4").alias("total"), F.max("v6").alias("longest"))


@query("SELECT CAST(i AS INT) AS v1, CAST((i + 1777) % 15000 AS INT) AS v2, CAST((i + 3) % 111 AS INT) AS v3 FROM range(100000) t(i) ORDER BY v2, v3, v1")
def mock_external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.mock(spark, "__mock_external_merge_sort_input").orderBy("v2", "v3", "v1")


@query("SELECT CAST(i AS INT) AS r, day, CAST(i IN (0, 2) AS INT) AS now, CAST(i IN (1, 3) AS INT) AS before FROM (SELECT unnest(range(7)) AS i, unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS day) t")
def mock_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = (generators.mock(spark, n) for n in ("__mock_table_schedule", "__mock_table_schedule_2022"))
    days = spark.createDataFrame([(i, d) for i, d in enumerate(("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))], "r int, day string")
    return days.join(now.toDF("day", "now"), "day").join(before.toDF("day", "before"), "day").select("r", "day", "now", "before")


@query("SELECT CAST(i % 10 AS INT) AS src, CAST(count(CASE WHEN i % 10 <> i // 10 THEN 1 END) AS BIGINT) AS edges, CAST(sum(i // 10 * 100) AS BIGINT) AS labels, CAST(min(i % 10 * 100) AS INT) AS label FROM range(100) t(i) GROUP BY i % 10")
def mock_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.mock(spark, "__mock_graph").groupBy("src").agg(F.count("distance").alias("edges"), F.sum("dst_label").alias("labels"), F.min("src_label").alias("label"))


@query("SELECT * FROM (VALUES ('uniform', TRUE), ('serial', TRUE), ('cyclic', TRUE), ('zipf', TRUE), ('nullable', TRUE)) t(kind, holds)")
def generated_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each distribution promises, on a hundred thousand rows."""
    n = 100_000
    rows = generators.generated(spark, n, {"u": generators.uniform(1, 10, 3), "s": generators.serial(5), "c": generators.cyclic(0, 3), "z": generators.zipf(1000, 1.2, 4), "k": generators.nullable(generators.serial(), 0.2, 5)})
    share = lambda c: F.count_if(c) / n
    checks = {
        "uniform": (F.min("u") == 1) & (F.max("u") == 10) & (F.countDistinct("u") == 10) & (F.abs(F.avg("u") - 5.5) < 0.1),
        "serial": (F.min("s") == 5) & (F.max("s") == n + 4) & (F.countDistinct("s") == n),
        "cyclic": (F.countDistinct("c") == 4) & (share(F.col("c") == 3) == 0.25),
        "zipf": (F.min("z") == 1) & (F.max("z") <= 1000) & (share(F.col("z") == 1) > share(F.col("z") == 2)) & (share(F.col("z") == 2) > share(F.col("z") == 9)),
        "nullable": F.abs(share(F.col("k").isNull()) - 0.2) < 0.01,
    }
    one = rows.agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("holds")) for k in checks])).alias("x")).select("x.kind", "x.holds")


@query("SELECT * FROM (VALUES ('warehouses', 50, 0), ('products', 1000, 0), ('inventory', 50000, 0), ('customers', 50000, 0), ('orders', 100000, 0), ('order_items', 500000, 0), ('shipments', 100000, 0)) t(table_name, n, orphans)")
def retail_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each generated retail table and of them those whose foreign keys lead nowhere."""
    tables = generators.retail(spark)
    out = None
    for name, t in tables.items():
        lost = [t.join(tables[p].select(F.col(k).alias("__k")), F.col(c) == F.col("__k"), "left_anti").agg(F.count("*").alias("o")) for p, k, child, c in generators.RETAIL_KEYS if child == name]
        orphans = lost[0] if lost else spark.range(1).select(F.lit(0).cast("long").alias("o"))
        for other in lost[1:]:
            orphans = orphans.unionByName(other)
        one = t.agg(F.count("*").cast("int").alias("n")).crossJoin(orphans.agg(F.sum("o").cast("int").alias("orphans"))).select(F.lit(name).alias("table_name"), "n", "orphans")  # a row each
        out = one if out is None else out.unionByName(one)
    return out


# ---- headline queries on the mock tables, at their sizes --------------------------------------------------------------------


def _mock_sql(spark: SparkSession, text: str, *names: str) -> DataFrame:
    for n in names:
        generators.mock(spark, n).createOrReplaceTempView(n)
    return spark.sql(text)


def _ranges(**tables: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in tables.items()) + " "


_T4 = "SELECT CAST((i + {0}) % 500000 AS INT) AS x, CAST((i + {0}) % 500000 * 10 AS INT) AS y FROM range(1000000) t(i)"
_JOIN = """SELECT count(*) AS n, max(a.x) AS ax, max(a.y) AS ay, max(b.x) AS bx, max(b.y) AS by_, max(c.x) AS cx, max(c.y) AS cy FROM __mock_t4_1m a, __mock_t5_1m b, __mock_t6_1m c
WHERE a.x = b.x AND c.y = b.y AND a.y >= 1000000 AND a.y < 1500000 AND c.x < 150000 AND c.x >= 100000"""


@query(_ranges(__mock_t4_1m=_T4.format(0), __mock_t5_1m=_T4.format(30000), __mock_t6_1m=_T4.format(60000)) + _JOIN)
def mock_leaderboard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock_sql(spark, _JOIN, "__mock_t4_1m", "__mock_t5_1m", "__mock_t6_1m")


_UNUSED = ", ".join(f"{e} AS u{i}" for i, e in enumerate(["min(v1)", "max(v2)", "min(v2)", "max(v1) + min(v1)", "max(v2) + min(v2)"] * 9))
_WIDE = f"SELECT v, d1, d2 FROM (SELECT v, max(v1) AS d1, max(v1) + max(v1) + max(v2) AS d2, {_UNUSED} FROM __mock_t7 LEFT JOIN (SELECT v4 FROM __mock_t8 WHERE 1 = 2) e ON v < v4 GROUP BY v) w"


@query(_ranges(__mock_t7="SELECT CAST(i % 20 AS INT) AS v, CAST(i AS INT) AS v1, CAST(i AS INT) AS v2 FROM range(1000000) t(i)", __mock_t8="SELECT CAST(i AS INT) AS v4 FROM range(10) t(i)") + _WIDE)
def mock_leaderboard_wide_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock_sql(spark, _WIDE, "__mock_t7", "__mock_t8")


_RANK = "SELECT x, y FROM (SELECT x, y, rank() OVER (PARTITION BY x ORDER BY y) AS place FROM __mock_t9) r WHERE place <= 3 ORDER BY y LIMIT 10"


@query(_ranges(__mock_t9="SELECT CAST(i // 10000 AS INT) AS x, CAST(10000000 - (i // 2 + ((i // 10000) % 2) * ((i // 2) % 2)) AS INT) AS y FROM range(10000000) t(i)") + _RANK)
def mock_leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock_sql(spark, _RANK, "__mock_t9")


@query("SELECT CAST(i // 10000 AS INT) AS x, CAST(i % 10000 AS INT) AS y, CAST(i AS INT) AS z FROM range(1000000) t(i) WHERE i // 10000 >= 90 AND i % 10000 = 10")
def mock_leaderboard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark)
    db.create_table("t1", Schema((ColumnDef("x", "int"), ColumnDef("y", "int"), ColumnDef("z", "int"))))
    db.create_index("t1", "t1xy", ["x", "y"])
    db.insert("t1", generators.mock(spark, "__mock_t1"))
    return db.table("t1").where("x >= 90 AND y = 10")


_EMPTY = "SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM __mock_t10 a JOIN __mock_t11 b ON a.x = b.x"


@query(_ranges(__mock_t10="SELECT CAST(i AS INT) AS x, CAST(i * 10 AS INT) AS y FROM range(10000) t(i)", __mock_t11="SELECT CAST(-1 * (i % 1000) - 1 AS INT) AS x, CAST(i * 10 AS INT) AS y FROM range(1000000) t(i)") + _EMPTY)
def mock_leaderboard_empty_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock_sql(spark, _EMPTY, "__mock_t10", "__mock_t11")


# ---- replicated sets --------------------------------------------------------------------------------------------------------


@query("SELECT n_name AS value FROM nation WHERE n_regionkey <> 2 OR n_nationkey % 2 = 0 UNION SELECT r_name FROM region")
def observed_remove_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the nations: one removes a region's, the other adds some of them again and the regions; the additions that weren't seen win."""
    region, nation = load(spark, sf_dir, "region", "nation")
    start = ObservedRemoveSet(nation.select(F.col("n_name").alias("value"), F.concat(F.lit("a"), "n_nationkey").alias("tag")))
    one = start.remove(nation.where("n_regionkey = 2").select(F.col("n_name").alias("value")))
    again = nation.where("n_regionkey = 2 AND n_nationkey % 2 = 0").select(F.col("n_name").alias("value"), F.concat(F.lit("b"), "n_nationkey").alias("tag"))
    other = start.add(again).add(region.select(F.col("r_name").alias("value"), F.concat(F.lit("c"), "r_regionkey").alias("tag")))
    return one.merge(other).elements()
