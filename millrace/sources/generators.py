"""Tables that are computed rather than read: deterministic mock tables, distributions and a retail schema.

Everything is an expression of ``spark.range``, so any size is made in parallel and the same in every run.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names, rows and the SQL of each column over the row number id.
MOCK = {
    "__mock_table_1": (100, {"colA": "int(id)", "colB": "int(id * 100)"}),
    "__mock_table_2": (100, {"colC": "concat(id, '-💩')", "colD": "repeat('😇', int(id % 8))"}),
    "__mock_table_3": (100, {"colE": "if(id % 2 = 0, int(id), null)", "colF": "concat(id, '-💩')"}),
    "__mock_table_4": (100, {"colG": "nullif(int(id % 5), 0)", "colH": "if(id % 10 = 0, null, repeat('💩', int(id % 3 + 1)))"}),
    "__mock_table_123": (3, {"number": "int(id + 1)"}),
    "__mock_table_schedule": (7, {"day_of_week": "element_at(array('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'), int(id + 1))", "has_lecture": "int(id in (0, 2))"}),
    "__mock_table_schedule_2022": (7, {"day_of_week": "element_at(array('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'), int(id + 1))", "has_lecture": "int(id in (1, 3))"}),
    "__mock_agg_input_small": (1_000, {"v1": "int((id + 2) % 10)", "v2": "int(id)", "v3": "int((id + 50) % 100)", "v4": "int(id div 100)", "v5": "233", "v6": "repeat('💩', int(id % 8 + 1))"}),
    "__mock_agg_input_big": (10_000, {"v1": "int((id + 2) % 10)", "v2": "int(id)", "v3": "int((id + 50) % 100)", "v4": "int(id div 1000)", "v5": "233", "v6": "repeat('💩', int(id % 16 + 1))"}),
    "__mock_external_merge_sort_input": (100_000, {"v1": "int(id)", "v2": "int((id + 1777) % 15000)", "v3": "int((id + 3) % 111)"}),
    "__mock_graph": (100, {"src": "int(id % 10)", "dst": "int(id div 10)", "src_label": "int(id % 10 * 100)", "dst_label": "int(id div 10 * 100)", "distance": "if(id % 10 = id div 10, null, 1)"}),
    "__mock_t1": (1_000_000, {"x": "int(id div 10000)", "y": "int(id % 10000)", "z": "int(id)"}),
    "__mock_t4_1m": (1_000_000, {"x": "int(id % 500000)", "y": "int(id % 500000 * 10)"}),
    "__mock_t5_1m": (1_000_000, {"x": "int((id + 30000) % 500000)", "y": "int((id + 30000) % 500000 * 10)"}),
    "__mock_t6_1m": (1_000_000, {"x": "int((id + 60000) % 500000)", "y": "int((id + 60000) % 500000 * 10)"}),
    "__mock_t7": (1_000_000, {"v": "int(id % 20)", "v1": "int(id)", "v2": "int(id)"}),
    "__mock_t8": (10, {"v4": "int(id)"}),
    "__mock_t9": (10_000_000, {"x": "int(id div 10000)", "y": "int(10000000 - (id div 2 + ((id div 10000) % 2) * ((id div 2) % 2)))"}),
    "__mock_t10": (10_000, {"x": "int(id)", "y": "int(id * 10)"}),
    "__mock_t11": (1_000_000, {"x": "int(-(id % 1000) - 1)", "y": "int(id * 10)"}),
    "empty_table": (0, {"colA": "int(id)"}),
    "test_simple_seq_1": (10, {"col1": "int(id)"}),
    "test_simple_seq_2": (10, {"col1": "int(id)", "col2": "int(id + 10)"}),
}


def mock(spark: SparkSession, name: str, shuffled: bool = False, seed: int = 1) -> DataFrame:
    """A mock table; ``shuffled`` deals its rows out in another, seeded order.  Names may go without the underscores in front."""
    rows, columns = MOCK[name if name in MOCK else f"__{name}"]
    out = spark.range(rows).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return out.orderBy(F.xxhash64(F.lit(seed), *out.columns)) if shuffled else out


def serial(start: int = 0) -> Column:
    return F.col("id") + start


def uniform(low: int, high: int, seed: int) -> Column:
    """Whole numbers from low to high, a function of the row number and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(high - low + 1)) + low


def cyclic(low: int, high: int) -> Column:
    return F.pmod(F.col("id"), F.lit(high - low + 1)) + low


def zipf(n: int, s: float, seed: int) -> Column:
    """1..n with probabilities falling about as rank ** -s (inverse of the continuous law; s above 1)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 1) / float(1 << 52)
    top = n ** (1 - s)
    return F.least(F.lit(n), F.floor(F.pow(1 - u * (1 - top), 1 / (1 - s)))).cast("long")


def nullable(value: Column, share: float, seed: int) -> Column:
    return F.when(uniform(0, 999_999, seed) >= int(share * 1_000_000), value)


def generated(spark: SparkSession, rows: int, columns: dict[str, Column]) -> DataFrame:
    return spark.range(rows).select(*[c.alias(n) for n, c in columns.items()])


def test_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "test_1": generated(spark, 1000, {"colA": serial().cast("int"), "colB": uniform(0, 9, 1).cast("int"), "colC": uniform(0, 9999, 2).cast("int"), "colD": uniform(0, 99999, 3).cast("int")}),
        "test_2": generated(spark, 100, {"colA": serial().cast("int"), "colB": nullable(uniform(0, 999, 4), 0.1, 5).cast("int"), "colC": nullable(cyclic(0, 9), 0.1, 6).cast("int")}),
    }


def _pick(values: tuple[str, ...], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), uniform(1, len(values), seed).cast("int"))


def retail(spark: SparkSession, warehouses: int = 50, products: int = 1000, customers: int = 50_000, orders: int = 100_000, seed: int = 42) -> dict[str, DataFrame]:
    """Seven tables of a retail business: five lines an order, two warehouses' stock for ten products in a hundred."""
    day = lambda s: F.timestamp_seconds(F.lit(1_704_067_200) + uniform(0, 365 * 86_400 - 1, s)).cast("timestamp_ntz")
    one = lambda name: F.concat(F.lit(name), F.col("id"))
    cents = lambda low, high, s: uniform(low, high, s) / 100.0
    key = F.col("id").cast("int")
    item = ((F.col("id") * 5) % F.lit(products) + F.col("line")) % products + 1
    stock = spark.range(warehouses * products).select((F.floor(F.col("id") / products) + 1).cast("int").alias("warehouse_id"), (F.col("id") % products + 1).cast("int").alias("product_id"), "id")
    lines = spark.range(1, orders + 1).withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(5))))
    line_id = F.col("id") * 5 + F.col("line")
    return {
        "warehouses": spark.range(1, warehouses + 1).select(key.alias("id"), one("warehouse-").alias("name"), _pick(("north", "south", "east", "west"), seed).alias("location"), uniform(1000, 9999, seed + 1).cast("int").alias("capacity"), F.lit("active").alias("status")),
        "products": spark.range(1, products + 1).select(key.alias("id"), one("product-").alias("name"), F.format_string("SKU-%06d", "id").alias("sku"), _pick(("tools", "toys", "food", "books", "garden"), seed + 2).alias("category"), cents(100, 99_999, seed + 3).alias("unit_price")),
        "inventory": stock.select("warehouse_id", "product_id", uniform(0, 500, seed + 4).cast("int").alias("quantity"), F.format_string("A-%03d", F.pmod("id", F.lit(200))).alias("shelf_location"), day(seed + 5).alias("last_updated")),
        "customers": spark.range(1, customers + 1).select(key.alias("id"), one("customer-").alias("name"), one("street ").alias("address"), F.format_string("555-%07d", "id").alias("phone"), _pick(("basic", "silver", "gold"), seed + 6).alias("membership_level")),
        "orders": spark.range(1, orders + 1).select(key.alias("id"), uniform(1, customers, seed + 7).cast("int").alias("customer_id"), day(seed + 8).alias("order_date"), _pick(("pending", "paid", "shipped", "done"), seed + 9).alias("status"), cents(500, 500_000, seed + 10).alias("total_amount")),
        "order_items": lines.select(F.col("id").cast("int").alias("order_id"), item.cast("int").alias("product_id"), (F.pmod(F.xxhash64(F.lit(seed + 11), line_id), F.lit(9)) + 1).cast("int").alias("quantity"), ((F.pmod(F.xxhash64(F.lit(seed + 12), line_id), F.lit(99_900)) + 100) / 100.0).alias("unit_price")),
        "shipments": spark.range(1, orders + 1).select(key.alias("id"), key.alias("order_id"), uniform(1, warehouses, seed + 13).cast("int").alias("warehouse_id"), _pick(("packed", "sent", "arrived"), seed + 14).alias("status"), F.format_string("TRK%09d", "id").alias("tracking_no"), day(seed + 15).alias("ship_date"), nullable(day(seed + 16), 0.2, seed + 17).alias("arrive_date")),
    }


#: Fixed foreign keys of the retail tables, all cascading: (parent, key, child, column).
RETAIL_KEYS = (
    ("warehouses", "id", "inventory", "warehouse_id"),
    ("warehouses", "id", "shipments", "warehouse_id"),
    ("products", "id", "inventory", "product_id"),
    ("products", "id", "order_items", "product_id"),
    ("customers", "id", "orders", "customer_id"),
    ("orders", "id", "order_items", "order_id"),
    ("orders", "id", "shipments", "order_id"),
)
