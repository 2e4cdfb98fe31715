"""The nine marketplace tables: schemas, registry and loaders, and star-schema tables cast in their roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.sources import multiline

# --- fixed schemas: column names, types and keys of the source files ----------
SCHEMAS = {
    "orders": "order_id string NOT NULL, customer_id string NOT NULL, order_status string, order_purchase_timestamp timestamp, "
    "order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, "
    "order_estimated_delivery_date timestamp",
    "order_items": "order_id string NOT NULL, order_item_id int NOT NULL, product_id string NOT NULL, seller_id string NOT NULL, "
    "shipping_limit_date timestamp, price double, freight_value double",
    "order_reviews": "review_id string NOT NULL, order_id string NOT NULL, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date timestamp, review_answer_timestamp timestamp",
    "customers": "customer_id string NOT NULL, customer_unique_id string NOT NULL, customer_zip_code_prefix int, customer_city string, "
    "customer_state string",
    "sellers": "seller_id string NOT NULL, seller_zip_code_prefix int, seller_city string, seller_state string",
    "products": "product_id string NOT NULL, product_category_name string, product_name_lenght int, product_description_lenght int, "
    "product_photos_qty int, product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int",
    "order_payments": "order_id string NOT NULL, payment_sequential int, payment_type string, payment_installments int, payment_value double",
    "geolocation": "geolocation_zip_code_prefix int NOT NULL, geolocation_lat double, geolocation_lng double, geolocation_city string, "
    "geolocation_state string",
    "category_translation": "product_category_name string NOT NULL, product_category_name_english string",
}


@dataclass(frozen=True)
class Table:
    """What a table is: its keys, its role and the names under which it holds shared keys."""

    role: str
    pk: tuple[str, ...] | None = None
    fks: tuple[str, ...] = ()
    temporal: tuple[str, ...] = ()
    file: str = ""
    alias: dict[str, str] = field(default_factory=dict)


TABLES = {
    "orders": Table(
        "transactional", ("order_id",), ("customer_id",),
        ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"),
        "*orders_dataset.csv",
    ),
    "order_items": Table("transactional", ("order_id", "order_item_id"), ("order_id", "product_id", "seller_id"), ("shipping_limit_date",), "*order_items_dataset.csv"),
    "order_reviews": Table("free-text", None, ("order_id",), ("review_creation_date", "review_answer_timestamp"), "*order_reviews_dataset.csv"),
    "customers": Table("dimensional", ("customer_id",), (), (), "*customers_dataset.csv", {"zip_code_prefix": "customer_zip_code_prefix"}),
    "sellers": Table("dimensional", ("seller_id",), (), (), "*sellers_dataset.csv", {"zip_code_prefix": "seller_zip_code_prefix"}),
    "products": Table("dimensional", ("product_id",), ("product_category_name",), (), "*products_dataset.csv"),
    "order_payments": Table("transactional", ("order_id", "payment_sequential"), ("order_id",), (), "*order_payments_dataset.csv"),
    "geolocation": Table("geospatial", None, (), (), "*geolocation_dataset.csv", {"zip_code_prefix": "geolocation_zip_code_prefix"}),
    "category_translation": Table("taxonomy", ("product_category_name",), (), (), "product_category_name_translation.csv"),
}
SHARED_KEYS = ("order_id", "customer_id", "product_id", "seller_id", "zip_code_prefix", "product_category_name")


def schema_of(key: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[key])


def load(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A CSV table with its declared schema, found by the ending of its file name; malformed cells become null.  Only reviews span lines; they are put together from splits."""
    if key == "order_reviews":
        return multiline.read_csv(spark, f"{folder}/{TABLES[key].file}", schema_of(key))
    reader = spark.read.schema(schema_of(key)).option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    return reader.csv(f"{folder}/{TABLES[key].file}")


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {key: load(spark, folder, key) for key in TABLES}


def write(df: DataFrame, path: str) -> DataFrame:
    """`df` written as Parquet over what was there, and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- the star-schema tables in these roles -------------------------------------
STAR = {
    "region": Table("dimensional", ("r_regionkey",)),
    "nation": Table("dimensional", ("n_nationkey",), ("n_regionkey",), (), "", {"nationkey": "n_nationkey"}),
    "customer": Table("dimensional", ("c_custkey",), ("c_nationkey",), (), "", {"custkey": "c_custkey", "nationkey": "c_nationkey"}),
    "supplier": Table("dimensional", ("s_suppkey",), ("s_nationkey",), (), "", {"suppkey": "s_suppkey", "nationkey": "s_nationkey"}),
    "part": Table("dimensional", ("p_partkey",), (), (), "", {"partkey": "p_partkey"}),
    "orders": Table("transactional", ("o_orderkey",), ("o_custkey",), ("o_orderdate",), "", {"orderkey": "o_orderkey", "custkey": "o_custkey"}),
    "lineitem": Table(
        "transactional", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey", "l_suppkey"), ("l_shipdate",), "",
        {"orderkey": "l_orderkey", "partkey": "l_partkey", "suppkey": "l_suppkey"},
    ),
    "events": Table("free-text", None, ("user_id",), ("ts",), "", {"custkey": "user_id"}),
}
STAR_KEYS = ("orderkey", "custkey", "partkey", "suppkey", "nationkey")


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """orders, order_items, sellers, products, customers and order_reviews made of the star-schema tables.

    A line's delivery is its ship date and its estimate the order date; an order
    with status P is not delivered.  Stars are bands of an event's value, and the
    n-th event reviews the n-th order.
    """
    t = lambda name: star(spark, sf_dir, name)
    nations = t("nation").select("n_nationkey", F.col("n_name").alias("seller_state"))
    v = F.col("value")
    stars = 1 + sum(F.when(v >= x, 1).otherwise(0) for x in (10, 25, 45, 80))
    return {
        "orders": t("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        ),
        "order_items": t("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("delivered_date"), F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"), F.col("l_quantity").alias("quantity"),
        ),
        "sellers": t("supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("seller_id"), "seller_state"
        ),
        "products": t("part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")),
        "customers": t("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id")),
        "order_reviews": t("events").select(
            F.col("event_id").alias("review_id"), F.col("event_id").alias("order_id"), stars.cast("int").alias("review_score"),
            F.col("event_type").alias("review_comment_message"), F.col("ts").alias("review_creation_date"),
        ),
    }
