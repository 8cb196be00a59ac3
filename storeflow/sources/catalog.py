"""Product catalogs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..schemas import PRODUCT, PRODUCT_FIELDS


def product_row(product_id: Column, name: Column, category: Column, brand: Column,
                description: Column) -> list[Column]:
    """The columns of a new product (sku, manufacturer = brand, ...)."""
    pid = product_id.cast("int")
    return [
        pid.alias("product_id"),
        S.sku_of(pid).alias("sku"),
        brand.alias("manufacturer"),
        S.category_id(category).alias("category_id"),
        S.generated_weight(pid).alias("weight"),
        pid.alias("some_other_id"),
        name.alias("name"),
        category.alias("category"),
        description.alias("description"),
        brand.alias("brand"),
    ]


def generate_from_ids(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """S1 for an arbitrary id column: brand and category cycle with the id."""
    pid = F.col(id_col)
    brand = S.cyclic_pick(C.BRANDS, pid)
    category = S.cyclic_pick(C.CATEGORIES, pid)
    name = F.format_string(C.NAME_FORMAT, brand, pid)
    desc = F.format_string(C.DESCRIPTION_FORMAT, pid, category, brand)
    return ids.select(*product_row(pid, name, category, brand, desc))


def generate(spark: SparkSession, n: int = C.CATALOG_SIZE, partitions: int | None = None) -> DataFrame:
    """The deterministic catalog with ids 1..n (distributed ``range``)."""
    return generate_from_ids(spark.range(1, n + 1, numPartitions=partitions))


def empty(spark: SparkSession) -> DataFrame:
    """S3: an empty catalog."""
    return spark.createDataFrame([], PRODUCT)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All products of a stored catalog (unordered)."""
    return spark.read.schema(PRODUCT).parquet(path).select(*PRODUCT_FIELDS)


def count(products: DataFrame) -> DataFrame:
    """A1: product count as a one-row DataFrame."""
    return products.agg(F.count(F.lit(1)).cast("bigint").alias("product_count"))


def from_part(part: DataFrame) -> DataFrame:
    """Product view of the driver's ``part`` table.

    ``product_id`` keeps the source type so range predicates on it reach the
    parquet scan unchanged (a narrowing cast would block the pushdown).
    """
    key = F.col("p_partkey")
    return part.select(
        key.alias("product_id"),
        F.concat(F.lit("SKU-"), key.cast("string")).alias("sku"),
        F.col("p_brand").alias("manufacturer"),
        S.category_id("p_type").alias("category_id"),
        F.col("p_size").cast("int").alias("weight"),
        key.alias("some_other_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.lit("").alias("description"),
        F.col("p_brand").alias("brand"),
    )


PART_PRODUCT_SQL = """
  select p_partkey as product_id, 'SKU-' || cast(p_partkey as varchar) as sku,
         p_brand as manufacturer,
         cast(coalesce(case p_type when 'Electronics' then 1 when 'Books' then 2
              when 'Home' then 3 when 'Sports' then 4 when 'Clothing' then 5
              when 'Beauty' then 6 when 'Toys' then 7 when 'Automotive' then 8 end, 1) as integer)
           as category_id,
         cast(p_size as integer) as weight, p_partkey as some_other_id,
         p_name as name, p_type as category, '' as description, p_brand as brand
  from part"""
