"""Catalog generation, counts and validation over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import validation as V
from ..schemas import PRODUCT_FIELDS
from ..sources import catalog, tables
from .registry import register, sql_values


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


BRANDS_SQL = _list_sql(C.BRANDS)
CATEGORIES_SQL = _list_sql(C.CATEGORIES)

GENERATED_SQL = f"""
gen as (
  select id, {BRANDS_SQL}[((id - 1) % {len(C.BRANDS)}) + 1] as brand,
         {CATEGORIES_SQL}[((id - 1) % {len(C.CATEGORIES)}) + 1] as category
  from (select p_partkey + 1 as id from part)
)"""

CATEGORY_CASE = ("case category " + " ".join(
    f"when '{k}' then {v}" for k, v in C.CATEGORY_IDS.items()) + " else 1 end")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One generated product per row of `part` (ids 1..|part|), so the
    # generated catalog scales with the driver data.
    ids = tables.load(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"))
    return catalog.generate_from_ids(ids)


@register("catalog_generate", f"""
with {GENERATED_SQL}
select cast(id as integer) as product_id, 'SKU-' || cast(id as varchar) as sku,
       brand as manufacturer, cast({CATEGORY_CASE} as integer) as category_id,
       cast(100 + id % 900 as integer) as weight, cast(id as integer) as some_other_id,
       'Product ' || brand || ' ' || cast(id as varchar) as name, category,
       'Description for product ' || cast(id as varchar) || ' in ' || category
         || ' category by ' || brand as description,
       brand
from gen
""")
def catalog_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic products for ids 1..|part|."""
    return _generated(spark, sf_dir)


@register("catalog_mix", f"""
with {GENERATED_SQL}
select brand, category, cast(count(*) as bigint) as product_count,
       cast(min(100 + id % 900) as integer) as min_weight,
       cast(max(100 + id % 900) as integer) as max_weight
from gen group by brand, category
""")
def catalog_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 per (brand, category) with the weight range."""
    return (_generated(spark, sf_dir).groupBy("brand", "category")
            .agg(F.count(F.lit(1)).cast("bigint").alias("product_count"),
                 F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")))


VALIDATION_CASES = [
    ("product_id < 1", C.MSG_PRODUCT_ID),
    ("strlen(sku) < 1 or strlen(sku) > 100", C.MSG_SKU),
    ("strlen(manufacturer) < 1 or strlen(manufacturer) > 200", C.MSG_MANUFACTURER),
    ("category_id < 1", C.MSG_CATEGORY_ID),
    ("weight < 0", C.MSG_WEIGHT),
    ("some_other_id < 1", C.MSG_SOME_OTHER_ID),
    ("strlen(name) < 1 or strlen(name) > 200", C.MSG_NAME),
    ("strlen(category) < 1 or strlen(category) > 100", C.MSG_CATEGORY),
    ("strlen(description) > 1000", C.MSG_DESCRIPTION),
    ("strlen(brand) < 1 or strlen(brand) > 100", C.MSG_BRAND),
]
FIRST_ERROR_SQL = "case " + " ".join(f"when {c} then '{m}'" for c, m in VALIDATION_CASES) + " end"
ALL_ERRORS_SQL = "concat_ws('; ', " + ", ".join(
    f"case when {c} then '{m}' end" for c, m in VALIDATION_CASES) + ")"


# One product in 16 of each kind: faults of every rule, and pairs of faults.
FAULTS = [
    (1, "product_id", "-1"), (2, "sku", "repeat('s', 101)"), (3, "manufacturer", "''"), (4, "category_id", "0"),
    (5, "weight", "-1"), (6, "some_other_id", "0"), (7, "name", "repeat('n', 201)"), (8, "category", "''"),
    (9, "description", "repeat('d', 1001)"), (10, "brand", "repeat('b', 101)"), (11, "sku", "''"), (11, "brand", "''"),
    (12, "weight", "-5"), (12, "name", "''"), (13, "sku", "repeat('é', 51)"), (14, "sku", "repeat('s', 100)"),
]


def faulty_sql(key: str, product_sql: str, skip: tuple[str, ...] = ()) -> str:
    """Products with the faults of their kind (``key`` modulo 16) as SQL that
    Spark and DuckDB read alike."""
    cases = {}
    for kind, field, value in FAULTS:
        if field not in skip:
            cases.setdefault(field, []).append(f"when {key} % 16 = {kind} then {value}")
    fields = [f"case {' '.join(cases[f])} else {f} end as {f}" if f in cases else f for f in PRODUCT_FIELDS]
    return f"select {key}, {', '.join(fields)} from ({product_sql}) pr"


def faulty(products: DataFrame, key: str, skip: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    cases = {}
    for kind, field, value in FAULTS:
        if field not in skip:
            cases[field] = cases.get(field, F).when(F.col(key) % 16 == kind, F.expr(value))
    return products.select(key, *keep, *[cases[f].otherwise(F.col(f)).alias(f) if f in cases else F.col(f) for f in PRODUCT_FIELDS])


FAULTY_SQL = faulty_sql("pk", f"select product_id as pk, * from ({catalog.PART_PRODUCT_SQL}) q")


def _faulty_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty(catalog.from_part(tables.load(spark, sf_dir, "part")).withColumn("pk", F.col("product_id")), "pk")


@register("validate_first_error", f"""
with prod as ({FAULTY_SQL})
select pk, {FIRST_ERROR_SQL} as first_error from prod
""")
def validate_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first failing rule per product (NULL = valid)."""
    return _faulty_parts(spark, sf_dir).select("pk", V.first_error().alias("first_error"))


@register("validate_all_errors", f"""
with prod as ({FAULTY_SQL})
select pk, {ALL_ERRORS_SQL} as all_errors,
       cast(({' + '.join(f'(case when {c} then 1 else 0 end)' for c, _ in VALIDATION_CASES)}) as integer) as n_errors
from prod
""")
def validate_all_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every failing rule per product, joined with '; ', and their count."""
    errs = V.all_errors()
    return _faulty_parts(spark, sf_dir).select("pk", F.array_join(errs, "; ").alias("all_errors"),
                                               F.size(errs).cast("int").alias("n_errors"))
