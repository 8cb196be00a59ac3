"""outcome of product requests (GET /products/{id}, POST .../details).

Input ``request_id, method, product_id_text, body``. The checks run in
the service's order and the first failure decides the status:
  GET : 400 bad id -> 404 missing -> 200 (product JSON)
  POST: 400 bad id -> 400 bad JSON -> 400 id mismatch -> 400 invalid
        product (first failing rule) -> 204
Accepted POST bodies are returned as ``product`` so they can be upserted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions import validation as V
from ..schemas import PRODUCT, PRODUCT_FIELDS
from ..sources import codec


def outcomes(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Outcome per request, in one pass over the input: rows are split on
    method and id first, so only POST bodies are decoded and only GET rows
    with a valid id reach the join (rows that need neither bypass both)."""
    r = requests.withColumn("path_id", S.parse_request_id("product_id_text"))
    r = r.withColumn("id_ok", S.valid_id("path_id")).withColumn("is_post", F.upper("method") == "POST")
    passthrough = [c for c in requests.columns if c != "body"]
    bad_id = S.error_record(C.ERR_INVALID_INPUT, C.MSG_INVALID_ID, C.DETAILS_INVALID_ID)
    error_type = "struct<error:string,message:string,details:string>"
    product_type = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in PRODUCT.fields).join(("struct<", ">"))

    def answer(df: DataFrame, status, error, body, accepted) -> DataFrame:
        return df.select(*passthrough, status.cast("int").alias("status_code"), error.cast(error_type).alias("error"),
                         body.cast("string").alias("response_body"), accepted.cast(product_type).alias("accepted"))

    none = F.lit(None)
    rejected = answer(r.where(~F.col("id_ok")), F.lit(400), bad_id, none, none)

    key_type = products.schema["product_id"].dataType
    cat = products.select(F.col("product_id").alias("_pk"), F.struct(*PRODUCT_FIELDS).alias("_product"))
    gets = r.where(F.col("id_ok") & ~F.col("is_post"))
    gets = gets.join(cat, gets["path_id"].cast(key_type) == cat["_pk"], "left")
    gone = F.col("_pk").isNull()
    got = answer(gets, F.when(gone, 404).otherwise(200),
                 F.when(gone, S.error_record(C.ERR_NOT_FOUND, C.MSG_NOT_FOUND, C.DETAILS_NOT_FOUND)),
                 F.when(~gone, F.to_json("_product")), none)

    posts = codec.decode_rows(r.where(F.col("id_ok") & F.col("is_post")), "body", "product")
    p = F.col("value")
    rule_error = V.first_error_of(p)
    err = (F.when(~F.col("ok"), S.error_record(C.ERR_INVALID_INPUT, C.MSG_INVALID_JSON, "malformed JSON body"))
            .when(~V.id_matches(p.getField("product_id"), F.col("path_id")),
                  S.error_record(C.ERR_INVALID_INPUT, C.MSG_ID_MISMATCH, C.DETAILS_ID_MISMATCH))
            .when(rule_error.isNotNull(), S.error_record(C.ERR_INVALID_INPUT, C.MSG_INVALID_DATA, rule_error)))
    posts = posts.withColumn("error", err)
    fine = F.col("error").isNull()
    posted = answer(posts, F.when(fine, 204).otherwise(400), F.col("error"), none, F.when(fine, p))
    return rejected.unionByName(got).unionByName(posted)
