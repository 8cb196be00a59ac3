"""Bounded product search for tables of queries.

Semantics per query (q, max_check, max_results):
  * non-positive max_check / max_results fall back to 100 / 20 (P12);
  * the probe walks ids 1..max_check; an id above the wrap size (100000)
    is reduced once by the wrap size, a missing id still counts as checked,
    and an id probed twice counts twice (L1, L3);
  * a product matches when lower(q) is a literal substring of lower(name)
    or lower(category) (F7; ``%`` and ``_`` are plain characters);
  * a catalog row counts by itself, also when ids repeat;
  * total_found counts every match, the result list keeps the first
    max_results matches in probe order (L2, W2, A3, A4).

Plan shape: requests are reduced to distinct search keys first (many
requests share a key). A key of n characters can only match where all its
grams of min(n, 3) characters occur, so the products of each gram are kept as
bitmaps of ids (posting lists) and the lists of a key's grams are intersected;
texts are read for the ids that remain. There is one way for every number of
keys and products. Postings, candidates and hits are narrow (ids, row hash,
position); product columns are joined to the result lists last. Counts use
partial aggregation and the top-N uses a window group limit, so a key that
matches a third of the catalog never sends its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..schemas import PRODUCT_FIELDS
from ..session import materialize

KEY = ["q_lower", "max_check", "max_results"]
GRAM = 3


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Add the folded query, defaults and the F6 check to search requests."""
    return requests.select(
        "query_id",
        "q",
        F.lower(F.coalesce(F.col("q"), F.lit(""))).alias("q_lower"),
        S.positive_or_default("max_check", C.DEFAULT_MAX_CHECK).alias("max_check"),
        S.positive_or_default("max_results", C.DEFAULT_MAX_RESULTS).alias("max_results"),
        (F.coalesce(F.col("q"), F.lit("")) != "").alias("q_present"),
        *[c for c in ("elapsed_ms",) if c in requests.columns],
    )


def _prepared_products(products: DataFrame, id_upper: int | None) -> DataFrame:
    """Narrow product rows: id, row hash, folded texts."""
    p = products
    if id_upper is not None:
        # L1 range predicate; reaches the parquet scan as a pushed filter.
        p = p.where((F.col("product_id") >= C.SEARCH_START_ID) & (F.col("product_id") <= id_upper))
    return p.select("product_id", _row_hash().alias("_row"),
                    F.lower("name").alias("name_l"), F.lower("category").alias("cat_l"))


def _row_hash() -> Column:
    return F.xxhash64(*PRODUCT_FIELDS)


def _text_match(q: Column) -> Column:
    return F.contains(F.col("name_l"), q) | F.contains(F.col("cat_l"), q)


def _grams(text: Column, k: int) -> Column:
    """The distinct k-character parts of a text (the empty text for k = 0)."""
    if k == 0:
        return F.array(F.lit(""))
    n = F.greatest(F.char_length(text) - F.lit(k - 1), F.lit(1))
    return F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, k)),
                    lambda g: F.char_length(g) == k)


def postings(prod: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, bucket, ids): for each wanted gram the product ids that have it,
    as bitmaps of 32768 ids each. Only ids and grams are shuffled."""
    in_product = F.array_distinct(F.flatten(F.array(
        *[_grams(F.coalesce(c, F.lit("")), k) for k in lengths for c in (F.col("name_l"), F.col("cat_l"))])))
    told = prod.select("product_id", F.explode(in_product).alias("gram")).join(wanted, "gram", "left_semi")
    return (told.groupBy("gram", F.bitmap_bucket_number("product_id").alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("product_id")).alias("ids")))


def _ids(bitmaps: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and product_id, for every id set in (bucket, ids)."""
    byte = lambda n: F.substring(F.col("ids"), n + 1, 1)
    full = F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda n: byte(n) != F.unhex(F.lit("00")))
    rows = bitmaps.select(*columns, "bucket", "ids", F.explode(full).alias("_byte"))
    value = F.conv(F.hex(byte(F.col("_byte"))), 16, 10).cast("int")
    rows = rows.select(*columns, "bucket", "_byte", value.alias("_value"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("_value"), k) == 1)
    rows = rows.select(*columns, "bucket", (F.col("_byte") * 8).alias("_at"), F.explode(bits).alias("_bit"))
    at = (F.col("_at") + F.col("_bit")).cast("bigint")
    return rows.select(*columns, F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + at + 1)
                       .otherwise(F.col("bucket") * 32768 - at).alias("product_id"))


def candidate_ids(prod: DataFrame, keys: DataFrame, gram_lengths: list[int]) -> DataFrame:
    """(key, product_id) of the products that have all grams of a key: the
    postings of its grams are intersected before any text is read, so a key
    made of common grams only keeps the few products that have all of them."""
    lengths = sorted(set(gram_lengths)) or [GRAM]
    own = [F.when(F.least(F.char_length("q_lower"), F.lit(GRAM)) == k, _grams(F.col("q_lower"), k)) for k in lengths]
    kg = keys.select(*KEY, F.array_distinct(F.coalesce(*own)).alias("_grams"))
    kg = kg.select(*KEY, F.size("_grams").alias("_all"), F.explode("_grams").alias("gram"))
    lists = postings(prod, kg.select("gram").distinct(), lengths)
    met = (kg.join(lists, "gram").groupBy(*KEY, "_all", "bucket")
             .agg(F.bitmap_and_agg("ids").alias("ids"), F.count(F.lit(1)).alias("_met")).where("_met = _all"))
    return _ids(met.where(F.bitmap_count("ids") > 0), *KEY)


def _candidates(prod: DataFrame, keys: DataFrame, gram_lengths: list[int]) -> DataFrame:
    """(product_id, _row, key) of every match: the candidates' texts, tested."""
    met = candidate_ids(prod, keys, gram_lengths).withColumnRenamed("product_id", "_id")
    return (prod.join(met, prod["product_id"] == met["_id"].cast(prod.schema["product_id"].dataType))
                .where(_text_match(F.col("q_lower"))).select("product_id", "_row", *KEY))


def search_keys(keys: DataFrame) -> tuple[DataFrame, dict]:
    """Materialize the distinct search keys once and read their statistics
    in one small job: largest max_check (static range predicate), largest
    max_results (window group limit) and the gram lengths of the equi-join."""
    keys = materialize(keys.select(*KEY).distinct(), "search-keys")
    r = keys.agg(F.max("max_check").alias("mc"),
                 F.max("max_results").alias("mr"),
                 F.collect_set(F.least(F.char_length("q_lower"), F.lit(GRAM))).alias("gl")).first()
    stats = {"max_check": int(r["mc"] or 0),
             "max_results": int(r["mr"] or C.DEFAULT_MAX_RESULTS), "gram_lengths": list(r["gl"] or [])}
    return keys, stats


def match_positions(products: DataFrame, keys: DataFrame, *, bounded: bool = True,
                    wrap: int = C.SEARCH_WRAP, stats: dict | None = None) -> DataFrame:
    """Every (key, product, probe position) hit as narrow rows; duplicates
    from the wrap and from repeated ids are kept.

    ``keys`` has columns q_lower, max_check, max_results. With
    ``bounded=False`` the whole catalog is probed in id order. Pass the
    output of ``search_keys`` as (keys, stats) to reuse its statistics.
    """
    if stats is None:
        keys, stats = search_keys(keys)
    prod = _prepared_products(products, stats["max_check"] if bounded else None)
    hits = _candidates(prod, keys, stats["gram_lengths"])
    if not bounded:
        return hits.withColumn("pos", F.col("product_id").cast("bigint"))
    # positions of a product in the probe walk: id-1 (if id <= wrap) and
    # id-1+wrap (if id+wrap <= max_check); none beyond max_check.
    pid = F.col("product_id").cast("bigint")
    passes = F.filter(F.array(F.lit(0), F.lit(1)),
                      lambda k: ((k == 0) & (pid <= wrap)) | ((k == 1) & (pid + wrap <= F.col("max_check"))))
    return (hits.where((F.col("product_id") >= C.SEARCH_START_ID) & (F.col("product_id") <= F.col("max_check")))
                .withColumn("pass", F.explode(passes))
                .withColumn("pos", pid - 1 + F.col("pass").cast("bigint") * wrap)
                .drop("pass"))


def totals(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """A3: total_found per key, zero-hit keys kept (partial aggregation)."""
    counts = hits.groupBy(*KEY).agg(F.count(F.lit(1)).cast("bigint").alias("total_found"))
    return (keys.select(*KEY).distinct().join(counts, KEY, "left")
                .withColumn("total_found", F.coalesce("total_found", F.lit(0).cast("bigint"))))


def top_matches(hits: DataFrame, cap: int) -> DataFrame:
    """First max_results hits per key in probe order, with rank.

    ``cap`` is a literal upper bound of max_results; the literal lets
    Catalyst plan a WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*KEY).orderBy("pos", "product_id", "_row")
    rn = F.row_number().over(w)
    return (hits.withColumn("rank", rn)
                .where((F.col("rank") <= F.lit(cap)) & (F.col("rank") <= F.col("max_results")))
                .withColumn("rank", F.col("rank").cast("bigint")))


def result_lists(top: DataFrame, products: DataFrame, id_upper: int | None = None) -> DataFrame:
    """A4: the capped result list per key, ordered by probe position. Of the
    products only those inside the probe bound are read, and of these the
    ranked ones kept, before anything is shuffled by all columns."""
    full = products
    if id_upper is not None:
        full = full.where((F.col("product_id") >= C.SEARCH_START_ID) & (F.col("product_id") <= id_upper))
    ranked = top.select("product_id", "_row").distinct()
    full = full.select(*PRODUCT_FIELDS, _row_hash().alias("_row")).join(ranked, ["product_id", "_row"], "left_semi").dropDuplicates(["product_id", "_row"])
    prod = F.struct(*[F.col(c) for c in PRODUCT_FIELDS])
    return (top.join(full, ["product_id", "_row"]).groupBy(*KEY)
               .agg(F.sort_array(F.collect_list(F.struct(F.col("rank"), prod.alias("p")))).alias("ps"))
               .select(*KEY, F.transform("ps", lambda x: x["p"]).alias("products")))


def go_duration(ms: Column) -> Column:
    """Milliseconds as the service prints a duration (1.5ms, 250µs, 1.2s)."""
    text = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), "[.]$", "")
    return (F.when(ms.isNull(), F.lit(None)).when(ms == 0, F.lit("0s"))
             .when(ms < 0.001, F.concat(text(F.round(ms * 1e6, 0)), F.lit("ns")))
             .when(ms < 1, F.concat(text(F.round(ms * 1e3, 3)), F.lit("µs")))
             .when(ms < 1000, F.concat(text(F.round(ms, 6)), F.lit("ms")))
             .otherwise(F.concat(text(F.round(ms / 1e3, 9)), F.lit("s"))))


def search(products: DataFrame, requests: DataFrame, *, wrap: int = C.SEARCH_WRAP,
           limit_ms: float = C.LATENCY_LIMIT_MS) -> DataFrame:
    """Answer a table of search requests.

    Returns query_id, q, status_code, products (array of product structs),
    total_found, checked, search_time_ms, error (struct or NULL). Requests
    with an empty query get 400 INVALID_INPUT (F6). A batch job has no
    per-request time; ``elapsed_ms``, an optional input column, brings the
    measured one: it is given back as search_time_ms, and above ``limit_ms``
    the answer is 503 (F8). The rest is 200.
    """
    timed = "elapsed_ms" in requests.columns
    req = normalize_requests(requests)
    keys, stats = search_keys(req.where("q_present").select(*KEY))
    hits = match_positions(products, keys, wrap=wrap, stats=stats)
    # counts and result lists both read the (narrow) hits
    hits = materialize(hits, "search-hits")
    lists = result_lists(top_matches(hits, stats["max_results"]), products, stats["max_check"])
    answers = totals(hits, keys).join(lists, KEY, "left")
    empty = F.array().cast(answers.schema["products"].dataType)
    error = F.when(~F.col("q_present"), S.error_record(C.ERR_INVALID_INPUT, C.MSG_MISSING_QUERY, C.DETAILS_MISSING_QUERY))
    if timed:
        error = error.when(F.col("elapsed_ms") > limit_ms, S.error_record(
            C.ERR_SERVICE_UNAVAILABLE, C.MSG_SEARCH_UNAVAILABLE, C.DETAILS_SEARCH_UNAVAILABLE))
    bad = F.col("error").isNotNull()
    status = F.when(~F.col("q_present"), F.lit(400)).when(bad, F.lit(503)).otherwise(F.lit(200))
    return (req.join(answers, KEY, "left").withColumn("error", error)
               .select(
                   "query_id", "q", status.alias("status_code"),
                   F.when(bad, empty).otherwise(F.coalesce("products", empty)).alias("products"),
                   F.when(bad, F.lit(None)).otherwise(F.coalesce("total_found", F.lit(0).cast("bigint"))).alias("total_found"),
                   F.when(bad, F.lit(None)).otherwise(F.col("max_check").cast("bigint")).alias("checked"),
                   (F.when(bad, F.lit(None)).otherwise(F.col("elapsed_ms")) if timed else F.lit(None)).cast("double").alias("search_time_ms"),
                   "error"))


def response_json(results: DataFrame) -> DataFrame:
    """JSON body per request: the error record, or products, total_found
    and, where it was measured, search_time."""
    timed = results.withColumn("search_time", go_duration(F.col("search_time_ms")))
    body = F.when(F.col("error").isNotNull(), F.to_json("error")).otherwise(
        F.to_json(F.struct("products", "total_found", "search_time")))
    return timed.withColumn("body", body).drop("search_time")


def search_terms(products: DataFrame) -> DataFrame:
    """Distinct words of product names and categories (a derived query set)."""
    words = F.explode(F.split(F.concat_ws(" ", F.lower("name"), F.lower("category")), " "))
    return products.select(words.alias("q")).where(F.col("q") != "").distinct()
