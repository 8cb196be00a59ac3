"""product validation. Lengths are in bytes (``octet_length``),
as Go's ``len`` on strings counts bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _blen(name: str, base: Column | None = None) -> Column:
    return F.octet_length(F.col(name) if base is None else base.getField(name))


def _num(name: str, base: Column | None = None) -> Column:
    return F.col(name) if base is None else base.getField(name)


def _between(name: str, lo: int, hi: int, base: Column | None = None) -> Column:
    n = _blen(name, base)
    return (n < lo) | (n > hi)


def rule_failures(base: Column | None = None) -> list[tuple[Column, str]]:
    """The ten rules in evaluation order: (failure condition, message).
    Columns are taken from the row, or from the struct ``base``."""
    return [
        (_num("product_id", base) < 1, C.MSG_PRODUCT_ID),
        (_between("sku", 1, 100, base), C.MSG_SKU),
        (_between("manufacturer", 1, 200, base), C.MSG_MANUFACTURER),
        (_num("category_id", base) < 1, C.MSG_CATEGORY_ID),
        (_num("weight", base) < 0, C.MSG_WEIGHT),
        (_num("some_other_id", base) < 1, C.MSG_SOME_OTHER_ID),
        (_between("name", 1, 200, base), C.MSG_NAME),
        (_between("category", 1, 100, base), C.MSG_CATEGORY),
        (_blen("description", base) > 1000, C.MSG_DESCRIPTION),
        (_between("brand", 1, 100, base), C.MSG_BRAND),
    ]


def first_error(base: Column | None = None) -> Column:
    """message of the first failing rule, NULL when the product is valid.
    Expects zero-filled product columns (no NULLs)."""
    return F.coalesce(*[F.when(cond, F.lit(msg)) for cond, msg in rule_failures(base)])


def first_error_of(product: Column) -> Column:
    """F3 on a product struct column."""
    return first_error(product)


def all_errors(base: Column | None = None) -> Column:
    """every failing rule's message, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rule_failures(base)]))


def id_matches(body_id: str | Column, path_id: str | Column) -> Column:
    """body product_id equals the path id."""
    b = F.col(body_id) if isinstance(body_id, str) else body_id
    p = F.col(path_id) if isinstance(path_id, str) else path_id
    return F.coalesce(b == p, F.lit(False))
