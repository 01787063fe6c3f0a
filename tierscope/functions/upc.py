"""Product codes: GS1 check digits, UPC-E, and one 14-digit form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_digit(body: Column) -> Column:
    """GS1 check digit of the digits before it: weights 3 and 1 from the right."""
    digits = F.transform(F.filter(F.split(F.reverse(body), ""), lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return (10 - F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10) % 10


def has_valid_check_digit(code: Column) -> Column:
    n = F.length(code)
    return check_digit(F.substring(code, F.lit(1), n - 1)) == F.substring(code, n, F.lit(1)).cast("int")


def expand_upc_e(code: Column) -> Column:
    """The UPC-A of an eight-digit UPC-E in number system 0, else null."""
    part = lambda a, n: F.substring(code, a, n)  # noqa: E731  from the first digit, counted from 1
    kind = part(7, 1)
    body = (
        F.when(kind.isin("0", "1", "2"), F.concat(part(2, 2), kind, F.lit("0000"), part(4, 3)))
        .when(kind == "3", F.concat(part(2, 3), F.lit("00000"), part(5, 2)))
        .when(kind == "4", F.concat(part(2, 4), F.lit("00000"), part(6, 1)))
        .otherwise(F.concat(part(2, 5), F.lit("0000"), kind))
    )
    return F.when((F.length(code) == 8) & (part(1, 1) == "0"), F.concat(F.lit("0"), body, part(8, 1)))


def normalize_upc(raw: Column) -> Column:
    """GTIN-14 of a code as shown, null for anything that is not one."""
    digits = F.regexp_replace(raw, r"[\s-]", "")
    usable = digits.rlike(r"^(\d{8}|\d{12,14})$") & ~digits.rlike("^0+$")
    full = F.coalesce(expand_upc_e(digits), digits)
    return F.when(usable, F.when(has_valid_check_digit(full), F.lpad(full, 14, "0")))
