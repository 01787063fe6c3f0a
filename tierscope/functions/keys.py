"""Grouping keys. Absent parts of a key are empty strings, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CELL_KEY_MAX, UUID


def joined(*parts, sep: str = "|") -> Column:
    return F.concat_ws(sep, *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def cell_key(retailer="retailer", store="store_id", sku="sku", fulfillment="fulfillment", zip3="zip3") -> Column:
    return joined(retailer, store, sku, fulfillment, zip3)


def canonical_cell_key(canonical="canonical_id", fulfillment="fulfillment", zip3="zip3") -> Column:
    return F.when(F.col(canonical).isNotNull(), joined(canonical, fulfillment, zip3))


def sku_key(retailer="retailer", sku="sku") -> Column:
    return joined(retailer, sku)


def probe_key(retailer="retailer", sku="sku") -> Column:
    return joined(retailer, sku, sep=":")


SEMANTIC = ("panelist_id", "cell_key", "price_minor", "currency")


def semantic_key(*columns: str) -> Column:
    return joined(*(columns or SEMANTIC))


def rendering_key(url="url", evidence="evidence_hash", price="price_minor") -> Column:
    return joined(url, evidence, price)


def is_cell_key(key: str) -> Column:
    """Exactly five parts, of which retailer, sku and fulfilment aren't empty, in at most 512 characters."""
    p = F.split(key, r"\|", -1)
    return F.coalesce((F.size(p) == 5) & (F.length(key) <= CELL_KEY_MAX) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(2)) != "") & (F.get(p, F.lit(3)) != ""), F.lit(False))


def is_uuid(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(UUID), F.lit(False))


def rotating_id(panelist: str, day: str, days: int = 7) -> Column:
    """A pseudonym that changes every so many days."""
    return F.sha2(joined(panelist, F.floor(F.datediff(F.col(day), F.lit("1970-01-01")) / days)), 256)


def rate_token_key(token: str) -> Column:
    return F.when(F.col(token).isNull(), "token:open").otherwise(F.concat(F.lit("token:"), F.substring(F.sha2(token, 256), 1, 16)))


def device_class(width: Column, coarse: Column) -> Column:
    """Touch-first screens below 768 are mobile and below 1200 tablets; all else is a desktop."""
    return F.when(coarse & (width < 768), "mobile").when(coarse & (width < 1200), "tablet").otherwise("desktop")


def surface_of(device: Column) -> Column:
    return F.when(device == "desktop", "web").otherwise("mobile_web")
