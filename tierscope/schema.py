"""The observation contract as Spark types, its checks, and the engine's constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SCHEMA_VERSION = "1.1.0"
RETAILERS = ["instacart", "target", "walmart"]
FULFILLMENTS = ["delivery", "pickup", "ship"]
SESSIONS = ["logged_in", "logged_out", "unknown"]
SURFACES = ["web", "app"]
DEVICES = ["desktop", "mobile", "tablet"]
WINDOW_HOURS, MAX_TIERS, SAFETY_FACTOR, MIN_SIGHTINGS, NOISE_FROM = 72, 8, 1.5, 3, 100
DEDUP_MINUTES, RATE_LIMIT, RETENTION_DAYS, BUCKET_HOURS = 10, 1000, 90, 2
BATCH_MAX, STORE_CAP, CELL_KEY_MAX = 200, 5000, 512
ABUSE_PANELISTS, ABUSE_LOW, ABUSE_HIGH = 3, 0.5, 1.5
PAIR_BACK_MINUTES, PAIR_AHEAD_MINUTES = 60, 5
CANDIDATES, QUERY_TOKENS, KEY_TOKENS, MATCH_AT, SIZE_TOLERANCE = 50, 32, 24, 0.8, 0.03
DECISION = {"multi_tier_share": 0.2, "difference_rate": 0.1, "min_cells": 20, "min_checks": 50}
FORBIDDEN_KEYS = ["email", "name", "firstName", "lastName", "fullName", "phone", "address", "street", "zip", "zipCode", "postalCode", "ip", "ipAddress", "userId", "accountId"]

_money = T.StructType([T.StructField("amountMinor", T.LongType()), T.StructField("currency", T.StringType())])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_s, _b = T.StringType(), T.BooleanType()

OBSERVATION = _struct(
    schemaVersion=_s, observationId=_s, panelistId=_s, observedAt=T.TimestampType(), retailer=_s,
    store=_struct(retailerStoreId=_s, label=_s),
    product=_struct(retailerSku=_s, upc=_s, title=_s, brand=_s, sizeText=_s, url=_s),
    facts=_struct(price=_money, priceText=_s, isEstimate=_b, wasPrice=_money, unitPriceText=_s, promoTags=T.ArrayType(_s), memberPrice=_b),
    context=_struct(fulfillment=_s, sessionState=_s, surface=_s, device=_s, zip3=_s, cleanSession=_b, fulfillmentInferred=_b),
    provenance=_struct(adapter=_s, clientVersion=_s, evidenceHash=_s),
)

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def errors() -> Column:
    """What is wrong with a nested observation, as an array of 'path: message'; empty for a good one."""

    def text(path: str, least: int, most: int, needed: bool = True) -> Column:
        c = F.col(path)
        bad = F.length(c).cast("int").between(least, most) == F.lit(False)
        return F.when((c.isNull() if needed else F.lit(False)) | F.coalesce(bad, F.lit(False)), f"{path}: {least} to {most} characters")

    def match(path: str, pattern: str, needed: bool = True) -> Column:
        c = F.col(path)
        return F.when((c.isNull() if needed else F.lit(False)) | ~F.coalesce(c.rlike(pattern), F.lit(True)), f"{path}: malformed")

    def one_of(path: str, values: list[str]) -> Column:
        return F.when(~F.coalesce(F.col(path).isin(values), F.lit(False)), f"{path}: not one of {', '.join(values)}")

    def money(path: str, needed: bool = True) -> Column:
        c = F.col(path)
        bad = ~F.coalesce((c["amountMinor"] >= 0) & (c["currency"] == "USD"), F.lit(False))
        return F.when((F.lit(True) if needed else c.isNotNull()) & bad, f"{path}: not whole USD cents of zero or more")

    checks = [
        F.when(~F.coalesce(F.col("schemaVersion") == SCHEMA_VERSION, F.lit(False)), "schemaVersion: unsupported"),
        match("observationId", UUID), match("panelistId", UUID),
        F.when(F.col("observedAt").isNull(), "observedAt: not a time"),
        one_of("retailer", RETAILERS),
        F.when(F.col("store").isNotNull() & F.col("store.retailerStoreId").isNull() & F.col("store.label").isNull(), "store: empty"),
        text("store.retailerStoreId", 1, 128, False), text("store.label", 1, 256, False),
        text("product.retailerSku", 1, 128), match("product.upc", r"^\d{8,14}$", False), text("product.title", 1, 512),
        text("product.brand", 0, 128, False), text("product.sizeText", 0, 128, False), text("product.url", 1, 2048), match("product.url", r"^[a-zA-Z][a-zA-Z0-9+.-]*:"),
        money("facts.price"), money("facts.wasPrice", False), text("facts.priceText", 1, 64), text("facts.unitPriceText", 0, 64, False),
        F.when(F.size("facts.promoTags") > 16, "facts.promoTags: more than 16"),
        F.when(F.exists("facts.promoTags", lambda t: F.length(t) > 64), "facts.promoTags: over 64 characters"),
        one_of("context.fulfillment", FULFILLMENTS), one_of("context.sessionState", SESSIONS), one_of("context.surface", SURFACES), one_of("context.device", DEVICES),
        match("context.zip3", r"^\d{3}$", False), match("provenance.adapter", r"^[a-z0-9-]+@\d+\.\d+\.\d+$"),
        match("provenance.clientVersion", r"^\d+\.\d+\.\d+$"), match("provenance.evidenceHash", "^[0-9a-f]{64}$"),
    ]
    return F.array_compact(F.array(*checks))
