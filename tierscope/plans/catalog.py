"""The engine's queries by name: functions of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coupon, keys, money, sizes, text, upc, urls
from ..operators import flagging, health, identity, ingest, panel, probes, products, resolve, scrub, series, synth, windows
from ..schema import DEVICES, FORBIDDEN_KEYS, SCHEMA_VERSION, SURFACES, errors
from ..sources import exports, registry
from ..sources.staged import finished, scratch, staged
from ..streaming import ingest as streaming
from ..streaming import probing
from . import views as V

QUERIES: dict = {}
#: Queries on whole tables that SQL can't check: tests hold them against brute force.
WHOLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def six(c):
    return F.round(c, 6)


def obs(spark, d):
    return V.observations(spark, d)


def recent(spark, d):
    return windows.trailing(obs(spark, d), V.NOW)


def clean(spark, d):
    o = obs(spark, d)
    return windows.without_suspects(windows.trailing(o, V.NOW), V.flags(o))


def votes(spark, d):
    return windows.votes(clean(spark, d))


def resolved(spark, d):
    return resolve.resolve(votes(spark, d))


FLAT = ("n", "k", "status", "reason", "needed", "floor_minor")


def flat(r, *key):
    return r.select(*key, *FLAT, six("confidence").alias("confidence"), six("spread").alias("spread"))


@query
def cell_resolution(spark, d):
    return flat(resolved(spark, d), "cell_key")


@query
def cell_resolution_noise(spark, d):
    o = windows.half_open(obs(spark, d), "2024-01-01", "2024-02-01").withColumn("cell_key", F.col("sku"))
    return flat(resolve.resolve(windows.votes(o)), "cell_key")


@query
def cell_resolution_too_many(spark, d):
    return flat(resolve.resolve(windows.votes(V.panel_orders(spark, d))), "cell_key")


@query
def cell_no_observations(spark, d):
    o = obs(spark, d)
    v = windows.votes(windows.trailing(o, "2024-01-02 00:00:00", 24))
    return flat(resolve.resolve(v, cells=o.select("cell_key")), "cell_key")


@query
def cell_requested(spark, d):
    """Keys asked for against resolved cells: how many are there, resolved, and multi-tier."""
    r = resolved(spark, d)
    asked = obs(spark, d).where("retailer = 'target'").select("cell_key").distinct()
    both = asked.join(r, "cell_key", "left")
    return both.agg(F.count(F.lit(1)).alias("queried"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if((F.col("status") == "RESOLVED") & (F.col("k") > 1)).alias("multi_tier"), F.count_if(F.col("status").isNull()).alias("missing"))


@query
def obs_flatten(spark, d):
    o = obs(spark, d)
    nested = o.select(F.struct(F.col("observation_id").alias("observationId"), F.col("panelist_id").alias("panelistId"), F.struct(F.struct(F.col("price_minor").alias("amountMinor"), "currency").alias("price"), F.col("is_estimate").alias("isEstimate")).alias("facts"), F.struct("fulfillment", "zip3").alias("context")).alias("o"))
    return nested.select("o.*").select(F.col("observationId").alias("observation_id"), F.col("panelistId").alias("panelist_id"), F.col("facts.price.amountMinor").alias("price_minor"), F.col("facts.price.currency").alias("currency"), F.col("facts.isEstimate").alias("is_estimate"), "context.fulfillment", "context.zip3")


@query
def cell_keys(spark, d):
    return obs(spark, d).select("observation_id", "cell_key", keys.sku_key().alias("sku_key"), keys.probe_key().alias("probe_key"), keys.semantic_key().alias("semantic_key"))


@query
def canonical_cell_keys(spark, d):
    return obs(spark, d).withColumn("canonical_id", F.when(F.col("observation_id") % 3 != 0, F.concat(F.lit("fuzzy:"), "sku"))).select("observation_id", keys.canonical_cell_key().alias("canonical_cell_key"))


@query
def cell_scan(spark, d):
    return windows.trailing(obs(spark, d), V.NOW).where("cell_key = 'target||view|delivery|080'").select("observation_id", "observed_at", "price_minor").orderBy("observed_at", "observation_id")


@query
def panelist_scan(spark, d):
    return windows.half_open(obs(spark, d), "2024-01-10", "2024-01-20").where("panelist_id = 7").select("observation_id", "observed_at", "cell_key").orderBy("observed_at")


@query
def canonical_cell_scan(spark, d):
    o = obs(spark, d).withColumn("canonical_id", F.when(F.col("observation_id") % 3 != 0, F.concat(F.lit("fuzzy:"), "sku")))
    return o.withColumn("c", keys.canonical_cell_key()).where("c = 'fuzzy:view|delivery|080'").select("observation_id", "price_minor")


@query
def point_lookup(spark, d):
    return obs(spark, d).where("observation_id = 42").select("observation_id", "panelist_id", "cell_key", "price_minor").limit(1)


@query
def export_window(spark, d):
    return windows.half_open(obs(spark, d), "2024-01-08", "2024-01-15").select("observation_id", "observed_at", "panelist_id", "cell_key", "price_minor", "clean_session").orderBy("observed_at", "observation_id")


@query
def json_clean_session(spark, d):
    return obs(spark, d).select("observation_id", (F.try_variant_get(F.parse_json("props"), "$.k", "int") > 49).alias("flag"), F.get_json_object("props", "$.missing").alias("missing"))


def _nested(o):
    """Observations as the contract has them, some with faults: every tenth count a bad zip3, every seventh no title, dear ones below zero."""
    i, k = F.col("observation_id"), F.col("k")
    uuid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c.cast("string"), 12, "0"))
    price = F.when(F.col("price_minor") > 1000, -F.col("price_minor")).otherwise(F.col("price_minor"))
    return o.select(
        "observation_id", F.lit(SCHEMA_VERSION).alias("schemaVersion"), uuid(i).alias("observationId"), uuid(F.col("panelist_id")).alias("panelistId"), F.col("observed_at").cast("timestamp").alias("observedAt"), "retailer",
        F.struct("store_id", F.col("store_label")).cast("struct<retailerStoreId:string,label:string>").alias("store"),
        F.struct(F.col("sku"), F.lit(None).cast("string"), F.when(k % 7 != 3, F.col("title")).otherwise(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("https://shop.example/"), F.col("sku"))).cast("struct<retailerSku:string,upc:string,title:string,brand:string,sizeText:string,url:string>").alias("product"),
        F.struct(F.struct(price, "currency"), F.lit("$1"), "is_estimate", F.lit(None), F.lit(None), F.array().cast("array<string>"), F.lit(None)).cast("struct<price:struct<amountMinor:bigint,currency:string>,priceText:string,isEstimate:boolean,wasPrice:struct<amountMinor:bigint,currency:string>,unitPriceText:string,promoTags:array<string>,memberPrice:boolean>").alias("facts"),
        F.struct("fulfillment", "session_state", F.lit(SURFACES[0]), F.lit(DEVICES[0]), F.when(k % 10 == 0, "8x").otherwise(F.col("zip3")), "clean_session", F.lit(None)).cast("struct<fulfillment:string,sessionState:string,surface:string,device:string,zip3:string,cleanSession:boolean,fulfillmentInferred:boolean>").alias("context"),
        F.struct("adapter", F.lit("1.0.0"), F.sha2(F.col("props"), 256)).cast("struct<adapter:string,clientVersion:string,evidenceHash:string>").alias("provenance"),
    )


@query
def validate_rows(spark, d):
    """The contract's own checks on every row: one row for each error."""
    return _nested(obs(spark, d)).select("observation_id", F.explode(errors()).alias("error"))


@query
def parse_cell_key(spark, d):
    o = obs(spark, d).withColumn("raw", F.when(F.col("observation_id") % 7 == 0, F.concat("cell_key", F.lit("|x"))).when(F.col("observation_id") % 7 == 1, F.concat(F.lit("|"), F.substring("cell_key", 2, 400))).otherwise(F.col("cell_key")))
    return o.select("observation_id", keys.is_cell_key("raw").alias("ok"))


@query
def forbidden_keys(spark, d):
    doc = F.to_json(F.struct(F.col("props").alias("raw"), F.when(F.col("observation_id") % 50 == 0, F.array(F.struct(F.lit("a@b.c").alias("email")))).alias("list")))
    return obs(spark, d).select("observation_id", F.explode(scrub.forbidden_keys(doc, FORBIDDEN_KEYS)).alias("path"))


@query
def week_windows(spark, d):
    start, end = windows.week_bounds(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("week"))
    w = spark.range(1, 5).select(F.col("id").cast("int").alias("week")).withColumns({"start": start, "end": end})
    o = obs(spark, d)
    return o.join(F.broadcast(w), (o.observed_at >= w.start) & (o.observed_at < w.end)).groupBy("week", "start", "end").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("panelist_id").alias("panelists"))


@query
def since_dates(spark, d):
    day = F.to_date("observed_at")
    return obs(spark, d).where(day >= windows.since_date(F.lit("2024-01-30").cast("date"))).groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query
def probe_rows(spark, d):
    return obs(spark, d).where(panel.is_probe()).select("observation_id", "panelist_id", "price_minor")


@query
def same_store(spark, d):
    """Verdicts for every two stores at which a panelist saw a product, logged out and logged in: distinct stores meet, not rows."""
    own = ["panelist_id", "sku", "retailer", "store_id", "store_label"]
    o = obs(spark, d).withColumn("store_id", F.when(F.col("observation_id") % 5 == 0, F.lit("s1")))
    a, b = (o.where(F.col("session_state") == s).select(*own).distinct().alias(x) for s, x in (("logged_out", "anon"), ("logged_in", "mine")))
    met = a.join(b, (F.col("anon.panelist_id") == F.col("mine.panelist_id")) & (F.col("anon.sku") == F.col("mine.sku")))
    return met.select("anon.panelist_id", "anon.sku", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("anon", "mine") for c in ("store_id", "store_label")), probes.same_store().alias("same"))


@query
def same_store_counts(spark, d):
    """All pairs of a logged-out and a logged-in row of a panelist and product, counted by verdict: both sides shrink before they meet."""
    own = ["panelist_id", "sku", "retailer", "store_id", "store_label"]
    o = obs(spark, d).withColumn("store_id", F.when(F.col("observation_id") % 5 == 0, F.lit("s1")))
    a, b = (o.where(F.col("session_state") == s).groupBy(*own).agg(F.count(F.lit(1)).alias("n")).alias(x) for s, x in (("logged_out", "anon"), ("logged_in", "mine")))
    met = a.join(b, (F.col("anon.panelist_id") == F.col("mine.panelist_id")) & (F.col("anon.sku") == F.col("mine.sku")))
    told = met.select("anon.panelist_id", "anon.sku", probes.same_store().alias("same"), (F.col("anon.n") * F.col("mine.n")).alias("pairs"))
    return told.groupBy("panelist_id", "sku", "same").agg(F.sum("pairs").alias("pairs"))


@query
def coupon_required(spark, d):
    """What each part would need if it had as many tiers as its size says."""
    k = F.col("p_size").cast("int").alias("k")
    return V.table(spark, d, "part").select("p_partkey", k).select("p_partkey", "k", six(coupon.harmonic(F.col("k"))).alias("harmonic"), six(coupon.expected_uniform(F.col("k"))).alias("expected"), coupon.required(F.col("k")).alias("required"))


def _line_shares(spark, d):
    """Suppliers with the shares that the seven line numbers have of their lines."""
    lines = V.table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c"))
    counts = lines.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "c"))), lambda x: x["c"]).alias("cs"), F.sum("c").alias("n"))
    return counts.select("l_suppkey", F.transform("cs", lambda c: c / F.col("n")).alias("shares"))


@query
def coupon_all_seen(spark, d):
    g = _line_shares(spark, d).select("l_suppkey", "shares", F.explode(F.array(*map(F.lit, (0, 1, 5, 6, 20, 100)))).alias("n"))
    return g.select("l_suppkey", "n", six(coupon.all_seen(F.col("shares"), F.col("n"))).alias("p"))


@query
def expected_draws(spark, d):
    return _line_shares(spark, d).select("l_suppkey", six(coupon.expected_draws(F.col("shares"))).alias("draws"))


@query
def tier_shares(spark, d):
    return resolve.tiers_of(resolved(spark, d)).select("cell_key", "tier", "price", "n", six("share").alias("share"))


@query
def cell_confidence(spark, d):
    return resolved(spark, d).where("status = 'RESOLVED'").select("cell_key", six("confidence").alias("confidence"))


@query
def cell_explain(spark, d):
    return resolved(spark, d).select("cell_key", money.explain(72).alias("sentence"))


@query
def ladder_view(spark, d):
    mine = windows.latest(obs(spark, d).where("panelist_id % 10 = 3"), ("cell_key",)).select("cell_key", F.col("price_minor").alias("my_price"))
    v = resolve.ladder_view(resolved(spark, d), mine)
    return v.select("cell_key", "my_price", "state", F.explode_outer("tiers").alias("t")).select("cell_key", "my_price", "state", F.col("t.price").alias("price"), F.col("t.mine").alias("mine"), F.col("t.floor").alias("floor"))


@query
def one_vote_per_panelist(spark, d):
    return votes(spark, d).select("cell_key", "panelist_id", "observation_id", "observed_at", "price_minor").orderBy("observed_at", "observation_id")


@query
def id_dedup(spark, d):
    o = obs(spark, d)
    sent = o.union(o.where("observation_id % 3 = 0"))
    return ingest.new_rows(sent, o.where("observation_id % 10 = 1")).groupBy("retailer").agg(F.count(F.lit(1)).alias("accepted"))


@query
def batch_slices(spark, d):
    return windows.sliced(obs(spark, d).select("panelist_id", "observed_at", "observation_id"), ("panelist_id",), ("observed_at", "observation_id"), 20).groupBy("panelist_id", "slice").agg(F.count(F.lit(1)).alias("rows"), F.min("observation_id").alias("first_id"))


@query
def fifo_cap(spark, d):
    return windows.newest(obs(spark, d).select("panelist_id", "observed_at", "observation_id"), 5, "observed_at", F.desc("observation_id"), key=("panelist_id",))


@query
def semantic_dedup(spark, d):
    return ingest.semantic_dedup(obs(spark, d), minutes=720, key=("panelist_id", "sku")).select("observation_id")


@query
def semantic_dedup_stored(spark, d):
    o = obs(spark, d)
    return ingest.semantic_dedup(o.where("observation_id % 2 = 0"), o.where("observation_id % 2 = 1"), minutes=720, key=("panelist_id", "sku")).groupBy("sku").agg(F.count(F.lit(1)).alias("kept"))


@query
def panel_metrics(spark, d):
    return panel.panel_metrics(obs(spark, d))


@query
def rows_by_adapter(spark, d):
    return panel.counts_by(obs(spark, d), "adapter")


@query
def rows_by_zip3(spark, d):
    return panel.counts_by(obs(spark, d), "zip3")


@query
def rows_by_fulfillment(spark, d):
    return panel.counts_by(obs(spark, d), "fulfillment")


@query
def top_skus(spark, d):
    return panel.top_skus(V.panel_orders(spark, d))


@query
def common_title(spark, d):
    return panel.commonest(V.panel_orders(spark, d), ["sku"], "title").select("sku", "title")


def cells(spark, d):
    o = obs(spark, d)
    return panel.cell_summary(windows.trailing(o, V.NOW), V.flags(o))


@query
def cell_summary(spark, d):
    return cells(spark, d).select("cell_key", "rows", "panelists", "excluded_rows", "votes", "title", "status", "k", six("spread").alias("spread"))


@query
def cell_metrics(spark, d):
    m = panel.cell_metrics(cells(spark, d))
    return m.select(*[six(c).alias(c) if c in ("multi_tier_share", "max_spread", "median_spread") else c for c in m.columns])


@query
def tier_histogram(spark, d):
    return resolved(spark, d).where("status = 'RESOLVED'").groupBy("k").agg(F.count(F.lit(1)).alias("cells"))


@query
def unresolved_by_reason(spark, d):
    return resolved(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("cells"))


@query
def max_spread(spark, d):
    return panel.max_spread(resolved(spark, d)).select("cell_key", six("spread").alias("spread"))


@query
def median_spread(spark, d):
    return panel.medians(resolved(spark, d).withColumn("all", F.lit(1)), ["all"], F.col("spread"), "median_spread").select(six("median_spread").alias("median_spread"))


@query
def suspects(spark, d):
    o = obs(spark, d)
    return ingest.suspects(windows.trailing(o, V.NOW), V.flags(o))


@query
def suspect_flags(spark, d):
    o = obs(spark, d)
    return ingest.flag_new(V.flags(o), ingest.suspects(windows.trailing(o, V.NOW), V.flags(o)))


@query
def flags_in_order(spark, d):
    """All observations as one batch: each pair of panelist and cell sees the flags of those before it."""
    o = obs(spark, d)
    return flagging.flags_in_order(flagging.pairs_of(o), windows.trailing(o, V.NOW), V.flags(o)).select("panelist_id", "cell_key", "reason", "place")


@query
def suspect_exclusion_anti(spark, d):
    return clean(spark, d).groupBy("cell_key").agg(F.count(F.lit(1)).alias("rows"))


@query
def flags_semi(spark, d):
    o = obs(spark, d)
    return V.flags(o).join(o.where("sku = 'view'").select("panelist_id"), "panelist_id", "left_semi")


@query
def flag_counts(spark, d):
    return V.flags(obs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("panelists"))


@query
def rate_windows(spark, d):
    return ingest.rate_windows(obs(spark, d))


@query
def rate_counts_left(spark, d):
    """Every panelist's hours against the counts of what was stored logged in."""
    o = obs(spark, d)
    asked = o.select("panelist_id", F.date_trunc("hour", F.col("received_at")).alias("window_start")).distinct()
    return ingest.counts_for(asked, ingest.rate_windows(o.where("session_state = 'logged_in'")), ["panelist_id", "window_start"])


@query
def rate_demands(spark, d):
    """What all rows ask for, under a token for each retailer but one."""
    return ingest.demands(obs(spark, d).withColumn("token", F.when(F.col("retailer") != "target", F.col("retailer"))), keys.rate_token_key("token"))


@query
def rate_over_limit(spark, d):
    """Demand of the later half of January against what the earlier half has stored."""
    o, half = obs(spark, d), F.col("observed_at") >= F.lit("2024-01-16").cast("timestamp_ntz")
    key = F.concat(F.lit("panelist:"), F.col("panelist_id").cast("string")).alias("key")
    asked, have = (o.where(side).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for side, n in ((half, "demand"), (~half, "count")))
    return ingest.over_limit(asked, have, 16).select("key", "demand", "count")


def _asked(spark, d):
    """All rows: logged-out ones ask, the others are stored."""
    o, out = obs(spark, d), F.col("session_state") == "logged_out"
    return o.where(out), o.where(~out)


@query
def rate_counts_left_whole(spark, d):
    asked, stored = _asked(spark, d)
    hours = asked.select("panelist_id", F.date_trunc("hour", F.col("received_at")).alias("window_start")).distinct()
    return ingest.counts_for(hours, ingest.rate_windows(stored), ["panelist_id", "window_start"])


@query
def rate_demands_whole(spark, d):
    return ingest.demands(obs(spark, d).withColumn("token", F.when(F.col("panelist_id") % 2 == 0, "abc")), keys.rate_token_key("token"))


@query
def rate_over_limit_whole(spark, d):
    key = F.concat(F.lit("panelist:"), F.col("panelist_id").cast("string")).alias("key")
    asked, stored = _asked(spark, d)
    have = stored.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return ingest.over_limit(asked.groupBy(key).agg(F.count(F.lit(1)).alias("demand")), have, 16).select("key", "demand", "count")


@query
def rate_add(spark, d):
    w = ingest.rate_windows(obs(spark, d)).withColumnRenamed("panelist_id", "key")
    return ingest.add_counts(w, w.where("key % 2 = 0"))


def _pairs(spark, d, back, ahead):
    return probes.pair(obs(spark, d), back, ahead)


@query
def probe_pairs_asof(spark, d):
    return _pairs(spark, d, 60, 5)


@query
def probe_pairs_two_days(spark, d):
    return _pairs(spark, d, 2880, 5)


@query
def probe_rates(spark, d):
    return probes.rates(_pairs(spark, d, 2880, 5)).withColumn("difference_rate", six("difference_rate"))


@query
def probe_stats(spark, d):
    p = _pairs(spark, d, 2880, 5)
    return p.groupBy("retailer", F.coalesce("verdict", F.lit("UNPAIRED")).alias("verdict")).agg(F.count(F.lit(1)).alias("checks"))


@query
def latest_own(spark, d):
    return probes.latest_own(obs(spark, d))


def _signed(spark, d):
    return products.signed(V.products(spark, d))


def _queries(spark, d):
    return _signed(spark, d).where("product_id % 50 = 0").withColumnRenamed("product_id", "query_id")


@query
def sku_links_inner(spark, d):
    p = V.products(spark, d)
    links = p.select(F.concat(F.lit("target|"), F.col("product_id").cast("string")).alias("sku_key"), F.floor(F.col("product_id") / 2).alias("canonical_id"))
    known = p.select(F.col("product_id").alias("canonical_id"), "title")
    asked = p.where("product_id % 3 = 0").select(F.concat(F.lit("target|"), F.col("product_id").cast("string")).alias("sku_key"))
    return products.linked(asked, links, known).select("sku_key", "canonical_id", "title")


@query
def token_candidates_topk(spark, d):
    return products.candidates(_queries(spark, d), _signed(spark, d)).select("query_id", "product_id", "shared", "rank")


def _listings(spark, d):
    """Other sellers' listings of every fiftieth product: the same words in another title, and no code."""
    p, seller = V.products(spark, d).where("product_id % 50 = 0"), F.col("seller")
    title = F.when(seller == 0, F.col("title")).when(seller == 1, F.concat(F.lit("The "), "title")).otherwise(F.concat("title", F.lit(", with")))
    rows = p.withColumn("seller", F.explode(F.array(*map(F.lit, range(3))))).withColumns({"query_id": F.col("product_id") * 3 + seller, "title": title, "upc": F.lit(None).cast("string")})
    return rows.drop("product_id", "seller")


def _matches(spark, d):
    """Each step is written, so the driver holds the plan of one at a time."""
    q, p = products.signed_once(_listings(spark, d)), products.signed_once(V.products(spark, d))
    return products.best_match(q, p, staged(products.candidates(q, p), "found"))


@query
def best_match(spark, d):
    return _matches(spark, d).select("query_id", "product_id", six("score").alias("score"))


@query
def canonical_match(spark, d):
    """Listings take the id of the best product that is the same, with the score as confidence; the others keep a key of their own."""
    known = products.canonical(_signed(spark, d)).select("product_id", F.col("canonical_id").alias("known_id"))
    best = _matches(spark, d).join(known, "product_id").drop("product_id")
    return products.canonical(products.signed(_listings(spark, d)), best, "known_id").select("query_id", "canonical_id", "method", six("confidence").alias("confidence"))


@query
def products_recorded(spark, d):
    """Sightings of products recorded in two batches, as the store shows them after."""
    i, path = F.col("product_id"), scratch(spark, "products")
    seen = _signed(spark, d).select(
        i.alias("position"), F.concat(F.lit("c"), F.floor(i / 3)).alias("canonical_id"), F.lit("fuzzy").alias("method"), F.lit(0.9).alias("confidence"), "title", "brand", "size_text", "upc",
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((i % 97).cast("int"))).alias("seen_at"), (i % 1000).cast("string").alias("sku_key"), F.lit("target").alias("retailer"), (i % 1000).cast("string").alias("retailer_sku"), "tokens",
    )
    for half in (0, 1):
        registry.record(spark, path, seen.where(F.col("position") % 2 == half))
    t = registry.tables(spark, path)
    count = lambda name: t[name].groupBy("canonical_id").agg(F.count(F.lit(1)).alias(name))
    whole = t["products"].join(count("links"), "canonical_id", "left").join(count("tokens"), "canonical_id", "left")
    return whole.select("canonical_id", "title", "first_seen_at", "last_seen_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "tokens")))


@query
def tokenize_titles(spark, d):
    return _signed(spark, d).select("product_id", F.array_join("tokens", "-").alias("tokens"), F.array_join("brand_tokens", "-").alias("brand_tokens"))


#: Size texts; # is a number.
SIZES = ["# fl oz", "# oz", "# L", "# lb", "# Pack 12 fl oz", "# oz Pack of #", "1/# lb", "2 oz (# g)", "0,# kg", "Case of #", "sold by the each", "half gallon", "# Ozbag", "Packs #", "plain"]


@query
def parse_size(spark, d):
    """Every part's size, written in the ways of SIZES in turn."""
    shape = F.get(F.array(*map(F.lit, SIZES)), F.pmod("p_partkey", F.lit(len(SIZES))).cast("int"))
    s = V.table(spark, d, "part").select("p_partkey", F.replace(shape, F.lit("#"), F.col("p_size").cast("string")).alias("text")).withColumn("p", sizes.parse_size(F.col("text")))
    return s.select("p_partkey", "text", six("p.size.ml").alias("ml"), six("p.size.g").alias("g"), six("p.size.ct").alias("ct"), F.trim(F.regexp_replace("p.rest", r"\s+", " ")).alias("rest"), sizes.size_key(F.col("p.size")).alias("key"))


@query
def size_compare(spark, d):
    p = _signed(spark, d)
    a, b = p.select(F.col("product_id").alias("a"), F.col("size").alias("x")), p.select(F.col("product_id").alias("b"), F.col("size").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", sizes.compare_sizes(F.col("x"), F.col("y")).alias("sizes"))


@query
def normalize_upc(spark, d):
    p = V.products(spark, d)
    raw = F.concat(F.lpad((F.col("product_id") * 7919).cast("string"), 11, "0"), (F.col("product_id") % 10).cast("string"))
    return p.select("product_id", upc.normalize_upc(raw).alias("gtin"), upc.check_digit(F.substring(raw, 1, 11)).alias("check_digit"))


@query
def dice_match(spark, d):
    p = _signed(spark, d).select("product_id", F.struct("tokens", "brand_tokens", "size", "upc").alias("s"))
    pairs = p.select(F.col("product_id").alias("a_id"), F.col("s").alias("a")).join(p.select(F.col("product_id").alias("b_id"), F.col("s").alias("b")), F.col("b_id") == F.col("a_id") + 3)
    return products.matched(pairs).select("a_id", "b_id", "method", six("score").alias("score"), "reason")


@query
def canonical_id(spark, d):
    return products.canonical(_signed(spark, d)).select("product_id", "canonical_id", "method", six("confidence").alias("confidence"))


@query
def product_record(spark, d):
    seen = obs(spark, d).select(F.concat(F.lit("fuzzy:"), "sku").alias("canonical_id"), F.col("observation_id").alias("by"), "retailer", F.col("observed_at").alias("seen_at"))
    return products.recorded(seen)


@query
def identity_batch(spark, d):
    p = V.products(spark, d).select(F.concat(F.lit("walmart|"), F.col("product_id").cast("string")).alias("sku_key"), F.col("product_id").alias("position"), "title", "brand", "size_text", "upc")
    links = p.where("position % 4 = 0").select("sku_key", F.concat(F.lit("known:"), F.col("position").cast("string")).alias("canonical_id"))
    return products.resolve_batch(p, links, None)


def _by_sku(spark, d):
    return obs(spark, d).withColumn("cell_key", F.concat("retailer", F.lit("|"), "sku"))


@query
def shift_blocks(spark, d):
    return series.shift_blocks(_by_sku(spark, d))


@query
def detect_shift(spark, d):
    o = _by_sku(spark, d).withColumn("price_minor", F.when(F.col("observed_at") < F.lit("2024-01-16").cast("timestamp_ntz"), 200).otherwise(F.when(F.col("sku") == "view", 260).otherwise(200)).cast("long") + F.when(F.col("k") % 10 == 0, 50).otherwise(0))
    return series.detect_shift(o)


@query
def first_resolution(spark, d):
    return series.first_resolution(votes(spark, d), series.SWEEP)


@query
def reconcile_sweep(spark, d):
    v = votes(spark, d)
    r = series.reconcile(resolve.resolve(v), v)
    return r.select(*[six(c).alias(c) if c.endswith("rate") else c for c in r.columns])


@query
def rare_share_by_k(spark, d):
    return panel.rare_share_by_k(resolved(spark, d)).select("k", "cells", six("rarest_median").alias("rarest_median"), six("rarest_min").alias("rarest_min"))


@query
def twice_seen(spark, d):
    return panel.twice_seen(votes(spark, d)).select("twice", "thrice", six("share").alias("share"))


@query
def decide(spark, d):
    r = resolved(spark, d).agg(F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count_if((F.col("status") == "RESOLVED") & (F.col("k") > 1)).alias("multi_tier"))
    p = probes.rates(_pairs(spark, d, 2880, 5)).agg(F.sum("comparable").alias("checks"), F.sum(F.col("more") + F.col("less")).alias("differences"))
    both = r.withColumn("one", F.lit(1)).join(p.withColumn("one", F.lit(1)), "one").drop("one")
    return both.select("*", panel.decide(F.col("resolved"), F.col("multi_tier"), F.col("checks"), F.col("differences")).alias("verdict"))


@query
def retention_purge(spark, d):
    return ingest.purged(obs(spark, d), F.lit("2024-04-14 12:00:00").cast("timestamp_ntz")).groupBy("retailer").agg(F.count(F.lit(1)).alias("rows"), F.min("received_at").alias("oldest"))


@query
def panelist_delete(spark, d):
    o = obs(spark, d)
    return ingest.without_panelists(o, o.where("panelist_id % 7 = 0")).groupBy("retailer").agg(F.count(F.lit(1)).alias("rows"))


@query
def pending_anti(spark, d):
    o = obs(spark, d)
    return ingest.pending(o, o.where("observation_id % 2 = 0")).select("observation_id")


@query
def live_sent(spark, d):
    o = obs(spark, d)
    sent = o.select("observation_id", F.col("observed_at").alias("sent_at"))
    return ingest.live_sent(sent, o.where("observation_id % 5 = 0"), F.lit(V.NOW).cast("timestamp_ntz")).select("observation_id")


@query
def contributed_since(spark, d):
    return obs(spark, d).groupBy("panelist_id").agg(F.count_if(F.col("observed_at") >= F.lit("2024-01-20").cast("timestamp_ntz")).alias("rows"))


def _reports(spark, d):
    failed = F.create_map(F.when(F.col("k") % 3 == 0, "no_price").otherwise("no_sku"), (F.col("k") % 4).cast("long"))
    return obs(spark, d).select(F.col("sku").alias("adapter"), F.to_date("observed_at").alias("date"), F.col("k").cast("long").alias("attempted"), (F.col("k") - F.col("k") % 4).cast("long").alias("extracted"), failed.alias("failed"))


@query
def health_summary(spark, d):
    s = health.summary(_reports(spark, d))
    return s.select("adapter", F.col("date").cast("string").alias("date"), "attempted", "extracted", F.explode("failed").alias("reason", "n"))


@query
def health_fold(spark, d):
    f = health.fold(_reports(spark, d))
    return f.select("adapter", "attempted", "extracted", six("rate").alias("rate"), F.posexplode("reasons").alias("place", "r")).select("adapter", "attempted", "extracted", "rate", "place", "r.reason", "r.n")


@query
def health_subtract(spark, d):
    r = health.summary(_reports(spark, d), ("adapter",))
    sent = health.summary(_reports(spark, d).where("attempted % 2 = 0"), ("adapter",))
    return health.subtract(r, sent).select("adapter", "attempted", "extracted")


@query
def health_left(spark, d):
    """What is left of every adapter's counters, by reason, once the reports of even attempts have gone."""
    r = health.summary(_reports(spark, d), ("adapter",))
    sent = health.summary(_reports(spark, d).where("attempted % 2 = 0"), ("adapter",))
    return health.subtract(r, sent).select("adapter", "attempted", F.explode_outer("failed").alias("reason", "n"))


@query
def outcome_totals(spark, d):
    """Captures and listings counted per adapter and reason; every seventh names no adapter, every eleventh had no consent."""
    k, i = F.col("k"), F.col("observation_id")
    status = F.when(i % 11 == 0, "no_consent").when(k % 5 == 0, "stored").when(k % 5 == 1, "duplicate").when(k % 5 == 2, "rejected").when(k % 5 == 3, "extract_failed").otherwise("listing")
    skipped = F.create_map(F.lit("no_price"), (k % 3).cast("long"), F.lit("rejected"), (k % 2).cast("long"))
    o = obs(spark, d).select(F.when(i % 7 != 0, F.col("adapter")).alias("adapter"), status.alias("status"), F.when(k % 2 == 0, "no_sku").alias("reason"), (k % 4).alias("stored"), (k % 3).alias("duplicates"), (k % 2).alias("rejected"), skipped.alias("skipped"))
    return health.summary(health.outcome_rows(o, "other"), ("adapter",)).select("adapter", "attempted", "extracted", F.explode_outer("failed").alias("reason", "n"))


@query
def probe_check_stats(spark, d):
    """Checks, differences and failures per retailer, failures by reason: a probe without a pair was not read, one of an unknown store can't be told."""
    v = F.col("verdict")
    told = _pairs(spark, d, 2880, 5).select("retailer", F.when(v.isin("SAME", "MORE", "LESS", "STORE_DIFFERS"), v).otherwise("UNCHECKED").alias("verdict"), F.when(v == "STORE_UNKNOWN", "store_unknown").alias("reason"))
    return probes.check_stats(told).select("retailer", "checks", "differences", "failures", F.explode_outer("by_reason").alias("reason", "n"))


@query
def outcome_counters(spark, d):
    k = F.col("k") % 5
    o = obs(spark, d).select(F.col("adapter"), F.when(k == 0, "stored").when(k == 1, "duplicate").when(k == 2, "rejected").when(k == 3, "skipped").otherwise("extract_failed").alias("outcome"))
    return health.outcome_counters(o)


@query
def sessions_by_query(spark, d):
    return windows.islands(obs(spark, d).select("panelist_id", "observed_at", "observation_id", "sku"), ("panelist_id",), ("observed_at", "observation_id"), "sku").select("observation_id", "session", "count")


@query
def debounce(spark, d):
    return streaming.debounced(obs(spark, d), "panelist_id", "observed_at", "6 hours").select("panelist_id", "changes", "settled")


@query
def capture_outcomes(spark, d):
    o = obs(spark, d).select(F.col("panelist_id").alias("session"), F.concat_ws("|", "sku", F.col("price_minor").cast("string")).alias("rendering"), F.col("observation_id").alias("position"), F.when(F.col("k") % 10 == 9, "no_price").alias("reason"))
    return scrub.capture_outcome(o).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query
def backoff(spark, d):
    """How long each panelist waits after as many failures as it has rows without a price."""
    failed = obs(spark, d).groupBy("panelist_id").agg(F.count_if(F.col("k") % 10 == 9).alias("failures"))
    return failed.select("panelist_id", "failures", ingest.backoff_ms(F.col("failures")).alias("ms"))


def _uses(spark, d):
    """Every panelist as a browser, once a row."""
    return obs(spark, d).select(F.concat(F.lit("b"), F.col("panelist_id").cast("string")).alias("browser"), F.col("observed_at").alias("at"))


@query
def remembered_ids(spark, d):
    """Ids that last two days, and the four that a browser still knows."""
    return identity.remembered(_uses(spark, d), 2, 4).select("browser", "id", F.col("minted_at").cast("timestamp_ntz").alias("minted_at"), F.array_join("ids", ",").alias("ids"))


@query
def stored_panelists(spark, d):
    """A store by days and cells, written, and read by panelist within two weeks of receipt."""
    path = scratch(spark, "observations")
    exports.write_observations(obs(spark, d).select("observation_id", "panelist_id", "cell_key", "observed_at", "received_at", "price_minor"), path)
    first, last = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-08 06:00:00", "2024-01-21 18:00:00"))
    return exports.stored_observations(spark, path, first, last).where("panelist_id in (3, 17, 40)")


@query
def waits(spark, d):
    """For every row: seconds until its next window, and whether its sender, after k % 8 failures, still waits some hours later (or, by a clock that went back, before)."""
    at, failures = F.col("received_at"), F.col("k") % 8
    until = F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + 1000 * ingest.backoff_ms(failures))
    now = at + F.make_dt_interval(hours=(F.col("observation_id") % 40 - 20).cast("int"))
    return obs(spark, d).select("observation_id", ingest.until_next_window(at).alias("seconds"), ingest.in_backoff(until, now).alias("waits"), ingest.epoch_ms(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("ms"))


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text")


@query
def scrub_email(spark, d):
    """The email rule alone: the part of scrub_pii that SQL can check."""
    s = _docs(spark, d).select("doc_id", "text", F.regexp_replace("text", scrub.RULES["email"], r"\[scrubbed\]").alias("clean"))
    return s.where("text <> clean").select("doc_id", F.sha2("clean", 256).alias("sha"), F.length("clean").alias("n_chars"))


def scrub_pii(spark, d):
    """Documents that any rule changes, as they are afterwards."""
    s = _docs(spark, d).select("doc_id", "text", scrub.scrub_text(F.col("text")).alias("clean"))
    return s.where("text <> clean").select("doc_id", F.sha2("clean", 256).alias("sha"), F.length("clean").alias("n_chars"))


WHOLE["scrub_pii"] = scrub_pii


@query
def scrub_all_rules(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(scrub.scrub_text(F.col("text")), 256).alias("sha"))


@query
def pii_violations_two(spark, d):
    """The findings of the two rules that SQL can check."""
    return scrub.violations(_docs(spark, d), "doc_id", "text").where("rule in ('email', 'zip')").drop("sample")


def pii_violations(spark, d):
    """Every rule's findings."""
    return scrub.violations(_docs(spark, d), "doc_id", "text")


WHOLE["pii_violations"] = WHOLE["pii_violations_all"] = pii_violations


def _pages(spark, d):
    return V.table(spark, d, "pages")


@query
def visible_text(spark, d):
    return _pages(spark, d).select("page_id", F.length(scrub.visible_text(F.col("html"))).alias("n_chars"), F.sha2(scrub.visible_text(F.col("html")), 256).alias("sha"))


@query
def text_sha256(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


@query
def evidence_hashes(spark, d):
    return _pages(spark, d).select("page_id", scrub.evidence_hash(F.col("html")).alias("sha"))


@query
def json_ld(spark, d):
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"'), F.col("page_id").cast("string"), F.lit('","name":"x","offers":[{"price":"'), (F.col("page_id") % 90).cast("string"), F.lit('.5","priceCurrency":"USD"}]}]}</script>'))
    p = _pages(spark, d).select("page_id", F.explode(scrub.json_ld_products(F.concat("html", block))).alias("p"))
    return p.select("page_id", "p.sku", money.json_ld_money(F.col("p.price")).alias("price_minor"))


@query
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", urls.canonical_url(F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("retailerSlug=walmart#top"))).alias("canonical"), urls.canonical_url(F.col("url")).alias("bare"))


@query
def path_only(spark, d):
    href = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("mailto:"), F.col("url"))).when(F.col("page_id") % 5 == 1, F.lit("#top")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", urls.path_only(href).alias("path"))


@query
def page_kinds(spark, d):
    i = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.instacart.com/products/"), i, F.lit("-x?retailerSlug=a"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://www.target.com/p/thing/-/A-"), i)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://www.walmart.com/ip/thing/"), i)).otherwise(F.lit("https://www.walmart.com/search?q=x"))
    return _pages(spark, d).select("page_id", urls.retailer_of(url).alias("retailer"), urls.page_kind(url).alias("kind"), urls.sku_in_url(url).alias("sku"))


@query
def adapter_extract(spark, d):
    from ..operators import adapters

    i = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://www.walmart.com/ip/thing/"), i)
    price = F.concat(F.lit('<div data-testid="price-wrap"><span itemprop="price">Now $'), (F.col("page_id") % 90).cast("string"), F.lit(".05</span><span>was $99.00</span><b>Rollback</b></div>"))
    html = F.concat(F.lit("<h1>Milk "), i, F.lit("</h1>"), price, F.lit('<button data-testid="sign-in">Sign in</button>'), F.col("html"))
    return adapters.extract(_pages(spark, d).select("page_id", url.alias("url"), html.alias("html"))).select("page_id", "sku", "title", "price_minor", "price_text", "was_minor", "session_state", "fulfillment", "reason")


def _listing_pages(spark, d):
    """An order's lines as a retailer's listing page: page_id, url, html. A line of one piece has no price, one with a high discount a former one."""
    x = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    dollars = lambda more: (F.col("l_extendedprice").cast("decimal(12,2)") + more).cast("string")
    r, part, priced, former = F.col("l_orderkey") % 3, F.col("l_partkey").cast("string"), F.col("l_quantity") > 1, F.col("l_discount") > 0.05
    filled = lambda text, **cols: F.concat(*(F.coalesce(cols[w], F.lit("")) if w in cols else F.lit(w) for w in text.split("|")))
    was = filled('<span class="screen-reader-only">Original price: $|was|</span>', was=dollars(1))
    one = filled('<span class="screen-reader-only">Current price: $|now|</span>|was|', now=dollars(0), was=F.when(former, was))
    instacart = filled('<div data-item-card="true"><a href="/products/|part|-x"><h3>|name|</h3></a>|price|</div>', part=part, name=F.col("p_name"), price=F.when(priced, one))
    two = filled('<div data-test="text-quill"><span data-test="text-quill-insert-0">$|now|</span></div>', now=dollars(0))
    target = filled('<div data-test="ListingPageProductListing"><a data-test="content" href="/p/x/-/A-|part|" aria-label="|name|">|price|</a>|was|</div>', part=part, name=F.col("p_name"), price=F.when(priced, two), was=F.when(former, filled("<s>$|was|</s>", was=dollars(1))))
    three = filled("Price $ |now||was| Final", now=dollars(0), was=F.when(former, filled(" Was $ |was|", was=dollars(1))))
    walmart = filled('<div data-item-id="x"><a href="/ip/|part|">x</a><h3>|name|</h3><div data-testid="unified-global-product-price" aria-label="|price|"></div></div>', part=part, name=F.col("p_name"), price=F.when(priced, three))
    tile = F.when(r == 0, instacart).when(r == 1, target).otherwise(walmart)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", tile.alias("tile"))
    pages = x.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["tile"]), "\n").alias("tiles"))
    r, own = F.col("page_id") % 3, F.col("page_id").cast("string")
    url = F.when(r == 0, F.concat(F.lit("https://www.instacart.com/store/s?k="), own)).when(r == 1, F.concat(F.lit("https://www.target.com/s?searchTerm="), own)).otherwise(F.concat(F.lit("https://www.walmart.com/search?q="), own))
    head = '<a href="/store/corner/storefront"><h2>Corner</h2></a><button data-test="@web/StoreName/Button" aria-label="Store: Corner"></button><div data-automation-id="fulfillment-banner"><span data-sensitivity="medium">Corner</span></div><div data-testid="item-stack">'
    # written once, as pages would lie there: what is asked of an url is asked of pages and not of lines
    return staged(pages.select("page_id", url.alias("url"), F.concat(F.lit(head), F.col("tiles"), F.lit("</div>")).alias("html")), "pages")


@query
def listing_tiles(spark, d):
    from ..operators import adapters

    seen = adapters.observations(adapters.extract(_listing_pages(spark, d)))
    return seen.select("page_id", "retailer", "sku", "url", "title", "price_minor", "price_text", "was_minor", "store_label", "fulfillment", "fulfillment_inferred")


@query
def listing_skips(spark, d):
    from ..operators import adapters

    return adapters.skipped(adapters.extract(_listing_pages(spark, d)))


@query
def money_parse(spark, d):
    t = F.concat(F.lit("now $"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" each"))
    p = V.table(spark, d, "part").select("p_partkey", money.parse_money(t).alias("m"))
    return p.select("p_partkey", "m.amount_minor", "m.token", money.format_minor(F.col("m.amount_minor")).alias("shown"))


#: Addresses, good and bad; # is a customer.
MAILS = [" C#@B.co ", "c#@b", "c#@@b.co", "#", "c #@z.com", "c#@mail.example", "@#.co", "c#@.co", "c#@b."]


@query
def waitlist_validate(spark, d):
    raw = F.replace(F.get(F.array(*map(F.lit, MAILS)), F.pmod("c_custkey", F.lit(len(MAILS))).cast("int")), F.lit("#"), F.col("c_custkey").cast("string"))
    m = V.table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return m.select("c_custkey", "raw", text.normal_email(F.col("raw")).alias("email"), text.is_email(text.normal_email(F.col("raw"))).alias("ok"))


@query
def waitlist_join(spark, d):
    u = obs(spark, d).select(F.concat(F.lit("U"), (F.col("panelist_id") % 40).cast("string"), F.lit("@Mail.example ")).alias("raw"), F.col("observed_at").alias("at"))
    rows = u.select(text.normal_email(F.col("raw")).alias("email"), "at").where(text.is_email(F.col("email")))
    return ingest.first_of(rows, ("email",), ("at",))


@query
def synth_ladder(spark, d):
    """A ladder for every part: its truth is a function of the part, its sample a hash of seed and position."""
    p = V.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("seed"), F.transform(F.sequence(F.lit(0), F.col("p_partkey") % 4), lambda i: (199 + 50 * i).cast("long")).alias("tiers"), F.lit(None).cast("array<double>").alias("probabilities"), F.lit(0.5).alias("stickiness"), F.lit(10).alias("observers"))
    return synth.ladders(p, 30)


@query
def verdict_lines(spark, d):
    p = _pairs(spark, d, 2880, 5)
    v = F.when(F.col("verdict").isin("STORE_UNKNOWN") | F.col("verdict").isNull(), "UNCHECKED").otherwise(F.col("verdict"))
    return p.select("observation_id", money.verdict_line(v, F.col("delta")).alias("line"), money.verdict_detail(v).alias("detail"))


@query
def device_classes(spark, d):
    o = obs(spark, d).withColumns({"width": F.col("k") * 15, "coarse": F.col("observation_id") % 3 != 0})
    device = keys.device_class(F.col("width"), F.col("coarse"))
    return o.select("observation_id", device.alias("device"), keys.surface_of(device).alias("surface"))


@query
def window_totals(spark, d):
    """Of the trailing window, and of one that has no rows."""
    o = obs(spark, d)
    return panel.window_totals(recent(spark, d)).withColumn("window", F.lit("recent")).union(panel.window_totals(windows.trailing(o, "1999-01-01 00:00:00")).withColumn("window", F.lit("none")))


@query
def panelist_cells(spark, d):
    return panel.panelist_cells(obs(spark, d))


@query
def identity_checks(spark, d):
    """Ids that are UUIDs, renderings' keys, and pseudonyms that change every week."""
    o = obs(spark, d).withColumns({"uuid": F.when(F.col("k") % 4 == 0, F.concat(F.lit("0000000A-0000-4000-8000-"), F.lpad(F.col("observation_id").cast("string"), 12, "0"))).otherwise(F.col("sku")), "day": F.to_date("observed_at")})
    return o.select("observation_id", keys.is_uuid("uuid").alias("is_uuid"), keys.rendering_key("sku", "props").alias("rendering"), keys.rotating_id("panelist_id", "day").alias("pseudonym"))


@query
def health_rows(spark, d):
    """Reports exploded to adapters, faulty ones left out, with reasons read from JSON."""
    k = F.col("k").cast("long")
    failed = F.concat(F.lit('{"no_price":'), F.when(F.col("k") % 5 == 0, "-1").when(F.col("k") % 5 == 1, '"x"').otherwise((F.col("k") % 4).cast("string")), F.lit("}"))
    adapter = F.struct(F.col("sku").alias("adapter"), F.lit("1.2.0").alias("version"), k.alias("attempted"), F.when(F.col("k") % 9 == 0, k + 1).otherwise(k - k % 4).alias("extracted"), health.failed_from_json(failed).alias("failed"))
    reports = obs(spark, d).select("observation_id", F.to_date("observed_at").alias("date"), F.when(F.col("k") % 11 == 0, "1.x").otherwise("1.0.3").alias("clientVersion"), F.array(adapter).alias("adapters"))
    good = reports.where(F.size(health.report_errors()) == 0)
    rows = health.report_rows(good)
    return rows.groupBy("adapter", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("reports"), F.sum("attempted").alias("attempted"), F.sum("extracted").alias("extracted"), F.sum(F.coalesce(F.try_element_at("failed", F.lit("no_price")), F.lit(0).cast("long"))).alias("no_price"))


def _three(spark, d):
    """Stored rows, flags with the time they were set, and hourly buckets."""
    o = obs(spark, d)
    flags = V.flags(o).withColumn("flagged_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("panelist_id").cast("int") % 60))
    return {"observations": o, "flags": flags, "buckets": ingest.rate_windows(o)}


@query
def retention_counts(spark, d):
    t = _three(spark, d)
    return ingest.retained(t["observations"], t["flags"], t["buckets"], F.lit("2024-04-14 12:00:00").cast("timestamp_ntz"))[1]


@query
def delete_counts(spark, d):
    """An identity's ids, and others on its rows, deleted from all three tables."""
    t = _three(spark, d)
    known = t["observations"].where("panelist_id % 7 = 0").select("panelist_id")
    return ingest.deleted(t, ingest.ids_to_delete(known, t["observations"].where("panelist_id % 7 < 2")))[1]


@query
def ids_to_delete(spark, d):
    o = obs(spark, d)
    return ingest.ids_to_delete(o.where("panelist_id % 7 = 0").select("panelist_id"), o.where("panelist_id % 7 < 2"))


def _replayed(spark, d, columns):
    """The observations as a stream that ends: the same file, read as a source."""
    from pyspark.sql.types import StructType

    schema: StructType = V.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    e = events.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("panelist_id"), F.col("event_type").alias("sku"), F.col("ts").alias("observed_at"))
    return e.select(*columns)


def _ended(spark, d):
    """The observations as a stream, and a row of nobody, a year ahead, that ends the wait for rows that might still come."""
    events, ahead = V.table(spark, d, "events"), scratch(spark, "ahead")
    last = events.orderBy(F.desc("ts")).limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("event_id", "ts") else F.col(f.name) for f in events.schema))
    last.withColumns({"event_id": F.lit(-4).cast(events.schema["event_id"].dataType), "ts": F.col("ts") + F.expr("interval 365 days")}).write.parquet(ahead)
    read = lambda path: spark.readStream.schema(events.schema).parquet(path)
    return V.observations_of(read(f"{d}/events.parque[t]").union(read(ahead)))


@query
def stream_probe_pairs(spark, d):
    """probe_pairs_two_days on a stream."""
    return finished(probing.paired(_ended(spark, d), 2880, 5), "append").where("observation_id >= 0")


@query
def stream_debounce(spark, d):
    """debounce on a stream."""
    rows = _ended(spark, d).select("panelist_id", "observed_at")
    return finished(streaming.debounced_stream(rows, "panelist_id", "observed_at", "6 hours"), "append").select("panelist_id", "changes", "settled")


@query
def stream_hourly(spark, d):
    s = streaming.hourly(_replayed(spark, d, ["panelist_id", "observed_at"]))
    return finished(s, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "panelist_id", "rows")


@query
def stream_dedup(spark, d):
    s = streaming.deduplicated(_replayed(spark, d, ["observation_id", "panelist_id", "sku", "observed_at"]), 720, ("panelist_id", "sku"))
    return finished(s, "append").select("observation_id")


@query
def stream_ingest(spark, d):
    root = scratch(spark, "ingest")
    rows = _replayed(spark, d, ["observation_id", "panelist_id", "sku", "observed_at"]).withColumns({"received_at": F.col("observed_at"), "cell_key": F.col("sku"), "price_minor": F.lit(199).cast("long"), "currency": F.lit("USD")})
    q = rows.writeStream.foreachBatch(streaming.ingest_batch(spark, root, 1000, 720)).option("checkpointLocation", root + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(root + "/rows").select("observation_id")


@query
def ingest_results(spark, d):
    """How many rows of the stream's batches came, were valid, were admitted, were stored and were duplicates, as the writing jobs counted them."""
    root = scratch(spark, "ingest")
    rows = _replayed(spark, d, ["observation_id", "panelist_id", "sku", "observed_at"]).withColumns({"received_at": F.col("observed_at"), "cell_key": F.col("sku"), "price_minor": F.lit(199).cast("long"), "currency": F.lit("USD")})
    run = streaming.ingest_batch(spark, root, 1000, 720, valid=F.col("price_minor") > 0)
    rows.writeStream.foreachBatch(run).option("checkpointLocation", root + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(root + "/results").agg(*(F.sum(c).alias(c) for c in ("presented", "valid", "admitted", "accepted", "duplicates")))


@query
def stream_ingest_two_steps(spark, d):
    """Admitted rows land, pass once by their id, and are stored: the same rows as stream_ingest, with no look-up of stored ids."""
    root = scratch(spark, "ingest")
    rows = _replayed(spark, d, ["observation_id", "panelist_id", "sku", "observed_at"]).withColumns({"received_at": F.col("observed_at"), "cell_key": F.col("sku"), "price_minor": F.lit(199).cast("long"), "currency": F.lit("USD")})
    rows.writeStream.foreachBatch(streaming.admit_batch(spark, root, 1000)).option("checkpointLocation", root + "/admit").trigger(availableNow=True).start().awaitTermination()
    seen = streaming.idempotent(streaming.landed(spark, root, rows))
    seen.writeStream.foreachBatch(streaming.ingest_batch(spark, root, None, 720, ids_known=True)).option("checkpointLocation", root + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(root + "/rows").select("observation_id")
