"""The same queries in SQL for DuckDB, written apart from the Spark ones: windows and lists instead of folds and aggregates."""

from __future__ import annotations

from ..operators import scrub
from .views import OBS, ORDERS, PRODUCTS


def all_seen(shares: str, n: str, k: str) -> str:
    return f"""greatest(0, least(1, list_sum(list_transform(range(CAST(power(2, {k}) AS BIGINT)), lambda m:
        (CASE WHEN bit_count(m) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)
        * power(greatest(0::DOUBLE, 1::DOUBLE - list_sum(list_transform(range({k}), lambda i: CASE WHEN (m >> CAST(i AS INTEGER)) & 1 = 1 THEN {shares}[i + 1] ELSE 0::DOUBLE END))), {n})))))"""


def resolved(votes: str = "votes", key: str = "cell_key", cells: str | None = None) -> str:
    """CTEs up to r: one resolution per key."""
    base = f"(SELECT DISTINCT {key} FROM {cells})" if cells else f"(SELECT DISTINCT {key} FROM {votes})"
    return f"""
h AS (SELECT {key}, price_minor AS price, count(*) AS c FROM {votes} GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY {key}) AS total_n, min(CASE WHEN c >= 2 THEN price END) OVER (PARTITION BY {key}) AS twice FROM h),
kept AS (SELECT * FROM m WHERE total_n < 100 OR twice IS NULL OR c >= 2 OR price < twice),
a AS (SELECT {key}, CAST(any_value(total_n) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS k, min(c) AS rarest, CAST(sum(c) AS BIGINT) AS kept_n, min(price) AS low, max(price) AS high,
      list(c::DOUBLE ORDER BY price) AS ns FROM kept GROUP BY {key}),
b AS (SELECT x.{key}, coalesce(n, 0) AS n, coalesce(k, 0) AS k, rarest, kept_n, low, high, ns,
      [2, 5, 9, 13, 18, 23, 28, 33][greatest(1, least(coalesce(k, 0), 8))] AS req FROM {base} x LEFT JOIN a ON a.{key} = x.{key}),
c AS (SELECT *, greatest(req, CASE WHEN rarest < 3 THEN ceil(3 * n / rarest) ELSE 0 END) - n AS more,
      CASE WHEN n = 0 THEN 'no_observations' WHEN k > 8 THEN 'too_many_tiers' WHEN n < req THEN 'insufficient_n' WHEN rarest < 3 THEN 'rare_tier_unconfirmed' END AS reason FROM b),
r AS (SELECT {key}, n, k, CASE WHEN reason IS NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, reason,
      CAST(CASE reason WHEN 'no_observations' THEN 5 WHEN 'too_many_tiers' THEN 0 WHEN 'insufficient_n' THEN more WHEN 'rare_tier_unconfirmed' THEN greatest(1, more) END AS BIGINT) AS needed,
      CASE WHEN reason IS NULL THEN low END AS floor_minor,
      CASE WHEN reason IS NULL THEN round({all_seen("list_transform(ns, lambda v: v / kept_n)", "n", "k")}, 6) END AS confidence,
      CASE WHEN reason IS NULL AND k > 1 THEN round(CASE WHEN low = 0 THEN 0 ELSE (high - low) / low::DOUBLE END, 6) END AS spread,
      kept_n FROM c)
"""


LINE_SHARES = """
WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL),
g AS (SELECT l_suppkey, CAST(count(*) AS INTEGER) AS k, list_transform(list(c ORDER BY l_linenumber), lambda v: v / sum(c)::DOUBLE) AS shares FROM c GROUP BY l_suppkey)"""
FLAT = "n, k, status, reason, needed, floor_minor, confidence, spread"
R = f"WITH {OBS}, {resolved()}"
O = f"WITH {OBS} "  # noqa: E741
VERDICT = """
pairs0 AS (SELECT a.observation_id, a.panelist_id, a.retailer, a.sku, a.price_minor, m.observation_id AS mine_id, m.price_minor AS mine_price,
      CASE WHEN a.store_id IS NOT NULL AND m.store_id IS NOT NULL THEN a.store_id = m.store_id
           WHEN a.retailer <> 'instacart' AND a.store_label IS NOT NULL AND m.store_label IS NOT NULL THEN a.store_label = m.store_label END AS same,
      row_number() OVER (PARTITION BY a.observation_id ORDER BY abs(epoch_us(m.observed_at) - epoch_us(a.observed_at)), m.observed_at, m.observation_id) AS rn
      FROM (SELECT * FROM o WHERE session_state = 'logged_out' AND clean_session) a LEFT JOIN (SELECT * FROM o WHERE session_state = 'logged_in') m
      ON a.panelist_id = m.panelist_id AND a.retailer = m.retailer AND a.sku = m.sku AND epoch(m.observed_at)::BIGINT - epoch(a.observed_at)::BIGINT BETWEEN {back} AND {ahead}),
pairs1 AS (SELECT *, CASE WHEN mine_id IS NULL THEN NULL WHEN same IS NULL THEN 'STORE_UNKNOWN' WHEN NOT same THEN 'STORE_DIFFERS' WHEN mine_price = price_minor THEN 'SAME' WHEN mine_price > price_minor THEN 'MORE' ELSE 'LESS' END AS verdict FROM pairs0 WHERE rn = 1),
pairs AS (SELECT observation_id, panelist_id, retailer, sku, price_minor, mine_id, mine_price, verdict, CASE WHEN verdict IN ('SAME', 'MORE', 'LESS') THEN mine_price - price_minor END AS delta FROM pairs1)
"""


def pairs(back: int, ahead: int) -> str:
    return VERDICT.replace("{back}", str(-60 * back)).replace("{ahead}", str(60 * ahead + 0))


RATES = """
rates AS (SELECT retailer, count(*) FILTER (verdict = 'SAME') AS same, count(*) FILTER (verdict = 'MORE') AS more, count(*) FILTER (verdict = 'LESS') AS less,
      count(*) FILTER (verdict = 'STORE_DIFFERS') AS store_differs, count(*) FILTER (verdict = 'STORE_UNKNOWN') AS store_unknown,
      count(*) FILTER (verdict IN ('SAME', 'MORE', 'LESS')) AS comparable, count(*) FILTER (mine_id IS NULL) AS unpaired,
      round(count(*) FILTER (verdict IN ('MORE', 'LESS')) / nullif(count(*) FILTER (verdict IN ('SAME', 'MORE', 'LESS')), 0), 6) AS difference_rate,
      median(CASE WHEN verdict IN ('MORE', 'LESS') THEN abs(delta) END) AS median_delta FROM pairs GROUP BY retailer)
"""
CELLS = f"""
marked AS (SELECT *, panelist_id IN (SELECT panelist_id FROM flags WHERE status = 'suspect') AS suspect FROM t72),
tot AS (SELECT cell_key, count(*) AS rows, count(DISTINCT panelist_id) AS panelists, count(*) FILTER (suspect) AS excluded_rows FROM marked GROUP BY cell_key),
ttl AS (SELECT cell_key, title FROM (SELECT cell_key, title, count(*) AS c FROM marked GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY c DESC, title) = 1),
{resolved()},
cells AS (SELECT tot.*, title, coalesce(r.n, 0) AS votes, r.status, r.k, r.spread FROM tot JOIN ttl USING (cell_key) LEFT JOIN r USING (cell_key))
"""
SKU_CELL = "sc AS (SELECT * REPLACE (retailer || '|' || sku AS cell_key) FROM o)"
BLOCKS = """
nb AS (SELECT cell_key, observed_at, price_minor, (row_number() OVER (PARTITION BY cell_key ORDER BY observed_at, observation_id) - 1) // 10 AS block FROM {src}),
bl AS (SELECT cell_key, CAST(block AS INTEGER) AS block, quantile_disc(price_minor, 0.5) AS median, min(observed_at) AS "at", list(price_minor) AS p FROM nb GROUP BY cell_key, block HAVING count(*) = 10),
blocks AS (SELECT cell_key, block, median, len(list_filter(p, lambda x: x = median)) / 10 AS share, "at" FROM bl)
"""
SETTINGS = "settings AS (SELECT * FROM (VALUES (1.0::DOUBLE, 3), (1.25, 3), (1.5, 3), (1.75, 3), (2.0, 3), (2.5, 3), (3.0, 3), (1.5, 2), (1.5, 4)) t(factor, sightings))"
FIRST = """
seq AS (SELECT cell_key, price_minor, row_number() OVER (PARTITION BY cell_key ORDER BY observed_at, observation_id) AS "at" FROM votes),
pre AS (SELECT s.cell_key, s."at", p.price_minor, count(*) AS c FROM seq s JOIN seq p ON s.cell_key = p.cell_key AND p."at" <= s."at" GROUP BY ALL),
pfx AS (SELECT cell_key, "at", count(*) AS k, min(c) AS rarest, min(price_minor) AS low FROM pre GROUP BY ALL),
fr AS (SELECT cell_key, factor, sightings, CAST("at" AS INTEGER) AS "at", CAST(k AS INTEGER) AS k, low AS floor_minor FROM pfx, settings
       WHERE "at" >= ceil(round(factor * k * list_sum(list_transform(range(1, k + 1), lambda i: 1::DOUBLE / i)), 9)) AND rarest >= sightings
       QUALIFY row_number() OVER (PARTITION BY cell_key, factor, sightings ORDER BY "at") = 1)
"""
FUZZY = "'fuzzy:' || array_to_string(tokens[1:24], '-') || '@' || CAST(floor(g + 0.5) AS BIGINT) || 'g'"
SIZES = "CASE WHEN abs(a.g - b.g) <= 0.03::DOUBLE * greatest(a.g, b.g) THEN 'agree' ELSE 'conflict' END"
VARIANT = "len(list_intersect(list_concat(list_filter(a.tokens, lambda t: NOT list_contains(b.tokens, t)), list_filter(b.tokens, lambda t: NOT list_contains(a.tokens, t))), {v}))"
DICE = "2.0::DOUBLE * len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens))"


def reason() -> str:
    from ..functions.text import VARIANTS

    words = "[" + ", ".join(f"'{v}'" for v in VARIANTS) + "]"
    return f"""CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 'no_tokens' WHEN {SIZES} = 'conflict' THEN 'size_conflict'
        WHEN len(list_intersect(a.brand_tokens, b.brand_tokens)) = 0 AND len(a.brand_tokens) > 0 AND len(b.brand_tokens) > 0 THEN 'brand_conflict' WHEN {VARIANT.replace("{v}", words)} > 0 THEN 'variant_conflict'
        WHEN {DICE} < 0.8::DOUBLE THEN 'below_threshold' END"""


CHECK = "(10 - list_sum(list_transform(range(1, length({b}) + 1), lambda i: CAST(substr({b}, length({b}) + 1 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10"


def gtin(code: str) -> str:
    """Of a twelve-digit code."""
    body = f"substr({code}, 1, 11)"
    return f"CASE WHEN {code} ~ '^[0-9]{{12}}$' AND NOT {code} ~ '^0+$' AND {CHECK.replace('{b}', body)} = CAST(substr({code}, 12, 1) AS INTEGER) THEN lpad({code}, 14, '0') END"


CANDIDATES = """
q AS (SELECT product_id AS query_id, * EXCLUDE (product_id) FROM tok WHERE product_id % 50 = 0),
qt AS (SELECT query_id, unnest(tokens[1:32]) AS token FROM q), pt AS (SELECT product_id, unnest(tokens) AS token FROM {src}),
cand AS (SELECT query_id, product_id, count(*) AS shared FROM qt JOIN pt USING (token) GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, product_id) AS INTEGER) AS rank FROM cand QUALIFY rank <= 50)
"""
REPORTS = """
rep AS (SELECT sku AS adapter, CAST(observed_at AS DATE) AS date, CAST(k AS BIGINT) AS attempted, CAST(k - k % 4 AS BIGINT) AS extracted,
        CASE WHEN k % 3 = 0 THEN 'no_price' ELSE 'no_sku' END AS reason, CAST(k % 4 AS BIGINT) AS n FROM o)
"""
GREEDY = """WITH RECURSIVE {obs},
s AS (SELECT panelist_id, sku, observation_id, epoch_us(observed_at) AS "at", row_number() OVER (PARTITION BY panelist_id, sku ORDER BY observed_at, observation_id) AS rn FROM {src}),
g AS (SELECT panelist_id, sku, observation_id, "at", rn, "at" AS last, TRUE AS kept FROM s WHERE rn = 1
      UNION ALL SELECT s.panelist_id, s.sku, s.observation_id, s."at", s.rn, CASE WHEN s."at" - g.last >= 43200000000 THEN s."at" ELSE g.last END, s."at" - g.last >= 43200000000
      FROM g JOIN s ON s.panelist_id = g.panelist_id AND s.sku = g.sku AND s.rn = g.rn + 1)
"""
MINOR = "'$' || (price // 100) || '.' || lpad(CAST(price % 100 AS VARCHAR), 2, '0')"
PLURAL = lambda n, noun: f"({n} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END)"
EMAIL, ZIP = scrub.RULES["email"], scrub.RULES["zip"]

BEST = f"""picked AS (SELECT top.query_id AS base_id, top.product_id, {DICE} AS score FROM top JOIN q a ON a.query_id = top.query_id JOIN tok b ON b.product_id = top.product_id WHERE {reason()} IS NULL
        QUALIFY row_number() OVER (PARTITION BY top.query_id ORDER BY {DICE} DESC, top.product_id) = 1),
best AS (SELECT base_id * 3 + seller AS query_id, product_id, score FROM picked, (SELECT unnest([0, 1, 2]) AS seller))"""
DRAW = "CAST('0x' || substr(md5(seed || '|{label}|' || position), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"

SQL: dict[str, str] = {
    "cell_resolution": f"{R} SELECT cell_key, {FLAT} FROM r",
    "cell_resolution_noise": f"""WITH {OBS}, v0 AS (SELECT * REPLACE (sku AS cell_key) FROM o WHERE observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-02-01'),
        v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY cell_key, panelist_id ORDER BY observed_at DESC, received_at DESC, observation_id DESC) = 1), {resolved("v1")} SELECT cell_key, {FLAT} FROM r""",
    "cell_resolution_too_many": f"""WITH {ORDERS}, v1 AS (SELECT * FROM po QUALIFY row_number() OVER (PARTITION BY cell_key, panelist_id ORDER BY observed_at DESC, received_at DESC, observation_id DESC) = 1), {resolved("v1")} SELECT cell_key, {FLAT} FROM r""",
    "cell_no_observations": f"""WITH {OBS}, v0 AS (SELECT * FROM o WHERE observed_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-02'),
        v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY cell_key, panelist_id ORDER BY observed_at DESC, received_at DESC, observation_id DESC) = 1), {resolved("v1", "cell_key", "o")} SELECT cell_key, {FLAT} FROM r""",
    "cell_requested": f"{R} SELECT count(*) AS queried, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'RESOLVED' AND k > 1) AS multi_tier, count(*) FILTER (status IS NULL) AS missing FROM (SELECT DISTINCT cell_key FROM o WHERE retailer = 'target') x LEFT JOIN r USING (cell_key)",
    "obs_flatten": f"{O} SELECT observation_id, panelist_id, price_minor, currency, is_estimate, fulfillment, zip3 FROM o",
    "cell_keys": f"{O} SELECT observation_id, cell_key, retailer || '|' || sku AS sku_key, retailer || ':' || sku AS probe_key, panelist_id || '|' || cell_key || '|' || price_minor || '|' || currency AS semantic_key FROM o",
    "canonical_cell_keys": f"{O} SELECT observation_id, CASE WHEN observation_id % 3 <> 0 THEN 'fuzzy:' || sku || '|' || fulfillment || '|' || coalesce(zip3, '') END AS canonical_cell_key FROM o",
    "cell_scan": f"{O} SELECT observation_id, observed_at, price_minor FROM t72 WHERE cell_key = 'target||view|delivery|080'",
    "panelist_scan": f"{O} SELECT observation_id, observed_at, cell_key FROM o WHERE panelist_id = 7 AND observed_at >= TIMESTAMP '2024-01-10' AND observed_at < TIMESTAMP '2024-01-20'",
    "canonical_cell_scan": f"{O} SELECT observation_id, price_minor FROM o WHERE observation_id % 3 <> 0 AND sku = 'view' AND fulfillment = 'delivery' AND zip3 = '080'",
    "point_lookup": f"{O} SELECT observation_id, panelist_id, cell_key, price_minor FROM o WHERE observation_id = 42",
    "export_window": f"{O} SELECT observation_id, observed_at, panelist_id, cell_key, price_minor, clean_session FROM o WHERE observed_at >= TIMESTAMP '2024-01-08' AND observed_at < TIMESTAMP '2024-01-15'",
    "json_clean_session": f"{O} SELECT observation_id, k > 49 AS flag, CAST(NULL AS VARCHAR) AS missing FROM o",
    "validate_rows": f"""{O} SELECT observation_id, 'facts.price: not whole USD cents of zero or more' AS error FROM o WHERE price_minor > 1000 UNION ALL SELECT observation_id, 'context.zip3: malformed' FROM o WHERE k % 10 = 0
        UNION ALL SELECT observation_id, 'product.title: 1 to 512 characters' FROM o WHERE k % 7 = 3 UNION ALL SELECT observation_id, 'store: empty' FROM o WHERE store_label IS NULL""",
    "parse_cell_key": f"{O} SELECT observation_id, observation_id % 7 > 1 AS ok FROM o",
    "forbidden_keys": f"{O} SELECT observation_id, 'list[0].email' AS path FROM o WHERE observation_id % 50 = 0",
    "week_windows": f"""{O} SELECT CAST(w AS INTEGER) AS week, TIMESTAMP '2024-01-01' + to_days(CAST(7 * (w - 1) AS INTEGER)) AS start, TIMESTAMP '2024-01-01' + to_days(CAST(7 * w AS INTEGER)) AS "end", count(*) AS rows, count(DISTINCT panelist_id) AS panelists
        FROM range(1, 5) t(w) JOIN o ON observed_at >= TIMESTAMP '2024-01-01' + to_days(CAST(7 * (w - 1) AS INTEGER)) AND observed_at < TIMESTAMP '2024-01-01' + to_days(CAST(7 * w AS INTEGER)) GROUP BY ALL""",
    "since_dates": f"{O} SELECT CAST(CAST(observed_at AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM o WHERE CAST(observed_at AS DATE) >= DATE '2024-01-24' GROUP BY ALL",
    "probe_rows": f"{O} SELECT observation_id, panelist_id, price_minor FROM o WHERE session_state = 'logged_out' AND clean_session IS TRUE",
    "same_store": f"""{O}, s AS (SELECT DISTINCT panelist_id, sku, retailer, session_state, CASE WHEN observation_id % 5 = 0 THEN 's1' END AS store_id, store_label FROM o)
        SELECT a.panelist_id, a.sku, a.store_id AS anon_store_id, a.store_label AS anon_store_label, m.store_id AS mine_store_id, m.store_label AS mine_store_label,
        CASE WHEN a.store_id IS NOT NULL AND m.store_id IS NOT NULL THEN a.store_id = m.store_id WHEN a.retailer <> 'instacart' AND a.store_label IS NOT NULL AND m.store_label IS NOT NULL THEN a.store_label = m.store_label END AS same
        FROM s a JOIN s m ON a.panelist_id = m.panelist_id AND a.sku = m.sku WHERE a.session_state = 'logged_out' AND m.session_state = 'logged_in'""",
    "coupon_required": "WITH t AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS k, list_sum(list_transform(range(1, p_size + 1), lambda i: 1::DOUBLE / i)) AS h FROM part) SELECT p_partkey, k, round(h, 6) AS harmonic, round(k * h, 6) AS expected, CAST(ceil(round(1.5 * k * h, 9)) AS BIGINT) AS required FROM t",
    "coupon_all_seen": f"{LINE_SHARES}, s AS (SELECT *, unnest([0, 1, 5, 6, 20, 100]) AS n FROM g) SELECT l_suppkey, n, round({all_seen('shares', 'n', 'k')}, 6) AS p FROM s",
    "expected_draws": f"""{LINE_SHARES},
        s AS (SELECT l_suppkey, m, list_sum(list_transform(range(k), lambda i: CASE WHEN (m >> CAST(i AS INTEGER)) & 1 = 1 THEN shares[i + 1] ELSE 0 END)) AS p FROM g, LATERAL (SELECT unnest(range(1, CAST(power(2, k) AS BIGINT))) AS m) x)
        SELECT l_suppkey, round(sum(CASE WHEN bit_count(m) % 2 = 1 THEN 1 ELSE -1 END / p), 6) AS draws FROM s GROUP BY l_suppkey""",
    "tier_shares": f"{R} SELECT kept.cell_key, CAST(row_number() OVER (PARTITION BY kept.cell_key ORDER BY price) - 1 AS INTEGER) AS tier, price, c AS n, round(c / r.kept_n, 6) AS share FROM kept JOIN r USING (cell_key) WHERE status = 'RESOLVED'",
    "cell_confidence": f"{R} SELECT cell_key, confidence FROM r WHERE status = 'RESOLVED'",
    "cell_explain": f"""{R}, t AS (SELECT cell_key, string_agg({MINOR} || ' (' || CAST(floor(100 * c / kept_n + 0.5) AS BIGINT) || '%)', ', ' ORDER BY price) AS ladder, first(c ORDER BY price) AS floor_n, first({MINOR} ORDER BY price) AS floor_text
        FROM kept JOIN (SELECT cell_key, kept_n FROM r) USING (cell_key) GROUP BY cell_key)
        SELECT cell_key, CASE WHEN status = 'RESOLVED' AND k = 1 THEN 'One price in the last 3 days: ' || floor_text || ', seen ' || {PLURAL("floor_n", "time")} || ' across ' || {PLURAL("n", "observation")} || '. Everyone we observed was shown the same price.'
        WHEN status = 'RESOLVED' THEN {PLURAL("k", "price")} || ' in the last 3 days across ' || {PLURAL("n", "observation")} || ': ' || ladder || '. Floor: ' || floor_text || ', seen ' || {PLURAL("floor_n", "time")} || '. Confidence ' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% that no tier is still hidden.'
        WHEN reason = 'insufficient_n' THEN 'Not enough data yet: ' || {PLURAL("n", "observation")} || ' in the last 3 days showing ' || {PLURAL("k", "distinct price")} || '. About ' || needed || ' more needed before the tiers can be resolved.'
        WHEN reason = 'rare_tier_unconfirmed' THEN {PLURAL("n", "observation")} || ' in the last 3 days show ' || {PLURAL("k", "distinct price")} || ', but the rarest has been seen fewer than 3 times. About ' || needed || ' more needed to confirm it.' END AS sentence FROM r JOIN t USING (cell_key)""",
    "ladder_view": f"""{R}, mine AS (SELECT cell_key, price_minor AS my_price FROM o WHERE panelist_id % 10 = 3 QUALIFY row_number() OVER (PARTITION BY cell_key ORDER BY observed_at DESC, received_at DESC, observation_id DESC) = 1)
        SELECT mine.cell_key, my_price, CASE WHEN status = 'RESOLVED' THEN 'resolved' WHEN coalesce(r.n, 0) > 0 THEN 'unresolved' ELSE 'no_data' END AS state, price, price = my_price AS mine, price = floor_minor AS floor
        FROM mine LEFT JOIN r USING (cell_key) LEFT JOIN kept ON kept.cell_key = mine.cell_key AND r.status = 'RESOLVED'""",
    "one_vote_per_panelist": f"{O} SELECT cell_key, panelist_id, observation_id, observed_at, price_minor FROM votes",
    "id_dedup": f"{O} SELECT retailer, count(*) AS accepted FROM o WHERE observation_id % 10 <> 1 GROUP BY retailer",
    "batch_slices": f"{O}, s AS (SELECT panelist_id, observation_id, CAST((row_number() OVER (PARTITION BY panelist_id ORDER BY observed_at, observation_id) - 1) // 20 AS INTEGER) AS slice FROM o) SELECT panelist_id, slice, count(*) AS rows, min(observation_id) AS first_id FROM s GROUP BY ALL",
    "fifo_cap": f"{O} SELECT panelist_id, observed_at, observation_id FROM o QUALIFY row_number() OVER (PARTITION BY panelist_id ORDER BY observed_at DESC, observation_id DESC) <= 5",
    "semantic_dedup": GREEDY.replace("{obs}", OBS).replace("{src}", "o") + "SELECT observation_id FROM g WHERE kept",
    "panel_metrics": f"{O} SELECT retailer, count(DISTINCT panelist_id) AS panelists, count(*) AS rows, count(*) FILTER (session_state = 'logged_out' AND clean_session) AS probe_rows, count(*) FILTER (is_estimate) AS estimate_rows FROM o GROUP BY ROLLUP (retailer)",
    "rows_by_adapter": f"{O} SELECT adapter, count(*) AS rows FROM o GROUP BY ALL",
    "rows_by_zip3": f"{O} SELECT zip3, count(*) AS rows FROM o GROUP BY ALL",
    "rows_by_fulfillment": f"{O} SELECT fulfillment, count(*) AS rows FROM o GROUP BY ALL",
    "top_skus": f"WITH {ORDERS}, t AS (SELECT sku, title FROM (SELECT sku, title, count(*) AS c FROM po GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY c DESC, title) = 1) SELECT sku, count(*) AS rows, count(DISTINCT panelist_id) AS panelists, any_value(t.title) AS title FROM po JOIN t USING (sku) GROUP BY sku ORDER BY rows DESC, panelists DESC, sku LIMIT 20",
    "common_title": f"WITH {ORDERS} SELECT sku, title FROM (SELECT sku, title, count(*) AS c FROM po GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY c DESC, title) = 1",
    "cell_summary": f"WITH {OBS}, {CELLS} SELECT cell_key, rows, panelists, excluded_rows, votes, title, status, k, spread FROM cells",
    "cell_metrics": f"""WITH {OBS}, {CELLS} SELECT count(*) AS cells, count(*) FILTER (votes >= 5) AS cells_with_votes, count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'RESOLVED' AND k > 1) AS multi_tier,
        round(count(*) FILTER (status = 'RESOLVED' AND k > 1) / nullif(count(*) FILTER (status = 'RESOLVED'), 0), 6) AS multi_tier_share, max(spread) AS max_spread, median(spread) AS median_spread, CAST(sum(excluded_rows) AS BIGINT) AS excluded_rows FROM cells""",
    "tier_histogram": f"{R} SELECT k, count(*) AS cells FROM r WHERE status = 'RESOLVED' GROUP BY k",
    "unresolved_by_reason": f"{R} SELECT reason, count(*) AS cells FROM r WHERE reason IS NOT NULL GROUP BY reason",
    "max_spread": f"{R} SELECT cell_key, spread FROM r WHERE spread IS NOT NULL ORDER BY spread DESC, cell_key LIMIT 1",
    "median_spread": f"{R} SELECT median(spread) AS median_spread FROM r",
    "suspects": f"""{O}, own AS (SELECT cell_key, panelist_id, min(price_minor) AS lo, max(price_minor) AS hi FROM t72 GROUP BY ALL),
        base AS (SELECT * FROM own WHERE panelist_id NOT IN (SELECT panelist_id FROM flags WHERE status = 'suspect')),
        oth AS (SELECT x.cell_key, x.panelist_id, count(*) AS others, min(b.lo) AS others_lo, max(b.hi) AS others_hi FROM own x JOIN base b ON x.cell_key = b.cell_key AND x.panelist_id <> b.panelist_id GROUP BY ALL HAVING count(*) >= 3)
        SELECT cell_key, panelist_id, others, others_lo, others_hi FROM oth JOIN t72 USING (cell_key, panelist_id) GROUP BY ALL HAVING bool_and(price_minor < 0.5 * others_lo OR price_minor > 1.5 * others_hi)""",
    "suspect_exclusion_anti": f"{O} SELECT cell_key, count(*) AS rows FROM clean GROUP BY ALL",
    "flags_semi": f"{O} SELECT * FROM flags WHERE panelist_id IN (SELECT panelist_id FROM o WHERE sku = 'view')",
    "flag_counts": f"{O} SELECT status, count(*) AS panelists FROM flags GROUP BY ALL",
    "rate_windows": f"{O} SELECT panelist_id, date_trunc('hour', received_at) AS window_start, count(*) AS count FROM o GROUP BY ALL",
    "rate_counts_left": f"""{O}, a AS (SELECT DISTINCT panelist_id, date_trunc('hour', received_at) AS window_start FROM o), b AS (SELECT panelist_id, date_trunc('hour', received_at) AS window_start, count(*) AS c FROM o WHERE session_state = 'logged_in' GROUP BY ALL)
        SELECT panelist_id, window_start, coalesce(c, 0) AS count FROM a LEFT JOIN b USING (panelist_id, window_start)""",
    "rate_demands": f"""{O} SELECT CASE WHEN retailer <> 'target' THEN 'token:' || substr(sha256(retailer), 1, 16) ELSE 'token:open' END AS key, count(*) AS demand FROM o GROUP BY ALL
        UNION ALL SELECT 'panelist:' || panelist_id, count(*) FROM o GROUP BY panelist_id""",
    "rate_over_limit": f"""{O}, a AS (SELECT 'panelist:' || panelist_id AS key, count(*) AS demand FROM o WHERE observed_at >= TIMESTAMP '2024-01-16' GROUP BY ALL), b AS (SELECT 'panelist:' || panelist_id AS key, count(*) AS c FROM o WHERE observed_at < TIMESTAMP '2024-01-16' GROUP BY ALL)
        SELECT key, demand, coalesce(c, 0) AS count FROM a LEFT JOIN b USING (key) WHERE demand + coalesce(c, 0) > 16""",
    "same_store_counts": f"""{O}, s AS (SELECT observation_id, panelist_id, sku, retailer, session_state, CASE WHEN observation_id % 5 = 0 THEN 's1' END AS store_id, store_label FROM o)
        SELECT a.panelist_id, a.sku, CASE WHEN a.store_id IS NOT NULL AND m.store_id IS NOT NULL THEN a.store_id = m.store_id WHEN a.retailer <> 'instacart' AND a.store_label IS NOT NULL AND m.store_label IS NOT NULL THEN a.store_label = m.store_label END AS same, count(*) AS pairs
        FROM s a JOIN s m ON a.panelist_id = m.panelist_id AND a.sku = m.sku WHERE a.session_state = 'logged_out' AND m.session_state = 'logged_in' GROUP BY ALL""",
    "rate_counts_left_whole": f"""{O}, a AS (SELECT DISTINCT panelist_id, date_trunc('hour', received_at) AS window_start FROM o WHERE session_state = 'logged_out'), b AS (SELECT panelist_id, date_trunc('hour', received_at) AS window_start, count(*) AS c FROM o WHERE session_state <> 'logged_out' GROUP BY ALL)
        SELECT panelist_id, window_start, coalesce(c, 0) AS count FROM a LEFT JOIN b USING (panelist_id, window_start)""",
    "rate_demands_whole": f"""{O} SELECT CASE WHEN panelist_id % 2 = 0 THEN 'token:' || substr(sha256('abc'), 1, 16) ELSE 'token:open' END AS key, count(*) AS demand FROM o GROUP BY ALL
        UNION ALL SELECT 'panelist:' || panelist_id, count(*) FROM o GROUP BY panelist_id""",
    "rate_over_limit_whole": f"""{O}, a AS (SELECT 'panelist:' || panelist_id AS key, count(*) AS demand FROM o WHERE session_state = 'logged_out' GROUP BY ALL), b AS (SELECT 'panelist:' || panelist_id AS key, count(*) AS c FROM o WHERE session_state <> 'logged_out' GROUP BY ALL)
        SELECT key, demand, coalesce(c, 0) AS count FROM a LEFT JOIN b USING (key) WHERE demand + coalesce(c, 0) > 16""",
    "rate_add": f"{O} SELECT panelist_id AS key, date_trunc('hour', received_at) AS window_start, count(*) * CASE WHEN panelist_id % 2 = 0 THEN 2 ELSE 1 END AS count FROM o GROUP BY panelist_id, date_trunc('hour', received_at)",
    "probe_pairs_asof": f"WITH {OBS}, {pairs(60, 5)} SELECT * FROM pairs",
    "probe_pairs_two_days": f"WITH {OBS}, {pairs(2880, 5)} SELECT * FROM pairs",
    "probe_rates": f"WITH {OBS}, {pairs(2880, 5)}, {RATES} SELECT * FROM rates",
    "probe_stats": f"WITH {OBS}, {pairs(2880, 5)} SELECT retailer, coalesce(verdict, 'UNPAIRED') AS verdict, count(*) AS checks FROM pairs GROUP BY ALL",
    "latest_own": f"{O} SELECT panelist_id, sku, observation_id, price_minor FROM o WHERE clean_session IS DISTINCT FROM TRUE QUALIFY row_number() OVER (PARTITION BY panelist_id, sku ORDER BY observed_at DESC, observation_id DESC) = 1",
    "sku_links_inner": f"WITH {PRODUCTS} SELECT 'target|' || a.product_id AS sku_key, b.product_id AS canonical_id, b.title FROM p0 a JOIN p0 b ON b.product_id = a.product_id // 2 WHERE a.product_id % 3 = 0",
    "token_candidates_topk": f"WITH {PRODUCTS}, {CANDIDATES.replace('{src}', 'tok')} SELECT query_id, product_id, shared, rank FROM top",
    "best_match": f"WITH {PRODUCTS}, {CANDIDATES.replace('{src}', 'tok')}, {BEST} SELECT query_id, product_id, round(score, 6) AS score FROM best",
    "canonical_match": f"""WITH {PRODUCTS}, {CANDIDATES.replace("{src}", "tok")}, {BEST}, u AS (SELECT *, {gtin("upc")} AS code FROM tok), k AS (SELECT product_id, coalesce('gtin:' || code, {FUZZY}) AS id FROM u)
        SELECT query_id, id AS canonical_id, 'fuzzy' AS method, round(score, 6) AS confidence FROM best JOIN k USING (product_id)""",
    "tokenize_titles": f"WITH {PRODUCTS} SELECT product_id, array_to_string(tokens, '-') AS tokens, array_to_string(brand_tokens, '-') AS brand_tokens FROM tok",
    "parse_size": """WITH t AS (SELECT p_partkey, p_partkey % 15 AS i, p_size AS n, CAST(p_size AS VARCHAR) AS x FROM part),
        s AS (SELECT *, replace(['# fl oz', '# oz', '# L', '# lb', '# Pack 12 fl oz', '# oz Pack of #', '1/# lb', '2 oz (# g)', '0,# kg', 'Case of #', 'sold by the each', 'half gallon', '# Ozbag', 'Packs #', 'plain'][i + 1], '#', x) AS text,
            CASE i WHEN 0 THEN n * 29.5735::DOUBLE WHEN 2 THEN n * 1000::DOUBLE WHEN 4 THEN 354.882::DOUBLE WHEN 11 THEN 1892.705::DOUBLE END AS ml,
            CASE WHEN i IN (1, 5) THEN n * 28.3495::DOUBLE WHEN i = 3 THEN n * 453.592::DOUBLE WHEN i = 6 THEN 453.592::DOUBLE / n WHEN i = 7 THEN 56.699::DOUBLE WHEN i = 8 THEN CAST('0.' || x AS DOUBLE) * 1000 END AS g,
            CASE WHEN i IN (4, 5, 9, 13) THEN n::DOUBLE WHEN i = 10 THEN 1::DOUBLE END AS ct FROM t)
        SELECT p_partkey, text, round(ml, 6) AS ml, round(g, 6) AS g, round(ct, 6) AS ct, CASE WHEN i = 7 THEN '( )' WHEN i IN (12, 14) THEN text ELSE '' END AS rest,
        concat_ws('+', CAST(floor(ml + 0.5) AS BIGINT) || 'ml', CAST(floor(g + 0.5) AS BIGINT) || 'g', CAST(floor(ct + 0.5) AS BIGINT) || 'ct') AS key FROM s""",
    "size_compare": f"WITH {PRODUCTS} SELECT a.product_id AS a, b.product_id AS b, {SIZES} AS sizes FROM tok a JOIN tok b ON b.product_id = a.product_id + 1",
    "normalize_upc": f"""WITH c AS (SELECT p_partkey AS product_id, lpad(CAST(p_partkey * 7919 AS VARCHAR), 11, '0') || (p_partkey % 10) AS code FROM part)
        SELECT product_id, {gtin("code")} AS gtin, CAST({CHECK.replace("{b}", "substr(code, 1, 11)")} AS INTEGER) AS check_digit FROM c""",
    "dice_match": f"""WITH {PRODUCTS}, u AS (SELECT *, {gtin("upc")} AS code FROM tok)
        SELECT a.product_id AS a_id, b.product_id AS b_id, CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN 'upc' ELSE 'fuzzy' END AS method,
        round(CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN CASE WHEN a.code = b.code THEN 1 ELSE 0 END ELSE {DICE} END, 6) AS score,
        CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN CASE WHEN a.code <> b.code THEN 'upc_conflict' END ELSE {reason()} END AS reason FROM u a JOIN u b ON b.product_id = a.product_id + 3""",
    "canonical_id": f"""WITH {PRODUCTS}, u AS (SELECT *, {gtin("upc")} AS code FROM tok)
        SELECT product_id, coalesce('gtin:' || code, {FUZZY}) AS canonical_id, CASE WHEN code IS NOT NULL THEN 'upc' ELSE 'fuzzy' END AS method, CASE WHEN code IS NOT NULL THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM u""",
    "product_record": f"{O} SELECT 'fuzzy:' || sku AS canonical_id, first(observation_id ORDER BY observed_at, observation_id) AS by, first(retailer ORDER BY observed_at, observation_id) AS retailer, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at FROM o GROUP BY ALL",
    "shift_blocks": f"WITH {OBS}, {SKU_CELL}, {BLOCKS.replace('{src}', 'sc')} SELECT * FROM blocks",
    "detect_shift": f"""WITH RECURSIVE {OBS}, {SKU_CELL}, sh AS (SELECT * REPLACE (CAST(CASE WHEN observed_at < TIMESTAMP '2024-01-16' THEN 200 WHEN sku = 'view' THEN 260 ELSE 200 END + CASE WHEN k % 10 = 0 THEN 50 ELSE 0 END AS BIGINT) AS price_minor) FROM sc), {BLOCKS.replace("{src}", "sh")},
        nbk AS (SELECT cell_key, count(block) AS nb, avg(share) AS ms FROM (SELECT DISTINCT cell_key FROM sh) LEFT JOIN blocks USING (cell_key) GROUP BY cell_key),
        ref AS (SELECT cell_key, quantile_disc(median, 0.5) AS ref FROM blocks WHERE block < 3 GROUP BY cell_key),
        x AS (SELECT cell_key, block, "at", (median - ref) / ref::DOUBLE AS x FROM blocks JOIN ref USING (cell_key)),
        sg AS (SELECT cell_key, greatest(0.02, coalesce(stddev_samp(x), 0)) AS sigma FROM x GROUP BY cell_key),
        z AS (SELECT cell_key, block, "at", x / sigma AS z FROM x JOIN sg USING (cell_key)),
        cu AS (SELECT cell_key, -1 AS block, 0::DOUBLE AS up, 0::DOUBLE AS dn, 0 AS us, 0 AS ds, CAST(NULL AS INTEGER) AS alarm FROM sg
               UNION ALL SELECT cell_key, z.block, greatest(up + z - 0.5, 0), greatest(dn - z - 0.5, 0), CASE WHEN up + z - 0.5 <= 0 THEN z.block + 1 ELSE us END, CASE WHEN dn - z - 0.5 <= 0 THEN z.block + 1 ELSE ds END,
               CASE WHEN up + z - 0.5 > 4 THEN us WHEN dn - z - 0.5 > 4 THEN ds END FROM cu JOIN z USING (cell_key) WHERE z.block = cu.block + 1 AND alarm IS NULL),
        al AS (SELECT cell_key, max(alarm) AS alarm FROM cu GROUP BY cell_key),
        rs AS (SELECT cell_key, CASE WHEN nb < 2 THEN 'too_few_blocks' WHEN ms < 0.7 OR ref <= 0 THEN 'no_dominant_price' END AS inconclusive FROM nbk LEFT JOIN ref USING (cell_key))
        SELECT rs.cell_key, inconclusive IS NULL AND alarm IS NOT NULL AS shifted, CASE WHEN inconclusive IS NULL THEN blocks."at" END AS "at", inconclusive FROM rs LEFT JOIN al USING (cell_key) LEFT JOIN blocks ON blocks.cell_key = rs.cell_key AND blocks.block = alarm""",
    "first_resolution": f"WITH {OBS}, {SETTINGS}, {FIRST} SELECT * FROM fr",
    "reconcile_sweep": f"""WITH {OBS}, {resolved()}, {SETTINGS}, {FIRST}, j AS (SELECT fr.*, r.k AS kf, r.floor_minor AS ff FROM fr JOIN r USING (cell_key) WHERE status = 'RESOLVED')
        SELECT s.factor, s.sightings, count(cell_key) AS resolved, count(*) FILTER (k < kf) AS premature_tiers, count(*) FILTER (j.floor_minor > ff) AS premature_floor,
        round(count(*) FILTER (k < kf) / nullif(count(cell_key), 0), 6) AS premature_tier_rate, round(count(*) FILTER (j.floor_minor > ff) / nullif(count(cell_key), 0), 6) AS premature_floor_rate, median("at") AS median_votes
        FROM settings s LEFT JOIN j ON s.factor = j.factor AND s.sightings = j.sightings GROUP BY ALL""",
    "rare_share_by_k": f"{R}, s AS (SELECT cell_key, any_value(r.k) AS k, min(c / r.kept_n) AS rarest FROM kept JOIN r USING (cell_key) WHERE status = 'RESOLVED' GROUP BY cell_key) SELECT k, count(*) AS cells, round(median(rarest), 6) AS rarest_median, round(min(rarest), 6) AS rarest_min FROM s GROUP BY k",
    "twice_seen": f"{O}, g AS (SELECT count(*) AS n FROM votes GROUP BY cell_key, price_minor) SELECT count(*) FILTER (n >= 2) AS twice, count(*) FILTER (n >= 3) AS thrice, round(count(*) FILTER (n >= 3) / nullif(count(*) FILTER (n >= 2), 0), 6) AS share FROM g",
    "decide": f"""WITH {OBS}, {resolved()}, {pairs(2880, 5)}, {RATES}, i AS (SELECT count(*) FILTER (status = 'RESOLVED') AS resolved, count(*) FILTER (status = 'RESOLVED' AND k > 1) AS multi_tier FROM r), p AS (SELECT CAST(sum(comparable) AS BIGINT) AS checks, CAST(sum(more + less) AS BIGINT) AS differences FROM rates)
        SELECT *, CASE WHEN resolved >= 20 AND multi_tier / resolved >= 0.2 THEN 'TRACK_B' WHEN checks >= 50 AND differences / checks >= 0.1 THEN 'TRACK_A' WHEN resolved >= 20 AND checks >= 50 THEN 'PIVOT' ELSE 'INCONCLUSIVE' END AS verdict FROM i, p""",
    "retention_purge": f"{O} SELECT retailer, count(*) AS rows, min(received_at) AS oldest FROM o WHERE received_at >= TIMESTAMP '2024-04-14 12:00:00' - INTERVAL 90 DAY GROUP BY retailer",
    "panelist_delete": f"{O} SELECT retailer, count(*) AS rows FROM o WHERE panelist_id % 7 <> 0 GROUP BY retailer",
    "pending_anti": f"{O} SELECT observation_id FROM o WHERE observation_id % 2 <> 0",
    "live_sent": f"{O} SELECT observation_id FROM o WHERE observation_id % 5 = 0 OR observed_at >= TIMESTAMP '2024-01-23'",
    "contributed_since": f"{O} SELECT panelist_id, count(*) FILTER (observed_at >= TIMESTAMP '2024-01-20') AS rows FROM o GROUP BY panelist_id",
    "health_summary": f"WITH {OBS}, {REPORTS} SELECT adapter, CAST(date AS VARCHAR) AS date, CAST(sum(sum(attempted)) OVER w AS BIGINT) AS attempted, CAST(sum(sum(extracted)) OVER w AS BIGINT) AS extracted, reason, CAST(sum(n) AS BIGINT) AS n FROM rep GROUP BY adapter, date, reason WINDOW w AS (PARTITION BY adapter, date)",
    "health_fold": f"""WITH {OBS}, {REPORTS}, t AS (SELECT adapter, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(extracted) AS BIGINT) AS extracted FROM rep GROUP BY adapter), s AS (SELECT adapter, reason, CAST(sum(n) AS BIGINT) AS n FROM rep GROUP BY ALL)
        SELECT adapter, attempted, extracted, round(extracted / attempted, 6) AS rate, CAST(row_number() OVER (PARTITION BY adapter ORDER BY n DESC, reason) - 1 AS INTEGER) AS place, reason, n FROM t JOIN s USING (adapter)""",
    "health_subtract": f"WITH {OBS}, {REPORTS} SELECT adapter, CAST(sum(attempted) FILTER (attempted % 2 = 1) AS BIGINT) AS attempted, CAST(sum(extracted) FILTER (attempted % 2 = 1) AS BIGINT) AS extracted FROM rep GROUP BY adapter",
    "outcome_counters": f"{O} SELECT adapter, count(*) AS attempted, count(*) FILTER (k % 5 = 0) AS stored, count(*) FILTER (k % 5 = 1) AS duplicates, count(*) FILTER (k % 5 = 2) AS rejected, count(*) FILTER (k % 5 = 3) AS skipped, count(*) FILTER (k % 5 = 4) AS failed FROM o GROUP BY adapter",
    "sessions_by_query": f"""{O}, l AS (SELECT *, CASE WHEN lag(sku) OVER w = sku THEN 0 ELSE 1 END AS ch FROM o WINDOW w AS (PARTITION BY panelist_id ORDER BY observed_at, observation_id)),
        s AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY panelist_id ORDER BY observed_at, observation_id) AS BIGINT) AS session FROM l)
        SELECT observation_id, session, CAST(row_number() OVER (PARTITION BY panelist_id, session ORDER BY observed_at, observation_id) AS INTEGER) AS count FROM s""",
    "debounce": f"""{O}, l AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER (PARTITION BY panelist_id ORDER BY observed_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS ch FROM o),
        s AS (SELECT *, sum(ch) OVER (PARTITION BY panelist_id ORDER BY observed_at) AS burst FROM l) SELECT panelist_id, count(*) AS changes, max(observed_at) AS settled FROM s GROUP BY panelist_id, burst""",
    "capture_outcomes": f"""{O}, x AS (SELECT panelist_id, sku || '|' || price_minor AS rendering, observation_id, k % 10 = 9 AS bad FROM o), y AS (SELECT *, observation_id = min(CASE WHEN NOT bad THEN observation_id END) OVER (PARTITION BY panelist_id, rendering) AS first FROM x)
        SELECT CASE WHEN bad THEN 'extract_failed' WHEN first THEN 'stored' ELSE 'duplicate' END AS outcome, count(*) AS rows FROM y GROUP BY ALL""",
    "backoff": f"{O}, t AS (SELECT panelist_id, CAST(count(*) FILTER (WHERE k % 10 = 9) AS BIGINT) AS f FROM o GROUP BY ALL) SELECT panelist_id, f AS failures, CASE WHEN f <= 0 THEN 0 ELSE CAST(least(86400000, 900000 * power(2, f - 1)) AS BIGINT) END AS ms FROM t",
    "remembered_ids": f"""WITH RECURSIVE {OBS}, u AS (SELECT DISTINCT 'b' || panelist_id AS browser, observed_at AS used FROM o),
        m AS (SELECT browser, min(used) AS minted_at FROM u GROUP BY browser UNION ALL SELECT m.browser, min(u.used) FROM m JOIN u ON u.browser = m.browser AND u.used >= m.minted_at + INTERVAL 2 DAY GROUP BY m.browser, m.minted_at),
        i AS (SELECT *, sha256(browser || '|' || epoch_us(minted_at)) AS id FROM m)
        SELECT browser, id, minted_at, array_to_string(list_reverse(list(id) OVER (PARTITION BY browser ORDER BY minted_at ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), ',') AS ids FROM i""",
    "stored_panelists": f"{O} SELECT observation_id, panelist_id, cell_key, observed_at, received_at, price_minor FROM o WHERE panelist_id IN (3, 17, 40) AND received_at BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-21 18:00:00'",
    "scrub_email": f"WITH s AS (SELECT doc_id, text, regexp_replace(text, '{EMAIL}', '[scrubbed]', 'g') AS c FROM documents) SELECT doc_id, sha256(c) AS sha, CAST(length(c) AS INTEGER) AS n_chars FROM s WHERE text <> c",
    "pii_violations_two": f"""SELECT doc_id, rule, hits[1] AS first, CAST(len(hits) AS INTEGER) AS hits FROM (SELECT doc_id, 'email' AS rule, regexp_extract_all(text, '{EMAIL}') AS hits FROM documents UNION ALL SELECT doc_id, 'zip', regexp_extract_all(text, '{ZIP}') FROM documents) WHERE len(hits) > 0""",
    "text_sha256": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "json_ld": "SELECT page_id, CAST(page_id AS VARCHAR) AS sku, (page_id % 90) * 100 + 50 AS price_minor FROM pages",
    "url_canonical": """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS base, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)
        SELECT page_id, base || CASE WHEN p = '' THEN '/' ELSE p END || '?retailerSlug=walmart' AS canonical, base || CASE WHEN p = '' THEN '/' ELSE p END AS bare FROM u""",
    "path_only": "SELECT page_id, CASE WHEN page_id % 5 > 1 THEN CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END END AS path FROM pages",
    "page_kinds": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'instacart' WHEN 1 THEN 'target' ELSE 'walmart' END AS retailer, CASE WHEN page_id % 4 = 3 THEN 'listing' ELSE 'product' END AS kind, CASE WHEN page_id % 4 < 3 THEN CAST(page_id AS VARCHAR) END AS sku FROM pages",
    "adapter_extract": "SELECT page_id, CAST(page_id AS VARCHAR) AS sku, 'Milk ' || page_id AS title, (page_id % 90) * 100 + 5 AS price_minor, '$' || (page_id % 90) || '.05' AS price_text, 9900::BIGINT AS was_minor, 'logged_out' AS session_state, 'ship' AS fulfillment, CAST(NULL AS VARCHAR) AS reason FROM pages",
    "listing_tiles": """WITH t AS (SELECT l_orderkey AS page_id, l_orderkey % 3 AS r, l_partkey AS part, p_name, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, l_discount > 0.05 AS former,
            row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 1)
        SELECT page_id, ['instacart', 'target', 'walmart'][r + 1] AS retailer, CAST(part AS VARCHAR) AS sku,
            CASE r WHEN 0 THEN 'https://www.instacart.com/products/' || part || '-x?retailerSlug=corner' WHEN 1 THEN 'https://www.target.com/p/x/-/A-' || part ELSE 'https://www.walmart.com/ip/' || part END AS url, p_name AS title,
            CAST(price * 100 AS BIGINT) AS price_minor, '$' || CAST(price AS VARCHAR) AS price_text, CASE WHEN former THEN CAST((price + 1) * 100 AS BIGINT) END AS was_minor, 'Corner' AS store_label, CASE r WHEN 0 THEN 'delivery' ELSE 'ship' END AS fulfillment, TRUE AS fulfillment_inferred
        FROM t WHERE n = 1""",
    "listing_skips": "SELECT l_orderkey AS page_id, 'no_price' AS reason, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 1 GROUP BY l_orderkey",
    "money_parse": "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS amount_minor, '$' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS token, '$' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS shown FROM part",
    "waitlist_validate": """SELECT c_custkey, replace([' C#@B.co ', 'c#@b', 'c#@@b.co', '#', 'c #@z.com', 'c#@mail.example', '@#.co', 'c#@.co', 'c#@b.'][c_custkey % 9 + 1], '#', CAST(c_custkey AS VARCHAR)) AS raw,
        replace(['c#@b.co', 'c#@b', 'c#@@b.co', '#', 'c #@z.com', 'c#@mail.example', '@#.co', 'c#@.co', 'c#@b.'][c_custkey % 9 + 1], '#', CAST(c_custkey AS VARCHAR)) AS email, c_custkey % 9 IN (0, 5) AS ok FROM customer""",
    "waitlist_join": f"{O} SELECT 'u' || (panelist_id % 40) || '@mail.example' AS email, min(observed_at) AS \"at\" FROM o GROUP BY ALL",
    "synth_ladder": f"""WITH p AS (SELECT 'p' || p_partkey AS seed, p_partkey % 4 + 1 AS k, unnest(range(30)) AS position FROM part),
        s AS (SELECT seed, position, position % 10 AS panelist_id, 199 + 50 * CAST(floor({DRAW.replace("{label}", "tier")} * k) AS BIGINT) AS own, {DRAW.replace("{label}", "stay")} < 0.5 AND position >= 10 AS stays FROM p)
        SELECT seed, position, panelist_id, TIMESTAMP '2026-09-04 15:26:18' + to_minutes(position) AS observed_at, last_value(CASE WHEN NOT stays THEN own END IGNORE NULLS) OVER (PARTITION BY seed, panelist_id ORDER BY position) AS price_minor FROM s""",
    "verdict_lines": f"""WITH {OBS}, {pairs(2880, 5)}, v AS (SELECT *, CASE WHEN verdict IS NULL OR verdict = 'STORE_UNKNOWN' THEN 'UNCHECKED' ELSE verdict END AS w, '$' || (abs(delta) // 100) || '.' || lpad(CAST(abs(delta) % 100 AS VARCHAR), 2, '0') AS usd FROM pairs)
        SELECT observation_id, CASE w WHEN 'SAME' THEN 'Same' WHEN 'MORE' THEN 'You pay ' || usd || ' more' WHEN 'LESS' THEN 'You pay ' || usd || ' less' WHEN 'STORE_DIFFERS' THEN 'Store differs' ELSE 'Could not check' END AS line,
        CASE w WHEN 'STORE_DIFFERS' THEN 'Anonymous visitors are served a different store.' WHEN 'UNCHECKED' THEN 'The anonymous page showed no price this time.' END AS detail FROM v""",
    "device_classes": f"{O}, v AS (SELECT observation_id, CASE WHEN observation_id % 3 = 0 OR k * 15 >= 1200 THEN 'desktop' WHEN k * 15 < 768 THEN 'mobile' ELSE 'tablet' END AS device FROM o) SELECT observation_id, device, CASE device WHEN 'desktop' THEN 'web' ELSE 'mobile_web' END AS surface FROM v",
    "window_totals": f"{O} SELECT count(*) AS rows, count(DISTINCT panelist_id) AS panelists, max(observed_at) AS latest, 'recent' AS \"window\" FROM t72 UNION ALL SELECT 0, 0, NULL, 'none'",
    "panelist_cells": f"{O} SELECT panelist_id, cell_key, min(observed_at) AS first_seen FROM o GROUP BY ALL",
    "identity_checks": f"{O} SELECT observation_id, k % 4 = 0 AS is_uuid, sku || '|' || props || '|' || price_minor AS rendering, sha256(panelist_id || '|' || (date_diff('day', DATE '1970-01-01', CAST(observed_at AS DATE)) // 7)) AS pseudonym FROM o",
    "health_rows": f"""{O} SELECT sku || '@1.2.0' AS adapter, CAST(CAST(observed_at AS DATE) AS VARCHAR) AS date, count(*) AS reports, CAST(sum(k) AS BIGINT) AS attempted, CAST(sum(k - k % 4) AS BIGINT) AS extracted,
        CAST(sum(CASE WHEN k % 5 > 1 THEN k % 4 ELSE 0 END) AS BIGINT) AS no_price FROM o WHERE k % 11 <> 0 AND k % 9 <> 0 GROUP BY ALL""",
    "retention_counts": f"""{O}, f AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(panelist_id % 60 AS INTEGER)) AS flagged_at FROM flags), b AS (SELECT DISTINCT panelist_id, date_trunc('hour', received_at) AS window_start FROM o)
        SELECT 'observations' AS "table", count(*) AS deleted FROM o WHERE received_at < TIMESTAMP '2024-01-15 12:00:00' UNION ALL SELECT 'flags', count(*) FROM f WHERE flagged_at < TIMESTAMP '2024-01-15 12:00:00' UNION ALL SELECT 'buckets', count(*) FROM b WHERE window_start < TIMESTAMP '2024-04-14 10:00:00'""",
    "delete_counts": f"""{O}, b AS (SELECT DISTINCT panelist_id, date_trunc('hour', received_at) AS window_start FROM o)
        SELECT 'observations' AS "table", count(*) AS deleted FROM o WHERE panelist_id % 7 < 2 UNION ALL SELECT 'flags', count(*) FROM flags WHERE panelist_id % 7 < 2 UNION ALL SELECT 'buckets', count(*) FROM b WHERE panelist_id % 7 < 2""",
    "ids_to_delete": f"{O} SELECT DISTINCT panelist_id, panelist_id % 7 = 0 AS known FROM o WHERE panelist_id % 7 < 2",
    "stream_hourly": f"{O} SELECT date_trunc('hour', observed_at) AS hour, panelist_id, count(*) AS rows FROM o GROUP BY ALL",
}
SQL["stream_dedup"] = SQL["semantic_dedup"]
SQL["stream_debounce"] = SQL["debounce"]
SQL["stream_ingest"] = SQL["stream_ingest_two_steps"] = SQL["semantic_dedup"]
SQL["ingest_results"] = GREEDY.replace("{obs}", OBS).replace("{src}", "o") + "SELECT count(*) AS presented, count(*) AS valid, count(*) AS admitted, count(*) FILTER (kept) AS accepted, count(*) FILTER (NOT kept) AS duplicates FROM g"
SQL["health_left"] = f"""WITH {OBS}, {REPORTS}, t AS (SELECT adapter, CAST(sum(attempted) AS BIGINT) AS attempted FROM rep WHERE attempted % 2 = 1 GROUP BY adapter),
f AS (SELECT adapter, reason, CAST(sum(n) AS BIGINT) AS n FROM rep WHERE attempted % 2 = 1 GROUP BY ALL HAVING sum(n) > 0)
SELECT adapter, attempted, reason, n FROM t LEFT JOIN f USING (adapter) WHERE attempted > 0"""
SQL["outcome_totals"] = f"""{O}, x AS (SELECT CASE WHEN observation_id % 7 <> 0 THEN adapter ELSE 'other' END AS adapter, k, k % 5 AS what FROM o WHERE observation_id % 11 <> 0),
t AS (SELECT adapter, CAST(sum(CASE WHEN what = 4 THEN k % 4 + 2 * (k % 3) + 2 * (k % 2) ELSE 1 END) AS BIGINT) AS attempted, CAST(sum(CASE what WHEN 4 THEN k % 4 + k % 3 + k % 2 WHEN 3 THEN 0 ELSE 1 END) AS BIGINT) AS extracted FROM x GROUP BY adapter),
u AS (SELECT adapter, 'no_price' AS reason, k % 3 AS n FROM x WHERE what = 4 UNION ALL SELECT adapter, 'rejected', 2 * (k % 2) FROM x WHERE what = 4 UNION ALL SELECT adapter, 'rejected', 1 FROM x WHERE what = 2
      UNION ALL SELECT adapter, CASE WHEN k % 2 = 0 THEN 'no_sku' ELSE 'unknown' END, 1 FROM x WHERE what = 3),
f AS (SELECT adapter, reason, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL HAVING sum(n) > 0) SELECT adapter, attempted, extracted, reason, n FROM t LEFT JOIN f USING (adapter) WHERE attempted >= 0"""
SQL["probe_check_stats"] = f"""WITH {OBS}, {pairs(2880, 5)}, t AS (SELECT retailer, count(*) AS checks, count(*) FILTER (verdict IN ('MORE', 'LESS')) AS differences, count(*) FILTER (verdict IS NULL OR verdict = 'STORE_UNKNOWN') AS failures FROM pairs GROUP BY retailer),
f AS (SELECT retailer, CASE WHEN verdict = 'STORE_UNKNOWN' THEN 'store_unknown' ELSE 'extract_unavailable' END AS reason, count(*) AS n FROM pairs WHERE verdict IS NULL OR verdict = 'STORE_UNKNOWN' GROUP BY ALL)
SELECT retailer, checks, differences, failures, reason, n FROM t LEFT JOIN f USING (retailer)"""
SQL["products_recorded"] = f"""WITH {PRODUCTS}, s AS (SELECT product_id, 'c' || (product_id // 3) AS canonical_id, title, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(product_id % 97 AS INTEGER)) AS TIMESTAMP) AS seen_at, product_id % 1000 AS sku, tokens FROM tok),
r AS (SELECT canonical_id, title, seen_at AS first_seen_at, max(seen_at) OVER (PARTITION BY canonical_id) AS last_seen_at FROM s QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY product_id % 2, product_id) = 1),
l AS (SELECT canonical_id, count(*) AS links FROM (SELECT canonical_id FROM s QUALIFY row_number() OVER (PARTITION BY sku ORDER BY product_id % 2, product_id) = 1) GROUP BY canonical_id),
k AS (SELECT canonical_id, count(DISTINCT token) AS tokens FROM (SELECT canonical_id, unnest(tokens) AS token FROM s) GROUP BY canonical_id)
SELECT canonical_id, title, first_seen_at, last_seen_at, coalesce(links, 0) AS links, coalesce(tokens, 0) AS tokens FROM r LEFT JOIN l USING (canonical_id) LEFT JOIN k USING (canonical_id)"""
SQL["waits"] = f"""{O}, x AS (SELECT observation_id, epoch_us(received_at) AS us, k % 8 AS f, observation_id % 40 - 20 AS h FROM o),
y AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE least(86400000, 900000 * CAST(power(2, f - 1) AS BIGINT)) END AS wait FROM x), z AS (SELECT *, (us + wait * 1000) // 1000 - (us + h * 3600000000) // 1000 AS togo FROM y)
SELECT observation_id, CAST(greatest(1, ceil((3600000000 - us % 3600000000) / 1000000.0)) AS BIGINT) AS seconds, togo > 0 AND togo <= 86400000 AS waits, us // 1000 AS ms FROM z"""
SQL["stream_probe_pairs"] = SQL["probe_pairs_two_days"]
