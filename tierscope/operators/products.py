"""Product identity: signatures, matches, candidates by shared tokens, canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizes, text, upc
from ..schema import CANDIDATES, KEY_TOKENS, MATCH_AT, QUERY_TOKENS
from ..sources.staged import staged

#: Lists of tokens are read in full at once up to this many times the number of candidates wanted.
SHORT_LISTS = 20


def signed(products: DataFrame, title="title", brand="brand", size_text="size_text") -> DataFrame:
    """products with tokens (sorted, distinct), brand_tokens and size; a size text goes before a size in the title."""
    named = F.coalesce(F.col(title), F.lit(""))
    texts = products.withColumn("_texts", F.array(named, F.coalesce(F.col(size_text), F.lit(""))))
    parsed = texts.withColumn("_p", sizes.sizes_in("_texts")).withColumns({"_t": F.col("_p")[0], "_s": F.col("_p")[1]}).drop("_p", "_texts")
    brand_tokens = F.array_sort(F.array_distinct(text.tokenize(F.coalesce(F.col(brand), F.lit("")))))
    out = parsed.withColumn("brand_tokens", brand_tokens).withColumn("tokens", F.array_sort(F.array_union("brand_tokens", text.tokenize(F.col("_t.rest")))))
    return out.withColumn("size", sizes.merge_sizes(F.col("_s.size"), F.col("_t.size"))).drop("_t", "_s")


def signed_once(products: DataFrame) -> DataFrame:
    """signed(products), written: each combination of title, brand and size_text is read once. Texts are dealt to all tasks whatever their bytes, and
    meet the products in a shuffled join, since a table that is small as Parquet can be large in the driver's memory."""
    said = ["title", "brand", "size_text"]
    keyed = products.withColumn("_text", F.to_json(F.struct(*said)))
    texts = keyed.select("_text", *said).distinct().repartition(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_text")
    return staged(keyed.join(staged(signed(texts).drop(*said), "texts").hint("merge"), "_text").drop("_text"), "signed")


def compared(a: str, b: str, threshold: float = MATCH_AT) -> tuple[Column, Column]:
    """(score, reason) of two signatures; the reason is null for the same product."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    score = text.dice(x("tokens"), y("tokens"))
    brands = (F.size(x("brand_tokens")) > 0) & (F.size(y("brand_tokens")) > 0) & ~F.arrays_overlap(x("brand_tokens"), y("brand_tokens"))
    reason = (
        F.when((F.size(x("tokens")) == 0) | (F.size(y("tokens")) == 0), "no_tokens")
        .when(sizes.compare_sizes(x("size"), y("size")) == "conflict", "size_conflict")
        .when(brands, "brand_conflict")
        .when(text.variant_conflict(x("tokens"), y("tokens")), "variant_conflict")
        .when(score < threshold, "below_threshold")
    )
    return score, reason


def matched(pairs: DataFrame, a: str = "a", b: str = "b", threshold: float = MATCH_AT) -> DataFrame:
    """pairs(a struct, b struct, each signed and with upc) with method, score, same and reason: a valid code on both decides."""
    one, two = upc.normalize_upc(F.col(f"{a}.upc")), upc.normalize_upc(F.col(f"{b}.upc"))
    coded = one.isNotNull() & two.isNotNull()
    score, reason = compared(a, b, threshold)
    told = pairs.withColumns({
        "method": F.when(coded, "upc").otherwise("fuzzy"),
        "score": F.when(coded, F.when(one == two, 1.0).otherwise(0.0)).otherwise(score),
        "reason": F.when(coded, F.when(one != two, "upc_conflict")).otherwise(reason),
    })
    return told.withColumn("same", F.col("reason").isNull())


def fuzzy_key(tokens: str = "tokens", size: str = "size") -> Column:
    key = F.concat(F.lit("fuzzy:"), F.array_join(F.slice(tokens, 1, KEY_TOKENS), "-"))
    sized = sizes.size_key(F.col(size))
    return F.when(F.size(tokens) > 0, F.when(sized != "", F.concat(key, F.lit("@"), sized)).otherwise(key))


def standalone_confidence() -> Column:
    more = F.when(F.size("brand_tokens") > 0, 20).otherwise(0) + F.when(sizes.has_size(F.col("size")), 20).otherwise(0) + F.when(F.size("tokens") >= 3, 10).otherwise(0)
    return F.least(F.lit(90), 50 + more) / 100


def candidates(queries: DataFrame, products: DataFrame, most: int = CANDIDATES, tokens: int = QUERY_TOKENS, earlier: bool = False) -> DataFrame:
    """query_id, product_id, shared, rank: the products that share the most tokens with each query, ties to the smaller id; earlier: of those with a
    smaller id than the query's. A query asks with its first tokens in order. Product ids are distinct.

    A token's list is read in full only where it can matter. Queries with the same tokens ask once (not with earlier, where the answer is each one's
    own), products with the same tokens are one set. First the rarest tokens of an ask meet their whole lists, as long as these are short, and the others
    the `most` first sets of theirs. What shares one token is found by that: the sets before it in the list share one as well. If the last of the `most`
    best shares n, all that can still come before it share n, so one of the rarest size - n + 1 tokens; the n - 1 most common ones need no list."""
    asked = queries.select("query_id", F.slice("tokens", 1, tokens).alias("asked"))
    asks = asked.select(F.col("query_id").alias("ask_id"), "asked") if earlier else asked.groupBy("asked").agg(F.min("query_id").alias("ask_id"))
    # of one set no more than `most` can be found; the limit of a row number is applied before rows are shuffled
    nth = F.row_number().over(Window.partitionBy("tokens").orderBy("product_id"))
    few = products.select("product_id", "tokens").where(F.size("tokens") > 0).withColumn("nth", nth).where(F.col("nth") <= most)
    # a small table of sets makes many pairs, so its rows are spread whatever their bytes
    spread = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = staged(few.groupBy("tokens").agg(F.array_sort(F.collect_list("product_id")).alias("ids")).withColumn("set_id", F.col("ids")[0]).repartition(spread, "set_id"), "sets")
    lists = sets.select(F.explode("tokens").alias("token"), "set_id", "tokens")
    heads = lists.withColumn("nth", F.row_number().over(Window.partitionBy("token").orderBy("set_id"))).where(F.col("nth") <= most).drop("nth")
    by_rarity = Window.partitionBy("ask_id").orderBy("held", "token")
    terms = asks.select("ask_id", F.explode("asked").alias("token")).join(lists.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "token").withColumn("read", F.sum("held").over(by_rarity))
    sorted_terms = terms.groupBy("ask_id").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("t"), F.count_if(F.col("read") <= SHORT_LISTS * most).cast("int").alias("short"))
    asking = staged(sorted_terms.select("ask_id", F.col("t.token").alias("asked"), "short", F.lit(1).alias("floor")), "asks")

    def met(asking: DataFrame, asked_with: Column, postings: DataFrame) -> DataFrame:
        shared = F.array_intersect("asked", "tokens")
        pairs = asking.withColumn("token", F.explode(asked_with)).join(postings, "token")
        pairs = pairs.where(F.col("set_id") < F.col("ask_id")) if earlier else pairs
        return pairs.select("ask_id", "set_id", F.size(shared).alias("shared"), "floor", (shared[0] == F.col("token")).alias("rarest"))

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("ask_id", "set_id").agg(F.max("shared").alias("shared"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("shared"), "set_id"))).where(F.col("rank") <= most)

    size, columns = F.size("asked"), ["ask_id", "set_id", "shared"]
    short = met(asking, F.slice("asked", 1, F.col("short")), lists).where("rarest").select(columns)
    first = staged(best(short.union(met(asking, F.slice("asked", F.col("short") + 1, size), heads).select(columns))), "first")
    # a pair is listed at the rarest token that it shares, so none is listed twice
    floors = first.where(F.col("rank") == most).select("ask_id", F.col("shared").alias("floor"))
    bounded = asking.drop("floor").join(floors, "ask_id", "left").withColumn("floor", F.greatest(F.lit(2), F.coalesce("floor", F.lit(2))))
    rest = F.slice("asked", F.col("short") + 1, F.greatest(F.lit(0), size - F.col("floor") + 1 - F.col("short")))
    more = met(bounded, rest, lists).where("rarest").where(F.col("shared") >= F.col("floor")).select(columns)
    found = best(first.select(columns).union(more)).drop("rank").join(sets.select("set_id", F.explode("ids").alias("product_id")), "set_id")
    found = found.where(F.col("product_id") < F.col("ask_id")) if earlier else found
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("shared"), "product_id"))).where(F.col("rank") <= most)
    if not earlier:
        top = top.join(asks, "ask_id").join(asked, "asked")
    return top.select(F.col("ask_id" if earlier else "query_id").alias("query_id"), "product_id", "shared", "rank")


def best_match(queries: DataFrame, products: DataFrame, found: DataFrame, threshold: float = MATCH_AT) -> DataFrame:
    """query_id, product_id, score: of the candidates that are the same product, the best; ties to the smaller id."""
    own = lambda df, name: df.select(f"{name}_id", F.struct("tokens", "brand_tokens", "size").alias(name))
    # not by broadcast: what is small as Parquet can be large in the driver's memory
    pairs = found.select("query_id", "product_id").join(own(queries, "query").hint("merge"), "query_id").join(own(products, "product").hint("merge"), "product_id")
    score, reason = compared("query", "product", threshold)
    same = pairs.withColumn("score", score).where(reason.isNull())
    best = same.groupBy("query_id").agg(F.max_by(F.struct("product_id", "score"), F.struct("score", -F.col("product_id"))).alias("b"))
    return best.select("query_id", "b.product_id", "b.score")


def earlier_best(rows: DataFrame, most: int = CANDIDATES, tokens: int = QUERY_TOKENS, threshold: float = MATCH_AT) -> DataFrame:
    """query_id, product_id, score: best_match of rows(position, tokens, brand_tokens, size) with their candidates of smaller positions.

    Of the rows that share n tokens with a set of tokens only the `most` first can be candidates of any row with that set, whatever its position. So each
    set has one pool, `most` rows for each n, and rows that are alike are compared with it once; a row's candidates are the first `most` of its pool that
    come before it. Sets for which whole lists are longer than what their rows would read one by one are asked row by row."""
    kind = F.to_json(F.struct("tokens", "brand_tokens", "size")).alias("kind")
    keyed = rows.where(F.size("tokens") > 0).select("position", "tokens", "brand_tokens", "size", kind)
    kinds = staged(keyed.groupBy("kind").agg(*(F.first(c).alias(c) for c in ("tokens", "brand_tokens", "size")), F.count(F.lit(1)).alias("n"), F.max("position").alias("last")), "kinds")
    nth = F.row_number().over(Window.partitionBy("tokens").orderBy("position"))
    few = keyed.select("position", "tokens").withColumn("nth", nth).where(F.col("nth") <= most)
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = few.groupBy("tokens").agg(F.array_sort(F.collect_list("position")).alias("ids"))
    sets = ids.join(kinds.groupBy("tokens").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "tokens").withColumn("set_id", F.col("ids")[0])
    sets = staged(sets.repartition(spread, "set_id"), "sets")
    lists = sets.select(F.explode("tokens").alias("token"), "set_id", "tokens")
    asking = sets.select(F.col("set_id").alias("ask_id"), F.slice("tokens", 1, tokens).alias("asked"), "n", "last")
    terms = asking.select("ask_id", "n", F.explode("asked").alias("token")).join(lists.groupBy("token").agg(F.count(F.lit(1)).alias("held")), "token")
    listed = terms.groupBy("ask_id").agg(F.sum("held").alias("held"), F.first("n").alias("n")).select("ask_id", (F.col("held") <= (SHORT_LISTS + tokens) * most * F.col("n")).alias("pooled"))
    asked = staged(asking.join(listed, "ask_id").repartition(spread, "ask_id"), "asked")

    shared = F.array_intersect("asked", "tokens")
    met = asked.where("pooled").withColumn("token", F.explode("asked")).join(lists, "token").where((shared[0] == F.col("token")) & (F.col("set_id") < F.col("last")))
    first = lambda by: F.row_number().over(Window.partitionBy("ask_id", "shared").orderBy(by))
    near = met.select("ask_id", "set_id", F.size(shared).alias("shared")).withColumn("nth", first("set_id")).where(F.col("nth") <= most).drop("nth")
    pool = near.join(sets.select("set_id", F.explode("ids").alias("product_id")), "set_id").select("ask_id", "shared", "product_id").withColumn("nth", first("product_id")).where(F.col("nth") <= most)
    pool = staged(pool.drop("nth").join(own_struct(keyed, "product").withColumnRenamed("position", "product_id").hint("merge"), "product_id").repartition(spread, "ask_id"), "pool")
    kind_of = kinds.select("kind", F.struct("tokens", "brand_tokens", "size").alias("query"), "tokens").join(sets.select("tokens", F.col("set_id").alias("ask_id")).hint("merge"), "tokens").drop("tokens")
    score, reason = compared("query", "product", threshold)
    told = pool.hint("merge").join(kind_of, "ask_id").select("kind", F.struct((-F.col("shared")).alias("less"), F.col("product_id").alias("id"), F.when(reason.isNull(), score).alias("score")).alias("c"))
    pools = staged(told.groupBy("kind").agg(F.array_sort(F.collect_list("c")).alias("pool")), "pools")
    seen = F.slice(F.filter("pool", lambda c: c["id"] < F.col("position")), 1, most)
    best = F.array_max(F.transform(F.filter(seen, lambda c: c["score"].isNotNull()), lambda c: F.struct(c["score"].alias("score"), (-c["id"]).alias("id"))))
    found = keyed.select("position", "kind").join(pools.hint("merge"), "kind").select(F.col("position").alias("query_id"), best.alias("b")).where("b is not null")
    found = found.select("query_id", (-F.col("b.id")).alias("product_id"), "b.score")

    alone = asked.where("not pooled").select(F.col("ask_id").alias("set_id"))
    if alone.isEmpty():
        return found
    asks = staged(keyed.drop("kind").join(sets.select("tokens", "set_id").join(alone, "set_id"), "tokens", "left_semi").withColumnRenamed("position", "query_id"), "asks")
    there = keyed.drop("kind").withColumnRenamed("position", "product_id")
    return found.union(best_match(asks, there, candidates(asks, there, most, tokens, earlier=True), threshold))


def own_struct(df: DataFrame, name: str) -> DataFrame:
    return df.select("position", F.struct("tokens", "brand_tokens", "size").alias(name))


def canonical(products: DataFrame, best: DataFrame | None = None, known_id: str = "canonical_id") -> DataFrame:
    """products (signed, with upc) with canonical_id, method and confidence: a code, else the best known product, else an own key."""
    code = upc.normalize_upc(F.col("upc"))
    rows = products.join(best, "query_id", "left") if best is not None else products.withColumn("_known", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    known = F.col(known_id) if best is not None else F.col("_known")
    fresh = fuzzy_key()
    out = rows.withColumns({
        "_id": F.when(code.isNotNull(), F.concat(F.lit("gtin:"), code)).when(fresh.isNull(), F.lit(None)).otherwise(F.coalesce(known, fresh)),
        "method": F.when(code.isNotNull(), "upc").when(fresh.isNull(), "none").otherwise("fuzzy"),
        "confidence": F.when(code.isNotNull(), 1.0).when(fresh.isNull(), 0.0).otherwise(F.coalesce(F.col("score"), standalone_confidence())),
    })
    return out.drop(known_id, "_known", "score").withColumnRenamed("_id", "canonical_id")


def recorded(seen: DataFrame) -> DataFrame:
    """Sightings folded to products: the first sighting gives the fields, the last its time."""
    rest = [c for c in seen.columns if c not in ("canonical_id", "seen_at")]
    out = seen.groupBy("canonical_id").agg(F.min_by(F.struct(*rest), F.struct("seen_at", *rest[:1])).alias("f"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
    return out.select("canonical_id", *(F.col("f")[c].alias(c) for c in rest), "first_seen_at", "last_seen_at")


def linked(keys: DataFrame, links: DataFrame, products: DataFrame) -> DataFrame:
    """Products of SKU keys that are linked."""
    return links.join(keys.select("sku_key").distinct(), "sku_key", "left_semi").join(products, "canonical_id")


def roots(pointers: DataFrame) -> DataFrame:
    """node, up for pointers(node, up), each up followed to its end; pointers go to smaller ids, so there is one.

    Each round doubles the way that every pointer has gone; rounds are few and each is written to the shared folder."""
    now = staged(pointers, "pointers")
    while True:
        on = now.join(now.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "left")
        after = staged(on.select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "pointers")
        if after.where("moved").isEmpty():
            return now
        now = after.drop("moved")


def resolve_batch(batch: DataFrame, links: DataFrame, products: DataFrame | None) -> DataFrame:
    """Ids for the SKUs of a batch in ingest order (position): linked ones keep theirs, a new one may take the id of the best
    matching earlier new one (ties to the earliest), and so on back to the first."""
    first = batch.groupBy("sku_key").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "sku_key"]), "position").alias("r")).select("sku_key", "r.*")
    told = first.join(links, "sku_key").select("sku_key", "canonical_id", F.lit("linked").alias("method"))
    fresh = signed_once(first.join(links.select("sku_key"), "sku_key", "left_anti")).withColumn("query_id", F.col("position"))
    if products is not None:
        known = signed(products.withColumn("product_id", F.xxhash64("canonical_id")))
        best = best_match(fresh, known, candidates(fresh, known)).join(known.select("product_id", F.col("canonical_id").alias("known_id")), "product_id").drop("product_id")
        rows = canonical(fresh, best, "known_id")
    else:
        rows = canonical(fresh)
    rows = staged(rows.select("sku_key", "position", "canonical_id", "method", "tokens", "brand_tokens", "size"), "fresh")
    fuzzy = rows.where("method = 'fuzzy'")
    best = earlier_best(fuzzy)
    ends = roots(best.select(F.col("query_id").alias("node"), F.col("product_id").alias("up")))
    ids = rows.select(F.col("position").alias("up"), F.col("canonical_id").alias("first_id"))
    new = rows.join(ends.join(ids, "up"), F.col("position") == F.col("node"), "left").select("sku_key", F.coalesce("first_id", "canonical_id").alias("canonical_id"), "method")
    return told.unionByName(new)
