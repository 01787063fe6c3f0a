"""Best matches: texts read once, joins that hold no table of products in the driver, pools of rows that are alike."""

import random

import pytest

from tierscope.operators import products

SIGNED = "position long, tokens array<string>, brand_tokens array<string>, size struct<ml:double,g:double,ct:double>"


def test_texts_are_signed_once_and_give_the_same(spark):
    texts = [("Oat Milk 12 oz", "Brand A", None), ("Oat Milk 12 oz", "Brand A", ""), (None, None, "2 lb"), ("Oat Milk 12 oz", "Brand A", None), ("", None, None), (None, "", None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "position long, title string, brand string, size_text string")
    once = products.signed_once(df)
    want = products.signed(df)
    assert sorted(map(str, once.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_products_are_not_broadcast_to_be_compared(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["a", f"w{i % 3}"], [], None) for i in range(20)], SIGNED)
    rows.write.parquet(f"{tmp_path}/rows")
    there = spark.read.parquet(f"{tmp_path}/rows")
    q, p = there.withColumnRenamed("position", "query_id"), there.withColumnRenamed("position", "product_id")
    best = products.best_match(q, p, q.select("query_id").join(p.select("product_id")))
    best.collect()
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed,short", [(0, 1), (1, -4), (2, 100)])
def test_earlier_rows_by_pools_and_one_by_one(spark, monkeypatch, seed, short):
    """One token in a third of all, copies, rows of no tokens; all sets by pools, none, or some."""
    monkeypatch.setattr(products, "SHORT_LISTS", short)
    rng = random.Random(seed)
    words = ["hot"] * 12 + ["warm", "mild"] * 5 + [f"w{i}" for i in range(30)]
    own = lambda: ["hot", "mild", "warm"] if rng.random() < 0.33 else sorted({rng.choice(words) for _ in range(rng.randrange(1, 7))})
    rows = [(i, own(), rng.choice([[], ["hot"], ["w1"]]), rng.choice([None, (None, rng.choice([28.0, 60.0]), None)])) for i in range(400)] + [(400, [], [], None)]
    df = spark.createDataFrame(rows, SIGNED)
    q, p = df.withColumnRenamed("position", "query_id"), df.withColumnRenamed("position", "product_id")
    want = products.best_match(q, p, products.candidates(q, p, 7, 4, earlier=True), 0.5).collect()
    asked, whole = [], products.candidates
    monkeypatch.setattr(products, "candidates", lambda asks, *a, **k: asked.append(asks.count()) or whole(asks, *a, **k))
    assert want and sorted(map(tuple, products.earlier_best(df, 7, 4, 0.5).collect())) == sorted(map(tuple, want))
    assert {1: 0 < sum(asked) < 400, -4: sum(asked) == 400, 100: not asked}[short]


def test_copies_in_a_batch_are_not_asked_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(products, "candidates", None)
    rows = [(f"s{i}", i, f"oat milk {i % 5}", "Brand", None, None) for i in range(300)]
    batch = spark.createDataFrame(rows, "sku_key string, position long, title string, brand string, size_text string, upc string")
    got = {r.sku_key: r.canonical_id for r in products.resolve_batch(batch, spark.createDataFrame([], "sku_key string, canonical_id string"), None).collect()}
    assert len(got) == 300 and all(got[f"s{i}"] == got[f"s{i % 5}"] for i in range(300))
