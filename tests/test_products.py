"""Candidates against counting all pairs; products recorded whole or not at all."""

import datetime as dt
import random

import pytest

from tierscope.operators import products
from tierscope.sources import registry


def all_pairs(queries, sets, most, earlier):
    out = []
    for q, asked in queries:
        asked = set(asked[:4])
        found = sorted((-len(asked & set(t)), p) for p, t in sets if asked & set(t) and (not earlier or p < q))
        out += [(q, p, -n, i + 1) for i, (n, p) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("seed,earlier", [(0, False), (1, True), (2, False)])
def test_candidates_with_hot_tokens_and_copies(spark, monkeypatch, seed, earlier):
    """One token in a third of all, a few common ones, rare ones, a third of the products with the same tokens; asks of one hot token, of unknown and of no tokens."""
    monkeypatch.setattr(products, "SHORT_LISTS", 1)
    rng = random.Random(seed)
    words = ["hot"] * 12 + ["warm", "mild"] * 5 + [f"w{i}" for i in range(30)]
    own = lambda: sorted({rng.choice(words) for _ in range(rng.randrange(1, 7))})
    sets = [(i, ["hot", "mild", "warm"] if rng.random() < 0.33 else own()) for i in range(400)] + [(400, [])]
    queries = sets if earlier else [(1000 + i, own()) for i in range(60)] + [(2000, ["hot"]), (2001, ["hot"]), (2002, ["none"]), (2003, []), (2004, ["hot", "none"])]
    table = lambda rows, name: spark.createDataFrame(rows, f"{name} long, tokens array<string>")
    got = products.candidates(table(queries, "query_id"), table(sets, "product_id"), most=7, tokens=4, earlier=earlier)
    assert sorted(map(tuple, got.collect())) == all_pairs(queries, sets, 7, earlier)


def test_candidates_of_no_products(spark):
    empty = spark.createDataFrame([], "product_id long, tokens array<string>")
    assert products.candidates(spark.createDataFrame([(1, ["a"])], "query_id long, tokens array<string>"), empty).isEmpty()


SEEN = "position long, canonical_id string, method string, confidence double, title string, brand string, size_text string, upc string, seen_at timestamp_ntz, sku_key string, retailer string, retailer_sku string, tokens array<string>"


def sighting(position, product, day, sku, *tokens):
    return (position, product, "fuzzy", 0.9, f"title {position}", None, None, None, dt.datetime(2026, 9, day), sku, "target", sku, list(tokens))


def shown(spark, path):
    t = {k: v.collect() for k, v in registry.tables(spark, path).items()}
    return {r.canonical_id: (r.title, r.first_seen_at.day, r.last_seen_at.day) for r in t["products"]}, {r.sku_key: r.canonical_id for r in t["links"]}, sorted(map(tuple, t["tokens"]))


def test_the_first_record_stays_and_times_move_on(spark, tmp_path):
    path = str(tmp_path)
    assert shown(spark, path) == ({}, {}, [])
    batches = [
        [sighting(2, "p", 5, "s1", "oat"), sighting(1, "p", 3, "s1", "milk", "oat"), sighting(3, "q", 4, "s2")],
        [sighting(0, "p", 9, "s3", "milk"), sighting(1, "q", 1, "s1", "tea"), sighting(2, None, 2, "s4", "x"), sighting(3, "r", 2, None)],
        [],
    ]
    for k, b in enumerate(batches):
        assert registry.record(spark, path, spark.createDataFrame(b, SEEN)) == k + 1
    want = ({"p": ("title 1", 3, 9), "q": ("title 3", 4, 4), "r": ("title 3", 2, 2)}, {"s1": "p", "s2": "q", "s3": "p"}, [("milk", "p"), ("oat", "p"), ("tea", "q")])
    assert shown(spark, path) == want
    registry.record(spark, path, spark.createDataFrame(batches[0], SEEN))  # again
    assert shown(spark, path) == want
    registry.record(spark, path, spark.createDataFrame(batches[1], SEEN), most=2)  # folded into one folder
    assert shown(spark, path) == want and len(registry._head(spark, path)[1]) == 1


@pytest.mark.parametrize("step", ["products", "links", "tokens", "commit"])
def test_a_failure_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    registry.record(spark, path, spark.createDataFrame([sighting(1, "p", 3, "s1", "milk")], SEEN))
    before, new = shown(spark, path), spark.createDataFrame([sighting(1, "p", 8, "s2", "oat"), sighting(2, "q", 8, "s3", "tea")], SEEN)
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(registry, "_commit", lambda *_: (_ for _ in ()).throw(OSError()))
        else:
            whole = registry.TABLES
            m.setattr(registry, "TABLES", {k: v if k != step else "no_such_column long" for k, v in whole.items()})
        with pytest.raises(Exception):  # noqa: B017
            registry.record(spark, path, new)
    assert shown(spark, path) == before
    registry.record(spark, path, new)
    assert shown(spark, path) == ({"p": ("title 1", 3, 8), "q": ("title 2", 8, 8)}, {"s1": "p", "s2": "p", "s3": "q"}, [("milk", "p"), ("oat", "p"), ("tea", "q")])
