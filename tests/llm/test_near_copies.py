"""Near copies: what is held against what, and that texts of one template are not all paired."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierscope.llm import near_copies
from tierscope.llm.components import components


def text(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]


def numbers(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    shared = near_copies.shared_shingles(rows)
    first = near_copies.in_order(shared.select(F.explode(F.array("first", "before")).alias("a"), F.col("node").alias("b")))
    links = near_copies.verified(first, rows)
    rest = near_copies.other_pairs(shared, components(links))
    return first.count(), rest.count(), near_copies.near_links(rows).count()


@pytest.mark.parametrize("own", [11, 16])
def test_texts_of_one_template_are_not_all_paired(spark, own):
    rng = random.Random(3)
    template = text(rng, 86)
    got = [numbers(spark, [" ".join(template[:43] + text(rng, own) + template[43:]) for _ in range(n)]) for n in (60, 240)]
    assert all(first <= 2 * n and rest <= 2 * n and linked == 0 for n, (first, rest, linked) in zip((60, 240), got, strict=True))


def test_two_prefixes_meet_for_every_similar_pair():
    """Of sets in one order of size, the short prefix of the smaller and the long one of the larger share an element."""
    rng = random.Random(1)
    counts = np.zeros(near_copies.SLOTS, np.int64)
    near = 0
    for _ in range(400):
        n = rng.randint(1, 40)
        a = set(rng.sample(range(60), n))
        b = {x for x in a if rng.random() > 0.08} | set(rng.sample(range(60, 80), rng.randint(0, 3)))
        if not b or 5 * len(a & b) < 4 * len(a | b):
            continue
        near += 1
        small, large = sorted((np.array(sorted(x), np.uint64) << np.uint64(50) for x in (a, b)), key=len)
        few = near_copies.prefix(small, counts)[: near_copies.short(np.array([len(small)]))[0]]
        assert set(few.tolist()) & set(near_copies.prefix(large, counts).tolist())
    assert near > 100


def test_unequal_texts_with_one_key_both_stay(spark, monkeypatch):
    """Texts that only a hash takes for one are not judged by each other."""
    rng = random.Random(2)
    base = text(rng, 40)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(text(rng, 40)))]
    one = F.xxhash64
    keys = {rows[0][1]: 7, rows[1][1]: 8, rows[2][1]: 8}
    clashing = lambda *c: F.coalesce(*(F.when(F.coalesce(F.col("text"), F.lit("")) == t, F.lit(k).cast("long")) for t, k in keys.items())) if len(c) == 1 else one(*c)
    monkeypatch.setattr(near_copies.F, "xxhash64", clashing)
    got = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2, 3}


def test_buckets_over_batches(spark):
    """Groups of copies and unlike texts give the links of brute force, whatever the batches."""
    rng = random.Random(9)
    bases = [text(rng, n) for n in (6, 30, 80)]
    texts = []
    for b in bases:
        for _ in range(30):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = text(rng, 1)[0]
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    want = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and want[i] != want[j]:
            old, new = max(want[i], want[j]), min(want[i], want[j])
            want = [new if c == old else c for c in want]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for batch in ("1000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.node: r.component for r in near_copies.near_links(rows).collect()}
        assert [got.get(i, i) for i in range(len(texts))] == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def test_stage_takes_simhash(spark, monkeypatch):
    """The pipeline's stage goes by fingerprints, and never by the prefix join that they are measured against."""
    import corpus_pipeline

    def other(*_):
        raise AssertionError("not SimHash")

    for name in ("exact_near_links", "shared_shingles", "other_pairs"):
        monkeypatch.setattr(near_copies, name, other)
    base = text(random.Random(4), 50)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, " ".join(text(random.Random(5), 50)))]
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()) == [1, 3]


def test_fingerprint_is_a_majority_of_bits():
    rng, odd = np.random.default_rng(3), near_copies.odd_numbers()
    for n in (1, 2, 7, 254, 255, 256, 700):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        each = np.stack([near_copies.fingerprint(s[i : i + 1], odd) for i in range(len(s))])
        ones = np.unpackbits(each.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        assert (np.unpackbits(near_copies.fingerprint(s, odd).view(np.uint8), bitorder="little") == (2 * ones > n)).all()


def test_recall_of_bands_at_the_least_similarity():
    """Sets of a similarity of just 0.8 agree in a band and stay within both radii in at least 97 of 100 cases."""
    rng, odd, found = np.random.default_rng(6), near_copies.odd_numbers(), 0
    for _ in range(400):
        s = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        x, y = (near_copies.fingerprint(np.unique(z), odd) for z in (s[:180], np.r_[s[:160], s[180:]]))
        bits = near_copies.apart(x[:, None], y[:, None])[0]
        head = near_copies.apart(x[: near_copies.HEAD, None], y[: near_copies.HEAD, None])[0]
        found += bool((x.view(np.uint16) == y.view(np.uint16)).any() and head <= near_copies.RADIUS and bits <= near_copies.NEAR)
    assert found >= 388


def test_links_of_one_bucket_grow_with_its_rows():
    """A bucket in which all are linked sends a forest, and one in which few are sends these."""
    rng = np.random.default_rng(7)
    f = rng.integers(0, 1 << 63, (near_copies.HEAD, 1), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (near_copies.HEAD, 1500), dtype=np.uint64))
    f = np.concatenate([f, rng.integers(0, 1 << 63, (near_copies.HEAD, 100), dtype=np.uint64)], axis=1)
    a, b = near_copies.bucket_links(np.zeros(1600, np.int32), np.arange(1600), f)
    assert len(a) == 1499 and set(a.tolist()) | set(b.tolist()) == set(range(1500))


def test_stars_are_a_forest_of_the_same_components():
    rng = np.random.default_rng(11)
    for n, m in ((1, 1), (30, 12), (200, 120), (200, 900)):
        a, b = rng.integers(0, n, (2, m))
        a, b = np.r_[a, np.arange(1000, 1060)], np.r_[b, np.arange(1001, 1061)]  # and a long chain
        label = {x: x for x in (*a.tolist(), *b.tolist())}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            old, new = max(label[x], label[y]), min(label[x], label[y])
            label = {k: new if v == old else v for k, v in label.items()}
        x, y = near_copies.stars(a, b)
        assert sorted(zip(y.tolist(), x.tolist(), strict=True)) == sorted((k, v) for k, v in label.items() if k != v)
    assert [len(x) for x in near_copies.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("n", [300, 900])
def test_a_group_sends_few_links_for_each_text(spark, n):
    """Texts of one group meet in buckets of all bands, and links grow with the texts: 46 to 50 a text when each band sent its own."""
    rng, base, texts = random.Random(12), text(random.Random(13), 100), []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(100), rng.randint(1, 2)):
            w[at] = text(rng, 1)[0]
        texts.append(" ".join(w))
    links = near_copies.in_order(near_copies.simhash_links(spark.createDataFrame(list(enumerate(texts)), "node long, text string"))).collect()
    assert len(links) <= 12 * n
    a, b = np.array(links).T
    assert len(near_copies.stars(a, b)[0]) == n - 1


@pytest.mark.parametrize("part", [1024, 20])
def test_variants_of_one_text_make_no_pairs_by_their_square(spark, monkeypatch, part):
    """Many texts of one kind, near and not near enough: each unit sends a forest, and the components are those of brute force."""
    monkeypatch.setattr(near_copies, "CLASS", part)
    rng, n, texts = random.Random(8), 120, []
    base = text(rng, 100)
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(100), rng.randint(1, 5)):
            w[at] = text(rng, 1)[0]
        texts.append(" ".join(w))
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    classes = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
    links = [tuple(r) for r in near_copies.decided(classes, rows).collect()]
    parts = -(-n // part)
    assert len(links) < n if parts == 1 else len(links) < n * (parts + 1)
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    assert all(similar(sets[i], sets[j]) for i, j in links)

    def grouped(pairs):
        label = list(range(n))
        for i, j in pairs:
            if label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if c == old else c for c in label]
        return label

    want = grouped((i, j) for i, j in itertools.combinations(range(n), 2) if similar(sets[i], sets[j]))
    assert grouped(links) == want and 3 < len(set(want)) < n
