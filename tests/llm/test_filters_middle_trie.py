"""URL filters, fill-in-the-middle and the prefix trie against brute force, with nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tierscope.llm import fill_in_middle, prefix_trie, queries, url_filters

CLASH = ["row", "key", "part", "rule", "host", "verdict", "depth", "n", "form", "k1", "run", "output"]


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def many_ranges(spark):
    """Enough ranges, left as they are, for a sweep to be taken over from one to the next."""
    keys = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def judged(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_filters(many_ranges):
    spark, rng = many_ranges, random.Random(5)
    names = ["a", "b", "org", "com", "", "ab", "é", "org\u0001"]
    hosts = [".".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b/c", "/\U0010ffff", "/\x01", "//"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in rng.sample(hosts, 20) + ["org", "com"] for p in rng.sample(paths, 4)}.values())
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts).upper() if i % 9 == 0 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?x=1/', '#top', '?://'])}" for i in range(1500)]
    urls += [None, "", "org/a", "://", "http://", "x://org", "x://org://a", "http://user@a.org:80/a", "http://" + "a." * 3000 + "org/a"] + ["http://a.b.org/a/b/c"] * 700
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for default in ("allow", "block"):
        got = sorted(tuple(r) for r in url_filters.judge(with_clashes(pages), table, default).collect())
        assert got == [(i, *judged(u, rules, default)) for i, u in enumerate(urls)]


def test_url_filters_defined_cases(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("ORG", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://x.org/"), (1, "http://example.org/es/a"), (1, "http://example.org/es/a"), (2, "http://com/frx"), (3, None)], "page_id long, url string")
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect())
    assert got == [("1", "example.org/es/", "block"), ("1", "example.org/es/", "block"), ("2", None, "allow"), ("3", None, "allow"), ("None", "org/", "block")]
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_url_filters_run_without_python(spark, data):
    plan = queries.op11_url_filters(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(lines[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(2)
    pieces = ["\n", "\n\n", "a", "é", "\U0001f600", "<", "<P", "S>", "\r", "\u2028", " word", "\x00", "<M"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "\n", "x", "<P>", "a<S>b", "<M>\n", "x\n" * 30_000, "\n" * 70_000, "long " * 50_000]
    rows = [*enumerate(texts), (None, "a\nb\nc\n"), (5, "again\n"), (5, "again\n")]
    made = fill_in_middle.transform(with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3), rate=rate, spm=spm)
    got = made.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1:])[:300])
    want = sorted(((i, *middle(i, t, rate=rate, spm=spm), t or "") for i, t in rows), key=order)
    assert sorted((tuple(r) for r in got), key=order) == want
    if rate == 100:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parts(spark):
    rng = random.Random(3)
    for _ in range(300):
        bits = rng.getrandbits(rng.randint(1, 400)) | 1
        places = [i for i in range(bits.bit_length()) if bits >> i & 1]
        assert [fill_in_middle.select(bits, k) for k in range(len(places))] == places
        data = bytes(rng.choice(b"ab<P>") for _ in range(60))
        assert fill_in_middle.occurrences(data, b"<P>") == sum(1 << i for i in range(60) if data[i : i + 3] == b"<P>")
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError, match="overlap"):
            fill_in_middle.check_sentinels(bad)


def trie_of(rows, block=100, heads=6):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        path[c] = tuple(own.get(c - c % block, [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in sorted(path.items()):
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in nodes if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1] if n else "")
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in nodes[n] if len(path[c]) == len(n)).encode()).hexdigest()
    return sorted((m[0], len(n), nodes[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n], ends(n)) for n, m in nodes.items())


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), *range(205, 260), 300, 999, 1400, 1401, 1402]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é\U0001f600"])))
    rows += [(400, t, "user", f"t{t % 7}") for t in range(700)] + [(450, t, "user", f"t{t % 7}") for t in range(650)]
    rows += [(c, t, "user", "same") for c in range(2000, 2190) for t in range(7)]
    rows += [(None, 1, "user", "x"), (2, 0, "user", "again"), (2, 0, "user", "again")]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(many_ranges):
    rows = conversations()
    df = many_ranges.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in prefix_trie.trie(with_clashes(df), fan_in=2).collect())
    assert got == trie_of(rows)


def test_prefix_trie_pieces_of_lists(many_ranges):
    """Lists longer than their bound stay in pieces, in order, and hash as one."""
    rng = random.Random(4)
    ends = [(c, c // 40, rng.choice([1, 1, 1, 2, 3])) for c in range(600)]
    paths = many_ranges.createDataFrame([(c, run, 7, k, True) for c, run, k in ends], "conv_id long, run int, k1 long, k2 long, last boolean")
    pieces = prefix_trie.merged_ends(paths, 15, fan_in=3, longest=90)
    sizes = collections.Counter(r.k2 for r in pieces.collect())
    assert sizes[1] > 1
    want = {k: hashlib.sha256(",".join(str(c) for c, _, x in ends if x == k).encode()).hexdigest() for k in (1, 2, 3)}
    assert {r.k2: r.ends_sha256 for r in prefix_trie.hashed_ends(pieces).collect()} == want


def test_prefix_trie_defined_cases(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], kind)).count() == 0
    for rows in ([(150, 0, "user", "x")], [(c, 0, "user", "x") for c in (1, 2, 3, 4, 5, 101, 106)]):
        assert sorted(tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, kind)).collect()) == trie_of(rows)
