"""A trie of the common beginnings of conversations: partial tries that partitions emit, merged as a tree, then rolled up.

A node is the sequence of a conversation's first d turns. Its key is 128 bits: the exclusive-or, over those turns, of two hashes of (depth,
role, text). So the key of a parent is the node's key without its last turn, keys of beginnings that two conversations share need no texts, and a long
conversation is keyed in pieces: turns lie in ranges of (conversation, turn), and a range takes over count and key from those before it.

Every range emits its own trie: one row for each of its nodes, with members, the smallest of them, and the sorted list of those that end there. These node
tables meet key by key in rounds of `fan_in` neighbours; members are summed and lists, which follow each other in order, are put together. A list of more
than LIST members stays in pieces, and its hash is taken over them one after the other. A node that all share has one row in each range.

Sums over subtrees go bottom-up in strides that double: after a round every node holds the sum of the levels within twice the distance and points twice as far up,
so a conversation of n turns takes log2(n) rounds.

Defined cases: rows with a null conv_id are left out; null roles and texts are empty; turns stand in order of turn (null first), then role, then text, and
repeated rows are turns of their own; a conversation without turns ends at the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_ranges, small_batches, stage

LIST = 8192
KEY = ["k1", "k2"]
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, run, depth, k1, k2, x1, x2, n_chars, last: the nodes on the path of every conversation, its root included.

    Conversation c has the first h turns of conversation c - c % block, then its own after its first h; h: the CRC-32 of c's digits, modulo heads.
    x1, x2: what the last turn of a node adds to its parent's key; run: growing with conv_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.substring(text, 1, 16).alias("begin"))
    dealt = in_ranges(turns, "turns", "conv_id", "turn", "role", "begin")

    pieces = stage(dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "pieces")
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("part").alias("run")).withColumns({"base": F.expr(f"conv_id - conv_id % {block}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads})
    lengths = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stage(convs.select("conv_id", "run", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "convs")

    by_piece = Window.partitionBy("conv_id").orderBy("part")
    begun = pieces.withColumn("before", F.coalesce(F.sum("n").over(by_piece.rowsBetween(*BEFORE)), F.lit(0))).drop("n").join(convs, "conv_id")
    in_order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    placed = dealt.join(begun, ["conv_id", "part"]).withColumn("at", F.col("before") + F.row_number().over(in_order))
    placed = placed.withColumn("depth", F.when(F.col("conv_id") == F.col("base"), F.col("at")).when(F.col("at") > F.col("h"), F.col("at") - F.col("h") + F.col("k")))
    hashed = {"x1": F.xxhash64("depth", "role", "text"), "x2": F.xxhash64("text", "role", "depth")}
    keyed = placed.withColumns({c: F.when(F.col("depth").isNotNull(), x).otherwise(F.lit(0)) for c, x in hashed.items()})
    keyed = keyed.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(in_order.rowsBetween(*SO_FAR)) for i in (1, 2)})
    keyed = stage(keyed.select("conv_id", "part", "base", "depth", "x1", "x2", "k1", "k2", F.length("text").alias("n_chars")), "keyed")

    sums = keyed.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    taken = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"s{i}").over(by_piece.rowsBetween(*BEFORE)), F.lit(0)).alias(f"s{i}") for i in (1, 2)))

    def with_taken(rows: DataFrame, over: DataFrame) -> DataFrame:
        return rows.join(over, ["conv_id", "part"]).withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)}).drop("s1", "s2")

    short = keyed.where(f"conv_id = base and depth < {heads}")
    first = stage(with_taken(short, taken).select("base", "depth", *KEY, "x1", "x2", "n_chars"), "first_turns")
    others = convs.where("conv_id <> base")
    ends = others.join(first.select("base", F.col("depth").alias("k"), *KEY), ["base", "k"]).select("conv_id", "k1", "k2")
    over = taken.join(ends, "conv_id", "left").select("conv_id", "part", *(F.col(f"s{i}").bitwiseXOR(F.coalesce(f"k{i}", F.lit(0))).alias(f"s{i}") for i in (1, 2))).join(convs.select("conv_id", "run", "n_turns"), "conv_id")

    own = with_taken(keyed.where("depth is not null").drop("base"), over)
    shared = others.join(first, "base").where("depth <= k")
    root = convs.withColumns({"depth": F.lit(0), **{c: F.lit(0) for c in (*KEY, "x1", "x2", "n_chars")}})
    columns = ["conv_id", "run", *(F.col(c).cast("long") for c in ("depth", *KEY, "x1", "x2", "n_chars")), (F.col("depth") == F.col("n_turns")).alias("last")]
    return own.select(columns).union(shared.select(columns)).union(root.select(columns))


def merged_nodes(paths: DataFrame, runs: int, fan_in: int = 8) -> DataFrame:
    """k1, k2, depth, x1, x2, n_chars, n_convs, conv_id of every node, from the node tables of the runs."""
    same = ["depth", "x1", "x2", "n_chars"]
    nodes = paths.groupBy("run", *KEY, *same).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    while runs > 1:
        runs = -(-runs // fan_in)
        nodes = nodes.groupBy(F.expr(f"run div {fan_in}").alias("run"), *KEY, *same).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return nodes.drop("run")


def merged_ends(paths: DataFrame, runs: int, fan_in: int = 8, longest: int = LIST) -> DataFrame:
    """k1, k2, ids: the sorted ids of a node's ended members, in one row, or in several in order of their first where there are more than longest."""
    lists = paths.where("last").groupBy("run", *KEY).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    while runs > 1:
        runs = -(-runs // fan_in)
        lists = lists.withColumn("run", F.expr(f"run div {fan_in}"))
        size = F.sum(F.size("ids")).over(Window.partitionBy("run", *KEY))
        # where the group is too long all its rows stay apart, so a row never spans another
        lists = lists.withColumn("apart", F.when(size > longest, F.col("ids")[0]))
        lists = lists.groupBy("run", *KEY, "apart").agg(F.flatten(F.array_sort(F.collect_list("ids"))).alias("ids")).drop("apart")
    return lists.select(*KEY, "ids")


def hashed_ends(lists: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of lists(k1, k2, ids): a node's rows are hashed one after the other."""
    small_batches(lists.sparkSession)

    def run(batches):
        key, state = None, None
        for b in batches:
            done: list[tuple] = []
            ids = b.column("ids")
            for i, now in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ids[i].as_py())).encode())
            yield pa.record_batch([pa.array([r[j] for r in done], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])

    ordered = lists.repartition(*KEY).sortWithinPartitions(*KEY, F.col("ids")[0])
    return ordered.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def rolled_up(up: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """k1, k2 and the values of up(k1, k2, a1, a2, values), summed over each node's subtree; a1, a2: the key of the parent, null for the root."""
    stride = 1
    while stride <= deepest:
        below = up.where("a1 is not null")
        sums = below.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        further = below.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        hops = below.join(further, ["a1", "a2"], "left").select(*KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), *values)
        none = up.where("a1 is null").select(*KEY, "a1", "a2", *values)
        summed = hops.union(none).join(sums, KEY, "left")
        up = stage(summed.select(*KEY, "a1", "a2", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values)), "rollup")
        stride *= 2
    return up.select(*KEY, *values)


def trie(conversations: DataFrame, block: int = 100, heads: int = 6, fan_in: int = 8) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stage(rebuilt(conversations, block, heads), "paths")
    runs = (paths.agg(F.max("run")).first()[0] or 0) + 1
    parent = [F.when(F.col("depth") > 0, F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}"))).alias(f"a{i}") for i in (1, 2)]
    nodes = stage(merged_nodes(paths, runs, fan_in).select(*KEY, *parent, "depth", "n_chars", "n_convs", "conv_id"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, ["a1", "a2"], "left")
    told = told.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    told = stage(told, "told")
    sums = rolled_up(told.select(*KEY, "a1", "a2", "n_leaves", "saved_tokens"), told.agg(F.max("depth")).first()[0] or 0, ["n_leaves", "saved_tokens"])
    ends = hashed_ends(merged_ends(paths, runs, fan_in))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = told.drop("n_leaves", "saved_tokens").join(sums, KEY).join(ends, KEY, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
