"""Distributed union-find, and linking of items that share a bucket, in DataFrame operations.

No step collects links or members, emits all pairs of a bucket, or needs the rows of a
bucket in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import forget, shuffles_done, together, written

#: Members of a bucket that one block holds; a larger bucket is compared block by block.
BLOCK = 256
#: Weight that the members of a block may add up to, about.
WEIGHT = 1 << 20
#: Rounds of comparison with heads, and heads that an item is compared with in each.
ROUNDS, TRIES = 2, 1
#: A round that finds at most this share of the links of the one before is the last.
LITTLE = 0.1
#: Rows up to which a table of a few numbers each, and one of a key each, is sent to all executors (at most about 40 MB).
BROADCAST_ROWS, BROADCAST_KEYS = 400_000, 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b): component is the least id that links reach.

    Alternates large stars (every neighbour above a node moves to the node's least
    neighbour) and small stars (the same among the lower neighbours) until only stars
    are left, which takes rounds in the logarithm of the longest chain. A hub's links
    meet its minimum in a join whose sides can both be split.
    """
    pairs = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node has few lower neighbours left: at most one for each link of its own
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        last, pairs = pairs, written(small.distinct(), "links")
        forget(last, lowest)
    tops = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)


def _stars(pairs: DataFrame) -> bool:
    """Whether every node has one lower neighbour, which has none itself."""
    several = pairs.groupBy("u").agg(F.count("v").alias("n")).filter("n > 1").select("u")
    chained = pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return several.unionByName(chained).isEmpty()


Pairs = Callable[[DataFrame], DataFrame]


def shared_buckets(members: DataFrame, passes: int = 1) -> DataFrame:
    """The rows of members(key, id), without repeats, of the buckets that hold several ids. Read twice a pass; written.

    A pass takes the keys of one remainder, so that disk holds the shuffles of one pass at a time.
    """
    parts = []
    for k in range(passes):
        own = members.filter(F.pmod("key", F.lit(passes)) == k) if passes > 1 else members
        spread = own.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
        keys = written(spread.select("key"), "shared-keys")
        shuffles_done(members.sparkSession)
        parts.append(written(own.join(sized(keys, BROADCAST_KEYS), "key", "left_semi").distinct(), "shared"))
        forget(keys)
        shuffles_done(members.sparkSession)
    return together(parts)


def link(members: DataFrame, confirm: Pairs, compare: Pairs, weights: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, component) of the items that confirmed links join; items without a link are not in it.

    members(key, id): rows of shared buckets. confirm(a, b) keeps the pairs that are links, and may get a pair twice.
    compare(key, i, j, id, slot, component) gets blocks of members and returns the links
    (a, b) with a in slot i, b in slot j and different components, or so many of them that
    all are joined. weights(id, weight) bounds blocks by the weight of their members, too.

    In a round, every bucket that still holds several components has one member as its
    head, and an item outside the head's component is compared with the TRIES heads with
    which it shares most buckets. What this joins needs no more comparison inside, so
    that a large group of copies is soon one component. When a round joins little, or
    after so many rounds, all pairs across components in the buckets left are compared, in
    blocks, so that no link is lost. Members of a bucket's largest component meet its
    other members only, so that the blocks grow with what is left outside of it.
    """
    held, known, found = members, None, 0
    for number in range(rounds + 1):
        left = _placed(held, known)
        order = F.col("id") if number == 0 else F.xxhash64("id", F.lit(number))
        heads = left.groupBy("key").agg(
            F.min(F.struct(order.alias("o"), F.col("id").alias("head"), F.col("component").alias("c"))).alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")
        )
        # buckets of one component are done
        heads = written(heads.filter("lo < hi").select("key", "h.head", "h.c"), "heads")
        if heads.isEmpty():
            return components(members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)) if known is None else known
        last, held = held, written(left.join(heads, "key"), "left")
        forget(heads, left if known is not None else None, last if number else None)
        if number == rounds:
            break
        met = held.filter("component <> c").groupBy("id", "head").agg(F.count("key").alias("shared"))
        # an item is in a fixed number of buckets, and so has few heads
        best = met.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "head")), asc=False), 1, TRIES).alias("best"))
        near = written(confirm(best.select(F.col("id").alias("a"), F.explode("best.head").alias("b"))), "near")
        before, found = found, near.count()
        if found:
            known = written(components(near if known is None else _as_links(known).unionByName(near.select("a", "b"))), "known")
        shuffles_done(members.sparkSession)
        if found <= before * LITTLE:
            break
    far = written(compare(written(_blocks(_placed(held, known), weights), "blocks")).select("a", "b"), "far")
    if known is not None and far.isEmpty():
        return known
    return components(far if known is None else _as_links(known).unionByName(far))


def _placed(held: DataFrame, known: DataFrame | None) -> DataFrame:
    """(key, id, component) of held(key, id, ...); an item that is not known is its own component."""
    held = held.select("key", "id")
    if known is None:
        return held.withColumn("component", F.col("id"))
    return written(held.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")


def _blocks(left: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(key, i, j, id, slot, component): the members of left(key, id, component) dealt to the pairs of slots that must meet.

    The largest component of a bucket has slots of its own, behind those of the other members, which do not meet each other.
    """
    weighed = left.withColumn("weight", F.lit(1)) if weights is None else left.join(weights, "id")
    # a member counts for 1 / BLOCK of a slot, and for its weight's share of WEIGHT
    counts = weighed.groupBy("key", "component").agg(F.greatest(F.count("id") / BLOCK, F.sum("weight") / WEIGHT).alias("n"))
    most = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("n").alias("several")).filter("several > 1")
    most = most.select("key", F.col("top.component").alias("largest"), F.ceil("top.n").cast("int").alias("own"), F.ceil(F.col("all") - F.col("top.n")).cast("int").alias("others"))
    # a sum of shares may come out a little above or at a whole number
    most = most.withColumns({"own": F.greatest("own", F.lit(1)), "others": F.greatest("others", F.lit(1))})
    rest = left.select("key", "id", "component").join(written(most, "largest"), "key")
    inside = F.col("component") == F.col("largest")
    deal = F.xxhash64("id", F.lit("slot"))
    rest = rest.withColumn("slot", F.when(inside, F.col("others") + F.pmod(deal, F.col("own"))).otherwise(F.pmod(deal, F.col("others"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(inside, F.col("others") - 1).otherwise(F.col("own") + F.col("others") - 1))
    rest = rest.select("key", "id", "component", "slot", F.explode(meets).alias("other"))
    return rest.select("key", "id", "component", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def sized(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint where its rows, of a few numbers each, are few; else it is joined by a shuffle."""
    return F.broadcast(small) if small.count() <= most else small
