"""All similar pairs between set-valued records: adaptive extended-prefix join.

Items are ordered from rare to frequent. Two sets of similarity t or more share their first l
common items within the first n - ceil(t n) + l items of each (n: set size). The join starts with
l = 1 on single prefix items. A key that is held by more than `hot` sets is not joined: its sets
are extended to combinations with the next prefix item, l + 1, until the keys are selective; so a
frequent item costs more combinations instead of all its pairs. Pairs that share exactly l items
under a hot key can only be similar if both are small; they are joined by their sizes and all of
them are results. A pair is reported under the key made of its first l common items only, so no
de-duplication is needed, and every candidate is verified.

Equal sets are joined once, as a class; members are attached at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import materialize


def item_set(*arrays: str) -> Column:
    """Sorted distinct items of several array columns, trimmed, lower case; nulls and blanks don't count."""
    each = [F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays]
    cleaned = F.transform(F.flatten(F.array(*each)), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))))


def classes_of(records: DataFrame, key: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, cid) and (cid, items). Records without items are in no class."""
    sets = records.select(F.col(key).alias("id"), items.alias("items")).filter(F.size("items") > 0)
    members = sets.select("id", F.md5(F.to_json(F.struct("items"))).alias("cid"), "items")
    return members.select("id", "cid"), members.groupBy("cid").agg(F.first("items").alias("items"))


def ordered_tokens(classes: DataFrame) -> DataFrame:
    """(cid, toks): each class's items as 64-bit hashes in the global order, rare first."""
    tokens = classes.select("cid", F.explode("items").alias("item")).select("cid", F.xxhash64("item").alias("tok"))
    freq = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    ordered = tokens.join(freq, "tok").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("x"))
    return ordered.select("cid", F.col("x.tok").alias("toks"))


def _need(size: Column, t: float) -> Column:
    """Least overlap of a set of this size with any similar set."""
    return F.ceil(size * t - 1e-9).cast("int")


def _verified(a: str, b: str, t: float) -> Column:
    common = F.size(F.array_intersect(f"{a}toks", f"{b}toks"))
    return common >= t * (F.size(f"{a}toks") + F.size(f"{b}toks") - common) - 1e-9


def similar_classes(ordered: DataFrame, t: float = 0.6, hot: int = 200, max_level: int = 12) -> DataFrame:
    """(cid_a, cid_b), each similar pair of different classes once, cid_a < cid_b.

    `hot` bounds the sets joined under one key; it changes the cost, never the result. Level
    `max_level` is joined whatever its keys hold, which is exact as well.
    """
    spark = ordered.sparkSession
    n = F.size("toks")
    # key: the items chosen so far; last: prefix position of the last of them (0-based).
    prefix = lambda level: F.least(n, n - _need(n, t) + level)
    rows = ordered.select("cid", "toks", F.posexplode(F.slice("toks", F.lit(1), prefix(1))).alias("last", "tok")).select(
        "cid", "toks", F.array("tok").alias("key"), "last"
    )
    found: list[DataFrame] = []
    for level in range(1, max_level + 1):
        rows = materialize(rows, f"prefix{level}")
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        heat = materialize(counted.filter(F.col("held") > hot).select("key"), f"hot{level}")
        last_level = level == max_level
        any_hot = not last_level and not heat.isEmpty()
        cold = rows.join(heat, "key", "left_anti") if any_hot else rows
        found.append(_join_on(cold, level, t))
        if not any_hot:
            break
        kept = materialize(rows.join(heat, "key", "left_semi"), f"kept{level}")
        found.append(_residual(kept, level, t))
        nxt = F.transform(
            F.sequence(F.col("last") + 1, F.greatest(F.col("last") + 1, prefix(level + 1) - 1)), lambda i: F.struct(i.alias("i"), F.get("toks", i).alias("tok"))
        )
        rows = (
            kept.filter(prefix(level + 1) - 1 > F.col("last"))
            .select("cid", "toks", "key", F.explode(nxt).alias("x"))
            .select("cid", "toks", F.concat("key", F.array("x.tok")).alias("key"), F.col("x.i").alias("last"))
        )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _sides(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a = left.select(*on, F.col("cid").alias("a_cid"), F.col("toks").alias("a_toks"))
    b = right.select(*on, F.col("cid").alias("b_cid"), F.col("toks").alias("b_toks"))
    return a.join(b, on)


def _join_on(rows: DataFrame, level: int, t: float) -> DataFrame:
    """Verified pairs under selective keys, each under its first `level` common items only."""
    pairs = _sides(rows, rows, ["key"]).filter(F.col("a_cid") < F.col("b_cid"))
    # Sizes alone rule out most candidates before the overlap is computed.
    na, nb = F.size("a_toks"), F.size("b_toks")
    pairs = pairs.filter((F.least(na, nb) >= t * F.greatest(na, nb) - 1e-9))
    first = F.slice(F.array_intersect("a_toks", "b_toks"), 1, level) == F.col("key")
    return pairs.filter(first & _verified("a_", "b_", t)).select(F.col("a_cid").alias("cid_a"), F.col("b_cid").alias("cid_b"))


def _residual(kept: DataFrame, level: int, t: float) -> DataFrame:
    """Pairs that share exactly `level` items, all of a hot key: sizes n <= m with level / (n + m - level) >= t."""
    biggest = math.floor(level / t + 1e-9)
    sizes = [(x, y) for x in range(level, biggest + 1) for y in range(x, biggest + 1) if level >= t * (x + y - level) - 1e-9]
    small = kept.filter(F.size("toks") <= biggest).withColumn("sz", F.size("toks"))
    out = None
    for x, y in sizes:
        if x == y == level:
            continue  # equal sets are one class already
        pairs = _sides(small.filter(F.col("sz") == x), small.filter(F.col("sz") == y), ["key"])
        if x == y:
            pairs = pairs.filter(F.col("a_cid") < F.col("b_cid"))
        exact = F.array_intersect("a_toks", "b_toks") == F.col("key")
        pairs = pairs.filter(exact).select(F.least("a_cid", "b_cid").alias("cid_a"), F.greatest("a_cid", "b_cid").alias("cid_b"))
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = kept.sparkSession.createDataFrame([], "cid_a string, cid_b string")
    return out


def confirmed(links: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """The links whose overlap holds on the items themselves; candidates are found by 64-bit hashes of items."""
    side = lambda s: classes.select(F.col("cid").alias(f"cid_{s}"), F.col("items").alias(f"items_{s}"))
    common = F.size(F.array_intersect("items_a", "items_b"))
    holds = common >= t * (F.size("items_a") + F.size("items_b") - common) - 1e-9
    return links.join(side("a"), "cid_a").join(side("b"), "cid_b").filter(holds).select("cid_a", "cid_b")


def _classes(records: DataFrame, key: str, items: Column, t: float, hot: int) -> tuple[DataFrame, DataFrame]:
    members, classes = classes_of(records, key, items)
    classes = materialize(classes, "classes")
    ordered = materialize(ordered_tokens(classes), "ordered")
    return members, confirmed(similar_classes(ordered, t, hot), classes, t)


def _spread(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(members by class and part, members once for every part of their class): a class of `block` members or fewer is one part."""
    size = members.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    m = members.join(size, "cid")
    once = m.select("cid", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return once, m.select("cid", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def similar_pairs(records: DataFrame, key: str, items: Column, t: float = 0.6, hot: int = 200, block: int = 2000) -> DataFrame:
    """(a, b): all pairs of ids a < b whose sets have Jaccard similarity of at least t.

    Records without items pair with nothing. Repeated ids and an empty table are fine. The pairs
    inside a class of equal sets are as many as its size squared; a class of more than `block`
    members is cut into parts, so that no task makes all of them. Where pairs of copies aren't
    wanted, class_links() has the same links in one row per record.
    """
    members, links = _classes(records, key, items, t, hot)
    a, b = members.select(F.col("id").alias("x"), F.col("cid").alias("cid_a")), members.select(F.col("id").alias("y"), F.col("cid").alias("cid_b"))
    across = links.join(a, "cid_a").join(b, "cid_b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    once, every = _spread(members, block)
    same = once.withColumnRenamed("id", "a").join(every.withColumnRenamed("id", "b"), ["cid", "part"]).filter("a < b").select("a", "b")
    return across.unionByName(same)


def class_links(records: DataFrame, key: str, items: Column, t: float = 0.6, hot: int = 200) -> DataFrame:
    """(id, cid, copies, links): one row per record: its class of equal sets, the class's size, and links to other classes."""
    members, links = _classes(records, key, items, t, hot)
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    degree = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    return members.join(size, "cid").join(degree, "cid", "left").select("id", "cid", "copies", F.coalesce("links", F.lit(0)).alias("links"))
