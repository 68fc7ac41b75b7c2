"""Corpus correlation: tf-idf, set similarity, pair scores, clusters and campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import lexicons as L
from postern.functions import text
from postern.functions.text import c
from postern.operators.graph import components
from postern.session import materialize

SETS = ("domains", "addresses", "header_names", "attachment_hashes", "urls", "file_types")


def clean_set(*arrays, cap: int | None = None) -> Column:
    """Distinct trimmed values of array columns, nulls and blanks out, in first-seen order, at most `cap` if given."""
    each = [F.coalesce(c(a), F.array().cast("array<string>")) for a in arrays]
    vals = F.transform(F.flatten(F.array(*each)), lambda v: F.trim(v))
    return text.at_most(F.array_distinct(F.filter(vals, lambda v: v.isNotNull() & (v != ""))), cap)


def jaccard(a, b) -> Column:
    """Shared / either; an empty or null set gives 0."""
    x, y = c(a), c(b)
    both = F.coalesce(F.size(x) * F.size(y), F.lit(0))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(term, df) from (id, tokens): each document counts once per term."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(tokens: DataFrame) -> DataFrame:
    """(term, df, idf): ln((N + 1) / (df + 1)) + 1; N counts empty documents too."""
    n = tokens.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(tokens).crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(tokens: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln count) * idf, each document of length 1.

    Counts are made inside the document's row; a frequent term's join rows are spread by the
    adaptive skew split, and the norm is one aggregate per document.
    """
    counted = tokens.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))
    raw = counted.join(idf(tokens), "term").select("id", "term", ((1 + F.log("c")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine(vec_a, vec_b) -> Column:
    """Dot product of two map<string,double> columns, clamped to [0, 1]; an empty vector gives 0."""
    a, b = c(vec_a), c(vec_b)
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot, F.lit(0.0))))


# Weights of the combined score, and of what it can reach without domains and addresses of its own.
WEIGHTS = {"header_names": 0.25, "domains": 0.30, "addresses": 0.20, "text": 0.20, "attachment_hashes": 0.05}


def _prefix(docs: DataFrame, column: str, least: float) -> DataFrame:
    """(id, column, size): the items, rare ones first, of which one is shared by any two sets with Jaccard `least` or more."""
    items = docs.select("id", F.explode(column).alias("v"))
    count = items.groupBy("v").agg(F.count(F.lit(1)).alias("f"))
    whole = items.join(count, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("x"))
    n = F.size("x")
    return whole.select("id", F.slice(F.transform("x", lambda s: s["v"]), F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1).alias(column), n.alias(f"n_{column}"))


def candidates(docs: DataFrame, with_headers: bool = True, tau: float | None = None) -> DataFrame:
    """(a, b), a < b: every pair that can reach the link threshold.

    A pair that shares neither a domain nor an address scores at most .50 < .62. Where no document
    has header names the rest can't make up for either one missing (.45 or .55), so the pair must
    share a domain and an address; that key is selective even if one domain holds a third of the rows.

    With `tau` only pairs that can score that much are looked for (without header names): the text and
    the hashes add .25 at most, which bounds both similarities from below, and two sets that similar
    share an item among the rarest of each. A frequent domain or address is then no key, unless a set
    has nothing else.
    """
    if with_headers:
        key = F.explode(F.array_union(F.transform("domains", lambda x: F.concat(F.lit("d:"), x)), F.transform("addresses", lambda x: F.concat(F.lit("a:"), x)))).alias("k")
        k = docs.select("id", key)
    else:
        both = docs.select("id", "domains", "addresses")
        if tau is not None:
            need = tau - WEIGHTS["text"] - WEIGHTS["attachment_hashes"]
            d, a = (need - WEIGHTS["addresses"]) / WEIGHTS["domains"], (need - WEIGHTS["domains"]) / WEIGHTS["addresses"]
            if min(d, a) > 0:
                both = _prefix(docs, "domains", d).join(_prefix(docs, "addresses", a), "id")
        k = both.select("id", F.explode(F.flatten(F.transform("domains", lambda x: F.transform("addresses", lambda y: F.concat_ws("\x01", x, y))))).alias("k"))
    return k.select(F.col("id").alias("a"), "k").join(k.select(F.col("id").alias("b"), "k"), "k").filter("a < b").select("a", "b").distinct()


def with_vectors(docs: DataFrame) -> DataFrame:
    """docs with the tf-idf vector of subject and body as `vec`; all vectors come from one idf."""
    toks = docs.select("id", text.tokens(F.concat_ws(" ", "subject", "body")).alias("tokens"))
    vec = tfidf(toks).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("vec"))
    return materialize(docs.join(vec, "id", "left"), "documents")


def missed_pairs(members: DataFrame, scored: DataFrame, parts: int = 32) -> DataFrame:
    """(a, b), a < b: pairs inside a cluster that were not scored, as they can't be links.

    They are all pairs of a cluster by nature; one side of it is cut into `parts`, so that a large
    cluster is the work of many tasks.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(parts))
    big = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("root")
    m = members.join(big, "root", "left_semi")
    x = m.select("root", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("s"))
    y = m.select("root", F.col("id").alias("b"), salt.cast("int").alias("s"))
    return x.join(y, ["root", "s"]).filter("a < b").select("a", "b").join(scored.select("a", "b"), ["a", "b"], "left_anti")


def pair_scores(docs: DataFrame, pairs: DataFrame | None = None, with_headers: bool = True, tau: float | None = None) -> DataFrame:
    """All components of each candidate pair and the combined score; with `tau` candidates that can reach it.

    `docs`: id, subject, body and the six sets, with vectors or without.
    """
    full = docs if "vec" in docs.columns else with_vectors(docs)
    pairs = candidates(docs, with_headers, tau) if pairs is None else pairs
    side = lambda s: full.select(*[F.col(x).alias(f"{s}_{x}" if x != "id" else s) for x in full.columns])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    cols = {x: jaccard(f"a_{x}", f"b_{x}") for x in SETS}
    j = j.select("a", "b", *[v.alias(f"j_{k}") for k, v in cols.items()], jaccard(text.tokens("a_subject"), text.tokens("b_subject")).alias("j_subject"), jaccard(text.tokens("a_body"), text.tokens("b_body")).alias("j_body"), cosine("a_vec", "b_vec").alias("text_cosine"))
    combined = 0.25 * F.col("j_header_names") + 0.30 * F.col("j_domains") + 0.20 * F.col("j_addresses") + 0.20 * F.col("text_cosine") + 0.05 * F.col("j_attachment_hashes")
    return j.withColumn("infrastructure", F.greatest("j_addresses", "j_domains")).withColumn("content", 0.5 * F.col("j_body") + 0.5 * F.col("text_cosine")).withColumn(
        "combined", F.least(F.lit(1.0), F.greatest(F.lit(0.0), combined))
    )


def single_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of (a, b, tokens_a, tokens_b): text similarity with document frequencies of the two texts alone.

    A term of both texts weighs 1, of one text 1 + ln 1.5, times 1 + ln of its count. No text, no
    similarity. The terms of a pair are summed by two aggregates, so a long text is never one row.
    """
    side = lambda c, x, y: pairs.select("a", "b", F.explode(c).alias("term"), F.lit(x).alias("ca"), F.lit(y).alias("cb"))
    t = side("tokens_a", 1, 0).unionByName(side("tokens_b", 0, 1)).groupBy("a", "b", "term").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    both = (F.col("ca") > 0) & (F.col("cb") > 0)
    weight = lambda c: F.when(F.col(c) > 0, (1 + F.log(c)) * F.when(both, 1.0).otherwise(1 + F.log(F.lit(1.5)))).otherwise(0.0)
    w = t.select("a", "b", weight("ca").alias("wa"), weight("cb").alias("wb"))
    norm = F.sqrt(F.sum(F.col("wa") * F.col("wa"))) * F.sqrt(F.sum(F.col("wb") * F.col("wb")))
    g = w.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), norm.alias("norm"))
    found = g.select("a", "b", F.when(F.col("norm") > 0, F.least(F.lit(1.0), F.col("dot") / F.col("norm"))).otherwise(0.0).alias("cosine"))
    return pairs.select("a", "b").join(found, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def dominant(scores: dict[str, str]) -> Column:
    """Name of the largest component, the first listed wins ties; all 0 gives 'none'."""
    top = F.greatest(*[F.col(v) for v in scores.values()])
    out = F.when(top <= 0, "none")
    for name, col in scores.items():
        out = out.when(F.col(col) == top, name)
    return out


def threshold(tau: float | None) -> float:
    return tau if tau is not None and 0 < tau <= 1 else L.TAU_CLUSTER


def campaign_risk(risk: Column) -> Column:
    """Aggregate: 100 (1 - prod(1 - r / 100)), r clamped; NULL risks don't count; none gives NULL."""
    r = F.when(risk.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), risk)))
    return 100.0 * (1.0 - F.product(1.0 - r / 100.0))


def clusters(links: DataFrame) -> DataFrame:
    """(id, root) of the linked pairs (a, b); singletons have no row."""
    return components(links)


def campaigns(docs: DataFrame, members: DataFrame, scored: DataFrame, tau: float | None = None) -> DataFrame:
    """One row per cluster: size, risk, mean confidence, window, cohesion, weakest pair, dominant component.

    Cohesion is over linked pairs; weakest over all scored pairs inside the cluster, so `scored` must have them all.
    """
    t = threshold(tau)
    per = members.join(docs.select("id", "risk", "confidence", "observed_ms"), "id").groupBy("root").agg(
        F.count(F.lit(1)).alias("size"), campaign_risk(F.col("risk")).alias("risk"), F.avg("confidence").alias("confidence"), F.min("observed_ms").alias("first_ms"), F.max("observed_ms").alias("last_ms")
    )
    named = scored.withColumn("dominant", dominant({"infrastructure": "infrastructure", "content": "content", "headers": "j_header_names", "attachments": "j_attachment_hashes"}))
    inside = named.join(members.select(F.col("id").alias("a"), "root"), "a").join(members.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b").filter("root = root_b")
    linked = F.col("combined") >= t
    stats = inside.groupBy("root").agg(F.avg(F.when(linked, F.col("combined"))).alias("cohesion"), F.min("combined").alias("weakest"), F.count(F.when(linked, 1)).alias("links"))
    counts = inside.filter(linked).groupBy("root", "dominant").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "dominant"))["dominant"].alias("dominant"))
    return per.join(stats, "root", "left").join(mode, "root", "left")


def ordered_clusters(members: DataFrame) -> DataFrame:
    """(root, size, members): clusters by falling size, then by their members, which are listed in order.

    A cluster's list is bounded by the cluster.
    """
    g = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("members"))
    return g.orderBy(F.col("size").desc(), "members")


def unclustered(docs: DataFrame, members: DataFrame) -> DataFrame:
    return docs.select("id").join(members.select("id"), "id", "left_anti")


def case_documents(cases: DataFrame) -> DataFrame:
    """Correlation documents from case rows; a missing observation time is NULL."""
    return cases.select(
        F.col("case_no").alias("id"), F.coalesce("subject", F.lit("")).alias("subject"), F.lit("").alias("body"),
        clean_set(F.transform("domains", F.lower)).alias("domains"), clean_set(F.transform("addresses", F.lower), "hopaddresses").alias("addresses"),
        F.array().cast("array<string>").alias("header_names"), clean_set("attachmenthashes").alias("attachment_hashes"), clean_set("urls").alias("urls"), F.array().cast("array<string>").alias("file_types"),
        "risk", "confidence", F.when(F.col("observedat") >= 0, F.col("observedat")).alias("observed_ms"),
    )
