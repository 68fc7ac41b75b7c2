"""Filling fixed-capacity sequences: configuration linear program over the length histogram.

1. Token counts of all posts (public tokenizer, Arrow batches). Only a post longer than the
   capacity is split, into full pieces and one rest.
2. The histogram of piece lengths has at most `capacity` rows, whatever the number of posts, so it
   alone goes to the driver. Neighbouring lengths are put in at most `groups` slots, cut where the
   slack (a slot is as long as its longest piece) is least; with fewer lengths each is its own slot.
3. The configuration LP (fewest sequences whose configurations cover the demand for each slot) is
   solved by multiplicative weights: every slot has a price, its length (a long one is worth more
   than its part) times an exponential of what is missing of its demand; an exact knapsack dynamic program over all slots with open demand
   prices the best configuration, which is used in steps of a small part of the demand. Prices that no
   configuration exceeds give the dual bound, so the gap to the optimum is known.
4. The solution is rounded down to whole sequences. Steps are whole numbers of sequences unless less is
   open, so rounding loses little; what it loses is priced again whole.
5. Pieces get their sequence by rank within their slot. Ranks come from salted groups with exact
   offsets, so a length that holds a third of all posts is never one group.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from postern.session import materialize

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the split pattern published with the byte-level vocabulary.
GPT2_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Byte-pair encoder of a vocabulary file of ranks, one per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) over whole texts; null and empty texts have 0 tokens."""
    path = os.path.join(tokenizers, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.asarray(n, dtype="int64")})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, length): one piece per post, or full pieces and a rest if it exceeds the capacity."""
    n = F.ceil(F.col("n_tokens") / capacity).cast("int")
    return counts.filter(F.col("n_tokens") > 0).select("doc_id", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("piece", "_k"), "n_tokens").select(
        "doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("_k") * capacity).cast("int").alias("length")
    )


def slots(lengths: np.ndarray, demand: np.ndarray, groups: int) -> np.ndarray:
    """Slot number of each length (0 is the longest), at most `groups`: runs of lengths with equal slack.

    The slack a run may have is found by bisection; a run is cut before it would exceed it.
    """
    if len(lengths) <= groups:
        return len(lengths) - 1 - np.arange(len(lengths))
    size, count = lengths[::-1], demand[::-1].astype(float)

    def runs(most: float) -> np.ndarray:
        out, k, top, slack = np.zeros(len(size), dtype=np.int64), 0, size[0], 0.0
        for i in range(1, len(size)):
            more = count[i] * (top - size[i])
            if slack + more > most:
                k, top, slack = k + 1, size[i], 0.0
            else:
                slack += more
            out[i] = k
        return out

    low, high = 0.0, float((count * (size[0] - size)).sum())
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if runs(mid)[-1] + 1 > groups else (low, mid)
    return runs(high)[::-1]


def price(values: np.ndarray, lengths: np.ndarray, capacity: int, most: np.ndarray) -> tuple[np.ndarray, float]:
    """(counts per length, value) of the most valuable configuration with at most `most` of each length.

    Exact knapsack by dynamic programming; repeats go in binary bundles.
    """
    best, taken = np.zeros(capacity + 1), []
    for k in range(len(lengths)):
        left, size = int(min(most[k], capacity // lengths[k])), 1
        while left > 0:
            use = min(size, left)
            w = use * int(lengths[k])
            gain = best[:-w] + use * values[k]
            better = gain > best[w:]
            best[w:] = np.where(better, gain, best[w:])
            taken.append((k, use, w, better))
            left, size = left - use, size * 2
    counts, c = np.zeros(len(lengths), dtype=np.int64), capacity
    for k, use, w, better in reversed(taken):
        if c >= w and better[c - w]:
            counts[k] += use
            c -= w
    return counts, float(best[capacity])


def dual_bound(lengths: np.ndarray, demand: np.ndarray, capacity: int, most: int = 20) -> float:
    """A lower bound on the sequences: the best of some prices that sum to at most 1 in any configuration.

    The prices are the length's part of the capacity, and that part rounded down to k-ths of k + 1 parts.
    """
    best = float(demand @ lengths) / capacity
    for k in range(1, most + 1):
        whole, rest = np.divmod((k + 1) * lengths, capacity)
        best = max(best, float(demand @ np.where(rest == 0, lengths / capacity, whole / k)))
    return best


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.2, rate: float = 2.0) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(configurations with how often each is used, dual bound): the LP by multiplicative weights.

    Together the configurations cover the demand exactly. Every round prices the best configuration
    for the open demand and uses it for `step` of the scarcest demand in it, at least once if so
    much is open. The bound is the best one of the rounds in which every length is still open.
    """
    need = demand.astype(float)
    left, bound = need.copy(), dual_bound(lengths, need, capacity)
    worth = lengths * (1.0 + lengths / capacity)
    chosen: dict[bytes, list] = {}
    while (left > 1e-9).any():
        have = np.nonzero(left > 1e-9)[0]
        missing = left[have] / need[have]
        value = worth[have] * np.exp(rate * (missing - missing.max()))
        counts, _ = price(value, lengths[have], capacity, np.ceil(left[have] - 1e-9))
        config = np.zeros(len(need), dtype=np.int64)
        config[have] = counts
        held = config > 0
        times = min(max(1.0, float(np.floor(step * (need[held] / config[held]).min()))), float((left[held] / config[held]).min()))
        chosen.setdefault(config.tobytes(), [config, 0.0])[1] += times
        left[held] = np.maximum(0.0, left[held] - config[held] * times)
    return [(c, x) for c, x in chosen.values()], bound


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], dict[str, float]]:
    """Whole configurations with their multiplicity that together hold every item exactly once, and what was found.

    The report has the dual bound, the sequences and the share of the items that rounding kept.
    """
    left, plan = demand.astype(np.int64).copy(), []
    relaxed, bound = fractional(lengths, demand, capacity)
    for config, x in sorted(relaxed, key=lambda p: -p[1]):
        held = config > 0
        k = int(min(math.floor(x + 1e-6), (left[held] // config[held]).min()))
        if k > 0:
            plan.append((config, k))
            left -= config * k
    kept = 1.0 - float(left.sum()) / max(1, int(demand.sum()))
    while left.any():
        have = np.nonzero(left)[0]
        config = np.zeros(len(lengths), dtype=np.int64)
        config[have] = price(lengths[have].astype(float), lengths[have], capacity, left[have])[0]
        held = config > 0
        k = int((left[held] // config[held]).min())
        plan.append((config, k))
        left -= config * k
    return plan, {"bound": bound, "sequences": float(sum(k for _, k in plan)), "kept": kept}


def assign(items: DataFrame, tops: np.ndarray, plan: list[tuple[np.ndarray, int]], salts: int = 64) -> DataFrame:
    """Adds seq_id and pos_tokens (where the item's slot starts) to (doc_id, piece, length, slot).

    A configuration's sequences are numbered consecutively; the r-th item of a slot belongs to the
    configuration whose share of that slot holds r. The plan has at most one entry per slot and
    configuration, so shipping it is bounded by the histogram. `tops` are the lengths of the slots.
    """
    spark = items.sparkSession
    table: dict[int, tuple] = {}
    first_seq, seen = 0, np.zeros(len(tops), dtype=np.int64)
    rows: dict[int, list] = {}
    for config, times in plan:
        at = 0
        for k in np.nonzero(config)[0]:
            n = int(config[k])
            rows.setdefault(int(k), []).append((int(seen[k]), first_seq, n, at))
            seen[k] += n * times
            at += n * int(tops[k])
        first_seq += times
    for slot, r in rows.items():
        table[slot] = tuple(np.asarray(x, dtype=np.int64) for x in zip(*r, strict=True))
    shipped = spark.sparkContext.broadcast(table)

    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # At most groups x salts rows: counts of each salted group, and the ranks that come before it.
    sizes = salted.groupBy("slot", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("slot", "salt", (F.sum("n").over(Window.partitionBy("slot").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("slot", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("r", rank).join(before, ["slot", "salt"]).select("doc_id", "piece", "length", "slot", (F.col("before") + F.col("r") - 1).alias("r"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq, pos = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            slot, r = b["slot"].to_numpy(), b["r"].to_numpy()
            for v in np.unique(slot):
                start, base, n, at = shipped.value[int(v)]
                mine = np.nonzero(slot == v)[0]
                e = np.searchsorted(start, r[mine], side="right") - 1
                inside = r[mine] - start[e]
                seq[mine], pos[mine] = base[e] + inside // n[e], at[e] + (inside % n[e]) * tops[v]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "length": b["length"], "seq_id": seq, "pos_tokens": pos})

    return ranked.mapInPandas(place, "doc_id bigint, piece int, length int, seq_id bigint, pos_tokens bigint")


def pack(documents: DataFrame, capacity: int = 2048, tokenizers: str = TOKENIZERS, groups: int = 256) -> DataFrame:
    """(doc_id, piece, length, seq_id, pos_tokens): every post in a training sequence.

    Null and empty posts hold no tokens and are in no sequence. Repeated rows are packed as often
    as they occur. Ties in length are broken by doc_id and piece.
    """
    items = materialize(pieces(token_counts(documents, tokenizers), capacity), "pieces")
    histogram = sorted(items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    if not histogram:
        return items.selectExpr("doc_id", "piece", "length", "0L AS seq_id", "0L AS pos_tokens")
    lengths = np.array([h["length"] for h in histogram], dtype=np.int64)
    demand = np.array([h["n"] for h in histogram], dtype=np.int64)
    slot = slots(lengths, demand, groups)
    tops, need = np.zeros(slot.max() + 1, dtype=np.int64), np.zeros(slot.max() + 1, dtype=np.int64)
    np.maximum.at(tops, slot, lengths)
    np.add.at(need, slot, demand)
    plan, _ = solve(tops, need, capacity)
    of_length = documents.sparkSession.createDataFrame([(int(v), int(k)) for v, k in zip(lengths, slot, strict=True)], "length int, slot int")
    # At most `capacity` rows: one per length.
    return assign(items.join(F.broadcast(of_length), "length"), tops, plan, salts=max(16, int(demand.sum()) // 200_000))
