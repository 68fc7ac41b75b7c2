"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

Patterns are all runs of `window` consecutive words of the evaluation items. A shift table holds,
for every block of two words that occurs in a pattern, how far the block is from a pattern's end;
any other block lets the scan skip `window - 1` words at once. A block that can end a pattern
selects, by hash of the pattern's last words, a bucket of pattern places, where the window is
compared word by word with the item's own words.

The items are the pattern side. They are gathered in blocks of at most `block_windows` windows,
each block is shipped to the executors and searched against all documents; one item's windows are
never split, so a very long item makes a block of its own. Documents are scanned where they lie:
no shuffle until the final distinct of (doc, item).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<[^<>]*>|\[/?[A-Za-z]+(?:=[^\[\]]*)?\]")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words for comparison: entities decoded once, tags taken out, lower case; null has none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = TAG.sub(" ", text)
    return WORD.findall(text.lower())


class WuManber:
    """Finds every item that shares `window` consecutive words with a text."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int):
        self.window = window
        self.items = [(i, w) for i, w in items if len(w) >= window]
        self.skip = window - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = {}
        for at, (_, w) in enumerate(self.items):
            last_end = len(w) - 1
            for j in range(1, len(w)):
                # Distance from this block to the nearest pattern end at or after it.
                block, far = (w[j - 1], w[j]), max(0, window - 1 - j)
                if far < self.shift.get(block, self.skip):
                    self.shift[block] = far
                if j >= window - 1:
                    self.bucket.setdefault(hash((w[j - 2], w[j - 1], w[j])), []).append((at, j))
            assert last_end >= window - 1

    def search(self, text: list[str]) -> set[int]:
        m, n, found = self.window, len(text), set()
        i, shift, skip = m - 1, self.shift, self.skip
        while i < n:
            step = shift.get((text[i - 1], text[i]), skip)
            if step:
                i += step
                continue
            for at, j in self.bucket.get(hash((text[i - 2], text[i - 1], text[i])), ()):
                item, w = self.items[at]
                if item not in found and w[j - m + 1 : j + 1] == text[i - m + 1 : i + 1]:
                    found.add(item)
            i += 1
        return found


def blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most block_windows windows, read one partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        w = words(row["text"])
        n = len(w) - window + 1
        if n < 1:
            continue
        if block and size + n > block_windows:
            yield block
            block, size = [], 0
        block.append((row["item_id"], w))
        size += n
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, window: int = 12, block_windows: int = 500_000) -> DataFrame:
    """(doc_id, item_id): each pair that shares at least `window` consecutive words.

    Whole texts are scanned. Null and short texts hold nothing; repeated items are each reported;
    repeated doc_ids collapse to one row. No items or no documents give no rows.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint"
    parts = []
    for block in blocks(items, window, block_windows):
        shipped = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            wm = WuManber(shipped.value, window)
            for b in batches:
                hits = [(d, i) for d, t in zip(b["doc_id"], b["text"], strict=True) for i in wm.search(words(t))]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        parts.append(documents.select("doc_id", "text").filter(F.col("text").isNotNull()).mapInPandas(scan, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
