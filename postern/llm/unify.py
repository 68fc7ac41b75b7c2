"""Visually identical text with different characters: one consistent form in one pass.

A transducer is compiled before any text is read. Its tables are made by rule from the character
database and the look-alikes: `single` holds every character whose form differs from itself
(widths, compatibility forms, spaces, invisible characters), `pairs` the transitions from a letter
and an accent to the accented letter, `apart` and `order` what those transitions need where several
accents follow. A state is the letter composed so far, so reading a grapheme cluster to its end is
the longest match. Look-alikes are written as Latin only in words (or domain labels) that hold other
Latin letters, which one look ahead to the word's end decides. Nothing is normalised while text is
read and the output isn't read again.

The mapping is checked when it is compiled: entries for the same character that disagree, and
entries for characters that already have another form, are conflicts. They are rows of
conflict_rows(); of disagreeing entries the lowest row number is used.

ASCII text is already in this form and never leaves the JVM.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTATION = regex.compile(r"[Uu]\+([0-9A-Fa-f]{4,6})")
EMOJI = regex.compile(r"\p{Extended_Pictographic}|\p{Regional_Indicator}|[0-9#*]️?⃣")
LATIN = regex.compile(r"\p{Script=Latin}")
CLUSTER = regex.compile(r"\X")
# Typographic marks that compatibility mapping would change or that must stay.
STAYS = frozenset("‐‑‒–—―‘’‚‛“”„‟‹›«»…")
INVISIBLE = frozenset("͏ᅟᅠ឴឵᠎ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE10)} | {chr(c) for c in range(0xE0100, 0xE01F0)}


def _gone(ch: str) -> bool:
    return ch in INVISIBLE or unicodedata.category(ch) == "Cf"


def _space(ch: str) -> bool:
    return ch in "\t\n\r\v\f\x85  " or unicodedata.category(ch) == "Zs"


def read_notation(text: str) -> str | None:
    """The character named by a source field: a literal, or U+ notation; None if it names none."""
    plain = "".join(unicodedata.normalize("NFKC", c) for c in text if not _gone(c)).strip()
    if m := NOTATION.fullmatch(plain):
        return chr(int(m[1], 16))
    bare = "".join(c for c in text if not _gone(c)).strip()
    return bare if len(bare) == 1 else None


class Tables(NamedTuple):
    """Compiled transitions; every one is a plain look-up."""

    single: dict[str, str]  # character -> its form, where that differs
    pairs: dict[str, str]  # letter + accent -> accented letter
    apart: dict[str, str]  # accented letter -> letter and accents in canonical order
    order: dict[str, int]  # accent -> its place among the accents of a letter


def _form(ch: str) -> str:
    """Consistent form of one character: rules, used at compile time only."""
    if _gone(ch):
        return ""
    if _space(ch):
        return " "
    if ch in STAYS:
        return ch
    return "".join(" " if _space(c) else c for c in unicodedata.normalize("NFKC", ch) if not _gone(c))


@functools.cache
def tables() -> Tables:
    """Compile the transitions over all assigned characters (once per process, a fraction of a second).

    Hangul syllables and unified ideographs stay as they are and are passed over.
    """
    t = Tables({}, {}, {}, {})
    for block in (range(0x80, 0x3400), range(0x4DC0, 0x4E00), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000)):
        for ch in map(chr, block):
            if unicodedata.category(ch) in ("Cn", "Co", "Cs"):
                continue
            if (form := _form(ch)) != ch:
                t.single[ch] = form
            if place := unicodedata.combining(ch):
                t.order[ch] = place
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<":
                t.apart[ch] = unicodedata.normalize("NFD", ch)
                pair = "".join(chr(int(x, 16)) for x in parts.split())
                if len(pair) == 2 and unicodedata.normalize("NFC", pair) == ch:
                    t.pairs[pair] = ch
    return t


def compile_lookalikes(rows: list[tuple[int, str, str]]) -> tuple[dict[str, str], list[tuple[str, str, int]]]:
    """(mapping, conflicts) from (row_no, source, target); ASCII sources stay and are left out.

    A conflict is (character, the entry's target, its row): the target isn't the one in use, as an
    earlier row or the character's own form comes first.
    """
    mapping: dict[str, str] = {}
    conflicts = []
    for row_no, source, target in sorted((r for r in rows if r[1] and r[2]), key=lambda r: r[0]):
        ch = read_notation(source)
        if ch is None or ch.isascii():
            continue
        if mapping.setdefault(ch, target) != target or tables().single.get(ch, target) != target:
            conflicts.append((ch, target, row_no))
    return mapping, conflicts


def hangul(a: str, b: str) -> str | None:
    """The syllable of a leading consonant and a vowel, or of an open syllable and a final consonant."""
    x, y = ord(a), ord(b)
    if 0x1100 <= x < 0x1113 and 0x1161 <= y < 0x1176:
        return chr(0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28)
    if 0xAC00 <= x < 0xD7A4 and (x - 0xAC00) % 28 == 0 and 0x11A7 < y < 0x11C3:
        return chr(x + y - 0x11A7)
    return None


class Transducer:
    """Compiled mapping from grapheme clusters to their consistent form."""

    def __init__(self, lookalikes: dict[str, str]):
        self.look, self.t = lookalikes, tables()

    def compose(self, chars: list[str]) -> list[str]:
        """Accents put in order and read into their letter as long as a transition exists."""
        t = self.t
        parts = [p for c in chars for p in t.apart.get(c, c)]
        out: list[str] = []
        i = 0
        while i < len(parts):
            j = i + 1
            while j < len(parts) and parts[j] in t.order:
                j += 1
            run = parts[i:j] if parts[i] not in t.order else None
            marks = sorted(run[1:] if run else parts[i:j], key=t.order.__getitem__)
            if run:
                state, held, last = run[0], [], 0
                if out and (joined := (hangul(out[-1], state) if len(out[-1]) == 1 else None) or t.pairs.get(out[-1] + state)):
                    state = joined
                    out.pop()
                for m in marks:
                    step = t.pairs.get(state + m) if last != t.order[m] else None
                    if step:
                        state = step
                    else:
                        held.append(m)
                        last = t.order[m]
                out += [state, *held]
            else:
                out += marks
            i = j
        return out

    def plain(self, cluster: str) -> list[str]:
        """Form of a cluster without the look-alikes."""
        single = self.t.single
        if len(cluster) == 1:
            return list(single.get(cluster, cluster))
        chars = [x for c in cluster for x in single.get(c, c)]
        return chars if len(chars) < 2 else self.compose(chars)

    def apply(self, text: str, domain: bool = False) -> str:
        """Consistent form of a text; with `domain`, - and _ don't end a label."""
        if text.isascii():
            return text
        out, word, marked = [], [], False
        look, order = self.look, self.t.order

        def flush() -> None:
            nonlocal marked
            # Accents and syllable parts that an invisible character or a width had parted from their letter.
            chars = self.compose(word) if marked else word
            if any(c in look for c in chars) and any(LATIN.match(c) and c not in look for c in chars):
                chars = [look.get(c, c) if c not in look or not c.isupper() else look[c].upper() for c in chars]
                if marked:
                    chars = self.compose([x for c in chars for x in c])
            out.extend(chars)
            word.clear()
            marked = False

        for cluster in CLUSTER.findall(text):
            if EMOJI.search(cluster) and not cluster.isascii():
                flush()
                out.append(cluster)
                continue
            for c in self.plain(cluster):
                if c.isalnum() or c in order or unicodedata.category(c)[0] == "M" or (domain and c in "-_"):
                    word.append(c)
                    marked = marked or c in order or "\u1100" <= c < "\u1200"
                else:
                    flush()
                    out.append(c)
        flush()
        return "".join(out)


def load_lookalikes(confusables: DataFrame, limit: int = 200_000) -> tuple[dict[str, str], list[tuple[str, str, int]]]:
    """Compiled table; more than `limit` entries are refused, as Unicode itself holds fewer characters of this kind."""
    rows = confusables.select("row_no", "c0", "c1").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} look-alike entries")
    return compile_lookalikes([tuple(r) for r in rows])


def conflict_rows(confusables: DataFrame) -> DataFrame:
    """(row_no, source, target, used): entries whose target isn't the one in use; at most as many as the table has rows."""
    look, conflicts = load_lookalikes(confusables)
    rows = [(row_no, ch, target, tables().single.get(ch, look[ch])) for ch, target, row_no in conflicts]
    return confusables.sparkSession.createDataFrame(rows, "row_no int, source string, target string, used string")


def consistent(df: DataFrame, column: str, lookalikes: dict[str, str], domain: bool = False, out: str = "unified") -> DataFrame:
    """Adds `out`, the consistent form of `column`; null stays null, ASCII text is passed through."""
    shipped = df.sparkSession.sparkContext.broadcast(lookalikes)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = Transducer(shipped.value)
        for s in batches:
            yield s.map(lambda v: None if v is None else t.apply(v, domain))

    ascii_only = F.col(column).isNull() | F.col(column).rlike(r"^[\x00-\x7F]*$")
    return df.withColumn(out, F.when(ascii_only, F.col(column)).otherwise(run(F.col(column))))


def stored_values(cases: DataFrame, confusables: DataFrame) -> DataFrame:
    """(fieldname, rec_no, pos, value): subjects, domain elements and notations that aren't ASCII."""
    odd = lambda c: c.rlike(r"[^\x00-\x7F]")
    subject = cases.select(F.lit("subject").alias("fieldname"), F.col("case_no").alias("rec_no"), F.lit(-1).alias("pos"), F.col("subject").alias("value"))
    # Elements that stay as they are drop out inside the array, before it is exploded.
    numbered = F.filter(F.transform("domains", lambda d, i: F.struct(i.alias("pos"), d.alias("value"))), lambda x: odd(x["value"]))
    domains = cases.select(F.lit("domains").alias("fieldname"), F.col("case_no").alias("rec_no"), F.explode(numbered).alias("x")).select("fieldname", "rec_no", "x.*")
    notation = confusables.filter(F.length("c0") > 1).select(F.lit("c0").alias("fieldname"), F.col("row_no").cast("bigint").alias("rec_no"), F.lit(-1).alias("pos"), F.col("c0").alias("value"))
    return subject.filter(odd(F.col("value"))).unionByName(domains).unionByName(notation.filter(odd(F.col("value"))))


def changed_values(cases: DataFrame, confusables: DataFrame) -> DataFrame:
    """(fieldname, rec_no, pos, clean): stored values that differ from their consistent form.

    Letter case and blanks of any kind at the ends don't count. Values that are null, empty or
    ASCII are never changed; a notation that is a single character is an entry, not a value.
    """
    lookalikes, _ = load_lookalikes(confusables)
    shipped = cases.sparkSession.sparkContext.broadcast(lookalikes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Transducer(shipped.value)
        for b in batches:
            clean = [t.apply(v, f == "domains").lower().strip() for v, f in zip(b["value"], b["fieldname"], strict=True)]
            differs = [c != v.lower().strip() for c, v in zip(clean, b["value"], strict=True)]
            yield b.assign(clean=clean)[differs][["fieldname", "rec_no", "pos", "clean"]]

    return stored_values(cases, confusables).mapInPandas(run, "fieldname string, rec_no bigint, pos int, clean string")


def skeleton_key(column: Column) -> Column:
    """Comparison key of a consistent form: lower case without blanks at the ends."""
    return F.lower(F.trim(column))
