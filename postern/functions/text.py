"""String columns: tokens, similarity folding, lexicon scores, masking, hashes and identifiers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.session import let

INVISIBLE = "[\\x{200B}-\\x{200D}\\x{2060}-\\x{2064}\\x{180E}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E0000}-\\x{E000E}\\x{00AD}]"


INVISIBLE_CLASS = "[\u200b-\u200d\u2060-\u2064\u180e\ufeff\u202a-\u202e\u2066-\u2069\U000e0000-\U000e000e\u00ad]"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at_most(array: Column, limit: int | None) -> Column:
    return array if limit is None else F.slice(array, 1, limit)


def tokens(text, limit: int | None = None, chars: int | None = None) -> Column:
    """Lower-case ASCII words of 2..32 characters; NULL gives none.

    For the reference's form, the first 4,000 words of the first 1,000,000 characters, give both limits.
    """
    t = F.coalesce(c(text), F.lit(""))
    found = F.regexp_extract_all(t if chars is None else F.substring(t, 1, chars), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return at_most(F.transform(F.filter(found, lambda t: F.length(t).between(2, 32)), F.lower), limit)


@F.pandas_udf(T.StringType())
def _nfkc_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text) -> Column:
    """Compatibility composition; ASCII rows never leave the JVM."""
    t = c(text)
    return F.when(t.rlike(r"^[\x00-\x7F]*$"), t).otherwise(_nfkc_udf(t))


def strip_invisible(text) -> Column:
    return F.regexp_replace(c(text), INVISIBLE, "")


def fold(text, table: dict[str, str]) -> Column:
    """Replace look-alike characters: one translate for single targets, a replace for longer ones."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c(text), "".join(one), "".join(one.values())) if one else c(text)
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def fold_text(text: str, table: dict[str, str]) -> str:
    """Comparison form of one string, the same as skeleton() of a column."""
    clean = re.sub(INVISIBLE_CLASS, "", unicodedata.normalize("NFKC", text))
    return "".join(table.get(ch, ch) for ch in clean).lower()


def skeleton(text, table: dict[str, str]) -> Column:
    """Comparison form: compatibility composition, invisibles out, look-alikes folded, lower case."""
    return F.lower(fold(strip_invisible(nfkc(text)), table))


def homoglyph_ratio(text, table: dict[str, str]) -> Column:
    """Share of characters that folding changes; empty text gives 0."""
    clean = strip_invisible(nfkc(text))
    return F.when(F.length(clean) > 0, 1 - F.length(F.translate(clean, "".join(table), "")) / F.length(clean)).otherwise(0.0)


def mixed_script(text, table: dict[str, str] | None = None) -> Column:
    """Latin letters together with Cyrillic or Greek ones, in the normalised text without invisibles.

    Letters of other scripts that the table folds to ASCII count as Latin; digits don't.
    """
    t = strip_invisible(nfkc(text))
    disguised = "".join(k for k, v in (table or {}).items() if v.isascii() and k.isalpha() and not unicodedata.name(k, "").startswith(("CYRILLIC", "GREEK", "LATIN")))
    latin = t.rlike(r"\p{IsLatin}" if not disguised else rf"[\p{{IsLatin}}{disguised}]")
    return latin & t.rlike(r"[\p{L}&&[\p{IsCyrillic}\p{IsGreek}]]")


SCRIPTS = ("Latin", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai", "Armenian", "Georgian", "Cherokee")


def script_of(char) -> Column:
    """Script label of one character; digits, marks and the rest are Common."""
    out = None
    for s in SCRIPTS:
        cond = c(char).rlike(rf"\p{{Is{s}}}")
        out = F.when(cond, s) if out is None else out.when(cond, s)
    return out.otherwise("Common")


def osa(a: str, b: str) -> int:
    """Edit distance with adjacent transpositions, each substring edited at most once."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.IntegerType())
def _osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def osa_distance(a, b, most: int | None = None) -> Column:
    """Exact distance; with `most`, NULL where it is surely larger: the plain distance is at most twice this one."""
    if most is None:
        return _osa_udf(c(a), c(b))
    near = F.levenshtein(c(a), c(b), 2 * most) >= 0
    d = _osa_udf(F.when(near, c(a)), F.when(near, c(b)))
    return F.when(d <= most, d)


def cue_count(text, cues: list[str]) -> Column:
    """How many different cues the text contains."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cues]), lambda x: F.contains(c(text), x)))


def weighted_hits(text, lexicon: list[tuple[str, float]]) -> Column:
    """Sum of the weights of contained phrases; each found phrase is blanked out before the next is tried."""
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(float(w)).alias("w")) for p, w in lexicon])
    zero = F.struct(c(text).alias("t"), F.lit(0.0).alias("w"))
    return F.aggregate(
        entries,
        zero,
        lambda acc, e: F.when(
            F.contains(acc["t"], e["p"]), F.struct(F.replace(acc["t"], e["p"], F.lit(" ")).alias("t"), (acc["w"] + e["w"]).alias("w"))
        ).otherwise(acc),
        lambda acc: acc["w"],
    )


def names_whole(text, name: str) -> Column:
    """The full name, or any of its words of 3 letters or more, bounded by non-letters."""
    words = [name] + [w for w in name.split() if len(w) >= 3]
    alt = "|".join(r"\Q" + w.lower() + r"\E" for w in words)
    return F.lower(c(text)).rlike(rf"(?<!\p{{L}})(?:{alt})(?!\p{{L}})")


def first_label(domain) -> Column:
    return F.substring_index(c(domain), ".", 1)


def tld(domain) -> Column:
    return F.substring_index(c(domain), ".", -1)


def extension(filename) -> Column:
    """Lower-case text after the last dot; NULL without one."""
    return F.when(F.contains(c(filename), F.lit(".")), F.lower(F.substring_index(c(filename), ".", -1)))


def double_extension(filename, inner: list[str]) -> Column:
    """A document extension (or nothing) stands before the last extension."""
    parts = F.split(c(filename), r"\.")
    mid = F.lower(F.get(parts, F.size(parts) - 2))
    return (F.size(parts) >= 3) & (mid.isin(*inner) | (mid == ""))


def rtl_override(filename) -> Column:
    return c(filename).rlike("[\\x{202E}\\x{202D}\\x{200F}]")


def digit_dash_ratio(text) -> Column:
    n = F.length(c(text))
    return F.when(n > 0, (n - F.length(F.translate(c(text), "0123456789-", ""))) / n).otherwise(0.0)


def truncate(text, n: int) -> Column:
    return F.when(F.length(c(text)) > n, F.concat(F.substring(c(text), 1, n), F.lit("...[truncated]"))).otherwise(c(text))


# The masking patterns and their marks, applied in this order.
MASKS = [
    (r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]"),
    (r"(\+\d{1,3}[- ]?)?\d{10}|(\d{3}[- .]\d{3}[- .]\d{4})", "[PHONE_REDACTED]"),
    (r"\b(?:\d[ -]*?){13,16}\b", "[CARD_REDACTED]"),
]


def mask_pii(text) -> Column:
    out = c(text)
    for pattern, mark in MASKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def content_hash(data, limit: int = 8 << 20) -> Column:
    """sha256:<hex> of the bytes; empty gives NULL; longer than `limit` hashes the prefix and says so."""
    d = c(data).cast("binary")
    return F.when(F.length(d) == 0, F.lit(None)).when(
        F.length(d) > limit, F.concat(F.lit("sha256:"), F.sha2(F.substring(d, 1, limit), 256), F.lit(f":prefix{limit}"))
    ).otherwise(F.concat(F.lit("sha256:"), F.sha2(d, 256)))


def uuid5(namespace: str, name) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), c(name).cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)

    def layout(x: Column) -> Column:
        v = F.substring(variant, (F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
        return F.concat(
            F.substring(x, 1, 8), F.lit("-"), F.substring(x, 9, 4), F.lit("-5"), F.substring(x, 14, 3), F.lit("-"), v, F.substring(x, 18, 3), F.lit("-"), F.substring(x, 21, 12)
        )

    return let(h, layout)


def round_half_up(x, places: int = 4) -> Column:
    f = float(10**places)
    return F.floor(c(x) * f + 0.5) / f


def canonical_number(x) -> Column:
    """Ten significant digits without trailing zeros; exponent forms stay as they are, minus zero is 0; not finite is an error."""
    v = c(x).cast("double")
    text = F.format_string("%.10g", v)
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    finite = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("a number must be finite"))).otherwise(F.when(F.contains(text, F.lit("e")), text).otherwise(plain))
    return F.when(v == 0, F.lit("0")).when(v.isNotNull(), finite)
