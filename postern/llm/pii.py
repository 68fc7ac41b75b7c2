"""Personal information in free text: bootstrapped contextual extraction.

1. *Candidates.* One pass over every text proposes spans by loose surface grammars: addresses with
   an at-sign however spelled, runs of digits (and capitals), house number with a capitalised name,
   adjacent capitalised words. Most number runs and capitalised words are no personal data.
2. *Patterns.* A candidate carries lexical patterns: the words left of it, the words right of it,
   and its own shape (digit layout, street type, given name).
3. *Graph.* Candidates with the same patterns behave alike, so the pattern-instance graph is held
   between patterns and distinct signatures with counts; this compression is exact.
4. *Bootstrapping.* Seed entities that prove themselves (plain addresses, international numbers,
   identity numbers with valid check letters, names after a title, known street types) give their
   patterns confidence: the share of a pattern's instances that are accepted. Signatures whose
   patterns are confident are accepted and raise further patterns, for a few rounds; so the layouts
   and contexts that no seed shows are found through the contexts and layouts they share with seeds.
5. Accepted spans are reported and replaced by typed placeholders.

All counts cover all texts. Scoring joins are on patterns; counts are combined before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import materialize

# Seed titles and seed street types, and particles of surnames.
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "herr", "herrn", "frau", "monsieur", "madame", "mme", "mlle", "señor", "señora", "sr", "sra", "señorita"]
STREET_SEEDS = ["st.", "street", "road", "lane", "avenue", "rue", "calle", "straße", "str.", "strasse"]
PARTICLES = "van der|van den|van|von der|von|de la|de los|del|de|della|di|da|dos|zu|ter|ten"

# Latin letters of all alphabets, by rule.
_MORE = [chr(c) for c in range(0x100, 0x250)]
CAP, LOW = "A-ZÀ-ÖØ-Þ" + "".join(c for c in _MORE if c.isupper()), "a-zà-öø-ÿ'’" + "".join(c for c in _MORE if c.islower())
_WORD = f"[{CAP}][{LOW}]+"
_NO_TITLE = r"(?!(?:" + "|".join({t for x in TITLES for t in (x, x.capitalize())}) + r")\b)"
_AT = r"(?:@| @ | ?[\[(] ?(?:at|AT) ?[\])] ?)"
_DOT = r"(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)"
EMAIL = re.compile(
    rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*(?:{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)*?{_DOT}[A-Za-z]{{2,}}(?![\w@])"
    r"| (?:AT|at) [A-Za-z0-9][\w-]*(?: (?:DOT|dot) [A-Za-z0-9][\w-]*)*? (?:DOT|dot) [A-Za-z]{2,}(?![\w@]))"
)
NUMBER = re.compile(
    r"(?<![\w@#+])(?<!\w[.,/:-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|(?:\+\d+|\(\d{1,4}\))(?:[ ./-]?(?:\(\d{1,4}\)|\d+))*"
    r"|(?:[A-Z]{2} ?)?\d+(?:[ ./-]?(?:\(\d{1,4}\)|\d+)|[ -]?[A-Z](?= \d)|-?[A-Z](?![A-Za-z]))*"
    r")(?!\w|[.,:/-]\d)"
)
NAME = re.compile(
    rf"(?<![\w-])(?=[{CAP}])(?=({_NO_TITLE}(?:[{CAP}]{{3,}}(?:-[{CAP}]{{3,}})*, {_WORD}"
    rf"|(?:{_WORD}|[{CAP}]\.)(?: [{CAP}]\.)* (?:(?:{PARTICLES}) )?{_WORD}(?:-{_WORD})*)(?![\w-])))"
)
_HOUSE, _END = r"\d{1,4}[a-z]?", r"(?![\w-]|[./ ]\d|, ?\d)"
STREETS = [
    ("lead", re.compile(rf"(?<![\w.,/-])(?:Flat {_HOUSE}, )?{_HOUSE}(?: bis| ter)?,? ([a-zà-ÿ]{{3,}}) (?:des?|du|de la|de l['’]) ?[{CAP}][\w-]+")),
    ("type", re.compile(rf"(?<!\d )(?<![\w.,/-])(?:Flat {_HOUSE}, )?{_HOUSE} [{CAP}][{LOW}-]+ ({_WORD}\.?)(?!\w)")),
    ("lead", re.compile(rf"(?<!\w)(Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Hinter dem|Unter den) {_WORD}(?: {_WORD})? {_HOUSE}{_END}")),
    ("lead", re.compile(rf"(?<!\w)({_WORD}\.?) (?:de (?:la |los |las )?|del )?{_WORD}(?:-{_WORD})*(?:,| núm\.| nº| n\.º) ?{_HOUSE}{_END}")),
    ("tail", re.compile(rf"(?<!\w)[{CAP}][{LOW}-]*([{LOW}]{{4}}\.?) {_HOUSE}{_END}")),
]
CLAUSE = re.compile(r"[\r\n|]| / ")
AFTER = re.compile(r"[\r\n|]| / |[.!?](?:\s|$)")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
# Prefix letters that are issued, and QQ, which is kept for examples.
INSURANCE = re.compile(r"(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z])\d{6}[A-D]")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _proves_identity(val: str) -> bool:
    """Seeds among identity numbers: layouts with a check letter, a check key or a reserved alphabet."""
    bare = re.sub(r"[ -]", "", val)
    if INSURANCE.fullmatch(bare):
        return True
    if re.fullmatch(r"\d{8}[A-Z]", bare):
        return DNI_LETTERS[int(bare[:8]) % 23] == bare[8]
    return bool(re.fullmatch(r"[12]\d{14}", bare)) and 97 - int(bare[:13]) % 97 == int(bare[13:])


def _shape(val: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", val))


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, shape, seed kind or '') of every candidate span of a text."""
    out, taken = [], []
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    has_digit = any(c.isdigit() for c in text)
    if "@" in text or "at" in text or "AT" in text:
        for m in EMAIL.finditer(text):
            v = m[0]
            kind = "plain" if "@" in v and " " not in v else "spaced" if "@" in v else "bracket" if "]" in v or ")" in v else "words"
            out.append((m.start(), m.end(), "email", kind, "email" if kind == "plain" else ""))
            taken.append(m.span())
    if has_digit:
        for form, rx in STREETS:
            for m in rx.finditer(text):
                if free(*m.span()):
                    t, end = m[1].lower(), m.end()
                    if t.endswith(".") and len(t) > 4 and form == "type":  # the sentence's full stop
                        t, end = t[:-1], end - 1
                    shape = f"{form}:{t}"
                    seed = t in STREET_SEEDS or (form == "tail" and t in ("raße", "str.", "asse"))
                    out.append((m.start(), end, "street", shape, "street" if seed and t != "asse" else ""))
                    taken.append(m.span())
        for m in NUMBER.finditer(text):
            v = m[0]
            digits = sum(c.isdigit() for c in v)
            # Shorter runs are no number of a person, except the layout with two letters before and one after.
            short = digits == 6 and re.fullmatch(r"[A-Z]{2}[\d ]+[A-Z]", v)
            if (7 <= digits <= 16 or short) and free(*m.span()):
                seed = "phone" if v[0] == "+" else "idnum" if _proves_identity(v) else ""
                out.append((m.start(), m.end(), "number", _shape(v), seed))
                taken.append(m.span())
    for m in NAME.finditer(text):
        v = m[1]
        a, b = m.start(1), m.end(1)
        if free(a, b):
            given = v.split(", ")[1] if ", " in v else v.split(" ")[0]
            before = TOKEN.findall(text[max(0, a - 14) : a])
            titled = any(t.lower() in TITLES for t in before[-2:] if t != ".")
            out.append((a, b, "name", "A." if given.endswith(".") else given.lower(), "person" if titled else ""))
    return out


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to three tokens left and two right of a span, within its line; '' where there are none."""
    left = CLAUSE.split(text[max(0, start - 60) : start])[-1]
    right = AFTER.split(text[end : end + 40], maxsplit=1)[0]
    norm = lambda t: "0" if t.isdigit() else t.lower()
    return " ".join(norm(t) for t in TOKEN.findall(left)[-3:]), " ".join(norm(t) for t in TOKEN.findall(right)[:2])


OCCURRENCE = "src string, rec_no bigint, start int, len int, val string, ctype string, lctx string, rctx string, shape string, seed string"


def occurrences(texts: DataFrame) -> DataFrame:
    """Candidates of (src, rec_no, text) with their patterns; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for src, no, text in zip(b["src"], b["rec_no"], b["text"], strict=True):
                for start, end, ctype, shape, seed in candidates(text):
                    rows.append((src, no, start, end - start, text[start:end], ctype, *_context(text, start, end), shape, seed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OCCURRENCE.split(", ")])

    return texts.filter(F.length("text") > 0).mapInPandas(run, OCCURRENCE)


def _slots() -> Column:
    """The patterns of a signature: contexts from long to short, and the shape."""
    one = lambda slot, c: F.struct(F.lit(slot).alias("slot"), c.alias("pat"))
    left, right = F.col("lctx"), F.col("rctx")
    return F.filter(
        F.array(
            one("L3", left),
            one("L2", F.substring_index(left, " ", -2)),
            one("L1", F.substring_index(left, " ", -1)),
            one("R2", right),
            one("R1", F.substring_index(right, " ", 1)),
            one("S", F.col("shape")),
        ),
        lambda x: (x["slot"] == "S") | x["pat"].rlike(r"\p{L}"),
    )


def decide(occ: DataFrame, thresholds: tuple[float, ...] = (0.12, 0.12, 0.2, 0.35, 0.5, 0.5), support: int = 4, known: int = 20) -> DataFrame:
    """(ctype, lctx, rctx, shape, kind, score): accepted signatures, one scoring round per threshold.

    A pattern's confidence for a kind is its accepted instances / all instances (one pseudo-count
    against it). Seeds are a part of the instances at first, so thresholds start low and rise while
    true patterns fill up; every round decides anew, so an early error can be taken back. The longest
    context with `support` instances counts on each side. A context with `known` instances and next
    to none accepted is negative: it rejects, and its instances don't count against the shape. Names have
    no negative contexts: a given name identifies by itself, which a layout of digits does not.
    """
    keys = ["ctype", "lctx", "rctx", "shape"]
    is_seed = lambda *k: F.sum(F.col("seed").isin(*k).cast("long"))
    sigs = occ.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (is_seed("email", "phone", "person", "street")).alias("seed_a"), is_seed("idnum").alias("seed_b"))
    sigs = materialize(sigs.withColumn("sig", F.xxhash64(*keys)), "signatures")
    # State: the share of a signature's instances that are accepted as its first and second kind.
    state = sigs.select("sig", (F.col("seed_a") / F.col("n")).alias("a"), (F.col("seed_b") / F.col("n")).alias("b"), F.lit(False).alias("neg"))
    edges = materialize(sigs.select("sig", "ctype", "n", "seed_a", "seed_b", F.explode(_slots()).alias("x")).select("sig", "ctype", "n", "seed_a", "seed_b", "x.*"), "edges")
    slots = ("L3", "L2", "L1", "R2", "R1", "S")
    pick = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    for r, accept in enumerate(thresholds):
        scored = edges.join(state, "sig")
        counted = F.when((F.col("slot") == "S") & F.col("neg"), 0).otherwise(F.col("n"))
        conf = scored.groupBy("ctype", "slot", "pat").agg(
            F.sum("n").alias("sup"),
            (F.sum(counted * F.col("a")) / (F.sum(counted) + 1)).alias("ca"),
            (F.sum(counted * F.col("b")) / (F.sum(counted) + 1)).alias("cb"),
        )
        conf = conf.filter((F.col("slot") == "S") | (F.col("sup") >= support))
        per = edges.join(conf, ["ctype", "slot", "pat"]).groupBy("sig", "ctype").agg(
            F.max(F.col("seed_a") / F.col("n")).alias("sa"),
            F.max(F.col("seed_b") / F.col("n")).alias("sb"),
            *[pick(s, c).alias(f"{s}_{c}") for s in slots for c in ("ca", "cb", "sup")],
        )

        def sides(c: str) -> Column:
            return F.greatest(F.coalesce(f"L3_{c}", f"L2_{c}", f"L1_{c}"), F.coalesce(f"R2_{c}", f"R1_{c}"))

        context = F.coalesce(F.greatest(sides("ca"), sides("cb")), F.lit(1.0))
        negative = (F.col("ctype") != "name") & (context < 0.05) & (sides("sup") >= known)

        def score(c: str) -> Column:
            return F.when(negative, 0.0).otherwise(F.greatest(F.coalesce(sides(c), F.lit(0.0)), F.coalesce(f"S_{c}", F.lit(0.0))))

        grown = per.select("sig", "sa", "sb", negative.alias("neg"), score("ca").alias("xa"), score("cb").alias("xb"))
        a_wins = (F.col("xa") >= accept) & (F.col("xa") >= F.col("xb"))
        b_wins = (F.col("xb") >= accept) & (F.col("xb") > F.col("xa"))
        state = materialize(
            grown.select(
                "sig",
                F.when(a_wins, 1.0).when(b_wins, 0.0).otherwise(F.col("sa")).alias("a"),
                F.when(b_wins, 1.0).when(a_wins, 0.0).otherwise(F.col("sb")).alias("b"),
                "neg",
                F.greatest("xa", "xb").alias("score"),
                F.when(a_wins, F.lit("a")).when(b_wins, F.lit("b")).alias("won"),
            ),
            f"state{r}",
        )
    kind = F.when(F.col("ctype") == "email", "email").when(F.col("ctype") == "name", "person").when(F.col("ctype") == "street", "street").when(F.col("won") == "a", "phone").otherwise("idnum")
    return sigs.join(state.filter(F.col("won").isNotNull()), "sig").select(*keys, kind.alias("kind"), "score")


def spans(texts: DataFrame, **options) -> DataFrame:
    """(src, rec_no, start, len, kind, val): accepted spans; a seed is accepted by itself."""
    occ = materialize(occurrences(texts), "occurrences")
    won = materialize(decide(occ, **options), "accepted").select("ctype", "lctx", "rctx", "shape", "kind")
    seed = F.when(F.col("seed") != "", F.col("seed"))
    return (
        occ.join(won, ["ctype", "lctx", "rctx", "shape"], "left")
        .select("src", "rec_no", "start", "len", F.coalesce(seed, "kind").alias("kind"), "val")
        .filter(F.col("kind").isNotNull())
    )


def mail_texts(parts: DataFrame, cases: DataFrame) -> DataFrame:
    """(src, rec_no, text) of bodies and subjects."""
    return parts.select(F.lit("parts").alias("src"), F.col("part_no").alias("rec_no"), F.col("body").alias("text")).unionByName(
        cases.select(F.lit("cases").alias("src"), F.col("case_no").alias("rec_no"), F.col("subject").alias("text"))
    )


def found(texts: DataFrame) -> DataFrame:
    """(src, rec_no, kind, val): one row per record, kind and distinct text."""
    return spans(texts).select("src", "rec_no", "kind", "val").distinct()


def masked(texts: DataFrame) -> DataFrame:
    """(src, rec_no, text, n_masked): texts with every accepted span replaced by [KIND].

    Where spans overlap, the one that starts first (then the longer) is replaced. Null and empty
    texts stay as they are. A record's spans come together in one row, as its text does.
    """
    per = spans(texts).groupBy("src", "rec_no").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "kind"))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("k"))
    joined = texts.join(per, ["src", "rec_no"], "left")
    built = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
                (s["start"] - s["neg"]).alias("at"),
                (acc["k"] + 1).alias("k"),
            )
        ),
        lambda acc: F.struct(F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))).alias("text"), acc["k"].alias("k")),
    )
    out = joined.select("src", "rec_no", "text", F.when(F.col("spans").isNotNull(), built).alias("b"))
    return out.select("src", "rec_no", F.coalesce("b.text", "text").alias("text"), F.coalesce("b.k", F.lit(0)).alias("n_masked"))
