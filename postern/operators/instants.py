"""Mixed timestamp notations and zones to one UTC instant.

A value is read under every notation that can hold it. Its first characters say which pattern that
is; the pattern rewrites it into fixed fields, so a row costs one regular expression, inside the JVM.
What remains open is settled per source (table and host). A source is a mixture of notations, the
COMPONENTS: day or month first in slashed dates, seconds, milliseconds or microseconds in bare
numbers, a compact date or a number in fourteen digits, and the notations that leave nothing open.
The mixture is fitted by expectation-maximisation: every value contributes its likelihood under each
valid reading, a host's documented order enters as a prior, and the posterior chooses the reading.
Readings whose posterior stays below `settled`, local times that occur twice (their first pass is
taken) and local times that the clock skipped are marked ambiguous, with the reason.

Values with the same likelihoods have the same posterior, so the fit needs one count per source and
likelihood class (CLASSES), combined before the shuffle; it runs inside each source's row and nothing
is collected.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import materialize

# Offsets of the zone abbreviations in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
    "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ZONE = r"([A-Za-z]{1,5}|[+-]\d{2}:?\d{2}|\[[^\]]+\])?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"

# family -> (pattern, fields year|month|day|hour|minute|second|fraction|zone|half)
PATTERNS = {
    "iso": (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]\s*{CLOCK}\s*{ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "rfc": (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?,?\s+(\d{{4}}|\d{{2}})\s+{CLOCK}\s*{ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    "asctime": (rf"^[A-Za-z]{{3,9}},?\s+([A-Za-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{CLOCK}\s+(?:{ZONE}\s+)?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6|$7|"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{CLOCK}\s*{ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),?\s+{CLOCK}\s*([AaPp][Mm])?\s*{ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
}


# A mixture's components, and for each class of values the likelihood of its valid readings.
COMPONENTS = ("iso", "rfc", "asctime", "compact", "dotted", "slash_dmy", "slash_mdy", "epoch_s", "epoch_ms", "epoch_us")
UNLIKELY = 1e-6  # a number of this length in another unit would lie far outside the years mail has been sent in
CLASSES = {
    **{k: {k: 1.0} for k in ("iso", "rfc", "asctime", "compact", "dotted", "slash_dmy", "slash_mdy")},
    "slash_both": {"slash_dmy": 1.0, "slash_mdy": 1.0},
    "slash_same": {"slash_dmy": 1.0, "slash_mdy": 1.0},  # both readings are the same day
    "digits_s": {"epoch_s": 1.0, "epoch_ms": UNLIKELY, "epoch_us": UNLIKELY},
    "digits_ms": {"epoch_ms": 1.0, "epoch_s": UNLIKELY, "epoch_us": UNLIKELY},
    "digits_us": {"epoch_us": 1.0, "epoch_s": UNLIKELY, "epoch_ms": UNLIKELY},
    "digits_14": {"compact": 1.0, "epoch_ms": UNLIKELY},
}


def _family(s: Column) -> Column:
    second, third = F.substring(s, 2, 1), F.substring(s, 3, 1)
    return (
        F.when(s.rlike(r"^\d{9,17}$") & (F.length(s) != 14), "epoch")
        .when((second == "/") | (third == "/"), "slash")
        .when((second == ".") | (third == "."), "dotted")
        .when(F.substring(s, 5, 1) == "-", "iso")
        .when(s.rlike(r"^\d{8}"), "compact")
        .when(s.rlike(r"^[A-Za-z]{3,9},?\s+[A-Za-z]"), "asctime")
        .otherwise("rfc")
    )


def _fields(s: Column, family: Column) -> Column:
    chain = None
    for name, (pattern, to) in PATTERNS.items():
        rewritten = F.regexp_replace(s, pattern, to)
        chain = F.when(family == name, rewritten) if chain is None else chain.when(family == name, rewritten)
    return F.split(chain, r"\|")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _days_valid(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return m.between(1, 12) & d.between(1, 31) & (d <= last) & y.between(1, 9999)


def parse(df: DataFrame, value: str) -> DataFrame:
    """Adds the fields of `value`: family, y, a, b, day parts, zone; a is the month and b the day as written.

    NULL, blank and unreadable values get a NULL family.
    """
    text = F.trim(F.when(F.col(value).contains("("), F.regexp_replace(value, r"\([^()]*\)", " ")).otherwise(F.col(value)))
    df = df.withColumn("_t", text).withColumn("_family", _family(F.col("_t"))).withColumn("_f", _fields(F.col("_t"), F.col("_family")))
    ok = F.size("_f") == 9
    part = lambda i: F.when(ok, F.col("_f")[i])
    year = _int(part(0))
    named = F.instr(F.lit(MONTHS), F.lower(part(1)))
    month = F.when(part(1).rlike("^[A-Za-z]"), F.when((named > 0) & ((named - 1) % 3 == 0), ((named + 2) / 3).cast("int"))).otherwise(_int(part(1)))
    hour, half = _int(part(3)), F.upper(part(8))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return df.select(
        *[c for c in df.columns if c not in ("_f",)],
        F.when(F.length(part(0)) == 2, year + 2000).otherwise(year).alias("_y"),
        month.alias("_a"),
        _int(part(2)).alias("_b"),
        hour.alias("_h"),
        _int(part(4)).alias("_mi"),
        F.when(part(5) == "", 0).otherwise(_int(part(5))).alias("_s"),
        F.when(part(6) == "", 0).otherwise(_int(F.substring(F.rpad(part(6), 3, "0"), 1, 3))).alias("_ms"),
        part(7).alias("_zone"),
    )


def _clock_valid() -> Column:
    return F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 60)


def likelihood_class(parsed: DataFrame) -> DataFrame:
    """Adds _class, the value's class of likelihoods (a key of CLASSES); NULL where no reading is valid."""
    y, a, b, family = F.col("_y"), F.col("_a"), F.col("_b"), F.col("_family")
    clock = F.coalesce(_clock_valid(), F.lit(False))
    dmy = clock & F.coalesce(_days_valid(y, a, b), F.lit(False))
    mdy = clock & (family == "slash") & F.coalesce(_days_valid(y, b, a), F.lit(False))
    n = F.length("_t")
    kind = (
        F.when(family == "epoch", F.when(n <= 11, "digits_s").when(n <= 14, "digits_ms").otherwise("digits_us"))
        .when(family == "slash", F.when(dmy & mdy, F.when(a == b, "slash_same").otherwise("slash_both")).when(dmy, "slash_dmy").when(mdy, "slash_mdy"))
        .when(dmy, F.when((family == "compact") & F.col("_t").rlike(r"^\d{14}$"), "digits_14").otherwise(family))
    )
    return parsed.withColumn("_class", kind)


def mixtures(values: DataFrame, sites: DataFrame, prior: float = 50.0, rounds: int = 25) -> DataFrame:
    """(src, host, read): each source's fitted mixture, as the reading and posterior of every class.

    `values` has src, host and _class. Every component starts with one observation, the documented
    order of slashed dates with `prior`. A value without host belongs to no source.
    """
    counts = values.filter("host is not null").groupBy("src", "host", "_class").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # At most one entry per class. Unreadable values drop out here: a filter would be pushed down and parse every value again.
    held = counts.groupBy("src", "host").agg(F.map_from_entries(F.collect_list(F.when(F.col("_class").isNotNull(), F.struct("_class", "n")))).alias("held"))
    known = held.join(sites.select(F.col("byhost").alias("host"), F.lower("dayorder").alias("dayorder")), "host", "left")
    before = [F.when(F.col("dayorder") == k[-3:], prior).otherwise(1.0) if k.startswith("slash") else F.lit(1.0) for k in COMPONENTS]
    n = {c: F.coalesce(F.try_element_at("held", F.lit(c)), F.lit(0.0)) for c in CLASSES}
    total = sum(before, F.lit(0.0)) + sum(n.values(), F.lit(0.0))
    share = lambda pi, k: F.get(pi, F.lit(COMPONENTS.index(k)))
    joint = lambda pi, c: {k: share(pi, k) * like for k, like in CLASSES[c].items()}

    def responsibility(pi: Column, c: str, k: str) -> Column:
        j = joint(pi, c)
        return F.lit(1.0) if len(j) == 1 else j[k] / sum(j.values(), F.lit(0.0))

    def maximise(pi: Column, _: Column) -> Column:
        return F.array(*[(p + sum((n[c] * responsibility(pi, c, k) for c in CLASSES if k in CLASSES[c]), F.lit(0.0))) / total for k, p in zip(COMPONENTS, before, strict=True)])

    start = F.array(*[p / sum(before, F.lit(0.0)) for p in before])
    fitted = materialize(known.select("src", "host", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, maximise).alias("pi")), "mixtures")
    pi = F.col("pi")
    best = {c: F.greatest(*[F.struct(responsibility(pi, c, k).alias("posterior"), F.lit(-i).alias("rank"), F.lit(k).alias("component")) for i, k in enumerate(CLASSES[c])]) if len(CLASSES[c]) > 1 and c != "slash_same" else None for c in CLASSES}
    entries = [x for c, b in best.items() for x in (F.lit(c), F.struct(F.lit(next(iter(CLASSES[c]))).alias("component"), F.lit(1.0).alias("posterior")) if b is None else F.struct(b["component"].alias("component"), b["posterior"].alias("posterior")))]
    return fitted.select("src", "host", F.create_map(*entries).alias("read"))


def _unfitted() -> Column:
    """Readings without a source's mixture: every component is as likely."""
    entries = []
    for c, like in CLASSES.items():
        k = max(like, key=like.get)
        entries += [F.lit(c), F.struct(F.lit(k).alias("component"), F.lit(1.0 if c == "slash_same" else like[k] / sum(like.values())).alias("posterior"))]
    return F.create_map(*entries)


def normalise(values: DataFrame, sites: DataFrame, settled: float = 0.95) -> DataFrame:
    """(src, rec_no, host, value) to (src, rec_no, utc_ms, family, posterior, ambiguous, reason).

    Every value that states a valid date and time has a row; `family` is the component it was read
    by. Without a zone it is local time of its host's clock zone, a repeated hour its first pass
    (reason `repeated`), a skipped one read with the offset before the change (`skipped`); if the
    host has no known zone the value states no instant and has no row. NULL, blank, negative and
    impossible values have none. Offsets beyond 18 hours and unknown abbreviations state nothing.
    """
    parsed = likelihood_class(parse(values, "value"))
    fitted = mixtures(parsed, sites)
    y, a, b = F.col("_y"), F.col("_a"), F.col("_b")
    zone, named, local = F.col("_zone"), F.col("_named"), F.col("_local")
    joined = parsed.join(fitted, ["src", "host"], "left").join(
        sites.select(F.col("byhost").alias("host"), "clockzone"), "host", "left"
    )
    chosen = F.coalesce(F.try_element_at("read", F.col("_class")), F.try_element_at(_unfitted(), F.col("_class")))
    read = joined.select(
        "src", "rec_no", "_t", "_y", "_a", "_b", "_ms", "_zone", "clockzone", chosen.alias("_read"),
        (F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")).alias("_clock"),
        F.when(zone == "", F.col("clockzone")).when(zone.startswith("["), F.regexp_replace(zone, r"[\[\]]", "")).alias("_named"),
        F.regexp_replace(zone, ":", "").alias("_digits"),
    )
    digits = F.col("_digits")
    minutes = F.when(zone.rlike(r"^[+-]"), F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int"))
    read = read.select("*", F.col("_read.component").alias("family"), F.col("_read.posterior").alias("posterior"), minutes.alias("_minutes"))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    swapped = F.col("family") == "slash_mdy"
    # The fields of a slashed date were laid out day first: a is the second number, b the first.
    read = read.withColumns(
        {
            "_day": F.when(swapped, F.make_date(y, b, a)).when(~F.col("family").startswith("epoch"), F.make_date(y, a, b)),
            "_offset": F.when(F.col("_minutes") <= 18 * 60, F.when(zone.startswith("-"), -F.col("_minutes")).otherwise(F.col("_minutes"))).when(
                zone.rlike(r"^[A-Za-z]"), F.try_element_at(table, F.upper(zone))
            ),
            "_named": F.when(named.isin(sorted(zoneinfo.available_timezones())), named),
        }
    )
    read = read.withColumn("_local", F.unix_date("_day").cast("long") * 86400 + F.col("_clock"))
    read = read.withColumn("_utc", F.when(named.isNotNull(), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), named))).otherwise(local - F.col("_offset") * 60))
    number, utc = F.col("_t").try_cast("bigint"), F.col("_utc")
    epoch = F.when(F.col("family") == "epoch_s", number * 1000).when(F.col("family") == "epoch_ms", number).when(F.col("family") == "epoch_us", F.expr("try_cast(_t as bigint) div 1000"))
    shown = lambda later: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc + later), named))
    # Clocks are put back by an hour or, on one island, half of it.
    reason = (
        F.when(named.isNotNull() & (shown(0) != local), "skipped")
        .when(named.isNotNull() & ((shown(3600) == local) | (shown(1800) == local)), "repeated")
        .when(F.col("posterior") < settled, "order")
    )
    return (
        read.withColumn("utc_ms", F.coalesce(epoch, utc * 1000 + F.col("_ms")))
        # The row number keeps the optimiser from copying the whole reading into a pushed-down filter.
        .withColumn("_row", F.monotonically_increasing_id())
        .filter(F.col("utc_ms").isNotNull() & (F.col("_row") >= 0))
        .withColumn("reason", reason)
        .select("src", "rec_no", "utc_ms", "family", "posterior", F.col("reason").isNotNull().alias("ambiguous"), "reason")
    )


def mail_times(messages: DataFrame, hops: DataFrame) -> DataFrame:
    """(src, rec_no, host, value) of the dates of messages and hops."""
    return messages.select(
        F.lit("messages").alias("src"), F.col("msg_no").alias("rec_no"), F.col("originhost").alias("host"), F.col("dateheader").alias("value")
    ).unionByName(
        hops.select(F.lit("hops").alias("src"), F.col("hop_no").alias("rec_no"), F.col("byhost").alias("host"), F.col("timestampraw").alias("value"))
    )
