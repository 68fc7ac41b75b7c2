"""Fields of message headers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postern.functions.text import c
from postern.session import let


def unfold(block) -> Column:
    """Continuation lines joined with one space."""
    return F.regexp_replace(c(block), "\r?\n[ \t]+", " ")


def address_domain(value) -> Column:
    """Domain after the last at-sign of the angle part (or the whole), lower case, no leading dot or dash; NULL without one."""
    addr = address_only(value)
    domain = F.regexp_replace(F.lower(F.trim(F.substring_index(addr, "@", -1))), r"^[.\-]+", "")
    return F.when(F.contains(addr, F.lit("@")) & (domain != ""), domain)


def address_only(value) -> Column:
    """Text in the first angle brackets, an unclosed one up to the end; else the whole, trimmed."""
    v = c(value)
    return F.when(F.contains(v, F.lit("<")), F.trim(F.regexp_extract(v, r"(?s)<([^>]*)", 1))).otherwise(F.trim(v))


def display_name(value) -> Column:
    return F.when(F.contains(c(value), F.lit("<")), F.trim(F.regexp_replace(F.substring_index(c(value), "<", 1), '^[\\s"]+|[\\s"]+$', ""))).otherwise(F.lit(""))


def message_ids(value) -> Column:
    """Ids in angle brackets, brackets stripped."""
    return F.regexp_extract_all(F.coalesce(c(value), F.lit("")), F.lit("<([^>]*)>"), F.lit(1))


def auth_result(header, method: str) -> Column:
    """Result of a method in an authentication header: after its next equals sign, until blank or semicolon."""
    v = F.regexp_extract(F.lower(c(header)), rf"(?s){method}.*?=([^\s;]*)", 1)
    return F.when(v != "", v)


def first_auth_result(headers, method: str) -> Column:
    """Result of a method in the first of several authentication headers that states one; no header gives NULL."""
    return F.get(F.filter(F.transform(c(headers), lambda h: auth_result(h, method)), lambda v: v.isNotNull()), F.lit(0))


def auth_component(header, key: str) -> Column:
    """Value of the first `key=value` segment."""
    parts = F.transform(F.split(c(header), ";"), lambda s: F.trim(s))
    hit = F.get(F.filter(parts, lambda s: F.lower(s).startswith(key + "=")), F.lit(0))
    return F.regexp_extract(hit, r"=\s*([^\s]*)", 1)


def spf_verdict(received_spf, auth_header) -> Column:
    """First word of Received-SPF, else the spf result of the authentication header; fail is tested first."""
    def normal(v: Column) -> Column:
        out = None
        for x in ("fail", "pass", "neutral", "none", "temperror", "permerror"):
            out = F.when(F.contains(v, F.lit(x)), x) if out is None else out.when(F.contains(v, F.lit(x)), x)
        return out

    return F.coalesce(normal(F.lower(F.regexp_extract(c(received_spf), r"^\s*(\w+)", 1))), normal(auth_result(auth_header, "spf")))


def spf_contradiction(received_spf, auth_header) -> Column:
    """Received-SPF and the authentication header both state a verdict, and not the same one."""
    a, b = spf_verdict(received_spf, F.lit(None).cast("string")), spf_verdict(F.lit(None).cast("string"), auth_header)
    return F.coalesce(a != b, F.lit(False))


def dkim_domain(signature) -> Column:
    """Domain of a signature's first d= tag, lower case."""
    v = F.regexp_extract(F.lower(c(signature)), r"(?s)^(?:(?!d=).)*d=\s*([\p{L}\p{N}.\-]*)", 1)
    return F.when(v != "", v)


def parameter(value, name: str) -> Column:
    """A header parameter, quoted or bare, lower-cased name; NULL without it."""
    v = F.regexp_extract(c(value), rf"""(?i)(?:^|;)\s*{name}\*?\s*=\s*(?:"([^"]*)"|([^;\s]*))""", 1)
    w = F.regexp_extract(c(value), rf"""(?i)(?:^|;)\s*{name}\*?\s*=\s*(?:"([^"]*)"|([^;\s]*))""", 2)
    return F.when(v != "", v).when(w != "", w)


# Charsets that are decoded as named; others are read as utf-8.
CHARSETS = [
    "utf-8", "us-ascii", "iso-8859-1", "iso-8859-2", "iso-8859-15", "windows-1250", "windows-1251", "windows-1252", "utf-16", "utf-16le", "utf-16be",
    "gb2312", "big5", "shift_jis", "koi8-r",
]


def charset(value) -> Column:
    v = F.lower(parameter(value, "charset"))
    return F.when(v.isin(CHARSETS), v).otherwise("utf-8")


# Zone names that stand for an offset, and names of regions, whose offset follows the date.
US_ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700", "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000"}
REGIONS = {"CET": "Europe/Paris", "CEST": "Europe/Paris", "WET": "Europe/Lisbon", "WEST": "Europe/Lisbon", "EET": "Europe/Bucharest", "EEST": "Europe/Bucharest", "MSK": "Europe/Moscow", "JST": "Asia/Tokyo", "AKST": "America/Anchorage", "AKDT": "America/Anchorage"}
DATE = r"^(?:([A-Za-z]+), ?)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}):(\d{2})(?::(\d{2}))? (\S+)$"
MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _fields(s: Column) -> Column:
    """[weekday, day, month, year, hour, minute, second, zone] of a text in DATE's form; else fewer."""
    return F.split(F.regexp_replace(s, DATE, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|")


def _local_seconds(f: Column, clamp: bool = True) -> Column:
    """Seconds since 1970 of date fields, zone aside; NULL if invalid. With `clamp` days up to the 31st become the month's last day, else they are invalid."""
    num = lambda i: F.get(f, F.lit(i)).try_cast("int")
    at = F.instr(F.lit(MONTH_NAMES), F.initcap(F.get(f, F.lit(2))))
    month = F.when((at > 0) & ((at - 1) % 3 == 0), ((at + 2) / 3).cast("int"))
    ok = (F.size(f) == 8) & month.isNotNull() & num(1).between(1, 31) & (num(3) >= 1) & (num(4) <= 23) & (num(5) <= 59) & (F.coalesce(num(6), F.lit(0)) <= 59)
    last = lambda first: F.day(F.last_day(first))
    day = lambda first: F.unix_date(first) + (F.least(num(1), last(first)) if clamp else F.when(num(1) <= last(first), num(1))) - 1
    return let(F.when(ok, F.make_date(num(3), month, F.lit(1))), day).cast("bigint") * 86400 + num(4) * 3600 + num(5) * 60 + F.coalesce(num(6), F.lit(0))


def _offset_seconds(zone: Column) -> Column:
    digits = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
    return F.when(zone.rlike(r"^[+-]\d{4}$") & (digits <= 18 * 3600) & (F.substring(zone, 4, 2) <= "59"), F.when(zone.startswith("-"), -digits).otherwise(digits))


def header_date(value, tolerant: bool = True) -> Column:
    """Instant of an RFC 5322 date; NULL if it can't be read.

    Any weekday of 3 to 12 letters is passed over; seconds may be absent; zones are offsets, names
    of US zones, UT, Z, or names of regions. `tolerant` also passes over comments, repeated blanks
    and letter case; without it the text must have the exact form, and days up to the 31st stand for
    the last day of a shorter month.
    """
    s = F.trim(c(value))
    if tolerant:
        s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for kv in US_ZONES.items() for x in kv])
    regions = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])

    def instant(f: Column) -> Column:
        weekday, month, zone = (F.get(f, F.lit(i)) for i in (0, 2, 7))
        named = F.upper(zone) if tolerant else zone
        exact = F.lit(True) if tolerant else F.contains(F.lit(MONTH_NAMES), month)
        fixed = F.coalesce(zone if tolerant else F.when(zone.rlike(r"^[+-]"), zone), F.lit(""))
        offset = _offset_seconds(F.coalesce(F.try_element_at(table, named), fixed))
        local = F.when(exact & ((weekday == "") | F.length(weekday).between(3, 12)), _local_seconds(f, clamp=not tolerant))
        return let(local, lambda t: F.coalesce(F.timestamp_seconds(t - offset), F.to_utc_timestamp(F.timestamp_seconds(t), F.try_element_at(regions, named))))

    return let(_fields(s), instant)


def scoring_date(value) -> Column:
    """Instant of a date as the scoring reads it: the last word is the zone (an offset, GMT, UT, UTC, Z or a military letter), a weekday must be the right one."""
    d = F.regexp_replace(F.trim(c(value)), r"\s+", " ")

    def instant(f: Column) -> Column:
        weekday, zone = F.get(f, F.lit(0)), F.get(f, F.lit(7))
        right = lambda t: (weekday == "") | (F.lower(weekday) == F.lower(F.date_format(F.timestamp_seconds(t), "EEE")))
        return let(_local_seconds(f), lambda t: F.when(right(t), F.timestamp_seconds(t - _offset_seconds(zone))))

    def read(d: Column) -> Column:
        word = F.substring_index(d, " ", -1)
        zone = F.when(word.rlike(r"^[+-]\d{4}$"), word).when(F.upper(word).isin("GMT", "UT", "UTC"), "+0000").otherwise(F.when(F.length(word) == 1, military_offset(word)))
        body = F.regexp_replace(F.regexp_extract(d, r"^(.*) [^ ]*$", 1), r"(?<=.) \(.*$", "")
        return let(_fields(F.concat(body, F.lit(" "), zone)), instant)

    return let(d, read)


def military_offset(letter) -> Column:
    """Offset of a military zone letter; letters that need two digits can't be read and give NULL."""
    l = F.upper(c(letter))  # noqa: E741
    early, late = F.instr(F.lit("ABCDEFGHI"), l), F.instr(F.lit("NOPQRSTUV"), l)
    return F.when(l == "Z", "+0000").when(early > 0, F.concat(F.lit("-0"), early.cast("string"), F.lit("00"))).when(late > 0, F.concat(F.lit("+0"), late.cast("string"), F.lit("00")))


def iso_millis(epoch_ms) -> Column:
    return F.date_format(F.timestamp_millis(c(epoch_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
