"""Organisation profile: own and partner domains, brands, executives, mail ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import net, text


def domain_member(domain: Column, own: list[str]) -> Column:
    """Equal to a listed domain or below it; NULL (unobserved) when the list is empty."""
    if not own:
        return F.lit(None).cast("boolean")
    names = [x.lower() for x in own]
    return F.exists(F.array(*[F.lit(x) for x in names]), lambda x: (F.lower(domain) == x) | F.endswith(F.lower(domain), F.concat(F.lit("."), x)))


def in_mail_range(ip: Column, ranges: list[str]) -> Column:
    """Inside one of the ranges; NULL when none is known."""
    if not ranges:
        return F.lit(None).cast("boolean")
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in ranges]), lambda r: net.in_cidr(ip, r)), F.lit(False))


def abuse_contact_quoted(body: Column, contact: str | None) -> Column:
    """The contact, or its local part, stands in the body; NULL without a contact."""
    if not contact:
        return F.lit(None).cast("boolean")
    low = F.lower(body)
    return F.contains(low, F.lit(contact.lower())) | F.contains(low, F.lit(contact.lower().split("@")[0]))


def executive_named(body: Column, names: list[str]) -> Column:
    if not names:
        return F.lit(None).cast("boolean")
    out = F.lit(False)
    for n in names:
        out = out | text.names_whole(body, n)
    return out


def brand_distance(df: DataFrame, label: str, brands: list[str], most: int = 2) -> DataFrame:
    """Adds brand and distance: the nearest brand (the first one wins ties) within `most` edits, else NULL.

    The brands are a profile list, so they are literals of one expression and no join is needed.
    """
    cols = {f"_d{i}": text.osa_distance(F.col(label), F.lit(b), most) for i, b in enumerate(brands)}
    scored = df.withColumns(cols)
    pairs = F.array(*[F.struct(F.coalesce(F.col(f"_d{i}"), F.lit(1 << 20)).alias("distance"), F.lit(i).alias("i"), F.lit(b).alias("brand")) for i, b in enumerate(brands)])
    best = F.array_min(pairs)
    near = best["distance"] <= most
    return scored.select(*df.columns, F.when(near, best["brand"]).alias("brand"), F.when(near, best["distance"]).alias("distance"))
