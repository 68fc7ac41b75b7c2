"""Value sets of parsed messages and the two kinds of correlation documents made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import headers, net, text
from postern.operators.correlate import clean_set


def _domains(*lists: str) -> list[Column]:
    return [F.transform(a, lambda x: F.lower(x["domain"])) for a in lists]


def message_sets(parsed: DataFrame) -> DataFrame:
    """(msg_id and the distinct value sets of a message parsed in mode `evidence`), each sorted.

    mailboxes: local@domain of sender and recipients; domains: theirs and the hops' hosts;
    reply_domains: theirs, the return path's and Reply-To's; hop_ips: literals of hops without brackets and zone;
    candidate_ips: those and the return path's literals; header_names; file_types: content types of all
    parts that are no containers; attachment_hashes: content of attachments that were read whole.
    """
    people = ("from_addr", "to_addr", "cc_addr")
    boxes = [F.transform(a, lambda x: F.concat(x["local"], F.lit("@"), F.lower(x["domain"]))) for a in people]
    hosts = F.transform("hops", lambda h: F.lower(h["host"]))
    bare = F.transform("hops", lambda h: F.regexp_replace(F.regexp_replace(h["ip"], r"[\[\]]", ""), "%.*$", ""))
    back = F.filter(F.transform(F.regexp_extract_all(F.coalesce("return_path", F.lit("")), F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), F.lower), lambda v: v.rlike(net.IPV4) | F.contains(v, F.lit(":")))
    leaves = F.filter("parts", lambda p: ~p["container"])
    attached = F.filter("parts", lambda p: (p["disposition"] == "attachment") & ~p["truncated"])
    sets = {
        "mailboxes": clean_set(*boxes), "domains": clean_set(*_domains(*people), hosts), "reply_domains": clean_set(*_domains(*people, "reply_to"), F.array(headers.address_domain("return_path"))),
        "hop_ips": clean_set(bare), "candidate_ips": clean_set(bare, back), "header_names": clean_set(F.transform("headers", lambda h: h["name"])),
        "file_types": clean_set(F.transform(leaves, lambda p: p["content_type"])), "attachment_hashes": clean_set(F.transform(attached, lambda p: text.content_hash(p["data"]))), "urls": clean_set(net.urls_b("body")),
        "attached_types": clean_set(F.transform(F.filter("parts", lambda p: p["disposition"] == "attachment"), lambda p: p["content_type"])), "sender_domains": clean_set(*_domains("from_addr"), F.array(headers.address_domain("return_path"))),
    }
    return parsed.select("msg_id", "subject", "body", "hops", *[F.array_sort(v).alias(k) for k, v in sets.items()])


def _times() -> Column:
    return F.transform("hops", lambda h: F.unix_millis(headers.header_date(h["date"])))


def library_documents(parsed: DataFrame) -> DataFrame:
    """Correlation documents whose addresses are hop literals and whose domains are the sender's and the return path's; observed at the earliest hop."""
    s = message_sets(parsed)
    return s.select(
        F.col("msg_id").alias("id"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"), F.col("sender_domains").alias("domains"), F.col("hop_ips").alias("addresses"), "header_names", "attachment_hashes", "urls",
        F.col("attached_types").alias("file_types"), F.lit(None).cast("double").alias("risk"), F.lit(None).cast("double").alias("confidence"), F.array_min(_times()).alias("observed_ms"),
    )


def production_documents(parsed: DataFrame) -> DataFrame:
    """Correlation documents whose addresses are mailboxes and whose domains are all of the headers' and the hops' hosts; observed at the latest hop."""
    s = message_sets(parsed)
    return s.select(
        F.col("msg_id").alias("id"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"), "domains", F.col("mailboxes").alias("addresses"), "header_names", "attachment_hashes", "urls", "file_types",
        F.lit(None).cast("double").alias("risk"), F.lit(None).cast("double").alias("confidence"), F.array_max(_times()).alias("observed_ms"),
    )
