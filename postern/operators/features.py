"""The 60 evidence features of a message, each one nullable column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.functions import headers, net, text
from postern.functions import lexicons as L
from postern.functions.scoring import age_ramp, quarantine


def _flag(cond: Column) -> Column:
    return cond.cast("double")


def auth_features(auth: Column, signatures: Column, from_domain: Column, return_domain: Column) -> dict[str, Column]:
    """From the authentication headers and the signatures (arrays, in order) and the two domains (nullable)."""
    spf, dkim, dmarc = (headers.first_auth_result(auth, m) for m in ("spf", "dkim", "dmarc"))
    failish = lambda v: v.isin("softfail", "temperror", "permerror") | v.startswith("fail")
    signed = F.coalesce(F.size(signatures) > 0, F.lit(False))
    signer = F.get(F.filter(F.transform(signatures, headers.dkim_domain), lambda v: v.isNotNull()), F.lit(0))
    policy = F.regexp_extract(dmarc, r"(?s)^(?:(?!p=).)*p=([a-z]*)", 1).isin("reject", "quarantine")
    return {
        "spf_fail": F.when(spf.isNotNull() & (spf != "none"), _flag(failish(spf))),
        "spf_none": _flag(F.coalesce(spf, F.lit("none")) == "none"),
        "dkim_fail": F.when(dkim.isNotNull() | signed, _flag(F.coalesce(failish(dkim), F.lit(False)))),
        "dkim_absent": _flag(dkim.isNull() & ~signed),
        "dmarc_fail": _flag(dmarc == "fail"),
        "dmarc_absent": _flag(dmarc.isNull()),
        "alignment_from_spf": _flag(return_domain != from_domain),
        "alignment_from_dkim": _flag(signer != from_domain),
        "dmarc_policy_strict": F.when(dmarc.isNotNull(), _flag(policy)),
    }


PRIVATE_TOKEN = r"^(?:10\.|192\.168\.|172\.1[6-9]\.|172\.2|172\.3[01]\.|127\.0\.0\.1$|fe80:)"


def route_features(from_domain: Column, return_domain: Column, reply_domain: Column, message_id: Column, received: Column, date: Column) -> dict[str, Column]:
    """`received` is array<struct<raw, ts>>, newest first; `date` the header's instant."""
    n = F.size(F.coalesce(received, F.array().cast("array<struct<raw:string,ts:timestamp>>")))
    present = F.coalesce(F.trim(message_id) != "", F.lit(False))
    id_domain = headers.address_domain(F.translate(F.trim(message_id), "<>", ""))
    malformed = ~F.contains(message_id, F.lit("@"))
    known = F.filter(received, lambda r: r["ts"].isNotNull())
    later = F.aggregate(
        known,
        F.struct(F.lit(None).cast("timestamp").alias("last"), F.lit(0).alias("bad")),
        lambda acc, r: F.struct(r["ts"].alias("last"), (acc["bad"] + F.when(r["ts"] > acc["last"], 1).otherwise(0)).alias("bad")),
        lambda acc: acc["bad"],
    )
    private = lambda r: F.exists(F.split(r["raw"], r"[\[\](),;]"), lambda t: F.trim(t).rlike(PRIVATE_TOKEN))
    first = F.get(known, F.lit(0))["ts"]
    return {
        "rp_from_mismatch": _flag(return_domain != from_domain),
        "replyto_mismatch": _flag(reply_domain != from_domain),
        "replyto_free_mail": F.when(from_domain.isNotNull(), _flag(reply_domain.isin(L.FREE_MAIL))),
        "messageid_anomaly": F.when(present, _flag(malformed | F.coalesce(id_domain != from_domain, F.lit(False)))),
        "received_count_n": F.least(n / 8.0, F.lit(1.0)),
        "received_disorder": F.coalesce(later, F.lit(0)) / F.greatest(F.lit(1), n),
        "received_private_hop": F.when(n > 0, _flag(F.exists(received, private))),
        "received_missing_from": F.when(n > 0, _flag(~F.contains(F.lower(F.get(received, F.lit(0))["raw"]), F.lit("from ")))),
        "helo_mismatch": F.lit(None).cast("double"),
        "date_skew": F.abs(F.unix_millis(date) - F.unix_millis(first)) / 3600000.0 / 1440.0,
    }


def ident_features(domain: Column, age_days: Column, distance: Column, mx: Column, privacy: Column, registrar: Column, registrar_country: Column, org_country: Column, lookalikes: dict[str, str]) -> dict[str, Column]:
    """Sender domain and nullable enrichment columns; unknown enrichment stays unobserved."""
    labels = F.size(F.split(domain, r"\."))
    return {
        "domain_age_inv": age_ramp(age_days),
        "domain_age_unknown": _flag(age_days.isNull()),
        "lookalike_strong": _flag(distance <= 2),
        "homoglyph_ratio": F.when(domain.isNotNull(), text.homoglyph_ratio(domain, lookalikes)),
        "digit_dash_ratio": F.when(F.length(text.first_label(domain)) > 0, text.digit_dash_ratio(text.first_label(domain))),
        "subdomain_depth": F.when(domain.isNotNull(), 1.0 - 1.0 / (1.0 + F.greatest(F.lit(0), labels - 2))),
        "suspicious_tld": _flag(F.contains(domain, F.lit(".")) & text.tld(domain).isin(L.SUSPICIOUS_TLD)),
        "mx_absent": _flag(~mx),
        "rdap_privacy": _flag(privacy),
        "registrar_risk": _flag(F.lower(registrar).isin(L.RISKY_REGISTRARS)),
        "registrar_country_off": _flag(F.lower(registrar_country) != F.lower(org_country)),
    }


def nlp_features(subject: Column, body: Column, display: Column, address: Column, executives: list[str] | None = None) -> dict[str, Column]:
    t = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    ramp = lambda lex: F.least(F.lit(1.0), text.weighted_hits(t, lex) / 1.5)
    head = F.lower(F.concat_ws(" ", subject, display, address))
    titles = text.cue_count(head, L.EXEC_TITLES)
    formal = F.when(titles > 0, F.least(F.lit(1.0), 0.5 + 0.25 * titles)).otherwise(0.0)
    if executives:
        named = F.lit(False)
        for e in executives:
            named = named | text.names_whole(F.coalesce(body, F.lit("")), e)
        formal = F.when(named, 1.0).otherwise(formal * 0.5)
    spaces = F.regexp_count(t, F.lit(r"\s"))
    bangs, odd = F.length(t) - F.length(F.translate(t, "!", "")), F.regexp_count(t, F.lit(r"[^\x00-\x7F]"))
    raw = F.lit(0.0)
    for p, w in L.URGENCY:
        raw = raw + F.when(F.contains(t, F.lit(p)), w).otherwise(0.0)
    # Words of a display name that look like an office.
    polite = F.lower(display).rlike(r"\b(?:department|office|service|team|support|administrator|info|no-?reply)\b")
    return {
        "urgency": ramp(L.URGENCY),
        "authority_claim": ramp(L.AUTHORITY),
        "credential_request": text.cue_count(t, L.CREDENTIAL) / 2.0,
        "payment_request": text.cue_count(t, L.PAYMENT) / 3.0,
        "payment_channel_change": F.least(F.lit(1.0), text.cue_count(t, L.CHANNEL_CHANGE) / 2.0),
        "exec_impersonation": formal,
        "secrecy_pressure": ramp(L.SECRECY),
        "generic_salutation": _flag(text.cue_count(t, L.GENERIC_SALUTATION) > 0),
        "grammar_anomaly": F.when(spaces > 0, F.least(F.lit(1.0), 0.15 * bangs / (spaces + 1) + 0.3 * odd / (F.length(t) + 1))).otherwise(0.0),
        "tone_incongruence": F.when(F.coalesce(F.length(F.trim(display)), F.lit(0)) == 0, 0.0).when(polite & (raw >= 1.0), 1.0).otherwise(F.least(F.lit(1.0), raw / 3.0)),
    }


def anchor_mismatch(html: Column) -> Column:
    """Share of links in HTML whose visible text names neither the target's host nor its second-level name; no links give 0.

    A link without target or host is a link that doesn't mismatch.
    """
    t = F.lower(html)
    tags = F.regexp_extract_all(t, F.lit(r"(?s)(<a [^>]*)>(?:(?!</a>).)*(?:</a>)?"), F.lit(1))
    inner = F.regexp_extract_all(t, F.lit(r"(?s)<a [^>]*>((?:(?!</a>).)*)</a>|(?s)<a [^>]*>"), F.lit(1))
    quoted = lambda g, i: F.regexp_extract(g, r"""(?s)href=(?:"([^"]*)|'([^']*)|([^\s"'][^\s]*))""", i)

    def bad(g: Column, label: Column) -> Column:
        target = F.concat(quoted(g, 1), quoted(g, 2), quoted(g, 3))
        host = net.url_host_a(F.when(F.contains(target, F.lit("//")), target).otherwise(F.concat(F.lit("//"), target)))
        labels = F.split(host, r"\.")
        named = F.contains(label, host) | F.contains(label, F.element_at(labels, F.greatest(F.lit(1), F.size(labels) - 1)))
        return F.when((host != "") & ~named, 1).otherwise(0)

    return F.when(F.size(tags) > 0, F.aggregate(F.zip_with(tags, inner, bad), F.lit(0), lambda a, v: a + v) / F.size(tags)).otherwise(0.0)


def payload_features(urls: Column, filenames: Column, body: Column, from_domain: Column) -> dict[str, Column]:
    """`urls` and `filenames` are arrays of strings."""
    hosts = F.transform(urls, net.url_host_a)
    any_ext = lambda exts: _flag(F.exists(filenames, lambda f: F.coalesce(text.extension(f).isin(exts), F.lit(False))))
    names = "|".join(L.REDIRECT_PARAMS)
    outside = lambda h: (h != from_domain) & ~F.endswith(h, F.concat(F.lit("."), from_domain))
    # What makes a body a form.
    form = F.exists(F.array(*[F.lit(x) for x in ("<form", "<input", 'type="password"', "type='password'", "sign in", "log in")]), lambda x: F.contains(F.lower(body), x))
    params = lambda u: F.filter(F.split(F.lower(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1)), "[&;]"), lambda kv: kv.rlike(f"^(?:{names})="))
    return {
        "link_text_mismatch": anchor_mismatch(body),
        "shortener": _flag(F.arrays_overlap(hosts, F.array(*[F.lit(x) for x in L.SHORTENERS]))),
        "ip_literal": _flag(F.exists(hosts, lambda h: h.rlike(r"^[0-9]*\.[0-9.]*$"))),
        "punycode": _flag(F.exists(hosts, lambda h: h.rlike(r"(^|\.)xn--"))),
        "at_in_url": _flag(F.exists(urls, lambda u: u.rlike(r"//[^/]*@"))),
        "deep_redirect": _flag(F.exists(urls, lambda u: F.size(params(u)) >= 2)),
        "credential_form_host": _flag(from_domain.isNotNull() & F.coalesce(form, F.lit(False)) & F.exists(hosts, lambda h: F.coalesce(outside(h), F.lit(False)))),
        "attachment_dangerous": any_ext(L.DANGEROUS_EXT),
        "attachment_macro": any_ext(L.MACRO_EXT),
        "attachment_archive": any_ext(L.ARCHIVE_EXT),
        "attachment_double_ext": _flag(F.exists(filenames, lambda f: F.coalesce(text.double_extension(f, L.DOUBLE_EXT) | text.rtl_override(f), F.lit(False)))),
        "attachment_count_n": F.least(F.size(filenames) / 4.0, F.lit(1.0)),
    }


def infra_features(evidence: dict[str, Column] | None = None, origin_country: Column | None = None, registrar_country: Column | None = None) -> dict[str, Column]:
    """Nullable booleans of the enrichment; what nobody looked up is unobserved."""
    e = evidence or {}
    none = F.lit(None).cast("double")
    out = {k: _flag(e[k]) if k in e else none for k in L.FAMILIES["INFRA"]}
    if origin_country is not None and registrar_country is not None:
        out["geo_mismatch"] = _flag(F.lower(origin_country) != F.lower(registrar_country))
    return out


def vector(features: dict[str, Column]) -> Column:
    """array<double>[60] in vector order; missing and out-of-range values are unobserved."""
    none = F.lit(None).cast("double")
    # One pass over the finished array: each value is computed once.
    return F.transform(F.array(*[features[f].cast("double") if f in features else none for f in L.FEATURES]), quarantine)


EVIDENCE = "mx boolean, privacy boolean, registrar string, registrar_country string, origin_country string, age_days int"


def mail_columns(parsed: DataFrame) -> DataFrame:
    """Scoring view of messages parsed in mode `features`: one row per message.

    Of repeated headers the first counts, but for authentication results, signatures and hops.
    """
    all_ = lambda n: F.transform(F.filter("headers", lambda h: h["name"] == n), lambda h: h["value"])
    one = lambda n: F.get(all_(n), F.lit(0))
    hops = F.transform(all_("received"), lambda v: F.struct(v.alias("raw"), F.when(F.contains(v, F.lit(";")), headers.scoring_date(F.regexp_extract(v, r"(?s)^[^;]*;(.*)$", 1))).alias("ts")))
    p = parsed.select(
        "msg_id", all_("authentication-results").alias("auth"), all_("dkim-signature").alias("signatures"), one("from").alias("from_header"), one("return-path").alias("return_header"), one("reply-to").alias("reply_header"),
        one("message-id").alias("message_id"), one("date").alias("date_header"), hops.alias("received"), F.coalesce(one("subject"), F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"),
        F.filter(F.transform("parts", lambda x: F.lower(x["filename"])), lambda f: f.isNotNull() & (F.trim(f) != "")).alias("filenames"), F.get("hops", F.lit(0))["ip"].alias("origin_ip"), "warnings",
    )
    return p.select(
        "*", headers.address_domain("from_header").alias("from_domain"), headers.address_domain("return_header").alias("return_domain"), headers.address_domain("reply_header").alias("reply_domain"),
        headers.address_only("from_header").alias("from_address"), F.when(F.instr("from_header", "<") > 1, F.trim(F.substring_index("from_header", "<", 1))).alias("display"),
        headers.scoring_date("date_header").alias("sent"), net.urls_a("body").alias("urls"),
    )


def vectors(mail: DataFrame, lookalikes: dict[str, str], brands: list[str] | None = None, executives: list[str] | None = None, org_country: str | None = None, infra: tuple[str, ...] = ()) -> DataFrame:
    """Adds x, the vector of mail_columns() joined with what is known about sender and origin.

    Columns of EVIDENCE that are absent are unknown; `infra` names further nullable boolean columns,
    called like their features. Lists that are empty leave their features unobserved.
    """
    col, none = F.col, F.lit(None)
    types = dict(x.split(" ") for x in EVIDENCE.split(", "))
    known = {k: col(k) if k in mail.columns else none.cast(t) for k, t in types.items()}
    label = text.skeleton(text.first_label(col("from_domain")), lookalikes)
    if brands:
        mail = mail.withColumn("_label", F.when(F.length(label) > 0, label))
        folded = [text.fold_text(b, lookalikes) for b in brands]
        # The distance only has to be told apart up to 2; without a near brand it is larger.
        near = F.array_min(F.array(*[F.coalesce(text.osa_distance(col("_label"), F.lit(b), 2), F.lit(99)) for b in folded]))
        mail = mail.withColumn("_distance", F.when(col("_label").isNotNull(), near))
    distance = col("_distance") if brands else none.cast("int")
    feats = (
        auth_features(col("auth"), col("signatures"), col("from_domain"), col("return_domain"))
        | route_features(col("from_domain"), col("return_domain"), col("reply_domain"), col("message_id"), col("received"), col("sent"))
        | ident_features(col("from_domain"), known["age_days"], distance, known["mx"], known["privacy"], known["registrar"], known["registrar_country"], F.lit(org_country).cast("string"), lookalikes)
        | nlp_features(col("subject"), col("body"), col("display"), col("from_address"), executives)
        | payload_features(col("urls"), col("filenames"), col("body"), col("from_domain"))
        | infra_features({k: col(k) for k in infra}, known["origin_country"], known["registrar_country"])
    )
    return mail.withColumn("x", vector(feats)).drop("_label", "_distance")
