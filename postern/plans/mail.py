"""Raw messages from the message tables, through the whole pipeline: parser, features, model, attribution.

The messages are put together by expressions that both engines read, so that the SQL of a query knows
what a header or a body holds without parsing: RAW_* below. Everything behind that is written twice,
as columns of the engine and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions import headers, mailparse, scoring
from postern.functions import lexicons as L
from postern.operators import attribution, documents, features
from postern.plans import analysis
from postern.plans.textual import _NUM, LOOKALIKES, SCOPE_SQL
from postern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BRANDS = ["belmar", "norden", "corveth", "quellmark"]
EXECUTIVES = ["Aldreth Torbarford"]
ORG_COUNTRY = "SE"


def pick(by: int, values: list[str | None], shift: int = 0) -> str:
    """CASE expression: a value (SQL text) by the remainder of the message number."""
    key = f"(msg_no + {shift}) % {by}"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"


def quoted(values: list[str]) -> list[str]:
    return ["'" + v + "'" for v in values]


SUBJECTS = [
    "'Urgent: wire transfer needed asap'", "'Final notice: official audit'", "'Required by law - mandatory compliance'", "'Strictly confidential: do not forward'", "'Please confirm your password'",
    "'Update the bank, new account number'", "'From the CEO'", "'Dear customer'", "'Act immediately or account will be suspended'", "'Internal use only, off the record!!!'", None, "'Invoice, remittance, billing and refund'",
]
TAILS = quoted([
    "see http://bit.ly/x", "or http://192.0.2.1/a", "at https://xn--abc.example/", "by http://user@evil.test/", "to http://r.test/?url=a&next=b", "<form> sign in at https://login.test/p",
    "<a href=\"https://real.test/x\">fake.test</a> <a href=\"https://real.test/y\">real.test</a>", "Dear customer, keep this between us.", "Aldreth Torbarford asks", "",
])

_SENDER = "CASE msg_no % 8 WHEN 1 THEN replace(fromaddr, '@', '@mail.eu.') WHEN 2 THEN fromaddr || '.top' WHEN 3 THEN replace(fromaddr, '@', '@p0rt-1') ELSE fromaddr END"
# Header fields of a message, from the columns of messages; the second level sees the first.
RAW_FIRST = {
    "sender": _SENDER,
    "dom": f"regexp_replace(lower({_SENDER}), '^.*@', '')",
    "display": pick(6, quoted(["Support Team", "Office of the CEO", "Dag Holm"])),
    "subject": pick(12, SUBJECTS),
    "tail": pick(10, TAILS),
    "spf": pick(5, quoted(["pass", "softfail", "none", "fail", "temperror"])),
    "dkim": pick(4, quoted(["pass", "fail", "none", "permerror"]), 1),
    "dmarc": pick(3, quoted(["pass", "fail", "fail(p=reject)"]), 2),
}
RAW_SECOND = {
    "from_header": "CASE WHEN display IS NULL THEN sender ELSE display || ' <' || sender || '>' END",
    "return_header": pick(3, [None, "'<bounce@' || dom || '>'", "CASE WHEN msg_no % 2 = 0 THEN '<bounce@[192.0.2.77]>' ELSE '<bounce@' || originhost || '>' END"]),
    "reply_header": pick(5, [None, "'x@gmail.com'", "sender", "toaddr", "'Y <y@proton.me>'"]),
    "auth_before": "CASE WHEN msg_no % 11 = 0 THEN 'edge.test; arc=none' END",
    "auth": "CASE WHEN msg_no % 7 <> 0 THEN 'mx.test; spf=' || spf || ' smtp.mailfrom=x; dkim=' || dkim || ' header.d=y; dmarc=' || dmarc || ' header.from=z' END",
    "received_spf": "CASE WHEN msg_no % 9 = 0 THEN 'Pass (mx.test: permitted)' END",
    "signature": pick(4, [None, "'v=1; a=rsa-sha256; d=' || dom || '; s=k'", "'v=1; a=rsa-sha256; d=Mailer.Test; s=k'", None]),
    "arc": "CASE WHEN msg_no % 6 = 0 THEN 'i=1; cv=none' END",
}
WITH_CLAUSE = "CASE hop_no % 9 WHEN 0 THEN 'HTTP' WHEN 4 THEN 'SUBMISSION (webmail proxy)' ELSE protocol END"
RAW_HOP = {
    "raw": "CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN 'by ' ELSE 'from ' || fromclause || ' by ' END || coalesce(byhost, 'unknown') || coalesce(' with ' || " + WITH_CLAUSE + ", '') || coalesce(' via ' || viaclause, '')"
    " || coalesce(' id ' || idclause, '') || coalesce(' for ' || forclause, '') || '; ' || coalesce(timestampraw, '')",
}
# A part's content; `tail` ends the first text of a message. A text that isn't ASCII says so.
RAW_PART = {
    "content": "CASE WHEN body IS NULL THEN 'PK' || part_no WHEN part_no = first_text THEN body || chr(13) || chr(10) || tail ELSE body END",
    "declared": "CASE WHEN body IS NULL THEN NULL WHEN regexp_replace(body, '[^ -~]', '') = regexp_replace(body, '[\\r\\n\\t]', '') THEN charset ELSE 'utf-8' END",
    "attached": "CASE part_no % 8 WHEN 0 THEN filename || '.exe' WHEN 1 THEN filename || '.docm' WHEN 2 THEN filename || '.tar' ELSE filename END",
    "encoding": "lower(coalesce(transferencoding, ''))",
}


def composed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(messages with their header fields, parts with content), by the expressions both engines share."""
    m = table(spark, d, "messages")
    m = m.selectExpr("*", *[f"{e} AS {k}" for k, e in RAW_FIRST.items()]).selectExpr("*", *[f"{e} AS {k}" for k, e in RAW_SECOND.items()])
    p = table(spark, d, "parts")
    # A message's own parts are bounded by the message.
    first = p.filter("body is not null").groupBy("msg_no").agg(F.min("part_no").alias("first_text"))
    p = p.join(first, "msg_no", "left").join(m.select("msg_no", "tail"), "msg_no")
    return m, p.selectExpr("*", *[f"{e} AS {k}" for k, e in RAW_PART.items()])


def raw_mail(spark: SparkSession, d: str) -> DataFrame:
    """(msg_id, content): an RFC 5322 message for every row of messages, with all its hops and parts.

    Parts of depth 2 lie in a container inside the body, parts of depth 0 are the whole body.
    """
    m, p = composed(spark, d)
    end = F.lit("\r\n")
    coded = F.when(F.col("encoding") == "base64", F.base64(F.encode("content", "utf-8"))).when(F.col("encoding") == "quoted-printable", F.replace("content", F.lit("="), F.lit("=3D"))).otherwise(F.col("content"))
    opt = lambda *x: F.coalesce(F.concat(*x), F.lit(""))
    block = F.concat(
        F.lit("Content-Type: "), F.coalesce("contenttype", F.lit("text/plain")), opt(F.lit("; charset="), "declared"), end, F.when(F.col("encoding") != "", F.concat(F.lit("Content-Transfer-Encoding: "), "transferencoding", end)).otherwise(F.lit("")),
        opt(F.lit("Content-Disposition: "), "disposition", F.when(F.col("attached").isNotNull(), F.concat(F.lit('; filename="'), "attached", F.lit('"'))).otherwise(F.lit("")), end), end, coded,
    )
    of = lambda depth, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mimedepth") == depth, F.struct("part_no", block.alias("b"))))), lambda s: F.concat(F.lit(mark), s["b"], end)), "")
    parts = p.groupBy("msg_no").agg(of(0, "").alias("alone"), of(1, "--bb\r\n").alias("outer"), of(2, "--cc\r\n").alias("inner"))
    h = table(spark, d, "hops").selectExpr("msg_no", "hopindex", "hop_no", *[f"{e} AS {k}" for k, e in RAW_HOP.items()])
    rec = h.groupBy("msg_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hopindex", "hop_no", "raw"))), lambda s: F.concat(F.lit("Received: "), s["raw"], end)), "").alias("received"))
    line = lambda name, col: opt(F.lit(name + ": "), F.col(col), end)
    nested = F.when(F.col("inner") != "", F.concat(F.lit("--bb\r\nContent-Type: multipart/related; boundary=cc\r\n\r\n"), "inner", F.lit("--cc--\r\n"))).otherwise(F.lit(""))
    many = F.concat(F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="bb"\r\n\r\n'), nested, "outer", F.lit("--bb--\r\n"))
    body = F.when(F.col("alone").isNull(), F.lit("\r\n")).when(F.col("alone") != "", F.expr("substr(alone, 1, length(alone) - 2)")).otherwise(many)
    j = m.join(rec, "msg_no", "left").join(parts, "msg_no", "left")
    content = F.concat(
        line("Return-Path", "return_header"), F.coalesce("received", F.lit("")), line("Received-SPF", "received_spf"), line("Authentication-Results", "auth_before"), line("Authentication-Results", "auth"), line("DKIM-Signature", "signature"), line("ARC-Seal", "arc"),
        line("ARC-Message-Signature", "arc"), line("From", "from_header"), line("To", "toaddr"), F.lit('Cc: "Desk, main" <desk@y.test>, Team: a@x.test, b@X.test;\r\n'), line("Reply-To", "reply_header"), line("Subject", "subject"), line("Message-ID", "messageid"), line("Date", "dateheader"),
        body,
    )
    return j.select(F.col("msg_no").cast("string").alias("msg_id"), F.encode(content, "utf-8").alias("content"))


def parsed(spark: SparkSession, d: str, mode: str = "evidence") -> DataFrame:
    return mailparse.parse_messages(raw_mail(spark, d), mode)


def sender_facts(spark: SparkSession, d: str) -> DataFrame:
    """(from_domain, and what a registry knows of it): stand-ins, one row per sender domain."""
    doms = table(spark, d, "messages").selectExpr(f"{RAW_FIRST['dom']} AS from_domain").filter("from_domain is not null").distinct()
    return doms.selectExpr("from_domain", *[f"{e.format(v='from_domain')} AS {k}" for k, e in SENDER.items()])


def origin_facts(spark: SparkSession, d: str) -> DataFrame:
    """(origin_ip, and what reputation lists know of it): stand-ins, one row per address."""
    ips = table(spark, d, "hops").select(F.lower("ip").alias("origin_ip")).filter("origin_ip is not null").distinct()
    return ips.selectExpr("origin_ip", *[f"{e.format(v='origin_ip')} AS {k}" for k, e in ORIGIN.items()])


SENDER = {
    "age_days": "CASE WHEN length({v}) % 4 <> 0 THEN CAST((length({v}) * 173) % 4000 AS INT) END",
    "mx": "CASE length({v}) % 3 WHEN 1 THEN true WHEN 2 THEN false END",
    "privacy": "CASE WHEN length({v}) % 5 <> 0 THEN length({v}) % 5 <= 2 END",
    "registrar": "CASE length({v}) % 3 WHEN 0 THEN 'Namecheap' WHEN 1 THEN 'GANDI' END",
    "registrar_country": "CASE length({v}) % 4 WHEN 0 THEN 'SE' WHEN 1 THEN 'de' WHEN 2 THEN 'XA' END",
}
INFRA = ("ip_in_blacklist", "asn_risk", "vpn_proxy", "tor_exit", "open_relay", "cloud_hosted", "reputation_low")
ORIGIN = {f: "CASE WHEN {v} NOT LIKE '%:%' THEN {v} LIKE '%" + str(i) + "' END" for i, f in enumerate(INFRA)} | {"origin_country": "CASE WHEN {v} LIKE '198.18.%' THEN 'XA' WHEN {v} LIKE '198.19.%' THEN 'SE' END"}


def mail_vectors(spark: SparkSession, d: str) -> DataFrame:
    """One row per message with its vector: raw message, parser, facts about sender and origin, features."""
    p = parsed(spark, d, "features")
    mail = features.mail_columns(p).join(sender_facts(spark, d), "from_domain", "left").join(origin_facts(spark, d), "origin_ip", "left")
    v = features.vectors(mail, LOOKALIKES, BRANDS, EXECUTIVES, ORG_COUNTRY, INFRA)
    return v.select(F.col("msg_id").cast("bigint").alias("msg_no"), "x")


# --- the same in SQL -------------------------------------------------------------------------

_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
_DATE = r"^(?:([A-Za-z]+), ?)?(\d{{1,2}}) ([A-Za-z]{{3}}) (\d{{4}}) (\d{{2}}):(\d{{2}})(?::(\d{{2}}))?$".replace("{{", "{").replace("}}", "}")


def _stamp(body: str, clamp: bool = True) -> str:
    """Timestamp of a date text without its zone, NULL if invalid."""
    g = lambda i: f"TRY_CAST(regexp_extract({body}, '{_DATE}', {i}) AS INTEGER)"
    month = f"list_position({_MONTHS}, lower(regexp_extract({body}, '{_DATE}', 3)))"
    ok = f"{month} > 0 AND {g(2)} BETWEEN 1 AND 31 AND {g(4)} >= 1 AND {g(5)} <= 23 AND {g(6)} <= 59 AND coalesce({g(7)}, 0) <= 59"
    if not clamp:
        ok += f" AND {g(2)} <= day(last_day(make_date({g(4)}, {month}, 1)))"
    return f"CASE WHEN {ok} THEN make_timestamp({g(4)}, {month}, least({g(2)}, day(last_day(make_date({g(4)}, {month}, 1)))), {g(5)}, {g(6)}, coalesce({g(7)}, 0)) END"


def _minutes(zone: str) -> str:
    return f"CASE WHEN regexp_matches({zone}, '^[+-]\\d{{2}}[0-5]\\d$') THEN (CASE WHEN {zone}[1] = '-' THEN -1 ELSE 1 END) * (CAST({zone}[2:3] AS INTEGER) * 60 + CAST({zone}[4:5] AS INTEGER)) END"


def scoring_ms(value: str) -> str:
    """Epoch milliseconds of a date by the scoring's rules, as a scalar subquery."""
    letter = "CASE WHEN length(w) <> 1 THEN NULL WHEN upper(w) = 'Z' THEN '+0000' WHEN instr('ABCDEFGHI', upper(w)) > 0 THEN '-0' || instr('ABCDEFGHI', upper(w)) || '00' WHEN instr('NOPQRSTUV', upper(w)) > 0 THEN '+0' || instr('NOPQRSTUV', upper(w)) || '00' END"
    zone = f"CASE WHEN regexp_matches(w, '^[+-]\\d{{4}}$') THEN w WHEN upper(w) IN ('GMT', 'UT', 'UTC') THEN '+0000' ELSE {letter} END"
    return f"""(SELECT CASE WHEN wd = '' OR lower(wd) = lower(strftime(t, '%a')) THEN epoch_ms(t) - {_minutes('z')} * 60000 END FROM (SELECT {zone} AS z, regexp_extract(b, '{_DATE}', 1) AS wd, {_stamp('b')} AS t FROM (
        SELECT regexp_extract(dd, ' ([^ ]*)$', 1) AS w, regexp_replace(regexp_extract(dd, '^(.*) [^ ]*$', 1), '^(.+?) \\(.*$', '\\1') AS b FROM (SELECT regexp_replace(trim({value}), '\\s+', ' ', 'g') AS dd))))"""


def header_ms(value: str, tolerant: bool = False) -> str:
    """Epoch milliseconds of a date in one of the exact forms, or with comments, blanks and letter case passed over."""
    if tolerant:
        value, up, months = f"regexp_replace(regexp_replace({value}, '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')", "upper", "TRUE"
    else:
        up, months = "", "mon IN ('Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec')"
    fixed = "CASE z " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in headers.US_ZONES.items()) + " ELSE z END"
    region = "CASE z " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in headers.REGIONS.items()) + " END"
    return f"""(SELECT coalesce(epoch_ms(t) - {_minutes('o')} * 60000, least(epoch_ms(timezone(r, t)), epoch_ms(timezone(r, t - INTERVAL 1 HOUR)) + 3600000)) FROM (SELECT {fixed} AS o, {region} AS r, CASE WHEN (wd = '' OR length(wd) BETWEEN 3 AND 12) AND {months} THEN {_stamp('b', not tolerant)} END AS t
        FROM (SELECT z, b, regexp_extract(b, '{_DATE}', 1) AS wd, regexp_extract(b, '{_DATE}', 3) AS mon FROM (SELECT {up}(regexp_extract(s, ' (\\S+)$', 1)) AS z, regexp_replace(s, ' \\S+$', '') AS b FROM (SELECT trim({value}) AS s)))))"""


def attribution_sql(hops: str, networks: str, relays: str) -> str:
    """Attribution over hops (msg_no, hopindex, hop_no, ip, host, via, ms): CTEs ending in `attr`; the lists are the query's hints."""
    tokens = " + ".join(f"CAST(contains(via, '{t}') AS INTEGER)" for t in L.PROXY_TOKENS)
    return f"""WITH hp0 AS (SELECT *, {SCOPE_SQL} AS scope, coalesce({tokens}, 0) AS tok, CAST(coalesce(contains(lower(host), 'edge8.'), false) AS INTEGER) AS prox FROM {hops}),
    hp AS (SELECT *, bool_and(ms IS NOT NULL) OVER (PARTITION BY msg_no) AS dated, lead(ms) OVER (PARTITION BY msg_no ORDER BY hopindex, hop_no) AS older FROM hp0),
    per AS (SELECT msg_no, count(*) AS n, count(*) FILTER (WHERE scope = 'PRIVATE') AS np, count(*) FILTER (WHERE ip IS NOT NULL AND scope NOT IN ('PUBLIC', 'PRIVATE')) AS nr, count(DISTINCT CASE WHEN scope = 'PUBLIC' THEN ip END) AS n_public, bool_and(dated) AS dated,
        coalesce(bool_or(ms < older), false) AS contradicted, sum(tok) AS tok, sum(prox) AS prox, max(hopindex) AS deepest,
        arg_min({{'ip': ip, 'hopindex': hopindex, 'host': host}}, (CASE WHEN dated THEN ms ELSE 0 END, -hopindex, hop_no)) FILTER (WHERE scope = 'PUBLIC') AS prim FROM hp GROUP BY msg_no),
    nets AS (SELECT * FROM (VALUES {networks}) v(r, lo, prefix, country, organization, asn)),
    known AS (SELECT ip, arg_min({{'country': country, 'organization': organization, 'asn': asn}}, (-prefix, r)) AS k FROM (SELECT DISTINCT prim.ip AS ip FROM per) JOIN nets ON {_NUM} >= lo AND {_NUM} < lo + CAST(pow(2, 32 - prefix) AS BIGINT) GROUP BY ip),
    rel AS (SELECT * FROM (VALUES {relays}) v(domain, age_days, mx)),
    hinted AS (SELECT per.*, prim.ip AS primary_ip, CASE WHEN n <= 1 THEN 'TRIVIAL' WHEN dated THEN 'TIMESTAMP' ELSE 'HEADER_DEPTH' END AS basis, prim.hopindex = deepest AS originating, (n - np - nr) / n AS t, k.organization AS org, k.asn AS asn, k.country AS country,
        coalesce(length(lower(trim(prim.host))) > 0, false) AS host_known, age_days, mx FROM per LEFT JOIN known ON known.ip = prim.ip LEFT JOIN rel ON domain = lower(trim(prim.host))),
    parts4 AS (SELECT *, coalesce(asn = 'AS64504', false) AS anon, coalesce(org = 'bench seven', false) AS anon_org,
        list_filter([CASE WHEN org IS NOT NULL THEN CASE WHEN org = 'bench seven' THEN 0.0 ELSE 1.0 END END, CASE WHEN age_days >= 0 THEN least(age_days / 365, 1.0) END, CASE WHEN mx THEN 1.0 WHEN NOT mx THEN 0.0 END], lambda v: v IS NOT NULL) AS sig FROM hinted),
    factored AS (SELECT *, CASE WHEN len(sig) > 0 THEN list_sum(sig) / len(sig) ELSE 0 END AS s, CASE WHEN anon THEN 1.0 WHEN prox > 0 THEN 0.75 ELSE least(0.5, 0.25 * tok) END AS a, tok + prox + CAST(anon AS INTEGER) AS indicators,
        (CAST(primary_ip IS NOT NULL AS INTEGER) + CAST(asn IS NOT NULL AS INTEGER) + CAST(org IS NOT NULL AS INTEGER) + CAST(host_known AS INTEGER)) / 4 AS x FROM parts4),
    attr AS (SELECT *, CASE WHEN primary_ip IS NULL THEN 0.0 ELSE least({L.CONFIDENCE_CAP}, pow(t, 0.35) * pow(s, 0.25) * pow(1 - a, 0.25) * pow(x, 0.15)) END AS value,
        CASE WHEN primary_ip IS NOT NULL THEN 1 + CAST(n_public >= 1 AS INTEGER) + CAST(contradicted OR basis = 'TIMESTAMP' AS INTEGER) + 1 + 1 + CAST(anon AS INTEGER) + CAST(indicators > 0 AS INTEGER) + CAST(NOT host_known AS INTEGER) END AS n_factors FROM factored)"""


_M = f"(SELECT *, {', '.join(f'{e} AS {k}' for k, e in RAW_SECOND.items())} FROM (SELECT *, {', '.join(f'{e} AS {k}' for k, e in RAW_FIRST.items())} FROM messages))"
_H = f"(SELECT msg_no, hopindex, hop_no, {RAW_HOP['raw']} AS raw, CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE lower(nullif(regexp_extract(fromclause, '\\[([^\\]]*)\\]', 1), '')) END AS lit FROM hops)"
_PARTS = f"""(SELECT *, {', '.join(f"{e} AS {k}" for k, e in RAW_PART.items())} FROM (SELECT p.*, tail, min(CASE WHEN body IS NOT NULL THEN part_no END) OVER (PARTITION BY p.msg_no) AS first_text FROM parts p JOIN {_M} USING (msg_no)))"""
_CODED = "CASE encoding WHEN 'base64' THEN array_to_string(regexp_extract_all(base64(encode(content)), '.{1,76}'), chr(13) || chr(10)) WHEN 'quoted-printable' THEN replace(content, '=', '=3D') ELSE content END"
_SEEN = "CASE encoding WHEN 'quoted-printable' THEN replace(content, '=', '=3D') ELSE content END"  # as the scoring decodes it
_TEXT = "lower(coalesce(contenttype, 'text/plain')) LIKE 'text/%'"

MAIL_SQL = f"""WITH m AS {_M},
    h AS (SELECT msg_no, list({{'raw': raw, 'ms': {scoring_ms("regexp_extract(raw, '^[^;]*;(.*)$', 1)")}}} ORDER BY hopindex, hop_no)[1:25] AS received, list(lit ORDER BY hopindex, hop_no)[1] AS first_lit, count(*) AS n_hops FROM {_H} GROUP BY 1),
    p AS (SELECT msg_no, max(CASE WHEN mimedepth = 0 THEN {_CODED} END) AS alone, arg_max({_SEEN}, part_no) FILTER (WHERE mimedepth = 1 AND {_TEXT} AND coalesce(disposition, '') <> 'attachment' AND content <> '') AS outer_text,
        arg_min({_SEEN}, (-mimedepth, part_no)) FILTER (WHERE mimedepth > 0 AND {_TEXT}) AS any_text, list(lower(attached)) FILTER (WHERE trim(attached) <> '') AS filenames, count(*) AS n_parts FROM {_PARTS} GROUP BY 1),
    mail0 AS (SELECT m.*, coalesce(received, []) AS received, first_lit, coalesce(alone, outer_text, any_text, '') AS body, alone IS NOT NULL AS latin, coalesce(filenames, []) AS filenames,
        {{a}} FROM m LEFT JOIN h USING (msg_no) LEFT JOIN p USING (msg_no)),
    mail1 AS (SELECT *, lower(coalesce(subject, '') || chr(10) || body) AS t, CASE WHEN lit_ok THEN first_lit END AS origin_ip, list_filter(list_transform(regexp_extract_all(body, '(?i)https?://[^\\s"''<>)|]*'), lambda u: regexp_replace(u, '[.,;:!]+$', '')), lambda u: length(u) > 8) AS urls,
        {scoring_ms('dateheader')} AS sent_ms, list_filter(received, lambda r: r.ms IS NOT NULL) AS known FROM mail0),
    mail2 AS (SELECT *, list_transform(urls, lambda u: CASE WHEN contains(u, '@') THEN regexp_replace(regexp_replace(lower(u), '@.*$', ''), '^[^/]*//([^:]*).*$', '\\1') ELSE regexp_extract(lower(u), '//([^/?#:]*)', 1) END) AS hosts FROM mail1),
    mail AS (SELECT *, {', '.join(f"{e.format(v='dom')} AS {k}" for k, e in SENDER.items())}, {', '.join(f"{e.format(v='origin_ip')} AS {k}" for k, e in ORIGIN.items())} FROM mail2)"""


def _domain(e: str) -> str:
    return f"nullif(regexp_replace(lower(CASE WHEN contains({e}, '<') THEN regexp_extract({e}, '<([^>]*)', 1) ELSE trim({e}) END), '^.*@[.-]*', ''), '')"


MAIL_SQL = MAIL_SQL.replace("{a}", f"{_domain('return_header')} AS return_domain, {_domain('reply_header')} AS reply_domain, regexp_matches(first_lit, '^[0-9.]+$|:') AS lit_ok")


def _weighted(lex) -> str:
    expr, total = "t", []
    for p, w in lex:
        total.append(f"CASE WHEN contains({expr}, '{p}') THEN {w} ELSE 0 END")
        expr = f"replace({expr}, '{p}', ' ')"
    return f"least(1.0, ({' + '.join(total)}) / 1.5)"


def _cues(text: str, cues) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{x}') AS INTEGER)" for x in cues) + ")"


def _in(e: str, values) -> str:
    return f"{e} IN ({', '.join(repr(v) for v in values)})"


def _flag(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


_HEAD = "lower(concat_ws(' ', coalesce(subject, ''), CASE WHEN sender IS NOT NULL THEN display END, sender))"
_EXEC = _cues(_HEAD, L.EXEC_TITLES)
_EXT = "list_transform(filenames, lambda f: CASE WHEN contains(f, '.') THEN string_split(f, '.')[-1] ELSE '' END)"
_any_ext = lambda exts: _flag(f"len(list_filter({_EXT}, lambda e: {_in('e', exts)})) > 0")
_LEN = "(CASE WHEN latin THEN strlen(t) ELSE length(t) END)"
_ODD = "(CASE WHEN latin THEN strlen(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) ELSE length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) END)"
_SPACES = "length(regexp_replace(t, '[^ \\t\\r\\n\\f\\v]', '', 'g'))"
_FORM = " OR ".join(f"contains(lower(body), '{x}')" for x in ("<form", "<input", 'type="password"', "type=''password''", "sign in", "log in"))
_RAWU = " + ".join(f"CASE WHEN contains(t, '{p}') THEN {w} ELSE 0 END" for p, w in L.URGENCY)
_AUTHED = "auth IS NOT NULL"
_LABEL = "string_split(translate(dom, '01', 'ol'), '.')[1]"

FEATURE_SQL = {
    "spf_fail": f"CASE WHEN {_AUTHED} AND spf <> 'none' THEN {_flag(_in('spf', ['fail', 'softfail', 'temperror']))} END",
    "spf_none": f"{_flag(f'NOT ({_AUTHED}) OR spf = ' + chr(39) + 'none' + chr(39))}",
    "dkim_fail": f"CASE WHEN {_AUTHED} OR signature IS NOT NULL THEN {_flag(f'({_AUTHED}) AND ' + _in('dkim', ['fail', 'permerror']))} END",
    "dkim_absent": _flag(f"NOT ({_AUTHED}) AND signature IS NULL"),
    "dmarc_fail": f"CASE WHEN {_AUTHED} THEN {_flag('dmarc = ' + repr('fail'))} END",
    "dmarc_absent": _flag(f"NOT ({_AUTHED})"),
    "alignment_from_spf": _flag("return_domain <> dom"),
    "alignment_from_dkim": _flag("CASE WHEN signature LIKE '%Mailer%' THEN 'mailer.test' WHEN signature IS NOT NULL THEN dom END <> dom"),
    "dmarc_policy_strict": f"CASE WHEN {_AUTHED} THEN {_flag('contains(dmarc, ' + repr('p=reject') + ')')} END",
    "rp_from_mismatch": _flag("return_domain <> dom"),
    "replyto_mismatch": _flag("reply_domain <> dom"),
    "replyto_free_mail": f"CASE WHEN dom IS NOT NULL THEN {_flag(_in('reply_domain', L.FREE_MAIL))} END",
    "messageid_anomaly": "CASE WHEN trim(messageid) <> '' THEN CAST(NOT contains(messageid, '@') OR coalesce(nullif(regexp_replace(lower(translate(trim(messageid), '<>', '')), '^.*@[.-]*', ''), '') <> dom, false) AS DOUBLE) END",
    "received_count_n": "least(len(received) / 8, 1.0)",
    "received_disorder": "coalesce(len(list_filter(range(2, len(known) + 1), lambda i: known[i].ms > known[i - 1].ms)), 0) / greatest(1, len(received))",
    "received_private_hop": "CASE WHEN len(received) > 0 THEN CAST(len(list_filter(received, lambda r: len(list_filter(regexp_split_to_array(r.raw, '\\[|\\]|[(),;]'), lambda k: regexp_matches(trim(k), '" + features.PRIVATE_TOKEN + "'))) > 0)) > 0 AS DOUBLE) END",
    "received_missing_from": "CASE WHEN len(received) > 0 THEN CAST(NOT contains(lower(received[1].raw), 'from ') AS DOUBLE) END",
    "helo_mismatch": "NULL",
    "date_skew": "abs(sent_ms - known[1].ms) / 3600000.0 / 1440.0",
    "domain_age_inv": "CASE WHEN age_days >= 0 THEN 1.0 - least(ln(1 + age_days) / ln(3651), 1.0) END",
    "domain_age_unknown": _flag("age_days IS NULL"),
    "lookalike_strong": _flag("least(" + ", ".join(f"damerau_levenshtein({_LABEL}, '{b}')" for b in BRANDS) + ") <= 2"),
    "homoglyph_ratio": f"1 - length(translate(dom, '{''.join(LOOKALIKES)}', '')) / length(dom)",
    "digit_dash_ratio": "length(regexp_replace(string_split(dom, '.')[1], '[^0-9-]', '', 'g')) / nullif(length(string_split(dom, '.')[1]), 0)",
    "subdomain_depth": "CASE WHEN dom IS NOT NULL THEN 1.0 - 1.0 / (1.0 + greatest(0, len(string_split(dom, '.')) - 2)) END",
    "suspicious_tld": _flag("contains(dom, '.') AND " + _in("string_split(dom, '.')[-1]", L.SUSPICIOUS_TLD)),
    "mx_absent": _flag("NOT mx"),
    "rdap_privacy": _flag("privacy"),
    "registrar_risk": _flag(_in("lower(registrar)", L.RISKY_REGISTRARS)),
    "registrar_country_off": _flag(f"lower(registrar_country) <> '{ORG_COUNTRY.lower()}'"),
    "urgency": _weighted(L.URGENCY),
    "authority_claim": _weighted(L.AUTHORITY),
    "credential_request": f"{_cues('t', L.CREDENTIAL)} / 2",
    "payment_request": f"{_cues('t', L.PAYMENT)} / 3",
    "payment_channel_change": f"least(1.0, {_cues('t', L.CHANNEL_CHANGE)} / 2)",
    "exec_impersonation": f"CASE WHEN regexp_matches(' ' || lower(body) || ' ', '[^\\p{{L}}](aldreth torbarford|aldreth|torbarford)[^\\p{{L}}]') THEN 1.0 WHEN {_EXEC} = 0 THEN 0 ELSE 0.5 * least(1.0, 0.5 + 0.25 * {_EXEC}) END",
    "secrecy_pressure": _weighted(L.SECRECY),
    "generic_salutation": _flag(f"{_cues('t', L.GENERIC_SALUTATION)} > 0"),
    "grammar_anomaly": f"CASE WHEN {_SPACES} > 0 THEN least(1.0, 0.15 * (length(t) - length(replace(t, '!', ''))) / ({_SPACES} + 1) + 0.3 * {_ODD} / ({_LEN} + 1)) ELSE 0 END",
    "tone_incongruence": f"CASE WHEN display IS NULL OR fromaddr IS NULL THEN 0 WHEN regexp_matches(lower(display), '\\b(department|office|service|team|support|administrator|info|no-?reply)\\b') AND {_RAWU} >= 1 THEN 1 ELSE least(1.0, ({_RAWU}) / 3) END",
    "link_text_mismatch": "CASE WHEN contains(body, 'fake.test</a>') THEN 0.5 ELSE 0 END",
    "shortener": _flag(f"len(list_filter(hosts, lambda h: {_in('h', L.SHORTENERS)})) > 0"),
    "ip_literal": _flag("len(list_filter(hosts, lambda h: regexp_matches(h, '^[0-9]*\\.[0-9.]*$'))) > 0"),
    "punycode": _flag("len(list_filter(hosts, lambda h: regexp_matches(h, '(^|\\.)xn--'))) > 0"),
    "at_in_url": _flag("len(list_filter(urls, lambda u: regexp_matches(u, '//[^/]*@'))) > 0"),
    "deep_redirect": _flag("len(list_filter(urls, lambda u: len(list_filter(regexp_split_to_array(lower(regexp_extract(u, '^[^?]*\\?(.*)$', 1)), '[&;]'), lambda k: regexp_matches(k, '^(" + "|".join(L.REDIRECT_PARAMS) + ")='))) >= 2)) > 0"),
    "credential_form_host": _flag(f"dom IS NOT NULL AND ({_FORM}) AND len(list_filter(hosts, lambda h: h <> dom AND NOT ends_with(h, '.' || dom))) > 0"),
    "attachment_dangerous": _any_ext(L.DANGEROUS_EXT),
    "attachment_macro": _any_ext(L.MACRO_EXT),
    "attachment_archive": _any_ext(L.ARCHIVE_EXT),
    "attachment_double_ext": _flag(f"len(list_filter(filenames, lambda f: (len(string_split(f, '.')) >= 3 AND {_in('string_split(f, chr(46))[-2]', [*L.DOUBLE_EXT, ''])}) OR regexp_matches(f, '[\\x{{202E}}\\x{{202D}}\\x{{200F}}]'))) > 0"),
    "attachment_count_n": "least(len(filenames) / 4, 1.0)",
    **{f: _flag(f) for f in ("ip_in_blacklist", "asn_risk", "vpn_proxy", "tor_exit", "open_relay", "cloud_hosted")},
    "geo_mismatch": _flag("lower(origin_country) <> lower(registrar_country)"),
    "reputation_low": _flag("reputation_low"),
}
VECTOR_SQL = MAIL_SQL + ", vec AS (SELECT msg_no, list_transform([" + ", ".join(f"CAST({FEATURE_SQL[f]} AS DOUBLE)" for f in L.FEATURES) + "], lambda v: CASE WHEN v BETWEEN 0 AND 1 THEN v END) AS x FROM mail)"
_NAMES = "[" + ", ".join(repr(f) for f in L.FEATURES) + "]"


@query(VECTOR_SQL + f" SELECT msg_no, feature, round(value, 6) AS value FROM (SELECT msg_no, unnest({_NAMES}) AS feature, unnest(x) AS value FROM vec) WHERE value IS NOT NULL")
def f_features(spark: SparkSession, d: str) -> DataFrame:
    """F00 to F59, from raw messages: (msg_no, feature, value); unobserved ones have no row. A13 to A20, P13 to P15, P19 and X14 as well."""
    named = F.zip_with(F.array(*[F.lit(x) for x in L.FEATURES]), F.col("x"), lambda n, x: F.struct(n.alias("feature"), x.alias("value")))
    return mail_vectors(spark, d).select("msg_no", F.explode(F.filter(named, lambda s: s["value"].isNotNull())).alias("f")).select("msg_no", "f.feature", F.round("f.value", 6).alias("value"))


def _scored_sql() -> str:
    z = ", ".join(f"{b} + list_sum(list_transform(range(1, 61), lambda i: greatest(-2.5, least(2.5, [{', '.join(map(repr, w))}][i] * coalesce(x[i], 0)))))" for b, w in zip(L.INTERCEPTS, scoring.weights(), strict=True))
    bec = f"1 / (1 + exp(-({L.BEC_INTERCEPT} + " + " + ".join(f"{g} * coalesce(x[{L.FEATURES.index(n) + 1}], 0)" for n, g in L.BEC_WEIGHTS.items()) + ")))"
    return f"""{VECTOR_SQL}, zs AS (SELECT msg_no, x, [{z}] AS z FROM vec), ps AS (SELECT msg_no, x, z, list_transform(z, lambda v: exp(v - list_max(z)) / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS p, {bec} AS bec FROM zs),
        s AS (SELECT *, 100 * (1 - p[1]) AS risk, 100 * (1 - p[1] * (1 - {L.W_BEC} * bec)) AS rf, pow(greatest(0, 1 - list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END)) / ln(8)), 0.7) AS conf, list_position(z, list_max(z)) - 1 AS top FROM ps)"""


@query(_scored_sql() + """ SELECT msg_no, round(risk, 6) AS risk, round(rf, 6) AS risk_final, round(conf, 6) AS confidence, CASE WHEN rf >= 60 THEN 'HIGH-RISK' WHEN rf >= 40 THEN 'SUSPICIOUS' ELSE 'LOW' END AS band,
    CASE WHEN conf < 0.5 THEN 'UNDETERMINED' WHEN conf < 0.7 THEN 'LOW_CONFIDENCE_REVIEW_ADVISED' ELSE 'DETERMINED' END AS verdict, CAST(top AS INTEGER) AS top FROM s""")
def m_mail_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every message through the whole pipeline: raw message, parser, features, model, blend, band, verdict."""
    s = scoring.score(mail_vectors(spark, d))
    return s.select("msg_no", *[F.round(c, 6).alias(c) for c in ("risk", "risk_final", "confidence")], "band", "verdict", "top")


@query(_scored_sql() + f""", terms AS (SELECT msg_no, unnest({_NAMES}) AS feature, unnest(range(60)) AS pos, unnest(list_transform(range(1, 61), lambda i: greatest(-2.5, least(2.5, ([{', '.join('[' + ', '.join(map(repr, w)) + ']' for w in scoring.weights())}][top + 1])[i] * coalesce(x[i], 0))))) AS c FROM s)
    SELECT msg_no, CAST(row_number() OVER (PARTITION BY msg_no ORDER BY -abs(c), pos) - 1 AS INTEGER) AS rank, feature, round(c, 6) + 0 AS contribution FROM terms WHERE c <> 0""")
def m10_mail_findings(spark: SparkSession, d: str) -> DataFrame:
    """M10 and W07 over the pipeline: clipped terms of the chosen class, strongest first, ties in vector order."""
    f = scoring.score(mail_vectors(spark, d)).select("msg_no", F.posexplode(scoring.findings("x", "top")).alias("rank", "f"))
    return f.select("msg_no", "rank", F.get(F.array(*[F.lit(x) for x in L.FEATURES]), F.col("f.pos")).alias("feature"), F.round("f.contribution", 6).alias("contribution"))


# --- the parser ------------------------------------------------------------------------------

_EPARTS = f"""(SELECT msg_no, count(*) AS k, bool_or(mimedepth > 0) AS many, bool_or(mimedepth = 2) AS inner_, arg_min(content, (lower(trim(string_split(coalesce(contenttype, 'text/plain'), ';')[1])) <> 'text/plain', -mimedepth, part_no)) FILTER (WHERE {_TEXT}) AS body FROM {_PARTS} GROUP BY 1)"""


@query(f"""SELECT CAST(m.msg_no AS VARCHAR) AS msg_id, coalesce(n, 0) AS n_hops, m.subject, CAST(k + CAST(many AS INTEGER) + CAST(inner_ AS INTEGER) AS INTEGER) AS n_parts, body, coalesce(n, 0) > 200 AS cut
    FROM {_M} m LEFT JOIN (SELECT msg_no, least(200, count(*)) AS n FROM hops GROUP BY 1) h USING (msg_no) JOIN {_EPARTS} USING (msg_no)""")
def p01_parse(spark: SparkSession, d: str) -> DataFrame:
    """P01 to P05, P17, P18, P20, P21 and S01 as well: every message with its own parts, encodings and charsets."""
    return parsed(spark, d).select("msg_id", F.size("hops").cast("bigint").alias("n_hops"), "subject", F.size("parts").alias("n_parts"), "body", F.array_contains("warnings", "RECEIVED_TRUNCATED").alias("cut"))


@query(f"""SELECT CAST(msg_no AS VARCHAR) AS msg_id, CAST(i AS INTEGER) AS index, hh AS host, lit AS ip, lower(CASE WHEN wc LIKE 'SUBMISSION%' THEN NULL ELSE wc END) AS protocol, byhost AS "by", viaclause AS via, idclause AS id, forclause AS "for", coalesce(trim(timestampraw), '') AS date, CASE WHEN {header_ms('timestampraw', True)} IS NOT NULL THEN {header_ms('timestampraw', True)} END AS ms
    FROM (SELECT *, row_number() OVER (PARTITION BY msg_no ORDER BY hopindex, hop_no) - 1 AS i, CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE string_split(fromclause, ' ')[1] END AS hh,
        CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE lower(nullif(regexp_extract(fromclause, '\\[([^\\]]*)\\]', 1), '')) END AS lit, {WITH_CLAUSE} AS wc FROM hops WHERE msg_no IN (SELECT msg_no FROM messages)) WHERE i < 200""")
def p08_hops(spark: SparkSession, d: str) -> DataFrame:
    """P09 and P10 as well: all clauses of every hop, and its instant."""
    h = mailparse.hop_rows(parsed(spark, d))
    return h.select("msg_id", "index", "host", "ip", F.lower("protocol").alias("protocol"), "by", "via", "id", "for", F.coalesce("date", F.lit("")).alias("date"), F.unix_millis(headers.header_date("date")).alias("ms"))


@query(f"""WITH m AS {_M}, a AS (SELECT msg_no, CASE WHEN display IS NOT NULL THEN display END AS display, sender AS addr FROM m WHERE sender IS NOT NULL UNION ALL SELECT msg_no, NULL, toaddr FROM m WHERE toaddr IS NOT NULL
    UNION ALL SELECT msg_no, 'Desk, main', 'desk@y.test' FROM m UNION ALL SELECT msg_no, 'Team', NULL FROM m UNION ALL SELECT msg_no, NULL, 'a@x.test' FROM m UNION ALL SELECT msg_no, NULL, 'b@X.test' FROM m)
    SELECT CAST(msg_no AS VARCHAR) AS msg_id, display, regexp_extract(addr, '^(.*)@', 1) AS local, lower(regexp_extract(addr, '^.*@(.*)$', 1)) AS domain FROM a""")
def p06_addresses(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(spark, d)
    return p.select("msg_id", F.explode(F.concat("from_addr", "to_addr", "cc_addr")).alias("a")).select("msg_id", "a.display", "a.local", "a.domain")


@query(MAIL_SQL + """, np AS (SELECT msg_no, count(*) + CAST(bool_or(mimedepth > 0) AS INTEGER) + CAST(bool_or(mimedepth = 2) AS INTEGER) AS n FROM parts GROUP BY 1)
    SELECT CAST(msg_no AS VARCHAR) AS msg_id, CAST(n AS INTEGER) AS n_parts, CASE WHEN latin THEN strlen(body) ELSE length(body) END AS n_chars, coalesce(n_hops, 0) > 25 AS cut, len(received) AS n_received FROM mail JOIN np USING (msg_no) LEFT JOIN (SELECT msg_no, n_hops FROM h) USING (msg_no)""")
def p19_parse_features_mode(spark: SparkSession, d: str) -> DataFrame:
    """P03 and P19 to P21 by the scoring's rules: its body text, its limits."""
    p = parsed(spark, d, "features")
    n = F.size(F.filter("headers", lambda x: x["name"] == "received")).cast("bigint")
    return p.select("msg_id", F.size("parts").alias("n_parts"), F.length("body").cast("bigint").alias("n_chars"), F.array_contains("warnings", "RECEIVED_COUNT_EXCEEDED").alias("cut"), n.alias("n_received"))


_VERDICT = "CASE WHEN contains(spf, 'fail') THEN 'fail' ELSE spf END"


@query(f"""SELECT CAST(msg_no AS VARCHAR) AS msg_id, CASE WHEN auth IS NOT NULL THEN spf END AS spf, CASE WHEN auth IS NOT NULL THEN dkim END AS dkim, CASE WHEN auth IS NOT NULL THEN dmarc END AS dmarc, CASE WHEN signature LIKE '%Mailer%' THEN 'mailer.test' WHEN signature IS NOT NULL THEN dom END AS signer,
    CASE WHEN received_spf IS NOT NULL THEN 'pass' WHEN auth IS NOT NULL THEN {_VERDICT} END AS verdict, received_spf IS NOT NULL AND auth IS NOT NULL AND {_VERDICT} <> 'pass' AS contradicted, CASE WHEN arc IS NOT NULL THEN 'arc-message-signature,arc-seal' ELSE '' END AS arc,
    CASE WHEN auth IS NOT NULL THEN 'x' END AS mailfrom FROM {_M}""")
def p13_auth_results(spark: SparkSession, d: str) -> DataFrame:
    """P12, P14, P15 and P16 as well."""
    all_ = lambda n: F.transform(F.filter("headers", lambda x: x["name"] == n), lambda x: x["value"])
    p = parsed(spark, d).select("msg_id", "arc", all_("authentication-results").alias("ar"), all_("dkim-signature").alias("ds"), F.get(all_("received-spf"), F.lit(0)).alias("rs"))
    with_spf = F.get(F.filter("ar", lambda h: F.contains(F.lower(h), F.lit("spf"))), F.lit(0))
    mailfrom = headers.auth_component(F.replace(with_spf, F.lit(" smtp.mailfrom"), F.lit("; smtp.mailfrom")), "smtp.mailfrom")
    return p.select(
        "msg_id", *[headers.first_auth_result("ar", m).alias(m) for m in ("spf", "dkim", "dmarc")], F.get(F.filter(F.transform("ds", headers.dkim_domain), lambda v: v.isNotNull()), F.lit(0)).alias("signer"),
        headers.spf_verdict(F.col("rs"), with_spf).alias("verdict"), headers.spf_contradiction(F.col("rs"), with_spf).alias("contradicted"), F.array_join("arc", ",").alias("arc"), mailfrom.alias("mailfrom"),
    )


@query(f"SELECT msg_no, hop_no, token FROM (SELECT msg_no, hop_no, lower({WITH_CLAUSE}) AS p, unnest([" + ", ".join(repr(t) for t in L.PROXY_TOKENS) + "]) AS token FROM hops) WHERE contains(p, token)")
def t03_indicators(spark: SparkSession, d: str) -> DataFrame:
    return attribution.indicators(table(spark, d, "hops").withColumn("protocol", F.expr(WITH_CLAUSE)))


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else repr(v)
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


def hint_values() -> tuple[str, str]:
    """The fixed hints of the attribution queries as SQL rows: networks and relay domains."""
    number = lambda q: sum(int(x) << (24 - 8 * k) for k, x in enumerate(q.split("/")[0].split(".")))
    nets = [(i, number(n), int(n.split("/")[1]) if "/" in n else 32, country, org, analysis.ASNS.get(org)) for i, (n, country, org) in enumerate(analysis.NETS) if n[0].isdigit()]
    return _values(nets), _values(analysis.RELAYS)


_ATTR = attribution_sql(f"(SELECT msg_no, hopindex, hop_no, ip, host, lower(protocol) AS via, {header_ms('timestampraw', True)} AS ms FROM hops)", *hint_values())
_ATTR_COLS = "msg_no, primary_ip, n, basis, contradicted, n_public, CAST(indicators AS BIGINT) AS indicators, originating, round(value, 6) AS value, CASE WHEN value >= 0.7 THEN 'STRONG' WHEN value >= 0.45 THEN 'MODERATE' WHEN value >= 0.25 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS band"


@query(_ATTR + f" SELECT {_ATTR_COLS.replace(', n,', ', CAST(n AS INTEGER) AS n_hops,').replace('n_public,', 'CAST(n_public AS INTEGER) AS n_public,').replace('CAST(indicators AS BIGINT)', 'CAST(indicators AS INTEGER)')}, CAST(coalesce(n_factors, -1) AS INTEGER) AS n_factors FROM attr")
def t07_attribution(spark: SparkSession, d: str) -> DataFrame:
    """T01, T02, T04 to T10, W02, W03, M08, R10, A13 to A15, J05 as well."""
    a = analysis.attributed(spark, table(spark, d, "hops").withColumn("ts", headers.header_date("timestampraw")))
    return a.select("msg_no", "primary_ip", "n_hops", "basis", "contradicted", "n_public", "indicators", "originating", F.round("value", 6).alias("value"), "band", F.coalesce(F.size("factors"), F.lit(-1)).alias("n_factors"))


_PIPED = attribution_sql(f"""(SELECT msg_no, i AS hopindex, i AS hop_no, ip, host, lower(wc) AS via, {header_ms('timestampraw', True)} AS ms FROM (SELECT msg_no, timestampraw, {WITH_CLAUSE} AS wc, row_number() OVER (PARTITION BY msg_no ORDER BY hopindex, hop_no) - 1 AS i,
    CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE string_split(fromclause, ' ')[1] END AS host, CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE lower(nullif(regexp_extract(fromclause, '\\[([^\\]]*)\\]', 1), '')) END AS ip
    FROM (SELECT hop_no, msg_no, hopindex, protocol, timestampraw, fromclause FROM hops WHERE msg_no IN (SELECT msg_no FROM messages))) WHERE i < 200)""", *hint_values())


@query(_PIPED + """, gate AS (SELECT *, [CASE WHEN primary_ip IS NULL THEN 'no public address was observed' END, CASE WHEN n = 1 THEN 'one hop only' END, CASE WHEN basis = 'HEADER_DEPTH' THEN 'some hops carry no usable time' END, CASE WHEN contradicted THEN 'hop times contradict the header order' END,
    CASE WHEN n_public > 1 THEN 'several public addresses were observed' END, CASE WHEN indicators > 0 THEN 'a relay names an intermediary protocol, or it or its network is on a list of intermediaries' END,
    CASE WHEN primary_ip IS NOT NULL AND asn IS NULL AND org IS NULL AND country IS NULL THEN 'the network of the primary address is not known' END, CASE WHEN anon_org THEN 'the registered operator is an anonymiser' END] AS u FROM attr)
    SELECT CAST(msg_no AS VARCHAR) AS msg_id, primary_ip, round(value, 6) AS value, CASE WHEN value >= 0.7 THEN 'STRONG' WHEN value >= 0.45 THEN 'MODERATE' WHEN value >= 0.25 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS band, CAST(indicators AS INTEGER) AS indicators, array_to_string(list_filter(u, lambda v: v IS NOT NULL), ', ') AS limits FROM gate""")
def t09_mail_attribution(spark: SparkSession, d: str) -> DataFrame:
    """T03, T04, T09, T11 and T13 over parsed messages: raw message, parser, hops, hints, attribution and what limits it."""
    h = mailparse.hop_rows(parsed(spark, d)).select(F.col("msg_id").alias("msg_no"), F.col("index").alias("hopindex"), F.col("index").alias("hop_no"), "ip", "host", F.col("with").alias("protocol"), headers.header_date("date").alias("ts"))
    a = analysis.attributed(spark, h)
    return a.select(F.col("msg_no").alias("msg_id"), "primary_ip", F.round("value", 6).alias("value"), "band", "indicators", F.array_join(attribution.uncertainty(a), ", ").alias("limits"))


_LIMITS = """[CASE WHEN primary_ip IS NULL THEN 'no public address was observed' END, CASE WHEN n = 1 THEN 'one hop only' END, CASE WHEN basis = 'HEADER_DEPTH' THEN 'some hops carry no usable time' END, CASE WHEN contradicted THEN 'hop times contradict the header order' END,
    CASE WHEN n_public > 1 THEN 'several public addresses were observed' END, CASE WHEN indicators > 0 THEN 'a relay names an intermediary protocol, or it or its network is on a list of intermediaries' END,
    CASE WHEN primary_ip IS NOT NULL AND asn IS NULL AND org IS NULL AND country IS NULL THEN 'the network of the primary address is not known' END, CASE WHEN anon_org THEN 'the registered operator is an anonymiser' END]"""


@query(_ATTR + f""" SELECT msg_no, concat_ws('; ', 'primary ' || coalesce(primary_ip, 'none') || ' confidence ' || printf('%.4f', value) || ' ' || CASE WHEN value >= 0.7 THEN 'STRONG' WHEN value >= 0.45 THEN 'MODERATE' WHEN value >= 0.25 THEN 'WEAK' ELSE 'INSUFFICIENT' END,
    array_to_string(list_filter({_LIMITS}, lambda v: v IS NOT NULL), ', ')) AS summary, '{attribution.DISCLAIMER}' AS disclaimer FROM attr""")
def t12_summary(spark: SparkSession, d: str) -> DataFrame:
    """T09 and T11 as well: one line per message, with the disclaimer."""
    return attribution.summary(analysis.attributed(spark, table(spark, d, "hops").withColumn("ts", headers.header_date("timestampraw"))))


@query(f"SELECT msg_no, {header_ms('dateheader')} AS ms, {scoring_ms('dateheader')} AS scoring_ms FROM messages")
def p10_header_date(spark: SparkSession, d: str) -> DataFrame:
    """P11 as well: every message by both rules, NULL where a rule can't read its date."""
    m = table(spark, d, "messages")
    return m.select("msg_no", F.unix_millis(headers.header_date("dateheader", tolerant=False)).alias("ms"), F.unix_millis(headers.scoring_date("dateheader")).alias("scoring_ms"))


# --- value sets and documents ----------------------------------------------------------------

_uniq = lambda e: f"array_to_string(list_sort(list_distinct(list_filter({e}, lambda v: v IS NOT NULL AND trim(v) <> ''))), ' ')"
_box = lambda e: f"CASE WHEN contains({e}, '@') THEN regexp_extract({e}, '^(.*)@', 1) || '@' || lower(regexp_extract({e}, '^.*@(.*)$', 1)) END"
_dom = lambda e: f"lower(nullif(regexp_extract({e}, '^.*@(.*)$', 1), ''))"
_ADDR = "CASE WHEN contains(reply_header, '<') THEN regexp_extract(reply_header, '<([^>]*)', 1) ELSE reply_header END"
_HEADER_NAMES = "['cc', 'content-type', " + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END"
    for n, c in {
        "return-path": "return_header IS NOT NULL", "received": "n > 0", "received-spf": "received_spf IS NOT NULL", "authentication-results": "auth IS NOT NULL OR auth_before IS NOT NULL", "dkim-signature": "signature IS NOT NULL", "arc-seal": "arc IS NOT NULL",
        "arc-message-signature": "arc IS NOT NULL", "from": "sender IS NOT NULL", "to": "toaddr IS NOT NULL", "reply-to": "reply_header IS NOT NULL", "subject": "subject IS NOT NULL", "message-id": "messageid IS NOT NULL", "date": "dateheader IS NOT NULL",
        "mime-version": "many", "content-transfer-encoding": "NOT many AND coded", "content-disposition": "NOT many AND disposed",
    }.items()
) + "]"
_KIND = "lower(trim(string_split(coalesce(contenttype, 'text/plain'), ';')[1]))"
_SETS = f"""WITH m AS {_M}, hh AS (SELECT msg_no, i, CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE lower(string_split(fromclause, ' ')[1]) END AS host, CASE WHEN hopindex = 0 AND msg_no % 13 = 0 THEN NULL ELSE lower(nullif(regexp_extract(fromclause, '\\[([^\\]]*)\\]', 1), '')) END AS ip, {header_ms('timestampraw', True)} AS ms
        FROM (SELECT msg_no, hopindex, fromclause, timestampraw, row_number() OVER (PARTITION BY msg_no ORDER BY hopindex, hop_no) - 1 AS i FROM hops) WHERE i < 200),
    h AS (SELECT msg_no, count(*) AS n, list(host) AS hosts, list(ip) AS ips, min(ms) AS first_ms, max(ms) AS last_ms FROM hh GROUP BY 1),
    p AS (SELECT msg_no, bool_or(mimedepth > 0) AS many, bool_or(transferencoding <> '') AS coded, bool_or(disposition IS NOT NULL) AS disposed, list({_KIND}) AS kinds, list(CASE WHEN disposition = 'attachment' THEN {_KIND} END) AS attached_kinds,
        list(CASE WHEN disposition = 'attachment' AND content <> '' THEN 'sha256:' || sha256(content) END) AS hashes, arg_min(content, ({_KIND} <> 'text/plain', -mimedepth, part_no)) FILTER (WHERE {_TEXT}) AS body FROM {_PARTS} GROUP BY 1),
    s AS (SELECT m.*, coalesce(h.n, 0) AS n, coalesce(hosts, []) AS hosts, coalesce(ips, []) AS ips, first_ms, last_ms, many, coded, disposed, kinds, attached_kinds, hashes, coalesce(body, '') AS body FROM m LEFT JOIN h USING (msg_no) JOIN p USING (msg_no))"""
_SET_COLS = {
    "mailboxes": _uniq(f"[{_box('sender')}, {_box('toaddr')}, 'desk@y.test', 'a@x.test', 'b@x.test']"),
    "domains": _uniq(f"[{_dom('sender')}, {_dom('toaddr')}, 'y.test', 'x.test'] || hosts"),
    "reply_domains": _uniq(f"[{_dom('sender')}, {_dom('toaddr')}, 'y.test', 'x.test', {_dom(_ADDR)}, {_domain('return_header')}]"),
    "hop_ips": _uniq("ips"),
    "candidate_ips": _uniq("ips || [CASE WHEN contains(return_header, '[192.0.2.77]') THEN '192.0.2.77' END]"),
    "header_names": _uniq(_HEADER_NAMES),
    "file_types": _uniq("kinds"),
    "attachment_hashes": _uniq("hashes"),
}


@query(_SETS + " SELECT CAST(msg_no AS VARCHAR) AS msg_id, " + ", ".join(f"{e} AS {k}" for k, e in _SET_COLS.items()) + " FROM s")
def u04_message_sets(spark: SparkSession, d: str) -> DataFrame:
    """U04, U05, U06, U07, U08 and U09: the distinct value sets of every parsed message."""
    s = documents.message_sets(parsed(spark, d))
    return s.select("msg_id", *[F.array_join(k, " ").alias(k) for k in _SET_COLS])


@query(_SETS + f""" SELECT CAST(msg_no AS VARCHAR) AS id, {_uniq(f"[{_dom('sender')}, {_domain('return_header')}]")} AS domains, {_uniq('ips')} AS addresses, {_uniq('attached_kinds')} AS file_types, first_ms AS observed_ms FROM s""")
def c01_library_documents(spark: SparkSession, d: str) -> DataFrame:
    x = documents.library_documents(parsed(spark, d))
    return x.select("id", *[F.array_join(k, " ").alias(k) for k in ("domains", "addresses", "file_types")], "observed_ms")


@query(_SETS + f" SELECT CAST(msg_no AS VARCHAR) AS id, {_SET_COLS['domains']} AS domains, {_SET_COLS['mailboxes']} AS addresses, {_SET_COLS['file_types']} AS file_types, {_SET_COLS['header_names']} AS header_names, coalesce(subject, '') AS subject, length(body) AS body_chars, last_ms AS observed_ms FROM s")
def c02_production_documents(spark: SparkSession, d: str) -> DataFrame:
    x = documents.production_documents(parsed(spark, d))
    return x.select("id", *[F.array_join(k, " ").alias(k) for k in ("domains", "addresses", "file_types", "header_names")], "subject", F.length("body").cast("bigint").alias("body_chars"), "observed_ms")


@query(f"SELECT msg_no, {header_ms('dateheader', True)} AS ms FROM messages")
def p10_header_date_all(spark: SparkSession, d: str) -> DataFrame:
    """Every message, comments and blanks passed over, NULL where its date can't be read; p10_header_date reads the exact forms."""
    return table(spark, d, "messages").select("msg_no", F.unix_millis(headers.header_date("dateheader")).alias("ms"))
