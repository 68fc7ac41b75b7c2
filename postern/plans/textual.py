"""Queries of scalar functions: strings, networks, dates, parsing by columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions import headers, lexicons, net, text
from postern.operators.orgprofile import brand_distance
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


LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ı": "i", "ɡ": "g", "0": "o", "1": "l", "ы": "bl"}
_ONE = {k: v for k, v in LOOKALIKES.items() if len(v) == 1}
_TOKENS = "list_slice(list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) BETWEEN 2 AND 32), 1, 4000)"
_URLS = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '(?i)https?://[^\\s\"''<>`)\\]]*'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), lambda u: length(u) > 12))"
_INV = "[\\x{200B}-\\x{200D}\\x{2060}-\\x{2064}\\x{180E}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E0000}-\\x{E000E}\\x{00AD}]"


@query(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS INTEGER) AS n_tokens, {_TOKENS.format('text')}[1] AS first_token FROM documents")
def x08_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"))


def _compatible() -> str:
    """VALUES of every character with a compatibility form, and that form taken apart: made by rule from the character database."""
    rows = ((chr(i), unicodedata.normalize("NFKD", chr(i))) for block in (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20)) for i in block if unicodedata.normalize("NFKC", chr(i)) != chr(i))
    return ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in rows)


# Normalised subjects: each character's form, composed again.
_NORMAL = f"""WITH form(ch, f) AS (VALUES {_compatible()}), chars AS (SELECT case_no, unnest(regexp_extract_all(subject, '(?s).')) AS ch, unnest(range(length(subject))) AS i FROM cases WHERE subject IS NOT NULL),
    composed AS (SELECT case_no, nfc_normalize(string_agg(coalesce(f, ch), '' ORDER BY i)) AS n FROM chars LEFT JOIN form USING (ch) GROUP BY case_no), normal AS (SELECT case_no, coalesce(n, subject) AS n FROM cases LEFT JOIN composed USING (case_no)),
    seen AS (SELECT case_no, n, regexp_replace(n, '{_INV}', '', 'g') AS v FROM normal)"""


@query(_NORMAL + " SELECT case_no, n AS normal FROM normal")
def x01_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """The normalised text of every subject."""
    return table(spark, d, "cases").select("case_no", text.nfkc("subject").alias("normal"))


@query(f"SELECT case_no, regexp_replace(subject, '{_INV}', '', 'g') AS visible FROM cases")
def x02_strip_invisible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_no", text.strip_invisible("subject").alias("visible"))


@query(f"SELECT case_no, replace(translate(subject, '{''.join(_ONE)}', '{''.join(_ONE.values())}'), 'ы', 'bl') AS folded FROM cases")
def x03_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_no", text.fold("subject", LOOKALIKES).alias("folded"))


@query(_NORMAL + f" SELECT case_no, lower(replace(translate(v, '{''.join(_ONE)}', '{''.join(_ONE.values())}'), 'ы', 'bl')) AS skeleton FROM seen")
def x04_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_no", text.skeleton("subject", LOOKALIKES).alias("skeleton"))


@query(_NORMAL + f" SELECT case_no, CASE WHEN length(v) > 0 THEN round(1 - length(translate(v, '{''.join(LOOKALIKES)}', '')) / length(v), 6) WHEN v = '' THEN 0 END AS ratio FROM seen")
def x05_homoglyph_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Every subject, NULL without one."""
    return table(spark, d, "cases").select("case_no", F.when(F.col("subject").isNotNull(), F.round(text.homoglyph_ratio("subject", LOOKALIKES), 6)).alias("ratio"))


@query(_NORMAL + " SELECT case_no, regexp_matches(v, '\\p{Latin}') AND len(list_filter(regexp_extract_all(v, '\\p{L}'), lambda c: regexp_matches(c, '[\\p{Cyrillic}\\p{Greek}]'))) > 0 AS mixed FROM seen")
def x06_mixed_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cases").select("case_no", text.mixed_script("subject", LOOKALIKES).alias("mixed"))


_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(ch, '\\p{{{x}}}') THEN '{x}'" for x in text.SCRIPTS) + " ELSE 'Common' END"


@query(f"SELECT script, count(*) AS n FROM (SELECT {_SCRIPT} AS script FROM (SELECT unnest(regexp_extract_all(subject, '(?s).')) AS ch FROM cases WHERE subject IS NOT NULL)) GROUP BY 1")
def x07_script_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A22 as well: characters by script; letters of one word are counted before the shuffle."""
    ch = table(spark, d, "cases").filter("subject is not null").select(F.explode(F.split("subject", "")).alias("ch")).filter("ch <> ''")
    return ch.select(text.script_of("ch").alias("script")).groupBy("script").agg(F.count(F.lit(1)).alias("n"))


_LABELS = """(SELECT msg_no, a, CASE msg_no % 5 WHEN 0 THEN a WHEN 1 THEN substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3) WHEN 2 THEN substr(a, 1, length(a) - 1) WHEN 3 THEN substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3) || 'xy' ELSE 'quellmark' END AS b
    FROM (SELECT msg_no, regexp_replace(regexp_replace(lower(fromaddr), '^.*@', ''), '[.].*$', '') AS a FROM messages))"""


@query(f"SELECT msg_no, CASE WHEN d <= 6 THEN CAST(d AS INTEGER) END AS distance FROM (SELECT msg_no, damerau_levenshtein(a, b) AS d FROM {_LABELS})")
def x09_osa_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each sender's label to a distorted one (swapped, cut, lengthened letters) or another name, up to 6."""
    table(spark, d, "messages").createOrReplaceTempView("messages")
    return spark.sql(f"SELECT * FROM {_LABELS}").select("msg_no", text.osa_distance("a", "b", 6).alias("distance"))


_CUES = " + ".join(f"CAST(contains(lower(body), '{x}') AS INTEGER)" for x in lexicons.PAYMENT)


@query(f"SELECT part_no, {_CUES} AS hits FROM parts WHERE body IS NOT NULL")
def x10_cue_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").filter("body is not null").select("part_no", text.cue_count(F.lower("body"), lexicons.PAYMENT).alias("hits"))


def _weighted_sql(col: str, lex) -> str:
    """Nested text after each phrase, and the sum of weights found."""
    expr, total = col, []
    for p, w in lex:
        total.append(f"CASE WHEN contains({expr}, '{p}') THEN {w} ELSE 0 END")
        expr = f"replace({expr}, '{p}', ' ')"
    return "round(" + " + ".join(total) + ", 6)"


@query(f"SELECT part_no, CAST({_weighted_sql('t', lexicons.AUTHORITY)} AS DOUBLE) AS weight FROM (SELECT part_no, lower(body) AS t FROM parts WHERE body IS NOT NULL)")
def x11_weighted_hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").filter("body is not null").select("part_no", F.round(text.weighted_hits(F.lower("body"), lexicons.AUTHORITY), 6).alias("weight"))


@query("SELECT part_no, regexp_matches(' ' || lower(body) || ' ', '[^\\p{L}](aldreth torbarford|aldreth|torbarford)[^\\p{L}]') AS named FROM parts WHERE body IS NOT NULL")
def x12_names_whole(spark: SparkSession, d: str) -> DataFrame:
    """R07 as well: a person's full name or any longer part of it, bounded by non-letters."""
    return table(spark, d, "parts").filter("body is not null").select("part_no", text.names_whole("body", "Aldreth Torbarford").alias("named"))


@query("""SELECT msg_no, string_split(originhost, '.')[1] AS label, string_split(originhost, '.')[-1] AS tld, CAST(len(string_split(originhost, '.')) AS INTEGER) AS labels,
    round(CASE WHEN length(string_split(originhost, '.')[1]) > 0 THEN length(regexp_replace(string_split(originhost, '.')[1], '[^0-9-]', '', 'g')) / length(string_split(originhost, '.')[1]) ELSE 0 END, 6) AS digit_dash
    FROM messages WHERE originhost IS NOT NULL""")
def x13_domain_parts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").filter("originhost is not null")
    lab = text.first_label("originhost")
    return m.select("msg_no", lab.alias("label"), text.tld("originhost").alias("tld"), F.size(F.split("originhost", r"\.")).alias("labels"), F.round(text.digit_dash_ratio(lab), 6).alias("digit_dash"))


@query(f"""SELECT part_no, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) END AS ext,
    len(string_split(filename, '.')) >= 3 AND coalesce(lower(string_split(filename, '.')[-2]) IN ({", ".join(repr(x) for x in lexicons.DOUBLE_EXT)}, ''), false) AS double_ext,
    regexp_matches(filename, '[\\x{{202E}}\\x{{202D}}\\x{{200F}}]') AS rtl FROM parts WHERE filename IS NOT NULL""")
def x14_filenames(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parts").filter("filename is not null")
    return p.select("part_no", text.extension("filename").alias("ext"), F.coalesce(text.double_extension("filename", lexicons.DOUBLE_EXT), F.lit(False)).alias("double_ext"), text.rtl_override("filename").alias("rtl"))


@query("SELECT part_no, CASE WHEN length(body) > 80 THEN substr(body, 1, 80) || '...[truncated]' ELSE body END AS short FROM parts")
def x15_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").select("part_no", text.truncate("body", 80).alias("short"))


@query("""SELECT part_no, regexp_replace(regexp_replace(regexp_replace(body, '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[EMAIL_REDACTED]', 'g'),
    '(\\+\\d{1,3}[- ]?)?\\d{10}|(\\d{3}[- .]\\d{3}[- .]\\d{4})', '[PHONE_REDACTED]', 'g'), '\\b(?:\\d[ -]*?){13,16}\\b', '[CARD_REDACTED]', 'g') AS masked FROM parts""")
def x16_mask_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").select("part_no", text.mask_pii("body").alias("masked"))


@query("SELECT part_no, CASE WHEN body <> '' THEN 'sha256:' || sha256(body) END AS content FROM parts")
def x17_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").select("part_no", text.content_hash("body").alias("content"))


def uuid5_sql(name: str) -> str:
    """Name-based identifier of a text expression under the fixed namespace."""
    h = f"sha1(from_hex('00abedb4aa42466c9c01fed23315a9b7') || encode({name}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


@query(f"SELECT msg_no, {uuid5_sql('messageid')} AS uid FROM messages WHERE messageid IS NOT NULL")
def x18_uuid5(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").filter("messageid is not null")
    return m.select("msg_no", text.uuid5("00abedb4-aa42-466c-9c01-fed23315a9b7", "messageid").alias("uid"))


_SCALED = "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * o_totalprice * pow(10.0, CAST(o_orderkey % 25 AS DOUBLE) - 12) END"


@query(f"""SELECT o_orderkey, CASE WHEN v = 0 THEN '0' WHEN contains(e, 'e+1') OR regexp_matches(e, 'e-(0[5-9]|[1-9])') THEN e WHEN contains(f, '.') THEN regexp_replace(regexp_replace(f, '0+$', ''), '[.]$', '') ELSE f END AS txt FROM (
    SELECT o_orderkey, v, e, printf('%.' || greatest(0, 9 - CAST(regexp_extract(e, 'e([+-][0-9]+)$', 1) AS INTEGER)) || 'f', v) AS f FROM (SELECT o_orderkey, {_SCALED} AS v, printf('%.9e', {_SCALED}) AS e FROM orders))""")
def x19_canonical_number(spark: SparkSession, d: str) -> DataFrame:
    """Prices from 1e-12 to 1e+18 times their size, and zeros."""
    return table(spark, d, "orders").select("o_orderkey", F.expr(_SCALED).alias("v")).select("o_orderkey", text.canonical_number("v").alias("txt"))


_NUM = "CASE WHEN regexp_matches(ip, '^((25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)$') THEN CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536 + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) END"


@query(f"SELECT hop_no, {_NUM} AS number FROM hops")
def x21_ipv4_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hops").select("hop_no", net.ipv4_number("ip").alias("number"))


@query(f"SELECT hop_no, {_NUM} BETWEEN 3323068416 AND 3323199487 AS inside FROM hops")
def x22_in_cidr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hops").select("hop_no", net.in_cidr("ip", F.lit("198.18.0.0/15")).alias("inside"))


SCOPE_SQL = f"""CASE WHEN ip IS NULL OR trim(ip) = '' THEN 'UNKNOWN'
    WHEN contains(ip, ':') THEN CASE WHEN ip = '::1' THEN 'LOOPBACK' WHEN ip = '::' THEN 'UNSPECIFIED' WHEN regexp_matches(ip, '^f[cd]') THEN 'PRIVATE' WHEN regexp_matches(ip, '^fe[89ab]') THEN 'LINK_LOCAL'
        WHEN ip LIKE 'ff%' THEN 'MULTICAST' WHEN ip LIKE '2001:db8:%' THEN 'RESERVED' WHEN regexp_matches(ip, '^[23][0-9a-f]{{3}}:') THEN 'PUBLIC' ELSE 'RESERVED' END
    WHEN {_NUM} IS NULL THEN 'UNKNOWN' WHEN ip = '0.0.0.0' THEN 'UNSPECIFIED' WHEN ip = '255.255.255.255' THEN 'BROADCAST' WHEN ip LIKE '127.%' THEN 'LOOPBACK'
    WHEN ip LIKE '10.%' OR ip LIKE '192.168.%' OR regexp_matches(ip, '^172\\.(1[6-9]|2\\d|3[01])\\.') THEN 'PRIVATE' WHEN ip LIKE '169.254.%' THEN 'LINK_LOCAL'
    WHEN regexp_matches(ip, '^100\\.(6[4-9]|[7-9]\\d|1[01]\\d|12[0-7])\\.') THEN 'CARRIER_GRADE_NAT'
    WHEN regexp_matches(ip, '^(192\\.0\\.0|192\\.0\\.2|198\\.18\\.0|198\\.51\\.100|203\\.0\\.113)\\.') THEN 'RESERVED'
    WHEN regexp_matches(ip, '^2(2[4-9]|3\\d)\\.') THEN 'MULTICAST' WHEN regexp_matches(ip, '^2(4\\d|5\\d)\\.') THEN 'RESERVED' ELSE 'PUBLIC' END"""


@query(f"SELECT hop_no, {SCOPE_SQL} AS scope FROM hops")
def x23_ip_scope(spark: SparkSession, d: str) -> DataFrame:
    """T01 and R03 as well."""
    return table(spark, d, "hops").select("hop_no", net.ip_scope("ip").alias("scope"))


# Hosts that the tables don't have, as the verdict has words for them.
_HOSTS = ["", "localhost", "metadata.google.internal", "0x7f.1", "010.1.2.3", "1.2.3", "256.1.1.1", "127.0.0.1", "10.1.2.3", "172.20.1.1", "169.254.1.1", "100.64.0.1", "192.0.0.8", "192.88.99.1", "224.0.0.1", "240.0.0.1", "8.8.8.8",
    "::", "::1", "::ffff:10.0.0.1", "2001::1", "2002::1", "64:ff9b::1", "fd00::1", "fe80::1", "fe80::1%eth0", "ff02::1", "2606:4700::1111", "[2606:4700::1111]", "x:y", "intranet", "bad_host.com", "a..com"]
_HOST_ROWS = """SELECT host FROM hops UNION ALL SELECT ip FROM hops UNION ALL SELECT byhost FROM hops UNION ALL SELECT regexp_replace(host, '[.](test|example|invalid)$', '.com') FROM hops UNION ALL SELECT v AS host FROM (VALUES """ + ", ".join(f"('{h}')" for h in _HOSTS) + ") AS t(v)"
_OCTETS = "list_transform(string_split(h, '.'), lambda o: TRY_CAST(o AS INTEGER))"


@query(f"""SELECT host, n, CASE WHEN h IS NULL OR h = '' THEN 'empty_host' WHEN length(h) > 253 THEN 'host_too_long' WHEN h IN ({', '.join(map(repr, net.METADATA_NAMES))}) THEN 'cloud_metadata_name' WHEN h IN ({', '.join(map(repr, net.RESERVED_TLDS))}) THEN 'reserved_hostname'
    WHEN contains(h, '.') AND string_split(h, '.')[-1] IN ({', '.join(map(repr, net.RESERVED_TLDS))}) THEN 'reserved_tld' WHEN h LIKE '0x%' OR regexp_matches(h, '(^|[.])0[^.]') THEN 'non_canonical_ip_literal'
    WHEN regexp_matches(h, '^[0-9.]*[.][0-9.]*$') THEN CASE WHEN NOT regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') OR list_max(o) > 255 THEN 'malformed_ipv4' WHEN o[1] = 0 THEN 'unspecified' WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 10 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) THEN 'private'
        WHEN o[1] = 169 AND o[2] = 254 THEN 'link_local' WHEN o[1] = 100 AND o[2] BETWEEN 64 AND 127 THEN 'cgnat' WHEN o[1] = 192 AND o[2] = 0 AND o[3] = 0 THEN 'ietf_protocol_assignment' WHEN (o[1] = 192 AND o[2] = 0 AND o[3] = 2) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113) THEN 'documentation'
        WHEN o[1] = 192 AND o[2] = 88 AND o[3] = 99 THEN '6to4_relay' WHEN o[1] = 198 AND o[2] IN (18, 19) THEN 'benchmarking' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' WHEN o[1] >= 240 THEN 'reserved' ELSE 'allow' END
    WHEN contains(h, ':') THEN CASE WHEN contains(h, '%') THEN 'ipv6_zone_id' WHEN NOT regexp_matches(h, '^[0-9a-f:.]+$') THEN 'malformed_ipv6' WHEN h = '::' THEN 'unspecified' WHEN h = '::1' THEN 'loopback' WHEN h LIKE '::ffff:%' THEN 'ipv4_mapped' WHEN h LIKE '2001:db8:%' THEN 'documentation' WHEN h LIKE '2001::%' THEN 'teredo'
        WHEN h LIKE '2002:%' THEN '6to4' WHEN h LIKE '64:ff9b::%' THEN 'nat64' WHEN regexp_matches(h, '^f[cd]') THEN 'unique_local' WHEN regexp_matches(h, '^fe[89ab]') THEN 'link_local' WHEN h LIKE 'ff%' THEN 'multicast' ELSE 'allow' END
    WHEN NOT contains(h, '.') THEN 'non_fqdn_hostname' WHEN NOT regexp_matches(h, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+$') THEN 'malformed_hostname' ELSE 'allow' END AS verdict
    FROM (SELECT host, n, h, {_OCTETS} AS o FROM (SELECT host, count(*) AS n, lower(regexp_replace(trim(host), '^[[](.+)[]]$', '\\1')) AS h FROM ({_HOST_ROWS}) GROUP BY host))""")
def x24_fetch_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and addresses of all hops, the hosts under a public top-level name, and one host for every other verdict."""
    table(spark, d, "hops").createOrReplaceTempView("hops")
    h = spark.sql(_HOST_ROWS).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return h.select("host", "n", net.fetch_verdict("host").alias("verdict"))


@query("SELECT part_no, len(x) AS n, x[1] AS first_ip FROM (SELECT part_no, list_filter(list_transform(regexp_extract_all(body, '[0-9.]+'), lambda r: regexp_replace(r, '^\\.+|\\.+$', '', 'g')), lambda r: regexp_matches(r, '^((25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)$')) AS x FROM parts WHERE body IS NOT NULL)")
def p26_extract_ips(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "parts").filter("body is not null").select("part_no", net.extract_ips("body").alias("x"))
    return x.select("part_no", F.size("x").cast("bigint").alias("n"), F.get("x", F.lit(0)).alias("first_ip"))


@query(f"SELECT doc_id, len({_URLS.format('text')}) AS n FROM documents")
def p22_urls_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(net.urls_b("text")).cast("bigint").alias("n"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)https?://[^\\s\"''<>)|]*'), lambda u: regexp_replace(u, '[.,;:!]+$', '')), lambda u: length(u) > 8)) AS n FROM documents")
def p23_urls_a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(net.urls_a("text")).cast("bigint").alias("n"))


@query("SELECT case_no, u AS url, lower(regexp_extract(u, '://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host FROM (SELECT case_no, unnest(urls) AS u FROM cases) WHERE u IS NOT NULL")
def p24_host_b(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "cases").select("case_no", F.explode("urls").alias("url")).filter("url is not null")
    return u.select("case_no", "url", net.url_host_b("url").alias("host"))


@query("SELECT case_no, u AS url, lower(CASE WHEN contains(a, '@') THEN regexp_replace(string_split(a, '@')[1], ':.*$', '') ELSE regexp_replace(a, ':.*$', '') END) AS host FROM (SELECT case_no, u, regexp_extract(u, '://([^/?#]*)', 1) AS a FROM (SELECT case_no, unnest(urls) AS u FROM cases) WHERE u IS NOT NULL)")
def p25_host_a(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "cases").select("case_no", F.explode("urls").alias("url")).filter("url is not null")
    return u.select("case_no", "url", net.url_host_a("url").alias("host"))


@query("SELECT msg_no, CASE WHEN contains(a, '@') THEN regexp_replace(lower(string_split(a, '@')[-1]), '^[.-]+', '') END AS domain FROM (SELECT msg_no, CASE WHEN regexp_matches(fromaddr, '<[^>]*>') THEN regexp_extract(fromaddr, '<([^>]*)>', 1) ELSE trim(fromaddr) END AS a FROM messages)")
def p07_address_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_no", headers.address_domain("fromaddr").alias("domain"))


@query("SELECT msg_no, regexp_extract_all(coalesce(messageid, ''), '<([^>]*)>', 1)[1] AS bare FROM messages")
def p27_bracket_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("msg_no", F.get(headers.message_ids("messageid"), F.lit(0)).alias("bare"))


@query("SELECT o_orderkey, strftime(make_timestamp_ms(o_orderkey * 86400123), '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM orders")
def x29_iso_millis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", headers.iso_millis(F.col("o_orderkey") * 86400123).alias("stamp"))


@query("SELECT o_orderkey, floor(o_totalprice / 7 * 10000 + 0.5) / 10000 AS half_up FROM orders")
def x30_round_half_up(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.round_half_up(F.col("o_totalprice") / 7).alias("half_up"))


_BRANDS = ["belmar", "norden", "corveth", "quellmark"]
_NEAR = ", ".join(f"{{'d': damerau_levenshtein(label, '{b}'), 'i': {i}, 'b': '{b}'}}" for i, b in enumerate(_BRANDS))


@query(f"""SELECT label, CASE WHEN m.d <= 2 THEN m.b END AS brand, CASE WHEN m.d <= 2 THEN CAST(m.d AS INTEGER) END AS distance FROM (SELECT label, list_min([{_NEAR}]) AS m FROM (SELECT DISTINCT unnest(string_split(h, '.')) AS label FROM (
    SELECT lower(originhost) AS h FROM messages UNION ALL SELECT regexp_replace(lower(fromaddr), '^.*@', '') FROM messages)))""")
def j06_brand_distance(spark: SparkSession, d: str) -> DataFrame:
    """A19 as well: nearest brand of every distinct label of hosts and sender domains, and its distance."""
    m = table(spark, d, "messages")
    names = m.select(F.lower("originhost").alias("h")).unionByName(m.select(F.regexp_replace(F.lower("fromaddr"), "^.*@", "").alias("h")))
    return brand_distance(names.select(F.explode(F.split("h", r"\.")).alias("label")).distinct(), "label", _BRANDS)
