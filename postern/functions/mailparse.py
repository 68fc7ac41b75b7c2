"""Raw messages to nested rows: one Arrow-batched parser with two rule sets.

Mode "evidence" feeds attribution and correlation, mode "features" the scoring; they differ in
limits and decoding. The parser never raises: what it can't read or had to cut is listed in
`warnings`. Sizes are the only limits; there is no time budget, so results don't depend on load.
"""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.functions.headers import CHARSETS


@dataclass(frozen=True)
class Limits:
    """Fixed values of a rule set."""

    message: int
    headers: int
    received: int
    line: int = 8192
    depth: int = 8
    parts: int = 200
    decoded: int = 10 << 20
    value: int = 65536
    addresses: int = 512
    base64_lines: int | None = None
    urls: int | None = None


MODES = {
    "evidence": Limits(message=2 << 20, headers=500, received=200),
    "features": Limits(message=5 << 20, headers=100, received=25, base64_lines=2000, urls=1000),
}
# The codes of what a rule set cut; both say PARSE_TRUNCATED as well then.
CODES = {
    "evidence": {"line": "HEADER_LINE_EXCEEDED", "parts": "MIME_PART_LIMIT", "budget": "DECODED_CONTENT_EXCEEDED", "received": "RECEIVED_TRUNCATED"},
    "features": {"line": "HEADER_LINE_TRUNCATED", "parts": "MIME_PART_LIMIT_EXCEEDED", "budget": "DECODE_BUDGET_EXCEEDED", "received": "RECEIVED_COUNT_EXCEEDED"},
}
CUTS = {c for m in CODES.values() for c in m.values()} | {"MESSAGE_TRUNCATED", "HEADER_COUNT_EXCEEDED", "HEADER_VALUE_TRUNCATED", "MIME_DEPTH_EXCEEDED", "BASE64_LINE_LIMIT_EXCEEDED", "URL_LIMIT_EXCEEDED"}
LINK = re.compile(r"""https?://[^\s"'<>)|]*""", re.I)

ADDRESS = "struct<raw:string,display:string,local:string,domain:string>"
HOP = "struct<index:int,raw:string,host:string,ip:string,date:string,protocol:string,by:string,from:string,with:string,id:string,for:string,via:string>"
PART = "struct<depth:int,content_type:string,disposition:string,filename:string,encoding:string,charset:string,data:binary,declared:bigint,truncated:boolean,container:boolean>"
SCHEMA = (
    f"msg_id string, headers array<struct<name:string,value:string,folded:boolean,lines:int>>, from_addr array<{ADDRESS}>, to_addr array<{ADDRESS}>, cc_addr array<{ADDRESS}>, "
    f"reply_to array<{ADDRESS}>, return_path string, subject string, message_id string, date string, references array<string>, hops array<{HOP}>, parts array<{PART}>, "
    "body string, arc array<string>, warnings array<string>"
)

NAME = re.compile(r"^[!-9;-~]+$")
CLAUSE = re.compile(r"^(by|from|with|id|for|via)$", re.I)
PROTOCOLS = set([
    "smtp", "esmtp", "esmtps", "esmtpa", "esmtpsa", "lmtp", "lmtps", "lmtpa", "lmtpsa", "http", "https", "utf8smtp", "utf8smtps", "utf8smtpa",
    "utf8smtpsa", "mmdf", "uucp",
])
QUAD = re.compile(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")


def split_message(raw: bytes) -> tuple[bytes, bytes]:
    """Header block and body at the first blank line; without one everything is header."""
    m = re.search(rb"\r?\n\r?\n", raw)
    if raw[:1] in (b"\n", b"\r"):
        return b"", raw.lstrip(b"\r\n")
    return (raw[: m.start()], raw[m.end() :]) if m else (raw, b"")


def unfold(block: str, lim: Limits, warn: list[str], code: str = "HEADER_LINE_TRUNCATED") -> list[tuple[str, str, bool, int]]:
    """(lower-case name, value, folded, lines) in order; continuation lines join with one space."""
    out: list[list] = []
    for line in block.splitlines():
        if len(line) > lim.line:
            warn.append(code)
            line = line[: lim.line]
        if line[:1] in (" ", "\t"):
            if not out:
                warn.append("HEADER_CONTINUATION_ORPHAN")
                continue
            h = out[-1]
            h[1], h[2], h[3] = h[1] + " " + line.strip(), True, h[3] + 1
            continue
        name, sep, value = line.partition(":")
        if not sep:
            if line:
                warn.append("MALFORMED_HEADER_LINE")
            continue
        if not NAME.match(name.rstrip()):
            warn.append("MALFORMED_HEADER_NAME")
            continue
        if len(out) >= lim.headers:
            warn.append("HEADER_COUNT_EXCEEDED")
            break
        out.append([name.rstrip().lower(), value.strip(), False, 1])
    for h in out:
        if len(h[1]) > lim.value:
            warn.append("HEADER_VALUE_TRUNCATED")
            h[1] = h[1][: lim.value]
    return [tuple(h) for h in out]


def split_outside(text: str, sep: str) -> list[str]:
    """Pieces between separators that lie outside quotes, angle brackets and comments."""
    out, now, quote, angle, paren = [], [], False, 0, 0
    skip = False
    for ch in text:
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"' and not paren:
            quote = not quote
        elif not quote:
            paren += (ch == "(") - (ch == ")" and paren > 0)
            angle += (ch == "<") - (ch == ">" and angle > 0)
            if ch == sep and not angle and not paren:
                out.append("".join(now))
                now = []
                continue
        now.append(ch)
    return [*out, "".join(now)]


def addresses(text: str | None, cap: int) -> list[dict]:
    """Addresses of a list header; a group keeps its name only, what can't be read is kept raw."""
    out = []
    for item in split_outside(text or "", ","):
        item = item.strip()
        if not item or len(out) >= cap:
            continue
        if re.match(r'^[^<>"@]+:', item):
            name, _, rest = item.partition(":")
            out.append({"raw": item, "display": name.strip(), "local": None, "domain": None})
            item = rest.strip(" ;")
            if not item or len(out) >= cap:
                continue
        m = re.search(r"<([^<>]*)>", item)
        addr = m[1].strip() if m else (re.sub(r"\([^()]*\)", "", item).split() or [""])[-1].rstrip(";")
        display = item[: m.start()].strip().strip('"') if m else None
        local, at, domain = addr.rpartition("@")
        good = bool(at and local and domain)
        out.append({"raw": item, "display": display or None, "local": local if good else None, "domain": domain.lower() if good else None})
    return out


def bracketed_ip(text: str) -> str | None:
    """First address literal in brackets: strict v4, or anything with the structure of v6."""
    for lit in re.findall(r"\[([^\[\]]*)\]", text):
        lit = re.sub(r"^IPv6:", "", lit.strip(), flags=re.I)
        if QUAD.match(lit):
            return lit
        if re.match(r"^[0-9A-Fa-f:]{2,39}$", lit) and ":" in lit and lit.count("::") <= 1 and all(len(g) <= 4 for g in lit.split(":")):
            return lit.lower()
    return None


def hop(raw: str, index: int) -> dict:
    """Clauses of a Received header; parenthesised groups stay whole; the date follows the last semicolon."""
    path, sep, date = raw.rpartition(";")
    path = path if sep else raw
    tokens = re.findall(r"\((?:[^()]|\([^()]*\))*\)|[^\s()]+", path)
    clauses: dict[str, list[str]] = {}
    key = None
    for t in tokens:
        k, eq, v = t.partition("=")
        if CLAUSE.match(t):
            key = t.lower()
            clauses.setdefault(key, [])
        elif eq and CLAUSE.match(k):
            clauses.setdefault(k.lower(), []).append(v)
        elif key:
            clauses[key].append(t)
    text = {k: " ".join(v) for k, v in clauses.items()}
    proto = (text.get("with") or "").split(" ")[0]
    host = (clauses.get("from") or [None])[0]
    if host and (host[0] in "[(" or CLAUSE.match(host) or host.lower() in PROTOCOLS):
        host = None
    return {
        "index": index, "raw": raw, "host": host, "ip": bracketed_ip(text.get("from", "")), "date": date.strip() if sep else None, "protocol": proto if proto.lower() in PROTOCOLS else None,
        **{k: text.get(k) for k in ("by", "from", "with", "id", "for", "via")},
    }


def param(value: str, *names: str) -> str | None:
    for n in names:
        m = re.search(rf"""(?:^|;)\s*{re.escape(n)}\*?\s*=\s*(?:"([^"]*)"|([^;\s]*))""", value, re.I)
        if m:
            return (m[1] if m[1] is not None else m[2])[:256]
    return None


def decode(data: bytes, encoding: str, budget: int, warn: list[str], mode: str) -> tuple[bytes, bool]:
    """Decoded bytes within the budget and whether something was cut."""
    lines = MODES[mode].base64_lines
    if encoding == "base64":
        if lines is not None and data.count(b"\n") > lines:
            warn.append("BASE64_LINE_LIMIT_EXCEEDED")
            data = b"\n".join(data.split(b"\n", lines + 1)[: lines + 1])
        clean = re.sub(rb"[^A-Za-z0-9+/]", b"", data.split(b"=")[0])
        try:
            data = base64.b64decode(clean + b"=" * (-len(clean) % 4))
        except (binascii.Error, ValueError):
            warn.append("BASE64_DECODE_FAILED")
            data = b""
    elif encoding == "quoted-printable" and mode == "evidence":
        data = quopri.decodestring(data)
    if len(data) > budget:
        warn.append(CODES[mode]["budget"])
        return data[:budget], True
    return data, False


class Walker:
    """Depth-first walk over the parts of a body under one global decode budget."""

    def __init__(self, mode: str, warn: list[str]):
        self.lim, self.warn, self.mode = MODES[mode], warn, mode
        self.left, self.parts = self.lim.decoded, []

    def walk(self, head: dict[str, str], body: bytes, depth: int) -> None:
        if len(self.parts) >= self.lim.parts:
            self.warn.append(CODES[self.mode]["parts"])
            return
        ctype = head.get("content-type", "text/plain")
        kind = ctype.split(";")[0].strip().lower() or "text/plain"
        disposition = head.get("content-disposition", "")
        encoding = head.get("content-transfer-encoding", "").strip().lower()
        cs = (param(ctype, "charset") or "utf-8").lower()
        boundary = param(ctype, "boundary") if kind.startswith("multipart/") else None
        row = {
            "depth": depth, "content_type": kind, "disposition": disposition.split(";")[0].strip().lower() or None, "filename": param(disposition, "filename") or param(ctype, "name"),
            "encoding": encoding or None, "charset": cs if cs in CHARSETS else "utf-8", "charset_given": param(ctype, "charset") is not None, "data": None, "declared": len(body), "truncated": False, "container": bool(boundary),
        }
        self.parts.append(row)
        if not boundary:
            row["data"], row["truncated"] = decode(body, encoding, self.left, self.warn, self.mode)
            self.left -= len(row["data"])
            return
        if depth + 1 > self.lim.depth:
            self.warn.append("MIME_DEPTH_EXCEEDED")
            return
        mark = re.compile(rb"(?:^|\r?\n)--" + re.escape(boundary.encode("latin-1", "replace")) + rb"(--)?[ \t]*(?=\r?\n|$)")
        starts = list(mark.finditer(body))
        for m, nxt in zip(starts, [*starts[1:], None], strict=True):
            if m[1]:
                break
            chunk = re.sub(rb"^\r?\n", b"", body[m.end() : nxt.start() if nxt else len(body)], count=1)
            h, b = split_message(chunk) if not re.match(rb"\r?\n", body[m.end() : m.end() + 4] + chunk[:2]) or chunk[:1] not in (b"\r", b"\n") else (b"", chunk.lstrip(b"\r\n"))
            self.walk({n: v for n, v, _, _ in reversed(unfold(h.decode("latin-1"), self.lim, self.warn, CODES[self.mode]["line"]))}, b, depth + 1)


def body_text(parts: list[dict], mode: str, body: bytes, heads: dict[str, str]) -> str | None:
    """First plain text, else first text of any kind.

    In mode features it is the body as it stands of a message without parts, else the last text
    directly below the top that is no attachment, else the first text anywhere.
    """
    texts = [p for p in parts if p["content_type"].startswith("text/") and p["data"] is not None]
    if mode == "evidence":
        best = next((p for p in texts if p["content_type"] == "text/plain"), texts[0] if texts else None)
        return None if best is None else best["data"].decode(best["charset"], "replace")
    if not parts or not parts[0]["container"]:
        return body.decode("latin-1")
    top = [p for p in texts if p["depth"] == 1 and p["disposition"] != "attachment" and p["data"]]
    if top and (text := top[-1]["data"].decode(top[-1]["charset"] if top[-1]["charset_given"] else "ascii", "replace")):
        return text
    return texts[0]["data"].decode("utf-8", "replace") if texts else None


def parse(msg_id: str, raw: bytes | None, mode: str = "evidence") -> dict:
    """One message as a row of SCHEMA; null and empty content give an empty row."""
    lim, warn = MODES[mode], []
    raw = bytes(raw or b"")
    if len(raw) > lim.message:
        warn.append("MESSAGE_TRUNCATED")
        raw = raw[: lim.message]
    block, body = split_message(raw)
    heads = unfold(block.decode("latin-1"), lim, warn, CODES[mode]["line"])
    first: dict[str, str] = {}
    for n, v, _, _ in heads:
        first.setdefault(n, v)
    received = [v for n, v, _, _ in heads if n == "received"]
    if len(received) > lim.received:
        warn.append(CODES[mode]["received"])
        received, seen = received[: lim.received], 0
        if mode == "features":  # this rule set doesn't keep the rest as headers either
            kept = []
            for h in heads:
                seen += h[0] == "received"
                if h[0] != "received" or seen <= lim.received:
                    kept.append(h)
            heads = kept
    w = Walker(mode, warn)
    w.walk(first, body, 0)
    text = body_text(w.parts, mode, body, first)
    if lim.urls is not None and len(LINK.findall(text or "")) > lim.urls:
        warn.append("URL_LIMIT_EXCEEDED")  # the links themselves are a matter of net.urls_a
    if CUTS.intersection(warn):
        warn.append("PARSE_TRUNCATED")
    addr = lambda n: addresses(first.get(n), lim.addresses)
    ids = re.findall(r"<([^>]*)>", first.get("references", ""))
    return {
        "msg_id": msg_id, "headers": [{"name": n, "value": v, "folded": f, "lines": k} for n, v, f, k in heads], "from_addr": addr("from"), "to_addr": addr("to"), "cc_addr": addr("cc"), "reply_to": addr("reply-to"),
        "return_path": (re.sub(r"^<|>$", "", first.get("return-path", "").strip()) or None), "subject": first.get("subject"), "message_id": first.get("message-id"), "date": first.get("date"), "references": ids,
        "hops": [hop(v, i) for i, v in enumerate(received)], "parts": w.parts, "body": text, "arc": sorted({n for n in first if n.startswith("arc-")}), "warnings": list(dict.fromkeys(warn)),
    }


def parse_messages(raw: DataFrame, mode: str = "evidence") -> DataFrame:
    """(msg_id, content) to one nested row per message; narrow, no shuffle."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, contents = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 256):  # rows of parsed messages are large
                rows = [parse(i, c.as_py(), mode) for i, c in zip(ids[at : at + 256], contents[at : at + 256], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.select("msg_id", "content").mapInArrow(run, SCHEMA)


def hop_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("msg_id", F.explode("hops").alias("h")).select("msg_id", "h.*")


def part_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("msg_id", F.posexplode("parts").alias("part_index", "p")).select("msg_id", "part_index", "p.*")


def warning_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("warnings").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
