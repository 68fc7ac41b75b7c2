"""Forensic report of a case: five sections of text, as PDF, and the same facts as one JSON document."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH, LINES = 100, 54


def pdf(lines: list[str]) -> bytes:
    """Text as PDF: long lines are wrapped, and there are as many pages as the lines need."""
    wrapped = [w for x in lines for w in (textwrap.wrap(x, WIDTH, subsequent_indent="    ", drop_whitespace=False) or [""])]
    safe = [x.encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for x in wrapped]
    pages = [safe[i : i + LINES] for i in range(0, len(safe), LINES)] or [[]]
    first = 5  # objects before the pages: catalogue, page tree, font, information
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", "<< /Producer (postern) >>"]
    for i, page in enumerate(pages):
        content = "BT /F1 10 Tf 50 790 Td 13 TL " + " ".join(f"({x}) Tj T*" for x in page) + " ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {first + 2 * i + 1} 0 R >>")
        objects.append(f"<< /Length {len(content.encode('latin-1'))} >>\nstream\n{content}\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode("latin-1")
    xref = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    return out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /Info 4 0 R >>\nstartxref\n{xref}\n%%EOF\n".encode()


@F.pandas_udf(T.BinaryType())
def _pdf_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else pdf(t.split("\n")))


def pdf_report(text: Column) -> Column:
    """PDF bytes of a text column; NULL stays NULL."""
    return _pdf_udf(text)


def report_text(audit: dict[str, Column], families: Column | None = None) -> Column:
    """The report of a case row: custody, summary, semantic analysis, infrastructure, proof.

    `audit` has assurance, head, head_signed and last_signed; `families` is an optional
    array<struct<name, contribution>>. A missing value reads `not known`.
    """
    show = lambda c: F.coalesce(c.cast("string"), F.lit("not known"))
    line = lambda name, c: F.concat(F.lit(f"  {name}: "), show(c))
    names = lambda a: F.when(F.col(a).isNull(), "none").otherwise(F.array_join(a, ", "))
    number = lambda c: F.format_string("%.2f", c)
    semantic = F.lit("  no breakdown for this record") if families is None else F.coalesce(F.array_join(F.transform(families, lambda f: F.concat(F.lit("  "), f["name"], F.lit(": "), F.format_string("%.6f", f["contribution"]))), "\n"), F.lit("  no breakdown for this record"))
    proven = audit["head_signed"] & (audit["assurance"] == "SIGNED")
    return F.concat_ws(
        "\n", F.lit("CASE REPORT"), F.lit("0. CHAIN OF CUSTODY"), line("Assurance", audit["assurance"]), line("Head hash", audit["head"]), line("Head signature valid", audit["head_signed"]), line("Last signed record", audit["last_signed"]),
        F.lit("1. CASE SUMMARY"), line("Case", F.col("id")), line("Evidence SHA-256", F.col("evidencehash")), line("Observed at", F.col("observedat")), line("Verdict", F.col("verdict")), line("Risk", F.when(F.col("riskfinal").isNotNull(), number(F.col("riskfinal")))),
        F.lit("2. SEMANTIC ANALYSIS"), semantic, F.lit("3. INFRASTRUCTURE AND CORRELATION"), line("Sender domains", names("domains")), line("Observed addresses", names("hopaddresses")),
        F.lit("4. PROOF"), F.when(proven, "  the head of the audit log is signed by the configured key").otherwise("  not signed: the records are linked by hashes only"),
    )


def json_report(case: list[str], objects: Column, audit: dict[str, Column]) -> Column:
    """The case, its STIX objects and the audit block as one JSON document; NULL fields are left out."""
    return F.to_json(F.struct(F.struct(*case).alias("case"), F.struct(F.lit("bundle").alias("type"), objects.alias("objects")).alias("stix"), F.struct(*[c.alias(k) for k, c in audit.items()]).alias("audit")))
