"""A query over files whose fonts have codes of their own, built from ``documents``: two-byte codes, differences, and Latin-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pdf, text
from .registry import query as _query
from .registry import read as _read

_MAP = """/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0041> <0058> <0065> <00E90065> endbfchar
3 beginbfrange <0000> <0040> <0000> <0042> <0063> <0042> <0064> <0064> [<0064>] endbfrange
1 beginbfrange <0066> <D7FF> <0066> endbfrange endcmap end"""


def font_files(docs: DataFrame) -> DataFrame:
    """file and content of a file for each document; its text without characters beyond the basic plane is shown in UTF-16 codes."""
    obj = lambda number, *parts: F.concat(F.lit(f"{number} 0 obj\n"), *(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("\nendobj\n"))
    basic = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\uD7FF]", "")
    shown = F.concat(F.lit("BT /F1 9 Tf <"), F.hex(F.encode(basic, "UTF-16BE")), F.lit("> Tj q /F3 9 Tf [(\\351t) -120 <E9>] TJ Q /F2 9 Tf (ABab\\051c) Tj q /F1 9 Tf Q (A) ' /None 1 Tf (z) Tj ET"))
    parts = [
        obj(1, "<< /Type /Catalog /Pages 2 0 R >>"),
        obj(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] /Resources << /Font 9 0 R >> >>"),
        obj(3, "<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"),
        obj(4, "<< /Length ", F.octet_length(shown).cast("string"), " >>\nstream\n", shown, "\nendstream"),
        obj(5, "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R >>"),
        obj(6, "<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /B /A 97 /uni00E9 /space] >> >>"),
        obj(7, "<< /Type /Font /Subtype /Type1 >>"),
        obj(8, f"<< /Length {len(_MAP)} >>\nstream\n{_MAP}\nendstream"),
        obj(9, "<< /F1 5 0 R /F2 6 0 R /F3 7 0 R >>"),
    ]
    return docs.select(F.concat(F.lit("font-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.lit("%PDF-1.7\n"), *parts).cast("binary").alias("content"))


@_query(r"""
select 'font-' || doc_id || '.pdf' as file, 1 as page_number, replace(replace(regexp_replace(coalesce(text, ''), '[^\x{0}-\x{D7FF}]', '', 'g'), 'A', 'X'), 'e', 'ée') || ' été BAé )c B z ' as text from documents
""")
def pdf_font_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages show in fonts of one and two bytes, with maps, differences and neither."""
    return text.file_text(font_files(pdf.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))))
