"""Texts printed as PDF files, as a source whose content is known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simweave.functions.text import lines
from simweave.sources.corpus import PAGE_LINES

#: The side of the gray image that every printed file shows.
IMAGE_SIDE = 64


def print_pdf(pages: list[str], pixels: bytes) -> bytes:
    """A file with a page for each text, a line of the page for each of its lines, and a gray image on the first page."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(),
        f"<< /Subtype /Image /Width {IMAGE_SIDE} /Height {IMAGE_SIDE} /BitsPerComponent 8 /ColorSpace /DeviceGray /Length {len(pixels)} >>\nstream\n".encode() + pixels + b"\nendstream",
    ]
    for i, text in enumerate(pages):
        shown = "".join("(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj T*\n" for line in text.split("\n"))
        body = f"BT /F1 10 Tf 12 TL\n{shown}ET".encode("ascii")
        images = "/XObject << /Im0 3 0 R >>" if i == 0 else ""
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R /Resources << /Font << /F1 << /Subtype /Type1 >> >> {images} >> >>".encode())
        objects.append(f"<< /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream")
    out = b"%PDF-1.5\n"
    for number, o in enumerate(objects, 1):
        out += f"{number} 0 obj\n".encode() + o + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def printed_documents(documents: DataFrame) -> DataFrame:
    """``path, content``: each document as a file of its printable ASCII lines, ``PAGE_LINES`` stored lines to a page.

    The image's pixels are the digest of the document's number, repeated. A document without
    text has one empty page.
    """
    plain = F.transform(lines(F.coalesce("text", F.lit(""))), lambda x: F.trim(F.regexp_replace(x, "[^ -~]+", "?")))
    count = F.ceil(F.size("lines") / PAGE_LINES).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.array_join(F.filter(F.slice("lines", p * PAGE_LINES + 1, F.lit(PAGE_LINES)), lambda x: x != ""), "\n"))
    pixels = F.repeat(F.md5(F.col("doc_id").cast("string")), IMAGE_SIDE * IMAGE_SIDE // 32)
    rows = documents.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf")).alias("path"), plain.alias("lines"), pixels.alias("pixels")).select("path", pages.alias("pages"), "pixels")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "content": [print_pdf(list(p), x.encode()) for p, x in zip(pdf["pages"], pdf["pixels"], strict=True)]})

    return rows.mapInPandas(run, "path STRING, content BINARY")
