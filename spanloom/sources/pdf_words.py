"""Words and boxes of PDF pages; needs an optional library, or tables made elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotAvailable

SCHEMA = "doc_uri string, page int, kind string, text string, x0 double, x1 double, top double, bottom double"


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each word (kind 'word'), image ('image'), rectangle ('rect') and page ('page') of the PDFs under ``path``.

    A file that can't be read has no rows, which resolution takes as NOT_FOUND.
    """
    try:
        import pdfplumber  # noqa: F401
    except ImportError as missing:
        raise NotAvailable("reading PDF files needs pdfplumber; pass pdf_word, pdf_box and pdf_page tables instead") from missing

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for batch in batches:
            for uri, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with pdfplumber.open(io.BytesIO(bytes(content))) as document:
                        for number, page in enumerate(document.pages, 1):
                            rows.append((uri, number, "page", None, None, None, None, None))
                            rows += [(uri, number, "word", w["text"], w["x0"], w["x1"], w["top"], w["bottom"]) for w in page.extract_words()]
                            for kind, boxes in (("image", page.images), ("rect", page.rects)):
                                rows += [(uri, number, kind, None, b["x0"], b["x1"], b["top"], b["bottom"]) for b in boxes]
                except Exception:  # any unreadable file counts as absent, by contract
                    rows = []
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def split_pages(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pdf_word, pdf_box and pdf_page tables of :func:`read_pdf`."""
    words = rows.where("kind = 'word'").drop("kind")
    boxes = rows.where("kind IN ('image', 'rect')").drop("text")
    pages = rows.where("kind = 'page'").groupBy("doc_uri").agg(F.max("page").alias("page_count"))
    return words, boxes, pages
