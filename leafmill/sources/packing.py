"""Archives from pages, for round trips."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.files import sliced


def archive(items: list[tuple[str, str]]) -> bytes:
    """An EPUB whose spine is (href, xhtml) in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>')
        manifest = "".join(f'<item id="i{n}" href="{href}"/>' for n, (href, _) in enumerate(items))
        spine = "".join(f'<itemref idref="i{n}"/>' for n in range(len(items)))
        z.writestr("OPS/content.opf", f"<package><manifest>{manifest}</manifest><spine>{spine}</spine></package>")
        for href, body in items:
            z.writestr(f"OPS/{href}", body)
    return out.getvalue()


def packed(pages: DataFrame, path: str, html: str) -> DataFrame:
    """(path, content): one archive a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, pages_ = (batch.column(c).to_pylist() for c in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([archive([("page.xhtml", h or "")]) for h in pages_], pa.binary())], ["path", "content"])

    return pages.select(F.col(path).cast("string"), html).mapInArrow(run, "path string, content binary")
