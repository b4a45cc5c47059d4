"""The main body of each page: a recurrent labeller classifies every block in the context of the whole page.

Pages stream through Python in Arrow batches; no block leaves its page and nothing is shuffled but the answers, which
meet once so that repeated page_ids count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages, and characters of HTML, that are parsed at a time; both only bound memory.
CHUNK_PAGES, CHUNK_CHARS = 256, 4_000_000


def chunks(values: list) -> Iterator[tuple[int, list]]:
    """Consecutive stretches of a list of texts with the place each starts at."""
    start, chars = 0, 0
    for i, v in enumerate(values):
        chars += len(v) if v else 0
        if i + 1 - start >= CHUNK_PAGES or chars >= CHUNK_CHARS:
            yield start, values[start : i + 1]
            start, chars = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def labelled(htmls: list) -> Iterator[tuple[list, list]]:
    """For each page its blocks and, per block, whether it is of the main body."""
    from pagemill.llm import block_model, page_blocks

    block_model.weights()
    for _, part in chunks(htmls):
        pages = [page_blocks.blocks(h) for h in part]
        logits = block_model.label([page_blocks.read(p) for p in pages])
        for page, logit in zip(pages, logits):
            yield page, (logit > 0).tolist()


def per_page(pages: DataFrame, columns: list[str], fields: list[pa.Field], work: Callable[[list, list], list]) -> DataFrame:
    """page_id with what ``work`` makes of a batch's (labelled pages, other columns); see the callers."""
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = pa.schema([pa.field("page_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = work(b.column("html").to_pylist(), [b.column(c).to_pylist() for c in columns])
            arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), *arrays], schema=schema)

    source = pages.where("page_id is not null").select("page_id", "html", *columns)
    return source.mapInArrow(run, from_arrow_schema(schema))


def main_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, blocks): numbers of the p and li elements of each page's main body.

    A page without html, or without such elements, has an empty list; a repeated page_id counts once.
    """

    def work(htmls: list, _: list) -> list:
        return [([b.no for b, y in zip(page, main) if y and b.no >= 0],) for page, main in labelled(htmls)]

    found = per_page(pages, [], [pa.field("blocks", pa.list_(pa.int32()))], work)
    return found.groupBy("page_id").agg(F.max("blocks").alias("blocks"))


def main_found(pages: DataFrame) -> DataFrame:
    """(page_id, block_no) of the main body's p and li elements."""
    return main_blocks(pages).select("page_id", F.explode("blocks").alias("block_no"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, main_text): the text of the main body, a block a line; '' where there is none."""

    def work(htmls: list, _: list) -> list:
        return [("\n".join(" ".join(b.text.split()) for b, y in zip(page, main) if y and b.text.strip()),) for page, main in labelled(htmls)]

    found = per_page(pages, [], [pa.field("main_text", pa.string())], work)
    return found.groupBy("page_id").agg(F.max("main_text").alias("main_text"))
