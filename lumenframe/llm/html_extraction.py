"""Main text of web pages: every block of a page is labelled by a recurrent network that reads the whole page.

Kept blocks are joined in page order by one space.  Character references are
decoded, white space inside a block is one space.  Scripts and styles are no
blocks.

Defined cases: a null, empty or textless page gives the empty text; markup that
never closes ends with the page; very long pages run by themselves; repeated
rows repeat; an empty table gives an empty result; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .block_labeller import Labeller, trained
from .common import record_batch
from .html_blocks import blocks

#: Pages parsed before they are labelled together, by number and by characters.
AT_ONCE, CHARS_AT_ONCE = 512, 4_000_000


def main_texts(pages: list[str], model: Labeller) -> list[tuple[str, int, int]]:
    """(main text, blocks, blocks kept) of each page."""
    parsed = [blocks(p) for p in pages]
    out = []
    for found, p in zip(parsed, model.probabilities(parsed), strict=True):
        kept = [b.text for b, q in zip(found, p.tolist(), strict=True) if q >= 0.5]
        out.append((" ".join(kept), len(found), len(kept)))
    return out


def _extracting(keys: list[str], model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(pa.field(k, batch.schema.field(i).type) for i, k in enumerate(keys)), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])
            at = 0
            while at < batch.num_rows:
                pages, size = [], 0
                for value in batch.column(len(keys)).slice(at, AT_ONCE):
                    page = value.as_py() or ""
                    if pages and size + len(page) > CHARS_AT_ONCE:
                        break
                    pages.append(page)
                    size += len(page)
                texts, found, kept = zip(*main_texts(pages, model), strict=True)
                yield record_batch({**{k: batch.column(i).slice(at, len(pages)) for i, k in enumerate(keys)}, "text": list(texts), "n_chars": [len(t) for t in texts], "n_blocks": list(found), "n_kept": list(kept)}, schema)
                at += len(pages)

    return run


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html", model: Labeller | None = None) -> DataFrame:
    """Per row: the key columns, text, n_chars, n_blocks and n_kept."""
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(_extracting(list(keys), model or trained()), f"{kinds}, text string, n_chars long, n_blocks long, n_kept long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
