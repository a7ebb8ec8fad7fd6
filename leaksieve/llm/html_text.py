"""The main text of web pages, by tag path ratios.

Blocks with one root-to-leaf tag path (tags and class names) play one part in a page. For each path

1. the lengths and the punctuation of its blocks are **aggregated**, with the share of their characters that are links;
2. both are **smoothed** with the sums of the paths that have the same parent, so that a short path among long ones
   is not lost;
3. they are **fused** into one value: length x (1 + punctuation) x (1 - share of links);
4. a path is **kept** when its value exceeds the standard deviation of all blocks' values. A heading has the value of the block
   after it.

What tags, roles and names mark as lying around an article (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts, styles, hidden parts) never becomes a block (``html_blocks``). Where a page names its article (``article``, else
``main``, else names like ``post-content``), only what lies in it is looked at; values are on a logarithmic scale then and the
threshold is a fiftieth, which drops lists of links and little else: short paragraphs share the path of long ones.

Each page is read by itself, in one narrow pass: nothing is shuffled, and a task holds one batch of pages (8 MB, or one page).
Reading is linear in a page's length.

Defined results: a null or empty page has an empty text. Every row gives one row, repeated ones too. Markup that is cut
off or not closed is read as browsers do: an unfinished tag or comment at the end holds no text. References are decoded as in
HTML5, white space is what Unicode calls so, a ``br`` is white space. Columns other than ``page_id``, ``url`` and ``html`` are not read, so
they may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaksieve.llm.html_blocks import Block, blocks
from leaksieve.llm.shared import python_ready, tidy

#: Share of the standard deviation that a path's value must exceed, in a page without and with a named article.
THRESHOLD = 1.0
NAMED_THRESHOLD = 0.02
#: Weight of the paths with the same parent.
SMOOTHING = 0.5

PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡")
_ENDS = str.maketrans("", "", "".join(sorted(PUNCTUATION)))


def content(found: list[Block]) -> list[Block]:
    """The blocks of the paths that hold the main text."""
    trust = max((b.trust for b in found), default=0)
    found = [b for b in found if b.trust == trust]
    if not found:
        return []
    values = _path_values(found, named=trust > 0)
    per_block = [values[b.path] for b in found]
    for i in range(len(found) - 2, -1, -1):
        if found[i].heading:
            per_block[i] = per_block[i + 1]
    mean = sum(per_block) / len(per_block)
    deviation = sqrt(sum((v - mean) ** 2 for v in per_block) / len(per_block))
    threshold = deviation * (NAMED_THRESHOLD if trust else THRESHOLD)
    kept = [b for b, value in zip(found, per_block) if value > threshold]
    return kept or (found if trust else [])


def _path_values(found: list[Block], named: bool) -> dict[int, float]:
    """The fused value of every path."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    parent_of = {}
    for block in found:
        total = sums[block.path]
        parent_of[block.path] = block.parent
        total[0] += 1
        total[1] += len(block.text)
        total[2] += len(block.text) - len(block.text.translate(_ENDS))
        total[3] += block.linked / max(1, len("".join(block.text.split())))
    around: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0])
    ratios = {}
    for path, (n, length, signs, _) in sums.items():
        ratio = (length / n, signs / n)
        ratios[path] = [log2(1 + r) for r in ratio] if named else ratio
        group = around[parent_of[path]]
        group[0] += n
        group[1] += n * ratios[path][0]
        group[2] += n * ratios[path][1]
    values = {}
    for path, (n, _, _, linked) in sums.items():
        group_n, group_length, group_signs = around[parent_of[path]]
        weight = n + SMOOTHING * (group_n - n)
        length, signs = ((n * own + SMOOTHING * (group - n * own)) / weight
                         for own, group in zip(ratios[path], (group_length, group_signs)))
        values[path] = length * (1 + signs) * max(0.0, 1 - linked / n)
    return values


def main_text(html: str | None) -> str:
    """The main text of a page; its blocks are two line feeds apart."""
    return "\n\n".join(block.text for block in content(blocks(html or "")))


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_TEXTS)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    columns = python_ready(pages).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
