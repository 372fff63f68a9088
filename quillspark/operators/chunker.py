"""Structure-aware chunks as relations: lines, blocks, sections, chunks.

Texts move once, to the task of their document. Lines are classified by column rules, windows number the blocks (headings and
paragraphs) and the sections (a new page, or a heading below text, begins one), and running minima of heading levels give each
section its path. Only the fill of a section, a walk over the lengths of its pieces, is Python. Offsets are those of the page's text.

Defined cases: a null or empty text has no chunks; a sentence is never cut, however long; rows of one doc_id count as one document's
pages in the order of their numbers; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

MAX_CHARS, OVERLAP = 1800, 150
#: Levels that a heading path can have.
DEPTH = 4


def blocks(docs: DataFrame) -> DataFrame:
    """Headings and paragraphs of ``docs`` (doc_id, filename, pages: array of struct(page, text)), numbered within each page.

    Columns: doc_id, filename, seq (place of the page), page, block, text, raw (text with its white space), start, end, title (of a heading).
    """
    pages = docs.select("doc_id", "filename", "pages").repartition("doc_id").select("doc_id", "filename", F.posexplode("pages").alias("seq", "_p"))
    lines = pages.select("doc_id", "filename", "seq", F.col("_p.page").alias("page"), F.posexplode(F.split("_p.text", r"[\r\n]")).alias("line", "raw"))
    on_page = Window.partitionBy("doc_id", "seq").orderBy("line")
    before = on_page.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"start": F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int"), "text": T.strip(F.col("raw"))})
    lines = lines.withColumn("gap", (F.col("text") == "") | T.is_noise(F.col("text"))).withColumn("title", F.when(~F.col("gap"), T.heading(F.col("text"))))
    alone = F.col("gap") | F.col("title").isNotNull()
    begins = alone | F.coalesce(F.lag(alone).over(on_page), F.lit(True))
    lines = lines.withColumn("block", F.sum(begins.cast("int")).over(on_page)).where(~F.col("gap"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text", "raw")))
    found = lines.groupBy("doc_id", "seq", "block").agg(
        F.first("filename").alias("filename"),
        F.first("page").alias("page"),
        parts.alias("_l"),
        F.min("start").alias("start"),
        F.max(F.col("start") + F.length("raw")).alias("end"),
        F.max("title").alias("title"),
    )
    return found.select("doc_id", "filename", "seq", "page", "block", F.array_join("_l.text", "\n").alias("text"), F.array_join("_l.raw", "\n").alias("raw"), "start", "end", "title")


def sections(found: DataFrame) -> DataFrame:
    """Blocks with the number of their section, the heading they are under and its path.

    A section begins on a new page, and at a heading unless only headings without a number come right before it. A heading of level n
    hangs below the last one of a lesser level, one step deeper at most: with depth d of the i-th heading, d - i is the running minimum of
    level - 1 - i, so windows give all depths, and each level of the path is the last heading of that depth.
    """
    doc = Window.partitionBy("doc_id").orderBy("seq", "block")
    is_heading = F.col("title").isNotNull()
    turned = F.lag("page").over(doc) != F.col("page")
    text_before = F.lag(~is_heading | T.is_numbered_heading(F.col("text"))).over(doc)
    begins = F.coalesce(turned, F.lit(False)) | (is_heading & (F.coalesce(text_before, F.lit(True)) | ~F.col("page").eqNullSafe(F.lag("page").over(doc))))
    rows = found.withColumns({"section": F.sum(begins.cast("int")).over(doc), "_i": F.sum(is_heading.cast("int")).over(doc)})
    floor = F.min(F.when(is_heading, T.heading_level(F.col("title")) - 1 - F.col("_i"))).over(doc)
    rows = rows.withColumn("_d", F.col("_i") + F.least(F.lit(-1), floor))
    step = lambda k: F.when(F.col("_d") >= k, F.last(F.when(is_heading & (F.col("_d") == k), F.col("title")), ignorenulls=True).over(doc))
    path = F.array_compact(F.array(*[step(k) for k in range(DEPTH)]))
    return rows.withColumns({"header": F.coalesce(F.last("title", ignorenulls=True).over(doc), F.lit("General")), "path": path}).drop("_i", "_d")


def apart(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of more than ``most`` characters as their raw sentences ``_s``, others whole; a sentence's row holds nothing of its block's text but itself."""
    long, rest = F.length("text") > most, [c for c in rows.columns if c not in ("text", "raw")]
    parts = F.when(long, F.split("raw", r"(?<=[.!?])(?=\s)")).otherwise(F.array("raw"))
    whole = rows.select(*rest, long.alias("_long"), F.when(~long, F.col("text")).alias("text"), parts.alias("_p"))
    return whole.select(*rest, "_long", "text", F.posexplode("_p").alias("part", "_s"))


def pieces(rows: DataFrame, most: int) -> DataFrame:
    """Blocks, those of more than ``most`` characters as their sentences, each with its offsets."""
    cut, long = apart(rows, most), F.col("_long")
    at = F.coalesce(F.sum(F.length("_s")).over(Window.partitionBy("doc_id", "seq", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumns({"_at": F.col("start") + at, "_t": T.strip(F.col("_s"))}).where("_t != ''")
    lead = F.length("_s") - F.length(F.regexp_replace("_s", r"(?U)^\s+", ""))
    exact = {"start": F.when(long, F.col("_at") + lead).otherwise(F.col("start")), "end": F.when(long, F.col("_at") + lead + F.length("_t")).otherwise(F.col("end"))}
    cut = cut.withColumns({**exact, "text": F.when(long, F.regexp_replace("_t", r"[^\S\n]*\n[^\S\n]*", "\n")).otherwise(F.col("text"))})
    return cut.drop("_long", "_s", "_at", "_t")


def fill(lengths: Sequence[int], most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Chunks of a section as (first piece, piece after the last, first piece that is not carried over).

    A chunk is closed when the next piece would make it too long; the next one then begins with the last pieces that fit into ``overlap``.
    """
    low = own = size = 0
    for i, n in enumerate(lengths):
        if i > low and size + n + 2 > most:
            yield low, i, min(own, i - 1)
            own, size, room, back = i, 0, overlap, i
            while back > low and lengths[back - 1] <= room:
                back -= 1
                room -= lengths[back] + 2
                size += lengths[back] + 2
            low = back
        size += n + 2
    if len(lengths) > low:
        yield low, len(lengths), min(own, len(lengths) - 1)


def filled(lengths: Column, most: int, overlap: int) -> Column:
    @F.pandas_udf("array<struct<low:int,high:int,own:int>>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda n: [{"low": a, "high": b, "own": c} for a, b, c in fill(n.tolist(), most, overlap)])

    return run(lengths)


def chunk_documents(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``docs`` (doc_id, filename, pages: array of struct(page, text)): doc_id, filename, chunk_index, page, header,
    heading_path, locator, content, char_start, char_end, citation and source_hash."""
    rows = pieces(sections(blocks(docs)), most)
    items = F.array_sort(F.collect_list(F.struct("seq", "block", "part", "text", "page", "start", "end")))
    whole = rows.groupBy("doc_id", "section").agg(F.first("filename").alias("filename"), F.max(F.struct("seq", "block", "header", "path")).alias("_h"), items.alias("_x"))
    cut = whole.select("*", F.explode(filled(F.transform("_x", lambda x: F.length(x["text"])), most, overlap)).alias("_c"))
    low, high, own = (F.col(f"_c.{c}") for c in ("low", "high", "own"))
    page = F.coalesce(F.get("_x", own)["page"], F.get("_x", low)["page"])
    named = F.concat(F.lit("Page "), page.cast("string"))
    path = F.col("_h.path")
    out = cut.select(
        "doc_id",
        "filename",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "_c.low", "_c.high")) - 1).alias("chunk_index"),
        page.alias("page"),
        F.col("_h.header").alias("header"),
        F.concat(F.when(page.isNotNull(), F.array(named)).otherwise(F.array().cast("array<string>")), path).alias("heading_path"),
        F.when(page.isNotNull(), named).when(F.size(path) > 0, F.concat_ws(" > ", path)).alias("locator"),
        T.strip(F.array_join(F.transform(F.slice("_x", low + 1, high - low), lambda x: x["text"]), "\n\n")).alias("content"),
        F.get("_x", low)["start"].alias("char_start"),
        F.get("_x", high - 1)["end"].alias("char_end"),
    )
    cite = T.citation(F.col("filename"), F.col("page"), F.col("locator"), F.col("header"))
    return out.withColumns({"citation": cite, "source_hash": T.source_hash(F.col("content"))})
