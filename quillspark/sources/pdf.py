"""PDF pages from word tables, as relations: lines, columns, baselines, tables and text; checks on the bytes; OCR order and quality.

Words come from an extractor or an OCR engine: doc, page, block, par, line, left, top, width, height, text (and conf). A page is the unit of
all windows, so its size bounds a group; nothing is collected across pages. Defined cases: words without text are dropped, a page without
words has no rows, equal places go by text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points between lines of one row, least lines of a column, least width of a column, height factor of a paragraph's gap; for OCR
# the gutter in pixels and line heights, the margin in points; quality below which a page is set aside; and for black bars darkness, height, width, density.
BASELINE, COLUMN_LINES, COLUMN_WIDTH, GAP = 2.5, 3, 80.0, 1.2
GUTTER, GUTTER_HEIGHTS, OCR_MARGIN, LEAST_CONFIDENCE = 60.0, 3.5, 40.0, 0.5
DARK, BAR_HEIGHT, BAR_WIDTH, BAR_COLUMN, BAR_DENSITY, BAR_MARGIN = 40, 12, 100, 0.75, 0.80, 5
HEAD_BYTES, IMAGE_BYTES = 4096, 2_000_000

PAGE = ("doc", "page")


def _bytes_hold(content: Column, low: int, n: int, *marks: str) -> Column:
    text = F.decode(F.substring(content, low, n), "ISO-8859-1")
    found = text.contains(marks[0])
    for m in marks[1:]:
        found |= text.contains(m)
    return F.coalesce(found, F.lit(False))


def is_encrypted(content: Column) -> Column:
    """Whether the first or last 4 KB of a file name an encryption dictionary."""
    return _bytes_hold(content, 1, HEAD_BYTES, "/Encrypt") | _bytes_hold(content, -HEAD_BYTES, HEAD_BYTES, "/Encrypt")


def has_images(content: Column) -> Column:
    """Whether the first 2 MB of a file name an image object."""
    return _bytes_hold(content, 1, IMAGE_BYTES, "/Image", "/XObject")


def needs_ocr(chars: Column, images: Column) -> Column:
    """Whether a page's digital text is too short to trust."""
    return (chars < 40) | (images & (chars < 100))


def lines(words: DataFrame) -> DataFrame:
    """Lines of words by (block, par, line), words left to right, with the line's box."""
    g = words.where(F.trim("text") != "").groupBy(*PAGE, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("_r"),
        F.max(F.col("top") + F.col("height")).alias("_b"),
    )
    return g.withColumns({"width": F.col("_r") - F.col("left"), "height": F.col("_b") - F.col("top")}).drop("_r", "_b")


def columns(found: DataFrame) -> DataFrame:
    """Lines with ``right`` (in the right half of the page's left edges) and ``two_columns``: both halves have three lines, the left one is wide
    enough, and fewer than two of its lines share a baseline with one of the right, as the rows of a table would."""
    page = Window.partitionBy(*PAGE)
    split = (F.min("left").over(page) + F.max("left").over(page)) / 2
    rows = found.withColumn("_split", split).withColumn("right", F.col("left") + F.col("width") / 2 >= F.col("_split"))
    rows = rows.withColumn("_tops", F.collect_list(F.when(F.col("right"), F.col("top"))).over(page))
    shared = ~F.col("right") & F.exists("_tops", lambda t: F.abs(t - F.col("top")) <= BASELINE)
    many = lambda c: F.sum(c.cast("int")).over(page)
    two = (many(~F.col("right")) >= COLUMN_LINES) & (many(F.col("right")) >= COLUMN_LINES) & (F.col("_split") - F.min("left").over(page) > COLUMN_WIDTH) & (many(shared) < 2)
    return rows.withColumn("two_columns", two).drop("_split", "_tops")


def _row_numbers(tops: Column) -> Column:
    """Numbers rows of ascending tops: a row holds what is within 2.5 points of its first line."""

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        def number(values: np.ndarray) -> list[int]:
            out, head, n = [], -np.inf, -1
            for t in values:
                if t - head > BASELINE:
                    head, n = t, n + 1
                out.append(n)
            return out

        return batch.map(number)

    return run(tops)


def rows(found: DataFrame) -> DataFrame:
    """Rows of a page in reading order: doc, page, row, cells (text and box), text, box, is_table.

    A page of two columns is read column by column, each line a row; else lines on one baseline are the cells of a table row, and a line with
    bars is one too.
    """
    each = columns(found)
    group = [*PAGE, F.when(F.col("two_columns"), F.col("right").cast("int")).otherwise(0).alias("column")]
    item = F.struct("top", "left", "text", "width", "height", "two_columns")
    pages = each.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_x"))
    pages = pages.withColumn("_n", _row_numbers(F.transform("_x", lambda x: x["top"])))
    flat = pages.select(*PAGE, "column", F.posexplode(F.arrays_zip("_x", "_n")).alias("_i", "_z")).select(*PAGE, "column", "_i", "_z._x.*", F.when(F.col("_z._x.two_columns"), F.col("_i")).otherwise(F.col("_z._n")).alias("_row"))
    cell = F.struct("left", "text", "top", "width", "height")
    g = flat.groupBy(*PAGE, "column", "_row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), *_box())
    bars = F.filter(F.transform(F.split(F.get("cells", F.lit(0))["text"], r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    g = g.withColumns({"text": F.array_join(F.col("cells.text"), " | "), "_bars": F.when((F.size("cells") == 1) & F.get("cells", F.lit(0))["text"].contains("|"), bars)})
    g = g.withColumns({"is_table": (F.size("cells") > 1) | F.col("_bars").isNotNull(), "values": F.coalesce("_bars", F.col("cells.text"))})
    return g.withColumn("row", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "_row")) - 1).cast("int")).drop("_bars", "_row")


def _box() -> list[Column]:
    return [F.min("left").alias("left"), F.min("top").alias("top"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height")]


def page_text(of_rows: DataFrame) -> DataFrame:
    """doc, page and text: rows in order, a blank line where the gap to the row before is more than 1.2 of its height, or the next column begins."""
    page = Window.partitionBy(*PAGE).orderBy("row")
    gap = F.col("top") - F.lag(F.col("top") + F.col("height")).over(page)
    high = F.lag("height").over(page)
    mark = F.when(F.lag("row").over(page).isNull(), "").when((gap > GAP * high) | (gap < -high), "\n\n").otherwise("\n")
    marked = of_rows.withColumn("_t", F.concat(mark, F.col("text")))
    return marked.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_t"))), lambda x: x["_t"]), "").alias("text"))


def tables(of_rows: DataFrame) -> DataFrame:
    """Tables of a page: runs of two table rows or more, as markdown with a box."""
    page = Window.partitionBy(*PAGE).orderBy("row")
    run = of_rows.withColumn("_run", F.sum((~F.col("is_table")).cast("int")).over(page)).where("is_table")
    line = F.concat(F.lit("| "), F.array_join("values", " | "), F.lit(" |"))
    g = run.withColumn("_l", line).groupBy(*PAGE, "_run").agg(F.array_sort(F.collect_list(F.struct("row", "_l"))).alias("_x"), F.max(F.size("values")).alias("n_columns"), F.count("*").alias("n_rows"), *_box()).where("n_rows > 1")
    named = F.concat(F.lit("Table "), F.row_number().over(Window.partitionBy(*PAGE).orderBy("_run")))
    bar = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_columns")), " | "), F.lit(" |"))
    every = F.transform("_x", lambda x: x["_l"])
    markdown = F.array_join(F.concat(F.slice(every, 1, 1), F.array(bar), F.slice(every, 2, F.size(every))), "\n")
    return g.select(*PAGE, named.alias("table_id"), "n_rows", "n_columns", *[F.round(c, 2).alias(c) for c in ("left", "top", "width", "height")], markdown.alias("markdown"))


def pages(words: DataFrame) -> DataFrame:
    """doc, page and text of word tables, for the chunker."""
    return page_text(rows(lines(words)))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words: a line of the engine, cut where the gap between two words is wider than a gutter; with the mean confidence."""
    line = Window.partitionBy(*PAGE, "block", "par", "line").orderBy("left", "text")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(line)
    cut = F.coalesce(gap > F.greatest(F.lit(GUTTER), GUTTER_HEIGHTS * F.col("height")), F.lit(False))
    parts = words.where(F.trim("text") != "").withColumn("_cut", F.sum(cut.cast("int")).over(line))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ")
    return parts.groupBy(*PAGE, "block", "par", "line", "_cut").agg(text.alias("text"), F.avg("conf").alias("conf"), *_box()).drop("_cut")


def ocr_order(found: DataFrame, dpi: int = 300) -> DataFrame:
    """OCR lines with their place on the page: banners above the right column, then the left column, the right one, and what is below both."""
    page = Window.partitionBy(*PAGE)
    low = F.min("left").over(page)
    split = (low + F.max("left").over(page)) / 2
    each = found.withColumns({"_low": low, "_split": split}).withColumn("_right", F.col("left") + F.col("width") / 2 >= F.col("_split"))
    many = lambda c: F.sum(c.cast("int")).over(page)
    two = (many(~F.col("_right")) >= COLUMN_LINES) & (many(F.col("_right")) >= COLUMN_LINES) & (F.col("_split") - F.col("_low") > OCR_MARGIN * dpi / 72)
    bottom = F.col("top") + F.col("height")
    starts = F.min(F.when(F.col("_right"), F.col("top"))).over(page)
    ends = F.least(F.max(F.when(~F.col("_right"), bottom)).over(page), F.max(F.when(F.col("_right"), bottom)).over(page))
    each = each.withColumns({"_two": two, "_starts": starts, "_ends": ends})
    zone = F.when(~F.col("_two"), 0).when(~F.col("_right") & (bottom <= F.col("_starts")), 0).when(F.col("top") >= F.col("_ends"), 3).otherwise(1 + F.col("_right").cast("int"))
    place = F.row_number().over(page.orderBy("_zone", "top", "left", "text")) - 1
    return each.withColumn("_zone", zone).withColumn("place", place).drop("_low", "_split", "_right", "_two", "_starts", "_ends", "_zone")


def set_aside(ocr_words: DataFrame) -> DataFrame:
    """doc, page, confidence, and whether the page is too poorly read to be searched."""
    return ocr_words.groupBy(*PAGE).agg(F.avg("conf").alias("confidence")).withColumn("quarantined", F.col("confidence") < LEAST_CONFIDENCE)


def black_bars(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, right, bottom) of solid dark bars of a grey image: a run of 12 rows or more with over 100 dark pixels each, cut to the columns
    that are dark in three quarters of the run, over 100 wide and dark in four fifths."""
    dark = gray < DARK
    rows_ = np.flatnonzero(dark.sum(1) > BAR_WIDTH)
    out = []
    for run in np.split(rows_, np.flatnonzero(np.diff(rows_) != 1) + 1):
        if len(run) < BAR_HEIGHT:
            continue
        part = dark[run[0] : run[-1] + 1]
        across = np.flatnonzero(part.sum(0) > BAR_COLUMN * len(run))
        if len(across) > BAR_WIDTH and part[:, across[0] : across[-1] + 1].mean() >= BAR_DENSITY:
            out.append((int(across[0]), int(run[0]), int(across[-1]), int(run[-1])))
    return out


def without_bars(pixels: Column, width: Column) -> Column:
    """Grey images (a byte a pixel, row by row) with dark bars whitened: a struct of pixels and boxes."""

    @F.pandas_udf("struct<pixels:binary,bars:array<array<int>>>")
    def run(images: pd.Series, widths: pd.Series) -> pd.DataFrame:
        out = []
        for raw, w in zip(images, widths, strict=True):
            gray = np.frombuffer(raw, np.uint8).reshape(-1, w).copy()
            bars = black_bars(gray)
            for left, top, right, bottom in bars:
                gray[max(0, top - BAR_MARGIN) : bottom + BAR_MARGIN + 1, max(0, left - BAR_MARGIN) : right + BAR_MARGIN + 1] = 255
            out.append((gray.tobytes(), [list(b) for b in bars]))
        return pd.DataFrame(out, columns=["pixels", "bars"])

    return run(pixels, width)
