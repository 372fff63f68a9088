"""Files as rows: scan, checks before parsing, and page tables by format."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import EncryptedFile

# Accepted endings, and how large a file may be.
ENDINGS = ("pdf", "docx", "doc", "eml", "msg", "txt", "md", "csv", "json", "html", "htm", "py", "js", "ts", "yaml", "yml", "sql")
MOST_BYTES = 52_428_800
PAGES = "path string, page int, locator string, text string, extra string, error string"
DELIMITERS = (",", "\t")
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All accepted files below a folder with their SHA-256; hidden and unfinished files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*ENDINGS)
    return files.withColumns({"filename": name, "file_hash": F.sha2("content", 256)}).where(known & ~name.startswith("."))


def _counted(lines: Column, mark: str) -> Column:
    return F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))


def _is_delimited(text: Column) -> Column:
    """Whether the first two to five lines hold commas, or tabs where the first line has more of them, equally often."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 5)
    commas, tabs = (_counted(lines, d) for d in DELIMITERS)
    counts = F.when(F.get(commas, F.lit(0)) >= F.get(tabs, F.lit(0)), commas).otherwise(tabs)
    return F.coalesce((F.size(lines) >= 2) & (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts)), F.lit(False))


def mime(content: Column, path: Column) -> Column:
    """The type by first bytes, else by ending. ``content`` is binary."""
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 2048), "ISO-8859-1")))
    raw = F.hex(F.substring(content, 1, 4))
    ending = F.lower(F.regexp_extract(path, r"\.([^./?#]*)$", 1))
    by_ending = F.create_map(*[F.lit(x) for kv in {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "eml": "message/rfc822", "json": "application/json", "docx": DOCX, "pdf": "application/pdf", "doc": "application/msword", "msg": "application/vnd.ms-outlook", "py": "text/x-python", "sql": "text/x-sql", **dict.fromkeys(("js", "ts", "yaml", "yml"), "text/plain")}.items() for x in kv])
    return (
        F.when(raw == "25504446", "application/pdf")
        .when((raw == "504B0304") & (F.instr(F.decode(content, "ISO-8859-1"), "word/document.xml") > 0), DOCX)  # whatever it is called
        .when(raw == "504B0304", F.coalesce(by_ending[ending], F.lit("application/zip")))
        .when(text.rlike(r"^(?:from|received|subject|date|mime-version|return-path|to): "), "message/rfc822")
        .when(text.startswith("<!doctype html") | text.startswith("<html") | text.contains("<body"), "text/html")
        .when(text.rlike(r"^[\[{]"), "application/json")
        .when(_is_delimited(text), "text/csv")
        .otherwise(F.coalesce(by_ending[ending], F.lit("application/octet-stream")))
    )


def reject_reason(files: DataFrame) -> Column:
    """Why a file (path, length, content) is not parsed, or null."""
    head = F.hex(F.substring("content", 1, 4))
    ending = F.lower(F.regexp_extract("path", r"\.([^./?#]*)$", 1))
    return (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MOST_BYTES, "file too large")
        .when(head.startswith("4D5A") | (head == "7F454C46") | head.isin("FEEDFACE", "FEEDFACF", "CFFAEDFE", "CEFAEDFE"), "executable content")
        .when((ending == "pdf") & (head != "25504446"), "not a PDF")
        .when(~ending.isin(*ENDINGS), "extension not accepted")
    )


# What stands before and after the text of an element in markdown, and elements whose text is left out.
HTML_MARKS = {
    **{f"h{n}": ("\n\n" + "#" * n + " ", "\n") for n in range(1, 7)},
    **dict.fromkeys(("p", "div", "table"), ("\n\n", "\n")),
    **dict.fromkeys(("article", "section"), ("\n\n", "")),
    **dict.fromkeys(("ul", "ol"), ("", "\n")),
    "br": ("\n", ""),
    "li": ("\n- ", ""),
}
HTML_SILENT = frozenset({"script", "style", "head", "noscript", "svg", "iframe"})


class _Page(HTMLParser):
    """Writes text and marks to the innermost open place: the page, or a cell of a table row, rows being lists of cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page: list[str] = []
        self.cells: list[list[str]] | None = None
        self.silent = 0

    def mark(self, tag: str, end: int) -> None:
        self.silent = max(0, self.silent + (tag in HTML_SILENT) * (1 - 2 * end))
        if tag in HTML_MARKS:
            self.page.append(HTML_MARKS[tag][end])
        elif tag == "tr":
            if end and self.cells is not None:
                self.page.append("\n| " + " | ".join(" ".join("".join(c).split()) for c in self.cells) + " |")
            self.cells = None if end else []
        elif tag in ("td", "th") and not end and self.cells is not None:
            self.cells.append([])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.mark(tag, 0)

    def handle_endtag(self, tag: str) -> None:
        self.mark(tag, 1)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            place = self.cells[-1] if self.cells else self.page
            place.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """A page as markdown: headings, list items and table rows are marked, blank lines are single."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.page).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(html_text, na_action="ignore")

    return run(html)


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


Page = tuple[int | None, str, str]


def _plain(raw: bytes, name: str) -> list[Page]:
    return [(1, "Page 1", _decoded(raw))] if name.endswith(".txt") else [(None, "", _decoded(raw))]


def _json(raw: bytes, name: str) -> list[Page]:
    """Indented, so that its parts stand on lines; what is no JSON stays as it is."""
    text = _decoded(raw)
    try:
        text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    return [(None, "", text)]


def _html(raw: bytes, name: str) -> list[Page]:
    return [(None, "", html_text(_decoded(raw)))]


def _pdf(raw: bytes, name: str) -> list[Page]:
    """Words of a PDF come from an extractor, see `pdf`; here a file is only refused if it is locked."""
    if b"/Encrypt" in raw[:4096] or b"/Encrypt" in raw[-4096:]:
        raise EncryptedFile(name)
    raise LookupError("no words")


def _eml(raw: bytes, name: str) -> list[Page]:
    """Headers and body, then the pages of each attachment that has a handler, each with the attachment's name as locator."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_subtype() == "html":
        text = html_text(text)
    head = "\n".join(f"{k}: {message[k]}" for k in ("From", "To", "Subject", "Date") if message[k])
    pages: list[Page] = [(None, "Message", f"{head}\n\n{text.strip()}")]
    for part in message.iter_attachments():
        name, kind = part.get_filename() or "unnamed", part.get_content_type()
        at = f"Attachment: {name}"
        if kind == "message/rfc822":  # a message of its own, with its attachments
            inner = part.get_content()
            at = f"Attachment: {part.get_filename() or inner['Subject'] or name}"
            pages += [(n, at if where == "Message" else f"{at} > {where}", t) for n, where, t in _eml(inner.as_bytes(), name)]
        elif kind in HANDLERS:
            found = HANDLERS[kind](part.get_payload(decode=True) or b"", name.lower())
            pages += [(None, f"{at} > {where}" if where and kind == "text/csv" else at, t.strip()) for _, where, t, *_ in found]
        elif part.get_content_maintype() == "text":
            pages.append((None, at, part.get_content().strip()))
    return pages


def _csv(raw: bytes, name: str) -> list[Page]:
    """Thirty rows a page as a markdown table, each page below the header, located as ``Rows a-b``."""
    text = _decoded(raw)
    counts = {d: text.split("\n", 1)[0].count(d) for d in ",;\t|"}
    table = [r for r in csv.reader(io.StringIO(text), delimiter=max(counts, key=counts.get)) if any(c.strip() for c in r)]
    if not table:
        return []
    line = lambda cells: "| " + " | ".join(c.strip() for c in cells) + " |"
    head, rows = table[0], table[1:]
    top = [line(head), "| " + " | ".join("---" for _ in head) + " |"]
    return [(None, f"Rows {i + 1}-{min(i + 30, len(rows))}", "\n".join([*top, *map(line, rows[i : i + 30])])) for i in range(0, max(1, len(rows)), 30)]


def _docx(raw: bytes, name: str) -> list[tuple]:
    """Paragraphs and tables in document order, with the tracked changes aside; deleted text is left out of the page."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    say = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body:
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            rank = re.fullmatch(r"Heading(\d)", style.get(f"{w}val", "")) if style is not None else None
            out.append(("#" * int(rank[1]) + " " if rank else "") + say(e))
        elif e.tag == f"{w}tbl":
            out += ["| " + " | ".join(say(c) for c in r.iter(f"{w}tc")) + " |" for r in e.iter(f"{w}tr")]
    said = (("deletion", "del", lambda e: "".join(t.text or "" for t in e.iter(f"{w}delText"))), ("insertion", "ins", say))
    changes = [{"type": kind, "text": of(e), "author": e.get(f"{w}author")} for kind, tag, of in said for e in body.iter(f"{w}{tag}") if of(e)]
    extra = json.dumps({"redline_changes": changes}, ensure_ascii=False) if changes else None
    return [(None, "", "\n\n".join(x for x in out if x.strip()), extra)]


#: Parsers by type: pages as (page, locator, text) and, where there is more to say, JSON.
HANDLERS: dict[str, Callable[[bytes, str], list[tuple]]] = {
    "text/plain": _plain,
    "text/x-python": _plain,
    "text/x-sql": _plain,
    "text/markdown": _plain,
    "application/json": _json,
    "application/pdf": _pdf,
    "text/html": _html,
    "text/csv": _csv,
    "message/rfc822": _eml,
    DOCX: _docx,
}


def parse(files: DataFrame) -> DataFrame:
    """Pages of files (path, content); a file that fails, or has no handler, is one row with its error."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    if f.mime not in HANDLERS:
                        raise LookupError("no handler")
                    rows += [(f.path, *p[:3], p[3] if len(p) > 3 else None, None) for p in HANDLERS[f.mime](bytes(f.content), f.path.lower())]
                except LookupError as e:
                    rows.append((f.path, None, "", "", None, f"{e.args[0]} for {f.mime}"))
                except Exception as e:  # a broken file must not stop the others; the message has no text of it
                    rows.append((f.path, None, "", "", None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page": "Int32"})

    return files.select("path", "content", mime(F.col("content"), F.col("path")).alias("mime")).mapInPandas(step, PAGES)


def register_handler(mime_type: str, handler: Callable[[bytes, str], list[tuple]]) -> None:
    HANDLERS[mime_type] = handler


def parse_file(spark: SparkSession, path: str) -> DataFrame:
    """The pages of one file, or of all files that a pattern names."""
    return parse(spark.read.format("binaryFile").load(path))


def parse_and_chunk(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """The chunks of one file, or of all files that a pattern names; a file that fails has none."""
    from quillspark.operators.chunker import chunk_documents

    pages = parse_file(spark, path).where("error is null")
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("_o"), "page", "text")))
    docs = pages.groupBy("path").agg(F.transform(parts, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"))).alias("pages"))
    return chunk_documents(docs.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "pages"), **limits)
