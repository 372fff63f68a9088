"""Text, heading and citation rules as column expressions.

Words are ``[\\p{L}\\p{N}_]+``, which Java and RE2 read alike. All functions take and return columns and stay within the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# Words that a lexical query leaves out.
STOPWORDS = (
    "the and for with from that this these those what when where which who whom whose why how are was were been being have has had "
    "does did doing will would could should can may might must shall into onto upon about under over between through during before after "
    "not nor but or near any all each every some such other than then there their theirs they them its your our"
).split()
# Labels that need no section sign, file endings that a title drops, and lines that are page furniture.
PLAIN_LABELS = ("section", "row", "art", "table", "exhibit", "attachment", "item", "schedule", "clause", "appendix", "para")
DOC_ENDING = r"(?i)\.(?:pdf|docx?|txt|md|markdown|html?|rtf|csv|json|xml)$"
PAGE_CRUMB = r"^page\s+\d+(?:\s+of\s+\d+)?$"
NOISE_LINE = (
    r"(?i)^(?:page\s+\d+(?:\s+of\s+\d+)?|\d+\s*[/\-]\s*\d+|-\s*\d+\s*-|\d+|confidential|privileged|attorney-client\s+privilege|all\s+rights\s+reserved"
    r"|[A-Z]{2,12}[-_\s]*\d{4,12}|(?:EXHIBIT|(?:PLTF|DEF|GOV|STATE)\s+EX(?:HIBIT)?)\s*(?:#|NO\.?)?\s*[\w.\-]+|(?:TRANSMISSION|FAX|SENT|RCVD)\b.*"
    r"|Case\s+[0-9]+:[0-9]{2}-[a-z]{2,4}-[0-9]+.*)$"
)
TOC_LINE = r"(?i)(?:\.{3,}|_{3,}|-{3,})\s*(?:\d+|[ivxlcdm]+)$"
SECTION_WORD = r"^(?:§+|section|sec\.|article|art\.|clause)\s*"
# What a reference to a section looks like in a heading, words before a number that make one operative, and limits in characters
# of a heading's line, of a title kept whole, of capitals before a reference, and of a line of capitals.
SECTION_REFERENCE = (
    r"(?:(?:(?:[A-Za-z.]+\s+)*(?:Code|U\.S\.C\.|Stat\.|C\.F\.R\.)\s*)?(?:§+|Section|Sec\.|Article|Art\.|Clause|Exhibit)\s*[0-9A-Z][0-9A-Za-z.\-:]*(?:\([0-9A-Za-z]+\))*"
    r"|\b[0-9]{1,3}\.[0-9]{2,3}\.[0-9]{2,4}(?:\([A-Za-z0-9]+\))*)"
)
OPERATIVE = r"(?i)(?:§+|Section|Sec\.|Article|Art\.|Clause)\s*[0-9IVXLCDM]+"
LINE_MOST, TITLE_MOST, PREFIX_MOST, CAPITALS = 120, 100, 40, (5, 79)
# Beginnings of headings by level, and forms of a reference to a section.
LEVELS = ((1, r"^(?:article|art\.|chapter|part|title|exhibit|schedule|appendix)"), (2, r"^(?:section|sec\.|§|clause|\d+\.\d+)"), (3, r"^(?:\([a-z0-9]+\)|subsection|sub-section|paragraph)"))
TREE_LEVELS = ((1, r"^(?:article|art\.|chapter|part|title )"), (2, r"^(?:section|sec\.|§|clause|[0-9]+\.[0-9]+)"), (3, r"^(?:\(|subsection|sub-section)"))
SECTION_FORMS = (r"(?i)(?:§+|Section|Sec\.|Article|Art\.|Clause|Exhibit)\s*([0-9A-Za-z.\-:]+)", r"\b([0-9]{1,4}(?:\.[0-9]+)*)(?:\([0-9A-Za-z]+\))+", r"\b([0-9]{1,4}(?:\.[0-9]+)+)")
#: A reference from the name of its code to the words behind it.
WHOLE_REFERENCE = r"""(?i)(?:(?:Code|U\.S\.C\.|Stat\.|C\.F\.R\.)\s*)?(?:§+|Section|Sec\.|Article|Art\.|Clause|Exhibit)\s*[0-9A-Za-z.\-:]+(?:\([0-9A-Za-z]+\))*(?:\s+[A-Za-z0-9\s,\-'":]{0,60})?"""
# Topics by the first phrase found, in this order.
TOPICS: list[tuple[str, tuple[str, ...]]] = [
    ("Security Deposits", ("security deposit",)),
    ("Just Cause Evictions", ("just cause", "evict")),
    ("Rent Control & Preemption", ("rent control", "costa-hawkins")),
    ("Rent Increases", ("rent increase", "rent adjustment")),
    ("Utility Shutoff & Lockouts", ("utility", "lockout")),
    ("Owner Move-In", ("owner move-in", "omi")),
    ("Service Level Commitments", ("availability", "service level", "sla")),
    ("Limitation of Liability", ("liability", "indemnif")),
    ("Premises & Expansion", ("expansion", "leased premises")),
    ("Tenant Improvements", ("allowance", "improvement")),
    ("Financial Statements", ("revenue", "10-k", "financial")),
]


def source_hash(text: Column) -> Column:
    """SHA-256 of a text with its white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def model_checksum(backend: Column, model: Column, dim: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.lower(F.concat_ws(":", backend, model, dim.cast("string"))), 256))


def short_id(value: Column) -> Column:
    """31 bits of an MD5, for ids that have to be small integers."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def doc_title(filename: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(filename), DOC_ENDING, ""), r"[/\\_\-]+", " "), r"\s+", " "))


def safe_filename(path: Column) -> Column:
    """The last part of a path, with letters, digits and ``._- `` only."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._\- ]", "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: a break is white space after ``.``, ``!`` or ``?``."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    trimmed = F.length(F.trim(text))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(trimmed / 4)).cast("int")).cast("long")


def topic(title: Column, text: Column) -> Column:
    """The first topic whose phrase occurs anywhere, also inside words."""
    has = lambda x, phrases: reduce(lambda a, b: a | b, [x.contains(p) for p in phrases])
    named = lambda x: reduce(lambda out, t: F.when(has(x, t[1]), t[0]).otherwise(out), reversed(TOPICS), F.lit("General"))
    return F.transform(F.array(F.lower(F.concat_ws(" ", title, text))), named)[0]  # lowered once, not for each phrase


def norm_citation(token: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.lower(token)), SECTION_WORD, ""))


def section_number(text: Column) -> Column:
    """The number of the first statute reference, or of a bare number with dots or brackets; empty if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, form, 1), F.lit("")) for form in SECTION_FORMS], F.substring(text, 1, 0))


def statute_citation(text: Column) -> Column:
    """The first statute reference of a text as a struct: matched, canonical_token (``§ n``, an article as it is written with what follows), normalized_token and section_number."""
    number, article = section_number(text), F.regexp_extract(text, WHOLE_REFERENCE, 0)
    token = F.when(number == "", "").when(F.lower(article).startswith("art"), F.trim(article)).otherwise(F.concat(F.lit("§ "), number))
    return F.struct((number != "").alias("matched"), token.alias("canonical_token"), canonical(text).alias("normalized_token"), number.alias("section_number"))


def canonical(text: Column) -> Column:
    """The first statute reference as lower-case letters and digits; empty if there is none."""
    return F.regexp_replace(F.lower(section_number(text)), "[^a-z0-9]", "")


def _capitals(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def heading_level(heading: Column) -> Column:
    """1 for articles and the like, 2 for sections, 3 for subsections; markdown headings count their hashes, 4 at most."""
    h = F.lower(F.trim(heading))
    dots = F.size(F.regexp_extract_all(h, F.lit(r"(\.\d+)"), F.lit(1)))
    level = F.when(h.startswith("#"), F.least(F.length(F.regexp_extract(heading, r"^(#*)", 1)), F.lit(4)))
    for n, pattern in LEVELS:
        level = level.when(h.rlike(pattern), F.when(dots >= 2, 3).otherwise(2) if n == 2 else n)
    return level.when(_capitals(heading), 1).otherwise(2).cast("long")


def tree_level(title: Column) -> Column:
    """The level of a table-of-contents entry, by a table of its own."""
    t = F.lower(F.trim(title))
    return F.coalesce(*[F.when(t.rlike(pattern), n) for n, pattern in TREE_LEVELS], F.lit(1)).cast("long")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_case(text: Column) -> Column:
    """Letters after a non-letter in upper case, others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def heading(line: Column) -> Column:
    """The title that a stripped line is, or null: what follows hashes; a line with a reference to a section that has nothing but some
    capitals before it, cut to the reference if long; a short line of capitals without a sentence's marks."""
    size, reference = F.length(line), F.regexp_extract(line, f"(?i){SECTION_REFERENCE}", 0)
    before = F.trim(F.regexp_extract(line, f"(?i)^(.*?){SECTION_REFERENCE}", 1))
    leads = (before == "") | (_capitals(before) & (F.length(before) <= PREFIX_MOST))
    cut = F.rtrim(F.regexp_replace(reference, r"[ :.\-—]+$", ""))
    rules = [
        (line.startswith("#"), strip(F.regexp_replace(line, "^#+", ""))),
        (reference != "", F.when(leads, F.when(size <= TITLE_MOST, line).otherwise(cut))),
        (_capitals(line) & size.between(*CAPITALS) & ~line.rlike("[.;!?]"), title_case(line)),
    ]
    title = reduce(lambda low, rule: F.when(rule[0], rule[1]).otherwise(low), reversed(rules), F.lit(None).cast("string"))
    return F.when((size > 0) & (size <= LINE_MOST) & ~is_noise(line) & ~is_toc_line(line), title)


def is_numbered_heading(line: Column) -> Column:
    """Whether a heading's line has a number of its own, or hashes."""
    return line.startswith("#") | line.rlike(OPERATIVE)


def is_noise(line: Column) -> Column:
    return F.trim(line).rlike(NOISE_LINE)


def is_toc_line(line: Column) -> Column:
    return F.trim(line).rlike(TOC_LINE)


def citation(filename: Column, page: Column, locator: Column, header: Column, printed: Column | None = None) -> Column:
    """``file p.N [printed: X] § header``; without a page, the locator stands for it. Never ``p. None``."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    label = F.when(page.isNull() & ~blank(locator), locator).otherwise(F.when(blank(header), locator).otherwise(header))
    s = F.trim(F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"^#+", ""))
    plain = s.startswith("§") | F.lower(s).rlike("^(?:" + "|".join(PLAIN_LABELS) + ")")
    section = F.when(s == "", F.lit(None)).when(plain, s).otherwise(F.concat(F.lit("§ "), s))
    p = F.concat(F.lit("p."), page.cast("string"))
    if printed is not None:
        x = F.trim(F.coalesce(printed, F.lit("")))
        p = F.when((x != "") & (x != page.cast("string")), F.concat(p, F.lit(" [printed: "), x, F.lit("]"))).otherwise(p)
    return F.concat_ws(" ", filename, p, section)


def locator(page: Column, raw: Column, header: Column) -> Column:
    """A struct of kind (page, row_range or heading), path and the formatted locator."""
    head = F.when((header != "") & (header != "General"), header)
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ">"), lambda x: F.trim(x)), lambda x: x != "")
    paged = F.concat(F.lit("Page "), page.cast("string"))
    rows = F.lower(F.coalesce(raw, F.lit(""))).contains("row")
    path = F.when(page.isNotNull(), F.concat(F.array(paged), F.when(head.isNotNull(), F.array(head)).otherwise(parts(raw)))).when(rows, F.array(raw)).otherwise(
        parts(F.when(F.coalesce(raw, F.lit("")) == "", head).otherwise(raw))
    )
    shown = F.when(page.isNotNull(), paged).when(rows, raw).when(F.size(path) > 0, F.concat_ws(" > ", path)).otherwise(F.coalesce(head, F.when(raw != "", raw), F.lit("General")))
    kind = F.when(page.isNotNull(), "page").when(rows, "row_range").otherwise("heading")
    return F.struct(kind.alias("kind"), path.alias("path"), shown.alias("formatted"))


def _crumbs(path: Column, *instead: Column) -> Column:
    """Real parts of a section path joined by ``>``, consecutive ones once; without any, the first real one of ``instead``."""
    real = lambda x: (F.trim(x) != "") & (F.lower(F.trim(x)) != "general") & ~F.lower(F.trim(x)).rlike(PAGE_CRUMB)
    kept = F.transform(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: x.isNotNull() & real(x)), lambda x: F.trim(x))
    once = F.filter(F.zip_with(kept, F.concat(F.array(F.lit("")), kept), lambda x, before: F.when(F.lower(x) != F.lower(F.coalesce(before, F.lit(""))), x)), lambda x: x.isNotNull())
    return reduce(lambda low, c: F.coalesce(low, F.when(real(F.coalesce(c, F.lit(""))), F.trim(c))), instead, F.when(F.size(once) > 0, F.concat_ws(" > ", once)))


def _below_title(text: Column, filename: Column, crumbs: Column) -> Column:
    title = doc_title(F.coalesce(filename, F.lit("")))
    return F.concat_ws("\n", F.when(title != "", F.concat(F.lit("Document: "), title)), F.concat(F.lit("Section: "), crumbs), text)


def contextual(text: Column, filename: Column, path: Column, header: Column) -> Column:
    """The text below its document title and section path: ``Document: …``, ``Section: a > b``."""
    return _below_title(text, filename, _crumbs(path, header))


def rerank_text(text: Column, filename: Column, path: Column, locator: Column, header: Column) -> Column:
    """The same for a reranker; without a path the locator stands for it, then the header."""
    return _below_title(text, filename, _crumbs(path, locator, header))


def path_of(raw: Column) -> Column:
    """A section path from text: a JSON array, or parts between ``>``."""
    parts = F.filter(F.transform(F.split(raw, ">"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), parts)).otherwise(parts)


def match_terms(query: Column, most: int = 28) -> Column:
    """The terms of a lexical query: distinct, lower case, without stopwords unless nothing else is left; numbers, then long words first."""
    raw = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), F.lit(1)))
    usable = F.filter(raw, lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))
    telling = F.filter(usable, lambda t: ~t.isin(STOPWORDS))
    chosen = F.when(F.size(telling) > 0, telling).when(F.size(usable) > 0, usable).otherwise(raw)
    ranked = F.transform(F.sort_array(F.transform(chosen, lambda t, i: F.struct((-t.rlike("[0-9]").cast("int")).alias("d"), (-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))), lambda x: x["t"])
    return F.when(F.size(chosen) > most, F.slice(ranked, 1, most)).otherwise(chosen)


# Phrases that name what a text preempts, is subject to, and defines.
PREEMPTS, SUBJECT_TO = (("preempts", "notwithstanding any other"), r"(?i)(?:preempts|supersedes)\s+([^\n.,;]+)"), (("subject to", "exempted by"), r"(?i)(?:subject to|exempted by)\s+([^\n.,;]+)")
DEFINES = r"['\"“]([A-Z][A-Za-z0-9\s\-_]{2,40})['\"”]\s+(?:means|shall mean|denotes)"


def references(text: Column) -> Column:
    """A struct of what a text preempts, is subject to, and defines, each in order of first mention."""
    found = lambda p: F.filter(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.trim(x))), lambda x: x != "")

    def told(signs: tuple[str, ...], pattern: str) -> Column:
        said = reduce(lambda a, b: a | b, [F.lower(text).contains(s) for s in signs])
        return F.when(said, found(pattern)).otherwise(F.array().cast("array<string>"))

    return F.struct(told(*PREEMPTS).alias("preempts"), told(*SUBJECT_TO).alias("preempted_by"), found(DEFINES).alias("defines"))
