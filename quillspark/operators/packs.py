"""Authority packs: sections of pages as entries with topic, slots and references, checked and written as YAML.

Pages have doc, page and text; a chunk table gives them back by `pages_of`. Defined cases: text before the first section of a page is an entry of its own
named ``General Provisions``; a document without any text has one entry, its name; rows of one page count in the order of their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import structure
from quillspark.operators.versions import written

# A line that begins a section, and classes of entries by kind of pack.
SECTION_LINE = (
    r"(?i)^(?:(?:(?:[A-Za-z.][A-Za-z.\s]*\s)?(?:Code|U\.S\.C\.|Stat\.|C\.F\.R\.)\s*)?(?:§+|Section|Sec\.|Article|Art\.|Clause|Exhibit)\s*[0-9A-Za-z.\-:]+(?:\([0-9A-Za-z]+\))*"
    r"|\b[0-9]{1,3}\.[0-9]{2,3}(?:\.[0-9]{2,4})?(?:\([A-Za-z0-9]+\))*)(?:\s*[:\-—.]\s*|\s+|$)"
)
CLASSES = {"jurisdiction": "controlling_statute", "standards": "standard_rule", "playbook": "playbook_clause"}


def pages_of(chunks: DataFrame) -> DataFrame:
    """Pages of a chunk table (doc, chunk_index, page, content): a page's chunks in order, parted by blank lines; chunks without a page are page 0."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc", F.coalesce("page", F.lit(0)).alias("page")).agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))


def sections(pages: DataFrame) -> DataFrame:
    """doc, page, section (number on the page), title (null before the first section line) and text."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    begins = T.strip(F.col("line")).rlike(SECTION_LINE)
    page = Window.partitionBy("doc", "page").orderBy("n")
    lines = lines.withColumns({"_begins": begins, "section": F.sum(begins.cast("int")).over(page)})
    parts = F.array_sort(F.collect_list(F.struct("n", "line")))
    title = F.max(F.when(F.col("_begins"), T.strip(F.col("line"))))
    return lines.groupBy("doc", "page", "section").agg(title.alias("title"), T.strip(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("text")).where("text != ''")


def entries(pages: DataFrame, kind: str = "jurisdiction") -> DataFrame:
    """One entry for each section: citation, section_number, title, topic, authority_class, hierarchy_level, raw_content, tokens, references, slots.

    Sections are written to `versions.scratch`, as entries, their slots and documents without any are all derived from them.
    """
    found = written(sections(pages), "sections")
    number = T.section_number(F.col("title"))
    place = F.concat_ws(" p.", F.col("doc").cast("string"), F.when(F.col("page") > 0, F.col("page").cast("string")))
    rows = found.withColumns({"citation": F.coalesce(F.nullif(T.canonical(F.col("title")), F.lit("")), F.col("title"), place), "section_number": F.nullif(number, F.lit("")), "hierarchy_level": F.lit("section")})
    alone = pages.select("doc").distinct().join(rows.select("doc").distinct(), "doc", "left_anti")
    name = F.col("doc").cast("string")
    empty = alone.select("doc", F.lit(0).alias("page"), F.lit(0).alias("section"), name.alias("title"), F.lit("").alias("text"), F.concat(name, F.lit(" Main")).alias("citation"), F.lit(None).cast("string").alias("section_number"), F.lit("document").alias("hierarchy_level"))
    rows = rows.withColumn("title", F.coalesce("title", F.lit("General Provisions"))).unionByName(empty.withColumns({c: F.col(c).cast(t) for c, t in (("page", "int"), ("section", "long"))}))
    rows = rows.withColumns({"topic": T.topic(F.col("title"), F.col("text")), "authority_class": F.lit(CLASSES[kind]), "estimated_tokens": T.token_estimate(F.col("text")), "_r": T.references(F.col("text"))})
    rows = rows.withColumn("section_id", F.xxhash64("doc", "page", "section"))
    slot = F.struct("slot", "value", "unit", "quoted_sentence")
    said = structure.slots(rows.select("section_id", "text")).groupBy("section_id").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    out = rows.join(said, "section_id", "left")
    none = F.array().cast("array<struct<slot:string,value:double,unit:string,quoted_sentence:string>>")
    return out.select("doc", "page", "section", "citation", "section_number", "title", "topic", "authority_class", "hierarchy_level", F.col("text").alias("raw_content"), "estimated_tokens", "_r.*", F.coalesce("slots", none).alias("slots"))


def covered_topics(of_entries: DataFrame) -> DataFrame:
    """Topics of each document's entries, in order."""
    return of_entries.groupBy("doc").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def _yaml(value: object, depth: int) -> str:
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"\n{pad}{k}:{_yaml(v, depth + 1)}" for k, v in value.items()) if value else " {}"
    if isinstance(value, list):
        items = [_yaml(v, depth + 1) for v in value]
        return "".join(f"\n{pad}- {x.lstrip()}" for x in items) if items else " []"
    if isinstance(value, str):
        if "\n" in value and value == value.strip() and value.isprintable() is False and not any(line != line.rstrip() or line.startswith("\t") for line in value.split("\n")):
            return " |-\n" + "\n".join(f"{pad}{line}" if line else "" for line in value.split("\n"))
        return " '" + value.replace("'", "''") + "'" if value.isprintable() else ' "' + "".join(c if c.isprintable() and c not in '"\\' else f"\\U{ord(c):08x}" for c in value) + '"'
    return " null" if value is None else f" {str(value).lower()}" if isinstance(value, bool) else f" {value}"


def to_yaml(of_entries: DataFrame, doc: object, **head: object) -> str:
    """One document's pack as YAML, multi-line texts as block scalars; only this pack's entries reach the driver."""
    rows = of_entries.where(F.col("doc") == doc).orderBy("page", "section")
    items = [r.asDict(recursive=True) for r in rows.drop("doc").toLocalIterator()]
    topics = sorted({r["topic"] for r in items}) or ["General"]
    return _yaml({"pack_id": str(doc), **head, "covered_topics": topics, "entries": items}, 0).lstrip() + "\n"
