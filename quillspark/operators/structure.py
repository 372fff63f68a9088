"""Structure of texts as relations: paragraphs, row groups, running lines, contents trees, exhibits, slots and pack checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of every line, from 0."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of non-empty lines that are no page furniture; a blank or dropped line, or a heading, ends a run. All within each text's row:
    lines fold into runs, so nothing is shuffled."""
    rows = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    kind = lambda x: F.when((x == "") | T.is_noise(x), 0).when(x.startswith("#"), 2).otherwise(1)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("run"))
    close = lambda a: F.when(a["run"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["run"])))

    def add(a: Column, x: Column) -> Column:
        k = kind(x)
        return (
            F.when(k == 0, F.struct(close(a).alias("done"), F.lit("").alias("run")))
            .when(k == 2, F.struct(F.concat(close(a), F.array(x)).alias("done"), F.lit("").alias("run")))
            .otherwise(F.struct(a["done"].alias("done"), F.when(a["run"] == "", x).otherwise(F.concat(a["run"], F.lit("\n"), x)).alias("run")))
        )

    return docs.select(key, F.posexplode(F.aggregate(rows, empty, add, close)).alias("paragraph", "content"))


def row_groups(rows: DataFrame, group: str, order: str, cells: list[str], size: int = 30, parts: int = 64) -> DataFrame:
    """Pages of ``size`` rows in order, each a markdown table's rows with the locator ``Rows a-b``.

    A group of any size is cut into ``parts`` ranges of ``order`` by its quantiles; the ranges' counts give each its start, so no task orders a whole group.
    """
    cuts = rows.groupBy(group).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cells]), F.lit(" |"))
    dealt = rows.join(cuts, group).select(group, part.alias("_part"), F.col(order).alias("_o"), line.alias("_l"))
    starts = dealt.groupBy(group, "_part").count()
    starts = starts.select(group, "_part", F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_o", "_l")) + F.col("_start")
    numbered = dealt.join(starts, [group, "_part"]).select(group, n.alias("_n"), "_l").withColumn("page_seq", F.floor((F.col("_n") - 1) / size))
    out = numbered.groupBy(group, "page_seq").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"), F.sort_array(F.collect_list(F.struct("_n", "_l"))).alias("_x"))
    return out.select(group, "page_seq", F.concat(F.lit("Rows "), F.col("_a"), F.lit("-"), F.col("_b")).alias("locator"), F.concat_ws("\n", F.col("_x._l")).alias("content"))


def running_lines(pages: DataFrame) -> DataFrame:
    """Lines among the first and last two of a document's pages that at least half of its pages share, two at least: headers and footers.

    ``pages`` has doc, page and text.
    """
    all_lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edges = F.array_distinct(F.concat(F.slice(all_lines, 1, 2), F.when(F.size(all_lines) > 2, F.slice(all_lines, F.greatest(F.lit(3), F.size(all_lines) - 1), F.lit(2))).otherwise(F.array().cast("array<string>"))))
    counts = pages.select("doc", F.explode(edges).alias("line")).groupBy("doc", "line").agg(F.count("*").alias("n_pages"))
    total = pages.groupBy("doc").agg(F.count("*").alias("_total"))
    return counts.join(total, "doc").where("n_pages >= greatest(2, _total / 2) and _total >= 2").select("doc", "line", "n_pages")


def contents_tree(headers: DataFrame) -> DataFrame:
    """Parent of each header (doc, chunk_index, title): the last earlier one of a lesser level, and the depth of that level.

    Levels are 1 to 3, so a parent is the later of two running maxima: one window a document, no self-join.
    """
    rows = headers.withColumn("level", T.tree_level(F.col("title")))
    w = Window.partitionBy("doc").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.max(F.when(F.col("level") == n, F.col("chunk_index"))).over(w)
    rows = rows.withColumns({"_1": last(1), "_2": last(2)})
    parent = F.when(F.col("level") == 2, F.col("_1")).when(F.col("level") == 3, F.greatest("_1", "_2"))
    return rows.select("doc", "chunk_index", "title", "level", parent.alias("parent_index"))


def exhibits(chunks: DataFrame) -> DataFrame:
    """The first chunk of each exhibit, schedule, appendix or addendum that headers name."""
    head = F.concat_ws(" ", "header", "locator")
    kind, ident = (F.regexp_extract(head, r"(?i)\b(Exhibit|Schedule|Appendix|Addendum)\s+([A-Z0-9]+(?:[.\-][A-Z0-9]+)*)", i) for i in (1, 2))
    rows = chunks.select("doc", "chunk_index", "header", F.initcap(kind).alias("_k"), F.upper(ident).alias("_i")).where("_k != ''")
    rows = rows.select("doc", F.concat_ws(" ", "_k", "_i").alias("identifier"), "chunk_index", "header")
    return rows.groupBy("doc", "identifier").agg(F.min("chunk_index").alias("chunk_index"), F.min_by("header", "chunk_index").alias("title"))


def attachments(chunks: DataFrame) -> DataFrame:
    """The first chunk of each attachment that headers or locators name: identifier (what stands behind ``Attachment``), chunk_index, and where it was found.

    ``chunks`` may have mime, the type of their document: attachments of a message are told from others.
    """
    head = F.trim(F.concat(F.coalesce("header", F.lit("")), F.lit(" "), F.coalesce("locator", F.lit(""))))
    name = F.trim(F.regexp_extract(head, r"(?i)\bAttachment(?::\s*|\s+)([^\n\r]+)", 1))
    mime = F.col("mime") if "mime" in chunks.columns else F.lit(None).cast("string")
    source = F.when(mime == "message/rfc822", "email_attachment").otherwise("embedded_attachment")
    rows = chunks.select("doc", "chunk_index", name.alias("identifier"), source.alias("source")).where("identifier != ''")
    return rows.groupBy("doc", "identifier").agg(F.min("chunk_index").alias("chunk_index"), F.min_by("source", "chunk_index").alias("source"))


# Number words of legal texts; for each slot its unit and the phrase that states it (the number is the first group that
# matches), with the dollar amounts that are sought in the text as written; flags and the phrases that raise them; words that ground a flag.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "twenty-one": 21, "twenty-two": 22, "twenty-three": 23, "twenty-four": 24, "twenty-five": 25, "thirty": 30, "thirty-three": 33,
    "thirty-six": 36, "forty": 40, "forty-five": 45, "fifty": 50, "sixty": 60, "ninety": 90, "twice": 2,
}
SLOTS = {
    "deposit_cap_months": ("months", r"(?s)(?:demand(?:\s+or\s+receive)?\s+security.*?in\s+excess\s+of|security\s+deposit.*?(?:exceed|cap\s+is)|security.*?limited\s+to)\s+(\d+(?:\.\d+)?|one|two)\s+month(?:'s|s'|s)?\s+rent|(\d+(?:\.\d+)?|one|two)\s+month(?:'s|s'|s)?\s+rent\s+(?:as\s+a\s+security\s+deposit|for\s+an?\s+(?:unfurnished|furnished))"),
    "small_landlord_cap_months": ("months", r"(?s)(?:no\s+more\s+than\s+two\s+residential\s+rental\s+properties.*?demand\s+up\s+to\s+|small\s+landlord.*?up\s+to\s+)(two|\d+(?:\.\d+)?)\s+month(?:'s|s'|s)?\s+rent"),
    "accounting_days": ("days", r"within\s+(\d+|twenty-one|thirty|fourteen|sixty)\s+(?:calendar\s+)?days"),
    "statutory_damages_multiplier": ("multiplier", r"statutory\s+damages\s+of\s+(?:up\s+to\s+)?(twice|two|\d+(?:\.\d+)?)\s+(?:the\s+amount|times)"),
    "minimum_ownership_percent_omi": ("percent", r"(\d+(?:\.\d+)?)\s*%\s*(?:recorded\s+)?ownership"),
    "occupancy_threshold_months": ("months", r"(?:lawfully\s+occupied[^.]*?for\s+|occupancy\s+of\s+at\s+least\s+)(\d+|twelve|twenty-four)\s+months"),
    "base_cap_percent": ("percent", r"increase\s+[^.]*?more\s+than\s+(\d+(?:\.\d+)?)\s*(?:%|percent)\s+plus"),
    "max_cap_percent": ("percent", r"or\s+(\d+(?:\.\d+)?)\s*(?:%|percent),?\s+whichever\s+is\s+lower"),
    "max_increases_per_year": ("count", r"no\s+more\s+than\s+(\d+|one|two)\s+increments?\s+over\s+(?:any\s+)?12-month"),
    "cure_days": ("days", r"(?:cure\s+within|written\s+notice\s+to\s+cure\s+of)\s+(\d+|one|two|five|ten|fourteen|twenty|thirty|sixty)\s+(?:calendar\s+)?days"),
    "sla_availability_percent": ("percent", r"(?:warrants?\s+|availability\s+of\s+|uptime\s+of\s+)(\d{2}(?:\.\d+)?)\s*%\s*(?:monthly\s+)?(?:service\s+)?(?:availability|uptime)"),
    "liability_cap_months": ("months", r"(?:exceed\s+)?fees\s+paid\s+(?:by\s+customer\s+)?in\s+(?:the\s+)?(?:prior|preceding)\s+(\d+|twelve|twenty-four)\s+months"),
    "max_server_nodes": ("nodes", r"up\s+to\s+(\d+)\s+server\s+nodes"),
    "monthly_base_rent": ("USD", r"base\s+rent[^.]*?shall\s+be\s+\$([0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?)\s+per\s+month"),
    "annual_escalation_percent": ("percent", r"(\d+(?:\.\d+)?)\s*%\s*annual\s+escalation"),
    "allowance_per_sqft": ("USD/sqft", r"allowance\s+of\s+\$([0-9]+(?:\.[0-9]{2})?)\s+per\s+rentable\s+square\s+foot"),
    "rentable_square_feet": ("sqft", r"(\d+(?:,[0-9]{3})*)\s+rentable\s+square\s+feet"),
}
SLOTS_AS_WRITTEN = {
    "daily_statutory_penalty": ("USD", r"\$([0-9]+(?:\.[0-9]{2})?)\s+for\s+each\s+(?:calendar\s+)?day"),
    "minimum_statutory_damages": ("USD", r"(?:not\s+less\s+than|minimum\s+statutory\s+damages\s+of)\s+[^$0-9]*\$([0-9]+(?:\.[0-9]{2})?)"),
}
#: What a text must hold for the phrase of a slot to match; only then is the phrase sought.
SLOT_WORDS = {
    "deposit_cap_months": ("month", "rent"), "small_landlord_cap_months": ("month", "rent"), "accounting_days": ("within", "days"), "statutory_damages_multiplier": ("statutory", "damages"),
    "minimum_ownership_percent_omi": ("%", "ownership"), "occupancy_threshold_months": ("months",), "base_cap_percent": ("increase", "plus"), "max_cap_percent": ("whichever", "lower"),
    "max_increases_per_year": ("12-month",), "cure_days": ("cure", "days"), "sla_availability_percent": ("%",), "liability_cap_months": ("fees", "paid", "months"), "max_server_nodes": ("server", "nodes"),
    "monthly_base_rent": ("$", "month"), "annual_escalation_percent": ("annual", "escalation"), "allowance_per_sqft": ("$", "allowance"), "rentable_square_feet": ("rentable", "square"),
    "daily_statutory_penalty": ("$", "each", "day"), "minimum_statutory_damages": ("$",),
}
FLAGS = {
    "prevailing_attorney_fees": ("reasonable attorney's fees to the prevailing party", "award reasonable attorney"),
    "requires_written_warning_notice": ("written notice to cease", "written notice of the rent adjustment program"),
    "requires_relocation_payment": ("relocation assistance", "relocation payments"),
    "vacancy_decontrol": ("initial and all subsequent rental rates", "vacancy decontrol"),
}
FLAG_GROUNDS = ("true", "1", "one", "shall", "must", "required", "prohibited", "may not", "notice")


def slots(sections: DataFrame) -> DataFrame:
    """Typed values that sentences of a section state, with unit and sentence; the last sentence that grounds a slot wins.

    A value is grounded if its sentence holds its whole part in digits or as a number word; a flag (value 1) needs a word that binds.
    ``sections`` has section_id and text. Only texts that hold all words of some slot, or a phrase of some flag, are split into sentences.
    """
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    holds = lambda text, phrases: reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])
    has_words = lambda text: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [text.contains(w) for w in words]) for words in SLOT_WORDS.values()])
    has_any = lambda text: has_words(text) | holds(text, [p for phrases in FLAGS.values() for p in phrases])
    telling = sections.where(F.exists(F.array(F.lower("text")), has_any))
    each = telling.select("section_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence")).withColumn("low", F.lower("sentence"))
    value_of = lambda text, pattern: reduce(F.concat, [F.regexp_extract(text, pattern, i + 1) for i in range(len(re.findall(r"\((?!\?)", pattern)))])
    said = lambda text, slot, pattern: F.when(reduce(lambda a, b: a & b, [text.contains(w) for w in SLOT_WORDS[slot]]), value_of(text, pattern)).otherwise("")
    rule = lambda slot, unit, raw, flag: F.struct(F.lit(slot).alias("slot"), F.lit(unit).cast("string").alias("unit"), raw.alias("raw"), F.lit(flag).alias("flag"))
    rules = [rule(s, unit, said(F.col("low"), s, p), False) for s, (unit, p) in SLOTS.items()]
    rules += [rule(s, unit, said(F.col("sentence"), s, p), False) for s, (unit, p) in SLOTS_AS_WRITTEN.items()]
    rules += [rule(s, None, F.when(holds(F.col("low"), phrases), "1").otherwise(""), True) for s, phrases in FLAGS.items()]
    found = each.select("section_id", "at", "sentence", "low", F.explode(F.filter(F.array(*rules), lambda r: r["raw"] != "")).alias("r")).select("section_id", "at", "sentence", "low", "r.*")
    value = F.when(F.col("raw").rlike("^[0-9]"), F.regexp_replace("raw", ",", "").try_cast("double")).otherwise(words[F.col("raw")])
    found = found.withColumn("value", F.coalesce(value, F.lit(0.0))).withColumn("_whole", F.floor("value").cast("string"))
    spoken = F.exists(F.map_keys(words), lambda w: (words[w] == F.floor("value")) & F.col("low").contains(w))
    found = found.where(F.when(F.col("flag"), holds(F.col("low"), FLAG_GROUNDS)).otherwise(F.col("low").contains(F.col("_whole")) | spoken))
    return found.groupBy("section_id", "slot").agg(F.max_by("value", "at").alias("value"), F.max_by("unit", "at").alias("unit"), F.max_by("sentence", "at").alias("quoted_sentence"))


def pack_violations(entries: DataFrame, budget: int = 850) -> DataFrame:
    """What is wrong with a pack's entries (pack_id, entry_no, citation, topic, raw_content): one row for each violation."""
    again = F.row_number().over(Window.partitionBy("pack_id", "citation").orderBy("entry_no")) > 1
    tokens = T.token_estimate(F.coalesce("raw_content", F.lit("")))
    checks = [
        ("missing citation", F.coalesce("citation", F.lit("")) == ""),
        ("duplicate citation", (F.coalesce("citation", F.lit("")) != "") & again),
        ("missing topic", F.coalesce("topic", F.lit("")) == ""),
        ("empty content", F.trim(F.coalesce("raw_content", F.lit(""))) == ""),
        ("over token budget", tokens > budget),
    ]
    rows = entries.select("pack_id", "entry_no", F.array(*[F.when(c, F.lit(n)) for n, c in checks]).alias("_v"))  # the window comes before the generator
    return rows.select("pack_id", "entry_no", F.explode(F.array_compact("_v")).alias("violation"))


# What every pack has at its root.
PACK_KEYS = ("pack_id", "version", "publisher", "coverage", "description")


def pack_root_violations(packs: DataFrame, entries: DataFrame, required: Sequence[str] = PACK_KEYS) -> DataFrame:
    """(pack_id, violation) of whole packs: a required column of ``packs`` (pack_id, covered_topics, ...) that is null or missing, no covered topics, no entries."""
    there = {c.lower() for c in packs.columns}
    lacks = [F.when(F.col(c).isNull() if c in there else F.lit(True), F.lit(f"missing {c}")) for c in required]
    topics = F.when(F.coalesce(F.size("covered_topics"), F.lit(0)) < 1, F.lit("no covered topics"))
    held = entries.select("pack_id").distinct().withColumn("_held", F.lit(True))
    empty = F.when(F.col("_held").isNull(), F.lit("no entries"))
    rows = packs.join(held, "pack_id", "left").withColumn("_v", F.array(*lacks, topics, empty))
    return rows.select("pack_id", F.explode(F.array_compact("_v")).alias("violation"))


def slot_violations(found: DataFrame) -> DataFrame:
    """(pack_id, entry_no, slot, violation) of slots (value, quoted_sentence) without a sentence, or whose sentence doesn't hold their value.

    A value stands in its sentence as it is written, in its whole part's digits, or as a number word.
    """
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    low, whole = F.lower("quoted_sentence"), F.floor("value").cast("string")
    spoken = F.exists(F.map_keys(words), lambda w: (words[w] == F.floor("value")) & low.contains(w))
    grounded = low.contains(F.col("value").cast("string")) | low.contains(whole) | spoken
    wrong = F.when(F.coalesce("quoted_sentence", F.lit("")) == "", "no quoted sentence").when(~F.coalesce(grounded, F.lit(False)), "value not in its sentence")
    return found.select("pack_id", "entry_no", "slot", wrong.alias("violation")).where("violation is not null")


def bbox_union(boxes: DataFrame, key: str) -> DataFrame:
    """The least box around all boxes (left, top, width, height) of a key, rounded to 2 places."""
    g = boxes.groupBy(key).agg(F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"))
    return g.select(key, F.round("l", 2).alias("left"), F.round("t", 2).alias("top"), F.round(F.col("r") - F.col("l"), 2).alias("width"), F.round(F.col("b") - F.col("t"), 2).alias("height"))


def line_boxes(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines (doc, page, text, ...) with the box of the block of the same text on their page; of several blocks the last."""
    last = blocks.groupBy("doc", "page", F.trim("text").alias("_t")).agg(F.max_by(F.struct("left", "top", "width", "height"), "block").alias("box"))
    named = lines.withColumn("_t", F.trim("text"))
    return named.join(last, ["doc", "page", "_t"], "left").drop("_t")


def chunk_confidence(items: DataFrame) -> DataFrame:
    """The mean confidence of a chunk's pieces that have one; null without any. ``items`` has doc, chunk_index and confidence."""
    return items.groupBy("doc", "chunk_index").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
