"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then the nearest ancestor directory.

The units of a file are its lines, its paragraphs, the comment at its head, and the whole, without comment marks. A unit's terms are its
words and pairs of neighbouring words; a word's idf comes from how many files of the corpus hold it, a pair weighs as its rarer word, and
words of no template weigh 1. Units join the templates' weights by term, products add up by unit and template, and a file's best template at `LEAST`
or more is its own licence. A file speaks for its directory if it is called like a licence file, matches as a whole, or if at least half of its words
are in units that match. A file without a licence of its own takes that of the nearest ancestor directory that has one, by joins on paths.

Only units with one of a template's rarest terms are compared: without these, the rest of the template's weight can't reach `LEAST`, so
nothing is lost.

Defined cases: null or empty texts have no own licence; long texts are read whole; a null path inherits from the root only; equal matches: the text of more
terms, then the lesser name; two licence files of one directory: the better match, then the lesser path; repeated rows get a row each, and rows of one path share
their licence; an empty table gives an empty result; columns named as those added are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_hot, stored
from quillspark.llm.licence_texts import TEMPLATES

LEAST = 0.6
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
COMMENT = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)[ \t]?"
CODE = r"^[ \t]*(?![ \t]|#|//|/\*|\*|--|;|%|<!--)."
#: Names of files that speak for their directory.
NAMES = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)(?:[.\-][^/]*)?$"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def bag(text: str) -> Counter:
    """Words and pairs of a text."""
    w = re.findall(TERM, text.lower())
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])


def vectors(rarity: dict[str, float], templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, number of its text, unit weights by term)."""
    out = []
    for name, texts in templates.items():
        for i, text in enumerate(texts):
            raw = {t: n * weight(t, rarity) for t, n in bag(text).items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            out.append((name, i, {t: w / norm for t, w in sorted(raw.items())}))
    return out


def weight(term: str, rarity: dict[str, float]) -> float:
    return max(rarity[w] for w in term.split())


def needed(rows: list[tuple[str, int, dict[str, float]]], rarity: dict[str, float], least: float = LEAST) -> set[str]:
    """Words one of which a unit must hold to reach ``least`` with any template, the rarest first: the cosine is at most the root of the squared
    weights of the template's terms that the unit holds. A pair counts with its rarer word."""
    out: set[str] = set()
    for _, _, terms in rows:
        mass: dict[str, float] = {}
        for t, w in terms.items():
            one = max(t.split(), key=lambda x: (rarity[x], x))
            mass[one] = mass.get(one, 0.0) + w * w
        rest = sum(mass.values())
        for t in sorted(mass, key=lambda t: (-rarity[t], t)):
            if rest < least * least - 1e-5:
                break
            out.add(t)
            rest -= mass[t]
    return out


def corpus_rarity(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> dict[str, float]:
    """The idf of each word of the templates over all files: one scan, and a row for each word reaches the driver."""
    known = sorted({w for texts in templates.values() for t in texts for w in bag(t) if " " not in w})
    held = F.array_intersect(F.array_distinct(words_of(F.col("text"))), F.array(*[F.lit(w) for w in known]))
    counts = files.where("text is not null").select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    n = seen.get("", 0)  # every file once
    return {w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in known}


def units(files: DataFrame) -> DataFrame:
    """path, file (hash of path and text), kind, part and words of each unit; kinds: 0 line, 1 paragraph, 2 head, 3 whole."""
    clean = F.regexp_replace("text", COMMENT, "")
    lines = F.split("text", "\n")
    code = F.array_position(F.transform(lines, lambda x: x.rlike(CODE)), True)  # the first line that is no comment
    head = F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n"), COMMENT, "")
    parts = lambda kind, array: F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("part"), x.alias("text")))
    every = F.concat(parts(0, F.split(clean, "\n")), parts(1, F.split(clean, r"\n[ \t]*\n")), parts(2, F.array(head)), parts(3, F.array(clean)))
    rows = files.select("path", F.xxhash64("path", "text").alias("file"), F.explode(every).alias("u"))
    return rows.select("path", "file", "u.kind", "u.part", words_of(F.col("u.text")).alias("words"))


def own_licences(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """path, best template, its cosine, and whether the file speaks for its directory, for files with a match. One row for each path."""
    spark = files.sparkSession
    rarity = corpus_rarity(files, templates)
    rows = vectors(rarity, templates)
    telling = F.array(*[F.lit(w) for w in sorted(needed(rows, rarity))])
    # a row for each term of each template
    weights = F.broadcast(spark.createDataFrame([(n, i, len(terms), t, w) for n, i, terms in rows for t, w in terms.items()], "licence string, template int, size int, term string, weight double"))
    idf = F.broadcast(spark.createDataFrame([(t, weight(t, rarity)) for t in sorted({t for _, _, terms in rows for t in terms})], "term string, idf double"))
    keys = ["file", "kind", "part"]
    some = files.where("path is not null and text is not null").where(F.arrays_overlap(words_of(F.col("text")), telling)).select("path", "text")
    kept = stored(units(some).where(F.arrays_overlap("words", telling)).dropDuplicates(keys), "licence-units")  # read three times below
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    terms = kept.select(*keys, F.explode(F.concat("words", pairs)).alias("term")).groupBy(*keys, "term").count().join(idf, "term", "left")
    terms = terms.withColumn("w", F.col("count") * F.coalesce("idf", F.when(F.col("term").contains(" "), 0.0).otherwise(1.0)))
    # stored, as norm and products read them: two shuffles of all terms become one; the text of a term is only needed where it has an idf
    terms = stored(terms.select(*keys, F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), "w"), "licence-terms")
    norm = terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = terms.where("term is not null").join(weights, "term").groupBy(*keys, "licence", "template", "size").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    match = dot.join(norm, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST)
    best = match.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("size")).alias("n"), "licence", "score")).alias("b"))
    covered = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_w"))), F.lit(0))
    best = stored(best.join(kept.select("path", *keys, F.size("words").alias("_w")), keys), "licence-matches")
    share = best.groupBy("path", "file").agg(covered(0).alias("_l"), covered(1).alias("_p"), covered(3).alias("_f"))
    sizes = kept.where("kind = 3").select("file", F.size("words").alias("_n"))
    speaks = share.join(sizes, "file").groupBy("path").agg(F.max(F.expr("2 * greatest(_l, _p, _f) >= _n")).alias("is_licence_file"))
    first = best.groupBy("path").agg(F.min("b").alias("b"))
    return first.join(speaks, "path").select("path", "b.licence", "b.score", (F.col("is_licence_file") | F.col("path").rlike(NAMES)).alias("is_licence_file"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The rows of ``files`` (path, text, any others) without text, with own_licence, score, inherited_licence, inherited_from, licence."""
    own = stored(own_licences(files.select("path", "text"), templates), "licences")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    speaks = own.where("is_licence_file").groupBy(folder(F.col("path")).alias("above")).agg(F.min_by("licence", F.struct((-F.col("score")).alias("s"), "path")).alias("inherited_licence"))
    rows = files.drop("text", "own_licence", "score", "inherited_licence", "inherited_from", "licence").withColumn("_dir", folder(F.coalesce("path", F.lit(""))))
    # each directory once: a directory with a third of all files costs no more than another
    dirs = rows.select("_dir").distinct().withColumn("_names", F.split("_dir", "/"))
    up = dirs.select("_dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_names")), lambda i: F.concat_ws("/", F.slice("_names", 1, i)))).alias("depth", "above"))
    near = up.join(speaks, "above").groupBy("_dir").agg(F.max_by(F.struct("inherited_licence", F.col("above").alias("inherited_from")), "depth").alias("i"))
    named = rows.join(own.select("path", F.col("licence").alias("own_licence"), "score"), "path", "left")
    out = join_hot(named, near, "_dir", "path", "left", counts=rows.groupBy("_dir").count())
    return out.select(*[c for c in rows.columns if c != "_dir"], "own_licence", "score", "i.inherited_licence", "i.inherited_from", F.coalesce("own_licence", "i.inherited_licence").alias("licence"))
