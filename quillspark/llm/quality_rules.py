"""Quality rules as a bitmask ledger: every rule once a document, verdicts and ablations from the stored bits.

`ledger` measures each text and writes one bit for each rule that fails. A policy is a set of rules with a version; a verdict is
``fail_mask & policy == 0``, so a new policy, or the question what a rule alone removes, never reads a text again. Built-in SQL
functions only; all work is within a row, so nothing is shuffled and no group can be hot.

Defined cases: a null or empty text has no words and fails ``few_words``; a text of any length is measured whole, within its row; equal windows
count each time; repeated rows each get their own row; an empty table gives an empty ledger; other columns stay, and those named as the
measures or ``fail_mask`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, SPACE_CLASS, let, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash of their word hashes. Positions of repeated windows, sorted, each cover the words up to
    the next one, 5 at most.
    """
    mix = lambda a, b: F.xxhash64(a, b)
    long0 = F.lit(0).cast("long")

    def windows(h: Column) -> Column:
        n = F.size(h)
        two = lambda h: F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), mix)
        four = lambda t: F.zip_with(F.slice(t, 1, n - 3), F.slice(t, 3, n - 3), mix)
        return let(two(h), lambda t: let(four(t), lambda f: F.zip_with(F.slice(f, 1, n - 4), F.slice(h, 5, n - 4), mix)))

    def covered(keys: Column) -> Column:
        rows = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            n = F.size(s)
            same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["k"] == b["k"])
            return let(
                same,
                lambda e: F.filter(
                    F.zip_with(
                        s,
                        F.zip_with(F.concat(e, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), e), lambda after, before: after | before),
                        lambda row, twice: F.when(twice, row["i"]),
                    ),
                    lambda i: i.isNotNull(),
                ),
            )

        def length(at: Column) -> Column:
            m = F.size(at)
            gaps = F.zip_with(F.slice(at, 1, m - 1), F.slice(at, 2, m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
            return F.when(m == 0, long0).otherwise(F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g))

        return let(rows, lambda s: let(F.sort_array(repeated(s)), length))

    some = let(
        windows(F.transform(words, lambda w: F.xxhash64(w))), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), long0).otherwise(covered(k))
    )
    return F.when(F.size(words) <= WINDOW, long0).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    dense = F.translate(text, SPACE, "")
    by_line = let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = let(words, lambda w: F.struct(long(F.size(w)).alias("n"), _repeat_words(w).alias("rep")))
    return let(
        F.struct(
            by_word.alias("w"),
            by_line.alias("l"),
            long(F.length(dense)).alias("chars"),
            long(F.length(F.translate(text, SYMBOLS, ""))).alias("plain"),
            long(F.length(text)).alias("all"),
            long(F.length(F.translate(text, "!", ""))).alias("calm"),
        ),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            m["chars"].alias("word_chars"),
            (m["all"] - m["plain"]).alias("n_symbols"),
            m["l"]["dup"].alias("n_dup_lines"),
            m["w"]["rep"].alias("n_repeat_words"),
            m["l"]["n"].alias("n_lines"),
            (m["all"] - m["calm"]).alias("n_bangs"),
        ),
    )


#: Name and SQL condition of failure; the place in the list is the bit. Rules are only ever appended, so that stored masks stay valid.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("same_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("bangs", "5 * n_bangs > n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Rule sets by version. Version 1 is the base.
POLICIES: dict[str, tuple[str, ...]] = {"v1": ("few_words", "repeats"), "v2": tuple(BIT)}


def policy_mask(version: str) -> int:
    return sum(BIT[r] for r in POLICIES[version])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns, one column for each measure, and ``fail_mask``; same-named columns are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]
    held = unused(docs, "_m")
    df = docs.drop("fail_mask").withColumn(held, measures(F.col(text)))
    df = df.withColumns({n: F.col(held)[n] for n in names}).drop(held)
    bits = [F.when(F.expr(sql), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, sql in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return df.withColumn("fail_mask", mask)


def verdict(version: str, mask: str = "fail_mask") -> Column:
    """Whether a document passes a policy."""
    return F.col(mask).bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it removes, and that the policy without it keeps.

    The ledger shrinks to one row a mask first (at most 2 to the number of rules), then only bits are compared.
    """
    full = policy_mask(version)
    masks = entries.groupBy("fail_mask").count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[version]])
    each = masks.select("*", F.explode(rules).alias("r")).select("fail_mask", "count", "r.rule", "r.bit")
    hit = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).alias
    m = F.col("fail_mask")
    return each.groupBy("rule").agg(
        hit(m.bitwiseAND(F.col("bit")) != 0)("n_failed"),
        hit(m.bitwiseAND(F.lit(full)) == F.col("bit"))("n_only_this"),
        hit(m.bitwiseAND(F.lit(full) - F.col("bit")) == 0)("n_kept_without"),
    )


def clean(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    return ledger(docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns]), "_text").where(verdict(version)).select(
        *[F.col(f"_{c}").alias(c) for c in docs.columns]
    )
