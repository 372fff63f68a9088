"""Judges urls by host and path rules, and where none fits by a weighted vocabulary that an Aho-Corasick automaton finds in one pass over the url.

A strict term rejects alone; soft terms reject if several different ones occur and their weights sum to 1 or more. A term counts only between
boundaries: no letter may stand next to its first or last letter, no digit next to its first or last digit, so ``win`` isn't in ``window``, but is
in ``win24`` and ``/win/``. Urls are lower-cased and percent-decoded for terms, whole, with query and fragment.

Rules and vocabulary are parameters, bounded by what a user writes; no row is shuffled, so hot hosts cost nothing.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule, and is judged by its terms (a null has none: allow); an empty
path fits no rule, as each rule's path begins with ``/``; of two rules of one length, the one with the longer host wins, then the greater text; equal
rows are judged alike; an empty table gives an empty result; other columns stay, but for those named like a new one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different soft terms, and their sum of weights in hundredths, from which a url is rejected. A term of so many hundredths is strict.
SEVERAL, LEAST, STRICT = 2, 100, 100


class Rule(NamedTuple):
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
#: Terms by weight in hundredths: strict ones first, then soft ones.
TERMS = {
    100: "adult-x adultx camgirl camgirls casino casinos escort escorts hentai milf nsfw nude nudes porn porno pornhub pussy sexcam spam viagra warez x-rated xxx xvideos",
    60: "ads adult adware bet bets bingo botox cialis clickbait coupon crack dating diet erotic gambling jackpot keygen loan loans lottery lotto payday pharma pharmacy pill pills poker replica sex sexy slots torrent torrents weightloss",
    40: "bonus buy cheap click crypto deal deals download farm fast free girls hot instant money offer offers online promo sale tracker track traffic win winner",
}
VOCABULARY = {term: weight for weight, terms in TERMS.items() for term in terms.split()}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A to Z lower-cased, and the path behind it; both empty where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring_index(F.regexp_replace(text, r"(?s)^.*?://", ""), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    return F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null where none does."""
    fits = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    named = lambda r: F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(len(r.host)).alias("host"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    return F.array_max(F.array_compact(F.array(*[F.when(fits(r), named(r)) for r in rules]))) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


@lru_cache(maxsize=4)
def _automaton(vocabulary: frozenset[tuple[str, int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _joined(a: str, b: str) -> bool:
    """Whether no boundary lies between two neighbours."""
    return a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit()


def hits(url: str | None, vocabulary: frozenset[tuple[str, int]]) -> list[tuple[str, int]]:
    """(term, weight) for each bounded occurrence."""
    text = unquote(url or "", errors="replace").lower()
    out = []
    for end, (term, weight) in _automaton(vocabulary).iter(text):
        start = end - len(term) + 1
        if not (start and _joined(text[start - 1], text[start]) or end + 1 < len(text) and _joined(text[end], text[end + 1])):
            out.append((term, weight))
    return out


def terms(url: Column, vocabulary: dict[str, int]) -> Column:
    """Struct of all hits, different strict terms, different soft terms, and the sum of these soft terms' weights."""
    weights = frozenset(vocabulary.items())

    @F.pandas_udf("n_hits long, n_strict long, n_soft long, soft_weight long")
    def count(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            found = hits(u, weights) if weights else []
            soft = {t: w for t, w in found if w < STRICT}
            rows.append((len(found), len({t for t, w in found if w >= STRICT}), len(soft), sum(soft.values())))
        return pd.DataFrame(rows, columns=["n_hits", "n_strict", "n_soft", "soft_weight"])

    return count(url)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, vocabulary: dict[str, int] | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule (host and path of the longest that fits, else null), verdict (its own, else that of the terms) and the counts of terms."""
    host, path = host_and_path(F.col(url))
    new = ["host", "path", "rule", "verdict", "n_hits", "n_strict", "n_soft", "soft_weight"]
    kept = [c for c in pages.columns if c.lower() not in new]
    of_terms, of_rule = terms(F.col(url), VOCABULARY if vocabulary is None else vocabulary), rule_for(F.col("_n.host"), F.col("_n.path"), rules)
    rows = pages.select(F.struct(*kept).alias("_row"), F.struct(host.alias("host"), path.alias("path")).alias("_n"), of_terms.alias("_t")).withColumn("_r", of_rule)
    rejected = (F.col("_t.n_strict") > 0) | ((F.col("_t.n_soft") >= SEVERAL) & (F.col("_t.soft_weight") >= LEAST))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(rejected, "block").otherwise("allow"))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in kept], "_n.host", "_n.path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), *[f"_t.{c}" for c in new[4:]])
