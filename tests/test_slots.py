"""Slots seek a phrase only where its words are."""

import re

from quillspark.operators import packs, structure

SAID = [
    "demand or receive security in excess of one month's rent", "2 months rent for an unfurnished", "small landlord takes up to two months' rent", "within 30 calendar days", "statutory damages of up to twice the amount",
    "at least 33% recorded ownership", "occupancy of at least twelve months", "increase of more than 5% plus", "or 10%, whichever is lower", "no more than 1 increment over any 12-month", "cure within ten days", "warrants 99.95% monthly uptime",
    "fees paid by customer in the prior 12 months", "up to 50 server nodes", "base rent shall be $12,500.00 per month", "3.5% annual escalation", "allowance of $45.00 per rentable square foot", "1,200 rentable square feet", "$25.50 for each day", "not less than $500",
]


def test_phrases_hold_the_words_they_are_sought_by():
    patterns = {s: p for s, (_, p) in {**structure.SLOTS, **structure.SLOTS_AS_WRITTEN}.items()}
    assert patterns.keys() == structure.SLOT_WORDS.keys()
    for slot, pattern in patterns.items():
        found = [m.group(0) for text in SAID if (m := re.search(pattern, text))]
        assert found and all(w in text for text in found for w in structure.SLOT_WORDS[slot])


def test_every_phrase_passes_the_gate_of_its_whole_text(spark):
    """Each phrase alone among sentences without any, and flags; texts that hold nothing have no slots, nor have amounts whose digits are parted."""
    flags = [p + " shall be" for phrases in structure.FLAGS.values() for p in phrases]
    texts = [f"Nothing here. Some {x}. No more." for x in [*SAID, *flags]]
    rows = spark.createDataFrame([*enumerate(texts), (-1, "Nothing here. No more."), (-2, None), (-3, "")], "section_id int, text string")
    assert {r["section_id"] for r in structure.slots(rows).collect()} == {i for i, t in enumerate(texts) if not re.search(r"\d,\d", t)}


def test_entries_find_sections_once(spark):
    """Entries, slots and documents without entries read the sections that were found; no branch finds them again."""
    pages = spark.createDataFrame([("a", 1, "Section 1. Rent\nwithin 30 days"), ("b", 1, "")], "doc string, page int, text string")
    found = packs.entries(pages)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc"]: len(r["slots"]) for r in found.collect()} == {"a": 1, "b": 0}
