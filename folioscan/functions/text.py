"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.config import CASE_FOLDS, FOLD_FROM, FOLD_TO, BlockConfig


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def casefold(c: Column) -> Column:
    """Full case folding: letters that fold to one letter by table, and those that
    fold to several one by one where a text has any."""
    single = {a: b for a, b in CASE_FOLDS.items() if len(b) == 1}
    several = {a: b for a, b in CASE_FOLDS.items() if len(b) > 1}
    low = F.translate(F.lower(c), "".join(single), "".join(single.values()))
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return F.when(low.rlike("[" + "".join(several) + "]"), spelled).otherwise(low)


def normal_block(c: Column) -> Column:
    """White space of one block: none around line ends, single spaces elsewhere."""
    c = F.regexp_replace(F.translate(c, "\r", "\n"), r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n[ \t]+", "\n"), r"[ \t]{2,}", " "))


def normal_text(c: Column) -> Column:
    """Of a whole decoded text: at most one blank line in a row."""
    c = F.regexp_replace(F.translate(c, "\r", "\n"), r"\n{3,}", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def slug(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def is_heading(c: Column, config: BlockConfig = BlockConfig()) -> Column:
    text = strip(c)
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'/-]*"), F.lit(0))
    led = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return (
        F.length(text).between(config.heading_min, config.heading_max)
        & ~text.rlike(r"[.!?;,:]$")
        & F.size(words).between(1, config.heading_words)
        & (led / F.greatest(F.size(words), F.lit(1)) >= config.heading_share)
    )


def block_type(c: Column, config: BlockConfig = BlockConfig()) -> Column:
    text = strip(c)
    return (
        F.when(text == "", "empty")
        .when(text.contains(" | "), "table_row")
        .when(text.rlike(r"^(\d+[.)]|[-*])\s+"), "list_item")
        .when(is_heading(c, config), "heading_candidate")
        .otherwise("paragraph")
    )


def index_terms(c: Column) -> Column:
    """Terms of the index: lower case, marks folded, split at all but letters and digits."""
    folded = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(c: Column) -> Column:
    """Runs of word characters of any script."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def has_phrase(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text between word boundaries; an empty one does not."""
    whole = F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), whole, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return (phrase != "") & F.regexp_like(text, pattern)


def excerpt(c: Column, limit: int = 500) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, limit), r"\s+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))
