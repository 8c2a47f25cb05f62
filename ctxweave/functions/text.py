"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of duplicate detection, of vectors and of pruning.
STOP_VECTOR = (
    "a an the and or but in on at to for of with by is it its are was be has have had do does did will would could should may can "
    "this that these those i you he she we they my your his her our their me him us them what which who whom if not no so as from "
    "about into through also just more very too"
).split()
STOP_DUPLICATE = [*STOP_VECTOR, "than"]
STOP_PRUNE = [
    *STOP_DUPLICATE,
    *(
        "then here there when where how all each every both few some any most other new old been being get got going go come came "
        "make made take took know known think see want give use tell try like well way now even still actually really basically "
        "right sure yes yeah ok okay"
    ).split(),
]

# Phrases that mark a line as filler.
FILLER = [
    "sure, i can help", "great question", "good question", "that's a great question", "absolutely", "of course", "let me help",
    "i'd be happy to", "no problem", "sure thing", "thanks for asking", "thanks for sharing", "thanks for the context", "thank you for",
    "i understand", "i see", "got it", "makes sense", "let me explain", "let me break this down", "here's the thing", "so basically",
    "to be honest", "in my opinion", "as i mentioned", "as you know", "as we discussed",
]

_ALNUM = r"\p{IsAlphabetic}\p{N}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_words(text: str | Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return F.regexp_extract_all(col(text), F.lit(r"(?U)\S+"), F.lit(0))


def words(text: str | Column, keep: str = "", min_bytes: int = 1, stop: list[str] | None = None) -> Column:
    """Lower-case words without the marks at their ends (other than ``keep``), at least ``min_bytes`` long, none of ``stop``.

    One pattern over the whole text finds each run's stretch from its first letter or digit to its last.
    """
    inner = f"[{_ALNUM}{keep}]"
    bare = F.regexp_extract_all(F.lower(col(text)), F.lit(rf"(?U){inner}(?:\S*{inner})?"), F.lit(0))
    if min_bytes <= 1 and not stop:
        return bare
    return F.filter(bare, lambda w: (F.octet_length(w) >= min_bytes) & ~w.isin(stop or []))


def query_words(text: str | Column) -> Column:
    """Words for ranking by a query; repeats count."""
    return words(text, "$")


def duplicate_words(text: str | Column) -> Column:
    """The set of words that duplicate detection compares."""
    return F.array_distinct(words(text, "$", 2, STOP_DUPLICATE))


def vector_words(text: str | Column) -> Column:
    """Words of TF-IDF vectors; repeats count."""
    return words(text, "", 2, STOP_VECTOR)


def prune_words(text: str | Column) -> Column:
    """Words that pruning takes as content; repeats count."""
    return words(text, "", 2, STOP_PRUNE)


def section_words(text: str | Column) -> Column:
    """The set of words by which a section is matched to a query."""
    return F.array_distinct(words(text))


def sentences(text: str | Column) -> Column:
    """Pieces between line ends and '. ', trimmed, of more than 5 bytes."""
    pieces = F.flatten(F.transform(F.split(col(text), "\n"), lambda line: F.split(line, r"\. ")))
    return F.filter(F.transform(pieces, trimmed), lambda s: F.octet_length(s) > 5)


def trimmed(text: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_filler(text: str | Column) -> Column:
    def holds(lower: Column) -> Column:
        out = F.lit(False)
        for phrase in FILLER:
            out = out | F.contains(lower, F.lit(phrase))
        return out

    # the text is bound to a variable, so it is lower-cased once
    return F.transform(F.array(F.lower(col(text))), holds)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float vectors over the shorter one's length, norms over all of each, within [-1, 1]; 0 for a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0).cast("float"))), F.lit(0.0).cast("double"), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(size != 0, size))))


def uuid_shaped(text: str | Column) -> Column:
    return col(text).rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def safe_id(text: str | Column) -> Column:
    """An id for a file name: all but letters, digits, _ and - as _."""
    return F.regexp_replace(col(text), "[^A-Za-z0-9_-]", "_")


def without_ansi(text: str | Column) -> Column:
    return F.regexp_replace(col(text), "\u001b\\[[0-9;]*m", "")


def with_commas(n: str | Column) -> Column:
    return F.format_number(col(n), 0)


def grade(score: str | Column) -> Column:
    """GOOD from 80, NEEDS WORK from 60, else POOR."""
    return F.when(col(score) >= 80, "GOOD").when(col(score) >= 60, "NEEDS WORK").otherwise("POOR")


def cut_bytes(text: str | Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends with a whole character."""
    raw = col(text).cast("binary")
    # a character has up to four bytes, and those after its first are 10xxxxxx
    ends = F.filter(F.sequence(F.lit(most), F.lit(max(0, most - 3)), F.lit(-1)), lambda m: ~F.hex(F.substring(raw, m + 1, 1)).rlike("^[89AB]"))
    return F.when(F.length(raw) <= most, col(text)).otherwise(F.substring(raw, 1, F.get(ends, F.lit(0))).cast("string"))


def without_positions(parts: Column, gone: Column) -> Column:
    """The elements of ``parts`` but those at the positions ``gone``, joined by line ends; in time that grows with both alone."""
    at = F.array_sort(gone)
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("a"), F.concat(at, F.array(F.size(parts))).alias("b"))
    # the array is bound to a variable, so it is made once
    kept = F.transform(F.array(parts), lambda ls: F.flatten(F.transform(bounds, lambda z: F.slice(ls, z["a"] + 2, z["b"] - z["a"] - 1))))
    return F.array_join(F.element_at(kept, 1), "\n")
