"""Text, label and score functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the tokenizer.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "when", "with")


def _empty() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda refers to from outside is else computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(c: Column) -> Column:
    """Lower case; runs of anything but [a-z0-9_-] become one space; trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_\-]+", " "))


def tokenize(c: Column, keep_stopwords: bool = False) -> Column:
    """The runs of [a-z0-9_] of the lower-cased text in order, with repeats; without stop words unless asked for."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return words if keep_stopwords else F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def normalize_label(c: Column) -> Column:
    """normalize_text with underscores for spaces; empty becomes null."""
    return F.nullif(F.replace(normalize_text(c), F.lit(" "), F.lit("_")), F.lit(""))


def labels(c: Column) -> Column:
    """Normalised labels of an array in order; null and empty ones left out; a null array is empty."""
    return F.coalesce(F.array_compact(F.transform(c, normalize_label)), _empty())


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The set of runs of n characters of the normalised text; a shorter text is its own only gram, an empty one has none."""
    def grams(s: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: s.substr(i, F.lit(n)))
        return F.when(F.length(s) == 0, _empty()).otherwise(F.array_distinct(runs))

    return let(normalize_text(c), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held as arrays; 0 if either is empty or null."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))), F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty or null."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))), F.lit(0.0))


def squash(s: Column) -> Column:
    return F.when(s > 0, s / (s + 8.0)).otherwise(0.0)


def normalize_seed(s: Column) -> Column:
    """Seeds below 0 as a clamped cosine, up to 1 as they are, above 1 squashed with constant 12 (so not continuous at 1)."""
    return F.when(s < 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2))).when(s <= 1, s).otherwise(s / (s + 12.0))


def clamp(s: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(s, F.lit(30.0)), F.lit(-30.0))))


def binary_match(a: Column, b: Column) -> Column:
    return F.when((a == b) & (a != ""), 1.0).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def unit_interval(cosine: Column) -> Column:
    return clamp((cosine + 1) / 2)


def relu(s: Column) -> Column:
    return F.greatest(s, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length; the zero vector stays."""
    return let(F.sqrt(dot(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))


def split_grouped(c: Column) -> Column:
    """The parts of a '||'-separated text without empty ones."""
    return F.coalesce(F.filter(F.split(c, r"\|\|"), lambda x: x != ""), _empty())


def issue_reference(c: Column) -> Column:
    """A number for a reference: its trailing digits, else a stable non-negative hash of the trimmed text; null and blank give null."""
    t = F.trim(c)
    digits = F.regexp_extract(t, "([0-9]+)$", 1).try_cast("bigint")
    return F.when(t != "", F.coalesce(digits, F.xxhash64(t).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))))
