"""Spelling variants by reduced-alphabet generation.

Every letter is hashed to one of ``SYMBOLS`` symbols. If two words differ by one inserted, deleted or replaced code point,
their reduced forms are equal or differ by one edit as well. So each word generates the full one-edit neighbourhood of its
reduced form, which is small because the alphabet is, joins it with the reduced vocabulary, and the pairs that meet are
verified on the original strings. No pair is missed and none is met twice.

A stored vocabulary is small in bytes and large in memory, so its joins are sort merges: none goes through the driver.

All steps are DataFrame functions. Words are counted before the shuffle, so a word that holds a third of all tokens is one
row a task. The vocabulary is joined by reduced form; a form that many words share is split by AQE like any other join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import stored

#: Symbols of the reduced alphabet. A word of n code points generates about 2 * SYMBOLS * n keys; more symbols make the
#: reduced forms of short words rarer. Results do not depend on it.
SYMBOLS = 6
#: Letters of the default alphabet; all other code points fold to the last symbol.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))


def reduced(word: Column, letters: str = LETTERS, symbols: int = SYMBOLS) -> Column:
    """The word with every letter replaced by a symbol A, B, ...: the hash of its code point."""
    hashed = "".join(chr(65 + (ord(letter) * 0x9E3779B1 % 2**32 >> 16) % symbols) for letter in letters)
    folded = F.translate(word, letters, hashed)
    return F.regexp_replace(folded, f"[^A-{chr(64 + symbols)}]", chr(64 + symbols))


def neighbourhood(form: Column, symbols: int = SYMBOLS) -> Column:
    """The reduced form and all strings over the symbols that are one insertion, deletion or replacement away, each once."""
    alphabet = F.array(*[F.lit(chr(65 + i)) for i in range(symbols)])
    places = F.sequence(F.lit(1), F.length(form))
    head = lambda i: F.substring(form, F.lit(1), i - 1)
    after = lambda i: F.substring(form, i + 1, F.length(form))
    deleted = F.transform(places, lambda i: F.concat(head(i), after(i)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(alphabet, lambda s: F.concat(head(i), s, after(i)))))
    gaps = F.sequence(F.lit(1), F.length(form) + 1)
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(
        alphabet, lambda s: F.concat(head(i), s, F.substring(form, i, F.length(form))))))
    return F.array_distinct(F.concat(F.array(form), deleted, replaced, inserted))


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, other, other_n for all ordered pairs of words that differ by exactly one code point edit."""
    held = words.select("word", "n", reduced(F.col("word"), symbols=symbols).alias("form"))
    asked = held.select("word", "n", F.explode(neighbourhood(F.col("form"), symbols)).alias("form"))
    other = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "form")
    near = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.call_function("levenshtein", F.col("word"), F.col("other"), F.lit(1)) == 1)
    return asked.hint("merge").join(other.hint("merge"), "form").where(near).select("word", "n", "other", "other_n")


def variant_groups(words: DataFrame, ratio: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """The preferred form of every word of words(word string, n long), one row per word.

    Adds n_near (words that are one edit away), form (the near word of largest n, ties: the smallest in code-point order,
    if its n is at least ``ratio`` times the word's own; else null), form_n, and root (the end of the chain of forms; the
    word itself without a form). Null words are no words and go; a word that occurs in several rows has the sum of their
    n, where a null n counts nothing. An empty table gives an empty table. Only the columns word and n are read, so others
    cannot clash. Counts grow by ``ratio`` along a chain, so chains have no loops and end after log(n) steps.
    """
    if ratio < 2:
        raise ValueError("A form must be more frequent than its variants: ratio is at least 2.")
    merged = words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    vocabulary = stored(merged)
    # UTF-8 bytes sort like code points, so the smallest of equal counts is the minimum of a plain struct.
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("word")))
    found = near_pairs(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.hint("merge").join(found.hint("merge"), "word", "left")
    fits = (-F.col("best.rank") >= ratio * F.col("n")) & (F.col("n") > 0)
    ranked = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"),
        F.when(fits, -F.col("best.rank")).alias("form_n")))

    links = ranked.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # pointer doubling: each round doubles the steps taken
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(links.hint("merge").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        links = moved.select("word", "root")
        if moved.where("further is not null").isEmpty():
            break
    return ranked.hint("merge").join(links.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def count_words(tokens: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """word, n of the words in tokens(word) with at least ``min_length`` code points and ``min_count`` occurrences."""
    counted = tokens.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def letter_runs(text: Column, pattern: str = r"[A-Za-zÀ-ÿ]+") -> Column:
    """The maximal runs of letters of a text, A-Z in lower case; none of a null text."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.isNotNull(), F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0)))


def with_slips(runs: DataFrame, key: str, run: str = "run", every: int = 199) -> DataFrame:
    """word: the run, or the run without one code point where ``every`` divides the checksum of ``<key>:<run>``.

    This plants the slips of the pen that the groups are measured on; a null key is written as nothing.
    """
    h = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col(run)).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(F.col(run), F.lit(1), at), F.substring(F.col(run), at + 2, F.length(run)))
    return runs.select(F.when(F.pmod(h, F.lit(every).cast("long")) == 0, cut).otherwise(F.col(run)).alias("word"))
