"""Quality rules: fixed limits on words and repetition, then divergence from language references.

Everything is DataFrame functions: a document's windows are sorted inside its own row, so there is no shuffle of words.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import WORD, stored

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Frequent words of each language whose shares make the word histogram; all other words are one more bin.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


@dataclass(frozen=True)
class Limits:
    """Limits of the verdict. Divergences are Jensen-Shannon distances (0 to 1, base 2)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Histograms of fewer words say little: such a document is not judged by divergence.
    guard_words: int = 100
    max_class_distance: float = 0.30
    max_word_distance: float = 0.29


def _bits(words: Column) -> Column:
    """Low bits that hold any position in the array."""
    return F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")


def sorted_windows(words: Column) -> Column:
    """All 3-word windows as sorted longs: a hash above, the position in as many low bits as it needs.

    One sort of longs brings equal windows together, each with its place.
    """
    def packed(i: Column) -> Column:
        window = F.xxhash64(*(F.get(words, i + k) for k in range(3)))
        return F.call_function("shiftleft", window, _bits(words)).bitwiseOR(i.cast("long"))

    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), packed))


def equal_neighbours(windows: Column, words: Column) -> Column:
    """Indices of sorted windows that equal the next one. One short test per window; the result is small."""
    bits = _bits(words)
    return F.filter(F.sequence(F.lit(0), F.size(windows) - 2), lambda i: F.call_function(
        "shiftright", F.get(windows, i).bitwiseXOR(F.get(windows, i + 1)), bits) == 0)


def covered_words(windows: Column, alike: Column, words: Column) -> Column:
    """Words inside windows that occur twice or more, each word once: 3 for each place, less where places overlap."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _bits(words)) - 1
    both = F.flatten(F.transform(alike, lambda i: F.array(F.get(windows, i).bitwiseAND(mask), F.get(windows, i + 1).bitwiseAND(mask))))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(F.array_distinct(both)), start, lambda acc, x: F.struct(
        x.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n")))["n"]


def measure(documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms' counts.

    Null text: no words, no lines. Long texts stay whole; a row's arrays are the largest thing in memory.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(WORD))
    frame = documents.select(
        *[F.col(f"`{name}`") for name in keep], F.length(value).alias("__chars"),
        F.array_remove(F.split(value, SPACE_RUN), "").alias("__words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.regexp_replace(value, r"\p{Ll}+", "").alias("__rest"))
    frame = frame.withColumn("__tight", F.regexp_replace("__rest", SPACE_RUN, ""))
    n, words = F.size("__words"), F.col("__words")
    none = F.array().cast("array<int>")
    frame = frame.withColumn("__windows", F.when(n >= 3, sorted_windows(words)).otherwise(F.array().cast("array<long>")))
    frame = frame.withColumn("__alike", F.when(n >= 4, equal_neighbours(F.col("__windows"), words)).otherwise(none))
    listed = sorted({word for words in COMMON_WORDS.values() for word in words})
    longest = max(map(len, listed))
    common = F.filter("__words", lambda word: (F.length(word) <= longest) & F.lower(word).isin(listed))
    frame = frame.withColumn("__common", F.transform(common, F.lower))
    tight = F.col("__tight")
    upper, digit = F.regexp_count(tight, F.lit(r"\p{Lu}")), F.regexp_count(tight, F.lit(r"\p{Nd}"))
    symbol = F.regexp_count(tight, F.lit(r"[#*$%&|<>]"))
    space = F.length("__rest") - F.length(tight)
    lower = F.col("__chars") - F.length("__rest")
    counted = F.array(lower, upper, digit, space, symbol, F.length(tight) - upper - digit - symbol).cast("array<long>")
    tally = F.array(*(F.size("__common") - F.size(F.array_remove("__common", word)) for word in listed))
    return frame.select(
        *[F.col(f"`{name}`") for name in keep], n.cast("long").alias("n_words"),
        (F.col("__chars") - space).cast("long").alias("word_chars"), symbol.cast("long").alias("n_symbols"),
        "n_dup_lines", F.when(F.size("__alike") > 0, covered_words(F.col("__windows"), F.col("__alike"), words)).otherwise(0)
        .cast("long").alias("n_repeat_words"),
        counted.alias("class_counts"), tally.cast("array<long>").alias("word_counts"))


def _entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def distance(counts: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a reference distribution; 0 for an empty histogram."""
    known = F.array(*map(F.lit, map(float, reference)))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    shares = F.transform(counts, lambda x: x / total)
    middle = F.zip_with(shares, known, lambda p, q: (p + q) / 2)
    divergence = _entropy(middle) - (_entropy(shares) + _entropy(known)) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def word_histogram(frame_words: Column, language: str, n_words: Column) -> Column:
    """Counts of the language's common words and of all others, from the counts of all listed words."""
    listed = sorted({word for words in COMMON_WORDS.values() for word in words})
    mine = [F.get(frame_words, F.lit(listed.index(word))) for word in COMMON_WORDS[language]]
    return F.concat(F.array(*mine), F.array(n_words - sum(mine[1:], mine[0])))


def references(measured: DataFrame, limits: Limits) -> dict[str, tuple[list[float], list[float]]]:
    """Class and word shares of each listed language over all its documents that pass the base rules and the guard.

    A sum per language, combined before the shuffle; the languages are a parameter, so the driver gets a few rows.
    """
    fit = measured.where(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed(limits) & (F.col("n_words") >= limits.guard_words))
    listed = len({word for words in COMMON_WORDS.values() for word in words})
    sums = [F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(listed)]
    names = sorted({word for words in COMMON_WORDS.values() for word in words})
    out = {}
    for row in fit.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect():
        classes = [row[f"c{i}"] for i in range(len(CLASSES))]
        words = [row[f"w{names.index(word)}"] for word in COMMON_WORDS[row["lang"]]]
        words.append(row["n"] - sum(words))
        out[row["lang"]] = [x / sum(classes) for x in classes], [x / row["n"] for x in words]
    return dict(sorted(out.items()))


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def quality_verdicts(documents: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang",
                     keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Base counts, base_failed, divergences and kept of every document.

    A document is dropped if it fails the base rules, or if it has ``guard_words`` words and is further than the
    limits from every language's reference, by character classes or by common words: its own label is not trusted,
    so an unknown, null or wrong language costs nothing. References come from all documents with a listed language;
    without any (an empty table, other languages), only the base rules count.

    Counts are stored once in the shared folder (about 300 bytes a document), so texts are read once. Null text: no
    words, base_failed. Repeated rows and ties are judged alike. Other columns are ignored.
    """
    names = [name for name in keep if name != "lang"]
    source = documents.select(*[F.col(f"`{name}`") for name in names], F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = stored(measure(source, "text", [*names, "lang"]))
    known = references(measured, limits)
    classes = [distance(F.col("class_counts"), c) for c, _ in known.values()]
    words = [distance(word_histogram(F.col("word_counts"), name, F.col("n_words")), w) for name, (_, w) in known.items()]
    least = lambda parts: F.least(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(0.0)
    judged = measured.withColumn("base_failed", base_failed(limits)).withColumn("class_distance", least(classes)).withColumn(
        "word_distance", least(words))
    far = (F.col("n_words") >= limits.guard_words) & (
        (F.col("class_distance") > limits.max_class_distance) | (F.col("word_distance") > limits.max_word_distance))
    return judged.select(*[F.col(f"`{name}`") for name in names], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
                         F.round("class_distance", 6).alias("class_distance"),
                         F.round("word_distance", 6).alias("word_distance"))
