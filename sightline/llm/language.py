"""Language identification with interpolated Kneser-Ney character models.

Each language has one model: for every order the hashes of its n-grams, sorted, with their probability terms. A text
gets the language with the lowest cross-entropy per character; a text that no model explains is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import claim

#: Longest n-gram.
ORDER = 4
#: A language is learned from about so many documents (whole texts, drawn by a hash): the bound of the sample.
SAMPLE_DOCUMENTS = 600
#: Of the sampled documents, one in so many calibrates and is not counted.
CALIBRATION_PART = 5
#: A text is rejected if its cross-entropy is above its language's limit: this quantile of the calibration documents
#: times the slack. Short texts full of numbers and keys reach 4.7 bits where prose has 2.2; other scripts have 10 and more.
REJECT_QUANTILE, REJECT_SLACK = 0.995, 1.9
#: Characters that are scored at a time.
WINDOW = 1 << 18
#: The text is framed by this character, so its first letters have a context.
EDGE = 0x20
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with white space folded, between two spaces."""
    folded = " ".join(text.lower().split())
    return np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams that end at each position from ``order - 1``."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide = codes.astype(np.uint64)
    out = np.full(n, order, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            out = (out ^ wide[k: k + n]) * MIX
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


@dataclass
class Model:
    """Sorted n-gram hashes per order, log probabilities of the seen n-grams and back-off terms of their contexts."""

    gram: list[np.ndarray]
    probability: list[np.ndarray]
    context: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    @classmethod
    def train(cls, counts: Sequence[pd.DataFrame]) -> Model:
        """From tables (gram, context, suffix, n) of each order, the first of order 1.

        The longest order uses counts; shorter ones the number of distinct characters in front (continuation counts).
        Absolute discounts are estimated from the counts of counts: d = n1 / (n1 + 2 n2).
        """
        gram, probability, context, backoff = [], [], [], []
        lower: tuple[np.ndarray, np.ndarray] | None = None
        floor = 0.0
        for order, table in enumerate(counts, 1):
            keys, prefix, suffix, n = (table[c].to_numpy() for c in ("gram", "context", "suffix", "n"))
            if order < len(counts):
                above = counts[order]["suffix"].to_numpy()
                found, fronts = np.unique(above, return_counts=True)
                at = np.searchsorted(found, keys)
                at[at == len(found)] = 0
                hit = found[at] == keys if len(found) else np.zeros(len(keys), bool)
                n = np.where(hit, fronts[at] if len(found) else 0, 0) + (0 if order > 1 else 0)
                n = np.maximum(n, 1)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, inverse = np.unique(prefix, return_inverse=True)
            total = np.bincount(inverse, n, len(contexts))
            kinds = np.bincount(inverse, minlength=len(contexts))
            share = discount * kinds / total
            if lower is None:
                floor = float(share[0]) / 65536 if len(share) else 1.0
                below = np.full(len(keys), 1 / 65536)
            else:
                below = lower[1][np.searchsorted(lower[0], suffix)]
            values = (n - discount) / total[inverse] + share[inverse] * below
            rank = np.argsort(keys)
            gram.append(keys[rank])
            probability.append(np.log2(values[rank]))
            context.append(contexts)
            backoff.append(np.log2(share))
            lower = keys[rank], values[rank]
        return cls(gram, probability, context, backoff, float(np.log2(floor)))

    def score(self, keys: Sequence[np.ndarray], prefixes: Sequence[np.ndarray]) -> np.ndarray:
        """log2 probability of the last character of each n-gram: keys[o] are the grams of order o + 1 that end there,
        prefixes[o] their contexts. The longest seen gram counts; each longer seen context adds its back-off."""
        out = np.full(len(keys[0]), self.floor)
        for order, (gram, probability) in enumerate(zip(self.gram, self.probability)):
            if not len(gram):
                continue
            at = np.minimum(np.searchsorted(gram, keys[order]), len(gram) - 1)
            hit = gram[at] == keys[order]
            if order:
                where = np.minimum(np.searchsorted(self.context[order], prefixes[order]), len(self.context[order]) - 1)
                known = self.context[order][where] == prefixes[order]
                out = np.where(known, out + self.backoff[order][where], out)
            out = np.where(hit, probability[at], out)
        return out


@dataclass
class Identifier:
    """Models of all languages with the temperature of the score and each language's limit."""

    languages: list[str]
    models: list[Model]
    limits: np.ndarray
    temperature: float = 1.0

    def entropies(self, texts: Sequence[str]) -> np.ndarray:
        """Bits per character of each text (rows) under each language, 0 for an empty text.

        Equal n-grams of a window are scored once. Windows cut long texts with the context they need.
        """
        total = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            codes = characters(text)
            for begin in range(1, len(codes), WINDOW):
                part = codes[max(0, begin - ORDER + 1): begin + WINDOW]
                fresh = len(codes[begin: begin + WINDOW])
                pad = np.full(max(0, ORDER - 1 - (len(part) - fresh)), EDGE, np.uint32)
                held.append(np.concatenate([pad, part]))
                owners.append(i)
                size += len(part)
                if size >= WINDOW:
                    self._add(total, held, owners)
                    held, owners, size = [], [], 0
        if held:
            self._add(total, held, owners)
        return total / np.maximum([len(characters(text)) - 1 for text in texts], 1)[:, None]

    def _add(self, total: np.ndarray, held: list[np.ndarray], owners: list[int]) -> None:
        codes = np.concatenate(held)
        sizes = np.array([len(part) for part in held])
        ends = np.cumsum(sizes)
        own = np.repeat(np.arange(len(held)), sizes)
        first = np.repeat(ends - sizes, sizes) + ORDER - 1
        valid = np.flatnonzero(np.arange(len(codes)) >= first)
        longest = grams(codes, ORDER)[valid - ORDER + 1]
        label, unique = pd.factorize(longest)
        where = np.zeros(len(unique), np.int64)
        where[label] = valid  # any position of each n-gram
        keys, prefixes = [], []
        for order in range(1, ORDER + 1):
            hashed = grams(codes, order)
            keys.append(hashed[where - order + 1])
            prefixes.append(grams(codes, order - 1)[where - order + 1] if order > 1 else np.zeros(len(where), np.int64))
        rows = np.array(owners)[own[valid]]
        for k, model in enumerate(self.models):
            bits = -model.score(keys, prefixes)
            total[:, k] += np.bincount(rows, bits[label], len(total))

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, bits per character) of each text."""
        usable = [i for i, text in enumerate(texts) if text and any(map(str.isalpha, text))]
        out = [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        if not usable or not self.models:
            return out
        bits = self.entropies([texts[i] for i in usable])
        best = bits.argmin(1)
        for i, row, k in zip(usable, bits, best):
            weights = np.exp2(-(row - row[k]) * self.temperature)
            out[i] = (self.languages[k], float(1 / weights.sum()), bool(row[k] > self.limits[k]), float(row[k]))
        return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-grams of all orders of each language in a batch."""
    claim("language")
    for batch in batches:
        for language, texts in batch.groupby("lang")["text"]:
            pad = np.full(ORDER - 1, EDGE, np.uint32)
            for order in range(1, ORDER + 1):
                parts = [np.concatenate([pad, characters(text)]) for text in texts]
                whole = np.concatenate([grams(p[ORDER - order:], order) for p in parts])
                front = [p[ORDER - order:] for p in parts]
                prefix = np.concatenate([grams(p, order - 1)[: max(0, len(p) - order + 1)] if order > 1
                                         else np.zeros(len(p), np.int64) for p in front])
                suffix = np.concatenate([grams(p[1:], order - 1) if order > 1
                                         else np.zeros(len(p), np.int64) for p in front])
                table = pd.DataFrame({"gram": whole, "context": prefix, "suffix": suffix})
                found = table.groupby(["gram", "context", "suffix"], sort=False).size().rename("n").reset_index()
                found.insert(0, "gram_order", order)
                found.insert(0, "lang", language)
                yield found


def train(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Identifier:
    """Fit an identifier on labelled documents.

    Each language counts about ``SAMPLE_DOCUMENTS`` whole texts, drawn by a hash of the key with a rate that follows
    from the language's number of documents; that bounds the models, however large the input is. Spark counts n-grams
    per task and sums them; the driver gets the sums, never texts of the counted part, and the cross-entropies of the
    calibration part. Documents with a null text or language are ignored. Without any, no language is learned.
    """
    spark = documents.sparkSession
    labelled = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {row["lang"]: row["count"] for row in labelled.select("lang").groupBy("lang").count().collect()}
    if not sizes:
        return Identifier([], [], np.zeros(0))
    rate = F.create_map(*[x for name, n in sizes.items()
                          for x in (F.lit(name), F.lit(min(1.0, SAMPLE_DOCUMENTS / n)))])
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "id"), 11)
    drawn = labelled.where(hashed.cast("double") * F.lit(2.0 ** -53) < F.element_at(rate, F.col("lang")))
    drawn = drawn.withColumn("part", F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION_PART)))
    schema = "lang string, gram_order int, gram long, context long, suffix long, n long"
    found = (drawn.where("part > 0").select("lang", "text").mapInPandas(_count, schema)
             .groupBy("lang", "gram_order", "gram", "context", "suffix").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(found["lang"].unique())
    models = []
    for language in languages:
        mine = found[found["lang"] == language]
        models.append(Model.train([mine[mine["gram_order"] == order] for order in range(1, ORDER + 1)]))
    identifier = Identifier(languages, models, np.full(len(languages), np.inf))
    shared = spark.sparkContext.broadcast(identifier)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch[[any(map(str.isalpha, value)) for value in batch["text"]]]
            if len(kept):
                yield pd.DataFrame({"lang": kept["lang"].to_numpy(), "bits": list(shared.value.entropies(list(kept["text"])))})

    held = drawn.where("part = 0").select("lang", "text").mapInPandas(measure, "lang string, bits array<double>").toPandas()
    return calibrate(identifier, list(held["lang"]), np.array([list(row) for row in held["bits"]]))


def calibrate(identifier: Identifier, labels: list[str], bits: np.ndarray) -> Identifier:
    """Set the score's temperature (best log score on a grid) and the limits from documents that were not counted."""
    at = {name: k for k, name in enumerate(identifier.languages)}
    known = [i for i, name in enumerate(labels) if name in at]
    if not known:
        return identifier
    bits, truth = bits[known], np.array([at[labels[i]] for i in known])
    gap = bits - bits.min(1, keepdims=True)
    grid = 2.0 ** np.arange(0, 8, 0.5)
    worth = []
    for t in grid:
        p = np.exp2(-gap * t)
        worth.append(np.log(np.clip(p[np.arange(len(p)), truth] / p.sum(1), 1e-6, 1)).sum())
    identifier.temperature = float(grid[int(np.argmax(worth))])
    best = bits.min(1)
    pooled = np.quantile(best, REJECT_QUANTILE)
    identifier.limits = np.array([max(pooled, np.quantile(best[truth == k], REJECT_QUANTILE)) if (truth == k).any()
                                  else pooled for k in range(len(at))]) * REJECT_SLACK
    return identifier


RESULT = "lang_pred string, score double, rejected boolean, bits double"


def identify(documents: DataFrame, identifier: Identifier, text: str = "text", out: str = "language") -> DataFrame:
    """Add the struct ``out``: lang_pred, score (0 to 1), rejected, bits (cross-entropy per character).

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is every text if no language was
    learned. Texts that are worse than their language's limit are named but rejected. Ties go to the first language by
    name. Rows are independent: no shuffle; the models (a few MB, bounded by the sample) are broadcast; whole texts are
    scored in windows. Only the text is read. A column named like ``out`` is replaced; others stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(identifier)
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language")
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(list(texts)), columns=names)

    return documents.withColumn(out, F.pandas_udf(run, RESULT)(F.col(text)))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of a key as text, modulo a divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor
