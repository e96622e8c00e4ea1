"""Mixing sources to target weights: raking of token mass to marginals, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import WORD

#: Class of all values that a marginal doesn't name, nulls included.
REST = "*"
#: The cells of the marginals' cross product are held by the driver; a larger product is refused.
MAX_CELLS = 1_000_000


def class_of(column: Column, marginal: Mapping[str, float]) -> Column:
    """The value if the marginal names it, else the class ``*``."""
    return F.when(column.isin([key for key in marginal if key != REST]), column).otherwise(F.lit(REST))


def rake(mass: np.ndarray, targets: Sequence[np.ndarray], rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Iterative proportional fitting: scale ``mass`` (one axis per marginal) until its marginals are the targets.

    Targets of classes without mass are shared out among the others of their marginal. Where zero cells make the
    marginals contradict one another, the fit after ``rounds`` is returned. The last marginal is met exactly.
    """
    fitted = mass / mass.sum() if mass.sum() > 0 else mass.astype(float)
    axes = range(mass.ndim)
    wanted = []
    for axis, target in zip(axes, targets):
        present = mass.sum(tuple(a for a in axes if a != axis)) > 0
        target = np.where(present, target, 0.0)
        if target.sum() <= 0:
            target = present.astype(float)
        wanted.append(target / target.sum() if target.sum() > 0 else target)
    for _ in range(rounds):
        worst = 0.0
        for axis, target in zip(axes, wanted):
            now = fitted.sum(tuple(a for a in axes if a != axis))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max(initial=0.0)))
            fitted = fitted * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst <= tolerance:
            break
    return fitted


def probabilities(mass: np.ndarray, fitted: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each cell (fitted share over its share) and sampling probability of its documents.

    Probabilities are proportional to the weights, capped at 1, and scaled so that the expected tokens are
    ``fraction`` of all: cells that reach 1 are set aside and the rest is scaled again until none is added. Where
    cells with a positive weight hold less than that, they are kept whole.
    """
    share = mass / mass.sum() if mass.sum() > 0 else mass.astype(float)
    weight = np.divide(fitted, share, out=np.zeros_like(share), where=share > 0)
    full = np.zeros(mass.shape, bool)
    while True:
        free = (weight > 0) & ~full
        need = fraction - share[full].sum()
        base = (weight * share)[free].sum()
        scale = max(need, 0.0) / base if base > 0 else 0.0
        more = free & (weight * scale >= 1.0)
        if not more.any():
            return weight, np.where(full, 1.0, np.where(free, weight * scale, 0.0))
        full |= more


def mix(documents: DataFrame, marginals: Mapping[str, Mapping[str, float]], fraction: float, seed: int = 7,
        tokens: Column | None = None, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add mix_tokens, mix_weight, mix_probability and mix_kept (is the document drawn) to every document.

    ``marginals`` names a target share for values of each column; ``*`` stands for all other values and for null
    (share 0 if it is not given: then no such document is drawn). ``tokens`` is a document's size, by default its
    words; null texts have none. ``fraction`` of all tokens is drawn in expectation.

    One aggregation sums the tokens per cell. A value outside the marginals falls into ``*`` before it, so the number
    of cells is bounded by the parameters, at any input size; partial sums are combined before the shuffle, so a source
    with a third of all rows is no hot key. The cells are fitted on the driver and come back as expressions of the
    document's classes: no join, no shuffle of documents. The draw compares a hash of the key columns and the seed
    with the probability, so it is the same in every run; repeated rows with one key are drawn together. Documents
    without tokens share their cell's probability. An empty table stays empty. The four columns are replaced if present.
    """
    names = list(marginals)
    classes = [sorted({*marginals[name], REST}) for name in names]
    if np.prod([len(part) for part in classes]) > MAX_CELLS:
        raise ValueError("too many cells")
    size = tokens if tokens is not None else F.regexp_count(F.col("text"), F.lit(WORD))
    counted = documents.withColumn("mix_tokens", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    keys = [class_of(F.col(name), marginals[name]) for name in names]
    sums = counted.groupBy(*[part.alias(f"c{i}") for i, part in enumerate(keys)]).agg(F.sum("mix_tokens").alias("n"))
    mass = np.zeros([len(part) for part in classes])
    for row in sums.collect():
        mass[tuple(classes[i].index(row[i]) for i in range(len(names)))] = row["n"]
    fitted = rake(mass, [np.array([marginals[name].get(value, 0.0) for value in part], float)
                         for name, part in zip(names, classes)])
    weight, probability = probabilities(mass, fitted, fraction)
    cell = reduce(lambda at, i: at * len(classes[i]) + F.array_position(F.array(*map(F.lit, classes[i])), keys[i]) - 1,
                  range(len(names)), F.lit(0))
    shown = [F.element_at(F.array(*(F.lit(float(x)) for x in values.ravel())), (cell + 1).cast("int"))
             for values in (weight, probability)]
    drawn = F.xxhash64(F.lit(seed), *[F.col(name) for name in key])
    unit = F.shiftrightunsigned(drawn, 11).cast("double") * F.lit(2.0 ** -53)
    return (counted.withColumn("mix_weight", shown[0]).withColumn("mix_probability", shown[1])
            .withColumn("mix_kept", unit < F.col("mix_probability")))


def topic(text: Column) -> Column:
    """A document's topic by form, for tables without a topic column: numeric, shouted, list or prose.

    Null and empty texts are prose.
    """
    size = F.greatest(F.length(text), F.lit(1))
    return (F.when(F.regexp_count(text, F.lit("[0-9]")) * 20 > size, F.lit("numeric"))
            .when(F.regexp_count(text, F.lit("[A-Z]")) * 2 > size, F.lit("shouted"))
            .when(F.regexp_count(text, F.lit("[|#*<>]")) * 50 > size, F.lit("list"))
            .otherwise(F.lit("prose")))
