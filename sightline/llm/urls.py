"""URL filters: a sort-merge range join of page keys with nested host rules."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule list is a parameter that every task holds; a longer list is refused.
MAX_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def label(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        """Reversed labels with a closing dot: the interval of all keys that start with it is the host's subtree."""
        return ".".join(reversed(self.host.split("."))) + "."


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """The active rules while keys rise. Rules are intervals [key, key + everything); they nest or are disjoint."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda rule: (rule.key.encode(), rule.path.encode()))
        self.keys = [rule.key.encode() for rule in self.rules]
        self.next, self.stack = None, []

    def enter(self, key: bytes) -> None:
        """Start at ``key``: the open rules are those whose key is one of its label prefixes."""
        self.stack, at = [], 0
        while (at := key.find(b".", at) + 1) > 0:
            prefix = key[:at]
            found = bisect_left(self.keys, prefix)
            while found < len(self.keys) and self.keys[found] == prefix:
                self.stack.append(self.rules[found])
                found += 1
        self.next = bisect_left(self.keys, key + b"\x00")

    def match(self, key: bytes, path: str) -> Rule | None:
        if self.next is None:
            self.enter(key)
        while self.stack and not key.startswith(self.stack[-1].key.encode()):
            self.stack.pop()
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            rule = self.rules[self.next]
            self.next += 1
            while self.stack and not rule.key.startswith(self.stack[-1].key):
                self.stack.pop()
            if key.startswith(rule.key.encode()):
                self.stack.append(rule)
        fit = [rule for rule in self.stack if path.startswith(rule.path)]
        return max(fit, key=lambda rule: (len(rule.label), len(rule.host))) if fit else None


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url",
                 keep: Sequence[str] = ("page_id",), partitions: int | None = None) -> DataFrame:
    """Verdict of the longest fitting rule for every row; columns ``keep``, host, path, rule, verdict.

    Rows are ranged by (reversed host, path, kept columns) and sorted, so a host or even one url with a third of the
    rows is spread over several partitions. Each partition sweeps its keys and the sorted rules side by side with a
    stack of the rules that are open; it may start anywhere, because the rules open there are found by bisection.
    Memory is one Arrow batch plus the stack.

    Null urls and urls without ``://`` have an empty host and path and get ``default`` with a null rule. Repeated rows
    each get a row. No rules, or an empty table, give the same columns. Of rules with equally long labels the one
    with the longer host wins. Other columns of the input are ignored; names that clash with the result are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held by each task")
    spark = pages.sparkSession
    names = [name for name in keep if name not in ("host", "path", "rule", "verdict")]
    kept = [F.col(f"`{name}`") for name in names]
    keyed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = keyed.withColumn("__key", reversed_host(F.col("host")))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__key", "path", *(f"`{name}`" for name in names)]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    listed = tuple(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep(listed)
        for batch in batches:
            hits = [sweep.match(key.encode(), path) for key, path in zip(batch["__key"], batch["path"])]
            batch["rule"] = pd.Series([hit.label if hit else None for hit in hits], dtype=object, index=batch.index)
            batch["verdict"] = pd.Series([hit.verdict if hit else default for hit in hits], dtype=object,
                                         index=batch.index)
            yield batch.drop(columns="__key")

    schema = keyed.drop("__key").schema.add("rule", "string").add("verdict", "string")
    return ranged.mapInPandas(judge, schema)
