"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard similarity.

A document's sketch is the K smallest values of one hash function over its word shingles. Two documents with Jaccard
similarity J share each of the K smallest values of their union with probability J, so linked documents (J >= 0.75)
share at least ``SHARED`` of 32 but for a chance of about 1e-8 (exactly, for sets of up to K shingles). Each sketch
keeps its rarest values only, so many that two sketches with that overlap must meet in the inverted list of one of
them (a prefix filter): shared passages fill the frequent part of a sketch and make no candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import claim, connected_components, stored

SIZE = 5  # words of a shingle
PERCENT = 75  # least similarity
K = 32  # sketch values
SHARED = 9  # least overlap of two full sketches of linked documents
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 1024, 1 << 20  # a task compares at most two blocks of a group
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; emptied when full, so it does not grow with the data."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


WORDS = _Words()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text: A-Z lower-cased, words split at ASCII white space.

    Fewer than ``SIZE`` words make one shingle; none make an empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    width = min(SIZE, len(values))
    n = len(values) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ values[k: k + n]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(shingle_set: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("near", WORDS)
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingles(text)
            rows.append((len(found), node_of(found), found[:K].view(np.int64)) if len(found) else (0, None, found.view(np.int64)))
        size, node, sketch = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"], "n": size, "node": pd.array(node, "Int64"),
                            "sketch": pd.Series(sketch, dtype=object, index=batch.index)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("near", WORDS)
    for batch in batches:
        found = [shingles(text) for text in batch["text"]]
        out = pd.DataFrame({"node": [node_of(part) for part in found], "members": [part.tobytes() for part in found]})
        yield out[out["node"].to_numpy() == batch["node"].to_numpy()]  # another document may bear the same id


def need(size: int) -> int:
    """Least overlap of a sketch of ``size`` values with that of any linked document; see the module's text."""
    if size >= K:
        return SHARED
    return max(1, -(-PERCENT * size // 100) - max(0, 100 * size // PERCENT - K))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of two sorted sets, after an estimate from the sketch of their union where both are larger."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > 4 * K and len(b) > 4 * K:
        union = np.union1d(a[:K], b[:K])[:K]
        both = np.isin(union, a[:K], assume_unique=True) & np.isin(union, b[:K], assume_unique=True)
        if both.sum() < SHARED:
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of all values that occur in two sets or more."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(part) for part in sets])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    return rows[keep], place[column[keep]], int(often.sum())


def _overlaps(sets: list[np.ndarray], left: slice) -> np.ndarray:
    """Intersection sizes of the sets in ``left`` with all sets, by products of 0/1 matrices over column ranges."""
    rows, columns, width = _incidence(sets)
    total = np.zeros((left.stop - left.start, len(sets)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    step = max(64, (1 << 22) // max(1, len(sets)))
    for begin in range(0, width, step):
        a, b = np.searchsorted(columns, (begin, begin + step))
        part = np.zeros((len(sets), step), np.float32)
        part[rows[a:b], columns[a:b] - begin] = 1
        total += part[left] @ part.T
    return total


def links_of(sets: list[np.ndarray], cross: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with ``cross``, of the links between the first ``cross`` and the rest.

    Sketch overlaps rule out most pairs. What is left is verified exactly, pair by pair or by one matrix product,
    whichever is less work; pairs that are connected already are not verified.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))

    if len(sets) == 2:
        return [(0, 1)] if linked(*sets) else []
    sizes = np.array([len(part) for part in sets])
    least = np.array([need(min(size, K)) for size in sizes])
    stop = cross if cross is not None else len(sets)
    for begin in range(0, stop, 256):
        rows = slice(begin, min(begin + 256, stop))
        shared = _overlaps([part[:K] for part in sets], rows)
        maybe = shared >= np.maximum(least[rows, None], least[None, :])
        maybe &= 100 * np.minimum(sizes[rows, None], sizes) >= PERCENT * np.maximum(sizes[rows, None], sizes)
        if cross is not None:
            maybe[:, :cross] = False
        else:
            maybe &= np.arange(len(sets)) > np.arange(rows.start, rows.stop)[:, None]
        a, b = np.nonzero(maybe)
        if len(a) * 4e-5 < maybe.size * sizes.mean() * 5e-11 + 1e-7 * sizes.sum() or len(a) < 64:
            for x, y in zip((a + begin).tolist(), b.tolist()):
                if find(x) != find(y) and linked(sets[x], sets[y]):
                    join(x, y)
        else:
            common = _overlaps(sets, rows)[a, b]
            sure = 100 * common >= PERCENT * (sizes[a + begin] + sizes[b] - common)
            for x, y in zip((a[sure] + begin).tolist(), b[sure].tolist()):
                join(x, y)
    return out


def _verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks of a group."""
    _, i, j = key
    group = group.sort_values(["block", "node"])
    sets = [np.frombuffer(value, np.uint64) for value in group["members"]]
    nodes = group["node"].to_numpy()
    found = links_of(sets, None if i == j else int((group["block"] == i).sum()))
    return pd.DataFrame({"a": nodes[[x for x, _ in found]] if found else np.zeros(0, np.int64),
                         "b": nodes[[y for _, y in found]] if found else np.zeros(0, np.int64)})


def sketches(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, mark (a hash of the text), n (set size), node (the set's hash, null if empty) and sketch of every document."""
    source = documents.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("binary").alias("text"))
    return source.mapInPandas(_sketch, f"id {source.schema['id'].dataType.simpleString()}, mark long, n long, node long, sketch array<long>")


def groups_of(classes: DataFrame) -> DataFrame:
    """hub, node: candidates. Every two nodes that share a list are in the group of its hub.

    The hub of a list is its node with the most widely shared sketch, as the original of a group of copies has. One hub
    serves nearly all lists of such a group, so its members come together once and not once per list.
    """
    postings = classes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    required = F.when(F.col("s") >= K, F.lit(SHARED)).otherwise(F.greatest(
        F.lit(1), F.ceil(F.col("s") * PERCENT / 100.0) - F.greatest(F.lit(0), F.floor(F.col("s") * 100.0 / PERCENT) - K)))
    per_node = postings.join(often, "v").groupBy("node").agg(
        F.first("s").alias("s"), F.sum("df").alias("score"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    # Values of one list only come first in the order, but lead nowhere.
    left = (F.col("s") - required + 1 - (F.col("s") - F.size("values"))).cast("int")
    prefix = per_node.where(left > 0).select("node", "score", F.explode(F.slice("values", F.lit(1), left)).alias("x"))
    lists = stored(prefix.select("node", "score", F.col("x.v").alias("v")))
    hubs = lists.groupBy("v").agg(F.max(F.struct("score", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = lists.select("v", "node").join(hubs.select("v", F.col("hub.node").alias("hub")), "v")
    return pairs.select("hub", "node").distinct()


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Component of every document under links of shingle sets with at least 75 % Jaccard similarity.

    Columns: the key, mark (xxhash64 of the text), n_shingles, node (hash of the set; null if empty), component_id (the
    smallest key reachable, itself included) and kept (key = component_id).

    1. Each task sketches its texts. Equal sets form one class (combined before the shuffle), so copies of any number are
       one node from here on. 2. Inverted lists of the classes' sketches give groups of candidates around hubs. 3. The
    full sets of group members are made again from their texts and compared in blocks of bounded size; a task returns a
    spanning forest, never all pairs. 4. Components of the forests.

    Null and empty texts, and texts of white space, have an empty set and stand alone. A null key is carried along and
    never is the smallest unless all are null. Rows that repeat a key are separate rows. Other columns are ignored.
    """
    nodes = stored(sketches(documents, text, key))
    classes = stored(nodes.where("n > 0").groupBy("node").agg(
        F.min("id").alias("first_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")))
    groups = stored(groups_of(classes))
    needed = groups.select("node").distinct().join(classes.select("node", "first_id", "n"), "node")
    texts = documents.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    wanted = texts.join(needed.select("first_id", "node"), F.col("id").eqNullSafe(F.col("first_id")))
    sets = wanted.select("node", "text").mapInPandas(_sets, "node long, members binary").dropDuplicates(["node"])
    sized = groups.join(needed.select("node", "n"), "node")
    blocks = sized.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCUMENTS),
                                                 F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = groups.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hub", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = stored(dealt.join(sets, "node").groupBy("hub", "i", "j").applyInPandas(_verify, "a long, b long"))
    roots = connected_components(links)
    known = classes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = known.join(smallest, "root").select("node", "root", "component_id")
    out = nodes.select("id", "mark", "n", "node").join(component, "node", "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "mark", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("node"),
                      found.alias("component_id"), found.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay: of each component one row with the smallest key, and all rows with an empty set.

    Rows equal in key and text count as one row of their component. Columns and texts stay as they are.
    """
    found = near_duplicates(documents, text, key)
    best = found.where("node is not null").groupBy("node").agg(
        F.min_by(F.struct(F.col(key).alias("id"), "mark"), F.struct(F.col(key).isNull(), F.col(key), "mark")).alias("x"))
    stay = best.select(F.col("x.id").alias("__id"), F.col("x.mark").alias("__mark"))
    marked = documents.withColumn("__at", F.xxhash64(F.col(text)))
    full = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = marked.where(full).join(stay, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__mark")), "left_semi")
    return first.dropDuplicates([key, "__at"]).union(marked.where(~full)).select(*documents.columns)
