"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of up to ``DEPTH`` words that occurs ``CONTEXT_COUNT`` times and whose next-word distribution diverges
from its parent's (the context without its first word). A word is scored by the longest suffix of what precedes it that
is a state; words that the state does not hold itself fall back to its parent, down to the smoothed word frequencies.

The model is a set of Spark tables and grows with the corpus. What falls below a state is its fallback, and for a word that
it holds the difference to that; both depend on a run of words alone, so the score of a text is the sum of one value
for every run of up to ``DEPTH + 1`` words in it. Frequent runs are broadcast, all others are joined.

Tasks split, hash and count whole Arrow batches. What they shuffle is dealt by ranges of the hashed runs, many runs to a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import forget, stored

DEPTH = 3
#: A context occurs so often, and a word so often below it, at any size of the corpus.
CONTEXT_COUNT, WORD_COUNT = 4, 2
#: What is broadcast: contexts of up to LEVELS words and runs of words with these shares of all tokens. The rest is joined.
LEVELS, CONTEXT_SHARE, WORD_SHARE = 2, 1e-4, 1e-6
#: Taken off each count below a state, and so left to its parent.
DISCOUNT = 0.5
#: A state's log-likelihood gain over its parent exceeds what chance gives by this many standard deviations.
DEVIATIONS = 4.0
#: Hash of the end of a text; no word holds a space.
END = xxhash.xxh64_intdigest(b"end of text") - (1 << 63)
#: Hash of what precedes a text.
START = xxhash.xxh64_intdigest(b"start of text") - (1 << 63)
#: A filter of runs has 8 to 16 bits a run, but at most so many; what passes it in error finds no partner.
FILTER_BITS = 1 << 28
#: Tokens that are scored, and bytes of text that are split, at a time.
GROUP, PIECE = 1 << 18, 1 << 23
#: Runs that a task counts before it passes them on, that it looks up, and tokens whose runs one task gathers.
BLOCK, ASKED, TASK_TOKENS = 1 << 21, 1 << 20, 1 << 21
#: Words of more bytes are hashed one by one.
LONG = 1 << 10
_BLANK, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER[65:91] += 32
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _stir(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(29))) + b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of binary texts, A-Z lower-cased and split at ASCII white space, and the number of words of each.

    All words take eight bytes at a time together. Null text: no words.
    """
    joined = pc.binary_join_element_wise(texts.fill_null(b""), pa.scalar(b" ", texts.type), pa.scalar(b"", texts.type))
    wide = pa.types.is_large_binary(joined.type)
    offsets = np.frombuffer(joined.buffers()[1], np.int64 if wide else np.int32)[joined.offset: joined.offset + len(joined) + 1].astype(np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    text = np.full(len(data) + 9, 32, np.uint8)
    np.take(_LOWER, data, out=text[1: len(data) + 1])
    blank = _BLANK[text]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(text) - 7, np.uint64, text, strides=(1,))
    found = _stir(size.astype(np.uint64), eight[starts] & _BYTES[np.minimum(size, 8)])
    at, here = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(here):
        found[here] = _stir(found[here], eight[starts[here] + at] & _BYTES[np.minimum(size[here] - at, 8)])
        at += 8
        here = here[size[here] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        found[k] = xxhash.xxh64_intdigest(text[starts[k]: starts[k] + size[k]].tobytes())
    return found.view(np.int64), np.diff(np.searchsorted(starts, offsets - offsets[0] + 1))


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``PIECE`` bytes of text, the hashes of their words and the number of words of each row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
        piece = batch.slice(first, last - first)
        yield piece, *hashes_of(piece.column(text))
        first = last


class Places:
    """Places of keys in a list of distinct hashes, by a table with open addresses."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = (1 << max(4, (3 * len(keys)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = keys & self.mask
        out = self.table[slot]
        here = np.flatnonzero(out >= 0)
        here = here[self.keys[out[here]] != keys[here]]
        slot = slot[here]
        while len(here):
            slot = (slot + 1) & self.mask
            found = self.table[slot]
            out[here] = found
            next_ = np.flatnonzero(found >= 0)
            next_ = next_[self.keys[found[next_]] != keys[here[next_]]]
            here, slot = here[next_], slot[next_]
        return out


@dataclass
class Level:
    """States of one depth: sorted codes of their contexts, log back-off weights, and the words that they hold."""

    states: np.ndarray  # the words of each context, the earliest in front, as digits to the base of the width
    fallback: np.ndarray
    codes: np.ndarray  # state * width + word, sorted
    values: np.ndarray  # log10 probabilities


@dataclass
class Tree:
    """Frequent words by sorted hash with log10 root probabilities and counts, the totals, and the levels."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)
    #: Frequent runs, those of the levels among them: sorted keys, and what each adds to a score.
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    worth: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: All other runs that add to a score (key, worth, length), and a filter of their keys.
    tail: DataFrame | None = None
    passes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tail": None, "levels": []}  # the tail is joined, the levels are in ``often``

    @property
    def width(self) -> int:
        return len(self.hashes)

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.hashes, END))

    @property
    def root(self) -> np.ndarray:
        return np.log10((self.counts + 1) / (self.tokens + self.distinct + 1))

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)

    @cached_property
    def often_places(self) -> Places:
        return Places(self.often)

    def known(self, depth: int, before: list[np.ndarray]) -> np.ndarray:
        """State of depth ``depth`` (1 is the first) of each position, -1 if there is none. before[k]: the word that
        precedes by k + 1 places, -1 if it is rare or there is none."""
        last, level = before[0], self.levels[depth - 1]
        out = np.full(len(last), -1)
        if not len(level.states):
            return out
        # A table says which words end a context; most positions need no search.
        ends = np.zeros(self.width + 1, bool)
        ends[level.states % self.width] = True
        here = np.flatnonzero(ends[last])
        code = last[here]
        for k in range(1, depth):
            fit = before[k][here] >= 0
            here, code = here[fit], code[fit] + before[k][here[fit]] * self.width ** k
        at = np.minimum(np.searchsorted(level.states, code), len(level.states) - 1)
        hit = level.states[at] == code
        out[here[hit]] = at[hit]
        return out

    def score(self, word: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each word in its context, without the root's part for rare words (-1)."""
        total = np.zeros(len(word))
        open_ = np.ones(len(word), bool)
        for depth in range(len(self.levels), 0, -1):
            level = self.levels[depth - 1]
            state = np.where(open_, self.known(depth, before), -1)
            here = np.flatnonzero(state >= 0)
            if not len(here):
                continue
            if len(level.codes):
                code = np.where(word[here] >= 0, state[here] * self.width + word[here], -1)
                at = np.minimum(np.searchsorted(level.codes, code), len(level.codes) - 1)
                hit = level.codes[at] == code
            else:
                at, hit = np.zeros(len(here), int), np.zeros(len(here), bool)
            total[here[hit]] += level.values[at[hit]]
            open_[here[hit]] = False
            total[here[~hit]] += level.fallback[state[here[~hit]]]
        rest = open_ & (word >= 0)
        total[rest] += self.root[word[rest]]
        return total


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a run from the keys of the run without its last and of the run without its first word."""
    return _stir(a.view(np.uint64), b.view(np.uint64)).view(np.int64)


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of placed texts of about ``GROUP`` tokens: their rows, words, rare words and numbers of words."""
    columns = [batch.column(name) for name in ("words", "h")]
    (words, rare), (at, far) = ([c.flatten().to_numpy() for c in columns], [c.offsets.to_numpy().astype(np.int64) for c in columns])
    at, far = at - at[0], far - far[0]
    ends, first = at[1:] + 2 * np.arange(1, len(batch) + 1), 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GROUP, "right")))
        yield slice(first, last), words[at[first]: at[last]], rare[far[first]: far[last]], np.diff(at[first: last + 1])
        first = last


def _run_keys(words: np.ndarray, rare: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, longest: int) -> tuple[np.ndarray, list]:
    """Owners of all places of a group of texts and, for each length of 1 to ``longest``, the places where such runs end
    and their keys at all places. Every text is its words between a start and an end."""
    lengths = lengths + 2
    size, starts = int(lengths.sum()), np.cumsum(lengths) - lengths
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(size) - starts[own]
    keys = np.empty(size, np.int64)
    inner = np.ones(size, bool)
    inner[starts] = inner[starts + lengths - 1] = False
    found = hashes[words]
    found[words < 0] = rare
    keys[inner], keys[starts], keys[starts + lengths - 1] = found, START, END
    out = [(np.arange(size), keys)]
    for n in range(2, longest + 1):
        keys = np.concatenate([keys[:1], _mix(keys[:-1], keys[1:])])
        out.append((np.flatnonzero(place >= n - 1), keys))
    return own, out


def _parts(spark, tokens: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TASK_TOKENS))


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, the parts that hold some, and the number of keys of each: ranges of the keys."""
    order = np.argsort(keys.view(np.uint64))
    part = ((keys[order].view(np.uint64) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    return order, part[first].astype(np.int64), np.diff(np.append(first, len(part)))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of a sorted list begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)


def _batches(columns: dict[str, np.ndarray], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict({name: pa.array(value) for name, value in columns.items()})
    for first in range(0, len(whole), rows):
        yield whole.slice(first, rows)


def _passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    word, both = bits[(keys & (64 * len(bits) - 1)) >> 6], (np.int64(1) << (keys & 63)) | (np.int64(1) << ((keys >> 40) & 63))
    return word & both == both


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bits of the keys of a table (key), two for each in one word, at most ``FILTER_BITS``."""
    size = min(FILTER_BITS, 1 << max(10, (8 * keys.count()).bit_length()))
    key = F.col("key")
    first, second = (F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int")) for x in (key, F.shiftright(key, 40)))
    words = keys.select(F.shiftright(key.bitwiseAND(F.lit(size - 1).cast("long")), 6).alias("at"), first.bitwiseOR(second).alias("bit"))
    # Stored, so the shuffle files go.
    merged = stored(words.groupBy("at").agg(F.bit_or("bit").alias("bit")), free=True)
    held = merged.toArrow().to_pandas()
    forget(merged)
    bits = np.zeros(size >> 6, np.int64)
    bits[held["at"].to_numpy(np.int64)] = held["bit"].to_numpy(np.int64)
    return bits


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, texts = [], 0, 0

    def told() -> Iterator[pa.RecordBatch]:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return _batches({"h": np.append(words, END), "n": np.append(n, texts)})

    for batch in batches:
        for piece, words, _ in _pieces(batch, "text"):
            held.append(words)
            size, texts = size + len(words), texts + len(piece)
            if size >= BLOCK:
                yield from told()
                held, size, texts = [], 0, 0
    if texts:
        yield from told()


def vocabulary(documents: DataFrame, text: str = "text") -> tuple[Tree, DataFrame]:
    """A tree without states, and the stored counts (h, n) of all words, hashed, and of the end of texts.

    Counts cover all rows and are summed by Spark, combined per batch before the shuffle. The driver gets the words
    with at least ``WORD_SHARE`` of all tokens: their number is bounded at any size of the corpus.
    """
    source = documents.select(F.col(text).cast("binary").alias("text"))
    counts = stored(source.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), free=True)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    often = counts.where((F.col("n") >= max(2, WORD_SHARE * tokens)) | (F.col("h") == END)).toArrow().to_pandas().sort_values("h")
    if not tokens:
        return Tree(np.array([END]), np.array([0]), 0, 0), counts
    return Tree(often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64), tokens, distinct), counts


def place_words(documents: DataFrame, tree: Tree, text: str = "text") -> DataFrame:
    """Replace the text by ``words``: the place of each word in the tree's list, -1 for a rare one; h: the hashes of
    the rare words in their order; and add ``row``, a number per row. Stored, so texts are split once.

    All other columns stay; columns with those three names are replaced. Null text: no words.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tree)
    rest = [name for name in documents.columns if name not in ("row", "words", "h", text)]
    source = documents.select(*[F.col(f"`{name}`") for name in rest], F.monotonically_increasing_id().alias("row"),
                              F.col(text).cast("binary").alias("__text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value.places
        for batch in batches:
            for piece, words, lengths in _pieces(batch, "__text"):
                ids = places(words)
                few = np.concatenate([[0], np.cumsum(ids < 0)])[np.concatenate([[0], np.cumsum(lengths)])]
                keep = [name for name in piece.schema.names if name != "__text"]
                yield pa.RecordBatch.from_arrays([*map(piece.column, keep), _list(ids, lengths), _list(words[ids < 0], np.diff(few))],
                                                 [*keep, "words", "h"])

    schema = source.drop("__text").schema.add("words", T.ArrayType(T.IntegerType())).add("h", T.ArrayType(T.LongType()))
    return stored(source.mapInArrow(place, schema), codec="zstd")


def _count_runs(placed: DataFrame, hashes, tokens: int, length: int, filter_: np.ndarray) -> DataFrame:
    """Stored runs (ctx, suf, n, key) of ``length`` words that occur ``WORD_COUNT`` times. filter_: keys of the shorter runs
    that do; a run cannot be more frequent than the two inside it."""
    passes = placed.sparkSession.sparkContext.broadcast(filter_)
    parts = _parts(placed.sparkSession, tokens)

    def told(held: list) -> Iterator[pa.RecordBatch]:
        ctx, suf = (np.concatenate(x) for x in zip(*held))
        keys = _mix(ctx, suf)
        order = np.argsort(keys.view(np.uint64))
        first = _firsts(keys[order])
        one, n = order[first], np.diff(np.append(first, len(order))).astype(np.int32)
        order, part, size = _dealt(keys[one], 16 * parts)
        yield pa.RecordBatch.from_arrays([pa.array(part), *(_list(x[order], size) for x in (ctx[one], suf[one], n))], ["part", "ctx", "suf", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words, rare, lengths in _groups(batch):
                _, runs = _run_keys(words, rare, lengths, hashes.value, length)
                at, shorter = runs[length - 1][0], runs[length - 2][1]
                fit = _passing(shorter, passes.value)
                at = at[fit[at] & fit[at - 1]]
                held.append((shorter[at - 1], shorter[at]))
                size += len(at)
                if size >= BLOCK:
                    yield from told(held)
                    held, size = [], 0
        if size:
            yield from told(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(name).flatten().to_numpy() for name in ("ctx", "suf", "n")] for batch in batches]
        if not held:
            return
        ctx, suf, n = (np.concatenate(x) for x in zip(*held))
        del held
        keys = _mix(ctx, suf)
        order = np.argsort(keys)
        first = _firsts(keys[order])
        if len(first):
            total = np.add.reduceat(n[order].astype(np.int64), first)
            first, total = first[total >= WORD_COUNT], total[total >= WORD_COUNT]
            one = order[first]
            yield from _batches({"ctx": ctx[one], "suf": suf[one], "n": total, "key": keys[one]})

    blocks = placed.select("words", "h").mapInArrow(count, "part long, ctx array<long>, suf array<long>, n array<int>")
    runs = stored(blocks.repartition(parts, "part").mapInArrow(add, "ctx long, suf long, n long, key long"), free=True)
    passes.destroy()
    return runs


def grow(tree: Tree, placed: DataFrame, counts: DataFrame) -> Tree:
    """Give the tree its states, learned from the rows of ``place_words`` (those that its vocabulary was counted on).

    Per depth, Spark counts the runs of words, joins each with its context's count and its parent's value, and tests the
    contexts. States and values stay in Spark; the driver gets those whose shares bound their number, and a filter.
    """
    tree.levels.clear()
    if not tree.tokens:
        return tree
    big, often = max(CONTEXT_COUNT, CONTEXT_SHARE * tree.tokens), max(WORD_COUNT, WORD_SHARE * tree.tokens)
    hashes = placed.sparkSession.sparkContext.broadcast(tree.hashes)
    root = F.log10((F.col("n") + 1) / F.lit(float(tree.tokens + tree.distinct + 1)))
    values = counts.where(F.col("n") >= WORD_COUNT).select(F.col("h").alias("key"), root.alias("value"))
    start = counts.where(F.col("h") == END).select(F.lit(START).alias("key"), F.col("n").alias("size"))
    contexts = counts.where(F.col("h") != END).select(F.col("h").alias("key"), F.col("n").alias("size")).union(start)
    contexts = contexts.where(F.col("size") >= CONTEXT_COUNT)
    filter_ = _filter_of(counts.where(F.col("n") >= WORD_COUNT).select(F.col("h").alias("key")).union(start.select("key")))
    digits = pd.Series(np.append(np.arange(tree.width), tree.end), np.append(tree.hashes, START))
    rest, stages = [], []
    for depth in range(1, DEPTH + 1):
        runs = _count_runs(placed, hashes, tree.tokens, depth + 1, filter_)
        below = stored(runs.join(contexts.withColumnRenamed("key", "ctx"), "ctx").join(
            values.select(F.col("key").alias("suf"), F.col("value").alias("parent")), "suf"), free=True)
        kept = stored(diverging(below), free=True)
        value = F.log10((F.col("n") - DISCOUNT) / F.col("size"))
        head = F.lit(depth <= LEVELS) & (F.col("size") >= big) & (F.col("n") >= often)
        held = stored(below.join(kept.select("ctx", "fallback"), "ctx").select(
            "key", "n", value.alias("value"), (value - F.col("fallback") - F.col("parent")).alias("more"),
            *[F.when(head, F.col(name)).alias(name) for name in ("ctx", "suf")]), free=True)
        forget(below)
        stages += [kept, held]
        if depth <= LEVELS:
            tree.levels.append(level(tree, digits, kept.where(F.col("size") >= big).toArrow().to_pandas(),
                                     held.where("ctx is not null").toArrow().to_pandas()))
        if depth < LEVELS:
            run = runs.where(F.col("n") >= often).toArrow().to_pandas()
            last = digits.loc[run["suf"]].to_numpy() % tree.width
            digits = pd.Series(digits.loc[run["ctx"]].to_numpy() * tree.width + last, run["key"].to_numpy())
        rest += [kept.select(F.col("ctx").alias("key"), F.col("size").alias("n"), F.col("fallback").alias("worth")),
                 held.select("key", "n", F.col("more").alias("worth"))]
        rest[-2:] = [part.withColumn("length", F.lit(depth + k)) for k, part in enumerate(rest[-2:])]
        if depth == DEPTH:
            break
        # A run becomes a context if the run without its first word is a state; runs to the end of a text have no next word.
        contexts = runs.where(F.col("n") >= CONTEXT_COUNT).join(kept.select(F.col("ctx").alias("suf")), "suf", "left_semi").select("key", F.col("n").alias("size"))
        contexts = stored(contexts, free=True)
        stages.append(contexts)
        values, filter_ = held.select("key", "value"), _filter_of(runs.select("key"))
        forget(runs)
    forget(runs)
    # A run may have two rows, as a state and as what a state holds.
    whole = stored(reduce(DataFrame.union, rest))
    for stage in stages:
        forget(stage)
    head = whole.where(F.col("n") >= often).toArrow().to_pandas().groupby("key")["worth"].sum()
    tree.often, tree.worth = head.index.to_numpy(np.int64), head.to_numpy(np.float64)
    tree.tail = whole.where(F.col("n") < often).select("key", "worth", "length")
    tree.passes = _filter_of(tree.tail.select("key"))
    return tree


def train(documents: DataFrame, text: str = "text") -> tuple[Tree, DataFrame]:
    """Learn a tree from all rows; returns it with the counts of all words. No rows: no states and no tokens."""
    tree, counts = vocabulary(documents, text)
    return grow(tree, place_words(documents.select(text), tree, text), counts), counts


def diverging(below: DataFrame) -> DataFrame:
    """The states (ctx, size, fallback): contexts whose next-word distribution diverges from their parent's.

    The gain of a state is its size times the Kullback-Leibler divergence; under the parent's distribution twice the gain
    follows a chi-square law with as many degrees of freedom as it holds words. A word below a state has its count less the
    discount over the state's size; all other words have what is left, in the parent's proportions.
    """
    share, parent = F.col("n") / F.col("size"), F.pow(F.lit(10.0), F.col("parent"))
    sums = below.groupBy("ctx").agg(
        F.max("size").alias("size"), F.count("*").alias("kinds"), F.sum(share).alias("held"), F.sum(parent).alias("base"),
        F.sum(share * F.log(share / parent)).alias("near"), F.sum((F.col("n") - DISCOUNT) / F.col("size")).alias("smooth"))
    rest, left = F.greatest(1 - F.col("held"), F.lit(1e-12)), F.greatest(1 - F.col("base"), F.lit(1e-12))
    gain = F.col("near") + F.when(rest > 1e-12, rest * F.log(rest / left)).otherwise(0)
    keep = 2 * F.col("size") * gain > F.col("kinds") + DEVIATIONS * F.sqrt(2 * F.col("kinds"))
    return sums.where(keep).select("ctx", "size", F.log10(F.greatest(1 - F.col("smooth"), F.lit(1e-12)) / left).alias("fallback"))


def level(tree: Tree, digits: pd.Series, kept: pd.DataFrame, held: pd.DataFrame) -> Level:
    """The frequent states of a depth and the frequent words below them. digits: of the runs of that length by key."""
    codes = digits.loc[kept["ctx"]].to_numpy(np.int64)
    order = np.argsort(codes)
    states = codes[order]
    state = np.searchsorted(states, digits.loc[held["ctx"]].to_numpy(np.int64))
    codes = state * tree.width + digits.loc[held["suf"]].to_numpy(np.int64) % tree.width
    place = np.argsort(codes)
    return Level(states, kept["fallback"].to_numpy(np.float64)[order], codes[place], held["value"].to_numpy(np.float64)[place])


def score_texts(documents: DataFrame, tree: Tree, counts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, n_tokens, n_known, train_tokens, base_score and score of every document; see ``score_placed``."""
    return score_placed(place_words(documents.select(F.col(key), F.col(text)), tree, text), tree, counts)


def score_placed(placed: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """Score the rows of ``place_words``: all their other columns, n_tokens, n_known, train_tokens, base_score, score.

    The tree (bounded by its shares) is broadcast. Words that are too rare for it are looked up in ``counts``, and runs of
    words in its tail, by shuffle joins of (row, hash) records; such a word or run has at most ``WORD_SHARE`` of the
    training tokens, and one that is frequent elsewhere only lies on the side that Spark can split. Texts are not shuffled.

    Null and empty texts are scored by their end alone. Repeated rows, equal keys and null keys are separate rows.
    Columns with the names of the results are replaced.
    """
    spark = placed.sparkSession
    shared, parts = spark.sparkContext.broadcast(tree), _parts(spark, tree.tokens)
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [name for name in placed.columns if name not in ("row", "words", "h", *results)]
    # What a word without a count adds; a count c adds log10(c + 1) to that.
    unknown = -float(np.log10(tree.tokens + tree.distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        root = tree.root
        for batch in batches:
            total, base, n, known = (np.zeros(len(batch)) for _ in range(4))
            for rows, words, rare, lengths in _groups(batch):
                own, runs = _run_keys(words, rare, lengths, tree.hashes, DEPTH + 1)
                size = len(lengths)
                n[rows] = lengths + 1
                mine, often = np.repeat(np.arange(size), lengths), words >= 0
                ids = words[often]
                base[rows] = np.bincount(mine, np.where(often, root[words], unknown), size) + root[tree.end]
                known[rows] = np.bincount(mine[often], tree.counts[ids] > 0, size) + (tree.counts[tree.end] > 0)
                total[rows] = base[rows]
                for at, keys in runs:
                    place = tree.often_places(keys[at])
                    hit = np.flatnonzero(place >= 0)
                    total[rows] += np.bincount(own[at[hit]], tree.worth[place[hit]], size)
            columns = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, [*rest, "row"]), *columns], [*rest, "row", "n_tokens", "__known", "__base", "__total"])

    def asked(held: list) -> Iterator[pa.RecordBatch]:
        rows, keys = (np.concatenate(x) for x in zip(*held))
        order, part, size = _dealt(keys, 16 * parts)
        none = pa.nulls(len(part), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), _list(keys[order], size), _list(rows[order], size), none, none], ["part", "key", "row", "worth", "base"])

    def asking(length: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            held, size = [], 0
            for batch in batches:
                row = batch.column("row").to_numpy()
                for rows, words, rare, lengths in _groups(batch):
                    own, runs = _run_keys(words, rare, lengths, tree.hashes, length)
                    at, keys = runs[-1]
                    fit = _passing(keys[at], tree.passes)
                    if length == 1:  # every rare word is looked up, the end of a text is not
                        places = np.arange(len(words)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1
                        fit[places[words < 0]] = True
                        fit[np.cumsum(lengths + 2) - 1] = False
                    at = at[fit]
                    held.append((row[rows][own[at]], keys[at]))
                    size += len(at)
                    if size >= ASKED:
                        yield from asked(held)
                        held, size = [], 0
            if size:
                yield from asked(held)
        return ask

    def telling(held: list) -> Iterator[pa.RecordBatch]:
        keys, worth, base = (np.concatenate(x) for x in zip(*held))
        order, part, size = _dealt(keys, 16 * parts)
        none = pa.nulls(len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), _list(keys[order], size), none, _list(worth[order], size), _list(base[order], size)],
                                         ["part", "key", "row", "worth", "base"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(name).to_numpy() for name in ("key", "worth", "base")])
            size += len(batch)
            if size >= ASKED:
                yield from telling(held)
                held, size = [], 0
        if size:
            yield from telling(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, asked = [], []
        for batch in batches:
            of = batch.column("row").is_null()
            for rows, names, into in ((of, ("key", "worth", "base"), told), (pc.invert(of), ("key", "row"), asked)):
                some = batch.filter(rows)
                if len(some):
                    into.append([some.column(name).flatten().to_numpy() for name in names])
        if not told or not asked:
            return
        keys, worth, base = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(keys)
        first = _firsts(keys[order])
        keys, worth, base = keys[order][first], np.add.reduceat(worth[order], first), np.add.reduceat(base[order], first)
        rows, places = [], []
        for key, row in asked:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            rows.append(row[hit])
            places.append(at[hit])
        at = np.concatenate(places)
        own, rows = pd.factorize(np.concatenate(rows))
        if len(rows):
            yield summed(rows, np.bincount(own, worth[at]), np.bincount(own, base[at]), np.bincount(own[base[at] > 0], minlength=len(rows)))

    def summed(rows: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        order, part, size = _dealt(_stir(rows.view(np.uint64), np.uint64(0)).view(np.int64), parts)
        return pa.RecordBatch.from_arrays([pa.array(part), *(_list(x[order], size) for x in (rows, *sums))], ["part", "row", "worth", "base", "known"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(name).flatten().to_numpy() for name in ("row", "worth", "base", "known")] for batch in batches]
        if held:
            rows, *sums = (np.concatenate(x) for x in zip(*held))
            own, rows = pd.factorize(rows)
            yield from _batches({"row": rows} | {name: np.bincount(own, x) for name, x in zip(("worth", "base", "known"), sums)})

    light = counts.where(F.col("n") < max(2, WORD_SHARE * tree.tokens)).where(F.col("h") != END).select(
        F.col("h").alias("key"), F.log10(F.col("n") + 1).alias("worth"), F.log10(F.col("n") + 1).alias("base"))
    shape = "part long, key array<long>, row array<long>, worth array<double>, base array<double>"
    sums = "part long, row array<long>, worth array<double>, base array<double>, known array<long>"
    found = []
    # Runs of each length are looked up by themselves, so what one shuffles is gone before the next.
    for length in range(1, DEPTH + 2):
        tables = [light] if length == 1 else []
        if tree.tail is not None:
            tables.append(tree.tail.where(F.col("length") == length).select("key", "worth", F.lit(0.0).alias("base")))
        if tables:
            dealt = placed.select("row", "words", "h").mapInArrow(asking(length), shape).union(reduce(DataFrame.union, tables).mapInArrow(tell, shape))
            met = dealt.repartition(parts, "part").mapInArrow(meet, sums).repartition(parts, "part")
            found.append(stored(met.mapInArrow(add, "row long, worth double, base double, known double"), free=True))
    met = reduce(DataFrame.union, found).groupBy("row").agg(
        F.sum("worth").alias("__worth"), F.sum("base").alias("__more"), F.sum("known").cast("long").alias("__found"))
    schema = T.StructType([*[placed.schema[name] for name in [*rest, "row"]], T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()),
                           T.StructField("__base", T.DoubleType()), T.StructField("__total", T.DoubleType())])
    out = placed.select(*[F.col(f"`{name}`") for name in rest], "row", "words", "h").mapInArrow(score, schema).join(met, "row", "left")
    worth, more, found = F.coalesce("__worth", F.lit(0.0)), F.coalesce("__more", F.lit(0.0)), F.coalesce("__found", F.lit(0))
    return out.select(*[F.col(f"`{name}`") for name in rest], "n_tokens", (F.col("__known") + found).alias("n_known"),
                      F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("__base") + more).alias("base_score"),
                      (F.col("__total") + worth).alias("score"))
