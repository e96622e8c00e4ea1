"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A segment is cut left to right into the longest pieces that match (Aho-Corasick); a piece is taken only if it is
compatible with the piece before it, that is if re-merging the two leaves them apart. Where no piece fits, the last
piece gives way to a shorter one. Positions that cannot be continued are marked in a bitfield and never tried again.
Of all cuts only the one that the merges make is compatible throughout, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import claim

SPACE = "▁"
#: Segments whose result a worker keeps; the cache is emptied when full, so its size does not grow with the data.
CACHE = 300_000
#: Longer segments are not kept.
CACHE_LENGTH = 40


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # n normal, b byte, c control, u unknown, x unused
    end_id: int
    unknown_id: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["b" if model.is_byte(i) else "c" if model.is_control(i) else "u" if model.is_unknown(i)
                 else "x" if model.is_unused(i) else "n" for i in ids]
        return cls(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), "".join(kinds),
                   model.eos_id(), model.unk_id())


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.kinds = vocabulary.pieces, vocabulary.kinds
        self.end_id, self.unknown_id = vocabulary.end_id, vocabulary.unknown_id
        normal = [i for i, kind in enumerate(self.kinds) if kind == "n"]
        #: Pieces of spaces alone share the lowest score, so they merge last and from the left; see ``spaces``.
        self.runs = {len(self.pieces[i]): i for i in normal if not self.pieces[i].strip(SPACE)}
        normal = [i for i in normal if self.runs.get(len(self.pieces[i])) != i or self.pieces[i] == SPACE]
        self.ids = {self.pieces[i]: i for i in normal}
        #: A better piece merges first. Other pieces with one score would tie and go by position: such a model is refused.
        self.rank = {i: -vocabulary.scores[i] for i in normal}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == "b"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.symbols = {self.pieces[i] for i in normal if len(self.pieces[i]) == 1}
        merged = [i for i in normal if len(self.pieces[i]) > 1]
        if len({self.rank[i] for i in merged}) != len(merged):
            raise ValueError("pieces with equal scores: not a merge-type model")
        if any(SPACE in self.pieces[i][1:] for i in normal):  # then a segment could not end before each run of spaces
            raise ValueError("a piece has a space behind another character")
        self.halves: dict[int, tuple[int, int]] = {}
        self.reachable: set[int] = set()
        for i in sorted(normal, key=lambda i: len(self.pieces[i])):
            self._split(i)
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.plain = [piece.replace(SPACE, " ") for piece in self.pieces]
        self.special = {i for i, kind in enumerate(self.kinds) if kind not in "nx"}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _split(self, i: int) -> None:
        """Find the last merge that makes a piece; a piece that the merges never make is not matched."""
        parts = self.merge(self.pieces[i])
        if len(parts) == 1:
            self.reachable.add(i)
            if self.last is not None:
                self.halves[i] = self.last

    def merge(self, text: str) -> list[int]:
        """The merges one by one, best score first, leftmost of equals: the definition, for short texts."""
        self.last = None
        parts = [self.ids.get(c) for c in text]
        words = list(text)
        while len(parts) > 1:
            best = min(((self.rank[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(words, words[1:]))
                        if a + b in self.ids), default=None)
            if best is None:
                break
            k = best[1]
            self.last = (parts[k], parts[k + 1])
            words[k: k + 2] = [words[k] + words[k + 1]]
            parts[k: k + 2] = [self.ids[words[k]]]
        return parts

    @cached_property
    def automaton(self):
        out = ahocorasick.Automaton()
        for i in self.reachable:
            out.add_word(self.pieces[i], (len(self.pieces[i]), i))
        out.make_automaton()
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Re-merge two neighbours: undo merges along their border, the later first; a merge across means no.

        The pair is apart exactly if at no stage the outermost symbols at the border could merge with a better score
        than the merges that took them away from it.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        rank, ids, pieces, halves = self.rank, self.ids, self.pieces, self.halves
        limit = float("inf")
        while True:
            joined = ids.get(pieces[left] + pieces[right])
            if joined is not None and rank[joined] < limit:
                return False
            a = rank[left] if left in halves else -1.0
            b = rank[right] if right in halves else -1.0
            if a < 0 and b < 0:
                return True
            # Undo the later merge; of equal ones the right, as the left merged first. A merge across the border lies
            # left of one undone in the right piece, so there it also wins with the same score.
            if a > b:
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 0.5, halves[right][0]

    def segment(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are in the vocabulary."""
        n = len(text)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):
            matches[end - found[0] + 1].append(found)
        # Matches come by their end, so each list rises in length and the longest is last.
        failed, at, out, lengths, pairs = 0, 0, [], [], self.pairs
        pending = matches[0][:]
        while at < n:
            while pending:
                length, piece = pending.pop()
                if failed >> (at + length) & 1:
                    continue
                if out:
                    fits = pairs.get((out[-1], piece))
                    if not (self.compatible(out[-1], piece) if fits is None else fits):
                        continue
                out.append(piece)
                lengths.append(length)
                at += length
                pending = matches[at][:]
                break
            else:
                if not out:
                    raise ValueError("no cut fits")
                failed |= 1 << at
                length = lengths.pop()
                out.pop()
                at -= length
                pending = [found for found in matches[at] if found[0] < length]
        return out

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of spaces: the leftmost pair whose sum is a piece merges, again and again.

        The first part is final once the longest piece can no longer reach it, so long runs go part by part.
        """
        longest, out = max(self.runs), []
        while n:
            parts = [1] * min(n, 3 * longest)
            k = 0
            while k + 1 < len(parts):
                if parts[k] + parts[k + 1] in self.runs:
                    parts[k: k + 2] = [parts[k] + parts[k + 1]]
                    k = max(k - 1, 0)
                else:
                    k += 1
            parts = parts if n <= 3 * longest else parts[:1]
            out += [self.runs[part] for part in parts]
            n -= sum(parts)
        return out

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one segment: spaces, then others. The last space merges with what follows if any piece allows it."""
        lead = len(text) - len(text.lstrip(SPACE))
        if not lead:
            return self._encode(text)
        out = self._encode(text[lead - 1:]) if lead < len(text) else []
        if out and out[0] != self.ids[SPACE]:
            return self.spaces(lead - 1) + out
        return self.spaces(lead) + out[1:]

    def _encode(self, text: str) -> list[int]:
        """Characters outside the vocabulary become byte pieces and stop merges."""
        if self.symbols.issuperset(text):
            return self.segment(text)
        out, run = [], []
        for c in text:
            if c in self.symbols:
                run.append(c)
                continue
            if run:
                out += self.segment("".join(run))
                run = []
            coded = c.encode("utf-8", "surrogatepass")
            out += [self.bytes[b] for b in coded] if self.bytes else [self.unknown_id]
        return out + self.segment("".join(run)) if run else out

    def segments(self, text: str) -> Iterator[str]:
        """The normalised text (dummy prefix, spaces as pieces write them), cut before each run of spaces."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        run = ""
        parts = text.split(SPACE)
        if parts[0]:
            yield parts[0]
        for part in parts[1:]:
            run += SPACE
            if part:
                yield run + part
                run = ""
        if run:
            yield run

    def lookup(self, segment: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and what they decode to."""
        found = self.cache.get(segment)
        if found is None:
            ids = self.encode_segment(segment)
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids, False))
            if len(segment) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[segment] = found
        return found

    def lookups(self, text: str) -> list[tuple[int, str, str]]:
        """``lookup`` of all segments; words between single spaces are found without cutting the text twice."""
        if not text or SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [self.lookup(part) for part in self.segments(text)]
        cache, lookup = self.cache, self.lookup
        return [cache.get(part) or lookup(part) for part in (SPACE + text.replace(" ", " " + SPACE)).split(" ")]

    def encode(self, text: str) -> list[int]:
        """Ids of a text and the end id."""
        return [i for part in self.segments(text) for i in self.encode_segment(part)] + [self.end_id]

    def decode(self, ids: list[int], begin: bool = True) -> str:
        """Text of ids. ``begin``: they start a text, so the space that encoding put in front goes."""
        if self.special.isdisjoint(ids):
            text = "".join([self.plain[i] for i in ids])
            return text[1:] if begin and text[:1] == " " else text
        out, held = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == "b":
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_decode_bytes(held))
                held, begin = bytearray(), False
            if kind == "c":
                continue
            piece = " ⁇ " if kind == "u" else self.plain[i]
            if begin and piece:
                piece = piece[1:] if kind != "u" and piece[0] == " " else piece
                begin = False
            out.append(piece)
        if held:
            out.append(_decode_bytes(held))
        return "".join(out)


def _decode_bytes(held: bytearray) -> str:
    """UTF-8, one replacement character for each byte that starts nothing valid."""
    out, at = [], 0
    while at < len(held):
        for size in (1, 2, 3, 4):
            try:
                out.append(held[at: at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                if size == 4:
                    out.append("�")
                    at += 1
    return "".join(out)


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "array<int>"


class _Texts:
    """The codec of a worker, built once per process."""

    codecs: dict[int, Codec] = {}

    @classmethod
    def of(cls, broadcast) -> Codec:
        if broadcast.id not in cls.codecs:
            cls.codecs.clear()
            cls.codecs[broadcast.id] = Codec(broadcast.value)
        codec = cls.codecs[broadcast.id]
        claim("pieces", codec.cache, codec.pairs)
        return codec


class _Shared:
    """A broadcast vocabulary with a key that workers can compare."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.id = hash((vocabulary.pieces, vocabulary.scores)) if vocabulary else 0
        self.broadcast = spark.sparkContext.broadcast(vocabulary)

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode_texts(documents: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the encoding with the end id. Null text: as empty (the end id alone).

    ``model`` is a path on the driver; the pieces (about 1 MB) are broadcast. Rows are independent: no shuffle, no state
    but a bounded cache; repeated rows, an empty table and other columns need no care; a column named like ``ids`` is
    replaced. Encoding is linear in the text, of whatever length.
    """
    shared = _Shared(documents.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _Texts.of(shared)
        for texts in batches:
            yield pd.Series([codec.encode(value or "") for value in texts], dtype=object)

    return documents.withColumn(ids, F.pandas_udf(run, IDS)(F.col(text)))


def decode_ids(frame: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the decoding of ``ids``. Null ids give null; ids outside the vocabulary are an error."""
    shared = _Shared(frame.sparkSession, Vocabulary.load(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _Texts.of(shared)
        for rows in batches:
            yield pd.Series([None if row is None else codec.decode([int(i) for i in row]) for row in rows], dtype=object)

    return frame.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def token_digests(documents: DataFrame, model: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the struct ``out``: number of ids, digest of the ids, digest of what they decode to.

    The same codec as ``encode_texts`` and ``decode_ids``, but ids and texts stay in the task. Null text: as empty.
    """
    shared = _Shared(documents.sparkSession, Vocabulary.load(model))
    names = [part.split()[0] for part in RESULT.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _Texts.of(shared)
        for texts in batches:
            rows = []
            for value in texts:
                found = codec.lookups(value or "")
                counts, listed, decoded = zip(*found) if found else ((), (), ())
                text_back = "".join(decoded)
                text_back = text_back[1:] if text_back[:1] == " " else text_back
                listed = " ".join([*listed, str(codec.end_id)])
                rows.append((sum(counts) + 1, hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(text_back.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=names)

    return documents.withColumn(out, F.pandas_udf(run, RESULT)(F.col(text)))
