"""Piece ids of texts and texts of piece ids for a SentencePiece model, words by a depth-first walk of their trie.

Words are marked: a space becomes the mark U+2581 in front of a word. No piece
holds a mark behind another character, or anything else behind a letter, so
texts are cut in front of marks, behind letters and at line ends. The distinct words of a run of texts are sorted, which is the
depth-first order of their trie; the forward states of a word's prefix are kept
for the next word that shares it.

A prefix's forward state holds the last piece of its best segmentation. For a
model of scores (unigram) that is the segmentation with the largest sum of its
pieces' scores, which the state holds too. For a model of merges the sum doesn't
tell: the segmentation is the one that merges lead to, where a piece may only
stand behind another if merging their joint characters gives just these two. Of
all pieces that end a prefix one alone may stand behind the last piece of what
is before it, so there the first that does is taken and no scores are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WordMemory, quoted, slices, worker_memory

MARK = "▁"
_RAISED = "²³¹¼½¾"
_LETTER, _OTHER = rf"[^\W\d_{_RAISED}]", rf"(?:[^\w{MARK}\n]|[\d_{_RAISED}])"
_PARTS = re.compile(rf"{MARK}*{_OTHER}*{_LETTER}+|{MARK}*{_OTHER}+|{MARK}+|\n")
#: Where no piece may run across: in front of marks, at line ends, behind letters.
_CUTS = re.compile(rf"[^{MARK}]{MARK}|\n.|.\n|{_LETTER}(?!{_LETTER}).", re.S)
#: What a Python worker remembers of words, in bytes, and of pairs of pieces, in pairs of about 100 bytes.
MEMORY_BYTES = 150_000_000
CACHE_PAIRS = 1_000_000
#: Characters of texts that are encoded together.
SLICE_CHARS = 2_000_000


#: By how much an unknown character is below the lowest score.
UNKNOWN_PENALTY = 10.0


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the wire format of protocol buffers."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else number(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def by_scores(raw: bytes) -> bool:
    """Whether a model file's contents are a model of scores (the default) rather than one of merges."""
    settings = b"".join(x for n, x in fields(raw) if n == 2 and isinstance(x, bytes))
    kind = ([1] + [x for n, x in fields(settings) if n == 3])[-1]
    if kind not in (1, 2):
        raise ValueError("the model is one of whole words or characters")
    return kind == 1


class Pieces:
    """The pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if byte[i]}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.surface = [b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        if any(_CUTS.search(p) for p in self.ids):
            raise ValueError("the model has pieces across words")
        self.names, self.size, self.lengths = names, n, list(map(len, names))
        self.scores = [model.get_score(i) for i in range(n)] if by_scores(model.serialized_model_proto()) else None
        self.lowest = min(map(model.get_score, self.ids.values())) - UNKNOWN_PENALTY
        self.memory = WordMemory(MEMORY_BYTES)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters of a short text gives."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, key: int) -> bool:
        """Whether a piece can follow another (or a cut, whose number is that of all pieces): key is both their numbers."""
        before, piece = divmod(key, self.size)
        names = [self.names[piece]] if before == self.size else [self.names[before], self.names[piece]]
        return self.merged("".join(names)) == names

    def walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) for sorted distinct words; each starts from the forward states it shares with the one before."""
        last = [self.size]  # of each prefix the last piece; ``size`` at a cut or behind a character that is no piece
        score = [0.0]
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            if self.scores is None:
                self._by_merges(word, last)
            else:
                self._by_scores(word, last, score, self.scores)
            found: list[int] = []
            end = len(word)
            while end:
                piece = last[end]
                if piece < self.size:
                    found.append(piece)
                    end -= self.lengths[piece]
                else:
                    raw = word[end - 1].encode("utf-8", "replace")
                    found.extend(self.bytes[b] for b in reversed(raw)) if self.bytes else found.append(self.unknown)
                    end -= 1
            found.reverse()
            yield word, array("i", found).tobytes()
            before = word

    def _by_merges(self, word: str, last: list[int]) -> None:
        """Adds the states of a word's further prefixes: the piece that may stand behind what is before it."""
        get, pairs, size, longest = self.ids.get, self.pairs, self.size, self.longest
        cut = next((k for k in range(len(last) - 1, 0, -1) if last[k] == size), 0)  # pieces don't cross a cut
        for end in range(len(last), len(word) + 1):
            if get(word[end - 1]) is None:
                last.append(size)
                cut = end
                continue
            for start in range(max(cut, end - longest), end):
                piece = get(word[start:end])
                if piece is None:
                    continue
                key = last[start] * size + piece
                stands = pairs.get(key)
                if stands is None:
                    stands = pairs[key] = self._stands(key)
                if stands:
                    last.append(piece)
                    break
            else:
                raise RuntimeError(f"no piece ends {word[:end]!r}")
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()

    def _by_scores(self, word: str, last: list[int], score: list[float], scores: list[float]) -> None:
        """Adds the states of a word's further prefixes: the piece with the largest sum up to it, the longest of equal ones."""
        get, longest = self.ids.get, self.longest
        for end in range(len(last), len(word) + 1):
            best, won = -float("inf"), self.size
            for start in range(max(0, end - longest), end):
                piece = get(word[start:end])
                if piece is not None and score[start] + scores[piece] > best:
                    best, won = score[start] + scores[piece], piece
            if get(word[end - 1]) is None and score[end - 1] + self.lowest > best:
                best, won = score[end - 1] + self.lowest, self.size
            last.append(won)
            score.append(best)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian 32-bit numbers."""
        parts = [_PARTS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        memory = self.memory
        for word, ids in self.walk(sorted(memory.missing(set().union(*parts) if parts else set()))):
            memory.put(word, ids)
        get = memory.newer.__getitem__
        found = [b"".join(map(get, p)) for p in parts]
        return found if self.bytes else list(map(self._one_unknown, found))

    def _one_unknown(self, raw: bytes) -> bytes:
        """Unknown characters in a row as one id."""
        ids = np.frombuffer(raw, dtype="<i4")
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return np.delete(ids, np.flatnonzero(again) + 1).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined to characters, and the mark in front of the text goes."""
        surface = self.surface
        text = b"".join([surface[i] if 0 <= i < len(surface) else b"" for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    """This worker's pieces of the model file at ``path``."""
    return worker_memory(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row of ``docs``, ``ids`` being the array of piece ids of the whole text.

    ``model`` is the path of a model file that all executors have. Null and
    empty texts have no ids (an empty array); null ids stay null; repeated rows
    stay; of an empty table nothing comes out. Characters that are no piece
    become their bytes' ids, or the unknown id where the model has no bytes. Sums of
    scores are in doubles. Other columns aren't read; an id that is called
    ``ids`` raises an error.
    """
    if id_col.lower() == "ids":
        raise ValueError("the id can't be called ids, as a column of the result is")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            at = 0
            for part in slices([t or "" for t in batch.column(1).to_pylist()], SLICE_CHARS):
                found = own.encode(part)
                ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                values = np.frombuffer(b"".join(found), dtype="<i4")
                rows = batch.column(0).slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "ids"])

    found = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return found.withColumnRenamed("id", id_col)


def decode(ids: Column, model: str) -> Column:
    """The text of each array of piece ids; null for null, and empty for an empty array."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(model)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(np.asarray(x)) for x in batch], dtype=object)

    return run(ids)
