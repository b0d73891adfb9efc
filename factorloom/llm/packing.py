"""Training sequences without padding: every document is cut into pieces whose lengths are powers of two.

A document of n tokens becomes n // 4096 pieces of 4096 and then one piece for
each binary digit of the rest, the longest first. A piece is a sequence of its
own, and sequences of one length make up a bucket, so that batches are taken
from one bucket, no sequence crosses a document and none has padding.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WordMemory, quoted, slices, worker_memory

SEQUENCE_TOKENS = 4096
#: Characters that the tokenizer never joins to a letter before them.
PUNCTUATION = ".,;:!?#$%&*-+=/()[]{}\"_~"
#: What bytes that aren't printed are as letters, as in tokenizers of bytes.
LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Kinds of a UTF-8 text's bytes, and what is of each kind.
SPACE, MARK, LETTER, OTHER = range(4)
KINDS = bytes(
    SPACE if chr(b) in " \n" else MARK if chr(b) in PUNCTUATION else LETTER if b < 128 and chr(b).isalpha() else OTHER for b in range(256)
)
#: From here on what a letter is, and its small form, may differ between Unicode's versions.
NEWER = "\u0530"
#: What a Python worker remembers of words' ids, in bytes.
MEMORY_BYTES = 160_000_000
#: Characters of texts whose parts are looked up together.
SLICE_CHARS = 3_000_000


class WordIds:
    """Token ids of whole texts, as little-endian 32-bit numbers, by way of a bounded memory of words.

    A tokenizer that lower-cases, takes runs of letters apart from all else,
    drops white space and joins nothing across it, gives a text the ids of the
    parts between its spaces and line ends in turn; a part of letters with
    punctuation behind it is two parts. Texts of Latin-1 characters are
    lower-cased as a whole and each distinct part of many texts is looked up
    once; only what may be one of the tokenizer's own added tokens stays as it
    is. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as opened:
            file = json.load(opened)
        self.by_words = splits_words(file)
        self.added = [x["content"] for x in file.get("added_tokens") or []]
        self.memory = WordMemory(MEMORY_BYTES)
        self.letters = self._letters if takes_letters(file) else self._each

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, straight from the tokenizer's model, which gets their bytes as letters after the normalization."""
        tokens = self.tokenizer.model.tokenize
        low = [w.lower() if w.isascii() else self._as_letters(w) for w in words]
        others = iter(self._each([w for w, x in zip(words, low, strict=True) if x is None]))
        return [next(others) if x is None else array("I", [t.id for t in tokens(x)]).tobytes() for x in low]

    @staticmethod
    def _as_letters(word: str) -> str | None:
        """What the tokenizer's model gets for a word of letters; none where that may depend on Unicode's version or isn't letters alone."""
        low = "".join(map(str.lower, word))
        known = low.isalpha() and max(word) < NEWER and max(low) < NEWER and is_normalized("NFC", word)
        return low.encode().decode("latin-1").translate(LETTERS) if known else None

    def _learn(self, parts: list[str]) -> None:
        memory = self.memory
        memory.put("", b"")
        self._put([p for p in parts if p.isalpha()], self.letters)
        parts = [p for p in parts if p and not p.isalpha()]
        bases = [p.rstrip(PUNCTUATION) for p in parts]
        bases = [b if _plain(b) else p for p, b in zip(parts, bases, strict=True)]
        ends = [p[len(b) :] for p, b in zip(parts, bases, strict=True)]
        bases = [b.lower() if b.isascii() and b.isalpha() else b for b in bases]
        distinct = set(bases).union(ends).difference(memory.newer)
        remembered = {b: memory.older[b] for b in distinct if b in memory.older}
        memory.put_all(remembered)
        distinct.difference_update(remembered)
        letters = [b for b in distinct if b.isalpha()]
        self._put(letters, self.letters)
        self._put(list(distinct.difference(letters)), self._each)
        known = memory.newer
        whole = zip(parts, bases, ends, strict=True)
        memory.put_all({p: known[b] + known[e] for p, b, e in whole if p not in known})

    def _put(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            self.memory.put_all(dict(zip(some, encode(some), strict=True)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._each(texts)
        low = [t.lower() if _latin(t) else t for t in texts]
        whole = {}
        for k, (text, small) in enumerate(zip(texts, low, strict=True)):
            if any(x in text or x in small for x in self.added):
                whole[k], low[k] = text.replace("\n", " ").split(" "), ""
        words, which, firsts = cut_words(low)
        self._learn(self.memory.missing(set(words).union(*whole.values())))
        known = self.memory.newer
        ids = pa.array([known[w] for w in words], pa.large_binary()).take(which)
        values = b"".join(filter(None, ids.buffers()[2:]))
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids))])[firsts].tolist()
        found = [values[i:j] for i, j in itertools.pairwise(ends)]
        for k, parts in whole.items():
            found[k] = b"".join(map(known.__getitem__, parts))
        return found


def cut_words(texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The distinct words of some texts, which of these each word in turn is, and where each text's words begin, and end at last.

    Words end at spaces and line ends and where ``PUNCTUATION`` follows a letter from a to z.
    """
    sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
    joined = "\n".join([*texts, ""]).encode()
    kinds = np.frombuffer(joined.translate(KINDS), np.uint8)
    inside = kinds != SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (kinds[1:] == MARK) & (kinds[:-1] == LETTER)
    starts = np.flatnonzero(first)
    packed = joined.translate(None, b" \n")
    offsets = np.append(np.flatnonzero(first[inside]), len(packed))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    begins = np.cumsum([0, *(n + 1 for n in sizes)])
    distinct = b"\n".join(words.dictionary.to_pylist()).decode().split("\n") if len(starts) else []
    return distinct, words.indices, np.searchsorted(starts, begins)


def splits_words(file: dict) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded apart: see ``WordIds``."""
    steps = (file.get("normalizer") or {}).get("normalizers") or []
    kinds = [x.get("type") for x in steps]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
        return False
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return cuts[0].get("pattern") == {"Regex": words} and bool(cuts[0].get("invert")) and not cuts[1].get("add_prefix_space")


def takes_letters(file: dict) -> bool:
    """Whether the model of a tokenizer file that ``splits_words`` gets words of letters as a whole and as they are but for their bytes' letters."""
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    whole = splits_words(file) and not cuts[1].get("use_regex", True) and (file.get("model") or {}).get("dropout") is None
    return whole and not any(x["content"].isalpha() for x in file.get("added_tokens") or [])


def _latin(text: str) -> bool:
    """Whether a text has characters of Latin-1 only, whose small forms are the tokenizer's whatever is beside them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _plain(word: str) -> bool:
    """Whether a word is of letters, and also after the tokenizer's normalization, so that punctuation behind it stays apart."""
    return word.isalpha() and (word.isascii() or is_normalized("NFC", word) and word.lower().isalpha())


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer of the file at ``path``."""
    return worker_memory(("word ids", path), lambda: WordIds(path))


def cut(n: int, longest: int = SEQUENCE_TOKENS) -> list[int]:
    """Lengths of the pieces of n tokens: as many of ``longest`` (a power of two) as fit, then the binary digits."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = SEQUENCE_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of each row of ``docs``; a piece is a sequence, and ``bucket`` is its length.

    ``tokenizer`` is the path of a tokenizer file that all executors have (any
    kind; those that take words apart, as ``splits_words`` says, are faster);
    ``end_id`` ends every document. Columns: the id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset (always 0), bucket, and ``ids`` if asked
    for. ``sequence_id`` is unique within the result and follows from the order
    of the input's partitions.

    A null text is as empty: its only piece is the end id. Null ids stay null.
    Repeated rows are packed each for itself. Of an empty table nothing comes
    out. Other columns aren't read. An id that is called like another column of
    the result raises an error.
    """
    if id_col.lower() in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"):
        raise ValueError(f"the id can't be called {id_col}, as a column of the result is")
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if with_ids else ""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for part in slices(texts, SLICE_CHARS):
                row, start, length, crc, total, parts = [], [], [], [], [], []
                for k, ids in enumerate(encode(part), at):
                    ids += end
                    n = len(ids) // 4
                    pos = 0
                    for m in cut(n, longest):
                        piece = ids[4 * pos : 4 * (pos + m)]
                        row.append(k)
                        start.append(pos)
                        length.append(m)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            parts.append(piece)
                        pos += m
                at += len(part)
                columns = [batch.column(0).take(pa.array(row, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                if with_ids:
                    values = np.frombuffer(b"".join(parts), dtype="<i4")
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    found = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).mapInArrow(run, schema)
    return found.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
        *(["ids"] if with_ids else []),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write ``pieces(...)`` as Parquet with a folder for each bucket, as batches are taken from one bucket."""
    packed.write.partitionBy("bucket").parquet(path)
