"""Removal of lines that stand elsewhere already, also with small differences.

Lines are normalised (lower case, single spaces). Equal ones are one by a
128-bit hash. Each distinct line of enough words gets a SimHash in blocks: a
block's bits are voted on by some of the line's words only, so an edit leaves
most blocks as they are. Lines that agree on a block are candidates (pigeonhole);
their edit similarity is verified, links are joined to groups, and of each group
the first occurrence stays.

A block's words are a few in a row, counted from either end of the line, so an
edit changes the block that it stands in, and one that moves other words leaves
those from one end. Three or four blocks from either end are enough for a line of any
length. Lines of few words are cut into halves as well, in which every single
edit leaves one as it is. In longer lines, whose ends alone may differ, words
also vote in blocks that a hash of the word tells; how many there are follows
from the number of words, and lines that a shorter near copy may have fewer of
get those for its number too. The README has the shares of links found.

Texts are read once for hashes and blocks, then only for the lines that are
candidates, and for the result. Between, only numbers are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import durable, fresh, join_hot, light, quoted, slices, stored, worker_memory
from factorloom.llm.components import Nearness, as_binary, linked_in_cells, shared_cells

#: The number of whose powers the 64-bit hash of a word is made, and that which undoes one.
BASE = 0xD1342543DE82EF95
DOWN = pow(BASE, -1, 2**64)
#: Bytes that are hashed at a time, and the powers from 0 up to so many.
HASHED_BYTES = 1 << 17
POWERS, POWERS_DOWN = (np.cumprod(np.append(np.uint64(1), np.full(HASHED_BYTES, x, dtype=np.uint64))) for x in (BASE, DOWN))
#: Lines of under so many words are also cut into halves, as are lines of a word fewer.
HALVED = 15
#: Words in a row that make up a block, the numbers of words of the lines that have such, from and to under, and how many of them from either end.
IN_A_ROW = ((3, 8, 25, 4), (4, 12, 25, 4), (4, 25, np.inf, 3))
#: Lines of so many words or more have blocks of words by their hashes too; so many are used.
HASHED, USED = 25, 5
#: The least number of words of the next class of line lengths is so many times that of a class; words in a block of its shortest lines.
RATIO, WORDS_PER_BLOCK = 1.6, 3.4
#: Shorter words, as articles and prepositions are, have no vote by hash, unless they are over two thirds of a line's; a block has two votes or more.
VOTING_CHARS, LEAST_VOTES = 4, 2
#: Characters of texts whose words are told apart together, about.
SLICE = 3_000_000
#: White space other than the space and the line feed; with a part of it that is ASCII.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
ASCII_SPACES = "".join(c for c in SPACES if c.isascii())
#: Lines that a task remembers so that repeated ones give their blocks once.
REMEMBERED = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normalised(line: str) -> str:
    """A line in lower case, white space as single spaces, none at its ends."""
    return " ".join(line.lower().split())


def is_plain(text: str) -> bool:
    """Whether the lines of a text have single spaces between words and no other white space, but for spaces at their ends."""
    return "  " not in text and not any(c in text for c in (ASCII_SPACES if text.isascii() else SPACES))


def blocks_of(classes: np.ndarray) -> np.ndarray:
    """How many blocks by hash lines of each class of lengths have."""
    return np.round(HASHED * RATIO**classes / WORDS_PER_BLOCK).astype(np.int64)


def votes(hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SimHash of each run of words: of each bit of their hashes (by code) whether over half of the words have it."""
    counts = np.diff(np.append(starts, len(codes)))
    out = np.zeros(len(starts), dtype=np.uint64)
    for count in np.unique(counts).tolist() if len(starts) else ():
        where = np.flatnonzero(counts == count)
        first = starts[where]
        # how often each bit is set, as a number whose digits are the same bit of some words
        digits: list[np.ndarray] = []
        for k in range(count):
            carry = hashes[codes[first + k]]
            for d, digit in enumerate(digits):
                digits[d], carry = digit ^ carry, digit & carry
            if len(digits) < (k + 1).bit_length():
                digits.append(carry)
        # that number over half of the count, from the last digit on
        over = np.zeros(len(where), dtype=np.uint64)
        for d, digit in enumerate(digits):
            over = digit & over if count // 2 >> d & 1 else digit | over
        out[where] = over
    return out


def mixed(prints: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """One number for a fingerprint and what kind of block has it."""
    x = (prints ^ (kind.astype(np.uint64) * MIX[0])) * MIX[1]
    return (x ^ (x >> np.uint64(29))) * MIX[0]


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketches of lines of so many words: 128 to 8192."""
    return 128 << np.clip(np.floor(np.log2(np.maximum(sizes, 1) / 64 + 1e-9)), 0, 6).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from starts to ends, ascending, in bytes: a polynomial of its bytes, from sums over all bytes before its ends."""
    sums = [np.empty(len(starts), dtype=np.uint64) for _ in range(2)]
    low = np.zeros(HASHED_BYTES + 1, dtype=np.uint64)
    back = np.empty(len(starts), dtype=np.uint64)
    before, scale, down = 0, 1, 1
    for first in range(0, len(data), HASHED_BYTES):
        n = min(HASHED_BYTES, len(data) - first)
        np.cumsum(np.multiply(data[first : first + n], POWERS[:n], dtype=np.uint64), out=low[1 : n + 1])
        for found, places, off in zip(sums, (starts, ends), (0, 1), strict=True):
            own = slice(*np.searchsorted(places, (first + off, first + n + off)))
            found[own] = low[places[own] - first] * np.uint64(scale) + np.uint64(before)
            if not off:
                back[own] = POWERS_DOWN[places[own] - first] * np.uint64(down)
        before = (before + int(low[n]) * scale) % 2**64
        scale, down = (x * pow(y, HASHED_BYTES, 2**64) % 2**64 for x, y in ((scale, BASE), (down, DOWN)))
    x = (sums[1] - sums[0]) * back
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[0]
    return x ^ (x >> np.uint64(32))


def line_blocks(lines: list[list[str]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each key, keys, sketches) of lines of words; lines that agree on a block have a key in common.

    A sketch has a bit for whether an odd number of a line's words have the
    last bits of their hashes; an edit changes two of its bits at most. There
    are 128 bits, or more in a line of 128 words or more, so that they are twice
    its words at least, or nearly.
    """
    return _blocks([" ".join(x).encode() for x in lines], np.array(list(map(len, lines)), dtype=np.int64), least)


def _blocks(lines: list[bytes], sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(lines), dtype=np.uint8)
    spaces = np.flatnonzero(data == 32)
    first_byte, end_byte = (np.append(0, spaces + 1), np.append(spaces, len(data))) if len(lines) else (spaces, spaces)
    hashes = word_hashes(data, first_byte, end_byte)
    chars = end_byte - first_byte
    further = data & 0xC0 == 0x80  # bytes that go on with a character
    if further.any():
        chars = chars - np.bincount(np.searchsorted(first_byte, np.flatnonzero(further), side="right") - 1, minlength=len(chars))
    line = np.repeat(np.arange(len(sizes)), sizes)
    wide = sketch_bits(sizes)
    from_bit = np.cumsum(wide) - wide
    at = from_bit[line] + (hashes.view(np.int64) & (wide[line] - 1))
    odd = (np.bincount(at, minlength=int(wide.sum())) & 1).astype(np.uint8)
    sketches = np.packbits(odd).view(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    ends = np.cumsum(sizes)

    def rows(some: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> None:
        """The blocks of the words from start to end of some lines."""
        size = end - start
        first = np.cumsum(size) - size
        inside = np.repeat(start - first, size) + np.arange(size.sum())
        found.append((some, mixed(votes(hashes, inside, first), kind)))

    # halves of lines of few words, as the lines that have as many words or one fewer are cut
    for fewer in (0, 1):
        some = np.flatnonzero((sizes < HALVED) & (sizes - fewer > 1))
        n, start, end = sizes[some] - fewer, ends[some] - sizes[some], ends[some]
        rows(some, start, start + n // 2, 2 * n << 8)
        rows(some, end - (n - n // 2), end, 2 * n + 1 << 8)

    # words in a row from either end
    for width, low, high, from_end in IN_A_ROW:
        for k in range(from_end):
            some = np.flatnonzero((sizes >= max(low, (k + 1) * width)) & (sizes < high))
            start = ends[some] - sizes[some] + k * width
            rows(some, start, start + width, np.full(len(some), width))
            some = some[sizes[some] % width > 0]  # else these blocks are those from the start
            rows(some, ends[some] - (k + 1) * width, ends[some] - k * width, np.full(len(some), width))

    # blocks by the words' hashes; each word of a line votes once, however often it stands there
    own = np.floor(np.log(sizes / HASHED) / np.log(RATIO) + 1e-9).astype(np.int64)
    longer = chars >= VOTING_CHARS
    few = 3 * np.bincount(line[longer], minlength=len(sizes)) < sizes
    top = (hashes >> np.uint64(32)).view(np.int64)
    kinds, most = [own, own + 1], []  # of each line the hashes up to which words are in a block that is used
    for further, kind in enumerate(kinds):
        taken = (kind >= 0) & (sizes >= (least if further else 1) * HASHED * RATIO ** kind.astype(np.float64) - 1e-9)
        most.append(np.where(taken, ((USED << 32) - 1) // np.maximum(blocks_of(kind), 1), -1))
    chosen = np.flatnonzero((top <= np.maximum(*most)[line]) & (longer | few[line]))
    word = chosen[~pd.Series(hashes[chosen] + mixed(line[chosen].view(np.uint64), line[chosen])).duplicated().to_numpy()]
    owner, top = line[word], top[word]
    for kind, low in zip(kinds, most, strict=True):
        where = np.flatnonzero(top <= low[owner])
        if not len(where):
            continue
        cell = owner[where] * USED + (top[where] * blocks_of(kind)[owner[where]] >> 32)
        order = np.argsort(cell, kind="stable")
        cell, code = cell[order], word[where][order]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        enough = np.diff(np.append(starts, len(cell))) >= LEAST_VOTES
        at, of = cell[starts] // USED, cell[starts] % USED
        found.append((at[enough], mixed(votes(hashes, code, starts), 1 << 20 | kind[at] * USED + of)[enough]))
    at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    keys = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
    order = np.argsort(at, kind="stable")
    return at[order], keys[order].view(np.int64), sketches


def line_marks(texts: list[str], min_words: int, least: float, seen: list[set[bytes]]) -> list[pa.Array]:
    """For some texts the (pos, u, v) of every line that has a word, and the (pos, u, w, s, keys) of those that are compared.

    u and v are the line's hash. Only lines of ``min_words`` words or more are
    compared, of equal ones only the first that isn't in ``seen``: w is the
    number of words, s a sketch. Sketches and keys are longs in a binary.
    """
    pos, hashes, new, lines, counts, ends, new_ends = [], [], [], [], [], [0], [0]
    digest = xxhash.xxh3_128_digest
    for text in texts:
        low = text.lower()
        plain = is_plain(low)
        for j, line in enumerate(low.split("\n")):
            normal = line.strip(" ") if plain else " ".join(line.split())
            if not normal:
                continue
            data = normal.encode("utf-8", "replace")
            h = digest(data)
            n = normal.count(" ") + 1
            if n >= min_words and h not in seen[0] and h not in seen[1]:
                if len(seen[0]) >= REMEMBERED // 2:
                    seen[1] = seen[0]
                    seen[0] = set()
                seen[0].add(h)
                new.append(len(pos))
                lines.append(data)
                counts.append(n)
            pos.append(j)
            hashes.append(h)
        ends.append(len(pos))
        new_ends.append(len(new))
    w = np.array(counts, dtype=np.int32)
    at, keys, sketches = _blocks(lines, w.astype(np.int64), least)
    pos, both = np.array(pos, dtype=np.int32), np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
    u, v = both[:, 0].copy(), both[:, 1].copy()
    all_rows = pa.StructArray.from_arrays(list(map(pa.array, (pos, u, v))), ["pos", "u", "v"])
    longs = [as_binary(x, n) for x, n in ((sketches, sketch_bits(w) // 64), (keys, np.bincount(at, minlength=len(lines))))]
    new_rows = pa.StructArray.from_arrays([pa.array(pos[new]), pa.array(u[new]), pa.array(w), *longs], ["pos", "u", "w", "s", "keys"])
    return [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((ends, all_rows), (new_ends, new_rows))]


def with_marks(docs: DataFrame, text_col: str, marks: str, compared: str, min_words: int, least: float) -> DataFrame:
    """``docs`` and columns of the marks of each text's lines: an array of (pos, u, v) and one of (pos, u, w, s, keys) of lines that are compared."""
    kind = "array<struct<pos:int,u:bigint,v:bigint>>"
    kind_compared = "array<struct<pos:int,u:bigint,w:int,s:binary,keys:binary>>"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("line marks", lambda: None)
        seen: list[set[bytes]] = [set(), set()]  # of this attempt only: what is left out must have been given by it
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            done = 0
            for part in slices(texts, SLICE):
                own = batch.slice(done, len(part))
                done += len(part)
                yield pa.RecordBatch.from_arrays([*own.columns, *line_marks(part, min_words, least, seen)], [*batch.schema.names, marks, compared])

    schema = docs.select("*", F.lit(None).cast(kind).alias(marks), F.lit(None).cast(kind_compared).alias(compared)).schema
    return docs.mapInArrow(run, schema)


def edits(a: list[str], b: list[str], most: int) -> int:
    """Words that are inserted, left out or replaced between two lines; over ``most`` any number over it."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    same, most_same = 0, end - start
    while same < most_same and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b = a[start : len(a) - same], b[start : len(b) - same]
    if not a or not b or abs(len(a) - len(b)) > most:
        return max(len(a), len(b))
    if max(len(a), len(b)) == 1:
        return 1
    # one column of the table at a time, as the bits of two numbers: where it goes up by one, where down
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    if len(b) - sum(map(where.__contains__, b)) > most:  # each of these words takes an edit
        return len(b)
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    limit = most + len(b)  # each word of b that is left takes one off the score at most
    for w in b:
        equal = where.get(w, 0)
        level = ((equal & up) + up ^ up) | equal | down
        rise, fall = down | ~(level | up) & mask, up & level
        score += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & mask
        up, down = (fall << 1 | ~(level | rise)) & mask, rise & level
        limit -= 1
        if score > limit:
            return max(score, most + 1)
    return score


def similar(a: str, b: str, least: float) -> bool:
    """Whether two normalised lines' edit similarity, 1 - edits / words of the longer, is at least ``least``."""
    x, y = a.split(" "), b.split(" ")
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if len(x) == len(y) and sum(map(ne, x, y)) <= most:  # replacements alone are enough
        return True
    return edits(x, y, most) <= most


def lines_gone(rows: DataFrame, marks: str, compared: str, row: str, order: list[Column], text: Column, least: float) -> DataFrame:
    """(row, pos) of each occurrence of a line that goes, as one of its group comes before it.

    rows: documents with ``marks`` and ``compared``, a number ``row`` of their
    own and a text; order: what comes first of a group, before row and place.
    """
    copies = durable(rows.select(F.inline(marks)).groupBy("u").agg(F.count("*").alias("n")).filter("n > 1"))
    marked = rows.select(F.col(row).alias("_row"), F.inline(compared))

    def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        edits_most = np.floor((1 - least) * np.maximum(a, b) + 1e-9)
        return np.where(np.abs(a - b) <= edits_most, 2 * edits_most, -1)

    nearness = Nearness(bits)

    def line_texts(needed: DataFrame) -> DataFrame:
        at = marked.select("u", "_row", F.col("pos").alias("_pos")).join(light(needed, needed.count()), "u").dropDuplicates(["u"])
        at = durable(at.groupBy("_row").agg(F.collect_list(F.struct("_pos", "u")).alias("_at")))
        texts = rows.select(F.col(row).alias("_row"), text.alias("_text")).join(light(at, at.count()), "_row")
        return texts.select("_text", "_at").mapInArrow(_lines_at, "u long, x string, bytes int")

    sketched = marked.select("u", F.col("w").alias("size"), "s")
    cells = shared_cells(marked.select("u", F.col("keys").alias("cells")))
    roots = linked_in_cells(cells, sketched, nearness, line_texts, lambda x, y: similar(x, y, least)).toDF("u", "root")
    # lines without near copies that agree in half of the hash only are no group: v tells them apart
    groups = durable(copies.join(roots, "u", "full").select("u", F.coalesce("n", F.lit(1)).alias("n"), "root"))
    places = [x.alias(f"_o{k}") for k, x in enumerate(order)]
    lines = rows.select(F.col(row).alias("row"), *places, F.inline(marks))
    found = join_hot(lines, groups, "u", "n").withColumns({"v": F.when(F.col("root").isNull(), F.col("v")).otherwise(0), "root": F.coalesce("root", "u")})
    place = F.struct(*[f"_o{k}" for k in range(len(order))], "row", "pos")
    found = stored(found.select("root", "v", place.alias("place")))
    keep = durable(found.groupBy("root", "v").agg(F.min("place").alias("keep"), F.count("*").alias("k")).filter("k > 1"))
    return join_hot(found, keep, ["root", "v"], "k").filter("place.row <> keep.row or place.pos <> keep.pos").select("place.row", "place.pos")


def _lines_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts and the (pos, u) of some of their lines each (u, normalised line, its length)."""
    for batch in batches:
        found: list[tuple[int, str]] = []
        for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = text.split("\n")
            found += [(x["u"], normalised(own[x["_pos"]])) for x in at]
        us, lines = [x for x, _ in found], [x for _, x in found]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(lines, pa.string()), pa.array(list(map(len, lines)), pa.int32())], ["u", "x", "bytes"])


def _without(text: Column, drop: Column) -> Column:
    """A text without the lines at some places; null where these are null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            out = []
            for t, d in zip(texts, places, strict=True):
                gone = () if d is None else set(np.asarray(d).tolist())
                out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else None)
            yield pd.Series(out, dtype=object)

    return run(F.when(drop.isNotNull(), text), drop)  # other texts needn't go to Python


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without lines that are copies or near copies of another, and n_removed, the number of lines that went.

    Lines end at line feeds. Two lines are linked if they are equal once
    normalised, or if both have ``min_words`` words or more and the edit
    similarity of their words is at least ``least``, which must be 0.8 or more;
    see the module on how these are found. Of each group that links connect the
    occurrence with the least id stays, then the one in the first row, then the
    first in its text; the others are cut out of their texts with their line
    end. Lines without a word always stay. Lines are known by 128 bits of hash,
    in the search for near copies by 64.

    Null texts stay null and have no line. Null ids come last. Repeated rows
    are different documents, so the later one's lines go. Of an empty table
    nothing comes out. All columns stay; one that is called n_removed is
    replaced.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("similar lines are found from 0.8 on")
    names = [c for c in docs.columns if c.lower() != "n_removed"]
    row, marks, compared, drop = fresh(docs, "_row", "_marks", "_compared", "_drop")
    rows = docs.select(*map(quoted, names)).withColumn(row, F.monotonically_increasing_id())
    rows = stored(with_marks(rows, text_col, marks, compared, max(2, min_words), least), level=1)
    order = [quoted(id_col).isNull(), quoted(id_col)]
    gone = lines_gone(rows, marks, compared, row, order, quoted(text_col), least)
    gone = durable(gone.groupBy(F.col("row").alias(row)).agg(F.collect_list("pos").alias(drop)))
    found = rows.drop(marks, compared).join(light(gone, gone.count()), row, "left")
    text = F.when(F.col(drop).isNull(), quoted(text_col)).otherwise(_without(quoted(text_col), F.col(drop)))
    kept = [(text.alias(c) if c == text_col else quoted(c)) for c in names]
    return found.select(*kept, F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"))
