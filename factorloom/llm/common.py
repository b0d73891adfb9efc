"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Rows of texts in a batch for a Python worker.
BATCH_ROWS = 1000
#: White space between words: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers (under 100 bytes each) that may be broadcast; beyond, the join shuffles.
LIGHT_ROWS = 400_000
#: A key is hot if it has over a part in so many of all rows; so there are never more hot keys than this.
HOT_KEYS = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to understand.

    Rows hold whole texts, so the batches that go to Python workers are set to
    hold few of them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where ``spark.checkpoint.dir`` is unset a temporary folder is set, but only
    for a session that runs in one process, as in tests; elsewhere this is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared folder; goes from there when nothing refers to it and the session cleans checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_written: dict[str, list[str]] = {}


def stored(df: DataFrame, places: list[str] | None = None, level: int = 3) -> DataFrame:
    """``df``, written once as compressed Parquet into the shared folder; it stays there until ``forget``, ``clear_stored`` or until the folder is cleared.

    places: gets where it is, for ``forget``; level: of compression, 1 for what is mostly hashes.
    """
    folder = shared_folder(df.sparkSession)
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    _written.setdefault(folder, []).append(path)
    if places is not None:
        places.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` wrote for this session; results that were built on it must have been written before."""
    forget(spark, _written.pop(shared_folder(spark), []))


def forget(spark: SparkSession, places: list[str]) -> None:
    """Delete what ``stored`` wrote at some places, which nothing needs any more."""
    for p in places:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], count: str, narrow: bool = True) -> DataFrame:
    """``left`` and ``right`` joined on ``key``, whose rows in ``left`` may be dealt as unevenly as can be.

    ``right`` has a row for each key and in ``count`` how many rows of ``left``
    have it. Keys with over a part in ``HOT_KEYS`` of all rows, at most as many
    as that, are broadcast, so their rows stay where they are; so are all if
    ``right`` is ``narrow``, of few numbers, and short. ``left`` is read twice,
    ``right`` three times. The count isn't in the result.
    """
    total, n = right.agg(F.coalesce(F.sum(count), F.lit(0)), F.count("*")).first()
    if narrow and n <= LIGHT_ROWS:
        return left.join(F.broadcast(right), key).drop(count)
    hot = F.broadcast(right.filter(F.col(count) * HOT_KEYS > total))
    cold = right.filter(F.col(count) * HOT_KEYS <= total)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest).drop(count)


def light(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows of a few numbers, to be broadcast if these are few."""
    return F.broadcast(df) if n <= LIGHT_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_kept: dict[object, object] = {}


def worker_memory(key: object, make: Callable[[], T]) -> T:
    """What ``make`` makes, kept by this Python worker until something with another key is asked for.

    Workers serve one query after the other, so what one operator remembers
    must not stay beside what the next does. Operators that remember nothing
    ask for nothing, under a key of their own.
    """
    if key not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


class WordMemory:
    """What is known of words, in two halves of at most ``max_bytes`` together, as estimated from lengths.

    When the newer half is full the older one is forgotten; words that are met
    again move to the newer. Words over ``longest`` characters aren't kept.
    """

    #: Beside its characters a word takes about so much: two objects and the place in the table.
    EACH = 230

    def __init__(self, max_bytes: int, longest: int = 200):
        self.half, self.longest = max_bytes // 2, longest
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.passing: list[str] = []

    def missing(self, words: set[str]) -> list[str]:
        """Those of the words that aren't known; the known ones are in ``newer`` from then on."""
        for w in self.passing:
            self.newer.pop(w, None)
        self.passing = []
        if self.size > self.half:
            self.older, self.newer, self.size = self.newer, {}, 0
        absent, older = words.difference(self.newer), self.older
        known = {w: older[w] for w in absent if w in older}
        self.put_all(known)
        return list(absent.difference(known))

    def put(self, word: str, known: bytes) -> None:
        """Remember a word, a long one only until ``missing`` is called again."""
        self.newer[word] = known
        if len(word) > self.longest:
            self.passing.append(word)
        else:
            self.size += self.EACH + len(word) + len(known)

    def put_all(self, known: dict[str, bytes]) -> None:
        """``put`` of all of these."""
        self.newer.update(known)
        self.size += self.EACH * len(known) + sum(map(len, known)) + sum(map(len, known.values()))
        for w in [w for w in known if len(w) > self.longest]:
            self.passing.append(w)
            self.size -= self.EACH + len(w) + len(known[w])


def slices(texts: Sequence[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive runs of ``texts`` of about ``chars`` characters, so that what is built from a run stays small."""
    run: list[str] = []
    total = 0
    for text in texts:
        run.append(text)
        total += len(text)
        if total >= chars:
            yield run
            run, total = [], 0
    if run:
        yield run
