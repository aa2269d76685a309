"""Small helpers shared by the operators: staged tables, text batches, vocabulary files."""

from __future__ import annotations

import ctypes
import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_path

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: its memory stays with the worker
    _LIBC = None
#: Bytes of text a Python task handles at once; a longer single text is handled alone, whole.
SLICE_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``."""
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage, and fixes once what later passes must agree on (partition numbers, sampled
    range bounds); a lost executor costs no more than its unfinished tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Broadcast values that the session's executors may hold, to be given back by :func:`give_back`.
_LENT: list[tuple[SparkContext, Broadcast]] = []


class _Packed:
    """A value that travels compressed: what is broadcast lies on the disk of every executor."""

    def __init__(self, value: object):
        self.value = value

    def __reduce__(self):
        return _unpacked, (zlib.compress(pickle.dumps(self.value, 5), 1),)


def _unpacked(raw: bytes) -> object:
    return pickle.loads(zlib.decompress(raw))


def lent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that :func:`give_back` takes off the executors; its ``value`` is to be read there."""
    shared = spark.sparkContext.broadcast(_Packed(value))
    _LENT.append((spark.sparkContext, shared))
    return shared


def give_back() -> None:
    """Frees what executors hold of lent values; one that is needed after all is sent again."""
    while _LENT:
        context, value = _LENT.pop()
        if context._jsc is not None:  # else it went with its session
            value.unpersist()


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers live on and serve other steps."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with about ``budget`` bytes in ``column`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + budget, "right")))
        yield batch.slice(start, end - start)
        start = end
    trim()


def column(name: str) -> Column:
    """The column of this very name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_beside(rows: DataFrame, given: dict[str, Column], run: Callable, added: dict[str, str]) -> DataFrame:
    """``rows`` with columns that ``run`` (for ``mapInArrow``) adds.

    ``run`` gets all columns and the ``given`` ones, and yields all but these with the ``added``
    ones (name -> type) at the end.  Columns go by position meanwhile, so any name will do.
    """
    names = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.select("*", *(c.alias(n) for n, c in given.items())).toDF(*names, *given)
    types = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema, strict=True)]
    out = plain.mapInArrow(run, ", ".join([*types, *(f"{n} {t}" for n, t in added.items())]))
    return out.toDF(*rows.columns, *added)


def vocabulary_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies on this machine (installed on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Letters below U+0250 once A-Z and the like are lower-cased (fixed values); others go by their category.
_LOW_LETTERS = re.compile("[a-zªµºß-öø-ɏ]+")
_HIGH = re.compile("[^\\x00-ɏ]")
_ANY_LETTERS = regex.compile(r"\p{L}+")
#: Distinct words, and characters of text, that a task works on together.
GROUP_WORDS = 60_000
GROUP_CHARS = 8 << 20


def letter_words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    if not text:
        return []
    low = text.lower()
    return _ANY_LETTERS.findall(low) if _HIGH.search(low) else _LOW_LETTERS.findall(low)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def word_groups(
    texts: Iterable[str | None], split: Callable[[str | None], list[str]] = letter_words, words: int = GROUP_WORDS, chars: int = GROUP_CHARS
) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Whole texts in groups: a group's distinct words, and each text as numbers of these words.

    What depends on a word alone is then worked out once for the group.
    """
    numbers, group, size = _Numbers(), [], 0
    for text in texts:
        found = split(text)
        group.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        size += len(text or "")
        if len(numbers) >= words or size >= chars:
            yield list(numbers), group
            numbers, group, size = _Numbers(), [], 0
    if group:
        yield list(numbers), group


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end with a 10 after each, as code points; each word's start and length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join([w + "\n" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.cumsum(lengths + 1) - lengths - 1, lengths
