"""Pack documents into sequences: sets of up to three pieces fixed by dominance, best fit for the rest.

Only the numbers of pieces per length matter, at most one per length up to the
capacity, so the instance the driver solves doesn't grow with the table. The
solution says for ranges of ranks within a length which sequences they go to.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapsekit.llm.buffers import parts, tidy
from lapsekit.session import stage

CAPACITY = 2048
#: Parts in which the pieces of one length are numbered side by side.
SALTS = 256
END = 0
VOCABULARY = "byte_bpe_50k.json"


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary as ranks of byte strings, and the texts that stand for one id."""

    ranks: dict[bytes, int]
    special: tuple[str, ...]
    path: str | None


def byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a ``tokenizers`` file; by default the 50k byte-level one of the installed package.

    Its merges have to be numbered in the order in which they apply, so that
    the id of a merged string is its rank.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        content = json.load(file)
    ids, letters = content["model"]["vocab"], byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    order = [ids["".join(m)] for m in merges]
    if content["model"]["type"] != "BPE" or order != sorted(order):
        raise ValueError(f"{path}: not a vocabulary of merges in the order of their ids")
    special = tuple(t["content"] for t in content["added_tokens"])
    ranks = {bytes(letters[c] for c in token): i for token, i in ids.items() if token not in special}
    return Vocabulary(ranks, special, path)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes; nothing is kept from text to text.

    The merges run in ``tiktoken``, which needs about a third of the time
    ``tokenizers`` does for the same ids. Two kinds of text go to ``tokenizers``
    itself: those that hold a special token, and those with a run of white space
    so long that the other's pattern can't be matched.
    """

    WHITE_RUN = re.compile(r"\s{2048}")

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import tiktoken

        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.whole = None

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.vocabulary.special) or self.WHITE_RUN.search(text):
            if self.whole is None:
                import public_tokenizers
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.vocabulary.path or public_tokenizers.path(VOCABULARY))
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def piece_bounds(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all but the first are full."""
    first = (n - 1) % capacity + 1 if n else 0
    start = 0
    while start < n:
        length = first if start == 0 else capacity
        yield start, length
        start += length


def tokenized_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit bytes).

    A document is the ids of its text and the id 0 at the end; null text is
    empty, so its only id is 0. ``vocabulary`` (a file that all executors have)
    and ``pattern`` default to the 50k byte-level vocabulary of the installed package.
    """
    fields = f"key {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = [part.split()[0] for part in fields.split(", ")] + ["ids"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    words = read_vocabulary(vocabulary)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = Encoder(words, pattern or public_tokenizers.PATTERN)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for some in parts(batch, 1):
                of, out = [], []
                for row, text in enumerate(some.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for i, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        of.append(row)
                        out.append((i, start, length, zlib.crc32(part), *([part] if with_ids else [])))
                columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)]
                # Keys are taken as they are: ids beyond 2 ** 53 and null ones stay apart.
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of, pa.int32())), *columns], names=names)

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(pieces), fields + ", ids binary" * with_ids)


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``rank`` fill ``each`` places in every of ``bins`` sequences."""

    length: int
    rank: int
    first: int
    bins: int
    each: int
    offset: int


def _best_two(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum within ``room`` of two pieces; 0 if no two fit. ``sizes``: ascending lengths with a count."""
    at = np.searchsorted(sizes, room - sizes, side="right") - 1
    own = np.arange(len(sizes))
    at = np.where((at == own) & (counts[sizes] < 2), at - 1, at)
    fits = (at >= 0) & (sizes + sizes[np.maximum(at, 0)] <= room)
    return int((sizes + sizes[np.maximum(at, 0)])[fits].max(initial=0))


def _fixed_set(size: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """The pieces that go with a longest piece of ``size`` without need of more sequences; None if that isn't proved.

    At most ``k`` other pieces fit with it. With k = 0 it is alone. The longest
    piece that fits, the partner, is right if it fills the sequence, if k = 1,
    or if k = 2 and it is as long as any two together. With k = 2 the partner
    and the longest piece that still fits are right if no two pieces longer
    than that one, but shorter than the partner, fit together: then every other
    choice can be exchanged piece by piece for shorter ones.
    """
    room = capacity - size
    others = left.copy()
    others[size] -= 1
    sizes = np.flatnonzero(others[: room + 1])
    if not len(sizes):
        return ()
    partner = int(sizes[-1])
    if partner == room:
        return (partner,)
    least = np.repeat(sizes[:3], np.minimum(others[sizes[:3]], 3))[:3]
    k = int((np.cumsum(least) <= room).sum())
    if k == 1 or (k == 2 and partner >= _best_two(sizes, others, room)):
        return (partner,)
    if k > 2:
        return None
    others[partner] -= 1
    third = np.flatnonzero(others[: room - partner + 1])
    if not len(third):
        return None
    between = np.flatnonzero(others[int(third[-1]) + 1 : partner])[:2] + int(third[-1]) + 1
    two = np.repeat(between, np.minimum(others[between], 2))[:2]
    return (partner, int(third[-1])) if len(two) < 2 or two.sum() > room else None


def _sets_left(sizes: tuple[int, ...], left: np.ndarray) -> int:
    """How many sets of these sizes the pieces that are left make."""
    return min(int(left[s]) // sizes.count(s) for s in sizes)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, reduce_only: bool = False) -> list[Run]:
    """Sequences for ``counts`` pieces of each length, as runs. Sequence numbers are gapless from 0.

    Reduction, from the longest piece: sets of one, two or three pieces that
    no other choice beats are fixed (``_fixed_set``), until nothing changes.
    Best fit for the rest: longest first, into the least room.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] += n
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    bins = 0

    def place(length: int, first: int, n: int, each: int, offset: int) -> None:
        if n:
            runs.append(Run(length, used[length], first, n, each, offset))
            used[length] += n * each
            left[length] -= n * each

    longest_first = [int(s) for s in np.flatnonzero(left)[::-1]]
    changed = True
    while changed:
        changed = False
        for size in longest_first:
            while left[size] and (found := _fixed_set(size, left, capacity)) is not None:
                whole = (size, *found)
                n, offset = _sets_left(whole, left), 0
                for own in dict.fromkeys(whole):
                    place(own, bins, n, whole.count(own), offset)
                    offset += own * whole.count(own)
                bins += n
                changed = True
    if reduce_only:
        return runs

    # Groups of sequences with equal room: (first, how many), by room.
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for size in longest_first:
        while left[size]:
            n = int(left[size])
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = min(n, capacity // size)
                whole = n // each
                place(size, bins, whole, each, 0)
                add(capacity - each * size, bins, whole)
                bins += whole
                continue
            room = rooms[i]
            first, m = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            each = min(room // size, n)
            full = min(m, n // each)
            place(size, first, full, each, capacity - room)
            add(room - each * size, first, full)
            add(room, first + full, m - full)
    return runs


def _ranked(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` with ``_rank`` from 0 within their length, numbered in salted parts and offset by their counts."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    order = Window.partitionBy("length").orderBy("_salt")
    before = salted.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(order) - F.col("count"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    return salted.withColumn("_number", number).join(before.drop("count"), ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.col("_number")
    )


def pack_pieces(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) and their sequence_id and offset.

    ``keys`` order the pieces of one length; equal rows get a place each.
    ``pieces`` is read more than once, so it has to be stored.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = pack_lengths(counts, capacity)
    schema = "length bigint, _from bigint, _first bigint, _bins bigint, _each bigint, _offset bigint"
    plan = spark.createDataFrame([(r.length, r.rank, r.first, r.bins, r.each, r.offset) for r in runs], schema)
    # A length's runs as one sorted array: the plan has a row per length, at most ``capacity``.
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_first", "_bins", "_each", "_offset"))).alias("_runs"))
    run = F.element_at(F.filter("_runs", lambda r: r["_from"] <= F.col("_rank")), -1)
    placed = _ranked(pieces, keys).join(F.broadcast(plan), "length").withColumn("_run", run)
    within = F.col("_rank") - F.col("_run._from")
    return placed.withColumn("_within", within).select(
        *pieces.columns,
        (F.col("_run._first") + F.expr("_within div _run._each")).alias("sequence_id"),
        (F.col("_run._offset") + F.col("length") * F.expr("_within % _run._each")).alias("offset"),
    )


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece of the documents: key, piece, start, length, ids_crc32, sequence_id, offset (and ids with ``with_ids``).

    Repeated rows and null keys are packed like any other; an empty table gives
    no row. Columns of ``df`` other than key and text are left out.
    """
    pieces = stage(tokenized_pieces(df, key, text, capacity, **options), "pieces")
    packed = pack_pieces(pieces, ["key", "piece", "ids_crc32"], capacity)
    return packed.withColumnRenamed("key", key)
