"""Exact duplicates by an exchange of compressed fingerprints.

Every task sends the sorted fingerprints of its texts, Golomb-coded, to the
owners of their ranges. An owner answers each message with a bitmap of the
fingerprints that another message holds too. Only texts marked so, or equal to
one of the same message, are suspects; their full digests and then their bytes
are compared. A fingerprint is in a message once, so a text of any number of
copies costs an owner one number per message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm import golomb
from lapsekit.llm.buffers import tidy
from lapsekit.session import stage

#: Texts in a message's block: what a task holds in memory at once, 40 bytes each.
BLOCK = 500_000
#: Fingerprints that an owner decodes at once, on average.
PER_OWNER = 500_000
LEAST_OWNERS = 24
#: Bits of a fingerprint beyond those that number the texts: a chance pair in 2 ** 14 texts is a suspect too many.
SPARE_BITS = 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests up to this number (32 bytes each) are sent to all executors to find the suspects' texts, and groups to find
#: their rows; of more groups those with this part of all rows or a larger one, which can't be more, and the rest is joined.
BROADCAST_DIGESTS = 500_000

_ROWS = "key string, digest binary, sender bigint, block int, owner int, at int, twin boolean, size int, remainder int, payload binary"


def normalised(text: Column) -> Column:
    """The text by which rows are compared: A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _digest(text: str | None) -> bytes:
    # Lower-casing bytes changes A-Z only.
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def _send(bits: int, owners: int):
    """Function of Arrow batches (key, text): a row per text, and a message per block and owner."""
    names = [part.split()[0] for part in _ROWS.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    width = -(-(1 << bits) // owners)

    def table(key_type: pa.DataType, n: int, **columns) -> pa.RecordBatch:
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, [key_type, *types])])
        return pa.RecordBatch.from_arrays(
            [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def block_rows(keys: list[pa.Array], digests: list[bytes], sender: int, block: int) -> Iterator[pa.RecordBatch]:
        n = len(digests)
        top = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64) >> np.uint64(64 - bits)
        values, which, counts = np.unique(top, return_inverse=True, return_counts=True)
        owner_of = (values // np.uint64(width)).astype(np.int32)
        present, first, sizes = np.unique(owner_of, return_index=True, return_counts=True)
        at = np.arange(len(values)) - np.repeat(first, sizes)
        same = lambda value, as_type: pa.array(np.full(n, value), as_type)
        kind = keys[0].type
        rows = table(
            kind, n, key=pa.concat_arrays(keys), digest=pa.array(digests, pa.binary()), sender=same(sender, pa.int64()),
            block=same(block, pa.int32()), owner=pa.array(owner_of[which]), at=pa.array(at[which].astype(np.int32)),
            twin=pa.array(counts[which] > 1),
        )
        for start in range(0, n, 10_000):
            yield rows.slice(start, 10_000)
        remainders = [golomb.parameter(width, int(s)) for s in sizes]
        m = len(present)
        yield table(
            kind, m, sender=pa.array(np.full(m, sender), pa.int64()), block=pa.array(np.full(m, block), pa.int32()),
            owner=pa.array(present), size=pa.array(sizes.astype(np.int32)), remainder=pa.array(remainders, pa.int32()),
            payload=pa.array(
                [
                    golomb.encode(values[f : f + s] - np.uint64(int(o) * width), r)
                    for o, f, s, r in zip(present, first, sizes, remainders)
                ],
                pa.binary(),
            ),
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, block = TaskContext.get().partitionId(), 0
        keys, digests = [], []
        for batch in batches:
            keys.append(batch.column(0))
            digests.extend(_digest(text.as_py()) for text in batch.column(1))
            if len(digests) >= BLOCK:
                yield from block_rows(keys, digests, sender, block)
                keys, digests, block = [], [], block + 1
        if digests:
            yield from block_rows(keys, digests, sender, block)

    return send


def _answer(messages: pa.Table) -> pa.Table:
    """One owner: for each message the bitmap of the fingerprints that are in another message too."""
    sizes = messages["size"].to_pylist()
    decoded = [
        golomb.decode(p, n, r)
        for p, n, r in zip(messages["payload"].to_pylist(), sizes, messages["remainder"].to_pylist())
    ]
    _, which, counts = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
    marks = np.split(counts[which] > 1, np.cumsum(sizes)[:-1])
    return messages.select(["sender", "block", "owner"]).append_column("marks", pa.array([np.packbits(m).tobytes() for m in marks], pa.binary()))


def fingerprint_rows(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, digest, uid) of all rows, and those of them that may have an equal."""
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = slim.count()
    bits = min(63, max(total, 1).bit_length() + SPARE_BITS)
    owners = max(LEAST_OWNERS, -(-total // PER_OWNER))
    schema = _ROWS.replace("key string", f"key {slim.schema['key'].dataType.simpleString()}")
    sent = stage(slim.mapInArrow(tidy(_send(bits, owners)), schema), "fingerprints")
    messages = sent.filter("payload IS NOT NULL").select("sender", "block", "owner", "size", "remainder", "payload")
    answers = messages.groupBy("owner").applyInArrow(_answer, "sender bigint, block int, owner int, marks binary")
    rows = sent.filter("digest IS NOT NULL")
    uid = F.struct("sender", "block", "owner", "at").alias("uid")
    # Bit ``at`` of the bitmap; Spark has no direct access to a byte of a binary.
    byte = F.conv(F.hex(F.substring("marks", F.expr("at div 8 + 1"), F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(128, at % 8)").bitwiseAND(byte) != 0
    suspects = rows.join(answers, ["sender", "block", "owner"]).filter(F.col("twin") | marked).select("key", "digest", uid)
    return rows.select("key", "digest"), suspects


def duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, digest) of all rows, and per text that stands more than once: digest, keep_key, group_size.

    The bytes of all texts of a group are compared; a digest shared by two
    different texts stops the query.
    """
    rows, suspects = fingerprint_rows(df, key, text)
    counted = suspects.groupBy("digest").agg(F.max("key").alias("keep_key"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(counted.filter("group_size > 1"), "duplicate-groups")
    wanted = groups.select("digest")
    if groups.count() <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    source = df.select(normalised(F.col(text)).alias("text"))
    source = source.withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = source.join(wanted, "digest", "left_semi").groupBy("digest", "text").count()
    checked = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("count").alias("n"))
    verified = groups.join(checked, "digest", "left").select(
        "digest", "keep_key",
        F.when((F.col("texts") == 1) & (F.col("n") == F.col("group_size")), F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two texts have one digest")).cast("bigint")).alias("group_size"),
    )
    return rows, verified


def _with_group(rows: DataFrame, groups: DataFrame, digest: str, spread: Column) -> DataFrame:
    """``rows`` with (_digest, _keep, _size) of their group, null for a text that stands once.

    No group is dealt to one task: large ones meet their rows where those are.
    """
    groups = groups.select(F.col("digest").alias("_digest"), F.col("keep_key").alias("_keep"), F.col("group_size").alias("_size"))
    groups = stage(groups, "duplicate-keys")
    own = F.col(digest) == F.col("_digest")
    totals = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("_size"), F.lit(0)).alias("rows")).first()
    if totals["groups"] <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(groups), own, "left")
    large = F.col("_size") * BROADCAST_DIGESTS >= totals["rows"]
    found = rows.join(F.broadcast(groups.filter(large)), own, "left")
    rest = groups.filter(~large).toDF("_digest2", "_keep2", "_size2")
    # Rows that have their group go anywhere: eight bytes equal no digest.
    to = F.when(F.col("_digest").isNull(), F.col(digest)).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64(spread)), 16, "0")))
    both = found.join(rest, to == F.col("_digest2"), "left")
    return both.select(
        *(F.col(name) for name in rows.columns),
        *(F.coalesce(name, f"{name}2").alias(name) for name in ("_digest", "_keep", "_size")),
    )


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the greatest key stays; a null key is the least. Rows
    repeated with one key and one text have the same ``kept``. Null texts equal
    empty ones. An empty table gives no row. Other columns are left out.
    """
    rows, groups = duplicate_groups(df, key, text)
    joined = _with_group(rows, groups, "digest", F.col("key"))
    keep = F.when(F.col("_digest").isNull(), F.col("key")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("key").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, its columns unchanged; of rows repeated with one key and one text, one."""
    _, groups = duplicate_groups(df, key, text)
    own = F.unhex(F.sha2(normalised(F.col(text)), 256))
    # Whole rows in one column, so that no name of theirs can clash.
    whole = df.select(F.struct(*(F.col(f"`{name}`") for name in df.columns)).alias("row"), F.col(key).alias("key"), own.alias("own"))
    joined = _with_group(whole, groups, "own", F.col("key"))
    alone = joined.filter("_digest IS NULL").select("row.*")
    first = joined.filter(F.col("key").eqNullSafe(F.col("_keep")) & F.col("_digest").isNotNull()).dropDuplicates(["_digest"])
    return alone.unionByName(first.select("row.*"))
