"""Filling containers of fixed capacity: harmonic packing of lengths in classes of reciprocal capacity.

An item of class j has a length in (capacity / (j + 1), capacity / j], so j items of the class always fit one container and
j + 1 never do.  Each class fills its own containers with j items each; what the containers of larger classes have left is
offered to a class first, the smallest space that holds an item.  Items of the last class, of at most ``capacity /
classes``, are laid end to end in what is still left and in containers of their own.  An item longer than the capacity
fills whole containers; what is left of it is an item like any other.

Items are dealt evenly to workers of about ``share`` items, whatever their ids or lengths, and each worker packs its own in
one pass over memory of bounded size; only the numbers of containers are exchanged.

Cases: a NULL length counts as 0, and an item of length 0 gets a container, with other small items; negative lengths are an
error; ties and repeated rows each get a place; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioweave.session import materialise

_BLOCK = 1_000  # workers whose counts are summed in one task


def pack(items: DataFrame, item_id: str, length: str, capacity: int = 2048, classes: int = 64, share: int = 200_000) -> DataFrame:
    """(item, part, length, container): a container number for each item, or each part of one longer than ``capacity``.

    ``share`` is about the number of items a worker fills containers with on its own.
    """
    if capacity < 1 or classes < 2:
        raise ValueError("capacity must be positive and classes at least 2")
    sized = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"))
    full = F.floor(F.col("length") / capacity).cast("int")
    rest = F.col("length") - full * capacity
    none = F.array().cast("array<struct<part:int,length:bigint>>")
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.struct(i.alias("part"), F.lit(capacity).cast("long").alias("length")))).otherwise(none)
    left = F.when((full == 0) | (rest > 0), F.array(F.struct(full.alias("part"), rest.alias("length")))).otherwise(none)
    checked = sized.filter(F.when(F.col("length") < 0, F.raise_error(F.lit("negative length"))).otherwise(True))
    parts = materialise(checked.select("item", F.inline(F.concat(whole, left))))
    workers = max(1, -(-parts.count() // share))
    # places in a written table do not change, so a lost task deals its rows as before
    dealt = parts.withColumn("worker", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(workers)))

    def fill(table: pa.Table) -> pa.Table:
        own = harmonic(table.column("length").to_numpy(), capacity, classes)
        return table.append_column("own", pa.array(own, pa.int64()))

    kind = parts.schema["item"].dataType.simpleString()
    placed = materialise(dealt.groupBy("worker").applyInArrow(fill, f"item {kind}, part int, length long, worker long, own long"))
    counts = placed.groupBy("worker").agg((F.max("own") + 1).alias("n")).withColumn("block", F.floor(F.col("worker") / _BLOCK))
    # containers are numbered through: sums of blocks of workers, then of workers in their block
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("first"))
    first = counts.withColumn("ahead", before(Window.partitionBy("block").orderBy("worker"))).join(blocks, "block").select("worker", (F.col("first") + F.col("ahead")).alias("first"))
    return placed.join(first, "worker").select("item", "part", "length", (F.col("first") + F.col("own")).alias("container"))


def harmonic(lengths: np.ndarray, capacity: int, classes: int) -> np.ndarray:
    """The container of each item, numbered from 0."""
    own = np.full(len(lengths), -1, np.int64)
    kind = np.where(lengths * classes <= capacity, classes, capacity // np.maximum(lengths, 1))
    order = np.argsort(-lengths, kind="stable")
    starts = np.searchsorted(kind[order], np.arange(1, classes + 2))  # kinds rise as lengths fall
    held: dict[int, list[int]] = {}  # containers by the space they have left
    spaces: list[int] = []  # the keys of ``held``, sorted
    opened = 0

    def put(container: int, space: int) -> None:
        if space:
            if space not in held:
                held[space] = []
                insort(spaces, space)
            held[space].append(container)

    for j in range(1, classes + 1):
        rest = []
        for i in order[starts[j - 1] : starts[j]].tolist():
            n = int(lengths[i])
            at = bisect_left(spaces, max(n, 1))
            if at == len(spaces):
                rest.append(i)
                continue
            space = spaces[at]
            container = held[space].pop()
            if not held[space]:
                del held[space], spaces[at]
            own[i] = container
            put(container, space - n)
        if not rest:
            continue
        rest = np.array(rest)
        if j < classes:
            group = np.arange(len(rest)) // j
        else:  # small items end to end, a container closed where the next might not fit
            usable = max(1, capacity - capacity // classes)
            group = (np.cumsum(lengths[rest]) - lengths[rest]) // usable
            group = np.unique(group, return_inverse=True)[1]
        own[rest] = opened + group
        used = np.bincount(group, lengths[rest]).astype(np.int64)
        for g, u in enumerate(used.tolist()):
            put(opened + g, capacity - u)
        opened += len(used)
    return own


def filling(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, used, overfull): number of containers, share of their space in use, containers beyond capacity."""
    each = packed.groupBy("container").agg(F.sum("length").alias("used"))
    return each.agg(F.count("*").alias("containers"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("used"), F.sum((F.col("used") > capacity).cast("long")).alias("overfull"))
