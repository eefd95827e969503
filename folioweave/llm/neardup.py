"""Near-duplicates with small edits: MinHash bands for candidates, odd sketches for their similarity.

Similarity is that of two bags of words: words common to both, counted with repetition, over
all words of the two.  The n-th occurrence of a word is an element of its own, which turns
bags into sets, so MinHash estimates exactly this ratio.

1. Each text becomes ``rows * bands`` MinHash values in one pass over Arrow batches.
2. Texts with equal bags form a class; only classes are compared.
3. ``rows`` values form a band; classes that agree in a band are candidates.
4. The values are folded into an odd sketch, a bitmap in which bit h(i, value) is flipped for
   every sample i (Mitzenmacher, Pagh, Pham, 2014).  The XOR of two sketches has a one for
   every odd number of differing samples, so its population count gives the similarity with
   an error that shrinks as the similarity grows.  A coarse sketch of 32 bytes drops chance
   candidates, a fine one of all samples decides the rest but for a margin.
5. Inside the margin the words themselves are counted.

Cases: NULL fields count as empty; a text with fewer than ``least_words`` words in the field
that must be long enough is in no pair; texts of any length are used whole; equal texts fall
into one class, and a hot class leaves each map task as one row per band; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioweave.session import materialise

ROWS, BANDS = 10, 84
COARSE_BITS, COARSE_SAMPLES, FINE_BITS = 256, 128, 2048

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&#?\w{1,8};")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def words_of(*fields: str | None) -> list[str]:
    """Runs of letters and digits of all fields in lower case, markup aside."""
    text = " ".join(f for f in fields if f)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def _elements(bags: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit elements of all bags, each bag's sorted, and where each bag starts."""
    flat: list[int] = []
    starts = np.zeros(len(bags) + 1, np.int64)
    for i, bag in enumerate(bags):
        for w in bag:
            h = known.get(w)
            if h is None:
                h = _word_hash(w)
                if len(known) < 1_000_000:  # a memory bound for the table, not for the words
                    known[w] = h
            flat.append(h)
        starts[i + 1] = len(flat)
    hashes = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(bags)), np.diff(starts))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    # the n-th occurrence of a word in its bag
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    return _mix(hashes + (np.arange(len(hashes)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def _minhashes(elements: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """(k, bags) of 32-bit MinHash values; no bag may be empty."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    adds = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    low, high = elements.astype(np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    out = np.empty((k, len(starts) - 1), np.uint32)
    value = np.empty_like(low)
    for i in range(k):
        np.multiply(low, factors[i], out=value)
        value ^= high
        value += adds[i]
        value *= np.uint32(0x85EBCA6B)
        out[i] = np.minimum.reduceat(value, starts[:-1])
    return out


def _bands(values: np.ndarray, rows: int) -> np.ndarray:
    """(bags, bands) of 64-bit band keys, different for each band."""
    k, n = values.shape
    keys = np.zeros((k // rows, n), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(31) + values[r::rows][: k // rows].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return _mix(keys + np.arange(k // rows, dtype=np.uint64)[:, None]).T


def _odd_sketches(values: np.ndarray, bits: int) -> np.ndarray:
    """(bags, bits / 8) bytes: bit h(i, value) is flipped for each sample i."""
    k, n = values.shape
    place = (_mix(values.astype(np.uint64) + (np.arange(k, dtype=np.uint64)[:, None] << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((place + np.arange(n) * bits).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((counts & 1).astype(np.uint8), axis=1)


def odd_similarity(differing: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The similarity at which two odd sketches of ``k`` samples are expected to differ in so many bits."""
    share = np.minimum(np.asarray(differing, float) * 2 / bits, 1 - 1e-9)
    return np.clip(1 + bits / (4 * k) * np.log1p(-share), 0, 1)


_SKETCH = pa.schema([("id", pa.int64()), ("class_id", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int32())), ("coarse", pa.binary()), ("fine", pa.binary())])


def sketches(texts: DataFrame, record_id: str, fields: list[str], long_field: str | None, least_words: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, class_id, check, bands, coarse, fine) of each text that is long enough.

    Equal bags share ``class_id`` and ``check``, two independent 64-bit sums.  The last three
    are filled for the first text of a class in each partition only: the map side's share of
    collapsing a hot class.
    """
    at = fields.index(long_field) if long_field else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            columns = [batch.column(c + 1).to_pylist() for c in range(len(fields))]
            ids, bags = [], []
            for i, record in zip(batch.column(0).to_pylist(), zip(*columns)):
                split = [words_of(x) for x in record]
                bag = [w for words in split for w in words]
                if len(bag) >= max(1, least_words) and (at is None or len(split[at]) >= least_words):
                    ids.append(i)
                    bags.append(bag)
            if not ids:
                continue
            elements, starts = _elements(bags, known)
            one = np.add.reduceat(elements, starts[:-1]).view(np.int64)
            two = np.add.reduceat(_mix(elements ^ np.uint64(0xD6E8FEB86659FD93)), starts[:-1]).view(np.int64)
            fresh = []
            for i, c in enumerate(zip(one.tolist(), two.tolist())):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            keys, coarse, fine = ([None] * len(ids) for _ in range(3))
            if fresh:
                part = np.concatenate([elements[starts[i] : starts[i + 1]] for i in fresh])
                begin = np.concatenate([[0], np.cumsum([starts[i + 1] - starts[i] for i in fresh])])
                values = _minhashes(part, begin, rows * bands)
                keyed, low, high = _bands(values, rows).astype(np.uint32).view(np.int32), _odd_sketches(values[:COARSE_SAMPLES], COARSE_BITS), _odd_sketches(values, FINE_BITS)
                for j, i in enumerate(fresh):
                    keys[i], coarse[i], fine[i] = keyed[j], low[j].tobytes(), high[j].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one), pa.array(two), pa.array(keys, pa.list_(pa.int32())), pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())], schema=_SKETCH)

    slim = texts.select(F.col(record_id).cast("long").alias("id"), *fields)
    return slim.mapInArrow(run, "id long, class_id long, check long, bands array<int>, coarse binary, fine binary")


def _estimated(pairs: DataFrame, kind: str, bits: int, k: int, least: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose odd sketches ``kind``_a and ``kind``_b tell a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, bits // 8) for c in (2, 3))
            estimate = odd_similarity(np.bitwise_count(x ^ y).sum(axis=1), bits, k)
            keep = pa.array(estimate >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(estimate).filter(keep)], names=["a", "b", "estimate"])

    return pairs.select("a", "b", f"{kind}_a", f"{kind}_b").mapInArrow(run, "a long, b long, estimate double")


def _exact(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) from the words of both sides of each pair, in ``bag_a`` and ``bag_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = Counter(x), Counter(y)
                common = sum((u & v).values())
                out.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long, similarity double")


def _bags(texts: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c + 1).to_pylist() for c in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(*r) for r in zip(*columns)], pa.list_(pa.string()))], names=["id", "bag"])

    return texts.select(F.col(record_id).cast("long").alias("id"), *fields).mapInArrow(run, "id long, bag array<string>")


def class_pairs(texts: DataFrame, record_id: str, fields: list[str], long_field: str | None = None, least_words: int = 1, threshold: float = 2 / 3, margin: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id, check) of each text, and (a, b, similarity) of each two similar classes.

    ``margin`` is about four standard errors of the fine estimate at the threshold; the
    coarse one is allowed twice as much.
    """
    table = materialise(sketches(texts, record_id, fields, long_field, least_words))
    members = table.select("id", "class_id", "check")
    shown = table.filter("bands IS NOT NULL")
    keyed = shown.select(F.posexplode("bands").alias("at", "key"), "class_id")
    keyed = keyed.select((F.shiftleft(F.col("at").cast("long"), 32) + F.col("key")).alias("band"), "class_id")
    keyed = keyed.repartition("band").dropDuplicates(["band", "class_id"])
    other = keyed.select("band", F.col("class_id").alias("b"))
    pairs = keyed.withColumnRenamed("class_id", "a").join(other, "band").filter("a < b").select("a", "b")
    pairs = pairs.repartition("a").dropDuplicates(["a", "b"])  # lies as the join with the sketches needs it

    def side(kind: str, s: str) -> DataFrame:  # a class may be shown by several partitions
        return shown.select("class_id", kind).dropDuplicates(["class_id"]).select(F.col("class_id").alias(s), F.col(kind).alias(f"{kind}_{s}"))

    likely = _estimated(pairs.join(side("coarse", "a"), "a").join(side("coarse", "b"), "b"), "coarse", COARSE_BITS, COARSE_SAMPLES, threshold - 2 * margin).select("a", "b")
    near = materialise(_estimated(likely.join(side("fine", "a"), "a").join(side("fine", "b"), "b"), "fine", FINE_BITS, ROWS * BANDS, threshold - margin))
    sure = near.filter(F.col("estimate") >= threshold + margin).select("a", "b", F.col("estimate").alias("similarity"))
    # the sketches can't decide the rest: read the words of one text of each such class
    doubtful = near.filter(F.col("estimate") < threshold + margin).select("a", "b")
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    first = materialise(members.join(asked, "class_id").groupBy("class_id").agg(F.min("id").alias("id")))
    bags = materialise(_bags(texts.join(first.select(F.col("id").alias(record_id)), record_id, "left_semi"), record_id, fields).join(first, "id").select("class_id", "bag").dropDuplicates(["class_id"]))
    bag = lambda s: bags.select(F.col("class_id").alias(s), F.col("bag").alias(f"bag_{s}"))
    settled = _exact(doubtful.join(bag("a"), "a").join(bag("b"), "b")).filter(F.col("similarity") >= threshold)
    return members, sure.unionByName(settled)


def document_links(texts: DataFrame, record_id: str, fields: list[str], long_field: str | None = None, least_words: int = 1, threshold: float = 2 / 3) -> DataFrame:
    """(id, class_rep, copies, links): each text, the smallest id with its words, their number, and the number of similar other classes."""
    members, pairs = class_pairs(texts, record_id, fields, long_field, least_words, threshold)
    classes = members.groupBy("class_id").agg(F.min("id").alias("class_rep"), F.count("*").alias("copies"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    told = classes.join(links, "class_id", "left").select("class_id", "class_rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(told, "class_id").select("id", "class_rep", "copies", "links")


def found(papers: DataFrame) -> DataFrame:
    """(first_id, second_id) of each two papers whose titles and abstracts agree to two thirds, equal ones included."""
    members, pairs = class_pairs(papers, "paper_id", ["title", "abstract"], "abstract", 30)
    left, right = members.select(F.col("class_id").alias("a"), F.col("id").alias("i")), members.select(F.col("class_id").alias("b"), F.col("id").alias("j"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("i", "j").alias("first_id"), F.greatest("i", "j").alias("second_id"))
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    within = members.select(F.col("class_id").alias("a"), F.col("check").alias("c"), F.col("id").alias("i")).join(members.select(F.col("class_id").alias("b"), F.col("check").alias("d"), F.col("id").alias("j")), same)
    within = within.filter("i < j").select(F.col("i").alias("first_id"), F.col("j").alias("second_id"))
    return across.unionByName(within)
