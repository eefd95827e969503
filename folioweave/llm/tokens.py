"""Encoding of a corpus with a public byte-level tokenizer through a table of distinct words.

The tokenizer first splits a text into words by a pattern and encodes each word by itself, so
a word's ids never depend on its neighbours.  Words are split in the JVM; each distinct word
of the corpus is encoded once; the ids come back by position.  The most frequent words of every
length, of bounded number and size, go to every worker; the rest, a small share of all
positions, are joined by a shuffle, so no frequent word makes a hot key.

The JVM's and the tokenizer's character classes agree on every character the JVM knows.
Texts with characters it does not know (of later Unicode versions) are encoded whole.

Cases: a NULL or empty text has the empty list of ids; blank texts and texts of any length
are encoded in full; strings of special tokens are ordinary text; repeated rows are encoded
alike; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioweave.session import materialise

# Fixed value: how the byte-level tokenizers of this family split a text into words.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Most frequent words that every worker holds, by their longest length: some 4 million characters of each kind at most.
HOT_WORDS = {32: 65_536, 1_024: 4_096, 65_536: 64}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def _encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)] if texts else []


def _encoded(df: DataFrame, path: str, key: str, text: str, kind: pa.DataType, ddl: str) -> DataFrame:
    """(key, ids): ``text`` of each row encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        for batch in batches:
            ids = _encode(path, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], schema=pa.schema([(key, kind), ("ids", pa.list_(pa.int32()))]))

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} {ddl}, ids array<int>")


def word_table(documents: DataFrame, text: str, path: str) -> DataFrame:
    """(word, ids, n): each distinct word of the corpus, encoded once, and its number of occurrences."""
    words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")))
    ids = _encoded(counts.select("word", F.col("word").alias("w")), path, "word", "w", pa.string(), "string")
    return counts.join(ids, "word").select("word", "ids", "n")


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = path or tokenizer_path()
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    unknown = F.col("text").rlike(r"\p{Cn}")
    plain, odd = docs.filter(~unknown), docs.filter(unknown)
    table = materialise(word_table(plain, "text", path))
    hot, shorter = [], 0
    for longest, most in HOT_WORDS.items():
        hot += table.filter(F.length("word").between(shorter + 1, longest) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(most).select("word", "ids").collect()
        shorter = longest
    known = spark.sparkContext.broadcast({r["word"]: r["ids"] for r in hot})  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = known.value.get
        for batch in batches:
            all_ids, holes = [], []
            for words in batch.column(1).to_pylist():
                ids: list[int] = []
                missing = []
                for w in words:
                    k = look(w)
                    if k is None:
                        missing.append({"at": len(ids), "word": w})
                    else:
                        ids += k
                all_ids.append(ids)
                holes.append(missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_ids, pa.list_(pa.int32())), pa.array(holes, pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())])))], names=["id", "ids", "holes"])

    split = plain.select("id", F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0)).alias("words"))
    partly = materialise(split.mapInArrow(run, "id long, ids array<int>, holes array<struct<at:int,word:string>>"))
    whole = partly.filter(F.size("holes") == 0).select("id", "ids")
    open_ = partly.filter(F.size("holes") > 0)
    gaps = open_.select("id", F.posexplode("holes").alias("nth", "hole")).select("id", "nth", F.col("hole.at").alias("at"), F.col("hole.word").alias("word"))
    filled = gaps.join(table.select("word", F.col("ids").alias("piece")), "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", "at", "piece"))).alias("pieces"))
    # no more pieces than the document has words

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, pieces in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                done, row = 0, []
                for p in pieces:
                    row += ids[done : p["at"]] + p["piece"]
                    done = p["at"]
                out.append(row + ids[done:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    spliced = open_.select("id", "ids").join(filled, "id").mapInArrow(splice, "id long, ids array<int>")
    late = _encoded(odd, path, "id", "text", pa.int64(), "long")
    return whole.unionByName(spliced).unionByName(late).select(F.col("id").alias(doc_id), "ids")


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, bytes) of the vocabulary: byte-level pieces turned back into the bytes they stand for."""
    import json

    path = path or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are moved up in order
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    rows = [(i, bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()) for piece, i in vocabulary.items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode(encoded: DataFrame, doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), through a join of ids and pieces; an empty list gives the empty text, NULL gives NULL."""
    table = pieces(encoded.sparkSession, path)  # as large as the vocabulary
    each = encoded.select(F.col(doc_id).alias("id"), F.posexplode("ids").alias("pos", "token")).join(F.broadcast(table), "token")
    parts = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("parts"))
    texts = parts.select("id", F.decode(F.unhex(F.array_join(F.col("parts.h"), "")), "UTF-8").alias("text"))
    joined = encoded.select(F.col(doc_id).alias("id"), "ids").join(texts, "id", "left")
    return joined.select(F.col("id").alias(doc_id), F.when(F.col("ids").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))
