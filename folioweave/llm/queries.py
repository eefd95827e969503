"""The p-queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioweave.llm import exact, languages, linkage, names, neardup, packing, survivor, tokens, truncation
from folioweave.session import materialise

CAPACITY = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(_table(spark, sf_dir, "papers"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.judged(_table(spark, sf_dir, "papers"), "abstract", "paper_id", "source"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(_table(spark, sf_dir, "papers"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.document_links(_table(spark, sf_dir, "papers"), "paper_id", ["title", "abstract"], "abstract", 30)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.found(_table(spark, sf_dir, "papers"), _table(spark, sf_dir, "import_papers"))


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = linkage.link(_table(spark, sf_dir, "papers"), "paper_id", _table(spark, sf_dir, "import_papers"), "import_id")
    return links.withColumnsRenamed({"a": "paper_id", "b": "import_id"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.found(_table(spark, sf_dir, "papers"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.collapsed(_table(spark, sf_dir, "papers"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.found(_table(spark, sf_dir, "papers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(_table(spark, sf_dir, "papers"), _table(spark, sf_dir, "authors"), _table(spark, sf_dir, "institutions"))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(_table(spark, sf_dir, "authors"), _table(spark, sf_dir, "institutions"), _table(spark, sf_dir, "papers"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document decoded from its ids, and whether the text came back."""
    documents = _table(spark, sf_dir, "documents")
    back = tokens.decode(materialise(tokens.encode(documents))).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.encode(_table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").alias("n"))
    packed = packing.pack(sizes, "doc_id", "n", CAPACITY)
    return packed.withColumnsRenamed({"item": "doc_id", "length": "n_tokens"})


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.found(_table(spark, sf_dir, "documents"))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = languages.detect(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "line_no", "lang", F.round("confidence", 6).alias("confidence"), "mixed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_rates, p2_found, p2_links, p4_found, p4_confidence, p5_found, p5_records, p6_found, p7_found, p7_entities, p8_ids, p8_roundtrip, p9_containers, p10_found, p10_languages)
    return {f.__name__: f for f in fs}


# The sets of p5 in SQL: keys, the DOIs of each title, and the set each row falls into.
_SETS = (
    r"WITH k AS (SELECT paper_id AS id, nullif(regexp_replace(lower(title), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '') AS t,"
    r" nullif(regexp_extract(replace(lower(doi), '%2f', '/'), '(10\.[0-9]{3,9}(\.[0-9]+)*/[^\s]*[^\s.,;:)\]}>\"''])', 1), '') AS d FROM papers),"
    " g AS (SELECT t, count(DISTINCT d) AS n, min(d) AS one FROM k WHERE t IS NOT NULL GROUP BY t),"
    " s AS (SELECT id, t, CASE WHEN d IS NULL AND n = 1 THEN one ELSE d END AS sd FROM k JOIN g USING (t)),"
    " m AS (SELECT id, min(id) OVER (PARTITION BY t, sd) AS first_id FROM s)"
)


# The words of title and abstract with their occurrences, and each pair's common ones: every pair of texts that share a word.
_MARKUP = r"</?[A-Za-z][^<>]{0,200}>|&#?\w{1,8};"
_RUNS = r"'[\p{L}\p{N}]+'"
_BAGS = (
    "f AS (SELECT paper_id, abstract, concat_ws(' ', nullif(title, ''), nullif(abstract, '')) AS txt FROM papers)"
    f", k AS (SELECT paper_id, regexp_extract_all(lower(CASE WHEN contains(txt, '<') OR contains(txt, '&') THEN regexp_replace(txt, '{_MARKUP}', ' ', 'g') ELSE txt END), {_RUNS}) AS ws,"
    f" len(regexp_extract_all(CASE WHEN contains(abstract, '<') OR contains(abstract, '&') THEN regexp_replace(abstract, '{_MARKUP}', ' ', 'g') ELSE abstract END, {_RUNS})) AS n_abstract FROM f)"
    ", l AS (SELECT paper_id, ws, len(ws) AS n, md5(array_to_string(list_sort(ws), ' ')) AS bag FROM k WHERE n_abstract >= 30)"
)


def _common(rows: str) -> str:
    return (
        f"w AS (SELECT id, n, w, row_number() OVER (PARTITION BY id, w) AS nth FROM (SELECT id, n, unnest(ws) AS w FROM {rows}))"
        ", c AS (SELECT a.id AS i, b.id AS j, a.n + b.n AS total, count(*) AS common FROM w a JOIN w b ON a.w = b.w AND a.nth = b.nth AND a.id < b.id AND 3 * least(a.n, b.n) >= 2 * greatest(a.n, b.n) GROUP BY 1, 2, 3)"
        ", similar_pairs AS (SELECT i, j FROM c WHERE 3 * common >= 2 * (total - common))"
    )


def oracle_sql() -> dict[str, str]:
    classes = "cl AS (SELECT bag, min(paper_id) AS id, count(*) AS copies, any_value(ws) AS ws, any_value(n) AS n FROM l GROUP BY 1)"
    return {
        "p2_found": f"WITH {_BAGS}, r AS (SELECT paper_id AS id, n, ws FROM l), {_common('r')} SELECT i AS first_id, j AS second_id FROM similar_pairs",
        "p2_links": f"WITH {_BAGS}, {classes}, {_common('cl')}, k2 AS (SELECT id, count(*) AS links FROM (SELECT i AS id FROM similar_pairs UNION ALL SELECT j FROM similar_pairs) GROUP BY 1)"
        " SELECT l.paper_id AS id, cl.id AS class_rep, copies, coalesce(links, 0) AS links FROM l JOIN cl USING (bag) LEFT JOIN k2 ON k2.id = cl.id",
        # every text comes back as it was, missing ones as empty
        "p8_roundtrip": "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, true AS same FROM documents",
        "p5_found": _SETS + " SELECT first_id, id AS second_id FROM m WHERE id <> first_id",
        "p5_records": _SETS + " SELECT first_id AS record_id, count(*) AS copies, false AS collided FROM m GROUP BY 1",
    }
