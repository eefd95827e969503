"""Languages of documents and of their lines: string-kernel classification.

A line is the set of its character n-grams of length 1 to 4; two lines compare by the
blended-spectrum presence kernel ``|A & B| / sqrt(|A| |B|)`` (Lodhi et al., 2002; Ionescu et
al., 2014).  Kernel ridge regression, one language against the rest, is fitted on the
Nystroem features that a set of landmark lines spans (Williams and Seeger, 2001).  The
decision values of a line are then ``X Z' A / sqrt(|A|)`` with its row ``X`` of n-grams, the
landmarks ``Z`` and the coefficients ``A``; ``Z' A`` has one column per language and is
multiplied out once, so a batch of lines is scored by one product of its sparse n-gram matrix.

The training rows are a bounded sample, ``lines_per_language`` labelled lines of each language that two documents or more
name, however rare it is.  Labels are noisy: a language counts if a model fitted without a fifth of the lines gives most
of that fifth's lines their label, for each fifth in turn, and the fit is repeated without the rows it contradicts.  Rows
weigh so that all languages weigh alike.  All texts are scored, whole.

A document's main language is that of most of its characters.  A line counts for itself if it
has five words or more and is no reference entry; a line scored with less than
``least_confidence`` takes the main language of its document.

Cases: NULL, empty and blank texts, texts of numbers and texts of reference entries alone have
no language and give no row; a label that names no language is NULL; lines of any length are
scored by all their n-grams; repeated rows are scored alike; an empty table, or
one without labels, gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioweave.session import materialise

ORDERS, BUCKET_BITS = (1, 2, 3, 4), 18
_PIECE, _LINES = 100_000, 1 << 32 - BUCKET_BITS
_SAMPLE = 60_000  # training lines of all languages at most

# English names and three-letter codes of languages, with their two-letter codes.
LANGUAGE_NAMES = {
    "english": "en", "eng": "en", "german": "de", "deu": "de", "ger": "de", "french": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "spa": "es", "portuguese": "pt", "por": "pt",
    "italian": "it", "ita": "it", "dutch": "nl", "nld": "nl", "dut": "nl", "russian": "ru", "rus": "ru", "polish": "pl", "pol": "pl", "swedish": "sv", "swe": "sv", "danish": "da", "dan": "da",
    "czech": "cs", "ces": "cs", "cze": "cs", "turkish": "tr", "tur": "tr", "chinese": "zh", "zho": "zh", "chi": "zh", "japanese": "ja", "jpn": "ja", "korean": "ko", "kor": "ko",
    "arabic": "ar", "ara": "ar", "greek": "el", "ell": "el", "gre": "el", "finnish": "fi", "fin": "fi", "norwegian": "no", "nor": "no", "hungarian": "hu", "hun": "hu", "ukrainian": "uk", "ukr": "uk",
}
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,400}>|&#?\w{1,8};|https?://\S+|doi:\S+")
_REFERENCE = re.compile(r"^\W*(?:\[\d+\]|\d+\.)\s.*(?:doi|\(\d{4}\)|\d{4}[a-z]?[);,.])|^\W*\[\d+\]\s|\bdoi:\s?10\.")
_QUOTED = re.compile(r"\[[^\[\]]{1,150}\]|«[^«»]{1,150}»|“[^“”]{1,150}”|„[^„“”]{1,150}[“”]|\"[^\"]{1,150}\"|(?<!\w)'[^']{3,150}'(?!\w)|(?<!\w)([*_]{1,2})[^*_]{3,150}\1(?!\w)")
# Share of letters below which a line is code, a formula or a table, not prose.
PROSE_SHARE = 0.6
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"\S*\w\S*")


def language_of_label(label: Column) -> Column:
    """The two-letter code a label names in any notation; NULL if it names none."""
    low = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return F.when(F.length(low) == 2, low).otherwise(F.try_element_at(names, low))


def prepared(line: str) -> str:
    """The letters of a line in lower case, words set apart by one blank; empty for a reference entry and for what is no prose.

    Quoted terms are left out where enough of the line remains without them.
    """
    if _REFERENCE.search(line):
        return ""
    if "<" in line or "&" in line or ":" in line:
        line = _MARKUP.sub(" ", line)
    shown = len(line) - line.count(" ")
    if shown and sum(map(len, _LETTERS.findall(line))) < PROSE_SHARE * shown:
        return ""
    if _QUOTED.search(line):
        rest = _QUOTED.sub(" ", line)
        if len(_LETTERS.findall(rest)) >= 5:
            line = rest
    words = _LETTERS.findall(line.lower())
    return " " + " ".join(words) + " " if words else ""


def word_count(line: str) -> int:
    return len(_WORDS.findall(_MARKUP.sub(" ", line) if "<" in line else line))


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of each distinct n-gram of each of up to ``_LINES`` lines, by line."""
    code = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = code == 10
    owner = np.cumsum(mark) - mark
    keys = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :]
        whole = (owner[: len(h)] == owner[n - 1 :]) & ~mark[n - 1 :] & ~mark[: len(h)]
        x = (h[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        keys.append((owner[: len(h)][whole].astype(np.uint32) << np.uint32(BUCKET_BITS)) | (x >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
    keys = np.concatenate(keys)  # a line number and a bucket in 32 bits, which sort fastest
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint32(BUCKET_BITS)).astype(np.int64), (keys & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _product(lines: list[str], table: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """The lines' normalised n-gram matrix times a table with a row per bucket, or per bucket that ``row`` gives a place."""
    out = np.zeros((len(lines), table.shape[1]), np.float64)
    line, bucket = _grams(lines)
    if len(line):
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(line)]]))
        out[line[starts]] = np.add.reduceat(table[bucket if row is None else row[bucket]], starts, axis=0) / np.sqrt(sizes)[:, None]
    return out


@dataclass
class Model:
    """Languages, the weight of each n-gram bucket for each, the intercepts, and the temperature of the confidences."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, lines: list[str]) -> np.ndarray:
        """Decision values of prepared lines, each by all its n-grams."""
        out = np.zeros((len(lines), len(self.languages)))
        short = [i for i, s in enumerate(lines) if len(s) <= _PIECE]
        begin = 0
        while begin < len(short):
            end, size = begin, 0
            while end < len(short) and end - begin < _LINES and (end == begin or size + len(lines[short[end]]) <= 8 * _PIECE):
                size += len(lines[short[end]])
                end += 1
            out[short[begin:end]] = _product([lines[i] for i in short[begin:end]], self.weights)
            begin = end
        for i, s in enumerate(lines):
            if len(s) > _PIECE:  # its set of n-grams is gathered part by part; parts overlap by what an n-gram may span
                held = np.zeros(1 << BUCKET_BITS, bool)
                for a in range(0, len(s), _PIECE):
                    held[_grams([s[a : a + _PIECE + max(ORDERS) - 1]])[1]] = True
                out[i] = self.weights[held].sum(axis=0, dtype=np.float64) / np.sqrt(held.sum())
        return out + self.bias

    def confidences(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp((scores - scores.max(axis=1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=1, keepdims=True)


def fit(lines: list[str], labels: list[str], landmarks: int = 24, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression on Nystroem features of prepared lines; ``landmarks`` per language, 2,400 in all at most."""
    languages = sorted(set(labels))
    truth = np.array([languages.index(x) for x in labels])
    told = _regression(lines, truth, languages, landmarks, ridge)[1]
    right = told.argmax(axis=1) == truth
    # languages whose lines the rest of the sample does not tell as theirs are wrong labels
    real = [c for c in range(len(languages)) if right[truth == c].mean() > 0.5]
    keep = np.flatnonzero(right & np.isin(truth, real))
    if len(set(truth[keep])) > 1:
        lines, truth = [lines[i] for i in keep], np.searchsorted(real, truth[keep])
        languages = [languages[c] for c in real]
    model, told = _regression(lines, truth, languages, landmarks, ridge)
    losses = {}
    for t in (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0):
        model.temperature = t
        losses[t] = -np.log(np.maximum(model.confidences(told)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def _regression(lines: list[str], truth: np.ndarray, languages: list[str], landmarks: int, ridge: float) -> tuple[Model, np.ndarray]:
    """The model of all lines, and what models without each fifth of them say of that fifth.  Languages weigh alike."""
    many = max(4, min(landmarks, 2_400 // len(languages)))
    chosen = np.concatenate([np.flatnonzero(truth == c)[:many] for c in range(len(languages))]).astype(int)
    line, bucket = _grams([lines[i] for i in chosen])
    used, place = np.unique(bucket, return_inverse=True)
    row = np.full(1 << BUCKET_BITS, len(used))  # the last row is empty
    row[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(chosen)), np.float32)
    table[place, line] = 1
    table /= np.sqrt(np.maximum(table.sum(axis=0), 1))
    kernel = np.concatenate([_product(lines[a : a + 64], table, row) for a in range(0, len(lines), 64)])
    between = _product([lines[i] for i in chosen], table, row)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    sizes = np.bincount(truth, minlength=len(languages))
    weight = (len(truth) / (len(languages) * sizes))[truth]
    bias = (target * weight[:, None]).sum(axis=0) / weight.sum()

    def solve(rows: np.ndarray) -> np.ndarray:
        x = features[rows] * weight[rows, None]
        return np.linalg.solve(x.T @ features[rows] + ridge * weight[rows].sum() * np.eye(features.shape[1]), x.T @ (target[rows] - bias))

    fifth = np.arange(len(lines)) % 5
    told = np.zeros(target.shape)
    for f in range(5):
        if (fifth == f).any() and (fifth != f).any():
            told[fifth == f] = features[fifth == f] @ solve(fifth != f) + bias
    coefficients = root @ solve(np.ones(len(lines), bool))
    return Model(languages, (table @ coefficients.astype(np.float32)).astype(np.float32)[row], bias, 1.0), told


def training_lines(documents: DataFrame, text: str, label: str, lines_per_language: int = 300, longest: int = 2000) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled lines: ``lines_per_language`` of up to ``longest`` characters for each language, fewer where that were more than 60,000 in all."""
    labelled = documents.select(language_of_label(F.col(label)).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").count().collect()  # a row per language code
    known = [r["lang"] for r in counts if r["count"] >= 2]
    lines_per_language = min(lines_per_language, _SAMPLE // max(1, len(known)))
    lines = labelled.filter(F.col("lang").isin(known)).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(F.length("line").between(40, longest) & (F.size(F.split("line", " ")) >= 6) & ~F.col("line").rlike(r"^\W*\[\d+\]|doi:"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line")
    sample = lines.select("lang", "line", F.row_number().over(order).alias("n")).filter(F.col("n") <= lines_per_language).collect()
    sample.sort(key=lambda r: (r["lang"], r["n"]))
    pairs = [(prepared(r["line"]), r["lang"]) for r in sample]
    pairs = [p for p in pairs if p[0]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def detect(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", least_confidence: float = 0.6, **sample: float) -> DataFrame:
    """(doc_id, line_no, lang, confidence, mixed): line 0 is the document, lines of five words or more follow by number."""
    schema = "id long, line_no int, lang string, confidence double, mixed boolean"
    spark = documents.sparkSession
    lines, labels = training_lines(documents, text, label, **sample)
    if len(set(labels)) < 2:
        return spark.createDataFrame([], schema).withColumnRenamed("id", doc_id)
    model = spark.sparkContext.broadcast(fit(lines, labels))  # buckets times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            where, flat, long = [], [], []
            for d, t in enumerate(texts):
                for n, line in enumerate(t.split("\n"), 1):
                    p = prepared(line) if line.strip() else ""
                    if p:
                        where.append((d, n))
                        flat.append(p)
                        long.append(word_count(line) >= 5)
            if not flat:
                continue
            confidence = m.confidences(m.scores(flat))
            best, sure = confidence.argmax(axis=1), confidence.max(axis=1)
            size = np.array([len(p) - 2 for p in flat])
            doc, counts = np.array([w[0] for w in where]), np.array(long)
            weight = np.zeros((len(texts), len(m.languages)))
            clear = counts & (sure >= least_confidence)
            np.add.at(weight, (doc[clear], best[clear]), size[clear])
            rest = weight.sum(axis=1)[doc] == 0  # documents without a clear long line: all their lines, by confidence
            np.add.at(weight, doc[rest], confidence[rest] * size[rest][:, None])
            main = weight.argmax(axis=1)
            best = np.where(sure >= least_confidence, best, main[doc])
            kinds = np.zeros((len(texts), len(m.languages)), bool)
            kinds[doc[counts], best[counts]] = True
            mixed = kinds.sum(axis=1) > 1
            has = np.flatnonzero(weight.sum(axis=1) > 0)
            share = weight[has, main[has]] / weight[has].sum(axis=1)
            certainty = np.zeros(len(texts))
            np.add.at(certainty, doc, confidence[np.arange(len(doc)), main[doc]] * size)
            total = np.bincount(doc, size, len(texts))
            rows = [(ids[d], 0, m.languages[main[d]], float(min(s, 1.0) if mixed[d] else certainty[d] / total[d]), bool(mixed[d])) for d, s in zip(has, share)]
            rows += [(ids[d], n, m.languages[b], float(c[b]), bool(mixed[d])) for (d, n), b, c, w in zip(where, best, confidence, long) if w]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_()))], names=["id", "line_no", "lang", "confidence", "mixed"])

    scored = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(run, schema)
    return scored.withColumnRenamed("id", doc_id)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): documents whose label is missing, empty of meaning or wrong, and the lines of mixed documents."""
    told = materialise(detect(documents))
    labels = documents.select("doc_id", language_of_label(F.col("lang")).alias("label"))
    whole = told.filter("line_no = 0").join(labels, "doc_id").filter("label IS NULL OR label <> lang")
    return whole.select("doc_id", "line_no", "lang").unionByName(told.filter("line_no > 0 AND mixed").select("doc_id", "line_no", "lang"))
