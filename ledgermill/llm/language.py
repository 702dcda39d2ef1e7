"""Language of a text by the nearest of several centroids per language.

A text is the TF-IDF vector of its byte n-grams of letters, one to three bytes
long and hashed to ``FEATURES`` places, at unit length. Spherical k-means gives
every language ``CENTROIDS`` centroids; the language of the centroid with the
largest cosine is the answer. A text whose cosine is far below what training
texts of about its length reach is rejected.

Document frequencies come from every training row. The centroids are fitted on
a bounded sample: at most ``SAMPLE_ROWS`` training rows in all, shared out
evenly over the languages, those with the smallest hashes.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected. Rows with a null label are not trained on. Without training rows all
texts are ``und``. Repeated rows are each answered; extra columns stay unless
named as an added one, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import small_batches
from .words import text_bytes, text_slices

FEATURES = 4096
CENTROIDS = 3
SAMPLE_ROWS = 4000
ROUNDS = 12
SLICE_ROWS = 512
#: Share of the low quantile of training cosines below which a text is rejected.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.6
UNKNOWN = "und"


def features(column: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams of letters: one row per text."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    letter = ((data >= ord("a")) & (data <= ord("z"))) | (data >= 0x80)
    plain = np.where(letter, data, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    out = np.zeros(len(column) * FEATURES, np.float32)
    gram = np.zeros(len(plain), np.uint32)
    for n in (1, 2, 3):
        gram = gram[: len(plain) - n + 1] * np.uint32(256) + plain[n - 1 :]
        if not len(gram):
            break
        code = (gram + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(20)
        first, last = row[: len(gram)], row[n - 1 :]
        # inside one text and not of blanks alone
        blank = ~letter[: len(gram)] & ~letter[n - 1 :]
        good = (first == last) & ~blank
        out += np.bincount(first[good] * FEATURES + code[good], minlength=len(out)).astype(np.float32)
    return out.reshape(len(column), FEATURES)


def _slices(batches):
    for part in text_slices(batches):
        for start in range(0, part.num_rows, SLICE_ROWS):
            yield part.slice(start, SLICE_ROWS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rows of counts as weighted unit vectors, in place and a slice at a time."""
    for a in range(0, len(counts), SLICE_ROWS):
        counts[a : a + SLICE_ROWS] = _unit(counts[a : a + SLICE_ROWS] * idf)
    return counts


def _bands(counts: np.ndarray) -> np.ndarray:
    """Length band of texts from their n-gram counts: powers of two."""
    return np.log2(1 + counts.sum(axis=1)).astype(int)


@dataclass
class Centroids:
    """A fitted model; its size depends on the languages and features alone."""

    idf: np.ndarray
    vectors: np.ndarray  # all centroids
    languages: list[str]  # of each centroid
    cutoffs: np.ndarray  # by length band

    def answer(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each row of counts."""
        cosine = _unit(counts * self.idf) @ self.vectors.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        band = np.minimum(_bands(counts), len(self.cutoffs) - 1)
        return [self.languages[i] for i in best], score, score < self.cutoffs[band]


def _document_counts(batches):
    """How many texts of a task have each feature, and the number of texts at place -1."""
    seen, rows = np.zeros(FEATURES, np.int64), 0
    for part in _slices(batches):
        seen += (features(part.column("text")) > 0).sum(axis=0)
        rows += part.num_rows
    places = np.concatenate([[-1], np.flatnonzero(seen)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()), pa.array(np.concatenate([[rows], seen[seen > 0]]), pa.int64())], ["place", "n"]
    )


def _sparse(batches):
    for part in _slices(batches):
        counts = features(part.column("text"))
        places = [np.flatnonzero(c).astype(np.int32) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("lang"),
                pa.array([p.tobytes() for p in places], pa.binary()),
                pa.array([c[p].astype(np.float32).tobytes() for c, p in zip(counts, places)], pa.binary()),
            ],
            ["lang", "places", "counts"],
        )


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from rows that lie far apart."""
    k = min(k, len(x))
    centers = [x.mean(axis=0)]
    while len(centers) < k:
        centers.append(x[(x @ _unit(np.array(centers)).T).max(axis=1).argmin()])
    centers = _unit(np.array(centers))
    for _ in range(ROUNDS):
        nearest = (x @ centers.T).argmax(axis=1)
        centers = _unit(np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(k)]))
    return centers


def _limits(keyed: DataFrame, sizes: dict[str, int], quota: int) -> Column:
    """Map of each language to a bound of ``u`` below which its quota of distinct texts lies, or all of them.

    The bound lets about four times the quota of rows through. Where copies
    leave too few distinct texts below it, that language's bound widens.
    """
    shares = {lang: min(1.0, 4 * quota / n) for lang, n in sorted(sizes.items())}
    while True:
        limits = F.create_map(*[x for lang, share in shares.items() for x in (F.lit(lang), F.lit(share * 2.0**32))])
        # only languages whose bound may still have to widen
        open_ = [lang for lang, share in shares.items() if share < 1]
        if not open_:
            return limits
        near = keyed.filter(F.col("lang").isin(open_) & (F.col("u") <= F.element_at(limits, F.col("lang"))))
        found = {r["lang"]: r["n"] for r in near.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [lang for lang in open_ if found.get(lang, 0) < quota]
        if not few:
            return limits
        for lang in few:
            shares[lang] = min(1.0, 4 * shares[lang])


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Centroids | None:
    """Centroids from labelled rows; None where there are none."""
    rows = small_batches(training).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    seen = rows.select("text").mapInArrow(_document_counts, "place long, n long")
    seen = {r["place"]: r["n"] for r in seen.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(FEATURES)
    df[list(seen)] = list(seen.values())
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    keyed = rows.withColumn("h", F.xxhash64("text", F.lit(8)))
    keyed = keyed.withColumn("u", F.shiftrightunsigned("h", 32))
    sizes = {r["lang"]: r["count"] for r in keyed.groupBy("lang").count().collect()}
    quota = max(1, SAMPLE_ROWS // len(sizes))
    near = keyed.select("lang", "u", "h").filter(F.col("u") <= F.element_at(_limits(keyed, sizes, quota), F.col("lang")))
    order = Window.partitionBy("lang").orderBy("u", "h")
    chosen = near.distinct().withColumn("r", F.row_number().over(order))
    chosen = chosen.filter(F.col("r") <= quota)
    chosen = cut_lineage(chosen.select("lang", "h"), "sample")
    sample = keyed.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    found = sample.mapInArrow(_sparse, "lang string, places binary, counts binary").collect()
    found.sort(key=lambda r: (r["lang"], r["places"], r["counts"]))
    counts = np.zeros((len(found), FEATURES), np.float32)
    for i, r in enumerate(found):
        counts[i, np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    label, bands = np.array([r["lang"] for r in found]), _bands(counts)
    del found
    x = _weighted(counts, idf)
    names, vectors = [], []
    for name in sorted(set(label)):
        own = _cluster(x[label == name], CENTROIDS)
        vectors.append(own)
        names += [name] * len(own)
    vectors = np.concatenate(vectors).astype(np.float32)
    return Centroids(idf, vectors, names, _cutoffs((x @ vectors.T).max(axis=1), bands))


def _cutoffs(score: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Least cosine by length band: never higher for a shorter text."""
    cut = np.zeros(40)
    for b in range(40):
        near = score[(band >= b - 1) & (band <= b + 1)]
        cut[b] = REJECT_SHARE * np.quantile(near, REJECT_QUANTILE) if len(near) >= 20 else np.nan
    known = np.flatnonzero(~np.isnan(cut))
    if not len(known):
        return np.zeros(40)
    cut[: known[0]] = 0  # shorter than anything seen often enough
    for b in range(known[0], 40):
        cut[b] = cut[b - 1] if np.isnan(cut[b]) else cut[b]
    return np.minimum.accumulate(cut[::-1])[::-1]


def identify(docs: DataFrame, model: Centroids | None, text_col: str = "text", keep: bool = True, also=()) -> DataFrame:
    """Rows with ``lang_pred, score, rejected``; without ``keep`` only the columns ``also`` stay."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in _slices(batches):
            text = part.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text.cast(pa.string()), r"\p{L}"), False)
            letters = letters.to_numpy(zero_copy_only=False)
            lang, score, out = [UNKNOWN] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
            if shared.value is not None:
                lang, score, out = shared.value.answer(features(text))
                lang = [x if ok else UNKNOWN for x, ok in zip(lang, letters)]
                score, out = np.where(letters, score, 0.0), out | ~letters
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *([text] if keep else []), pa.array(lang, pa.string()), pa.array(score), pa.array(out)],
                ["row", *(["text"] if keep else []), "lang_pred", "score", "rejected"],
            )

    added = ("lang_pred", "score", "rejected")
    names = [c for c in docs.columns if c not in added and c != text_col] if keep else list(also)
    rows = docs.select(F.struct(*names).alias("row"), F.col(text_col).cast("string").alias("text"))
    extra = T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields
    schema = T.StructType([rows.schema["row"], *([rows.schema["text"]] if keep else []), *extra])
    found = rows.mapInArrow(run, schema)
    if not keep:
        return found.select("row.*", *added)
    found = found.select("row.*", F.col("text").alias(text_col), *added)
    return found.select(*[c for c in docs.columns if c in found.columns and c not in added], *added)


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of an id's text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
