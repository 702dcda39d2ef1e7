"""Language-model scores of whole texts.

A text is its lower-cased words and an end. The base score is the log10
probability under smoothed counts of whole words in the training texts. The
model's score is that of the causal attention model in ``attention`` over the
words' subword ids, which a public tokenizer gives.

Every training word is counted, and the counts of subword ids follow from the
words' counts. The weights of the attention model start from a bounded sample:
``TRAIN_TEXTS`` distinct training texts, those with the smallest hashes, without
those that exceed what is left of ``TRAIN_IDS`` ids. From there they learn from
all training texts, each once, in ``RATES`` rounds. In a round every task moves
the weights over its own texts, slice by slice, and Spark averages what the
tasks moved: an input row by how often each task read it, the rest by positions.
How rows are dealt to tasks therefore changes scores a little.

The most frequent words, ``HOT`` at most, go to every task with their counts and
subword ids. The other words of a text join the table of
counts as rows of hash and text number, and their sums return per text. No
text is shuffled. Words are matched by 64-bit hashes there.

Edge cases: a null or empty text has the end alone. A row without an id is a
training text. Without training texts all counts are 0. Repeated rows are each
scored; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import attention
from .batches import small_batches
from .language import fold
from .sampling import least_hashes
from .words import BLANK_WORDS, Words, text_slices

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
END = 2
HOT = 1 << 18
TRAIN_TEXTS = 600
TRAIN_IDS = 600_000
EPOCHS = 6
RATES = (0.006, 0.003, 0.001)  # step size of each round over the training texts
BATCH = 128  # windows in a step of a round


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the place of each word's code among them, and a word of each code."""
    codes, first, inverse = np.unique(words.codes(), return_index=True, return_inverse=True)
    return codes, inverse, first


def _spelled(words: Words, which: np.ndarray) -> pa.Array:
    """The texts of some words as one Arrow array."""
    start, size = words.starts[which], (words.ends - words.starts)[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    data = words.data[place].tobytes()
    return pa.Array.from_buffers(
        pa.string(), len(which), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)]
    )


def _count_words(batches):
    for part in text_slices(batches):
        words = Words(part.column("text"), BLANK_WORDS)
        codes, inverse, first = _distinct(words)
        yield pa.RecordBatch.from_arrays(
            [
                _spelled(words, first), pa.array(codes.view(np.int64), pa.int64()),
                pa.array(np.bincount(inverse, minlength=len(codes)), pa.int64()),
            ],
            ["word", "h", "c"],
        )


@dataclass
class Known:
    """The most frequent words: codes in order, counts, and the subword ids of one word after the other."""

    codes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    starts: np.ndarray  # one more than words

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)


NONE_KNOWN = Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64))


class _Subwords:
    """Ids of words: those of known ones are looked up, the tokenizer gives the others'."""

    def __init__(self, model: bytes, known: Known = NONE_KNOWN):
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known = known

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words in a row, how many each word has, its code and its place among the known ones (-1: none)."""
        codes, inverse, first = _distinct(words)
        at = self.known.find(codes)
        new = np.flatnonzero(at < 0)
        coded = self.encoder.encode(_spelled(words, first[new]).to_pylist(), num_threads=1) if len(new) else []
        start, size = self.known.starts[at], self.known.starts[at + 1] - self.known.starts[at]
        size[new] = [len(c) for c in coded]
        start[new] = len(self.known.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.known.ids, np.array([i for c in coded for i in c], np.int32)]) if coded else self.known.ids
        start, size = start[inverse], size[inverse]
        place = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return ids[place], size, codes[inverse], at[inverse]


def _encoded(model: bytes):
    """``h, c, ids`` of words."""

    def run(batches):
        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            coded = encoder.encode(batch.column("word").to_pylist(), num_threads=1)
            ids = pa.array(coded, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), ids], ["h", "c", "ids"])

    return run


def _known(words: DataFrame, proto: bytes) -> Known:
    """The given words, ``HOT`` at most, from their counts ``word, h, c``."""
    found = words.mapInArrow(_encoded(proto), "h long, c long, ids array<int>").toArrow().combine_chunks()
    codes = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    ids = found.column("ids").take(pa.array(order)).combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    sizes = ids.value_lengths().to_numpy()
    return Known(
        codes[order], found.column("c").to_numpy()[order], ids.flatten().to_numpy(),
        np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
    )


def _id_counts(model: bytes):
    """``id, c``: how often a task's counted words have each subword id."""

    def run(batches):
        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        total = np.zeros(encoder.get_piece_size(), np.int64)
        for batch in batches:
            coded = encoder.encode(batch.column("word").to_pylist(), num_threads=1)
            size = np.array([len(c) for c in coded], np.int64)
            flat = np.array([i for c in coded for i in c], np.int64)
            weight = np.repeat(batch.column("c").to_numpy(), size)
            total += np.bincount(flat, weights=weight, minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "c"])

    return run


@dataclass
class Model:
    """What scoring needs in every task; its size does not depend on the corpus."""

    tokenizer: bytes
    vocabulary: attention.Vocabulary
    weights: dict
    known: Known
    tokens: int  # N
    distinct: int  # V
    ends: int


def _sequences(subwords: _Subwords, words: Words, vocabulary: attention.Vocabulary):
    """Slots of a run of texts: inputs, targets, texts, and the target ids; each word's code and place among the known."""
    ids, size, codes, known = subwords.of(words)
    per_row = np.bincount(words.row, weights=size, minlength=words.rows).astype(np.int64)
    lengths = per_row + 1  # the end
    slot, text, _ = attention.layout(lengths)
    ends = np.cumsum(lengths) - 1
    target = np.full(len(slot), END, np.int64)
    inner = np.ones(len(slot), bool)
    inner[ends] = False
    target[inner] = ids
    # what is read before a text's first id is an end
    before = np.concatenate([[END], target[:-1]]) if len(target) else target
    inputs = np.zeros(len(text), np.int64)
    inputs[slot] = vocabulary.inputs[before]
    classes = np.full(len(text), -1, np.int64)
    classes[slot] = vocabulary.classes[target]
    return slot, text, inputs, classes, target, lengths, codes, known


def _hot_from(counts: DataFrame) -> int:
    """The least count of which at most ``HOT`` words have as many or more.

    Counts are grouped in bins of a sixteenth of a power of two, so the
    grouped table has at most a thousand rows.
    """
    number = F.floor(F.log2("c") * 16)
    bins = counts.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    above, least = 0, 2**62
    for r in sorted(bins, key=lambda r: -r["b"]):
        above += r["n"]
        if above > HOT:
            break
        least = r["c"]
    return least


def fit(training: DataFrame, counts: DataFrame, tokenizer: str = TOKENIZER) -> Model:
    """The model from training texts and their word counts ``word, h, c``."""
    with open(tokenizer, "rb") as f:
        proto = f.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    known = _known(counts.filter(F.col("c") >= _hot_from(counts)), proto)
    of_ids = np.zeros(pieces, np.int64)
    for r in counts.select("word", "c").mapInArrow(_id_counts(proto), "id long, c long").groupBy("id").sum("c").collect():
        of_ids[r[0]] = r[1]
    of_ids[END] += ends
    vocabulary = attention.vocabulary(of_ids)
    sample = training.select("text", F.xxhash64("text").alias("k")).filter("text is not null")
    keys = least_hashes(sample, "k", TRAIN_TEXTS)
    rows = sample.filter(F.col("k") <= (keys[-1] if keys else 0)).dropDuplicates(["k"])
    # one task trains on the bounded sample
    trained = rows.repartition(1).mapInArrow(_train(proto, vocabulary, known), "weights binary").collect()
    weights = pickle.loads(trained[0][0]) if trained else _trained(vocabulary, *(np.zeros(0, np.int64),) * 3)
    for number, rate in enumerate(RATES if ends else ()):
        weights = _round(training, number, proto, vocabulary, known, weights, rate)
    return Model(
        proto, vocabulary, weights, known, int(totals["n"]) + ends, int(totals["v"]) + (ends > 0), ends,
    )


def _train(proto: bytes, vocabulary: attention.Vocabulary, known: Known = NONE_KNOWN):
    def run(batches):
        rows = pa.Table.from_batches(batches).sort_by("k") if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        words = Words(rows.column("text").combine_chunks(), BLANK_WORDS)
        _, text, inputs, classes, _, lengths, _, _ = _sequences(_Subwords(proto, known), words, vocabulary)
        kept, left = np.zeros(len(lengths), bool), TRAIN_IDS
        for i, n in enumerate(lengths.tolist()):
            if n <= left:
                kept[i], left = True, left - n
        slots = np.repeat(kept, -(-lengths // attention.STRIDE) * attention.STRIDE)
        weights = _trained(vocabulary, inputs[slots], text[slots], classes[slots])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(weights)], pa.binary())], ["weights"])

    return run


def _trained(vocabulary: attention.Vocabulary, inputs: np.ndarray, text: np.ndarray, classes: np.ndarray) -> dict:
    return attention.train(
        inputs, text, classes, epochs=EPOCHS, classes=int(vocabulary.classes.max()) + 1, rows=int(vocabulary.inputs.max()) + 1
    )


def _round(
    training: DataFrame, number: int, proto: bytes, vocabulary: attention.Vocabulary, known: Known, weights: dict, rate: float
) -> dict:
    """Weights after every task learned from its training texts of this round.

    What comes back is at most one row per row of weights, whatever the corpus.
    """
    shared = training.sparkSession.sparkContext.broadcast((proto, vocabulary, known, weights))
    own = training.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(len(RATES))) == number).select("text")
    moves = [f"d{j}" for j in range(attention.WEIGHTS_A_ROW)]
    schema = "place int, n double, " + ", ".join(f"{d} double" for d in moves)
    found = own.mapInArrow(_moved(shared, rate), schema).groupBy("place").agg(F.sum("n"), *[F.sum(d) for d in moves]).toArrow()
    shared.unpersist()
    table = attention.table(weights).astype(float)
    place, n, *sums = [c.to_numpy() for c in found.columns]
    table[place] += np.stack(sums, axis=1) / n[:, None] if len(place) else 0.0
    return attention.untable(table, weights)


def _moved(shared, rate: float):
    """``place, n, d0 ...``: how far a task moved each row of weights, times the weight ``n`` of its say."""

    def run(batches):
        proto, vocabulary, known, weights = shared.value
        subwords, learner = _Subwords(proto, known), attention.Learner(weights)
        for part in text_slices(batches):
            _, text, inputs, classes, *_ = _sequences(subwords, Words(part.column("text"), BLANK_WORDS), vocabulary)
            learner.learn(inputs, text, classes, lambda step: rate, BATCH)
        if not learner.positions:
            return
        moved = attention.table(learner.m).astype(float) - attention.table(weights)
        n = np.full(len(moved), float(learner.positions))
        n[: len(learner.reads)] = learner.reads
        place = np.flatnonzero(n)
        moved = moved[place] * n[place, None]
        names = ["place", "n", *[f"d{j}" for j in range(moved.shape[1])]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(n[place]), *[pa.array(np.ascontiguousarray(c)) for c in moved.T]], names
        )

    return run


def _score(shared):
    def run(batches):
        model: Model = shared.value
        subwords, own = _Subwords(model.tokenizer, model.known), attention.projected(model.weights)
        task, number = TaskContext.get().partitionId(), 0
        logs = np.log10(model.known.counts + 1.0)
        for part in text_slices(batches):
            words = Words(part.column("text"), BLANK_WORDS)
            slot, text, inputs, classes, target, lengths, codes, at = _sequences(subwords, words, model.vocabulary)
            cold, hit = at < 0, at >= 0
            sums = np.bincount(words.row[hit], weights=logs[at[hit]], minlength=part.num_rows)
            known = np.bincount(words.row[hit], minlength=part.num_rows)
            logp = attention.log10_classes(model.weights, inputs, text, np.maximum(classes, 0), own)[slot]
            logp += model.vocabulary.within[target]
            score = np.add.reduceat(logp, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
            rest = np.bincount(words.row[cold], minlength=part.num_rows)
            offsets = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
            places = (task << 33) + number + np.arange(part.num_rows)
            number += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(places), part.column("doc_id"), part.column("held_out"),
                    pa.array(np.diff(words.first) + 1, pa.int64()), pa.array(known), pa.array(sums), pa.array(score),
                    pa.ListArray.from_arrays(offsets, pa.array(codes[cold].view(np.int64))),
                ],
                ["place", "doc_id", "held_out", "n_tokens", "known", "sums", "score", "cold"],
            )

    return run


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Training texts are those whose id's fold is not ``held``.
    """
    spark = small_batches(docs).sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"),
    )
    training = rows.filter("not held_out")
    counts = training.select("text").mapInArrow(_count_words, "word string, h long, c long")
    counts = cut_lineage(counts.groupBy("word", "h").agg(F.sum("c").alias("c")), "counts")
    model = fit(training, counts, tokenizer)
    schema = (
        "place long, doc_id long, held_out boolean, n_tokens long, known long, sums double, score double, cold array<long>"
    )
    scored = cut_lineage(rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema), "scored")
    found = scored.select("place", F.explode("cold").alias("h")).join(counts.select("h", "c"), "h")
    found = found.groupBy("place").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("n"))
    end = float(np.log10(model.ends + 1.0))
    size = float(np.log10(model.tokens + model.distinct + 1.0))
    return scored.join(found, "place", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("n", F.lit(0)) + int(model.ends > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) + end - F.col("n_tokens") * size).alias("base_score"),
        "score",
    )
