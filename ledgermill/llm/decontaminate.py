"""Benchmark passages in training texts, by an FM-index per training shard.

A shard is a run of rows of one task with at most ``words.SLICE_BYTES`` bytes
of text. Its words become symbols: words that no benchmark item holds can not
be part of an occurrence and end a stretch; stretches shorter than the
shortest window can hold none and are left out, which loses nothing. The index
of the remaining stretches is searched backward for all windows at once, the
occurrences are located, and overlapping ones merge to spans.

The benchmark is split by hash into blocks of about ``BLOCK_BYTES`` text
bytes. The rows pass one block after the other, and are written in between, so
the driver and a task hold the windows of one block at a time, in arrays of
about sixty times its bytes at most, and no text is shuffled.

Edge cases: a null or empty text, or one without words, has no hits. An item
without words has no window; equal items all count, one without an id hits but
is not counted. With an empty benchmark nothing is hit. Repeated rows are
handled one by one. Extra columns stay unless named as an added one, which
replaces them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .batches import small_batches
from .fm_index import FMIndex
from .words import ALNUM_WORDS, Words, text_slices

WINDOW = 10
BLOCK_BYTES = 1 << 20
_BREAK = 1  # the symbol between stretches; 0 ends the index

_ADDED = "n_words long, hit_words array<array<int>>, spans array<array<int>>, items array<long>"


class Windows:
    """Distinct windows of one block of benchmark items, as symbols."""

    def __init__(self, rows: list[tuple], window: int):
        column = pa.array([text for _, text in rows], pa.string())
        words = Words(column, ALNUM_WORDS)
        self.vocabulary, symbol = np.unique(words.codes(), return_inverse=True)
        self.sigma = len(self.vocabulary) + 2
        symbol = symbol + 2
        items = np.array([-1 if item is None else item for item, _ in rows], np.int64)
        named = np.array([item is not None for item, _ in rows], bool)
        counts = np.diff(words.first)
        widths = np.minimum(window, counts)
        #: By width: the windows, and the items that hold each, one run of ``items`` per window.
        self.patterns: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == m)
            n = counts[own] - m + 1
            at = np.arange(n.sum()) + np.repeat(words.first[own] - np.cumsum(n) + n, n)
            self.patterns[m], which = np.unique(symbol[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            owner = np.repeat(own, n)
            kept = named[owner]
            pairs = np.unique(np.stack([which.reshape(-1)[kept], items[owner[kept]]]), axis=1)
            self.items[m] = (np.searchsorted(pairs[0], np.arange(len(self.patterns[m]) + 1)), pairs[1])
        self.shortest = min(self.patterns, default=0)

    def items_of(self, width: int, which: int) -> list[int]:
        first, items = self.items[width]
        return items[first[which] : first[which + 1]].tolist()

    def occurrences(self, words: Words, codes: np.ndarray):
        """``(width, pattern, first word)`` arrays of all occurrences in a shard."""
        at = np.searchsorted(self.vocabulary, codes)
        at = np.minimum(at, len(self.vocabulary) - 1)
        known = self.vocabulary[at] == codes
        if not known.any():
            return
        # stretches of known words of one row
        edge = np.zeros(len(codes) + 1, bool)
        edge[words.first] = True
        begins = known & ~np.concatenate([[False], known[:-1] & ~edge[1:-1]])
        ends = known & ~np.concatenate([known[1:] & ~edge[1:-1], [False]])
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long_enough = last - first >= self.shortest
        first, size = first[long_enough], (last - first)[long_enough]
        if not len(first):
            return
        # each stretch and the break behind it
        place = np.cumsum(size + 1) - size - 1
        text = np.full(int((size + 1).sum()), _BREAK, np.int64)
        source = np.arange(len(text)) + np.repeat(first - place, size + 1)
        inside = np.ones(len(text), bool)
        inside[place + size] = False
        text[inside] = at[source[inside]] + 2
        index = FMIndex(text, self.sigma)
        for width, patterns in self.patterns.items():
            low, high = index.search(patterns)
            found = high - low
            which = np.repeat(np.arange(len(patterns)), found)
            if len(which):
                row = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)
                yield width, which, source[index.locate(row)]


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the runs of hit words."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _search(block: list[tuple], window: int, last: bool):
    def run(batches):
        windows = Windows(block.value, window)
        for part in text_slices(batches):
            words = Words(part.column("text"), ALNUM_WORDS)
            codes = words.codes()
            cover = np.zeros(len(codes) + 1, np.int64)
            # what earlier blocks have hit
            old = part.column("hit_words")
            for r in range(part.num_rows):
                for a, b in old[r].as_py() or ():
                    cover[words.first[r] + a] += 1
                    cover[words.first[r] + b] -= 1
            items = [set(x.as_py() or ()) for x in part.column("items")]
            if windows.shortest and len(codes):
                for width, which, at in windows.occurrences(words, codes):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    pairs = np.unique(np.stack([words.row[at], which]), axis=1)
                    for r, w in pairs.T.tolist():
                        items[r].update(windows.items_of(width, w))
            hit = np.cumsum(cover)[:-1] > 0
            hit_words, spans = [], []
            for r in range(part.num_rows):
                f = words.first[r]
                a, b = _spans(hit[f : words.first[r + 1]])
                hit_words.append(np.stack([a, b], axis=1).tolist())
                base = words.offsets[r]
                spans.append([[int(words.starts[f + i] - base), int(words.ends[f + j - 1] - base)] for i, j in zip(a, b)] if last else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("text"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(hit_words, pa.list_(pa.list_(pa.int32()))),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                ["row", "text", "n_words", "hit_words", "spans", "items"],
            )

    return run


def _cut(text: str | None, spans: list) -> str | None:
    data, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def _remove(batches):
    for batch in batches:
        texts = [
            _cut(t, s) if s else t
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
        ]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    remove: bool = False,
    keep: bool = True,
    id_col: str = "doc_id",
) -> DataFrame:
    """Rows with ``n_words, n_hit, hit_words, spans, items``.

    ``hit_words`` are the merged runs of hit words ``[first, past the last]``,
    ``spans`` the same as UTF-8 byte offsets. ``remove`` cuts the spans out of
    the text. Without ``keep`` only the id and the added columns return.
    """
    spark = small_batches(docs).sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    bench = bench.filter("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    names = ("n_words", "n_hit", "hit_words", "spans", "items")
    kept = [c for c in docs.columns if c not in names and c != text_col] if keep else [id_col]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        F.array().cast("array<array<int>>").alias("hit_words"),
        F.array().cast("array<long>").alias("items"),
    )
    schema = T.StructType([rows.schema["row"], rows.schema["text"], *T._parse_datatype_string(_ADDED).fields])
    for b in range(blocks):
        block = bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in block])
        rows = rows.mapInArrow(_search(shared, window, b == blocks - 1), schema)
        if b < blocks - 1:
            rows = cut_lineage(rows, "hits")
            shared.destroy()
    if remove:
        rows = rows.mapInArrow(_remove, rows.schema)
    n_hit = F.aggregate("hit_words", F.lit(0), lambda s, x: s + x[1] - x[0]).cast("long")
    text = [F.col("text").alias(text_col)] if keep else []
    found = rows.select("row.*", *text, "n_words", n_hit.alias("n_hit"), "hit_words", "spans", "items")
    return found.select(*[c for c in docs.columns if c in found.columns and c not in names], *names) if keep else found
