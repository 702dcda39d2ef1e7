"""Byte-level BPE ids of whole texts and back.

A vocabulary is a rank per byte string; encoding merges the adjacent pair of
the lowest rank, the first one of several, until no pair is in the vocabulary.
Here no merge is played through. Two tokens can stand side by side in a result
if and only if merging their joined bytes alone leaves the border between them
alone; a sequence in which all neighbours can is the only such one, and is
what the merges give. So a piece is covered from the left by its longest tokens, found
by an Aho-Corasick automaton over the bytes as Latin-1 characters; where a
token cannot stand after the one before it, the next shorter one is tried, and
where none is left the last token is taken back. A place from which no token
led on is marked and not tried again, which bounds the work by the length of
the piece times that of the longest token.

Whether two tokens are compatible follows from how each was merged: the last
merges at both sides of the border are undone in falling order of rank, and
any pair across the border that would have merged earlier rules the neighbours
out. Answers are kept per pair of tokens.

Edge cases: a null or empty text has no ids. Bytes that are not UTF-8 are
replaced as Python does. Rows are independent: repeated rows give equal
results, an empty table an empty one. Extra columns stay out of the result. A
very long text is cut before white space that follows other characters, where
the pattern always ends a piece, so its pieces are never all held at once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches

#: Characters after which a text is cut at the next border between pieces.
CUT = 1 << 16
#: Pieces and pairs of tokens whose results a worker keeps; beyond, both start anew.
KEPT = 1 << 19
#: Longer pieces (bytes) are rare words and not kept.
KEPT_BYTES = 64


class Merges:
    """The tokens of a rank file, how each was merged, and which can be neighbours."""

    def __init__(self, rank_file: bytes):
        import ahocorasick

        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        reached = set()
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) == 1 or self._split(rank, token, reached):
                reached.add(rank)
        self._apart.clear()  # answers found before the later merges were known
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(self.sizes.values())
        self.finder = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for rank in reached:
            self.finder.add_word(self.tokens[rank].decode("latin-1"), rank)
        self.finder.make_automaton()
        for rank in reached:
            token = self.tokens[rank]
            self.shorter[rank] = next(
                (r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) in reached), -1
            )

    def _split(self, rank: int, token: bytes, reached: set[int]) -> bool:
        """Find the pair whose merge makes the token; some tokens of a vocabulary have none."""
        for n in range(1, len(token)):
            left, right = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if left in reached and right in reached and self._stay_apart(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return True
        return False

    def apart(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in a result."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) >= KEPT:
                self._apart.clear()
            known = self._apart[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo merges beside the border, the latest first.

        ``before`` is the rank below which a merge across the border would have
        come first: that of the merge undone last. Of equal ranks the left one
        was merged first, so an undone right token lets equals across.
        """
        before = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < before:
                return False
            l_parts, r_parts = self.parts.get(left), self.parts.get(right)
            if l_parts is None and r_parts is None:
                return True
            if r_parts is None or (l_parts is not None and left > right):
                before, left = left, l_parts[1]
            else:
                before, right = right + 1, r_parts[0]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, find, reach = piece.decode("latin-1"), self.finder.iter_long, self.reach
        sizes, shorter, apart = self.sizes, self.shorter, self.apart
        # every byte is a token, so the first match in what follows a place starts there
        ids, at, token = [], 0, next(find(text[:reach]))[1]
        dead = bytearray(len(text) + 1)
        while True:
            end = at + sizes[token]
            if not dead[end] and (not ids or apart(ids[-1], token)):
                ids.append(token)
                if end == len(text):
                    return ids
                at, token = end, next(find(text[end : end + reach]))[1]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]


class Coder:
    """Whole texts to ids and back."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.merges = Merges(rank_file)
        self.pieces = regex.compile(pattern).findall
        self.border = regex.compile(r"(?<=\S)(?=\s)").search
        self.kept: dict[str, list[int]] = {}

    def ids(self, text: str) -> Iterator[list[int]]:
        """The ids of the text, cut into runs."""
        at = 0
        while at < len(text):
            found = self.border(text, at + CUT) if len(text) - at > CUT else None
            end = found.start() if found else len(text)
            ids: list[int] = []
            kept = self.kept
            for piece in self.pieces(text[at:end]):
                known = kept.get(piece)
                if known is None:
                    data = piece.encode()
                    known = self.merges.encode(data)
                    if len(data) <= KEPT_BYTES:
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[piece] = known
                ids += known
            yield ids
            at = end

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def coder(rank_file: bytes, pattern: str) -> Coder:
    """The tables of a vocabulary, built once per worker."""
    return Coder(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    """A rank file: one line per token, its bytes in base 64 and its rank."""
    with open(path, "rb") as file:
        return file.read()


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column.cast(pa.large_binary()):
        data = value.as_py()
        yield data.decode("utf-8", "replace") if data else ""


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, ids`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: a megabyte or so

    def run(batches):
        own = coder(sent.value, pattern)
        for batch in batches:
            for i, text in enumerate(_texts(batch.column("text"))):
                ids = [x for part in own.ids(text) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks: bytes) -> DataFrame:
    """``doc_id, data``: the bytes of the ids of ``coded(doc_id, ids)``."""
    sent = coded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        own = coder(sent.value, "")
        for batch in batches:
            data = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids and what they decode to, run by run."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        own = coder(sent.value, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in _texts(batch.column("text")):
                n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in own.ids(text):
                    coded.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                    decoded.update(own.decode(ids))
                    n += len(ids)
                counts.append(n)
                of_ids.append(coded.hexdigest())
                of_bytes.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _plain(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
