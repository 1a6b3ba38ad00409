"""Exact byte-pair encoding of a whole corpus by per-prefix dynamic programming.

Every prefix of a piece of text has exactly one encoding, so it has one last token. That token is found among the tokens that end
the prefix: an automaton over the vocabulary (of Aho and Corasick, whose states are the suffixes of what was read that begin a token) gives these suffix matches, longest first. It is the one which is compatible with the last token of the
prefix before it, that is, the encoding of the two tokens' joint bytes is these two tokens. Back-pointers from the end give the ids. The
work is linear in the length of the piece, where merging the best pair again and again isn't.

Text is first cut where the public pattern cuts it. Cuts before a single space between two other characters hold
whatever surrounds them, so words are cut out cheaply, and the ids of short words are kept in a bounded memory per worker.

Scale: one narrow pass, no shuffle; the vocabulary is read by each worker from a path given as a parameter and takes a few MB.

Nulls and odd input: null and empty text give an empty list; strings of special tokens are ordinary text; any length is encoded
whole; one row per input row, repeated rows included; further columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.common import ship, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: published with the vocabulary
#: Words of at most SHORT characters are remembered, up to WORDS of them, then the memory starts anew.
SHORT, WORDS = 48, 300_000


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabulary files write bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its encoder."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.pieces = regex.compile(pattern).findall
        self.single = [0] * 256
        for letter, byte in letters.items():
            self.single[byte] = vocab[letter]
        size = max(vocab.values()) + 1
        self.rank = [-1] * size  # order of the merge that makes the token; -1 for single bytes
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[z], self.left[z], self.right[z], self.merged[x, y] = k, x, y, z
        self.fits: dict[int, bool] = {}
        self.words: dict[str, array] = {}
        self.blanks: dict[str, array] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            if self._whole(token):
                self.automaton.add_word(bytes(letters[c] for c in text).decode("latin-1"), (token, len(text)))
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins a part at the end of ``a`` with one at the start of ``b``.

        The last merges inside ``a`` and ``b`` are taken back, latest first; what then meets at the boundary must not have been
        merged before that moment.
        """
        rank, merged = self.rank, self.merged
        while True:
            if (joint := merged.get((a, b))) is not None and rank[joint] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] >= rank[b]:
                # at equal ranks the left one is merged first, so its boundary is taken back last
                if rank[a] == rank[b]:
                    limit, b = rank[b] + 1, self.left[b]
                else:
                    limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token."""
        if self.rank[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        return self._apart(a, b, self.rank[token]) and self._whole(a) and self._whole(b)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._apart(a, b, len(self.rank))
        return known

    def encode_piece(self, piece: str) -> array:
        """Ids of one piece, by the last token of each of its prefixes."""
        raw = piece.encode("utf-8").decode("latin-1")
        last, width = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        compatible = self.compatible
        for end, (token, n) in self.automaton.iter(raw):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if n == end or (before >= 0 and compatible(before, token)):
                    last[end], width[end] = token, n
        ids, at = array("i"), len(raw)
        while at:
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return ids

    def _encode_word(self, word: str) -> array:
        out = array("i")
        for piece in self.pieces(word):
            # white space is remembered apart: as a word it would seem to end in a cut that holds
            memory = self.blanks if piece[-1].isspace() else self.words
            if len(piece) > SHORT or (ids := memory.get(piece)) is None:
                ids = self.encode_piece(piece)
                if len(piece) <= SHORT:
                    self._remember(piece, ids, memory)
            out.extend(ids)
        return out

    def _remember(self, word: str, ids: array, memory: dict[str, array]) -> None:
        if len(memory) >= WORDS:
            memory.clear()
        memory[word] = ids

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        known, pending, first = self.words.get, "", True
        for chunk in text.split(" "):
            word = chunk if first else " " + chunk
            if pending:
                word, pending = pending + word, ""
            first = False
            ids = known(word)
            if ids is None:
                # a cut holds only between two characters that aren't white space: a word beginning or ending in one waits
                if not chunk or chunk[-1].isspace():
                    pending = word
                    continue
                if chunk[0].isspace() and word != chunk:
                    out.extend(self._encode_word(word))
                    continue
                ids = self._encode_word(word)
                if len(word) <= SHORT:
                    self._remember(word, ids, self.words)
            out.extend(ids)
        if pending:
            out.extend(self._encode_word(pending))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """The codec of this process; a worker keeps it over its tasks."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _lists(path: str, pattern: str, only_counts: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidelog.llm import tokenize

        c = tokenize.codec(path, pattern)
        for batch in batches:
            offsets, ids, n = array("i", [0]), array("i"), array("i")
            for text in batch.column(1):
                text = text.as_py()
                if text:
                    c.encode_into(text, ids)
                if only_counts:
                    n.append(len(ids))
                    del ids[:]
                else:
                    offsets.append(len(ids))
            if only_counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["id", "n"])
            else:
                flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    return encode


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_column`` and ``ids`` of every row."""
    ship(df.sparkSession)
    rows = spread(df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")))
    return rows.mapInArrow(_lists(path, pattern, False), "id bigint, ids array<int>").withColumnRenamed("id", id_column)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_column`` and ``n_tokens`` of every row."""
    ship(df.sparkSession)
    rows = spread(df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")))
    return rows.mapInArrow(_lists(path, pattern, True), "id bigint, n int").toDF(id_column, "n_tokens")
