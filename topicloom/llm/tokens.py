"""Encoding of whole corpora with a public byte-pair tokenizer (problem 8).

Pre-tokenisation runs without regular expressions. Each code point becomes a symbol: its class (letter,
number, white space, other) with up to two characters of look-ahead. A symbol is a function from state
to state; functions compose associatively, so blocks of text are composed side by side, the blocks'
functions are chained, and a second pass over all blocks marks where pieces begin. Pieces are slices of
the batch's UTF-8; each distinct piece is merged once per worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import chunks, code_points

#: Where the public vocabularies are, unless told otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED_PIECES = 300_000

LETTER, NUMBER, SPACE, OTHER, END = range(5)
# Symbols. A, B: an apostrophe that can open a contraction of one or two letters more; LAST_BLANK: U+0020 before
# something that isn't white space; LAST_SPACE: other white space before such; MORE_SPACE: white space before white space or the end.
L, N, O, A, B, LAST_BLANK, LAST_SPACE, MORE_SPACE = range(8)
# States: nothing open; in letters, numbers, others, white space; a blank that the next piece takes in; one or two letters left of a contraction.
NONE, IN_L, IN_N, IN_O, IN_SPACE, LEAD, ONE_LEFT, TWO_LEFT = range(8)
# The contractions of the pattern, lower case only.
SHORT, LONG = "sdmt", ("ll", "ve", "re")


@cache
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            table[cp] = LETTER if kind == "L" else NUMBER
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


@cache
def transition_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins), by symbol * 8 + state; symbols from 8 on begin a text."""
    after, begins = np.zeros((16, 8), dtype=np.uint8), np.zeros((16, 8), dtype=bool)
    for symbol in range(8):
        for state in range(8):
            joins, to = False, NONE
            if symbol == L:
                joins = state in (IN_L, LEAD, ONE_LEFT, TWO_LEFT)
                to = {ONE_LEFT: NONE, TWO_LEFT: ONE_LEFT}.get(state, IN_L)
            elif symbol == N:
                joins, to = state in (IN_N, LEAD), IN_N
            elif symbol in (O, A, B):
                joins = state in (IN_O, LEAD)
                to = IN_O if joins or symbol == O else ONE_LEFT if symbol == A else TWO_LEFT
            elif symbol == MORE_SPACE:
                joins, to = state == IN_SPACE, IN_SPACE
            elif symbol == LAST_BLANK:
                to = LEAD
            after[symbol, state], begins[symbol, state] = to, not joins
        after[symbol + 8], begins[symbol + 8] = after[symbol, NONE], True
    return after.ravel(), begins.ravel()


def symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    kinds = class_table()[codes]
    ends = starts[1:][np.diff(starts) > 0] - 1
    after = np.append(kinds[1:], END).astype(np.uint8)
    after[ends] = END
    out = np.array([L, N, MORE_SPACE, O], dtype=np.uint8)[kinds]
    last = (kinds == SPACE) & (after != SPACE) & (after != END)
    out[last] = np.where(codes[last] == 0x20, LAST_BLANK, LAST_SPACE)
    if len(quote := np.flatnonzero(codes == ord("'"))):
        owner_end = starts[np.searchsorted(starts, quote, side="right")]
        padded = np.append(codes, [0, 0])
        one = np.where(quote + 1 < owner_end, padded[quote + 1], 0)
        two = np.where(quote + 2 < owner_end, padded[quote + 2], 0)
        out[quote[np.isin(one, [ord(c) for c in SHORT])]] = A
        for x, y in LONG:
            out[quote[(one == ord(x)) & (two == ord(y))]] = B
    first = starts[:-1][np.diff(starts) > 0]
    out[first] += 8
    return out


def piece_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places at which the pieces of all texts begin."""
    size = len(codes)
    if not size:
        return np.zeros(0, dtype=np.int64)
    after, begins = transition_tables()
    blocks = max(1, int(size**0.5 * 2))
    length = -(-size // blocks)
    padded = np.zeros(blocks * length, dtype=np.uint16)
    padded[:size] = symbols(codes, starts)
    columns = np.ascontiguousarray(padded.reshape(blocks, length).T * np.uint16(8))
    function = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        function = after[column[:, None] + function]
    state, entry = NONE, np.zeros(blocks, dtype=np.uint8)
    for k, f in enumerate(function.tolist()):
        entry[k] = state
        state = f[state]
    marks = np.zeros((length, blocks), dtype=bool)
    for j, column in enumerate(columns):
        at = column + entry
        marks[j] = begins[at]
        entry = after[at]
    return np.flatnonzero(marks.T.ravel()[:size])


class Encoder:
    """A vocabulary file of ranks with its cache of merged pieces."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("public", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache: dict[bytes, bytes] = {}
        self.widths = np.zeros(max(self.ranks.values()) + 1, dtype=np.int32)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        for rank, token in self.tokens.items():
            self.widths[rank] = len(token)

    def ids(self, piece: bytes) -> bytes:
        """The piece's ids, as packed 32-bit integers."""
        rank = self.ranks.get(piece)
        found = np.array([rank] if rank is not None else self.merge(piece), dtype=np.int32).tobytes()
        if len(self.cache) >= CACHED_PIECES:
            self.cache.clear()
        self.cache[piece] = found
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry: the end)."""
        codes, starts = code_points(texts)
        begin = piece_starts(codes, starts)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        data = "".join(texts).encode("utf-8", "surrogatepass")
        edges = place[np.append(begin, len(codes))].tolist()
        known, miss = self.cache.get, self.ids
        packed = [known(piece := data[a:b]) or miss(piece) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.frombuffer(b"".join(packed), dtype=np.int32), total[np.searchsorted(begin, starts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, ids) by the vocabulary's file, without special tokens.

    Null and empty texts have an empty list; repeated rows stay; other columns are left out. With offsets,
    the column `starts` holds the byte of the UTF-8 text at which each id's token begins.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(vocabulary)
        for batch in batches:
            doc_id = batch.column(0)
            for at, part in chunks(batch.column(1).to_pylist()):
                ids, bounds = by.encode(part)
                edge = pa.array(bounds.astype(np.int32))
                columns = [doc_id.slice(at, len(part)), pa.ListArray.from_arrays(edge, pa.array(ids))]
                if offsets:
                    ends = np.concatenate([[0], np.cumsum(by.widths[ids], dtype=np.int64)])
                    base = np.repeat(ends[bounds[:-1]], np.diff(bounds))
                    columns.append(pa.ListArray.from_arrays(edge, pa.array((ends[:-1] - base).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][: len(columns)])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>" + ", starts array<int>" * offsets)


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, *keep: str) -> DataFrame:
    """(doc_id, text, keep...) to (doc_id, n_tokens, keep...); null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(vocabulary)
        for batch in batches:
            for at, part in chunks(batch.column(1).to_pylist()):
                _, bounds = by.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(np.diff(bounds)), *(c.slice(at, len(part)) for c in batch.columns[2:])], names=["doc_id", "n_tokens", *keep])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join(["doc_id long, n_tokens long", *(f"`{k}` {kinds[k]}" for k in keep)]))


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else by.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


#: What decoding gives back: every text, null as empty.
ROUND_TRIP_SQL = "select doc_id, coalesce(text, '') as text from documents"
