"""Byte-level BPE over columns: ids of whole texts by matrix rounds, and texts of ids."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import small_batches, tidy
from seqrisk.llm.registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Symbols of the widest matrix; longer pieces go through a heap, because a round for each merge would be quadratic.
WIDEST = 512
#: Pieces whose ids a task keeps, and pieces that are looked up together.
CACHE, TOGETHER = 200_000, 400_000
#: Numbers of a matrix, at most.
CELLS = 1 << 21
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by id, from lines of a base64 string and its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(n) for _, n in pairs))
    for text, n in pairs:
        tokens[int(n)] = base64.b64decode(text)
    return tokens


class Pairs:
    """Hash table from two neighbouring ids to the id of their bytes together.

    Open addressing in two arrays, four times as long as there are pairs; a probe is one gather for all keys
    that are still looking.
    """

    def __init__(self, tokens: list[bytes], ids: dict[bytes, int]):
        left, right, whole = [], [], []
        for token, own in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(own)
        keys = self.key(np.array(left, np.int64), np.array(right, np.int64))
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        whole_ids, at = np.array(whole, np.int32), self.slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[at[waiting]] < 0]
            self.keys[at[free]] = keys[free]  # of several on one slot the last stays
            won = self.keys[at[waiting]] == keys[waiting]
            self.found[at[waiting[won]]] = whole_ids[waiting[won]]
            waiting = waiting[~won]
            at[waiting] = (at[waiting] + 1) & self.mask

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs; ``NONE`` where there is none or either side is padding (negative)."""
        out = np.full(a.shape, NONE, np.int32)
        looking = np.flatnonzero((a >= 0) & (b >= 0))
        keys = self.key(a.ravel()[looking], b.ravel()[looking])
        at, flat = self.slot(keys), out.ravel()
        while len(looking):
            there = self.keys[at]
            hit = there == keys
            flat[looking[hit]] = self.found[at[hit]]
            on = ~hit & (there >= 0)
            looking, keys, at = looking[on], keys[on], (at[on] + 1) & self.mask
        return out


class Encoder:
    """Ids of texts: cut by a pattern, each piece merged on its own, without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ids = {token: n for n, token in enumerate(self.tokens) if token}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = Pairs(self.tokens, self.ids)
        self.near, self.far, self.beyond = _cutters(pattern)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        cut = self.far if self.beyond.search(text) else self.near
        if len(text) <= TOGETHER:
            yield cut.findall(text)
            return
        found = (m.group() for m in cut.finditer(text))
        while some := list(islice(found, TOGETHER)):
            yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = [bytearray() for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            for some in self.pieces(text):
                held.append((i, some))
                n += len(some)
                if n >= TOGETHER:
                    self._settle(held, out)
                    n = 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[bytearray]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({piece for _, some in held for piece in some} - self.known.keys())
        self.known.update(zip(new, self.merged([piece.encode() for piece in new])))
        for i, some in held:
            out[i] += b"".join(map(self.known.__getitem__, some))
        held.clear()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its own id if it is a token, else by merges of the least pair, leftmost first."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            own = self.ids.get(piece)
            if own is not None:
                out[n] = own.to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[n] = self._by_heap(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(n)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for n, ids in zip(some, self._by_rounds([pieces[n] for n in some], width)):
                    out[n] = ids
        return out

    def _by_rounds(self, pieces: list[bytes], width: int) -> list[bytes]:
        """One merge in every row a round; rows without a pair leave the matrix, and its last column goes."""
        size = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.single[flat], np.int32(-1))
        rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), int)
            least = rank[np.arange(len(rows)), j] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for n, own in zip(rows[done], ids[done]):
                    out[n] = own[own >= 0].tobytes()
                on = ~done
                rows, ids, rank, j, least = rows[on], ids[on], rank[on], j[on], least[on]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[here, j] = least
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > j[:, None]), axis=1)
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= j[:, None]), axis=1)
            for left in (j - 1, j):
                at = np.flatnonzero((left >= 0) & (left < rank.shape[1]))
                rank[at, left[at]] = self.pairs.ranks(ids[at, left[at]], ids[at, left[at] + 1])
        return out

    def _by_heap(self, piece: bytes) -> bytes:
        """The same merges for a long piece, with a queue of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        both = np.array(ids, np.int32)
        first = self.pairs.ranks(both[:-1], both[1:])
        queue = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(queue)
        rank = first.tolist() + [int(NONE)]
        tokens, known = self.tokens, self.ids.get
        while queue:
            r, i = heapq.heappop(queue)
            if rank[i] != r:
                continue
            ids[i], gone = r, nxt[i]
            rank[gone], nxt[i] = -1, nxt[gone]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a in (prev[i], i):
                if a >= 0:
                    b = nxt[a]
                    own = known(tokens[ids[a]] + tokens[ids[b]]) if b < n else None
                    rank[a] = int(NONE) if own is None else own
                    if own is not None:
                        heapq.heappush(queue, (own, a))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return np.array(out, "<i4").tobytes()


def _cutters(pattern: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """The pattern for texts without characters beyond U+FFFF, for texts with such, and a search for them.

    Letters, numbers and white space are written out as the classes that the tiktoken library takes for them, so that
    its Unicode version counts; Python's own patterns look such classes up in a table, up to U+FFFF.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    near = far = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        there = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        own = there.decode_bytes(there.encode_ordinary(every)).decode()
        near, far = _spelled(near, name, [c for c in own if c <= "\uffff"]), _spelled(far, name, own)
    return re.compile(near), re.compile(far), re.compile("[\U00010000-\U0010ffff]")


def _spelled(pattern: str, name: str, members: Iterable[str]) -> str:
    """A pattern with a class by name, inside and outside of brackets, written out; ``\\S`` goes with ``\\s``."""
    spans: list[list[int]] = []
    for p in map(ord, members):
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    out, inside, at = [], False, 0
    while at < len(pattern):
        if pattern.startswith(name, at):
            out.append(ranges if inside else f"[{ranges}]")
            at += len(name)
        elif name == r"\s" and pattern.startswith(r"\S", at):
            if inside:
                raise ValueError(f"a class with \\S in {pattern}")
            out.append(f"[^{ranges}]")
            at += 2
        else:
            step = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at : at + step])
            at += step
    return "".join(out)


def token_ids(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids`` (array of int) of whole texts, row by row; nothing is shuffled.

    A NULL text is an empty one and has no ids; a NULL doc_id stays; rows that repeat are encoded each; an empty table
    gives no rows; other columns are ignored. Long texts are cut in bounded lists of pieces, and only
    their ids are held whole.
    """
    path, cut = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path, cut)
            for some in _spans(batch, 1):
                coded = encoder.encode([text or "" for text in some.column(1).to_pylist()])
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([some.column(0), lists], ["doc_id", "ids"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def _spans(batch: pa.RecordBatch, column: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes or list entries in a column, a row at least."""
    sizes, at = _sizes(batch.column(column)), 0
    while at < batch.num_rows:
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _sizes(column: pa.Array) -> np.ndarray:
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)


def token_bytes(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``coded`` (doc_id, ids) with ``decoded``: the bytes of the ids, row by row.

    NULL or empty ids are no bytes; an id that the file does not have is an error.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = None
        for batch in batches:
            if table_of is None:
                tokens = read_ranks(path)
                size = np.array([len(t) for t in tokens])
                table_of = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
            for some in _spans(batch, 1, 1 << 20):
                lengths = _sizes(some.column(1))
                flat = some.column(1).flatten().to_numpy(zero_copy_only=False)
                made = _joined(flat, *table_of)
                ends = np.concatenate([[0], np.cumsum(table_of[2][flat])])[np.concatenate([[0], np.cumsum(lengths)])]
                column = pa.Array.from_buffers(
                    pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(made)]
                )
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), column], ["doc_id", "ids", "decoded"])

    return coded.select(F.col("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")


def _joined(ids: np.ndarray, blob: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Bytes of all ids, a million at a time."""
    out = []
    for at in range(0, len(ids), 1 << 20):
        some = ids[at : at + (1 << 20)]
        if len(some) and (some.min() < 0 or some.max() >= len(size) or (size[some] == 0).any()):
            raise ValueError("an id that the vocabulary does not have")
        long = size[some]
        shift = start[some] - (np.cumsum(long) - long)
        out.append(blob[np.repeat(shift, long) + np.arange(int(long.sum()))].tobytes())
    return b"".join(out)


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = token_bytes(token_ids(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
