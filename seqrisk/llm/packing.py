"""Best-fit packing of tokenised documents with linear grouping."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqrisk.llm.common import small_batches, tidy
from seqrisk.llm.registry import query, table
from seqrisk.plans.joins import local_table, stored

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Lengths above capacity / SMALL are packed by configurations, the others by best fit.
SMALL = 8
#: Groups of equal cardinality whose lengths are rounded up to one size.
GROUPS = 64
#: Part of each configuration's sequences that are filled by it. Real lengths that fit better than the
#: rounded ones use up the stock unevenly; the rest is left to best fit, which evens it out. Of these plans the
#: one with the fewest sequences is taken; 0 is best fit alone.
SHARES = (0.8, 0.4, 0.0)
#: New pre-tokens after which those that were not met again are given up; a Python worker keeps the ids of twice as many.
CACHE = 80_000


class Encoder:
    """Ids of whole texts by a byte-level BPE file, as little-endian unsigned 32-bit bytes.

    Merges never leave a pre-token, so each distinct pre-token is encoded once and kept while it is met again. Texts of Latin-1
    characters are cut by the tokenizer's own pattern, spelled out for those; any other text, and any
    with unusual white space, is cut by the tokenizer. Marker strings of special tokens are the tokens that the file
    names for them, as in the library's default setting.
    """

    LATIN = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
        r"| ?[^ \t-\rA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
        r"|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
    )
    OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u0100-\U0010ffff]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = whole = Tokenizer.from_file(path)
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.marker = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.split = whole.model, whole.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # Byte-level vocabularies spell a byte as its character if that is printable, else as one from 256 on.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.spelled = {b: 256 + n for n, b in enumerate(hidden)}
        self.blank = chr(self.spelled[32])

    def encode(self, text: str) -> bytes:
        if self.marker and self.marker.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self.OTHER.search(text):
            return b"".join(self._ids(spelled) for spelled, _ in self.split(text))
        cuts = self.LATIN.findall(text)
        found = list(map(self.known.get, cuts))
        if None in found:
            if len(self.known) > CACHE:
                self.known, self.before = {}, self.known
            known, before = self.known, self.before
            for n, cut in enumerate(cuts):
                if found[n] is None:
                    found[n] = known[cut] = known.get(cut) or before.get(cut) or self._ids(self._spell(cut))
        return b"".join(found)

    def _spell(self, cut: str) -> str:
        if cut.isascii() and cut.isprintable():
            return cut.replace(" ", self.blank)
        return cut.encode().decode("latin-1").translate(self.spelled)

    def _ids(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each row: ``doc_id, piece, start, length, ids_crc32, _part, _nth``.

    Only documents of more than ``capacity`` tokens are cut, and only their first piece may be shorter.
    ``_nth`` counts the pieces of the same length in the task ``_part``. ``with_ids`` adds ``ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer).encode
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = encode(text.as_py() or "") + end
                    total = len(ids) // 4
                    start, piece = 0, 0
                    while start < total:
                        length = ((total - 1) % capacity + 1) if start == 0 else capacity
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc, piece, start, length, zlib.crc32(own), part, seen[length])
                        rows.append((*row, np.frombuffer(own, "<u4").astype("<i8")) if with_ids else row)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.list_(pa.int64())] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part long, _nth long" + ", ids array<long>" * with_ids
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Fractional optimum of cutting stock for few sizes: (how many of each size, how many sequences).

    Column generation: a basis of configurations, priced by an unbounded knapsack over the capacity.
    """
    k, size = len(sizes), np.array(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    cost, need = np.ones(k), np.array(demand, float)
    by_room = [np.flatnonzero(size <= c) for c in range(capacity + 1)]
    for _ in range(40 * k):
        amounts, dual = np.linalg.solve(basis, need), np.linalg.solve(basis.T, cost)
        if dual.min() < -1e-9:  # a size may be cut too often
            column, price = np.zeros(k), 0.0
            column[int(dual.argmin())] = -1.0
        else:
            best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
            for c in range(int(size.min()), capacity + 1):
                fit = by_room[c]
                value = best[c - size[fit]] + dual[fit]
                top = int(value.argmax())
                best[c], pick[c] = (value[top], fit[top]) if value[top] > best[c - 1] else (best[c - 1], -1)
            if best[capacity] < 1 + 1e-7:
                break
            column, price, c = np.zeros(k), 1.0, capacity
            while c > 0:
                if pick[c] < 0:
                    c -= 1
                else:
                    column[pick[c]] += 1
                    c -= sizes[pick[c]]
        step = np.linalg.solve(basis, column)
        if step.max() <= 1e-12:
            break
        ratio = np.where(step > 1e-12, amounts / np.where(step > 1e-12, step, 1.0), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price
    amounts = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int).tolist(), float(amounts[j])) for j in range(k) if cost[j] > 0 and amounts[j] > 0]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """Where the items of each length go: rows ``(length, first, last, sequence, offset)``, and the sequences.

    Items of a length are told apart by rank; ranks from ``first`` to before ``last`` lie one each in the
    sequences from ``sequence`` on, all at ``offset``. Input and output are as long as there are
    lengths and runs of equal sequences, never as there are items. The best of the plans for ``SHARES``, so never
    worse than best fit.
    """
    # Large lengths, longest first, in groups of equal cardinality; each group has the size of its longest.
    large = sorted(s for s, n in counts.items() if n and capacity // SMALL < s < capacity)
    width = max(1, -(-sum(counts[s] for s in large) // groups))
    sizes: list[int] = []
    demand: list[int] = []
    for s in reversed(large):
        n = counts[s]
        while n:
            if not demand or demand[-1] == width:
                sizes.append(s)
                demand.append(0)
            take = min(n, width - demand[-1])
            demand[-1] += take
            n -= take
    solution = configurations(sizes, demand, capacity) if sizes else []
    return min((_filled(counts, capacity, sizes, solution, share) for share in SHARES), key=lambda plan: plan[1])


def _filled(
    counts: dict[int, int], capacity: int, sizes: list[int], solution: list[tuple[list[int], float]], share: float
) -> tuple[list[tuple], int]:
    """The plan that fills a share of the solution's sequences with real lengths and leaves the rest to best fit."""
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows: list[tuple] = []
    runs: dict[int, list[list[int]]] = {}  # room: [first sequence, sequences]
    sequences = 0

    def put(s: int, n: int, sequence: int, offset: int) -> None:
        rows.append((s, used[s], used[s] + n, sequence, offset))
        used[s] += n
        left[s] -= n

    def keep(sequence: int, n: int, room: int) -> None:
        if n and room:
            runs.setdefault(room, []).append([sequence, n])

    large = sorted(s for s in left if capacity // SMALL < s < capacity)
    for config, amount in sorted(solution, key=lambda x: -x[1]):
        times = int(amount * share)
        if not times:
            continue
        slots = [sizes[g] for g, c in enumerate(config) for _ in range(c)]
        open_runs = [(sequences, times, 0)]
        sequences += times
        for k, slot in enumerate(slots):
            filled = []
            for first, n, offset in open_runs:
                # A real length for the rounded one: the longest of its size or below, at last the longest that fits.
                most = capacity - offset if k == len(slots) - 1 else slot
                while n:
                    at = bisect_right(large, most) - 1
                    if at < 0:
                        filled.append((first, n, offset))
                        break
                    take = min(n, left[large[at]])
                    put(large[at], take, first, offset)
                    filled.append((first, take, offset + large[at]))
                    first, n = first + take, n - take
                    if not left[large[at]]:
                        del large[at]
            open_runs = filled
        for first, n, offset in open_runs:
            keep(first, n, capacity - offset)
    # What is left, longest first, into the tightest room; equal items fill a sequence before the next.
    rooms = sorted(runs)
    for s in sorted(left, reverse=True):
        while left[s]:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                room, each = capacity, capacity // s
                first, n = sequences, -(-left[s] // each)
                sequences += n
            else:
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
                each = room // s
            full = min(n, left[s] // each)
            for i in range(each if full else 0):
                put(s, full, first, capacity - room + i * s)
            odd = min(left[s], each - 1) if full < n else 0
            for i in range(odd):
                put(s, 1, first + full, capacity - room + i * s)
            for start, many, rest in ((first, full, room - each * s), (first + full, int(odd > 0), room - odd * s), (first + full + (odd > 0), n - full - (odd > 0), room)):
                if many and rest:
                    keep(start, many, rest)
                    if len(runs[rest]) == 1:
                        rooms.insert(bisect_left(rooms, rest), rest)
    return rows, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` of ``token_pieces``, stored, with ``sequence_id`` and ``offset``.

    The driver gets the number of pieces of each length (at most ``capacity`` numbers) and plans with those.
    A piece's rank among those of its length is its place in its task plus the counts of the tasks before.
    """
    spark = pieces.sparkSession
    cells = stored(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_in")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_in").alias("n")).collect()}
    rows, _ = packing_plan(counts, capacity, groups)
    plan = local_table(spark, rows, "_length bigint, _first bigint, _last bigint, _sequence bigint, offset bigint")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = cells.select("_part", "length", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_head"))
    ranked = pieces.join(heads, ["_part", "length"]).withColumn("_rank", F.col("_head") + F.col("_nth"))
    within = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    placed = ranked.join(F.broadcast(plan), within)
    kept = [c for c in pieces.columns if c not in ("_part", "_nth")]
    return placed.select(*kept, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")


def packed_sequences(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) per piece of ``docs`` (doc_id, text).

    Every row is packed on its own, also where ids or whole rows repeat. A NULL or empty text is the end
    token alone; texts of any length are tokenised whole; NULL ids stay NULL; an empty table gives no rows;
    other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return pack(stored(token_pieces(docs, path, capacity, end_id, with_ids)), capacity)


@query("op4_linear_grouping_pack")
def op4_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"))
