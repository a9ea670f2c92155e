"""SimHash near-duplicates with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import connected, small_batches, tidy
from seqrisk.llm.paragraphs import verified_links
from seqrisk.llm.registry import query, table
from seqrisk.plans.joins import lookup_join, settled, stored

RADIUS = 4
SHINGLE = 4
#: Bit blocks of a fingerprint. With two more blocks than differing bits, two blocks are equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of one bucket that one task compares; larger buckets are compared part by part.
PART = 4096
#: Fingerprints for copies with edits, and the bits in which two of them may differ: at 0.8 about 10 do, with a deviation of 3.
PRINTS, WIDE_RADIUS = 10, 16
#: Rows that a task holds while it compares.
CHUNK = 1 << 17


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of the word shingles of a whole text; 0 without words."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.schema.field(1).type) else pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (the last word is sticky overflow) is above the radius."""
    above, equal = counter[-1].copy(), ~counter[-1]
    for bit in range(len(counter) - 2, -1, -1):
        if radius >> bit & 1:
            equal &= counter[bit]
        else:
            above |= equal & counter[bit]
            equal &= ~counter[bit]
    return above


def _distances(planes: np.ndarray, words: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and lane masks in which the row and the row ``shift`` further differ in at most ``radius`` bits.

    ``planes[k]`` holds bit k of 64 rows per word. Differences go into vertical counters, three
    planes at a time through a full adder; after every twelve planes the words in which all lanes are
    beyond the radius are abandoned.
    """
    far, off = shift >> 6, np.uint64(shift & 63)
    counter = [np.zeros(len(words), np.uint64) for _ in range(max(3, radius.bit_length()) + 1)]
    for first in range(0, 66, 3):
        adds = []
        for k in range(first, min(first + 3, 64)):
            plane = planes[k]
            other = plane[words + far]
            if off:
                other = (other >> off) | (plane[words + far + 1] << (np.uint64(64) - off))
            adds.append(plane[words] ^ other)
        x = adds[0]
        y, z = adds[1] if len(adds) > 1 else np.zeros_like(x), adds[2] if len(adds) > 2 else np.zeros_like(x)
        half = x ^ y
        one, two = half ^ z, (x & y) | (z & half)
        up = counter[0] & one
        counter[0] ^= one
        half = counter[1] ^ up
        carry = (counter[1] & up) | (two & half)
        counter[1] = half ^ two
        for bit in range(2, len(counter) - 1):
            counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry
        counter[-1] |= carry
        if first % 12 == 9 or first >= 63:
            valid = valid & ~_exceeds(counter, radius)
            alive = np.flatnonzero(valid)
            if len(alive) < len(valid):
                words, valid, counter = words[alive], valid[alive], [c[alive] for c in counter]
            if not len(words):
                break
    return words, valid


#: Planes in an order that looks at all blocks early, as the equal blocks of a bucket tell nothing.
_ORDER = np.argsort(np.arange(64) % 11, kind="stable")


def _planes(prints: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    width = -(-len(prints) // 64) * 64
    wide = np.zeros((64, 2 * width + 128), np.uint8)
    wide[:, : len(prints)] = bits.T[_ORDER]
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def linked_rows(group: np.ndarray, prints: np.ndarray, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row it is linked with, through links within its group.

    Rows are sorted by ``group``. Every row meets the row one, two, ... further while that is in its
    group. With ``side``, only rows of different sides, and of sides below 0, are compared. Links are folded
    into labels as they appear, so the result is linear in the rows.
    """
    label = np.arange(len(prints))
    rows = np.arange(len(prints))
    shift = 1
    while True:
        # Only groups with more rows than the shift go on; every doubling drops the others.
        _, where, sizes = np.unique(group[rows], return_inverse=True, return_counts=True)
        rows = rows[sizes[where] > shift]
        if not len(rows):
            return label
        here, planes = group[rows], _planes(prints[rows])
        sides = side[rows] if side is not None else None
        for shift in range(shift, 2 * shift):
            same = here[:-shift] == here[shift:] if shift < len(here) else np.zeros(0, bool)
            if not same.any():
                break
            if sides is not None:
                same &= (sides[:-shift] != sides[shift:]) | (sides[:-shift] < 0)
            mask = np.zeros(-(-len(here) // 64) * 64, np.uint8)
            mask[: len(same)] = same
            mask = np.packbits(mask, bitorder="little").view("<u8")
            words = np.flatnonzero(mask)
            words, found = _distances(planes, words, mask[words], shift, radius)
            if len(words):
                lanes = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, lane = np.nonzero(lanes)
                one = words[at] * 64 + lane
                _fold(label, rows[one], rows[one + shift])
        else:
            shift += 1
            continue
        shift += 1
        if shift >= len(here):
            return label


def _fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of linked rows; labels stay flat."""
    x, y = label[a], label[b]
    apart = x != y
    if not apart.any():
        return
    pairs = np.unique(np.stack([np.maximum(x, y)[apart], np.minimum(x, y)[apart]], axis=1), axis=0)

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for u, v in pairs.tolist():
        u, v = root(u), root(v)
        if u != v:
            label[max(u, v)] = min(u, v)
    while True:
        flat = label[label]
        if np.array_equal(flat, label):
            return
        label[:] = flat


def _compare(radius: int):
    """mapInArrow over rows (key, low, high, part, print, name) sorted by cell: edges from each name to the first of its links."""

    def edges(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        key, low, high, part, prints, names = rows
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        side = np.where(low == high, -1, part)
        label = linked_rows(np.cumsum(new), prints.view(np.uint64), radius, side)
        on = np.flatnonzero(label != np.arange(len(label)))
        pair = np.unique(np.stack([names[on], names[label[on]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) < CHUNK:
                continue
            key, low, high = held[:3]
            last = (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(np.argmax(last))
            if cut:
                yield edges([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield edges(held)

    return run


def simhash_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` that span the links of all distinct fingerprints at most ``radius`` bits apart.

    Exact for a radius of 4 or less: two such fingerprints agree in two of six blocks, so they meet in one
    of the 15 buckets of that pair of blocks. Buckets are sorted inside the shuffle's partitions and
    compared by ``linked_rows``; a bucket of more than ``PART`` is dealt out as pairs of parts.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius {radius}: the six blocks are exact from 0 to {RADIUS}")
    keys = []
    for n, ((a, wide), (b, wide_b)) in enumerate(combinations(BLOCKS, 2)):
        x = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << wide) - 1))
        y = F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << wide_b) - 1))
        keys.append(F.lit(n << 24) + F.shiftleft(x, wide_b) + y)
    return _bucket_links(prints.select(F.col("fp").alias("print"), F.col("fp").alias("name"), F.explode(F.array(*keys)).alias("key")), radius)


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges ``a, b`` that span the links of ``keyed`` (key, print, name) inside each key; large buckets go part by part."""
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    hot = hot.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    cut = lookup_join(keyed, hot, ["key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    met = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cut.withColumn("with", F.explode(met)).select(
        "key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "print", "name"
    )
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "part")
    return cells.mapInArrow(tidy(_compare(radius)), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs`` (doc_id, text).

    Equal fingerprints are one class, so copies are compared once. The component's id is the smallest
    doc_id in it, NULL only where all its ids are NULL. NULL and empty texts have fingerprint 0, which is
    linked like any other; texts are read whole; repeated rows stay rows; an empty table gives none;
    other columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(simhash_links(classes.select("fp"), radius), "a", "b")
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = stored(placed)
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return lookup_join(rows, placed.join(names, "root").select("fp", "component_id"), ["fp"], "left").select(
        "doc_id", "fp", "component_id"
    )


# ---------------------------------------------------------------- copies with edits


def _words(data: bytes | None) -> list[bytes]:
    return data.lower().split() if data else []


def _grams(words: list[bytes], shingle: int) -> np.ndarray:
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64)


def _name(words: list[bytes]) -> int:
    """Texts with the same words are one class."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).astype(np.int64))


def wide_fingerprint(hashes: np.ndarray, prints: int) -> np.ndarray:
    """Several independent majority fingerprints of the same distinct shingles."""
    ones = np.zeros((prints, 64), np.int64)
    for at in range(0, len(hashes), 1 << 12):
        some = hashes[at : at + (1 << 12)]
        for k in range(prints):
            mixed = (some ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            ones[k] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def _classes(docs: DataFrame, shingle: int, prints: int) -> DataFrame:
    """``doc_id, name, prints`` of each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                words = _words(text.as_py())
                if words:
                    ids.append(doc)
                    names.append(_name(words))
                    found.append(wide_fingerprint(np.unique(_grams(words, shingle)), prints).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "name", "prints"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, name long, prints array<long>")


def near_links(classes: DataFrame, prints: int = PRINTS, radius: int = WIDE_RADIUS) -> DataFrame:
    """Edges ``a, b`` that span the candidates among ``classes`` (name, prints).

    Two classes are candidates if one of the 16-bit blocks of their fingerprints is equal and their next fingerprint, which is
    independent of it, differs in at most ``radius`` bits.
    """
    keys = []
    for k in range(prints):
        for block in range(4):
            bits = F.shiftrightunsigned(F.col("prints")[k], 16 * block).bitwiseAND(F.lit(0xFFFF))
            keys.append(F.struct((F.lit((4 * k + block) << 16) + bits).alias("key"), F.col("prints")[(k + 1) % prints].alias("print")))
    return _bucket_links(classes.select("name", F.inline(F.array(*keys))), radius)


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, prints: int = PRINTS) -> DataFrame:
    """``doc_id, name, component_id`` of each row with words: copies, with edits too, are one component.

    Texts with the same words (ASCII case aside) are one class. Candidates come from several fingerprints (``near_links``);
    in each group of candidates the Jaccard similarity of the distinct ``shingle``-word shingles, read from the texts
    again, decides exactly: ``similarity`` or more links. Groups are compared part by part where they are large. Two texts at 0.8 share
    no block with probability 0.05, nearer ones less; nothing else is lost. Rows without an id are classes of others or
    of their own, but a class that only such rows have is not compared. Very long texts are read whole, rows that repeat stay rows,
    an empty table gives none, other columns are ignored.
    """
    return settled(lambda: _near_copies(docs, shingle, similarity, prints))


def _near_copies(docs: DataFrame, shingle: int, similarity: float, prints: int) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(_classes(plain, shingle, prints))
    classes = stored(rows.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("prints").alias("prints")))
    roots = connected(near_links(classes.where("least is not null").select("name", "prints"), prints), "a", "b")
    named = classes.select("name", "least")
    placed = lookup_join(named, roots, F.col("name") == F.col("node"), "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    placed = stored(placed)
    several = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    wanted = lookup_join(placed, several, ["root"]).select(F.col("least").alias("_least"), F.col("name").alias("node"), F.col("root").alias("key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, grams = [], []
            for n, (text, name) in enumerate(zip(batch.column(0).cast(pa.large_binary()), batch.column(2).to_pylist())):
                words = _words(text.as_py())
                if words and _name(words) == name:
                    kept.append(n)
                    grams.append(np.unique(_grams(words, shingle)).view(np.int64))
            at = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(grams, pa.list_(pa.int64()))], ["key", "node", "grams"])

    texts = lookup_join(plain, wanted, F.col("doc_id") == F.col("_least")).select("text", "key", "node")
    members = texts.mapInArrow(tidy(sets), "key long, node long, grams array<long>").dropDuplicates(["key", "node"])
    verified = connected(verified_links(stored(members), similarity), "a", "b")
    final = stored(lookup_join(named, verified, F.col("name") == F.col("node"), "left").select("name", "least", F.coalesce("root", "name").alias("root")))
    names = final.groupBy("root").agg(F.min("least").alias("component_id"))
    return lookup_join(rows.select("doc_id", "name"), lookup_join(final, names, ["root"]).select("name", "component_id"), ["name"])


def without_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component of ``near_copies``, that of the smallest doc_id.

    A row goes if its id is not its component's; rows that repeat an id are told apart by nothing else and
    stay or go together. Rows without an id, and texts that are NULL, empty or without a word, stay. Columns of any name but
    ``_gone`` are kept.
    """
    gone = near_copies(docs, shingle, similarity).where(F.col("doc_id") != F.col("component_id"))
    return lookup_join(docs, gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


@query("op3_simhash_bitsliced")
def op3_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
