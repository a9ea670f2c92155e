"""Substring dedup: paragraph MinHash banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import connected, give_back, small_batches, tidy
from seqrisk.llm.registry import query, table
from seqrisk.llm.runs import shared_runs, text_id
from seqrisk.plans.joins import lookup_join, release, settled, stored

#: Words of the shortest paragraph (line) that counts as a passage.
LEAST_WORDS = 20
SHINGLE = 5
SIMILARITY = 0.8
#: Bands of the signature and their rows: a pair at 0.8 misses all with probability 0.0018.
BANDS, ROWS = 12, 4
#: Different paragraphs of one bucket that one task compares; larger buckets are compared part by part.
PART = 4096

_MIX = np.random.default_rng(6).integers(0, 1 << 32, 2 * BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def passages(data: bytes, least: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """Lines with enough words: number, first byte, byte behind, lower-case words."""
    begin = 0
    for number, line in enumerate(data.split(b"\n")):
        words = line.lower().split()
        if len(words) >= least:
            yield number, begin, begin + len(line), words
        begin += len(line) + 1


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    grams = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams)), np.uint64)


def node_of(words: list[bytes]) -> int:
    """Paragraphs with the same words are one node."""
    return np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).astype(np.int64).item()


def band_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """Band keys of each set: rows of a band are minima of the hashes' upper halves under different mixings."""
    flat = (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]])
    keys = np.zeros((len(hashes), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(hashes), band + 1, np.uint64)
        for row in range(ROWS):
            k = band * ROWS + row
            low = np.minimum.reduceat((flat ^ _MIX[2 * k]) * _MIX[2 * k + 1], starts)
            key = (key ^ low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def signed_passages(docs: DataFrame, least: int = LEAST_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Every passage with its node and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, sets = [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.large_binary())):
                    for number, begin, end, words in passages(text.as_py() or b"", least):
                        rows.append((doc, number, begin, end, len(words), node_of(words)))
                        sets.append(np.unique(shingles(words, shingle)))
                if rows:
                    bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sets).ravel()), BANDS).cast(pa.list_(pa.int64()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([*cols, bands], names)

    names = ["doc_id", "paragraph", "begin", "end", "words", "node", "bands"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, paragraph int, begin long, end long, words int, node long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, wanted: DataFrame, least: int, shingle: int) -> DataFrame:
    """``node, grams`` of the wanted passages (``_doc``, ``_numbers``), read from the documents again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for text, numbers in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist()):
                numbers = set(numbers)
                for number, _, _, words in passages(text.as_py() or b"", least):
                    if number in numbers:
                        nodes.append(node_of(words))
                        sets.append(np.unique(shingles(words, shingle)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    found = lookup_join(docs.select(F.col("doc_id").cast("long").alias("_of"), F.col("text").cast("string").alias("_text")), wanted, F.col("_of").eqNullSafe(F.col("_doc")))
    return found.select("_text", "_numbers").mapInArrow(tidy(run), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams"))


def linked_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first set of its component under Jaccard similarity.

    From each set the search goes on to all sets not reached yet; sets of one tight group are reached
    from its first, so they are not compared with each other.
    """
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    label = np.full(len(sets), -1)
    rest = np.arange(len(sets))
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    while len(rest):
        queue = [rest[0]]
        label[rest[0]] = rest[0]
        rest = rest[1:]
        while queue and len(rest):
            one = queue.pop()
            own = flat[starts[one] : starts[one] + size[one]]
            mark[own] = 1
            lengths = size[rest]
            inside = np.repeat(starts[rest] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.add.reduceat(mark[flat[inside]], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            mark[own] = 0
            near = common >= similarity * (size[one] + lengths - common) - 1e-9
            label[rest[near]] = label[one]
            queue += rest[near].tolist()
            rest = rest[~near]
    return label


def verified_links(members: DataFrame, similarity: float) -> DataFrame:
    """Edges ``a, b`` that span the links of ``members`` (key, node, grams) within each key."""
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    hot = counts.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    cut = lookup_join(members, hot, ["key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cut.withColumn("with", F.explode(met)).select(
        "key", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "node", "grams"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            label = linked_sets(sets, similarity) if len(sets) > 1 else np.arange(len(sets))
            node = np.array(nodes, np.int64)
            on = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[label[on]])], ["a", "b"])

        for batch in batches:
            at = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for here, node, grams in zip(at, batch.column(3).to_pylist(), batch.column(4)):
                if here != cell:
                    if len(sets) > 1:
                        yield links()
                    cell, nodes, sets = here, [], []
                nodes.append(node)
                sets.append(grams.values.to_numpy())
        if len(sets) > 1:
            yield links()

    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long")


PASSAGE = ["doc_id", "paragraph", "begin", "end", "words", "node", "component_id", "keep_doc", "removed"]


def repeated_passages(
    docs: DataFrame, least: int = LEAST_WORDS, shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Passages that are in several documents: ``doc_id, paragraph, begin, end, words, node, component_id, keep_doc, removed``.

    Similar lines (``repeated_lines``), and runs of 50 or more words that are shared word for word at any place of a line or
    across line breaks (``shared_runs``). A run's ``paragraph`` is the line it begins in, its component its words. Runs and
    lines may overlap.
    """
    runs = shared_runs(docs.select("doc_id", "text")).withColumn("component_id", F.col("node"))
    return repeated_lines(docs, least, shingle, similarity).unionByName(runs.select(*PASSAGE))


def repeated_lines(
    docs: DataFrame, least: int = LEAST_WORDS, shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Lines that are in several documents: ``doc_id, paragraph, begin, end, words, node, component_id, keep_doc, removed``.

    A passage is a line of at least ``least`` words, ``begin`` and ``end`` its place in UTF-8 bytes. Lines with the
    same words (ASCII case aside) are one node, so copies are compared once. Nodes that collide in a band are
    joined by bucket and verified by exact Jaccard similarity of their word shingles, read from the text
    again; linked nodes form components. The document with the smallest id in a component keeps its passages,
    in all others they are marked for removal; repeats inside one document stay. NULL and empty texts have no
    passages; rows with a NULL id never keep, rows that share an id are one document; long texts are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    return settled(lambda: _repeated_lines(docs, least, shingle, similarity))


def _repeated_lines(docs: DataFrame, least: int, shingle: int, similarity: float) -> DataFrame:
    signed = stored(signed_passages(docs.select("doc_id", "text"), least, shingle))
    found = stored(signed.drop("bands"))
    keyed = signed.select("node", F.explode("bands").alias("key"))
    collide = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    members = stored(lookup_join(keyed, collide, ["key"]).distinct())
    release(signed)
    # Similar paragraphs collide in most bands: of the buckets that hold the same nodes one is enough.
    marks = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    members = stored(lookup_join(members, marks.groupBy("n", "x", "lo", "hi").agg(F.min("key").alias("key")).select("key"), ["key"]))
    nodes = stored(members.select("node").distinct())
    at = lookup_join(found.select("node", "doc_id", "paragraph"), nodes, ["node"], at_hand=True)
    wanted = (
        at.groupBy("node").agg(F.min(F.struct("doc_id", "paragraph")).alias("at"))
        .groupBy(F.col("at.doc_id").alias("_doc")).agg(F.collect_set("at.paragraph").alias("_numbers"))
    )
    sets = shingle_sets(docs, wanted, least, shingle)
    roots = connected(verified_links(stored(members.join(sets, "node").select("key", "node", "grams")), similarity), "a", "b")
    ends = found.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"))
    placed = ends.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", F.coalesce("root", "node").alias("component_id"), "first", "last", "nameless"
    )
    placed = stored(placed)
    shared = placed.groupBy("component_id").agg(
        F.min("first").alias("keep_doc"), F.max("last").alias("last"), F.sum("nameless").alias("nameless")
    ).where((F.col("keep_doc") != F.col("last")) | (F.col("keep_doc").isNotNull() & (F.col("nameless") > 0)))
    repeated = placed.select("node", "component_id").join(shared.select("component_id", "keep_doc"), "component_id")
    return lookup_join(found, repeated, ["node"]).select(
        "doc_id", "paragraph", "begin", "end", "words", "node", "component_id", "keep_doc",
        (~F.col("doc_id").eqNullSafe(F.col("keep_doc"))).alias("removed"),
    )


def left_of(data: bytes, gone: set[int], runs: list[tuple[int, int]], least: int) -> bytes:
    """The text without the lines that are one of the nodes and without the runs; where a run is cut, the line ends."""
    cut = {n for n, _, _, words in passages(data, least) if node_of(words) in gone} if gone else set()
    out, begin, at = [], 0, 0
    runs = sorted(runs)
    for n, line in enumerate(data.split(b"\n")):
        end = begin + len(line)
        pieces, here, touched = [], begin, False
        while at < len(runs) and runs[at][1] <= begin:
            at += 1
        for first, last in runs[at:]:
            if first >= end:
                break
            touched |= last > begin
            pieces.append(data[here : max(here, first)])
            here = max(here, min(last, end))
        pieces.append(data[here:end])
        if n not in cut:
            out += [x for x in (p.strip() for p in pieces) if x] if touched else [line]
        begin = end + 1
    return b"\n".join(out)


def without_passages(text: Column, nodes: Column, runs: Column, least: int = LEAST_WORDS) -> Column:
    """The text without the nodes' lines and the runs (``begin, end``); NULL if nothing but white space is left.

    The column is not deterministic for Spark, so a filter on it stays above it. Pushed below, the filter would cut every text a
    second time, in a second Python worker for each core.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array, removed: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, gone, cuts in zip(texts.cast(pa.large_binary()), removed.to_pylist(), spans.to_pylist()):
            left = left_of(text.as_py() or b"", set(gone or ()), [(c["begin"], c["end"]) for c in cuts or ()], least)
            out.append(left.decode() if left.strip() else None)
        made = pa.array(out, pa.string())
        give_back()
        return made

    return run.asNondeterministic()(text, nodes, runs)


def documents_without_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the marked passages cut from ``text`` and ``n_chars`` counted again; emptied documents go."""
    lines = repeated_lines(docs, least).where("removed").select("doc_id", "node", F.lit(None).cast("struct<text_id:long,begin:long,end:long>").alias("run"))
    runs = shared_runs(docs.select("doc_id", "text")).where("removed").select("doc_id", F.lit(None).cast("long").alias("node"), F.struct("text_id", "begin", "end").alias("run"))
    per_doc = lines.unionByName(runs).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("node").alias("_gone"), F.collect_set("run").alias("_runs"))
    joined = lookup_join(docs, per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    joined = joined.withColumn("_runs", F.filter("_runs", lambda r: r["text_id"] == text_id(F.col("text"))))
    cut = F.col("_gone").isNotNull()
    text = F.when(cut, without_passages(F.when(cut, F.col("text")), F.col("_gone"), F.col("_runs"), least)).otherwise(F.col("text"))
    kept = joined.withColumn("_text", text).where(~cut | F.col("_text").isNotNull())
    changed = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in docs.columns])


@query("op6_paragraph_minhash")
def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
