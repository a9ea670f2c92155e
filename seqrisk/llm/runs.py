"""Runs of words that several documents share word for word, wherever in a text they begin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqrisk.llm.common import small_batches, tidy
from seqrisk.plans.joins import lookup_join, release, settled, stored

#: Words of the shortest run.
RUN = 50
#: Words of an anchor: every window of ``RUN`` words picks the least of its ``RUN - GRAM + 1`` word groups.
GRAM = 20

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` words in a row, put together from groups of 1, 2, 4, ... words."""
    n = len(words) - size + 1
    out, done = np.zeros(n, np.uint64), 0
    group, width, power = words, 1, _BASE
    while True:
        if size & width:
            out = out * power + group[done : done + n]
            done += width
        if 2 * width > size:
            return out
        group = group[:-width] * power + group[width:]
        power, width = np.uint64(int(power) ** 2 % (1 << 64)), 2 * width


def anchors(words: list[bytes], run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``run`` words (lower case) its anchor; and the hashes of the words.

    The anchor depends on the window's words alone, so equal windows have equal anchors.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < run:
        return hashes[:0], hashes
    least = gram_hashes(hashes, gram)
    least ^= least >> np.uint64(32)
    least *= _MIX
    least ^= least >> np.uint64(29)
    wide = run - gram + 1
    width = 1
    while 2 * width <= wide:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    return least, hashes


def _named(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def _anchors(docs: DataFrame, run: int, gram: int) -> DataFrame:
    """``doc_id, text_id, anchors``: the different anchors of each text with at least ``run`` words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for n, text in enumerate(batch.column(2).cast(pa.large_binary())):
                least, _ = anchors((text.as_py() or b"").lower().split(), run, gram)
                if len(least):
                    rows.append(n)
                    found.append(np.unique(least).view(np.int64))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_id", "anchors"])

    return _named(docs).mapInArrow(tidy(work), "doc_id long, text_id long, anchors array<long>")


def _blocks(texts: DataFrame, run: int, gram: int) -> DataFrame:
    """Windows in a row with the same anchor, one of ``_anchors``, as one row: first place, windows' hashes, bytes and lines."""
    names = ["doc_id", "text_id", "place", "anchor", "block", "head", "tail", "n", "windows", "begins", "ends", "lines"]
    schema = (
        "doc_id long, text_id long, place int, anchor long, block long, head long, tail long, n int,"
        " windows array<long>, begins array<int>, ends array<int>, lines array<int>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for n in range(batch.num_rows):
                data, wanted = texts[n].as_py(), batch.column(3)[n].values.to_numpy()
                least, hashes = anchors(data.lower().split(), run, gram)
                own = least.view(np.int64)
                at = np.flatnonzero(np.isin(own, wanted))
                if not len(at):
                    continue
                spans = np.fromiter((x for m in _WORD.finditer(data) for x in m.span()), np.int32).reshape(-1, 2)
                breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                begin, end = spans[at, 0], spans[at + run - 1, 1]
                line = np.searchsorted(breaks, begin).astype(np.int32)
                windows = gram_hashes(hashes, run)[at].view(np.int64)
                heads = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(own[at]) != 0)))
                tails = np.append(heads[1:], len(at))
                block = [xxhash.xxh64_intdigest(windows[i:j].tobytes()) for i, j in zip(heads, tails)]
                cuts = pa.array(np.append(heads, len(at)).astype(np.int32))
                ids = [pa.repeat(batch.column(k)[n], len(heads)) for k in (0, 1)]
                plain = (at[heads].astype(np.int32), own[at[heads]], np.array(block, np.uint64).view(np.int64), windows[heads], windows[tails - 1], (tails - heads).astype(np.int32))
                cols = [pa.array(x) for x in plain]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (windows, begin, end, line)]
                yield pa.RecordBatch.from_arrays([*ids, *cols, *lists], names)

    return texts.select("doc_id", "text_id", "text", "_anchors").mapInArrow(tidy(work), schema)


def _ends(found: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest id of each key, and its rows without an id."""
    return found.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("nameless").alias("nameless"))


def _by_id(*kept: str) -> list[Column]:
    return [*map(F.col, kept), F.col("doc_id").alias("first"), F.col("doc_id").alias("last"), F.col("doc_id").isNull().cast("long").alias("nameless")]


#: Several documents have it; rows without an id are other documents than those with one.
_SHARED = "first != last or first is not null and nameless > 0"


def _pieces(blocks: DataFrame) -> DataFrame:
    """Parts of the blocks that several documents have: ``doc_id, text_id, keep_doc, lo, hi, head, tail, begin, end, line``.

    Where an anchor has one block only, its documents are those of each of its windows; the blocks of other
    anchors, at the ends of runs, are compared window by window, equal blocks once. What is joined grows with the texts, so it
    is joined by key at any size; only blocks that are taken apart bring their lists along.
    """
    marks = blocks.select(*_by_id("anchor", "block")).groupBy("anchor").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("nameless").alias("nameless"),
        F.min("block").alias("_lo"), F.max("block").alias("_hi"),
    )
    marks = stored(marks)
    once = marks.where("_lo = _hi").where(_SHARED).select("anchor", F.col("first").alias("keep_doc"))
    last = F.col("n") - 1
    plain = blocks.select(
        "doc_id", "text_id", "anchor", F.col("place").alias("lo"), (F.col("place") + last).alias("hi"), "head", "tail",
        F.get("begins", F.lit(0)).alias("begin"), F.get("ends", last).alias("end"), F.get("lines", F.lit(0)).alias("line"),
    )
    whole = plain.join(once, "anchor").select("doc_id", "text_id", "keep_doc", "lo", "hi", "head", "tail", "begin", "end", "line")
    taken = lookup_join(blocks, marks.where("_lo != _hi").select("anchor"), ["anchor"], at_hand=True)
    opened = taken.select(*_by_id("anchor", "block", "windows")).groupBy("anchor", "block").agg(
        F.first("windows").alias("windows"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("nameless").alias("nameless")
    )
    each = stored(opened).select("anchor", "block", "first", "last", "nameless", F.posexplode("windows").alias("at", "window"))
    shared = _ends(each, "anchor", "window").where(_SHARED).select("anchor", "window", F.col("first").alias("keep_doc"))
    held = each.select("anchor", "block", "at", "window").join(stored(shared), ["anchor", "window"])
    island = F.col("at") - F.row_number().over(Window.partitionBy("anchor", "block", "keep_doc").orderBy("at"))
    part = held.withColumn("_island", island).groupBy("anchor", "block", "keep_doc", "_island").agg(
        F.min("at").alias("_from"), F.max("at").alias("_to"), F.min_by("window", "at").alias("head"), F.max_by("window", "at").alias("tail")
    )
    listed = taken.select("doc_id", "text_id", "place", "anchor", "block", "begins", "ends", "lines")
    return whole.unionByName(listed.join(stored(part), ["anchor", "block"]).select(
        "doc_id", "text_id", "keep_doc", (F.col("place") + F.col("_from")).alias("lo"), (F.col("place") + F.col("_to")).alias("hi"), "head", "tail",
        F.get("begins", "_from").alias("begin"), F.get("ends", "_to").alias("end"), F.get("lines", "_from").alias("line"),
    ))


def shared_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """Runs of at least ``run`` words that several documents share: ``doc_id, text_id, paragraph, begin, end, words, node, keep_doc, removed``.

    Exact: a run is made of all windows of ``run`` words (white space and ASCII case aside) that the same smallest
    document has, at any place of a line and across line breaks. First only each window's anchor is looked at, about one
    for sixteen words; then the windows at anchors of several documents, which are compared by anchor and hash, 128
    bits. Every step is linear in the windows: a window meets the smallest id, not the other windows.
    """
    return settled(lambda: _shared_runs(docs, run, gram))


def _shared_runs(docs: DataFrame, run: int, gram: int) -> DataFrame:
    found = stored(_anchors(docs, run, gram))
    each = found.select("doc_id", "text_id", F.explode("anchors").alias("anchor"))
    shared = _ends(each.select(*_by_id("anchor")), "anchor").where(_SHARED).select("anchor")
    wanted = lookup_join(each, shared, ["anchor"]).groupBy(
        F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")
    ).agg(F.collect_set("anchor").alias("_anchors"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_id") == F.col("_text"))
    blocks = stored(_blocks(lookup_join(_named(docs), wanted, same), run, gram))
    release(found)
    parts = _pieces(blocks)
    of = ["doc_id", "text_id", "keep_doc"]
    along = Window.partitionBy(*of).orderBy("lo", "hi")
    before = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", F.coalesce((F.col("lo") > before + 1).cast("long"), F.lit(0)))
    parts = parts.withColumn("_island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*of, "_island").agg(
        F.min("line").alias("paragraph"), F.min("begin").cast("long").alias("begin"), F.max("end").cast("long").alias("end"),
        (F.max("hi") - F.min("lo") + run).alias("words"),
        F.xxhash64(F.min_by("head", "lo"), F.max_by("tail", "hi"), F.max("hi") - F.min("lo")).alias("node"),
    ).select(
        "doc_id", "text_id", "paragraph", "begin", "end", "words", "node", "keep_doc", (~F.col("doc_id").eqNullSafe(F.col("keep_doc"))).alias("removed")
    )


def text_id(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))
