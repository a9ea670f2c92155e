"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import give_back, tidy
from seqrisk.llm.registry import query, table

#: Labelled documents per language that the fit reads at most, in expectation.
SAMPLE = 2_000
#: Buckets of the letter trigrams.
BUCKETS = 1 << 16
#: Log-odds that a change of language inside a text must gain.
SWITCH = 12.0
#: Log-likelihood of a word in a language whose script it is not in.
FOREIGN = -60.0
#: A language uses a script that has at least this share of its letters.
USES = 0.005
#: First code points of scripts, in order. Fixed values.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other Indic"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1380, "others"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "others"), (0x3040, "Kana"),
    (0x3100, "others"), (0x3400, "Han"), (0xA000, "others"), (0xAC00, "Hangul"), (0xD800, "others"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0x10000, "others"),
    (0x20000, "Han"),
)
#: Texts whose words are labelled together, and those whose letters are scored together.
TOGETHER, SCORED = 4096, 256


class Letters:
    """Tables by code point: letter or not, lower case, script."""

    def __init__(self) -> None:
        chars = [chr(i) for i in range(0x33480)]
        self.letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        self.lower = np.fromiter((ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars))
        names = list(dict.fromkeys(name for _, name in SCRIPTS))
        starts = np.array([first for first, _ in SCRIPTS])
        kind = np.array([names.index(name) for _, name in SCRIPTS])
        self.script = kind[np.searchsorted(starts, np.arange(len(chars)), side="right") - 1].astype(np.uint8)
        self.scripts = len(names)

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of all texts: trigram buckets and scripts of the letters, and each word's text, first letter, begin and end.

        A word is a run of letters. A letter's trigram is it with its neighbours, a blank at the ends of the word.
        """
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        code = np.where(code < len(self.letter), code, 32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        letter = self.letter[code]
        low = np.zeros(len(code) + 2, np.uint32)
        low[1:-1] = np.where(letter, self.lower[code], 0)
        at = np.flatnonzero(letter)
        gram = (low[at] * np.uint32(0x9E3779B1)) ^ (low[at + 1] * np.uint32(0x85EBCA77)) ^ (low[at + 2] * np.uint32(0xC2B2AE3D))
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        bucket = gram >> np.uint32(32 - BUCKETS.bit_length() + 1)
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        begin = at[first]
        end = at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else begin
        owner = np.searchsorted(ends, begin, side="right")
        offset = np.concatenate([[0], ends[:-1]])[owner] if len(owner) else begin
        return bucket, self.script[code[at]], owner, first, begin - offset, end - offset


@dataclass
class LanguageModel:
    """Log-likelihoods of trigram buckets and permitted scripts by language."""

    langs: list[str]
    table: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages

    def spans(self, texts: list[str], letters: Letters) -> list[list[tuple[int, int, int, int]]]:
        """Of each text its spans: begin, end, language, letters."""
        lists: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.langs:
            return lists
        owners, scores, begins, ends, sizes = [], [], [], [], []
        for at in range(0, len(texts), SCORED):
            bucket, script, owner, first, begin, end = letters.words(texts[at : at + SCORED])
            if not len(first):
                continue
            each = np.add.reduceat(self.table[bucket], first, axis=0)
            each += np.where(self.allowed[script[first]], np.float32(0), np.float32(FOREIGN))
            owners.append(owner + at)
            scores.append(each)
            begins.append(begin)
            ends.append(end)
            sizes.append(end - begin)
        if not owners:
            return lists
        owner, score = np.concatenate(owners), np.concatenate(scores)
        state = viterbi(owner, score, SWITCH)
        begin, end, size = np.concatenate(begins), np.concatenate(ends), np.concatenate(sizes)
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(state, prepend=-1) != 0))
        last = np.append(first[1:], len(owner)) - 1
        got = zip(owner[first].tolist(), begin[first].tolist(), end[last].tolist(), state[first].tolist(), np.add.reduceat(size, first).tolist())
        for doc, b, e, lang, n in got:
            lists[doc].append((b, e, lang, n))
        return lists


def viterbi(owner: np.ndarray, score: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word, where a change between neighbours in a text costs ``penalty``.

    ``owner`` (sorted) says whose word it is. All texts advance together, word by word, longest first.
    Ties keep the language, then take the first.
    """
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    length = np.diff(np.append(starts, len(owner)))
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # texts longer than t
    stay = np.ones(score.shape, bool)
    came = np.zeros(len(owner), np.uint8 if score.shape[1] < 256 else np.int32)
    now = score[starts].astype(np.float64)
    final = np.zeros(len(starts), came.dtype)
    for t in range(1, length[0]):
        a = active[t]
        if a < len(now):
            final[a : len(now)] = now[a:].argmax(axis=1)
            now = now[:a]
        at = starts[:a] + t
        top = now.argmax(axis=1)
        moved = now[np.arange(a), top] - penalty
        came[at] = top
        stay[at] = now >= moved[:, None]
        now = np.maximum(now, moved[:, None]) + score[at]
    final[: len(now)] = now.argmax(axis=1)
    state = np.zeros(len(owner), came.dtype)
    here = final.copy()
    for t in range(length[0] - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        own = here[:a]
        state[at] = own
        if t:
            here[:a] = np.where(stay[at, own], own, came[at])
    return state.astype(np.int64)


def letters() -> Letters:
    """The worker's tables; kept beside numpy, so that the next task finds them."""
    kept = vars(np).setdefault("_letter_tables", [])
    if not kept:
        kept.append(Letters())
    return kept[0]


def held_out(doc_id: Column) -> Column:
    """Rows that languages are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Trigram and script counts of each labelled language, from whole texts of at most about ``sample`` documents each.

    Counts are summed by (language, bucket); their number is bounded by languages times buckets.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((1, 0), bool))
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(part)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = letters(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bucket, script, *_ = tables.words([text.as_py()])
                total = sums.setdefault(lang, np.zeros(BUCKETS + tables.scripts, np.int64))
                total += np.bincount(np.append(bucket, script.astype(np.int64) + BUCKETS), minlength=len(total))
        for lang, total in sums.items():
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on), pa.array(total[on])], ["lang", "k", "n"])

    summed = chosen.mapInArrow(tidy(run), "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    size = BUCKETS + letters().scripts
    total = np.zeros((size, len(langs)))
    for r in summed.toLocalIterator():
        total[r["k"], langs.index(r["lang"])] = r["n"]
    grams, scripts = total[:BUCKETS], total[BUCKETS:]
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    allowed = scripts >= USES * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(langs, table, allowed)


SPANS = "array<struct<begin:int,end:int,lang:string,letters:int>>"


def language_spans(model: LanguageModel, text: Column) -> Column:
    """Spans of the text in characters, in order, each with its language and number of letters."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        tables, out = letters(), []
        for at in range(0, len(texts), TOGETHER):
            part = [t or "" for t in texts.slice(at, TOGETHER).to_pylist()]
            for spans in model.spans(part, tables):
                out.append([{"begin": b, "end": e, "lang": model.langs[k], "letters": n} for b, e, k, n in spans])
        kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("letters", pa.int32())])
        made = pa.array(out, pa.list_(kind))
        give_back()
        return made

    return run(F.coalesce(text.cast("string"), F.lit("")))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` for each row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is the language with the most letters in the spans (ties: the first by name), ``score`` its share of the
    letters. Texts that are NULL, empty or without letters, and all texts where nothing could be learned,
    are ``und`` with score 0. A NULL id counts as not held out; repeated rows stay; other columns are ignored.
    """
    model = fit_language(docs)
    spanned = docs.select(F.col("doc_id").cast("long"), language_spans(model, F.col("text")).alias("spans"))

    def letters_in(lang: str) -> Column:
        return F.aggregate("spans", F.lit(0), lambda n, s: n + F.when(s["lang"] == lang, s["letters"]).otherwise(0))

    per_lang = [
        F.struct(letters_in(lang).alias("n"), F.lit(-k).alias("first"), F.lit(lang).alias("lang"))
        for k, lang in enumerate(model.langs)
    ]
    best = F.array_max(F.array(*per_lang)) if per_lang else F.lit(None).cast("struct<n:int,first:int,lang:string>")
    letters_of = F.aggregate("spans", F.lit(0), lambda n, s: n + s["letters"])
    some = letters_of > 0
    return spanned.withColumn("_best", best).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.when(some, F.col("_best.lang")).otherwise("und").alias("lang_pred"),
        F.when(some, F.col("_best.n") / letters_of).otherwise(F.lit(0.0)).alias("score"),
        "spans",
    )


@query("op10_viterbi_language")
def op10_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
