"""Repair of conversation structure: the cheapest edits by a run-length dynamic programme."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import WORD, tidy
from seqrisk.llm.registry import query, table

# What a repair costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = ".!?"
BLANKS = " \t\n\x0b\f\r"
#: Marks that adjacent messages may have: the first letters of their roles.
LEGAL = ("su", "ua", "au")

# Where a repaired conversation may stand, by the roles so far: nothing, "s", "…u", "…a". It ends in the first or the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that an inserted or re-roled message has at each place; only one is possible.
NEEDED = ("user", "user", "assistant", "user")
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(x + y for x, y in zip(row, col)) for col in zip(*b)) for row in a)


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _after(place: int) -> int:
    """Where an inserted or re-roled message leads."""
    return FOLLOWS[place, NEEDED[place][0]]


def _inserts() -> Matrix:
    """Cheapest insertions between any two places."""
    one = tuple(tuple(0 if p == q else INSERT if q == _after(p) else FAR for q in range(4)) for p in range(4))
    return times(times(one, one), times(one, one))


INSERTS = _inserts()
#: Cost from each place behind the last message.
AT_END = onto(INSERTS, (0, FAR, FAR, 0))


# A message's symbol: 0 must go (blank or duplicate), else 1 + 2 x (place of its role in "sua", 3 if none) + truncated.
def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + truncated


def choices(sign: int, place: int) -> list[tuple[str, int, int]]:
    """Edits of one message at a place, in the order of their letters: (letter, cost, next place); without insertions."""
    found = [("D", DELETE, place)]
    if sign:
        extra, initial = TRUNCATED * ((sign - 1) % 2), "sua-"[(sign - 1) // 2]
        if (place, initial) in FOLLOWS:
            found.append(("K", extra, FOLLOWS[place, initial]))
        found.append(("R", REROLE + extra, _after(place)))
    return found


@cache
def power(sign: int, k: int) -> Matrix:
    """Transition of 2^k messages of a symbol: insertions before each, then its edit."""
    if k:
        half = power(sign, k - 1)
        return times(half, half)
    step = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        for _, cost, q in choices(sign, p):
            step[p][q] = min(step[p][q], cost)
    return times(INSERTS, tuple(map(tuple, step)))


def advance(sign: int, n: int, v: Vector) -> Vector:
    """Costs before a run of ``n`` equal messages from those behind it."""
    k = 0
    while n:
        if n & 1:
            v = onto(power(sign, k), v)
        n, k = n >> 1, k + 1
    return v


def level(v: Vector) -> tuple[int, Vector]:
    least = min(v)
    return least, tuple(x - least for x in v)


def unroll(sign: int, n: int, place: int, behind: Vector, out: bytearray) -> int:
    """Append the letters of a run from ``place`` on, the least letter first among the cheapest; the place behind it.

    Long runs are halved: costs in the middle come from the cached powers, so only a logarithm of them is held.
    """
    if n > 64:
        half = n // 2
        place = unroll(sign, n - half, place, level(advance(sign, half, behind))[1], out)
        return unroll(sign, half, place, behind, out)
    costs = [behind]
    for _ in range(n):
        costs.append(onto(power(sign, 0), costs[-1]))
    while n:
        left = costs[n][place]
        for letter, cost, following in choices(sign, place):
            if letter != "D" and left == INSERT + costs[n][_after(place)]:
                letter, following = "I", _after(place)
            elif left != cost + costs[n - 1][following]:
                continue
            break
        else:
            letter, following = "I", _after(place)
        out += letter.encode()
        place = following
        n -= letter != "I"
    return place


def repair(signs: array, lengths: array) -> tuple[int, bytearray]:
    """Cost and letters of the cheapest edits of a conversation given as runs of equal symbols.

    Letters: Delete, Insert, Keep, Rerole; among equally cheap edits the least string. Held per run are four
    small numbers: the costs behind it, less the least of them.
    """
    total, v = 0, AT_END
    behind = bytearray()
    for i in range(len(signs) - 1, -1, -1):
        behind += bytes(v)
        least, v = level(advance(signs[i], lengths[i], v))
        total += least
    out, place = bytearray(), NOTHING
    total += v[NOTHING]
    for i, sign in enumerate(signs):
        at = 4 * (len(signs) - 1 - i)
        place = unroll(sign, lengths[i], place, tuple(behind[at : at + 4]), out)
    while place not in (NOTHING, ASSISTANT):
        out += b"I"
        place = _after(place)
    return total, out


def faults(rows: DataFrame) -> DataFrame:
    """Messages as the repair reads them: ``conv, kind, turn, role, key, initial, blank, truncated, copies, first, text``.

    ``rows``: conv_id, turn, role, text, copies (0: only says that the conversation exists). Equal messages of a turn
    become one entry of kind 0 with their number; which entry holds the first of its role and text is the
    least turn per (conversation, role, text), an aggregate that is joined back. Entries carry a digest
    and no text; the texts follow as kind 1.
    """
    text, role = F.col("text"), F.col("role")
    found = rows.where("copies > 0").select(
        F.col("conv_id").alias("conv"),
        "turn",
        "role",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"),
        F.substring(role, 1, 1).alias("initial"),
        (~text.rlike(WORD)).alias("blank"),
        (~F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).isin(*ENDS)).alias("truncated"),
        F.col("copies").cast("long").alias("copies"),
        "text",
    )
    same = ["conv", "turn", "role", "key", "initial", "blank", "truncated"]
    entries = found.groupBy(*same).agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("later"), F.col("turn").alias("turn"))
    heads = entries.groupBy(F.col("conv").alias("_c"), F.col("key").alias("_k")).agg(F.min(when)["turn"].alias("_t"))
    entries = entries.join(heads, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")))
    entries = entries.select(F.lit(0).alias("kind"), *same, "copies", F.col("turn").eqNullSafe(F.col("_t")).alias("first"))
    alone = rows.where("copies = 0").select(F.lit(0).alias("kind"), F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("copies")).distinct()
    texts = found.select(F.lit(1).alias("kind"), "conv", "turn", "role", "key", "text")
    return texts.unionByName(entries, True).unionByName(alone, True)


class Conversation:
    """One conversation while it streams by: entries first, then texts in the same order."""

    def __init__(self, conv):
        self.conv = conv
        self.signs, self.lengths = array("b"), array("q")
        self.copies = array("q")
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.last = ""
        self.letters: bytearray | None = None
        self.cost = self.at = self.entry = 0
        self.place, self.seen = NOTHING, None

    def run(self, sign: int, n: int) -> None:
        if self.signs and self.signs[-1] == sign:
            self.lengths[-1] += n
        elif n:
            self.signs.append(sign)
            self.lengths.append(n)

    def add(self, turn, initial, blank, truncated, copies, first) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += self.high != turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += copies - 1 + (bool(self.copies) and self.last + initial not in LEGAL)
        self.last = initial
        self.copies.append(copies)
        stays = first and not blank
        if stays:
            self.run(symbol(initial, truncated), 1)
            self.truncated += truncated
        self.run(0, copies - stays)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - stays

    def solve(self) -> None:
        self.cost, self.letters = repair(self.signs, self.lengths)

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.letters) and self.letters[self.at] == 73:
            self.at += 1
            yield None, NEEDED[self.place], "", "I"
            self.place = _after(self.place)

    def edited(self, turn, role: str, key: bytes, text: str) -> Iterator[tuple]:
        """Messages (turn, role, text, letter) up to this one and its copies."""
        if self.seen == (turn, role, key):
            return
        self.seen = turn, role, key
        for _ in range(self.copies[self.entry]):
            yield from self.inserted()
            letter = chr(self.letters[self.at])
            self.at += 1
            if letter == "D":
                continue
            kept = role if letter == "K" else NEEDED[self.place]
            yield turn, kept, text, letter
            self.place = FOLLOWS[self.place, kept[0]]
        self.entry += 1

    def report(self, sha: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.letters.decode(), sha)


def _streamed(rows: DataFrame, make: Callable[[], tuple[Callable, Callable]], names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """Send each conversation's entries, then its texts, through one of ``make``'s pairs of functions.

    ``message(conversation, edited message)`` and ``end(conversation)`` return output rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message, end = make()
        now: Conversation | None = None
        out: list[tuple] = []

        def closing() -> Iterator[tuple]:
            if now.letters is None:
                now.solve()
            for item in now.inserted():
                yield from message(now, item)
            yield from end(now)

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for conv, kind, turn, role, key, initial, blank, truncated, copies, first, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.extend(closing())
                    now = Conversation(conv)
                if not kind:
                    now.add(turn, initial, blank, truncated, copies, first)
                    continue
                if now.letters is None:
                    now.solve()
                for item in now.edited(turn, role, key, text):
                    out.extend(message(now, item))
                if len(out) >= 1000:
                    yield batch_of()
            if out:
                yield batch_of()
        if now is not None:
            out.extend(closing())
            if out:
                yield batch_of()

    cols = ["conv", "kind", "turn", "role", "key", "initial", "blank", "truncated", "copies", "first", "text"]
    dealt = faults(rows).select(*cols).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "key")
    return dealt.mapInArrow(tidy(run), schema)


def _plain(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), (F.lit(1) if copies is None else copies).alias("copies")
    )


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows``: conv_id, turn, role, text and optionally ``copies``, the number of equal messages that a row stands for
    (0: the conversation exists, the message does not). A conversation's messages go by turn, NULL turns
    first, equal turns by role and digest. A NULL role or text is one space; a NULL conv_id is a conversation.
    Empty and blank texts must go, texts of any length are hashed as they stream by and never held; an
    empty table gives no rows; other columns are ignored.

    A conversation of any length is held as runs of equal symbols and the audit that is its result.
    """

    def make():
        state: dict = {}

        def message(conversation, item):
            sha = state.setdefault("sha", None) or hashlib.sha256()
            if state["sha"]:
                sha.update(b"\n")
            state["sha"] = sha
            sha.update(f"{item[1]}:{item[2]}".encode())
            return ()

        def end(conversation):
            sha = state.pop("sha", None) or hashlib.sha256()
            return (conversation.report(sha.hexdigest()),)

        return message, end

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    given = _plain(rows, F.col("copies") if "copies" in rows.columns else None)
    return _streamed(given, make, names, [pa.int64()] * 7 + [pa.string()] * 2, schema)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, turn, role, text, edit`` per message that remains or is inserted.

    ``position`` counts from 0; inserted messages have no turn. Input and cases as in ``repair_report``; a conversation
    that is repaired to nothing has no rows.
    """

    def make():
        state = {"at": 0}

        def message(conversation, item):
            turn, role, text, letter = item
            state["at"] += 1
            return ((conversation.conv, state["at"] - 1, turn, role, text, letter),)

        def end(conversation):
            state["at"] = 0
            return ()

        return message, end

    names = ["conv_id", "position", "turn", "role", "text", "edit"]
    schema = "conv_id long, position long, turn long, role string, text string, edit string"
    given = _plain(rows, F.col("copies") if "copies" in rows.columns else None)
    return _streamed(given, make, names, [pa.int64()] * 3 + [pa.string()] * 3, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Messages with faults dealt by the checksum of ``conv_id:turn``, as ``repair_report`` takes them."""
    rows = _plain(conversations)
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *place).cast("binary")) % 20
    dropped = fault == 0
    return rows.select(
        "conv_id",
        F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(dropped, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


@query("op11_repair_conversations")
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))
