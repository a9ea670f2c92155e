import hashlib
import random
import zlib
from array import array
from collections import defaultdict
from functools import cache

import pytest

from seqrisk.llm import dialogs as D
from seqrisk.llm.queries import QUERIES

WHITE = " \t\n\x0b\f\r"
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, letters) of the cheapest edits, least string first, over all edits: rows are (initial, fault)."""

    @cache
    def rest(i, place, inserted):
        found = [(0, "")] if i == len(rows) and place in ("", "a") else []
        needed = "a" if place == "u" else "u"

        def then(cost, letter, *following):
            more = rest(*following)
            if more:
                found.append((cost + more[0], letter + more[1]))

        if inserted < 3:
            then(3, "I", i, needed, inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            then(4, "D", i + 1, place, 0)
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if (place, initial) in LEADS:
                    then(extra, "K", i + 1, LEADS[place, initial], 0)
                then(extra + 3, "R", i + 1, needed, 0)
        return min(found, default=None)

    return rest(0, "", 0)


def direct(rows):
    """Reports of (conv, turn, role, text) rows by the contract, one row at a time."""
    space = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in convs.items():
        def digest(r):
            return hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()

        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, faults = set(), []
        for turn, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, faults)))
        place, at, lines = "", 0, []
        for letter in audit:
            needed = "assistant" if place == "u" else "user"
            if letter == "I":
                lines.append(f"{needed}:")
                place = needed[0]
                continue
            _, role, text = own[at]
            at += 1
            if letter != "D":
                role = role if letter == "K" else needed
                lines.append(f"{role}:{text}")
                place = role[0]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in list(range(120)) + [None]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "well", " ", "", None, "a b?\n", "Ünï. \t", "long " * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows + rows[:9]


SCHEMA = "conv_id long, turn long, role string, text string, copies long, first long, kind string, key int"


def test_reports_match_a_search_of_all_edits(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in D.repair_report(D.damaged(df)).collect()}
    assert got == direct(rows)


def test_runs_of_any_length_and_kind_match_stepwise_repair():
    rng = random.Random(2)
    for _ in range(150):
        signs, lengths = array("b"), array("q")
        for _ in range(rng.randint(0, 5)):
            sign = rng.randrange(9)
            if signs and signs[-1] == sign:
                continue
            signs.append(sign)
            lengths.append(rng.choice([1, 2, 3, 70, 500]))
        cost, letters = D.repair(signs, lengths)
        v, behind = D.AT_END, [D.AT_END]
        flat = [s for s, n in zip(signs, lengths) for _ in range(n)]
        for sign in reversed(flat):
            v = D.onto(D.power(sign, 0), v)
            behind.append(v)
        behind.reverse()
        want, place, i = "", D.NOTHING, 0
        while i < len(flat) or place not in (D.NOTHING, D.ASSISTANT):
            options = [(x, c, q, 1) for x, c, q in D.choices(flat[i], place)] if i < len(flat) else []
            options.append(("I", D.INSERT, D._after(place), 0))
            letter, _, place, step = min(o for o in options if o[1] + behind[i + o[3]][o[2]] == behind[i][place])
            want += letter
            i += step
        assert (cost, letters.decode()) == (v[D.NOTHING], want)


def test_a_long_conversation_is_one_run():
    cost, letters = D.repair(array("b", [D.symbol("u", False)]), array("q", [1_000_000]))
    assert cost == 3 * 500_000 and len(letters) == 1_000_000 and letters[:4] == b"KRKR"


def test_messages_are_those_of_the_report(spark):
    df = D.damaged(spark.createDataFrame([(*r, None, None, None, None) for r in conversations()], SCHEMA))
    audits = {r["conv_id"]: r for r in D.repair_report(df).collect()}
    kept = defaultdict(list)
    for r in D.repaired_messages(df).orderBy("position").collect():
        kept[r["conv_id"]].append(r)
    for conv, report in audits.items():
        own = kept.get(conv, [])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert "".join(r["edit"] for r in own) == report["audit"].replace("D", "")
        said = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(said.encode()).hexdigest() == report["repaired_sha256"]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.repair_report(D.damaged(none)).count() == 0 and D.repaired_messages(none.drop("copies")).count() == 0


def test_dropped_conversation_is_reported(spark):
    one = spark.createDataFrame([(7, 0, "user", "Hi.", 0)], "conv_id long, turn long, role string, text string, copies int")
    row = tuple(D.repair_report(one).first())
    assert row == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_over_its_table(spark, size):
    path = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_repair_conversations"](spark, path).collect()}
    assert got == direct(rows)
