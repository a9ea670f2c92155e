import random
import re

import numpy as np
import pytest

from seqrisk.llm import paragraphs as P
from seqrisk.llm import runs as R
from seqrisk.plans import joins

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "ra", "lis")]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Shared runs inside longer lines, across line breaks, and in lines under 20 words; texts else unlike."""
    rng = random.Random(11)
    run = words(rng, 60)
    wrapped = "\n".join(" ".join(run[i : i + 12]) for i in range(0, 60, 12))
    line = lambda a, mid, b: " ".join(words(rng, a)) + " " + mid + " " + " ".join(words(rng, b))
    return {
        1: line(150, " ".join(run), 140),
        2: line(90, " ".join(run).upper(), 200),
        3: " ".join(words(rng, 30)) + "\n" + wrapped + "\n" + "é " + " ".join(words(rng, 30)),
        4: line(70, " ".join(run[:30]), 3) + "\n" + line(0, " ".join(run[30:]), 80),
        5: line(100, " ".join(run[:49]), 100),
        6: line(40, "été", 40),
    }


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame([*texts.items(), (None, texts[1]), (7, None), (8, "")], "doc_id long, text string").repartition(3)


def windows(text):
    w = text.lower().split()
    return [tuple(w[i : i + R.RUN]) for i in range(len(w) - R.RUN + 1)]


def test_runs_equal_brute_force(rows, texts):
    first = {}
    for doc, text in texts.items():
        for w in windows(text):
            first.setdefault(w, doc)
    covered = {}
    for doc, text in [*texts.items(), (None, texts[1])]:
        at = [i for i, w in enumerate(windows(text)) if first[w] != doc]
        covered[doc] = {k for i in at for k in range(i, i + R.RUN)}
    got = {doc: set() for doc in covered}
    for r in R.shared_runs(rows).where("removed").collect():
        text = (texts[r["doc_id"]] if r["doc_id"] else texts[1]).encode()
        places = [m.span() for m in re.finditer(rb"[^ \t-\r]+", text)]
        inside = [k for k, (b, e) in enumerate(places) if r["begin"] <= b and e <= r["end"]]
        assert len(inside) == r["words"] and r["paragraph"] == text[: r["begin"]].count(b"\n")
        got[r["doc_id"]] |= set(inside)
    assert got == covered
    assert len(covered[2]) == len(covered[3]) == 60 and not covered[1] and not covered[5] and len(covered[None]) > 300


def test_no_two_documents_share_50_words_after_the_cut(rows, texts):
    out = {r["doc_id"]: r["text"] for r in P.documents_without_repeats(rows).collect()}
    assert out[1] == texts[1] and out[5] == texts[5] and out[6] == texts[6] and None not in out
    seen = {}
    for doc, text in out.items():
        for w in windows(text or ""):
            assert seen.setdefault(w, doc) == doc
    before, after = texts[2].split(), out[2].split()
    assert after == before[:90] + before[150:] and out[2].count("\n") == 1
    assert out[3].split() == texts[3].split()[:30] + texts[3].split()[90:]


def test_anchors_and_hashes():
    rng = random.Random(2)
    shared = words(rng, 50)
    for _ in range(50):
        a, b = words(rng, rng.randrange(90)) + shared, shared + words(rng, rng.randrange(90))
        assert R.anchors([w.encode() for w in a])[0][-1] == R.anchors([w.encode() for w in b])[0][0]
    some = np.arange(1, 200, dtype=np.uint64)
    for size in (1, 2, 20, 50):
        direct = [np.uint64(0)] * (200 - size)
        for i in range(200 - size):
            value = 0
            for k in range(size):
                value = (value * int(R._BASE) + int(some[i + k])) % (1 << 64)
            direct[i] = np.uint64(value)
        assert (R.gram_hashes(some, size) == np.array(direct, np.uint64)).all()


def test_joins_that_grow_with_the_texts_do_not_depend_on_a_lookups_limit(rows, monkeypatch):
    asked, lookup = [], R.lookup_join

    def noted(big, table, on, *args, **kwargs):
        asked.append(set(table.columns))
        return lookup(big, table, on, *args, **kwargs)

    monkeypatch.setattr(R, "lookup_join", noted)
    found = R.shared_runs(rows).collect()
    assert found and asked and not any(columns & {"block", "window"} for columns in asked)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert sorted(map(str, R.shared_runs(rows).collect())) == sorted(map(str, found))
