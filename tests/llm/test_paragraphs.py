import random

import numpy as np

from seqrisk.llm import paragraphs as P
from seqrisk.llm.common import connected


def gram_sets(rows):
    out = []
    for r in rows:
        for number, line in enumerate((r["text"] or "").split("\n")):
            words = line.lower().split()
            if len(words) >= P.LEAST_WORDS:
                out.append((r["doc_id"], number, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    return out


def test_equals_brute_force(docs):
    found = gram_sets(docs.select("doc_id", "text").collect())
    label = list(range(len(found)))
    changed = True
    while changed:
        changed = False
        for i, (_, _, a) in enumerate(found):
            for j, (_, _, b) in enumerate(found):
                if label[j] < label[i] and len(a & b) >= 0.8 * len(a | b):
                    label[i], changed = label[j], True
    members = {}
    for (doc, number, _), k in zip(found, label):
        members.setdefault(k, []).append((doc, number))
    want = set()
    for group in members.values():
        docs_in = {d for d, _ in group}
        if len(docs_in) > 1:
            keep = min(d for d in docs_in if d is not None)
            want |= {(d, n, d != keep) for d, n in group}
    got = P.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["paragraph"], r["removed"]) for r in got} == want
    assert len(want) > 20


def test_places_are_bytes(docs):
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id between 50 and 55").collect()}
    got = P.repeated_passages(docs).where("doc_id between 50 and 55").collect()
    assert got and all(len(text[r["doc_id"]].encode()[r["begin"] : r["end"]].split()) == r["words"] for r in got)


def test_passages_are_cut(docs, no_docs):
    out = P.documents_without_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.where("doc_id is not null and doc_id != 20").collect()}
    before = {r["doc_id"]: r for r in docs.where("doc_id is not null and doc_id != 20").collect()}
    assert 30 not in rows and 40 not in rows and 71 not in rows
    assert rows[50] == before[50] and rows[1] == before[1] and rows[7] == before[7] and rows[70] == before[70]
    assert rows[51]["text"] == "\n".join(before[51]["text"].split("\n")[::2]) and rows[51]["n_chars"] == len(rows[51]["text"])
    assert P.repeated_passages(no_docs).count() == 0


def test_linked_sets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "PART", 6)
    rng = random.Random(4)
    base = [[rng.getrandbits(60) for _ in range(30)] for _ in range(3)]
    sets = []
    for n in range(40):
        own = list(base[n % 3])
        for _ in range(n % 4):
            own[rng.randrange(30)] = rng.getrandbits(60)
        sets.append(sorted(set(own)))
    rows = [(1, n, s) for n, s in enumerate(sets)]
    edges = P.verified_links(spark.createDataFrame(rows, "key long, node long, grams array<long>"), 0.8)
    root = {r["node"]: r["root"] for r in connected(edges, "a", "b").collect()}
    direct = P.linked_sets([np.array(s) for s in sets], 0.8)
    assert {frozenset(i for i in range(40) if root.get(i, i) == root.get(k, k)) for k in range(40)} == {
        frozenset(np.flatnonzero(direct == d).tolist()) for d in set(direct.tolist())
    }


def test_bands_find_similar_sets():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        core = rng.integers(0, 1 << 62, 80, dtype=np.uint64)
        a, b = np.append(core, rng.integers(0, 1 << 62, 10, dtype=np.uint64)), np.append(core, rng.integers(0, 1 << 62, 10, dtype=np.uint64))
        keys = P.band_keys([a, b])
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 6


def test_texts_are_cut_once(docs):
    plan = P.documents_without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
