import random
import re

import numpy as np
import xxhash

from seqrisk.llm import simhash as S
from seqrisk.llm.common import connected


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(prints: list[int], radius: int) -> list[int]:
    label = list(range(len(prints)))
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius] for i in range(len(prints))]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min(label[j] for j in others)
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_fingerprints_and_components(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    label = components(prints, 4)
    least = {}
    for r, k in zip(rows, label):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, 1 << 60), r["doc_id"])
    want = sorted((repr(r["doc_id"]), f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, label))
    got = sorted((repr(r["doc_id"]), f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in S.simhash_components(docs).collect())
    assert got == want


def test_bit_sliced_links_equal_brute_force():
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for n in range(400):
        p = seeds[n % 12]
        for _ in range(rng.randrange(0, 7)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    group = np.sort(np.array([rng.randrange(5) for _ in prints]))
    label = S.linked_rows(group, np.array(prints, np.uint64), 4)
    for g in range(5):
        on = np.flatnonzero(group == g)
        want = components([prints[i] for i in on], 4)
        assert [on[w] for w in want] == label[on].tolist()


def test_large_buckets_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 8)
    monkeypatch.setattr(S, "CHUNK", 16)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({base[n % 4] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for n in range(120)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = S.simhash_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    root = {r["node"]: r["root"] for r in connected(edges, "a", "b").collect()}
    want = components(prints, 4)
    groups = {}
    for p, k in zip(signed, want):
        groups.setdefault(k, set()).add(root.get(p, p))
    assert all(len(roots) == 1 for roots in groups.values()) and len({min(r) for r in groups.values()}) == len(groups)


def test_one_document_of_each_group_stays(docs, no_docs):
    kept = S.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 30 not in ids and 20 in ids and None in ids
    assert S.simhash_components(no_docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100)}
