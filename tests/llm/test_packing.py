import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqrisk.llm import packing
from seqrisk.llm.packing import Encoder, packed_sequences, packing_plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'asdé½_1. \x1c\r!日"), st.characters(codec="utf-8")), max_size=40))
def test_ids_equal_the_library(text):
    own = np.frombuffer(ENCODER.encode(text), "<u4").tolist()
    assert own == LIBRARY.encode(text, add_special_tokens=False).ids


ENCODER, LIBRARY = Encoder(PATH), library()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30))
def test_plan_places_every_item_once(counts):
    rows, sequences = packing_plan(counts, capacity=64, groups=6)
    room = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, last, sequence, offset in rows:
        for n in range(last - first):
            room[sequence + n].append((offset, length))
        ranks[length] += range(first, last)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert len(room) == sequences
    for items in room.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


def test_near_the_lower_bound():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 1025, 20_000).tolist())
    _, sequences = packing_plan(dict(counts))
    assert sequences <= 1.01 * sum(k * n for k, n in counts.items()) / 1024


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 200), max_size=40), st.integers(2, 20))
def test_never_worse_than_best_fit(counts, groups):
    """Against best fit decreasing, one item at a time."""
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [r for r in rooms if r >= length]
        room = min(fitting) if fitting else 100
        if fitting:
            rooms.remove(room)
        rooms.append(room - length)
    assert packing_plan(counts, capacity=100, groups=groups)[1] <= len(rooms)


def test_pieces_of_all_documents(docs, no_docs):
    rows = packed_sequences(docs, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
    for doc, text in docs.where("doc_id is not null and doc_id != 20").select("doc_id", "text").collect():
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert sum((r["ids"] for r in own), []) == LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 1024 for r in own[1:])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]
    assert len(pieces[20]) == 2
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in filled.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packed_sequences(no_docs).count() == 0


def test_common_words_stay_known(monkeypatch):
    """Many rare words do not push out the words that every text has."""
    monkeypatch.setattr(packing, "CACHE", 20)
    encoder, asked = Encoder(PATH), Counter()
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda spelled: asked.update([spelled]) or ids(spelled))
    for n in range(200):
        text = f"the same words q{chr(97 + n % 26)}{'z' * (n // 26)} x{chr(97 + n % 26)}{'y' * (n // 26)} the same words été"
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(getattr(encoder, "before", ())) < 100
    assert asked["the"] == asked["\u0120same"] == asked["\u0120words"] == 1
