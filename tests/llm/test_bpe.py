import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seqrisk.llm import bpe
from seqrisk.llm.queries import QUERIES


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    ranks = {token: n for n, token in enumerate(encoder.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lists(coded):
    return [np.frombuffer(c, "<i4").tolist() for c in coded]


EVERY = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]


def odd_texts():
    rng = random.Random(1)
    out = ["", "a", " ", "\n\n  x", "don't 日本語 \x85 \x1c\x1dabc", "x" * 5000, "ab" * 3000, "<|endoftext|> 12"]
    out.append("".join(rng.choice("abcdefgh") for _ in range(1500)))
    for _ in range(800):
        pool = EVERY if rng.random() < 0.3 else EVERY[:0x3000]
        out.append("".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice("abc XYZ  \n'st19.,é日本") for _ in range(rng.randint(1, 60))))
    return out


def test_ids_are_those_of_the_library(encoder, library):
    texts = odd_texts()
    assert lists(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_every_character_is_cut_as_the_library_cuts_it(encoder, library):
    texts = ["".join(EVERY[n : n + 4000]) for n in range(0, len(EVERY), 4000)] + [f" a{c}1" for c in EVERY[0x80:0x3100]]
    assert lists(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_long_texts(encoder, library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeiounrst") for _ in range(n)) for n in (511, 512, 513, 700)]
    want = [library.encode_ordinary(t) for t in texts]
    assert lists(encoder.encode(texts)) == want
    monkeypatch.setattr(bpe, "WIDEST", 8)  # all through the heap
    encoder.known.clear()
    assert lists(encoder.encode(texts)) == want
    monkeypatch.setattr(bpe, "TOGETHER", 50)  # many lists of pieces
    monkeypatch.setattr(bpe, "CACHE", 20)
    whole = " ".join(odd_texts())
    assert lists(encoder.encode([whole, "b", whole])) == [library.encode_ordinary(t) for t in (whole, "b", whole)]


def test_matrices_without_the_heap(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "WIDEST", 1 << 20)
    encoder.known.clear()
    texts = ["ab" * 700, "".join(random.Random(3).choice("abcde") for _ in range(1200))]
    assert lists(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_pair_table_holds_all_pairs_and_no_other(encoder):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-1, len(encoder.tokens), (2, 20_000)).astype(np.int32)
    tail = np.array([n for n, t in enumerate(encoder.tokens) if len(t) > 1][:20_000])
    a[: len(tail)] = [encoder.ids[encoder.tokens[n][:1]] for n in tail[: len(a)]]
    got = encoder.pairs.ranks(a, b)
    want = [encoder.ids.get(encoder.tokens[x] + encoder.tokens[y], int(bpe.NONE)) if x >= 0 and y >= 0 else int(bpe.NONE) for x, y in zip(a, b)]
    assert got.tolist() == want


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        said = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out.append((doc, len(ids), said, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_with_edge_rows(spark, docs, library, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_byte_bpe"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, rows)


def test_given_table(spark, library):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_byte_bpe"](spark, path).collect()), key=str) == expected(library, rows)


def test_empty_table_and_bad_ids(spark, no_docs):
    assert bpe.token_bytes(bpe.token_ids(no_docs)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.token_bytes(none).collect()] == [b"", b""]
    wrong = spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="an id that the vocabulary does not have"):
        bpe.token_bytes(wrong).collect()
