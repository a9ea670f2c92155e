import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seqrisk.llm import packing

TEXTS = {1: "a <|endoftext|> b", 2: "<|endoftext|>don't<|endoftext|>\nété 日本", 3: "no marker", 4: "<|endoftext", 5: ""}


def test_marker_strings_are_the_tokens_of_the_file(spark, tmp_path):
    """The query and the pipeline's stage give the library's ids in its default setting."""
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {n: library.encode(t, add_special_tokens=False).ids + [packing.END_ID] for n, t in TEXTS.items()}
    assert 50256 in want[1]
    docs = spark.createDataFrame([*TEXTS.items()], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (packing.op4_linear_grouping_pack(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out.collect()}
        assert got == {n: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for n, ids in want.items()}
