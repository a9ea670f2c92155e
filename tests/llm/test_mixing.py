import re
from fractions import Fraction

import duckdb
import pytest

from seqrisk.llm.mixing import SQL, mix, mixed_documents


def test_equals_sql_on_edge_cases(docs):
    documents = docs.select("doc_id", "text", "source").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(SQL).fetchall(), key=repr)
    got = sorted((tuple(r) for r in mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    assert got == want


def test_targets_and_nested_budgets(docs):
    small = {(r["doc_id"], r["size"]): r["taken"] for r in mix(docs, budget=Fraction(1, 2)).collect()}
    large = {(r["doc_id"], r["size"]): r["taken"] for r in mix(docs, budget=Fraction(3, 4)).collect()}
    assert all(large[k] >= v for k, v in small.items())
    rows = mix(docs).collect()
    assert sum(r["target"] for r in {r["source_size"]: r for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)


def test_documents_are_repeated_as_planned(docs):
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got.select("text").collect())
    assert words == sum(r["taken"] for r in mix(docs).collect())


def test_empty(no_docs):
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
