import duckdb

from seqrisk.llm.licenses import CUES, SENTENCES, license_scan, normal_sentences
from seqrisk.llm.registry import ORACLE

MIT = "\n".join([
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
    "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:", "",
    "The above copyright notice and this permission notice shall be included in all", "copies or substantial portions of the Software.",
])


def texts() -> dict[int, str | None]:
    both = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = next(s for s, i in SENTENCES.items() if i == "bsd-binary")
    names = next(s for s, i in SENTENCES.items() if i == "bsd-names")
    return {
        1: None, 2: "", 3: "No licence here. A license is mentioned.", 4: "Intro\nReleased under the MIT License.\nMore text", 5: MIT,
        6: both + binary, 7: both + binary + "\n" + names, 8: "RELEASED UNDER THE MIT LICENSE. Licensed under CC BY-NC 4.0.", 9: "x " * 50_000 + "\nLicensed under CC BY-NC 4.0.",
        10: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License", 11: names,
    }


def test_rules_and_order(spark):
    rows = spark.createDataFrame([(k, v, "z") for k, v in texts().items()], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan(rows).collect()}
    assert got == {
        1: [], 2: [], 3: [], 4: ["MIT"], 5: ["MIT"], 6: ["BSD-2-Clause"], 7: ["BSD-3-Clause"], 8: ["MIT", "CC-BY-NC-4.0"],
        9: ["CC-BY-NC-4.0"], 10: ["Apache-2.0", "MIT"], 11: [],
    }
    assert license_scan(rows.where("1 = 0")).count() == 0


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts().items()))
    want = sorted(con.execute(ORACLE["op5_license_sentences"]).fetchall())
    rows = license_scan(spark.createDataFrame(list(texts().items()), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], " ".join(r["sentence_ids"]), " ".join(r["licenses"])) for r in rows) == want


def test_every_known_sentence_has_a_cue():
    assert all(any(c in s for c in CUES) for s in normal_sentences())


def test_runs_without_python(spark):
    plan = license_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
