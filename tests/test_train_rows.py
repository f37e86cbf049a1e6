"""Training rows of conversations: every answered one, and those rated useful."""

import duckdb

from lexforge import registry

SF = "/root/testdata/sf0.01"


def test_train_rows_are_whole(spark):
    con = duckdb.connect()
    said = con.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' where text is not null order by conv_id, turn").fetchall()
    useful = {r[0] for r in con.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1 and toxic = 0").fetchall()}
    talks = {}
    for conv, _, role, text in said:
        talks.setdefault(conv, ([], []))[role == "assistant"].append(text)
    want = sorted((c, " ".join(q), " ".join(a)) for c, (q, a) in talks.items() if q and a)
    got = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
    assert got("sink_train_jsonl") == want
    rated = [r for r in want if r[0] in useful]
    assert got("sink_train_useful") == rated and 0 < len(rated) < len(want)
