"""Stored indexes, tables of buckets, sinks and state machines against plain Python."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexforge import sources as S
from lexforge.operators import bm25, bm25_index, multihop
from lexforge.plans import search, streams
from lexforge.streaming import stateful

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_buckets_without_a_change_keep_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, f"v{i}") for i in range(500)], "k bigint, version int, v string")
    table = S.BucketTable.create(rows, str(tmp_path / "t"), ["k"], 16)
    before = files(tmp_path / "t" / "data")
    touched = table.upsert(spark.createDataFrame([(7, 1, "new"), (7, 2, "newer"), (9000, 1, "added"), (8, -1, "old")], "k bigint, version int, v string"), "version")
    assert len(touched) <= 3 and all(files(tmp_path / "t" / "data")[f] == t for f, t in before.items())
    new = [f for f in files(tmp_path / "t" / "data") if f not in before]
    assert 1 <= len({os.path.dirname(f) for f in new}) <= 3
    got = {r.k: r.v for r in table.read(rows.schema).collect()}
    assert len(got) == 501 and got[7] == "newer" and got[8] == "v8" and got[9000] == "added"
    table.delete(spark.createDataFrame([(7,), (12345,)], "k bigint"), rows.schema)
    assert {r.k for r in table.read(rows.schema).collect()} == {*range(500), 9000} - {7}
    table.delete(rows.select("k").union(spark.createDataFrame([(9000,)], "k bigint")), rows.schema)
    assert table.read(rows.schema).count() == 0
    table.upsert(spark.createDataFrame([(None, 1, "n"), (None, 2, "m"), (3, 1, None)], "k bigint, version int, v string"), "version")
    assert {(r.k, r.v) for r in table.read(rows.schema).collect()} == {(None, "m"), (3, None)}


def test_a_sink_holds_a_batch_once(spark, tmp_path):
    a, b = (S.Sink.open(spark, str(tmp_path / n)) for n in "ab")
    batch = lambda i: spark.range(i * 10, i * 10 + 10)
    for i in (0, 1, 1, 0, 2, 2):
        S.dual_write(batch(i), i, a, b)
    for s in (a, b, S.Sink.open(spark, str(tmp_path / "a"))):
        assert sorted(r.id for r in s.read("id bigint").collect()) == list(range(30))
    # A run that died in the middle of a batch left rows without a commit; the next run writes them anew.
    batch(7).write.parquet(str(tmp_path / "a" / "data" / "batch=3"))
    assert a.read("id bigint").count() == 30
    assert a.write(batch(3), 3) and not a.write(batch(3), 3)
    assert sorted(r.id for r in a.read("id bigint").collect()) == list(range(40))
    assert S.Sink.open(spark, str(tmp_path / "c")).read("id bigint").count() == 0


def by_user(spark):
    rows = defaultdict(list)
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumns({"tier": streams.tier(), **streams.job_columns()})
    for r in e.orderBy("t", "event_id").collect():
        rows[r.user_id].append(r)
    return rows


def test_limits_on_a_stream_with_a_restart(spark):
    got = {r.event_id: (r.allowed, r.retry_after, r.hit) for r in streams.st_rate_limit_stream(spark, SF).collect()}
    refused = 0
    for user, rows in by_user(spark).items():
        passed = []
        for r in rows:
            minute, day = streams.LIMITS.get(r.tier, streams.LIMITS["free"])
            want = (True, None, None)
            for name, width, most in (("minute", 60, minute), ("day", 86400, day)):
                inside = [t for t in passed if t > r.t - width * 1_000_000]
                if len(inside) >= most:
                    want = False, max(1, int(width - (r.t - inside[0]) / 1e6)), name
                    break
            refused += not want[0]
            if want[0]:
                passed.append(r.t)
            assert got[r.event_id] == want, (user, r)
    assert refused > 20 and len(got) == sum(map(len, by_user(spark).values()))


def test_counts_of_one_second_are_one_entry():
    limiter, passed = stateful.RateLimiter({"a": (5, 7)}, "a"), []
    told = [limiter.decide(passed, t * 250_000, "b") for t in range(8)]
    assert [x[0] for x in told] == [True] * 5 + [False] * 3 and passed == [(0, 4), (1_000_000, 1)]
    assert limiter.decide(passed, 70_000_000, "a")[0] and limiter.decide(passed, 71_500_000, "a")[0]
    assert limiter.decide(passed, 140_000_000, "a") == (False, 86_260, "day")


def test_jobs_on_a_stream_with_a_restart(spark):
    got = {r.event_id: (r.accepted, r.state) for r in streams.st_job_state_stream(spark, SF).collect()}
    seen = Counter()
    for rows in by_user(spark).values():
        jobs = {}
        for r in rows:
            jobs = {j: v for j, v in jobs.items() if v[1] is None or v[1] >= r.t - 3_600_000_000}
            state = jobs.get(r.job, (None, None))[0]
            active = sum(s in ("queued", "running") for s, _ in jobs.values())
            ok = {"submit": state not in ("queued", "running") and active < 3, "start": state == "queued", "finish": state == "running", "fail": state == "running", "poll": state is not None}[r.action]
            if ok and r.action != "poll":
                after = {"submit": "queued", "start": "running", "finish": "done", "fail": "error"}[r.action]
                jobs[r.job] = after, r.t if after in ("done", "error") else None
            assert got[r.event_id] == (ok, jobs.get(r.job, (None, None))[0]), r
            seen[r.action, ok] += 1
    assert all(seen[a, ok] for a in ("submit", "start", "finish", "fail") for ok in (True, False))


def test_job_steps():
    m, jobs = stateful.JobStates(most=2, retention=10), {}
    say = lambda t, j, a: m.step(jobs, t * 1_000_000, j, a)
    assert say(0, 1, "submit") == (True, "queued") and say(0, 1, "submit") == (False, "queued")
    assert say(1, 2, "submit") == (True, "queued") and say(1, 3, "submit") == (False, None)
    assert say(2, 1, "start") == (True, "running") and say(2, 1, "restart") == (True, "queued")
    assert say(3, 1, "start") == (True, "running") and say(3, 1, "finish") == (True, "done") and say(4, 1, "poll") == (True, "done")
    assert say(13, 1, "poll") == (True, "done") and say(14, 1, "poll") == (False, None) and say(99, 2, "poll") == (True, "queued")


def index_rows(hits):
    return sorted((r.query_id, r.id, r["rank"], round(r.score, 6)) for r in hits.collect())


def test_a_stored_index_skips_blocks_and_reads_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25_index, "RANGE_DOCS", 8)
    random.seed(5)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(random.choices(common, k=random.randint(3, 30)) + random.choices(rare, k=2))) for i in range(600)] + [(600, None), (601, ""), (602, "c1 c1 c1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    asked = spark.createDataFrame([(1, "c1 c2 r7 r8 r9"), (2, "r1 r1 r2"), (3, "nowhere"), (4, None), (5, "c3"), (6, "c1 r3")], "item_id bigint, text string")
    index = bm25_index.build(stored.where("doc_id < 400"), str(tmp_path / "index"))
    assert index_rows(bm25_index.search(index, asked, 5).hits) == index_rows(bm25.search(docs.where("doc_id < 400"), asked, 5))
    kept = files(tmp_path / "index")
    bm25_index.add(index, stored.where("doc_id >= 400"))
    assert all(files(tmp_path / "index")[f] == t for f, t in kept.items())
    for f in (tmp_path / "texts").iterdir():
        f.unlink()
    for _ in range(2):
        found = bm25_index.search(index, asked, 5)
        assert index_rows(found.hits) == index_rows(bm25.search(docs, asked, 5))
    work = {r.query_id: (r.blocks, r.read) for r in found.work.collect()}
    assert set(work) == {1, 2, 5, 6} and all(read <= blocks for blocks, read in work.values())
    assert work[5][1] < 0.4 * work[5][0] and work[6][1] < 0.4 * work[6][0] and work[1][1] < work[1][0], work


def test_wanted_words_by_shuffle(spark, monkeypatch):
    docs, asked = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = index_rows(bm25.search(docs, asked, 5))
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", -1)
    assert index_rows(bm25.search(docs, asked, 5)) == want


def test_hops_go_on_until_a_reason_to_stop(spark, tmp_path):
    docs = [(1, "alpha beta gamma " * 30), (2, "alpha beta gamma " * 30), (3, "delta epsilon zeta " * 30), (4, "omega " * 60 + "kappa"), (5, "filler words only"), (6, None)]
    index = bm25_index.build(spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta omega kappa"), (2, "alpha beta"), (3, "unheard of things"), (4, None)], "query_id bigint, q string")
    got = multihop.retrieve(index, asked, k=1)
    hops = {(r.query_id, r.hop): (r["query"], round(r.completeness, 3), r.n_gaps, r.reason) for r in got.hops.collect()}
    assert hops[2, 1][1:] == (1.0, 0, "complete") and {q for q, _ in hops} == {1, 2}
    assert [hops[1, h][1] for h in (1, 2)] == [0.375, 0.75] and hops[1, 1][3] is None and hops[1, 2][0] == "alpha beta gamma omega"
    assert hops[1, max(h for q, h in hops if q == 1)][3] == "complete"
    evidence = got.evidence.where("query_id = 1").collect()
    assert len({r.content for r in evidence}) == len(evidence) and {r.id for r in evidence} - {1, 2} == {3, 4}


def test_words_stand_for_all_members_of_their_groups(spark):
    docs = spark.createDataFrame([(1, "a contractor"), (2, "an ic"), (3, "the freelancer"), (4, "employee handbook"), (5, "staff and worker")], "id bigint, text string")
    rows = docs.select("id", search._es_places(F.col("text")).alias("body"), F.lit(None).cast("array<array<string>>").alias("title"))
    asked = spark.createDataFrame([(w, [w]) for w in ("contractor", "freelancer", "ic", "worker")], "query_id string, words array<string>")
    found = defaultdict(set)
    for r in bm25.field_scores(rows, asked, ["title", "body"]).collect():
        assert r.title == 0.0 and r.body > 0
        found[r.query_id].add(r.id)
    assert found == {"contractor": {1, 3}, "freelancer": {1, 2, 3}, "ic": {2, 3}, "worker": {4, 5}}


def test_every_word_is_asked(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["c", "b", "a", "a"]), (4, []), (5, None)], "id bigint, words array<string>")
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "b"]), (3, ["a", "z"]), (4, []), (5, None)], "query_id bigint, words array<string>")
    got = sorted((r.query_id, r.id) for r in bm25.all_words(docs, asked, 2).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 40])
def test_namespaces_are_searched_in_one_plan(spark, n):
    from lexforge.operators import ranking

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3 if i % 5 else None) for i in range(n)], "id bigint, v array<double>, space int")
    got = ranking.vector_top_k(rows.selectExpr("id as query_id", "v as q", "space"), rows, 4, within="space").collect()
    space = {r.id: r.space for r in rows.collect()}
    assert all(space[r.query_id] == space[r.id] is not None and r.query_id != r.id for r in got)
    per = Counter(r.query_id for r in got)
    assert all(per[i] == min(4, Counter(space.values())[s] - 1) for i, s in space.items() if s is not None)
