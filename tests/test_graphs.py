"""Tree search, triples and merged contexts against plain Python."""

import json
import math
import re

from pyspark.sql import functions as F

from lexforge.operators import scoring, treesearch, triples
from lexforge.plans import graphs


def run_plain(question, evidence, rounds, depth, enough=0.8, c=1.414):
    """The same search for one question, node by node."""
    worth = lambda q: plain_worth(q, evidence)
    nodes = {"": [0, question, 0, 0.0]}
    parts = [s.strip(" ") for s in re.split(r"[.!?\n]+", question) if s.strip(" ")] or [question]
    for k, p in enumerate(parts[:5]):
        nodes[str(k)] = [1, p, 0, 0.0]
    kids = lambda p: sorted(x for x in nodes if len(x) == len(p) + 1 and x.startswith(p))
    for _ in range(rounds):
        at = ""
        while kids(at):
            def u(x, at=at):
                _, _, v, t = nodes[x]
                return math.inf if v == 0 else t / v + c * math.sqrt(math.log(max(nodes[at][2], 1)) / v)

            at = max(kids(at), key=u)
        if nodes[at][0] < depth and nodes[at][2] > 0:
            w = nodes[at][1].split()
            step = max(1, math.ceil(len(w) / 3))
            for k, i in enumerate(range(0, len(w), step) if len(w) > 1 else []):
                nodes[at + str(k)] = [nodes[at][0] + 1, " ".join(w[i : i + step]), 0, 0.0]
            at = kids(at)[0] if kids(at) else at
        r = worth(nodes[at][1])
        for n in range(len(at) + 1):
            nodes[at[:n]][2] += 1
            nodes[at[:n]][3] += r
        mean = lambda x: nodes[x][3] / nodes[x][2] if nodes[x][2] else 0.0
        best = max(kids(""), key=mean)
        if nodes[""][2] >= 10 and nodes[best][2] >= 5 and mean(best) >= enough:
            break
    return nodes


def plain_worth(q, evidence):
    terms = [t for t in re.findall(r"\b[\w\-\.]+\b", q.lower()) if len(t) > 3]
    text, pieces = " ".join(evidence).lower(), min(1.0, len(evidence) / 3)
    return 0.7 * sum(t in text for t in terms) / len(terms) + 0.3 * pieces if terms else pieces


def test_tree_search_of_every_item(spark):
    items = [(r.item_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, q, [d[:500] for d in docs[i % 20 :: 20]][: i % 4]) for i, q in items] + [(900, "", ["x"]), (901, "one", []), (902, "Alpha beta. Gamma delta!", ["alpha beta", "gamma delta", "x"]), (903, "alpha beta", ["alpha beta"] * 3)]
    roots = spark.createDataFrame(rows, "root bigint, question string, evidence array<string>")
    found = treesearch.search(roots, graphs.sentences, graphs.thirds, lambda q: scoring.evidence_heuristic(F.col("evidence"), q), rounds=12, depth=3).cache()
    got = {}
    for r in found.collect():
        got.setdefault(r.root, {})[r.path] = [r.depth, r.question, r.visits, round(r.total, 9)]
    lines = {}
    for r in treesearch.best_path(found).orderBy("root", "depth").collect():
        lines.setdefault(r.root, []).append(r.path)
    stopped = 0
    for root, question, evidence in rows:
        want = run_plain(question, evidence, 12, 3)
        assert got[root] == {p: [d, q, v, round(t, 9)] for p, (d, q, v, t) in want.items()}, root
        path, line = "", [""]
        while kids := [p for p in want if len(p) == len(path) + 1 and p.startswith(path) and want[p][2]]:
            path = max(sorted(kids), key=lambda p: want[p][3] / want[p][2])
            line.append(path)
        assert lines[root] == line
        stopped += want[""][2] < 12
    assert stopped >= 1


def test_mentions_and_triples(spark):
    entities = spark.createDataFrame([("Supreme Court", "Court"), ("supreme court of canada", "Court"), ("Bardal", "Case"), ("bardal", "Party"), ("", "Case"), ("Wiebe Door", "Case")], "name string, type string")
    texts = spark.createDataFrame([(1, "Bardal v. The Supreme Court of Canada said wiebe door. Bardal"), (2, None), (3, "supreme  court, BARDAL bardal Wiebe\nDoor"), (4, "x " * 5000 + "bardal the wiebe door")], "id bigint, text string")
    got = {(r.id, r.sentence): [(m.start, m.stop, m.name) for m in r.found] for r in triples.mentions(texts, entities).collect()}
    # Of equal names the one of least (name, type) stands.
    assert got[1, 1] == [(1, 5, "supreme court of canada"), (6, 8, "Wiebe Door")] and got[1, 0] == [(0, 1, "Bardal")] and got[1, 2] == [(0, 1, "Bardal")]
    assert got[3, 0] == [(0, 2, "Supreme Court"), (2, 3, "Bardal"), (3, 4, "Bardal")] and (2, 0) not in got and got[4, 0] == [(5000, 5001, "Bardal"), (5002, 5004, "Wiebe Door")]
    said = triples.answers(texts, entities)
    rows = {(r.id, r.subject, r.object): (r.predicate, r.confidence) for r in triples.validated(said).collect()}
    assert rows[1, "supreme court of canada", "Wiebe Door"][1] == 0.5 and rows[3, "Supreme Court", "Bardal"][1] == 0.8 and rows[4, "Bardal", "Wiebe Door"][1] == 0.5 and len(rows) == 3
    assert triples.mentions(texts, entities.limit(0)).count() == 0


def test_answers_are_validated(spark):
    t = {"subject": "a", "subject_type": "Case", "predicate": "cites", "object": "b", "object_type": "Court"}
    said = [
        (1, "```json\n" + json.dumps({"triples": [t, t | {"confidence": 0.25}]}) + "\n```"),
        (2, json.dumps({"triples": [t | {"predicate": "likes"}, t | {"subject_type": "Dog"}, t | {"object": None}]})),
        (3, json.dumps({"triples": [t, t]})[:-40]),
        (4, "no idea"),
        (5, None),
        (6, '{"triples": []}'),
    ]
    got = [(r.id, r.confidence) for r in triples.validated(spark.createDataFrame(said, "id bigint, answer string")).orderBy("id", "confidence").collect()]
    assert got == [(1, 0.25), (1, 0.8), (3, 0.8)]


def test_contexts(spark):
    e = [("a", "b", "cites", "Case", "Case"), ("b", "c", "cites", "Case", "Court"), ("c", "d", "overrules", "Court", "Case"), ("x", "y", "amends", "Case", "Case")]
    edges = spark.createDataFrame(e, "subject string, object string, relation string, subject_type string, object_type string")
    near = triples.around(edges, spark.createDataFrame([("a",), ("d",), ("zz",)], "seed string"), 2)
    text = {r.seed: r.text for r in triples.described(near).collect()}
    assert text == {"a": "Case (2): a; b\nCourt (1): c\ncites (2): a -> b; b -> c\nchain: a -> b -> c", "d": "Case (2): b; d\nCourt (1): c\ncites (1): b -> c\noverrules (1): c -> d\nchain: b -> c"}
    hits = spark.createDataFrame([(1, 1, 2.0, "about a b"), (1, 2, 1.0, None), (2, 1, 0.5, "d")], "query_id bigint, rank int, score double, text string")
    names = spark.createDataFrame([("a", "Case"), ("d", "Case"), ("q", "Case"), ("b", "Case")], "name string, type string")
    links = triples.linked(spark.createDataFrame([(1, "q of b"), (2, None)], "query_id bigint, q string"), hits, names, most=3)
    assert sorted((r.query_id, r.place, r.name) for r in links.collect()) == [(1, 1, "q"), (1, 2, "b"), (1, 3, "a"), (2, 1, "d")]
    got = {r.query_id: r.context for r in triples.merged(hits, links, triples.described(near)).collect()}
    assert got[2] == "=== PASSAGES ===\n[Passage 1, Score: 0.500]\nd\n\n=== GRAPH ===\nAbout d\n" + text["d"]
    assert got[1] == "=== PASSAGES ===\n[Passage 1, Score: 2.000]\nabout a b\n[Passage 2, Score: 1.000]\n\n\n=== GRAPH ===\nAbout a\n" + text["a"]
