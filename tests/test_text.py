"""Chunks by tokens and JSON out of answers, against plain Python."""

import json
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexforge.functions import legal
from lexforge.operators import chunking

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("budget,overlap", [(512, 50), (40, 10), (8, 0), (3, 2)])
def test_chunks_by_tokens(spark, monkeypatch, budget, overlap):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunking, "SEGMENT", 200)
    random.seed(3)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    texts += [None, "", " \n ", "One. Two! Three?  four\n\n\n\nfive", "x" * 3000, "no end " * 900, "東京都🙂 é́ " * 50, "<|endoftext|> a. <|endoftext|>"]
    texts += ["".join(random.choice(["word", " ", ". ", "\n\n", "\n", "! ", "é"]) for _ in range(400)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as content")
    got = {}
    for r in chunking.chunk_tokens(docs, BPE, budget, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    for i, text in enumerate(texts):
        clean = re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", text or ""))
        if not clean.strip():
            assert i not in got
            continue
        spans = t.encode(clean, add_special_tokens=False).offsets
        rows = got[i]
        assert [r.chunk_index for r in rows] == list(range(len(rows))) and {r.total_chunks for r in rows} == {len(rows)}
        end = 0
        for k, r in enumerate(rows):
            assert r.token_count <= budget and r.content == clean[spans[r.first_token][0] : spans[r.first_token + r.token_count - 1][1]]
            assert r.first_token == (max(0, end - overlap) if k else 0)
            end = r.first_token + r.token_count
        assert end == len(spans)
        # A chunk ends only where the next piece would not fit: all ends but the last are ends of pieces.
        most, pieces, at = budget - overlap, set(), 0
        for par in [m.start() for m in re.finditer("\n\n", clean)] + [len(clean)]:
            last = sum(b <= par for _, b in spans)
            stops = [last]
            if last - at > most:
                start = spans[at][0] if at < len(spans) else par
                stops = sorted({sum(b <= m.start() for _, b in spans) for m in re.finditer(r"(?<=[.!?])\s+", clean) if m.start() <= par and sum(b <= m.start() for _, b in spans) > at} | {last})
            for s in stops:
                while s - at > most:
                    at += most
                    pieces.add(at)
                if s > at:
                    at = s
                    pieces.add(at)
        assert {r.first_token + r.token_count for r in rows} <= pieces | {len(spans)}


def make(depth=0):
    kind = random.random()
    if depth < 4 and kind < 0.35:
        return {random.choice(["a", "b c", 'q"uote', "br]ack{et", "é\n"]) + str(i): make(depth + 1) for i in range(random.randint(0, 4))}
    if depth < 4 and kind < 0.7:
        return [make(depth + 1) for _ in range(random.randint(0, 4))]
    return random.choice([1, -2.5, 1e-7, 0, True, False, None, "", "text, with: marks", 'with "quotes" and \\ slashes', "[{", "}]", "line\nend", "東"])


TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\s\[\]{}:,"]+', re.S)


def brute(text, opener):
    """Every whole token counts: the longest run of tokens that, closed, is JSON."""
    at = text.find(opener)
    if at < 0:
        return None
    ends, pos = [], at
    while m := TOKEN.match(text, pos) or re.compile(r"\s+").match(text, pos):
        pos = m.end()
        if m[0].strip():
            ends.append(pos)
    for end in reversed(ends):
        prefix, stack, inside, k = text[at:end], [], False, 0
        while k < len(prefix):
            c = prefix[k]
            if inside:
                k += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append(c)
            elif c in "}]" and stack:
                stack.pop()
                if not stack:
                    prefix = prefix[: k + 1]
                    break
            k += 1
        closed = prefix + "".join("}" if c == "{" else "]" for c in reversed(stack))
        try:
            return json.loads(closed)
        except ValueError:
            continue
    return None


def test_json_out_of_answers(spark):
    random.seed(6)
    cases = []
    for _ in range(400):
        v = make()
        while not isinstance(v, (dict, list)):
            v = make()
        text = json.dumps(v, ensure_ascii=random.random() < 0.5, indent=random.choice([None, 1]))
        for _ in range(3):
            said = random.choice(["", "Here you go: ", "```json\n"]) + text[: random.randint(1, len(text))]
            cases.append(said + (random.choice(["", " done.", "\n```"]) if said.endswith(text) else ""))
    cases += [None, "", "no json", "{", "[", '{"a"', '{"a":', '{"a": tru', '[1, 2', '[1, "x]y", {"b": "{"', "see [1] and {\"k\": 2} there", '{"a": "line\nbreak"}']
    df = spark.createDataFrame(list(enumerate(cases)), "i bigint, said string").select("i", legal.json_object(F.col("said")).alias("o"), legal.json_array(F.col("said")).alias("a"))
    same = lambda x, y: json.dumps(x, sort_keys=True) == json.dumps(y, sort_keys=True)
    for r in df.collect():
        said = re.sub("```(?:json)?", "", cases[r.i] or "")
        for got, opener in ((r.o, "{"), (r.a, "[")):
            want = brute(said, opener)
            if '"line\nbreak"' in said and opener == "{":
                want = {"a": "line break"}
            assert (got is None) == (want is None) and (got is None or same(json.loads(got), want)), (said, opener, got, want)


def test_a_plugged_in_scorer_sees_batches(spark):
    from lexforge.operators import ranking

    score = ranking.batches(lambda texts: texts.fillna("").str.len() / 10.0)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * i) for i in range(2500)], "i bigint, t string").repartition(4)
    got = {r.i: r.s for r in rows.select("i", score("t").alias("s")).collect()}
    assert got == {i: 0.0 if i % 7 == 0 else i / 10 for i in range(2500)}
    assert rows.limit(0).select(score("t")).count() == 0
