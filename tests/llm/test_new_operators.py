"""Operators 11 to 13 and sorted arrays against brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import xxhash

from lexforge.llm import alignment, filter_audit, mapped, url_rules

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    " a  b\n\n c\t\td \r\n e\r\nf \x0b\x0c ",
    "one two",
    "one two",
    "x" * 5000,
    "ab ▁ cd",
    "<|endoftext|> <s> </s><unk> <0x41> is text",
    "Zürich naïve 東京都 🙂🙂 é́ \x00 \x1c end",
    "a\u00a0b\u2003c \u3000 d\u200be \x85 f",
    "don't it's  12345 3.14, (foo)[bar] !!! ... --- ",
    "word " * 3000,
    "ab\rcd \r ef;\r\n gh",
]


def plain(texts):
    """Links by their definition, a token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    sign = alignment.byte_of_sign()
    spelt_a = {k: bytes(sign[c] for c in x) for x, k in t.get_vocab(with_added_tokens=False).items() if all(c in sign for c in x)}

    def spelt_b(k):
        piece = s.id_to_piece(k)
        return bytes([k - 3]) if 3 <= k < 259 else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        want = (" " + text).encode() if text else b""
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        if not text or b"".join(spelt_a[k] for k in a) != want or b"".join(map(spelt_b, b)) != want:
            found.append(([], []))
            continue
        at = {0: "a"}
        ends = [set(np.cumsum([len(f(k)) for k in x]).tolist()) for f, x in ((spelt_a.get, a), (spelt_b, b))]
        groups = []
        for edge in sorted(ends[0] & ends[1]):
            groups.append(([], []))
            at[edge] = len(groups) - 1
        edges = sorted(ends[0] & ends[1])
        for x, f, side in ((a, spelt_a.get, 0), (b, spelt_b, 1)):
            run, g = 0, 0
            for k in x:
                run += len(f(k))
                groups[g][side].append(k)
                if run == edges[g]:
                    g += 1
        links = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            for i in cx:
                for j in cy:
                    links[i, j] += cx[i] * cy[j]
        found.append((groups, links))
        counts.update(links.keys())
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for groups, links in found:
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        links = links or {}
        out.append((*n, len(groups), sum(links.values()), sum(m for p, m in links.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in links.items()), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("how", ["whole", "cut"])
def test_alignment(spark, monkeypatch, how):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    random.seed(4)
    texts += ["".join(random.choice("aé \n\t\r.,1東x▁<s>") for _ in range(random.randint(1, 60))) for _ in range(100)]
    if how == "cut":  # small slices part the texts, few links at a time, big groups by distinct ids
        for name, n in (("SLICE", 300), ("TOGETHER", 50), ("BIG_GROUP", 3), ("PAIRS_HELD", 100)):
            monkeypatch.setattr(alignment, name, n)
        coder = alignment.Aligner(A, B)
        got, counts, kept = [], Counter(), []
        for rows, told, links in alignment._batch(coder, [x and x.encode() for x in texts]):
            for i, t, found in zip(rows, told, links):
                pairs = dict(zip(found.column("pair").to_pylist(), found.column("n").to_pylist())) if found is not None else {}
                counts.update(pairs.keys())
                kept.append((i, t, pairs))
        best = {}
        for p, n in counts.items():
            best[p >> 32] = max(best.get(p >> 32, 0), n)
        got = [(*t[:4], sum(m for p, m in pairs.items() if counts[p] == best[p >> 32]), sum(m * counts[p] for p, m in pairs.items()), t[4]) for _, t, pairs in sorted(kept, key=lambda x: x[0])]
    else:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as n_a", "'x' as pairs").repartition(5)
        got = [tuple(r)[1:] for r in alignment.align_corpus(docs, A, B, ship=True).orderBy("doc_id").collect()]
    for text, g, w in zip(texts, got, plain(texts), strict=True):
        assert g == w, text


def test_alignment_of_nothing(spark):
    assert alignment.align_corpus(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
    got = alignment.align_corpus(spark.createDataFrame([(None, None), (None, "a b"), (None, "a b"), (1, "")], "doc_id bigint, text string"), A, B).collect()
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in got) == [("1", 0, 0), ("None", 0, 0), ("None", 2, 4), ("None", 2, 4)]


def test_sorted_array(spark, monkeypatch):
    monkeypatch.setattr(mapped, "RANGE_ROWS", 100)
    rows = [(k * k * (-1) ** k, k) for k in range(1000)] + [(5, 1), (5, 2), (5, 3)]
    df = spark.createDataFrame(rows, "key bigint, v bigint").repartition(7)
    for ship in (False, True):
        array = mapped.write_sorted(df, mapped.folder(spark, "t"), ship)
        assert len(array.files) > 3 and array.rows == 1003
        keys = np.array([5, 0, -1, 998001, 10**12, -(10**12), 7])
        if ship:  # workers find their copies by name
            local = spark.range(1).rdd.map(lambda _: sorted(w for p in array.probe(keys) for w in p[0].tolist())).collect()
            assert local == [[0, 1, 2, 3, 4, 6]] or local == [[0, 1, 2, 3, 4, 5, 6]]
            continue
        found = {}
        for which, table, held, place in array.probe(keys):
            for w, p in zip(which.tolist(), place.tolist()):
                if p < len(held) and held[p] == keys[w]:
                    found[int(keys[w])] = table.column("v")[p].as_py()
        assert found == {5: 1, 0: 0, -1: 1, -998001: 999} or found == {5: 1, 0: 0, -1: 1}
    nothing = mapped.write_sorted(df.limit(0), mapped.folder(spark, "t"))
    assert nothing.files == () and list(nothing.probe(np.array([1]))) == []


URLS = [
    None, "", "nothing", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://a.net?x=/", "http://net.com/", "http://anet/",
    "http://x.example.net/en/1", "http://x.example.net/EN/1", "http://example.net/e", "http://example.com/de/", "http://b.example.com/de", "http://o.org/fr/x#y",
    "http://a.b.c.d.org/fr/", "http://u@net/", "http://net:80/", "http://a..net/", "http://net./", "a://b://net/", "http://x.net/" + "y" * 100000, "http://ÄB.NET/é",
]


def fits(host, path, rules):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v == "block")
            if best is None or key > best[0]:
                best = key, h + p, v
    return best[1:] if best else (None, "allow")


def split_url(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


@pytest.mark.parametrize("collide", [False, True])
def test_url_rules(spark, monkeypatch, collide):
    random.seed(7)
    labels = ["net", "org", "example", "a", "b", "c"]
    make = lambda: (".".join(random.choice(labels) for _ in range(random.randint(1, 4))), random.choice(["", "/", "/en/", "/d", "/en/x"]), random.choice(["allow", "block"]))
    rules = [make() for _ in range(200)] + [("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("net", "/", "allow")]
    useless = [(None, "/", "block"), ("net", "x", "block"), ("net", "/zz", None), ("", "/", "block"), ("net", "/zz", "other")]
    df = spark.createDataFrame(rules + useless, "host string, path string, verdict string")
    urls = URLS + [f"http://{make()[0]}{random.choice(['', '/', '/en/', '/en/xy', '/de'])}{random.choice(['', '?q', '#f'])}" for _ in range(500)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id bigint, url string, rule string, verdict int")
    array = url_rules.build(df)
    if collide:  # all strings of a table under one digest: strings alone tell entries apart
        rows = [r for k in range(len(array.files)) for r in array._table(k).to_pylist()]
        same = spark.createDataFrame([(1, r["entry"], r["verdict"], r["lengths"]) for r in rows], "key bigint, entry string, verdict string, lengths array<int>")
        array = mapped.write_sorted(same, mapped.folder(spark, "t"), ship=True)
        for text in ("net", "net/", "absent"):
            assert (text in url_rules.look_up(mapped.write_sorted(same, mapped.folder(spark, "t"), ship=False), [text], np.array([1]))) == (text != "absent")
        return
    want = [(h.lower(), p, v) for h, p, v in rules]
    for r in url_rules.judge(pages, array).collect():
        host, path = split_url(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *fits(host, path, want)), urls[r.page_id]
    assert url_rules.judge(pages.limit(0), array).count() == 0
    none = url_rules.judge(pages, url_rules.build(df.limit(0)), default="block")
    assert none.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and none.where("verdict = 'block' and rule is null").count() == len(urls)


def test_digest_is_the_one_of_spark(spark):
    texts = ["", "a", "net/", "é東" * 40]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert got == url_rules.digest(texts).tolist() == [np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64) for t in texts]


def test_filter_audit(spark):
    import re

    base = "The quick brown fox jumps over a lazy dog while seven wise owls watch from tall old trees near that river bank " * 1
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "s"), (2, "", "s"), (3, "", None), (4, long, "s"), (5, long, "t"), (5, long, "t"), (None, long, "t"), (6, long + " $", ""), (7, "SHOUT " * 70, "t"), (8, base, "s"), (9, base, "s"), (10, "a\x0bb\x0cc\rd", "t"), (11, long.upper() + "|", "u"), (None, "", None), (12, "word " * 40000, "s")]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (7, 1, None), (None, 1, 1), (9, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as part", "2 as mask", "3 as n", "4 as digest")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as good")
    cells, parts = Counter(), set()
    for d, t, s in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        t = t or ""
        f = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and any(e is not None and e < d and (x or "") == t for e, x, _ in rows))
        good = d is not None and any(i == d and q == 1 for i, q, _ in labels)
        toxic = d is not None and any(i == d and x == 1 for i, _, x in labels)
        cells[s or "", f, good, toxic] += 1
        parts.add(s or "")
    want = {}
    for part in parts:
        for o in permutations("ABCDE"):
            for k in range(5):
                now, before = "ABCDE".index(o[k]), ["ABCDE".index(x) for x in o[:k]]
                fig = [0] * 6
                for (p, f, g, x), n in cells.items():
                    if p != part:
                        continue
                    gone = any(f[b] for b in before)
                    fig[0] += n * (not gone and not f[now])
                    fig[1] += n * (not gone and f[now])
                    fig[2] += n * (gone and f[now])
                    fig[3] += n * (f[now] and sum(f) == 1)
                    fig[4] += n * (not gone and f[now] and g)
                    fig[5] += n * (not gone and f[now] and x)
                want[part, "".join(o), k + 1] = fig
    sums = Counter()
    for (part, o, k), fig in want.items():
        sums[part, o[k - 1]] += fig[1]
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(filter_audit.failures(docs, lab)).collect()}
    assert got == {k: [*f, sums[k[0], k[1][k[2] - 1]]] for k, f in want.items()}
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), lab)).count() == 0
    assert filter_audit.audit(filter_audit.failures(docs, lab.limit(0))).where("good_lost + toxic_lost > 0").count() == 0
    three = filter_audit.audit(spark.createDataFrame([("p", 5, True, False, 7)], "part string, mask int, good boolean, toxic boolean, n bigint"), "XYZ").collect()
    assert len(three) == 18 and {(r.filter_order, r.step): r.removed for r in three}["YZX", 2] == 7
