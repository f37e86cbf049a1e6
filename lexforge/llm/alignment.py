"""Alignment of two tokenizers' tokens over the same texts, as an Arrow-native pipeline.

Byte offsets where a token of both ends cut a text into groups, and every A token of a group is linked with every
B token of it. Tokens of a slice of texts lie flat in Arrow lists: ``list_flatten`` and ``list_parent_indices`` give each
its document, cumulative sums of byte lengths, less what lies before the document, give its end, and an Acero hash join
on (document, end) keys finds the common ends. ``Table.group_by`` counts links by document and by pair of ids; Spark
merges the partial counts. The count of a pair is then looked up in a sorted array that workers map from the shared
folder (at most one entry for each two entries of the vocabularies), so links are never shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import caches, mapped
from lexforge.llm.tokens import ODD, ODD_BYTES, SPACE
from lexforge.session import cut, importable

#: Bytes of text aligned at once; a longer text is cut where both tokenizers must begin a token.
SLICE = 1 << 20
#: Chunks a generation of the cache; a worker holds two at most.
GENERATION = 150_000
#: Links spelt out at once; groups of more are counted by distinct ids.
TOGETHER = 1 << 20
BIG_GROUP = 1 << 12
#: Distinct pairs a task gathers before it hands its partial counts on.
PAIRS_HELD = 1 << 19
#: A chunk begins with one of these; the piece tokenizer has pieces that hold a carriage return, so it is none.
BREAK = np.zeros(256, bool)
BREAK[list(b"\t\n\x0b\x0c ")] = True

_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}
caches.register("alignment", _ALIGNERS.clear)


def byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable Latin-1 signs are themselves, the other
    bytes follow in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both, for whole texts, with a cache of encoded chunks.

    Both tokenizers begin a token wherever white space follows another sign, so texts are cut there; texts with
    uncommon white space are encoded whole. Names of special tokens are plain text.
    """

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.space = self.b.piece_to_id("▁")
        sign = byte_of_sign()
        vocabulary = sorted(self.a.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        a_bytes = [b""] * (vocabulary[-1][1] + 1)
        for token, k in vocabulary:
            a_bytes[k] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)]
        # Each id as text with the sign that may follow it: within a group, after its A tokens, after its B tokens.
        self.most = max(map(len, (a_bytes, b_bytes)))
        self.texts = pa.array([f"{k}{s}".encode() for s in ",|;" for k in range(self.most)], pa.large_binary())
        self.young: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}

    def _encode(self, chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
        out = []
        texts = [c.decode() for c in chunks]
        for at in range(0, len(texts), 4096):
            some = texts[at : at + 4096]
            one = self.a.encode_batch_fast(some, add_special_tokens=False)
            # B puts a space before what it reads: it stands for the chunk's own, or is taken off again.
            two = self.b.encode([t[1:] if t[0] == " " else t for t in some], num_threads=1)
            for t, x, y in zip(some, one, two):
                if t == " ":  # the space after a text's last word: no text is left to read, but the space is a token
                    y = [self.space]
                out.append((np.array(x.ids, "<u4").tobytes(), np.array(y if t[0] == " " else y[1:], "<u4").tobytes()))
        return out

    def encode(self, raw: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Lists of A and B ids of the texts side by side in ``raw`` from ``begins`` on; each begins with a space."""
        ends = np.append(begins[1:], len(raw))
        first = BREAK[raw].copy()
        first[1:] &= ~SPACE[raw[:-1]]
        first[begins] = True
        for i in np.unique(np.searchsorted(begins, np.flatnonzero(ODD_BYTES[raw]), side="right") - 1).tolist():
            if ODD.search(raw[begins[i] : ends[i]].tobytes().decode()):
                first[begins[i] + 1 : ends[i]] = False
        starts = np.flatnonzero(first)
        edges = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(raw)]).dictionary_encode()
        distinct, which = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        found = [self.young.get(c) or self.old.get(c) for c in distinct]
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._encode([distinct[i] for i in new])):
            found[i] = x
        self.young.update((c, x) for c, x in zip(distinct, found) if len(c) <= 64)
        of_text = np.searchsorted(starts, np.append(begins, len(raw)))
        return self._lists([x for x, _ in found], which, of_text), self._lists([y for _, y in found], which, of_text)

    @staticmethod
    def _lists(ids: list[bytes], which: np.ndarray, of_text: np.ndarray) -> pa.Array:
        """One list a text of the ids of its chunks."""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, place = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        long = size[which]
        to = np.cumsum(long)
        flat = table[np.repeat(place[which] - (to - long), long) + np.arange(to[-1] if len(to) else 0)]
        return pa.LargeListArray.from_arrays(np.append(0, to)[of_text], pa.array(flat.astype(np.int32)))


def aligner(byte_bpe: str, piece_model: str) -> Aligner:
    caches.claim("alignment")
    if (byte_bpe, piece_model) not in _ALIGNERS:
        _ALIGNERS[byte_bpe, piece_model] = Aligner(byte_bpe, piece_model)
    return _ALIGNERS[byte_bpe, piece_model]


def _token_ends(lists: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all tokens, the text of each, and the byte of its text where it ends."""
    ids = pc.list_flatten(lists).to_numpy()
    parent = pc.list_parent_indices(lists).to_numpy()
    run = pc.cumulative_sum(pa.array(sizes[ids])).to_numpy() if len(ids) else np.zeros(0, np.int64)
    at = lists.offsets.to_numpy()[:-1]
    before = np.where(at > 0, run[np.maximum(at, 1) - 1] if len(run) else 0, 0)
    return ids, parent, run - before[parent]


def _fold(pairs: pa.Table, by: list[str], value: str, how: str) -> pa.Table:
    return pairs.group_by(by, use_threads=False).aggregate([(value, how)]).rename_columns([*by, value])


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, text: np.ndarray, groups: int) -> pa.Table:
    """text, pair and n, how often the pair is linked there, from the ids and groups of all tokens of a slice."""
    ca, cb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    start = np.cumsum(cb) - cb
    parts = []

    def add(t: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        pair = (x.astype(np.int64) << 32) | y
        parts.append(_fold(pa.table({"text": t, "pair": pair, "n": n}), ["text", "pair"], "n", "sum"))

    big = ca * cb > BIG_GROUP
    rows = np.flatnonzero(~big[ga])
    edges = np.append(0, np.cumsum(cb[ga[rows]]))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, side="right")) - 1)
        some = rows[at:to]
        times = cb[ga[some]]
        one = np.repeat(some, times)
        two = np.repeat(start[ga[some]] - (np.cumsum(times) - times), times) + np.arange(len(one))
        add(text[one], a[one], b[two], np.ones(len(one), np.int64))
        at = to
    # In a group of many tokens few ids differ: every distinct A id by every distinct B id, weighted.
    begin = np.cumsum(ca) - ca
    for g in np.flatnonzero(big).tolist():
        x, nx = np.unique(a[begin[g] : begin[g] + ca[g]], return_counts=True)
        y, ny = np.unique(b[start[g] : start[g] + cb[g]], return_counts=True)
        step = max(1, TOGETHER // len(y))
        for k in range(0, len(x), step):
            some = x[k : k + step]
            add(np.full(len(some) * len(y), text[begin[g]]), np.repeat(some, len(y)), np.tile(y, len(some)), np.repeat(nx[k : k + step], len(y)) * np.tile(ny, len(some)))
    return _fold(pa.concat_tables(parts), ["text", "pair"], "n", "sum") if len(parts) > 1 else parts[0] if parts else pa.table({"text": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})


def align(coder: Aligner, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[bytes], pa.Table]:
    """For the texts side by side in ``raw``: n_a, n_b, n_groups, n_links and whether it has tokens (columns of an
    array, a row a text), its groups as text, and the table of its links."""
    texts = len(begins)
    la, lb = coder.encode(raw, begins)
    ends = np.append(begins[1:], len(raw))
    # A text counts only where both sequences spell it: compare all at once, and each where that fails.
    right = np.ones(texts, bool)
    for lists, spelt in zip((la, lb), coder.bytes):
        said = spelt.take(pc.list_flatten(lists))
        at = np.frombuffer(said.buffers()[1], np.int64)[lists.offsets.to_numpy()]
        data = memoryview(said.buffers()[2] or b"")
        if not (len(data) and at[-1] == len(raw) and (np.frombuffer(data, np.uint8)[: len(raw)] == raw).all() and (at[:-1] == begins).all()):
            right &= [bytes(data[at[i] : at[i + 1]]) == raw[begins[i] : ends[i]].tobytes() for i in range(texts)]
    if not right.all():
        none = pa.array([[]] * texts, la.type)
        la, lb = pc.if_else(pa.array(right), la, none), pc.if_else(pa.array(right), lb, none)
        la, lb = (pa.LargeListArray.from_arrays(np.append(0, np.cumsum(pc.list_value_length(x).to_numpy())), pc.list_flatten(x)) for x in (la, lb))
    a, ta, ea = _token_ends(la, coder.sizes[0])
    b, tb, eb = _token_ends(lb, coder.sizes[1])
    one = pa.table({"key": (ta.astype(np.int64) << 40) | ea, "a": np.arange(len(a))})
    two = pa.table({"key": (tb.astype(np.int64) << 40) | eb, "b": np.arange(len(b))})
    common = one.join(two, "key", join_type="inner", use_threads=False)
    cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    cut_a[common.column("a").to_numpy()] = True
    cut_b[common.column("b").to_numpy()] = True
    # Both have the same cuts in the same order, and each text ends with one.
    ga, gb = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    text = ta[np.flatnonzero(cut_a)]
    ca, cb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    per = lambda x, w=None: np.bincount(x, w, texts).astype(np.int64)
    # Sums of links stay exact in integers whatever their size.
    links = np.zeros(texts, np.int64)
    np.add.at(links, text, ca * cb)
    figures = np.stack([per(ta), per(tb), per(text), links, right.astype(np.int64)], axis=1)
    # A tokens of a group, then its B tokens, each with the sign that follows it, spelt by one take.
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + (np.cumsum(cb) - cb)[ga]] = a + coder.most * cut_a
    code[np.arange(len(b)) + np.cumsum(ca)[gb]] = b + 2 * coder.most * cut_b
    spelt = coder.texts.take(pa.array(code))
    tokens = np.append(0, np.cumsum(figures[:, 0] + figures[:, 1]))
    at = np.frombuffer(spelt.buffers()[1], np.int64)[tokens] if len(code) else np.zeros(texts + 1, np.int64)
    data = memoryview(spelt.buffers()[2] or b"")
    return figures, [bytes(data[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())], _links(a, b, ga, gb, ta, groups)


def _segments(text: bytes) -> list[bytes]:
    """A long text in parts of some ``SLICE`` bytes, cut where both tokenizers begin a token; each begins with a space.

    Cuts are made at spaces that follow another sign; a text without any, or with uncommon white space, stays whole."""
    if len(text) <= 2 * SLICE or ODD.search(text.decode()):
        return [text]
    out, at = [], 0
    while len(text) - at > 2 * SLICE:
        to = at + SLICE
        while to > 0 and not (text[to] == 0x20 and not SPACE[text[to - 1]]):
            to = text.find(b" ", to + 1)
        if to < 0:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


class _Digest:
    """SHA-256 of groups as text, without the sign after the last."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, spelt: bytes) -> None:
        if spelt:
            self.hash.update(b";" + spelt[:-1] if self.any else spelt[:-1])
            self.any = True

    def told(self) -> str:
        return self.hash.hexdigest() if self.any else ""


def _batch(coder: Aligner, texts: list[bytes | None]) -> Iterator[tuple[list[int], list[tuple], list[pa.Table]]]:
    """Positions, (n_a, n_b, n_groups, n_links, sha256) and links of the texts, slice by slice."""
    held, size = [], 0

    def close(rows: list[int]) -> tuple:
        parts = [b" " + texts[i] for i in rows]
        begins = np.append(0, np.cumsum([len(p) for p in parts]))[:-1]
        figures, spelt, links = align(coder, np.frombuffer(b"".join(parts), np.uint8), begins)
        told = []
        for f, s in zip(figures.tolist(), spelt):
            d = _Digest()
            d.add(s)
            told.append((*f[:4], d.told()))
        order = links.sort_by("text")
        edges = np.searchsorted(order.column("text").to_numpy(), np.arange(len(rows) + 1))
        return rows, told, [order.slice(x, y - x) for x, y in zip(edges.tolist(), edges[1:].tolist())]

    for i, text in enumerate(texts):
        if not text:
            yield [i], [(0, 0, 0, 0, "")], [None]
        elif len(text) > SLICE:
            sums, digest, links, right = np.zeros(4, np.int64), _Digest(), [], True
            for part in _segments(b" " + text):
                figures, spelt, found = align(coder, np.frombuffer(part, np.uint8), np.zeros(1, np.int64))
                right = right and bool(figures[0, 4])
                if not right:
                    break
                sums += figures[0, :4]
                digest.add(spelt[0])
                links.append(_fold(pa.concat_tables([*links, found]), ["text", "pair"], "n", "sum"))
                links = links[-1:]
            yield [i], [(*sums.tolist(), digest.told()) if right else (0, 0, 0, 0, "")], [links[0] if right else None]
        else:
            if held and size + len(text) > SLICE:
                yield close(held)
                held, size = [], 0
            held.append(i)
            size += len(text) + 1
    if held:
        yield close(held)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row of ``docs(doc_id, text)``, and
    rows of partial counts alone: part_pairs and part_docs, with n_a null.

    ``pairs`` are the distinct linked ids of a text, ``a << 32 | b``, and ``times`` how often each is linked there. Null and empty
    texts, and texts that a tokenizer does not spell as they are, have no tokens: zeros, no pairs and an empty hash. Long
    texts are aligned whole, a part at a time; repeated rows and null doc_ids each have their row; other columns are
    ignored; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    lists = pa.list_(pa.int64())
    types = [pa.int64()] * 5 + [pa.string(), lists, lists, lists, lists]
    names = ["doc_id", *FIGURES, "groups_sha256", "pairs", "times", "part_pairs", "part_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(byte_bpe, piece_model)
        counts: list[pa.Table] = []

        def partial() -> pa.RecordBatch:
            held = counts.pop()
            row = [None] * 8 + [held.column("pair").to_pylist(), held.column("n").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()
            for rows, told, links in _batch(coder, texts):
                some = [t for t in links if t is not None and len(t)]
                pairs = pa.concat_tables(some) if some else None
                if pairs is not None:
                    seen = _fold(pairs.select(["pair"]).append_column("n", pa.array(np.ones(len(pairs), np.int64))), ["pair"], "n", "sum")
                    counts[:] = [_fold(pa.concat_tables([*counts, seen]), ["pair"], "n", "sum")]
                edges = np.append(0, np.cumsum([0 if t is None else len(t) for t in links])).astype(np.int32)
                flat = [pairs.column(c).combine_chunks() if pairs is not None else pa.array([], pa.int64()) for c in ("pair", "n")]
                flat = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in flat]
                columns = [pa.array([ids[i] for i in rows], pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*told), types[1:6]))]
                columns += [pa.ListArray.from_arrays(edges, x) for x in flat] + [pa.nulls(len(rows), lists)] * 2
                yield pa.RecordBatch.from_arrays(columns, names)
                if counts and len(counts[0]) >= PAIRS_HELD:
                    yield partial()
        if counts:
            yield partial()

    figures = ", ".join(f"{c} bigint" for c in FIGURES)
    arrays = ", ".join(f"{c} array<bigint>" for c in names[6:])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {figures}, groups_sha256 string, {arrays}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (how many documents hold it linked) and best (n is the highest of its A id), from ``aligned`` rows."""
    parts = rows.where("part_pairs is not null").select(F.explode(F.arrays_zip("part_pairs", "part_docs")).alias("p"))
    counts = parts.groupBy(F.col("p.part_pairs").alias("pair")).agg(F.sum("p.part_docs").alias("n"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 32)))
    # One row an A id, so at most the vocabulary.
    return mapped.best_of(counts, "a", "n", "best").select("pair", "n", "best")


def align_corpus(docs: DataFrame, byte_bpe: str, piece_model: str, ship: bool | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose pair is the most frequent of its A id over all rows, ties included; count_sum adds the
    counts of the pairs over the links. Texts are encoded once: ``aligned`` rows are written in the shared folder and
    read twice, their partial counts first. Odd rows are as ``aligned`` says.
    """
    spark = docs.sparkSession
    importable(spark)
    path = mapped.folder(spark, "alignment")
    aligned(docs, byte_bpe, piece_model).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    counts = pair_counts(rows).select(F.col("pair").alias("key"), "n", F.col("best").cast("long").alias("best"))
    array = mapped.write_sorted(counts, f"{path}/counts", ship)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("mapped")
        for batch in batches:
            lists, times = batch.column("pairs"), pc.list_flatten(batch.column("times")).to_numpy()
            pairs, text = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
            sums = np.zeros((2, batch.num_rows), np.int64)
            for which, table, held, place in array.probe(pairs):
                if not (held[place] == pairs[which]).all():
                    raise RuntimeError("a linked pair has no count")
                for k, name in enumerate(("best", "n")):
                    np.add.at(sums[k], text[which], times[which] * table.column(name).chunk(0).to_numpy()[place])
            kept = [batch.column(c) for c in ("doc_id", *FIGURES)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), batch.column("groups_sha256")], ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    figures = ", ".join(f"{c} bigint" for c in ("doc_id", *FIGURES, "n_best", "count_sum"))
    return rows.where("n_a is not null").select("doc_id", *FIGURES, "groups_sha256", "pairs", "times").mapInArrow(total, f"{figures}, groups_sha256 string")
