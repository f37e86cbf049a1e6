"""Chunks of documents: sentences packed greedily to a word budget, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.legal import SECTIONS
from lexforge.functions.text import let, word_count
from lexforge.session import importable

BUDGET = 120
#: Words a chunk aims at, by kind of content; a longer paragraph than ``MOST`` stands alone, and a tail
#: of fewer than ``LEAST`` joins the chunk before it in its section.
TARGET, MOST, LEAST = {"statute": 128, "list": 128, "narrative": 384}, 512, 50

# What may number a heading, headings, and marks of statutes and of lists.
NUMBERING = r"(?:(?:[IVXLCDM]+\.?\s+)|(?:[A-Z]\.?\s+)|(?:\d+\.?\s+))?"
HEADINGS = (
    r"(FACTS?|BACKGROUND|FACTUAL BACKGROUND"
    r"|LAW|LEGAL FRAMEWORK|APPLICABLE LAW|RELEVANT LAW"
    r"|ANALYSIS|DISCUSSION|REASONING"
    r"|CONCLUSION|DECISION|ORDER|DISPOSITION"
    r"|ISSUES?"
    r"|RELIEF|REMEDY|DAMAGES"
    r"|OVERVIEW|INTRODUCTION|SUMMARY"
    r"|BETWEEN|BEFORE)"
)
STATUTE = [r"(?i)(?:s\.|[Ss]ection)\s*\d+", r"\(\d+\)\s*[A-Z]", r"(?i)\b(?:shall|must|may not|is prohibited)\b"]
LIST = r"(?m)^\s*(?:[-•*]|\([a-z]\)|\([ivx]+\)|\d+\.)\s+"


def normalise(text: Column) -> Column:
    """Runs of line ends and of spaces fold."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")


def sentences(text: Column) -> Column:
    """Sentences by end marks and line ends, trimmed; empty ones go."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def pack_sentences(parts: Column, budget: int = BUDGET) -> Column:
    """Chunks of consecutive sentences within ``budget`` words; a longer sentence stands alone.

    The fold goes over numbers of words alone and gives the sentence each chunk begins at; texts are joined once.
    """
    state = "struct<starts:array<int>,n:int>"
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n")).cast(state)

    def packed(p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fits = (acc["n"] > 0) & (acc["n"] + x["n"] <= budget)
            grown = F.struct(acc["starts"].alias("starts"), (acc["n"] + x["n"]).alias("n"))
            opened = F.struct(F.concat(acc["starts"], F.array(x["i"])).alias("starts"), x["n"].alias("n"))
            return F.when(fits, grown).otherwise(opened).cast(state)

        counts = F.transform(p, lambda s, i: F.struct(word_count(s).alias("n"), i.alias("i")))
        starts = F.aggregate(counts, begin, step, lambda a: a["starts"])
        return let(starts, lambda at: F.transform(at, lambda s, i: F.array_join(F.slice(p, s + 1, F.coalesce(F.get(at, i + 1), F.size(p)) - s), " ")))

    return let(parts, packed)


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """document id, chunk_index (from 0), total_chunks, content and token_count of each chunk."""
    chunks = docs.select(id_col, pack_sentences(sentences(normalise(F.col(text_col))), budget).alias("chunks"))
    rows = chunks.select(id_col, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "content"))
    return rows.select(id_col, "chunk_index", "total_chunks", "content", word_count(F.col("content")).alias("token_count"))


def with_overlap(chunks: DataFrame, id_col: str = "doc_id", n: int = 200) -> DataFrame:
    """Each chunk led by the last ``n`` characters of the one before it."""
    before = F.lag("content").over(Window.partitionBy(id_col).orderBy("chunk_index"))
    return chunks.withColumn("content", F.when(before.isNull(), F.col("content")).otherwise(F.concat(F.right(before, F.lit(n)), F.lit(" "), F.col("content"))))


def content_type(text: Column) -> Column:
    """statute (two of its marks or more), list (three items or more) or narrative."""
    marks = sum((text.rlike(p).cast("int") for p in STATUTE), F.lit(0))
    return F.when(marks >= 2, "statute").when(F.size(F.regexp_extract_all(text, F.lit(LIST), F.lit(0))) >= 3, "list").otherwise("narrative")


def section_name(text: Column) -> Column:
    """The section that the first line's heading begins, else the heading itself; null without any."""
    heading = F.upper(F.regexp_extract(text, rf"(?i)^\s*{NUMBERING}{HEADINGS}", 1))
    name = F.when(heading != "", F.lower(heading))
    for section, marks in reversed(SECTIONS):
        name = F.when(heading.rlike(marks), section).otherwise(name)
    return name


def split_sections(text: Column) -> Column:
    """Pieces of a text that begin at headings; joined, they give the text."""
    return F.split(text, rf"(?im)(?=^{NUMBERING}{HEADINGS})")


def paragraphs(text: Column) -> Column:
    """Paragraphs by their numbers in brackets, else by blank lines; trimmed, without empty ones."""
    solid = lambda parts: F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    numbered = solid(F.split(text, r"(?=\[[0-9]+\])"))
    return F.when(F.size(numbered) > 1, numbered).otherwise(solid(F.split(text, "\n\n")))


def chunk_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks that cross neither sections nor paragraphs, of a size that fits their kind of content.

    id, section_index, section, content_type, chunk_index (from 0, within the section), content,
    token_count, first_par and last_par (bracketed numbers, null without). Null and blank texts give none.
    A short tail joins the chunk before it and is kept where there is none, so no word is lost.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    split = docs.select(id_col, F.filter(split_sections(text), lambda s: s.rlike(r"\S")).alias("pieces"))
    pieces = split.select(id_col, F.size("pieces").alias("n"), F.posexplode("pieces").alias("section_index", "piece"))
    untitled = F.when(F.col("n") > 1, "preamble").otherwise("body")
    named = pieces.select(id_col, "section_index", F.coalesce(section_name(F.col("piece")), untitled).alias("section"), content_type(F.col("piece")).alias("content_type"), paragraphs(F.col("piece")).alias("pars"))
    target = F.when(F.col("content_type") == "narrative", TARGET["narrative"]).otherwise(TARGET["statute"])
    chunk_type = "struct<text:string,n:int>"
    state = f"struct<done:array<{chunk_type}>,open:{chunk_type}>"
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("n")).cast(chunk_type)

    def flush(acc: Column) -> Column:
        return F.when(acc["open"]["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def joined(a: Column, b: Column) -> Column:
        return F.when(a["n"] == 0, b).otherwise(F.struct(F.concat(a["text"], F.lit("\n\n"), b["text"]).alias("text"), (a["n"] + b["n"]).alias("n")))

    def step(acc: Column, p: Column) -> Column:
        one = F.struct(p.alias("text"), word_count(p).alias("n")).cast(chunk_type)
        alone = F.struct(F.concat(flush(acc), F.array(one)).alias("done"), none.alias("open"))
        closed = F.struct(flush(acc).alias("done"), one.alias("open"))
        grown = F.struct(acc["done"].alias("done"), joined(acc["open"], one).alias("open"))
        fits = acc["open"]["n"] + one["n"] <= target
        return F.when(one["n"] > MOST, alone).when(fits | (acc["open"]["n"] == 0), grown).otherwise(closed).cast(state)

    def finish(acc: Column) -> Column:
        n, last = F.size(acc["done"]), F.get(acc["done"], F.size(acc["done"]) - 1)
        merge = (acc["open"]["n"] > 0) & (acc["open"]["n"] < LEAST) & (n > 0)
        return F.when(merge, F.concat(F.slice(acc["done"], F.lit(1), n - 1), F.array(joined(last, acc["open"]).cast(chunk_type)))).otherwise(flush(acc))

    start = F.struct(F.array().cast(f"array<{chunk_type}>").alias("done"), none.alias("open")).cast(state)
    rows = named.select(id_col, "section_index", "section", "content_type", F.posexplode(F.aggregate("pars", start, step, finish)).alias("chunk_index", "c"))
    numbers = F.regexp_extract_all(F.col("c.text"), F.lit(r"(?m)^\[([0-9]+)\]"), F.lit(1))
    ends = [F.get(numbers, i).try_cast("bigint") for i in (F.lit(0), F.size(numbers) - 1)]
    return rows.select(id_col, "section_index", "section", "content_type", "chunk_index", F.col("c.text").alias("content"), F.col("c.n").alias("token_count"), ends[0].alias("first_par"), ends[1].alias("last_par"))


# --- by tokens of a byte-level vocabulary ---

#: Characters given to the tokenizer at once; longer texts are cut where a token must begin.
SEGMENT = 1 << 17
PARAGRAPH, SENTENCE, CUT = re.compile(r"\n\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"(?<=\S) ")
_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def token_offsets(text: str, path: str) -> list[tuple[int, int]]:
    """First and last sign (exclusive) of every token."""
    out, at = [], 0
    while at < len(text):
        to = len(text)
        if to - at > SEGMENT:
            found = CUT.search(text, at + SEGMENT)
            to = found.start() if found else to
        out += [(a + at, b + at) for a, b in _tokenizer(path).encode(text[at:to], add_special_tokens=False).offsets]
        at = to
    return out


def token_pieces(text: str, ends: list[int], most: int) -> list[int]:
    """The token after each piece: paragraphs, sentences of those over ``most`` tokens, and cuts of longer ones."""
    out: list[int] = []

    def add(last: int) -> None:
        while last - (out[-1] if out else 0) > most:
            out.append((out[-1] if out else 0) + most)
        if last > (out[-1] if out else 0):
            out.append(last)

    def bounds(pattern: re.Pattern, a: int, b: int) -> list[int]:
        return [m.start() for m in pattern.finditer(text, a, b)] + [b]

    start = 0
    for end in bounds(PARAGRAPH, 0, len(text)):
        last = bisect_right(ends, end)
        if last - (out[-1] if out else 0) > most:
            for stop in bounds(SENTENCE, start, end):
                add(bisect_right(ends, stop))
        add(last)
        start = end
    add(len(ends))
    return out


def token_spans(pieces: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of tokens of at most ``budget``: whole pieces while they fit, each run led by the last ``overlap`` of the one
    before. No piece is longer than ``budget - overlap``."""
    out, a, b = [], 0, 0
    for end in pieces:
        if end - a > budget and b:
            out.append((a, b))
            a = max(0, b - overlap)
        b = end
    return [*out, (a, b)] if b else out


def chunk_tokens(docs: DataFrame, tokenizer: str, budget: int = 512, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, total_chunks, first_token, token_count, content: chunks of at most ``budget`` tokens.

    Runs of line ends and of spaces fold first. Chunks hold whole paragraphs while they fit; a paragraph that would not fit
    beside the overlap is parted into sentences, and a sentence that would not into runs of tokens. Every token is in some
    chunk and neighbours share exactly ``overlap`` tokens. Null and blank texts give none. ``tokenizer`` is the file of a
    byte-level vocabulary, at the same place on every worker.
    """
    if not 0 <= overlap < budget:
        raise ValueError("the overlap must be smaller than the budget")
    importable(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text")).where(F.col("_text").rlike(r"\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column("_text").to_pylist()):
                offsets = token_offsets(text, tokenizer)
                spans = token_spans(token_pieces(text, [b for _, b in offsets], budget - overlap), budget, overlap)
                for k, (a, b) in enumerate(spans):
                    for col, v in zip(cols, (i, k, len(spans), a, b - a, text[offsets[a][0] : offsets[b - 1][1]])):
                        col.append(v)
            ids = batch.column(id_col).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())))], [id_col, "chunk_index", "total_chunks", "first_token", "token_count", "content"])

    return rows.mapInArrow(run, f"{id_col} {kind}, chunk_index int, total_chunks int, first_token bigint, token_count bigint, content string")
