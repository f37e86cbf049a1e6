"""Triples out of texts by a dictionary of entities, and passages merged with what the graph says of their entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import legal
from lexforge.session import cut

# Types of entities and of relations.
ENTITY_TYPES = ["Case", "Court", "Judge", "LegalTest", "Factor", "Jurisdiction", "Party", "Statute"]
RELATION_TYPES = [
    "cites", "applies_test", "involves_factor", "decided_by", "supports_classification", "overrules", "distinguishes",
    "enacted_by", "amends", "interprets",
]
#: Entities that are broadcast at most; a larger dictionary is joined by shuffling.
BROADCAST_ENTITIES = 500_000
TRIPLE = "subject string, subject_type string, predicate string, object string, object_type string, confidence double"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """id, sentence, found: the entities of ``entities(name, type)`` in each sentence of ``texts(id, text)``, in order, as
    an array of (start, stop, name, type) by words; ids must be unique.

    Runs of words as long as some name are joined with the dictionary, so a text is read once whatever the number of
    names. A name within a longer one found there does not count. Names are compared by their lower-cased words.
    """
    names = entities.select(words(F.col("name")).alias("w"), "name", "type").where("size(w) > 0")
    names = cut(names.groupBy(F.array_join("w", " ").alias("gram"), F.size("w").alias("n")).agg(F.min(F.struct("name", "type")).alias("e")).select("gram", "n", "e.*"))
    lengths = sorted(r["n"] for r in names.select("n").distinct().collect())  # a number a length
    if not lengths:
        return texts.limit(0).selectExpr("id", "0 as sentence", "cast(array() as array<struct<start: int, stop: int, name: string, type: string>>) as found")
    parts = texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("sentence", "s")).select("id", "sentence", words(F.col("s")).alias("w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice(F.col("w"), i + 1, F.lit(n)), " ").alias("gram")))

    grams = parts.select("id", "sentence", F.explode(F.concat(*map(runs, lengths))).alias("g")).select("id", "sentence", "g.*")
    known = F.broadcast(names) if names.count() <= BROADCAST_ENTITIES else names
    hits = grams.join(known.drop("n"), "gram").groupBy("id", "sentence").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "name", "type"))).alias("all"))
    within = lambda x, y: (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & (y["stop"] - y["start"] > x["stop"] - x["start"])
    return hits.select("id", "sentence", F.filter("all", lambda x: ~F.exists("all", lambda y: within(x, y))).alias("found"))


def relation(subject_type: Column, object_type: Column) -> Column:
    """The relation that stands between two types: one of the list by their places."""
    place = lambda c: F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), c) - 1
    return F.element_at(F.array(*map(F.lit, RELATION_TYPES)), ((place(subject_type) * len(ENTITY_TYPES) + place(object_type)) % len(RELATION_TYPES) + 1).cast("int"))


def answers(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """id and answer: each text's triples as an extractor would say them in JSON, neighbours in a sentence paired.

    The nearer two names, the surer; names that touch get no confidence. Pairs grow with the names of a sentence.
    """
    pair = F.transform(
        F.filter(F.arrays_zip(F.slice("found", F.lit(1), F.size("found") - 1).alias("a"), F.slice("found", F.lit(2), F.size("found") - 1).alias("b")), lambda p: p["a"]["name"] != p["b"]["name"]),
        lambda p: F.struct(
            p["a"]["name"].alias("subject"), p["a"]["type"].alias("subject_type"), relation(p["a"]["type"], p["b"]["type"]).alias("predicate"),
            p["b"]["name"].alias("object"), p["b"]["type"].alias("object_type"),
            F.when(p["b"]["start"] > p["a"]["stop"], 1.0 / (1 + p["b"]["start"] - p["a"]["stop"])).alias("confidence"),
        ),
    )
    pairs = mentions(texts, entities).where("size(found) > 1").select("id", pair.alias("p"))
    return pairs.groupBy("id").agg(F.flatten(F.collect_list("p")).alias("triples")).select("id", F.to_json(F.struct("triples")).alias("answer"))


def validated(said: DataFrame) -> DataFrame:
    """The triples of ``said(id, answer)``: JSON out of the answer, known types and relations only, 0.8 where no
    confidence is given; answers without JSON give none."""
    read = said.select("id", F.from_json(legal.json_object(F.col("answer")), f"triples array<struct<{TRIPLE.replace(' ', ': ')}>>".replace(",: ", ", ")).alias("j"))
    rows = read.select("id", F.inline("j.triples"))
    known = F.col("subject_type").isin(ENTITY_TYPES) & F.col("object_type").isin(ENTITY_TYPES) & F.col("predicate").isin(RELATION_TYPES)
    return rows.where(known & F.col("subject").isNotNull() & F.col("object").isNotNull()).withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))


def edges_of(triples: DataFrame) -> DataFrame:
    """subject, object, relation, confidence and types: each relation of a pair once, at its surest."""
    return triples.groupBy("subject", "object", F.col("predicate").alias("relation")).agg(F.max("confidence").alias("confidence"), F.min("subject_type").alias("subject_type"), F.min("object_type").alias("object_type"))


def around(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed and the edges among the nodes at most ``depth`` undirected steps from it, for all of ``seeds(seed)`` at once."""
    both = edges.select(F.col("subject").alias("s"), F.col("object").alias("o")).union(edges.select("object", "subject")).distinct()
    near = seeds.select("seed", F.col("seed").alias("node")).distinct()
    for _ in range(depth):
        near = cut(near.union(near.join(both, F.col("node") == F.col("s")).select("seed", "o")).distinct())
    held = near.join(edges, F.col("node") == F.col("subject")).drop("node")
    return held.join(near.select("seed", F.col("node").alias("object")), ["seed", "object"], "left_semi").select("seed", *edges.columns)


def described(edges: DataFrame, most: int = 10) -> DataFrame:
    """seed and text: of ``edges(seed, subject, object, relation, subject_type, object_type)`` the entities by type, the
    relations, and the chain of what cites what; the first ``most`` of each in order of their names, with the number of all.

    Each task keeps its own first rows of a line, so a seed of any size sends few rows to the last step.
    """
    types = edges.select("seed", F.lit(1).alias("part"), F.col("subject_type").alias("line"), F.col("subject").alias("t")).union(edges.select("seed", F.lit(1), "object_type", "object")).distinct()
    links = edges.select("seed", F.lit(2).alias("part"), F.col("relation").alias("line"), F.concat_ws(" -> ", "subject", "object").alias("t"))
    rows = types.union(links)
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("t"), F.lit(32)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    few = dealt.withColumn("r", first("seed", "part", "line", "deal")).where(F.col("r") <= most)
    few = few.withColumn("r", first("seed", "part", "line")).where(F.col("r") <= most)
    lines = few.groupBy("seed", "part", "line").agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias("text"))
    lines = lines.join(rows.groupBy("seed", "part", "line").agg(F.count(F.lit(1)).alias("n")), ["seed", "part", "line"])
    lines = lines.select("seed", "part", "line", F.concat("line", F.lit(" ("), "n", F.lit("): "), "text").alias("text"))
    cites = edges.where("relation = 'cites'").select("seed", "subject", "object", F.pmod(F.xxhash64("subject", "object"), F.lit(32)).alias("deal"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("subject", "object"))
    chain = cites.withColumn("r", place("seed", "deal")).where("r <= 5").withColumn("r", place("seed")).where("r <= 5")
    chain = chain.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("r", "subject", "object"))).alias("c"))
    chain = chain.select("seed", F.lit(3).alias("part"), F.lit("").alias("line"), F.concat(F.lit("chain: "), F.array_join(F.concat(F.transform("c", lambda x: x["subject"]), F.array(F.element_at("c", -1)["object"])), " -> ")).alias("text"))
    every = lines.unionByName(chain).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("part", "line", "text"))).alias("l"))
    return every.select("seed", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def linked(questions: DataFrame, hits: DataFrame, entities: DataFrame, passages: int = 3, signs: int = 200, most: int = 5) -> DataFrame:
    """query_id, place (from 1), name: the entities of ``questions(query_id, q)``, then those of the first ``signs`` of its
    first ``passages`` of ``hits(query_id, rank, text)``; each once, ``most`` of them."""
    head = hits.where(F.col("rank") <= passages).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.left(F.coalesce("text", F.lit("")), F.lit(signs)).alias("t")))).alias("p"))
    heads = head.select("query_id", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))
    texts = questions.select(F.struct("query_id", F.lit(0).alias("source")).alias("id"), F.col("q").alias("text")).unionByName(heads.select(F.struct("query_id", F.lit(1).alias("source")).alias("id"), "text"))
    found = mentions(texts, entities).select("id.query_id", "id.source", "sentence", F.explode("found").alias("m"))
    first = found.groupBy("query_id", "m.name").agg(F.min(F.struct("source", "sentence", "m.start", "m.stop")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "name"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "name")


def merged(hits: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id and context: passages of ``hits(query_id, rank, score, text)`` by rank, then what ``texts(seed, text)`` say of
    ``links(query_id, place, name)`` by place, each part under its mark; entities the graph does not know are left out."""
    p = hits.select("query_id", F.lit(0).alias("part"), F.col("rank").alias("at"), F.concat(F.lit("[Passage "), "rank", F.lit(", Score: "), F.format_string("%.3f", "score"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))
    g = links.join(texts, F.col("name") == F.col("seed")).select("query_id", F.lit(1).alias("part"), F.col("place").alias("at"), F.concat(F.lit("About "), "name", F.lit("\n"), "text").alias("t"))
    rows = p.unionByName(g).groupBy("query_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("r"))
    mark = F.when(F.col("part") == 0, "=== PASSAGES ===").otherwise("=== GRAPH ===")
    parts = rows.select("query_id", "part", F.concat(mark, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("t"))
    both = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "t"))).alias("r"))
    return both.select("query_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("context"))
