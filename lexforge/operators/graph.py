"""Knowledge graphs as node and edge tables: upsert, search, PageRank, components, linear text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import cut

#: Names that are compared with every question at most, some 50 MB.
NAMES = 500_000


def upsert_edges(triples: DataFrame) -> DataFrame:
    """One edge a (subject, object): the last triple by ``ord`` gives relation and confidence."""
    last = F.max_by(F.struct("relation", "confidence"), "ord").alias("x")
    return triples.groupBy("subject", "object").agg(last).select("subject", "object", "x.relation", "x.confidence")


def nodes_of(triples: DataFrame) -> DataFrame:
    """id and type of every subject and object; the last type wins."""
    both = triples.select(F.col("subject").alias("id"), F.col("subject_type").alias("type"), "ord").unionByName(triples.select(F.col("object").alias("id"), F.col("object_type").alias("type"), "ord"))
    return both.groupBy("id").agg(F.max_by("type", F.struct("ord", "type")).alias("type"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id and the least number of undirected steps from ``seeds(id)``, up to ``depth``."""
    both = edges.select(F.col("subject").alias("s"), F.col("object").alias("o")).union(edges.select("object", "subject")).distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("s")).select(F.col("o").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
        if d % 3 == 0:
            seen, frontier = cut(seen), cut(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``nodes(id)``."""
    left = edges.join(nodes.select(F.col("id").alias("subject")), "subject", "left_semi")
    return left.join(nodes.select(F.col("id").alias("object")), "object", "left_semi").select(*edges.columns)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, score; nodes without out-edges spread their score evenly.

    Ends when the scores change by less than ``tolerance`` a node in sum, or after ``rounds``. Each round is one join
    and one partially combined sum, materialised, so that plans do not grow.
    """
    out = edges.groupBy("subject").agg(F.count(F.lit(1)).alias("out"))
    links = cut(edges.join(out, "subject").select(F.col("subject").alias("id"), F.col("object").alias("to"), "out"))
    base = nodes.select("id").join(out.withColumnRenamed("subject", "id"), "id", "left").select("id", F.col("out").isNull().alias("dangling"))
    n = max(nodes.count(), 1)
    rank = cut(base.select("id", "dangling", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("was")))
    for _ in range(rounds):
        lost, change = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)), F.sum(F.abs(F.col("score") - F.col("was")))).first()
        if (change or 0.0) < tolerance * n:
            break
        got = rank.join(links, "id").groupBy("to").agg(F.sum(F.col("score") / F.col("out")).alias("got")).withColumnRenamed("to", "id")
        score = F.lit((1 - damping + damping * lost) / n) + damping * F.coalesce("got", F.lit(0.0))
        rank = cut(rank.join(got, "id", "left").select("id", "dangling", score.alias("score"), F.col("score").alias("was")))
    return rank.select("id", "score")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges and density m / (n (n - 1)) of a directed graph; 0 below two nodes."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.join(F.broadcast(m), how="cross").withColumn("density", F.coalesce(F.try_divide(F.col("edges").cast("double"), pairs), F.lit(0.0)))  # one row each


def find_entity(asked: DataFrame, names: DataFrame) -> DataFrame:
    """query_id and the id of the node an entity means: of ``asked(query_id, q)`` and ``names(id, name, ord)``.

    Equal but for case comes first, then a name that holds the question or is held by it; of those the first by
    ``ord``. The containment test has no key, so ``names`` is broadcast; more than ``NAMES`` of them are refused.
    """
    if names.limit(NAMES + 1).count() > NAMES:
        raise ValueError(f"more than {NAMES} names to compare with; look entities up by words (triples.mentions)")
    low = lambda c: F.lower(F.col(c))
    match = (low("name") == low("q")) | F.contains(low("name"), low("q")) | F.contains(low("q"), low("name"))
    hits = asked.where("q != ''").join(F.broadcast(names), match)
    best = hits.groupBy("query_id").agg(F.min(F.struct((low("name") != low("q")).alias("other"), "ord", "id")).alias("r"))
    return best.select("query_id", "r.id")


def node_scores(ranks: DataFrame, words: DataFrame, question) -> DataFrame:
    """id and rank times (0.1 + share of the question's words in the node's) of ``ranks(id, score)``, ``words(id, words)``."""
    share = F.when(F.size(question) == 0, 0.0).otherwise(F.size(F.array_intersect(question, "words")) / F.size(question))
    return ranks.join(words, "id").select("id", (F.col("score") * (0.1 + share)).alias("score"))


def backpropagate(tree: DataFrame, rewards: DataFrame, most_depth: int = 64) -> DataFrame:
    """id, visits, total of ``tree(id, parent)`` after each of ``rewards(id, reward)`` is added to a node and all above it.

    Rewards climb one level a round, summed at each, so a round shuffles one row a node; lineage is cut each round.
    """
    level = rewards.groupBy("id").agg(F.count(F.lit(1)).alias("visits"), F.sum("reward").alias("total"))
    every = level
    for _ in range(most_depth):
        level = level.join(tree, "id").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("visits").alias("visits"), F.sum("total").alias("total"))
        level = cut(level)
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.groupBy("id").agg(F.sum("visits").alias("visits"), F.sum("total").alias("total"))


def best_path(tree: DataFrame, most_depth: int = 64) -> DataFrame:
    """root, step, id: from each root the visited child of best mean, again and again, of ``tree(id, parent, visits, total)``."""
    mean = F.col("total") / F.col("visits")
    best = tree.where("visits > 0 and parent is not null").groupBy("parent").agg(F.min(F.struct((-mean).alias("m"), "id")).alias("r"))
    best = cut(best.select("parent", F.col("r.id").alias("child")))
    at = tree.where("parent is null").select(F.col("id").alias("root"), F.lit(0).alias("step"), "id")
    path = at
    for step in range(1, most_depth):
        at = cut(at.join(best, F.col("id") == F.col("parent")).select("root", F.lit(step).alias("step"), F.col("child").alias("id")))
        if at.isEmpty():
            break
        path = path.unionByName(at)
    return path


def components(edges: DataFrame) -> DataFrame:
    """id and the least id of its weakly connected component, by least labels and pointer jumps."""
    both = cut(edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(edges.select("object", "subject")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = cut(labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c")))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
        step = cut(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("further", "c")).alias("c")))
        done = step.where("c != was").limit(1).count() == 0
        labels = step.select("id", "c")
        if done:
            return labels.withColumnRenamed("c", "component")


def linearize(edges: DataFrame, most: int = 10) -> DataFrame:
    """relation and its first ``most`` edges as sorted text, with the number of all.

    Each task keeps its own first edges a relation, so that a relation of any size sends few rows to the last step.
    """
    text = F.concat_ws(" -> ", "subject", "object")
    kept = edges.select("relation", F.struct("subject", "object", text.alias("t")).alias("e"), F.pmod(F.xxhash64("subject", "object"), F.lit(64)).alias("part"))
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("e"))
    few = kept.withColumn("r", by("relation", "part")).where(F.col("r") <= most)
    last = few.withColumn("r", by("relation")).where(F.col("r") <= most)
    joined = last.groupBy("relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), "; ").alias("text"))
    return joined.join(edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")), "relation")
