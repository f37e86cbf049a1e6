"""Near-duplicates by a MinHash LSH forest, every link confirmed on full shingle sets.

Texts of equal shingle sets form a class. A signature gives ``ORDERS`` sorted orders (trees of the forest):
each reads all values, beginning at its own place. Classes that share the first ``DEPTH`` values of an order
are a region of it; such a pair is a candidate, and its longest common prefix says how near it may be.

- First the nearest: in the first ``FIRST`` orders a region is cut by ever longer prefixes, until its parts
  hold at most ``REGION`` classes, so crowded regions go deep and sparse ones stay at ``DEPTH``. The parts are
  compared and the links make components.
- Then the rest, exactly: in every order, regions whose classes are not of one component yet are compared
  across components: the largest component in blocks against the others in blocks, never within itself.
  A region of near copies is settled by the first step; one of unlike texts costs blocks in the product
  of its two sides, the price of losing no link.

A pair at similarity 0.75 shares no region with probability (1 - 0.75 ** 3) ** 20 = 2e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import caches
from lexforge.llm.rows import fresh, keys, sieve, without
from lexforge.session import cut, importable

SHINGLE = 5
#: Orders, those of the first step, and the values a region shares.
ORDERS, FIRST, DEPTH = 20, 4, 3
#: Prefix lengths that crowded regions are cut by in turn; the last is the whole signature.
DEEPER = (6, 12, 24, 60)
#: Classes of a part that is compared whole; of a larger region's rest, classes of one block.
REGION = 512
#: Link when 100 * intersection >= SHARE * union.
SHARE = 75
CACHE_LIMIT = 200_000

_RNG = np.random.default_rng(20240601)
_FACTORS = _RNG.integers(0, 2**31, ORDERS * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WEIGHTS = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS: dict[bytes, int] = {}
caches.register("near_dedup", _WORDS.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; a short text is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only \t-\r and space split
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    if len(_WORDS) > CACHE_LIMIT:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _WEIGHTS[0]
    for j in range(1, SHINGLE):
        total += h[j : n + j] * _WEIGHTS[j]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Least value of each multiplicative hash over the shingles, 32 bits each."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_FACTORS), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        part = _FACTORS[:, None] * x[None, at : at + 1024]
        out = np.minimum(out, part.min(axis=1))
    return out


def set_hash(s: np.ndarray) -> bytes | None:
    """Name of a shingle set, 16 bytes; None for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (see rows.keys), n_shingles, set_hash (null: no words), signature (array<int>)."""
    importable(docs.sparkSession)
    k1, k2 = keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("near_dedup")
        for batch in batches:
            n, key, sig = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                n.append(len(s))
                key.append(set_hash(s))
                sig.append(signature(s).view(np.int32) if len(s) else None)
            kept = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names)

    names = ["doc_id", "k1", "k2", "n_shingles", "set_hash", "signature"]
    return docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, set_hash binary, signature array<int>")


def classes_of(rows: DataFrame) -> DataFrame:
    """set_hash, signature, and the first row of each class: doc_id (nulls last) and k1."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1")).alias("r")
    known = rows.where("set_hash is not null").groupBy("set_hash").agg(first, F.first("signature").alias("signature"))
    return known.select("set_hash", "signature", "r.doc_id", "r.k1")


def prefix(order: Column, depth: int) -> Column:
    """Hash of the first ``depth`` values of an order; the order reads the signature from its own place on, round."""
    sig = F.col("signature")
    if depth <= DEPTH:
        return F.xxhash64(order, F.slice(sig, order * DEPTH + 1, depth))
    return F.xxhash64(order, F.slice(F.concat(sig, sig), order * DEPTH + 1, depth))


def _regions(classes: DataFrame) -> DataFrame:
    """set_hash, ord, region, m (size), twin of every place of a class in a region of two or more.

    Regions of the same classes, told by number, least class, and sums and exclusive or of 64-bit hashes (in
    halves, so that sums stay exact for two billion), are one; the others are twins, kept only to be cut deeper.
    """
    orders = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDERS - 1)), lambda o: F.struct(o.alias("ord"), prefix(o, DEPTH).alias("region"))))
    placed = cut(classes.select("set_hash", orders.alias("o")).select("set_hash", "o.ord", "o.region"))
    # Most regions hold one class: only counts are shuffled for those.
    sizes = cut(placed.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    near = cut(sieve(placed, "region", sizes, "shared").where("shared").drop("shared").join(sizes, "region"))
    member = F.xxhash64("set_hash")
    alike = near.groupBy("region", "m").agg(
        F.min("ord").alias("ord"),
        F.sum(F.shiftright(member, 32)).alias("s"),
        F.sum(member.bitwiseAND(F.lit(2**32 - 1))).alias("t"),
        F.bit_xor(member).alias("x"),
        F.min(member).alias("low"),
    )
    same = alike.groupBy("m", "s", "t", "x", "low").agg(F.sort_array(F.collect_list(F.struct("ord", "region"))).alias("same"))
    each = same.select("m", F.posexplode("same").alias("i", "r")).select("r.region", "m", (F.col("i") > 0).alias("twin"), F.col("r.ord").alias("ord"))
    each = each.where(f"not twin or (m > {REGION} and ord < {FIRST})").select("region", "twin")
    return cut(near.join(each, "region").select("set_hash", "ord", "region", "m", "twin"))


def _leaves(classes: DataFrame, places: DataFrame) -> DataFrame:
    """set_hash, part, side: regions of the first orders, the crowded ones cut at the depth they need."""
    mine = places.where(F.col("ord") < FIRST)
    done = mine.where(F.col("m") <= REGION).select("set_hash", F.col("region").alias("part"))
    crowded = mine.where(F.col("m") > REGION).select("set_hash", "ord")
    for depth in DEEPER if not crowded.isEmpty() else ():
        keyed = cut(crowded.join(classes.select("set_hash", "signature"), "set_hash").select("set_hash", "ord", prefix(F.col("ord"), depth).alias("part")))
        sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        sized = keyed.join(sizes, "part")
        done = done.unionByName(sized.where(F.col("m") <= REGION).select("set_hash", "part"))
        crowded = sized.where(F.col("m") > REGION).select("set_hash", "ord")
        if depth == DEEPER[-1]:
            # Whole signatures alike: neighbours in the order of their names.
            rest = sized.where(F.col("m") > REGION)
            spread = F.pmod(F.xxhash64("set_hash"), F.ceil(F.col("m") / (REGION / 2)).cast("int"))
            done = done.unionByName(rest.select("set_hash", F.xxhash64("part", spread).alias("part")))
    return done.withColumn("side", F.lit(0))


def _rest(places: DataFrame, labels: DataFrame) -> DataFrame:
    """set_hash, part, side: pairs of blocks of the regions that hold more than one component."""
    once = places.where("not twin").join(labels.withColumnRenamed("node", "set_hash"), "set_hash", "left")
    once = cut(once.select("set_hash", "region", "m", F.coalesce("component", "set_hash").alias("component")))
    counts = once.groupBy("region", "m", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("region", "m").agg(F.max(F.struct("n", "component")).alias("top")).where("top.n < m")
    open_ = open_.select("region", F.col("top.component").alias("large"), F.col("top.n").alias("n"))
    member = once.join(open_, "region")
    inside = F.col("component") == F.col("large")
    blocks = lambda n: F.ceil(n / F.lit(REGION)).cast("int")
    n_in, n_out = blocks(F.col("n")), blocks(F.col("m") - F.col("n"))
    block = lambda n: F.pmod(F.xxhash64("set_hash", F.lit(7)), n).cast("int")
    pair = lambda kind, i, j, side: F.struct(F.xxhash64("region", F.lit(kind), i, j).alias("part"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    others = lambda b: F.transform(F.sequence(zero, n_out - 1), lambda j: pair("o", F.least(b, j), F.greatest(b, j), (j < b)))
    across_out = lambda b: F.transform(F.sequence(zero, n_in - 1), lambda j: pair("x", b, j, zero))
    across_in = lambda b: F.transform(F.sequence(zero, n_out - 1), lambda j: pair("x", j, b, one))
    whole = F.array(pair("w", zero, zero, zero))
    pairs = F.when(F.col("m") <= 2 * REGION, whole).when(inside, across_in(block(n_in))).otherwise(F.concat(others(block(n_out)), across_out(block(n_out))))
    return member.select("set_hash", F.explode(pairs).alias("p")).select("set_hash", "p.part", "p.side")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_hash and its whole set (binary, sorted 64-bit hashes), from the first row of each wanted class."""
    source = cut(classes.join(wanted.select("set_hash").distinct(), "set_hash", "left_semi").select("k1"))
    rows = sieve(docs.select("text", keys()[0].alias("k1")), "k1", source, "wanted").where("wanted").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("near_dedup")
        for batch in batches:
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([set_hash(s)], pa.binary()), pa.array([s.tobytes()], pa.large_binary()).cast(pa.binary())], ["set_hash", "shingles"])

    return rows.mapInArrow(run, "set_hash binary, shingles binary").groupBy("set_hash").agg(F.first("shingles").alias("shingles"))


def linked(sets: list[np.ndarray], side: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of texts of ``side`` and ``other`` whose full sets link, by exact intersection sizes."""
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(inverse, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    use = often[inverse]
    column, owner = number[inverse[use]], owner[use]
    left, right = np.full(len(sets), -1), np.full(len(sets), -1)
    left[side], right[other] = np.arange(len(side)), np.arange(len(other))
    inter = np.zeros((len(side), len(other)), np.float32)
    width = 2048
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        c, o = column[lo:hi] - at, owner[lo:hi]
        x, y = np.zeros((len(side), width), np.float32), np.zeros((len(other), width), np.float32)
        k = left[o] >= 0
        x[left[o[k]], c[k]] = 1
        k = right[o] >= 0
        y[right[o[k]], c[k]] = 1
        inter += x @ y.T
    whole = inter.astype(np.int64)
    union = sizes[side][:, None] + sizes[other][None, :] - whole
    i, j = np.nonzero(100 * whole >= SHARE * union)
    return side[i], other[j]


def forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """(root, member) of the components that the pairs make of n texts."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(find(i), i) for i in range(n) if find(i) != i]


def _links(docs: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the links found in each part; where a part has two sides, of those across."""
    parts = cut(parts)
    placed = parts.join(_sets(docs, classes, parts), "set_hash").select("set_hash", "part", "side", "shingles")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        caches.claim("comparison")
        group = group.drop_duplicates("set_hash").sort_values("set_hash")
        if len(group) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        sets = [np.frombuffer(s, np.uint64) for s in group.shingles]
        ids, side = group.set_hash.to_numpy(), group.side.to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if (side == 0).all() else np.flatnonzero(side == 1)
        i, j = linked(sets, left, right)
        keep = i != j
        found = forest(zip(i[keep].tolist(), j[keep].tolist()), len(ids))
        return pd.DataFrame({"a": ids[[r for r, _ in found]], "b": ids[[m for _, m in found]]}, dtype=object)

    return cut(placed.groupBy("part").applyInPandas(compare, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for all nodes of ``links(a, b)``, of any type that sorts.

    Each round takes the least component among neighbours, then jumps to that component's own; both
    joins split skewed keys. It ends when nothing changes.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = cut(edges)
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        after = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("was"))
        after = cut(after)
        jump = after.select(F.col("node").alias("c"), F.col("c").alias("further"))
        after = cut(after.join(jump, "c", "left").select("node", F.least("c", F.coalesce("further", "c")).alias("component"), "was"))
        changed = after.where("component != was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels


def groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """set_hash, component_id (least doc_id reachable, null without any) and keeper (set_hash of the class that holds
    its first row) for every class of ``rows``, the sketches of ``docs``."""
    classes = cut(classes_of(rows))
    places = _regions(classes)
    labels = cut(components(_links(docs, classes, _leaves(classes, places))))
    more = _links(docs, classes, _rest(places, labels))
    named = classes.select("set_hash", "doc_id").join(labels.withColumnRenamed("node", "set_hash"), "set_hash", "left")
    named = named.select("set_hash", "doc_id", F.coalesce("component", "set_hash").alias("component"))
    if not more.isEmpty():
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
        again = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        named = named.join(again.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        named = named.select("set_hash", "doc_id", F.coalesce("further", "component").alias("component"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_hash")).alias("r"))
    least = least.select("component", F.col("r.doc_id").alias("component_id"), F.col("r.set_hash").alias("keeper"))
    return named.select("set_hash", "component").join(least, "component").select("set_hash", "component_id", "keeper")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs(doc_id, text)``.

    Texts without words or null are empty and linked with nothing, not even each other. Rows are linked by
    their texts alone: a row without doc_id takes part, and one doc_id with two texts may lie in two components.
    component_id is the least doc_id of a component, null where no row of it has one; such rows are all kept.
    Repeated rows each give a row; ties have no effect; a long text is one set; an empty table gives no rows;
    other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(sketches(docs))
    found = groups(docs, rows)
    joined = rows.select("doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    component = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of least doc_id (nulls last), whatever other columns there are.

    Rows of empty or null text are in no group and stay. Of rows that repeat both doc_id and shingles one stays;
    a doc_id that repeats with another text loses only the row that is a copy.
    """
    rows = cut(sketches(docs))
    found = cut(groups(docs, rows))
    joined = rows.select("doc_id", "k1", "k2", "set_hash").join(found, "set_hash")
    stays = (F.col("set_hash") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = without(docs, cut(joined.where(~stays).select("k1", "k2")))
    more = cut(joined.where(stays).groupBy("set_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set_hash"))
    again = cut(joined.where(stays).join(more, "set_hash").select("k1", "k2", "set_hash").distinct())
    if again.isEmpty():
        return kept
    # Rows of one id and one set, some with other white space or other columns: the first of each set stays.
    k1, k2, name = fresh(docs, "_k1", "_k2", "_set")
    a, b = keys()
    keyed = kept.withColumn(k1, a).withColumn(k2, b)
    known = again.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("set_hash").alias(name))
    one = keyed.join(known, [k1, k2]).groupBy(name).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return keyed.join(known, [k1, k2], "left_anti").select(*docs.columns).unionByName(one)
