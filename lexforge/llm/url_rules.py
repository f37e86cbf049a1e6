"""URL rules by a sorted digest array: memory-mapped xxhash keys, vectorised binary search, confirmed full strings.

A rule is a host and the beginning of a path; it fits its host and all subdomains. The array holds one entry a
rule under the 64-bit xxhash of ``host + path``, and one a host under that of the host with the lengths of its rules'
paths. A URL asks for its host and the parents of it (one key a label), and then only for the beginnings that the hosts it
found have rules for. Every key found is compared with the full string stored beside it, so collisions change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexforge.llm import caches, mapped
from lexforge.session import importable

#: Spark's xxhash64 of a string is XXH64 of its UTF-8 bytes under this seed.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def build(rules: DataFrame, path: str | None = None, ship: bool | None = None) -> mapped.SortedArray:
    """The array of ``rules(host, path, verdict)``; verdicts are ``allow`` and ``block``.

    Hosts are lower-cased (A-Z). Rules without host or verdict, or whose path is neither empty nor begins with ``/``, can
    fit nothing and are left out; a null path is empty. Of equal rules one stays; ``block`` wins where they
    disagree. Other columns are ignored; an empty table gives an array that fits nothing.
    """
    host = F.translate("host", UPPER, LOWER)
    clean = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.where("host != '' and verdict in ('allow', 'block') and (path = '' or startswith(path, '/'))")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is the greater word
    # A path has as many lengths as characters at most, so a host's list is bounded by the longest rule.
    hosts = clean.groupBy("host").agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    none = F.lit(None)
    entries = clean.select(F.concat("host", "path").alias("entry"), "verdict", none.cast("array<int>").alias("lengths")).unionByName(hosts.select(F.col("host").alias("entry"), none.cast("string").alias("verdict"), "lengths"))
    # A rule with an empty path and its host are one string; the array joins them.
    entries = entries.groupBy("entry").agg(F.max("verdict").alias("verdict"), F.max("lengths").alias("lengths"))
    return mapped.write_sorted(entries.select(F.xxhash64("entry").alias("key"), "entry", "verdict", "lengths"), path or mapped.folder(rules.sparkSession, "url_rules"), ship)


def digest(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts)).view(np.int64)


def look_up(array: mapped.SortedArray, texts: list[str], keys: np.ndarray | None = None) -> dict[str, tuple[str | None, list[int] | None]]:
    """verdict and lengths of those of the distinct ``texts`` that have an entry."""
    keys, found = digest(texts) if keys is None else keys, {}
    asked = pa.array(texts, pa.string())
    for which, table, held, place in array.probe(keys):
        # Entries of one digest lie side by side: compare strings, and move on where another string has the digest.
        while len(which):
            inside = place < len(held)
            which, place = which[inside], place[inside]
            same = held[place] == keys[which]
            which, place = which[same], place[same]
            entries = table.take(pa.array(place))
            hit = pc.equal(entries.column("entry").cast(pa.string()).combine_chunks(), asked.take(pa.array(which))).to_numpy(zero_copy_only=False)
            verdicts, lengths = entries.column("verdict").to_pylist(), entries.column("lengths").to_pylist()
            for i in np.flatnonzero(hit).tolist():
                found[texts[which[i]]] = verdicts[i], lengths[i]
            which, place = which[~hit], place[~hit] + 1
    return found


def parents(host: str) -> list[str]:
    """The host itself and all it is a subdomain of."""
    out = [host]
    while "." in host:
        host = host.split(".", 1)[1]
        out.append(host)
    return [h for h in out if h]


def judge(pages: DataFrame, array: mapped.SortedArray, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced, all others stay.

    The longest rule that fits wins, and of two as long that of the longer host; ``rule`` is null and ``verdict`` is
    ``default`` where none fits. Null, empty and odd URLs (no ``://``) have an empty host, which no rule fits. URLs of any
    length are judged whole: the work of one grows with its labels and the rules' lengths below its hosts. Rows are
    judged one by one, so repeats, ties and null ids need nothing; an empty table stays empty.
    """
    importable(pages.sparkSession)
    taken = ("host", "path", "rule", "verdict")
    host, path = host_of(F.col(url)), path_of(F.col(url))
    keep = [c for c in pages.columns if c.lower() not in taken]
    parted = pages.select(*keep, host.alias("host"), path.alias("path"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("mapped")
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            above = {h: parents(h) for h in set(hosts)}
            known = look_up(array, sorted({p for all_ in above.values() for p in all_}))
            asks = [[(p, p + path[:n]) for p in above[h] if p in known for n in known[p][1] or [] if n <= len(path)] for h, path in zip(hosts, paths)]
            rules = look_up(array, sorted({text for ask in asks for _, text in ask}))
            best = [max(((len(t), len(p), t) for p, t in ask if t in rules and rules[t][0]), default=None) for ask in asks]
            rule = pa.array([b and b[2] for b in best], pa.string())
            verdict = pa.array([rules[b[2]][0] if b else default for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    return parted.mapInArrow(decide, StructType([*parted.schema.fields, StructField("rule", StringType()), StructField("verdict", StringType())]))
