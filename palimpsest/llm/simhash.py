"""SimHash near-duplicates with pivot distance tables.

Fingerprint. A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; shingles are three words joined by a space, repeats
included (fewer words: the whole sequence; none: fingerprint zero). A bit is 1 if it is set in over half of the shingles'
XXH64 values (UTF-8, seed 42). Fingerprints link at `max_bits` or fewer differing bits.

Links. Only distinct fingerprints are compared. Each gets a row of the pivot table: its Hamming distances to `PIVOTS`
reference fingerprints. Two that differ in at most `max_bits` bits are equal in two of four 16-bit quarters at least, so
pairs come from the six pairs of quarters; a pair with a pivot coordinate that differs by more than `max_bits` is
discarded (a Hamming distance is a metric), and the survivors are verified.

Large buckets. A pair of quarters that more than `BUCKET` distinct fingerprints share isn't paired. Each of these
fingerprints instead names itself and the 64 that differ from it in one bit, and those that name the same are linked
through the least of them: two are at most two bits apart exactly if they name one in common. So the work per fingerprint
is bounded and no link is lost. Both ways hold for 2 bits and less; `links` refuses more.

Components are the fixed point of minimum propagation with pointer jumping, on distinct linked fingerprints only; each
round is cut by a checkpoint. Cases: null and empty texts have fingerprint zero and link like any other; repeated rows
are copies; a null doc_id never names a component: where all ids are null, component_id is null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from palimpsest.llm import scan
from palimpsest.llm.common import SPACES, add_columns, col, cut, one_of_each, text_hash

SHINGLE, MAX_BITS, PIVOTS, BUCKET, SALTS = 3, 2, 16, 64, 16


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    parts = [np.zeros(0, np.uint64)]
    for _, _, data, bounds in scan.blocks(texts):
        data = scan.lower_table()[data]
        words = scan.Words(data, bounds, scan.class_table(SPACES, False))
        # The words of each text joined by one space: every shingle is then one stretch of bytes.
        keep = np.zeros(len(data) + 1, bool)
        in_word = scan.class_table(SPACES, False)[data]
        keep[:-1] = in_word
        keep[words.ends] = True
        joined = np.where(keep[:-1], np.where(in_word, data, np.uint8(32)), np.uint8(0))
        place = np.r_[0, np.cumsum(keep)]
        flat = np.r_[joined, np.uint8(32)][keep].tobytes()
        size = np.minimum(words.counts, shingle)
        n = np.where(words.counts > 0, words.counts - size + 1, 0)
        first = np.repeat(words.bounds[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        last = first + np.repeat(size, n) - 1
        begin, end = place[words.starts[first]].tolist(), place[words.ends[last]].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(flat[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(begin))
        stops = np.r_[0, np.cumsum(n)]
        out = np.zeros(len(n), np.uint64)
        for a, b, i in zip(stops[:-1], stops[1:], range(len(n))):
            if b > a:
                bits = np.unpackbits(h[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * bits > b - a).view(">u8")[0]
        parts.append(out)
    return np.concatenate(parts)


def add_fingerprint(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, into: str = "fingerprint") -> DataFrame:
    """docs with a 64-bit fingerprint, as a signed long."""

    def make():
        return lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))]

    return add_columns(docs, text, [StructField(into, LongType())], make)


def _pivots(n: int) -> list[int]:
    return np.random.default_rng(64).integers(-(2**63), 2**63 - 1, n).tolist()


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def with_pivot_distances(prints: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """prints with d0, d1, ...: the Hamming distances of fp to fixed reference fingerprints."""
    return prints.select("*", *[_distance(F.col("fp"), F.lit(p)).cast("byte").alias(f"d{i}") for i, p in enumerate(_pivots(pivots))])


def links(prints: DataFrame, *, max_bits: int = MAX_BITS, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: enough links between distinct fingerprints to connect all that are max_bits or fewer apart."""
    if max_bits > 2:
        raise ValueError(f"max_bits is {max_bits}: pairs of equal quarters find all links up to 2 bits only")
    quarter = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[
        F.lit(10 * i + j) + F.lit(100) * (quarter(i) * F.lit(1 << 16) + quarter(j)) for i in range(4) for j in range(i + 1, 4)])
    keyed = cut(prints.select("fp", F.explode(keys).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    names = [f"d{i}" for i in range(pivots)]
    # Cut, so that the pairs' plan holds neither the counts nor the distances twice.
    shared = cut(with_pivot_distances(keyed.join(counts, "key"), pivots).select("key", "fp", "n", F.struct(*names).alias("d")))
    small = shared.where(F.col("n") <= bucket)
    left, right = small.select("key", F.col("fp").alias("a"), F.col("d").alias("da")), small.select("key", F.col("fp").alias("b"), F.col("d").alias("db"))
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"da.{n}") - F.col(f"db.{n}")) <= max_bits for n in names])
    verified = _distance(F.col("a"), F.col("b")) <= max_bits
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & near & verified).select("a", "b")
    crowded = shared.where(F.col("n") > bucket)
    if crowded.isEmpty():
        return pairs.distinct()
    large = crowded.select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    named = large.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    least = named.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("at", "a")
    through = named.join(least, "at").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through).distinct()


def _salted(rows: DataFrame, facts: DataFrame, at: str, key: str) -> DataFrame:
    """rows left-joined with facts where rows.at = facts.key; the rows of one key are dealt over `SALTS` tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    each = facts.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    return rows.withColumn("salt", salt).join(each.withColumnRenamed(key, at), [at, "salt"], "left").drop("salt")


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the least node that it is connected to.

    Each round, every node takes the least root among its neighbours' roots, and roots follow their own roots; rounds are
    logarithmic in a component's diameter in practice, and end when no neighbour's root is less. A large component's nodes
    share a root, so joins on roots are salted; those on nodes have a row for each link.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    for _ in range(most_rounds):
        around = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        mine = cut(roots.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("to")))
        # Neighbours that all share a root are a component, and its least node is among them.
        if mine.where("to < old").isEmpty():
            return roots
        # A root that some node can improve is improved too, so that whole trees move at once.
        hooks = mine.where("to < old").groupBy(F.col("old").alias("root")).agg(F.min("to").alias("hook"))
        hooked = _salted(mine, hooks, "old", "root").select("node", "old", F.least("to", F.coalesce("hook", "to")).alias("to"))
        # Only a node that is a root can be jumped from.
        tops = roots.select("root").distinct().withColumnRenamed("root", "node")
        jump = roots.join(tops, "node", "left_semi").select("node", F.col("root").alias("next"))
        roots = cut(_salted(hooked, jump, "to", "node").select("node", F.least(F.col("to"), F.coalesce("next", "to")).alias("root")))
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
    pivots: int = PIVOTS, bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, __th, fingerprint, component, component_id) for each row of docs.

    __th tells texts of an id apart; component is a fingerprint that names the component, also where all its ids are null.
    """
    light = docs.select(col(doc_id).alias("doc_id"), text_hash(text).alias("__th"), col(text).alias("__body"))
    printed = cut(add_fingerprint(light, text="__body", shingle=shingle, into="fingerprint").drop("__body"))
    prints = cut(printed.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    found = components(links(prints.select("fp"), max_bits=max_bits, pivots=pivots, bucket=bucket))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", F.col("root").alias("component"), "component_id")
    return printed.join(by_print, printed["fingerprint"] == by_print["fp"]).drop("fp")


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", at_least: float | None = None, **options) -> DataFrame:
    """The rows of docs that stay: of each component the document of least id, once.

    With `at_least`, links of fingerprints are confirmed by the Jaccard coefficient of shingle sets, and pairs of that
    coefficient that lie further apart are added (see shingle_dedup): those of 0.8 lie up to 20 bits apart, a bound at which
    pivot distances of 64-bit fingerprints discard half a per cent of pairs.
    """
    if at_least is not None:
        from palimpsest.llm import shingle_dedup

        return shingle_dedup.drop_similar(docs, text=text, doc_id=doc_id, at_least=at_least, **options)
    return keep_least(docs, near_duplicates(docs, text=text, doc_id=doc_id, **options), text=text, doc_id=doc_id)


def keep_least(docs: DataFrame, found: DataFrame, *, text: str, doc_id: str) -> DataFrame:
    """The rows of docs that stay if `found` has (doc_id, __th, component): of each component the document of least id, once."""
    rows = found.groupBy("component", "doc_id", "__th").agg(F.count("*").alias("__rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__th", "__rows"))
    chosen = rows.groupBy("component").agg(best.alias("best")).select(
        F.col("best.doc_id").alias("__id"), F.col("best.__th").alias("__th"), F.col("best.__rows").alias("__rows"))
    return one_of_each(docs, chosen, text=text, doc_id=doc_id)
