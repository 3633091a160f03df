"""Filtered hybrid search: token postings, lexical score, exact vector distance, weighted fusion.

Tokens are runs of letters and digits of any script, lower-cased. The lexical score is the share of a query's distinct
tokens that a text has; with a title it is the greater of that and the trigram similarity of title and query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import jaccard, trigrams
from palimpsest.functions.vectors import cosine_distance
from palimpsest.operators.lineage import cut
from palimpsest.operators.nearest import first_of_each, unit
from palimpsest.operators.packing import BLOCK_BYTES, block_pairs, few_records, numbered_blocks, packed, rows_of

#: Weights of the lexical and the vector score, by mode.
WEIGHTS = {"hybrid": (0.45, 0.55), "lexical": (1.0, 0.0), "vector": (0.0, 1.0)}


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys("".join(c if c.isalpha() or c.isnumeric() else " " for c in query.lower()).split()))


def term_share(text: Column, terms: list[str]) -> Column:
    """Share of the distinct query terms that the text has; 0 without terms."""
    if not terms:
        return F.lit(0.0)
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, terms)))) / F.lit(float(len(terms)))


def bm25(docs: DataFrame, terms: list[str], *, key: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents with a term: Okapi BM25 with idf ln(1 + (N - n + 0.5) / (n + 0.5))."""
    rows = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    times = lambda word: F.size(F.filter("t", lambda x: x == F.lit(word)))
    sized = rows.select("key", F.size("t").alias("size"), *[times(w).alias(f"f{i}") for i, w in enumerate(terms)])
    stats = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = stats[f"n{i}"] or 0
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        f = F.col(f"f{i}")
        score = score + F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("size") / F.lit(stats["mean"] or 1.0)))
    return sized.select(F.col("key").alias(key), score.alias("score")).where("score > 0")


def embedded(embed: Callable[[str], list[float]], query: str, mode: str) -> tuple[list[float] | None, str | None]:
    """(vector, error) of a query: a failure is told, and ends the search only where the mode needs the vector."""
    if mode == "lexical" or not query:
        return None, None
    try:
        return embed(query), None
    except Exception as failure:  # whatever the embedding service raises
        error = f"{type(failure).__name__}: {failure}"[:300]
        if mode == "vector":
            raise RuntimeError(f"vector search is unavailable: {error}") from failure
        return None, error


def hybrid_search(
    items: DataFrame, vectors: DataFrame | None, *, key: str, text: str, query: str, query_vector: list[float] | None, mode: str = "hybrid",
    title: str | None = None, published: str | None = None, where: Column | None = None,
    vector_key: str = "vec_id", vector: str = "embedding", top: int = 20, offset: int = 0,
) -> DataFrame:
    """(key, lexical, vector, score) of one request: the best items that meet `where`, newest first among equals, then by key.

    Without an item's vector, or a query vector, that score is 0. A mode without weight on vectors, or no query vector,
    leaves the vector table unread; `where` is applied before any score is computed.
    """
    lexical_weight, vector_weight = WEIGHTS[mode]
    rows = items if where is None else items.where(where)
    share = term_share(F.col(text), query_terms(query)) if lexical_weight else F.lit(0.0)
    if title is not None and lexical_weight and query:
        share = F.greatest(share, jaccard(trigrams(F.lower(F.coalesce(F.col(title), F.lit("")))), trigrams(F.lit(query.lower()))))
    newest = F.col(published) if published else F.lit(None).cast("int")
    lexical = rows.select(F.col(key).alias("key"), newest.alias("published"), F.round(share, 6).alias("lexical"))
    if vectors is None or query_vector is None or vector_weight == 0:
        scored = lexical.withColumn("vector", F.lit(0.0))
    else:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        near = vectors.select(F.col(vector_key).alias("key"), (F.lit(1.0) - cosine_distance(F.col(vector), q)).alias("v")).groupBy("key").agg(F.max("v").alias("v"))
        scored = lexical.join(near, "key", "left").select("key", "published", "lexical", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("vector"))
    score = F.round(F.col("lexical") * lexical_weight + F.col("vector") * vector_weight, 8)
    best = scored.withColumn("score", score).orderBy(F.col("score").desc(), F.col("published").desc_nulls_first(), "key").offset(offset).limit(top)
    return best.select(F.col("key").alias(key), "lexical", "vector", "score")


class _Sets:
    """The sets of hashes that the queries of a block have, by element: which queries have it."""

    def __init__(self, sets: pa.ListArray):
        flat, sizes = sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        self.known, first = np.unique(flat[order], return_index=True)
        self.first, self.who, self.sizes = np.r_[first, len(flat)], np.repeat(np.arange(len(sets)), sizes)[order], sizes

    def shared(self, sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, items): how many elements each has of each; and the items' numbers of elements."""
        flat, sizes = sets.flatten().to_numpy(zero_copy_only=False), sets.value_lengths().to_numpy(zero_copy_only=False)
        if not len(self.known):
            return np.zeros((len(self.sizes), len(sets)), np.int64), sizes
        at = np.searchsorted(self.known, flat)
        hit = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == flat)
        # Every query that has an element that the item has, once for each such element.
        at, item = at[hit], np.repeat(np.arange(len(sets)), sizes)[hit]
        times = self.first[at + 1] - self.first[at]
        place = np.arange(times.sum()) + np.repeat(self.first[at] - (np.cumsum(times) - times), times)
        counts = np.bincount(self.who[place] * len(sets) + np.repeat(item, times), minlength=len(self.sizes) * len(sets))
        return counts.reshape(len(self.sizes), -1), sizes


def _vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which element each is of) of an array of arrays of vectors."""
    inner = lists.flatten()
    who = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return unit(inner.to_pylist()), who


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x, not negative, rounded half up, as SQL does: 1/128 is 0.007813."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class _Asked:
    """A block of queries, and of each the tokens that an item must have some of to reach the query's bar.

    A query's bar is a score that `top` items are known to reach. An item without a vector has to share `least` tokens with
    it. Of a query's tokens, ordered from rare to frequent, the first `n_rare` are looked up: who shares m tokens in all shares
    m - (size - n_rare) of these at least, since no more are left. Without bars every token is looked up.
    """

    def __init__(self, q: pa.StructArray, weights: tuple[float, float]):
        terms = q.field("terms")
        flat, self.sizes = terms.flatten().to_numpy(zero_copy_only=False), terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.known, self.at = np.unique(flat, return_inverse=True)
        self.start = np.r_[0, np.cumsum(self.sizes)]
        who = np.repeat(np.arange(len(q)), self.sizes)
        self.bars = q.field("bar").to_numpy(zero_copy_only=False).astype(float) if q.type.get_field_index("bar") >= 0 else np.full(len(q), np.nan)
        self.vectors, self.whose = _vectors(q.field("v"))
        with np.errstate(invalid="ignore"):
            self.least = np.nan_to_num(self.needed(np.arange(len(q)), 0.0, weights), nan=-1.0)
        self.n_rare = np.clip(self.sizes - self.least + np.maximum(1, self.sizes // 8), 0, self.sizes).astype(np.int64)
        order = np.lexsort((np.bincount(self.at, minlength=len(self.known))[self.at], who))
        rare = order[np.arange(len(order)) - self.start[who] < self.n_rare[who]]
        rare = rare[np.argsort(self.at[rare], kind="stable")]
        #: Of each token, in how many queries it is looked up, and where in `who` these are.
        self.times, self.who = np.bincount(self.at[rare], minlength=len(self.known)), who[rare]
        self.first = np.cumsum(self.times) - self.times

    def needed(self, who: np.ndarray, near: np.ndarray | float, weights: tuple[float, float]) -> np.ndarray:
        """How many tokens an item has to share with each of the queries `who`, if its vector has the score `near`; nan without a bar.

        The margin is more than what scores are rounded by.
        """
        return np.ceil(self.sizes[who] * ((self.bars[who] - weights[1] * near) / weights[0] - 2e-6) - 1e-9)


def _places(known: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of flat are among known, and where there)."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known, flat)
    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == flat)
    return hit, at[hit]


class _Met:
    """The tokens of a block of items that a block of queries has: of which item, and which of the queries' tokens."""

    def __init__(self, asked: _Asked, terms: pa.ListArray):
        flat, sizes = terms.flatten().to_numpy(zero_copy_only=False), terms.value_lengths().to_numpy(zero_copy_only=False)
        self.n = len(terms)
        hit, self.at = _places(asked.known, flat)
        self.item = np.repeat(np.arange(self.n), sizes)[hit]
        self.edges = np.searchsorted(self.item, np.arange(self.n + 1))


def _spans(asked: _Asked, met: _Met):
    """(lo, hi, counts) of items: how many tokens that are looked up each query (row) shares with each of them (column), in parts of bounded size."""
    rare = np.flatnonzero(asked.times[met.at])
    at, item = met.at[rare], met.item[rare]
    times = asked.times[at]
    work = np.r_[0, np.cumsum(np.bincount(item, weights=times, minlength=met.n) + len(asked.sizes))]
    lo = 0
    while lo < met.n:
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + SPAN, "right")) - 1)
        a, b = np.searchsorted(item, (lo, hi))
        n = times[a:b]
        place = np.arange(n.sum()) + np.repeat(asked.first[at[a:b]] - (np.cumsum(n) - n), n)
        counts = np.bincount(asked.who[place] * (hi - lo) + np.repeat(item[a:b] - lo, n), minlength=len(asked.sizes) * (hi - lo))
        yield lo, hi, counts.reshape(len(asked.sizes), -1)
        lo = hi


def _shared(asked: _Asked, met: _Met, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """How many tokens in all the query `row` and the item `column` of each pair share; pairs are ordered by column."""
    out, mark = np.zeros(len(row), np.int64), np.zeros(len(asked.known), np.int8)
    edges = np.r_[np.flatnonzero(np.r_[True, column[1:] != column[:-1]]), len(column)] if len(column) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        at = met.at[met.edges[column[a]]:met.edges[column[a] + 1]]
        mark[at] = 1
        for c in range(a, b, SHARE):
            who = row[c:min(c + SHARE, b)]
            n = asked.sizes[who]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(asked.start[who] - (ends - n), n)
            sums = np.r_[0, np.cumsum(mark[asked.at[place]], dtype=np.int64)]
            out[c:c + len(who)] = sums[ends] - sums[ends - n]
        mark[at] = 0
    return out


def _nearness(asked: _Asked, v: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries with a vector, items with vectors, the vector score of each with each: the best of an item's vectors)."""
    xv, of = _vectors(v)
    if not (len(asked.vectors) and len(xv)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return asked.whose, of[starts], np.round(np.maximum.reduceat(asked.vectors @ xv.T, starts, axis=1), 6)


def _reaching(asked: _Asked, x: pa.StructArray, weights: tuple[float, float]):
    """(row, column, lexical, vector, score) of the pairs that reach the query's bar.

    Of items that share nothing with a query and have no vector, only those marked `first` come: `top` items are before the others.
    """
    tokens_met, marked = _Met(asked, x.field("terms")), x.field("first").to_numpy(zero_copy_only=False)
    whose, those, near = _nearness(asked, x.field("v")) if weights[1] else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
    left = (asked.sizes - asked.n_rare)[:, None]
    floor = np.where(np.isnan(asked.bars), -1, np.maximum(asked.least, 1))[:, None] - left
    pairs = []
    for lo, hi, counts in _spans(asked, tokens_met):
        met = counts >= floor
        some = np.flatnonzero(marked[lo:hi])
        met[:, some] = counts[:, some] >= asked.least[:, None] - left
        a, b = np.searchsorted(those, (lo, hi))
        if b > a and len(whose):
            wanted = np.nan_to_num(asked.needed(whose[:, None], near[:, a:b], weights), nan=-1.0)
            cells = np.ix_(whose, those[a:b] - lo)
            met[cells] = counts[cells] >= wanted - left[whose]
        column, row = np.nonzero(met.T)
        pairs.append((row, column + lo))
    row, column = (np.concatenate(c) if pairs else np.zeros(0, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    lexical = _half_up(_shared(asked, tokens_met, row, column) / np.maximum(asked.sizes[row], 1), 6)
    vector = np.zeros(len(row))
    if len(whose):
        # A query has one vector at most.
        of_q, of_x = np.full(len(asked.sizes), -1), np.full(len(x), -1)
        of_q[whose], of_x[those] = np.arange(len(whose)), np.arange(len(those))
        has = np.flatnonzero((of_q[row] >= 0) & (of_x[column] >= 0))
        vector[has] = near[of_q[row[has]], of_x[column[has]]]
    score = np.round(lexical * weights[0] + vector * weights[1], 8)
    kept = np.flatnonzero(~(score < asked.bars[row]))
    return row[kept], column[kept], lexical[kept], vector[kept], score[kept]


def _scored(asked: _Asked, x: pa.StructArray, weights: tuple[float, float], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the `top` best items of each query, by all its tokens."""
    score = np.zeros((len(asked.sizes), len(x)))
    for lo, hi, counts in _spans(asked, _Met(asked, x.field("terms"))):
        score[:, lo:hi] = _half_up(counts / np.maximum(asked.sizes, 1)[:, None], 6) * weights[0]
    if weights[1]:
        whose, those, near = _nearness(asked, x.field("v"))
        score[np.ix_(whose, those)] += near * weights[1]
    score = np.round(score, 8)
    row, column = first_of_each(-score, np.arange(len(x)), top)
    return row, score[row, column]


#: Items of the most tokens that bars come from, and as many of those with vectors.
LARGEST = 2048
#: Rows of a block at most.
BLOCK_ROWS = 10_000
#: Bytes of a block of queries; cells and hits that are counted at once, and pairs whose tokens are compared at once.
ASKED_BYTES, SPAN, SHARE = 1 << 24, 1 << 21, 1 << 12


def _by_bars(asked: DataFrame, rows: DataFrame, *, key: str, kind: str, weights: tuple[float, float], top: int, block_bytes: int) -> DataFrame:
    """search_all where words weigh and there are neither titles nor groups: no pair is scored that can't reach its query's bar.

    A bar is the `top`-th best score among few items: those of the most tokens, which share the most with any query, and the
    first by age and id, which come before all others that share nothing. Any items would give a bar that loses no result.
    asked (q_id, terms, v) and rows (id, age, terms, v).
    """
    spark = asked.sparkSession
    by_age = (F.col("age").desc_nulls_first(), F.col("id"))
    bare = rows.select("id", "age", (F.size("v") == 0).alias("plain"))
    firsts = None
    for some in (bare, bare.where("plain")):
        # First within each part, then of what these leave.
        few = some.withColumn("__r", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(256))).orderBy(*by_age))).where(F.col("__r") <= top)
        few = few.withColumn("__r", F.row_number().over(Window.orderBy(*by_age))).where(F.col("__r") <= top).select(F.col("id").alias("__first"))
        firsts = few if firsts is None else firsts.union(few)
    firsts = cut(firsts.distinct().coalesce(1))
    marked = rows.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("__first")), "left").select("id", "age", "terms", "v", F.size("terms").alias("n"), (F.col("__first").isNotNull()).alias("first"))
    marked = marked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    with few_records(spark, BLOCK_ROWS):
        blocks = cut(packed(marked, "x", block_bytes=8 * block_bytes).withColumn("sizes", F.expr("transform(x, r -> struct(r.n AS n, size(r.v) > 0 AS has))")))
    sizes = blocks.select(F.explode("sizes").alias("s")).select("s.n", "s.has")
    floors = []
    for some in (sizes, sizes.where("has")) if weights[1] else (sizes,):
        # The size that fewer than `LARGEST` items exceed: equal ones are as many as they like.
        found = some.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.col("n").desc()).withColumn("c", F.sum("c").over(Window.orderBy(F.col("n").desc()))).where(F.col("c") > LARGEST).agg(F.max("n")).first()[0]
        floors.append(-1 if found is None else found)
    of_bar = f"r.first OR r.n > {floors[0]}" + (f" OR (r.n > {floors[1]} AND size(r.v) > 0)" if weights[1] else "")
    few = blocks.select(F.explode(F.expr(f"filter(x, r -> {of_bar})")).alias("r")).select("r.*")
    with few_records(spark, BLOCK_ROWS):
        few = cut(packed(few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"), "x", block_bytes=8 * block_bytes))
    asked = cut(asked.withColumn("bytes", F.lit(64) + 8 * (F.size("terms") + F.aggregate("v", F.lit(0), lambda n, v: n + F.size(v)))))
    n = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // ASKED_BYTES))

    def asking(df: DataFrame) -> DataFrame:
        with few_records(spark, BLOCK_ROWS):
            # Parts without a block would read all items for nothing.
            return cut(numbered_blocks(packed(df.repartition(n, "q_id"), "q", block_bytes=ASKED_BYTES), "q_block")).coalesce(n)

    def each(batches):
        """(queries, number of items, items) of each pair of blocks; a task meets the pairs of one block of queries in a row."""
        known = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(batch.schema.get_field_index("q_block"))[i].as_py()
                if number not in known:
                    if len(known) == 2:
                        known.clear()
                    known[number] = rows_of(batch, "q", i).field("q_id"), _Asked(rows_of(batch, "q", i), weights)
                yield *known[number], rows_of(batch, "x", i)

    def to_bars(batches):
        for ids, queries, x in each(batches):
            row, score = _scored(queries, x, weights, top)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(score)], names=["q_id", "score"])

    def reaching(batches):
        for ids, queries, x in each(batches):
            row, column, lexical, vector, score = _reaching(queries, x, weights)
            if not weights[1] and len(row):
                vector = _cosines(queries, x.field("v"), row, column)
            at = pa.array(column)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), x.field("id").take(at), pa.array(lexical), pa.array(vector), pa.array(score), x.field("age").take(at)],
                                             names=["q_id", key, "lexical", "vector", "score", "age"])

    asked_as = asked.schema["q_id"].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc()))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("age").desc_nulls_first(), key))
    found = block_pairs(asking(asked.drop("bytes")), few).mapInArrow(to_bars, f"q_id {asked_as}, score double")
    with few_records(spark, 1):
        bars = cut(found.withColumn("__r", place).where(F.col("__r") == top).select(F.col("q_id").alias("__q_id"), F.col("score").alias("bar")))
    barred = asked.join(bars, F.col("q_id").eqNullSafe(F.col("__q_id")), "left").select("q_id", "terms", "v", "bar")
    out = block_pairs(asking(barred), blocks.select("x")).mapInArrow(reaching, f"q_id {asked_as}, {key} {kind}, lexical double, vector double, score double, age double")
    with few_records(spark, 1):
        return cut(out.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r", "age"))


def _cosines(asked: _Asked, v: pa.ListArray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The vector score of each pair (row, column)."""
    out, of_q = np.zeros(len(row)), np.full(len(asked.sizes), -1)
    of_q[asked.whose] = np.arange(len(asked.whose))
    sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    has = np.flatnonzero((of_q[row] >= 0) & (sizes[column] > 0))
    if len(has):
        those, at = np.unique(column[has], return_inverse=True)
        xv, of = _vectors(v.take(pa.array(those)))
        starts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        n = (starts[1:] - starts[:-1])[at]
        place = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
        dots = np.einsum("ij,ij->i", np.repeat(asked.vectors[of_q[row[has]]], n, axis=0), xv[place])
        out[has] = np.round(np.maximum.reduceat(dots, np.cumsum(n) - n), 6)
    return out


def _asked_once(queries: DataFrame, group: Column) -> tuple[DataFrame, DataFrame]:
    """(queries, of those without a vector that ask the same in a group only one, all of them: q_id and whom each asks as).

    A q_id of several rows asks for itself: its rows share one list.
    """
    plain = queries.where("vector IS NULL").select("q_id", group.alias("__group"), "query")
    single = cut(plain.groupBy("q_id").agg(F.count("*").alias("__n"), F.first("__group").alias("__group"), F.first("query").alias("query")).where("__n = 1"))
    first = cut(single.groupBy("__group", "query").agg(F.min("q_id").alias("__as")))
    same = single.join(first.withColumnsRenamed({"__group": "__g", "query": "__query"}), F.col("__group").eqNullSafe(F.col("__g")) & F.col("query").eqNullSafe(F.col("__query"))).select("q_id", "__as")
    later = same.where("q_id <> __as").select(F.col("q_id").alias("__later"))
    return queries.join(later, F.col("vector").isNull() & (F.col("q_id") == F.col("__later")), "left_anti"), same


def _first_of_alike(rows: DataFrame, top: int) -> DataFrame:
    """rows without those that others of the same group, text and title come before: without a vector the first `top` of them by age and id suffice."""
    first = Window.partitionBy("in_group", "text", "title").orderBy(F.col("age").desc_nulls_first(), "id")
    plain = rows.where("v IS NULL").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= top).drop("__r")
    return cut(plain.unionByName(rows.where("v IS NOT NULL")))


def search_all(
    queries: DataFrame, items: DataFrame, vectors: DataFrame, *, key: str, text: str, mode: str = "hybrid", title: str | None = None, published: str | None = None,
    group: str | None = None, vector_key: str = "vec_id", vector: str = "embedding", top: int = 20, block_bytes: int = BLOCK_BYTES, alike: bool = False,
) -> DataFrame:
    """(q_id, key, lexical, vector, score): the `top` items of each of many queries (q_id, query, vector), by all their tokens.

    With a title, an item's lexical score is the greater of the share of tokens and the trigram similarity of title and
    query. published: a column of numbers, dates or times, by which the newest come first among equal scores (null before
    all), then by key. group: a column of queries and items; a query meets the items of its group only, as filters that a
    question states make it. An item without vectors, or a query without one, has vector score 0; of several vectors of an
    item the best counts.

    A mode that gives one of the two scores no weight ranks without it, and works it out for the rows found alone. Without
    lexical weight all items without vectors score 0 with every query, so only the first `top` of them by age and key, of
    each group, take part.

    alike: many queries ask the same, and many items have the same group, text and title. Without vectors they score the same,
    so such queries are asked once, and of such items only the first `top` by age and key are compared. No result changes.

    Queries and items are packed into blocks where they are, and pairs of blocks are scored in numpy; a task sends on the
    `top` of each query, and these are ranked over all tasks. No query passes the driver.
    """
    lexical_weight, vector_weight = WEIGHTS[mode]
    spark, kind = queries.sparkSession, items.schema[key].dataType.simpleString()
    hashed = lambda x: F.transform(x, lambda t: F.xxhash64(t))
    none, vectors_none = F.array().cast("array<bigint>"), F.array().cast("array<array<double>>")
    words = lambda x: hashed(F.array_distinct(tokens(x)))
    grams = lambda x: hashed(trigrams(F.lower(F.coalesce(x, F.lit(""))))) if title else none
    of_group = lambda df: (F.col(group) if group else F.lit(0)).alias("in_group")
    if alike:
        queries, same = _asked_once(queries, F.col(group) if group else F.lit(0))
    asked = queries.select("q_id", of_group(queries), words(F.col("query")).alias("terms"), grams(F.col("query")).alias("grams"),
                           F.when(F.col("vector").isNull(), vectors_none).otherwise(F.array(F.col("vector").cast("array<double>"))).alias("v"))
    own = vectors.groupBy(F.col(vector_key).alias("own")).agg(F.collect_list(F.col(vector).cast("array<double>")).alias("v"))
    if published is None:
        age = F.lit(0.0)
    elif items.schema[published].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        age = F.unix_micros(F.col(published).cast("timestamp")).cast("double")
    else:
        age = F.col(published).cast("double")
    rows = items.select(F.col(key).alias("id"), of_group(items), F.col(text).alias("text"), (F.col(title) if title else F.lit(None).cast("string")).alias("title"), age.alias("age"))
    rows = rows.join(own, F.col("id") == F.col("own"), "left").select("id", "in_group", "age", "text", "title", "v")
    rows = _first_of_alike(rows, top) if alike else rows
    grouped = group is not None
    if not lexical_weight:
        # A query without a vector scores 0 with all items: the first of them all are its own, and a group of its own.
        # Blocks hold less of a row than their bytes say, and each pair of blocks gives `top` rows for each query.
        block_bytes *= 4
        asked, grouped, has = asked.withColumn("in_group", F.struct("in_group", (F.size("v") == 0).alias("zero"))), True, F.size(F.coalesce("v", vectors_none)) > 0
        by_age = F.col("age").desc_nulls_first(), F.col("id")

        def firsts(some: DataFrame, mark: str) -> DataFrame:
            """The first `top` of some in each group; first within each partition, then of what these leave: no group passes one task."""
            few = some.withColumn("__r", F.row_number().over(Window.partitionBy("in_group", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy(*by_age))).where(F.col("__r") <= top)
            few = few.withColumn("__r", F.row_number().over(Window.partitionBy("in_group").orderBy(*by_age))).where(F.col("__r") <= top)
            return few.select(F.col("id").alias("__id"), F.col("in_group").alias("__group"), F.lit(mark).alias("mark"))

        bare = rows.select("in_group", "id", "age", has.alias("has"))
        marks = firsts(bare, "all").unionByName(firsts(bare.where("NOT has").drop("has"), "plain")).groupBy("__id", "__group").agg(F.collect_set("mark").alias("marks"))
        marked = rows.join(cut(marks), F.col("id").eqNullSafe(F.col("__id")) & F.col("in_group").eqNullSafe(F.col("__group")), "left").drop("__id", "__group")
        # Texts are copied, and split into tokens, after the others have gone.
        marked = cut(marked.withColumns({"has": has, "marks": F.coalesce("marks", F.array().cast("array<string>"))}).where("has OR size(marks) > 0"))
        own_or_zero = lambda zero: marked.where("array_contains(marks, 'all')" if zero else "has OR array_contains(marks, 'plain')").withColumn("in_group", F.struct("in_group", F.lit(zero).alias("zero")))
        rows = own_or_zero(False).unionByName(own_or_zero(True))
    rows = rows.select("id", "in_group", "age", words(F.col("text")).alias("terms"), (grams(F.col("title")) if title else none).alias("grams"), F.coalesce("v", vectors_none).alias("v"))
    if lexical_weight and title is None and group is None and not alike:
        return _by_bars(asked.select("q_id", "terms", "v"), rows.select("id", "age", "terms", "v"), key=key, kind=kind, weights=(lexical_weight, vector_weight), top=top, block_bytes=block_bytes)
    bytes_of = F.lit(64) + 8 * (F.size("terms") + F.size("grams") + F.aggregate("v", F.lit(0), lambda n, v: n + F.size(v)))
    within = ("in_group",) if grouped else ()
    left = cut(asked.withColumn("bytes", bytes_of))
    n = max(1, -(-(left.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    left, right = left.drop("bytes").repartition(n, "q_id"), rows
    if grouped:
        # Rows of a group side by side, a large group over many tasks.
        left, right = left.sortWithinPartitions("in_group"), rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "in_group", "id").sortWithinPartitions("in_group")

    def as_blocks(df: DataFrame, name: str) -> DataFrame:
        """The blocks of df; what has no weight lies beside them, in `<name>_rest`, and isn't read when pairs are scored."""
        found = numbered_blocks(packed(df, name, block_bytes=block_bytes, within=within), f"{name}_block")
        if grouped:
            found = found.withColumn(f"{name}_group", F.col(name)[0]["in_group"])
        if not lexical_weight:
            pick = lambda columns: F.transform(name, lambda r: F.struct(*[r[c].alias(c) for c in columns]))
            found = found.withColumns({f"{name}_rest": pick(["terms", "grams"]), name: pick([c for c in df.columns if c not in ("terms", "grams")])})
        with few_records(spark, BLOCK_ROWS):
            return cut(found)

    blocks = [as_blocks(df, name) for df, name in ((left, "q"), (right, "x"))]
    if grouped:
        # A large group's pairs are dealt over many tasks by the items' block, and its queries go to each of them. They go
        # there by a shuffle: the copies of a small table may be large, and a broadcast of them passes the driver.
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked_of = blocks[1].withColumn("salt", F.pmod(F.xxhash64("x_block"), F.lit(salts)).cast("int"))
        has = asked_of.groupBy(F.col("x_group").alias("of_group")).agg(F.collect_set("salt").alias("salts"))
        asking = blocks[0].join(has, F.col("q_group").eqNullSafe(F.col("of_group"))).select("q", "q_block", "q_group", F.explode("salts").alias("salt"))
        pairs = asking.hint("merge").join(asked_of, F.col("q_group").eqNullSafe(F.col("x_group")) & (asking["salt"] == asked_of["salt"])).select("q", "q_block", "x", "x_block")
    else:
        pairs = block_pairs(*blocks)

    def best(batches):
        known = {}
        for batch in batches:
            for i in range(batch.num_rows):
                q, x, number = rows_of(batch, "q", i), rows_of(batch, "x", i), batch.column(batch.schema.get_field_index("q_block"))[i].as_py()
                if number not in known:
                    known.clear()
                    known[number] = *((_Sets(q.field("terms")), _Sets(q.field("grams"))) if lexical_weight else (None, None)), *_vectors(q.field("v"))
                terms, titles, qv, whose = known[number]
                lexical, near = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
                if lexical_weight:
                    shared, _ = terms.shared(x.field("terms"))
                    lexical = shared / np.maximum(terms.sizes, 1)[:, None]
                    if title:
                        both, sizes = titles.shared(x.field("grams"))
                        lexical = np.maximum(lexical, both / np.maximum(titles.sizes[:, None] + sizes - both, 1))
                    lexical = _half_up(lexical, 6)
                xv, of = _vectors(x.field("v")) if vector_weight and len(qv) else (qv, whose)
                if vector_weight and len(qv) and len(xv):
                    # The best of an item's vectors: rows of one item are side by side.
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    near[np.ix_(whose, of[starts])] = np.round(np.maximum.reduceat(qv @ xv.T, starts, axis=1), 6)
                score = np.round(lexical * lexical_weight + near * vector_weight, 8)
                keys, ages = x.field("id"), x.field("age").to_numpy(zero_copy_only=False)
                order = pc.sort_indices(pa.table({"a": pc.is_valid(x.field("age")), "b": x.field("age"), "c": keys}), [("a", "ascending"), ("b", "descending"), ("c", "ascending")]).to_numpy()
                row, column = first_of_each(-score, order, top)
                columns = [q.field("q_id").take(pa.array(row)), keys.take(pa.array(column)), *[pa.array(m[row, column]) for m in (lexical, near, score)], pa.array(ages[column], from_pandas=True)]
                places = [pa.array(np.full(len(row), number)), pa.array(row.astype(np.int64)), pa.array(np.full(len(row), batch.column(batch.schema.get_field_index("x_block"))[i].as_py())), pa.array(column.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns + places, names=["q_id", key, "lexical", "vector", "score", "age", "qb", "qi", "xb", "xi"])

    out = pairs.mapInArrow(best, f"q_id {queries.schema['q_id'].dataType.simpleString()}, {key} {kind}, lexical double, vector double, score double, age double, qb long, qi long, xb long, xi long")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("age").desc_nulls_first(), key))
    with few_records(spark):
        found = cut(out.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r", "age"))
    if alike:
        by = same.withColumnsRenamed({"q_id": "__q_id"})
        found = found.join(by, F.col("q_id") == F.col("__as"), "left").withColumn("q_id", F.coalesce("__q_id", "q_id")).drop("__q_id", "__as")
    if lexical_weight and vector_weight:
        return found.drop("qb", "qi", "xb", "xi")
    # What has no weight is worked out for the rows found; a row is known by its block and its place there.
    place = lambda df, n: df.select(F.col(f"{n}_block").alias(f"{n}b"), F.posexplode(n if lexical_weight else f"{n}_rest").alias(f"{n}i", f"{n}r")).select(f"{n}b", F.col(f"{n}i").cast("long").alias(f"{n}i"), *[F.col(f"{n}r.{c}").alias(f"{n}_{c}") for c in (("v",) if lexical_weight else ("terms", "grams"))])
    both = found.join(place(blocks[0], "q"), ["qb", "qi"]).join(place(blocks[1], "x"), ["xb", "xi"])
    if vector_weight:
        share = F.size(F.array_intersect("q_terms", "x_terms")) / F.greatest(F.size("q_terms"), F.lit(1))
        other = {"lexical": F.round(F.greatest(share, jaccard(F.col("q_grams"), F.col("x_grams"))) if title else share, 6)}
    else:
        cosine = F.array_max(F.transform("x_v", lambda v: F.coalesce(F.lit(1.0) - cosine_distance(v, F.col("q_v")[0]), F.lit(0.0))))
        other = {"vector": F.round(F.when(F.size("q_v") > 0, F.coalesce(cosine, F.lit(0.0))).otherwise(0.0), 6)}
    return both.withColumns(other).select("q_id", key, "lexical", "vector", "score")
