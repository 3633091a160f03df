"""Near-duplicates by the Jaccard coefficient of word shingles, without loss.

Sets. A-Z are lower-cased; words are as in `simhash`; a document's set holds the 64-bit hashes of its distinct shingles of
`shingle` words (fewer words: the whole sequence; none: the empty set). Equal sets are one node. Nodes link if their
Jaccard coefficient is `at_least` or more, and a component is what links connect.

SimHash first. A node has a fingerprint of its shingles (see `simhash`), and the distinct fingerprints are linked by equal
pairs of quarters and the table of pivot distances. Of each linked pair, and of the nodes of one fingerprint, a node is
compared with the least one by whole sets; what this connects is known, and isn't compared again.

Candidates. Copies further apart than the fingerprints' bound come from postings. Under any fixed order of the shingles, two sets of that coefficient share `MATCHES` among the first
n - ceil(at_least * n) + MATCHES of either (or as many as the smaller must share); only those are posted. The order puts
shingles last that recur in a sample of one in `SAMPLE` documents, so that common passages are hardly ever posted. The
sample, and the bound `COMMON` on the table that is broadcast, only choose the order: no pair depends on them.

Tallies. A node carries how many of its shingles fall into each of `TALLY` classes of hashes. The sum of two tallies'
differences is at most the number of shingles that only one of the sets has, and a pair of the coefficient t has at most
(1 - t) / (1 + t) * (na + nb) of these: a pair over that is discarded before any whole set is moved. No link is lost.

Verification. A pair that shares so many, whose sizes and tallies allow it, is compared by its whole sets. Postings of up
to `BUCKET` nodes give all their pairs; their count decides where a pair has no larger posting in common. Those of more
give pairs with `CENTRES` of their nodes first; what is then in one component isn't compared again, and all other pairs
follow in a second round, in blocks dealt over the tasks, each at the first large posting that it shares.

Positions. In that round a node stays in a large posting only if it can still share enough from there on: n - at, `at`
the shingle's place in the order, and one more for each of up to MATCHES - 1 small postings before it. A pair needs
t / (1 + t) * (na + nb), so t * n of either node and 2t / (1 + t) * n of the smaller: a posting whose nodes have more
shingles of their own before it than links allow forms no pair at all, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import scan
from palimpsest.llm.common import SPACES, col, cut, small_batches, text_hash
from palimpsest.llm.routing import NO_ID, numbered, only_in
from palimpsest.llm.simhash import components, fingerprints, keep_least, links as near_prints

SHINGLE, AT_LEAST, BUCKET, CENTRES, BLOCK = 5, 0.8, 16, 4, 256
SAMPLE, COMMON, MATCHES, TALLY = 16, 1 << 19, 4, 128


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles in rising order, one text after another, and each text's bounds."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, bounds in scan.blocks(texts):
        data = scan.lower_table()[data]
        words = scan.Words(data, bounds, scan.class_table(SPACES, False))
        size = np.minimum(words.counts, shingle)
        n = np.where(words.counts > 0, words.counts - size + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        first = words.bounds[:-1][owner] + np.arange(n.sum()) - (np.cumsum(n) - n)[owner]
        h = scan.Rolling(words.hashes()).of(first, first + size[owner])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
        parts.append(h[new])
        counts.append(np.bincount(owner[new], minlength=len(n)))
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)


def _nodes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.r_[np.uint64(0), np.cumsum(scan.mix(h + np.uint64(1)), dtype=np.uint64)]
    return scan.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _tallies(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """How many of each set's shingles have each value of seven bits of the hash."""
    size = len(bounds) - 1
    at = np.repeat(np.arange(size), np.diff(bounds)) * TALLY + (h >> np.uint64(32) & np.uint64(TALLY - 1)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=size * TALLY), 32767).astype(np.int16)
    return scan.as_list(pa.array(counts), np.full(size, TALLY))


def _lists(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    return scan.as_list(pa.array(h.view(np.int64)), counts)


def _common(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the documents, in rising order, and how often they do."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column(0), shingle)[0].view(np.int64))], names=["h"])

    sample = docs.select(col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.col("n").desc(), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _posted(docs: DataFrame, text: str, doc_id: str, shingle: int, at_least: float) -> DataFrame:
    """(doc_id, __th, node, fp, n, tally, posted) of each row; fp is the fingerprint."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text, shingle))

    def run(batches):
        known, often = common.value
        for whole in batches:
            for batch in small_batches(whole, "text"):
                h, bounds = shingle_sets(batch.column(2), shingle)
                n = np.diff(bounds)
                weight = np.zeros(len(h), np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    weight = np.where(known[near] == h, often[near], 0)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, weight, owner))
                size = np.minimum(n, n - np.ceil(at_least * n - 1e-9).astype(np.int64) + MATCHES)
                place = np.arange(len(h)) - bounds[:-1][owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(_nodes(h, bounds)), pa.array(fingerprints(batch.column(2), shingle).view(np.int64)), pa.array(n), _tallies(h, bounds),
                     _lists(h[order][place < size[owner]], size)],
                    names=["doc_id", "__th", "node", "fp", "n", "tally", "posted"])

    light = docs.select(col(doc_id).alias("doc_id"), text_hash(text).alias("__th"), col(text).alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    posted = cut(light.mapInArrow(run, f"doc_id {kind}, __th long, node long, fp long, n long, tally array<smallint>, posted array<long>"))
    common.destroy()
    return posted


def _whole_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(node, whole) of the documents (id, th) in `wanted`, and of a few others."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                h, bounds = shingle_sets(batch.column(0), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, bounds)), _lists(h, np.diff(bounds))], names=["node", "whole"])

    inside = only_in(numbered(docs, text, doc_id), wanted)
    return inside.select("text").mapInArrow(run, "node long, whole array<long>").groupBy("node").agg(F.first("whole").alias("whole"))


def _verified(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose sets have the coefficient."""
    left = sets.select(F.col("node").alias("a"), F.col("whole").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("whole").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= at_least * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _fits(at_least: float):
    return (F.col("na") >= at_least * F.col("nb") - 1e-9) & (F.col("nb") >= at_least * F.col("na") - 1e-9)


def _alike(at_least: float):
    """Whether the tallies s and t of sets of na and nb shingles allow the coefficient."""
    apart = F.aggregate(F.zip_with("s", "t", lambda s, t: F.abs(s - t)), F.lit(0), lambda total, x: total + x)
    return apart * F.lit(1 + at_least) <= F.lit(1 - at_least) * (F.col("na") + F.col("nb")) + 1e-6


def _ends():
    return F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")


def _first_pairs(postings: DataFrame, at_least: float) -> DataFrame:
    """(a, b) to compare first. postings: (h, node, n, at, m, place), m a posting's nodes."""
    left = postings.where((F.col("m") <= BUCKET) | (F.col("place") <= CENTRES)).select("h", F.col("node").alias("x"), F.col("n").alias("na"), F.col("place").alias("px"))
    right = postings.select("h", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("place").alias("py"), "m")
    least = F.least(F.lit(MATCHES), F.ceil(at_least * F.greatest("na", "nb") - 1e-9)).alias("least")
    pairs = left.join(right, "h").where((F.col("px") < F.col("py")) & _fits(at_least)).select(*_ends(), least, "m")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("least").alias("least"), F.max("m").alias("m"))
    return counted.where((F.col("shared") >= F.col("least")) | (F.col("m") > BUCKET)).select("a", "b")


def _with_like_tallies(pairs: DataFrame, tallies: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose tallies (node, n, tally) allow the coefficient."""
    left = tallies.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tally").alias("s"))
    right = tallies.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tally").alias("t"))
    return pairs.join(left, "a").join(right, "b").where(_alike(at_least)).select("a", "b")


def _reaching(rest: DataFrame, postings: DataFrame, at_least: float) -> DataFrame:
    """rest (h, node, n, at, root) with `most`, which a pair that shares nothing large before h can share: where that may do."""
    small = only_in(postings.where(F.col("m") <= BUCKET).select("node", "at"), rest.select("node"), "node")
    early = small.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("at")), 1, MATCHES - 1).alias("early"))
    before = F.when(F.col("early").isNotNull(), F.size(F.filter("early", lambda e: e < F.col("at")))).otherwise(0)
    most = F.col("n") - F.col("at") + before
    return rest.join(early, "node", "left").withColumn("most", most).drop("early").where(F.col("most") >= at_least * F.col("n") - 1e-6)


def _across(postings: DataFrame, found: DataFrame, tallies: DataFrame, at_least: float) -> DataFrame:
    """(a, b) that share a large posting, that are in different components (node, root) of `found`, and whose tallies are alike."""
    found = found.select(F.col("node").alias("linked"), "root")
    large = postings.where(F.col("m") > BUCKET)
    rooted = large.join(found, large["node"] == found["linked"], "left").select("h", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    every = Window.partitionBy("h")
    mixed = F.min("root").over(every) != F.max("root").over(every)
    reach = _reaching(cut(rooted.withColumn("mixed", mixed).where("mixed").drop("mixed")), postings, at_least)
    leads = F.col("most") * F.lit(1 + at_least) >= F.lit(2 * at_least) * F.col("n") - 1e-6
    led = F.max("leads").over(every)
    rest = reach.withColumn("leads", leads).withColumn("led", led).where("led").drop("led")
    rest = cut(rest.withColumn("place", F.row_number().over(every.orderBy("n", "node"))).withColumn("block", F.floor((F.col("place") - 1) / BLOCK)))
    own = rest.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "h")))["h"].alias("own")).join(tallies.select("node", "tally"), "node")
    rest = cut(rest.join(own, "node"))
    # Each row goes once to each block of its posting at or before its own, so that a task joins BLOCK rows to a row at most.
    left = rest.where("leads").select(
        "h", "block", F.col("node").alias("x"), F.col("n").alias("na"), F.col("root").alias("rx"), F.col("place").alias("px"), F.col("most").alias("mx"),
        F.col("tally").alias("s"), F.col("own").alias("ox"))
    right = rest.select(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("block"), F.col("node").alias("y"), F.col("n").alias("nb"),
        F.col("root").alias("ry"), F.col("place").alias("py"), F.col("most").alias("my"), F.col("tally").alias("t"), F.col("own").alias("oy"))
    enough = F.least("mx", "my") * F.lit(1 + at_least) >= F.lit(at_least) * (F.col("na") + F.col("nb")) - 1e-6
    apart = (F.col("px") < F.col("py")) & (F.col("rx") != F.col("ry")) & _fits(at_least) & enough
    here = F.filter("ox", lambda h: F.array_contains("oy", h))[0] == F.col("h")
    return left.join(right, ["h", "block"]).where(apart & here & _alike(at_least)).select(*_ends())


def _print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs to compare of the nodes (node, fp) whose fingerprints link, one pair for each node or link at most."""
    prints = cut(prints)
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")))
    same = prints.join(least, "fp").where("least < node").select(F.col("least").alias("x"), F.col("node").alias("y"))
    first = lambda x: least.select(F.col("fp").alias(f"fp{x}"), F.col("least").alias(x))
    linked = cut(near_prints(least.select("fp"))).withColumnsRenamed({"a": "fpx", "b": "fpy"})
    return same.unionByName(linked.join(first("x"), "fpx").join(first("y"), "fpy").select("x", "y")).select(*_ends())


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one component (node, root) of `found`."""
    root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"root{x}"))
    known = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return known.where("roota IS NULL OR rootb IS NULL OR roota <> rootb").select("a", "b")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) of `found` and more links (a, b)."""
    return components(found.where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links))


def similar_documents(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, at_least: float = AT_LEAST
) -> DataFrame:
    """(doc_id, __th, component) for each row of docs; __th tells texts of an id apart."""
    printed = _posted(docs, text, doc_id, shingle, at_least)
    nodes = printed.groupBy("node").agg(F.first("n").alias("n"), F.first("posted").alias("posted"), F.min("fp").alias("fp"))
    every = Window.partitionBy("h")
    # n and the place in the order travel as one number: this is the shuffle of all postings.
    posted = nodes.select("node", "n", F.posexplode("posted").alias("at", "h")).select("node", (F.col("n") * F.lit(1 << 32) + F.col("at")).alias("sized"), "h")
    counted = posted.withColumn("m", F.count("*").over(every)).where("m > 1")
    placed = counted.withColumn("place", F.row_number().over(every.orderBy(F.xxhash64("node"), "node")))
    postings = cut(placed.select("h", "node", F.shiftright("sized", 32).alias("n"), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), "m", "place"))
    tallies = cut(printed.join(postings.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("tally").alias("tally")))
    owners = printed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__th")).alias("owner"))

    def verified(pairs: DataFrame) -> DataFrame:
        compared = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = owners.join(compared, "node", "left_semi").select(
            F.coalesce(F.col("owner.doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("owner.__th", F.lit(0)).alias("th"))
        sets = cut(_whole_sets(docs, wanted, text, doc_id, shingle).join(compared, "node", "left_semi"))
        return cut(_verified(pairs, sets, at_least))

    prints = nodes.where("n > 0").select("node", "fp")
    found = components(verified(cut(_with_like_tallies(_print_pairs(prints), tallies, at_least))))
    found = _joined(found, verified(_apart(cut(_with_like_tallies(_first_pairs(postings, at_least), tallies, at_least)), found)))
    if not postings.where(F.col("m") > BUCKET).isEmpty():
        more = cut(_across(postings, found, tallies, at_least))
        if not more.isEmpty():
            found = _joined(found, verified(more))
    found = found.withColumnRenamed("node", "at")
    return printed.join(found, printed["node"] == found["at"], "left").select("doc_id", "__th", F.coalesce("root", "node").alias("component"))


def drop_similar(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay: of each component the document of least id, once."""
    return keep_least(docs, similar_documents(docs, text=text, doc_id=doc_id, **options), text=text, doc_id=doc_id)
