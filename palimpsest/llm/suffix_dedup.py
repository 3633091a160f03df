"""Suffix-array deduplication: repeated byte strings from a collection's Burrows-Wheeler transform and common prefixes.

Texts are UTF-8 bytes. Each byte goes that is covered by a string of `n` bytes which also starts anywhere else, in the
same document too; overlaps count, and strings are judged on the input, not on what is left.

1. Candidates. A string's phrase is its `k`-gram of least hash, the leftmost of equals: equal strings share it, at equal
   distance. Only phrases that occur twice can lie in a repeat.
2. Segments. An occurrence of such a phrase, with the bytes around it that its strings reach, is a segment: up to n - k
   bytes, the phrase as one marker, up to n - k bytes. Equal segments are counted and inserted once.
3. Construction. Segments are dealt by phrase, so all occurrences of a string meet. A phrase of more than `CROWD` segments
   is dealt over many tasks, twice: a string has half of n - k bytes before its phrase or as many behind it, so once by
   the bytes right before the phrase, for the former strings, and once by those right behind it, for the latter. Each
   task builds the transform and the common prefixes of its segments column by column (module bwt), through files, in
   collections of about `SYMBOLS` bytes of whole groups. A string is repeated if the suffix that starts with it shares
   n - k + 1 symbols (the marker stands for k bytes) with a neighbour, or if its segment was counted twice.
4. Crowds. What is dealt so may still be a group of more than `CROWD` segments: a passage that very many texts share. Its
   strings are counted by their hashes, pre-aggregated, and the two segments of least and greatest run stand for all that
   hold a string. Only these two come to a transform, as a group of their own; a string that it finds repeated is marked
   in every segment that has it. So no group that a task builds holds more than `CROWD` segments.
5. Marking. Repeated strings go back to the shards of the documents that hold them.

Copies of a text are settled by the text's hash: all lose every byte if they have `n`.
Cases. Ids are whole numbers, else a ValueError. A null or empty text has no bytes; a text of under n bytes is kept whole; repeated rows are copies of each other;
a removed span may end within a character, so what is left is bytes; ids, also null ones, don't matter to the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import scan
from palimpsest.llm.bwt import Collection
from palimpsest.llm.common import cut, small_batches
from palimpsest.llm.routing import NO_ID, copies, in_slots, marked, maybe_in, numbered, shard, shard_count, slot

N, K, CROWD, SYMBOLS, SALTS = 400, 300, 256, 1 << 22, 16
_SCHEMA = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_OUT = "id long, th long, n_bytes long, n_removed long, n_spans long, kept binary"


def _anchors(data: np.ndarray, bounds: np.ndarray, n: int, k: int) -> scan.Anchors:
    return scan.Anchors(scan.Rolling(scan.byte_values(0)[data]), bounds, n, k)


def _run_hashes(data: np.ndarray, found: scan.Anchors, n: int) -> np.ndarray:
    """Of each run's bytes and of the phrase's place in them, by another base than the phrase's."""
    roll = scan.Rolling(scan.byte_values(1)[data], 1)
    place = (found.at - found.first).astype(np.uint64)
    return scan.mix(roll.of(found.first, found.last + n) + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def phrases(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(id, th, phrase, times) of each document's phrases."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for a, _, data, bounds in scan.blocks(batch.column(2)):
                    found = _anchors(data, bounds, n, k)
                    if not len(found):
                        continue
                    order = np.lexsort((found.phrase, found.owner))
                    p, o = found.phrase[order], found.owner[order]
                    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (o[1:] != o[:-1])])
                    times = np.diff(np.r_[new, len(p)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + o[new]]), pa.array(ths[a + o[new]]), _signed(p[new]), pa.array(times.astype(np.int32))],
                        names=["id", "th", "phrase", "times"])

    return rows.select("id", "th", "text").mapInArrow(run, "id long, th long, phrase long, times int")


def _each_block(docs: pa.Table):
    """(first row, ids, hashes, bytes, bounds) of a shard's documents."""
    ids, ths = _longs(docs, "id"), _longs(docs, "th")
    at = 0
    for chunk in docs.column("text").chunks:
        for a, b, data, bounds in scan.blocks(chunk):
            yield ids[at + a : at + b], ths[at + a : at + b], data, bounds
        at += len(chunk)


def _counter(n: int, k: int):
    """For a shard's documents and candidate phrases: (shard, phrase, run, times) of distinct runs."""

    def run(key, docs, facts):
        wanted = np.unique(_longs(facts, "phrase").view(np.uint64)[_longs(facts, "kind") == 0])
        # Rows of a copied text other than the one of least id aren't counted: their marks need no partner.
        skip = {(a, b) for a, b, c in zip(_longs(facts, "phrase").tolist(), _longs(facts, "th").tolist(), _longs(facts, "kind").tolist()) if c == 1}
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for ids, ths, data, bounds in _each_block(docs) if len(wanted) else ():
            found = _anchors(data, bounds, n, k)
            found = found.keep(np.isin(found.phrase, wanted))
            if skip:
                later = np.array([(i, t) in skip for i, t in zip(ids.tolist(), ths.tolist())], bool)
                found = found.keep(~later[found.owner])
            parts.append((found.phrase, _run_hashes(data, found, n)))
        p, r = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((r, p))
        p, r = p[order], r[order]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])][: len(p)])
        times = np.diff(np.r_[new, len(p)])
        return pa.table([pa.array(np.full(len(new), key[0].as_py()), pa.int32()), _signed(p[new]), _signed(r[new]), pa.array(times)], names=["shard", "phrase", "run", "times"])

    return run


def _cutter(n: int, k: int):
    """For a shard's documents and the runs it provides: (phrase, run, many, left, right) with the bytes of each."""

    def run(key, docs, facts):
        many = dict(zip(zip(_longs(facts, "phrase").view(np.uint64).tolist(), _longs(facts, "run").view(np.uint64).tolist()), facts.column("many").to_pylist()))
        wanted = np.unique(_longs(facts, "phrase").view(np.uint64))
        out = []
        for _, _, data, bounds in _each_block(docs) if many else ():
            found = _anchors(data, bounds, n, k)
            found = found.keep(np.isin(found.phrase, wanted))
            for p, r, q, s, e in zip(found.phrase.tolist(), _run_hashes(data, found, n).tolist(), found.at.tolist(), found.first.tolist(), found.last.tolist()):
                if (m := many.pop((p, r), None)) is not None:
                    out.append((p, r, m, data[s:q].tobytes(), data[q + k : e + n].tobytes()))
        p, r, m, left, right = zip(*out) if out else ((),) * 5
        return pa.table([
            _signed(np.array(p, np.uint64)), _signed(np.array(r, np.uint64)), pa.array(m, pa.bool_()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
            names=["phrase", "run", "many", "left", "right"])

    return run


def _judge(n: int, k: int):
    """For a shard's segments: (phrase, run, first, last) stretches of repeated strings, by their start within the run."""

    def run(key, table):
        phrase, runs, group, side = (_longs(table, c) for c in ("phrase", "run", "group", "side"))
        many = table.column("many").to_numpy()
        left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
        sizes = np.array([len(x) for x in left], np.int64)
        strings = sizes + np.array([len(x) for x in right], np.int64) - (n - k) + 1
        # A segment that was counted twice repeats whole; one whose strings' hashes are all its own can't repeat.
        live = np.zeros(len(left), bool)
        live[_recurring(left, right, group, strings, n - k)] = True
        s, at = [np.repeat(np.flatnonzero(many), strings[many])], [scan.spread(np.zeros(many.sum(), np.int64), strings[many] - 1)[0]]
        chosen = np.flatnonzero(live)
        chosen = chosen[np.argsort(group[chosen], kind="stable")]
        for some in _collections(chosen, group, strings + 2 * (n - k)):
            if not many[some].all():
                built = Collection([left[i] for i in some], [right[i] for i in some], np.unique(group[some], return_inverse=True)[1])
                found, back = built.repeated(n - k + 1)
                found, back = some[found], back
                fresh = ~many[found]
                s.append(found[fresh])
                at.append((sizes[found] - back)[fresh])
        s, at = np.concatenate(s), np.concatenate(at)
        # What is dealt twice decides on half of its strings each time.
        before = sizes[s] - at >= (n - k) // 2
        mine = (side[s] == 0) | ((side[s] == 1) == before)
        s, at = s[mine], at[mine]
        order = np.lexsort((at, s))
        s, at = s[order], at[order]
        turn = np.r_[True, (np.diff(s) != 0) | (np.diff(at) != 1)][: len(s)]
        first = np.flatnonzero(turn)
        last = np.r_[first[1:], len(s)][: len(first)] - 1
        return pa.table([pa.array(phrase[s[first]]), pa.array(runs[s[first]]), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], names=["phrase", "run", "first", "last"])

    return run


def _collections(chosen: np.ndarray, group: np.ndarray, sizes: np.ndarray):
    """Parts of chosen, in order of their groups, of about SYMBOLS bytes: whole groups, one at least."""
    turn = np.flatnonzero(np.r_[True, np.diff(group[chosen]) != 0][: len(chosen)])
    total = np.r_[0, np.cumsum(sizes[chosen])]
    at = 0
    while at < len(chosen):
        ends = np.r_[turn[turn > at], len(chosen)]
        fits = ends[total[ends] - total[at] <= SYMBOLS]
        end = int(fits[-1] if len(fits) else ends[0])
        yield chosen[at:end]
        at = end


def _string_hashes(left, right, group, strings, side):
    """(place within its segment, segment, hash) of every string; the hash is of the group and of the bytes beside the phrase."""
    joined = b"".join(x + b"\xff" + y for x, y in zip(left, right))
    data = np.frombuffer(joined, np.uint8)
    begin = np.cumsum([0] + [len(x) + len(y) + 1 for x, y in zip(left, right)])[:-1].astype(np.int64)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, seg = scan.spread(begin, begin + strings - 1)
    h = scan.Rolling(scan.byte_values(0)[data]).of(starts, starts + side + 1) + scan.mix(group.view(np.uint64))[seg]
    return starts - begin[seg], seg, h


def _recurring(left, right, group, strings, side):
    """Segments with a string whose hash another string of the same group has."""
    _, seg, h = _string_hashes(left, right, group, strings, side)
    _, where, times = np.unique(h, return_inverse=True, return_counts=True)
    return seg[times[where] > 1]


def _strings(crowds: DataFrame, n: int, k: int) -> DataFrame:
    """(group, key, phrase, run, at) of the strings that each dealt segment decides on; key is a hash of the string."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "left", 1 << 18):
                left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
                phrase, runs, group, side = (batch.column(c).to_numpy().astype(np.int64) for c in ("phrase", "run", "group", "side"))
                sizes = np.array([len(x) for x in left], np.int64)
                strings = sizes + np.array([len(x) for x in right], np.int64) - (n - k) + 1
                at, seg, h = _string_hashes(left, right, group, strings, n - k)
                mine = (side[seg] == 1) == (sizes[seg] - at >= (n - k) // 2)
                at, seg, h = at[mine], seg[mine], scan.mix(h[mine])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[seg]), _signed(h), pa.array(phrase[seg]), pa.array(runs[seg]), pa.array(at.astype(np.int32))],
                    names=["group", "key", "phrase", "run", "at"])

    columns = crowds.select("phrase", "run", "left", "right", "side", "group")
    return columns.mapInArrow(run, "group long, key long, phrase long, run long, at int")


def _remover(n: int, k: int):
    """For a shard's documents, the repeated stretches of its runs (kind 0) and its copies (kind 1): the result rows."""

    def run(key, docs, facts):
        kind = _longs(facts, "kind")
        p, r = _longs(facts, "phrase"), _longs(facts, "run")
        copy = set(zip(p[kind == 1].tolist(), r[kind == 1].tolist()))
        sure = kind == 0
        p, r = p[sure].view(np.uint64), r[sure].view(np.uint64)
        first, last = _longs(facts, "first")[sure], _longs(facts, "last")[sure]
        order = np.lexsort((p, r))
        p, r, first, last = p[order], r[order], first[order], last[order]
        out = []
        for ids, ths, data, bounds in _each_block(docs):
            gone = np.zeros(len(data), bool)
            if len(p):
                found = _anchors(data, bounds, n, k)
                found = found.keep(np.isin(found.phrase, p))
                h = _run_hashes(data, found, n)
                low, high = np.searchsorted(r, h, "left"), np.searchsorted(r, h, "right") - 1
                has = np.flatnonzero(high >= low)
                row, pair = scan.spread(low[has], high[has])
                run_ = has[pair]
                fits = p[row] == found.phrase[run_]
                row, run_ = row[fits], run_[fits]
                starts, _ = scan.spread(found.first[run_] + first[row], found.first[run_] + last[row])
                gone = scan.covered(starts, n, len(data))
            size = np.diff(bounds)
            whole = np.array([(i, t) in copy for i, t in zip(ids.tolist(), ths.tolist())], bool) & (size >= n)
            gone |= np.repeat(whole, size)
            out.append(_result(ids, ths, data, bounds, gone))
        return pa.Table.from_batches(out, schema=_SCHEMA) if out else _SCHEMA.empty_table()

    return run


def _result(ids, ths, data, bounds, gone) -> pa.RecordBatch:
    place = np.r_[0, np.cumsum(~gone)]
    before = np.r_[False, gone[:-1]] if len(gone) else gone
    if len(gone):
        before[bounds[:-1][bounds[:-1] < len(gone)]] = False
    return pa.RecordBatch.from_arrays([
        pa.array(ids), pa.array(ths), pa.array(np.diff(bounds)), pa.array(scan.sums(gone, bounds)), pa.array(scan.sums(gone & ~before, bounds)),
        scan.string_array(data[~gone], place[bounds], pa.binary())], schema=_SCHEMA)


def _untouched(rows: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                for a, b, data, bounds in scan.blocks(batch.column(2)):
                    yield _result(batch.column(0).to_numpy()[a:b], batch.column(1).to_numpy()[a:b], data, bounds, np.zeros(len(data), bool))

    return rows.select("id", "th", "text").mapInArrow(run, _OUT)


def _dealt(segments: DataFrame, crowded: DataFrame, half: int, side: int) -> DataFrame:
    """segments with group and side: 0 for the phrase's own group, 1 and 2 for the bytes before and behind a crowded phrase."""
    found, hit = marked(segments, crowded, slot("phrase"))
    deal = lambda at, group: F.struct(F.lit(at).alias("side"), group.alias("group"))
    before = F.when(F.octet_length("left") >= half, deal(1, F.xxhash64(F.lit(1), "phrase", F.substring("left", -half, half))))
    behind = F.when(F.octet_length("right") > side - half, deal(2, F.xxhash64(F.lit(2), "phrase", F.substring("right", 1, side - half))))
    ways = F.when(hit, F.array_compact(F.array(before, behind))).otherwise(F.array(deal(0, F.col("phrase"))))
    return found.select(*segments.columns, F.explode(ways).alias("way")).select(*segments.columns, "way.side", "way.group")


def _in_crowds(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dealt segments of groups that a task can build, those of groups over `CROWD`); a group is whole in one of them."""
    crowds = dealt.where("side > 0").groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("group")
    found, hit = marked(dealt, crowds, slot("group"))
    crowded = hit & (F.col("side") > 0)
    return found.where(~crowded).select(*dealt.columns), found.where(crowded).select(*dealt.columns)


def _stand_ins(strings: DataFrame) -> DataFrame:
    """(group, key, phrase, run, at, other) of strings that two segments have: the least run, the place in it, the greatest."""
    ends = strings.groupBy("group", "key").agg(F.min(F.struct("run", "at", "phrase")).alias("a"), F.max("run").alias("other"))
    return ends.where("a.run <> other").select("group", "key", "a.phrase", "a.run", "a.at", "other")


def _pairs(twins: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments of each two runs that stand for others, as a group of two."""
    both = twins.select("phrase", "run", "other").distinct().withColumn("group", F.xxhash64("phrase", "run", "other"))
    members = both.select("phrase", "group", F.explode(F.array("run", "other")).alias("run"))
    return members.join(segments, ["phrase", "run"]).select("phrase", "run", F.lit(False).alias("many"), "left", "right", F.lit(0).alias("side"), "group")


def _crowd_stretches(crowds: DataFrame, segments: DataFrame, judged, n: int, k: int) -> DataFrame:
    """(phrase, run, first, last) stretches of repeated strings of the dealt segments in crowds."""
    strings = cut(_strings(crowds, n, k))
    twins = cut(_stand_ins(strings))
    found = judged(_pairs(twins, segments)).select("phrase", "run", F.explode(F.sequence("first", "last")).alias("at")).distinct()
    # A string that very many segments have is one key: its rows are dealt over `SALTS` tasks.
    sure = twins.join(found, ["phrase", "run", "at"]).select("group", "key", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salted = strings.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)).cast("int"))
    hits = salted.join(sure, ["group", "key", "salt"]).select("phrase", "run", "at")
    island = F.col("at") - F.row_number().over(Window.partitionBy("phrase", "run").orderBy("at"))
    turns = hits.withColumn("island", island).groupBy("phrase", "run", "island").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    size = F.octet_length("left") + F.octet_length("right") - F.lit(n - k)
    whole = crowds.where("many").select("phrase", "run", F.lit(0).alias("first"), size.alias("last")).distinct()
    return turns.select("phrase", "run", "first", "last").unionByName(whole)


def remove_repeated_strings(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs."""
    if not 0 < k < n:
        raise ValueError("k has to be shorter than n")
    rows = numbered(docs, text, doc_id)
    same, size = copies(rows)
    shards = shard_count(docs.sparkSession, size)
    copied, later = same.select("id", "th"), same.where("id > least").select("id", "th")
    every = cut(phrases(rows, n, k))
    recurring = cut(every.groupBy("phrase").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.max("times").alias("t")).where("a <> b OR t > 1").select("phrase"))
    candidates = cut(maybe_in(every, recurring, "phrase").join(recurring, "phrase").join(later, ["id", "th"], "left_anti").select("id", "th", "phrase"))
    inside, outside = in_slots(rows, candidates.select("id", "th").union(copied), shards)
    docs_in = inside.groupBy("shard")
    zero = F.lit(0).cast("long")
    wanted = candidates.select(shard(shards).alias("shard"), "phrase", zero.alias("th"), F.lit(0).alias("kind")).distinct()
    skipped = later.select(shard(shards).alias("shard"), F.col("id").alias("phrase"), "th", F.lit(1).alias("kind"))
    counted = cut(docs_in.cogroup(wanted.unionByName(skipped).groupBy("shard")).applyInArrow(_counter(n, k), "shard int, phrase long, run long, times long"))
    distinct = counted.groupBy("phrase", "run").agg(F.sum("times").alias("times"), F.min("shard").alias("shard"))
    provided = distinct.select("shard", "phrase", "run", (F.col("times") > 1).alias("many"))
    segments = cut(docs_in.cogroup(provided.groupBy("shard")).applyInArrow(_cutter(n, k), "phrase long, run long, many boolean, left binary, right binary"))
    crowded = distinct.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    few, crowds = _in_crowds(_dealt(segments, crowded, (n - k) // 2, n - k))
    judged = lambda x: x.groupBy(F.pmod(F.hash("group"), F.lit(shards)).alias("part")).applyInArrow(_judge(n, k), "phrase long, run long, first int, last int")
    repeated = judged(few).unionByName(_crowd_stretches(crowds, segments, judged, n, k))
    marks = counted.join(repeated, ["phrase", "run"]).select("shard", "phrase", "run", "first", "last", F.lit(0).alias("kind"))
    whole = copied.select(shard(shards).alias("shard"), F.col("id").alias("phrase"), F.col("th").alias("run"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(1).alias("kind"))
    removed = docs_in.cogroup(marks.unionByName(whole).groupBy("shard")).applyInArrow(_remover(n, k), _OUT)
    return removed.unionByName(_untouched(outside)).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
