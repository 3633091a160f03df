"""Substring deduplication by repeated-phrase automata.

A window is `n` consecutive words of one document. Each word goes that is covered by a window whose word sequence also
starts in a document of smaller id; windows are judged on the input, not on what is left.

1. Candidates. Every document's windows are winnowed to phrases of `k` words: a window's phrase is its k-gram of least
   hash, so equal windows share it. A phrase recurs if two different texts hold it.
2. Confirmation. In documents with recurring phrases, each window under such a phrase is hashed; (phrase hash, window
   hash), 128 bits together, is gathered over shards, and a window that two documents hold is confirmed with the least
   id that holds it. Shards send each window once, so no key gathers more rows than there are shards.
3. Location. Each shard compiles an Aho-Corasick automaton of its confirmed phrases, streams its documents through it,
   and looks up the windows around every occurrence. A shard's automaton holds only phrases of its own documents, so its
   size is bounded by theirs, and each document passes one automaton.

Words are coded as three letters each for the automaton (18 bits of the word's hash), so that phrases can share a code; the
phrase's and the window's hash decide.
Copies of a text are settled by the text's hash: all but the one of least id lose all words if they have `n`.

Cases. Ids are whole numbers, else a ValueError. Null and empty texts have no words; a null id is smaller than none and larger than all others, and rows with a
null id don't lose words to each other; rows with one id don't either; a text of under n words is kept whole.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import scan
from palimpsest.llm.common import SPACES, cut, small_batches
from palimpsest.llm.routing import NO_ID, copies, in_slots, maybe_in, numbered, shard, shard_count

N, K = 50, 20
_OUT = "id long, th long, n_words long, n_removed long, kept_text string"
_NAMES = ["id", "th", "n_words", "n_removed", "kept_text"]


def _words(data: np.ndarray, bounds: np.ndarray) -> scan.Words:
    return scan.Words(data, bounds, scan.class_table(SPACES, False))


def _letters(hashes: np.ndarray) -> bytes:
    """Three letters for each word, from 48 to 111."""
    bits = np.stack([(hashes >> np.uint64(s)) & np.uint64(63) for s in (46, 52, 58)], axis=1)
    return (bits.astype(np.uint8) + 48).tobytes()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def phrases(rows: DataFrame, n: int, k: int) -> DataFrame:
    """(id, th, phrase) of each document's distinct phrases."""

    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for a, _, data, bounds in scan.blocks(batch.column(2)):
                    words = _words(data, bounds)
                    found = scan.Anchors(scan.Rolling(words.hashes()), words.bounds, n, k)
                    if not len(found):
                        continue
                    order = np.lexsort((found.phrase, found.owner))
                    p, o = found.phrase[order], found.owner[order]
                    new = np.r_[True, (p[1:] != p[:-1]) | (o[1:] != o[:-1])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + o[new]]), pa.array(ths[a + o[new]]), pa.array(p[new].view(np.int64))], names=["id", "th", "phrase"])

    return rows.select("id", "th", "text").mapInArrow(run, "id long, th long, phrase long")


def _confirmer(n: int, k: int):
    """For a shard's documents and candidate phrases: (shard, phrase, window, least, most, code), each window once."""
    names = ["shard", "phrase", "window", "least", "most", "code"]

    def run(key, docs, facts):
        wanted = np.unique(_numbers(facts, "phrase").view(np.uint64))
        parts, codes = [], {}
        if len(wanted) and docs.num_rows:
            ids = _numbers(docs, "id")
            at = 0
            for chunk in docs.column("text").chunks:
                for a, _, data, bounds in scan.blocks(chunk):
                    words = _words(data, bounds)
                    h = words.hashes()
                    roll = scan.Rolling(h)
                    found = scan.Anchors(roll, words.bounds, n, k)
                    found = found.keep(np.isin(found.phrase, wanted))
                    letters = None
                    for p, q in zip(*(x.tolist() for x in (found.phrase, found.at))):
                        if p not in codes:
                            letters = letters or _letters(h).decode()
                            codes[p] = letters[3 * q : 3 * (q + k)]
                    starts, pair = scan.spread(found.first, found.last)
                    parts.append((found.phrase[pair], roll.of(starts, starts + n), ids[at + a + found.owner[pair]]))
                at += len(chunk)
        if not sum(len(x[0]) for x in parts):
            return pa.table({c: pa.array([], pa.string() if c == "code" else pa.int32() if c == "shard" else pa.int64()) for c in names})
        p, w, i = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((w, p))
        p, w, i = p[order], w[order], i[order]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        first = np.r_[True, p[new][1:] != p[new][:-1]]
        text = [codes[x] if f else None for x, f in zip(p[new].tolist(), first.tolist())]
        return pa.table([
            pa.array(np.full(len(new), key[0].as_py()), pa.int32()), pa.array(p[new].view(np.int64)), pa.array(w[new].view(np.int64)),
            pa.array(np.minimum.reduceat(i, new)), pa.array(np.maximum.reduceat(i, new)), pa.array(text, pa.string())], names=names)

    return run


def _remover(n: int, k: int):
    """For a shard's documents and its confirmed windows, phrase codes and copies: the result rows."""

    def run(key, docs, facts):
        kind = facts.column("kind").to_numpy()
        phrase, window, least = (_numbers(facts, c) for c in ("phrase", "window", "least"))
        hashes = phrase.view(np.uint64)
        copy = {(a, b) for a, b in zip(phrase[kind == 2].tolist(), window[kind == 2].tolist())}
        sure = kind == 0
        order = np.argsort(window[sure].view(np.uint64))
        windows, owners, firsts = window[sure].view(np.uint64)[order], hashes[sure][order], least[sure][order]
        confirmed = np.unique(owners)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        code = facts.column("code")
        for i in np.flatnonzero(kind == 1).tolist():
            j = np.searchsorted(confirmed, hashes[i])
            if j < len(confirmed) and confirmed[j] == hashes[i]:
                automaton.add_word(code[i].as_py(), i)
        if len(automaton):
            automaton.make_automaton()
        ids, ths = _numbers(docs, "id"), _numbers(docs, "th")
        out, at = [], 0
        for chunk in docs.column("text").chunks:
            for a, b, data, bounds in scan.blocks(chunk):
                words = _words(data, bounds)
                own_ids = ids[at + a : at + b]
                gone = np.zeros(len(words), bool)
                if len(automaton):
                    gone = _covered(words, own_ids, automaton, windows, owners, firsts, n, k)
                whole = np.array([(i, t) in copy for i, t in zip(own_ids.tolist(), ths[at + a : at + b].tolist())], bool) & (words.counts >= n)
                gone |= np.repeat(whole, words.counts)
                out.append(_result(words, own_ids, ths[at + a : at + b], gone))
            at += len(chunk)
        return pa.Table.from_batches(out, schema=_SCHEMA) if out else _SCHEMA.empty_table()

    return run


_SCHEMA = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _covered(words, ids, automaton, windows, owners, firsts, n, k) -> np.ndarray:
    """True for the words that a confirmed window of a smaller document covers."""
    if len(words) < n:
        return np.zeros(len(words), bool)
    h = words.hashes()
    ends = [e for e, _ in automaton.iter(_letters(h).decode()) if e % 3 == 2]
    if not ends:
        return np.zeros(len(words), bool)
    at = (np.array(ends, np.int64) + 1) // 3 - k
    roll = scan.Rolling(h)
    phrase = roll.of(at, at + k)
    starts, pair = scan.spread(np.maximum(at - (n - k), 0), np.minimum(at, len(words) - n))
    inside = words.within(n)
    fits = inside[starts]
    starts, pair = starts[fits], pair[fits]
    w = roll.of(starts, starts + n)
    near = np.minimum(np.searchsorted(windows, w), len(windows) - 1)
    earlier = (windows[near] == w) & (owners[near] == phrase[pair]) & (firsts[near] < ids[words.owner()[starts]])
    return scan.covered(starts[earlier], n, len(words))


def _result(words, ids, ths, gone) -> pa.RecordBatch:
    data, bounds = scan.join_words(words, ~gone)
    removed = scan.sums(gone, words.bounds)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(ths), pa.array(words.counts.astype(np.int64)), pa.array(removed), scan.string_array(data, bounds)], schema=_SCHEMA)


def _untouched(rows: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            for batch in small_batches(whole, "text"):
                for a, b, data, bounds in scan.blocks(batch.column(2)):
                    words = _words(data, bounds)
                    yield _result(words, batch.column(0).to_numpy()[a:b], batch.column(1).to_numpy()[a:b], np.zeros(len(words), bool))

    return rows.select("id", "th", "text").mapInArrow(run, _OUT)


def remove_repeated_windows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs; kept words are joined by one space."""
    rows = numbered(docs, text, doc_id)
    same, size = copies(rows)
    shards = shard_count(docs.sparkSession, size)
    later = same.where("id > least").select("id", "th")
    every = cut(phrases(rows, n, k))
    recurring = cut(every.groupBy("phrase").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("phrase"))
    candidates = cut(maybe_in(every, recurring, "phrase").join(recurring, "phrase").join(later, ["id", "th"], "left_anti").select("id", "th", "phrase"))
    inside, outside = in_slots(rows, candidates.select("id", "th").union(later), shards)
    wanted = candidates.select(shard(shards).alias("shard"), "phrase").distinct()
    found = inside.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(
        _confirmer(n, k), "shard int, phrase long, window long, least long, most long, code string")
    found = found.withColumn("first", F.min("least").over(Window.partitionBy("phrase", "window")))
    kinds = F.array(F.when(F.col("first") < F.col("most"), F.lit(0)), F.when(F.col("code").isNotNull(), F.lit(1)))
    facts = found.select("shard", "phrase", "window", F.col("first").alias("least"), "code", F.explode(F.array_compact(kinds)).alias("kind"))
    # A window that recurs within rows of one id only, or of none, isn't a repeat: least and most are then equal.
    done = later.select(shard(shards).alias("shard"), F.col("id").alias("phrase"), F.col("th").alias("window"), F.lit(0).cast("long").alias("least"), F.lit(None).cast("string").alias("code"), F.lit(2).alias("kind"))
    removed = inside.groupBy("shard").cogroup(facts.unionByName(done).groupBy("shard")).applyInArrow(_remover(n, k), _OUT)
    return removed.unionByName(_untouched(outside)).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text")
