"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows.

A-Z are lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. An item's windows are its runs of `n` words; an
item of fewer words, but not none, is one window. A hash hit is verified word by word before it counts.

Size. Items are broadcast only in blocks of about `block_bytes` of text, in arrays: the text once, and 17 bytes for each
window, of which a byte of text gives half a one at most; so a block takes some 12 times its bytes in the driver and in each
task, whose one worker has it. A larger benchmark is scanned block by block, without a shuffle: each block is one more pass
over the same rows, whose results are written before the next block is made, so that no stage and no driver ever has two
blocks. An item is never divided: a block is larger by its longest item at most.
Cases. A null or empty text has no words, hence no hits; a null or wordless item matches nothing; items with equal
windows are all named; repeated documents are judged each; items whose id is null are not named but their words count.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from palimpsest.llm import scan
from palimpsest.llm.common import add_columns, col, cut, without

WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
BLOCK_BYTES = 16 << 20
_FIELDS = [
    StructField("n_words", LongType()),
    StructField("hit_starts", ArrayType(IntegerType())),
    StructField("hit_ends", ArrayType(IntegerType())),
    StructField("hit_from", ArrayType(IntegerType())),
    StructField("hit_words", ArrayType(IntegerType())),
    StructField("items", ArrayType(StringType())),
]


def _words(data: np.ndarray, bounds: np.ndarray) -> scan.Words:
    return scan.Words(scan.lower_table()[data], bounds, scan.class_table(WORD_BYTES, True))


class WindowSet:
    """Windows of benchmark items: for each length the hashes in rising order, with the place of each window's first word.

    The items' words are kept once. Windows of equal words follow each other and have one number.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = [item for item, _ in items]
        text = [(text or "").encode() for _, text in items]
        bounds = np.r_[0, np.cumsum([len(x) for x in text])].astype(np.int64)
        self.words = _words(np.frombuffer(b"".join(text), np.uint8), bounds)
        self.owner = self.words.owner()
        counts, roll = self.words.counts, scan.Rolling(self.words.hashes())
        self.tables = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            fits = (counts >= n) if size == n else counts == size
            at = np.flatnonzero(self.words.within(size) & fits[self.owner[: max(len(self.words) - size + 1, 0)]])
            h = roll.of(at, at + size)
            order = np.argsort(h, kind="stable")
            self.tables[size] = self._grouped(h[order], at[order].astype(np.int32), size)

    def _grouped(self, h: np.ndarray, at: np.ndarray, size: int):
        """(hashes, places, whether a run of equal windows starts, filter); windows of one hash are put in order of their words."""
        same = np.flatnonzero(np.r_[False, h[1:] == h[:-1]])
        text = lambda p: _window(self.words, p, size)
        turns = lambda: [i for i in same.tolist() if text(at[i]) != text(at[i - 1])]
        for i in turns():
            first, last = np.searchsorted(h, h[i], "left"), np.searchsorted(h, h[i], "right")
            at[first:last] = sorted(at[first:last].tolist(), key=lambda p: (text(p), p))
        starts = np.ones(len(h), bool)
        starts[same] = False
        starts[turns()] = True
        bits = max(16, int(len(h)).bit_length() + 2)
        seen = np.zeros(1 << bits, bool)
        seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        return h, at, starts, np.uint64(64 - bits), seen

    def hits(self, words: scan.Words, roll: scan.Rolling):
        """(word, length, items) of every window of the block that an item holds too, verified word by word."""
        for size, (hashes, places, starts, shift, seen) in self.tables.items():
            h = roll.windows(size)
            maybe = np.flatnonzero(seen[(h >> shift).astype(np.int64)] & words.within(size)[: len(h)])
            near = np.searchsorted(hashes, h[maybe])
            sure = hashes[np.minimum(near, len(hashes) - 1)] == h[maybe]
            for at, first in zip(maybe[sure].tolist(), near[sure].tolist()):
                mine = _window(words, at, size)
                while first < len(hashes) and hashes[first] == h[at]:
                    last = first + 1
                    while last < len(hashes) and not starts[last]:
                        last += 1
                    if _window(self.words, places[first], size) == mine:
                        yield at, size, [self.names[i] for i in np.unique(self.owner[places[first:last]])]
                        break
                    first = last


def _window(words: scan.Words, at: int, size: int) -> bytes:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[at : at + size], words.ends[at : at + size]))


def _scanner(windows: WindowSet):
    def compute(texts: pa.Array) -> list[pa.Array]:
        counts, starts, ends, froms, sizes, named, n_runs = [], [], [], [], [], [], []
        for _, _, data, bounds in scan.blocks(texts):
            words = _words(data, bounds)
            counts.append(words.counts)
            hit = np.zeros(len(words), bool)
            items = defaultdict(set)
            own = words.owner()
            for at, size, found in windows.hits(words, scan.Rolling(words.hashes())):
                hit[at : at + size] = True
                items[int(own[at])].update(x for x in found if x is not None)
            for i in range(len(bounds) - 1):
                a, b = words.bounds[i], words.bounds[i + 1]
                named.append(sorted(items[i]) if i in items else [])
                if not hit[a:b].any():
                    n_runs.append(0)
                    continue
                first, last = scan.runs(hit[a:b])
                n_runs.append(len(first))
                starts.append(words.starts[a + first] - bounds[i])
                ends.append(words.ends[a + last - 1] - bounds[i])
                froms.append(first)
                sizes.append(last - first)
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32())
        n = np.array(n_runs, np.int64)
        return [
            pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
            scan.as_list(flat(starts), n), scan.as_list(flat(ends), n),
            scan.as_list(flat(froms), n), scan.as_list(flat(sizes), n),
            pa.array(named, pa.list_(pa.string())),
        ]

    return compute


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = 10, block_bytes: int = BLOCK_BYTES, prefix: str = "",
) -> DataFrame:
    """docs with n_words, hit_starts and hit_ends (byte spans), hit_from (first word), hit_words (words) and items.

    The names of these columns come after `prefix`.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(col(item_id).cast("string").alias("item"), col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    fields = [StructField(prefix + f.name, f.dataType) for f in _FIELDS]
    found = docs
    for block in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        windows = sc.broadcast(WindowSet([tuple(r) for r in part.collect()], n))
        if block == 0:
            found = add_columns(docs, text, fields, lambda w=windows: _scanner(w.value))
        else:
            before = found.select("*", *[col(f.name).alias(f"__{f.name}") for f in fields])
            found = _merge(add_columns(before, text, fields, lambda w=windows: _scanner(w.value)), prefix)
        if n_blocks > 1:
            found = cut(found)
            windows.destroy()
    return found


def _merge(found: DataFrame, p: str) -> DataFrame:
    """The union of the blocks' spans so far and of the last block's, and all items."""
    names = ("hit_from", "hit_words", "hit_starts", "hit_ends")
    spans = F.array_sort(F.concat(*[
        F.transform(F.arrays_zip(*[col(f"{q}{p}{f}").alias(f) for f in names]),
                    lambda x: F.struct(x["hit_from"].alias("f"), (x["hit_from"] + x["hit_words"]).alias("t"),
                                       x["hit_starts"].alias("s"), x["hit_ends"].alias("e")))
        for q in ("__", "")]))

    def join(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["f"].alias("f"), F.greatest(last["t"], x["t"]).alias("t"), last["s"].alias("s"),
                          F.greatest(last["e"], x["e"]).alias("e"))
        touches = (F.size(done) > 0) & (x["f"] <= last["t"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    out = found.withColumn("__spans", F.aggregate(spans, F.slice(spans, 1, 0), join))
    return out.withColumns({
        f"{p}hit_starts": F.transform("__spans", lambda x: x["s"]), f"{p}hit_ends": F.transform("__spans", lambda x: x["e"]),
        f"{p}hit_from": F.transform("__spans", lambda x: x["f"]), f"{p}hit_words": F.transform("__spans", lambda x: x["t"] - x["f"]),
        f"{p}items": F.array_sort(F.array_distinct(F.concat(f"__{p}items", f"{p}items"))),
    }).drop("__spans", *[f"__{p}{f.name}" for f in _FIELDS])


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", drop_share: float = 0.5, **options,
) -> DataFrame:
    """docs without the hit spans; a document goes whole if more than `drop_share` of its words are hit.

    Each span becomes one line break, so that what stood around it doesn't run together.
    """
    p = "__found_"
    found = find_contamination(docs, benchmark, text=text, prefix=p, **options)
    hit = F.aggregate(f"{p}hit_words", F.lit(0), lambda a, x: a + x)
    found = found.where((F.size(f"{p}hit_words") == 0) | (hit <= F.lit(drop_share) * F.col(f"{p}n_words")))
    raw = col(text).cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.col(f"{p}hit_ends"))
    ends = F.concat(F.col(f"{p}hit_starts"), F.array(F.octet_length(raw)))
    pieces = F.zip_with(starts, ends, lambda s, e: F.decode(F.substring(raw, s + 1, F.greatest(e - s, F.lit(0))), "UTF-8"))
    clean = F.when(F.size(f"{p}hit_starts") == 0, col(text)).otherwise(F.array_join(pieces, "\n"))
    return found.select(*[clean.alias(c) if c == text else col(c) for c in docs.columns])
