"""The manifest against a plain tree, with blocks of one level so that upper rounds are met."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, Tree string"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return _h("".join(parts))


def _up(nodes):
    return [_h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]


def _siblings(nodes, at):
    found, before, after = [], [], []
    while len(nodes) > 1:
        run = at // 16 * 16
        before.append("".join(nodes[run:at]))
        after.append("".join(nodes[at + 1 : run + 16]))
        nodes, at = _up(nodes), at // 16
    return list(zip(before, after)), nodes[0]


def _plain(rows):
    """(id, leaf, subroot, root, proof, folded root, verified) of each row, the tree built whole in memory."""
    trees = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        lower = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        trees.setdefault(r[1], []).append((r[0], _leaf(r, r[4]), _leaf(r, lower) if tampered else None))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))
    tops = [_siblings([x[1] for x in trees[s]], 0)[1] for s in order]
    out = []
    for i, s in enumerate(order):
        for at, (key, leaf, changed) in enumerate(trees[s]):
            path, subroot = _siblings([x[1] for x in trees[s]], at)
            upper, root = _siblings(tops, i)
            folded = changed or leaf
            for a, b in path + upper:
                folded = _h(a + folded + b)
            out.append((key, leaf, subroot, root, _h("".join(a + b for a, b in path + upper)), folded, folded == root))
    return sorted(out, key=repr)


def _check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.build_manifest(docs, tampered=tampered, becomes=lower, **options)


ROWS = (
    [(i, "hot", "en", i, f"Text {i}" if i % 3 else "lower") for i in range(300)] + [(i, f"s{i}", None, None, "É A" * (i % 4)) for i in range(300, 340)]
    + [(None, "hot", "en", None, "No id"), (None, None, None, None, None), (5, "hot", "en", 5, "lower"), (5, "hot", "en", 5, "Other"), (900, "", "de", 0, ""), (901, "é", "de", -3, None)]
)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_is_the_plain_tree(spark, depth):
    found = _check(spark, ROWS, depth=depth).check().collect()
    assert sorted((tuple(r) for r in found), key=repr) == _plain(ROWS)


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, "X")], [(7, None, None, None, None)] * 3])
def test_small_tables(spark, rows):
    found = _check(spark, rows).check().collect()
    assert sorted((tuple(r) for r in found), key=repr) == _plain(rows)


@pytest.mark.parametrize("depth", [1, 2])
def test_a_version_makes_its_ancestors_and_nothing_else(spark, depth):
    rows = [(i, "a" if i < 600 else f"b{i % 20}", "en", i, "Text") for i in range(700)]
    found = _check(spark, rows, depth=depth).check(made=True).collect()
    for r in found:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            assert r.made == [] and r.verified
        else:
            # Three levels over 600 leaves, one over a small source's five, two over 21 subroots.
            assert [m.level for m in r.made] == list(range(1 + (3 if r.doc_id < 600 else 1) + 2)) and not r.verified
            assert r.made[-1].digest == r.folded_root and len({(m.level, m.pos) for m in r.made}) == len(r.made)
            assert [m.pos for m in r.made][:3] == [r.doc_id, r.doc_id // 16, r.doc_id // 256] or r.doc_id >= 600
    assert len({r.root for r in found}) == 1
