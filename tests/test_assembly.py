"""Evidence of trees by the table function, panels by grouping sets, paged lists, guards of history."""

import json
import os
import tempfile

import pytest

from palimpsest.operators.dashboards import dashboards
from palimpsest.operators.evidence import evidence_rows, references
from palimpsest.operators.integrity import foreign_blocks, unfounded_revalidations
from palimpsest.sources.paged import crawl, later_pages_win


def test_references_of_several_shapes_and_depths():
    ref = lambda block, kind="direct": {"block_id": block, "quote": "q", "evidence_type": kind}
    tree = {
        "a": {"value": 1, "state": "conflict", "evidence": [ref("b1"), ref("b2", "inferred")]}, "none": {"value": None, "state": "not_found", "evidence": []},
        "list": [{"deep": [{"value": "é", "state": "stated", "evidence": [ref("b3")]}]}, 7, None], "other": {"kind": "k", "n": [1], "evidence": [ref("b4"), "no reference"], "in": {"evidence": "text"}}}
    assert list(references(tree, "/0")) == [
        ("/0/a", 0, "b1", "q", "direct", "1", "conflict"), ("/0/a", 1, "b2", "q", "inferred", "1", "conflict"), ("/0/list/0/deep/0", 0, "b3", "q", "direct", '"é"', "stated"),
        ("/0/other", 0, "b4", "q", "direct", '{"kind": "k", "n": [1], "in": {"evidence": "text"}}', "stated")]
    assert not list(references(None, "")) and not list(references([1, "x"], ""))


def test_evidence_rows(spark):
    fact = lambda state, *kinds: {"value": 1, "state": state, "evidence": [{"block_id": f"b{i}", "quote": "q", "evidence_type": k} for i, k in enumerate(kinds)]}
    trees = [(1, json.dumps({"a": fact("stated", "direct", "inferred", "direct"), "b": fact("conflict", "direct", "inferred")})), (2, None), (3, "no json"), (4, "{}"), (5, json.dumps(fact("stated", "direct")))]
    blocks = [(1, "b0", 10), (1, "b1", 11), (5, "b1", 50), (4, "b0", 40)]
    warnings = [(1, "/a/evidence/0: not there"), (1, "/a/evidence/0: twice"), (1, "/b"), (2, "/a/evidence/1: x"), (1, None)]
    rows = evidence_rows(
        spark.createDataFrame(trees, "k long, tree string"), spark.createDataFrame(blocks, "k long, block_id string, document long"), spark.createDataFrame(warnings, "k long, warning string"), key="k", tree="tree")
    assert sorted((r.k, r.document, r.path, r.status, r.verification) for r in rows.collect()) == [
        (1, 10, "/a", "candidate", "pending"), (1, 10, "/b", "conflicting", "verified"), (1, 11, "/a", "candidate", "pending"), (1, 11, "/b", "conflicting", "pending")]


def test_dashboards(spark):
    facts = spark.createDataFrame([("job", "a", "x"), ("job", "a", "y"), ("job", "b", "x"), ("job", None, None), ("note", "a", "x"), ("other", "a", "x")], "fact string, kind string, status string")
    found = dashboards(facts, {"1": ("job", "status", ()), "2": ("job", "both", ("x", "y")), "3": ("job", "kind", ("x",)), "4": ("note", "kind", ()), "5": ("none", "kind", ())})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([
        ("1", None, "x", 2), ("1", None, "y", 1), ("1", None, None, 1), ("2", "a", "x", 1), ("2", "a", "y", 1), ("2", "b", "x", 1), ("3", "a", None, 1), ("3", "b", None, 1), ("4", "a", None, 1)], key=repr)


def _pages(pages):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for number, files in pages.items():
        os.makedirs(f"{folder}/page={number}")
        for i, lines in enumerate(files):
            with open(f"{folder}/page={number}/part-{i}.json", "w") as out:
                out.write("\n".join(x if isinstance(x, str) else json.dumps({"total_pages": 4, **x}) for x in lines))
    return folder


def test_paged_list(spark):
    entry = lambda article, title: {"article": article, "title": title}
    path = _pages({1: [[entry(1, "a"), entry(2, "b")]], 2: [[entry(3, "c")], [entry(1, "later")]], 4: [[entry(2, "é"), "{broken", entry(5, None)]], 5: [[entry(9, "beyond")]]})
    rows = crawl(spark, path)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, rows.where("error IS NOT NULL").collect())) == [(3, None, None, "missing"), (4, None, None, "no JSON")]
    last = later_pages_win(rows, key="article").where("error IS NULL").select("article", "title", "page")
    assert sorted(map(tuple, last.collect())) == [(1, "later", 2), (2, "é", 4), (3, "c", 2), (5, None, 4)]
    with pytest.raises(Exception, match="no first page"):
        crawl(spark, _pages({2: [[entry(1, "a")]]})).collect()


def test_guards_of_history(spark):
    rows = [(1, None, "r", "received", 5), (2, 1, "r", "not_modified", 6), (3, 2, "r", "not_modified", 7), (4, 1, "s", "not_modified", 8), (5, None, "r", "not_modified", 9),
            (6, 7, "r", "not_modified", 1), (7, None, "r", "received", 5), (8, None, "r", "failed", 5), (9, 8, "r", "not_modified", 9), (10, 11, None, "not_modified", 9), (11, None, None, "received", 1)]
    found = unfounded_revalidations(spark.createDataFrame(rows, "id long, of long, what string, outcome string, at long"), key="id", reuses="of", same=["what"], outcome="outcome", started="at", finished="at")
    assert {r.id for r in found.collect()} == {4, 5, 6, 9, 10}
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (3, None)], "chunk long, block long")
    blocks, chunks = (spark.createDataFrame(x, f"{n} long, document long") for n, x in (("block", [(1, 1), (2, 2)]), ("chunk", [(1, 1), (2, 1), (3, 1)])))
    assert [tuple(r) for r in foreign_blocks(links, chunks, blocks, chunk="chunk", block="block", document="document").collect()] == [(1, 1)]


def test_routes_and_fallbacks(spark):
    from palimpsest.sources.registry import routed

    files = [(1, "pdf"), (2, "pdf"), (3, "pdf"), (4, "html"), (5, "html"), (6, "zip"), (7, "exe"), (8, "hwpx"), (9, "docx"), (10, None)]
    failures = [(2, "pdf_hybrid", "TimeoutError"), (3, "pdf_hybrid", "A"), (3, "direct", "B"), (5, "direct", "C"), (8, "hwp_pdf", "D"), (9, "other", "E"), (1, "direct", "F")]
    found = routed(spark.createDataFrame(files, "k long, format string"), spark.createDataFrame(failures, "k long, parser string, error string"), key="k")
    assert {r.k: (r.parser, r.status, r.flags) for r in found.collect()} == {
        1: ("pdf_hybrid", "succeeded", []), 2: ("direct", "partial", ["pdf_hybrid_failed:TimeoutError"]), 3: ("direct", "failed", ["pdf_hybrid_failed:A", "direct_failed:B"]),
        4: ("direct", "succeeded", []), 5: ("direct", "failed", ["direct_failed:C"]), 6: ("archive", "succeeded", []), 7: ("unsupported", "unsupported", ["unsupported:exe"]),
        8: ("direct", "partial", ["rhwp_failed:D"]), 9: ("docling", "succeeded", []), 10: ("unsupported", "unsupported", [])}


def test_version_rows(spark):
    from palimpsest.operators.records import UNTITLED, assemble_versions

    schema = "record long, pos long, name string, provenance array<string>, warnings array<string>, conflict boolean, coverage string, selected long, nominated long, benefits array<string>, conditions array<string>"
    drafts = [
        (1, 0, "a", [], [], False, "complete", 5, 9, ["x", "", None, "y"], ["c", "d"]), (1, 1, "", ["doc"], None, None, "complete", None, 9, [], None), (1, 2, None, ["doc"], ["w"], True, "complete", -1, 9, None, [""]),
        (2, 0, "b", None, None, None, None, None, None, ["z"], ["e"])]
    found = assemble_versions(spark.createDataFrame(drafts, schema), spark.createDataFrame([(1, 3), (1, 4), (9, 7)], "record long, version_no long"))
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 0, 5, 4, "in_place_edit", "a", "complete", [], 5, "final_selection", "x; y", "c\nd"), (1, 1, 6, 5, "in_place_edit", UNTITLED, "partial", ["doc"], 9, "university_nomination", None, None),
        (1, 2, 7, 6, "in_place_edit", UNTITLED, "needs_review", ["w", "field_conflict"], None, "final_selection", None, None), (2, 0, 1, None, "initial", "b", "needs_review", [], None, None, "z", "e")]


def test_subjects(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators.records import resolve_subjects

    people = spark.createDataFrame([(1, "Kim"), (2, None)], "id long, name string")
    audit = spark.createDataFrame([(1, "person", "1"), (2, "person", "2"), (3, "person", "x"), (4, "setting", "s"), (5, "job", "j"), (6, "other", "1"), (7, None, None)], "n long, kind string, entity string")
    kinds = {"person": (people, F.col("name"), F.concat(F.lit("/p/"), F.col("id").cast("string"))), "setting": (None, F.col("entity"), F.lit("/settings")), "job": (None, None, F.lit("/jobs"))}
    found = resolve_subjects(audit, kinds, kind="kind", entity="entity")
    assert {r.n: (r.link, r.subject) for r in found.collect()} == {
        1: ("/p/1", "Kim"), 2: ("/p/2", None), 3: (None, None), 4: ("/settings", "s"), 5: ("/jobs", None), 6: (None, None), 7: (None, None)}


def test_hashed_embedding(spark):
    import hashlib
    import math

    from palimpsest.functions.embedding import embed_texts
    from palimpsest.operators.retrieval import tokens
    from pyspark.sql import functions as F

    docs = [(1, "a b a é"), (2, ""), (3, None)]
    found = {r.k: r.vector for r in embed_texts(spark.createDataFrame(docs, "k long, t string"), key="k", tokens=tokens(F.col("t")), size=8).collect()}
    want = [0.0] * 8
    for token in "a b a é".split():
        h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        want[(h >> 1) % 8] += 1 if h & 1 else -1
    length = math.sqrt(sum(x * x for x in want))
    assert found[1] == pytest.approx([x / length if length else 0.0 for x in want]) and found[2] == found[3] == [0.0] * 8
