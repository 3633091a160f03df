"""Rules on small fixtures: names, dates, status, JSON, HTML, resolution, archives, paging."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, edition, html, json, text
from palimpsest.functions.geometry import normalized, overlap_share
from palimpsest.operators import identity, integrity, paging, predicates, records, resolution
from palimpsest.operators.feed import lifecycle_kind
from palimpsest.operators.similarity import trigram_pairs
from palimpsest.sources import archives, store


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def filters(spark, question, today="2026-10-06"):
    found = one(spark, predicates.question_filters(F.lit(question), F.lit(today).cast("date"))).asDict()
    return {k: v for k, v in found.items() if v is not None}


def test_question_filters(spark):
    assert filters(spark, "서울 거주 대학생이 이번 달 신청 가능한 100만원 이상 생활비 소득 8구간 이하") == {
        "student_type": "undergraduate", "benefit_type": "living_cost", "end_from": date(2026, 10, 6), "end_to": date(2026, 10, 31), "min_amount": 1_000_000,
        "income_bracket_max": 8, "region": "서울", "status": "active"}
    assert filters(spark, "석사 과정 대학생")["student_type"] == "graduate" and filters(spark, "") == {}
    assert filters(spark, "경기도에 사는 학생, 3,000원 초과") == {"region": "경기", "min_amount": 3000}
    assert filters(spark, "부산광역시 주민 소득 8분위 이하") == {"region": "부산"}
    stated = predicates.question_filters(F.lit("서울 거주 대학생"), F.lit("2026-10-06").cast("date"))
    both = one(spark, predicates.with_explicit(stated, {"region": F.lit("부산"), "student_type": F.lit(None).cast("string")}))
    assert (both.region, both.student_type) == ("부산", "undergraduate")


def test_cursors():
    assert paging.decode_cursor(paging.encode_cursor(40)) == 40 and paging.decode_cursor(paging.encode_cursor(-3)) == 0 and paging.decode_cursor(None) == 0
    for bad in ("???", "e30", "eyJvZmZzZXQiOiJ4In0"):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)


@pytest.mark.parametrize("value,want", [("1학기", "spring"), ("2 학기", "fall"), ("하계방학", "summer"), ("상반기", "h1"), ("winter", "winter"), ("수시", "other"), (None, None)])
def test_terms(spark, value, want):
    assert one(spark, edition.term_code(F.lit(value).cast("string"))) == want


def test_edition_tokens(spark):
    found = one(spark, edition.edition_tokens(F.lit("2026학년도 1학기 희망 장학생 추가모집 3차 12기")))
    assert (found.years, found.terms, found.rounds, found.cohorts) == (["2026"], ["spring"], ["3", "additional"], ["12"])
    assert one(spark, edition.edition_tokens(F.lit("'25학년도 하반기"))).years == ["2025"]


def test_edition_tokens_in_lists_and_short_forms(spark):
    found = one(spark, edition.edition_tokens(F.lit("'26년 후반기 67, 68기 후보생 모집")))
    assert found.years == ["2026"] and sorted(found.cohorts) == ["67", "68"]
    assert one(spark, edition.edition_tokens(F.lit("２６-1학기 안내"))).asDict() == {"years": ["2026"], "terms": ["spring"], "halves": [], "rounds": [], "cohorts": []}
    assert one(spark, edition.edition_tokens(F.lit("12345차 제3차 2차년도 재 모집"))).rounds == ["3", "re"]


@pytest.mark.parametrize("name,provider,same", [
    ("[기간연장] 2026학년도 1학기 희망장학금 선발 안내", None, "희망 장학금"), ("한빛재단 희망장학금", "한빛재단", "희망장학금"), ("2024 희망장학금", None, "희망장학금"),
    ("24년 희망장학금 67, 68기 모집", None, "희망 장학생"), ("26-1학기 희망장학금 하계 추가모집 2차", None, "희망장학금"), ("한빛재단", "한빛재단", "한빛재단"),
    ("희망장학금(교외>", None, "희망장학금"), ("선발", None, "선발"),
])
def test_core_names(spark, name, provider, same):
    core = lambda n, p: one(spark, edition.core_name(F.lit(n), F.lit(p).cast("string")))
    assert core(name, provider) == core(same, None)


def test_dates(spark):
    assert one(spark, dates.board_date(F.lit("2026.03.05"))) == date(2026, 3, 5)
    assert one(spark, dates.board_date(F.lit("2026.3.5"))) is None and one(spark, dates.board_date(F.lit("2026.13.05"))) is None
    day, time = dates.next_midnight(F.lit("2026-12-31").cast("date"), F.lit("24:00"))
    assert one(spark, F.struct(day.alias("d"), time.alias("t"))).asDict() == {"d": date(2027, 1, 1), "t": "00:00"}
    assert one(spark, dates.backoff_minutes(F.lit(3), F.lit(True))) == 90 and one(spark, dates.backoff_minutes(F.lit(3), F.lit(False))) == 8


@pytest.mark.parametrize("rows,want", [
    ([("application", "2025-09-01", None, "2025-09-30", None, "fixed")], "active"),
    ([("application", "2025-09-20", None, "2025-09-30", None, "fixed")], "upcoming"),
    ([("application", "2025-09-01", None, "2025-09-18", None, "fixed")], "closed"),
    ([("application", "2025-09-01", None, "2025-09-19", 61200, "fixed")], "closed"),
    ([("application", "2025-09-01", None, "2025-09-19", None, "fixed")], "active"),
    ([("application", "2025-09-01", None, None, None, "rolling")], "active"),
    ([("application", "2025-09-01", None, None, None, "fixed")], "unknown"),
    ([("application", "2025-09-01", None, "2025-09-02", None, "fixed"), ("document", "2025-09-01", None, "2025-12-01", None, "fixed")], "closed"),
    ([("application", None, None, None, None, "fixed")], "unknown"),
])
def test_application_status(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "id long, kind string, start_date string, start_second int, end_date string, end_second int, closing_rule string")
    df = df.withColumns({"start_date": F.col("start_date").cast("date"), "end_date": F.col("end_date").cast("date")})
    assert records.application_status(df, ["id"], today="2025-09-19", second=63_000).first()["status"] == want


def test_json():
    assert json.clean_json('```json\n{"a": [1, 2,], "b": ",]"}\n```') == '{"a": [1, 2], "b": ",]"}'
    assert json.clean_json("{nope") is None
    assert json.set_at({"a": [{"b~c/d": 1}]}, "/a/0/b~0c~1d", 2) == {"a": [{"b~c/d": 2}]} and json.set_at({"a": 1}, "/x/y", 2) == {"a": 1}
    assert [f["path"] for f in json.facts({"a": {"state": "stated", "value": 1}, "b": [{"state": "conflict"}]})] == ["/a", "/b/0"]


def test_html():
    page = "<h1>Title</h1><p>one<br>two <del>old</del></p><table><tr><td>only</td></tr><tr><td><p>inner</p></td></tr></table><table><tr><th rowspan=2>a</th><td>b</td><td></td></tr><tr><td colspan=2>c</td></tr></table><script>x</script>"
    found = [(b["kind"], b["text"]) for b in html.blocks(page)]
    assert found == [("heading", "Title"), ("paragraph", "one\ntwo ~~old~~"), ("paragraph", "inner"), ("table", "a\tb\t\na\tc\tc")]
    assert html.render("<p>a&nbsp; b</p><table><tr><td>x</td><td>y</td></tr></table>") == "a b\nx\ty"
    a, b, c = '<p style="x">t <a href="u">v</a></p>', '<p>t  <a href="u">v</a></p>', '<p>t <a href="w">v</a></p>'
    assert html.semantic_fingerprint(a) == html.semantic_fingerprint(b) != html.semantic_fingerprint(c)
    assert html.links(a) == [{"href": "u", "text": "v"}] and html.blocks(None) == []
    assert [(s["kind"], s["offset"]) for s in html.revision_signals("모집 기간 연장 및 정정")] == [("extension", 6), ("correction", 11)]
    assert [b["kind"] for b in html.transcription_blocks("# H\ntext\n\n| a | b |\n|---|---|\n| c | d |\n\n<table><tr><td>x</td></tr></table>")] == ["heading", "paragraph", "table", "table"]


def test_archives():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section0.xml", "<s xmlns:h='u'><h:p><h:run><h:t>first</h:t></h:run></h:p><h:p/></s>")
        z.writestr("inner.zip", b"PK")
    found, flags = archives.members(buffer.getvalue())
    assert [n for n, _ in found] == ["Contents/section0.xml"] and flags == ["skipped"] and archives.section_text(buffer.getvalue()) == ["first"]
    assert archives.members(b"no") == ([], ["unreadable"])


def test_store(spark, tmp_path):
    files = spark.createDataFrame([(b"%PDF-1.7", "a.bin"), (b"%PDF-1.7", "b.bin"), (b" <!DOCTYPE HTML>", "c"), (b"zz", "d.XLSX"), (b"zz", None)], "content binary, name string")
    assert [r.k.format for r in files.select(store.sniff(F.col("content"), F.col("name")).alias("k")).collect()] == ["pdf", "pdf", "html", "xlsx", "binary"]
    folder = str(tmp_path / "store")
    assert store.put(files, folder).count() == 3 and spark.read.parquet(folder).count() == 3
    store.put(files, folder)
    assert spark.read.parquet(folder).count() == 3 and store.verify(spark.read.parquet(folder)).isEmpty()
    urls = {"https://example.org/a": True, "http://localhost/a": False, "http://10.0.0.1/": False, "ftp://example.org": False, "https://u:p@example.org/": False, "https://example.org:8443/": False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", store.fetchable(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == urls


def test_geometry(spark):
    box = tuple(map(F.lit, (-0.5, 0.0, 0.5, 1.0)))
    assert one(spark, normalized(box)) == [0.0, 0.0, 0.5, 1.0] and one(spark, normalized(tuple(map(F.lit, (0.4, 0.0, 0.4, 1.0))))) is None
    assert one(spark, overlap_share(tuple(map(F.lit, (0.0, 0.0, 0.5, 1.0))), tuple(map(F.lit, (0.25, 0.0, 1.0, 1.0))))) == 0.5


def test_resolution():
    c = lambda k, v: {"key": k, "value": v}
    d = lambda k, new, *old, ok=True: {"key": k, "selected": new, "superseded": list(old), "verified": ok}
    assert resolution.resolve([], [], [])["outcome"] == "not_stated" and resolution.resolve([], [], [{"verified": True}])["outcome"] == "unresolved"
    assert resolution.resolve([c("a", "1"), c("b", "1.0")], [], [])["outcome"] == "unresolved"
    assert resolution.resolve([c("b", '{"x":1,"y":2}'), c("a", '{"y":2,"x":1}')], [], []) == {"outcome": "agreed", "selected": "a", "notes": []}
    assert resolution.resolve([c("a", "1"), c("b", "2")], [], [])["outcome"] == "unresolved"
    assert resolution.resolve([c("a", "1"), c("b", "2")], [d("x", "b", "a")], [])["outcome"] == "resolved_explicit_update"
    assert resolution.resolve([c("a", "1"), c("b", "2")], [d("x", "b", "a", ok=False)], [])["notes"] == ["ignored x", "disagreement"]
    assert resolution.resolve([c("a", "1"), c("b", "2")], [d("x", "b", "a"), d("y", "a", "b")], [])["notes"] == ["cycle"]
    assert resolution.resolve([c("a", "1")], [], [{"verified": True}])["outcome"] == "unresolved"
    with pytest.raises(ValueError):
        resolution.resolve([c("a", "1"), c("a", "2")], [], [])


def test_verdicts(spark):
    none = F.array().cast("array<string>")

    def signature(**given):
        names = ("fact_years", "name_years", "fact_terms", "name_terms", "halves", "rounds", "cohorts")
        days = {k: F.array(*[F.lit(x).cast("date") for x in given.get(k, [])]).cast("array<date>") for k in ("deadlines", "starts")}
        return F.struct(*[(F.array(*map(F.lit, given[n])) if given.get(n) else none).alias(n) for n in names], *[v.alias(k) for k, v in days.items()])

    cases = [
        (0.5, {}, {}, "different"), (0.9, {"fact_years": ["2026"]}, {"fact_years": ["2025"]}, "different_edition"), (0.9, {"rounds": ["1"]}, {}, "uncertain"),
        (0.9, {"fact_years": ["2026"]}, {"fact_years": ["2026"]}, "same"), (0.9, {}, {}, "uncertain"), (0.7, {"fact_years": ["2026"]}, {"fact_years": ["2026"]}, "uncertain"),
        (0.9, {"deadlines": ["2026-01-01"]}, {"deadlines": ["2026-09-01"]}, "different_edition"), (0.9, {"fact_years": ["2026"]}, {"name_years": ["2025"]}, "uncertain"),
    ]
    for score, a, b, want in cases:
        df = spark.range(1).select(signature(**a).alias("l"), signature(**b).alias("r"))
        assert df.select(identity.verdict(F.lit(score), "l", "r").alias("v")).first()["v"] == want, (score, a, b)


def test_lifecycle_kinds(spark):
    state = "struct<redirect:long,active:boolean,version:long,is_split:boolean,change:string>"
    cases = [
        ((None, True, None, False, None), (None, True, 1, False, None), "created"), ((None, True, 1, False, None), (None, True, 2, False, "extension"), "extended"),
        ((None, True, 1, False, None), (None, True, 2, False, None), "updated"), ((None, True, 1, False, None), (9, True, 1, False, None), "merged"),
        ((None, True, 1, False, None), (None, False, 1, False, None), "unpublished"), ((None, False, 1, False, None), (None, True, 1, False, None), "restored"),
        ((None, True, 1, False, None), (None, True, 1, False, None), None), ((None, True, 1, False, None), (None, True, 2, True, None), "split")]
    df = spark.createDataFrame([(i, b, a) for i, (b, a, _) in enumerate(cases)], f"i int, b {state}, a {state}")
    assert [r.k for r in df.orderBy("i").select(lifecycle_kind("b", "a").alias("k")).collect()] == [k for _, _, k in cases]


def test_trigram_pairs_lose_none(spark):
    import itertools
    import random

    rng = random.Random(2)
    names = {i: "".join(rng.choices("abc", k=rng.randint(1, 9))) for i in range(60)}
    grams = lambda s: {("  " + s + " ")[i : i + 3] for i in range(len(s) + 1)}
    for least in (0.2, 0.5, 0.8):
        want = {(a, b) for a, b in itertools.combinations(names, 2) if len(grams(names[a]) & grams(names[b])) / len(grams(names[a]) | grams(names[b])) >= least}
        got = trigram_pairs(spark.createDataFrame(list(names.items()), "k long, n string"), key="k", name="n", at_least=least)
        assert {(r.left_key, r.right_key) for r in got.collect()} == want


def test_text(spark):
    assert one(spark, text.parse_amount(F.lit("3,500,000원"))) == 3_500_000 and one(spark, text.parse_amount(F.lit("-5"))) is None
    assert one(spark, records.headcount_digits(F.lit("00명 선발"))) == 2 and one(spark, records.headcount_digits(F.lit("100명"))) is None
    row = spark.createDataFrame([("a  b\nc d", "b c")], "b string, q string").select(text.quote_offsets("b", "q").alias("x")).first()["x"]
    assert (row.start, row.stop) == (3, 6)
    assert one(spark, text.amount_label(F.lit("range"), F.lit(10_000), F.lit(25_500), F.lit(None))) == "1만원~25,500원"


def test_integrity(spark):
    parents, children = spark.createDataFrame([(1,)], "p long"), spark.createDataFrame([(1, 1), (2, 9), (3, None)], "c long, p long")
    assert [r.c for r in integrity.orphans(children, parents, "p", "p").collect()] == [2]
    after = spark.createDataFrame([(1, 1), (2, 8)], "c long, p long")
    assert {(r.c, r.how) for r in integrity.rewritten(children, after, "c", ["p"]).collect()} == {(2, "changed"), (3, "deleted")}


def test_redirects(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "k long, t long")
    assert {r.k: r.final for r in identity.follow_redirects(chain, source="k", target="t").collect()} == {1: 4, 2: 4, 3: 4, 9: 8}
    with pytest.raises(ValueError):
        identity.follow_redirects(spark.createDataFrame([(1, 2), (2, 1)], "k long, t long"), source="k", target="t", most=4)


def test_match_items(spark):
    years = lambda *y: identity.signature(F.col("name"), fact_years=F.when(F.col("year").isNull(), F.array().cast("array<string>")).otherwise(F.array("year")))
    cases = {
        # items (name, year), records (name, year, items of the extraction before), what is taken
        "each once": ([("희망장학금", "26"), ("희망장학금", "26")], [("희망 장학금", "26", 2)], [(0, "same"), None]),
        "two the same": ([("희망장학금", "26")], [("희망장학금", "26", 1), ("희망 장학금", "26", 1)], [None]),
        "the other is left": ([("희망장학금", "26"), ("희망장학금", "27"), ("희망장학금", "26")], [("희망장학금", "26", 3), ("희망장학금", "27", 3)], [(0, "same"), (1, "same"), None]),
        "name without anchor": ([("희망장학금", None)], [("희망장학금", None, 1)], [(0, "slot")]),
        "renamed": ([("새이름", None)], [("옛장학금", None, 1)], [(0, "renamed")]),
        "other edition": ([("희망장학금", "26")], [("희망장학금", "25", 1)], [None]),
        "more items before": ([("새이름", None)], [("옛장학금", None, 2)], [None]), "unknown before": ([("새이름", None)], [("옛장학금", None, None)], [None]),
        "more items now": ([("새이름", None), ("둘째", None)], [("옛장학금", None, 1)], [None, None]), "no record": ([("홀로", None)], [], [None]),
    }
    items = [(i, pos, *x) for i, (new, _, _) in enumerate(cases.values()) for pos, x in enumerate(new)]
    known = [(i, 100 * i + j, *x) for i, (_, old, _) in enumerate(cases.values()) for j, x in enumerate(old)]
    left = spark.createDataFrame(items, "notice long, pos long, name string, year string").withColumn("mark", years())
    right = spark.createDataFrame(known, "notice long, record long, name string, year string, previous long").withColumn("mark", years())
    got = {(r.notice, r.pos): (r.record - 100 * r.notice, r.how) if r.how else None for r in identity.match_items(left, right).collect()}
    assert got == {(i, pos): x for i, (_, _, want) in enumerate(cases.values()) for pos, x in enumerate(want)}


def test_container_formats(spark):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("[Content_Types].xml", "x")
        z.writestr("xl/workbook.xml", "word/")
    found = one(spark, store.sniff(F.lit(bytearray(zipped.getvalue())), F.lit("a.bin")))
    assert (found["format"], found.confidence) == ("xlsx", "magic")
    assert one(spark, store.sniff(F.lit(bytearray(b"PK\x03\x04junk")), F.lit("a.zip")))["format"] == "binary"
