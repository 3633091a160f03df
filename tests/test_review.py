"""Which corrections are allowed, and what a review settles."""

from pyspark.sql import functions as F

from palimpsest.operators.review import correctable, review_outcome


def test_correctable(spark):
    fine = [("/title", "x"), ("title", None), ("selection_capacity", "12"), ("academic_term", "fall"), ("windows/7/end_date", "2026-02-28"), ("windows/7/start_time", "09:30"), ("windows/7", None),
            ("benefits/a/amount_min", "1,000 원"), ("benefits/a/amount_kind", "fixed"), ("required_documents/-", "a form"), ("required_documents/0/name", "x"), ("contacts/1/email", None)]
    not_fine = [("published_at", "x"), ("selection_capacity", "-1"), ("selection_capacity", "many"), ("academic_term", "monsoon"), ("windows/7/end_date", "2026-02-30"), ("windows/7/end_date", "soon"),
                ("windows/7/start_time", "25:00"), ("windows/7", "x"), ("windows/7/id", "x"), ("benefits/a/amount_max", "-5"), ("benefits/a/amount_kind", "some"), ("required_documents/-", " "),
                ("contacts/-", "x"), ("contacts/1/fax", "x"), ("", None), (None, "x"), ("title/x/y/z", "x")]
    rows = spark.createDataFrame([(p, v, i < len(fine)) for i, (p, v) in enumerate(fine + not_fine)], "path string, value string, want boolean")
    wrong = rows.withColumn("got", correctable(F.col("path"), F.col("value"))).where("got <> want").collect()
    assert not wrong


def test_outcomes(spark):
    item = "struct<kind:string,entity:string,has_flags:boolean,published:boolean,related:array<long>,own:array<long>>"
    said = "struct<verdict:string,confidence:string,corrections:array<struct<path:string,value:string>>,same:array<long>,revisions:array<struct<target:long,merged:array<long>>>>"
    quality, identity, revision = ("other", "opportunity_version", True, False, None, None), ("identity_uncertain", "opportunity", False, None, [1, 2, 3], None), ("revision_candidate", "notice", False, None, None, [8, 9])
    say = lambda verdict, confidence="high", corrections=None, same=None, revisions=None: (verdict, confidence, corrections, same, revisions)
    cases = [
        (("parsing_failed", "document", True, None, None, None), say("dismiss"), "people"), (("other", "x", False, None, None, None), say("dismiss"), "people"), ((None, None, None, None, None, None), say("dismiss"), "people"),
        (quality, say("dismiss"), "dismissed"), (quality, say("dismiss", "low"), "escalated"), (quality, say("unsure"), "escalated"), (quality, (None,) * 5, "escalated"),
        (quality, say("fix", corrections=[("title", "x")]), "corrected"), (quality, say("fix"), "escalated"), (quality, say("fix", corrections=[("title", "x"), ("id", "y")]), "escalated"),
        ((*quality[:3], True, None, None), say("fix", corrections=[("title", "x")]), "escalated"), (identity, say("fix", corrections=[("title", "x")]), "escalated"),
        (identity, say("merge", same=[1, 3]), "merged"), (identity, say("merge", same=[1, 1]), "escalated"), (identity, say("merge", same=[1, 4]), "escalated"), (quality, say("merge", same=[1, 3]), "escalated"),
        (revision, say("revise", revisions=[(5, [8]), (6, None)]), "revised"), (revision, say("revise", revisions=[(5, [7])]), "escalated"), (revision, say("revise", revisions=[(5, None), (5, None)]), "escalated"),
        (revision, say("revise"), "escalated"), (identity, say("revise", revisions=[(5, None)]), "escalated"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, item {item}, said {said}")
    got = {r.i: r.x for r in rows.select("i", review_outcome(F.col("item"), F.col("said")).alias("x")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
