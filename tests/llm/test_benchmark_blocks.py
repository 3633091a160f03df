"""A benchmark of several blocks: one block in a stage at a time, and the same result as in one block."""

from palimpsest.llm import decontamination

SF = "/root/testdata/sf0.001"


def test_no_stage_has_two_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    made = []
    real = decontamination.cut

    def counted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made.append(plan.count("MapInArrow"))
        return real(df)

    monkeypatch.setattr(decontamination, "cut", counted)
    size = items.selectExpr("sum(octet_length(text))").first()[0]
    whole = decontamination.find_contamination(docs, items)
    parts = decontamination.find_contamination(docs, items, block_bytes=size // 5)
    assert len(made) == 6 and set(made) == {1} and parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(whole) == rows(parts) and any(r.items for r in whole.collect())


def test_longest_item_alone_in_its_block(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    items = spark.createDataFrame([(1, long), (2, "a b c d e f g h i j"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(500, 520)) + " y"), (2, "a b c d e f g h i j"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (list(r.hit_words), list(r["items"])) for r in decontamination.find_contamination(docs, items, block_bytes=6000).collect()}
    assert found == {1: ([20], ["1"]), 2: ([10], ["2"]), 3: ([], [])}
