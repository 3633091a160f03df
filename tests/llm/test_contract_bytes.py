"""op10 on passages of over 50 words: what its contract removes follows bytes, not words."""

import hashlib
import random

import __spark_entry__


def _passage(rng, words, size):
    """So many words in so many bytes, none of which another passage has."""
    cuts = sorted(rng.sample(range(1, size - words + 1), words - 1))
    sizes = [b - a for a, b in zip([0, *cuts], [*cuts, size - words + 1])]
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in sizes)


def test_op10_on_passages_about_400_bytes(spark, tmp_path):
    """60 words of 399 bytes stay in both texts, 60 words of 400 bytes go from both; columns are in the contract's order."""
    rng = random.Random(11)
    short, long = _passage(rng, 60, 399), _passage(rng, 60, 400)
    assert (len(short), len(long)) == (399, 400) and len(short.split()) == len(long.split()) == 60
    own = lambda: _passage(rng, 40, 500)
    # The bytes beside a passage differ, so that no string goes beyond it.
    parts = {1: (own() + "q", short, "q" + own()), 2: (own() + "r", short, "r" + own()), 3: (own() + "s", long, "s" + own()), 4: (own() + "t", long, "t" + own())}
    rows = [(d, "".join(p)) for d, p in parts.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["op10_suffix_dedup"](spark, str(tmp_path))
    kept = {d: "".join(p) if d < 3 else p[0] + p[2] for d, p in parts.items()}
    want = {(d, len(t), len(t) - len(kept[d]), int(d >= 3), hashlib.sha256(kept[d].encode()).hexdigest()) for d, t in rows}
    assert {tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
