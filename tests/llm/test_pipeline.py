"""The pipeline's stages, one after another, against their brute-force versions."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from tidemark.llm import neardup, quality

    from .test_llm import levenshtein, plain_em, slow_contamination, slow_counts, slow_line_drops, tiktoken_encoding

    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rules = quality.default_rules()
    cast = {i: quality.voted(rules)(t) for i, t in rows.items()}
    _, _, good = plain_em([tuple({"g": 1, "-": 0, "b": -1}[v] for v in c[-1]) for c in cast.values()], [r.kind for r in rules])
    kept = {}
    for (i, c), p in zip(cast.items(), good, strict=True):
        n, _, _, _, repeated = slow_counts(rows[i])
        assert c[:5] == slow_counts(rows[i])
        if n >= 50 and 2 * repeated <= n and p >= 0.5:
            kept[i] = rows[i]
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    drops = slow_line_drops(list(kept.items()), hashes)
    lined = {}
    for i, t in kept.items():
        gone = [k for k in range(len(t.split("\n"))) if (i, hashes[t], k) in drops]
        new = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or new.split():
            lined[i] = new
    ids = sorted(lined)
    root = {i: i for i in ids}
    words = {i: lined[i].split() for i in ids}
    for a, i in enumerate(ids):
        for j in ids[:a]:
            n = max(len(words[i]), len(words[j]))
            if abs(len(words[i]) - len(words[j])) <= (1 - neardup.SIMILARITY) * n and len(set(words[i]) & set(words[j])) >= 0.3 * len(set(words[i])):
                if levenshtein(words[i], words[j]) <= (1 - neardup.SIMILARITY) * n + 1e-9:
                    x, y = root[i], root[j]
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    firsts = {i: lined[i] for i in ids if root[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = {x[0] for x in slow_contamination(list(firsts.items()), items) if not x[2]}
    theirs = tiktoken_encoding()
    want = {i: theirs.encode_ordinary(firsts[i]) for i in clean}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, D).collect()}
    assert got == want and 0 < len(got) < len(rows)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, D)
        assert frame.columns == docs.columns


def test_odd_documents_go_through_the_pipeline(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and keys, clashing columns, and empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from .test_llm import ODD, prose, table

    long = [prose(k, 80) + "." for k in range(4)]
    odd = table(spark, [*ODD, *long, long[0], prose(9, 20_000), None, long[1]], [*range(len(ODD)), 20, 21, 22, 23, 24, 25, None, 21])
    odd = odd.withColumn("lang", F.when(F.col("doc_id") != 20, F.col("lang"))).withColumns({c: F.lit("clash") for c in ("_row", "_key", "votes", "tid", "n_tokens")})
    for k, docs in enumerate((odd, odd.filter("false"))):
        d = str(tmp_path / str(k))
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, long[2]), (None, None), (2, "")], "item_id bigint, text string").filter(F.lit(k == 0)).write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
        ids = sorted(r["doc_id"] for r in got.collect())
        assert ids == ([7, 20, 21, 23, 25] if k == 0 else [])


def test_near_dedup_of_what_meets_only_in_a_passage(spark, monkeypatch):
    """One of each class stays, though all buckets are wide and no bucket's end is near any other of its texts."""
    import random

    import corpus_pipeline
    from tidemark.llm import neardup

    from .test_llm import near_in_passages_only, table

    texts, least = near_in_passages_only(random.Random(14))
    star = neardup.star_pairs
    monkeypatch.setattr(neardup, "CROSS", 0)
    monkeypatch.setattr(neardup, "star_pairs", lambda rooted: star(rooted).filter("a < 0"))
    kept = corpus_pipeline.near_dedup(spark, table(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least))
