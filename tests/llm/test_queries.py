"""The registered queries on the driver's smallest tables against plain versions of their contracts."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm import queries, urls

from .test_llm import WORDS, levenshtein, slow_counts, slow_line_drops, tiktoken_encoding

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows.collect()}


def test_op1(spark, texts):
    got = by_id(queries.op1_pseudonyms(spark, D))
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r["text"] == texts[i]) == (r["n_found"] == 0) and len(r["spans"]) == r["n_found"]


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    t, got, at = Tokenizer.from_file(WORDS), by_id(queries.op2_token_shards(spark, D)), 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op3(spark, texts):
    theirs, got = tiktoken_encoding(), by_id(queries.op3_bpe(spark, D))
    for i, t in texts.items():
        ids = theirs.encode_ordinary(t)
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op4(spark, texts):
    got = by_id(queries.op4_quality_rules(spark, D))
    for i, t in texts.items():
        n, *rest = slow_counts(t)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (n, *rest)
        failed = n < 50 or 2 * rest[-1] > n
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and got[i]["p_good"] >= 0.5)
    outvoted = [r for r in got.values() if "b" in r["votes"] and r["kept"]]
    assert outvoted and any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_op6(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    rules = [("net", "/", "net/", "block"), ("example.net", "/en/", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow")]
    for i, r in by_id(queries.op6_url_filter(spark, D), "page_id").items():
        host, path = urls.split_url(pages[i])
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[2]), default=(None, None, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best[2:])


def test_op7(spark, texts):
    got = by_id(queries.op7_order_minhash(spark, D))
    words, root = {i: t.split() for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            n = max(len(words[i]), len(words[j]))
            if j < i and root[i] != root[j] and abs(len(words[i]) - len(words[j])) <= 0.2 * n and len(set(words[i]) & set(words[j])) >= 0.5 * len(set(words[i])) - 1 and levenshtein(words[i], words[j]) <= 0.2 * n + 1e-9:
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {i: r["class_id"] for i, r in got.items()} == root
    assert all(r["class_size"] == sum(v == root[i] for v in root.values()) for i, r in got.items())


def test_op8(spark, texts):
    got = by_id(queries.op8_line_crf(spark, D))
    assert got.keys() == texts.keys()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [i for i in quality if got.get(i) and got[i]["held_out"] and quality[i] is not None]
    assert sum(got[i]["predicted"] == quality[i] for i in held) >= 0.9 * len(held)


def test_op9(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{D}/documents.parquet")
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    drops = slow_line_drops(list(texts.items()), hashes)
    for i, r in by_id(queries.op9_line_dedup(spark, D)).items():
        lines = texts[i].split("\n")
        kept = [x for k, x in enumerate(lines) if (i, hashes[texts[i]], k) not in drops]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_op10(spark, texts):
    got = by_id(queries.op10_hilbert(spark, D))
    shards = {}
    for i, t in texts.items():
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None)
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and P.PATTERN
