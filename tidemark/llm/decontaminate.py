"""Benchmark decontamination by winnowing.

Of every run of W consecutive k-grams of words the one of least hash is a fingerprint (the leftmost at ties). Two texts
that share N = W + k - 1 words in a row share such a run, and so a fingerprint at the same place in it. With k = 5 and
W = 6 every shared span of N = 10 words is found: fingerprints of both sides are joined, and each hit is extended to
the windows of N words around it, which are compared word by word. An item of fewer than N words is one window; its
length is looked for as it is (lengths below N are at most N - 1, so at most that many kinds).

DataFrame functions only. The benchmark's fingerprints are broadcast if a count finds them within `most_broadcast` rows;
otherwise fingerprints are shuffled and only documents with hits are read again. Null texts have no words; documents
without words have no hits; repeated rows give a row each; items that share an id count as one item,
and so do those whose id is null, which is counted but not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, lowered, materialise, once, packed, small

K, W = 5, 6
N = K + W - 1
#: Rows of the benchmark's fingerprints that are broadcast at most; a row holds at most 2 N words, and their characters are
#: counted as well (common.BROADCAST_WEIGHT).
MOST_BROADCAST = 50_000


def item_words(text: Column) -> Column:
    """A-Z lower-cased; runs of digits, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _hashed(rows: DataFrame) -> DataFrame:
    """rows, which have _words, with _w: a hash of each word."""
    return once(rows, "_w", F.transform("_words", lambda x: F.xxhash64(x)))


def _windows(rows: DataFrame, keep: list[str], none: bool = False) -> DataFrame:
    """A row for each run of N words: keep, _s (where it begins), _at (its fingerprint's place) and _h.

    Everything beyond the word hashes is plain column arithmetic on the position, so it stays inside generated code
    and a wide column in `keep` is copied only into rows that survive what follows. none: also a row with _s = -1 and
    no fingerprint for each input row.
    """
    size = F.size("_w")
    starts = F.sequence(F.lit(-1), size - N) if none else F.sequence(F.lit(0), size - N)
    at = F.when(size >= N, starts).otherwise(F.array(F.lit(-1)) if none else F.array().cast("array<int>"))
    rows = rows.select(*keep, "_w", F.explode(at).alias("_s"))
    gram = lambda j: F.xxhash64(*[F.get("_w", F.col("_s") + (j + i)) for i in range(K)])
    rows = rows.select(*keep, "_s", *[F.when(F.col("_s") >= 0, gram(j)).alias(f"_g{j}") for j in range(W)])
    rows = rows.withColumn("_h", F.least(*[f"_g{j}" for j in range(W)]))
    place = F.lit(W - 1)
    for j in reversed(range(W - 1)):
        place = F.when(F.col(f"_g{j}") == F.col("_h"), j).otherwise(place)
    return rows.select(*keep, "_s", (F.col("_s") + place).alias("_at"), "_h")


def benchmark_prints(items: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """_n, _h, _item, _q (the fingerprint's place) and _near (up to N - K words before it and N after); short lengths."""
    rows = once(items.select(F.col(item).cast("string").alias("_item"), F.col(text).alias("_t")), "_words", item_words(F.col("_t"))).drop("_t")
    rows = materialise(_hashed(rows.filter(F.size("_words") > 0)))
    short = sorted(r[0] for r in rows.select(F.size("_words").alias("n")).filter(F.col("n") < N).distinct().collect())
    prints = _windows(rows, ["_item", "_words"]).select(F.lit(N).alias("_n"), "_h", "_item", F.col("_at").alias("_q"), "_words")
    if short:
        few = rows.filter(F.size("_words") < N)
        prints = prints.unionByName(few.select(F.size("_words").alias("_n"), F.xxhash64("_w").alias("_h"), "_item", F.lit(0).alias("_q"), "_words"))
    low = F.greatest(F.col("_q") - (N - K), F.lit(0))
    near = F.slice("_words", low + 1, F.col("_q") + N - low)
    return materialise(prints.select("_n", "_h", "_item", (F.col("_q") - low).alias("_q"), near.alias("_near")).distinct()), short


def _equal(n: Column) -> Column:
    """Whether the n document words from _s on are those of the item around its fingerprint, word by word."""
    u = F.col("_q") - (F.col("_at") - F.col("_s"))
    same = F.slice("_words", F.col("_s") + 1, n) == F.slice("_near", F.greatest(u, F.lit(0)) + 1, n)
    return (u >= 0) & (u + n <= F.size("_near")) & same


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """_key, _hash (of the text), _n_words, _copies (rows with that key and text), _spans (array of start, end), _items, _unnamed (1 if an item
    without an id is among the hits)."""
    prints, short = benchmark_prints(items, item, text)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    rows = once(rows, "_words", item_words(F.col("_t"))).withColumns({"_hash": F.xxhash64("_t"), "_n_words": F.size("_words").cast("bigint")}).drop("_t")
    rows = _hashed(rows)
    of, out = ["_key", "_hash", "_n_words"], [*["_key", "_hash", "_n_words"], "_row", "_n", "_s", "_item"]

    def short_windows(n: int, keep: list[str]) -> DataFrame:
        spread = rows.filter(F.size("_w") >= n).select(*keep, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - n)).alias("_s"))
        return spread.select(*keep, "_s", F.col("_s").alias("_at"), F.xxhash64(F.slice("_w", F.col("_s") + 1, F.lit(n))).alias("_h"))

    whole = prints.filter(F.col("_n") == N).drop("_n").withColumnRenamed("_h", "_ph")
    if small(prints, most_broadcast, F.char_length(F.array_join("_near", ""))):
        met = _windows(rows, [*of, "_words"], none=True).join(F.broadcast(whole), F.col("_h") == F.col("_ph"), "left")
        met = met.filter((F.col("_s") < 0) | (F.col("_ph").isNotNull() & _equal(F.lit(N))))
        found = met.select(*of, (F.col("_s") < 0).cast("bigint").alias("_row"), F.lit(N).alias("_n"), "_s", "_item")
        for n in short:
            few = prints.filter(F.col("_n") == n).drop("_n").withColumnRenamed("_h", "_ph")
            met = short_windows(n, [*of, "_words"]).join(F.broadcast(few), F.col("_h") == F.col("_ph")).filter(_equal(F.lit(n)))
            found = found.unionByName(met.select(*of, F.lit(0).cast("bigint").alias("_row"), F.lit(n).alias("_n"), "_s", "_item"))
    else:
        flat = _windows(rows, ["_key", "_hash"]).select("_key", "_hash", F.lit(N).alias("_n"), "_at", "_h").distinct()
        for n in short:
            flat = flat.unionByName(short_windows(n, ["_key", "_hash"]).select("_key", "_hash", F.lit(n).alias("_n"), "_at", "_h"))
        met = materialise(flat.join(prints, ["_n", "_h"]).drop("_h").withColumnsRenamed({"_key": "_mk", "_hash": "_mh"}))
        marked = materialise(met.select(F.col("_mk").alias("_key"), F.col("_mh").alias("_hash")).distinct())
        seen = joined(rows.drop("_w"), marked, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"])
        pairs = seen.join(met, F.col("_key").eqNullSafe(F.col("_mk")) & F.col("_hash").eqNullSafe(F.col("_mh")))
        back = F.when(F.col("_n") == N, F.sequence(F.greatest(F.col("_at") - (N - K), F.lit(0)), F.col("_at"))).otherwise(F.array("_at"))
        pairs = pairs.withColumn("_s", F.explode(back)).filter((F.col("_s") + F.col("_n") <= F.size("_words")) & _equal(F.col("_n")))
        found = pairs.select(*of, F.lit(0).cast("bigint").alias("_row"), "_n", "_s", "_item")
        none = F.lit(None)
        found = found.unionByName(rows.select(*of, F.lit(1).cast("bigint").alias("_row"), none.cast("int").alias("_n"), none.cast("int").alias("_s"), none.cast("string").alias("_item")))
    span = F.when(F.col("_row") == 0, F.struct(F.col("_s").alias("start"), (F.col("_s") + F.col("_n")).alias("end")))
    return found.select(*out[:4], span.alias("_span"), "_item").groupBy(*of).agg(
        F.sum("_row").alias("_copies"), F.array_sort(F.collect_set("_span")).alias("_spans"), F.array_sort(F.collect_set("_item")).alias("_items"),
        F.max(((F.col("_row") == 0) & F.col("_item").isNull()).cast("int")).alias("_unnamed"),
    )


def covered(spans: Column) -> Column:
    """The number of words inside sorted spans."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("sum"))
    return F.aggregate(spans, zero, step)["sum"]


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row for each row of docs: key, n_words, n_hit, n_items, items, spans, contaminated."""
    found = hits(docs, items, key, text, item, most_broadcast)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    n_hit = covered(F.col("_spans"))
    return found.select(
        F.col("_key").alias(key), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), (F.size("_items") + F.col("_unnamed")).cast("bigint").alias("n_items"),
        F.col("_items").alias("items"), F.col("_spans").alias("spans"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """docs without the rows that share a window with an item, all columns as they are."""
    found = materialise(hits(docs, items, key, text, item).filter(F.size("_spans") > 0).select(F.col("_key"), F.col("_hash")))
    rows = packed(docs, _key=F.col(key), _hash=F.xxhash64(text))
    return joined(rows, found, ["_key", "_hash"], "left_anti").select("_row.*")
