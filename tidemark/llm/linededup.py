"""Line dedup across documents: a line goes if an earlier line that stays is equal or within one word of it.

Lines are compared as their words, A-Z lower-cased; every line with `min_words` words or more takes part. From `near_words`
words on (one word in ten at most), a line also goes if it differs from an earlier line that stays by one word put in,
taken out or replaced. Earlier means a lower key, then text hash, then line number; so lines are decided in that order, and
a chain of lines, each near the one before, loses only those near one that stays.

The deletion neighbourhood: a line within one edit of another equals it once at most one word of each is deleted. Every
variant is a key of 128 bits, made in constant time: the exclusive or of hashes of each word with its place, of the words
before the deleted one and, a place further left, of those after it. With the place of the deletion in the key, lines that
meet replace the same word, so all of a key's lines are within one edit of each other; a line with a word more meets the
shorter one where its variant is the other's whole. Only lines that can have a neighbour make variants: of two lines within
one edit, the first or the last half of the shorter is whole in the other, so lines that share no half-line key are left
out. Which lines stay is found in rounds over the keys, not over pairs: in each, the lines that come first in all their keys
stay, and what shares a key with them goes. What goes is verified word by word against the line that it goes for.

DataFrame functions only. Costs are in proportion to the words of lines, very long ones included. Equal lines meet by 128
bits of hash. Null text counts as empty and stays null; rows with equal key and text count as one document and are treated
alike; ties cannot be, as no two lines share key, text and number; an empty table gives an empty result; other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, lowered, materialise, once, packed, rows_of, stored, words

ORDER, LINE, GROUP = ("_key", "_hash", "_pos"), ["_a", "_b"], ["_v", "_u", "_i"]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identified(rows: DataFrame, line: Column) -> DataFrame:
    """rows with _w, the hashes of a line's words, and LINE, 128 bits of hash of the words."""
    rows = once(rows, "_words", words(lowered(line)))
    flat = F.concat_ws(" ", "_words")
    return rows.withColumns({"_w": F.transform("_words", lambda x: F.xxhash64(x)), "_a": F.xxhash64(flat), "_b": F.xxhash64(flat, F.lit(1))}).drop("_words")


def _halves(w: Column, n: Column) -> Column:
    """Keys of the first and the last half for a shorter line of n words and of n - 1 words."""
    out = []
    for less in (0, 1):
        size = n - less
        half = F.expr(f"(_n - {less}) div 2").cast("int")
        out += [F.xxhash64(F.lit(0), size, F.slice(w, 1, half)), F.xxhash64(F.lit(1), size, F.slice(w, n - half + 1, half))]
    return F.array(*out)


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, near_words: int = 10) -> DataFrame:
    """_key, _hash and _drop, the numbers of the lines that go, for documents that lose any; materialised."""
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.posexplode(_split(F.col(text))).alias("_pos", "_line"))
    rows = once(_identified(rows, F.col("_line")).drop("_line"), "_x", F.col("_w")).drop("_w").withColumnRenamed("_x", "_w")
    rows = rows.withColumn("_n", F.size("_w")).filter(F.col("_n") >= min_words)
    halves = F.when(F.col("_n") >= near_words, _halves(F.col("_w"), F.col("_n")))
    lines = stored(rows.select(*ORDER, *LINE, halves.alias("_halves")), "lines")
    one = F.struct(*ORDER)
    firsts = lines.groupBy(*LINE).agg(F.min(F.struct(one.alias("o"), F.col("_halves").alias("h"))).alias("_m"), F.count("*").alias("_times"))
    distinct = stored(firsts.select(*LINE, F.col("_m.o").alias("_first"), F.col("_m.h").alias("_halves"), "_times"), "distinct-lines")
    near = _near(docs, distinct, key, text)
    marks = joined(distinct.select(*LINE, "_first", "_times"), near.withColumn("_near", F.lit(True)), LINE, "left").filter("_times > 1 or _near")
    marks = materialise(marks.select(*LINE, "_first", F.coalesce("_near", F.lit(False)).alias("_near")))
    gone = joined(lines.drop("_halves"), marks, LINE, "inner").filter(F.col("_near") | ~F.col("_first").eqNullSafe(one))
    return materialise(gone.groupBy("_key", "_hash").agg(F.collect_set("_pos").alias("_drop")))


def _able(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _o (where it comes first), LINE, _w of the distinct lines that share a half-line key with another, the key _v, _u
    of the whole and _v1, _u1, the same with each word a place further left; stored."""
    keyed = distinct.filter("_halves is not null").select(*LINE, "_first", F.explode(F.array_distinct("_halves")).alias("_half"))
    shared = keyed.groupBy("_half").agg(*[f(c).alias(f"{c}{n}") for c in LINE for f, n in ((F.min, 0), (F.max, 1))])
    shared = materialise(shared.filter("_a0 <> _a1 or _b0 <> _b1").select("_half"))
    able = materialise(joined(keyed, shared, ["_half"], "left_semi").select(*LINE, "_first").distinct())
    # their words, from the documents where they come first
    places = materialise(able.groupBy("_first._key", "_first._hash").agg(F.collect_set("_first._pos").alias("_at")))
    held = joined(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_t")), places, ["_key", "_hash"], "inner", F.size("_at"))
    held = held.select("_key", "_hash", "_at", F.posexplode(_split(F.col("_t"))).alias("_pos", "_l")).filter(F.array_contains("_at", F.col("_pos")))
    held = _identified(held.select(*ORDER, "_l"), F.col("_l"))

    def folded(seed: int, left: int) -> Column:
        tagged = F.transform("_w", lambda x, i: F.xxhash64(x, i - left, F.lit(seed)))
        return F.aggregate(tagged, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))

    held = held.select(F.struct(*ORDER).alias("_o"), *LINE, "_w").dropDuplicates(LINE).withColumn("_id", F.monotonically_increasing_id())
    return stored(held.withColumns({"_v": folded(0, 0), "_u": folded(1, 0), "_v1": folded(0, 1), "_u1": folded(1, 1)}), "near-lines")


def _variants(held: DataFrame) -> DataFrame:
    """_id, _o and the key _v, _u of each variant, with _at, the place of the deleted word; stored."""
    rows = held.select("_id", "_o", "_v1", "_u1", F.posexplode("_w").alias("_at", "_x"))
    by = Window.partitionBy("_id").orderBy("_at")
    before, so_far = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)

    def key(seed: int, all_left: str) -> Column:
        head = F.coalesce(F.bit_xor(F.xxhash64("_x", "_at", F.lit(seed))).over(before), F.lit(0).cast("bigint"))
        return head.bitwiseXOR(F.bit_xor(F.xxhash64("_x", F.col("_at") - 1, F.lit(seed))).over(so_far)).bitwiseXOR(F.col(all_left))

    return stored(rows.select("_id", "_o", "_at", key(0, "_v1").alias("_v"), key(1, "_u1").alias("_u")), "variants")


def _memberships(whole: DataFrame, variants: DataFrame) -> DataFrame:
    """GROUP, _id, _o, _at, _mid: who can have a neighbour in which group; stored.

    _i >= 0: lines that differ in the word at _i alone, all near each other. _i = -1: a line (_mid) and those with a word
    more, at _at, near it but not always each other.
    """
    several = materialise(variants.groupBy("_v", "_u", "_at").agg(F.count("*").alias("_k")).filter("_k > 1").drop("_k"))
    same = joined(variants, several, ["_v", "_u", "_at"], "left_semi").select("_v", "_u", F.col("_at").alias("_i"), "_id", "_o", "_at", F.lit(False).alias("_mid"))
    middles = materialise(whole.select("_v", "_u"))
    more = joined(variants, middles, ["_v", "_u"], "left_semi").groupBy("_v", "_u", "_id", "_o").agg(F.min("_at").alias("_at"))
    more = stored(more.select("_v", "_u", F.lit(-1).alias("_i"), "_id", "_o", "_at", F.lit(False).alias("_mid")), "longer")
    taken = materialise(more.select("_v", "_u").distinct())
    mid = joined(whole, taken, ["_v", "_u"], "left_semi").select("_v", "_u", F.lit(-1).alias("_i"), "_id", "_o", F.lit(-1).alias("_at"), F.lit(True).alias("_mid"))
    return stored(same.unionByName(more).unionByName(mid), "memberships")


def _near(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """LINE of the distinct lines that go for an earlier one that stays, within one edit; materialised."""
    held = _able(docs, distinct, key, text)
    left, lost = _memberships(held.select("_id", "_o", "_v", "_u"), _variants(held)), None
    while True:
        first = lambda mid: F.min(F.when(F.col("_mid") == mid, F.col("_o")))
        lows = left.groupBy(*GROUP).agg(first(True).alias("_m"), first(False).alias("_l"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
        # in a group, whoever has an earlier neighbour there waits
        waits = F.when(F.col("_mid") | (F.col("_i") >= 0), F.col("_l")).otherwise(F.col("_m")) < F.col("_o")
        left = joined(left, materialise(lows), GROUP, "inner").withColumn("_waits", F.coalesce(waits, F.lit(False))).drop("_m", "_l")
        left = stored(left, "undecided")
        waiting = materialise(left.filter("_waits").select("_id").distinct())
        if not rows_of(waiting):
            break
        stay = joined(left.filter("not _waits"), waiting, ["_id"], "left_anti")
        stay = materialise(stay.select(*GROUP, F.col("_mid").alias("_wm"), F.col("_at").alias("_wa"), F.col("_id").alias("_for")))
        met = joined(left.select(*GROUP, "_mid", "_at", "_id"), stay, GROUP, "inner").filter("_id <> _for and (_i >= 0 or _mid <> _wm)")
        how = F.when(F.col("_i") >= 0, F.lit("replaced")).when(F.col("_mid"), F.lit("shorter")).otherwise(F.lit("longer"))
        goes = materialise(met.select("_id", F.struct("_for", how.alias("_how"), F.when(F.col("_mid"), F.col("_wa")).otherwise(F.col("_at")).alias("_at")).alias("_hit")).groupBy("_id").agg(F.min("_hit").alias("_hit")))
        lost = goes if lost is None else materialise(lost.unionByName(goes))
        decided = materialise(goes.select("_id").unionByName(stay.select(F.col("_for").alias("_id"))).distinct())
        left = joined(left.drop("_waits"), decided, ["_id"], "left_anti")
    if lost is None:
        return materialise(held.select(*LINE).limit(0))
    cut = lambda w, i: F.concat(F.slice(w, 1, i), F.slice(w, i + 2, F.size(w)))
    pairs = lost.select("_id", "_hit.*").join(held.select("_id", *LINE, "_w"), "_id").join(held.select(F.col("_id").alias("_for"), F.col("_w").alias("_x")), "_for")
    w, x, i = F.col("_w"), F.col("_x"), F.col("_at")
    right = F.when(F.col("_how") == "replaced", (F.size(w) == F.size(x)) & (cut(w, i) == cut(x, i))).when(F.col("_how") == "longer", cut(w, i) == x).otherwise(w == cut(x, i))
    return materialise(pairs.filter(right).select(*LINE))


def _cleaned(docs: DataFrame, key: str, text: str, min_words: int, near_words: int) -> DataFrame:
    """_row (docs' columns), _text (its kept lines), _n_lines, _n_dropped. Texts stay where they are while the drop lists
    are small."""
    gone = dropped(docs, key, text, min_words, near_words)
    rows = joined(packed(docs, _key=F.col(key), _hash=F.xxhash64(text), _text=F.col(text)), gone, ["_key", "_hash"], "left", F.size("_drop"))
    lines = _split(F.col("_text"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drop", i)), "\n")
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept)
    return rows.select("_row", kept.alias("_text"), F.size(lines).alias("_n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).alias("_n_dropped"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, near_words: int = 10) -> DataFrame:
    """docs with the text's kept lines, and n_lines and n_dropped in the place of columns so named."""
    out = _cleaned(docs, key, text, min_words, near_words)
    old = [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*old, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", min_words: int = 1, near_words: int = 10) -> DataFrame:
    """docs without their repeated lines, columns as they were (chars recounted); documents left without a word go."""
    out = _cleaned(docs, key, text, min_words, near_words)
    out = out.filter((F.col("_n_dropped") == 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {text: F.col("_text")}
    if chars in docs.columns:
        fresh[chars] = F.when(F.col("_n_dropped") == 0, F.col(f"_row.`{chars}`")).otherwise(F.char_length("_text").cast(docs.schema[chars].dataType))
    return out.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
