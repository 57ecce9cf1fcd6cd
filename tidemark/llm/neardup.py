"""Near-duplicate documents by order MinHash.

A text is its words (runs of anything but white space); its k-mers are runs of k words, each labelled with how often
the same k-mer came before. A sketch takes the two labelled k-mers of least hash and keeps them in the text's order, so
two texts agree in a sketch if the same k-mers are least in both and come in the same order: the odds follow the edit
similarity, not only the set of k-mers. Each sketch is a bucket. SKETCHES says how many there are of each k: those of
five words are selective; edits spread evenly at similarity 0.8 break every run of five words, so there are also some
of three. Two texts meet if they share a bucket. By simulation (tests/llm: recall by band) at least 0.98 of the pairs of
30 words and more meet at edit similarity 0.80, and more above it. Short texts, whose bound is at most SHORT edits, lie in
a bucket for each way to take out as many words: such texts within the bound always meet.

Equal texts are one node from the start (by a 128-bit hash); only one of them is sketched into buckets. Two texts are
linked if the edit distance of their words is at most (1 - similarity) of the longer one's words, which banded alignment
verifies after bounds that never lose a link (lengths; word counts in BINS bins, whose differences the edit distance
can't be below). Classes are the connected components of the links. Links are sought in rounds, so that a large group
costs what its size does and not the square of it: first a few buckets' texts are compared with their bucket's ends, then
all buckets' components with the ends' components, and last all pairs of a bucket whose texts are still in different
components. If those pairs are more than CROSS for each text of the bucket (many texts that share a passage and nothing
else), its texts are sketched again without the k-mers that CROSS of them share, and all pairs of these buckets, which hold
few texts each, are compared. What is still in different components then is met by its rarest words (see rarest): two texts
within the bound always share one of them, so this loses no link, and texts in which the passage is the lesser part are not
compared for its sake. So no bucket is capped, and every pair that meets is compared, already in one class, or beyond the
bounds.

Null and empty texts are equal: one class. Texts of fewer than k words have one k-mer, all their words. Very long texts
are sketched in blocks of bounded size; two of n words cost up to n times their bound to align. Repeated rows belong to
one class and each gives its row; of equal keys any row may stand for them in first_of_each. An empty table gives an
empty result. Which of two texts is the first of a pair never changes a class.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, give_back, joined, map_rows, materialise, packed, rows_of, short_batches, small, stored

#: How many sketches there are of each length of k-mers.
SKETCHES = {5: 24, 3: 48}
SIMILARITY = 0.8
#: Edits that short texts may be apart at most to meet for certain.
SHORT = 2
#: Bins of a text's word counts; texts of a bucket that are compared in one piece at most.
BINS, TILE = 512, 4096
#: Pairs of different components that a bucket may have for each of its texts to be compared as it is; texts that share a
#: k-mer from which on it counts as a passage.
CROSS = 1024
#: Texts that share a rare word from which on they are first compared with their bucket's ends only.
STAR = 64
#: One bucket in so many is looked at in the first round.
FIRST = 12
#: Pairs of one text from which on they are dealt to several tasks.
HOT = 2000
#: Buckets of a text that go with it to tell the pairs that come out of another bucket.
OWN = 256


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _seeds(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(k << 20, (k << 20) + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds, _mix(seeds) | np.uint64(1)


_SEEDS = {k: _seeds(k, n) for k, n in SKETCHES.items()}


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of a text's labelled k-mers, in its order, from those of its words."""
    with np.errstate(over="ignore"):
        n = max(1, len(hashes) - k + 1)
        grams = np.full(n, k, np.uint64)
        for j in range(min(k, len(hashes))):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
        grams = _mix(grams)
        ranked = np.sort(grams)
        if (ranked[1:] == ranked[:-1]).any():
            order = np.argsort(grams, kind="stable")
            new = np.ones(n, bool)
            new[1:] = ranked[1:] != ranked[:-1]
            at = np.arange(n)
            seen = np.empty(n, np.uint64)
            seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
            grams = np.where(seen > 0, _mix(grams + seen * np.uint64(0xD6E8FEB86659FD93)), grams)
        return grams


def sketch(grams: np.ndarray, k: int) -> np.ndarray:
    """The buckets of a text's labelled k-mers: of each sketch's two least ones, in the text's order.

    The order of a sketch is that of 32 bits of each k-mer's hash, mixed by one odd multiplier; at ties the earlier k-mer
    is less. The bucket's key is made of all 64.
    """
    seeds, odd = _SEEDS[k]
    n = len(grams)
    low, seeds32, odd32 = (grams >> np.uint64(16)).astype(np.uint32), seeds.astype(np.uint32), odd.astype(np.uint32)
    first, second = np.empty(len(seeds), np.int64), np.empty(len(seeds), np.int64)
    block = max(1, 4_000_000 // n)  # sketches at a time, for bounded memory on very long texts
    with np.errstate(over="ignore"):
        for at in range(0, len(seeds), block):
            h = low[None, :] ^ seeds32[at : at + block, None]
            h *= odd32[at : at + block, None]
            i = first[at : at + block] = h.argmin(1)
            if n > 1:
                h[np.arange(len(h)), i] = np.uint32(0xFFFFFFFF)
            second[at : at + block] = h.argmin(1)
        return _mix(_mix(grams[np.minimum(first, second)] ^ seeds) + grams[np.maximum(first, second)]).view(np.int64)


def buckets_of(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """All buckets of a text from the hashes of its words."""
    out = [x for k in SKETCHES for x in sketch(kmers(hashes, k), k).tolist()]
    return out + shortened(hashes, similarity)


def shortened(hashes: np.ndarray, similarity: float) -> list[int]:
    """Hashes of a short text less every choice of as many words as it may be from a text of its kind; else none."""
    n = len(hashes)
    # the bound is the longer text's, and a longer text of n + more words is at least that many edits away
    limits = [int(_limit(n + more, similarity)) for more in range(SHORT + 1)]
    d = max((x for more, x in enumerate(limits) if more <= x <= SHORT), default=0)
    if not d:
        return []
    ws, out = hashes.tolist(), set()
    for less in range(min(d, n) + 1):
        for kept in itertools.combinations(ws, n - less):
            out.add(xxhash.xxh3_64_intdigest(np.array(kept, np.uint64).tobytes(), 1))
    return [x - 2**64 if x >= 2**63 else x for x in out]


def bag(hashes: np.ndarray) -> bytes:
    """How many words fall into each of BINS bins, a byte a bin. Counts stop at 255, which only brings two bags nearer."""
    counts = np.bincount((hashes & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _limit(n: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """The most edits between texts of which the longer has n words."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance from two (arrays of) bags: the words of either that the other has no partner for."""
    most = np.maximum(a.sum(-1, dtype=np.int64), b.sum(-1, dtype=np.int64))
    return most - np.minimum(a, b).sum(-1, dtype=np.int64)


def _bags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _hasher():
    """Texts to the hashes of their words; words are remembered up to a bound."""
    known: dict[str, int] = {}

    def hashes_of(text: str | None) -> np.ndarray:
        if len(known) > 100_000:
            known.clear()
        ws = (text or "").split()
        hashes = [known.get(w) for w in ws]
        if None in hashes:
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[ws[i]] = xxhash.xxh3_64_intdigest(ws[i])
        return np.array(hashes, np.uint64)

    return hashes_of


def identity(text: str) -> list[Column]:
    """_h and _g: 128 bits of hash, by which texts are equal; null is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("_h"), F.xxhash64(whole, F.lit(1)).alias("_g")]


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each distinct text: _h, _g, tid (its number), n_words, bag, buckets array<bigint>; stored."""

    def make():
        hashes_of = _hasher()

        def run(h, g, texts):
            counts, keys, bags = [], [], []
            for t in texts:
                hashes = hashes_of(t)
                counts.append(len(hashes))
                keys.append(buckets_of(hashes, similarity))
                bags.append(bag(hashes))
            return h, g, counts, bags, keys

        return run

    rows = docs.select(*identity(text), F.col(text).alias("_t"))
    made = map_rows(rows, ["_h", "_g", "_t"], make, "_h bigint, _g bigint, n_words int, bag binary, buckets array<bigint>")
    firsts = made.groupBy("_h", "_g").agg(F.first("n_words").alias("n_words"), F.first("bag").alias("bag"), F.first("buckets").alias("buckets"))
    return stored(firsts.withColumn("tid", F.monotonically_increasing_id()), "sketches")


def meetings(made: DataFrame) -> DataFrame:
    """bucket, tid of the buckets with several texts; stored."""
    every = made.select("tid", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = materialise(every.groupBy("bucket").agg(F.min("tid").alias("_a"), F.max("tid").alias("_b")).filter("_a <> _b").select("bucket"))
    return stored(joined(every, shared, ["bucket"], "left_semi"), "meetings")


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """shared with root, the text's component."""
    if roots is None:
        return shared.withColumn("root", F.col("tid"))
    known = roots.withColumnRenamed("node", "tid")
    return joined(shared, known, ["tid"], "left").withColumn("root", F.coalesce("root", "tid"))


def star_pairs(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: each bucket's components with the components of its ends, four pairs of texts at most for two
    components, whatever their sizes. A component comes to its bucket with four of its texts at most, in one row."""
    mark = F.xxhash64("tid")
    some = F.array_distinct(F.array(F.min("tid"), F.max("tid"), F.min_by("tid", mark), F.max_by("tid", mark)))
    parts = materialise(rooted.groupBy("bucket", "root").agg(some.alias("_some")))
    ends = parts.groupBy("bucket").agg(F.min(F.struct("root", F.array_min("_some").alias("tid"))).alias("_a"), F.max(F.struct("root", F.array_max("_some").alias("tid"))).alias("_b")).filter("_a.root <> _b.root")
    met = joined(parts, materialise(ends), ["bucket"], "inner").select("_some", "root", F.explode(F.array("_a", "_b")).alias("_e")).filter("root <> _e.root")
    met = met.select("root", "_e", F.explode("_some").alias("tid"))
    pair = F.struct(F.least("tid", "_e.tid").alias("a"), F.greatest("tid", "_e.tid").alias("b"))
    met = met.select(F.least("root", "_e.root").alias("_x"), F.greatest("root", "_e.root").alias("_y"), pair.alias("_p"))
    mark = F.xxhash64("_p")
    few = met.groupBy("_x", "_y").agg(F.min("_p").alias("_0"), F.max("_p").alias("_1"), F.min_by("_p", mark).alias("_2"), F.max_by("_p", mark).alias("_3"))
    return few.select(F.explode(F.array_distinct(F.array("_0", "_1", "_2", "_3"))).alias("_p")).select("_p.a", "_p.b")


def within_bounds(pairs: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose lengths and bags allow a link; materialised."""

    def bounds(batches):
        for batch in batches:
            na, nb = batch.column("_na").to_numpy(), batch.column("_nb").to_numpy()
            ok = _apart(_bags(batch.column("_ba")), _bags(batch.column("_bb"))) <= _limit(np.maximum(na, nb), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: made.select(F.col("tid").alias(x), F.col("n_words").alias(f"_n{x}"), F.col("bag").alias(f"_b{x}"))
    near = F.least("_na", "_nb") >= F.lit(similarity) * F.greatest("_na", "_nb") - 1e-6
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(near)
    return materialise(both.select("a", "b", "_na", "_nb", "_ba", "_bb").mapInArrow(bounds, "a bigint, b bigint"))


def _tile(bucket, tids, root, n, chunk, bags, own, similarity):
    """Pairs of different components within the bounds; of different chunks, if there are two; in the least of the buckets
    that both share only, if it is known. own: a row's place -> the set of its least buckets."""
    order = np.argsort(n, kind="stable")
    tids, root, n, chunk, bags = tids[order], root[order], n[order], chunk[order], bags[order]
    # n less its limit never falls with n, so the partners of a text within the bound on lengths are a run
    end = np.searchsorted(n - _limit(n, similarity), n, "right")
    across = len(chunk) and chunk.min() != chunk.max()
    for k in range(len(n) - 1):
        for at in range(k + 1, end[k], TILE):
            to = min(at + TILE, end[k])
            fits = root[at:to] != root[k]
            if across:
                fits &= chunk[at:to] != chunk[k]
            j = np.flatnonzero(fits) + at
            if len(j):
                mine = None
                for x in j[_apart(bags[k], bags[j]) <= _limit(n[j], similarity)].tolist():
                    mine = mine or own(int(order[k]))
                    # the least shared one is in both sets, or they share none
                    if min(mine & own(int(order[x])), default=bucket) == bucket:
                        yield int(tids[k]), int(tids[x])


def _chunks(size: str) -> Column:
    return F.ceil(F.col(size) / TILE).cast("int").alias("_chunks")


def all_pairs(members: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, within the bounds, of texts that share a bucket of members (bucket, tid, root) and lie in
    different components; materialised.

    A bucket of m > TILE texts is cut into c = ceil(m / TILE) chunks, and each text goes to the c tiles of its chunk with
    every chunk, so no task holds a bucket whole. Texts carry the list of their OWN least buckets here, so that a pair comes
    out of one bucket only, but for texts of more buckets; distinct takes what comes twice. What goes with a text is joined
    to it once, before it is dealt to its buckets. Members whose buckets are counted already, and are of several components,
    have _chunks.
    """

    def run(batches):
        held = None

        def pairs(table):
            cols = [table.column(c).to_numpy() for c in ("tid", "root", "n_words", "_chunk")]
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "_lo", "_hi")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            bags, lists = _bags(table.column("bag").combine_chunks()), table.column("_own").combine_chunks()
            ends, held_in = lists.offsets.to_numpy(), lists.values.to_numpy()
            a, b = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True):
                if hi - lo > 1:
                    own = cache(lambda i, lo=lo: set(held_in[ends[lo + i] : ends[lo + i + 1]].tolist()))
                    for x, y in _tile(int(keys[0, lo]), *(c[lo:hi] for c in cols), bags[lo:hi], own, similarity):
                        a.append(min(x, y))
                        b.append(max(x, y))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "_lo", "_hi")])
            open_ = np.flatnonzero((keys != keys[:, -1:]).any(0))  # the last tile may go on in the next batch
            at = int(open_[-1]) + 1 if len(open_) else 0
            held = table.slice(at)
            if at:
                yield pairs(table.slice(0, at))
        if held is not None and held.num_rows:
            yield pairs(held)
        give_back()

    if "_chunks" not in members.columns:
        chunks = members.groupBy("bucket").agg(F.count("*").alias("_m"), F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r <> _s")
        chunks = materialise(chunks.select("bucket", _chunks("_m")))
        members = stored(joined(members, chunks, ["bucket"], "inner"), "compared")
    texts = members.groupBy("tid").agg(F.first("root").alias("root"), F.sort_array(F.collect_set(F.struct("bucket", "_chunks"))).alias("_in"))
    texts = texts.join(made.select("tid", "n_words", "bag"), "tid")
    own = F.slice(F.col("_in.bucket"), 1, OWN)
    place = lambda x: F.pmod(F.xxhash64("tid"), x["_chunks"]).cast("int")
    tiles = F.flatten(F.transform("_in", lambda x: F.transform(F.sequence(F.lit(0), x["_chunks"] - 1), lambda w: F.struct(x["bucket"].alias("bucket"), place(x).alias("_chunk"), w.alias("_with")))))
    members = texts.select("tid", "root", "n_words", "bag", own.alias("_own"), F.explode(tiles).alias("_tile")).select("*", "_tile.*")
    members = members.select("bucket", F.least("_chunk", "_with").alias("_lo"), F.greatest("_chunk", "_with").alias("_hi"), "tid", "root", "n_words", "_chunk", "bag", "_own")
    members = members.repartition("bucket", "_lo", "_hi").sortWithinPartitions("bucket", "_lo", "_hi")
    return materialise(members.mapInArrow(run, "a bigint, b bigint").distinct())


def without_passages(docs: DataFrame, made: DataFrame, wide: DataFrame, text: str, similarity: float) -> DataFrame:
    """bucket, tid, root for the texts of wide (tid, root), sketched without the k-mers that many of them share.

    A k-mer is left out from CROSS texts on; if those are too many to broadcast, from twice as many on, and so on. Texts
    that consist of such k-mers only keep one bucket, of all their k-mers together.
    """
    spark = docs.sparkSession
    texts = _texts(docs, made, wide.select("tid"), text)

    def count():
        hashes_of = _hasher()

        def run(tids, texts):
            every = [kmers(hashes_of(t), k) for t in texts for k in SKETCHES]
            grams, times = np.unique(np.concatenate(every), return_counts=True) if every else ((), ())
            return [x for x in np.asarray(grams, np.uint64).view(np.int64)], list(times)

        return run

    counted = materialise(map_rows(texts, ["tid", "text"], count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= CROSS))
    least = CROSS
    while not small(counted.filter(F.col("n") >= least), BROADCAST_ROWS):
        least *= 2
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in counted.filter(F.col("n") >= least).select("gram").toLocalIterator()], np.int64).view(np.uint64)))

    def again():
        hashes_of = _hasher()

        def run(tids, texts):
            out = []
            for t in texts:
                hashes, keys = hashes_of(t), []
                for k in SKETCHES:
                    grams = kmers(hashes, k)
                    at = np.searchsorted(hot.value, grams)
                    at[at == len(hot.value)] = 0
                    rest = grams[hot.value[at] != grams] if len(hot.value) else grams
                    keys += sketch(rest, k).tolist() if len(rest) else [int(np.bitwise_xor.reduce(grams).view(np.int64))]
                out.append(keys)
            return tids, out

        return run

    rows = stored(map_rows(texts, ["tid", "text"], again, "tid bigint, buckets array<bigint>"), "resketched")
    return joined(meetings(rows), materialise(wide.select("tid", "root")), ["tid"], "inner")


def rarest(hashes: np.ndarray, known: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """One more of a text's labelled words than it may be edits from a text of its kind or shorter, the rarest first.

    known (sorted) and times tell how often words come; others come less often. Two texts within the bound share all but
    the bound of the longer one's words, so, whatever the order, the first of the words that they share is among these of
    both: neither has more words of its own before it than its own bound (n less its limit never falls with n).
    """
    grams = kmers(hashes, 1)
    count = np.zeros(len(grams), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        count = np.where(known[at] == grams, times[at], 0)
    return grams[np.lexsort((grams, count))[: int(_limit(len(hashes), similarity)) + 1]]


def by_rarest(docs: DataFrame, made: DataFrame, wanted: DataFrame, text: str, similarity: float) -> DataFrame:
    """bucket, tid of the rarest words that several of the wanted texts (tid) share; stored.

    The order is by how many of the wanted texts have a word. Of the words that two have or more, or if those are too many
    to broadcast four or more, and so on, the counts are known; rarer ones are in the order of their hashes, which any two
    texts share as well.
    """
    spark = docs.sparkSession
    texts = _texts(docs, made, wanted, text)

    def count():
        hashes_of = _hasher()

        def run(texts):
            grams, times = np.unique(np.concatenate([kmers(hashes_of(t), 1) for t in texts]), return_counts=True)
            return [pa.array(grams.view(np.int64)), pa.array(times)]

        return run

    counted = materialise(map_rows(texts, ["text"], count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"))
    least = 2
    while not small(counted.filter(F.col("n") >= least), BROADCAST_ROWS):
        least *= 2
    listed = [(r["gram"], r["n"]) for r in counted.filter(F.col("n") >= least).toLocalIterator()]
    grams, times = np.array([x for x, _ in listed], np.int64).view(np.uint64), np.array([x for _, x in listed], np.int64)
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], times[order]))

    def rare():
        hashes_of = _hasher()

        def run(tids, texts):
            return tids, [rarest(hashes_of(t), *frequent.value, similarity).view(np.int64).tolist() for t in texts]

        return run

    return meetings(stored(map_rows(texts, ["tid", "text"], rare, "tid bigint, buckets array<bigint>"), "rarest"))


def among_wide(docs: DataFrame, made: DataFrame, wide: DataFrame, roots: DataFrame, tried: DataFrame, text: str, similarity: float) -> DataFrame:
    """roots after all links between texts of the buckets wide (bucket, tid); tried: pairs (a, b) compared before."""
    members = materialise(_rooted(wide, roots))
    mixed = materialise(members.groupBy("bucket").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r <> _s").select("bucket"))
    wanted = materialise(joined(members, mixed, ["bucket"], "left_semi").select("tid").distinct())
    if not rows_of(wanted):
        return roots
    shared = by_rarest(docs, made, wanted, text, similarity)
    large = materialise(shared.groupBy("bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > STAR).select("bucket"))
    if rows_of(large):
        ends = star_pairs(_rooted(joined(shared, large, ["bucket"], "left_semi"), roots)).join(tried, ["a", "b"], "left_anti")
        ends = within_bounds(materialise(ends), made, similarity)
        if rows_of(ends):
            roots, tried = merged(roots, verified(docs, made, ends, text, similarity)), tried.unionByName(ends)
    rest = all_pairs(materialise(_rooted(shared, roots)), made, similarity)
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"))
    return roots if not rows_of(rest) else merged(roots, verified(docs, made, rest, text, similarity))


def remaining(docs: DataFrame, made: DataFrame, rooted: DataFrame, text: str, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b), a < b, within the bounds, of texts of different components that share a bucket, and what is left to
    among_wide: bucket, tid of the wide buckets, if there are any; materialised."""
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").cast("double").alias("_n"))
    sizes = sizes.groupBy("bucket").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_n")).alias("_q"), F.count("*").alias("_c")).filter("_c > 1")
    mixed = materialise(sizes.select("bucket", _chunks("_m"), ((F.col("_m") * F.col("_m") - F.col("_q")) / 2 > F.col("_m") * CROSS).alias("_wide")))
    members = stored(joined(rooted, mixed, ["bucket"], "inner").select("bucket", "tid", "root", "_chunks", "_wide"), "mixed")
    pairs = all_pairs(members.filter("not _wide").drop("_wide"), made, similarity)
    wide = materialise(members.filter("_wide").select("tid", "root").distinct())
    if not rows_of(wide):
        return pairs, None
    more = all_pairs(without_passages(docs, made, wide, text, similarity), made, similarity)
    return materialise(pairs.unionByName(more).distinct()), members.filter("_wide").select("bucket", "tid")


def edit_within(a: Sequence, b: Sequence, limit: int) -> int | None:
    """The edit distance of two word lists if it is at most limit; only the diagonals within the band are followed.

    The band's column of differences from row to row is two bit strings (where it rises, where it falls), and a column
    follows from the one before in a dozen operations on whole integers (Hyyro's form of Myers' algorithm). As the band
    moves down a row with each column, its last bit is the lower edge, whose value is carried along; once that exceeds
    what the band's other edge can still give back, the texts are too far apart.
    """
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    long, short = sorted((a[head : len(a) - tail], b[head : len(b) - tail]), key=len, reverse=True)
    n, m = len(long), len(short)
    if n - m > limit:
        return None
    if not m:
        return n
    if limit >= n:  # at most n by replacing all
        near = edit_within(long, short, n - 1)
        return n if near is None else near
    places: dict = {}
    for i, word in enumerate(long):
        places[word] = places.get(word, 0) | 1 << i
    width = 2 * limit + 2
    every, top = (1 << width) - 1, 1 << (width - 1)
    rises, falls, edge, row_end = every & ~((1 << (width - limit - 1)) - 1), 0, limit, top >> 1
    hopeless, down = 2 * limit + m - n, n - limit
    for j, word in enumerate(short):
        at = limit + 1 - width + j
        same = places.get(word, 0)
        same = (same >> at if at >= 0 else same << -at) & every
        flat = ((((same & rises) + rises) ^ rises) | same | falls) & every
        up, back = falls | (every & ~(flat | rises)), flat & rises
        if j < down:
            edge += not flat & top
        else:  # the lower edge has met the last row and goes along it
            edge += (up & row_end > 0) - (back & row_end > 0)
            row_end >>= 1
        if edge > hopeless:
            return None
        flat >>= 1
        rises, falls = back | (every & ~(flat | up)), flat & up
    return edge if edge <= limit else None


def _texts(docs: DataFrame, made: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """tid, text of the wanted tids; stored."""
    wanted = materialise(made.select("tid", "_h", "_g").join(wanted.distinct(), "tid"))
    rows = joined(docs.select(*identity(text), F.col(text).alias("_t")), wanted, ["_h", "_g"], "inner")
    return stored(rows.groupBy("tid").agg(F.first(F.coalesce("_t", F.lit(""))).alias("text")), "texts")


def verified(docs: DataFrame, made: DataFrame, pairs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose texts are within the edit bound; materialised.

    A text of `a` comes once, before the texts of `b` that it is compared with; a text of many pairs is dealt to several
    tasks, on either side.
    """

    def check(batches):
        now, words = None, []
        for batch in batches:
            keep_a, keep_b = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for a, salt, b, t in zip(*(part.column(c).to_pylist() for c in ("a", "_salt", "b", "text")), strict=True):
                    if b is None:
                        now, words = (a, salt), t.split()
                        continue
                    if now != (a, salt):
                        raise AssertionError("a pair came without its first text")
                    other = t.split()
                    if edit_within(words, other, int(_limit(max(len(words), len(other)), similarity))) is not None:
                        keep_a.append(a)
                        keep_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(keep_a, pa.int64()), "b": pa.array(keep_b, pa.int64())})
        give_back()

    ends = [pairs.groupBy(F.col(c).alias("tid")).agg(F.count("*").alias("_n")) for c in ("a", "b")]
    nodes = materialise(ends[0].unionByName(ends[1]).groupBy("tid").agg(F.sum("_n").alias("_n")))
    texts = _texts(docs, made, nodes.select("tid"), text)
    hot = materialise(nodes.filter(F.col("_n") > HOT).select("tid", F.ceil(F.col("_n") / HOT).cast("int").alias("_c")))
    salted = lambda one, other: joined(pairs.withColumn("tid", F.col(one)), hot, ["tid"], "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_c", F.lit(1))).cast("int")).drop("_c")
    dealt = joined(texts, hot, ["tid"], "left").select("tid", "text", F.explode(F.sequence(F.lit(0), F.coalesce("_c", F.lit(1)) - 1)).alias("_salt"))
    asked = materialise(salted("a", "b").select("a", "_salt").distinct())
    first = joined(dealt.withColumnRenamed("tid", "a"), asked, ["a", "_salt"], "left_semi").select("a", "_salt", F.lit(None).cast("bigint").alias("b"), "text")
    count = F.col("_c")
    second = joined(salted("b", "a").join(dealt, ["tid", "_salt"]).select(F.col("a").alias("tid"), "b", "text"), hot, ["tid"], "left")
    second = second.select(F.col("tid").alias("a"), F.pmod(F.xxhash64("b"), F.coalesce(count, F.lit(1))).cast("int").alias("_salt"), "b", "text")
    rows = first.unionByName(second).repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    with short_batches(docs.sparkSession):
        return materialise(rows.mapInArrow(check, "a bigint, b bigint"))


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) for the nodes of links (a, b).

    Each round turns every node's larger neighbours, then its smaller ones, to the least node it knows; links become
    stars around the least node. Rounds go with the logarithm of the longest chain; nothing is collected but a count
    and a checksum.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, was = materialise(edges), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = joined(both, least, ["u"], "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        near = joined(large, least, ["u"], "inner")
        edges = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        edges = materialise(edges.observe(seen, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
        now = (rows_of(edges), seen.get["sum"])
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now
    raise RuntimeError("components did not settle")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links: those between components become links of their roots."""
    if roots is None:
        return components(links)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_r{c}"))
    both = joined(joined(links, materialise(of("a")), ["a"], "left"), materialise(of("b")), ["b"], "left")
    new = components(both.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")))
    moved = joined(roots.withColumnRenamed("root", "_old"), new.withColumnRenamed("node", "_old"), ["_old"], "left")
    moved = moved.select("node", F.coalesce("root", "_old").alias("root"))
    return materialise(moved.unionByName(new))  # a root is no node of its own, so none is there twice


def roots_of(docs: DataFrame, made: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """node, root for the texts (tid) that are linked to another; materialised."""
    shared = meetings(made)
    first = materialise(star_pairs(_rooted(shared.filter(F.pmod("bucket", F.lit(FIRST)) == 0), None)))
    tried = within_bounds(first, made, similarity)
    roots = merged(None, verified(docs, made, tried, text, similarity))
    second = materialise(star_pairs(_rooted(shared, roots)).join(first, ["a", "b"], "left_anti"))
    more = within_bounds(second, made, similarity)
    roots = merged(roots, verified(docs, made, more, text, similarity))
    rest, wide = remaining(docs, made, _rooted(shared, roots), text, similarity)
    tried = tried.unionByName(more)
    rest = materialise(rest.join(tried, ["a", "b"], "left_anti"))
    if rows_of(rest):
        roots = merged(roots, verified(docs, made, rest, text, similarity))
    return roots if wide is None else among_wide(docs, made, wide, roots, tried.unionByName(rest), text, similarity)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: key, class_id (the least key of its class) and class_size (rows)."""
    made = sketches(docs, key, text, similarity)
    roots = roots_of(docs, made, text, similarity)
    ids = made.select("tid", "_h", "_g")
    named = roots.join(ids.withColumnRenamed("tid", "node"), "node").join(ids.select(F.col("tid").alias("root"), F.col("_h").alias("_rh"), F.col("_g").alias("_rg")), "root")
    named = materialise(named.select("_h", "_g", "_rh", "_rg"))
    rows = joined(docs.select(F.col(key).alias("_key"), *identity(text)), named, ["_h", "_g"], "left")
    rows = stored(rows.select("_key", F.coalesce("_rh", "_h").alias("_h"), F.coalesce("_rg", "_g").alias("_g")), "roots")
    groups = materialise(rows.groupBy("_h", "_g").agg(F.min("_key").alias("_least"), F.count("*").alias("_size")).filter("_size > 1"))
    out = joined(rows, groups, ["_h", "_g"], "left")
    return out.select(F.col("_key").alias(key), F.coalesce("_least", "_key").alias("class_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("class_size"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, that of its least key, all columns as they are."""
    found = classes(docs, key, text, similarity)
    later = materialise(found.filter(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_k")).distinct())
    again = found.filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy(key).count().filter("count > 1").select(F.col(key).alias("_k"))
    again = materialise(again)
    kept = joined(packed(docs, _k=F.col(key)), later, ["_k"], "left_anti")
    if rows_of(again):  # rows that share a key as well as a class
        once = joined(kept, again, ["_k"], "left_anti")
        kept = once.unionByName(joined(kept, again, ["_k"], "left_semi").dropDuplicates(["_k"]))
    return kept.select("_row.*")
