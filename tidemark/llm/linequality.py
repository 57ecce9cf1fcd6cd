"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are counts of itself and of the lines before and after it; the
chain's two-by-two transitions tie neighbours together. The field is trained on labelled documents whose lines all take
the document's label, by gradient ascent of the conditional likelihood (forward-backward). A document's score is the
mean of its lines' marginal probabilities of good, weighted by the lines' lengths.

Training takes a bounded sample: at most MOST_TRAINED labelled documents, those of least hash of their key, so the choice
doesn't depend on the layout; of these, documents of more than MOST_LINES / 100 lines are left out, and the others are taken
as long as their lines are MOST_LINES at most together. Their line features are computed on the executors and only those
reach the driver: some 60 bytes a line. Scoring is a map over the rows of all documents and whole texts.

Null and empty texts are one empty line, which has a score like any line; very long texts are scored whole, in memory
proportional to the text. Labels without a document, and null labels, teach nothing; of several labels of a document the
largest counts; an empty table of labels, or labels of one kind only, teach nothing, and then every score is 0.5. Repeated
rows score alike; an empty table of documents gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

MOST_TRAINED, MOST_LINES = 4000, 200_000

#: Byte classes: 0 others, 1 small letters and beyond ASCII, 2 capitals, 3 digits, 4 symbols, 5 exclamation, 6 other
#: punctuation, 7 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _ch in b"#*$%&|<>^~=@_{}[]\\":
    _CLASS[_ch] = 4
_CLASS[ord("!")] = 5
for _ch in b".,;:?'\"()-/":
    _CLASS[_ch] = 6
for _ch in b" \t\n\r\x0b\x0c":
    _CLASS[_ch] = 7

OWN = 14
FEATURES = 3 * OWN + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features of a text's lines by themselves, and the lines' lengths in bytes (at least 1)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    codes = _CLASS[np.frombuffer(raw + b"\n", np.uint8)]
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    share = np.stack([np.add.reduceat(codes == c, starts, dtype=np.int64) for c in range(1, 7)], 1) / np.maximum(sizes, 1)[:, None]
    rest = np.empty((n, 5))
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        if k:
            again = sum(map(bytes.__eq__, words, words[1:])) / k if k > 1 else 0.0
            rest[i] = (k, len(set(words)) / k, again, line in seen, line.rstrip()[-1:] in b".!?:\"'")
            seen.add(line)
        else:
            rest[i] = (0, 1, 0, 0, 0)
    k = rest[:, 0]
    own = np.empty((n, OWN))
    own[:, :6] = share
    own[:, 6] = np.log1p(k)
    own[:, 7] = np.minimum(np.where(k > 0, sizes / np.maximum(k, 1), 0), 40) / 10
    own[:, 8:12] = rest[:, 1:]
    own[:, 12] = (share[:, 3] > 0.02) | (share[:, 4] > 0.05)
    own[:, 13] = share[:, 1] > 0.3
    return own, np.maximum(sizes, 1)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """(lines, FEATURES): the line before, the line itself, the line after; whether each of the two is missing; one."""
    n = len(own)
    out = np.zeros((n, FEATURES))
    out[1:, :OWN] = own[:-1]
    out[:, OWN : 2 * OWN] = own
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, -3] = out[-1, -2] = 1
    out[:, -1] = 1
    return out


@dataclass(frozen=True)
class Chain:
    """weights: the log-odds of good by the scaled features. moves: 2 x 2 scores from label to label (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def forward_backward(lifts: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For chains of log-odds of good: their marginals of good, the sums of pair marginals (2 x 2) and log-partitions.

    All chains step together, longest first, so that those still running are a prefix.
    """
    order = sorted(range(len(lifts)), key=lambda i: -len(lifts[i]))
    lengths = np.array([len(lifts[i]) for i in order])
    longest = int(lengths[0]) if len(lengths) else 0
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # chains longer than t
    offsets = np.concatenate([[0], np.cumsum(running)])
    flat = np.zeros(int(offsets[-1]))
    for k, i in enumerate(order):
        flat[offsets[: len(lifts[i])] + k] = lifts[i]
    push = np.exp(moves)
    alpha, before = np.empty((len(flat), 2)), None
    norm = np.array([np.maximum(lifts[i], 0).sum() for i in order])
    grow = np.stack([np.exp(-np.maximum(flat, 0)), np.exp(np.minimum(flat, 0))], 1)  # (1, e^x), scaled to at most 1
    for t in range(longest):
        r, a = running[t], offsets[t]
        now = grow[a : a + r] if before is None else (before[:r] @ push) * grow[a : a + r]
        total = now.sum(1)
        norm[:r] += np.log(total)
        before = alpha[a : a + r] = now / total[:, None]
    gamma, pairs, beta = np.empty(len(flat)), np.zeros((2, 2)), None
    for t in reversed(range(longest)):
        r, a = running[t], offsets[t]
        here = np.ones((r, 2))
        if beta is not None:
            after = len(beta)
            ahead = beta * grow[offsets[t + 1] : offsets[t + 1] + after]
            joint = alpha[a : a + after, :, None] * push[None] * ahead[:, None, :]
            pairs += (joint / joint.sum((1, 2))[:, None, None]).sum(0)
            here[:after] = ahead @ push.T
            here /= here.sum(1)[:, None]
        beta = here
        both = alpha[a : a + r] * beta
        gamma[a : a + r] = both[:, 1] / both.sum(1)
    out: list[np.ndarray] = [None] * len(lifts)  # type: ignore[list-item]
    z = np.empty(len(lifts))
    for k, i in enumerate(order):
        out[i], z[i] = gamma[offsets[: len(lifts[i])] + k], norm[k]
    return out, pairs, z


def train(chains: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum conditional likelihood with a quadratic penalty, by Adam. chains: the features of each document's lines.

    Each document counts as one however many lines it has: its gradient is divided by its number of lines.
    """
    every = np.concatenate(chains)
    mean, scale = every.mean(0), every.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (every - mean) / scale
    ends = np.cumsum([len(c) for c in chains])[:-1]
    y = np.repeat(np.array(labels, float), [len(c) for c in chains])
    per = np.repeat([1 / len(c) for c in chains], [len(c) for c in chains])
    steps = np.zeros((2, 2))
    for c, label in zip(chains, labels, strict=True):
        steps[label, label] += (len(c) - 1) / len(c)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        lifts = np.split(x @ w, ends)
        marginals, pairs, _ = forward_backward(lifts, moves)
        g = np.concatenate(marginals)
        total = max(pairs.sum(), 1e-9)
        gradient = np.concatenate([x.T @ ((y - g) * per), (steps - pairs * (steps.sum() / total)).ravel()]) / len(chains) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)  # labels of whole documents never change inside one; keep the chain able to
    return Chain(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, most_lines: int = MOST_LINES, key: str = "doc_id", text: str = "text", label: str = "quality") -> Chain | None:
    """A chain from labelled documents; None if labels of one of the two kinds are missing."""
    chosen = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_c")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_c"), "_c").limit(most)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = rows.join(F.broadcast(chosen), F.col("_k") == F.col("_c")).select("_k", "_label", "_t", F.size(F.split(F.coalesce("_t", F.lit("")), "\n", -1)).alias("_lines"))
    rows = rows.filter(F.col("_lines") <= max(most_lines // 100, 1))

    def make():
        return lambda keys, marks, texts: (keys, marks, [line_features(t)[0].astype(np.float32).tobytes() for t in texts])

    kind = docs.schema[key].dataType.simpleString()
    made = stored(map_rows(rows, ["_k", "_label", "_t"], make, f"_k {kind}, _label int, own binary"), "line-features")
    so_far = Window.orderBy(F.xxhash64("_k"), "_k", "own")  # over at most a few thousand rows
    made = made.withColumn("_so_far", F.sum(F.length("own")).over(so_far)).filter(F.col("_so_far") <= most_lines * OWN * 4)
    got = sorted(made.collect(), key=lambda r: (r["_k"], bytes(r["own"])))
    if len({r["_label"] for r in got}) < 2:
        return None
    return train([with_neighbours(np.frombuffer(bytes(r["own"]), np.float32).reshape(-1, OWN).astype(float)) for r in got], [r["_label"] for r in got])


def line_marginals(texts: list[str | None], chain: Chain) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its lines' marginals of good and lengths."""
    own = [line_features(t) for t in texts]
    marginals, _, _ = forward_backward([chain.emissions(with_neighbours(f)) for f, _ in own], chain.moves)
    return [(m, size) for m, (_, size) in zip(marginals, own, strict=True)]


def scored(docs: DataFrame, chain: Chain | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, n_lines and n_good (lines whose marginal is at least a half)."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def run(keys, texts):
            if chain is None:
                return keys, [0.5] * len(keys), [len((t or "").split("\n")) for t in texts], [0] * len(keys)
            both = line_marginals(texts, chain)
            return keys, [float(m @ size / size.sum()) for m, size in both], [len(m) for m, _ in both], [int((m >= 0.5).sum()) for m, _ in both]

        return run

    return map_rows(docs, [key, text], make, f"`{key}` {kind}, score double, n_lines bigint, n_good bigint")
