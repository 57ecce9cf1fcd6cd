"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes good, bad or abstains. Expectation-maximisation over all documents' votes
estimates the share of good documents and, for each rule that votes, how often it votes bad on good and on bad documents;
a vote then moves a document's odds by the ratio of the two rates, and a document stays if its posterior probability of
being good reaches a threshold. So one bad vote can be outvoted, and a rule that votes at random weighs nothing.

What is believed before any vote is seen counts as WEIGHT documents for each rate, so it fades as documents are counted.
Documents enter the estimate only through the number of times each combination of votes occurs: at most 3^rules rows
reach the driver, however many documents there are, and the combinations' posteriors go back as a table of the same size.
The counts of each text are taken once and stored as a narrow table, which both the estimate and the result read.

Words are runs of anything but ASCII white space. Null text has no words and, like an empty one, fails the base rule.
Very long texts are counted whole, in memory proportional to the text. Repeated rows are judged alike, ties in the
posterior too; a row's other columns, whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_rows, packed, stored

#: The symbols that are counted, and the ends of a sentence.
SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", ":", '"', "”", "…")
#: A word of letters (all beyond ASCII count as such), with one mark after it at most.
PLAIN = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Za-z\x80-\xFF][A-Za-z\x80-\xFF'-]*[.,;:!?)\"]?(?![^\x20\x09-\x0D])")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_distinct", "n_ended", "n_exclaimed", "n_plain", "n_digits", "n_runs")
GOOD, NONE, BAD = 1, 0, -1


def counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS and MORE for a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on bytes: ASCII white space only
    n = len(words)
    chars = sum(map(len, words)) if raw.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) < len(windows):
            covered = 0  # words before this one are counted or never will be
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    ended = sum(x.rstrip().decode("utf-8", "replace").endswith(ENDS) for x in lines)
    plain, runs = len(PLAIN.findall(raw)), sum(map(bytes.__eq__, words, words[1:]))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, len(set(words)), ended, text.count("!"), plain, digits, runs


@dataclass(frozen=True)
class Rule:
    """Votes on a dict of counts: GOOD, NONE or BAD. kind: the kind of junk that it looks for."""

    name: str
    kind: str
    vote: Callable[[dict], int]


def _low(kind: str, name: str, of: str, good: float, bad: float) -> Rule:
    """Good if counts `name` per `of` are at most `good`, bad from `bad` on, else it abstains."""
    return Rule(name, kind, lambda c: GOOD if c[name] <= good * c[of] else BAD if c[name] >= bad * c[of] else NONE)


def _high(kind: str, name: str, of: str, good: float, bad: float) -> Rule:
    """Good from `good` on, bad at most `bad`, else it abstains."""
    return Rule(name, kind, lambda c: GOOD if c[name] >= good * c[of] else BAD if c[name] <= bad * c[of] else NONE)


def _variety(good: float, bad: float) -> Rule:
    """Distinct words, against the power 3/4 of all words that they follow in prose."""
    usual = lambda c: max(c["n_words"], 50) ** 0.75
    return Rule("variety", "repetition", lambda c: GOOD if c["n_distinct"] >= good * usual(c) else BAD if c["n_distinct"] <= bad * usual(c) else NONE)


def default_rules() -> list[Rule]:
    """Twelve rules that vote either way, for four kinds of junk; each kind is looked at from several sides, so that a
    rule's bad votes can be held against those of its neighbours."""
    return [
        _low("symbols", "n_symbols", "n_words", 0.02, 0.1),
        _high("symbols", "n_plain", "n_words", 0.9, 0.7),
        _low("shouting", "n_upper", "word_chars", 0.1, 0.3),
        _low("shouting", "n_exclaimed", "n_words", 0.05, 0.25),
        _low("repetition", "n_repeat_words", "n_words", 0.1, 0.3),
        _low("repetition", "n_runs", "n_words", 0.02, 0.2),
        _low("repetition", "n_dup_lines", "n_lines", 0.1, 0.5),
        _variety(0.9, 0.6),
        Rule("length", "scraps", lambda c: BAD if c["n_words"] < 60 else GOOD if c["n_words"] >= 100 else NONE),
        Rule("word_length", "scraps", lambda c: GOOD if 3 * c["n_words"] <= c["word_chars"] <= 8 * c["n_words"] else BAD),
        _high("scraps", "n_ended", "n_lines", 0.5, 0.2),
        _low("scraps", "n_digits", "word_chars", 0.02, 0.1),
    ]


def base_failed(c: dict) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def voted(rules: list[Rule]) -> Callable[[str | None], tuple]:
    """A text to the values of COUNTS, base_failed and votes (one letter a rule: g, b or -)."""
    letter = {GOOD: "g", NONE: "-", BAD: "b"}

    def of(text: str | None) -> tuple:
        values = counts(text)
        c = dict(zip(COUNTS + MORE, values, strict=True))
        return *values[: len(COUNTS)], base_failed(c), "".join(letter[r.vote(c)] for r in rules)

    return of


def votes(docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, base_failed and votes, in a map over the rows."""
    rules = rules or default_rules()
    kind = docs.schema[key].dataType.simpleString()

    def make():
        of = voted(rules)
        return lambda keys, texts: (keys, *(list(x) for x in zip(*map(of, texts), strict=True)))

    return map_rows(docs, [key, text], make, f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, votes string")


#: What is believed of a rule before votes are seen: how often it votes bad on good documents and on other kinds of junk,
#: and on its own kind; of the share of good documents; and the documents that each such belief counts for.
FALSE_ALARM, DETECTION, SHARE, WEIGHT = 0.05, 0.7, 0.9, 10.0


@dataclass(frozen=True)
class Model:
    """shares: of good documents (place 0) and of each kind of junk. alarms: for each rule (row), of its votes those that
    are bad on the documents of each class."""

    shares: np.ndarray
    alarms: np.ndarray

    def classes(self, patterns: list[str]) -> np.ndarray:
        """The probability of each class for each combination, by Bayes; who abstains says nothing."""
        bad, good = _cast(patterns)
        x = np.log(self.shares) + bad @ np.log(self.alarms) + good @ np.log1p(-self.alarms)
        x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        return x / x.sum(1, keepdims=True)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability of being good."""
        return self.classes(patterns)[:, 0]


def _cast(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices of 0 and 1, a row for each combination and a column for each rule: votes bad, votes good."""
    at = np.array([list(p) for p in patterns], "U1").reshape(len(patterns), -1)
    return (at == "b").astype(float), (at == "g").astype(float)


def fit(histogram: dict[str, int], rules: list[Rule], rounds: int = 500, weight: float = WEIGHT) -> Model:
    """EM over vote combinations and their numbers of documents, from the beliefs on.

    A rate is (bad votes + weight * belief) / (votes + weight), each document counting for a class by its posterior.
    """
    patterns = sorted(histogram)
    bad, good = _cast(patterns)
    n = np.array([histogram[p] for p in patterns], float)
    kinds = sorted({r.kind for r in rules})
    shares = np.array([SHARE] + [(1 - SHARE) / len(kinds)] * len(kinds))
    beliefs = np.array([[FALSE_ALARM] + [DETECTION if r.kind == k else FALSE_ALARM for k in kinds] for r in rules])
    model, p = Model(shares, beliefs), None
    for _ in range(rounds):
        now = model.classes(patterns)
        if p is not None and np.abs(now - p).max() < 1e-9:
            break
        p, held = now, now * n[:, None]
        model = Model((held.sum(0) + weight * shares) / (n.sum() + weight), (bad.T @ held + weight * beliefs) / ((bad + good).T @ held + weight))
    return model


def _posteriors(table: DataFrame, rules: list[Rule], threshold: float) -> DataFrame:
    """votes, p_good, _good for the combinations in a stored table of votes; as many rows as combinations."""
    histogram = {r["votes"]: r["n"] for r in table.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    patterns = sorted(histogram)
    p = fit(histogram, rules).posterior(patterns).tolist() if histogram else []
    schema = T.StructType([T.StructField("votes", T.StringType()), T.StructField("p_good", T.DoubleType()), T.StructField("_good", T.BooleanType())])
    return table.sparkSession.createDataFrame([(v, x, x >= threshold) for v, x in zip(patterns, p, strict=True)], schema)


def judged(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts, base_failed, votes, p_good and kept (p_good >= threshold, and the base rule not failed).

    One pass over the texts, into a narrow stored table; no shuffle but the histogram's, summed before it moves.
    """
    rules = rules or default_rules()
    table = stored(votes(docs, rules, key, text), "votes")
    out = table.join(F.broadcast(_posteriors(table, rules, threshold)), "votes")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_good")).drop("_good")


def keep(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that judged() keeps, all columns as they are.

    The rows are stored with their votes, so that texts are counted once and no row is shuffled.
    """
    rules = rules or default_rules()

    @F.arrow_udf("base_failed boolean, votes string")
    def cast(texts: pa.Array) -> pa.Array:
        of = voted(rules)
        got = [of(t.as_py())[-2:] for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.bool_()), pa.array([x for _, x in got], pa.string())], ["base_failed", "votes"])

    bounded_batches(docs.sparkSession)
    rows = packed(docs, _v=cast(F.col(text))).select("_row", F.col("_v.base_failed").alias("_failed"), F.col("_v.votes").alias("votes"))
    rows = stored(rows, "voted")
    good = _posteriors(rows, rules, threshold).filter("_good").select("votes")
    return rows.filter("not _failed").join(F.broadcast(good), "votes", "left_semi").select("_row.*")
