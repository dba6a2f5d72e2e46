"""Toxicity from a weighted lexicon, matched after folding disguises.

Method.  Texts are lower-cased, look-alike letters and digit substitutions are folded,
and the lexicon is matched by one Aho-Corasick automaton.  A term is a whole word or a
word's beginning.  Its weight is the log ratio of the shares of toxic and of clean
documents that hold it; an exception phrase (one or two words before or behind the term,
or one on each side, that make it harmless) cancels the match.  A text's matches are summed, once as distinct terms and
once in proportion to its length, and a logistic curve fitted on the same labelled
rows maps both to a score.

Learning uses a bounded sample of labelled rows and only their texts and labels.  All
terms of these rows are tried, all that are significant and pure are kept.
Documents that share their smallest three-word hash count once, so a group of copies
does not turn its own rare words into terms.

Defined results: null and empty texts score as a text without any term does.  Without
a learned term every score is the share of toxic rows, or 0 with no labelled row.
Repeated labels count once, contradictory ones of one key not at all; each row of a
repeated key is a row, and a null key has no label.  Texts of any length are read whole.
Columns of the documents other than key and text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import agreed, bounded_rows, discard, lots, materialise

#: Labelled rows used of each class (about).
TOXIC_ROWS, CLEAN_ROWS = 6_000, 10_000
#: A term needs so many different toxic texts and such a ratio of shares (and a fifth
#: of its texts may be clean).
LEAST_TEXTS, LEAST_RATIO = 3, 8.0
PREFIX_CHARS = (3, 4, 5, 6, 7)
#: Terms that a task counts before it sends them on.
AT_A_TIME = 500_000

# Letters that look like Latin ones, and characters used for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_WIDE = {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
_TABLE = str.maketrans(LOOK_ALIKES | SUBSTITUTES | _WIDE)
_FOLDABLE = re.compile("[" + re.escape("".join(LOOK_ALIKES | SUBSTITUTES | _WIDE)) + "]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> tuple[str, str]:
    """The lower-cased text and the same with disguises folded, character by character."""
    low = text.lower()
    return low, low.translate(_TABLE) if _FOLDABLE.search(low) else low


def _signature(text: str) -> int:
    """The smallest hash of three words in a row: copies and near copies mostly share it."""
    import xxhash

    words = text.split()
    if len(words) < 3:
        return xxhash.xxh64_intdigest(text) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(len(words) - 2)) >> 1


def _terms(text: str) -> set[str]:
    """Whole words, and beginnings marked by a star."""
    words = {w.translate(_TABLE) for w in _WORD.findall(fold(text)[0])}
    return words | {w[:k] + "*" for w in words for k in PREFIX_CHARS if len(w) > k}


class Lexicon:
    """Terms with weights, exceptions, and the curve from sums to scores."""

    def __init__(self, terms: dict[str, float], exceptions: dict[str, set[tuple[str, str]]], curve: list[float]):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def matches(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        """Term, start, end and folded text of each match that no exception cancels."""
        if not self.terms:
            return
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            by: dict[str, list[str]] = {}
            for t in self.terms:
                by.setdefault(t.rstrip("*"), []).append(t)
            for t, kinds in by.items():
                self._automaton.add_word(t, (len(t), kinds))
            self._automaton.make_automaton()
        low, folded = fold(text)
        n = len(low)
        for last, (size, kinds) in self._automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if (start and low[start - 1].isalpha()) or low[start] in "!|" or low[last] in "!|":
                continue
            whole = end == n or not low[end].isalpha()
            for t in kinds:
                if t[-1] == "*" or whole:
                    if t in self.exceptions and not self.exceptions[t].isdisjoint(_around(folded, start, end)):
                        continue
                    yield t, start, end, folded

    def sums(self, text: str | None) -> tuple[float, float]:
        """Summed weights of distinct terms, and of all matches for each 100 words (both damped)."""
        if not text:
            return 0.0, 0.0
        found = Counter(t for t, *_ in self.matches(text))
        if not found:
            return 0.0, 0.0
        distinct = sum(self.terms[t] for t in found)
        every = sum(self.terms[t] * n for t, n in found.items())
        return math.log1p(distinct), math.log1p(100.0 * every / (text.count(" ") + text.count("\n") + 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.sums(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def _around(folded: str, start: int, end: int) -> list[tuple[str, str]]:
    """The phrases around a match: one or two words before ("<") or behind (">"), or one on each side ("<>")."""
    before = _WORD.findall(folded[max(0, start - 60) : start])[-2:]
    after, at = [], end
    for _ in range(2):
        m = _WORD.search(folded, at, at + 40)
        if m is None or m.start() - at > 3:
            break
        after.append(m.group())
        at = m.end()
    out = [("<", before[-1])] if before else []
    out += [("<", " ".join(before))] if len(before) == 2 else []
    out += [(">", after[0])] if after else []
    out += [(">", " ".join(after))] if len(after) == 2 else []
    return out + ([("<>", f"{before[-1]} {after[0]}")] if before and after else [])


def _fit(points: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method with a little shrinkage; slopes are not negative."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weights * (labels - p)) - 1e-2 * w
        h = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learn the lexicon from labelled rows (null labels and texts are left out).

    At most about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows are read.  Terms are counted,
    weighed and chosen on executors; what reaches the driver is the chosen terms, their
    exceptions and two sums a row.
    """
    spark = docs.sparkSession
    known = agreed(labels, key, label)
    toxic = bounded_rows(known.where("__y = 1"), key, TOXIC_ROWS, "toxic")
    clean = bounded_rows(known.where("__y = 0"), key, CLEAN_ROWS, "clean")
    shares = [known.where(F.col("__y") == y).count() for y in (0, 1)]
    if not sum(shares):
        return Lexicon({}, {}, [-40.0, 0.0, 0.0])
    picked = F.broadcast(toxic.unionByName(clean))  # bounded by TOXIC_ROWS + CLEAN_ROWS
    sample = docs.select(key, text).where(F.col(text).isNotNull()).join(picked, key)

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, 0):
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signature(t) for t in texts], pa.int64()), batch.column(1), batch.column(0)],
                ["sig", "y", "text"],
            )

    one = sample.select(F.col(text).alias("t"), "__y").mapInArrow(signed, "sig bigint, y int, text string")
    one = materialise(one.groupBy("sig", "y").agg(F.min("text").alias("text")), "toxic-sample")
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, held = weigh(one, n.get(1, 0), n.get(0, 0))
    lexicon = Lexicon(_without_nested(weights, held), {}, [0.0, 0.0, 0.0])
    lexicon.exceptions = _exceptions(one, spark.sparkContext.broadcast(lexicon))
    final = spark.sparkContext.broadcast(lexicon)

    def points(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [final.value.sums(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1)], ["a", "b", "y"]
            )

    rows = one.select("text", "y").mapInArrow(points, "a double, b double, y int").toPandas()
    discard(one)
    rows = rows.sort_values(["a", "b", "y"], kind="stable")  # the same sums whatever the order of tasks
    y = rows["y"].to_numpy(float)
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    lexicon.curve = _fit(rows[["a", "b"]].to_numpy(float), y, weight * len(y) / max(1.0, weight.sum()))
    return lexicon


def weigh(texts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, int]]:
    """Weights and toxic texts of the terms that many toxic texts and hardly any clean ones hold.

    ``texts``: rows text, y (1 toxic, 0 clean), of which there are ``toxic`` and ``clean``.
    """
    many = materialise(_count(texts.where("y = 1")).where(F.col("n") >= LEAST_TEXTS), "toxic-terms")
    tried = many.count()
    both = many.select("term", F.col("n").cast("double").alias("a")).join(_count(texts.where("y = 0")).select("term", F.col("n").alias("c")), "term", "left")
    both = both.select("term", "a", F.coalesce("c", F.lit(0)).cast("double").alias("b"))
    ratio = ((F.col("a") + 0.5) / (toxic + 1.0)) / ((F.col("b") + 0.5) / (clean + 1.0))
    kept = both.withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (4 * F.col("b") <= F.col("a"))).collect()
    discard(many)
    share = toxic / max(1, toxic + clean)
    least = math.log(max(1, tried)) + 1
    kept = [r for r in kept if _surprise(r.a, r.b, share) > least]
    return {r.term: math.log(r.ratio) * (1 - math.exp(-r.a / 6)) for r in kept}, {r.term: int(r.a) for r in kept}


def _surprise(a: float, b: float, share: float) -> float:
    """How unlikely (a bound on minus the logarithm) so many of a term's texts are toxic by chance.

    Many rare words occur in a few toxic texts only; a term has to beat the number of
    terms that were tried.
    """
    p = a / (a + b)
    out = p * math.log(p / share)
    if b:
        out += (1 - p) * math.log((1 - p) / (1 - share)) if share < 1 else math.inf
    return (a + b) * out if p > share else 0.0


def _count(texts: DataFrame) -> DataFrame:
    """In how many texts each term occurs: term, n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            got = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(got, ["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(_terms(t))
                if len(seen) > AT_A_TIME:
                    yield batch_of()
        yield batch_of()

    return texts.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _without_nested(weights: dict[str, float], held: dict[str, int]) -> dict[str, float]:
    """Of a word and its beginnings keep the shortest that says nothing more than the word.

    A beginning stays if it covers clearly more texts than any longer term that starts
    with it; otherwise the longer one stays.
    """
    out = dict(weights)
    for t in sorted(weights, key=len):
        stem = t.rstrip("*")
        for k in PREFIX_CHARS:
            short = stem[:k] + "*"
            if k < len(stem) and short in out and t in out and short != t:
                if held[short] > 1.5 * held[t]:
                    del out[t]
                    break
                del out[short]
    return out


def _exceptions(texts: DataFrame, lexicon) -> dict[str, set[tuple[str, str]]]:
    """Neighbours with which a term occurs in clean texts several times and hardly in toxic ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                around = {(m, *a) for m, s, e, f in lexicon.value.matches(t) for a in _around(f, s, e)}
                seen.update((*a, y) for a in around)
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0][k] for r in rows], kind) for k, kind in enumerate((pa.string(),) * 3 + (pa.int32(),))]
            + [pa.array([r[1] for r in rows], pa.int64())],
            ["term", "side", "word", "y", "n"],
        )

    got = texts.select("text", "y").mapInArrow(run, "term string, side string, word string, y int, n bigint")
    clean = F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    dirty = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    kept = got.groupBy("term", "side", "word").agg(clean.alias("c"), dirty.alias("d")).where("c >= 2 and c > 4 * d")
    out: dict[str, set[tuple[str, str]]] = {}
    for r in kept.collect():
        out.setdefault(r.term, set()).add((r.side, r.word))
    return out


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str | Column], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` of each document with ``score`` and ``predicted``."""
    texts_at = len(keep)
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, texts_at):
            got = [shipped.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())],
                [*batch.schema.names[:-1], "score", "predicted"],
            )

    given = docs.select(*keep, F.col(text).alias("__text"))
    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], *more]))
