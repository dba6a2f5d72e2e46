"""Quality classifier: a generalised additive model with pairwise interactions.

Method.  Each text becomes a few numbers (shares of character kinds, lengths,
repetition).  Each number is cut into bins at quantiles of the training rows.
Boosting goes round the features in turn; each step fits a shallow tree to one
feature's bins and adds a small part of it to that feature's lookup table.  Then the
pairs of features that explain most of what is left get two-dimensional tables in the
same way.  A text is scored by adding up table entries, whole batches at a time, and
a logistic function.

Learning uses a bounded sample of labelled rows, only their texts and labels.

Defined results: null and empty texts score with their own bins (all numbers 0); texts of
any length are read whole.  With no labelled row every score is 0; with one class only,
0 or 1 nearly.  Repeated labels count once, contradictory ones of one key not at all;
each row of a repeated key is a row, and a null key has no label.  Columns of the
documents other than key and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import agreed, bounded_rows, lots

#: Labelled rows used at most (about), bins of a feature, boosting rounds, learning
#: rate, leaves of a tree, pairs of features, and bins of a pair's side.
TRAIN_ROWS, BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS = 20_000, 32, 120, 0.15, 3, 6, 8, 40

FEATURES = (
    "log_chars", "log_words", "letter_share", "upper_share", "digit_share", "mark_share", "symbol_share",
    "blank_share", "line_share", "word_chars", "distinct_words", "top_word_share", "doubled_words",
    "marked_words", "distinct_lines", "wide_share",
)

# kinds of bytes: 1 small letter, 2 capital, 3 digit, 4 sentence mark, 5 symbol, 6 blank, 7 line end, 8 beyond ASCII
_KIND = np.full(256, 5, np.uint8)
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,;:'\"-()", 4), (b" \t\r\v\f", 6), (b"\n", 7), (range(128, 256), 8)):
    for _c in _chars:
        _KIND[_c] = _k


def features(texts: list[str | None]) -> np.ndarray:
    """A row of :data:`FEATURES` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9)
        n = len(raw)
        small, upper, digit, mark, symbol, blank, line, wide = (int(k) for k in kinds[1:9])
        letters = small + upper + wide
        words = text.split()
        m = max(1, len(words))
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = text.split("\n")
        out[row] = (
            np.log1p(n), np.log1p(len(words)), letters / n, upper / max(1, small + upper), digit / n, mark / n, symbol / n,
            blank / n, line / m, letters / m, len(counts) / m, max(counts.values(), default=0) / m,
            sum(map(str.__eq__, words, words[1:])) / m, symbol / m, len(set(lines)) / len(lines), wide / n,
        )
    return out


class Model:
    """Bin edges, one table for each feature, and one for each chosen pair."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature rows: table entries added up, then the logistic function."""
        total = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, k], "right")]
        for a, b, edge_a, edge_b, table in self.pairs:
            total += table[np.searchsorted(edge_a, x[:, a], "right"), np.searchsorted(edge_b, x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Bin values of a tree over ordered bins: the best cuts one after another."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    spans = [(0, len(g))]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gain = (
                (cg[cut] - cg[a]) ** 2 / (ch[cut] - ch[a] + 1.0)
                + (cg[b] - cg[cut]) ** 2 / (ch[b] - ch[cut] + 1.0)
                - gain_of(a, b)
            )
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], s, int(cut[k]))
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values over a grid: one cut along each side, four cells."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 1e-9, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            a, b = (np.array([m[i, j], m[i, -1] - m[i, j], m[-1, j] - m[i, j], m[-1, -1] - m[i, -1] - m[-1, j] + m[i, j]]) for m in (cg, ch))
            gain = (a**2 / (b + 1.0)).sum()
            if gain > best:
                best = gain
                out = np.zeros_like(g)
                for cell, v in zip(cells, a / (b + 1.0)):
                    out[cell] = v
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of feature tables, then of the tables of the best pairs."""
    if not len(y):
        return Model(-30.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    edges = [_quantile_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            r, w = slopes()
            size = len(table)
            step = RATE * _tree(np.bincount(bins[k], r, size), np.bincount(bins[k], w, size), LEAVES)
            table += step
            total += step[bins[k]]
    coarse = [_quantile_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    r, w = slopes()
    found = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            cell = at[a] * shape[1] + at[b]
            g, h = np.bincount(cell, r, shape[0] * shape[1]), np.bincount(cell, w, shape[0] * shape[1])
            found.append((float((g**2 / (h + 1.0)).sum()), a, b, shape, cell))
    found.sort(key=lambda f: (-f[0], f[1], f[2]))
    pairs = [(a, b, shape, cell, np.zeros(shape)) for _, a, b, shape, cell in found[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for _, _, shape, cell, table in pairs:
            r, w = slopes()
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (r, w))
            step = RATE * _pair_tree(g, h)
            table += step
            total += step.reshape(-1)[cell]
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], table) for a, b, _, _, table in pairs])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on labelled rows (null labels and texts are left out), at most about ``TRAIN_ROWS``.

    Workers make the feature rows; only those reach the driver.
    """
    known = agreed(labels, key, label)
    picked = F.broadcast(bounded_rows(known, key, TRAIN_ROWS, "quality"))  # bounded by TRAIN_ROWS
    sample = docs.select(key, text).where(F.col(text).isNotNull()).join(picked, key)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, 0):
            x = features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, k]) for k in range(x.shape[1])] + [batch.column(1)], [*FEATURES, "y"]
            )

    rows = sample.select(text, "__y").mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", y int").toPandas()
    rows = rows.sort_values([*FEATURES, "y"], kind="stable")  # the same sums whatever the order of tasks
    return fit(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def score(
    docs: DataFrame, model: Model, keep: list[str | Column], text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """The columns ``keep`` of each document with ``score`` and ``predicted`` (or other ``names``)."""
    texts_at = len(keep)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, texts_at):
            got = shipped.value.score(features(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))],
                [*batch.schema.names[:-1], *names],
            )

    given = docs.select(*keep, F.col(text).alias("__text"))
    more = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], *more]))
