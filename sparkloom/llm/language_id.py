"""Language identification by prediction by partial matching.

Method.  For each language a tree of byte contexts up to ``ORDER`` bytes is counted on
labelled texts and then frozen.  A byte is coded in its longest context; a byte not
seen there costs an escape (method C: the number of distinct followers over that plus
the total) and is coded one order lower, down to a uniform code.  The language under
which a text has the shortest exact code wins.

The code lengths of all followers seen anywhere are worked out when the statistics
are frozen, for all languages at once, so a text is scored by table lookups over
whole batches.

Texts are lower-cased; runs of ASCII characters that are not letters count as one
blank.  Only text and label of the training rows are used, nothing else of a row.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and
where no language was learned.  Ties go to the language first in code point order.
The score is the winner's share of the probabilities for a byte (their geometric mean
over the text), so it tells how much better the winner fits, not how long the text is.
Repeated rows of one key are rows of their own; texts of any length are coded whole, in
slices.  Columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lots

#: Longest context in bytes; labelled rows used for each language (about).
ORDER, ROWS_PER_LANGUAGE = 3, 1_500
#: Positions scored at a time in a worker; cells up to which a table is laid out in full.
CHUNK, CELLS = 1 << 19, 1 << 23

_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def folded(text: str) -> bytes:
    """The bytes that are coded: lower case, one blank between words, blanks around."""
    return b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_FOLD).split(), b""])


def _grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each behind ``ORDER`` blanks, and where its own bytes start."""
    pad = b" " * ORDER
    joined = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8)
    ends = np.cumsum([len(b) + ORDER for b in bodies])
    return joined, ends


def _codes(joined: np.ndarray) -> np.ndarray:
    """Each position's last ``ORDER + 1`` bytes as one number; the first ``ORDER`` lack some."""
    code = joined.astype(np.uint32)
    for k in range(1, ORDER + 1):
        code[k:] |= joined[:-k].astype(np.uint32) << np.uint32(8 * k)
    return code


def count(labelled: DataFrame, label: str, text: str) -> DataFrame:
    """How often each language has each context with follower: label, gram, n."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, 1):
            by: dict[str, list[bytes]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(folded(t))
            for lang, bodies in by.items():
                joined, ends = _grams(bodies)
                own = np.ones(len(joined), bool)
                for start in np.concatenate(([0], ends[:-1])):
                    own[start : start + ORDER] = False
                grams, n = np.unique(_codes(joined)[own], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)],
                    ["label", "gram", "n"],
                )

    counted = labelled.select(label, text).mapInArrow(run, "label string, gram bigint, n bigint")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


class _Rows:
    """Numbers 0, 1, ... of sorted keys: a full table where that is small, else looked up by halving."""

    def __init__(self, keys: np.ndarray, size: int):
        self.full = self.keys = None
        if size <= CELLS:
            self.full = np.full(size, -1, np.int32)
            self.full[keys] = np.arange(len(keys), dtype=np.int32)
        else:
            self.keys = keys

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1).astype(np.int32)


class Model:
    """Frozen code lengths of all languages."""

    def __init__(self, labels: list[str], grams: np.ndarray, counts: np.ndarray):
        """``grams``: distinct (ORDER + 1)-byte numbers, sorted; ``counts``: grams x labels."""
        self.labels = labels
        syms = np.stack([(grams >> np.uint64(8 * k)).astype(np.int64) & 255 for k in range(ORDER, -1, -1)], axis=1)
        alphabet = np.unique(syms) if len(grams) else np.array([32])
        self.symbol = np.full(256, len(alphabet), np.int32)  # the last one: bytes never seen
        self.symbol[alphabet] = np.arange(len(alphabet), dtype=np.int32)
        self.base = len(alphabet) + 1
        syms = self.symbol[syms]
        counts = counts.astype(np.float64)
        # per order: contexts' ids by (parent id, symbol), followers' cost rows, escapes
        self.child: list[_Rows] = []
        self.rows: list[_Rows] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        uniform = np.full((1, len(labels)), np.log2(257.0))
        below = None
        for order in range(ORDER + 1):
            tail = syms[:, ORDER - order :]
            ctx = self._walk(tail[:, :-1], order)
            key = ctx * self.base + tail[:, -1]
            keys, inverse = np.unique(key, return_inverse=True)
            n = np.zeros((len(keys), len(labels)))
            np.add.at(n, inverse, counts)
            owner = keys // self.base
            size = int(owner.max()) + 1 if len(keys) else 1
            total, distinct = np.zeros((size, len(labels))), np.zeros((size, len(labels)))
            np.add.at(total, owner, n)
            np.add.at(distinct, owner, (n > 0).astype(float))
            whole = total + distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / whole), 0.0)
                seen = -np.log2(n / whole[owner])
            first = np.zeros(len(keys), np.int64)
            first[inverse] = np.arange(len(inverse))
            lower = uniform if below is None else below[first]
            cost = np.where(n > 0, seen, escape[owner] + lower)
            self.rows.append(_Rows(keys, size * self.base))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            below = cost[inverse]
        self.uniform = np.float32(np.log2(257.0))

    def _walk(self, context: np.ndarray, order: int) -> np.ndarray:
        """Ids of contexts of this order, given in training; makes the table on the way.

        A context's id comes from its last symbol outwards: the id of the context one
        byte shorter, and the byte before it.
        """
        if order == 0:
            return np.zeros(len(context), np.int64)
        parent = np.zeros(len(context), np.int64)
        for depth in range(1, order + 1):
            key = parent * self.base + context[:, order - depth]
            if depth > len(self.child):
                self.child.append(_Rows(np.unique(key), (int(parent.max()) + 1 if len(parent) else 1) * self.base))
            parent = self.child[depth - 1].of(key).astype(np.int64)
        return parent

    def bits(self, joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each text (see :func:`_grams`) under each language."""
        out = np.zeros((len(ends), len(self.labels)), np.float64)
        starts = np.concatenate(([0], ends[:-1]))
        sym = self.symbol[joined]
        for at in range(0, len(sym), CHUNK):
            stop = min(at + CHUNK, len(sym))
            cost = self._costs(sym, at, stop)
            lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, stop, "left")
            for k in (lo, *range(lo + 1, hi)) if hi - lo < 3 else ():
                a, b = max(starts[k] + ORDER, at), min(ends[k], stop)
                if b > a:
                    out[k] += cost[a - at : b - at].sum(axis=0, dtype=np.float64)
            if hi - lo >= 3:
                own = np.maximum(starts[lo:hi] + ORDER, at)
                until = np.minimum(ends[lo:hi], stop)
                some = until > own
                marks = np.stack([own[some], until[some]], axis=1).reshape(-1) - at
                padded = np.concatenate([cost, np.zeros((1, cost.shape[1]), np.float32)])
                sums = np.add.reduceat(padded, marks, axis=0)[::2]
                out[np.arange(lo, hi)[some]] += sums
        return out

    def _costs(self, sym: np.ndarray, at: int, stop: int) -> np.ndarray:
        """Cost rows of positions ``at`` to ``stop``; what lies before a text is blank."""
        here = sym[at:stop]
        last = {d: sym[max(at - d, 0) : stop - d] if at >= d else np.concatenate([np.full(min(d - at, stop - at), sym[0]), sym[: max(stop - d, 0)]]) for d in range(1, ORDER + 1)}
        ids = [np.zeros(len(here), np.int32)]
        for d in range(1, ORDER + 1):
            above = ids[-1]
            known = above >= 0
            nxt = self.child[d - 1].of(np.where(known, above, 0) * np.int64(self.base) + last[d])
            ids.append(np.where(known, nxt, -1).astype(np.int32))
        out = np.empty((len(here), len(self.labels)), np.float32)
        todo = np.arange(len(here))
        owed: np.ndarray | None = None
        for order in range(ORDER, -1, -1):
            ctx = ids[order][todo] if order < ORDER or len(todo) != len(here) else ids[order]
            safe = np.maximum(ctx, 0)
            row = self.rows[order].of(safe * np.int64(self.base) + here[todo])
            row = np.where(ctx >= 0, row, -1)
            hit = row >= 0
            got = self.cost[order][row[hit]]
            out[todo[hit]] = got if owed is None else got + owed[hit]
            if hit.all():
                return out
            miss = ~hit
            paid = np.where((ctx[miss] >= 0)[:, None], self.escape[order][safe[miss]], np.float32(0))
            owed = paid if owed is None else owed[miss] + paid
            todo = todo[miss]
        out[todo] = owed + self.uniform
        return out


def train(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Freeze the statistics of labelled texts (rows with null label or text are left out).

    At most about ``ROWS_PER_LANGUAGE`` rows of each language are used, chosen by a
    hash of ``key``; all of their contexts are kept, and what reaches the driver is at
    most the different stretches of ``ORDER + 1`` bytes in those rows.
    """
    rows = labelled.select(label, text, key).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))
    unit = 1 << 30
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(unit, int(ROWS_PER_LANGUAGE / n * unit)))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(unit)) < shares[F.col(label)])
    got = count(picked, label, text).toPandas()
    labels = sorted(set(got["label"]))
    grams, inverse = np.unique(got["gram"].to_numpy(np.uint64), return_inverse=True)
    counts = np.zeros((len(grams), len(labels)))
    counts[inverse, got["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()] = got["n"].to_numpy()
    return Model(labels, grams, counts)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    which = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    if not which or not model.labels:
        return langs, scores
    bodies = [folded(texts[k]) for k in which]
    bits = model.bits(*_grams(bodies))
    best = bits.argmin(axis=1)
    size = np.array([max(1, len(b)) for b in bodies])
    share = 1.0 / np.exp2((bits.min(axis=1)[:, None] - bits) / size[:, None]).sum(axis=1)
    for k, b, s in zip(which, best, share):
        langs[k], scores[k] = model.labels[b], float(s)
    return langs, scores


def identify(docs: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document with ``lang_pred`` and ``score``."""
    texts_at = len(keep)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, texts_at):
            langs, scores = predict(shipped.value, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    from pyspark.sql import types as T

    given = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType(
        [*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return given.mapInArrow(run, schema)
