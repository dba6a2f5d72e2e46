"""Document fingerprints by a randomised edit embedding.

Method.  All texts are walked with the same random bits: in step j the walk writes
down the symbol it stands on and moves on by one or not, as the bit for (j, symbol)
says.  Two texts that differ by few edits soon walk in step again, so the edit
distance turns into a Hamming distance of what is written down.  A fingerprint keeps
a sample of the steps, chosen by a hash of the step number alone and thinner for
longer texts, so that it spans the whole text and the samples of different lengths
are nested.  A symbol is a hash of three characters in a row.

Fingerprints are compared by the share of samples that agree.  For near duplicates,
bands of samples are join keys, and what meets in a band is verified.

Walks of a batch run side by side, one numpy operation a step for all texts; the few
longest are finished one by one, and very long texts are walked alone.

Defined results: null counts as empty; empty texts have the fingerprint ``0:`` and
likeness 1 with each other, 0 with others.  Equal texts have equal fingerprints.  Null
keys come before others, rows with equal keys in an order of their texts.  Texts of any
length are walked whole; beyond ``ALONE`` characters in slices, so that memory beside
the text itself does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import lots
from sparkloom.llm.ordered import in_order

#: A fingerprint has at least about so many samples (and up to twice as many).
SAMPLES = 192
#: Random bits repeat after so many steps; walks side by side until so few are left;
#: characters walked at a time; a longer text is walked alone, in slices.
PERIOD, FEW, AT_A_TIME, ALONE = 4096, 40, 6_000_000, 1_000_000
#: Steps whose levels are worked out at a time, characters of a slice.
STEPS, SLICE = 1 << 16, 1 << 18

_BITS = (np.random.Generator(np.random.PCG64(20_24)).integers(0, 2, (PERIOD, 256))).astype(np.uint8)
_ROWS = [row.tobytes() for row in _BITS] * 2


@lru_cache(maxsize=64)
def levels(block: int) -> np.ndarray:
    """For each of ``STEPS`` steps the thinnest sample that holds it: zero bits at the end of its hash."""
    h = np.arange(block * STEPS, (block + 1) * STEPS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = h & (~h + np.uint64(1))
    return np.where(h == 0, 63, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.uint8)


def _kept(level: int, step: int) -> Iterator[int]:
    """The steps from ``step`` on that are in the sample of ``level``."""
    for block in count(step // STEPS):
        own = np.flatnonzero(levels(block) >= level) + block * STEPS
        yield from own[np.searchsorted(own, step) :].tolist()


def level_of(n: int) -> int:
    """The sample that a text of ``n`` characters is fingerprinted with."""
    return max(0, (2 * n // SAMPLES).bit_length() - 1)


def _symbols(text: str) -> np.ndarray:
    """A byte for each character but the last two: a hash of it and the next two."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    h = code[:-2] * np.uint32(0x9E3779B1)
    h ^= code[1:-1] * np.uint32(0x85EBCA77)
    h ^= code[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(24)).astype(np.uint8)


def _part(text: str, a: int, b: int) -> bytes:
    """The symbols of characters ``a`` to ``b``; behind a text come two NULs."""
    return _symbols(text[a : b + 2] + "\0" * max(0, b + 2 - len(text))).tobytes()


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The samples of each text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: -len(texts[k]))
    at = 0
    while at < len(order):  # the longest first; a lot of about as many characters each time
        if len(texts[order[at]]) > ALONE:
            out[order[at]] = np.frombuffer(bytes(_walk_alone(texts[order[at]])), np.uint8)
            at += 1
            continue
        stop, size = at, 0
        while stop < len(order) and (stop == at or size + len(texts[order[stop]]) <= AT_A_TIME):
            size += len(texts[order[stop]])
            stop += 1
        lot = order[at:stop]
        for k, got in zip(lot, _walk([texts[k] for k in lot])):
            out[k] = got
        at = stop
    return out


def _walk_alone(text: str, at: int = 0, step: int = 0) -> list[int]:
    """The samples of a text from character ``at`` on, which step ``step`` stands on.

    Holds the symbols of one slice only, whatever the text's length.
    """
    n, got = len(text), []
    keep = _kept(level_of(n), step)
    wanted = next(keep)
    low = high = at
    here, p = b"", 0
    while at < n:
        if at == high:
            low, high = at, min(n, at + SLICE)
            here, p = _part(text, low, high), 0
        if step == wanted:
            got.append(here[p])
            wanted = next(keep)
        # a step moves by one at most, so the slice is not left within so many
        off = step & (PERIOD - 1)
        run = min(high - at, wanted - step, PERIOD)
        for row in _ROWS[off : off + run]:
            p += row[here[p]]
        step += run
        at = low + p
    return got


def _walk(texts: list[str]) -> list[np.ndarray]:
    """Samples of non-empty texts, given longest first, side by side."""
    sym = np.concatenate([*(_symbols(t + "\0\0") for t in texts), np.zeros(1, np.uint8)])
    size = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(size)))[:-1]
    lvl = np.array([level_of(int(n)) for n in size])
    who = np.arange(len(texts))
    pos, end = base.copy(), base + size
    owners: list[np.ndarray] = []
    samples: list[np.ndarray] = []
    j = 0
    while len(who) > FEW:
        lev = levels(j // STEPS)
        for step in range(j, j + 64):
            s = sym[pos]
            # levels fall along the order, so the texts that keep this step are at its end
            keep = np.searchsorted(-lvl, -int(lev[step & (STEPS - 1)]), "left")
            if keep < len(who):
                on = pos[keep:] < end[keep:]
                owners.append(who[keep:][on])
                samples.append(s[keep:][on])
            pos += _BITS[step & (PERIOD - 1)][s]
            np.minimum(pos, end, out=pos)
        j += 64
        on = pos < end
        if not on.all():
            who, pos, end, lvl = who[on], pos[on], end[on], lvl[on]
    for w, p in zip(who.tolist(), (pos - base[who]).tolist()):
        rest = _walk_alone(texts[w], p, j)
        owners.append(np.full(len(rest), w))
        samples.append(np.array(rest, np.uint8))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return np.split(np.concatenate(samples)[order], cut)


def written(n: int, samples: np.ndarray) -> str:
    """A fingerprint as text: its level, a colon, two hex digits a sample."""
    return f"{level_of(n)}:{samples.tobytes().hex()}"


@lru_cache(maxsize=64)
def _steps(level: int, many: int) -> np.ndarray:
    """The levels of the first ``many`` steps that are in the sample of ``level``."""
    own = islice(_kept(level, 0), many)
    return np.array([levels(step // STEPS)[step % STEPS] for step in own], np.uint8)


def _thinned(samples: np.ndarray, level: int, top: int) -> np.ndarray:
    """Those of the samples of ``level`` that are in the sample of ``top`` too."""
    if level == top:
        return samples
    many = 1 << max(9, (len(samples) - 1).bit_length())
    return samples[_steps(level, many)[: len(samples)] >= top]


def likeness(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """The share of agreeing samples of two fingerprints of texts with n and m characters."""
    k, l = level_of(n), level_of(m)  # noqa: E741
    top = max(k, l)
    a, b = _thinned(a, k, top), _thinned(b, l, top)
    longest = max(len(a), len(b))
    if not longest:
        return 1.0 if n == m else 0.0
    short = min(len(a), len(b))
    return float(np.count_nonzero(a[:short] == b[:short]) / longest)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows: ``key``, ``n_chars``, ``fingerprint``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = [written(len(t), f) for t, f in zip(texts, fingerprints(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(got, pa.string())],
                [key, "n_chars", "fingerprint"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_chars bigint, fingerprint string")


def read(fingerprint: str) -> np.ndarray:
    """The samples of a written fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint.split(":")[1]), np.uint8)


def stretch(least: float, most: int) -> int:
    """The longest stretch of which two fingerprints with a likeness of ``least`` share one.

    The shorter one has up to ``most`` samples.  Of n samples at most (1 - ``least``) n
    disagree, each spoils one stretch, and there are more stretches than that; fewer
    samples than a stretch must agree with all of the other's.
    """

    def sure(n: int, own: int) -> bool:
        return n // own > int((1 - least) * n + 1e-9) if n >= own else int(n / least + 1e-9) == n

    return max(own for own in range(1, 9) if own == 1 or all(sure(n, own) for n in range(1, most + 1)))


def near_duplicates(prints: DataFrame, key: str = "doc_id", bands: int = 32, width: int = 4, least: float = 0.8) -> DataFrame:
    """Pairs (representative, ``key``, likeness of at least ``least``) from :func:`fingerprint` rows.

    Texts with equal fingerprints are one; it is written down under its smallest key, so
    copies are not expanded into pairs.  A band is ``width`` samples at steps that a hash
    picks, at the text's own level and the next thinner one.  Texts with too few samples for
    bands, and those little longer, meet in a stretch of samples instead (:func:`stretch`),
    which loses no pair if ``least`` is 0.7 or more.  All that meet are verified against
    each other, each pair once.
    """
    few = SAMPLES // 3
    most = int(few / least)
    own = stretch(least, most)

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pick = np.random.Generator(np.random.PCG64(7)).integers(0, few, (bands, width))
        for batch in batches:
            rows: list[tuple] = []
            for k, n, f in zip(*(c.to_pylist() for c in batch.columns)):
                samples, level = read(f), level_of(n)
                for thin in (level, level + 1):
                    s = _thinned(samples, level, thin)
                    if len(s) >= few:
                        rows += [(f"{thin}.{b}.{s[p].tobytes().hex()}", k) for b, p in enumerate(pick)]
                if level == 0 and len(samples) <= most:
                    body, many = samples.tobytes(), len(samples)
                    rows += [(f"s{at}.{body[at : at + own].hex()}", k) for at in range(0, many - own + 1, own)]
                    if 0 < many < own:
                        rows.append((f"w.{body.hex()}", k))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64()))], ["band", "key"])

    given = prints.select(F.col(key).cast("bigint").alias("key"), "n_chars", "fingerprint")
    one = given.groupBy("fingerprint").agg(F.min("key").alias("key"), F.min("n_chars").alias("n_chars"))
    banded = one.select("key", "n_chars", "fingerprint").mapInArrow(keys, "band string, key bigint")
    met = banded.join(banded.select("band", F.col("key").alias("rep")), "band").where("key > rep").select("rep", "key").distinct()
    a = one.select(F.col("key").alias("rep"), F.col("n_chars").alias("n_a"), F.col("fingerprint").alias("f_a"))
    pairs = met.join(a, "rep").join(one, "key")

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rep, k, n, f, m, g = (c.to_pylist() for c in batch.columns)
            like = [likeness(x, read(y), z, read(w)) for x, y, z, w in zip(n, f, m, g)]
            ok = pa.array([x >= least for x in like], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], ["rep", "key", "likeness"]).filter(ok)

    found = pairs.select("rep", "key", "n_a", "f_a", "n_chars", "fingerprint").mapInArrow(verify, "rep bigint, key bigint, likeness double")
    same = given.join(one.select("fingerprint", F.col("key").alias("rep")), "fingerprint").where("key > rep")
    return found.unionByName(same.select("rep", "key", F.lit(1.0).alias("likeness"))).withColumnRenamed("key", key)


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text ends, instead of in its last quarter, in the beginning of the next
    document (ascending ``key``, after the last the first).  Rows: ``key``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.
    """
    dealt, _ = in_order(docs, key, text, followed=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []
        carried = 0
        ended = False

        def lot(rows: list[tuple]) -> pa.RecordBatch:
            """All of ``rows`` but the last, which is the last one's next."""
            texts = [r[1] for r in rows]
            edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:])]
            prints = fingerprints(texts + edited)
            own, new = prints[: len(texts)], prints[len(texts) :]
            n = [len(t) for t in texts]
            m = [len(t) for t in edited]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows[:-1]], pa.int64()),
                    pa.array(n[:-1], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
                    pa.array([written(a, f) for a, f in zip(n[:-1], own)], pa.string()),
                    pa.array([written(a, f) for a, f in zip(m, new)], pa.string()),
                    pa.array([likeness(a, f, b, g) for a, f, b, g in zip(n, own, m, new)], pa.float64()),
                    pa.array([likeness(a, f, b, g) for a, f, b, g in zip(n, own, n[1:], own[1:])], pa.float64()),
                ],
                names,
            )

        for batch in lots(batches, 3):
            if ended:
                continue
            for tail, k, t in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                held.append((k, t or ""))
                carried += len(held[-1][1])
                if tail:
                    ended = True
                    break
                if carried > AT_A_TIME and len(held) > 1:
                    yield lot(held)
                    held = held[-1:]
                    carried = len(held[0][1])
        if len(held) > 1:
            yield lot(held)

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema)
