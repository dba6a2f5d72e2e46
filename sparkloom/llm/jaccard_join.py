"""Exact Jaccard self-join on word n-grams, given as connected classes.

Method: prefix-filtered index lists with set-relation skipping.

1. Each text's set of shingles is ordered by a fixed global order, rare ones first
   (frequent shingles are known from map-side counts; any order gives the same
   result).  Two sets that link share one of the first few; those are indexed.
   Texts with equal sets are one node.
2. Index lists are ordered by set size and cut into blocks.  A block is skipped when
   its sizes, or the positions of the shared shingle in it, leave no room for the
   overlap that a link needs.
3. Sets that pass are compared by parity bitmaps: what two sets share cancels, so
   differing bits bound the number of differing shingles from below.
4. Answers are derived from those of similar sets.  In a wave each set is verified
   only against the nearest one before it in a list that is of another class yet; if
   they link, all answers of that class are its own, and later waves work on what is
   left between the classes.  When a wave finds no more links, the pairs left between
   different classes are all looked at: first bitmaps tell which entries still have a
   partner of another class, then these get bitmaps with ``WIDE`` times the bits, which
   leave hardly any pair but those that link or nearly do; all of them are verified.

Verification counts the shared shingles of both whole texts.  Lists known to be long
from map-side counts are dealt to parts before anything is sorted, and pairs of parts
are tasks of their own.

Classes are computed, not each set's links: within a class pairs are not verified.

Defined results: null and empty texts and texts of white space have no shingles and
are linked with nothing; texts of any length are taken whole.  A text of fewer words than ``width`` has one shingle of all
of them.  Rows with equal texts are linked; a class takes its id from its smallest
non-null key, and rows whose class has none get null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._words import mix, shingle_sets
from sparkloom.llm.common import discard, drop_path, lots, materialise, scratch_path
from sparkloom.llm.components import components

#: Shingles counted at a time in a task, the count from which they are reported, the
#: total from which they are frequent, and the most kept.
COUNTED, LOCAL_LEAST, TOTAL_LEAST, MOST_FREQUENT = 1_500_000, 6, 24, 300_000
#: Entries of a block of a list, entries of a part of a long list, lists checked for
#: partners before bitmaps are fetched, lists compared without numpy, waves at most.
BLOCK, PART, CHECKED, SHORT, WAVES = 64, 1_024, 4_096, 16, 3
#: Times the bits of the last wave's bitmaps, long lists that are broadcast at most, pairs sent on at a time.
WIDE, MOST_LONG, SENT = 16, 500_000, 20_000
#: Bits of the table that says which nodes are candidates (at most).
TABLE_BITS = 1 << 27


def needed(n, m, percent: int):
    """The overlap from which sets of sizes n and m link: 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts (over distinct sets of each lot).

    Shingles that are not frequent in any lot are not reported; this only affects the
    order, never the result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        size = 0

        def lot() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            keep = n >= LOCAL_LEAST
            return pa.RecordBatch.from_arrays([pa.array(got[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

        for batch in lots(batches, 0):
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                d = digest(s)
                if len(s) and d not in held:
                    held[d] = s
                    size += len(s)
                if size >= COUNTED:
                    yield lot()
                    held, size = {}, 0
        if held:
            yield lot()

    counted = docs.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= TOTAL_LEAST).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def digest(s: np.ndarray) -> int:
    """A number for a set: equal sets have equal ones, others practically never."""
    if not len(s):
        return 0
    place = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s + place)) + np.uint64(len(s))]))[0].view(np.int64))


def bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """Parity bits of a set: ``times`` as many as elements, rounded up to a power of two (256 at least)."""
    bits = max(256, times << max(0, len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0xA5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def profile(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """Rows: ``key``, ``n``, ``d`` (the set's number), ``prefix`` (first shingles), ``bits``."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(frequent(docs, text, width))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hot, hot_n = shipped.value
        last = max(len(hot) - 1, 0)
        for batch in lots(batches, 1):
            n, d, prefix, bits = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                d.append(digest(s))
                if not len(s):
                    prefix.append(None)
                    bits.append(None)
                    continue
                keep = len(s) - -(-percent * len(s) // 100) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), last)
                    count = np.where(hot[at] == s, hot_n[at], 0)
                    first = s[np.argsort(count, kind="stable")[:keep]] if count.any() else s[:keep]
                else:
                    first = s[:keep]
                prefix.append(first.view(np.int64))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                [key, "n", "d", "prefix", "bits"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n bigint, d bigint, prefix array<bigint>, bits binary")


def long_lists(nodes: DataFrame) -> DataFrame:
    """Index lists that are dealt to parts: token, pieces.

    Tasks count the prefixes of lots of sets and report what they saw twice, so no list
    passes through one task; a list that no task sees twice has at most an entry a lot.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[np.ndarray] = []
        size = 0

        def lot() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(got[n > 1]), pa.array(n[n > 1])], ["token", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= COUNTED:
                yield lot()
                held, size = [], 0
        if held:
            yield lot()

    counted = nodes.select("prefix").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    # an entry goes to as many pairs as there are pieces, so these grow with the root of very long lists
    share = F.col("n") / PART
    pieces = F.least(F.ceil(share), F.greatest(F.lit(16), F.ceil(2 * F.sqrt(share))))
    return counted.where(F.col("n") > PART).select("token", pieces.cast("int").alias("pieces"))


def lists(nodes: DataFrame, percent: int) -> DataFrame:
    """Entries of index lists that have a partner: token, lo, hi, part, n, d.

    First lists of one entry, and entries that no other one of the list can link with
    for their sizes and positions, are left out; then bitmaps are fetched, and entries
    that those rule out go too.  Lists with the same entries left, in the same parts, are one, as
    similar sets share many.  A list longer than ``PART`` is dealt to parts from the start;
    each pair of parts (``lo``, ``hi``) is a task of its own, and an entry goes to all
    pairs with its part.
    """
    long = materialise(long_lists(nodes), "long-lists")
    how = "broadcast" if long.count() <= MOST_LONG else "merge"
    entries = nodes.select(F.posexplode("prefix").alias("at", "token"), "d", "n").join(long.hint(how), "token", "left")
    pieces = F.coalesce("pieces", F.lit(1))
    entries = entries.select("at", "token", "d", "n", pieces.alias("pieces"), F.pmod(F.xxhash64("d"), pieces).cast("int").alias("part"))
    entries = entries.repartition("token", "part").sortWithinPartitions("token", "part")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token, held = None, []
        out: list[tuple] = []
        open_ = False  # a list too long to be looked at here, or one of several parts
        names = ["token", "d", "n", "at", "pieces", "part"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

        def batch_of() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()
            return got

        for batch in batches:
            for at, t, d, n, pieces, part in zip(*(x.to_pylist() for x in batch.columns)):
                if t != token:
                    out.extend((*e, 1, 0) for e in _with_partner(token, held, percent))
                    token, held, open_ = t, [], pieces > 1
                if open_:
                    out.append((t, d, n, at, pieces, part))
                    continue
                held.append((n, at, d))
                if len(held) > CHECKED:
                    out.extend((t, d, n, at, 1, 0) for n, at, d in held)
                    held, open_ = [], True
            if len(out) > SENT:
                yield batch_of()
        out.extend((*e, 1, 0) for e in _with_partner(token, held, percent))
        yield batch_of()

    kept = entries.mapInArrow(run, "token bigint, d bigint, n bigint, at bigint, pieces int, part int")
    full = kept.join(nodes.select("d", "bits").hint("merge"), "d")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = full.select("token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "n", "at", "d", "bits")
    dealt = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "d")

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["token", "lo", "hi", "part", "n", "at", "d", "bits"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            got = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(got, ["token", "lo", "hi", "part", "n", "d"])

        for (_, lo, hi), held in _runs(batches, names):
            mark = np.zeros(len(held), bool)
            find = _short if len(held) <= SHORT else _long
            for _ in find(held, list(range(len(held))), lo != hi, percent, True, mark):
                pass
            left = [held[k] for k in np.flatnonzero(mark).tolist()]
            if left:
                # parts belong to the key: lists of other lengths deal the same members differently
                left.sort(key=lambda e: e[3])
                held_by = np.array([[e[3] for e in left], [e[0] for e in left]], np.int64).view(np.uint64)
                members = digest(held_by.reshape(-1))
                out.extend((members, lo, hi, part, n, d) for part, n, _, d, _ in left)
            if len(out) > 10_000:
                yield batch_of()
        yield batch_of()

    near_ones = dealt.mapInArrow(near, "token bigint, lo int, hi int, part int, n bigint, d bigint")
    return near_ones.dropDuplicates(["token", "lo", "hi", "d"])


def _runs(batches: Iterator, names: list[str]) -> Iterator[tuple[tuple, list]]:
    """Lists of two entries or more from rows in order of (token, lo, hi)."""
    key, held = None, []
    for batch in batches:
        for token, lo, hi, *entry in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            if (token, lo, hi) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (token, lo, hi), []
            held.append(entry)
    if len(held) > 1:
        yield key, held


def _with_partner(token: int, held: list[tuple], percent: int) -> Iterator[tuple]:
    """The entries (n, at, d) of a list that at least one other one can link with."""
    if len(held) < 2:
        return
    if len(held) == 2:
        (n, i, _), (m, j, _) = held
        if 100 * min(n, m) >= percent * max(n, m) and min(n - i, m - j) >= needed(n, m, percent):
            yield from ((token, d, n, at) for n, at, d in held)
        return
    held.sort()
    size = np.array([e[0] for e in held])
    room = size - np.array([e[1] for e in held])
    partner = np.zeros(len(held), bool)
    from_ = 0
    for y in range(1, len(held)):
        m, my_room = held[y][0], int(room[y])
        while 100 * held[from_][0] < percent * m:
            from_ += 1
        fit = np.minimum(room[from_:y], my_room) >= needed(size[from_:y], m, percent)
        if fit.any():
            partner[from_:y] |= fit
            partner[y] = True
    for k in np.flatnonzero(partner).tolist():
        n, at, d = held[k]
        yield token, d, n, at


def _candidates(entries: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that pass all filters in a list: see :func:`_pairs`."""
    # positions have been looked at; equal lists of several shingles are one by now
    dealt = entries.withColumn("zero", F.lit(0).cast("bigint"))
    dealt = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "d")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["token", "lo", "hi", "part", "n", "zero", "d", "bits", "comp"]
        out: set[tuple[int, int]] = set()

        def batch_of() -> pa.RecordBatch:
            a, b = [p[0] for p in out], [p[1] for p in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for key, held in _runs(batches, names):
            for pair in _pairs(held, key[1] != key[2], percent, every):
                out.add(pair)
                if len(out) >= SENT:
                    yield batch_of()
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(entries: list[list], across: bool, percent: int, every: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a list (entries part, n, at, d, bits, comp, by size) that may link.

    ``across``: only pairs of different parts.  ``every``: all pairs of different
    classes; otherwise for each entry the nearest one before it of another class.
    """
    comps = [e[5] for e in entries]
    if comps.count(comps[0]) == len(comps):
        return
    find = _short if len(entries) <= SHORT else _long
    for x, y in find(entries, comps, across, percent, every):
        a, b = entries[x][3], entries[y][3]
        if a != b:
            yield (a, b) if a < b else (b, a)


def _undecided(entries: DataFrame, percent: int) -> DataFrame:
    """The entries (token, lo, hi, part, n, d, comp) that bitmaps leave a partner of another class."""
    dealt = entries.withColumn("zero", F.lit(0).cast("bigint"))
    dealt = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "d")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["token", "lo", "hi", "part", "n", "zero", "d", "bits", "comp"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for key, held in _runs(batches, names):
            comps = [e[5] for e in held]
            if comps.count(comps[0]) < len(comps):
                mark = np.zeros(len(held), bool)
                for _ in (_short if len(held) <= SHORT else _long)(held, comps, key[1] != key[2], percent, True, mark):
                    pass
                left = [(*key, held[k][0], held[k][1], held[k][3], held[k][5]) for k in np.flatnonzero(mark).tolist()]
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in left], t) for k, t in enumerate(kinds)], ["token", "lo", "hi", "part", "n", "d", "comp"])

    return dealt.mapInArrow(run, "token bigint, lo int, hi int, part int, n bigint, d bigint, comp bigint")


def _wide_bits(texts: DataFrame, width: int) -> DataFrame:
    """Bitmaps with ``WIDE`` times the bits: d, bits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in lots(batches, 1):
            bits = [bitmap(s, WIDE) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["d", "bits"])

    return texts.select("d", "text").mapInArrow(run, "d bigint, bits binary")


def _short(entries: list[list], comps: list[int], across: bool, percent: int, every: bool, mark: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    bits = [int.from_bytes(e[4], "little") for e in entries]
    for y in range(1, len(entries)):
        part, m, j, _, raw = entries[y][:5]
        best = None
        for x in range(y):
            n, i = entries[x][1], entries[x][2]
            if comps[x] == comps[y] or 100 * n < percent * m or (across and entries[x][0] == part):
                continue
            least = needed(n, m, percent)
            if min(n - i, m - j) < least:
                continue
            u, v = bits[x], bits[y]
            if len(entries[x][4]) != len(raw):
                u, v = _same_width(u, len(entries[x][4]) * 8, v, len(raw) * 8)
            spare = n + m - 2 * least - (u ^ v).bit_count()
            if spare >= 0:
                if mark is not None:
                    mark[x] = mark[y] = True
                elif every:
                    yield x, y
                elif best is None or spare > best[0]:
                    best = (spare, x)
        if best is not None:
            yield best[1], y


def _long(entries: list[list], comps: list[int], across: bool, percent: int, every: bool, mark: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    part = np.array([e[0] for e in entries])
    size = np.array([e[1] for e in entries])
    room = size - np.array([e[2] for e in entries])  # the shared shingle and what follows it
    comp = np.array(comps)
    wide = np.array([len(e[4]) for e in entries])
    maps = {int(w): np.zeros((len(entries), w // 8), np.uint64) for w in np.unique(wide)}
    for k, e in enumerate(entries):
        raw = np.frombuffer(e[4], np.uint64)
        while True:  # at its own width and all smaller ones of the list
            if len(raw) * 8 in maps:
                maps[len(raw) * 8][k] = raw
            if len(raw) * 8 <= min(maps):
                break
            raw = raw[: len(raw) // 2] ^ raw[len(raw) // 2 :]
    starts = np.arange(0, len(entries), BLOCK)
    largest, most_room, smallest = (f.reduceat(x, starts) for f, x in ((np.maximum, size), (np.maximum, room), (np.minimum, size)))
    from_ = 0
    for y in range(1, len(entries)):
        m, my_room = int(size[y]), int(room[y])
        while 100 * int(size[from_]) < percent * m:
            from_ += 1
        if from_ >= y:
            continue
        # blocks whose sizes and positions leave room for enough overlap
        first, last = from_ // BLOCK, (y - 1) // BLOCK + 1
        fit = (100 * largest[first:last] >= percent * m) & (np.minimum(most_room[first:last], my_room) >= needed(smallest[first:last], m, percent))
        best = (-1, -1)
        for k in (np.flatnonzero(fit) + first).tolist():
            a, b = max(k * BLOCK, from_), min((k + 1) * BLOCK, y)
            least = needed(size[a:b], m, percent)
            ok = (np.minimum(room[a:b], my_room) >= least) & (comp[a:b] != comp[y])
            if across:
                ok &= part[a:b] != part[y]
            some = np.flatnonzero(ok)
            if not len(some):
                continue
            spare = np.empty(len(some), np.int64)
            narrow = np.minimum(wide[a:b][some], wide[y])
            for w in np.unique(narrow):
                own = narrow == w
                table = maps[int(w)]
                spare[own] = -np.bitwise_count(table[a + some[own]] ^ table[y]).sum(axis=1)
            spare += size[a:b][some] + m - 2 * least[some]
            if mark is not None:
                near = some[spare >= 0]
                mark[a + near] = True
                mark[y] |= len(near) > 0
            elif every:
                for x in some[spare >= 0].tolist():
                    yield a + x, y
            else:
                top = int(spare.argmax())
                if spare[top] > best[0]:
                    best = (int(spare[top]), a + int(some[top]))
        if best[0] >= 0:
            yield best[1], y


def _same_width(u: int, wu: int, v: int, wv: int) -> tuple[int, int]:
    """Two parity bitmaps folded to the narrower one's bits."""
    while wu > wv:
        wu //= 2
        u = (u >> wu) ^ (u & ((1 << wu) - 1))
    while wv > wu:
        wv //= 2
        v = (v >> wv) ^ (v & ((1 << wv) - 1))
    return u, v


def _texts_of(docs: DataFrame, text: str, width: int, nodes: DataFrame) -> tuple[str, str]:
    """A table (its name and folder), bucketed by node, of one text for each of ``nodes``: d, text.

    A bit table of the nodes, bounded by ``TABLE_BITS``, keeps most other texts out of
    the shuffle; the join afterwards is exact.
    """
    spark = docs.sparkSession
    wanted = nodes.select("d").distinct()
    n = wanted.count()
    bits = min(TABLE_BITS, 1 << max(12, (16 * max(n, 1)).bit_length()))
    place = F.pmod(F.col("d"), F.lit(bits))
    words = wanted.groupBy(F.shiftright(place, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(d, {bits}) % 64 as int)))").alias("v")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    shipped = spark.sparkContext.broadcast(table)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        held = shipped.value
        for batch in lots(batches, 0):
            texts = batch.column(0).to_pylist()
            d, keep = [], []
            for t, s in zip(texts, shingle_sets(texts, width)):
                own = digest(s)
                at = own % bits
                if len(s) and own not in seen and (int(held[at >> 6]) >> (at & 63)) & 1:
                    seen.add(own)
                    d.append(own)
                    keep.append(t)
            if len(seen) > 2_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(keep, pa.string())], ["d", "text"])

    got = docs.select(text).mapInArrow(run, "d bigint, text string")
    one = got.groupBy("d").agg(F.min("text").alias("text")).join(wanted.hint("merge"), "d", "left_semi")
    name = f"texts_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = scratch_path(spark, "texts")
    one.write.bucketBy(buckets, "d").sortBy("d").option("path", where).saveAsTable(name)
    return name, where


def _joined(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """Classes (node, comp) once the links ``new`` are added: only the graph between the classes is labelled anew."""
    if label is None:
        return components(new)
    known = {c: label.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")).hint("merge") for c in "ab"}
    drawn = new.join(known["a"], "a", "left").join(known["b"], "b", "left")
    drawn = materialise(drawn.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "drawn")
    of = components(drawn.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    ends = drawn.select(F.col("a").alias("node"), F.col("ca").alias("comp")).union(drawn.select("b", "cb"))
    nodes = label.unionByName(ends).distinct()
    to = of.select(F.col("node").alias("comp"), F.col("comp").alias("now")).hint("merge")
    out = materialise(nodes.join(to, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")), "labels")
    for old in (drawn, of, label):
        discard(old)
    return out


def _verified(pairs: DataFrame, table: str, width: int, percent: int) -> DataFrame:
    """The pairs whose whole texts' shingles link; only pairs are shuffled, not the table of texts."""
    texts = pairs.sparkSession.table(table)
    a = texts.select(F.col("d").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("d").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                lot = batch.slice(at, 512)
                own = {}
                for c in (2, 3):
                    t = lot.column(c).to_pylist()
                    new = list(dict.fromkeys(x for x in t if x not in own))
                    own.update(zip(new, shingle_sets(new, width)))
                ok = []
                for x, y in zip(lot.column(2).to_pylist(), lot.column(3).to_pylist()):
                    s, t = own[x], own[y]
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * shared >= percent * (len(s) + len(t) - shared))
                yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows ``key``, ``n_shingles``, ``component_id``: one for each input row.

    Two texts link when 100 * shared >= ``percent`` * union of their distinct shingles
    of ``width`` words; a class is what links connect.
    """
    spark = docs.sparkSession
    rows = materialise(profile(docs, text, key, width, percent), "profiles")
    nodes = rows.where("n > 0").groupBy("d").agg(
        F.min(key).alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")
    )
    nodes = materialise(nodes, "nodes")
    entries = materialise(lists(nodes, percent), "lists")
    texts, where = _texts_of(docs, text, width, entries)
    bits = materialise(nodes.select("d", "bits").join(entries.select("d").distinct().hint("merge"), "d", "left_semi"), "bits")
    tried = label = None
    every, waves = False, 0
    while True:
        if label is None:
            own = bits.withColumn("comp", F.col("d"))
        else:
            known = label.select(F.col("node").alias("d"), "comp").hint("merge")
            own = bits.join(known, "d", "left").withColumn("comp", F.coalesce("comp", "d"))
        classed = entries.join(own.hint("merge"), "d")
        if every:
            left = materialise(_undecided(classed, percent), "undecided")
            some = spark.table(texts).join(left.select("d").distinct().hint("merge"), "d", "left_semi")
            classed = left.join(_wide_bits(some, width).hint("merge"), "d")
        pairs = _candidates(classed, percent, every)
        if tried is not None:
            pairs = pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = materialise(_verified(pairs, texts, width, percent), "links")
        waves += 1
        found = not new.isEmpty()
        if found or label is None:
            label = _joined(label, new)
        if every:
            break
        every = not found or waves == WAVES
    spark.sql(f"DROP TABLE IF EXISTS {texts}")
    drop_path(spark, where)
    ids = nodes.select("d", "rep").join(label.select(F.col("node").alias("d"), "comp").hint("merge"), "d", "left")
    ids = materialise(ids.select("d", "rep", F.coalesce("comp", "d").alias("comp")), "ids")
    least = ids.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = materialise(ids.join(least, "comp").select("d", "component_id"), "classes")
    for old in (entries, nodes, bits, ids, label):
        discard(old)
    none = rows.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    some = rows.where("n > 0").select(key, "n", "d").join(of, "d").select(key, F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(none)
