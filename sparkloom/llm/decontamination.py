"""Benchmark decontamination by canonical templates.

Method.  Words become template words: numbers (digits or spelled out), names
(capitalised inside a sentence) and units behind a number turn into typed
placeholders, other words are lower-cased without marks around them.  A capitalised
word that starts a sentence may be a name or not, so there are two layers of templates:
one takes all such words as they are, the other as names.  Windows of ``WIDTH``
template words of the benchmark are hashed; a document's windows of the same layer are
looked up.  Where slots stand so close that a window has fewer than ``WORDS`` other words, the
stretch over as many words is hashed instead, and slots at an item's ends are compared
next to it.  Where windows of an item are found, the slots are compared: a value of the item
must stand for one value throughout an occurrence, whichever it is, so a question
with other numbers or names is caught and a mere likeness of form is not.  Each
occurrence, told by its alignment with the item, is judged by itself.  An item is
found in a document when windows with consistent slots cover at least ``LEAST`` of
its words.

Not every window is looked up: an item that is covered so far cannot miss all windows
that touch a stretch of more than ``1 - LEAST`` of its words, so only the windows of
the stretch with the least common ones make a document a candidate for the item (a
template that many items share costs nothing unless it is all they have).

Documents are read whole, in one pass for each block of the benchmark.  A block is
bounded in items and in bytes, so is what is broadcast: about ten times its bytes.

Defined results: null and empty documents hold nothing.  Items of fewer than
``WIDTH`` words are one window.  Items with fewer than ``WORDS`` words besides slots
are found where all their words stand as they are, since their template fits too much;
items without words, and null items, are never found.  Repeated items and documents each
give their rows, items with the same template all of theirs.  Of assignments that fit
equally often the one first in byte order decides.  Texts of any length are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm._words import CHUNK, _powers, mix, rows_of, words

#: Template words of a window, share of an item's words that must be covered, most
#: slots in a window; items and bytes of a block (each is cut into windows on the driver).
WIDTH, LEAST, MOST_SLOTS, BLOCK_ITEMS, BLOCK_BYTES = 5, 0.8, 2, 50_000, 16_000_000
#: Words other than slots that a window has at least.
WORDS = WIDTH - MOST_SLOTS

# Spelled-out numbers and units (English, French, German, Spanish), without words that are articles too.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze vingt trente quarante cinquante "
    "soixante cent cents mille millions milliard milliards "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn "
    "neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen milliarde milliarden "
    "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho "
    "diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento cientos mil millón millones"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms lb pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent dollar dollars cent cents euro euros degree degrees meter meters metre metres kilometer kilometers "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours semaine semaines mois an ans année années degré degrés "
    "gramm kilogramm sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad meile meilen "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACE = np.array([0, 0x1F0E_0001, 0x1F0E_0002, 0x1F0E_0003], np.uint64)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
#: Two-byte capitals (Latin, Greek, Cyrillic) and what makes them small letters of two bytes too.
_SMALL = np.arange(1 << 16, dtype=np.uint16)
for _c in (*range(0xC0, 0x100), *range(0x370, 0x530)):
    if chr(_c).isupper() and len(chr(_c).lower().encode()) == 2:
        _SMALL[int.from_bytes(chr(_c).encode(), "big")] = int.from_bytes(chr(_c).lower().encode(), "big")
_LEADS = np.zeros(256, bool)
_LEADS[[0xC3, *range(0xCD, 0xD5)]] = True


def lowered(raw: bytes) -> np.ndarray:
    """Bytes with capitals made small, as many bytes as before."""
    low = np.frombuffer(raw.lower(), np.uint8)
    lead = np.flatnonzero(_LEADS[low[:-1]])
    if not len(lead):
        return low
    small = _SMALL[low[lead].astype(np.uint16) << np.uint16(8) | low[lead + 1]]
    low = low.copy()
    low[lead], low[lead + 1] = small >> np.uint16(8), small & np.uint16(255)
    return low


def _hashes_of(list_of_words: list[str]) -> np.ndarray:
    return np.sort(words([" ".join(list_of_words).encode()])[3])


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBERS), _hashes_of(UNITS)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Template:
    """The template words of several texts: hash and kind in each layer, and place in ``body``."""

    def __init__(self, texts: list[str]):
        raw = b"\n".join([*(t.encode("utf-8", "replace") for t in texts), b""])
        low = lowered(raw)
        self.body = low.tobytes()
        joined, starts, ends, _, _ = words([self.body])
        cased = np.frombuffer(raw + b"  ", np.uint8)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[joined])))
        whole_ends = ends.copy()
        for _ in range(4):  # marks around a word
            starts = starts + ((starts < ends) & _MARK[joined[np.minimum(starts, len(joined) - 1)]])
            ends = ends - ((starts < ends) & _MARK[joined[np.maximum(ends - 1, 0)]])
        keep = starts < ends
        before = np.concatenate(([0], whole_ends[:-1]))
        # a sentence starts at a text's or line's start and behind a stop
        lines = np.concatenate(([0], np.cumsum(joined == 10)))
        opens = (before == 0) | _STOP[joined[np.maximum(before - 1, 0)]] | (lines[starts] > lines[before])
        starts, ends, opens = starts[keep], ends[keep], opens[keep]
        h = _rehash(joined, starts, ends)
        first, second, third = (cased[starts + k] for k in range(3))
        wide = _LEADS[first]
        pair = first.astype(np.uint16) << np.uint16(8) | second
        capital = ((first >= 65) & (first <= 90)) | (wide & (_SMALL[pair] != pair))
        after = np.where(wide, third, second)
        size = ends - starts - wide
        # a name goes on in small letters; other than ASCII ones are told from marks by their place only
        small_next = (size > 1) & ((after >= 97) & (after <= 122) | (after >= 128) | (after == 39))
        number = (digits[ends] > digits[starts]) | _among(h, _NUMBER_HASHES)
        unit = np.concatenate(([False], number[:-1])) & ~number & _among(h, _UNIT_HASHES) if len(h) else np.zeros(0, bool)
        name = capital & small_next & ~number & ~unit
        strict = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name & ~opens, NAME, LITERAL))).astype(np.uint8)
        loose = np.where(name, NAME, strict).astype(np.uint8)
        #: by layer: words that start sentences as they are, and as names if capitalised
        self.kinds = (strict, loose)
        self.exact = h
        self.hashes = tuple(np.where(k == LITERAL, h, _PLACE[k]) for k in self.kinds)
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t.encode("utf-8", "replace")) + 1 for t in texts]))))

    def rows(self, what: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, layers and hashes of all windows of a kind (see :class:`Index`) in order of their starts.

        Of the second layer only those that differ from the first.
        """
        if what == "exact":
            h = rows_of(self.exact, width)
            a = np.arange(len(h))
            return a, a + width, np.zeros(len(h), np.int64), h
        other = np.concatenate(([0], np.cumsum(self.kinds[0] != self.kinds[1])))
        found = []
        for layer in (0, 1):
            if what == "stretch":
                a, b, h = self._stretches(layer)
            else:
                h = rows_of(self.hashes[layer], width)
                a = np.arange(len(h))
                b = a + width
            keep = slice(None) if not layer else other[b] > other[a]
            found.append((a[keep], b[keep], np.full(len(h), layer)[keep], h[keep]))
        both = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(both[0], kind="stable")
        return tuple(c[order] for c in both)

    def _stretches(self, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What lies between a word and the ``WORDS - 1``st after it, slots aside, where longer than a window."""
        literal = np.flatnonzero(self.kinds[layer] == LITERAL)
        a, b = literal[: max(0, len(literal) - WORDS + 1)], literal[WORDS - 1 :] + 1
        long = b - a > WIDTH
        a, b = a[long], b[long]
        hashes = self.hashes[layer]
        up, down = _powers(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes) * up[:-1], out=total[1:])
        return a, b, mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    def value(self, k: int) -> bytes:
        return self.body[self.starts[k] : self.ends[k]]


def _rehash(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of given stretches of bytes, as :func:`words` makes them."""
    up, down = _powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def _by_hash(entries: list[tuple]) -> tuple[np.ndarray, list[tuple]]:
    entries = sorted(entries)
    return np.array([e[0] for e in entries], np.uint64), [e[1:] for e in entries]


class Index:
    """The windows of a block of benchmark items.

    Entries (item, place, width) by what is looked up in a document: windows of
    ``WIDTH`` template words ("whole", and whole items of each smaller width), longer
    stretches with enough words among slots ("stretch"), and beginnings of items that
    are compared word by word ("exact").  ``tables`` holds the entries that make
    candidates, ``own`` all entries of each item.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        t = Template([x for _, x in items])
        self.sizes = np.diff(t.first)
        slots = [np.concatenate(([0], np.cumsum(k != LITERAL))) for k in t.kinds]
        #: kinds of slots: those of the second layer, whose names hold the first's
        self.kinds: list[np.ndarray] = []
        self.exact: dict[int, np.ndarray] = {}
        #: places of each item that no window has: slots at its ends, far from words
        self.loose: list[set[int]] = []
        self.own: list[dict[tuple, list[tuple]]] = []
        all_rows = {("whole", w): t.rows("whole", w) for w in range(1, WIDTH + 1)} | {("stretch", 0): t.rows("stretch", 0)}
        bounds = list(zip(t.first[:-1].tolist(), t.first[1:].tolist()))
        for k, (a, b) in enumerate(bounds):
            n = b - a
            self.kinds.append(t.kinds[1][a:b].copy())
            own: dict[tuple, list[tuple]] = {}
            words_in = [n - int(s[b] - s[a]) for s in slots]
            if n and words_in[0] < WORDS:
                # too few words for a template: the item as it is
                w = min(n, WIDTH)
                self.exact[k] = t.exact[a:b].copy()
                own["exact", w] = [(rows_of(t.exact[a : a + w], w)[0], 0, n)]
            elif n:
                for key in (("whole", n),) if n < WIDTH else (("whole", WIDTH), ("stretch", 0)):
                    from_, to, layers, rows = all_rows[key]
                    for e in range(*np.searchsorted(from_, (a, b)).tolist()):
                        p, q, layer = int(from_[e]), int(to[e]), int(layers[e])
                        dense = key == ("whole", WIDTH) and slots[layer][q] - slots[layer][p] > MOST_SLOTS
                        if q <= b and not dense and words_in[layer] >= WORDS:
                            own.setdefault(key, []).append((rows[e], p - a, q - p))
            held = {q + d for entries in own.values() for _, q, w in entries for d in range(w)}
            self.loose.append(set(range(n)) - held)
            self.own.append({key: _by_hash(v) for key, v in own.items()})
        self.tables = self._candidates()
        self.values = [[(int(t.kinds[1][p]), t.value(p)) if t.kinds[1][p] else None for p in range(a, b)] for a, b in bounds]

    def _candidates(self) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        """For each kind of window: hashes, sorted, and items, of those that an occurrence cannot miss."""
        common = {}
        for key in {key for own in self.own for key in own}:
            h, n = np.unique(np.concatenate([own[key][0] for own in self.own if key in own]), return_counts=True)
            common[key] = h, n
        found: dict[tuple, list[tuple]] = {}
        for k, own in enumerate(self.own):
            n = int(self.sizes[k])
            if not own:
                continue
            # what windows that touch a place would bring along, summed over stretches of places that all must be touched
            cost = np.zeros(n)
            for key, (rows, at) in own.items():
                h, many = common[key]
                for c, (q, w) in zip(many[np.searchsorted(h, rows)].tolist(), at):
                    cost[q : q + w] += c
            places = np.array(sorted(set(range(n)) - self.loose[k]))
            # loose places count as covered in the worst case
            must = min(len(places), int(np.floor((1 - LEAST) * n + 1e-9)) + 1)
            sums = np.convolve(cost[places], np.ones(must), "valid")
            low = int(np.argmin(sums))
            chosen = set(places[low : low + must].tolist())
            for key, (rows, at) in own.items():
                found.setdefault(key, []).extend((r, k) for r, (q, w) in zip(rows, at) if not chosen.isdisjoint(range(q, q + w)))
        tables = {}
        for key, rows in found.items():
            if not rows:
                continue
            h, item = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
            order = np.argsort(h, kind="stable")
            tables[key] = h[order], item[order]
        return tables

    def found(self, texts: list[str | None]) -> list[list[tuple[int, float, bool]]]:
        """For each text: the items it holds, their covered share, and if slots have other values."""
        out: list[list[tuple[int, float, bool]]] = [[] for _ in texts]
        lot: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if t:
                if lot and size + len(t) > CHUNK // 2:
                    self._lot(texts, lot, out)
                    lot, size = [], 0
                lot.append(k)
                size += len(t)
        if lot:
            self._lot(texts, lot, out)
        return out

    def _lot(self, texts: list[str | None], lot: list[int], out: list[list]) -> None:
        t = Template([texts[k] for k in lot])
        rows: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        pairs: list[np.ndarray] = []
        many = len(self.ids)
        for key, (hashes, items) in self.tables.items():
            a, _, _, h = rows[key] = t.rows(*key)
            left = np.searchsorted(hashes, h, "left")
            hits = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == h)
            if len(hits):
                size = np.searchsorted(hashes, h[hits], "right") - left[hits]
                owner = np.searchsorted(t.first, a[hits], "right") - 1
                total = np.cumsum(size)
                entry = np.repeat(left[hits] - (total - size), size) + np.arange(int(total[-1]))
                pairs.append(np.unique(np.repeat(owner, size) * many + items[entry]))
        for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
            o, item = divmod(pair, many)
            got = self._occurrences(t, rows, o, item)
            if got is not None:
                out[lot[o]].append((self.ids[item], got[0] / int(self.sizes[item]), got[1]))

    def _occurrences(self, t: Template, rows: dict[tuple, tuple], o: int, item: int) -> tuple[int, bool] | None:
        """Words covered and if slots have other values, if text ``o`` holds the item."""
        start, stop = int(t.first[o]), int(t.first[o + 1])
        own: set[tuple[int, int, int]] = set()
        for key, (hashes, at) in self.own[item].items():
            a, _, _, h = rows[key] if key in rows else rows.setdefault(key, t.rows(*key))
            low, high = np.searchsorted(a, (start, stop)).tolist()
            left = np.searchsorted(hashes, h[low:high], "left")
            hits = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == h[low:high])
            for x in hits.tolist():
                e, p = int(left[x]), int(a[low + x])
                while e < len(at) and hashes[e] == h[low + x]:
                    q, w = at[e]
                    e += 1
                    if p + w <= stop and (key[0] != "exact" or np.array_equal(t.exact[p : p + w], self.exact[item])):
                        own.add((p, q, w))
                        if self.loose[item]:
                            self._extend(t, item, (p, q, w), start, stop, own)
        n = int(self.sizes[item])
        if len({q + d for _, q, w in own for d in range(w)}) < LEAST * n:
            return None
        covered, changed = self._best(t, item, own)
        return (covered, changed) if covered >= LEAST * n else None

    def _extend(self, t: Template, item: int, hit: tuple[int, int, int], first: int, stop: int, own: set) -> None:
        """Slots next to a hit that no window has, as far as they are of the same kinds."""
        p, q, w = hit
        kinds, loose = self.kinds[item], self.loose[item]
        for step, k in ((-1, -1), (1, w)):
            while q + k in loose and first <= p + k < stop and t.kinds[1][p + k] == kinds[q + k]:
                own.add((p + k, q + k, 1))
                k += step

    def _best(self, t: Template, item: int, pairs: set[tuple[int, int, int]]) -> tuple[int, bool]:
        """Words covered by the occurrence that covers most, and if its slots have other values.

        An occurrence is what lies along one alignment (document position minus item
        position); windows up to an item's length away from it fill in what was moved.
        All windows of the document together are tried as well.
        """
        n = int(self.sizes[item])
        hits = sorted((p - q, p, q, w) for p, q, w in pairs)
        aligned = [h[0] for h in hits]
        best = self._consistent(t, item, hits, None)
        for d in dict.fromkeys(aligned):
            if best == (n, False):
                break
            own = hits[bisect_left(aligned, d - n) : bisect_right(aligned, d + n)]
            if len({q + k for _, _, q, w in own for k in range(w)}) >= LEAST * n:
                best = max(best, self._consistent(t, item, own, d), key=lambda x: (x[0], not x[1]))
        return best

    def _consistent(self, t: Template, item: int, hits: list[tuple[int, int, int, int]], d: int | None) -> tuple[int, bool]:
        """Words of the item covered by windows whose slots agree with the most frequent assignment.

        Windows at about the alignment ``d`` decide first; others only on values those lack.
        """
        values = self.values[item]
        seen: dict[tuple[int, bytes], Counter] = {}
        slots = []
        for at, p, q, w in hits:
            own = [(values[q + k], t.value(p + k)) for k in range(w) if values[q + k] is not None]
            slots.append(own)
            weight = len(hits) + 1 if d is not None and abs(at - d) < WIDTH else 1
            for mine, theirs in own:
                seen.setdefault(mine, Counter())[theirs] += weight
        stands = {mine: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for mine, c in seen.items()}
        covered: set[int] = set()
        changed = False
        for (_, _, q, w), own in zip(hits, slots):
            if all(stands[mine] == theirs for mine, theirs in own):
                covered.update(range(q, q + w))
                changed = changed or any(mine[1] != theirs for mine, theirs in own)
        return len(covered), changed


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark's items: about ``BLOCK_ITEMS`` of them and ``BLOCK_BYTES``, or less, in each."""
    given = benchmark.select(item, text).where(F.col(text).isNotNull())
    size = given.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    many = max(-(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES))
    for k in range(many):
        own = given.where(F.pmod(F.xxhash64(item, text), F.lit(many)) == k)
        yield Index(sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Rows ``key``, ``item``, ``covered`` (share of the item's words), ``changed`` (other slot values)."""
    out = None
    schema = T.StructType(
        [docs.schema[key], benchmark.schema[item], T.StructField("covered", T.DoubleType()), T.StructField("changed", T.BooleanType())]
    )
    for index in blocks(benchmark, item):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, shipped=shipped) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                found = shipped.value.found(batch.column(1).to_pylist())
                rows = [(k, *f) for k, own in enumerate(found) for f in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        *(pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.bool_()))),
                    ],
                    [key, item, "covered", "changed"],
                )

        got = docs.select(key, text).mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged and with all their columns."""
    for index in blocks(benchmark, item):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator, shipped=shipped) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not f for f in shipped.value.found(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def template(text: str) -> str:
    """A text's template, for people to read."""
    t = Template([text])
    names = {NUMBER: "<number>", NAME: "<name>", UNIT: "<unit>"}
    return " ".join(names.get(int(k)) or t.value(p).decode("utf-8", "replace") for p, k in enumerate(t.kinds[0]))
