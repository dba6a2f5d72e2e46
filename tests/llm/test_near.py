"""Near duplicates, fingerprints and decontamination against plain versions."""

import hashlib
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, fingerprints, jaccard_join
from sparkloom.llm.components import components

WORDS = [a + b for a in "tha on er in re".split() for b in "sh ing nd ou ti es".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def corpus(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([3, 8, 40, 120, 300])) for _ in range(40)]
    common = sentence(rng, 30)
    texts = base + [edited(rng, rng.choice(base), rng.randint(0, 8)) for _ in range(160)] + [rng.choice(base) for _ in range(40)]
    texts += [common + " " + sentence(rng, 20) for _ in range(30)]
    texts += [None, "", " \n\t ", "one", "One", "one two", "a b c d", "A  b\nC d", sentence(rng, 20_000)]
    return [(k, t, "x") for k, t in enumerate(texts)]


def plain_classes(rows: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for k, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {k: k for k in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {k: (k, len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 50)])
def test_classes(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(6)
    got = {r.doc_id: tuple(r) for r in jaccard_join.classes(docs, width=width, percent=percent).collect()}
    assert got == plain_classes(rows, width, percent)


def test_classes_with_long_lists(spark, monkeypatch):
    """Lists dealt to parts, and none checked before, give the same."""
    rng = random.Random(9)
    base = sentence(rng, 60)
    rows = [(k, edited(rng, base, rng.randint(1, 6)), "") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    monkeypatch.setattr(jaccard_join, "PART", 16)
    monkeypatch.setattr(jaccard_join, "CHECKED", 3)
    got = {r.doc_id: tuple(r) for r in jaccard_join.classes(docs, width=4, percent=85).collect()}
    assert got == plain_classes(rows, 4, 85)


def test_near_misses_make_few_pairs(spark, monkeypatch):
    """A family whose sets all nearly link and do not: what is verified is in proportion to the links, not to the pairs."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(1000)]
    rows, places = [], []
    while len(rows) < 80:  # 12 changed words change 48 shingles of four; two such texts share 0.82 to 0.845
        own = set(rng.sample(range(0, 1000, 5), 12))
        if all(len(own & other) < 4 for other in places):
            places.append(own)
            rows.append((len(rows), " ".join(f"x{len(rows)}y{at}" if at in own else w for at, w in enumerate(words))))
    sets = plain_classes([(k, t, "") for k, t in rows], 4, 85)
    assert all(v[2] == k for k, v in sets.items())
    seen = []
    real = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r) for r in jaccard_join.classes(docs, width=4, percent=85).collect()}
    assert got == sets and sum(seen) < 3160 / 10, seen


def test_long_texts_and_null_keys(spark):
    long = " ".join(f"w{k % 9973}" for k in range(150_000))
    rows = [(1, long), (2, long + " more"), (None, long), (None, "a b c d e"), (None, "A B C D E"), (7, "a b c d e"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.classes(docs, width=4, percent=85).collect())
    assert got == [(0, 1), (0, 7), (0, 7), (1, 1), (2, 1), (7, 7), (7, 7)]


def test_lists_dealt_differently_stay_apart(spark, monkeypatch):
    """A pair left in a list of two parts and in one of three keeps the parts of each."""
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "CHECKED", 0)
    dealt = spark.range(500).selectExpr("id", "pmod(xxhash64(id), 2) AS two", "pmod(xxhash64(id), 3) AS three").collect()
    a = next(r.id for r in dealt if (r.two, r.three) == (0, 1))
    b = next(r.id for r in dealt if (r.two, r.three) == (1, 0))
    rng = np.random.default_rng(1)
    near, size = rng.bytes(32), 100
    nodes = [(a, size, [1, 2], near), (b, size, [1, 2], near)]
    nodes += [(1000 + k, size, [1 if k < 6 else 2], rng.bytes(32)) for k in range(16)]
    got = jaccard_join.lists(spark.createDataFrame(nodes, "d long, n long, prefix array<long>, bits binary"), 85).collect()
    lists: dict = {}
    for r in got:
        lists.setdefault((r.token, r.lo, r.hi), set()).add((r.d, r.part))
    assert sorted(map(sorted, lists.values())) == sorted([sorted([(a, 0), (b, 1)]), sorted([(a, 1), (b, 0)])])


def test_classes_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(none).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "lonely words that are not there"), (3, None)]
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (3, 3), (5, 5), (5, 5)]


def test_components(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {x: x for ab in links for x in ab}
    for _ in range(100):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: c for k, c in comp.items() if any(k in ab and ab[0] != ab[1] for ab in links)}


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (10, 200, 600, 3000):
        s = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        t = np.unique(np.concatenate([s[n // 9 :], rng.integers(0, 1 << 60, n // 12).astype(np.uint64)]))
        a, b = jaccard_join.bitmap(s), jaccard_join.bitmap(t)
        u, v = jaccard_join._same_width(int.from_bytes(a, "little"), len(a) * 8, int.from_bytes(b, "little"), len(b) * 8)
        assert (u ^ v).bit_count() <= len(np.setxor1d(s, t))


# -- fingerprints ----------------------------------------------------------------------


def slow_walk(text: str) -> list[int]:
    sym, k = fingerprints._symbols(text + "\0\0"), fingerprints.level_of(len(text))
    i = j = 0
    out = []
    while i < len(text):
        if fingerprints.levels(j // fingerprints.STEPS)[j % fingerprints.STEPS] >= k:
            out.append(int(sym[i]))
        i += int(fingerprints._BITS[j % fingerprints.PERIOD][sym[i]])
        j += 1
    return out


def test_walks_side_by_side():
    rng = random.Random(6)
    texts = [sentence(rng, rng.choice([0, 1, 5, 50, 400])) if n else "" for n in range(120)] + ["x", "é" * 5000, sentence(rng, 9000)]
    for t, f in zip(texts, fingerprints.fingerprints(texts)):
        assert f.tolist() == slow_walk(t)


def test_walks_alone_as_in_company():
    rng = random.Random(13)
    texts = [sentence(rng, 2)[: rng.randint(1, 10)] for _ in range(300)]
    for t, f in zip(texts, fingerprints.fingerprints(texts)):
        assert fingerprints.fingerprints([t])[0].tolist() == f.tolist() == slow_walk(t), t


def test_walks_in_slices(monkeypatch):
    """Texts walked alone in small slices, side by side, and in small lots have the same samples."""
    rng = random.Random(14)
    texts = [sentence(rng, rng.choice([1, 30, 300])) for _ in range(90)]
    given = [f.tolist() for f in fingerprints.fingerprints(texts)]
    for name, value in (("SLICE", 17), ("ALONE", 100), ("AT_A_TIME", 3000), ("FEW", 3)):
        monkeypatch.setattr(fingerprints, name, value)
        assert [f.tolist() for f in fingerprints.fingerprints(texts)] == given, name


def test_very_long_texts_need_little_memory():
    """20 million characters: what is held beside the text stays below 100 MB."""
    code = (
        "import resource\nfrom sparkloom.llm import fingerprints as f\n"
        "t = ''.join(chr(97 + k * k % 23) + 'lorem ipsum dolor ' for k in range(1_100_000))\n"
        "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "g, h = f.fingerprints([t, t[:-50_000] + 'x' * 40_000])\n"
        "like = f.likeness(len(t), g, len(t) - 10_000, h)\n"
        "print(len(t), len(g), like, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 20_000_000 and int(out[1]) >= fingerprints.SAMPLES // 2 and float(out[2]) > 0.95 and int(out[3]) < 100


def test_likeness():
    rng = random.Random(7)
    for n in (60, 400, 3000):
        t = sentence(rng, n)
        few = edited(rng, t, max(1, n // 100))
        shifted = "x" + t
        other = sentence(rng, n)
        f = fingerprints.fingerprints([t, few, shifted, other])
        like = [fingerprints.likeness(len(t), f[0], len(x), g) for x, g in zip((t, few, shifted, other), f)]
        assert like[0] == 1.0 and like[1] > 0.75 and (like[2] > 0.6 or n == 60) and like[3] < 0.15


def test_with_edited(spark):
    rng = random.Random(11)
    rows = [(k * 7, sentence(rng, rng.randint(0, 60)), "z") for k in range(50)] + [(1000, None, "z"), (1001, "", "z"), (1002, "ab", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").repartition(7)
    got = {r.doc_id: r for r in fingerprints.with_edited(docs).collect()}
    assert len(got) == len(rows)
    rows.sort()
    for k, (d, t, _) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[d].n_chars == len(t)
        assert got[d].edited_fingerprint == fingerprints.written(len(new), fingerprints.fingerprints([new])[0])
    assert fingerprints.with_edited(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).first().near_next == 1.0
    assert fingerprints.with_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_with_edited_of_odd_keys(spark):
    """Null keys come first, repeated keys by a hash of their texts, repeated rows follow each other; ranges may be cut anywhere."""
    rng = random.Random(12)
    rows = [(rng.choice([None, None, 5, 5, 5, k]), rng.choice([None, "same text", sentence(rng, 9)])) for k in range(200)]
    rows += [(77, "long " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprints.with_edited(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _ in rows)
    order = [tuple(r) for r in docs.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").select("doc_id", "text").collect()]
    want = []
    for (k, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        n = len(t) // 4
        want.append((str(k), hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.edited_sha256) for r in got)


def test_near_duplicates(spark):
    rng = random.Random(12)
    base = [sentence(rng, 200) for _ in range(30)]
    rows = list(enumerate(base + [edited(rng, t, 2) for t in base[:15]] + base[:3]))
    found = fingerprints.near_duplicates(fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")), least=0.6).collect()
    pairs = {(r.rep, r.doc_id) for r in found}
    wanted = {(k, 30 + k) for k in range(15)} | {(k, 45 + k) for k in range(3)}
    assert len(pairs & wanted) >= 0.9 * len(wanted)
    assert all(b >= 30 for _, b in pairs)


def test_near_duplicates_among_themselves(spark):
    """Texts of a family are linked with each other, not only with the smallest key that they meet."""
    rng = random.Random(13)
    base = [sentence(rng, 200) for _ in range(3)]
    rows = list(enumerate(edited(rng, base[k % 3], k % 9) for k in range(60)))
    prints = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    own = fingerprints.fingerprints([t for _, t in rows])
    alike = {(a, b): fingerprints.likeness(len(rows[a][1]), own[a], len(rows[b][1]), own[b]) for b in range(60) for a in range(b)}
    found = {(r.rep, r.doc_id): r.likeness for r in fingerprints.near_duplicates(prints).collect()}
    same = {p for p in alike if rows[p[0]][1] == rows[p[1]][1]}  # copies: under the smallest key alone
    wanted = {p: x for p, x in alike.items() if x >= 0.8 and not {p[0], p[1]} & {b for _, b in same}}
    assert len(wanted) > 100 and wanted == {p: x for p, x in found.items() if p not in same}
    assert {b for _, b in same} <= {b for a, b in found if (a, b) in same}


def test_near_duplicates_of_short_texts(spark):
    """Texts of few characters lose no link, with each other or with longer ones."""
    rng = random.Random(14)
    given: dict[str, None] = {"ab": None, "": None}
    for _ in range(60):
        t = sentence(rng, rng.randint(1, 12))
        given |= dict.fromkeys([t, t[:-1], t + ".", t + " a", t[: len(t) // 2] + "x" + t[len(t) // 2 :]])
    rows = list(enumerate(given))
    own = fingerprints.fingerprints(list(given))
    prints = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    first = {}
    for r in sorted(prints.collect()):
        first.setdefault(r.fingerprint, r.doc_id)
    one = sorted(first.values())
    alike = {(a, b): fingerprints.likeness(len(rows[a][1]), own[a], len(rows[b][1]), own[b]) for b in one for a in one if a < b}
    for least in (0.7, 0.8, 0.9):
        found = {(r.rep, r.doc_id): r.likeness for r in fingerprints.near_duplicates(prints, least=least).collect()}
        wanted = {p: x for p, x in alike.items() if x >= least and min(len(own[p[0]]), len(own[p[1]])) < 64}
        assert len(wanted) > 10 and wanted.items() <= found.items()


# -- decontamination -------------------------------------------------------------------

QUESTION = "A farmer named John has 12 apples and gives 5 apples to Mary so how many apples does John keep now"


def test_reparameterised_questions():
    index = decontamination.Index([(1, QUESTION), (2, "too short")])
    other = QUESTION.replace("John", "Peter").replace("12", "31").replace("Mary", "Lucy")
    got = index.found([f"Before.\n{QUESTION}. After", f"x y {other} z", other.replace("does Peter", "does Karl").replace("named Peter", "named Bob"), QUESTION[:50], None, ""])
    assert [x[:1] for x in got[0]] == [(1, 1.0, False)[:1]] or got[0][0][0] == 1
    assert got[0][0][2] is False and got[1][0][0] == 1 and got[1][0][2] is True
    assert not got[2] or got[2][0][1] < 1.0
    assert got[3:] == [[], [], []]
    assert decontamination.template("In 2019 John Smith ran 12 km with Anna.") == "in <number> <name> <name> ran <number> <unit> with <name>"


def test_each_occurrence_counts():
    """Variants with other values beside each other hide neither a copy nor one another."""
    names = "Peter Lucy Karl Bob Anna Maria Hugo Nina Otto Paula".split()
    index = decontamination.Index([(1, QUESTION)])

    def variant(rng: random.Random) -> str:
        a, b = rng.sample(names, 2)
        x, y = rng.sample(range(20, 90), 2)
        return QUESTION.replace("John", a).replace("Mary", b).replace("12", str(x)).replace("5", str(y))

    rng = random.Random(5)
    for many in (1, 2, 3, 5, 12):
        for copy in (True, False):
            texts = []
            for _ in range(20):
                own = [variant(rng) for _ in range(many + 1 - copy)] + [QUESTION] * copy
                rng.shuffle(own)
                texts.append(rng.choice([". ", " ", "\nwell then "]).join(own))
            got = index.found(texts)
            assert all(len(g) == 1 and g[0][:2] == (1, 1.0) and g[0][2] is not copy for g in got), (many, copy, got)
    broken = [QUESTION.replace("named John", f"named {a}").replace("does John", f"does {b}") for a, b in zip(names[::2], names[1::2])]
    assert all(not g or g[0][1] < 1.0 for g in index.found([b for b in broken]))


def test_names_of_all_scripts_and_at_sentence_starts():
    pairs = [
        ("Tom has five red apples in the old basket. Tom gives Ann two apples", "Mike has nine red apples in the old basket. Mike gives Eva three apples"),
        ("Вчера утром Иван купил 3 килограмма яблок на старом рынке", "Вчера утром Пётр купил 7 килограмма яблок на старом рынке"),
        ("το πρωί ο Γιώργος έφυγε για το μεγάλο λιμάνι του νησιού", "το πρωί ο Νίκος έφυγε για το μεγάλο λιμάνι του νησιού"),
        ("le train de Émile roule trois heures vers la grande ville", "le train de Élodie roule sept heures vers la grande ville"),
        ("der Zug braucht fünf Stunden bis zur nächsten großen alten Stadt", "der Zug braucht zwölf Minuten bis zur nächsten großen alten Stadt"),
        ("el camión pesa siete kilogramos con toda la carga del puerto", "el camión pesa nueve gramos con toda la carga del puerto"),
    ]
    index = decontamination.Index([(k, a) for k, (a, _) in enumerate(pairs)])
    for k, (a, b) in enumerate(pairs):
        got = index.found([a, f"before. {b} after", f"then {b[0].lower()}{b[1:]}", a.upper() if a.isascii() else a])
        assert got[0] == [(k, 1.0, False)] and got[1] == [(k, 1.0, True)] and (not k or got[2] == [(k, 1.0, True)]), (k, got)
    mixed = "Mike has nine red apples in the old basket. Tom gives Eva three apples"
    assert index.found([mixed, f"so then Tom {pairs[0][0][4:]}"])[1] == [(0, 1.0, False)]
    assert all(c < 1.0 for _, c, _ in index.found([mixed])[0])


def plain_found(item: str, text: str) -> bool:
    """By definition: some alignment of the item's windows has consistent slots over enough of its words."""
    i, t = decontamination.Template([item]), decontamination.Template([text])
    n, m, w = len(i.exact), len(t.exact), decontamination.WIDTH
    for d in range(-n, m):
        stands: dict = {}
        for q in range(n):
            if 0 <= q + d < m and i.kinds[1][q] and t.kinds[1][q + d] == i.kinds[1][q]:
                c = stands.setdefault((int(i.kinds[1][q]), i.value(q)), {})
                c[t.value(q + d)] = c.get(t.value(q + d), 0) + 1
        best = {k: max(sorted(c), key=c.get) for k, c in stands.items()}
        fits = [
            0 <= q + d < m and (i.exact[q] == t.exact[q + d] or bool(i.kinds[1][q] and t.kinds[1][q + d] == i.kinds[1][q] and best[int(i.kinds[1][q]), i.value(q)] == t.value(q + d)))
            for q in range(n)
        ]
        covered = {q + k for q in range(n - w + 1) if all(fits[q : q + w]) for k in range(w)}
        if len(covered) >= decontamination.LEAST * n:
            return True
    return False


def test_found_as_by_definition():
    """Copies in place, with other values, and with words changed, against all alignments tried one by one."""
    rng = random.Random(21)
    names, kinds = "Anna Berta Carlo Dora Emil Flora".split(), ["km", "hours", "kg", "days"]

    def item() -> str:
        out = []
        for _ in range(rng.randint(8, 30)):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.12 else f"{rng.randint(2, 99)} {rng.choice(kinds)}" if x < 0.24 else rng.choice(WORDS) + rng.choice(WORDS))
        return " ".join(out)

    items = [item() for _ in range(60)]
    index = decontamination.Index(list(enumerate(items)))
    same = other = 0
    for k, x in enumerate(items):
        swap = dict(zip(names, rng.sample(names, len(names)))) | dict(zip(kinds, rng.sample(kinds, 4))) | {str(n): str(n + 100) for n in range(100)}
        words = x.split()
        changed = [swap.get(v, v) for v in words]
        damaged = [v if rng.random() < 0.93 else "zzz" for v in changed]
        for own in (words, changed, damaged):
            text = f"{item()} {' '.join(own)} {item()}"
            got, want = k in {f[0] for f in index.found([text])[0]}, plain_found(x, text)
            same += got == want
            other += got != want
            assert got or own is damaged, (x, own)
    assert other <= 0.05 * same, (same, other)


def test_every_benchmark_item_is_found(sf):
    """Each item of the table verbatim and re-parameterised; items besides it are not in clean texts."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    index = decontamination.Index([(r["item_id"], r["text"]) for r in rows if r["text"]])
    slotted = [f"{r['text']} Then Karl walks 12 km with Anna and Karl rests 3 hours near the {k} mill of Anna" for k, r in enumerate(rows) if r["text"]]
    more = decontamination.Index(list(enumerate(slotted)))
    found = [r["item_id"] in {f[0] for f in index.found([f"Before it. {r['text']} after it"])[0]} for r in rows if r["text"]]
    assert all(found)
    again = [k in {f[0] for f in more.found([x.replace("Karl", "Otto").replace("Anna", "Ida").replace("12", "45").replace(" 3 ", " 8 ")])[0]} for k, x in enumerate(slotted)]
    assert sum(again) >= 0.9 * len(again)


def test_common_templates_make_no_candidates():
    """Items that share a long beginning: a text with the beginning alone is compared with none of them."""
    start = "please read the following question with care and choose the best answer "
    rng = random.Random(3)
    items = [start + " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(12)) for _ in range(300)]
    index = decontamination.Index(list(enumerate(items)))
    seen = []
    real = index._occurrences
    index._occurrences = lambda *a: seen.append(a[2:]) or real(*a)
    assert index.found([start * 5, items[7]]) == [[], [(7, 1.0, False)]] and seen == [(1, 7)]


def test_items_dense_in_slots_and_short_ones():
    train, series = "A train ran 12 km in 3 hours and 5 km in 2 hours", "What number comes next: 2, 4, 8, 16, 32, 64, 128, 256"
    items = [train, series, "12, 7 and 19", "Who wrote Hamlet?", "boil three eggs slowly", "7 8 9 10 11 12 13", "..."]
    index = decontamination.Index(list(enumerate(items)))
    for k, x in enumerate(items[:-1]):
        for text in (x, f"Before it. {x} and after", f"5 6 {x.lower()} 3 4"):
            assert (k, 1.0, False) in index.found([text])[0], text
    assert index.found([items[-1], "boil three", "12, 7 and 20", "7 8 9 10 11 12 14", "Before\n7 8 9 10"]) == [[], [], [], [], []]
    other = train.replace("12", "70").replace("3", "4").replace("5", "9").replace("2 h", "8 h")
    assert index.found([f"x {other} y", series.replace("2, 4", "3, 6"), "boil nine eggs slowly"]) == [[(0, 1.0, True)], [(1, 1.0, True)], [(4, 1.0, True)]]
    assert index.found(["12 km in 3 hours", f"{train[:20]} zz", "boil three", "eggs slowly"]) == [[], [], [], []]
    assert index.found([train[:30], train[30:], "x"]) == [[], [], []]


def test_matches_and_filter(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    items = [(k, prose(rng.randint(12, 40))) for k in range(20)] + [(99, None), (98, "")]
    clean = [prose(100) for _ in range(30)]
    rows = [(k, t, 1) for k, t in enumerate(clean)] + [(100 + k, f"{clean[k]}\n{items[k][1]} and more", 1) for k in range(20)] + [(200, None, 1), (201, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, covered int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()} == {(100 + k, k) for k in range(20)}
    kept = decontamination.without_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {*range(30), 200, 201} and kept.columns == docs.columns
    assert decontamination.matches(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("name,value", [("BLOCK_ITEMS", 3), ("BLOCK_BYTES", 500)])
def test_blocks_of_items(spark, monkeypatch, name, value):
    monkeypatch.setattr(decontamination, name, value)
    test_matches_and_filter(spark)


def test_odd_benchmarks(spark):
    """Repeated items and rows, items with one template, a very long text, columns named like results."""
    long = " ".join(f"w{k % 977}x" for k in range(200_000)) + " " + QUESTION
    docs = spark.createDataFrame([(1, QUESTION, 1), (1, QUESTION, 1), (2, long, 2), (None, QUESTION, 3), (3, "w1x", 4)], "doc_id long, text string, item_id int")
    twin = QUESTION.replace("John", "Max").replace("12", "40")
    bench = spark.createDataFrame([(5, QUESTION, 0.5), (5, QUESTION, 0.5), (6, twin, 0.5), (None, "w1x", 0.5)], "item_id long, text string, covered double")
    rows = decontamination.matches(docs, bench).collect()
    assert sorted(r.doc_id for r in rows if r.item_id is None) == [2, 3]
    got = sorted((r.doc_id or 0, r.item_id, r.changed) for r in rows if r.item_id is not None)
    assert [g[:2] for g in got] == sorted([(d, i) for d in (0, 1, 1, 2) for i in (5, 5, 6)] )
    assert all(c is (i == 6) for _, i, c in got)
    assert [r.doc_id for r in decontamination.without_leaks(docs, bench.where("item_id is not null")).collect()] == [3]
