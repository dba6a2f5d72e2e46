"""Personal data: detection, and keyed surrogates that keep type, form and identity.

Method, in DataFrame functions only.  One pattern finds all entities of a text; each
gets a surrogate that depends on a key, its type and its canonical value, so the same
entity has the same surrogate everywhere and in each of its spellings.

* Digit strings (phone, social security, card numbers) and IPv4 addresses go through
  a keyed Feistel permutation: different values have different surrogates by
  construction.  Separators stay, and so do a phone's country code and a card's first
  digit; check digits are right again.  Long numbers are cards only if their check
  digit is right and their first digits are those of cards; other numbers stay.
* Names behind forms of address get surnames and given names made of syllables of
  their script (Latin, Greek, Cyrillic); hyphens, apostrophes, initials and particles
  stay.  Surname and given name are separate entities, so "Mr. Smith" and "Mr. John
  Smith" stay the same person, and so do later mentions of either word in the same text
  without a form of address.  A given name's ending has the gender that the forms of
  address in the text state; the rest of it does not depend on that.
* Mail addresses, access keys, secrets and account numbers keep their form: letters
  become letters, digits digits, all else stays.  A mail address keeps its last label, an
  account number its country, and its check digits are right again if they were.

Surrogates are checked over all texts: entities with the same surrogate (all but the
first), and those whose surrogate is a real entity of the texts, get another attempt,
round after round, until there are none.  The exceptions are joined back.

Defined results: null stays null, texts without entities are returned as they are.
Equal texts get equal results, repeated rows each theirs.  Where one match could be
several types the first of :data:`PATTERNS` decides.  A column of the input named like
an output column is replaced; other columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, free, materialise

# Forms of address by gender, particles of names, syllables of surrogate
# names by script, and telephone country codes of one and two digits.
MALE = ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "Don", "Κύριος", "Κύριε", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Κυρία", "Госпожа")
EITHER = ("Dr", "Doctor", "Prof", "Professor", "Docteur", "Doktor", "Profesor", "Профессор", "Доктор", "Καθηγητής")
PARTICLES = ("von", "van", "der", "den", "zu", "de", "del", "de la", "la", "le", "da", "di", "du", "y")
SYLLABLES = {
    "latin": "ba be bo da del do fa fen ga gor ha hel ka kel la len lo ma mer mo na nor pa per ra ro sa sel ta tor va ven".split(),
    "greek": "βα βε γο δα δελ ζη θα θερ κα κελ λα λεν μα μερ μο να νορ πα περ ρα ρο σα σελ τα τορ φα φεν χα χελ ψι λο δο".split(),
    "cyrillic": "ба бе бо ва вел го да дел до жа за зор ка кел ла лен ло ма мер мо на нор па пер ра ро са сел та тор фа хо".split(),
}
ENDINGS = {
    "latin": ("us", "ina", "en"),
    "greek": ("ος", "ίνα", "ι"),
    "cyrillic": ("ий", "ина", "ен"),
}
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_FORMS = "|".join(sorted((*MALE, *FEMALE, *EITHER), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A word of a name, with an apostrophe inside or hyphens; and what may stand before one.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:-\p{Lu}(?:['’]\p{Lu})?\p{Ll}+)*+"
_BEFORE = rf"(?:(?:{'|'.join(PARTICLES)}|\p{{Lu}}\.)[  ])"
_ADDRESS = rf"(?:(?:{_FORMS})\b\.?\s{{1,3}}){{1,3}}"
#: Patterns by type, in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.?(?<=\.[A-Za-z]{2,24})",
    "secret": r"\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?:[A-Za-z0-9+/_-]{8,}|(?=[A-Za-z+/_-]{0,6}\d)[A-Za-z0-9+/_-]{5,7})",
    "access": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d(+.-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|\+(?=\d(?:[ ./()-]{0,2}\d){7,14}(?!\d))[1-9]\d{0,2}(?:[ ./-]?\(?\d{1,8}\)?){1,6}(?<=\d)(?!\d))",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b(?<=\d[A-Z0-9 ]{10,30})",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "name": rf"\b{_ADDRESS}{_BEFORE}{{0,2}}{_WORD}(?:[  ]{_BEFORE}{{0,2}}{_WORD}){{0,2}}",
}
ANY = "(?U)" + "|".join(f"(?:{p})" for p in PATTERNS.values())
_FIRSTS = "".join(sorted({f[0] for f in (*MALE, *FEMALE, *EITHER)}))
#: A text that doesn't match this has no entity.  The look-ahead keeps most characters
#: from being tried against every form of address.
HINT = rf"[0-9@=:]|\b(?:AKIA|ASIA)[0-9A-Z]|(?=[{_FIRSTS}])\b(?:{_FORMS})\b"
#: A match of :data:`PATTERNS` that is a name behind a form of address.
NAME = rf"(?U)^(?:{PATTERNS['name']})$"


def _hash(key: str, *parts: Column) -> Column:
    """52 bits of a keyed hash as a non-negative number."""
    text = F.concat_ws("|", F.lit(key), *parts)
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(m: Column) -> Column:
    """The type of a match: the first pattern that fits it; "mention" for a later mention of a name, "none" for a number that is no card."""
    out = F
    for kind in ("email", "access", "ip", "ssn", "phone", "iban", "secret"):
        # look-arounds hold for the match in its text; here the match stands alone
        out = out.when(m.rlike(f"(?U)^(?:{PATTERNS[kind]})$"), F.lit(kind))
    is_card = _let(_digits(m), lambda d: d.rlike("^(?:[3-6]|2[2-7])") & (_luhn(d.substr(F.lit(1), F.length(d) - 1)) == d.substr(F.length(d), F.lit(1)).cast("int")))
    out = out.when(m.rlike(f"(?U)^(?:{PATTERNS['card']})$"), F.when(is_card, F.lit("card")).otherwise(F.lit("none")))
    return out.when(m.rlike(NAME), F.lit("name")).otherwise(F.lit("mention"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def canonical(m: Column, kind: Column) -> Column:
    """What all spellings of an entity share."""
    digits = _digits(m)
    # behind the country code; a number of ten digits without one is the same as with one
    national = F.when(m.startswith("+"), F.regexp_replace(digits, rf"^(?:{COUNTRY}|\d{{3}})", "")).otherwise(digits)
    return (
        F.when(kind == "phone", national)
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "secret", F.regexp_extract(m, r"[=:]\s{0,3}[\"']?(.*)$", 1))
        .when(kind == "email", F.lower(m))
        .otherwise(m)
    )


def _feistel(key: str, kind: Column, left: Column, right: Column, left_mod: Column, right_mod: Column) -> Column:
    """A keyed permutation of pairs of numbers below the two moduli."""

    def turn(state: Column, k: Column) -> Column:
        a, b = state["a"], state["b"]
        even = k % 2 == 0
        add = _hash(key, kind, k.cast("string"), F.when(even, b).otherwise(a).cast("string"))
        return F.struct(
            F.when(even, F.pmod(a + add, left_mod)).otherwise(a).alias("a"),
            F.when(even, b).otherwise(F.pmod(b + add, right_mod)).alias("b"),
        )

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(6)]), start, turn)


def _permuted(key: str, kind: Column, digits: Column) -> Column:
    """Another digit string of the same length, one to one."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    out = _feistel(
        key, F.concat(kind, n.cast("string")),
        digits.substr(F.lit(1), h).cast("bigint"), digits.substr(h + 1, n - h).cast("bigint"), ten(h), ten(n - h),
    )
    return _let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), h, "0"), F.lpad(o["b"].cast("string"), n - h, "0")))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind ``digits``."""

    def of(digits: Column) -> Column:
        n = F.length(digits)

        def add(total: Column, k: Column) -> Column:
            d = digits.substr(k, F.lit(1)).cast("int")
            twice = d * 2
            doubled = F.when(twice > 9, twice - 9).otherwise(twice)
            return total + F.when((n - k) % 2 == 0, doubled).otherwise(d)

        return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))

    return _let(digits, of)


def _reformatted(m: Column, digits: Column) -> Column:
    """``m`` with its last digits replaced by ``digits``; all else stays."""

    def with_(given: Column) -> Column:
        def put(state: Column, ch: Column) -> Column:
            is_digit = ch.rlike("^[0-9]$")
            at = state["k"] - given["skip"]
            new = F.when(is_digit & (at >= 0), given["digits"].substr(at + 1, F.lit(1))).otherwise(ch)
            return F.struct(F.concat(state["s"], new).alias("s"), (state["k"] + is_digit.cast("int")).alias("k"))

        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), put)["s"]

    numbered = _let(digits, lambda d: F.struct(d.alias("digits"), (F.length(_digits(m)) - F.length(d)).alias("skip")))
    return _let(numbered, with_)


def _formed(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Characters of a keyed hash in the form of ``canon``: a letter for a letter, a digit for a digit; all else stays."""
    parts = [F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.lit(k)).cast("binary"), 256) for k in range(4)]

    def drawn(hexes: Column) -> Column:
        def pick(ch: Column, k: Column) -> Column:
            def put(h: Column) -> Column:
                byte = F.conv(h, 16, 10).cast("int")
                out = F
                for form, alphabet in (("^[0-9]$", "0123456789"), ("^[a-z]$", "abcdefghijklmnopqrstuvwxyz"), ("^[A-Z]$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
                    out = out.when(ch.rlike(form), F.lit(alphabet).substr(F.pmod(byte, F.lit(len(alphabet))) + 1, F.lit(1)))
                return out.otherwise(ch)

            return put(hexes.substr(F.pmod(k * 2, F.lit(253)) + 1, F.lit(4)))

        return F.array_join(F.transform(F.split(canon, ""), pick), "")

    return _let(F.concat(*parts), drawn)


def _hexed(key: str, canon: Column, attempt: Column) -> Column:
    """Hexadecimal digits, as many as ``canon`` has."""
    digest = [F.sha2(F.concat_ws("|", F.lit(key), F.lit("hex"), canon, attempt.cast("string"), F.lit(k)).cast("binary"), 256) for k in range(4)]
    return F.rpad(F.concat(*digest), F.length(canon), "0")


def _rest_of_97(text: Column) -> Column:
    """An account number modulo 97, letters counting as two digits."""

    def add(rest: Column, ch: Column) -> Column:
        letter = F.ascii(ch) - 55
        return F.when(ch.rlike("^[0-9]$"), (rest * 10 + ch.try_cast("int")) % 97).otherwise((rest * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _account(key: str, canon: Column, attempt: Column) -> Column:
    """An account number of the same country and form; its check digits are as far off the right ones as before."""

    def right(body: Column) -> Column:
        return 98 - _rest_of_97(F.concat(body, F.substring(canon, 1, 2), F.lit("00")))

    n = F.length(canon)
    old = canon.substr(F.lit(5), n - 4)

    def put(new: Column) -> Column:
        off = F.substring(canon, 3, 2).cast("int") - right(old)
        return F.concat(F.substring(canon, 1, 2), F.lpad((F.pmod(right(new) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0"), new)

    return _let(_formed(key, F.lit("iban"), old, attempt), put)


def _address(key: str, canon: Column, attempt: Column) -> Column:
    """A mail address of the same form; addresses of one domain stay in one."""
    local, domain = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(canon, F.lit("@"), F.lit(2))
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]+\.?$", 1)
    more = F.when(attempt > 0, _formed(key, F.lit("more"), F.regexp_replace(F.sha2(canon.cast("binary"), 256), "[0-9]", "x").substr(F.lit(1), F.lit(8)), attempt)).otherwise(F.lit(""))
    start = F.concat(_formed(key, F.lit("email"), F.concat(local, F.lit("@"), domain), attempt), F.lit(""))
    return F.concat(F.split_part(start, F.lit("@"), F.lit(1)), more, F.lit("@"), _formed(key, F.lit("domain"), labels, F.lit(0)), F.regexp_extract(domain, r"(\.[^.]+\.?)$", 1))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _named(key: str, kind: Column, word: Column, attempt: Column, gender: Column | None) -> Column:
    """A capitalised name in the script of ``word``; a later attempt is two syllables longer."""

    def made(h: Column) -> Column:
        out = F
        for script, syllables in SYLLABLES.items():
            table = F.array(*[F.lit(s) for s in syllables])
            many = F.lit(4 if gender is None else 3) + F.least(attempt, F.lit(3)) * 2
            body = F.array_join(F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.element_at(table, (F.pmod(_shifted(h, k), F.lit(32)) + 1).cast("int"))), "")
            if gender is not None:
                male, female, either = ENDINGS[script]
                body = F.concat(body, F.when(gender == "m", F.lit(male)).when(gender == "f", F.lit(female)).otherwise(F.lit(either)))
            out = out.when(_script(word) == script, F.initcap(body))
        return out

    return _let(_hash(key, kind, word, attempt.cast("string")), made)


def _shifted(h: Column, k: Column) -> Column:
    """The ``k``-th five bits."""
    return F.floor(h / F.pow(F.lit(32.0), k)).cast("bigint")


def _gender(m: Column) -> Column:
    """What the forms of address in front of a name state: "m", "f" or "x"."""
    male, female = (rf"(?U)^(?:(?:{_FORMS})\b\.?\s+)*?(?:{'|'.join(forms)})\b" for forms in (MALE, FEMALE))
    return F.when(m.rlike(male), F.lit("m")).when(m.rlike(female), F.lit("f")).otherwise(F.lit("x"))


_PART = r"(?U)(\p{Lu}['’](?=\p{Lu}))?(\p{Lu}\p{Ll}+)"


def _name_parts(m: Column) -> Column:
    """The words of a name, particles, initials and leading letters with apostrophes aside; hyphenated ones as several."""
    body = F.regexp_replace(m, rf"(?U)^{_ADDRESS}", "")
    return F.regexp_extract_all(body, F.lit(_PART), F.lit(2))


def _surnames(m: Column) -> Column:
    """How many of the name's words belong to its last one."""
    return F.size(F.regexp_extract_all(F.regexp_extract(m, r"(?U)\S+$", 0), F.lit(_PART), F.lit(2)))


def known_names(matches: Column) -> Column:
    """The words of the names behind forms of address in a text: an array of (word, kind).

    A word that is a given name and a surname is a surname.
    """
    names = F.filter(matches, lambda m: m.rlike(NAME))

    def words_of(m: Column) -> Column:
        parts = _name_parts(m)
        given = F.size(parts) - _surnames(m)
        return F.transform(parts, lambda w, k: F.struct(w.alias("word"), F.when(k >= given, F.lit("s")).otherwise(_gender(m)).alias("sort")))

    def of(words: Column) -> Column:
        def kind(w: Column) -> Column:
            sorts = F.transform(F.filter(words, lambda o: o["word"] == w), lambda o: o["sort"])
            male, female = F.array_contains(sorts, "m"), F.array_contains(sorts, "f")
            given = F.when(male & ~female, F.lit("given-m")).when(female & ~male, F.lit("given-f")).otherwise(F.lit("given-x"))
            return F.when(F.array_contains(sorts, "s"), F.lit("surname")).otherwise(given)

        return F.transform(F.array_distinct(F.transform(words, lambda o: o["word"])), lambda w: F.struct(w.alias("word"), kind(w).alias("kind")))

    return _let(F.flatten(F.transform(names, words_of)), of)


def pattern_with(names: Column) -> Column:
    """:data:`ANY`, and mentions of known names as whole words."""
    return F.concat(F.lit(ANY + r"|\b(?:"), F.array_join(F.transform(names, lambda n: n["word"]), "|"), F.lit(r")\b"))


def entities(m: Column, names: Column) -> Column:
    """The entities in a match: an array of (kind, canon).  A name is one for each word."""
    words = F.when(m.rlike(NAME), _name_parts(m)).otherwise(F.array(m))

    def known(w: Column) -> Column:
        kind = F.filter(names, lambda n: n["word"] == w)
        return F.struct(F.element_at(F.transform(kind, lambda n: n["kind"]), 1).alias("kind"), w.alias("canon"))

    one = lambda kind: F.array(F.struct(kind.alias("kind"), canonical(m, kind).alias("canon")))
    none = F.array().cast("array<struct<kind:string,canon:string>>")
    return _let(
        kind_of(m), lambda kind: F.when(kind == "none", none).when(kind.isin("name", "mention"), F.transform(words, known)).otherwise(one(kind))
    )


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity's canonical value."""
    n = F.length(canon)
    turn = F.when(attempt > 0, attempt.cast("string")).otherwise(F.lit(""))
    first, rest = canon.substr(F.lit(1), F.lit(1)), canon.substr(F.lit(2), n - 2)
    card = _let(
        F.concat(first, _permuted(key, F.concat(F.lit("card"), turn), rest)), lambda new: F.concat(new, _luhn(new).cast("string"))
    )
    octet = [F.split_part(canon, F.lit("."), F.lit(k)).cast("bigint") for k in (1, 2, 3, 4)]
    two = F.lit(65536).cast("bigint")
    ip = _feistel(key, F.concat(F.lit("ip"), turn), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], two, two)
    address = _let(ip, lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.floor(o["a"] / 256), o["a"] % 256, F.floor(o["b"] / 256), o["b"] % 256)]))
    access = F.concat(F.substring(canon, 1, 4), _formed(key, kind, canon.substr(F.lit(5), n), attempt))
    return (
        F.when(kind.isin("phone", "ssn"), _permuted(key, F.concat(kind, turn), canon))
        .when(kind == "card", card)
        .when(kind == "ip", address)
        .when(kind == "email", _address(key, canon, attempt))
        .when(kind == "access", access)
        .when(kind == "iban", _account(key, canon, attempt))
        .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), _hexed(key, canon, attempt))
        .when(kind == "secret", _formed(key, kind, canon, attempt))
        .when(kind == "surname", _named(key, kind, canon, attempt, None))
        .otherwise(_named(key, F.lit("given"), canon, attempt, F.substring(kind, -1, 1)))
    )


def _in_form(m: Column, given: Column) -> Column:
    """``m`` with blanks where they were and the characters of ``given`` for the others."""

    def put(state: Column, ch: Column) -> Column:
        blank = ch == " "
        return F.struct(
            F.concat(state["s"], F.when(blank, ch).otherwise(given.substr(state["k"] + 1, F.lit(1)))).alias("s"),
            (state["k"] + F.when(blank, F.lit(0)).otherwise(F.lit(1))).alias("k"),
        )

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("k")), put)["s"]


def _renamed(m: Column, parts: Column) -> Column:
    """A name with its words replaced one after another; all else stays."""
    address = F.regexp_extract(m, rf"(?U)^{_ADDRESS}", 0)
    body = F.regexp_replace(m, rf"(?U)^{_ADDRESS}", "")
    # what stands between the words: the second group of the pattern is what is replaced
    between = F.split(F.regexp_replace(body, _PART, "$1\u0001"), "\u0001", -1)
    return F.concat(address, F.array_join(F.zip_with(between, parts, lambda b, p: F.concat(b, F.coalesce(p, F.lit("")))), ""))


def _replacement(key: str, m: Column, names: Column, attempts: Column | None) -> Column:
    """The text that takes the place of a match, and how many entities that are (1 or 0)."""
    parts = F.transform(
        entities(m, names),
        lambda e: surrogate(
            key, e["kind"], e["canon"],
            F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("|", e["kind"], e["canon"])), F.lit(0)),
        ),
    )

    def put(given: Column) -> Column:
        kind, one = given["kind"], F.try_element_at(given["parts"], F.lit(1))
        text = (
            F.when(kind == "none", m)
            .when(kind == "name", _renamed(m, given["parts"]))
            .when(kind.isin("phone", "ssn", "card"), _reformatted(m, one))
            .when(kind == "iban", _in_form(m, one))
            .when(kind == "secret", F.concat(F.regexp_extract(m, r"^.*?[=:]\s{0,3}[\"']?", 0), one))
            .otherwise(one)
        )
        return F.struct(text.alias("text"), F.when(kind == "none", F.lit(0)).otherwise(F.lit(1)).alias("n"))

    return _let(F.struct(kind_of(m).alias("kind"), parts.alias("parts")), put)


def _matched(docs: DataFrame, body: Column, found: str) -> DataFrame:
    """``docs`` with a column ``found``: (names, pattern, m) of the text, or null without a hint of an entity."""
    first = F.when(body.rlike(HINT), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))

    def with_names(matches: Column) -> Column:
        def of(names: Column) -> Column:
            pattern = F.when(F.size(names) > 0, pattern_with(names))
            again = F.when(F.size(names) > 0, F.regexp_extract_all(body, pattern_with(names), F.lit(0))).otherwise(matches)
            return F.struct(names.alias("names"), pattern.alias("pattern"), again.alias("m"))

        return F.when(matches.isNotNull() & (F.size(matches) > 0), _let(known_names(matches), of))

    # a generator of one element: matches are looked for once, however often they are used
    return docs.withColumn(found, F.explode(F.array(first))).withColumn(found, F.explode(F.array(with_names(F.col(f"`{found}`")))))


def _entities_of(found: str) -> Column:
    f = F.col(f"`{found}`")
    return F.flatten(F.transform(f["m"], lambda m: entities(m, f["names"])))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of all texts: kind, canon."""
    given = _matched(docs.select(F.col(text).alias("t")), F.col("t"), "found").where("found is not null")
    return given.select(F.explode(_entities_of("found")).alias("e")).select("e.kind", "e.canon").distinct()


def exceptions(found: DataFrame, key: str, rounds: int = 8) -> DataFrame | None:
    """Entities that need another attempt: kind, canon, attempt; None if there are none.

    Raises if collisions remain after ``rounds`` rounds.
    """
    from pyspark.sql import Window

    sort = F.regexp_replace("kind", "-.$", "")
    now = materialise(found.withColumn("attempt", F.lit(0)).withColumn("s", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))), "entities")
    real = now.select(sort.alias("sort"), F.lower("canon").alias("l"), F.lit(True).alias("real")).distinct()
    for turn in range(1, rounds + 1):
        order = Window.partitionBy("sort", "l").orderBy("attempt", "canon", "kind")
        keyed = now.withColumn("sort", sort).withColumn("l", F.lower("s"))
        ranked = keyed.withColumn("r", F.row_number().over(order)).join(real, ["sort", "l"], "left")
        again = (F.col("r") > 1) | F.col("real").isNotNull()
        moved = materialise(ranked.select("kind", "canon", "attempt", "s", again.alias("again")), "entities")
        if moved.where("again").isEmpty():
            discard(moved)
            return None if turn == 1 else now.where("attempt > 0").select("kind", "canon", "attempt")
        attempt = F.when(F.col("again"), F.lit(turn)).otherwise(F.col("attempt"))
        moved = moved.select("kind", "canon", attempt.alias("attempt"), "s", "again")
        new = F.when(F.col("again"), surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))).otherwise(F.col("s"))
        now = materialise(moved.select("kind", "canon", "attempt", new.alias("s")), "entities")
    raise RuntimeError("surrogates still collide; use another key")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and their number as ``count``."""
    special = exceptions(find(docs, text), key)
    cols = [c for c in docs.columns if c.lower() not in (count.lower(), text.lower())]
    body = F.col(f"`{text}`")
    found, tag, map_, new = (free(docs, f"__{n}") for n in ("found", "tag", "attempts", "new"))
    attempts = None
    if special is not None:
        given = _matched(docs.select(body.alias("t")), F.col("t"), "found").where("found is not null")
        hit = given.select(F.md5(F.col("t").cast("binary")).alias(tag), F.explode(_entities_of("found")).alias("e"))
        each = hit.select(tag, "e.kind", "e.canon").distinct().join(special, ["kind", "canon"]).groupBy(tag).agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias(map_)
        )
        docs = docs.withColumn(tag, F.md5(body.cast("binary"))).join(each, tag, "left")
        attempts = F.col(map_)
    given = _matched(docs, body, found)
    f = F.col(f"`{found}`")
    made = F.transform(f["m"], lambda m: _replacement(key, m, f["names"], attempts))
    given = given.withColumn(new, F.explode(F.array(made)))
    pieces = F.when(f["pattern"].isNull(), F.split(body, ANY, -1)).otherwise(F.split(body, f["pattern"], F.lit(-1)))
    joined = F.array_join(F.zip_with(pieces, F.col(new), lambda p, s: F.concat(p, F.coalesce(s["text"], F.lit("")))), "")
    n = F.aggregate(F.coalesce(F.transform(F.col(new), lambda s: s["n"]), F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)
    any_ = F.size(F.coalesce(F.col(new), F.array().cast(given.schema[new].dataType))) > 0
    return given.select(*[F.col(f"`{c}`") for c in cols], F.when(any_, joined).otherwise(body).alias(text), n.alias(count))
