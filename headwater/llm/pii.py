"""Surrogates for personal data with DataFrame and SQL functions only.

One pattern finds all entities of a text; the text is split by the same pattern and rebuilt with the surrogates in
place, inside its own row. A surrogate is a function of a secret key and the entity's canonical form (case folded,
separators dropped, a North American number with or without its +1), so every mention of an entity gets the same one, in the
mention's own format: digits for digits, letters of the same script and case, vowels for vowels in names, given names of the
same gender and script, valid check digits where they were valid, country prefixes and titles kept. The words of a detected
name are also replaced where they stand alone in the same text.

Distinctness is checked over the whole corpus: distinct entities (pre-aggregated) whose surrogates coincide with one
another or with any real entity are drawn again, round by round, until none is left. After ``ROUNDS`` draws of the
entity's own length each further draw is one character longer, so even where all short names are taken there is a free
one and the rounds end. Only such exceptions, usually none, are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.shared import BROADCAST_ROWS, bounded, cut, fresh

# Titles by gender and given names by script and gender, in parallel use.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Sir", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "г-н", "г-жа", "κ", "κα")
#: The same in capitals, where they are not a small letter by custom.
CAPITALS = tuple(t.upper() for t in TITLES if t[0].isupper())
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "David", "Carlos", "José", "Luis", "Pierre", "Jacques", "Hans", "Karl", "Peter", "Thomas", "Paul", "Antonio"),
    ("latin", "f"): ("Mary", "Anna", "Maria", "Laura", "Linda", "Carmen", "Lucía", "Marie", "Claire", "Julia", "Sofia", "Elena", "Greta", "Ingrid", "Susan", "Emma"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης", "Παναγιώτης"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Βασιλική", "Σοφία", "Άννα"),
}
# Vowels and consonants of the three scripts.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxz", r"[\p{IsLatin}]"),
    "cyrillic": ("аеиоуэюя", "бвгджзклмнпрстфхцчшщ", r"[\p{IsCyrillic}]"),
    "greek": ("αειουωη", "βγδζθκλμνξπρστφχψ", r"[\p{IsGreek}]"),
}
# Letters of further scripts (of Hangul and Han: frequent syllables and family names). Letters of any other
# script give way to Latin ones.
OTHERS = {
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
    "Georgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "Thai": "กขคงจชซดตถทนบปผพฟมยรลวสหอ",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    "Han": "王李张刘陈杨赵黄周吴徐孙马朱胡林郭何高罗",
}
# Country calling codes of one and of two digits; all others have three.
CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: Draws of an entity's own length before they grow.
ROUNDS = 8

_END = r"(?![\p{L}\p{N}_])"
_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_LOUD = rf"\p{{Lu}}[\p{{Lu}}'’-]{{1,40}}{_END}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kind -> pattern, tried in this order where no letter, digit or joining mark stands before.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "key": rf"(?:AKIA|ASIA)[0-9A-Z]{{16}}{_END}|(?:ghp|gho|sk|pk)_[A-Za-z0-9]{{16,}}+{_END}",
    "secret": rf"(?=[A-Za-z0-9]{{16}})(?<=(?i:token|secret|password|passwd|key)[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[A-Za-z0-9]{{16,}}+{_END}",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "ip": rf"\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_END}(?!\.\d)",
    "ip6": rf"(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{0,6}}){_END}(?!:)",
    "card": rf"\d(?:[ -]?\d){{12,18}}{_END}",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}{_END}(?!-)",
    # Numbers in threes and fours; with all digits after a plus; North American with a leading 1; in pairs; with a slash; international in any groups.
    "phone": "|".join((
        rf"(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\) ?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]?\d{{3,4}}{_END}",
        rf"\+\d{{8,15}}{_END}",
        rf"1[ .-](?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_END}",
        rf"0\d(?:[ .-]\d{{2}}){{4}}{_END}",
        rf"0\d{{2,4}} ?/ ?\d{{4,9}}(?:-\d{{1,4}})?{_END}",
        rf"(?=\+(?:[ ./()-]{{0,2}}\d){{8,15}}{_END})\+\d{{1,3}}(?:[ ./-]?\(?\d{{1,4}}\)?){{2,6}}{_END}",
    )),
    "name": rf"(?:{'|'.join(TITLES)})\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(CAPITALS)})\.? {_LOUD}(?: {_LOUD})?|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {_WORD}",
}
PATTERN = r"(?<![\p{L}\p{N}_.%+-])(?:" + "|".join(PATTERNS.values()) + ")"
#: What a text has at least if it has any entity, kind by kind; spares the rest of the pattern. Every kind's pattern implies a branch: an at sign, a digit,
#: a prefix of keys, a word for secrets before its sign, or a title or given name before a capital.
HINT = (
    r"[@0-9]|(?:AKIA|ASIA|ghp|gho|sk_|pk_)|(?i:token|secret|password|passwd|key)[\"']?\s{0,2}[=:]|(?<!\p{L})(?=\p{Lu}|г-|κ)(?:"
    + "|".join((*TITLES, *CAPITALS, *(n for names in GIVEN.values() for n in names))) + r")\.? \p{Lu}"
)

Attempt = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and stands once in the plan, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entities(text: Column) -> Column:
    """array<string>: all entities of a text in order; empty for null."""
    return F.when(F.coalesce(text.rlike(HINT), F.lit(False)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email").when(e.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk_|pk_)"), "key").when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(e.contains(":") & e.rlike("^[0-9A-Fa-f:]+$"), "ip6")
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), "iban").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card")
        .when(e.rlike(r"^[A-Za-z0-9]{16,}$") & (e.rlike(r"\d") | ~e.rlike(r"^\p{Lu}\p{Ll}+$")), "secret").when(e.rlike(r"^[+(\d]"), "phone").otherwise("name")
    )


def unit(e: Column) -> Column:
    """Kind and canonical form: what is one entity. Of names, each word is its own."""
    plain = F.regexp_replace(e, r"[^\p{L}\p{N}]", "")
    phone = F.when(e.rlike(r"^(?:\+|1[ .-])"), F.regexp_replace(plain, r"^1(?=\d{10}$)", "")).otherwise(plain)
    canonical = lambda k: F.when(k.isin("email", "name", "ip6"), F.lower(e)).when(k == "ip", e).when(k == "phone", phone).otherwise(plain)
    return let(kind(e), lambda k: F.concat(k, F.lit(":"), canonical(k)))


def _random(seed: Column, j: Column) -> Column:
    """20 keyed bits for place j."""
    return F.conv(F.substring(F.sha2(F.concat(seed, F.lit("#"), F.floor(j / 12).cast("string")), 256), (j % 12) * 5 + 1, F.lit(5)), 16, 10).cast("int")


def _pick(alphabet: str, r: Column) -> Column:
    return F.substring(F.lit(alphabet), r % len(alphabet) + 1, F.lit(1))


def _letter(c: Column, r: Column, as_name: bool) -> Column:
    return let(F.lower(c), lambda low: _cased(c, low, r, as_name))


def _cased(c: Column, low: Column, r: Column, as_name: bool) -> Column:
    """A letter of the alphabet of ``low``'s script (of its vowels or consonants in a name) in the case of ``c``."""
    out = F
    for vowels, consonants, script in LETTERS.values():
        if as_name:
            out = out.when(low.rlike(f"[{vowels}]"), vowels)
        out = out.when(low.rlike(script), consonants if as_name else vowels + consonants)
    for script, letters in OTHERS.items():
        out = out.when(low.rlike(rf"\p{{Is{script}}}"), letters)
    latin = LETTERS["latin"]
    new = let(out.otherwise(latin[0] + latin[1]), lambda letters: F.substring(letters, r % F.length(letters) + 1, F.lit(1)))
    return let(new, lambda x: F.when(c != low, F.upper(x)).otherwise(x))


def _poured(e: Column, seed: Column, kept: Column, as_name: bool = False, from_end: Column | None = None, hexadecimal: Column | None = None) -> Column:
    """The format of ``e`` with keyed digits and letters; the first ``kept`` of them stay. Where ``from_end``, places count from the end."""

    def fill(plain: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            def at(j: Column) -> Column:
                def drawn(r: Column) -> Column:
                    letter = _letter(c, r, as_name)
                    if hexadecimal is not None:
                        letter = F.when(hexadecimal, F.when(c.rlike("[A-F]"), _pick("ABCDEF", r)).otherwise(_pick("abcdef", r))).otherwise(letter)
                    return F.when(c.rlike(r"\p{N}"), (r % 10).cast("string")).otherwise(letter)

                place = j if from_end is None else F.when(from_end, F.length(plain) - 1 - j).otherwise(j)
                return F.when(j < kept, c).otherwise(let(_random(seed, place), drawn))

            place = F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
            return F.when(c.rlike(r"[\p{L}\p{N}]"), let(place, at)).otherwise(c)

        return F.array_join(F.transform(F.split(e, ""), one), "")

    return fill(F.lit("")) if from_end is None else let(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""), fill)


def _longer(s: Column, seed: Column, n: Column) -> Column:
    """``s`` with ``n`` more characters of the kind of its last one."""

    def more(last: Column) -> Column:
        one = lambda r: F.when(last.rlike(r"\p{N}"), (r % 10).cast("string")).otherwise(_letter(last, r, False))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: let(_random(F.concat(seed, F.lit("+")), i), one)), "")

    return let(s, lambda v: F.when(n > 0, F.concat(v, let(F.lower(F.substring(v, F.lit(-1), F.lit(1))), more))).otherwise(v))


def _luhn(digits: Column) -> Column:
    """Sum that is a multiple of 10 for valid numbers."""
    d = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0), lambda a, x: a + x,
    )


def _card(e: Column, new: Column) -> Column:
    """``new`` with a valid check digit where ``e`` has one."""
    digits = lambda x: F.regexp_replace(x, r"\D", "")

    def valid(head: Column) -> Column:
        return F.concat(head, ((10 - _luhn(F.concat(digits(head), F.lit("0"))) % 10) % 10).cast("string"))

    return F.when(_luhn(digits(e)) % 10 == 0, let(F.substring(new, F.lit(1), F.length(new) - 1), valid)).otherwise(new)


def _mod97(s: Column) -> Column:
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike(r"\d"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0).cast("long"), lambda a, v: (a * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97)


def _iban(e: Column, new: Column) -> Column:
    """``new`` with valid check digits where ``e`` has them."""
    plain = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    country, rest = F.substring(new, F.lit(1), F.lit(2)), F.substring(new, F.lit(5), F.length(new))
    valid = F.concat(country, F.lpad((98 - _mod97(plain(F.concat(country, F.lit("00"), rest)))).cast("string"), 2, "0"), rest)
    return F.when(_mod97(plain(e)) == 1, valid).otherwise(new)


def _email(e: Column, seed: Column, key: str, grow: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(_longer(_poured(local, seed, F.lit(0)), seed, grow), F.lit("@"), _poured(labels, F.concat(F.lit(f"{key}|domain|"), F.lower(domain)), F.lit(0)), top)


def _given(word: Column, key: str) -> Column | None:
    """Given names move to the next in a keyed order of their own list (script, gender): no two meet, none stays."""
    import hashlib

    out = F
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).digest())
        for i, name in enumerate(order):
            out = out.when(word == name, order[(i + 1) % len(order)])
    return out


def _is_title(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "").isin(*TITLES, *CAPITALS)


def _is_given(word: Column) -> Column:
    return word.isin(*[n for names in GIVEN.values() for n in names])


def _word(w: Column, key: str, attempt: Attempt) -> Column:
    """The surrogate of one word of a name that is no title."""

    def drawn(u: Column) -> Column:
        return let(attempt(u), lambda n: let(_seed(key, u, n), lambda s: _longer(_poured(w, s, F.lit(0), True), s, n - ROUNDS)))

    return _given(w, key).otherwise(let(F.concat(F.lit("name:"), F.lower(w)), drawn))


def _seed(key: str, u: Column, attempt: Column) -> Column:
    return F.concat(F.lit(f"{key}|"), u, F.lit("|"), attempt.cast("string"))


def surrogate(e: Column, key: str, attempt: Attempt) -> Column:
    """The surrogate of one entity; ``attempt`` gives the number of draws that a unit has failed."""

    def of(k: Column, s: Column, n: Column) -> Column:
        grow = n - ROUNDS
        code = F.when(e.startswith("+"), F.length(F.regexp_extract(F.regexp_replace(e, r"\D", ""), CODES + r"|^\d{3}", 0))).when(e.rlike(r"^1[ .-]"), 1).otherwise(0)
        octets = F.array_join(F.transform(F.split(e, r"\."), lambda o, i: (1 + _random(s, i) % 254).cast("string")), ".")
        prefix = F.when(e.rlike("^A"), 4).otherwise(F.length(F.regexp_extract(e, "^([a-z]+)_", 1)))
        kept = F.when(k == "key", prefix).when(k == "iban", 2).when(k == "phone", code).otherwise(0)
        hexadecimal = (k == "ip6") | (k == "secret") & e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        plain = let(_poured(e, s, kept, from_end=k == "phone", hexadecimal=hexadecimal), lambda new: F.when(k == "iban", _iban(e, new)).when(k == "card", _card(e, new)).otherwise(new))
        other = F.when(k == "ip", octets).otherwise(plain)
        names = F.transform(F.split(e, " "), lambda w: F.when(_is_title(w), w).otherwise(_word(w, key, attempt)))
        return F.when(k == "email", _email(e, s, key, grow)).when(k == "name", F.array_join(names, " ")).otherwise(_longer(other, s, grow))

    return let(kind(e), lambda k: let(unit(e), lambda u: let(attempt(u), lambda n: let(_seed(key, u, n), lambda s: of(k, s, n)))))


def _units(e: Column) -> Column:
    """array<struct<unit, example>> of an entity that surrogates are drawn for: itself, or the words of a name."""
    words = F.filter(F.split(e, " "), lambda w: ~_is_title(w) & ~_is_given(w))
    one = lambda u, x: F.struct(u.alias("unit"), x.alias("example"))
    return F.when(kind(e) == "name", F.transform(words, lambda w: one(F.concat(F.lit("name:"), F.lower(w)), w))).otherwise(F.array(one(unit(e), e)))


def _drawn(unit_col: Column, example: Column, key: str, attempt: Column) -> Column:
    """The unit that the surrogate of a unit would be."""
    name = unit_col.startswith("name:")
    new = F.when(name, _word(example, key, lambda _: attempt)).otherwise(surrogate(example, key, lambda _: attempt))
    return let(new, lambda x: F.when(name, F.concat(F.lit("name:"), F.lower(x))).otherwise(unit(x)))


def collisions(units: DataFrame, key: str) -> DataFrame | None:
    """(unit, attempt) of the units that need another draw than the first; None if there is none.

    The rounds end: once draws grow, their space is larger by the size of the alphabet each time.
    """
    real = units.select(F.col("unit").alias("drawn"))
    pending, settled, moved = units.withColumn("attempt", F.lit(0)), None, None
    while True:
        drawn = cut(pending.withColumn("drawn", _drawn(F.col("unit"), F.col("example"), key, F.col("attempt"))))
        first = drawn.groupBy("drawn").agg(F.min("unit").alias("first"))
        free = first.join(real, "drawn", "left_anti")
        free = free.join(settled, "drawn", "left_anti") if settled is not None else free
        judged = cut(drawn.join(free.select("drawn", F.col("first").alias("unit"), F.lit(True).alias("ok")), ["drawn", "unit"], "left"))
        good = judged.where("ok")
        settled = good.select("drawn") if settled is None else settled.unionByName(good.select("drawn"))
        again = good.where("attempt > 0").select("unit", "attempt")
        moved = again if moved is None else moved.unionByName(again)
        pending = judged.where("ok is null").select("unit", "example", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return None if moved.isEmpty() else moved


def _name_words(found: Column) -> Column:
    """array<string>: the words of all detected names, without titles."""
    words = F.flatten(F.transform(F.filter(found, lambda e: kind(e) == "name"), lambda e: F.filter(F.split(e, " "), lambda w: ~_is_title(w))))
    return F.array_distinct(words)


def _alone(piece: Column, names: Column, key: str, attempt: Attempt) -> Column:
    """Text between entities, with the words of ``names`` replaced where they stand alone (an 's may follow)."""

    def one(t: Column) -> Column:
        return let(F.regexp_replace(t, "['’]s$", ""), lambda w: F.when(F.array_contains(names, w), F.concat(_word(w, key, attempt), F.substring(t, F.length(w) + 1, F.length(t)))).otherwise(t))

    tokens = F.regexp_extract_all(piece, F.lit(r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"), F.lit(0))
    return F.array_join(F.transform(tokens, one), "")


def _replaced(docs: DataFrame, key: str, text_col: str) -> tuple[DataFrame, str, str]:
    """(``docs`` with surrogates in the text and two more columns, the name of the number of entities, that of their kinds)."""
    e, fix, known, own, count, kinds = (fresh(docs, f"_pii_{k}") for k in ("entities", "fix", "text", "hash", "count", "kinds"))
    source = F.col(text_col).cast("string")
    found = docs.select(F.explode(entities(source)).alias("e")).select(F.explode(_units(F.col("e"))).alias("u"))
    units = cut(found.groupBy("u.unit").agg(F.min("u.example").alias("example")))
    moved = collisions(units, key)
    rows = docs.withColumn(e, entities(source))
    if moved is None:
        attempt: Attempt = lambda u: F.lit(0)
    else:
        # By text: whatever rows share an id, or have none, each text's exceptions are its own, and there are no more than it has entities.
        rows = rows.withColumn(own, F.xxhash64(source))
        hit = rows.select(F.col(own).alias("i"), F.explode(e).alias("e")).select("i", F.explode(_units(F.col("e"))).alias("u")).select("i", "u.unit").distinct()
        held = cut(hit.join(bounded(cut(moved)), "unit"))
        fixes = held.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias(fix)).withColumnRenamed("i", known)
        fixes = F.broadcast(fixes) if held.count() <= BROADCAST_ROWS else fixes  # by entries, not by rows
        rows = rows.join(fixes, F.col(own) == F.col(known), "left").drop(known, own)
        attempt = lambda u: F.coalesce(F.try_element_at(fix, u), F.lit(0))
    pieces = F.split(source, PATTERN, -1)
    between = let(_name_words(F.col(e)), lambda names: F.when(F.size(names) == 0, pieces).otherwise(F.transform(pieces, lambda p: _alone(p, names, key, attempt))))
    new = F.transform(e, lambda x: surrogate(x, key, attempt))
    text = F.array_join(F.zip_with(between, new, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    out = rows.withColumn(count, F.size(e)).withColumn(kinds, F.array_sort(F.array_distinct(F.transform(e, kind))))
    out = out.withColumn(text_col, F.when(F.col(count) > 0, text).otherwise(F.col(text_col)))
    return out.drop(e, fix), count, kinds


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds): the operator's plain result, one row per row of ``docs``.

    Texts without entities are unchanged, null texts stay null, empty ones empty. Very long texts are rebuilt whole, in their
    row. Repeated rows give repeated results. Ids of any type pass, null and repeated ones too. Of entities that want the same surrogate the least keeps it. An empty table gives none; other columns,
    whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, count, kinds = _replaced(rows, key, "text")
    return out.select("doc_id", "text", F.col(count).cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))


def rewrite(docs: DataFrame, key: str, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns as ``docs``, with the number of characters kept true where there is such a column; else as ``pseudonymise``."""
    out, count, _ = _replaced(docs, key, text_col)
    if chars_col in docs.columns:
        kind_of = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(count) > 0, F.char_length(text_col).cast(kind_of)).otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
