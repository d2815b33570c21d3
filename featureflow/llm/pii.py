"""Personal data: detection and keyed, type-consistent surrogates.

Only column expressions are used.  One expression finds all candidates of a
text; a candidate is an entity if it passes its type's check (card numbers:
Luhn).  Its surrogate is a keyed permutation of its normalised characters: a
Feistel network over the two halves, each character moved within its own class
(digits, and vowels, consonants and accented letters of its script), so format,
script, length and letter case are those of the original.

* email: all letters and digits but those of the top-level domain; punctuation
  before the first of them is no part of the address
* phone: the digits after country code and trunk prefix (0, or a leading 1);
  these and the punctuation stay
* ip: the 32-bit address, so every part stays between 0 and 255; of IPv6 the 128
  bits, however they are abbreviated, written in full
* card: all digits but the last, which keeps the Luhn sum right
* ssn: all digits
* name (after titles, or a listed given name before a capitalised word, with
  initials): a listed given name becomes another of its gender and script; after
  a title that tells the gender, others become a listed one; after other titles
  they are permuted but for the last letter, which often marks gender; initials
  are permuted, and so is the surname, alike for all who bear it.  Further
  mentions of its given name or surname alone in the same text, as written or in
  capitals, are replaced likewise (by what the first name with it got)

Equal entities (after normalising case and punctuation) have equal surrogates
everywhere, without a table.  Permutations keep distinct entities distinct;
what is not a permutation (given names, letters of other scripts) is checked:
all distinct entities are grouped by surrogate, and of those that collide all
but one, and those that would stay as they are, are moved by a higher attempt
number until there are none.  From attempt ``WIDE`` on a surname gets two more
letters with each attempt, so a form with fewer surrogates than entities is
widened; after ``MOST`` rounds what is left keeps its last surrogate (an entity
whose form has no other, such as a one-letter address).  These few exceptions
reach their texts by a join on the document.

Candidates are found once and stored with their texts.

Defined results: null texts stay null, empty and clean texts stay as they are;
repeated rows get equal results; null ids are treated like any other; an empty
table gives no rows; other columns are kept, whatever their names, but a column
``_pii_kinds`` is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Given names by gender (Latin and Cyrillic), and titles.
FEMALE = "Anna Clara Elena Emma Julia Laura Lucia Maria Marta Mary Nina Sarah Sofia Susan Teresa Ursula".split()
MALE = "Andreas Carlos David Felix Hans James Jean John Klaus Luis Marco Michael Pablo Peter Robert Thomas".split()
FEMALE_CYRILLIC = "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split()
MALE_CYRILLIC = "Алексей Андрей Борис Виктор Иван Михаил Павел Сергей".split()
GIVEN = (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC)
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Г-н Г-жа".split()
TITLE_MALE = "Mr Herr Monsieur Señor Sr Г-н".split()
TITLE_FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа".split()

_LETTER = r"\p{L}"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_INITIAL = r"\p{Lu}\."
_TITLE = rf"(?:{'|'.join(TITLES)})\.? "
_TITLED = rf"(?<!{_LETTER})(?:{_TITLE})+(?:{_INITIAL} ?){{0,3}}{_NAME}(?:(?: {_INITIAL}){{0,3}} {_NAME})?(?!{_LETTER})"
_KNOWN = rf"(?<!{_LETTER})(?:{'|'.join(n for g in GIVEN for n in g)})(?: {_INITIAL}){{0,3}} {_NAME}(?!{_LETTER})"
#: Capitalised words, which may be further mentions of a name.
_MENTION = rf"(?<!{_LETTER})\p{{Lu}}{_LETTER}++(?:-{_LETTER}++)*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?=[A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)"
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_PHONES = (
    # 3-3-4, after a country code or a leading 1
    r"(?:\+\d{1,3}[ .-]?|1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    # international, with a trunk zero or area code in brackets
    r"(?:\+|00(?=[1-9]))\d{1,3}[ ./-]?(?:\(\d{1,5}\)[ ./-]?)?(?:\d[ ./-]?)?\d{2,4}(?:[ ./-]?\d{2,4}){1,4}(?![\p{L}\p{N}])",
    # national, with trunk zero: pairs, or an area code and groups, or bare
    r"0[1-9](?:[ .-]\d{2}){4}(?![\p{L}\p{N}])",
    r"(?=\(?0(?:[ ./()-]{0,2}\d){8,11})(?:0[1-9]\d{1,4}[ ./-]|\(0[1-9]\d{0,4}\)[ /-]?)\d{2,8}(?:[ ./-]\d{2,8}){0,4}(?![\p{L}\p{N}])",
    # national of nine digits in groups, no part of a longer grouped number
    r"(?<!\d[ ,])(?:[6-9]\d\d(?:[ -]\d{3}){2}|[89]\d\d(?:[ -]\d\d){3}|[89]\d[ -]\d{3}(?:[ -]\d\d){2})(?![\p{L}\p{N}]|[ .,-]\d)",
    # bare: trunk zero, or ten digits of North America
    r"(?:0[1-9]\d{8,9}|1?[2-9]\d{9})(?![\p{L}\p{N}]|\.\d)",
)
#: One expression for all candidates.  Runs are only entered at their start
#: and taken possessively, so the time is in proportion to the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]++\.)+[\p{L}]{2,24}(?![\p{L}\p{N}])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+-]|\p{{N}}\.)(?:{'|'.join(_PHONES)})",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
          rf"|(?<![\p{{L}}\p{{N}}:]){_IPV6}(?![\p{{L}}\p{{N}}]|:[\p{{L}}\p{{N}}:]|\.\d)",
    "card": r"(?<![\p{L}\p{N}-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "name": rf"{_TITLED}|{_KNOWN}",
}
TYPES = tuple(PATTERNS)
_ANY = "|".join(PATTERNS[t] for t in ("email", "ip", "ssn", "phone", "card", "name"))
#: Texts without any of these have no candidate.
_HINT = rf"[@\d]|{_TITLED}|{_KNOWN}"
ROUNDS = 4
#: Attempts from which surnames are lengthened, and rounds of the check.
WIDE = 3
MOST = 12

#: Classes of characters that move among themselves.
CLASSES = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρσςτφχψ",
)
_HEX_DIGITS = "0123456789abcdef"


def _let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _number(*parts: Column) -> Column:
    """A keyed number below 2**32."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8), 16, 10).cast("long")


def _moved(c: Column, by: Column) -> Column:
    """A character moved within its class; others that are letters or digits
    become a consonant, the rest stay."""
    out = F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(
        F.lit(CLASSES[2]), (F.ascii(c) + by) % len(CLASSES[2]) + 1, F.lit(1))).otherwise(c)
    for own in CLASSES:
        at = F.instr(F.lit(own), c)
        out = F.when(at > 0, F.substr(F.lit(own), ((at - 1 + by) % len(own) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def _hex_moved(c: Column, by: Column) -> Column:
    return F.substr(F.lit(_HEX_DIGITS), ((F.instr(F.lit(_HEX_DIGITS), c) - 1 + by) % 16 + 1).cast("int"), F.lit(1))


def _keyed(half: Column, other: Column, tweak: Column, n: Column, moved=_moved) -> Column:
    """``half`` (characters), each moved by a number that depends on the key,
    the round, its place and the other half."""
    return _let(F.array_join(other, ""), lambda o: F.transform(
        half, lambda c, i: moved(c, _number(tweak, n.cast("string"), i.cast("string"), o))))


def permuted(chars: Column, tweak: Column, moved=_moved) -> Column:
    """Characters permuted by a Feistel network; distinct sequences of equal
    classes stay distinct, for one tweak.  The halves change places after each
    of an even number of rounds."""
    cut = F.floor(F.size(chars) / 2).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(F.slice(chars, F.lit(1), cut).alias("a"), F.slice(chars, cut + 1, F.size(chars) - cut).alias("b")),
        lambda h, n: F.struct(h["b"].alias("a"), _keyed(h["a"], h["b"], tweak, n, moved).alias("b")),
        lambda h: F.concat(h["a"], h["b"]))


def _lower(c: Column) -> Column:
    """Lower case, unless that changes the number of characters."""
    return F.when(F.char_length(F.lower(c)) == 1, F.lower(c)).otherwise(c)


def _normal(text: Column) -> Column:
    return F.transform(_chars(text), _lower)


def _recased(new: Column, old: Column) -> Column:
    """Characters of ``new`` in the letter case of ``old`` (as many of it)."""
    return F.array_join(F.zip_with(new, F.slice(old, F.lit(1), F.size(new)), lambda n, o: F.when(
        (o != F.lower(o)) & (F.char_length(F.upper(n)) == 1), F.upper(n)).otherwise(n)), "")


def _filled(text: Column, digits: Column) -> Column:
    """``text`` with its last digits replaced by ``digits`` (an array)."""
    chars = _chars(text)
    return _let(F.struct(chars.alias("c"), digits.alias("d")), lambda s: F.array_join(F.aggregate(
        F.reverse(s["c"]),
        F.struct(F.array().cast("array<string>").alias("out"), F.size(s["d"]).alias("left")),
        lambda acc, c: F.when(c.rlike(r"\d") & (acc["left"] > 0), F.struct(
            F.array_append(acc["out"], F.get(s["d"], acc["left"] - 1)).alias("out"), (acc["left"] - 1).alias("left"),
        )).otherwise(F.struct(F.array_append(acc["out"], c).alias("out"), acc["left"].alias("left"))),
        lambda acc: F.reverse(acc["out"])), ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, the last one not doubled."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.when(
            c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x) % 10


def _national(text: Column) -> Column:
    """The digits of a phone number that are permuted: without country code
    and trunk prefix, so that they are the same with and without them."""
    local = F.regexp_replace(text, rf"^{_COUNTRY}", "")
    return F.regexp_replace(F.regexp_replace(_digits(local), r"^1(?=\d{10}$)", ""), r"^0", "")


def _lead(m: Column) -> Column:
    """Punctuation before the first letter or digit of an email."""
    return F.regexp_extract(m, r"^([._%+-]*)", 1)


def _address(m: Column) -> Column:
    return F.substr(m, F.length(_lead(m)) + 1, F.length(m))


def _top_level(m: Column) -> Column:
    return F.regexp_extract(m, r"(\.[^.]*)$", 1)


def _ip(m: Column, tweak: Column) -> Column:
    def part(k: int) -> Column:
        return F.split(m, r"\.")[k].cast("long")

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct((part(0) * 256 + part(1)).alias("a"), (part(2) * 256 + part(3)).alias("b")),
        lambda h, n: F.struct(
            h["b"].alias("a"), ((h["a"] + _number(tweak, n.cast("string"), h["b"].cast("string"))) % 65536).alias("b")),
        lambda h: F.concat_ws(".", *[
            x.cast("string") for half in ("a", "b") for x in (F.floor(h[half] / 256), h[half] % 256)]))


def _ipv6(m: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address; of what is none, not 32."""
    def digits(part: Column) -> Column:
        return F.array_join(F.transform(F.filter(F.split(part, ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0")), "")

    halves = F.split(F.lower(m), "::")
    first, last = digits(halves[0]), F.coalesce(digits(F.get(halves, F.lit(1))), F.lit(""))
    left = F.lit(32) - F.length(first) - F.length(last)
    return F.concat(first, F.when(F.contains(m, F.lit("::")) & (left > 0), F.repeat(F.lit("0"), left)).otherwise(""), last)


def _ipv6_moved(m: Column, tweak: Column) -> Column:
    full = F.regexp_replace(F.array_join(permuted(_chars(_ipv6(m)), tweak, _hex_moved), ""), "(.{4})(?=.)", "$1:")
    return F.when(m.rlike("[A-F]"), F.upper(full)).otherwise(full)


def _listed(name: Column, tweak: Column) -> Column:
    """Another listed name of the gender and script; null if not listed."""
    out = F.lit(None).cast("string")
    for k, group in enumerate(GIVEN):
        names = F.array(*map(F.lit, group))
        at = F.array_position(names, name)
        # From 1 to n - 1 further, so a name never stands for itself.
        by = 1 + _number(tweak, F.lit(f"given{k}")) % (len(group) - 1)
        out = F.when(at > 0, F.get(names, ((at - 1 + by) % len(group)).cast("int"))).otherwise(out)
    return out


def _title_of(m: Column) -> Column:
    return F.regexp_extract(m, rf"^((?:{_TITLE})*)", 1)


def _words(m: Column) -> Column:
    """The words of a name, without its titles."""
    return F.split(F.regexp_replace(F.substr(m, F.length(_title_of(m)) + 1, F.length(m)), r"\.(?=\p{L})", ". "), " ")


def _middle(m: Column) -> Column:
    """Initials between the given name (or first initial) and the surname."""
    return F.array_join(F.slice(_words(m), F.lit(2), F.greatest(F.size(_words(m)) - 2, F.lit(0))), " ")


def _gender(m: Column) -> Column:
    """Gender that a title tells for a given name that is not listed: f, m or empty."""
    given = _words(m)[0]

    def titled(own: list[str]) -> Column:
        return m.rlike(rf"^(?:{_TITLE})*(?:{'|'.join(own)})\.? ")

    open_ = (F.size(_words(m)) > 1) & ~given.isin(*(n for g in GIVEN for n in g)) & ~F.endswith(given, F.lit("."))
    return F.when(open_ & titled(TITLE_FEMALE), "f").when(open_ & titled(TITLE_MALE), "m").otherwise("")


def _drawn(m: Column, tweak: Column) -> Column:
    """A listed name of the title's gender and the given name's script; null
    without such a title."""
    given, out = _words(m)[0], F.lit(None).cast("string")
    for k, group in enumerate(GIVEN):
        names = F.array(*map(F.lit, group))
        at = (_number(tweak, F.lit("drawn"), given) % len(group)).cast("int")
        script = given.rlike(r"\p{IsCyrillic}") == F.lit(k >= 2)
        out = F.when((_gender(m) == ("f", "m")[k % 2]) & script, F.get(names, at)).otherwise(out)
    return out


def _parts(m: Column, kind: Column) -> Column:
    """What is permuted, as arrays of characters: the body of an entity; of a
    name its surname, its given name, whose last letter often marks gender and
    stays, and its initials."""
    digits = _digits(m)
    given = _words(m)[0]
    return (
        F.when(kind == "email", F.array(_normal(F.substr(
            m, F.length(_lead(m)) + 1, F.length(m) - F.length(_lead(m)) - F.length(_top_level(m))))))
        .when(kind == "phone", F.array(_chars(_national(m))))
        .when(kind == "card", F.array(_chars(F.substr(digits, F.lit(1), F.length(digits) - 1))))
        .when(kind == "ssn", F.array(_chars(digits)))
        .when(kind == "name", F.array(
            _normal(F.element_at(_words(m), -1)), _normal(F.substr(given, F.lit(1), F.length(given) - 1)),
            _normal(_middle(m))))
        .otherwise(F.array().cast("array<array<string>>")))


def _assembled(m: Column, kind: Column, parts: Column, tweak: Column) -> Column:
    """The surrogate in the format of ``m`` from its permuted parts."""
    def card(body: Column) -> Column:
        check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
        return _chars(F.concat(body, check.cast("string")))

    first = F.get(parts, F.lit(0))
    given = _words(m)[0]
    unlisted = F.concat(_recased(F.get(parts, F.lit(1)), _chars(given)), F.substring(given, -1, 1))
    named = F.concat(
        _title_of(m),
        F.when(F.size(_words(m)) > 1, F.concat(F.coalesce(_listed(given, tweak), _drawn(m, tweak), unlisted), F.lit(" "))).otherwise(""),
        F.when(F.size(_words(m)) > 2, F.concat(_recased(F.get(parts, F.lit(2)), _chars(_middle(m))), F.lit(" "))).otherwise(""),
        _recased(first, _chars(F.element_at(_words(m), -1))))
    digits = F.when(kind == "card", card(F.array_join(first, ""))).otherwise(first)
    return (
        F.when(kind == "email", F.concat(_lead(m), _recased(first, _chars(_address(m))), _top_level(m)))
        .when(kind == "ip", F.when(F.contains(m, F.lit(":")), _ipv6_moved(m, tweak)).otherwise(_ip(m, tweak)))
        .when(kind == "name", named)
        .otherwise(_filled(m, digits)))


def _more_letters(m: Column, tweak: Column, attempt: Column) -> Column:
    """Two letters for each attempt from ``WIDE`` on."""
    def two(n: Column) -> Column:
        return F.concat(F.substr(F.lit(CLASSES[2]), (n % 20 + 1).cast("int"), F.lit(1)),
                        F.substr(F.lit(CLASSES[1]), (F.floor(n / 20) % 6 + 1).cast("int"), F.lit(1)))

    name = F.array_join(_words(m), " ")
    return F.array_join(F.transform(F.sequence(F.lit(WIDE), attempt), lambda k: two(_number(tweak, name, k.cast("string")))), "")


def surrogate(m: Column, kind: Column, key: str, attempt: Column | None) -> Column:
    """The surrogate of an entity; no attempt is the first."""
    tweak = F.concat_ws("\x1f", F.lit(key), kind, F.lit("0") if attempt is None else attempt.cast("string"))
    parts = F.transform(_parts(m, kind), lambda p, i: permuted(p, F.concat(tweak, i.cast("string"))))
    first = _let(parts, lambda p: _assembled(m, kind, p, tweak))
    if attempt is None:
        return first
    return F.when((kind == "name") & (attempt >= WIDE), F.concat(first, _more_letters(m, tweak, attempt))).otherwise(first)


def entity_type(m: Column) -> Column:
    """Type of a candidate; null if it fails its check."""
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(rf"^(?:{PATTERNS['ip']})$"), F.when(~F.contains(m, F.lit(":")) | (F.length(_ipv6(m)) == 32), "ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^(\d{13,19}|\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})$"), F.when(_luhn(_digits(m)) == 0, "card"))
        .when(m.rlike(r"\d"), "phone")
        .otherwise("name"))


def normalised(m: Column, kind: Column) -> Column:
    """What equal entities share: case and punctuation aside."""
    return (
        F.when(kind.isin("email"), F.array_join(_normal(_address(m)), ""))
        .when(kind.isin("ip") & F.contains(m, F.lit(":")), _ipv6(m))
        .when(kind.isin("phone"), _national(m))
        .when(kind.isin("ssn", "card"), _digits(m))
        .when(kind.isin("name"), F.concat(F.array_join(_words(m), " "), _gender(m)))
        .otherwise(m))


def _candidates(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """kind, norm, example rows: all distinct entities of ``text``, whose
    candidates are in ``found`` if they are known."""
    found = _candidates(F.col("text")) if found is None else found
    found = docs.select(F.explode(found).alias("m")).groupBy("m").count()
    typed = found.select("m", entity_type(F.col("m")).alias("kind")).where(F.col("kind").isNotNull())
    return typed.groupBy("kind", normalised(F.col("m"), F.col("kind")).alias("norm")).agg(F.min("m").alias("m"))


def exceptions(docs: DataFrame, key: str, found: Column | None = None) -> DataFrame | None:
    """kind, norm, attempt of entities whose first surrogate is another's (all
    but the smallest are moved) or themselves; None if there are none."""
    def checked(rows: DataFrame) -> DataFrame:
        new = surrogate(F.col("m"), F.col("kind"), key, F.col("attempt"))
        return rows.withColumn("new", new).withColumn("new", normalised(F.col("new"), F.col("kind")))

    rows = common.stored(checked(entities(docs, found).withColumn("attempt", F.lit(0))), "pii-entities")
    same = F.col("new") == F.col("norm")
    for _ in range(MOST):
        # The smallest of a colliding group stays; the groups are only counted.
        groups = rows.groupBy("kind", "new").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1")
        if groups.isEmpty() and rows.where(same).isEmpty():
            break
        stays = F.col("n").isNull() | ((F.col("first.norm") == F.col("norm")) & (F.col("first.attempt") == F.col("attempt")))
        joined = rows.join(groups, ["kind", "new"], "left")
        rows = common.stored(checked(joined.select(
            "kind", "norm", "m", F.when(stays & ~same, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"))), "pii-entities")
    moved = rows.where("attempt > 0").select("kind", "norm", "attempt")
    return None if moved.isEmpty() else moved


def _own_words(named: Column) -> Column:
    """Struct of arrays: given names and surnames of a text's names, as written
    and in capitals, and what stands for them."""
    def of(x: Column) -> Column:
        def pair(old: Column, new: Column) -> Column:
            return F.struct(old.alias("old"), new.alias("new"))

        def pairs(w: Column) -> Column:
            own = [(F.element_at(w["old"], k), F.element_at(w["new"], k)) for k in (-1, 1)]
            return F.array(*(pair(*p) for p in own), *(pair(F.upper(o), F.upper(n)) for o, n in own))

        return _let(pair(_words(x["m"]), _words(x["new"])), pairs)

    return _let(F.array_distinct(F.flatten(F.transform(named, of))), lambda p: F.struct(
        F.transform(p, lambda x: x["old"]).alias("old"), F.transform(p, lambda x: x["new"]).alias("new")))


def _mentions_replaced(gap: Column, words: Column) -> Column:
    """``gap`` (text between entities) with ``words`` replaced, each as a whole
    or as a part of a hyphenated word."""
    def of(w: Column) -> Column:
        return F.get(words["new"], (F.array_position(words["old"], w) - 1).cast("int"))

    new = F.transform(F.regexp_extract_all(gap, F.lit(_MENTION), F.lit(0)), lambda w: F.coalesce(
        of(w), F.array_join(F.transform(F.split(w, "-"), lambda x: F.coalesce(of(x), x)), "-")))
    return F.array_join(F.zip_with(F.split(gap, _MENTION, -1), new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def _replaced(text: Column, candidates: Column, key: str, attempts: Column | None) -> Column:
    """(new text, kinds of the entities replaced) of a text."""

    def one(m: Column) -> Column:
        def of(kind: Column) -> Column:
            attempt = None
            if attempts is not None:
                name = F.concat_ws("\x1f", kind, normalised(m, kind))
                attempt = F.coalesce(F.try_element_at(attempts, name), F.lit(0))
            return F.struct(m.alias("m"), kind.alias("kind"), F.when(kind.isNull(), m).otherwise(surrogate(m, kind, key, attempt)).alias("new"))

        return _let(entity_type(m), of)

    def whole(found: Column) -> Column:
        gaps = F.split(text, _ANY, -1)
        named = F.filter(found, lambda x: F.coalesce(x["kind"] == "name", F.lit(False)))
        gaps = F.when(F.size(named) > 0, _let(_own_words(named), lambda words: F.transform(
            gaps, lambda g: _mentions_replaced(g, words)))).otherwise(gaps)
        return F.struct(
            F.array_join(F.zip_with(gaps, found, lambda g, x: F.concat(g, F.coalesce(x["new"], F.lit("")))), "").alias("text"),
            F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    clean = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return _let(F.transform(candidates, one), lambda found: F.when(F.size(found) > 0, whole(found)).otherwise(clean))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (all columns) with surrogates in ``text`` and a column
    ``_pii_kinds``: the types of the entities replaced, in order."""
    text = F.col("text")
    columns = [c for c in docs.columns if c != "_pii_kinds"]
    names = common.own_names(columns, "_pii_found", "_pii_hash", "_pii_sha", "_pii_attempts", "_pii")
    found, hashed, sha, tries, done = names
    rows = common.stored(docs.select(*(F.col(f"`{c}`") for c in columns)).withColumn(found, _candidates(text)), "pii-candidates")
    moved = exceptions(rows, key, F.col(found))
    attempts = None
    if moved is not None:
        # Only texts that hold an exception learn of it, by a row key made of
        # what the result depends on: the text.
        marks = {hashed: F.xxhash64(text), sha: F.sha2(text, 256)}
        marked = rows.where(F.size(found) > 0).withColumns(marks).select(hashed, sha, F.explode(F.array_distinct(F.col(found))).alias("m"))
        marked = marked.select(hashed, sha, "m", entity_type(F.col("m")).alias("kind")).where("kind is not null")
        marked = marked.select(hashed, sha, "kind", normalised(F.col("m"), F.col("kind")).alias("norm")).distinct()
        own = marked.join(moved, ["kind", "norm"]).groupBy(hashed, sha).agg(F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias(tries))
        rows = rows.withColumns(marks).join(own, [hashed, sha], "left")
        attempts = F.coalesce(F.col(tries), F.create_map().cast("map<string,int>"))
    rows = rows.withColumn(done, F.when(text.isNotNull(), _replaced(text, F.col(found), key, attempts)))
    kept = [F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    return rows.select(*kept, F.coalesce(F.col(f"{done}.kinds"), F.array().cast("array<string>")).alias("_pii_kinds"))


def new_key() -> str:
    """A random key; keep it to get the same surrogates again."""
    return uuid.uuid4().hex
