"""Surrogates: format, coreference, distinctness, nothing else touched."""

from __future__ import annotations

import ipaddress
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featureflow.llm import pii
from featureflow.llm.queries import op4_pii_surrogates

from .conftest import EDGE_TEXTS, SF

KEY = "test"


def replaced(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_surrogates(df, key).orderBy("doc_id").collect()
    return [(r["text"], r["_pii_kinds"]) for r in rows]


def luhn(digits):
    own = [int(c) for c in reversed(digits)]
    return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(own)) % 10 == 0


def shape(text):
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))


def test_types_and_formats(spark):
    cases = {
        "email": "Foo.55@Mail4.example.com", "phone": "+1 (017) 555-7713", "ip": "10.43.173.185", "card": "4111 1111 1111 1111",
        "ssn": "123-45-6789", "name": "Mr. John Smith"}
    out = replaced(spark, [f"see {m}, ok" for m in cases.values()])
    for (kind, m), (text, kinds) in zip(cases.items(), out):
        got = text.removeprefix("see ").removesuffix(", ok")
        assert kinds == [kind] and got != m, (m, text)
        if kind not in ("ip", "name"):
            assert shape(got) == shape(m)
    assert luhn(re.sub(r"\D", "", out[3][0]))
    assert all(0 <= int(x) <= 255 for x in re.search(r"[\d.]+\d", out[2][0])[0].split("."))
    assert out[1][0].startswith("see +1 (")


def test_clean_texts_stay(spark):
    clean = ["", None, "4111111111111112 is no card", "v1.2.3 and 300.1.1.1", "on 2024-01-01 at 12:30, 1,000,000 of 555",
             'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "a @ b, @home, x@y", "Smith and Mister John", "1234567890123456789012"]
    assert replaced(spark, clean) == [(t, []) for t in clean]


@pytest.mark.parametrize("kind,shapes", [
    ("phone", ["01 23 45 67 89", "030 1234567", "0170 1234567", "0170/1234567", "912 345 678", "912 34 56 78", "91 234 56 78",
               "+44 (0)20 7946 0958", "020 7946 0958", "+33 1 23 45 67 89", "+49 30 1234567", "0049 30 1234567", "(030) 1234567",
               "1-800-555-1234", "1 (800) 555-1234", "5551234567", "15552345678", "0612345678"]),
    ("card", ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904"]),
    ("email", ["_john@x.com", "...john@x.com", "-john@x.com", "_.-john@x.com"]),
])
def test_shapes_of_a_type(spark, kind, shapes):
    for m, (text, kinds) in zip(shapes, replaced(spark, [f"see {m}, ok" for m in shapes])):
        got = text.removeprefix("see ").removesuffix(", ok")
        assert kinds == [kind] and got != m and shape(got) == shape(m), (m, text)
        assert kind != "card" or luhn(re.sub(r"\D", "", got))


def test_spellings_of_one_phone_or_email(spark):
    out = replaced(spark, ["+33 1 23 45 67 89, 01 23 45 67 89, +33123456789, +33 (0)1 23 45 67 89", "1-800-555-1234, 800-555-1234, +1 800 555 1234",
                           "john@x.com, ...john@x.com, -john@x.com"])
    phones = [[re.sub(r"\D", "", m) for m in text.split(", ")] for text, _ in out[:2]]
    assert len({m[-9:] for m in phones[0]}) == 1 and phones[0][0][:2] == "33" and phones[0][1][0] == "0"
    assert len({m[-10:] for m in phones[1]}) == 1 and phones[1][0][0] == "1"
    assert len({m.lstrip(".-") for m in out[2][0].split(", ")}) == 1


def test_ipv6(spark):
    (text, kinds), (other, _), (mapped, _) = replaced(spark, [
        "2001:db8::1, 2001:0DB8:0:0:0:0:0:1, ::1, fe80::", "2001:db8::2: seen", "::ffff:10.1.2.3"])
    out = text.split(", ")
    assert kinds == ["ip"] * 4 and all(ipaddress.ip_address(m).version == 6 for m in out)
    assert out[0] == out[1].lower() and out[1].upper() == out[1] and len({m.lower() for m in out} | {other.removesuffix(": seen")}) == 4
    assert mapped.startswith("::ffff:") and "10.1.2.3" not in mapped
    clean = ["std::vector a::b at 12:30:45, 00:1a:2b:3c:4d:5e", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5::6:7:8:9"]
    assert replaced(spark, clean) == [(t, []) for t in clean]


def test_numbers_that_are_no_phones(spark):
    clean = ["912 345 678 901 people", "5 912 345 678", "1700000000 seconds", "01.02.2024 and 01-02-2024", "3.5551234567", "0.123456789",
             "4111 1111 1111 1112", "3782 822463 10006", "id 123456789", "page 012 345"]
    assert replaced(spark, clean) == [(t, []) for t in clean]


def test_coreference_and_keys(spark):
    texts = ["foo.55@mail4.example.com FOO.55@mail4.example.com", "+1 (017) 555-7713 and +1 017-555-7713",
             "4111 1111 1111 1111 4111111111111111", "Mr. Smith, Mr. John Smith, John Smith, Mary Smith, Mary Jones"]
    (mail, _), (phone, _), (card, _), (name, _) = replaced(spark, texts)
    a, b = mail.split()
    assert a == b.lower()
    assert re.sub(r"\D", "", phone.split(" and ")[0]) == re.sub(r"\D", "", phone.split(" and ")[1])
    assert card[:19].replace(" ", "") == card[20:]
    single, john, again, mary, jones = name.split(", ")
    assert john == f"Mr. {again}" and single.split()[-1] == again.split()[-1] == mary.split()[-1] != jones.split()[-1]
    assert again.split()[0] in pii.MALE and mary.split()[0] in pii.FEMALE and mary.split()[0] == jones.split()[0]
    assert replaced(spark, texts) == replaced(spark, texts) != replaced(spark, texts, "another key")


def test_script_and_gender(spark):
    text, kinds = replaced(spark, ["Г-н Иван Петров и Анна Петрова; Frau Müller"])[0]
    assert kinds == ["name"] * 3
    first, second = text.split(";")[0].split(" и ")
    assert first.split()[1] in pii.MALE_CYRILLIC and second.split()[0] in pii.FEMALE_CYRILLIC
    assert all("а" <= c.lower() <= "ё" for c in first.split()[2])


def test_initials_titles_and_gender(spark):
    out = replaced(spark, ["John Q. Smith", "Dr. J. Smith", "Mrs Jennifer Smith", "Herr Ottokar Schmidt", "Prof. Dr. Anna B. C. Weber", "Г-жа Зинаида Петрова",
                           "Mrs J. Smith"])
    assert all(kinds == ["name"] for _, kinds in out)
    john, doctor, mrs, herr, prof, russian, initial = (t.split(" ") for t, _ in out)
    assert john[0] in pii.MALE and re.fullmatch(r"[A-Z]\.", john[1]) and john[2] == doctor[2] == mrs[2] == initial[2] != "Smith"
    assert doctor[0] == "Dr." and re.fullmatch(r"[A-Z]\.", doctor[1]) and re.fullmatch(r"[A-Z]\.", initial[1])
    assert mrs[1] in pii.FEMALE and herr[1] in pii.MALE and russian[1] in pii.FEMALE_CYRILLIC
    assert prof[:2] == ["Prof.", "Dr."] and prof[2] in pii.FEMALE and len(prof) == 6 and prof[5] != "Weber"


def test_further_mentions_in_the_same_text(spark):
    text, other, swapped = (t for t, _ in replaced(spark, [
        "Anna Schmidt came. Schmidt's car, SCHMIDT, Schmidt-Haus; Anna left. Schmidtke and anna stayed.", "Schmidt and Anna",
        "Anna Schmidt, Maria Weber: Anna, Maria, Weber, Schmidt"]))
    given, surname = text.split(" ")[:2]
    assert given in pii.FEMALE and given != "Anna" and surname != "Schmidt"
    assert text == (f"{given} {surname} came. {surname}'s car, {surname.upper()}, {surname}-Haus; {given} left. Schmidtke and anna stayed.")
    assert other == "Schmidt and Anna"
    names, mentions = swapped.split(": ")
    (a, b), (c, d) = (x.split(" ") for x in names.split(", "))
    assert mentions.split(", ") == [a, c, d, b]


def test_names_drawn_for_a_title_stay_distinct(spark):
    own = [f"Mrs {a}{b}la Smith" for a in "BCDFGHKL" for b in "aeiou"]
    out = [t for t, _ in replaced(spark, own)]
    assert len(set(out)) == len(own) and all(t.split(" ")[1] in pii.FEMALE for t in out)


@pytest.mark.parametrize("make", [
    lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    lambda r: f"{r.randrange(1000):03}-{r.randrange(100):02}-{r.randrange(10000):04}",
    lambda r: f"+1 ({r.randrange(1000):03}) {r.randrange(1000):03}-{r.randrange(10000):04}",
    lambda r: "".join(r.choice("abcxyz09") for _ in range(4)) + "@ab.com",
    lambda r: f"{r.choice(pii.FEMALE)} {r.choice('ABC')}{r.choice('abcdef')}{r.choice('abcdef')}",
])
def test_distinct_entities_stay_distinct(spark, make):
    rng = random.Random(4)
    own = sorted({make(rng) for _ in range(400)})
    out = [t for t, _ in replaced(spark, own)]
    assert len(set(out)) == len(own)


def test_collisions_are_resolved(spark):
    """Letters outside the classes are no permutation: some surrogates collide
    at first and are moved until none does."""
    han = [chr(0x4E00 + k) for k in range(120)]
    mails = [f"{a}@ab.com" for a in han]
    df = spark.createDataFrame([(k, f"x {m} y") for k, m in enumerate(mails)], "doc_id long, text string")
    moved = pii.exceptions(df, KEY)
    assert moved is not None and moved.count() > 0
    out = [r["text"] for r in pii.with_surrogates(df.withColumn("_pii", F.lit(1)), KEY).drop("_pii").orderBy("doc_id").collect()]
    assert len(out) == len(mails)
    assert len(set(out)) == len(mails)


def test_query_and_edge_cases(spark, texts, edge, empty):
    rows = {r["doc_id"]: r for r in op4_pii_surrogates(spark, SF).collect()}
    assert len(rows) == len(texts)
    mail = re.compile(r"[\w.]+@mail\d\.example\.com")
    for doc, text in texts.items():
        for m in mail.findall(text):
            assert m not in rows[doc]["text"]
        if not re.search(r"[@\d]", text):
            assert rows[doc]["text"] == text
    kept = pii.with_surrogates(edge.drop("_pii"), KEY)
    assert kept.columns == [c for c in edge.columns if c != "_pii"] + ["_pii_kinds"]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(EDGE_TEXTS)
    assert pii.with_surrogates(empty.drop("_pii"), KEY).collect() == []


def names_table(spark, names):
    return spark.createDataFrame([(k, f"Yesterday Mr {n} came.") for k, n in enumerate(names)], "doc_id long, text string")


def test_no_name_stays_and_none_meets_another(spark):
    """Thousands of short names: some would stay as they are or collide."""
    vowels, consonants = "aeiouy", "bcdfghjklmnpqrstvwxz"
    names = [c.upper() + v + d for c in consonants for v in vowels for d in ["", *consonants]][:2_000]
    rows = pii.with_surrogates(names_table(spark, names), KEY).collect()
    new = [r["text"].split()[2] for r in rows]
    assert all(n != names[r["doc_id"]] for n, r in zip(new, rows)) and len(set(new)) == len(names)


def test_a_form_with_too_few_surrogates_is_widened(spark):
    """625 surnames of two unlisted letters have 400 surrogates of two."""
    letters = [chr(c) for c in range(0x101, 0x17F, 2) if chr(c).islower() and chr(c).upper() != chr(c) and len(chr(c).upper()) == 1][:25]
    names = [a.upper() + b for a in letters for b in letters]
    assert len(names) == 625
    rows = pii.with_surrogates(names_table(spark, names), KEY).collect()
    new = [r["text"].split()[2] for r in rows]
    assert len(set(new)) == 625 and not set(new) & set(names)


def test_columns_of_any_name_beside_exceptions(spark):
    docs = names_table(spark, ["Xe", "Mo", "Ăe", "Še", "Že", "Če"] * 2).selectExpr(
        "*", "1 as _h", "2 as _s", "3 as _pii_attempts", "4 as _pii_found", "5 as _pii_hash", "6 as _pii_sha", "7 as _pii", "8 as m", "9 as kind")
    rows = pii.with_surrogates(docs, KEY).collect()
    assert [c for c in rows[0].__fields__ if c != "_pii_kinds"] == docs.columns
    assert len(rows) == 12 and all(tuple(r)[2:-1] == (1, 2, 3, 4, 5, 6, 7, 8, 9) for r in rows)
    assert len({r["text"] for r in rows}) == 6
    assert pii.exceptions(docs, KEY) is None or pii.exceptions(docs, KEY).count() >= 1
