"""op7: every kind and script, short names, spellings of one entity, and distinctness over a corpus, against plain rules."""

import ipaddress
import random
import re

import pytest

from spreadlake.llm import surrogates as S

KEY = b"key of the test"


def replaced(text):
    out, at = "", 0
    for a, b, kind in S.entities(text):
        out += text[at:a] + S.render(kind, text[a:b], S.surrogate(kind, S.canonical(kind, text[a:b]), KEY))
        at = b
    return out + text[at:]


@pytest.mark.parametrize("name", ["Wu", "Ng", "Li", "Bo", "Eva", "Иван", "Ян", "Άννα", "Zoë", "Ødegård", "O"])
@pytest.mark.parametrize("title", ["Mr", "Frau", "Dr", "Señora"])
def test_short_names(title, name):
    text = f"{title} {name} came."
    new = replaced(text)
    if len(name) > 1:
        made = re.fullmatch(rf"{title} (\w+) came\.", new)[1]
        assert made != name and made[0].isupper() and S.script_of(made[0]) == S.script_of(name[0])
    else:
        assert new == text  # an initial is no name part


@pytest.mark.parametrize(
    ("kind", "text", "check"),
    [
        ("ssn", "SSN 078-05-1120.", lambda x: re.fullmatch(r"\d{3}-\d{2}-\d{4}", x)),
        ("iban", "to DE89 3704 0044 0532 0130 00 now", lambda x: x.startswith("DE") and len(x) == 27 and S.iban_rest(x.replace(" ", "")) == 1),
        ("card", "card 4845-1681-1440-7329!", lambda x: x[0] == "4" and re.fullmatch(r"(\d{4}-){3}\d{4}", x) and S.check_sum(x.replace("-", "")) == 0),
        ("dni", "DNI 12345678Z", lambda x: S.DNI_LETTERS[int(x[:8]) % 23] == x[8]),
        ("nino", "NI AB 12 34 56 C", lambda x: re.fullmatch(r"AB \d\d \d\d \d\d C", x)),
        ("ipv4", "at 10.20.30.40", ipaddress.IPv4Address),
        ("ipv6", "at 2001:db8::1, now", lambda x: ipaddress.IPv6Address(x) and x.startswith("2001:")),
        ("phone", "call +49 30 1234567", lambda x: re.fullmatch(r"\+49 \d\d \d{7}", x)),
        ("email", "mail A.Long@mail.example.org", lambda x: re.fullmatch(r"[A-Z]\.[A-Z][a-z]{3}@[a-z]{4}\.[a-z]{7}\.org", x)),
        ("address", "lives at 12 Main Street in", lambda x: re.fullmatch(r"\d\d [A-Z]\w+ Street", x)),
        ("address", "in der Hauptstraße 7 wohnt", lambda x: re.fullmatch(r"[A-Z]\w+straße \d", x)),
        ("address", "au 12, rue de Rivoli à", lambda x: re.fullmatch(r"\d\d, rue de [A-Z]\w+", x)),
        ("address", "vive en Calle Mayor, 5 hoy", lambda x: re.fullmatch(r"Calle [A-Z]\w+, \d", x)),
        ("secret", 'token = "04dbebab91ab85687d33eeaaf9ac699e"', lambda x: re.fullmatch("[0-9a-f]{32}", x)),
    ],
)
def test_kinds_keep_their_format(kind, text, check):
    ((a, b, found),) = S.entities(text)
    made = S.render(kind, text[a:b], S.surrogate(kind, S.canonical(kind, text[a:b]), KEY))
    assert found == kind and check(made) and made != text[a:b]


def test_spellings_of_one_entity():
    new = replaced("Call +1 017 555-7713, +1-017-555-7713 or (017) 555-7713; mail Anna.B@x.org or anna.b@x.org; card 4845168114407329 or 4845 1681 1440 7329; at 2001:db8::1 or 2001:DB8:0:0:0:0:0:1.")
    digits = [re.sub(r"\D", "", x)[-10:] for x in re.findall(r"[+(][\d ()-]+\d", new)]
    assert len(digits) == 3 and len(set(digits)) == 1
    mails = re.findall(r"[\w.]+@[\w.]+\w", new)
    assert mails[0] != mails[1] and mails[0].lower() == mails[1]
    cards = re.search(r"card (\d+) or ([\d ]+);", new)
    assert cards[1] == cards[2].replace(" ", "")
    first, second = re.search(r"at ([\w:]+) or ([\w:]+)\.", new).groups()
    assert ipaddress.IPv6Address(first) == ipaddress.IPv6Address(second)


def test_gender_and_case():
    new = replaced("Mrs Anna Berger and Mr Karl Berger. ANNA! Karl's hat. My name is Lena Vogt.")
    m = re.fullmatch(r"Mrs (\w+) (\w+) and Mr (\w+) (\w+)\. (\w+)! (\w+)'s hat\. My name is (\w+) (\w+)\.", new)
    women, men = ({x.lower() for x in S.GIVEN["LATIN", g]} for g in "fm")
    assert m[1].lower() in women and m[3].lower() in men and m[7].lower() in women
    assert m[2] == m[4] and m[5] == m[1].upper() and m[6] == m[3] and "Anna" not in new and "Vogt" not in new


def test_what_is_no_entity():
    for text in ("It is 12:30:45.", "std::vector and a::b", "Version 4.0.1", "Dear Sir", "Name: see below", "the 12 main streets", "7536784127813051", "Street 9", ""):
        assert S.entities(text) == []


def test_corpus_wide(spark):
    rng = random.Random(8)
    given = [f"{a}{b}" for a in ("An", "Be", "Cla", "Do", "El", "Fri", "Gre") for b in ("na", "ra", "tor", "mund")]
    family = [f"{a}{b}" for a in ("Berg", "Stein", "Holz", "Wald", "See", "Feld") for b in ("er", "mann", "bach", "hof", "ling")] + ["Weber", "Keller"]  # the last stand in the lists too
    people = [(rng.choice(["Mr", "Mrs"]), rng.choice(given), rng.choice(family)) for _ in range(120)]
    rows = [(i, f"{t} {g} {f} wrote from {i % 256}.{i % 7}.{i}.9 and {g.lower()}.{i}@x.org. {f} left.") for i, (t, g, f) in enumerate(people)]
    new = {r["doc_id"]: r["text"] for r in S.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    names, others = {}, {}
    for i, (_, g, f) in enumerate(people):
        m = re.fullmatch(r"M\w+ (\w+) (\w+) wrote from (\S+) and (\S+@\S+)\. (\w+) left\.", new[i])
        assert m[2] == m[5]
        for real, made in ((g, m[1]), (f, m[2])):
            assert names.setdefault(real, made) == made  # one surrogate wherever it stands
        others[i] = m[3], m[4]
    assert len(set(names.values())) == len(names) and not set(names.values()) & set(names)
    assert len(set(others.values())) == len(people)
