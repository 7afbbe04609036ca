"""op7: names composed by script, gender and length; titles in chains, apostrophes, hyphens; coreference over a corpus by brute force."""

import random
import re
from collections import defaultdict

import pytest

from spreadlake.llm import surrogates as S

KEY = b"key of the test"


def kinds(text):
    return {text[a:b]: kind for a, b, kind in S.entities(text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr Иванов came.", {"Иванов": "family"}),
        ("Frau Dr. Müller-Lüdenscheidt kam.", {"Müller": "family", "Lüdenscheidt": "family"}),
        ("Herr Prof. Dr. Hans-Peter Vogel kam.", {"Hans": "given_m", "Peter": "given_m", "Vogel": "family"}),
        ("Mr. O'Brien left.", {"O'Brien": "family"}),
        ("Ms Anna D’Angelo’s car.", {"Anna": "given_f", "D’Angelo": "family"}),
        ("Mr Berger's hat.", {"Berger": "family"}),
        ("Dear Anna, Dear Prof. Stone,", {"Anna": "given_f", "Stone": "family"}),
        ("Mr McDonald and Prof. Mrs Vale", {"McDonald": "family", "Vale": "family"}),
        ("Dr Dr Dr", {}),
        ("My name is Lena.", {"Lena": "given_f"}),
    ],
)
def test_parts_and_kinds(text, want):
    assert kinds(text) == want


def test_apostrophes_and_capitals_stay():
    made = S.surrogate("family", "o'brien", KEY)
    assert re.fullmatch(r"[a-z]'[a-z]{5}", made)
    assert re.fullmatch(r"[A-Z]'[A-Z][a-z]{4}", S.render("family", "O'Brien", made)) and S.render("family", "O'BRIEN", made) == made.upper()


@pytest.mark.parametrize(("script", "letters"), [("LATIN", "abcdefghijklmnop"), ("CYRILLIC", "абвгдежзиклмнопр"), ("GREEK", "αβγδεζηθικλμνξοπ")])
@pytest.mark.parametrize("kind", S.NAMES)
def test_composed_names(script, letters, kind):
    consonants, vowels, endings = S.SOUNDS[script]
    for n in range(2, 16):
        for turn in (1, 2, 7):
            made = S.surrogate(kind, letters[:n], KEY, turn)
            assert len(made) == n and {S.script_of(c) for c in made} == {script}
            assert made == S.surrogate(kind, letters[:n], KEY, turn) and made != S.surrogate(kind, letters[:n], b"other", turn) or n < 4
            if n > 5:
                assert made.endswith(endings[kind])
    assert len(S.surrogate(kind, letters[:5], KEY, S.WIDEN)) == 6


def test_ten_thousand_surnames(spark):
    rng = random.Random(3)
    names = set()
    while len(names) < 10_000:
        names.add("".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).title() + rng.choice(("r", "nn", "s", "")))
    names = sorted(names)
    df = spark.createDataFrame([(i, f"Mr {n} came. {n} left.") for i, n in enumerate(names)], "doc_id long, text string").repartition(8)
    made = {}
    for r in S.pseudonymise(df, KEY).collect():
        m = re.fullmatch(r"Mr (\w+) came\. (\w+) left\.", r["text"])
        assert m[1] == m[2]
        made[names[r["doc_id"]]] = m[1]
    assert len(set(made.values())) == 10_000 and not set(made.values()) & set(names)
    off = [abs(len(a) - len(b)) for a, b in made.items()]
    assert sum(x == 0 for x in off) > 9_900 and max(off) <= 2


def test_coreference_by_brute_force(spark):
    """Every mention of an entity gets the same surrogate wherever it stands, and different entities different ones."""
    rng = random.Random(9)
    family = ["O'Brien", "D'Amico", "Müller", "Lüdenscheidt", "Иванов", "Петрова", "Παππάς", "Ødegård", "McKay", "Ng", "Berger", "Weber"]
    given = ["Anna", "Karl", "Zoë", "Eva", "Иван", "Νίκος"]
    titles = ["Mr", "Mrs.", "Frau Dr.", "Herr Prof. Dr.", "Dr", "Señora"]
    texts = []
    for i in range(150):
        f, g, h = rng.choice(family), rng.choice(given), rng.choice(family)
        texts.append(f"{rng.choice(titles)} {g} {f} met {rng.choice(titles)} {h}-{f}. {f} wrote from u{i % 40}@x.org; {g} and {h.upper()} left.")
    out = {r["doc_id"]: (r["text"], r["entities"]) for r in S.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    made, owner = defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        new, spans = out[i]
        at, parts = 0, []
        for e in spans:
            mention = text[e["start"] : e["start"] + e["length"]]
            sort = "name" if e["kind"] in S.NAMES else e["kind"]
            entity = S.canonical(e["kind"], mention)
            made[sort, entity].add(e["surrogate"].lower())
            owner[sort, e["surrogate"].lower()].add(entity)
            assert e["surrogate"].isupper() == mention.isupper() or len(mention) < 2
            parts += [text[at : e["start"]], e["surrogate"]]
            at = e["start"] + e["length"]
        assert "".join([*parts, text[at:]]) == new
        assert {text[e["start"] : e["start"] + e["length"]].lower() for e in spans if e["kind"] in S.NAMES} == {w for w in re.findall(r"[\w'’]+", text.lower()) if w in {x.lower() for x in family + given}}
    assert all(len(x) == 1 for x in made.values()) and all(len(x) == 1 for x in owner.values())
    assert not {e for s, e in made if s == "name"} & {m for s, m in owner if s == "name"}
