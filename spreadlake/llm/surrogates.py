"""Surrogates for personal data (op7): detected entities get keyed replacements of the same kind and format.

Kinds: e-mail, IPv4 and IPv6 addresses, telephone numbers, payment card numbers (13 to 19 digits with a valid check
digit), bank accounts (IBAN with valid check digits), social security, insurance and identity numbers, street
addresses, secrets behind a name such as ``token =``, and names behind a title, a salutation or an introduction.

An entity is its canonical form: digits of a number, an address in lower case, a name part by part in lower case.
So every spelling of it in the corpus gets the same surrogate, written in the format of the place: separators, country
code, capitals, the address's words stay.  A name part is replaced wherever else its document has it as a word.

Names are given by a keyed hash, by script, gender and whether they are given or family names: first one of like
length of a short list, and whoever shares that with another gets one composed of the script's sounds, as long as the name itself and with an ending of its
kind.  Apostrophes and hyphens stay where they are.  Streets are drawn from the lists.  A title's gender counts double against one
guessed from the ending, a lone name behind a title is a family name, and the corpus decides by majority what a part is, so it has
one surrogate.  The other kinds take a keyed permutation of the strings of their format: digits
stay digits, letters keep class and script, an issuer's digit, a country and a top-level domain stay, check digits are right.

A surrogate that some document holds as a real entity, the entity itself included, or that another entity has got,
would join two persons.  Such collisions are looked for over the whole corpus; those entities draw again,
names and others after some turns with a letter more, streets with one more element of the list at each, until none is left.
A number's format can't be widened: if its strings are all taken after TURNS turns, an error says so.

Not found: names that a document never introduces, names in scripts without capitals, inflected forms, initials.

Defined results: a null text has no entities and stays null, an empty one empty; texts are taken whole; repeated
rows are treated alike; a null id stays; an empty table gives no rows; other columns pass through,
also those with names used here.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import record, text_blocks
from .shared import cut

EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.ASCII)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)", re.ASCII)
CARD = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)", re.ASCII)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])", re.ASCII)
NINO = re.compile(r"(?<!\w)[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.ASCII)
DNI = re.compile(r"(?<!\w)\d{8}-?[A-HJ-NP-TV-Z](?!\w)", re.ASCII)
SECRET = re.compile(r"(?i)(?<=\b)((?:api[_ -]?key|access[_ -]?key|secret(?:[_ -]?key)?|token|password|passwd|bearer)[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9_+/.=-]{8,})")
# Titles before a name and their gender; words that introduce one; what such words also precede; kinds of streets; check letters of DNI.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f"}
INTRODUCTIONS = ("My name is", "my name is", "Mein Name ist", "mein Name ist", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle", "Mon nom est", "mon nom est", "Me llamo", "me llamo", "Mi nombre es", "mi nombre es", "Name:", "Nombre:", "Nom:", "Dear", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida", "Estimado", "Estimada", "Sincerely,", "Regards,", "Grüßen,", "Cordialement,", "Atentamente,")
GENDERED = {"Liebe": "f", "Lieber": "m", "Cher": "m", "Chère": "f", "Querido": "m", "Querida": "f", "Estimado": "m", "Estimada": "f"}
NOT_NAMES = {"Sir", "Sirs", "Madam", "Customer", "Customers", "Team", "All", "Friend", "Friends", "Colleague", "Colleagues", "Reader", "Readers", "Kunde", "Kunden", "Freunde", "Client", "Clients", "Amis", "Cliente", "Clientes", "Amigos"}
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Terrace")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_CAP = r"[^\W\d_a-zß-öø-ÿа-яά-ώ]"
_APOSTROPHE = "['’]"
_PART = rf"{_CAP}(?:{_APOSTROPHE}{_CAP})?[^\W\d_]+(?:{_APOSTROPHE}[^\W\d_]{{2,}})?"
_NAME = rf"({_PART}(?:(?: (?:von|van|de|del|della|di|da|der|den|la|du))*[ -]{_PART}){{0,2}})"
_TITLED = r"((?:(?:" + "|".join(TITLES) + r")\.? )+)"
NAME = re.compile(r"(?<!\w)" + _TITLED + _NAME)
INTRODUCED = re.compile(r"(?<!\w)(" + "|".join(INTRODUCTIONS) + r")\s+" + _TITLED + "?" + _NAME)
ADDRESS = re.compile(
    rf"(?<![\w.,])(?P<n1>\d{{1,5}}) (?P<s1>{_PART}(?: {_PART}){{0,2}}) (?:{'|'.join(STREETS)})(?!\w)"
    rf"|(?<!\w)(?P<s2>{_CAP}[^\W\d_]+)(?:straße|strasse|weg|gasse|allee|platz) (?P<n2>\d{{1,4}})(?!\w|[.,]\d)"
    rf"|(?<![\w.,])(?P<n3>\d{{1,5}}),? (?:rue|avenue|boulevard|place|chemin) (?:de la |de |du |des )?(?P<s3>{_PART}(?: {_PART}){{0,2}})"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo) (?:de la |de |del |de los )?(?P<s4>{_PART}(?: {_PART}){{0,2}}),? (?P<n4>\d{{1,4}})(?!\w|[.,]\d)"
)
STREET_SIGNS = (*(f" {x}" for x in STREETS), "straße ", "strasse ", "weg ", "gasse ", "allee ", "platz ", "rue ", "avenue ", "boulevard ", "place ", "chemin ", "Calle ", "Avenida ", "Plaza ", "Paseo ")
# Names to draw from.
GIVEN = {
    ("LATIN", "f"): "Alma Berta Clara Dora Elisa Flora Greta Hanna Irma Julia Karla Lena Marta Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("LATIN", "m"): "Anton Bruno Carlos Daniel Edgar Felix Gustav Hugo Ivan Julius Konrad Leon Martin Norman Oscar Paul Robert Simon Tomas Viktor".split(),
    ("CYRILLIC", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга".split(),
    ("CYRILLIC", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Олег".split(),
    ("GREEK", "f"): "Άννα Δάφνη Ελένη Ζωή Θάλεια Ιωάννα Καλλιόπη Μαρία Νίκη Σοφία".split(),
    ("GREEK", "m"): "Άγγελος Γιώργος Δήμος Ηλίας Θωμάς Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος".split(),
}
FAMILY = {
    "LATIN": "Abel Bauer Castel Dorn Eklund Ferrer Garnier Holt Iversen Jansen Keller Lindner Moreno Norden Ortega Palmer Quist Rivera Sander Talbot Ulrich Vidal Weber Zeller".split(),
    "CYRILLIC": "Андреев Белов Волков Громов Дроздов Ершов Зимин Исаев Котов Лебедев Морозов Носов".split(),
    "GREEK": "Αλεξίου Βασιλείου Γεωργίου Δημητρίου Ευσταθίου Ζαχαρίου Ιωάννου Κυριάκου Λουκά Μιχαήλ".split(),
}
# Sounds that names are composed of, consonants and vowels, and endings by kind.
SOUNDS = {
    "LATIN": ("bdfghklmnprstvwz", "aeiou", {"family": ("er", "en", "in", "ov", "ard", "el", "and", "ez"), "given_f": ("a", "ia", "ina", "e"), "given_m": ("an", "o", "us", "in")}),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", {"family": ("ов", "ев", "ин", "енко"), "given_f": ("а", "ия", "ина"), "given_m": ("ан", "ей", "ил")}),
    "GREEK": ("βγδζθκλμνπρσ", "αειου", {"family": ("ου", "ιδης", "ακης"), "given_f": ("α", "η", "ια"), "given_m": ("ος", "ης", "ας")}),
}
VOWELS = set("aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýаеёиоуыэюяαεηιουωάέήίόύώ")
NAMES = ("family", "given_f", "given_m")
ROUNDS = 8
WIDEN = 8  # turns after which an e-mail address or secret gets one letter more, as its format may have no free string
TURNS = 64  # of a number: in a format half of whose strings are taken, one in 2^64 entities needs more


def check_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def iban_rest(iban: str) -> int:
    """The number of the account and country modulo 97: 1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


@lru_cache(maxsize=512)
def _alphabet(c: str) -> str:
    """The characters that a surrogate may have in this one's place: of the same case, script and sound."""
    if c.isascii():
        if c.isdigit():
            return "0123456789"
        base = [x for x in "abcdefghijklmnopqrstuvwxyz" if (x in VOWELS) == (c.lower() in VOWELS)]
        return "".join(base).upper() if c.isupper() else "".join(base)
    block = ord(c) & ~0xFF
    kin = [x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == unicodedata.category(c) and script_of(x) == script_of(c) and (x.lower() in VOWELS) == (c.lower() in VOWELS)]
    return "".join(kin) if c in kin else c


def _permute(values: list[int], sizes: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A keyed permutation of the tuples with these sizes: a Feistel network over two halves."""
    n = len(values)
    if n == 1:
        values, sizes = [values[0], 0], [sizes[0], 1]
    half = len(values) // 2
    parts, moduli = [0, 0], [1, 1]
    for side, span in enumerate((range(half), range(half, len(values)))):
        for i in span:
            parts[side] = parts[side] * sizes[i] + values[i]
            moduli[side] *= sizes[i]
    for r in range(ROUNDS):
        to, by = r % 2, 1 - r % 2
        size = (moduli[to].bit_length() + 7) // 8 + 8
        mac = hmac.new(key, tweak + bytes([r]) + parts[by].to_bytes((moduli[by].bit_length() + 7) // 8 + 1, "big"), hashlib.sha512).digest()
        stream = mac if size <= len(mac) else hashlib.shake_256(mac).digest(size)
        parts[to] = (parts[to] + int.from_bytes(stream[:size], "big")) % moduli[to]
    out = [0] * len(values)
    for side, span in enumerate((range(half), range(half, len(values)))):
        for i in reversed(span):
            parts[side], out[i] = divmod(parts[side], sizes[i])
    return out[:n]


def _drawn(names: list[str], n: int, key: bytes, tweak: bytes) -> str:
    """n names of the list as one word, by a keyed hash."""
    mac = int.from_bytes(hmac.new(key, tweak, hashlib.sha512).digest(), "big")
    out = []
    for _ in range(n):
        mac, i = divmod(mac, len(names))
        out.append(names[i])
    return out[0] + "".join(x.lower() for x in out[1:])


def _composed(kind: str, script: str, length: int, key: bytes, tweak: bytes) -> str:
    """A name of so many letters in turns of consonant and vowel, with an ending of its kind where there is room."""
    consonants, vowels, endings = SOUNDS[script]
    mac = int.from_bytes(hashlib.shake_256(hmac.new(key, b"sounds" + tweak, hashlib.sha512).digest()).digest(length + 32), "big")

    def pick(of):
        nonlocal mac
        mac, i = divmod(mac, len(of))
        return of[i]

    ending = pick(endings[kind])
    out = ending if len(ending) + 1 < length else pick(vowels if kind == "given_f" else consonants)
    while len(out) < length:
        out = pick(consonants if out[0] in VOWELS else vowels) + out
    return out


def _name(kind: str, entity: str, script: str, key: bytes, turn: int) -> str:
    """Each run of letters for itself; what stands between them stays, and later turns lengthen the last run."""
    tweak = f"{kind}{turn or ''}{entity}".encode()
    names = [x for x in (FAMILY[script] if kind == "family" else GIVEN[script, kind[-1]]) if abs(len(x) - len(entity)) < 2]
    runs = re.split(f"({_APOSTROPHE})", entity)
    if names and not turn and len(runs) == 1:
        return _drawn(names, 1, key, f"{kind}{entity}".encode()).lower()
    last = len(runs) - 1
    return "".join(x if i % 2 else _composed(kind if i == last else "family", script, max(1, len(x)) + (turn // WIDEN if i == last else 0), key, tweak + bytes([i % 256])) for i, x in enumerate(runs))


def country_code(digits: str) -> int:
    """How many digits the country code of an international number has."""
    if digits[:1] in ("1", "7"):
        return 1
    # The two-digit codes.
    two = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    return 2 if digits[:2] in two.split() else 3


def canonical(kind: str, mention: str) -> str:
    """The entity that a mention names."""
    if kind == "phone":
        digits = re.sub(r"\D", "", mention)
        return "+" + digits if "+" in mention else "+1" + digits if len(digits) == 10 and re.search(r"\D", mention) else digits
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind in ("iban", "nino", "dni"):
        return re.sub(r"[ -]", "", mention)
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in mention.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(mention).exploded
    if kind == "address":
        m = ADDRESS.fullmatch(mention)
        number, street = (next(g for k, g in m.groupdict().items() if k[0] == x and g) for x in "ns")
        return f"{number} {street.lower()}"
    return mention if kind == "secret" else mention.lower()


def surrogate(kind: str, entity: str, key: bytes, turn: int = 0) -> str:
    """The canonical form that replaces a canonical entity: under each turn another one."""
    tweak = f"{kind}{turn or ''}".encode()
    if kind in NAMES:
        script = script_of(entity[0])
        if script in SOUNDS:
            return _name(kind, entity, script, key, turn)
        entity += entity[-1] * (turn // WIDEN)
    if kind == "address":
        number, _, street = entity.partition(" ")
        names = FAMILY.get(script_of(street[0]), FAMILY["LATIN"])
        first, *more = _permute([int(number[0]) - 1 if number[0] != "0" else 0, *map(int, number[1:])], [9] + [10] * (len(number) - 1), key, tweak)
        return f"{first + 1}{''.join(map(str, more))} {_drawn(names, 1 + turn, key, tweak + entity.encode())}".lower()
    if kind == "ipv4":
        return ".".join(map(str, _permute([int(x) for x in entity.split(".")], [256] * 4, key, tweak)))
    if kind == "ipv6":  # the first group says what sort of address it is
        first, *groups = entity.split(":")
        return ":".join([first, *(f"{x:04x}" for x in _permute([int(x, 16) for x in groups], [1 << 16] * 7, key, tweak))])
    if kind in ("email", "secret"):  # all of a turn are widened alike, so different ones stay different
        entity = "n" * (turn // WIDEN) + entity
    free = [i for i, c in enumerate(entity) if len(_alphabet(c)) > 1 and (c.isalpha() or c.isdigit())]
    fixed = 0
    if kind == "card":
        free = free[1:-1]  # the issuer's digit stays, the check digit follows
    elif kind == "phone" and entity.startswith("+"):
        fixed = 1 + country_code(entity[1:])
    elif kind == "iban":
        fixed = 4
    elif kind == "dni":
        free = free[:8]
    elif kind == "nino":
        fixed = 2
        free = free[:-1]
    elif kind == "email":
        free = [i for i in free if i < entity.rindex(".")]  # the top-level domain stays
    free = [i for i in free if i >= fixed]
    if not free:
        return entity
    alphabets = [_alphabet(entity[i]) for i in free]
    if kind == "secret" and (hexadecimal := next((h for h in ("0123456789abcdef", "0123456789ABCDEF") if set(entity) <= set(h)), None)):
        alphabets = [hexadecimal] * len(free)
    shape = "".join("0" if len(a) == 10 and a[0] == "0" else a[0] for a in alphabets)
    got = _permute([a.index(entity[i]) for i, a in zip(free, alphabets, strict=True)], [len(a) for a in alphabets], key, tweak + shape.encode() + re.sub(r"[^\W_]", "x", entity).encode())
    out = list(entity)
    for i, a, v in zip(free, alphabets, got, strict=True):
        out[i] = a[v]
    if kind == "card":
        out[-1] = str((10 - check_sum("".join(out[:-1]) + "0")) % 10)
    elif kind == "dni":
        out[8] = DNI_LETTERS[int("".join(out[:8])) % 23]
    elif kind == "iban":
        out[2:4] = f"{98 - iban_rest(''.join(out[:2]) + '00' + ''.join(out[4:])):02d}"
    return "".join(out)


def _filled(mention: str, made: str) -> str:
    """The mention with its letters and digits, from the last, replaced by made's; what is left over goes ahead of them."""
    left = list(made)
    out = [left.pop() if c.isalnum() and left else c for c in reversed(mention)]
    at = next((i for i, c in enumerate(reversed(out)) if c.isalnum()), 0)
    out = out[::-1]
    return "".join([*out[:at], *left, *out[at:]])


def render(kind: str, mention: str, made: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind in (*NAMES, "email"):
        if mention.isupper():
            return made.upper()
        if kind == "email":
            longer = len(made) - len(mention)
            return made[:longer] + "".join(x.upper() if c.isupper() else x for x, c in zip(made[longer:], mention, strict=True))
        if mention[0].islower():
            return made
        large = re.search(f"{_APOSTROPHE}{_CAP}", mention)
        return re.sub(f"(^|{_APOSTROPHE})(.)" if large else "(^)(.)", lambda m: m[1] + m[2].upper(), made)
    if kind == "phone":
        digits = sum(c.isdigit() for c in mention)
        return _filled(mention, made[-digits:] if digits < len(made) else made)
    if kind in ("card", "ssn", "iban", "nino", "dni"):
        return _filled(mention, made)
    if kind == "ipv6":
        made = made if "::" not in mention else ipaddress.IPv6Address(made).compressed
        return made.upper() if mention != mention.lower() else made
    if kind == "address":
        m = ADDRESS.fullmatch(mention)
        number, street = (next(k for k, g in m.groupdict().items() if k[0] == x and g) for x in "ns")
        new_number, _, new_street = made.partition(" ")
        for group, new in sorted(((number, new_number), (street, new_street[0].upper() + new_street[1:])), key=lambda x: -m.start(x[0])):
            mention = mention[: m.start(group)] + new + mention[m.end(group) :]
        return mention
    return made


def _gender(titles: str) -> str:
    """Of a chain of titles, the first that tells."""
    return next((TITLES[t] for t in re.findall(r"\w+", titles) if TITLES[t]), "")


def _named(text: str) -> dict[str, tuple[str, int]]:
    """Name parts that the text introduces, as they stand there, with their kind and the weight of its evidence."""
    out: dict[str, tuple[str, int]] = {}
    found = []
    if any(t in text for t in TITLES):
        found += [(m[2], _gender(m[1]), True) for m in NAME.finditer(text)]
    if any(t in text for t in INTRODUCTIONS):
        found += [(m[3], GENDERED.get(m[1], _gender(m[2] or "")), bool(m[2])) for m in INTRODUCED.finditer(text)]
    for name, gender, titled in found:
        # A word is a part, or several with hyphens between, which are of one kind.
        spoken = [[x for x in re.findall(_PART, w) if x not in TITLES and x not in NOT_NAMES] for w in name.split(" ")]
        spoken = [parts for parts in spoken if parts]
        for i, parts in enumerate(spoken):
            for part in parts:
                sure = 2 if gender else 1
                if i == len(spoken) - 1 and (len(spoken) > 1 or gender or titled):
                    kind = "family"
                else:
                    kind = "given_" + (gender or ("f" if part[-1].lower() in "aeiаяαη" else "m"))
                if part not in out or out[part][1] < sure:
                    out[part] = kind, sure
    return out


def entities(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind), none overlapping; where two do, the one that begins first, then the longer."""
    return [(a, b, kind) for a, b, kind, _ in _entities_of(text)]


def _entities_of(text: str) -> list[tuple[int, int, str, int]]:
    found: list[tuple[int, int, str, int]] = []

    def add(kind: str, matches, group: int = 0) -> None:
        found.extend((m.start(group), m.end(group), kind, 1) for m in matches)

    if "@" in text:
        add("email", EMAIL.finditer(text))
    if "=" in text or ":" in text:
        add("secret", SECRET.finditer(text), 2)
    if text.count(":") > 6 or "::" in text:
        add("ipv6", (m for m in IPV6.finditer(text) if _is_ipv6(m[0])))
    if len(text) > 6 and re.search(r"\d\D?\d", text):
        add("ipv4", IPV4.finditer(text))
        add("phone", PHONE.finditer(text))
        add("card", (m for m in CARD.finditer(text) if check_sum(re.sub(r"\D", "", m[0])) == 0))
        add("iban", (m for m in IBAN.finditer(text) if iban_rest(m[0].replace(" ", "")) == 1))
        add("ssn", SSN.finditer(text))
        add("nino", NINO.finditer(text))
        add("dni", (m for m in DNI.finditer(text) if DNI_LETTERS[int(m[0][:8]) % 23] == m[0][-1]))
    if any(s in text for s in STREET_SIGNS):
        add("address", ADDRESS.finditer(text))
    if named := _named(text):  # every mention of a part in the document, with a title or without
        kinds = {p.upper(): k for p, k in named.items()} | named
        again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(kinds, key=lambda x: (-len(x), x))) + r")(?!\w)")
        found += [(m.start(), m.end(), *kinds[m[0]]) for m in again.finditer(text)]
    out, end = [], 0
    for e in sorted(found, key=lambda x: (x[0], -x[1])):
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _is_ipv6(s: str) -> bool:
    try:
        return len(re.findall(r"[0-9A-Fa-f]+", s)) > 2 and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


FOUND = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("made", pa.string())])
COUNTED = pa.schema([*FOUND, ("n", pa.int64())])


def _entities(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, made, n: the evidence for it; partial sums of a block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                got: dict[tuple[str, str], int] = {}
                for t in block.column("text").to_pylist():
                    for a, b, kind, sure in _entities_of(t) if t else ():
                        e = kind, canonical(kind, t[a:b])
                        got[e] = got.get(e, 0) + sure
                yield record(COUNTED, [k for k, _ in got], [e for _, e in got], [surrogate(k, e, key) for k, e in got], list(got.values()))

    return docs.mapInArrow(run, "kind string, entity string, made string, n long")


def _turned(collided: DataFrame, key: bytes, turn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names = (batch.column(c).to_pylist() for c in FOUND.names[:2])
            yield record(FOUND, kinds, names, [surrogate(k, e, key, turn) for k, e in zip(kinds, names, strict=True)])

    return collided.select(*FOUND.names[:2]).mapInArrow(run, "kind string, entity string, made string")


def _sort(kind: Column) -> Column:
    """What must not meet: all names, or the entities of another kind."""
    return F.when(kind.isin(*NAMES), "name").otherwise(kind)


def _collided(moved: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of moved whose surrogate is taken, or that share it with a smaller entity."""
    held = moved.join(taken, ["sort", "made"], "left_semi")
    owner = moved.groupBy("sort", "made").agg(F.min("entity").alias("owner"))
    shared = moved.join(owner, ["sort", "made"]).where("entity <> owner").select(*moved.columns)
    return held.unionByName(shared).distinct()


def replacements(docs: DataFrame, key: bytes, turns: int = TURNS) -> tuple[DataFrame, DataFrame | None]:
    """(kind, entity, made) of all different entities, and of those that don't get their first surrogate, None if there are none.

    The latter draw again, turn by turn, until what they get is neither real, themselves included, nor given to another.
    """
    counted = cut(_entities(docs, key).groupBy("kind", "entity", "made").agg(F.sum("n").alias("n")).withColumn("sort", _sort(F.col("kind"))))
    # A name part is what most of the corpus takes it for.
    chosen = counted.groupBy("sort", "entity").agg(F.max(F.struct("n", "kind", "made")).alias("x"))
    real = cut(chosen.select("sort", "x.kind", "entity", "x.made"))
    taken = real.select("sort", F.col("entity").alias("made"))
    again = cut(_collided(real, taken))
    settled = real.join(again.select("sort", "entity"), ["sort", "entity"], "left_anti")
    taken = taken.unionByName(settled.select("sort", "made"))
    turn = 0
    while not again.isEmpty():
        turn += 1
        if turn == turns:
            raise ValueError(f"{again.count()} entities without a free surrogate after {turns} turns")
        moved = cut(_turned(again, key, turn).withColumn("sort", _sort(F.col("kind"))))
        again = cut(_collided(moved, taken))
        done = cut(moved.join(again.select("sort", "entity"), ["sort", "entity"], "left_anti"))
        taken = taken.unionByName(done.select("sort", "made"))
        settled = settled.unionByName(done.select(*settled.columns))
    other = counted.select("sort", "kind", "entity", F.col("made").alias("first")).join(settled.select("sort", "entity", "made"), ["sort", "entity"]).where("made <> first")
    other = cut(other.select("kind", "entity", "made"))
    return real.select(*FOUND.names), None if other.isEmpty() else other


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("surrogate", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "entities") -> DataFrame:
    """docs with entities replaced in the text, and the replaced spans of the old text in ``out``."""
    names = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col(f"`{text_col}`").cast("string").alias("text"))
    _, settled = replacements(rows.select("text"), key)
    special = "cast(null as map<string, string>) as special"
    if settled is None:
        rows = rows.selectExpr("r", "text", special)
    else:  # the documents that hold such entities get them by an equi-join, a map for each document
        keyed = cut(rows.select("text").withColumn("h", F.md5("text")).dropDuplicates(["h"]))
        held = _held(keyed).join(settled.select(F.concat_ws("\x00", "kind", "entity").alias("e"), "made"), "e").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("e", "made"))).alias("special"))
        rows = rows.withColumn("h", F.md5("text")).join(cut(held), "h", "left").select("r", "text", "special")
    kept = rows.schema["r"].dataType
    spans_type = T._parse_datatype_string("array<struct<kind: string, start: long, length: long, surrogate: string>>")
    schema = T.StructType([T.StructField("r", kept), T.StructField("text", T.StringType()), T.StructField("spans", spans_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                texts, spans = [], []
                for text, special in zip(block.column("text").to_pylist(), block.column("special").to_pylist(), strict=True):
                    got = entities(text) if text else []
                    other = dict(special or ())
                    parts, at, marks = [], 0, []
                    for a, b, kind in got:
                        entity = canonical(kind, text[a:b])
                        made = render(kind, text[a:b], other.get(f"{kind}\x00{entity}") or surrogate(kind, entity, key))
                        parts += [text[at:a], made]
                        marks.append({"kind": kind, "start": a, "length": b - a, "surrogate": made})
                        at = b
                    texts.append("".join([*parts, text[at:]]) if got else text)
                    spans.append(marks)
                yield pa.RecordBatch.from_arrays([block.column("r"), pa.array(texts, type=pa.string()), pa.array(spans, type=SPANS)], names=["r", "text", "spans"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("r").getField(c).alias(c) for c in names], F.col("spans").alias(out))


def _held(keyed: DataFrame) -> DataFrame:
    schema = pa.schema([("h", pa.string()), ("e", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                pairs = {(h, f"{k}\x00{canonical(k, t[a:b])}") for h, t in zip(block.column("h").to_pylist(), block.column("text").to_pylist(), strict=True) if t for a, b, k in entities(t)}
                yield record(schema, [h for h, _ in pairs], [e for _, e in pairs])

    return keyed.select("h", "text").mapInArrow(run, "h string, e string")
