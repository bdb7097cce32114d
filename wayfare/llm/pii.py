"""Surrogates for personal data.

Detected entities are replaced by keyed values of the same type and format.  Each replacement is a permutation of
the values of its format without fixed points: x -> p^-1(p(x) + c), where p is a keyed Feistel permutation of the
numbers below the count of such values (walking on from values outside the format).  So equal entities get equal
surrogates in every document and task (coreference), different ones different surrogates (distinctness), and
no entity stays as it is, without any table of entities.

* letters stay letters of their script and case, digits digits, marks stay: e-mail addresses (each label of a
  domain by itself, so that one domain stays one; the top-level domain is kept; addresses that differ in case only
  are one, and get one surrogate, each in its own case) and secrets in hexadecimal;
* phone numbers keep country code and layout; IPv4 and IPv6 addresses stay addresses; card numbers keep whether they
  pass Luhn's check, and account numbers (IBAN) whether their check digits are right;
* keys with a known beginning keep it; what is given as a password, key or token is replaced without its name; so are
  the lines of private keys;
* names after a title are replaced from the pool of their gender and script, each part by itself; names outside the pools
  by letters, walking on while the result is a name of a pool (the collision check).  Parts may have hyphens and
  apostrophes, initials, particles, or be all in capitals.  "Dr" and "Prof" say no gender: the given name's pool does.
  Where a document names a person by title, the same full, family and given names stand for that person without it too,
  before or after, but for a word at the beginning of a sentence that the text also has in lower case.

``audit`` counts collisions over all entities of a table of documents.

Defined results: null texts stay null, empty ones empty; repeated rows are changed alike; other columns pass through,
but for one that is named ``pii_counts``, which is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.text import small_batches

KEY = b"wayfare-surrogates-1"
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LX, _UX = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"
_GREEK, _CYR = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_ALPHABETS = [_D, _L, _U, _LX, _UX, _GREEK, _GREEK.upper(), _CYR, _CYR.upper()]
_CLASS = {c: a for a in _ALPHABETS for c in a}


@lru_cache(maxsize=10_000)
def alphabet(c: str) -> str | None:
    """The letters (or digits) for which ``c`` may stand: of its script and case, each character in one alphabet only.

    Scripts without an alphabet above are taken by blocks of 128 characters and by kind; None for other characters.
    """
    kind = unicodedata.category(c)
    if c in _CLASS or not (kind[0] == "L" or kind == "Nd"):
        return _CLASS.get(c)
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if x not in _CLASS and unicodedata.category(x) == kind)



MEN = ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Karl", "Otto", "Pierre", "Jean", "Louis", "Carlos", "Jorge", "Pablo", "Miguel"]
WOMEN = ["Mary", "Linda", "Susan", "Karen", "Laura", "Emma", "Anna", "Julia", "Greta", "Heidi", "Marie", "Claire", "Sophie", "Elise", "Carmen", "Lucia", "Elena", "Rosa"]
FAMILY = ["Smith", "Jones", "Brown", "Miller", "Davis", "Wilson", "Taylor", "Clark", "Schmidt", "Fischer", "Weber", "Becker", "Martin", "Bernard", "Dubois", "Moreau", "Garcia", "Lopez", "Ruiz", "Torres"]
MEN_CYR, WOMEN_CYR, FAMILY_CYR = ["Иван", "Пётр", "Олег", "Игорь", "Павел"], ["Анна", "Ольга", "Мария", "Елена", "Вера"], ["Петров", "Орлов", "Волков", "Зайцев", "Попов"]
TITLES = {"n": ["Dr", "Prof", "Professor", "Doctor"], "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña"]}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}

_MARKS = re.compile(r"[0-9@]|[Pp]ass|PASS|[Ss]ecret|SECRET|[Kk]ey|KEY|[Tt]oken|TOKEN")
_SPOKEN = [f"{t}{dot} " for t in _GENDER for dot in ("", ".")]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAP, _LOW_LETTER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_ONE_TITLE = rf"(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?"
#: One part of a name: O'Neil, Jean-Luc, McDonald, or all in capitals.
_PART = rf"(?!{_ONE_TITLE}(?!\w))(?:(?:[ODod]['’])?[{_CAP}][{_LOW_LETTER}]+(?:[{_CAP}][{_LOW_LETTER}]+)?(?:['’-][{_CAP}]?[{_LOW_LETTER}]{{2,}})*|(?:O['’])?[{_CAP}]{{2,}}(?:['’-][{_CAP}]{{2,}})*)(?!\w)"
_PARTICLE = "(?:von|van|der|den|de|du|da|di|del|della|la|le|ten|ter|zu|zur|bin|al)"
_NAME = rf"(?:[{_CAP}]\. ?)*{_PART}(?: (?:[{_CAP}]\. |(?:{_PARTICLE} ){{1,2}})?{_PART}){{0,3}}|(?:{_PARTICLE} ){{1,2}}{_PART}"
#: Beginnings of keys, and how long what follows is at least.  Fixed values.
_KEYS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{30,}|glpat-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|sk-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
_HEX = "[0-9A-Fa-f]{1,4}"
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[\w+-][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<pem>[\s0-9A-Za-z+/=:,-]*?)(?=-----END [A-Z ]*PRIVATE KEY-----)"
    rf"|(?P<key>(?<![0-9A-Za-z_-])(?:{_KEYS})(?![0-9A-Za-z_]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?i:(?<![0-9a-z])(?:password|passwd|passphrase|pwd|pass|secret(?:[_-]?key)?|api[_-]?key|access[_-]?key|auth[_-]?token|access[_-]?token|token))[\"']?(?: ?[=] ?|: ?(?=[\"']?\S*\d))[\"']?(?P<assigned>[^\s\"'<>,;]{4,})"
    rf"|(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))"
    rf"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{1,7}}:)(?![\w:]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?!\w))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w(])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    + (_TITLED := rf"|(?P<name>(?<!\w)(?:{_ONE_TITLE} )+(?:{_NAME}))")
)
_NAMES_ONLY = re.compile(_TITLED[1:])
_LEAD = re.compile(rf"(?:{_ONE_TITLE} )+")
TYPES = ["email", "pem", "key", "secret", "assigned", "ip", "ip6", "iban", "card", "ssn", "phone", "name"]
_FIXED = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_(?:live|test)_|sk-|AIza|eyJ")


def _round(key: bytes, tag: str, step: int, value: int, bits: int = 256) -> int:
    """A keyed number of ``bits`` bits or more."""
    out = hashlib.blake2b(f"{tag}|{step}|{value}".encode(), key=key, digest_size=32).digest()
    for k in range(1, -(-bits // 256)):
        out += hashlib.blake2b(f"{tag}|{step}|{value:x}|{k}".encode(), key=key, digest_size=32).digest()
    return int.from_bytes(out, "big")


def _permuted(key: bytes, tag: str, size: int, x: int, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: eight Feistel rounds over the next power of two, walked until inside."""
    low = max(1, (size - 1).bit_length() // 2)
    high = max(1, (size - 1).bit_length() - low)
    a, b = (1 << high) - 1, (1 << low) - 1
    while True:
        left, right = x >> low, x & b
        for step in reversed(range(8)) if back else range(8):
            if step % 2:
                left = (left ^ _round(key, tag, step, right, high)) & a
            else:
                right = (right ^ _round(key, tag, step, left, low)) & b
        x = left << low | right
        if x < size:
            return x


def moved(key: bytes, tag: str, size: int, x: int) -> int:
    """A keyed permutation of 0..size-1 that leaves nothing in place (size 1 excepted)."""
    if size < 2:
        return x
    shift = 1 + _round(key, tag, 99, 0) % (size - 1)
    return _permuted(key, tag, size, (_permuted(key, tag, size, x) + shift) % size, back=True)


def same_format(key: bytes, kind: str, value: str) -> str:
    """Letters for letters of the same script and case, digits for digits; other characters stay."""
    alphabets = [alphabet(c) for c in value]
    size, number = 1, 0
    for c, a in zip(value, alphabets):
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
    tag = f"{kind}|" + "".join(c if a is None else f"<{a[0]}>" for c, a in zip(value, alphabets))
    number, out = moved(key, tag, size, number), []
    for c, a in zip(reversed(value), reversed(alphabets)):
        if a:
            number, k = divmod(number, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _lower(c: str) -> str:
    return c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c


def any_case(key: bytes, kind: str, value: str) -> str:
    """``same_format`` of the value in lower case, with capitals where the value has them: values that differ in case are one."""
    low = "".join(map(_lower, value))
    out = same_format(key, kind, low)
    return "".join(x.upper() if c != v and len(x.upper()) == 1 and x.upper().lower() == x else x for v, c, x in zip(value, low, out))


def luhn(digits: str) -> bool:
    """True if a number passes the check of card numbers."""
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _until(key: bytes, kind: str, value: str, good) -> str:
    """The permutation, walked on until the result is in the same class as the value."""
    while True:
        value = same_format(key, kind, value)
        if good(value):
            return value


def _digits(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _given(key: bytes, kind: str, name: str, pools: list[list[str]]) -> str:
    if name.isupper() and len(name) > 1:  # the same person in capitals
        return _given(key, kind, "".join(c.lower() if k and name[k - 1].isalpha() else c for k, c in enumerate(name)), pools).upper()
    for k, pool in enumerate(pools):
        if name in pool:
            return pool[moved(key, f"{kind}|{k}", len(pool), pool.index(name))]
    taken = {x for pool in pools for x in pool}
    return _until(key, kind, name, lambda x: x not in taken)


def _titled(value: str) -> tuple[str, str, str]:
    """(titles with the space after them, gender, names) of a name after titles."""
    lead = _LEAD.match(value)[0]
    genders = {_GENDER[t.rstrip(".")] for t in lead.split()} - {"n"}
    return lead, min(genders, default="n"), value[len(lead) :]


def _person(gender: str, name: str) -> str:
    """The pool of a given name: by gender, or, where a title says none, by which pool has the name."""
    if gender == "n":
        first = name.capitalize()
        gender = "m" if first in MEN or first in MEN_CYR else "f" if first in WOMEN or first in WOMEN_CYR else "n"
    return {"m": "man", "f": "woman", "n": "person"}[gender]


def _parts(names: str) -> list[tuple[str, str]]:
    """(part, role) of full names: given names before, the family name at the end; initials and particles are such."""
    parts = re.findall(r"\S+", names)
    roles = ["particle" if re.fullmatch(_PARTICLE, p) else "initial" if p.endswith(".") else "given" for p in parts]
    return [(p, "family" if k == len(parts) - 1 else r) for k, (p, r) in enumerate(zip(parts, roles))]


def _check_digits(value: str) -> str:
    """The two digits that make an account number right."""
    rest = "".join(str(int(c, 36)) for c in value[4:] + value[:2] + "00")
    return f"{98 - int(rest) % 97:02d}"


def _account(value: str, key: bytes) -> str:
    bare = value.replace(" ", "")
    right = _check_digits(bare) == bare[2:4]
    new = bare[:4] + same_format(key, f"iban{bare[:2]}", bare[4:])
    digits = _check_digits(new)
    if not right:
        digits = _until(key, f"check{new[:2]}{new[4:]}", bare[2:4], lambda d: d != _check_digits(new))
    letters = iter(new[:2] + digits + new[4:])
    return "".join(c if c == " " else next(letters) for c in value)


def surrogate(kind: str, value: str, key: bytes = KEY) -> str:
    """The replacement of an entity."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        return any_case(key, "local", local) + "@" + ".".join([*(any_case(key, "label", x) for x in labels), top])
    if kind == "secret":
        number = moved(key, f"secret|{len(value)}", 16 ** len(value), int(value, 16))
        out = format(number, f"0{len(value)}x")
        return out if value.lower() == value else out.upper()
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number << 8 | int(part)
        number = moved(key, "ip", 1 << 32, number)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":
        number = moved(key, "ip6", 1 << 128, int(ipaddress.IPv6Address(value)))
        out = str(ipaddress.IPv6Address(number))
        return out.upper() if value.upper() == value and value.lower() != value else out
    if kind == "iban":
        return _account(value, key)
    if kind == "key":
        n = _FIXED.match(value).end()
        return value[:n] + same_format(key, f"key{value[:n]}", value[n:])
    if kind == "pem":
        return "\n".join(same_format(key, f"pem{k % 2}", line) for k, line in enumerate(value.split("\n")))
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        passes = luhn(digits)
        return _digits(value, _until(key, "card", digits, lambda x: luhn(x) == passes))
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=\D)", value)
        n = head.end() if head else 0
        return value[:n] + same_format(key, f"phone{value[:n]}", value[n:])
    if kind == "name":
        lead, gender, names = _titled(value)
        return lead + surrogate(_person(gender, names.split()[0]) if " " in names else "family", names, key)
    if kind in ("man", "woman", "person"):
        pools = {"man": [MEN, MEN_CYR], "woman": [WOMEN, WOMEN_CYR], "person": []}[kind]
        new = {"family": lambda p: surrogate("family", p, key), "given": lambda p: _given(key, f"given-{kind[0]}", p, pools), "particle": str, "initial": lambda p: same_format(key, "initial", p)}
        return " ".join(new[role](p) for p, role in _parts(value)) if " " in value else new["given"](value)
    if kind == "family":
        return _given(key, "family", value, [FAMILY, FAMILY_CYR])
    return same_format(key, kind, value)


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, from left to right: one of TYPES, or a name without its title."""
    if not text:
        return []
    pattern = _ENTITY if _MARKS.search(text) else _NAMES_ONLY if any(t in text for t in _SPOKEN) else None
    found = [(m.lastgroup, *m.span(m.lastgroup)) for m in pattern.finditer(text)] if pattern else []
    found = [f for f in found if f[0] != "ip6" or _is_address(text[f[1] : f[2]])]
    return sorted(found + _mentions(text, found), key=lambda e: e[1])


def _is_address(value: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def _mentions(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Where names that were found by title stand without one."""
    known: dict[str, str] = {}
    for kind, s, e in found:
        if kind != "name":
            continue
        _, gender, names = _titled(text[s:e])
        parts = _parts(names)
        person = _person(gender, names.split()[0])
        tail = len(parts) - 1
        while tail and parts[tail - 1][1] == "particle":
            tail -= 1
        for form in (str, str.upper):
            known.setdefault(form(parts[-1][0]), "family")
            if tail:
                known.setdefault(form(names), person)
                given = [p for p, role in parts if role == "given"]
                if given:
                    known.setdefault(form(" ".join([given[0], parts[-1][0]])), person)
                    for p in given:
                        known.setdefault(form(p), person)
    if not known:
        return []
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(known, key=len, reverse=True))) + r")(?!\w)")
    common = {n for n in known if n[1:].islower() and re.search(rf"(?<!\w){re.escape(n.lower())}(?!\w)", text)}
    gaps = zip([0, *(e for _, _, e in found)], [*(s for _, s, _ in found), len(text)])
    out = [(known[m[0]], m.start(), m.end()) for a, b in gaps for m in pattern.finditer(text, a, b)]
    return [m for m in out if text[m[1] : m[2]] not in common or not _begins(text, m[1])]


def _begins(text: str, at: int) -> bool:
    """Whether a sentence begins at a place."""
    before = text[max(0, at - 8) : at].rstrip(" \"'“‘(")
    return at == 0 or not before or before[-1] in ".!?:\n"


def replaced(text: str, key: bytes, known: dict) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and the number of entities by type."""
    found = entities(text)
    if not found:
        return text, {}
    out, at, counts = [], 0, {}
    for kind, s, e in found:
        value = text[s:e]
        if (kind, value) not in known:
            if len(known) > 200_000:
                known.clear()
            known[kind, value] = surrogate(kind, value, key)
        out += [text[at:s], known[kind, value]]
        at = e
        kind = kind if kind in TYPES else "name"
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


def with_surrogates(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """``docs`` with entities of ``text`` replaced; adds ``pii_counts``, a map from type to number."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "pii_counts"))
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_counts", T.MapType(T.StringType(), T.IntegerType()))])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            new, counts = [], []
            for value in batch.column(place):
                value, n = replaced(value.as_py(), key, known)
                new.append(value)
                counts.append(list(n.items()))
            columns = batch.columns
            columns[place] = pa.array(new, batch.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int32()))], [*batch.schema.names, "pii_counts"])

    return docs.mapInArrow(change, schema)


def found_entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The distinct entities of all documents: type, value, surrogate."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, t[s:e]) for t in batch.column(0).to_pylist() for k, s, e in entities(t)}
            cols = [[k for k, _ in rows], [v for _, v in rows], [surrogate(k, v, key) for k, v in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["type", "value", "surrogate"])

    return docs.select(F.col("text").cast("string")).mapInArrow(find, "type string, value string, surrogate string").distinct()


def audit(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """For each type: entities, distinct surrogates and entities left unchanged.  The first two are equal and the last is 0.

    Addresses and secrets that differ in case only are one entity.
    """
    own = lambda c: F.when(F.col("type").isin("email", "secret"), F.lower(c)).otherwise(F.col(c)).alias(c)
    rows = found_entities(docs, key).select("type", own("value"), own("surrogate")).distinct()
    return rows.groupBy("type").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("surrogate").alias("n_surrogates"), F.sum((F.col("value") == F.col("surrogate")).cast("long")).alias("n_unchanged"))
