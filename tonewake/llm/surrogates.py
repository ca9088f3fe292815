"""Personal data replaced by keyed surrogates.

Detected entities get replacements of their own type, format, script and (given names) gender.  Every replacement is a keyed
permutation of the set of values of that format, so that equal entities get equal surrogates in every document and different
ones stay different: within a format by construction; collisions() checks it over the corpus.  No table of entities is kept
or shipped, and the work is one narrow pass.

A null text stays null and has no entities.  Each row is treated alone; repeated rows get equal results.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

#: Our choices: given names by gender, family names, titles, and what stands before a name in running text.
FEMALE = ("Alice", "Anna", "Camille", "Carmen", "Claire", "Elena", "Elizabeth", "Emma", "Hannah", "Isabel", "Jennifer", "Julia", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Olivia", "Patricia", "Sarah", "Sofia", "Sophie", "Susan")
MALE = ("Alexander", "Antonio", "Carlos", "Daniel", "David", "Felix", "Francisco", "Hans", "James", "Jean", "John", "Jorge", "Juan", "Karl", "Lucas", "Michael", "Miguel", "Pablo", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William")
FAMILY = ("Anderson", "Becker", "Bernard", "Brown", "Davis", "Dubois", "Durand", "Fischer", "Garcia", "Gonzalez", "Hernandez", "Hoffmann", "Johnson", "Jones", "Lambert", "Lopez", "Martin", "Martinez", "Meyer", "Miller", "Moreau", "Schmidt", "Schneider", "Smith", "Taylor", "Weber", "Williams", "Wilson")
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Señora")

CUES = ("my name is", "i am called", "je m'appelle", "mon nom est", "ich heiße", "mein name ist", "me llamo", "mi nombre es", "name:", "nom:", "nombre:", "author:", "contact:", "from:", "to:", "signed,", "sincerely,", "regards,", "mit freundlichen grüßen", "cordialement,", "atentamente,", "dear", "liebe", "lieber", "cher", "chère", "querido", "querida", "estimado", "estimada", "sehr geehrter herr", "sehr geehrte frau")
#: After a Han name, and before one.
HONORIFICS, LABELS = ("先生", "女士", "小姐", "さん", "様", "氏"), ("姓名", "名前", "氏名")

CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-ŽΑ-ΩЀ-Я][^\W\d_]+(?:['’-][^\W\d_]+)*"
GIVEN = "|".join(FEMALE + MALE)
NAME = re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\.?\s(?P<titled>{CAPITAL}(?:\s{CAPITAL})?)|(?P<full>(?:{GIVEN})\s{CAPITAL}))")
NAME_HINT = re.compile(rf"\b(?:{'|'.join(TITLES)}|{GIVEN})\b")
#: Some words with capitals: a name where a cue stands before them, or is the first of them, or an address comes after them.
CAPITALS = re.compile(rf"{CAPITAL}(?:[ ]{CAPITAL}){{1,3}}")
ADDRESS = re.compile(r"\s<[^\s<>@]+@")
LONGEST_CUE = max(map(len, CUES)) + 2
HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")
HAN_NAME = re.compile(f"(?P<han>[\u3400-\u4dbf\u4e00-\u9fff]{{2,4}}?)(?=(?:{'|'.join(HONORIFICS)}))|(?:{'|'.join(LABELS)})[:：]\\s*(?P<labelled>[\u3400-\u4dbf\u4e00-\u9fff]{{2,4}})")
#: Version 6 addresses are looked for where two colons stand near each other.
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
VERSION_6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
#: A phone ends where, after a space, an address, card, number or secret of its own starts.
APART = r"(?! (?:(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)|(?:\d{4}[ -]?){3}\d{1,7}(?![ -]?\d)|\d{3}-\d{2,3}-\d{4}(?![\d-])|(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32}|[A-Za-z0-9._%+-]+@))"
STRUCTURED = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>\b(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|\bAKIA[0-9A-Z]{16}\b|(?<![0-9A-Za-z])(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?!\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:" + rf"(?:{APART}[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d|\.\d))" + r"|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-]))"
)
KINDS = ("name", "email", "phone", "card", "ip", "ssn", "iban", "secret")
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def _round(key: bytes, tweak: str, side: int, number: int, modulus: int) -> int:
    n = (modulus.bit_length() + 7) // 8 + 8
    seed = b"%d|%d|" % (side, number) + tweak.encode()
    out = b"".join(hashlib.blake2b(seed, key=key, person=b"%d" % i, digest_size=64).digest() for i in range(-(-n // 64)))
    return int.from_bytes(out[:n], "big") % modulus


def permute(key: bytes, tweak: str, digits: list[int], radices: list[int], rounds: int = 6) -> list[int]:
    """A keyed bijection of mixed-radix numbers that moves every one of them.

    An alternating Feistel network over their two halves, a keyed step that isn't 0, and the network backwards: a step has no
    fixed point, and so what it is turned into has none."""
    half = (len(digits) + 1) // 2
    sizes = [1, 1]
    parts = [0, 0]
    for i, (d, r) in enumerate(zip(digits, radices, strict=True)):
        side = i >= half
        parts[side], sizes[side] = parts[side] * r + d, sizes[side] * r
    sides = [k % 2 for k in range(rounds) if sizes[k % 2] > 1]
    for k, side in enumerate(sides):
        parts[side] = (parts[side] + _round(key, tweak, k, parts[1 - side], sizes[side])) % sizes[side]
    whole = sizes[0] * sizes[1]
    if whole > 1:
        moved = (parts[0] * sizes[1] + parts[1] + 1 + _round(key, tweak, rounds, 0, whole - 1)) % whole
        parts = list(divmod(moved, sizes[1]))
    for k, side in reversed(list(enumerate(sides))):
        parts[side] = (parts[side] - _round(key, tweak, k, parts[1 - side], sizes[side])) % sizes[side]
    out = []
    for i in range(len(digits) - 1, -1, -1):
        side = i >= half
        parts[side], d = divmod(parts[side], radices[i])
        out.append(d)
    return out[::-1]


def _alphabet(c: str, pronounceable: bool) -> str:
    if c in "0123456789":
        return "0123456789"
    if c.isascii() and c.isalpha():
        if pronounceable:
            small = VOWELS if c.lower() in VOWELS else CONSONANTS
            return small if c.islower() else small.upper()
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if c.isalpha():  # of the same script, case and block of 32
        start, kind, script = ord(c) & ~31, unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
        return "".join(x for x in map(chr, range(start, start + 32)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script)
    return ""


def reformat(key: bytes, kind: str, text: str, pronounceable: bool = False, alphabet: str | None = None, loose: bool = False) -> str:
    """text with its letters and digits permuted within their classes; all else stays, and belongs to the value unless loose."""
    sets = [(alphabet if alphabet and c in alphabet else _alphabet(c, pronounceable)) for c in text]
    where = [i for i, s in enumerate(sets) if len(s) > 1]
    frame = "".join(sets[i][0] if len(sets[i]) > 1 else c for i, c in enumerate(text) if not loose or len(sets[i]) > 1)
    moved = permute(key, f"{kind}|{frame}", [sets[i].index(text[i]) for i in where], [len(sets[i]) for i in where])
    out = list(text)
    for i, d in zip(where, moved, strict=True):
        out[i] = sets[i][d]
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def card(key: bytes, text: str) -> str:
    """All digits but the last are permuted; the last keeps the Luhn remainder, so valid numbers stay valid."""
    last = max(i for i, c in enumerate(text) if c.isdigit())
    head = reformat(key, "card", text[:last], loose=True)
    residue = _luhn([int(c) for c in text if c.isdigit()])
    body = [int(c) for c in head if c.isdigit()]
    return head + next(str(d) for d in range(10) if _luhn([*body, d]) == residue) + text[last + 1 :]


def ip(key: bytes, text: str) -> str:
    """Version 4 by octets, each as wide as it was where zeros led it; version 6 by groups."""
    if ":" in text:
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        made = ":".join(f"{g:x}" for g in permute(key, "ip6", groups, [65536] * 8))
        return made.upper() if text != text.lower() else made
    octets = text.split(".")
    moved = permute(key, "ip", [int(o) for o in octets], [256] * 4)
    return ".".join(str(v).zfill(len(o) if len(o) > 1 and o[0] == "0" else 1) for o, v in zip(octets, moved, strict=True))


def _remainder(country: str, body: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def iban(key: bytes, text: str) -> str:
    """The country stays; a valid number gets a valid one, any other an invalid one."""
    country, check, body = text[:2], text[2:4], text[4:]
    plain = body.replace(" ", "")
    if _remainder(country, plain, check) == 1 and "02" <= check <= "98":
        moved = reformat(key, "iban" + country, body, loose=True)
        return f"{country}{98 - _remainder(country, moved.replace(' ', ''), '00'):02d}{moved}"
    made = text[2:]
    while True:  # cycle-walking keeps it a permutation of the invalid ones
        made = reformat(key, "iban-" + country, made, loose=True)
        digits = made.replace(" ", "")
        if not (_remainder(country, digits[2:], digits[:2]) == 1 and "02" <= digits[:2] <= "98"):
            return country + made


#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d+")


def phone(key: bytes, text: str) -> str:
    """The country code stays; a number without one is American.  Only digits tell numbers apart."""
    digits = [i for i, c in enumerate(text) if c.isdigit()]
    code = COUNTRY.match("".join(text[i] for i in digits))[0] if text[0] == "+" else ""
    at = digits[len(code)] if len(code) < len(digits) else len(text)
    return text[:at] + reformat(key, f"phone{code or 1}", text[at:], loose=True)


def email(key: bytes, text: str) -> str:
    """Local part and domain are permuted apart, so that addresses of a domain keep sharing one; the ending stays.

    An address in other case is the same one: its surrogate differs in case alone."""
    local, _, domain = text.lower().rpartition("@")
    names, _, ending = domain.rpartition(".")
    made = f"{reformat(key, 'local', local, True)}@{reformat(key, 'domain', names, True)}.{ending}"
    return "".join(x.upper() if old.isupper() else x for x, old in zip(made, text, strict=True))


def _shifted(key: bytes, tweak: str, pool: tuple[str, ...], value: str) -> str:
    return pool[(pool.index(value) + 1 + _round(key, tweak, 0, len(pool), len(pool) - 1)) % len(pool)]


def name(key: bytes, text: str) -> str:
    """Each word alone, so that a name's parts stay coreferent; listed names go to names of the same list, others to no listed one."""
    out = []
    for word in text.split(" "):
        pool = next((p for p in (FEMALE, MALE, FAMILY) if word in p), None)
        if pool:
            out.append(_shifted(key, pool[0], pool, word))
            continue
        other = reformat(key, "name", word, True)
        while other in FEMALE or other in MALE or other in FAMILY:  # cycle-walking keeps the permutation one of unlisted names
            other = reformat(key, "name", other, True)
        out.append(other)
    return " ".join(out)


def surrogate(key: bytes, kind: str, text: str) -> str:
    if kind in ("card", "ip", "phone", "email", "name", "iban"):
        return {"card": card, "ip": ip, "phone": phone, "email": email, "name": name, "iban": iban}[kind](key, text)
    if kind == "secret":
        m = re.match(r"(?:sk|pk|ghp|gho|xox[bp])[-_]|AKIA", text)
        if not m:  # hexadecimal, in either case
            made = reformat(key, kind, text.lower(), alphabet="0123456789abcdef")
            return made.upper() if text.isupper() else made
        return m[0] + reformat(key, kind + m[0], text[len(m[0]) :])
    return reformat(key, kind, text)


def _version_6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def _names(text: str):
    """Where names stand, by title, given name, cue, address, or in Han script."""
    if NAME_HINT.search(text):
        for m in NAME.finditer(text):
            yield m.span("titled" if m["titled"] else "full")
    for m in CAPITALS.finditer(text):
        a, b = m.span()
        if a and text[a - 1].isalnum() or not text[a].isupper():
            continue
        head, _, rest = m[0].partition(" ")
        if head.lower() in CUES:
            if " " in rest:
                yield a + len(head) + 1, b
            continue
        if b < len(text) and ADDRESS.match(text, b):
            yield a, b
            continue
        before = text[max(0, a - LONGEST_CUE) : a]
        if before and before[-1].isspace() and before.rstrip().lower().endswith(CUES):
            lead = before.rstrip().lower()
            cue = next(c for c in CUES if lead.endswith(c))
            if len(lead) == len(cue) or not lead[-len(cue) - 1].isalpha():
                yield a, b
    if not text.isascii() and HAN.search(text):
        for m in HAN_NAME.finditer(text):
            yield m.span("han" if m["han"] else "labelled")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in order, without overlaps."""
    found = []
    if COLONS.search(text):
        found = [(m.start(), m.end(), "ip") for m in VERSION_6.finditer(text) if _version_6(m[0])]
    apart = lambda a, b, others: not any(a < y and x < b for x, y, _ in others)
    if re.search(r"\d", text) or "@" in text or "-" in text or "_" in text:
        before = list(found)
        found += [(m.start(), m.end(), m.lastgroup) for m in STRUCTURED.finditer(text) if not before or apart(m.start(), m.end(), before)]
    names = []
    for a, b in _names(text):
        if apart(a, b, found) and apart(a, b, names):
            names.append((a, b, "name"))
    if names:
        found += names
        found += mentions(text, found)
    return sorted(found)


def mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where words of a detected name stand alone later in the text."""
    first: dict[str, int] = {}
    for a, b, kind in found:
        if kind == "name":
            for word in re.split(r"\s", text[a:b]):
                first[word] = min(b, first.get(word, b))
    if not first:
        return []
    spaced = [w for w in first if not HAN.match(w)]
    kinds = [rf"(?<![\w'-])(?:{'|'.join(map(re.escape, sorted(spaced, key=len, reverse=True)))})(?![\w-]|'(?!s\b))"] if spaced else []
    kinds += [re.escape(w) for w in sorted(first.keys() - set(spaced), key=len, reverse=True)]  # no blanks stand around these
    words = re.compile("|".join(kinds))
    taken = sorted(found)
    starts = [a for a, _, _ in taken]
    out = []
    for m in words.finditer(text):
        k = bisect.bisect_left(starts, m.end()) - 1
        if m.start() >= first[m[0]] and (k < 0 or taken[k][1] <= m.start()):
            out.append((m.start(), m.end(), "name"))
    return out


def canonical(kind: str, text: str) -> str:
    """What two ways of writing one entity have in common."""
    if kind in ("card", "phone"):
        digits = "".join(c for c in text if c.isdigit())
        return digits if kind == "card" or text[0] == "+" else "1" + digits
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ipaddress.IPv6Address(text).exploded if ":" in text else ".".join(str(int(o)) for o in text.split("."))
    return text.lower() if kind == "email" or kind == "secret" and re.fullmatch("[0-9A-Fa-f]+", text) else text


def replaced(key: bytes, text: str, memory: dict[tuple[str, str], str]) -> tuple[str, list[tuple[str, str, str]]]:
    out, at, done = [], 0, []
    for a, b, kind in entities(text):
        old = text[a:b]
        new = memory.get((kind, old))
        if new is None:
            if len(memory) > 50_000:
                memory.clear()
            new = memory[kind, old] = surrogate(key, kind, old)
        out += [text[at:a], new]
        at = b
        done.append((kind, old, new))
    return "".join([*out, text[at:]]), done


def anonymise(docs: DataFrame, key: str, carry: list[str], with_entities: bool = False) -> DataFrame:
    """Columns carry of docs with safe_text, n_entities and a count of each kind; inputs named like an output are replaced.

    with_entities adds entities, of (kind, original, surrogate); it holds the originals, for checks only."""
    ship(docs.sparkSession)
    outputs = ["safe_text", "n_entities", *(f"n_{k}" for k in KINDS)]
    kept = [f for f in docs.schema.fields if f.name in carry and f.name not in [*outputs, "entities"]]
    record = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "original", "surrogate")]))
    schema = T.StructType([*kept, T.StructField("safe_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in outputs[1:]), *([T.StructField("entities", record)] if with_entities else [])])
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def run(batches):
        memory: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, found = [], []
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                new, done = (None, []) if text is None else replaced(secret, text, memory)
                texts.append(new)
                found.append(done)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(texts, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            columns += [pa.array([sum(e[0] == k for e in x) for x in found], pa.int64()) for k in KINDS]
            if with_entities:
                columns.append(pa.array([[dict(zip(("kind", "original", "surrogate"), e, strict=True)) for e in x] for x in found], pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "original", "surrogate")]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f.name) for f in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def collisions(anonymised: DataFrame) -> DataFrame:
    """From anonymise(with_entities=True): surrogates that stand for two entities of a kind, or entities with two surrogates; none is right.

    Formats don't count, and values are told by digests."""
    same = F.udf(lambda kind, text: hashlib.blake2b(canonical(kind, text).encode(), digest_size=16).hexdigest())
    e = anonymised.select(F.explode("entities").alias("e")).distinct()
    pairs = e.select(F.col("e.kind"), same("e.kind", "e.original").alias("original"), same("e.kind", "e.surrogate").alias("surrogate")).distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", F.lit("shared").alias("fault"))
    split = pairs.groupBy("kind", "original").agg(F.count("*").alias("n")).where("n > 1").select("kind", F.col("original").alias("surrogate"), F.lit("split").alias("fault"))
    return shared.unionByName(split)
