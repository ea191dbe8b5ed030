"""Personal data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import kept, lean

# First names by gender and script, and family names by script.
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Fiona Greta Hanna Helen Ines Irene Jane Julia Karen Laura Linda Lucia Maria Marta Mary Nadia Nina Olga Paula Rita Rosa Sarah Sofia Susan Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Andrew Anton Bruno Carl Daniel David Eric Felix Frank George Henry Hugo Ivan Jack James John Jose Juan Karl Leon Lucas Luis Martin Max Michael Oscar Otto Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Татьяна".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Дмитрий Иван Максим Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
FAMILY_NAMES = {
    "latin": "Adler Baker Becker Bauer Brown Carter Clark Cooper Davis Dubois Evans Fischer Fontaine Garcia Gomez Green Hansen Harris Hoffmann Hughes Jackson Johnson Keller Klein Lambert Lopez Martinez Meyer Miller Moore Moreau Morris Navarro Parker Perez Roberts Rossi Schmidt Schneider Smith Taylor Turner Vogel Wagner Walker Weber Wilson Wood".split(),
    "cyrillic": "Волков Зайцев Иванов Козлов Кузнецов Лебедев Морозов Новиков Павлов Петров Попов Смирнов Соколов".split(),
    "greek": "Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδόπουλος Πέτρου".split(),
}
ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST = {n: key for key, names in FIRST_NAMES.items() for n in names}
_FAMILY = {n: script for script, names in FAMILY_NAMES.items() for n in names}
_NAME = "|".join(sorted(map(re.escape, _FIRST), key=len, reverse=True))
_SURNAME = "|".join(sorted(map(re.escape, _FAMILY), key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "key": r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:sk|ghp|gho|xoxb)[-_][A-Za-z0-9]{16,64}(?!\w)",
    "secret": r"(?<=password=)[A-Za-z0-9]{6,64}(?!\w)|(?<=api_key=)[A-Za-z0-9]{6,64}(?!\w)|(?<=token=)[A-Za-z0-9]{6,64}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
FINDER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
NAMES = re.compile(rf"(?<!\w)(?:{_NAME}) (?:{_SURNAME})(?!\w)|(?<=\b(?:Mr|Ms|Dr) )(?:{_SURNAME})(?!\w)|(?<=\b(?:Mr|Ms|Dr)\. )(?:{_SURNAME})(?!\w)")
WORD = re.compile(r"[^\W\d_]+")
# Texts without any of these signs hold nothing that the patterns find.
DIGITS_HINT = re.compile(r"\d[\d .()-]{5}")
SIGNS = ("@", "AKIA", "ASIA", "sk-", "sk_", "ghp_", "gho_", "ghp-", "gho-", "xoxb", "password=", "api_key=", "token=")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


class Keyed:
    """Keyed permutations of numbers below a bound: distinct in, distinct out, the same everywhere."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, label: str, turn: int, half: int, size: int) -> int:
        data = f"{label}|{turn}|{half}".encode()
        need = -(-size.bit_length() // 8) + 8
        out = b"".join(hmac.digest(self.key, data + bytes([i]), "sha256") for i in range(-(-need // 32)))
        return int.from_bytes(out[:need], "big") % size

    def number(self, label: str, value: int, bound: int) -> int:
        """Where a Feistel network over the least square that covers the bound sends ``value``, walked until below it."""
        if bound < 2:
            return value
        side = 1
        while side * side < bound:
            side += max(1, int(bound**0.5) - side) if bound < 1 << 52 else max(1, (1 << (bound.bit_length() + 1) // 2) - side)
        while True:
            a, b = divmod(value, side)
            for turn in range(ROUNDS):
                a, b = b, (a + self._round(label, turn, b, side)) % side
            value = a * side + b
            if value < bound:
                return value

    def shaped(self, label: str, text: str) -> str:
        """Text with letters and digits permuted among those of the same shape; other signs stay."""
        sets = [next((s for s in (DIGITS, LOWER, UPPER) if c in s), c) for c in text]
        bound, value = 1, 0
        for c, s in zip(text, sets):
            bound, value = bound * len(s), value * len(s) + s.index(c)
        shape = "".join("0aA"[(DIGITS, LOWER, UPPER).index(s)] if len(s) > 1 else s for s in sets)
        value = self.number(f"{label}|{shape}", value, bound)
        out = []
        for s in reversed(sets):
            value, at = divmod(value, len(s))
            out.append(s[at])
        return "".join(reversed(out))


def _digits(keyed: Keyed, label: str, text: str, keep: int, last: int = 0) -> str:
    """Digits beyond the first ``keep`` and before the ``last`` permuted, separators in place."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    own = at[keep : len(at) - last]
    new = keyed.shaped(f"{label}|{''.join(text[i] for i in at[:keep])}", "".join(text[i] for i in own))
    out = list(text)
    for i, c in zip(own, new):
        out[i] = c
    return "".join(out)


def _email(keyed: Keyed, text: str) -> str:
    user, _, host = text.lower().partition("@")
    name, dot, top = host.rpartition(".")
    return f"{keyed.shaped('user|' + host, user)}@{keyed.shaped('host|' + top, name)}{dot}{top}"


def _card(keyed: Keyed, text: str) -> str:
    """The issuer's digit stays; the last digit is set so that the check holds, or fails, as before."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    old = "".join(text[i] for i in at)
    off = next(d for d in range(10) if luhn(old[:-1] + str((int(old[-1]) + d) % 10)))
    body = old[0] + keyed.shaped(f"card|{old[0]}", old[1:-1])
    check = next(d for d in range(10) if luhn(f"{body}{d}"))
    out = list(text)
    for i, c in zip(at, f"{body}{(check - off) % 10}"):
        out[i] = c
    return "".join(out)


def _iban(keyed: Keyed, text: str) -> str:
    """Country kept, account permuted, check digits right again (or as wrong as before)."""
    flat = text.replace(" ", "")
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    off = (int(flat[2:4]) - (98 - as_number(flat[4:] + flat[:2] + "00") % 97)) % 97
    body = keyed.shaped(f"iban|{flat[:2]}|{off}", flat[4:])
    check = (98 - as_number(body + flat[:2] + "00") % 97 + off) % 97
    new = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(keyed: Keyed, text: str) -> str:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    value = keyed.number("ip", value, 1 << 32)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _name(keyed: Keyed, text: str) -> str:
    """Each name goes to the next in a keyed order of those of its gender and script: never to itself."""
    out = []
    for part in text.split(" "):
        names = FIRST_NAMES[_FIRST[part]] if part in _FIRST else FAMILY_NAMES[_FAMILY[part]]
        order = sorted(names, key=lambda n: hmac.digest(keyed.key, f"name|{n}".encode(), "sha256"))
        out.append(order[(order.index(part) + 1) % len(order)])
    return " ".join(out)


MAKERS: dict[str, Callable[[Keyed, str], str]] = {
    "email": _email,
    "key": lambda k, t: t[:4] + k.shaped(f"key|{t[:4]}", t[4:]),
    "secret": lambda k, t: k.shaped("secret", t),
    "iban": _iban,
    "ssn": lambda k, t: _digits(k, "ssn", t, 0),
    "ip": _ip,
    "phone": lambda k, t: _digits(k, "phone", t, 1),
    "card": _card,
    "name": _name,
}


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of entities, from left to right, none overlapping.

    A name is a first and a family name, or a family name after a title; parts of it that stand alone
    elsewhere in the text count too.
    """
    found = []
    if any(s in text for s in SIGNS) or DIGITS_HINT.search(text):
        found = [(m.lastgroup, m.start(), m.end()) for m in FINDER.finditer(text)]
    if not _FAMILY.keys().isdisjoint(WORD.findall(text)):
        whole = {m.group() for m in NAMES.finditer(text)}
        parts = {p for w in whole for p in w.split(" ")}
        if whole:
            again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(whole | parts, key=lambda w: (-len(w), w))))})(?!\w)")
            taken = [(a, b) for _, a, b in found]
            named = [("name", m.start(), m.end()) for m in again.finditer(text)]
            found += [n for n in named if not any(n[1] < b and a < n[2] for a, b in taken)]
    return sorted(found, key=lambda f: f[1])


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """Text with surrogates, and (kind, entity, surrogate) in order."""
    keyed, out, done, made = Keyed(key), [], 0, []
    for kind, begin, end in find(text):
        new = MAKERS[kind](keyed, text[begin:end])
        out += [text[done:begin], new]
        made.append((kind, text[begin:end], new))
        done = end
    return "".join([*out, text[done:]]), made


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))


def with_surrogates(docs: DataFrame, key: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """``docs`` with ``text`` rewritten and a column of (kind, entity, surrogate) in order of place.

    Finds e-mail and network addresses, telephone, card, account and social security numbers, access
    keys, values of ``password=`` and the like, and names. A surrogate is a permutation, keyed with
    ``key``, of the values of the same format: digits and letters of the same case in the same places,
    country and issuer kept, check digits as right as before, names of the same gender and script. So
    one entity has one surrogate in all documents, and two never share one. ``collisions`` checks that.

    A null text stays null and an empty one empty, both without entities; rows may repeat. A column
    named ``entities`` is replaced; others stay as they are.
    """
    secret = key.encode()
    kept_columns = [c for c in docs.columns if c != entities]
    schema = docs.select(*kept_columns).schema
    out_schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{entities}` array<struct<kind:string,entity:string,surrogate:string>>"

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for value in batch.column(text).to_pylist():
                new, made = replace(value, secret) if value else (value, [])
                texts.append(new)
                found.append([dict(zip(("kind", "entity", "surrogate"), m)) for m in made])
            columns = [pa.array(texts, pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _FOUND)], names=[*batch.schema.names, entities])

    return docs.select(*kept_columns).mapInArrow(lean(rewritten), out_schema)


def collisions(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """``kind, surrogate, n_entities`` of surrogates that stand for two entities or more: none, ever.

    Entities are compared without separators and case where these don't tell them apart.
    """
    rows = replaced.select(F.explode(entities).alias("e")).select("e.kind", "e.entity", "e.surrogate").distinct()
    bare = lambda c: F.when(F.col("kind").isin("phone", "card", "iban"), F.regexp_replace(c, "[ .()-]", "")).when(F.col("kind") == "email", F.lower(c)).otherwise(F.col(c))
    distinct = rows.select("kind", bare("entity").alias("entity"), bare("surrogate").alias("surrogate")).distinct()
    return distinct.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities")).where("n_entities > 1")


def replace_private(docs: DataFrame, key: str, text: str = "text", entities: str = "entities") -> DataFrame:
    """``with_surrogates``, written once and checked: the job fails if two entities share a surrogate."""
    replaced = kept(with_surrogates(docs, key, text, entities), "surrogates", texts=True)
    clash = collisions(replaced, entities).first()
    if clash is not None:
        raise RuntimeError(f"{clash.n_entities} entities share a {clash.kind} surrogate; use another key")
    return replaced
