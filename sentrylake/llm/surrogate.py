r"""PII surrogates: every detected entity gets a keyed replacement of its own type, format, script and gender.

An entity is normalised (e-mail: lower case; numbers: digits; names: single lower-case parts) and its surrogate drawn from
HMAC-SHA256 of key, type, normal form and attempt: digits for digits, letters of the same case and script for letters.
Cards keep their first digit and whether the check digit holds, IBANs their country and whether theirs does, phones their
country code, secrets their known prefix, e-mails their top-level domain, IPv6 addresses their first group. The surrogate
is then written in the occurrence's own format, so two spellings of one entity stay one entity: coreference holds over
the whole corpus.

A name is led by a title and falls into given names, drawn to end as the title's gender does, and a family name; each
part is an entity, so a family keeps one name under all its titles. After a neutral title a given name takes the
gender that it has elsewhere in its document. Where a document has a titled name, its capitalised parts are replaced
wherever else they stand in that document as well. Initials are moved by a keyed step, which keeps them distinct.

The distinct entities of all documents are checked in a table, by what is printed: surrogates that two entities share, or
that some entity really has, are drawn again with the next attempt until none is left. From the eighth attempt on, a
format too small for its entities gets longer with every attempt, so that this always ends: names by syllables, secrets,
passwords and e-mails by characters, numbers and addresses by an ``x`` and digits behind them. Only entities with
a later attempt must be looked up; up to ``most_listed`` of them travel with the tasks, more are joined to their documents.

Detection takes time in proportion to a text's length: every pattern can start at a run's first character only, or looks at
a bounded number of characters.

Defined results: null text stays null with no entities, empty text stays empty; overlapping matches resolve to the one
that starts first, then to the order of ``KINDS``; equal rows get equal results; all columns pass through, ``n_entities``
is replaced if present; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch

#: titles by gender, and small words inside family names; fixed values
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа", "Госпожа"],
    "n": ["Dr", "Prof"],
}
PARTICLES = ["van", "von", "de", "der", "den", "del", "di", "da", "la", "le", "du", "dos", "al", "bin"]
#: words that lead a password, and what secrets start with; fixed values
KEYWORDS = ["password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-"]
#: country calling codes of one and of two digits; all others have three; fixed values
CALLING = [1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98]

_TITLE = "|".join(t for names in TITLES.values() for t in names)
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)})[ \u00a0])"
_UPPER = r"[^\W\d_a-zß-öø-ÿа-яёα-ω]"
_PART = rf"(?!(?:{_TITLE})(?!\w))(?:{_UPPER}(?:[^\W\d_]|['’](?={_UPPER}))++|{_UPPER}\.)"
_MAIL = r"A-Za-z0-9À-ɏͰ-ϿЀ-ӿ"
KINDS = {
    "email": rf"(?<![{_MAIL}._%+-])[{_MAIL}._%+-]++@[{_MAIL}-]+(?:\.[{_MAIL}-]+)*\.[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]{{2,}}",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "password": r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s*+[=:]\s*+[\"']?)[^\s\"'#,;]{4,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,36}:)[0-9A-Fa-f:]{3,39}(?![\w:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+])(?<![0-9][-. ])[2-6](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?<![0-9][-.])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![0-9])|\+[0-9]{8,15}(?![0-9]))",
    "name": rf"(?<!\w)(?:{_TITLE})\.?[ \u00a0]{{1,4}}{_SMALL}{{0,3}}{_PART}(?:[ \u00a0-]{_SMALL}{{0,3}}{_PART}){{0,3}}",
}
#: what a text must have for a kind to occur in it
NEEDS_DIGIT = ("iban", "ip", "ipv6", "ssn", "card", "phone")
DIGIT = re.compile("[0-9]")
BARE = re.compile(r"(?<!\w)[^\W\d_]++(?!\w)")
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
NUMBERS = ("phone", "card", "ssn", "iban")
#: attempts before a format gets longer
PATIENCE = 7


# ---------------------------------------------------------------- detection


@lru_cache(maxsize=None)
def pattern(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{KINDS[k]})" for k in kinds))


def possible(text: str) -> tuple[str, ...]:
    """The kinds that a text can have, by cheap looks at the whole text."""
    found = []
    if "@" in text:
        found.append("email")
    digit = bool(DIGIT.search(text))
    if digit or any(p in text for p in PREFIXES):
        found.append("secret")
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found.append("password")
    if digit:
        found += NEEDS_DIGIT
    if any(t in text for names in TITLES.values() for t in names):
        found.append("name")
    return tuple(found)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_check(country: str, account: str) -> int:
    """The two check digits (ISO 13616) of an account."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def address(text: str) -> str | None:
    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return None


def credible(kind: str, found: str) -> bool:
    """Checks that a pattern can't say."""
    if kind == "card":
        digits, groups = re.sub(r"\D", "", found), [len(g) for g in re.split("[ -]", found)]
        if len({c for c in found if c in " -"}) > 1:
            return False
        return luhn(digits) or groups in ([16], [15], [4, 4, 4, 4], [4, 6, 5])
    if kind == "phone":
        if found[0] in "+(":
            return True
        digits = re.sub(r"\D", "", found)
        return len(digits) >= 7 and not re.match(r"(?:19|20)[0-9]{2}[^0-9]", found)
    if kind == "iban":
        bare = found.replace(" ", "")
        return len(bare) >= 15 and (int(bare[2:4]) == iban_check(bare[:2], bare[4:]) or sum(c.isdigit() for c in bare[4:]) >= 6)
    if kind == "ipv6":
        return any(c.isdigit() for c in found) and found.count(":") >= 2 and address(found) is not None
    return True


def matches(text: str):
    """(start, end, kind) left to right; a match that isn't credible gives way to the other kinds at its place."""
    kinds = possible(text)
    if not kinds:
        return
    at, search = 0, pattern(kinds).search
    while m := search(text, at):
        kind, end, others = m.lastgroup, m.end(), kinds
        while kind and not credible(kind, text[m.start() : end]):
            others = tuple(k for k in others if k != kind)
            n = pattern(others).match(text, m.start()) if others else None
            kind, end = (n.lastgroup, n.end()) if n else (None, end)
        if kind:
            yield m.start(), end, kind
        at = end if kind else m.start() + 1


def gender(title: str) -> str:
    t = title.strip().rstrip(".")
    return next(g for g, names in TITLES.items() if t in names)


def name_parts(found: str) -> tuple[str, list[tuple[str, str]]]:
    """The gender of a titled name and its pieces: (what, text), where what is empty for text that stays."""
    lead = re.match(rf"(?:{_TITLE})\.?[ \u00a0]+", found)
    pieces = [("", lead[0])]
    words = re.split(r"([ \u00a0-])", found[lead.end() :])
    parts = [i for i in range(0, len(words), 2) if words[i] not in PARTICLES]
    # the last part is the family name, together with what a hyphen ties to it
    family = parts[-1]
    while family >= 2 and words[family - 1] == "-":
        family -= 2
    for i, w in enumerate(words):
        if i % 2 or i not in parts:
            pieces.append(("", w))
        else:
            pieces.append(("initial" if w.endswith(".") else "family" if i >= family else "given", w))
    return gender(lead[0]), pieces


def normal(kind: str, body: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if body.startswith("+") else "") + re.sub(r"\D", "", body)
    if kind == "iban":
        return body.replace(" ", "")
    if kind == "ipv6":
        return address(body)
    return body.lower() if kind in ("email", "family", "initial") else body


def entities(text: str | None):
    """(start, end, kind, pieces), left to right; a piece is (kind, normal form, text), with kind "" where the text stays."""
    if not text:
        return
    found = list(matches(text))
    if not any(kind == "name" for _, _, kind in found):
        for start, end, kind in found:
            body = text[start:end]
            lead = re.match(r"[^=:]*[=:]\s*[\"']?", body).end() if kind == "password" else 0
            yield start, end, kind, ([("", "", body[:lead])] if lead else []) + [(kind, normal(kind, body[lead:]), body[lead:])]
        return
    named = {start: name_parts(text[start:end]) for start, end, kind in found if kind == "name"}
    genders: dict[str, str] = {}
    for which, pieces in named.values():
        for what, body in pieces:
            if what == "given" and which != "n":
                genders.setdefault(body.lower(), which)
    known: dict[str, tuple[str, str]] = {}
    whole = {}
    for start, (which, pieces) in named.items():
        out = []
        for what, body in pieces:
            low = body.lower()
            norm = (which if which != "n" else genders.get(low, "n")) + low if what == "given" else low if what else ""
            out.append((what, norm, body))
            if what in ("given", "family") and len(low) > 1:
                known.setdefault(low, (what, norm))
        whole[start] = out
    bare = iter([(m.start(), m.end(), m[0]) for m in BARE.finditer(text) if not m[0].islower() and m[0].lower() in known])
    word = next(bare, None)
    for start, end, kind in [*found, (len(text), len(text), "")]:
        while word and word[0] < end or word and not kind:
            if word[1] <= start:
                what, norm = known[word[2].lower()]
                yield word[0], word[1], "name", [(what, norm, word[2])]
            word = next(bare, None)
        if not kind:
            return
        if kind == "name":
            yield start, end, kind, whole[start]
        else:
            body = text[start:end]
            lead = re.match(r"[^=:]*[=:]\s*[\"']?", body).end() if kind == "password" else 0
            yield start, end, kind, ([("", "", body[:lead])] if lead else []) + [(kind, normal(kind, body[lead:]), body[lead:])]


# ---------------------------------------------------------------- surrogates


class Draws:
    """A keyed stream of small numbers."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.pool = key, "\0".join(what), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, f"{self.what}\0{self.n}".encode(), hashlib.sha256).digest()
            self.n += 1
        out, self.pool = int.from_bytes(self.pool[:4], "big") % n, self.pool[4:]
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


def script_of(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def like(c: str, draws: Draws) -> str:
    if c in "0123456789":
        return str(draws.below(10))
    if c.isalpha():
        letters = LETTERS[script_of(c)]
        new = letters[draws.below(len(letters))]
        return new.upper() if c.isupper() else new
    return c


def person(part: str, which: str, draws: Draws, more: int) -> str:
    """Syllables; a given name ends as its gender's names do."""
    script = script_of(part[:1])
    vowels, others = VOWELS[script], [c for c in LETTERS[script] if c not in VOWELS[script] and c not in "qxwьъщы"]
    name = "".join(others[draws.below(len(others))] + vowels[draws.below(len(vowels))] for _ in range(2 + draws.below(2) + more))
    return name[:-1] + vowels[0] if which == "f" else name + others[draws.below(len(others))] if which == "m" else name


def calling_code(digits: str) -> int:
    """How many digits a country calling code has."""
    return next((n for n in (1, 2) if digits[:n].isdigit() and int(digits[:n]) in CALLING and digits[0] != "0"), 3)


def draw(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The surrogate of a normal form."""
    d, more = Draws(key, kind, norm, str(attempt)), max(0, attempt - PATIENCE)
    if kind == "given":
        return norm[0] + person(norm[1:], norm[0], d, more)
    if kind == "family":
        return person(norm, "n", d, more)
    if kind == "initial":
        letters = LETTERS[script_of(norm[0])]
        step = 1 + Draws(key, "initial").below(len(letters) - 1)
        return (letters[(letters.index(norm[0]) + step) % len(letters)] if norm[0] in letters else norm[0]) + norm[1:]
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        new = "".join(like(c, d) for c in local) + d.digits(more)
        return new + "@" + ".".join(["".join(like(c, d) for c in x) for x in labels[:-1]] + labels[-1:])
    if kind in ("secret", "password"):
        keep = next((len(p) for p in PREFIXES if norm.startswith(p)), 0)
        if not keep and re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", norm) and re.search(r"[a-fA-F]", norm):
            signs = "0123456789abcdef" if norm == norm.lower() else "0123456789ABCDEF"
            return "".join(signs[d.below(16)] for _ in range(len(norm) + more))
        return norm[:keep] + "".join(like(c, d) for c in norm[keep:]) + d.digits(more)
    tail = "x" + d.digits(more) if more else ""
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4)) + tail
    if kind == "ipv6":
        return norm[:4] + "".join("0123456789abcdef"[d.below(16)] if c != ":" else c for c in norm[4:]) + tail
    if kind == "card":
        digits = norm[0] + d.digits(len(norm) - 2)
        last = [c for c in "0123456789" if luhn(digits + c) == luhn(norm)]
        return digits + last[d.below(len(last))] + tail
    if kind == "iban":
        account = "".join(like(c, d) for c in norm[4:])
        check = iban_check(norm[:2], account)
        if int(norm[2:4]) != iban_check(norm[:2], norm[4:]):
            check = 2 + (check - 2 + 1 + d.below(96)) % 97
        return f"{norm[:2]}{check:02d}{account}{tail}"
    keep = 1 + calling_code(norm[1:]) if norm.startswith("+") else 0
    # a leading zero of a number stays one, and no other number gets one
    lead = norm[keep : keep + 1]
    return norm[:keep] + (lead if lead in ("", "0") or kind == "ssn" else str(1 + d.below(9))) + d.digits(len(norm) - keep - len(lead)) + tail


def face(kind: str, form: str) -> str:
    """What is seen of an entity or a surrogate, whatever its format; distinctness is checked on it."""
    return form[1:] if kind == "given" else form.lstrip("+") if kind == "phone" else form


def written(kind: str, body: str, new: str) -> str:
    """The surrogate in the format of this occurrence."""
    if kind in NUMBERS:
        new, x, tail = new.lstrip("+").partition("x")
        signs = iter(new)
        return "".join(next(signs) if c.isalnum() else c for c in body) + x + tail
    if kind == "ipv6":
        new, x, tail = new.partition("x")
        short = new if len(body) == 39 else str(ipaddress.IPv6Address(new))
        return (short.upper() if body == body.upper() and body != body.lower() else short) + x + tail
    if kind == "email" and len(new) == len(body):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(body, new))
    if kind in ("given", "family"):
        new = face(kind, new)
        return new.upper() if len(body) > 1 and body.isupper() else new.capitalize()
    return new.upper() if kind == "initial" else new


def redraw(table: DataFrame, key: bytes) -> DataFrame:
    def work(batches):
        for b in batches:
            new = [draw(key, k, n, a) for k, n, a in zip(b.column("kind").to_pylist(), b.column("norm").to_pylist(), b.column("attempt").to_pylist())]
            seen = [(face(k, n), face(k, w)) for k, n, w in zip(b.column("kind").to_pylist(), b.column("norm").to_pylist(), new)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("norm"), b.column("attempt"), *(pa.array(list(c), pa.string()) for c in (zip(*seen) if seen else ([], [])))], ["kind", "norm", "attempt", "own", "new"])

    return table.select("kind", "norm", "attempt").mapInArrow(work, "kind string, norm string, attempt int, own string, new string")


def drawn(documents: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """kind, norm, attempt, own and new (the faces of an entity and its surrogate) of every distinct entity, free of collisions."""

    def detect(batches):
        for b in batches:
            seen = {(k, n) for text in b.column("text").to_pylist() for _, _, _, pieces in entities(text) for k, n, _ in pieces if k and k != "initial"}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.string())], ["kind", "norm"])

    first = documents.select("text").mapInArrow(detect, "kind string, norm string").distinct()
    table = scratch.write(redraw(first.withColumn("attempt", F.lit(0)), key), "entities")
    while True:  # formats grow with the attempts, so it ends
        shared = table.groupBy("new").agg(F.count("*").alias("n"), F.min(F.struct("kind", "norm")).alias("holder")).filter("n > 1").drop("n")
        clash = table.join(shared, "new").filter(F.struct("kind", "norm") != F.col("holder")).select("kind", "norm")
        real = table.join(table.select(F.col("own").alias("new")), "new", "left_semi").select("kind", "norm")
        again = scratch.write(clash.unionByName(real).distinct(), "collisions")
        if not again.limit(1).count():
            return table
        stay = table.join(again, ["kind", "norm"], "left_anti")
        moved = redraw(table.join(again, ["kind", "norm"], "left_semi").withColumn("attempt", (F.col("attempt") + 1).cast("int")), key)
        table = scratch.write(stay.unionByName(moved), "entities")


def replace_entities(documents: DataFrame, key: bytes, most_listed: int = 100_000) -> DataFrame:
    """``documents`` with surrogates in ``text`` and n_entities long."""
    scratch = Scratch(documents.sparkSession, "surrogate")
    rest = documents.drop("n_entities")
    late = drawn(rest, key, scratch).filter("attempt > 0").select("kind", "norm", "attempt")
    listed = late.limit(most_listed + 1).collect()
    attempts = {(r["kind"], r["norm"]): r["attempt"] for r in listed}
    names = rest.columns
    out = T.StructType([*rest.schema.fields, T.StructField("n_entities", T.LongType())])

    def rewrite(text, more):
        parts, last, n = [], 0, 0
        for start, end, _, pieces in entities(text):
            parts.append(text[last:start])
            parts += (written(k, body, draw(key, k, norm, more.get((k, norm), 0))) if k else body for k, norm, body in pieces)
            last, n = end, n + 1
        return ("".join(parts) + text[last:] if n else text), n

    def apply(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            own = b.column("_late").to_pylist() if "_late" in b.schema.names else None
            done = [rewrite(t, attempts if own is None else {(x["kind"], x["norm"]): x["attempt"] for x in own[i] or ()}) for i, t in enumerate(texts)]
            columns = [pa.array([t for t, _ in done], pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], [*names, "n_entities"])

    if len(listed) <= most_listed:
        return rest.mapInArrow(apply, out)
    attempts = {}

    def occurrences(batches):
        for b in batches:
            seen = {(t, k, n) for t, text in zip(b.column("_t").to_pylist(), b.column("text").to_pylist()) for _, _, _, pieces in entities(text) for k, n, _ in pieces if k}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.string()), pa.array([x[2] for x in seen], pa.string())], ["_t", "kind", "norm"])

    hashed = rest.withColumn("_t", F.xxhash64("text"))
    per = hashed.select("_t", "text").mapInArrow(occurrences, "_t long, kind string, norm string").distinct().join(late, ["kind", "norm"])
    per = per.groupBy("_t").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("_late"))
    return hashed.join(per, "_t", "left").select(*rest.columns, "_late").mapInArrow(apply, out)
