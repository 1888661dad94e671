"""Personal data: detected entities get keyed replacements of their own type and format.

Replacements come from keyed permutations, so nothing about other documents is needed: on each
domain (a type and a format, say "16 digits" or "2 digits @ 4 letters 1 digit .example.com")
a Feistel network P gives the map x -> P^-1(P(x) + 1). It is one cycle through the whole domain:
no entity keeps its value, different entities get different replacements, and the same entity
gets the same one in every document and partition. Digits stay digits (of their script), letters of
any script stay letters of their alphabet and case, and punctuation stays; country codes, reserved
and top-level domains and the kind of an address (private or public) are kept; check digits of
cards and IBANs are made anew, so what was valid stays valid. Known first names map to first names of
the same gender and script; other names letter by letter, vowels to vowels, never
to a listed name. A person's words are mapped one by one, so "Mr. Weber" and "Anna Weber" still agree.

A name is two capitalised words inside a sentence, or what follows a title, a listed first name or
words that introduce a person; in scripts without capitals it needs such a word before it or an
honorific behind it. A surname found so is also replaced where it stands alone in that text.
Places and firms of two words look alike and are replaced too, but for words of a short list.
Dates count only after words for birth, and street names only beside a house number.

A check in each task counts replacements that two entities share; collisions() does so
for a whole table. Null texts stay null, empty ones empty. Repeated rows give repeated results,
an empty table an empty one; other columns pass through replace() unchanged, but for those that
have the name of a count that is asked for, which the count replaces.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles and the gender they tell, and common first names by script and gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Doña": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f"}
FIRST_NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Klaus Jürgen Stefan Pierre Jean Jacques Antoine Carlos José Luis Miguel".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Emily Anna Ursula Monika Sabine Claire Sophie Camille Juliette María Carmen Lucía Elena".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Николай Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
}
LISTED = {n: k for k, names in FIRST_NAMES.items() for n in names}
#: Words before a person's name. Those with * need two words behind them.
CUES = ["my name is", "Name:", "name:", "Contact:", "contact:", "signed by", "Regards,", "regards,", "Sincerely,", "I am*", "I'm*", "this is*", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "ich bin*", "je m'appelle", "Je m'appelle", "je suis*", "me llamo", "Me llamo", "mi nombre es", "soy*", "меня зовут", "με λένε", "我叫", "我是", "اسمي"]
#: Capitalised words that don't make a name of two words.
NO_NAMES = set("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag North South East West New San Santa Saint Los Las United States Kingdom Republic University Institute Company Inc Ltd GmbH License Licence Copyright Software Foundation Public General Version Street Road Avenue Lane Drive Square The This That These Those And Or But If In On At Of For To From By With As It We You He She They I A An Der Die Das Und Ein Eine Le La Les Un Une El Los Una Apache Creative Commons Open Source Internet Protocol Language".split())
ALPHABETS = {"vowel": "aeiou", "consonant": "bcdfghjklmnpqrstvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "accented": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _alphabet(c: str) -> str:
    """The letters beside c: those of its 128 code points that are of its case."""
    block = ord(c) & ~0x7F
    name = f"{block:x}{'lower' if c.lower() == c else 'upper'}"
    if name not in ALPHABETS:
        ALPHABETS[name] = "".join(x for x in map(chr, range(block, block + 128)) if x.isalpha() and (x.lower() == x) == (c.lower() == c) and len(x.lower()) == 1)
    return name


class Permutation:
    """A keyed map of 0..n-1 onto itself that is a single cycle."""

    ROUNDS = 6

    def __init__(self, key: bytes, domain: str, n: int):
        self.key, self.n = hashlib.blake2b(domain.encode(), key=key, digest_size=32).digest(), n
        self.a = max(1, int(n**0.5)) if n < 1 << 50 else 1 << (n.bit_length() + 1) // 2
        self.b = -(-n // self.a)

    def _f(self, i: int, x: int, m: int) -> int:
        size = (m.bit_length() + 7) // 8 + 8
        data = i.to_bytes(1, "big") + x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "big") % m

    def _go(self, x: int, way: int) -> int:
        a, b = self.a, self.b
        while True:
            left, right = divmod(x, b)
            for i in range(self.ROUNDS) if way > 0 else range(self.ROUNDS - 1, -1, -1):
                if i % 2:
                    right = (right + way * self._f(i, left, b)) % b
                else:
                    left = (left + way * self._f(i, right, a)) % a
            x = left * b + right
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        return self._go((self._go(x, 1) + 1) % self.n, -1)


def _classes(text: str, sets: tuple[str, ...]) -> list[str | None]:
    out = []
    for c in text:
        low = c.lower()
        if c.isdigit() and unicodedata.decimal(c, None) is not None:
            out.append("digit")
        elif not c.isalpha():
            out.append(None)
        else:
            out.append(next((s for s in sets if low in (LETTERS if s == "letter" else ALPHABETS[s])), None) if len(low) == 1 else None)
            if out[-1] is None:
                out[-1] = _alphabet(c)
    return out


def _letters(kind: str) -> str:
    return LETTERS if kind == "letter" else ALPHABETS[kind]


class Surrogates:
    """Keyed replacements, remembered within a task."""

    REMEMBERED = 100_000

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()
        self.memo: dict[tuple[str, str], str] = {}
        self.taken: dict[tuple[str, str], tuple[str, str]] = {}
        self.collisions = 0

    def replace(self, kind: str, value: str) -> str:
        got = self.memo.get((kind, value))
        if got is None:
            if len(self.memo) >= self.REMEMBERED:
                self.memo.clear()
                self.taken.clear()
            got = self.memo[kind, value] = getattr(self, "_" + kind)(value)
            first = self.taken.setdefault((kind, identity(kind, got)), (kind, identity(kind, value)))
            self.collisions += first != (kind, identity(kind, value))
        return got

    def _pattern(self, domain: str, text: str, sets: tuple[str, ...] = ("letter", "cyrillic", "greek", "accented"), good=None) -> str:
        """The next text of the same pattern, in the order of the domain's permutation."""
        kinds = _classes(text, sets)
        bases = [10 if k == "digit" else len(_letters(k)) if k else 1 for k in kinds]
        n, x = 1, 0
        shape = "".join(c.lower() if k is None else k[0] if k in ("digit", "letter", *sets) else f"<{k}>" for c, k in zip(text, kinds))
        for c, k, base in zip(text, kinds, bases):
            n *= base
            if k and k != "digit":
                at = _letters(k).find(c.lower())
                at = at if at >= 0 else _letters(k).index(c)
            x = x * base + (0 if k is None else unicodedata.decimal(c) if k == "digit" else at)
        if n < 2:
            return text  # no letter or digit
        p = Permutation(self.key, f"{domain}|{shape}", n)
        while True:
            x = p.next(x)
            y, out = x, []
            for c, k, base in zip(text[::-1], kinds[::-1], bases[::-1]):
                y, v = divmod(y, base)
                if k is None:
                    out.append(c)
                elif k == "digit":
                    out.append(chr(ord(c) - unicodedata.decimal(c) + v))
                else:
                    letter = _letters(k)[v]
                    out.append(letter.upper() if c != c.lower() and len(letter.upper()) == 1 else letter)
            got = "".join(out[::-1])
            if good is None or good(got):
                return got

    def _digits(self, domain: str, value: str) -> str:
        """Digits of a value whose separators don't tell it apart."""
        digits = iter(self._pattern(domain, "".join(c for c in value if c.isdigit())))
        return "".join(next(digits) if c.isdigit() else c for c in value)

    def _email(self, value: str) -> str:
        at = value.index("@")
        labels = value[at + 1 :].split(".")
        keep = 2 if len(labels) > 2 and labels[-2].lower() == "example" else 1
        if labels[-2:-1] == ["example"] or labels[-2].lower() == "example":
            keep = 2
        tail = "." + ".".join(labels[-keep:])
        head = value[: -len(tail)] if len(labels) > keep else value[:at]
        tail = value[len(head) :]
        return self._pattern("email" + tail.lower(), head) + tail

    def _phone(self, value: str) -> str:
        m = re.match(r"\+\d{1,3}(?=[ (.-])", value)
        cc = m[0] if m else "0" if value[0] == "0" else ""
        return cc + self._digits("phone" + cc, value[len(cc) :])

    def _ip(self, value: str) -> str:
        if ":" in value:
            return self._ip6(value)
        parts = [int(p) for p in value.split(".")]
        kind = _address_kind(parts)
        p, x = Permutation(self.key, "ip", 1 << 32), int.from_bytes(bytes(parts), "big")
        while True:
            x = p.next(x)
            got = list(x.to_bytes(4, "big"))
            if _address_kind(got) == kind:
                return ".".join(map(str, got))

    def _ip6(self, value: str) -> str:
        """The first group stays, which tells the kind of an address."""
        whole = int(ipaddress.IPv6Address(value))
        first, rest = divmod(whole, 1 << 112)
        rest = Permutation(self.key, f"ip6 {first:x}", 1 << 112).next(rest)
        address = ipaddress.IPv6Address((first << 112) + rest)
        out = address.compressed if "::" in value else ":".join(f"{int(g, 16):x}" for g in address.exploded.split(":"))
        return out.upper() if value != value.lower() else out

    def _birth(self, value: str) -> str:
        """Another day of the years 1900 to 2029, written alike."""
        form, day = _date(value)
        start, n = dt.date(1900, 1, 1), 47_482
        if day is None or not 0 <= (day - start).days < n:
            return self._digits("birth", value)
        got = start + dt.timedelta(Permutation(self.key, "birth", n).next((day - start).days))
        return form.format(y=got.year, m=got.month, d=got.day)

    def _street(self, value: str) -> str:
        """House number and name; the word for the street stays."""
        return re.sub(r"\d+|[^\W\d_]+", lambda m: self._pattern("house", m[0]) if m[0].isdigit() else self._street_word(m[0]), value)

    def _street_word(self, word: str) -> str:
        tail = STREET_TAIL.search(word)
        if word.lower() in STREET_WORDS or word[0].islower():
            return word
        body = word[: tail.start()] if tail else word
        return self._pattern("street", body, ("vowel", "consonant", "cyrillic", "greek", "accented")) + word[len(body) :] if body else word

    def _number(self, value: str) -> str:
        digits = "".join(c for c in value if c.isdigit())
        if len(digits) < 12 or not digits.isascii():
            return self._digits("number", value)
        body = self._pattern("number", digits[:-1])
        last = (int(digits[-1]) - _luhn(digits[:-1]) + _luhn(body)) % 10
        new = iter(body + str(last))
        return "".join(next(new) if c.isdigit() else c for c in value)

    def _secret(self, value: str) -> str:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
            p = Permutation(self.key, f"hex{len(value)}", 16 ** len(value))
            got = f"{p.next(int(value, 16)):0{len(value)}x}"
            return got.upper() if value != value.lower() else got
        m = re.match(r"(?:AKIA|sk-|ghp_|xox[bp]-)?", value)
        return m[0] + self._pattern("secret" + m[0], value[m.end() :])

    def _iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        if _iban_rest(plain) == 1:
            body = self._pattern("iban" + plain[:2], plain[4:])
            made = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
        else:  # stays invalid, so it can't meet the replacement of a valid one
            made = plain[:2] + self._pattern("not iban" + plain[:2], plain[2:], good=lambda x: _iban_rest(plain[:2] + x) != 1)
        new = iter(made)
        return "".join(c if c == " " else next(new) for c in value)

    def _name(self, value: str) -> str:
        return re.sub(r"[^\W\d_]+", lambda m: self._name_word(m[0]), value)

    def _name_word(self, word: str) -> str:
        listed = LISTED.get(word)
        if listed:
            names = FIRST_NAMES[listed]
            return names[Permutation(self.key, "first" + "".join(listed), len(names)).next(names.index(word))]
        return self._pattern("name", word, ("vowel", "consonant", "cyrillic", "greek", "accented"), lambda x: x not in LISTED)


def _iban_rest(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


DATES = [
    (re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"), (1, 3, 4)),
    (re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})"), (4, 3, 1)),
]


def _date(value: str) -> tuple[str, dt.date | None]:
    """How a date is written, and the day; day before month where the year is last."""
    for pattern, (y, m, d) in DATES:
        if hit := pattern.fullmatch(value):
            form = value
            for at, name in sorted([(y, "y"), (m, "m"), (d, "d")], key=lambda x: -hit.start(x[0])):
                width = len(hit[at])
                form = form[: hit.start(at)] + "{" + name + (f":0{width}d" if width > 1 else "") + "}" + form[hit.end(at) :]
            try:
                return form, dt.date(int(hit[y]), int(hit[m]), int(hit[d]))
            except ValueError:
                return form, None
    return value, None


def _luhn(body: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in body[::-1]))
    return -total % 10


def _address_kind(p: list[int]) -> str:
    if p[0] in (0, 10, 127) or p[0] >= 224:
        return str(min(p[0], 224))
    if p[:2] == [192, 168] or (p[0] == 172 and 16 <= p[1] < 32) or p[:2] == [169, 254]:
        return ".".join(map(str, p[: 2 if p[0] != 172 else 1]))
    return "public"


def identity(kind: str, value: str) -> str:
    """What two mentions of one entity share."""
    if kind in ("phone", "number"):
        m = re.match(r"\+\d{1,3}(?=[ (.-])", value) if kind == "phone" else None
        return (m[0] + "|" if m else "") + "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "birth":
        return str(_date(value)[1] or value)
    return value.lower() if kind in ("email", "ip") else value


EMAIL_TAIL = re.compile(r"@[^\W_](?:[\w-]*[^\W_])?(?:\.[\w-]*[^\W_])+")
IBAN = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
NATIONAL = r"0\d{1,4}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,3}(?![\w-])|0\d(?:[ .]\d{2}){4}(?!\w)"
TRIES = [
    ("iban", re.compile(IBAN)),
    ("ip", re.compile(r"(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|\(\d{3}\) ?\d{3}-\d{4}(?!\w)|\d{3}[-.]\d{3}[-.]\d{4}(?!\w)|" + NATIONAL)),
    ("number", re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])|\d{4}(?:[ -]\d{4}){3}(?!\w)|\d{9,19}(?!\w)")),
    ("secret", re.compile(r"(?:AKIA[0-9A-Z]{16}|(?:sk-|ghp_|xox[bp]-)[A-Za-z0-9-]{16,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)")),
]
IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
BIRTH = re.compile(r"(?i:born(?: on)?|date of birth:?|dob:?|geboren(?: am)?|geburtsdatum:?|née? le|naciste el|nacid[oa] el|родил(?:ся|ась)) +(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4})(?!\w)")
#: Words for a street.
STREET_WORDS = set("street st road rd avenue ave lane ln drive dr boulevard blvd court ct rue place allée calle avenida plaza".split())
STREET_TAIL = re.compile(r"(?:straße|strasse|weg|platz|gasse|allee)$")
STREET = re.compile(r"(?<!\w)(?:\d{1,5}[a-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct)|\d{1,4},? (?:rue|avenue|boulevard|place|allée) (?:(?:de|du|des|la|le|les|l'|d') ?)*[A-ZÉ][\w-]+|(?:Calle|Avenida|Plaza) (?:(?:de|del|la|el) )*[A-ZÁÉÍÓÚ][\w-]+,? \d{1,4}|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|gasse|allee) \d{1,4}[a-z]?)(?!\w)")
DIGIT = re.compile(r"\d")
CAPITAL = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
AFTER_TITLE = re.compile(rf"\.? ({CAPITAL}(?: {CAPITAL})?)")
AFTER_FIRST = re.compile(rf" {CAPITAL}")
AFTER_CUE = re.compile(rf"\s*({CAPITAL}(?: {CAPITAL}){{0,2}})")
#: Two or three capitalised words behind a word in small letters.
UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]"
SHAPE = re.compile(rf"(?<=[a-zß-ÿа-яα-ω,;] ){UPPER}[^\W\d_A-ZÀ-ÖØ-Þ]+(?:-{UPPER}[^\W\d_]+)?(?: {UPPER}\.)?(?: {UPPER}[^\W\d_]+(?:-{UPPER}[^\W\d_]+)?){{1,2}}(?!\w)(?! {UPPER})")
WORD = re.compile(rf"{CAPITAL}")
HONORED = re.compile(r"([\u4e00-\u9fff]{2,4})(?=先生|女士|小姐)|([\u3040-\u30ff\u4e00-\u9fff]{2,6})(?=さん|様)")
_automaton: list = []


def _names():
    if not _automaton:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word in [*TITLES, *LISTED, *CUES]:
            a.add_word(word.rstrip("*"), word)
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def _before(text: str, at: int, more: str) -> int:
    """Where the run of letters, digits and characters of more that ends at a place begins."""
    while at and (text[at - 1].isalnum() or text[at - 1] in more):
        at -= 1
    return at


def _found_names(text: str) -> list[tuple[int, int, str]]:
    found = []
    for end, entry in _names().iter(text):
        word = entry.rstrip("*")
        s = end - len(word) + 1
        wide = word[0] < "\u0600"  # scripts that part words by spaces
        if wide and s and (text[s - 1].isalnum() or text[s - 1] == "_"):
            continue
        if wide and word[-1].isalnum() and text[end + 1 : end + 2].isalnum():
            continue
        if entry in TITLES:
            m = AFTER_TITLE.match(text, end + 1)
            if m:
                found.append((m.start(1), m.end(1), "name"))
        elif entry in LISTED:
            if m := AFTER_FIRST.match(text, end + 1):
                found.append((s, m.end(), "name"))
        elif m := AFTER_CUE.match(text, end + 1):
            if entry == word or " " in m[1]:
                stop = m.end(1) if wide else min(m.end(1), m.start(1) + 4)
                found.append((m.start(1), stop, "name"))
    for m in SHAPE.finditer(text):
        words = m[0].split()
        if len(set(words)) == len(words) and words[0] not in TITLES and not NO_NAMES.intersection(words):
            found.append((m.start(), m.end(), "name"))
    for m in HONORED.finditer(text):
        found.append((m.start(), m.end(), "name"))
    last = {text[s:e].rsplit(" ", 1)[-1] for s, e, _ in found if " " in text[s:e]}
    if last:
        found += [(m.start(), m.end(), "name") for m in WORD.finditer(text) if m[0] in last and not text[m.end() : m.end() + 1].isalnum() and not (m.start() and text[m.start() - 1].isalnum())]
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps."""
    found = []
    at = text.find("@")
    while at >= 0:
        tail = EMAIL_TAIL.match(text, at)
        if tail and (begin := _before(text, at, "._%+-")) < at:
            found.append((begin, tail.end(), "email"))
        at = text.find("@", at + 1)
    done, run_end = -1, -1
    for m in DIGIT.finditer(text):
        p = m.start()
        if p < done:
            continue
        if p >= run_end or run_start > p:
            run_start = _before(text, p, "_-")
            run_start -= run_start > 0 and text[run_start - 1] in "+("
        s = run_start
        run_end = p + 1
        while run_end < len(text) and (text[run_end].isalnum() or text[run_end] in "_-"):
            run_end += 1
        starts = {s, p} if s >= p - 1 else {s}
        for begin in sorted(starts):
            if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                continue
            hit = next(((k, x) for k, r in TRIES if (x := r.match(text, begin)) and x.end() > p and (k != "ip" or (text[begin - 1 : begin] != "." and all(int(o) < 256 for o in x[0].split("."))))), None)
            if hit:
                found.append((begin, hit[1].end(), hit[0]))
                done = hit[1].end()
                break
        else:
            n = p + 1
            while n < len(text) and text[n].isalnum():
                n += 1
            done = n if text[p:n].isdigit() or s < p - 1 else p + 1
    if "::" in text or text.count(":") >= 7:
        for m in IP6.finditer(text):
            if sum(c != ":" for c in m[0]) > 2 and _is_ip6(m[0]):
                found.append((m.start(), m.end(), "ip"))
    found += [(m.start(1), m.end(1), "birth") for m in BIRTH.finditer(text)] if BIRTH_HINT.search(text) else []
    found += [(m.start(), m.end(), "street") for m in STREET.finditer(text)] if STREET_HINT.search(text) else []
    found += _found_names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for f in found:
        if f[0] >= last:
            out.append(f)
            last = f[1]
    return out


def _is_ip6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


BIRTH_HINT = re.compile(r"(?i:born|birth|dob|gebor|geburt|né|nac|роди)")
STREET_HINT = re.compile(r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|rue|avenue|boulevard|place|allée|Calle|Avenida|Plaza|straße|strasse|weg|platz|gasse|allee)(?!\w)")
KINDS = ("email", "phone", "ip", "number", "secret", "iban", "name", "birth", "street")
_held: dict[str, Surrogates] = {}


def replace(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with entities replaced; with counts, also n_entities, n_collisions and a count of each kind."""
    extra = ["n_entities", "n_collisions", *[f"n_{k}" for k in KINDS]] if counts else []
    docs = docs.drop(*[c for c in extra if c in docs.columns])
    names = docs.columns

    def run(batches):
        for pdf in batches:
            made = _held.setdefault(key, Surrogates(key))
            texts, rows = [], []
            for t in pdf[text_col]:
                if not t:
                    texts.append(t)
                    rows.append([0] * (2 + len(KINDS)))
                    continue
                spans, before, out, last = find(t), made.collisions, [], 0
                for s, e, kind in spans:
                    out += [t[last:s], made.replace(kind, t[s:e])]
                    last = e
                out.append(t[last:])
                texts.append("".join(out))
                rows.append([len(spans), made.collisions - before, *[sum(k == x for _, _, x in spans) for k in KINDS]])
            pdf = pdf.assign(**{text_col: pd.Series(texts, index=pdf.index, dtype=object)})
            for i, c in enumerate(extra):
                pdf[c] = [r[i] for r in rows]
            yield pdf

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} int" for c in extra])
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInPandas(run, schema)


def entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, kind, value, surrogate of every mention."""

    def run(batches):
        for pdf in batches:
            made = _held.setdefault(key, Surrogates(key))
            rows = [(i, k, t[s:e], made.replace(k, t[s:e])) for i, t in zip(pdf["doc_id"], pdf["text"]) if t for s, e, k in find(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value", "surrogate"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, kind string, value string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for several different values: none, unless identities were joined on purpose."""
    plain = F.lower(F.regexp_replace("value", r"(?<=\d)[ ().-]+(?=\d)", ""))
    return found.groupBy("kind", F.lower(F.regexp_replace("surrogate", r"(?<=\d)[ ().-]+(?=\d)", "")).alias("surrogate")).agg(F.countDistinct(plain).alias("values")).where("values > 1")
