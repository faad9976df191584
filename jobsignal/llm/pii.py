"""PII surrogates: detected entities get keyed replacements of their own type, script, gender and format.

An entity is a type and a normalised value, so every mention of it, in any document and any format, gets the same
surrogate. Digits stay digits, letters keep case, separators stay, card numbers and IBANs keep right check digits,
addresses keep their parts. The values of one shape form a space, which a keyed permutation (a Feistel network walked
within the space) turns into one cycle; a value's surrogate is its next on the cycle, so surrogates of these types are
distinct by construction and never the value itself, however full the space. One that is itself an entity of the corpus
is drawn again with other permutations, checked against all others over the whole corpus, and stays as first drawn if
the space has no free value.

Personal names are told by a title, by words that introduce a name, or by a common given name before a capitalised word;
the name is the run of capitalised words, with initials and lower-case particles (``de la``, ``von``) between them, which
stay. In scripts without capitals it is the word after the title, and one more after a common given name, or before a
title that follows. They are replaced part by part in their own script, given names by names of the same gender. They have no shape to
permute, so they are drawn by BLAKE2b and, where two meet or one is an entity, drawn again from a space that grows with
every draw, so draws always end.

Defined results: null and empty texts have no entities and stay; repeated rows are replaced alike; overlapping mentions
go to the earliest, then the type listed first; an empty table gives an empty table. Other columns stay, whatever their
names; where one of them has the name of an added column, that gets more underscores in front.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns_of, dropped, fresh, pieces, plain_named, small_or_merge, written

# Titles by gender, words that introduce a name, common given names by gender, name parts by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία", "Κα"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος", "Κος"),
    "n": ("Dr", "Prof", "Δρ"),
}
PLAIN_TITLES = {"f": ("السيدة", "גברת", "श्रीमती"), "m": ("السيد", "מר", "श्री"), "n": ("الدكتور", "דוקטור", "डॉ")}
AFTER_TITLES = ("女士", "小姐", "太太", "先生", "博士", "教授", "医生")
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
CUES = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "signed by", "regards,", "Regards,", "sincerely,", "Sincerely,")
GIVEN = {
    ("f", "Latin"): ("Alice", "Clara", "Dora", "Elena", "Fiona", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria"),
    ("m", "Latin"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis"),
    ("n", "Latin"): ("Alex", "Chris", "Jamie", "Kim", "Robin", "Sascha", "Toni", "Andrea"),
    ("f", "Cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("m", "Cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Юрий"),
    ("n", "Cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
    ("f", "Greek"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("m", "Greek"): ("Γιώργος", "Κώστας", "Νίκος", "Πέτρος"),
    ("f", "Arabic"): ("فاطمة", "مريم", "ليلى", "سارة"),
    ("m", "Arabic"): ("أحمد", "علي", "حسن", "عمر"),
    ("f", "Hebrew"): ("שרה", "רחל", "לאה", "מרים"),
    ("m", "Hebrew"): ("דוד", "יוסף", "משה", "יעקב"),
    ("f", "Devanagari"): ("सीता", "राधा", "मीरा", "आशा"),
    ("m", "Devanagari"): ("राम", "मोहन", "विजय", "अमित"),
}
COMMON_GIVEN = {
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Emily", "Emma", "Jane", "Anna", "Maria", "Sophie", "Marie", "Camille", "Claire", "Isabelle", "Nathalie",
        "Sabine", "Ursula", "Petra", "Monika", "Carmen", "Lucía", "Isabel", "Pilar", "Priya", "Olga", "Ingrid", "Astrid", "Fatima", "Aisha", "Leila", "Yuki", "Natalia", "Svetlana", "Tatiana", "Ekaterina", "Anastasia", "Giulia", "Francesca",
        "Chiara", "Alessandra", "Beatriz", "Gabriela", "Valentina", "Camila", "Sofia", "Ana", "Teresa", "Marta", "Silvia", "Paula", "Raquel", "Helen", "Deborah", "Laura", "Rachel", "Rebecca", "Samantha", "Katherine", "Nicole", "Hannah",
        "Olivia", "Isabella", "Amelia", "Abigail", "Zofia", "Agnieszka", "Katarzyna", "Magdalena", "Katalin", "Zeynep", "Ananya", "Deepika", "Kavita", "Lakshmi", "Sunita",
    ),
    "m": (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "George", "Peter", "Paul", "Pierre", "Jean", "Jacques", "Michel", "Philippe", "François", "Hans", "Klaus",
        "Jürgen", "Wolfgang", "Stefan", "José", "Carlos", "Juan", "Miguel", "Javier", "Pablo", "Wei", "Ravi", "Rajesh", "Amit", "Sanjay", "Arjun", "Vikram", "Suresh", "Ahmed", "Mohammed", "Muhammad", "Omar", "Hassan", "Ibrahim", "Yusuf",
        "Mehmet", "Mustafa", "Hiroshi", "Takeshi", "Kenji", "Akira", "Vladimir", "Dmitri", "Sergei", "Alexei", "Nikolai", "Mikhail", "Igor", "Andrei", "Giovanni", "Marco", "Giuseppe", "Luca", "Alessandro", "Francesco", "Antonio", "Fernando",
        "Diego", "Luis", "Jorge", "Rafael", "Pedro", "João", "Paulo", "Lars", "Sven", "Olaf", "Anders", "Piotr", "Tomasz", "Krzysztof", "Wojciech", "Steven", "Andrew", "Kenneth", "Brian", "Kevin", "Edward", "Timothy", "Jason", "Jeffrey",
        "Nicholas", "Eric", "Jonathan", "Stephen", "Gregory", "Benjamin", "Samuel", "Patrick", "Alexander", "Laurent", "Olivier", "Uwe", "Dieter", "Helmut", "Matthias",
    ),
}
#: Words that end the name of a place or body that is called after a person.
BODIES = frozenset("University College Institute School Academy Hospital Church Cathedral Museum Library Park Street Avenue Road Square Bridge Airport Station Prize Award Foundation Trust Inc Ltd LLC GmbH Corp Corporation Company Bank Hotel County Island River Lake Fellowship Center Centre Hall Stadium Society Press Medal".split())
SYLLABLES = {
    "Latin": ("ba", "den", "fro", "gar", "hol", "kel", "lin", "mor", "nes", "pal", "rin", "sor", "tam", "vel", "wil", "zan"),
    "Cyrillic": ("ба", "вел", "гор", "дан", "жар", "кол", "лин", "мор", "нес", "пал", "рин", "сор", "там", "фед", "хол", "чер"),
    "Greek": ("βα", "γαρ", "δεν", "ζα", "θο", "καλ", "λιν", "μορ", "νε", "παλ", "ριν", "σορ", "ταμ", "φελ", "χο", "ψα"),
    "Arabic": ("با", "تم", "جر", "حل", "دن", "رم", "زن", "سل", "شم", "طل", "عم", "فر", "قل", "كر", "لم", "نو"),
    "Hebrew": ("בא", "גל", "דן", "הר", "זל", "חן", "טל", "כר", "לב", "מר", "נו", "סל", "פר", "צל", "רן", "שם"),
    "Devanagari": ("का", "गो", "चा", "जी", "ता", "दे", "ना", "पा", "बा", "मो", "या", "रा", "ला", "वि", "सो", "हा"),
    "Han": ("安", "北", "成", "德", "方", "光", "海", "江", "林", "明", "平", "清", "山", "文", "新", "云"),
    "Hangul": ("가", "나", "다", "라", "마", "바", "사", "아", "자", "차", "하", "고", "도", "로", "수", "진"),
    "Kana": ("あ", "か", "さ", "た", "な", "は", "ま", "や", "ら", "わ", "き", "し", "ち", "み", "り", "こ"),
}
#: First and last characters of a script's letters.
BLOCKS = (("Cyrillic", "\u0400", "\u04ff"), ("Greek", "\u0370", "\u03ff"), ("Greek", "\u1f00", "\u1fff"), ("Arabic", "\u0600", "\u06ff"), ("Hebrew", "\u0590", "\u05ff"), ("Devanagari", "\u0900", "\u097f"), ("Han", "\u4e00", "\u9fff"), ("Hangul", "\uac00", "\ud7a3"), ("Kana", "\u3041", "\u30ff"))

_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_PARTICLES = "de|la|las|los|del|della|di|da|das|do|dos|du|des|le|van|von|vom|der|den|ten|ter|zu|zum|zur|y|e|bin|ibn|al|el|af|av"
_UPPER = "".join(chr(c) for c in range(0x10000) if chr(c).isupper() and chr(c).isalpha())
_INITIALS = rf"(?:[{_UPPER}](?:\.[ ]?|[ ]))*"
_PART = rf"(?!(?:{_ALL_TITLES})(?!\w))[{_UPPER}][^\W\d_]+(?![\w@])"
_MORE = rf"(?:-|[ ](?:(?:{_PARTICLES})[ ])*{_INITIALS}){_PART}"
_SECRETS = "token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key"
_PHONE_WORDS = "phone|telephone|tel|mobile|fax|call|telefon|téléphone|teléfono"
_COMMON = "|".join(n for ns in COMMON_GIVEN.values() for n in ns)
_CUES = "|".join(map(re.escape, CUES))
_FIRM = "|".join(t for ts in PLAIN_TITLES.values() for t in ts)
_SUFFIX = "|".join(AFTER_TITLES)
_FIRST = "|".join(n for (_, s), ns in GIVEN.items() if s in ("Arabic", "Hebrew", "Devanagari") for n in ns)
_OTHER = "(?:[ء-يٱ-ۓ]{2,}|[א-ת]{2,}|[ऀ-ॣॱ-ॿ]{2,})"
_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    ("secret", rf"(?i:{_SECRETS})[\"']?\s*[=:]\s*[\"']?(?P<secret>(?=[+/_\-]*[A-Za-z0-9])[A-Za-z0-9+/_\-]{{16,}})"),
    ("hex", r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("phone", rf"(?<![0-9A-Za-z.\-])(?:\+[0-9]{{1,3}}[ .\-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .\-][0-9]{{3,4}}[ .\-][0-9]{{3,4}}(?![0-9]|[.\-][0-9])|(?<![0-9A-Za-z])\+[0-9]{{8,15}}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{{1,3}}(?:[ .\-][0-9]{{2,8}}){{2,5}}(?![0-9])|(?<![0-9A-Za-z.\-])0[1-9][0-9]{{1,3}}[ /\-][0-9]{{5,8}}(?![0-9]|[.\-][0-9])|(?<![0-9A-Za-z.\-])[2-9][0-9]{{2}}[2-9][0-9]{{6}}(?![0-9A-Za-z]|[.\-][0-9])|(?<!\w)(?i:{_PHONE_WORDS})[.:]*[ ](?P<dialled>\(?[0-9][0-9 .()\-]{{5,16}}[0-9])(?![0-9])"),
    ("name", rf"(?<!\w)(?P<title>{_ALL_TITLES})\.?[ ](?P<name>{_INITIALS}{_PART}(?:{_MORE})*)"),
    ("cued", rf"(?<!\w)(?:{_CUES})\s+(?P<cued>{_INITIALS}{_PART}(?:{_MORE})*)"),
    ("known", rf"(?<!\w)(?P<known>(?:{_COMMON})(?:{_MORE})+)"),
    ("firm", rf"(?<!\w)(?P<before>{_FIRM})\.?[ ](?P<firm>(?:(?:{_FIRST})[ ])?{_OTHER})"),
    ("styled", rf"(?P<styled>[{SURNAMES}][一-鿿]{{0,2}}?(?=[ ]?(?:{_SUFFIX}))|[一-鿿]{{2}}(?=さん|様)|(?<![가-힣])[가-힣]{{2,4}}?(?=[ ]?[씨님](?:[가는를의와도께에](?![가-힣])|(?![가-힣]))))"),
)
_OF_NAMES = ("name", "cued", "known", "firm", "styled")
_ORDER = {t: i for i, (t, _) in enumerate(_PATTERNS)}
_FIND_CODE = re.compile("|".join(f"(?P<t_{t}>{p})" for t, p in _PATTERNS if t not in _OF_NAMES))
_FIND_NAME = re.compile("|".join(f"(?P<t_{t}>{p})" for t, p in _PATTERNS if t in _OF_NAMES))
_SIGN, _SECRET_WORD = re.compile("[0-9@]"), re.compile(rf"(?i:{_SECRETS})")
#: What a text must hold for a name to be told in it.
_HINTS = ahocorasick.Automaton()
for _w in (*(t for ts in (*TITLES.values(), *PLAIN_TITLES.values(), *COMMON_GIVEN.values(), CUES, AFTER_TITLES) for t in ts), "さん", "様", "씨", "님"):
    _HINTS.add_word(_w, 0)
_HINTS.make_automaton()
_NAMES = ("name", "cued", "known")
#: Characters permuted together; Feistel rounds; draws of a shaped value before it keeps its first surrogate.
CHUNK, ROUNDS, DRAWS = 64, 8, 4
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def luhn(digits: str) -> int:
    """Check sum of a digit string modulo 10; 0 if its last digit is right."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    """An IBAN's check remainder; 1 if its check digits are right."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def dialable(number: str) -> bool:
    """Whether digits in groups follow a number plan: 7 to 15 digits, separators used alike, and, without a leading + or
    brackets, an area code with a 0 before it or of three digits; years, thousands and table columns don't."""
    digits = re.sub(r"[^0-9]", "", number)
    if not 7 <= len(digits) <= 15:
        return False
    if number.startswith("+") or "(" in number or number == digits:
        return True
    groups, between = re.findall(r"[0-9]+", number), set(re.findall(r"[^0-9]+", number))
    if len(between) > 1 or sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups) >= 2:
        return False
    if groups[0][0] == "0":
        return True
    thousands = all(len(g) == 3 for g in groups[1:]) and (between <= {"."} or groups[-1] == "000" or groups[0][0] < "6")
    return len(groups[0]) == 3 and groups[0][0] >= "2" and not thousands


def guessable(secret: str, before: str) -> bool:
    """Whether what follows ``secret:`` or ``token:``, words of prose themselves, is an ordinary word: letters of one case."""
    return before.lower().startswith(("secret", "token")) and ":" in before and secret.isalpha() and (secret[1:].islower() or secret.isupper())


def _gender(title: str, by: dict[str, tuple[str, ...]]) -> str:
    return next(g for g, ts in by.items() if title in ts)


def _found(text: str) -> list[tuple[str, re.Match]]:
    """(type, match) in order without overlaps."""
    codes = _SIGN.search(text) or (("=" in text or ":" in text) and _SECRET_WORD.search(text))
    found = [*_FIND_CODE.finditer(text)] if codes else []
    if next(_HINTS.iter(text), None) is not None:
        found += _FIND_NAME.finditer(text)
    typed = sorted(((next(t for t in _ORDER if m.groupdict().get(f"t_{t}") is not None), m) for m in found), key=lambda x: (x[1].start(), _ORDER[x[0]]))
    out, last = [], 0
    for t, m in typed:
        if m.start() >= last:
            out.append((t, m))
            last = m.end()
    return out


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) in order, values as they stand in the text; names come as one mention per part."""
    out = []
    for t, m in _found(text):
        if t == "secret":
            if not guessable(m["secret"], m[0][: m.start("secret") - m.start()]):
                out.append((*m.span("secret"), t, m["secret"]))
        elif t == "phone":
            told = "dialled" if m["dialled"] else 0
            if told and 7 <= sum(c.isdigit() for c in m[told]) <= 15 or dialable(m[0]):
                out.append((*m.span(told), t, m[told]))
        elif t == "iban":
            if mod97(m[0]) == 1:
                out.append((*m.span(), t, m[0]))
        elif t in _NAMES:
            parts = [p for p in re.finditer(r"[^\W\d_]{2,}", m[t]) if p[0][0].isupper()]
            if t == "known" and parts[-1][0] in BODIES:
                continue
            if t == "name":
                gender = _gender(m["title"], TITLES)
            else:
                gender = next((g for g, ns in COMMON_GIVEN.items() if parts[0][0] in ns), "n")
            for i, p in enumerate(parts):
                given = len(parts) > 1 and i == 0
                out.append((m.start(t) + p.start(), m.start(t) + p.end(), f"given_{gender}" if given else "surname", p[0]))
        elif t == "firm":
            parts = list(re.finditer(r"[^ ]+", m[t]))
            for i, p in enumerate(parts):
                given = len(parts) > 1 and i == 0
                out.append((m.start(t) + p.start(), m.start(t) + p.end(), f"given_{_gender(m['before'], PLAIN_TITLES)}" if given else "surname", p[0]))
        elif t == "styled":
            out.append((*m.span(t), "surname", m[t]))
        elif t != "card" or luhn(re.sub(r"[^0-9]", "", m[0])) == 0:  # digits without a right check digit are no card
            out.append((*m.span(), t, m[0]))
    return out


def normal(kind: str, value: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("secret",):
        return value
    return value.lower()


class Cycle:
    """A keyed cycle through range(n): each number's next, by a permutation that no one without the key can draw."""

    def __init__(self, key: bytes, label: str, n: int):
        self.key, self.n, bits = key, n, max(2, (n - 1).bit_length())
        self.label = blake2b(label.encode(), digest_size=16).digest()
        self.b = bits - bits // 2
        self.masks = ((1 << bits // 2) - 1, (1 << self.b) - 1)
        self.size = (self.b + 7) // 8

    def _round(self, r: int, x: int) -> int:
        data = self.label + r.to_bytes(1, "big") + x.to_bytes(self.size, "big")
        return int.from_bytes(blake2b(data, key=self.key, digest_size=min(64, self.size)).digest(), "big")

    def _walk(self, x: int, order: range) -> int:
        while True:
            half = [x >> self.b, x & self.masks[1]]
            for r in order:
                half[r % 2] ^= self._round(r, half[1 - r % 2]) & self.masks[r % 2]
            x = half[0] << self.b | half[1]
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        at = (self._walk(x, range(ROUNDS)) + 1) % self.n
        return self._walk(at, range(ROUNDS - 1, -1, -1))


def shaped(key: bytes, label: str, value: str, alphabets: list[str], fine: Callable[[str], bool] = lambda v: True) -> str:
    """The value with each character that has an alphabet moved within the space of its shape; the result is ``fine``."""
    spots = [i for i, a in enumerate(alphabets) if a]
    shape = blake2b("\0".join(alphabets).encode(), digest_size=16).hexdigest()
    out = list(value)
    for at in range(0, len(spots), CHUNK):
        part = spots[at : at + CHUNK]
        cycle = Cycle(key, f"{label}\0{shape}\0{at}", math.prod(len(alphabets[i]) for i in part))
        x = 0
        for i in part:
            x = x * len(alphabets[i]) + alphabets[i].index(out[i])
        while True:
            y = x = cycle.next(x)
            for i in reversed(part):
                y, c = divmod(y, len(alphabets[i]))
                out[i] = alphabets[i][c]
            if at + CHUNK < len(spots) or fine("".join(out)):
                break
    return "".join(out)


def by_class(value: str, letters: str = LOWER) -> list[str]:
    """Alphabets of a value's digits and ASCII letters."""
    upper = letters.upper()
    return [DIGITS if c in DIGITS else letters if c in letters else upper if c in upper else "" for c in value]


def script_of(value: str) -> str:
    return next((s for c in value for s, a, b in BLOCKS if a <= c <= b), "Latin")


class Draws:
    """Keyed numbers for a name: the same for the same key, type, value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.bits = int.from_bytes(blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key).digest(), "big")

    def below(self, n: int) -> int:
        self.bits, x = divmod(self.bits, n)
        return x


#: First octets and second ones of addresses outside the private ranges that have spaces of their own.
_PAIRS = [(a, b) for a in range(1, 224) for b in range(256) if a not in (10, 127) and (a, b) != (192, 168)]
_PAIR_AT = {p: i for i, p in enumerate(_PAIRS)}


def _address(key: bytes, value: str, attempt: int) -> str:
    parts = [int(x) for x in value.split(".")]
    whole = tuple(parts[:2]) in _PAIR_AT
    keep = 0 if whole else 2 if parts[:2] == [192, 168] else 1
    x = _PAIR_AT[tuple(parts[:2])] if whole else 0
    for p in parts[2 if whole else keep :]:
        x = x << 8 | p
    n = len(_PAIRS) << 16 if whole else 1 << 8 * (4 - keep)
    x = Cycle(key, f"ip\0{parts[:keep]}\0{attempt}", n).next(x)
    if whole:
        return ".".join(map(str, (*_PAIRS[x >> 16], x >> 8 & 255, x & 255)))
    return ".".join(map(str, (*parts[:keep], *(x >> 8 * i & 255 for i in reversed(range(4 - keep))))))


def _name(key: bytes, kind: str, value: str, attempt: int) -> str:
    script, d = script_of(value), Draws(key, kind, value, attempt)
    names = GIVEN.get((kind[-1], script)) if kind.startswith("given_") else None
    if names and not attempt:
        return names[d.below(len(names))].lower()
    n = 2 * attempt + (1 if names else 2 if script not in ("Han", "Hangul") else 1)
    return (names[d.below(len(names))].lower() if names else "") + "".join(SYLLABLES[script][d.below(16)] for _ in range(n))


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a normalised value."""
    label = f"{kind}\0{attempt}"
    if kind == "ip":
        return _address(key, value, attempt)
    if kind == "card":  # the last digit keeps its distance from the right one
        off = (int(value[-1]) - int(next(c for c in DIGITS if luhn(value[:-1] + c) == 0))) % 10
        out = value[0] + shaped(key, f"{label}\0{value[0]}\0{off}", value[1:-1], [DIGITS] * (len(value) - 2))
        right = int(next(c for c in DIGITS if luhn(out + c) == 0))
        return out + str((right + off) % 10)
    if kind == "phone":
        lead = max(0, len(value) - 10)
        return value[:lead] + shaped(key, f"{label}\0{value[:lead]}", value[lead:], [DIGITS] * (len(value) - lead))
    if kind == "email":
        local, _, domain = value.partition("@")
        head, _, top = domain.rpartition(".")
        return f"{shaped(key, f'{label}{chr(0)}{domain}', local, by_class(local))}@{shaped(key, f'domain{chr(0)}{top}', head, by_class(head))}.{top}"
    if kind == "iban":
        body = lambda v: 98 - int("".join(str(int(c, 36)) for c in v + value[:2] + "00")) % 97
        out = shaped(key, f"{label}\0{value[:2]}", value[4:], by_class(value[4:], UPPER.lower()))
        return f"{value[:2]}{(int(value[2:4]) - body(value[4:]) + body(out)) % 100:02d}{out}"
    if kind == "hex":
        return shaped(key, label, value, [HEX] * len(value), lambda v: not v.isdigit() and not v.isalpha())
    if kind == "secret":
        hexed = lambda v: re.fullmatch(r"[^A-Za-z0-9]*(?:[0-9a-f]|[^A-Za-z0-9])*|(?:[0-9A-F]|[^A-Za-z0-9])*", v) is not None
        if hexed(value):
            return shaped(key, label, value, by_class(value, "abcdef"))
        return shaped(key, label, value, by_class(value), lambda v: len(v) > CHUNK or not hexed(v))
    if kind == "ssn":
        return shaped(key, label, value, [DIGITS] * len(value))
    return _name(key, kind, value, attempt)


def formatted(kind: str, value: str, replacement: str) -> str:
    """The replacement in the format of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(replacement)
        return "".join(next(left) if c.isalnum() else c for c in value)
    if kind.startswith("given_") or kind == "surname":
        return replacement.upper() if value.isupper() and len(value) > 1 else replacement.capitalize()
    if kind == "email":
        return "".join(c.upper() if v.isupper() else c for c, v in zip(replacement, value))
    return replacement


@lru_cache(1 << 15)
def replacement(key: bytes, kind: str, value: str, attempt: int) -> str:
    return surrogate(key, kind, value, attempt)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set()
        for t in batch.column(0):
            if t.is_valid:
                seen |= {(k, normal(k, v)) for _, _, k, v in mentions(t.as_py())}
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "value"])


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v, a = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *x) for x in zip(k, v, a)], pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value) -> (kind, value, attempt, surrogate), all surrogates of a kind distinct.

    Shaped values are drawn at most DRAWS times; one whose draws all are entities keeps its first surrogate, which no
    other first draw equals and which later draws leave alone. Names are drawn until they are distinct and no entities.
    """
    named = "kind = 'surname' or kind like 'given%'"
    schema = "kind string, value string, attempt int, surrogate string"
    real = entities.select("kind", F.col("value").alias("surrogate"))
    first = written(entities.withColumn("attempt", F.lit(0)).mapInArrow(_drawn(key), schema), "drawn")
    drawn, parts, spent, attempt = first, [], [], 0
    while True:
        taken = real
        for p in parts:
            taken = taken.unionByName(p.select("kind", "surrogate"))
        if attempt:
            taken = taken.unionByName(first.where(f"not ({named})").select("kind", "surrogate"))
        lead = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("lead"))
        lead = lead.join(taken.distinct().withColumn("taken", F.lit(True)).hint("merge"), ["kind", "surrogate"], "left")
        judged = drawn.join(lead.hint("merge"), ["kind", "surrogate"]).withColumn("fine", F.col("taken").isNull() & (F.col("value") == F.col("lead")))
        judged = written(judged.select("kind", "value", "attempt", "surrogate", "fine"), "judged")
        parts.append(judged.where("fine").drop("fine"))
        spent.append(drawn)
        bad = judged.where("not fine").select("kind", "value")
        attempt += 1
        if attempt == DRAWS:
            shaped_left = bad.where(f"not ({named})")
            parts.append(written(first.join(shaped_left.hint("merge"), ["kind", "value"], "left_semi"), "kept"))
        if attempt >= DRAWS:
            bad = bad.where(named)
        if bad.isEmpty():
            break
        drawn = written(bad.withColumn("attempt", F.lit(attempt)).mapInArrow(_drawn(key), schema), "drawn")
    for t in spent:
        dropped(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _replaced(key: bytes, names: list[str], added: list[str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, counts, kinds = [], [], []
            again = batch.column(len(names)).to_pylist()
            for t, more in zip(batch.column(at).to_pylist(), again):
                tries = {(m["kind"], m["value"]): m["attempt"] for m in more or ()}
                out, last, found = [], 0, mentions(t) if t else []
                for s, e, k, v in found:
                    n = normal(k, v)
                    out += [t[last:s], formatted(k, v, replacement(key, k, n, tries.get((k, n), 0)))]
                    last = e
                texts.append(t if not found else "".join(out) + t[last:])
                counts.append(len(found))
                kinds.append(",".join(sorted({k for _, _, k, _ in found})))
            cols = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=[*names, *added])

    return run


def _doc_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        th, k, v = [], [], []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            for kind, value in sorted({(k2, normal(k2, v2)) for _, _, k2, v2 in mentions(t.as_py())} if t.is_valid else ()):
                th.append(h)
                k.append(kind)
                v.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(k, pa.string()), pa.array(v, pa.string())], names=["th", "kind", "value"])


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with the entities of ``text`` replaced, plus ``_n_entities`` (long) and ``_kinds`` (sorted, comma-joined)."""
    names = docs.columns
    th, again, *added = fresh(names, "_th", "_again", "_n_entities", "_kinds")
    found = docs.select("text").mapInArrow(_entities, "kind string, value string").distinct()
    found = written(found, "entities")
    assigned = assign(found, key)
    late = written(assigned.where("attempt > 0").select("kind", "value", "attempt"), "late")
    dropped(found)
    if late.isEmpty():
        rows = docs.select(*columns_of(names), F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>").alias(again))
    else:  # the few entities whose first surrogate was taken, by the texts that mention them
        of = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(_doc_entities, "th long, kind string, value string").distinct()
        per = of.join(small_or_merge(late), ["kind", "value"]).groupBy(F.col("th").alias(th)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(again))
        rows = docs.withColumn(th, F.xxhash64("text")).join(small_or_merge(written(per, "again")), th, "left").select(*columns_of(names), again)
    schema = T.StructType(list(docs.schema.fields)).add(added[0], "long").add(added[1], "string")
    return plain_named(rows).mapInArrow(_replaced(key, names, added), schema)
