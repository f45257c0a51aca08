"""Personal data in free text, replaced by typed placeholders.

Numbers that pass their format's check are pseudonymised by a keyed Feistel network over their
own digits and letters, walked until the pseudonym passes the check too, so a number keeps its
format and equal numbers get equal pseudonyms in all documents. Dates of birth are permuted in
the same way. Everything else, numbers that fail their check included, gets a keyed tag.

Names are told by structure and context. Which words serve as given and family names, and which
are ordinary words, is learned from the corpus itself: from author fields and from pairs behind a
common given name, counted over all rows and kept in filters of fixed size.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# --- format-preserving pseudonyms


def _round(key: bytes, tweak: bytes, n: int, half: int, modulus: int) -> int:
    h = hashlib.blake2b(n.to_bytes(1, "big") + tweak + half.to_bytes(24, "big"), key=key, digest_size=24)
    return int.from_bytes(h.digest(), "big") % modulus


def feistel(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of 0 .. left * right - 1 by an alternating Feistel network."""
    a, b = divmod(value, right)
    for n in range(0, ROUNDS, 2):
        a = (a + _round(key, tweak, n, b, left)) % left
        b = (b + _round(key, tweak, n + 1, a, right)) % right
    return a * right + b


def unfeistel(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """The inverse of feistel, for those who hold the key."""
    a, b = divmod(value, right)
    for n in range(ROUNDS - 2, -2, -2):
        b = (b - _round(key, tweak, n + 1, a, right)) % right
        a = (a - _round(key, tweak, n, b, left)) % left
    return a * right + b


def _halves(radix: int, n: int) -> tuple[int, int]:
    return radix ** (n // 2), radix ** (n - n // 2)


def permute_format(text: str, key: bytes, kind: str, keep: int = 0, inverse: bool = False) -> str:
    """text with its digits and its letters permuted; other characters, letter case and the first keep digits stay.

    What is permuted depends on digits and letters alone, so one number in two notations has one
    pseudonym. A single digit or letter is shifted by a keyed amount.
    """
    digits = [k for k, c in enumerate(text) if c.isascii() and c.isdigit()][keep:]
    letters = [k for k, c in enumerate(text) if c.isascii() and c.isalpha()]
    out = list(text)
    go = unfeistel if inverse else feistel
    for places, radix, zero in ((digits, 10, "0"), (letters, 26, "A")):
        n = len(places)
        if not n:
            continue
        value = 0
        for k in places:
            value = value * radix + ord(text[k].upper()) - ord(zero)
        left, right = _halves(radix, n)
        value = go(value, left, right, key, f"{kind}/{radix}/{n}".encode())
        for k in reversed(places):
            value, c = divmod(value, radix)
            c = chr(ord(zero) + c)
            out[k] = c.lower() if text[k].islower() else c
    return "".join(out)


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), 400 * 128


def permute_date(day: datetime.date, key: bytes) -> datetime.date:
    """A date of the 140 years from 1900 on as another one of them; other dates stay."""
    at = day.toordinal() - _FIRST
    return datetime.date.fromordinal(_FIRST + feistel(at, 400, 128, key, b"date")) if 0 <= at < _DAYS else day


def read_date(text: str) -> tuple[datetime.date, tuple[int, int, int]] | None:
    """A date in numbers, and which of its parts are year, month and day; the day goes first unless that can't be."""
    a, b, c = map(int, re.split(r"[-./]", text))
    order = (0, 1, 2) if "-" in text else (2, 0, 1) if b > 12 else (2, 1, 0)
    try:
        return datetime.date(*[(a, b, c)[k] for k in order]), order
    except ValueError:
        return None


def permute_date_text(text: str, key: bytes) -> str:
    """A date of birth as another one in the same notation; one that permute_date keeps as a tag."""
    day, order = read_date(text)
    new = permute_date(day, key)
    if new == day:
        return tag(day.isoformat(), key)
    parts = dict(zip(order, (new.year, new.month, new.day)))
    places = iter(range(3))
    return re.sub(r"\d+", lambda m: str(parts[next(places)]).zfill(len(m[0])), text)


def tag(text: str, key: bytes) -> str:
    return hashlib.blake2b(text.encode(), key=key, digest_size=16).hexdigest()


# --- numbers that can be checked


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_SSN = re.compile(r"(?!000|666)\d{3}(?!00)\d{2}(?!0000)\d{4}")
_NINO = re.compile(r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]")
#: Passports, licences and identity cards have no common check: a length, and digits among the letters.
_DOCUMENT = re.compile(r"(?=.*\d{3})[A-Z0-9]{6,16}")


def valid_number(kind: str, mention: str) -> bool:
    """Whether a number passes the check of its format: length of a phone number, ranges of the parts of a social security
    or insurance number, check digits of an account or card."""
    bare = re.sub(r"[^A-Za-z0-9]", "", mention).upper()
    if kind == "phone":
        return 7 <= len(bare) <= 15 and len(set(bare)) > 1
    if kind == "account":
        return bool(_IBAN.fullmatch(bare)) and _mod97(bare) if bare[:1].isalpha() else 13 <= len(bare) <= 19 and len(set(bare)) > 1 and _luhn(bare)
    if len(bare) == 9 and bare.isdigit():
        return bool(_SSN.fullmatch(bare))
    if len(bare) == 9 and bare[:2].isalpha() and bare[2:8].isdigit() and bare[8].isalpha():
        return bool(_NINO.fullmatch(bare))
    return bool(_DOCUMENT.fullmatch(bare)) and len(set(bare)) > 1


def permute_valid(mention: str, key: bytes, kind: str, keep: int = 0) -> str:
    """A valid number as another valid one of its format: the permutation is applied until its value is valid again,
    which makes it a permutation of the valid numbers. The country of an account stays."""
    if kind == "account" and mention[:1].isalpha():
        head = mention[:2]
        step: Callable[[str], str] = lambda t: head + permute_format(t[2:], key, "iban")
    else:
        step = lambda t: permute_format(t, key, kind, keep)
    out = step(mention)
    while not valid_number(kind, out):
        out = step(out)
    return out


# --- what counts as a mention

_L = r"[^\W\d_]"
_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|@)"
_DOTS = r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+|\.)"
_LOCAL = r"[\w+-]+(?:(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[\w+-]+)*"
EMAIL = re.compile(
    rf"(?<![\w/@:.+-])(?:mailto:)?(?P<a>[\w+-]+(?:\.[\w+-]+)*)@(?P<ad>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})(?![\w:/@])(?!\.[A-Za-z0-9])"
    rf"|(?<![\w/@:.+-])(?P<b>{_LOCAL})\s*[\[({{<]\s*at\s*[\])}}>]\s*(?P<bd>[A-Za-z0-9-]+(?:{_DOTS}[A-Za-z0-9-]+)*{_DOTS}[A-Za-z]{{2,}})(?!\w)"
    rf"|(?<![\w/@:.+-])(?P<c>[\w+-]+(?:(?:\.|\s+dot\s+)[\w+-]+)*)\s+at\s+(?P<cd>[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+[A-Za-z]{{2,}})(?!\w)",
    re.I,
)
_MAY_EMAIL = re.compile(r"[\[({<]\s*at\s*[\])}>]|\sdot\s", re.I)
#: Local parts that are logins of remotes, never a person's.
LOGINS = frozenset(["git", "hg", "svn", "root"])

PHONE = re.compile(
    r"(?<![\w+])\+\d{1,3}[\s.\-]?(?:\(0\)[\s.\-]?)?\(?\d{1,4}\)?(?:[\s./\-]?\d){5,11}(?![\w\-])"
    r"|(?<![\w.+/\-])(?:1[\-.\s])?(?:\(\d{3}\)[\s.\-]?|\d{3}[\-.\s])\d{3}[\-.\s]\d{4}(?![\w\-])"
    r"|(?<![\w.+/\-,])0\d{2,4}[/\s\-]\d{3,4}[\s\-]?\d{3,4}(?![\w\-])"
    r"|(?<![\w.+/\-,])0\d{2,4}\s?/\s?\d{3,6}(?:[\-\s]\d{2,4})?(?![\w\-])"
    r"|(?<![\w.+/\-,])0\d(?:[.\s\-]\d{2}){4}(?![\w\-])"
    r"|(?<![\w.+/\-,])07\d{9}(?!\w)",
)

_CUE = (
    r"(?:social\s+security(?:\s+(?:number|no\.?|nr\.?))?|ssn|national\s+insurance(?:\s+(?:number|no\.?))?|ni\s+(?:number|no\.?)|nino|national\s+id(?:entity)?(?:\s+(?:number|card|no\.?))*"
    r"|passport(?:\s+(?:number|no\.?|nr\.?))?|reisepass(?:nummer|nr\.?)?|(?:personal)?ausweis(?:nummer|nr\.?|-nr\.?)?|driv(?:er|ing)(?:['’]?s)?\s+licen[cs]e(?:\s+(?:number|no\.?))?|licen[cs]e\s+(?:number|no\.?)"
    r"|f[uü]hrerschein(?:nummer|nr\.?)?|id\s+card(?:\s+(?:number|no\.?))?|carte\s+d['’]identit[eé]|dni|nie|tax\s+id)"
)
ID_CUED = re.compile(rf"(?<!\w){_CUE}\s*[:#=]?\s*(?P<v>(?=(?:[\s-]?[A-Za-z0-9]){{6}})[A-Z]{{0,5}}[\s-]?\d(?:[\s-]?\d){{3,13}}(?:\s?[A-Z])?)(?![\w])", re.I)
ID_BARE = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<!\w)[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Da-d](?!\w)")
ACCOUNT = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![\w-])|(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])")
#: Parts of every cue, for a plain search before the expressions.
_CUES = ("ssn", "social", "insurance", "nino", "national", "passport", "reisepass", "ausweis", "licen", "hrerschein", "card", "identit", "dni", "nie", "tax")
_NI = re.compile(r"(?<!\w)ni\s+n", re.I)

_BORN = r"(?:born(?:\s+on)?|(?:date\s+of\s+birth|birth\s?date|birthday|dob|d\.o\.b\.?)(?:\s+is)?|geboren(?:\s+am)?|geb\.|geburtsdatum|née?\s+le|date\s+de\s+naissance|nacid[oa]\s+el|fecha\s+de\s+nacimiento)"
#: A date of birth in numbers; other dates belong to no person and stay.
BIRTH = re.compile(rf"(?<!\w){_BORN}\s*[:=]?\s*(?P<v>\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}(?P<s>[./])\d{{1,2}}(?P=s)\d{{4}})(?!\w)", re.I)
_BIRTHS = ("born", "birth", "dob", "d.o.b", "geb", "né", "naissance", "naci")

_EN = r"(?:street|road|rd\.?|lane|avenue|ave\.?|boulevard|blvd\.?)"
_EN_TITLE = r"(?:Street|St\.?|Drive|Dr\.?|Court|Ct\.?|Way|Place|Square|Terrace|Close|Crescent|Row|Park|Grove|Mews)"
ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?:(?:flat|apt\.?|unit|suite)\s+\d{{1,4}}[a-z]?,\s*)?\d{{1,5}}[a-z]?\s+(?!(?:of|the|and|to|in|on|a)\s)[^\W\d_][\w'’-]+\s+(?:(?!(?:of|the|and|to|in|on|a)\s)[^\W\d_][\w'’-]+\s+)?{_EN}(?!\w)"
    rf"|(?<![\w.:/-])\d{{1,5}}[a-z]?\s+(?-i:[A-Z][\w'’-]+\s+(?:[A-Z][\w'’-]+\s+)?{_EN_TITLE})(?!\w)"
    r"|(?<![\w.:/-])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|bd|place|chemin|impasse|all[ée]e|quai)\s+(?:d[eu]s?\s+(?:la\s+)?|d['’])?[^\W\d_][\w-]+"
    r"|(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino)\s+(?:de\s+(?:las?\s+|los\s+)?|del\s+)?[^\W\d_][\w-]+(?:\s+[^\W\d_][\w-]+)?,?\s+(?:n[º°.]\s*)?\d{1,4}(?!\w)"
    r"|(?<![\w/])[^\W\d_][\w-]*(?:stra(?:ß|ss)e|str\.|gasse)\s+\d{1,4}\s?[a-z]?(?!\w)"
    r"|(?<![\w/])(?-i:[A-ZÄÖÜ][a-zäöüß-]{2,}(?:weg|platz|allee|damm|ufer))\s+\d{1,4}\s?[a-z]?(?!\w)",
    re.I,
)
_STREETS = ("street", "road", "rd", "lane", "ave", "boul", "blvd", "bd", "rue", "place", "chemin", "impasse", "all", "quai", "drive", "court", "way", "square", "terrace", "close", "crescent", "row", "park", "grove", "mews", "st", "dr", "ct", "calle", "c/", "aven", "avda", "plaza", "paseo", "camino", "gasse", "weg", "platz", "damm", "ufer")
#: A number before a street, as the first three forms of ADDRESS have it, or behind one.
_NUMBERED = re.compile(r"\d[a-z]?(?:\s?(?:bis|ter|quater))?,?\s+[^\W\d_]|[\w.-],?\s+(?:n[º°.]\s*)?\d", re.I)
_DIGIT = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"\d[\d().\s/-]{7}")

#: Given names in lower case; a name is sought where one of them or a family name's ending stands.
GIVEN = frozenset(
    """
    aaron ahmed aisha alexander alice amelie ana anders andrea anna antonio barbara bastian beatriz benjamin björn bronwyn carlos carmen carol charles chiara chloe christine clara claudia daniel david
    deborah desmond dmitri donald dorothy edward eleni elena elizabeth emeka emily emma eric eva farah felix fergus fiona francesca frank gabriel george gideon giulia grace greta hanna hannah
    hans helen helena henrik hiroshi hugo ibrahim imani ingrid isabel ivan jacob james jan jean jennifer jessica johan johanna john jorge josé jose joseph juan julia karen katarina katya
    kenji kevin kirsten kofi lars laura leila linda linnea lorenzo louis lucas lucia luis mária maría maria marco marcus maren margaret mark marta martin mary mateo matthew meera mei michael miguel
    miriam mohamed nadia nancy nikolai nina noor olga oliver omar oskar pascal patricia paul pavel pedro peter petra pierre priya quentin rafael ravi raj renata renée renee richard robert
    rosalind ruth samir samuel sandra sarah sergei simone sofia sophie stefan susan sven svetlana tatiana thandiwe thomas tilda tobias tom ulrich ulrike tomasz ursula valentina viktor victor vincent wanjiru
    wei william winifred xavier yara yuki yusuf yvette zainab zoltan zoë zoe åsa asa
    """.split()
)
#: Words that make an author a bot, a team or a role.
ROLES = frozenset(
    "bot team teams builder automation maintainers maintainer release platform nightly queue sync runner unknown root build merge docs ci dependency updater service system admin group ops infra security robot job pipeline deploy index user agent committers developers engineering support office department lab labs project core contributors".split()
)
#: Titles, words that often stand before a person, and verbs of what persons do, in four languages.
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame mme mlle señor señora sr sra doña don".split())
BEFORE = frozenset("by from with to cc thanks ask contact owner owned author user reviewer colleague engineer and or between von mit bei laut an par avec selon à chez por con según para y et und oder".split())
AFTER = frozenset(
    "said says saw wrote writes asked asks approved approves reviewed reviews reported reports noted notes thinks thought decided decides agreed agrees disagreed disagrees confirmed confirms fixed fixes merged merges owns replied replies suggested suggests wants wanted insisted will would has had and or is was sagt sagte schrieb schreibt meint meinte a dit pense décidé dijo dice decidió".split()
)
_FUNCTION = frozenset("the a an this that these those i he she it they we you his her their our your in on at of for as if when then than but not no is are was were be been der die das den dem ein eine le la les un une des el los las una de du und et y o or and".split())

# --- names learned from the corpus

BITS = 1 << 23  # of each filter: 1 MB; at 3 hashes some 900,000 words at one false hit in a hundred
_HASHES = 3
_TRIM = ".,;:!?()[]<>\"'`“”‘’…"


def _slots(word: str) -> list[int]:
    raw = word.encode()
    return [crc32(raw, seed * 0x9E3779B1 & 0xFFFFFFFF) % BITS for seed in range(1, _HASHES + 1)]


class Names:
    """What the corpus says of a word: given name, family name, ordinary word. Filters of fixed size; empty without a corpus."""

    KINDS = ("given", "family", "common")

    def __init__(self, filters: dict[str, np.ndarray] | None = None):
        self.filters = filters or {}
        self.memo: dict[str, tuple[bool, bool, bool]] = {}

    def __getstate__(self) -> dict:
        return {"filters": self.filters, "memo": {}}

    def of(self, low: str) -> tuple[bool, bool, bool]:
        """(given, family, ordinary) of a word in lower case."""
        got = self.memo.get(low)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            parts = [_slots(p) for p in low.split("-")] if self.filters else []  # of a double name every part
            hit = [k in self.filters and all([self.filters[k][s >> 6] >> np.uint64(s & 63) & np.uint64(1) for slots in parts for s in slots]) for k in self.KINDS]
            given = low in GIVEN or hit[0]
            got = self.memo[low] = (given, hit[1], (hit[2] or low in _FUNCTION) and low not in GIVEN)
        return got


_AUTHOR_NOISE = re.compile(r"\([^)]*\)|<[^>]*>|\b(?:Dr|Prof|Mr|Mrs|Ms)\.?\s")
_AUTHOR = re.compile(rf"({_L}{{2,}}(?:-{_L}+)*)(?:\s+{_L}\.)?\s+({_L}{{2,}}(?:['’-]{_L}+)*)|({_L}{{2,}}(?:['’-]{_L}+)*),\s+({_L}+(?:-{_L}+)*)(?:\s+{_L}\.)?")


def author_pair(text: str) -> tuple[str, str] | None:
    """(given, family) of an author field that holds two capitalised words and no role, in either order."""
    if any(c.isdigit() for c in _AUTHOR_NOISE.sub(" ", text)) or "[" in text:
        return None
    m = _AUTHOR.fullmatch(_AUTHOR_NOISE.sub(" ", text).strip())
    if not m:
        return None
    given, family = (m[1], m[2]) if m[1] else (m[4], m[3])
    return (given, family) if given[0].isupper() and family[0].isupper() and len(given) > 1 and given.lower() not in ROLES and family.lower() not in ROLES else None


def count_words(text: str, author: bool, into: Counter) -> None:
    """Adds (word, what) of a text: lower or capital for each word of letters, given and family for each sure name."""
    if author:
        if pair := author_pair(text):
            into[pair[0].lower(), "given"] += 1
            for part in pair[1].lower().split("-"):
                into[part, "family"] += 1
        return
    before = ""
    for token in text.split():
        word = token.strip(_TRIM)
        if word.isalpha() or "-" in word and word.replace("-", "").isalpha():
            low = word.lower()
            capital = word[0].isupper()
            sure = before and capital and low not in ROLES and low not in _FUNCTION and len(low) > 2
            for part in low.split("-"):
                into[part, "capital" if capital else "lower"] += 1
                if sure:
                    into[part, "family"] += 1
            before = low if capital and low in GIVEN and token[-1] not in ".,;:!?)" else ""
        else:
            before = before if len(word) == 1 and word.isalpha() else ""


def learn_names(parts: list[tuple[DataFrame, str, bool]]) -> Names:
    """The names and the ordinary words of all rows of (rows, column, whether it holds authors).

    A word is a family (given) name if at least two sure names hold it there and they are a tenth
    of its occurrences; it is ordinary if it stands more often in lower case than capitalised. All
    rows are counted, exactly, with map-side sums; repeated author fields once. Only the filters'
    set bits, of fixed number, reach the driver. Null and empty texts count nothing.
    """
    texts = None
    for rows, column, author in parts:
        one = rows.select(F.col(column).alias("text")).where(F.col("text").isNotNull())
        one = (one.distinct() if author else one).select("text", F.lit(author).alias("author"))
        texts = one if texts is None else texts.unionByName(one)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        flush = lambda: pd.DataFrame([(w, what, n) for (w, what), n in seen.items()], columns=["word", "what", "n"])
        for pdf in batches:
            for t, author in zip(pdf["text"], pdf["author"]):
                count_words(t, author, seen)
            if len(seen) > 300_000:
                yield flush()
                seen.clear()
        yield flush()

    n = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(0)).alias(what)
    words = texts.mapInPandas(count, "word string, what string, n long").groupBy("word").agg(*[n(w) for w in ("lower", "capital", "given", "family")])
    seen = F.col("lower") + F.col("capital")
    flags = words.select("word", ((F.col("given") >= 2) & (F.col("given") * 10 >= seen)).alias("given"), ((F.col("family") >= 2) & (F.col("family") * 10 >= seen)).alias("family"), ((F.col("lower") > F.col("capital")) & (F.col("family") * 10 < seen)).alias("common"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.array([_slots(w) for w in pdf["word"]], np.int64).reshape(-1, _HASHES)
            for k, kind in enumerate(Names.KINDS):
                slots = np.unique(at[pdf[kind].to_numpy(bool)])
                yield pd.DataFrame({"kind": k, "slot": slots >> 6, "bit": (slots & 63).astype("int32")})

    rows = flags.where("given or family or common").mapInPandas(bits, "kind int, slot long, bit int").groupBy("kind", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).collect()
    filters = {k: np.zeros(BITS >> 6, np.uint64) for k in Names.KINDS}
    for kind, slot, word in rows:
        filters[Names.KINDS[kind]][slot] = np.uint64(word & 0xFFFFFFFFFFFFFFFF)
    return Names(filters)


_WORD = re.compile(rf"{_L}+(?:['’]{_L}+)?(?:-{_L}+)*")
_GAP = re.compile(r"[^\S\n]{1,3}|[^\S\n]?\n[^\S\n]?")


def _cased(word: str) -> bool:
    return word[:1].isupper()


def find_names(text: str, author: bool = False, names: Names | None = None) -> list[tuple[int, int, str]]:
    """(start, end, key) of names; the key is the same for 'Given Family', 'Family, Given' and a middle initial between.

    Two neighbouring words are a name if enough speaks for it: a known given name, a learned family
    name, a title, a word or verb of persons beside them, contact data right behind. Ordinary words
    of the corpus and words of roles are never part of one. Pairs in lower case need both a given
    and a family name; a family name with an initial needs to be learned or capitalised in such a
    context. An author field may be a name by its form alone.
    """
    names = names or Names()
    words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]
    out: list[tuple[int, int, str]] = []
    taken, n = -1, len(words)
    of = names.of

    def add(a: int, b: int, *parts: str) -> None:
        nonlocal taken
        out.append((a, b, " ".join(sorted(p.lower() for p in parts))))
        taken = b

    def context(k: int, j: int) -> int:
        """What speaks for a person around words k to j."""
        score = 0
        a, b = words[k][1], words[j][2]
        if out and out[-1][1] <= a and re.fullmatch(r"\s*(?:,|&|and|or|und|et|y|oder|ou|o)\s+", text[out[-1][1] : a]):
            score = 1
        if k:
            w, _, e = words[k - 1]
            between = text[e:a]
            low = w.lower()
            if low in TITLES and between.strip(" ") in ("", "."):
                score = 2
            elif low in BEFORE and between.isspace() or between.strip() in (":", ",", "'", '"') and low in BEFORE:
                score = max(score, 1)
        rest = text[b : b + 4].lstrip(" \n,(<:/")
        if rest[:1] in ("\x00", "@") and rest:
            score += 1
        elif j + 1 < n and text[b : words[j + 1][1]].isspace() and words[j + 1][0].lower() in AFTER:
            score += 1
        return score

    for k, (word, a, b) in enumerate(words):
        if a < taken or k + 1 >= n:
            continue
        low = word.lower()
        cased = word[0].isupper()
        nxt, na, nb = words[k + 1]
        if len(word) == 1:  # an initial and a family name
            gap = text[b + 1 : na]
            if text[b : b + 1] == "." and len(nxt) > 2 and (gap == "" or _GAP.fullmatch(gap)) and text[a - 1 : a] != ".":
                _, family, common = of(nxt.lower())
                if not common and nxt.lower() not in ROLES and (family or cased and nxt[0].isupper() and (author or context(k, k + 1) > 0)):
                    add(a, nb, word, nxt)
            continue
        given, family, common = of(low)
        if not (cased or given or family) or common or low in ROLES:
            continue
        j, between = k + 1, text[b:na]
        if len(nxt) == 1 and text[nb : nb + 1] == "." and k + 2 < n and _GAP.fullmatch(between):
            j, between = k + 2, text[nb + 1 : words[k + 2][1]]  # a middle initial
        second, sa, sb = words[j]
        if _GAP.fullmatch(between) and len(second) > 1:
            g2, f2, c2 = of(second.lower())
            if not c2 and second.lower() not in ROLES and not (low in BEFORE or low in TITLES or low in AFTER):
                both = cased and second[0].isupper()
                if both:
                    score = 2 * given + 2 * f2 + (context(k, j) if not (given or f2) else 0)
                    alike = word.isupper() == second.isupper()
                    good = score >= 2 or score == 1 and alike and not word.isupper() and len(second) > 2 or author and given
                    good = good and (f2 or len(second) > 2 or given and not second.isupper())
                    if given and g2 and not f2 and not author and j == k + 1:
                        good = good and context(k, j) > 0 or good and not (j + 1 < n and text[sb : words[j + 1][1]].isspace() and of(words[j + 1][0].lower())[1])
                else:
                    good = given and f2
                if good:
                    add(a, sb, word, second)
                    continue
        if text[b:na].strip() == "," and na - b <= 3:
            g2 = of(nxt.lower())[0]
            initial = len(nxt) == 1 and nxt.isupper() and text[nb : nb + 1] == "."
            if family and (g2 or initial) or cased and len(word) > 3 and (g2 and nxt[0].isupper() or initial) and not given and (author or family or context(k, k + 1) > 0):
                add(a, nb, word, nxt)
    if author and not out and (pair := author_pair(text)):
        first, second = sorted(pair, key=text.index)
        if not (of(first.lower())[2] and of(second.lower())[2]):
            at = text.index(first)
            add(at, text.index(second, at + len(first)) + len(second), *pair)
    return out


def _normal_email(m: re.Match) -> str:
    local, domain = (m["a"], m["ad"]) if m["a"] else (m["b"], m["bd"]) if m["b"] else (m["c"], m["cd"])
    join = lambda s: re.sub(r"\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*", ".", s, flags=re.I).lower()
    return f"{join(local)}@{join(domain)}"


def find_mentions(text: str, author: bool = False, names: Names | None = None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, mention, key) of the personal data of a text, in order and without overlap.

    Mentions are sought from the surest kind to the least sure; what a surer kind has taken is
    blanked, so that a name inside an e-mail address is no name.
    """
    out: list[tuple[int, int, str, str, str]] = []
    rest = text

    def take(a: int, b: int, kind: str, key: str) -> None:
        nonlocal rest
        out.append((a, b, kind, text[a:b], key))
        rest = rest[:a] + "\x00" * (b - a) + rest[b:]

    if "@" in text or _MAY_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            a = m.start()
            chunk = text[max(text.rfind(" ", 0, a), text.rfind("\n", 0, a), text.rfind("<", 0, a)) + 1 : a]
            local = (m["a"] or m["b"] or m["c"]).lower()
            if "://" in chunk or (m["a"] and local in LOGINS):
                continue
            a = a + 7 if m[0][:7].lower() == "mailto:" else a
            take(a, m.end(), "email", _normal_email(m))
    if _DIGIT.search(text):
        low = text.lower()
        if any([c in low for c in _BIRTHS]):
            for m in BIRTH.finditer(rest):
                if found := read_date(m["v"]):
                    take(*m.span("v"), "date", found[0].isoformat())
        if any([c in low for c in _CUES]) or _NI.search(low):
            for m in ID_CUED.finditer(rest):
                take(*m.span("v"), "id_number", re.sub(r"[\s-]", "", m["v"]).upper())
        for m in ID_BARE.finditer(rest):
            take(*m.span(), "id_number", re.sub(r"[\s-]", "", m[0]).upper())
        if _LONG_NUMBER.search(rest):
            for m in ACCOUNT.finditer(rest):
                if valid_number("account", m[0]):
                    take(*m.span(), "account", re.sub(r"[\s-]", "", m[0]))
        if any([c in low for c in _STREETS]) and _NUMBERED.search(rest):
            for m in ADDRESS.finditer(rest):
                take(*m.span(), "address", re.sub(r"\W+", " ", m[0]).strip().lower())
        if _LONG_NUMBER.search(rest):
            for m in PHONE.finditer(rest):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    take(*m.span(), "phone", re.sub(r"\D", "", m[0]))
    for a, b, key in find_names(rest, author, names):
        take(a, b, "name", key)
    return sorted(out)


def placeholder(kind: str, mention: str, key_text: str, key: bytes) -> str:
    """Typed placeholder of a mention; of a valid number or date with its pseudonym in the same format, else with a tag."""
    if kind == "date":
        return f"[DATE {permute_date_text(mention, key)}]"
    if kind in ("phone", "id_number", "account") and valid_number(kind, mention):
        keep = 0
        if kind == "phone":
            keep = len(m[1]) if (m := re.match(r"\+(\d{1,2})", mention)) else 1 if mention.startswith("0") else 0
        return f"[{kind.upper()} {permute_valid(mention, key, kind, keep)}]"
    return f"[{kind.upper()} {tag(f'{kind} {key_text}', key)}]"


def pseudonymise(text: str, key: bytes, author: bool = False, names: Names | None = None) -> tuple[str, list[str]]:
    """The text with placeholders, and the kinds of its mentions."""
    out, last, kinds = [], 0, []
    for a, b, kind, mention, same in find_mentions(text, author, names):
        out += [text[last:a], placeholder(kind, mention, same, key)]
        kinds.append(kind)
        last = b
    return "".join([*out, text[last:]]), kinds


def pseudonymised(rows: DataFrame, key: str, text: str, secret: bytes, author: bool = False, names: Names | None = None) -> DataFrame:
    """(row_id, redacted, kinds) of every non-null text; kinds has each kind of mention once.

    kinds are email, phone, id_number, address, name, account (IBAN or card, by its check digits)
    and date (of birth). Everything around a mention stays as it is. Null texts give no row, empty
    texts and texts without mentions come out unchanged with no kinds; repeated rows each count.
    author says that the column holds one person, not prose. secret is the key, which has no
    default: who knows it can undo the pseudonyms of numbers. names is what learn_names gives for
    the whole corpus, so that names are judged alike in all its columns; without it it is learned
    from these rows. The pseudonyms depend on text, key and names alone. One narrow pass.
    """
    if not secret:
        raise ValueError("a secret key is needed")
    shared = rows.sparkSession.sparkContext.broadcast(names or learn_names([(rows, text, author)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, list[str]]] = {}
        known = shared.value
        for pdf in batches:
            found = []
            for t in pdf["text"]:
                if author:  # few persons write most rows
                    if t not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[t] = pseudonymise(t, secret, True, known)
                    found.append(memo[t])
                else:
                    found.append(pseudonymise(t, secret, False, known))
            yield pd.DataFrame({"row_id": pdf["row_id"], "redacted": [t for t, _ in found], "kinds": [sorted(set(k)) for _, k in found]})

    some = rows.select(F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = some.schema["row_id"].dataType.simpleString()
    return some.mapInPandas(run, f"row_id {kind}, redacted string, kinds array<string>")
