"""The second dialect of normal forms: flags and legal forms as bits, learned aliases for Indic words, whole numbers.

Skeletons and folds are column expressions; names and addresses are plain functions, applied on Arrow batches to
distinct values only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import groupby, pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import joined_by_value

# Legal words that count anywhere, and those that count only at an edge or beside another.
STRONG_FORMS = {
    "pvt": "pvt", "private": "pvt", "ltd": "ltd", "limited": "ltd", "llc": "llc", "llp": "llp", "inc": "inc", "incorporated": "inc",
    "corp": "corp", "corporation": "corp", "pllc": "pllc", "plc": "plc", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl",
    "snc": "snc", "scop": "scop", "selarl": "selarl", "opc": "opc", "company": "co",
}
WEAK_FORMS = {"co": "co", "sa": "sa", "ei": "ei", "sci": "sci", "pc": "pc", "lp": "lp", "public": "public", "sca": "sca", "gie": "gie"}
FORM_CODES = sorted({*STRONG_FORMS.values(), *WEAK_FORMS.values()})
HONORIFICS = {"sri", "shri", "shree", "mr", "mrs", "ms", "dr", "messrs", "the", "m"}
# Street words, words that announce a number, parts of an address that say nothing.
STREET_WORDS = {
    "road": "rd", "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "avn": "ave", "drive": "dr", "lane": "ln",
    "court": "ct", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "bvd": "blvd", "highway": "hwy", "parkway": "pkwy", "circle": "cir",
    "place": "pl", "plaza": "plz", "trail": "trl", "terrace": "ter", "square": "sq", "suite": "ste", "sainte": "ste", "apartment": "apt",
    "floor": "fl", "flr": "fl", "north": "n", "south": "s", "east": "e", "west": "w", "mount": "mt", "fort": "ft", "county": "co",
    "township": "twp", "opposite": "opp", "near": "nr", "building": "bldg", "district": "dist", "r": "rue", "impasse": "imp",
    "allee": "allee", "chemin": "chem", "route": "rte", "faubourg": "fg", "centre": "center", "nagar": "ngr",
}
NUMBER_WORDS = {
    "no", "nos", "num", "number", "hno", "hn", "dno", "door", "house", "plot", "flat", "shop", "shp", "office", "unit", "apt", "ste",
    "fl", "pmb", "box", "po", "sno", "sy", "khasra", "kh",
}
EMPTY_PARTS = {"null", "n/a", "na", "none", "nan", "-", ""}
# Endings of sites, ways to announce another name, letters and signs written otherwise.
SITE_ENDS = ("co.in", "com", "in", "net", "org", "fr", "biz", "info", "io", "co", "us")
OTHER_NAMES = ("d/b/a", "dba", "a/k/a", "aka", "f/k/a", "fka", "formerly known as", "trading as", "t/a")
LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "’": "", "'": "", "‘": "", "&": " and "}
# Digraphs of a skeleton, in the order in which they go.
DIGRAPHS = {"chh": "c", "ch": "c", "sh": "s", "ph": "f", "kh": "k", "gh": "g", "th": "t", "dh": "d", "bh": "b", "jh": "j", "w": "v", "q": "k", "z": "j", "x": "ks"}
# Latin letters by offset in a Brahmic block.
CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split())) | dict(zip(range(0x58, 0x60), "q kh g z d rh f y".split()))
VOWELS = dict(zip(range(0x05, 0x15), "a aa i ee u oo ri li e e e ai o o o au".split()))
VOWEL_SIGNS = dict(zip(range(0x3E, 0x4D), "aa i ee u oo ri ri e e e ai o o o au".split()))
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA = 0x4D

#: Flags of a name.
IS_SITE, HAS_PHONE, HAS_ID, HAS_OTHER_NAME = 1, 2, 4, 8
#: Learned aliases travel with the task; beyond this many they are refused.
MAX_ALIASES = 200_000

_SITE = re.compile(rf"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:{'|'.join(map(re.escape, SITE_ENDS))})\b")
_OTHER_NAME = re.compile(r"\b(?:" + "|".join(re.escape(x).replace("/", r"\s*/\s*").replace(r"\ ", " ") for x in OTHER_NAMES) + r")\b")
_PHONE = re.compile(r"\+?\d[\d\s-]{7,}\d")
_ID = re.compile(r"\(?\s*\b(?:id|ref)\s*[:#]\s*\w+\s*\)?")
_INITIALS = re.compile(r"(?<![a-z0-9])[a-z]\.(?:[a-z]\.)*(?:[a-z](?![a-z0-9]))?")
_WORD = re.compile("[a-z0-9]+")
_SEPARATORS = frozenset(",;:|/\\()[]{}<>\"`~!@#$%^*+=?_.-–—°º")


def is_indic(text: str) -> bool:
    return any("ऀ" <= c <= "෿" for c in text)


def _sound(c: str) -> tuple[str, str] | None:
    """Kind and Latin letters of a sign; nothing for signs without a sound."""
    if not "ऀ" <= c < "඀":
        return "other", c
    place = ord(c) % 0x80
    if place == VIRAMA:
        return "sign", ""
    if 0x66 <= place <= 0x6F:
        return "other", str(place - 0x66)
    for kind, table in (("consonant", CONSONANTS), ("sign", VOWEL_SIGNS), ("other", VOWELS), ("other", NASALS)):
        if place in table:
            return kind, table[place]
    return None


def romanize(word: str) -> str:
    """Latin letters of a word in a Brahmic script: consonants carry an a unless a vowel sign follows or the word ends."""
    sounds = [s for s in map(_sound, word) if s] + [("sign", "")]
    return "".join(letters + "a" * (kind == "consonant" and after != "sign") for (kind, letters), (after, _) in pairwise(sounds))


def skeleton(word: Column) -> Column:
    """Digraphs as one letter; then the first letter and the consonants other than h after it, runs as one."""
    short = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), DIGRAPHS.items(), word)
    bare = F.concat(F.substring(short, 1, 1), F.translate(F.substring(short, 2, 1 << 30), "aeiouyh", ""))
    return F.regexp_replace(bare, r"(.)\1+", "$1")


def fold_of(key: Column, folds: int = 5) -> Column:
    """The fold of a whole number: bits 33 and up of its product with the golden ratio, modulo 2^64.

    Keys count modulo 2^64 (negative ones by their two's complement), decimals beyond a long too.
    Products of 16 by 32 bits fit longs: nothing overflows, nothing is rounded.
    """
    ratio_high, ratio_low = divmod(0x9E3779B97F4A7C15, 1 << 32)
    decimal = lambda x, digits: F.lit(str(x)).cast(f"decimal({digits},0)")
    masked = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    product = lambda c, n: masked(F.shiftleft(masked(F.shiftright(c, 16) * F.lit(n), 16), 16) + masked(c, 16) * F.lit(n), 32)
    whole = F.pmod(key.cast("decimal(38,0)"), decimal(1 << 64, 20))
    low = whole % decimal(1 << 32, 10)
    high = ((whole - low) / decimal(1 << 32, 10)).cast("long")
    low = low.cast("long")
    carry = F.shiftright(F.shiftright(low, 16) * F.lit(ratio_low) + F.shiftright(masked(low, 16) * F.lit(ratio_low), 16), 16)
    top = masked(carry + product(low, ratio_high) + product(high, ratio_low), 32)
    return (F.shiftright(top, 1) % folds).cast("int")


class Latin(NamedTuple):
    text: str
    indic: int = 0
    guessed: int = 0


def to_latin(text: str, aliases: dict[str, str]) -> Latin:
    """Indic words by their learned alias, else letter by letter; how many there were, and how many had no alias."""
    if not is_indic(text):
        return Latin(text)
    words = ["".join(run) for gap, run in groupby(text, lambda c: c.isspace() or c in _SEPARATORS) if not gap]
    foreign = [w for w in words if is_indic(w)]
    return Latin(" ".join(w if not is_indic(w) else aliases[w] if w in aliases else romanize(w) for w in words), len(foreign), sum(w not in aliases for w in foreign))


def _small(raw: str | None) -> str:
    return unicodedata.normalize("NFKC", raw or "").lower().translate(str.maketrans(LETTERS))


def _plain(text: str) -> str:
    """Initials without dots, letters without accents."""
    joined = _INITIALS.sub(lambda m: m[0].replace(".", ""), text)
    return "".join(c for c in unicodedata.normalize("NFKD", joined) if not unicodedata.combining(c))


class DialectName(NamedTuple):
    core: str
    full: str
    concat: str
    legal: int
    flags: int
    domain: str
    n_ind: int
    n_fb: int
    ntok: int


def _split_site(text: str) -> tuple[str, str, bool]:
    """(rest, site, whether there is nothing else)."""
    before, _, after = text.partition("|")
    sites = [m for m in (_SITE.search(after), _SITE.search(before)) if m]
    domain = sites[0][1].replace("-", "") if sites else ""
    own = _SITE.search(before)
    if not own:
        return before, domain, False
    rest = f"{before[: own.start()]} {before[own.end() :]}"
    return (rest, domain, False) if _WORD.search(rest) else (domain, domain, True)


def _own_words(words: list[str]) -> tuple[list[str], set[str]]:
    """The words that are no legal form, and the codes of those that are."""
    own, codes, after_form = [], set(), False
    for word, following in zip(words, [*words[1:], None]):
        at_edge = following is None or not own and not codes
        after_form = word in STRONG_FORMS or word in WEAK_FORMS and (at_edge or after_form or following in STRONG_FORMS)
        if after_form:
            codes.add(STRONG_FORMS.get(word) or WEAK_FORMS[word])
        else:
            own.append(word)
    return own, codes


def dialect_name(raw: str | None, aliases: dict[str, str] | None = None) -> DialectName:
    """The fields of a business name; a null counts as empty. A name of legal forms alone keeps its words."""
    text, domain, is_site = _split_site(_small(raw))
    flags = IS_SITE * is_site
    for bit, pattern in ((HAS_PHONE, _PHONE), (HAS_ID, _ID), (HAS_OTHER_NAME, _OTHER_NAME)):
        text, found = pattern.subn(" ", text)
        flags |= bit * (found > 0)
    latin = to_latin(text, aliases or {})
    words = _WORD.findall(_plain(latin.text))
    own, codes = _own_words(words)
    first = next((i for i, w in enumerate(own) if w not in HONORIFICS), len(own) - 1)
    own = own[max(first, 0) :]
    own = [w for w in own if w != "the"] or own
    last = next((i for i in range(len(own), 0, -1) if own[i - 1] != "and"), 1)
    core = [w for w, _ in groupby(own[:last] or words)]
    forms = [c for c in FORM_CODES if c in codes]
    mask = sum(1 << FORM_CODES.index(c) for c in forms)
    return DialectName(" ".join(core), " ".join(core + forms), "".join(core), mask, flags, domain, latin.indic, latin.guessed, len(core))


class DialectAddress(NamedTuple):
    addr: str
    alpha: str
    nums: list[str]
    empty: bool
    n_ind: int


def dialect_address(raw: str | None, aliases: dict[str, str] | None = None, parts: dict[str, str] | None = None) -> DialectAddress:
    """Words and numbers of an address, box numbers left out; words alone; the first eight numbers."""
    said = [x.strip() for x in _small(raw).replace("n°", " ").split(",")]
    latin = [to_latin((parts or {}).get(x, x), aliases or {}) for x in said if x not in EMPTY_PARTS]
    words = [STREET_WORDS.get(w, w) for w in _WORD.findall(_plain(", ".join(x.text for x in latin)))]
    # A number behind a box is the box's.
    words = [w for before, w in pairwise(["", *words]) if not (w.isdigit() and before in ("box", "pmb"))]
    out = [w.lstrip("0") or "0" if w.isdigit() else w for w in words]
    numbers = [m[0].lstrip("0") or "0" for m in (re.search(r"\d+", w) for w in words) if m]
    alpha = [w for w in words if w.isalpha() and w not in NUMBER_WORDS]
    return DialectAddress(" ".join(out), " ".join(alpha), list(dict.fromkeys(numbers))[:8], not out, sum(x.indic for x in latin))


_KINDS = {"legal": T.LongType(), "flags": T.IntegerType(), "n_ind": T.IntegerType(), "n_fb": T.IntegerType(), "ntok": T.IntegerType(), "nums": T.ArrayType(T.StringType()), "empty": T.BooleanType()}
_NAME, _ADDRESS = (T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in kind._fields]) for kind in (DialectName, DialectAddress))


def dialect_names(df: DataFrame, column: str = "business_name", aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the fields of its names; each distinct string is normalised once."""
    if len(aliases or {}) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    return joined_by_value(df, [(column, lambda x: dialect_name(x, aliases), _NAME)])


def dialect_addresses(df: DataFrame, column: str = "business_address", aliases: dict[str, str] | None = None, parts: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the fields of its addresses; ``parts`` has other names of whole parts, such as states."""
    if len(aliases or {}) + len(parts or {}) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    return joined_by_value(df, [(column, lambda x: dialect_address(x, aliases, parts), _ADDRESS)])
