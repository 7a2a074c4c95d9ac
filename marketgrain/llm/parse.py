"""Reading of listing names: their words in one alphabet, with what a bilingual glossary knows in one word for both languages.

A token is a sign and a word: ``=`` a food or variety of the glossary, ``c`` or ``l`` a word written in Cyrillic or Latin
letters (transliterated), ``n`` a number or a word of another script.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from marketgrain.llm import lexicon

# Plain transliteration of Bulgarian letters.
LATIN = dict(zip("абвгдезийклмнопрстуфъыьэ", "a b v g d e z i y k l m n o p r s t u f a y y e".split(), strict=True)) | {"ж": "zh", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ю": "yu", "я": "ya", "ё": "e"}
_WORD = re.compile(r"\d+(?:[.,]\d+)?|[^\W\d_]+")
_PERCENT = re.compile(r"(\d+(?:[.,]\d+)?)\s*%(?:\s*(?:масл\.?|fat)(?!\w))?")
_RANGE = re.compile(r"(\d+)\s*[-–]\s*(\d+)\s*%")
_UNIT = r"(?:кг|kg|килограм\w*|мг|mg|гр?а?м?а?|g|gr|мл|ml|милилит\w*|л|l|лит\w+|сл|cl|oz|lbs?)"
_NUM = r"(?:\d{1,2} \d00|\d+/\d+|\d+(?:[.,]\d+)?|½|¼|половин)"
_CONTENT = re.compile(
    rf"(?<![\w.,])(?:\d+\s*(?:[xх×*]|бр(?:оя|ой|\.)?\s*по|pcs?\.?\s*of)\s*)?{_NUM}\s*{_UNIT}\b\.?(?:\s*и\s*\d+\s*{_UNIT}\b\.?)?(?:\s*[xх×*]\s*\d+)?|(?<![\w.,])\d+\s*(?:бр(?:оя|ой)?|pcs?|pieces)\b\.?",
    re.IGNORECASE,
)

#: Foods whose variety may be their part of fat.
WITH_FAT = ("milk", "yogurt", "butter")


def latin(word: str) -> str:
    """Transliterated, lower-case, without marks: the form in which makers of both alphabets are compared."""
    word = "".join(LATIN.get(c, c) for c in word.lower())
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def near(a: str, b: str, most: int = 1) -> bool:
    """Edit distance (with swaps of neighbours) of at most ``most``, which is 1 or 2."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b) <= most
    if len(a) == 2 and a == b[::-1]:
        return True
    if most == 1:
        return len(a) == 1 and len(b) == 1
    return near(a[1:], b[1:]) or near(a[1:], b) or near(a, b[1:])


@dataclass(frozen=True)
class Glossary:
    """Foods with their varieties, phrases of advertising and filling words, as in :mod:`lexicon`; all may be empty."""

    foods: str = lexicon.FOODS
    advertising: str = lexicon.ADVERTISING
    fillers: str = lexicon.FILLERS


GLOSSARY, NO_GLOSSARY = Glossary(), Glossary("", "", "")


@dataclass
class _Entry:
    name: str
    ways: list[frozenset[str]]
    varieties: list[_Entry] = field(default_factory=list)


class _Known:
    """A glossary made ready: entries in order, phrases of advertising (longest first), all its words by length."""

    def __init__(self, glossary: Glossary) -> None:
        self.entries: list[_Entry] = []
        for line in filter(str.strip, glossary.foods.split("\n")):
            name, _, ways = line.strip().partition(":")
            entry = _Entry(name, sorted((frozenset(w.split()) for w in ways.split("|")), key=len, reverse=True))
            (self.entries[-1].varieties if line.startswith(" ") else self.entries).append(entry)
        self.ads = sorted(filter(None, (_WORD.findall(a.lower()) for a in glossary.advertising.split("|"))), key=len, reverse=True)
        self.ads_by_first: dict[str, list[list[str]]] = {}
        for ad in self.ads:
            self.ads_by_first.setdefault(ad[0], []).append(ad)
        self.fillers = frozenset(glossary.fillers.split())
        self.words = self.fillers | {w for e in self.entries for x in [e, *e.varieties] for way in x.ways for w in way} | {w for a in self.ads for w in a}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.words):
            if len(w) >= 3 and not w.isdigit():
                self.by_length.setdefault(len(w), []).append(w)
        self._slips: dict[str, frozenset[str]] = {}

    def slips(self, word: str) -> frozenset[str]:
        """All known words of which ``word`` may be a slip: with one letter left out, else changed in one place (two in
        words of nine letters or more)."""
        if len(word) < 2 or not self.words:
            return frozenset()
        if word not in self._slips:
            if len(self._slips) > 1 << 16:
                self._slips.clear()
            near_by = lambda d: (k for n in range(len(word) - d, len(word) + d + 1) for k in self.by_length.get(n, ()) if n >= 4)
            found = {k for k in self.by_length.get(len(word) + 1, ()) if any(k[:i] + k[i + 1 :] == word for i in range(len(k)))}
            for most in (1, 2) if len(word) >= 9 else (1,):
                if not found and len(word) >= 4:
                    found = {k for k in near_by(most) if near(word, k, most)}
            self._slips[word] = frozenset(found)
        return self._slips[word]


@lru_cache(maxsize=4)
def _known(glossary: Glossary) -> _Known:
    return _Known(glossary)


def _take(words: list[str], way: frozenset[str], meant: dict[str, frozenset[str]]) -> list[str] | None:
    """``words`` without those of ``way``, each there as it is or as a slip; None if one is missing."""
    rest = list(words)
    for w in way:
        at = w if w in rest else next((x for x in rest if w in meant.get(x, ())), None)
        if at is None:
            return None
        rest.remove(at)
    return rest


def _first(words: list[str], entries: list[_Entry], meant: dict[str, frozenset[str]]) -> tuple[_Entry | None, list[str]]:
    held = {*words, *(k for w in words for k in meant.get(w, ()))}
    for e in entries:
        for way in e.ways:
            if way <= held and (rest := _take(words, way, meant)) is not None:
                return e, rest
    return None, words


def _no_ads(words: list[str], ads: dict[str, list[list[str]]], meant: dict[str, frozenset[str]]) -> list[str]:
    """``words`` without phrases of ``ads`` (by first word), the longest first, each word as it is or as a slip."""
    out: list[str] = []
    i = 0
    same = lambda x, w: x == w or w in meant.get(x, ())
    while i < len(words):
        longest = 0
        for first in (words[i], *meant.get(words[i], ())):
            for ad in ads.get(first, ()):
                if longest < len(ad) <= len(words) - i and all(same(x, w) for x, w in zip(words[i : i + len(ad)], ad, strict=True)):
                    longest = len(ad)
        if longest:
            i += longest
        else:
            out.append(words[i])
            i += 1
    return out


def _sign(word: str) -> str:
    letter = next((c for c in word if c.isalpha()), " ")
    if "a" <= letter <= "z":
        return "l"
    if "а" <= letter <= "я":
        return "c"
    return "c" if "CYRILLIC" in (n := unicodedata.name(letter, "")) else "l" if "LATIN" in n else "n"


def name_tokens(name: str | None, glossary: Glossary = GLOSSARY) -> tuple[str, list[str]]:
    """Wording (its words in one alphabet, sorted) and distinct tokens of a listing name in ordinary spelling.

    Content and known advertising belong to neither.

    Known words may be written with a slip; that a known word was meant is only supposed where another unknown word is
    left to be the maker. Of the readings with and without slips the one with a food, a variety and least rest counts.
    """
    known = _known(glossary)
    text = _RANGE.sub(lambda m: f" {m.group(1)} {m.group(2)} ", (name or "").lower())
    shares = [m.replace(",", ".") for m in _PERCENT.findall(text)]
    shares = [m.rstrip("0").rstrip(".") if "." in m else m for m in shares]
    words = _WORD.findall(unicodedata.normalize("NFC", _CONTENT.sub(" ", _PERCENT.sub(" ", text))))
    plain = _no_ads(words, known.ads_by_first, {})
    odd = [w for w in dict.fromkeys(plain) if w not in known.words and not w[0].isdigit() and len(w) > 1]
    meant = {w: s for w in odd if (s := known.slips(w))} if len(odd) > 1 else {}
    if meant and len(meant) == len(odd):
        del meant[max(odd, key=len)]
    readings = []
    for slips in ({}, meant) if meant else ({},):
        left = _no_ads(plain, known.ads_by_first, slips) if slips else plain
        food, left = _first(left, known.entries, slips)
        variety, left = _first(left, food.varieties, slips) if food else (None, left)
        left = [w for w in left if not known.slips(w) & known.fillers or w not in slips]
        readings.append((food, variety, left))
    food, variety, left = max(readings, key=lambda r: (bool(r[0]), bool(r[1]), -len(r[2])))
    tokens = [f"={food.name}"] if food else []
    if variety:
        tokens.append(f"={variety.name}")
    elif not food or food.name in WITH_FAT:
        tokens += [f"n{m}%" for m in (shares[:1] if food else shares)]
    settled = food is not None and (variety is not None or food.name in WITH_FAT and bool(shares))
    # with food and variety known, other known words are wording
    tokens += [_sign(w) + latin(w) for w in left if w not in known.fillers and not (settled and (w in known.words or w[0].isdigit()))]
    wording = sorted({latin(w) for w in plain if w not in known.fillers} | {f"{m}%" for m in shares})
    return " ".join(wording), list(dict.fromkeys(tokens))
