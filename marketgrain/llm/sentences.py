"""Sentence boundaries across languages and scripts.

The standard sentence-break scheme: code points have classes taken from the Unicode properties (Sentence_Break and general
categories), so the terminators, continuing marks and letters of all scripts are known by rule. A terminator, then closing
quotation marks and brackets, then blanks, end a sentence, unless what follows goes on with it (small letter, continuing
mark), the full stop belongs to a number or an abbreviation of the document's language, or the quotation or bracket
stands within a sentence. Thai, which has no terminators, ends a sentence at a blank that touches neither a digit nor a
Latin letter.

Classes, runs of letters, neighbours of every mark and the plain cases (a terminator after a word that is no
abbreviation, before a capital letter) are computed for a whole Arrow batch in numpy; only marks in doubt are looked at one
by one. Quotations are matched once per paragraph; nothing looks ahead or back over a fixed distance.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.glyphs import TOP, slices

# Abbreviations of each language. "on": a sentence goes on after them; "title": so only where written with a
# capital (or in texts without case); "number": it goes on before a number; "unit": it ends before a capital letter only;
# "list": ends of lists; "time": units after which a short beginning goes on; "pairs_on", "pairs_end": two letters with a
# blank between them; "days": words after which an ordinal's full stop is none; "pause": words an ellipsis does not cut off.
RULES: dict[str, dict[str, str]] = {
    "bg": {
        "on": "вж напр т.нар бул ул кв пл вит т.е д-р проф инж г-н г-жа св гл т тел ж.к к.с акад доц",
        "number": "ок бл ал чл табл рис ст стр вх ет ап т п примерно прибл", "unit": "лв ч мин сек г гр кг мл л бр с.л ч.л хил млн млрд сл см мм м", "time": "ч",
        "list": "др т.н т.д т.п пр", "pairs_on": "т е,т к,т н", "pairs_end": "т д,т п", "pause": "ами ех ну на",
        "days": "януари февруари март април май юни юли август септември октомври ноември декември понеделник вторник сряда четвъртък петък събота неделя",
    },
    "ru": {
        "on": "см напр т.е т ул пр пл им г-н г-жа проф акад д-р вит", "number": "рис ст стр ок прибл примерно табл гл п ч т", "unit": "руб коп тыс к г гр кг мл л ч мин сек млн млрд см мм м", "time": "ч",
        "list": "др т.д т.п т.н пр", "pairs_on": "т е,т к,т н", "pairs_end": "т д,т п", "pause": "ну на ах",
        "days": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    },
    "en": {
        "on": "e.g i.e vs cf u.s u.k viz incl resp", "title": "st mr mrs ms dr prof jr sr", "number": "no nr fig tab approx ca pp p vol art ch sec circa",
        "unit": "oz lb lbs lv min sec hr hrs a.m p.m am pm std", "time": "a.m p.m", "list": "etc", "pairs_on": "i e,e g", "pause": "well hm hmm oh so",
    },
    "de": {
        "on": "z d z.b d.h u.a bzw vgl dr prof hr fr st evtl ggf inkl sog u o.ä", "number": "nr abb tab s abs kap ca art p circa", "unit": "std tl el min sek stk lv", "list": "usw",
        "pairs_on": "d h,z b,u a", "pause": "also tja hm",
        "days": "januar februar märz april mai juni juli august september oktober november dezember montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag",
    },
    "el": {"on": "π.χ δηλ βλ κα κος", "number": "σελ αρ κεφ", "unit": "κ κιλ γρ μ.μ π.μ ευρ λ", "time": "μ.μ π.μ", "list": "κ.λπ κ.ά"},
    "hi": {"on": "डॉ श्री सुश्री प्रो"},
}
# Units of measure of all languages.
UNITS = "oz lb kg gr ml cl lv лв"
# Words that carry on after a quotation or an ellipsis, by language.
CARRY_ON = {"ja": "と って という", "zh": "因为 但 不过 所以 而 可是", "ar": "ثم"}
# Letters and words that tell languages of one script apart, where a document names none.
TELLING = {"ru": "ыэё", "de": "äöüß"}
GERMAN = "der die das und ist nicht ein eine mit auf für von den zu es"
# Marks that end a sentence though their property does not say so (Tibetan shads, ellipsis), marks of
# question and exclamation that may stand within one, and quotation marks that open or close.
MORE_ENDS, ASKING = "།༎…", "!?‼⁇⁈⁉"
OPEN, CLOSE = "„«‹「『《〈“‟｢﹁﹃", "”»›」』》〉｣﹂﹄"

END, FULL, WIDE, QUOTE, OPENS, CLOSES, SPACE, UPPER, LOWER, LETTER, DIGIT, HIDDEN, THAI, GREEK, GOES, SEMI = (1 << k for k in range(16))
_KINDS = ("on", "title", "number", "unit", "list", "time", "pairs_on", "pairs_end", "days", "pause")

PARAGRAPH = re.compile(r"(?:[^\S\n]*\n){2,}\s*")
_NUMBER_BEFORE = re.compile(r"(?<![\w.,])(\d{1,2}(?:\.\d{1,2})?)$")
_PAIR_BEFORE = re.compile(r"(?<!\w)([^\W\d_])\.\s([^\W\d_])$")
_WORD_BEFORE = re.compile("(?:[^\\W\\d_]|[ऀ-ॿ­​-‍⁠]|\\.(?=[^\\W\\d_])|-(?=[^\\W\\d_]))+$")
_YEAR_BEFORE = re.compile(r"\d{4}\s*$")
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_WEB = re.compile(r"www\.|(?:\S*\.)?(?:com|org|net|bg|de|eu|example)\b", re.IGNORECASE)
_HIDE = re.compile("[­​-‏⁠﻿]+")
#: No abbreviation, number or pair with the word before it is longer, so a longer run of letters needs no look.
_LONGEST = 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class bits of every code point, from its Unicode properties."""
    every = "".join(chr(i) for i in range(TOP) if not 0xD800 <= i <= 0xDFFF)
    table = np.zeros(TOP, np.uint16)

    def put(bit: int, chars) -> None:
        table[np.array([ord(c) for c in chars], np.int64)] |= np.uint16(bit)

    has = lambda p: regex.findall(rf"\p{{{p}}}", every)
    put(END, has("SB=STerm") + has("SB=ATerm") + list(MORE_ENDS))
    put(FULL, has("SB=ATerm"))
    put(WIDE, [c for c in has("SB=STerm") + list("།༎") if c not in ASKING])
    put(QUOTE, OPEN + CLOSE + '"')
    put(OPENS, [c for c in every if unicodedata.category(c) == "Ps" and c not in OPEN])
    put(CLOSES, [c for c in every if unicodedata.category(c) == "Pe" and c not in CLOSE])
    put(SPACE, filter(str.isspace, every))
    put(UPPER, filter(str.isupper, every))
    put(LOWER, filter(str.islower, every))
    put(LETTER, filter(str.isalpha, every))
    put(DIGIT, filter(str.isdigit, every))
    put(HIDDEN, [*"­⁠﻿", *map(chr, range(0x200B, 0x2010))])
    put(THAI, has("InThai"))
    put(GREEK, has("InGreek") + has("InGreek_Extended"))
    put(GOES, [c for c in has("SB=SContinue") if c not in "-﹣－"])
    put(SEMI, ";;")
    return table


@lru_cache(maxsize=16)
def _rules(lang: str | None) -> dict[str, frozenset[str]]:
    """Word sets of a language; those of all languages where it is not known."""
    tables = [RULES[lang]] if lang in RULES else [] if lang else list(RULES.values())
    split = lambda kind, text: text.split(",") if kind.startswith("pairs") else text.split()
    sets = {k: frozenset(w for t in tables for w in split(k, t.get(k, "")) if w) for k in _KINDS}
    sets["unit"] |= frozenset(UNITS.split())
    sets["carry"] = frozenset(w for k, words in CARRY_ON.items() if lang in (k, None) for w in words.split())
    sets["any"] = frozenset().union(*(sets[k] for k in ("on", "title", "number", "unit", "list")))
    return sets


def language(lang: str | None, text: str) -> str | None:
    """Two-letter language: the one named, else by script, letters and common words (None where they do not tell)."""
    code = re.split(r"[-_\s]", lang.strip().lower())[0] if lang else ""
    if code in RULES or code in ("ja", "zh", "th", "ar"):
        return code
    count = lambda p: len(regex.findall(rf"\p{{{p}}}", text))
    kana = count("Hiragana") + count("Katakana")
    scripts = {"ja": 3 * kana, "zh": 0 if kana else count("Han"), "th": count("Thai"), "ar": count("Arabic"), "hi": count("Devanagari"), "el": count("Greek"), "cyrillic": count("Cyrillic"), "latin": count("Latin")}
    most = max(scripts, key=scripts.get)
    if not scripts[most]:
        return None
    low = text.lower()
    if most == "cyrillic":
        return "ru" if any(c in low for c in TELLING["ru"]) else "bg"
    if most == "latin":
        words = re.findall(r"[^\W\d_]+", low)
        return "de" if any(c in low for c in TELLING["de"]) or 10 * sum(w in GERMAN.split() for w in words) > len(words) else "en"
    return most


def _closes(ch: str, opener: str) -> bool:
    if ch == '"':
        return opener == '"'
    if ch in "“‟":
        return opener in "„‚"
    if ch == "«":
        return opener == "»"
    return ch in CLOSE


class _Paragraph:
    """One paragraph: text[begin:end] without outer white space, and its sentence ends."""

    def __init__(self, text: str, begin: int, end: int, caseless: bool, greek: bool, rules: dict[str, frozenset[str]], signs: list[int]) -> None:
        self.text, self.begin, self.end, self.caseless, self.greek, self.rules = text, begin, end, caseless, greek, rules
        self.signs = signs  # places of / and @

    def ends(self, at: list[int], cls: list[int], sure: list[bool], token: list[int], stop: list[int], quoted: bool) -> list[int]:
        """Ends among the marks ``at``, sorted, of classes ``cls``, each in the text between ``token`` and ``stop``; ``sure``
        ends where no quotation or bracket is open."""
        text, end = self.text, self.end
        found: list[int] = []
        start = self.begin
        quotes: list[tuple[int, str]] = []
        brackets: list[int] = []
        partner = self._partners(at, cls) if quoted else {}
        m, n = 0, len(at)
        past = self.begin
        while m < n:
            i, c = at[m], cls[m]
            m += 1
            if i < past:
                continue
            if sure[m - 1] and not quotes and not brackets and not self.caseless:
                found.append(i + 1)
                start = i + 2
                while start < end and text[start].isspace():
                    start += 1
                past = i + 1
                continue
            ch = text[i]
            self.token, self.stop = token[m - 1], stop[m - 1]
            if c & OPENS:
                brackets.append(i)
                continue
            if c & CLOSES:
                if brackets:
                    brackets.pop()
                continue
            if c & QUOTE:
                if quotes and _closes(ch, quotes[-1][1]):
                    quotes.pop()
                else:
                    quotes.append((i, ch))
                continue
            j = i + 1
            run = [c]
            while m < n and at[m] == j and cls[m] & (END | SEMI):
                run.append(cls[m])
                j += 1
                m += 1
            if all(x & SEMI for x in run) and not (self.greek and (";" in text[i:j] or self._greek_question(i))):
                continue
            # closing marks right after the terminators belong to the sentence they end
            k, in_quotes, in_brackets = j, None, None
            while m < n and at[m] == k:
                x = cls[m]
                if x & CLOSES and brackets:
                    in_brackets = brackets.pop()
                elif x & QUOTE and quotes and _closes(text[k], quotes[-1][1]):
                    in_quotes = quotes.pop()[0]
                elif not (x & END and k > j):
                    break
                k += 1
                m += 1
            inside = any(partner.get(q, -1) >= k for q, _ in quotes)
            if self._ends_here(start, i, j, k, in_quotes, in_brackets, bool(quotes), inside, run[0]):
                found.append(k)
                start = k
                while start < end and text[start].isspace():
                    start += 1
                quotes, brackets = [], []
            past = k
        return found

    def _partners(self, at: list[int], cls: list[int]) -> dict[int, int]:
        """The closing mark of each quotation mark that is closed in the paragraph, matched innermost first."""
        open_, partner = [], {}
        for i, c in zip(at, cls, strict=True):
            if c & QUOTE:
                if open_ and _closes(self.text[i], open_[-1][1]):
                    partner[open_.pop()[0]] = i
                else:
                    open_.append((i, self.text[i]))
        return partner

    def _greek_question(self, i: int) -> bool:
        k = i - 1
        while k >= self.begin and self.text[k].isspace():
            k -= 1
        return k >= self.begin and bool(_class(self.text[k]) & GREEK)

    def _follows(self, k: int) -> tuple[bool, str, int]:
        """Is there a blank after ``k``, the next visible character ('' at the end) and its place."""
        text, end = self.text, self.end
        blank = False
        while k < end and (text[k].isspace() or _class(text[k]) & HIDDEN):
            blank |= text[k].isspace()
            k += 1
        return blank, (text[k] if k < end else ""), k

    def _ends_here(self, start: int, i: int, j: int, k: int, quoted: int | None, bracketed: int | None, open_: bool, inside: bool, kind: int) -> bool:
        text = self.text
        blank, nxt, at = self._follows(k)
        if not nxt:
            return True
        if _class(nxt) & GOES or (nxt == "-" and blank):
            return False
        bare = nxt
        if _class(nxt) & (QUOTE | OPENS) and nxt not in CLOSE and at + 1 < self.end:
            bare = self._follows(at + 1)[1] or nxt
        goes_on = any(text.startswith(w, at) for w in self.rules["carry"])
        if quoted is not None or bracketed is not None:
            opened = min(x for x in (quoted, bracketed) if x is not None)
            first = opened <= start
            if goes_on:
                return False
            if self.caseless or not (bare.isupper() or bare.islower()):
                # without capital letters: a quotation that begins the sentence is followed by who said it,
                # one that was introduced ends the sentence; brackets the other way round
                return first if bracketed is not None and quoted is None else not first
            return not bare.islower()
        if open_ and not kind & WIDE and blank and bare.islower():
            return False
        if inside:
            return False
        if kind & WIDE:
            return True
        run = text[i:j]
        if run[0] == "…" or len(run) > 1 and set(run) <= {".", "…"}:
            if goes_on:
                return False
            if self.caseless:
                return not bare.islower() or text[start : min(i, start + _LONGEST)].strip().lower() not in self.rules["pause"]
            return not bare.islower()
        if not kind & FULL or len(run) > 1:
            return self.caseless or not bare.islower()
        return self._full_stop(start, i, k, blank, nxt, bare, at)

    def _full_stop(self, start: int, i: int, k: int, blank: bool, nxt: str, bare: str, at: int) -> bool:
        text, rules, token = self.text, self.rules, self.token
        last = i - 1
        while last >= start and _class(text[last]) & HIDDEN:
            last -= 1
        digit = last >= start and text[last].isdigit()
        if not blank:
            if nxt.isdigit() and digit:
                return False
            if not nxt.isupper() and self._address(max(token, start), i, at, min(self.stop, self.end)):
                return False
        if i - token <= _LONGEST:
            before = text[max(start, token - 8) : i]
            word = _WORD_BEFORE.search(before)
            numbered = _NUMBER_BEFORE.search(before)
            if numbered:
                following = _NEXT_WORD.match(text, at)
                if following and following.group().lower() in rules["days"]:
                    return False
                if "." in numbered.group(1) and self.caseless and not nxt.isdigit():
                    return False
            pair = _PAIR_BEFORE.search(before)
            if pair:
                both = f"{pair.group(1)} {pair.group(2)}".lower()
                if both in rules["pairs_on"]:
                    return False
                if both in rules["pairs_end"]:
                    return self.caseless or not bare.islower()
            if word:
                told = self._abbreviation(_HIDE.sub("", word.group()), before[: word.start()], start, i, blank, nxt, bare)
                if told is not None:
                    return told
        if not blank and not self.caseless:
            return bare.isupper() or nxt.isdigit() and not digit or not bare.isalnum()
        return self.caseless or not bare.islower()

    def _address(self, token: int, i: int, at: int, stop: int) -> bool:
        """Is the full stop at ``i`` within an address of the web?"""
        if self.signs and bisect_left(self.signs, max(i, stop)) > bisect_left(self.signs, token):
            return True
        near = lambda x, y: self.text[x : min(y, x + _LONGEST)] if y - x <= _LONGEST else ""
        return bool(_WEB.match(near(at, stop)) or _WEB.match(near(token, i) + "."))

    def _abbreviation(self, word: str, ahead: str, start: int, i: int, blank: bool, nxt: str, bare: str) -> bool | None:
        """What the word before a full stop says: True for an end, False for none, None if nothing."""
        rules, caseless = self.rules, self.caseless
        w = word.lower()
        on = w in rules["on"] or w in rules["title"] and (caseless or word[0].isupper())
        if on and not (w in rules["number"] and w not in ("т", "ст") and not nxt.isdigit() and bare.isupper()):
            if w != "т" or not bare.isupper() or caseless:
                return False
        if w in rules["number"] and nxt.isdigit():
            return False
        if w in rules["list"]:
            return caseless or not bare.islower()
        if w in rules["unit"]:
            amount = ahead.rstrip()
            if caseless:
                return w == "г" and not _YEAR_BEFORE.search(amount)
            if w == "г" and nxt != bare:
                return not _YEAR_BEFORE.search(amount)
            if not bare.isupper() or nxt != bare:
                return False
            return not (w in rules["time"] and len(self.text[start:i].split(None, 5)) <= 4)
        if len(w) == 1 and not blank:
            return False
        if len(w) == 1 and w.isalpha() and word[-1].isupper() and not caseless and blank and bare.isupper() and not ahead.strip():
            return False  # initial of a name
        return None


@lru_cache(maxsize=1 << 14)
def _class(ch: str) -> int:
    return int(classes()[ord(ch)]) if ord(ch) < TOP else 0


class _Batch:
    """Classes and runs over all code points of a batch of texts."""

    def __init__(self, points: np.ndarray) -> None:
        c = classes()[np.minimum(points, TOP - 1)]
        n = len(points)
        self.cls = c
        space = (c & SPACE) > 0
        letter = (c & LETTER) > 0
        marks = np.flatnonzero(c & (END | SEMI | QUOTE | OPENS | CLOSES))
        # a full stop between two digits is none
        sides = (c[np.maximum(marks - 1, 0)] & c[np.minimum(marks + 1, n - 1)] & DIGIT) > 0 if n else marks > 0
        self.marks = marks[~(((c[marks] & FULL) > 0) & sides & (marks > 0) & (marks < n - 1))]
        self.spaces = np.flatnonzero(space)
        self.signs = np.flatnonzero((points == 0x2F) | (points == 0x40))
        self.upper = np.concatenate([[0], np.cumsum((c & UPPER) > 0)])
        self.lower = np.concatenate([[0], np.cumsum((c & LOWER) > 0)])
        self.thai = np.concatenate([[0], np.cumsum((c & THAI) > 0)])
        self.greek = np.concatenate([[0], np.cumsum((c & GREEK) > 0)])
        # the beginning of the token around each mark, and the next blank; letters in a row before it, and what follows
        place = np.arange(n)
        m = self.marks
        s = np.searchsorted(self.spaces, m)
        edge = np.concatenate([[-1], self.spaces, [n]])
        self.token, self.stop = edge[s] + 1, edge[s + 1]
        run = place - np.maximum.accumulate(np.where(letter, -1, place))
        before = np.where(m > 0, run[np.maximum(m - 1, 0)], 0) * (m > 0)
        at = lambda d: c[np.minimum(m + d, n - 1)] * (m + d < n)
        one_blank = ((at(1) & SPACE) > 0) & ((at(2) & UPPER) > 0)
        ends = (c[m] & END) > 0
        plain = ends & ((c[m] & (FULL | WIDE)) == 0) & (points[m] != 0x2026)
        self.sure = one_blank & (plain & (np.where(m > 0, c[np.maximum(m - 1, 0)] & (END | SEMI), 0) == 0))
        self.word = one_blank & ((c[m] & FULL) > 0) & (before >= 2)
        self.before = before
        # what follows terminators after words of four letters: does case tell anything?
        asked = ends & np.isin(points[m], [0x21, 0x3F, 0x2E]) & (before >= 4) & ((at(1) & SPACE) > 0)
        follow = m + 1
        if len(self.spaces):
            notspace = np.where(space, n, place)
            after = np.minimum.accumulate(notspace[::-1])[::-1] if n else notspace
            follow = after[np.minimum(m + 1, n - 1)] if n else follow
        nxt = np.where(follow < n, c[np.minimum(follow, max(n - 1, 0))], 0) if n else np.zeros(0, np.uint16)
        asked &= (nxt & LETTER) > 0
        self.asked = np.concatenate([[0], np.cumsum(asked)])
        self.capital = np.concatenate([[0], np.cumsum(asked & ((nxt & UPPER) > 0))])


def _caseless(batch: _Batch, a: int, b: int, m0: int, m1: int) -> bool:
    """Does case tell nothing here: no capitals, nearly all capitals, or small letters after most sentence ends?"""
    upper, lower = int(batch.upper[b] - batch.upper[a]), int(batch.lower[b] - batch.lower[a])
    if not upper + lower:
        return False
    if not upper or upper > 0.7 * (upper + lower):
        return True
    after = int(batch.asked[m1] - batch.asked[m0])
    return after >= 2 and int(batch.capital[m1] - batch.capital[m0]) <= 0.3 * after


def _thai_cuts(text: str, begin: int, stop: int, cls: np.ndarray, base: int) -> list[int]:
    """Blanks of text[begin:stop] that end a Thai sentence."""
    c = cls[base + begin : base + stop]
    space = (c & SPACE) > 0
    firsts = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    cuts = []
    for f in firsts.tolist():
        e = f
        while e < len(space) and space[e]:
            e += 1
        if e >= len(space):
            break
        left, right = text[begin + f - 1], text[begin + e]
        told = (c[f - 1] | c[e]) & (DIGIT | UPPER | LOWER)
        if not told and (c[f - 1] | c[e]) & THAI and not _latin(left) and not _latin(right):
            cuts.append(begin + f)
    return cuts


def _latin(ch: str) -> bool:
    return ch.isdigit() or (ch.isalpha() and "LATIN" in unicodedata.name(ch, ""))


def _spans(text: str, lang: str | None, batch: _Batch, base: int) -> list[tuple[int, int]]:
    rules = _rules(language(lang, text))
    m_all = batch.marks
    lo, hi = np.searchsorted(m_all, (base, base + len(text)))
    g0, g1 = np.searchsorted(batch.signs, (base, base + len(text)))
    at = m_all[lo:hi] - base
    cls = batch.cls[m_all[lo:hi]]
    sure = batch.sure[lo:hi].copy()
    length = batch.before[lo:hi]
    for x in np.flatnonzero(batch.word[lo:hi]).tolist():  # full stops after a word, before a capital letter
        i = int(at[x])
        n = min(int(length[x]), i)
        if n > _LONGEST or text[i - n : i].lower() not in rules["any"]:
            sure[x] = n > 1 and (i == n or not text[i - n - 1] in ".-­​‌‍⁠" and not batch.cls[base + i - n - 1] & HIDDEN)
    places, kinds, sure = at.tolist(), cls.tolist(), sure.tolist()
    token, stops = np.maximum(batch.token[lo:hi] - base, 0).tolist(), np.minimum(batch.stop[lo:hi] - base, len(text)).tolist()
    quotes, signs = np.flatnonzero(cls & QUOTE).tolist(), (batch.signs[g0:g1] - base).tolist()
    spans: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))

    begin = 0
    breaks = list(PARAGRAPH.finditer(text)) if "\n" in text else []
    for m in [*breaks, None]:
        end = m.start() if m else len(text)
        stop = end
        while begin < stop and text[begin].isspace():
            begin += 1
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if begin < stop:
            a, b = bisect_left(places, begin), bisect_left(places, stop)
            caseless = _caseless(batch, base + begin, base + stop, lo + a, lo + b)
            greek = bool(batch.greek[base + stop] - batch.greek[base + begin])
            quoted = bisect_left(quotes, b) > bisect_left(quotes, a)
            ends = _Paragraph(text, begin, stop, caseless, greek, rules, signs).ends(places[a:b], kinds[a:b], sure[a:b], token[a:b], stops[a:b], quoted)
            if batch.thai[base + stop] - batch.thai[base + begin]:
                ends = sorted({*ends, *_thai_cuts(text, begin, stop, batch.cls, base)})
            x = begin
            for y in ends:
                add(x, y)
                x = y
            add(x, stop)
        if m:
            begin = m.end()
    return spans


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Code-point spans of the sentences of a text, without outer white space; none for null, empty or blank text.

    ``lang`` names the language of its abbreviations; where it is missing or unknown it is told from the text. A
    paragraph in which case tells nothing (all small, all capital) is read without help of case.
    """
    if not text or not text.strip():
        return []
    return _spans(text, lang, _Batch(_points(text)), 0)


#: Between the texts of a batch, so that no mark sees a neighbour of another text.
_GAP = "\0\0\0"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        which: list[int] = []
        a: list[int] = []
        b: list[int] = []
        texts = batch.column(1).to_pylist()
        held = _Batch(_points(_GAP.join(t or "" for t in texts)))
        base = 0
        for i, (text, lang) in enumerate(zip(texts, batch.column(2).to_pylist(), strict=True)):
            for x, y in _spans(text, lang, held, base) if text and not text.isspace() else ():
                which.append(i)
                a.append(x)
                b.append(y)
            base += len(text or "") + len(_GAP)
        yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int32())), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "char_from", "char_until"])


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row (``key``, ``char_from``, ``char_until``) per sentence: 0-based code points, end exclusive.

    There is no exchange: each partition splits its own documents. ``lang`` may be spelled in any case and with a region, or be
    missing, also as a column. Null, empty and blank texts have no sentences; rows with one key each give their
    sentences; an empty table gives an empty result; other columns do not matter.
    """
    kind = df.schema[key].dataType.simpleString()
    named = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), named.alias("lang")).mapInArrow(_split, f"key {kind}, char_from int, char_until int").withColumnRenamed("key", key)
