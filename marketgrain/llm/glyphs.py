"""One ordinary spelling for text that looks alike but differs in its characters.

Arrow text becomes one numpy array of code points per batch; everything after that is table gathers, expansion offsets
and reductions over the whole array, with no string call per row:

1. a table maps each code point to its ordinary form: normal width, plain blank, plain hyphen, ligatures in letters,
   nothing for what is invisible;
2. combining marks are composed with the letter before them, pair by pair, by a search in the sorted table of pairs;
3. runs of blanks become one, outer ones go;
4. a word is written in the one alphabet in which the catalogue otherwise writes it: words are hashed, counted over all
   rows, and a word of mixed letters, or one that could be read in two alphabets, takes the reading that is at home.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.session import cut

LATIN, CYRILLIC, GREEK = 0, 1, 2
TOP = 0x30000
BLANK, HYPHEN = 0x20, 0x2D
# Letters of one shape in Latin, Cyrillic and Greek, in that order, case by case ("." for none).
SHAPES = (
    "AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ "
    "aаα cс. eе. iіι jј. oоο pрρ sѕ. v.ν xхχ yу. u.υ"
).split()
#: A reading must be this many times as frequent as the one that stands there, to replace a word of one alphabet.
AT_HOME = 4


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over code points, made by rule from the character database."""
    width = np.ones(TOP, np.int8)  # length of the ordinary form
    forms = np.zeros((TOP, 4), np.uint32)
    forms[:, 0] = np.arange(TOP)
    letter = np.zeros(TOP, bool)
    script = np.zeros(TOP, np.uint8)  # bit per alphabet
    lower = np.arange(TOP, dtype=np.uint32)
    mark = np.zeros(TOP, bool)
    pairs: list[tuple[int, int, int]] = []
    for cp in range(TOP):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        letter[cp] = kind[0] in "LM"
        mark[cp] = kind[0] == "M"
        if kind[0] == "L" and cp < 0x2E80:
            name = unicodedata.name(ch, "")
            script[cp] = 1 * name.startswith("LATIN") + 2 * name.startswith("CYRILLIC") + 4 * name.startswith("GREEK")
        low = ch.lower()
        lower[cp] = ord(low) if len(low) == 1 else cp
        plain = None
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            plain = ""
        elif kind in ("Zs", "Zl", "Zp") or cp in (9, 10, 11, 12, 13, 0x85):
            plain = " "
        elif cp in (0x2010, 0x2011, 0xFE63, 0xFF0D):
            plain = "-"
        elif 0xFF01 <= cp <= 0xFFEE or 0xFB00 <= cp <= 0xFB4F or 0x1D400 <= cp <= 0x1D7FF or 0x2160 <= cp <= 0x217F:
            plain = unicodedata.normalize("NFKC", ch)
        elif unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<"):
            both = unicodedata.normalize("NFD", ch)
            single = unicodedata.normalize("NFC", ch)
            if single == ch:
                first, last = unicodedata.normalize("NFC", both[:-1]), both[-1]
                if len(first) == 1:
                    pairs.append((ord(first), ord(last), cp))
            else:
                plain = single
        if plain is not None and len(plain) <= 4:
            width[cp] = len(plain)
            for i, c in enumerate(plain):
                forms[cp, i] = ord(c)
    pairs.sort()
    reading = np.zeros((3, TOP), np.uint32)  # the letter in an alphabet, 0 where it has none of that shape
    for s in range(3):
        own = (script & (1 << s)) > 0
        reading[s, own] = np.flatnonzero(own)
        # marks and letters of no alphabet of the three belong to any
        reading[s, letter & (script == 0)] = np.flatnonzero(letter & (script == 0))
    for shape in SHAPES:
        for a in shape:
            for s, b in enumerate(shape):
                if a != "." and b != ".":
                    reading[s, ord(a)] = ord(b)
    key = np.array([a * TOP + b for a, b, _ in pairs], np.int64)
    return {"width": width, "forms": forms, "letter": letter, "script": script, "lower": lower, "mark": mark, "reading": reading, "pair": key, "made": np.array([c for _, _, c in pairs], np.uint32)}


def to_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and the offsets of the strings in them (null is empty)."""
    text = text.cast(pa.large_string())
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if text.null_count:
        text = text.fill_null("")
    _, at, data = text.buffers()
    offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1] if at is not None and len(text) else np.zeros(len(text) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    count = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, count[offsets - offsets[0]]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (at least a row), as arrays of code points take many
    times the memory of the text.
    """
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // most
    begins = np.flatnonzero(np.diff(run, prepend=-1))
    for a, b in zip(begins, np.append(begins[1:], len(sizes)), strict=True):
        yield batch.slice(int(a), int(b - a))


def from_points(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings of the code points between the offsets."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data)).cast(pa.string())


def _of(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Table entries of code points; those beyond the tables have the entry of the unassigned last one."""
    return table[np.minimum(points, TOP - 1)]


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def ordinary(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary width, blanks, hyphens and composed characters (steps 1 to 3)."""
    t, n = tables(), len(offsets) - 1
    rows = _rows(offsets)
    size = _of(t["width"], points).astype(np.int64)
    far = points >= TOP
    size[far & (points >= 0xE0000) & (points <= 0xE01EF)] = 0  # tags and variation selectors
    if (size != 1).any() or (_of(t["forms"][:, 0], points) != points).any():
        source = np.repeat(np.arange(len(points)), size)
        within = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
        old = points[source]
        rows, points = rows[source], np.where(old >= TOP, old, t["forms"][np.minimum(old, TOP - 1), within])
    while _of(t["mark"], points).any():
        pair = points[:-1].astype(np.int64) * TOP + points[1:]
        found = np.minimum(np.searchsorted(t["pair"], pair), len(t["pair"]) - 1)
        hit = (t["pair"][found] == pair) & (rows[:-1] == rows[1:]) & (points[1:] < TOP)
        hit[1:] &= ~hit[:-1]  # one mark at a time
        if not hit.any():
            break
        points = points.copy()
        at = np.flatnonzero(hit)
        points[at] = t["made"][found[at]]
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        points, rows = points[keep], rows[keep]
    blank = points == BLANK
    first = np.ones(len(points), bool)
    first[1:] = rows[1:] != rows[:-1]
    last = np.append(first[1:], True) if len(points) else first
    after = np.zeros(len(points), bool)
    after[1:] = blank[:-1]
    keep = ~(blank & (first | after))
    points, rows = points[keep], rows[keep]
    last = np.ones(len(points), bool)
    last[:-1] = rows[1:] != rows[:-1]
    keep = ~(last & (points == BLANK))
    points, rows = points[keep], rows[keep]
    return points, _offsets(rows, n)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in an odd base over the code points, mixed once more."""
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _BASE, np.uint64))
    terms = (values.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) * powers[place]
    h = np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Words:
    """The words of a batch: where they start, their alphabets, hashes and possible readings."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray) -> None:
        t = tables()
        rows = _rows(offsets)
        is_letter = _of(t["letter"], points)
        begin = is_letter.copy()
        begin[1:] &= ~(is_letter[:-1] & (rows[1:] == rows[:-1]))
        index = np.flatnonzero(is_letter)
        letters = points[index]
        self.starts = np.flatnonzero(begin)  # in points
        at = np.flatnonzero(begin[index])  # in letters
        word = np.cumsum(begin[index]) - 1
        place = np.arange(len(index)) - at[word] if len(index) else index
        self.rows = rows[self.starts]
        self.place = self.starts - offsets[self.rows]
        self.length = np.diff(np.append(at, len(index)))
        bits = t["script"][letters]
        self.scripts = np.bitwise_or.reduceat(bits, at) if len(at) else bits
        self.own = np.where(self.scripts == 1, LATIN, np.where(self.scripts == 2, CYRILLIC, np.where(self.scripts == 4, GREEK, -1)))
        self.form = _hash(letters, at, place)
        low = t["lower"][letters]
        self.low = _hash(low, at, place)
        self.reading, self.possible, self.share = [], [], []
        for s in range(3):
            as_s = t["reading"][s, letters]
            self.possible.append(np.minimum.reduceat(as_s, at) > 0 if len(at) else as_s > 0)
            self.reading.append(_hash(t["lower"][as_s], at, place))
            self.share.append(np.add.reduceat((bits == (1 << s)).astype(np.int32), at) if len(at) else as_s)
        self.pure = self.own >= 0
        others = sum((self.possible[s] & (self.own != s)).astype(int) for s in range(3))
        #: words of mixed letters, and words of one alphabet that could be read in another
        self.odd = (~self.pure & (self.scripts > 0) & (others > 0)) | (self.pure & (others > 0))


_COUNT = "kind int, h long, script int, reading long, own int, share int, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: counts of pure words (kind 0: h, script) and the readings of odd ones (kind 1)."""
    for batch in (part for whole in batches for part in slices(whole, 0)):
        w = Words(*to_points(batch.column(0)))
        out: list[list[np.ndarray]] = []
        key = np.stack([w.low[w.pure], w.own[w.pure]])
        if key.size:
            (h, own), n = np.unique(key, axis=1, return_counts=True)
            z = np.zeros(len(h), np.int64)
            out.append([z, h, own, z, z, z, n])
        for s in range(3):
            pick = w.odd & w.possible[s]
            key = np.stack([w.form[pick], w.reading[s][pick], w.own[pick], w.share[s][pick]])
            if key.size:
                h, reading, own, share = np.unique(key, axis=1)
                one = np.ones(len(h), np.int64)
                out.append([one, h, one * s, reading, own, share, one])
        if out:
            c = [np.concatenate([x[i] for x in out]) for i in range(7)]
            yield pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3]), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int32()), pa.array(c[6])], ["kind", "h", "script", "reading", "own", "share", "n"])


def home_alphabets(df: DataFrame, text: str) -> DataFrame:
    """Rows (form, home): word forms of ``text``, in composed characters of normal width (steps 1 to 3), that are not written
    in the alphabet where they are at home.

    Counts cover all rows. A word of one alphabet is moved only to a reading that is AT_HOME times as frequent; a word of
    mixed letters goes to its most frequent reading, with no reading known to the alphabet of most of its letters.
    """
    parts = df.select(text).mapInArrow(_count_words, _COUNT)
    words = parts.groupBy("kind", "h", "script", "reading", "own", "share").agg(F.sum("n").alias("n"))
    words = cut(words)
    pure = words.where("kind = 0").select(F.col("h").alias("reading"), F.col("script"), F.col("n").alias("seen"))
    odd = words.where("kind = 1").select(F.col("h").alias("form"), "script", "reading", "own", "share")
    known = odd.join(pure, ["reading", "script"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    best = known.groupBy("form", "own").agg(F.max(F.struct("seen", "share", (-F.col("script")).alias("s"))).alias("b"), F.max(F.when(F.col("script") == F.col("own"), F.col("seen"))).alias("here"))
    home = -F.col("b.s")
    moved = F.when(F.col("own") < 0, F.lit(True)).otherwise((home != F.col("own")) & (F.col("b.seen") >= AT_HOME * F.coalesce("here", F.lit(0))) & (F.col("b.seen") > 0))
    return best.where(moved).select("form", home.cast("int").alias("home"))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps 1 to 3 of each row, and its odd words as (place, length, form)."""
    for batch in (part for whole in batches for part in slices(whole, 1)):
        points, offsets = to_points(batch.column(1))
        new, at = ordinary(points, offsets)
        w = Words(new, at)
        odd = np.flatnonzero(w.odd)
        n = len(offsets) - 1
        lists = _offsets(w.rows[odd], n).astype(np.int32)
        item = pa.StructArray.from_arrays([pa.array(w.place[odd].astype(np.int32)), pa.array(w.length[odd].astype(np.int32)), pa.array(w.form[odd])], ["place", "length", "form"])
        words = pa.ListArray.from_arrays(pa.array(lists), item)
        spelled = from_points(new, at)
        nulls = batch.column(1).is_null()
        if batch.column(1).null_count:
            spelled = pa.compute.if_else(nulls, pa.scalar(None, pa.string()), spelled)
        yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.string()), spelled, words], ["row", "text", "spelled", "words"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlay of the words' home letters: (row, text, spelled, moves) to (row, text, spelled)."""
    t = tables()
    for batch in (part for whole in batches for part in slices(whole, 2)):
        points, offsets = to_points(batch.column(2))
        points = points.copy()
        moves = batch.column(3)
        if moves.null_count < len(moves):
            item, rows = moves.flatten(), np.repeat(np.arange(len(moves)), np.nan_to_num(pa.compute.list_value_length(moves).to_numpy(zero_copy_only=False).astype(float)).astype(int))
            place, length, home = (item.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            index = np.repeat(offsets[rows] + place, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            points[index] = t["reading"][np.repeat(home, length), points[index]]
        spelled = from_points(points, offsets)
        if batch.column(2).null_count:
            spelled = pa.compute.if_else(batch.column(2).is_null(), pa.scalar(None, pa.string()), spelled)
        yield pa.record_batch([batch.column(0), batch.column(1).cast(pa.string()), spelled], ["row", "text", "spelled"])


def ordinary_spelling(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, ``spelled`` (the ordinary spelling) and ``differs`` for every row of ``df``.

    A null text stays null and does not differ; an empty text, or one of invisible characters only, becomes empty. Rows
    repeated in full, or sharing a key, each get their result. Texts of any length are processed whole. An empty table
    gives an empty result. A word with no reading in one alphabet (letters of two that have no common shape) stays.
    """
    rows = df.select(F.struct(F.col(key).alias("key")).alias("row"), F.col(text).alias("text"))
    words = "words array<struct<place: int, length: int, form: bigint>>"
    spelled = rows.mapInArrow(_spell, f"row struct<key: {df.schema[key].dataType.simpleString()}>, text string, spelled string, {words}")
    spelled = cut(spelled.withColumn("at", F.monotonically_increasing_id()))
    home = home_alphabets(spelled, "spelled")  # the written rows: texts are read and made ordinary once
    odd = spelled.where(F.size("words") > 0).select("at", F.explode("words").alias("w")).select("at", "w.place", "w.length", "w.form")
    moves = odd.join(home, "form").groupBy("at").agg(F.collect_list(F.struct("place", "length", "home")).alias("moves"))
    both = spelled.select("at", "row", "text", "spelled").join(moves, "at", "left").select("row", "text", "spelled", "moves")
    done = both.mapInArrow(_rewrite, f"row struct<key: {df.schema[key].dataType.simpleString()}>, text string, spelled string")
    return done.select(F.col("row.key").alias(key), F.col("text").alias(text), "spelled", F.coalesce(F.col("text") != F.col("spelled"), F.lit(False)).alias("differs"))
