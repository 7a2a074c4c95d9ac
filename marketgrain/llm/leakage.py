"""Held-out test items that stand, in whole or in part, in the documents of a corpus.

Items and documents are read as streams of folded letters and digits (no case, blanks, punctuation or character forms).
The q-grams a document shares with an item are counted in overlapping diagonal bands; by the q-gram lemma a stretch of
half the item within the edit budget leaves a known number of them in one band. Bands that reach it are verified by an
alignment that counts changed words, run for all candidates of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.glyphs import SHAPES, TOP, _of, _rows, ordinary, slices, tables, to_points

#: Most test items that are sent to every executor (their grams are a few kilobytes an item).
MOST_ITEMS = 20000
#: Least width of a diagonal band, in letters.
BAND = 48
#: Longest q-grams of items in letters and in Han characters; shorter where a stretch that counts may have fewer letters.
GRAM, HAN_GRAM = 6, 4
_HAN = 1 << 20


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Code point to folded letter or digit, 0 for all others."""
    t = tables()
    fold = np.where(t["letter"], t["lower"], 0).astype(np.uint32)
    import unicodedata

    for cp in range(TOP):
        if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp))[0] == "N":
            digit = unicodedata.decimal(chr(cp), None)
            fold[cp] = ord("0") + digit if digit is not None else cp
    for shape in SHAPES:  # look-alikes in either case are one letter
        one = ord(shape[0].lower())
        for ch in shape[1:]:
            if ch != ".":
                for c in (ch, ch.lower()):
                    fold[ord(c)] = one
    fold[ord("ς")] = fold[ord("σ")]
    return fold


def stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of all texts, their rows, offsets of the rows, and the number of each letter's word."""
    points, offsets = ordinary(*to_points(text))
    rows = _rows(offsets)
    folded = _of(_folds(), points)
    kept = folded > 0
    begins = kept.copy()
    begins[1:] &= ~(kept[:-1] & (rows[1:] == rows[:-1]))
    begins |= kept & _han(points)  # each Han character counts as a word
    word = np.cumsum(begins)
    n = len(offsets) - 1
    rows = rows[kept]
    return folded[kept], rows, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), word[kept]


def _han(points: np.ndarray) -> np.ndarray:
    return (points >= 0x3400) & (points <= 0x9FFF) | (points >= 0x20000)


def _grams(letters: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(len(letters) - q + 1, 0), np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[i : i + len(h)].astype(np.uint64)
    return h ^ (h >> np.uint64(31))


@dataclass
class ItemIndex:
    """The items' letters, words and q-grams. An item's ``q`` is HAN_GRAM for Han characters, else GRAM, but no more than
    the letters of its shortest stretch that counts, so that short items are found whole."""

    ids: list
    letters: list[np.ndarray]
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by q: sorted grams, their ranges, items, places
    filters: dict[int, np.ndarray]
    least: np.ndarray  # grams that a band must hold
    bands: np.ndarray  # width of the item's bands: letters that its changed words may shift what follows

    @staticmethod
    def of(ids: list, texts: list[str | None], part: float, budget: float) -> ItemIndex:
        letters, _, at, word = stream(pa.array(texts, pa.string()))
        each = [letters[at[i] : at[i + 1]] for i in range(len(ids))]
        words = [word[at[i] : at[i + 1]] - (word[at[i]] if at[i] < at[i + 1] else 0) for i in range(len(ids))]
        han = [len(x) > 0 and _han(x).mean() > 0.5 for x in each]
        size = [min(HAN_GRAM if h else GRAM, _shortest(w, part)) for h, w in zip(han, words, strict=True)]
        grams, filters = {}, {}
        for q in sorted({q for q in size if q}):
            parts = [(i, _grams(x, q)) for i, x in enumerate(each) if size[i] == q]
            g = np.concatenate([x for _, x in parts] or [np.zeros(0, np.uint64)])
            item = np.concatenate([np.full(len(x), i) for i, x in parts] or [np.zeros(0, int)]).astype(np.int64)
            place = np.concatenate([np.arange(len(x)) for _, x in parts] or [np.zeros(0, int)])
            order = np.argsort(g, kind="stable")
            g, item, place = g[order], item[order], place[order]
            values, first = np.unique(g, return_index=True)
            grams[q] = (values, np.append(first, len(g)), item, place)
            filters[q] = np.zeros(_HAN, bool)
            filters[q][(values & np.uint64(_HAN - 1)).astype(np.int64)] = True
        # a stretch of m letters with e changed words keeps m - q + 1 - e * (letters of a word + q - 1) grams
        least = []
        for i, x in enumerate(each):
            q = size[i]
            m = part * len(x)
            each_word = len(x) / max(1, words[i][-1] + 1) if len(x) else 1
            changed = budget * m / each_word
            least.append(max(1.0, m - q + 1 - changed * (each_word + q - 1)))
        bands = np.array([max(BAND, 2 * int(np.ceil(budget * part * len(x) / 2)) * 2) for x in each], np.int64)
        return ItemIndex(list(ids), each, words, grams, filters, np.array(least), bands)


def _shortest(words: np.ndarray, part: float) -> int:
    """Letters of the shortest run of ``part`` of an item's words, given the number of each letter's word."""
    if not len(words):
        return 0
    sizes = np.bincount(words)
    run = int(np.ceil(part * len(sizes)))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return int((ends[run:] - ends[: len(ends) - run]).min())


def _candidates(index: ItemIndex, letters: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, middle diagonal, grams) of the bands that hold enough grams."""
    found = []
    for q, (values, ranges, items, places) in index.grams.items():
        if not len(values) or len(letters) < q:
            continue
        h = _grams(letters, q)
        maybe = np.flatnonzero(index.filters[q][(h & np.uint64(_HAN - 1)).astype(np.int64)] & (rows[: len(h)] == rows[q - 1 :]))
        where = np.minimum(np.searchsorted(values, h[maybe]), len(values) - 1)
        hit = values[where] == h[maybe]
        maybe, where = maybe[hit], where[hit]
        many = ranges[where + 1] - ranges[where]
        source = np.repeat(np.arange(len(maybe)), many)
        slot = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ranges[where], many)
        item, row = items[slot], rows[maybe[source]].astype(np.int64)
        diagonal = maybe[source] - at[row] - places[slot]
        width = index.bands[item]
        for half in (0, 1):
            shift = half * (width // 2)
            band = (diagonal + shift) // width
            key = (row * len(index.ids) + item) * (1 << 28) + (band + (1 << 27))
            keys, n = np.unique(key, return_counts=True)
            b, pair = (keys & ((1 << 28) - 1)) - (1 << 27), keys >> 28
            enough = n >= index.least[pair % len(index.ids)]
            of = pair[enough] % len(index.ids)
            wide = index.bands[of]
            found.append(np.stack([pair[enough] // len(index.ids), of, b[enough] * wide - half * (wide // 2) + wide // 2, n[enough]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(found, axis=1))


def stretches(index: ItemIndex, letters: np.ndarray, word: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, middle: np.ndarray, part: float, budget: float, width: int = BAND) -> np.ndarray:
    """Share of the item's words in the longest stretch that the band of each candidate holds, 0 below ``part``.

    A stretch begins and ends with words that stand letter for letter in the text, wherever its blanks are; between them
    at most ``budget`` of its words are changed, and seen from either end never more than half, so that a word which
    stands there by chance prolongs nothing. A word changed, left out or put in counts one; a word changed into
    several, their number. Where the text has no blanks to find the next word by, a letter counts its part of a word.
    Alignments from every possible first word are kept side by side, so nothing is cut off at a changed word.
    """
    n, size, far = len(row), 2 * width + 1, np.float32(1e6)
    total = np.array([index.words[i][-1] + 1 for i in item], np.int64)
    lengths = np.array([len(index.letters[i]) for i in item], np.int64)
    longest, most = int(lengths.max()), int(total.max())
    own = np.zeros((n, longest), np.int64)
    ends = np.zeros((n, most + 1), np.int64)  # letters before each word
    for k, i in enumerate(item):
        own[k, : lengths[k]] = index.letters[i]
        ends[k, 1 : total[k] + 1] = np.cumsum(np.bincount(index.words[i], minlength=total[k]))
        ends[k, total[k] + 1 :] = lengths[k]
    first, end = at[row][:, None], at[row + 1][:, None]
    j = first + middle[:, None] + np.arange(-width, width + 1)[None, :]
    wrong = np.zeros((n, longest + 1, size), np.int32)
    last = max(len(letters) - 1, 0)
    for i in range(longest):
        x = j + i
        wrong[:, i + 1] = wrong[:, i] + ~((x >= first) & (x < end) & (letters[np.clip(x, 0, last)] == own[:, i : i + 1]))
    each = np.arange(n)
    starts = max(1, int((total - np.ceil(part * total)).max()) + 1)
    gap = (total / np.maximum(lengths, 1)).astype(np.float32)[:, None, None] * np.arange(size, dtype=np.float32)
    cost = np.full((n, starts, size), far, np.float32)
    share = np.zeros(n)
    least = np.zeros((n, starts), np.float32)  # of changed words less half the words, from the first one to any before
    for w in range(most):
        a, b = ends[:, w], ends[:, w + 1]
        x = j + a[:, None]
        inside = (x >= first) & (x < end)
        number = np.where(inside, word[np.clip(x, 0, last)], 0)
        begins = inside & ((x == first) | (number != word[np.clip(x - 1, 0, last)]))
        place = (number - number.max(axis=1, keepdims=True)).astype(np.float32)[:, None, :]
        # words of the text passed over up to the beginning of one
        passed = np.full_like(cost, far)
        passed[:, :, 1:] = np.minimum.accumulate(np.where(inside[:, None, :], cost - place, far), axis=2)[:, :, :-1]
        passed = np.where(begins[:, None, :], passed + place, far)
        equal = (wrong[each, b] == wrong[each, a])[:, None, :] & (w < total)[:, None, None]
        match = np.where(equal, np.minimum(cost, passed), far)
        if w < starts:
            match[:, w] = np.where(equal[:, 0], 0, far)
        words = w + 1 - np.arange(starts)
        now = match.min(axis=2)
        held = (now <= budget * words + 1e-6) & (now - words / 2 <= least + 1e-6) & (words >= part * total[:, None])
        share = np.maximum(share, np.where(held, words, 0).max(axis=1) / total)
        left_out = np.minimum(cost + 1, passed)
        to = np.arange(size)[None, :] + (b - a)[:, None]
        moved = np.take_along_axis(left_out, np.broadcast_to(np.minimum(to, size - 1)[:, None, :], cost.shape), axis=2)
        changed = np.minimum(cost + 1, np.where((to < size)[:, None, :], moved, far))
        changed = np.minimum(np.minimum.accumulate(changed - gap, axis=2) + gap, np.minimum.accumulate((changed + gap)[:, :, ::-1], axis=2)[:, :, ::-1] - gap)
        cost = np.minimum(match, changed)
        cost[(cost > budget * most + 1e-3) | (2 * cost > words[:, None] + 1e-3)] = far
        least = np.where(words > 0, np.minimum(least, cost.min(axis=2) - words / 2), 0)
    return share


def _leaks(index: ItemIndex, part: float, budget: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            letters, rows, at, word = stream(batch.column(1))
            row, item, middle, grams = _candidates(index, letters, rows, at)
            # bands overlap: of a pair the one with most grams is verified first, the others where it does not hold
            order = np.lexsort((middle, -grams, item, row))
            row, item, middle = row[order], item[order], middle[order]
            pair = row * len(index.ids) + item
            begins = np.flatnonzero(np.diff(pair, prepend=-1))
            turn = np.arange(len(pair)) - np.repeat(begins, np.diff(np.append(begins, len(pair))))
            held = np.zeros(len(pair), bool)  # of every candidate of a pair that was found
            share = np.zeros(len(pair))
            for t in range(int(turn.max()) + 1 if len(turn) else 0):
                due = np.flatnonzero((turn == t) & ~held)
                due = due[np.argsort([len(index.letters[i]) for i in item[due]], kind="stable")]
                a = 0
                while a < len(due):  # as many as fit some megabytes, items of one size together
                    b = min(a + 64, len(due))
                    while b > a + 1 and (b - a) * len(index.letters[item[due[b - 1]]]) > 1 << 15:
                        b = a + (b - a) // 2
                    x = due[a:b]
                    share[x] = stretches(index, letters, word, at, row[x], item[x], middle[x], part, budget, int(index.bands[item[x]].max()))
                    a = b
                held = np.isin(pair, pair[due[share[due] > 0]]) | held
            found = np.flatnonzero(share)
            out_row, out_item, share = [row[found]], [item[found]], [share[found]]
            keys = batch.column(0).take(pa.array(np.concatenate(out_row), pa.int64()))
            yield pa.record_batch([keys, pa.array(np.concatenate(out_item), pa.int64()), pa.array(np.concatenate(share), pa.float64())], ["key", "item", "share"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", part: float = 0.5, budget: float = 0.15) -> DataFrame:
    """Rows (``item_key``, ``key``, ``share``): the document holds the item, or one stretch of at least ``part`` of it.

    ``share`` is the part of the item's words (characters, for Han) in the stretch, that of the band with most grams in common. Blanks do
    not count, so its first and last word may be parts of longer ones. Long items cost much: their bands, and with them the
    alignment, grow with the letters that ``budget`` lets shift. ``budget`` is the part of words that
    may be changed within it. The items are a fixed, small set: more than MOST_ITEMS is an error, as they are sent to
    every executor. Documents are read whole in one pass without an exchange of texts. Null or empty items and documents
    have no result; repeated documents with one key, and an item found at several places of a document, give one row.
    """
    held = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(item_key, text).limit(MOST_ITEMS + 1).collect()
    if len(held) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} test items; split them into several calls")
    index = ItemIndex.of([r[0] for r in held], [r[1] for r in held], part, budget)
    kind = documents.schema[key].dataType.simpleString()
    found = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_leaks(index, part, budget), f"key {kind}, item bigint, share double")
    pairs = found.groupBy("key", "item").agg(F.max("share").alias("share"))
    names = documents.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(held)], f"item bigint, name {items.schema[item_key].dataType.simpleString()}")
    return pairs.join(F.broadcast(names), "item").select(F.col("name").alias(item_key), F.col("key").alias(key), "share")
