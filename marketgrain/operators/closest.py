"""The most alike of many texts for each of a block of texts, exactly, for whole arrays of pairs at once.

The score of a pair is the larger of ``difflib``'s ratio and the Jaccard share of words. Pairs are left out only where an upper
bound of the ratio is below a score already reached: first the letters in common (a product of matrices), then the longest
common subsequence (one bit a character). The ratio of the rest is counted as ``difflib`` does it.
"""

from __future__ import annotations

import ctypes
import difflib
import re
from collections import Counter

import numpy as np

#: Texts of the right side and of the left side in one product of matrices.
TILE, ROWS = 8192, 256
#: Buckets of letters; letters beyond share them, so the bound stays one.
BUCKETS = 64
#: A further occurrence of a letter has its own column if one in so many left texts has it.
RARE = 200
#: If more of a product's pairs than this share remain, two of each left text are scored and the rest are bounded anew.
RAISE = 0.06
#: Pairs in one pass over their characters; pairs kept until they are scored; bytes of the table of character positions of a block.
PAIRS, HELD, TABLE = 1 << 14, 1 << 19, 1 << 26
#: From this length difflib leaves out popular characters.
AUTOJUNK = 200
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def one_thread() -> None:
    """Products of matrices take one thread: tasks fill the cores already, and threads that wait for others use CPU."""
    try:
        with open("/proc/self/maps") as maps:
            files = {line.split(maxsplit=5)[-1].strip() for line in maps if "openblas" in line}
        for lib in map(ctypes.CDLL, files):
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    break
    except OSError:  # only slower
        pass


class Texts:
    """Code points of texts in one array, with starts and lengths."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def coded(self, table: np.ndarray) -> np.ndarray:
        """Code of every character, and a 0 behind the last one."""
        return np.append(table[self.points], table.dtype.type(0))


def words_of(texts: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of three letters or more: starts of the texts, and numbers of words (new ones are added)."""
    found = re.findall(r"\w{3,}|\0", "".join(t.replace("\0", " ") + "\0" for t in texts))
    v = np.fromiter((-1 if w == "\0" else ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    row = np.cumsum(v < 0)
    pairs = np.sort(row[v >= 0] * (len(ids) + 1) + v[v >= 0])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    row, word = pairs // (len(ids) + 1), pairs % (len(ids) + 1)
    return np.searchsorted(row, np.arange(len(texts) + 1)), word


def best(x: list[str], y: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and position in ``y`` of the best text of each text of ``x``; of equal scores the first; -1 where none reaches ``threshold``."""
    right, ids = Texts(y), {}
    right_words = words_of(y, ids)
    holding = np.argsort(right_words[1], kind="stable")
    row_of = np.repeat(np.arange(len(y)), np.diff(right_words[0]))[holding]
    index = (np.searchsorted(right_words[1][holding], np.arange(len(ids) + 1)), row_of)
    # blocks of like length and script, so that tables and matrices hold little that is not used
    deep = [(max(len(t) - 1, 0) // 64).bit_length() for t in x]
    order = sorted(range(len(x)), key=lambda i: (deep[i], sum(map(ord, x[i])) / max(len(x[i]), 1)))
    scores, at = np.zeros(len(x)), np.full(len(x), -1)
    k = 0
    while k < len(order):
        n = 0
        letters: set[str] = set()
        for i in order[k:]:  # as many as the table may hold
            letters |= set(x[i])
            if n and (deep[i] > deep[order[k]] or (n + 1) * (len(letters) + 1) * (8 << deep[i]) > TABLE):
                break
            n += 1
        some = order[k : k + n]
        scores[some], at[some] = Search([x[i] for i in some], right, threshold, right_words, ids, index).run()
        k += n
    return scores, at


class Search:
    """The best right texts of one block of left texts."""

    def __init__(self, x: list[str], right: Texts, threshold: float, right_words: tuple[np.ndarray, np.ndarray], ids: dict[str, int], index: tuple[np.ndarray, np.ndarray]):
        self.x, self.right, self.left = x, right, Texts(x)
        self.words, self.ids, self.index = right_words, ids, index
        self.reached, self.at = np.full(len(x), float(threshold)), np.full(len(x), len(right.texts))
        often = [c for c, _ in Counter("".join(x)).most_common()]
        table = np.zeros(0x110000, np.int64)
        table[[ord(c) for c in often]] = np.arange(1, len(often) + 1)
        self.codes = right.coded(table)
        own = self.left.coded(table)[:-1]
        rows = np.repeat(np.arange(len(x)), self.left.sizes)
        place = np.arange(len(own)) - np.repeat(self.left.starts, self.left.sizes)
        # bit of every place of a left text, by its character
        self.letters, self.deep = len(often) + 1, max(1, -(-int(self.left.sizes.max(initial=0)) // 64))
        self.places = np.zeros((self.deep, len(x) * self.letters), np.uint64)
        np.bitwise_or.at(self.places, (place // 64, rows * self.letters + own), _ONE << (place % 64).astype(np.uint64))
        # columns: the k-th occurrence of a letter
        bucket = np.arange(-1, len(often))
        bucket[BUCKETS + 1 :] = BUCKETS - 1 - bucket[BUCKETS + 1 :] % BUCKETS
        self.bucket, self.buckets = bucket, min(BUCKETS, len(often))
        count = np.bincount(rows * self.buckets + bucket[own], minlength=len(x) * self.buckets).reshape(len(x), self.buckets)
        least = len(x) // RARE
        depth = [int((np.sort(count[:, b])[::-1][least : least + 1]).max(initial=0)) for b in range(self.buckets)]
        self.columns = [(b, k) for b in range(self.buckets) for k in range(max(1, min(depth[b], 64)))]
        self.seen = self._columns(count).T
        self.beyond = self.left.sizes - self.seen.sum(1)

    def _columns(self, count: np.ndarray) -> np.ndarray:
        out, count = np.empty((len(self.columns), len(count)), np.float32), np.ascontiguousarray(count.T)
        for c, (b, k) in enumerate(self.columns):
            out[c] = count[b] > k
        return out

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        self._put(*self._by_words())
        n = len(self.right.texts)
        for lo in range(0, n, TILE):
            hi = min(lo + TILE, n)
            sizes = self.right.sizes[lo:hi]
            first, end = self.right.starts[lo], self.right.starts[hi - 1] + sizes[-1]
            code = self.codes[first:end]
            known = np.flatnonzero(code)
            row = np.repeat(np.arange(hi - lo), sizes)[known]
            count = np.bincount(row * self.buckets + self.bucket[code[known]], minlength=(hi - lo) * self.buckets).reshape(hi - lo, self.buckets) if self.buckets else np.zeros((hi - lo, 0), np.int64)
            tile = np.vstack([self._columns(count), sizes.astype(np.float32), np.ones(hi - lo, np.float32)])
            longest = int(sizes.max(initial=0))
            near, held = [], 0
            for k in range(0, len(self.x), ROWS):
                near.append(self._near(slice(k, min(k + ROWS, len(self.x))), lo, tile, longest))
                held += len(near[-1][0])
                if held > HELD or k + ROWS >= len(self.x):
                    self._settle(*(np.concatenate(v) for v in zip(*near, strict=True)))
                    near, held = [], 0
        none = self.at == n
        return np.where(none, 0.0, self.reached), np.where(none, -1, self.at)

    def _near(self, s: slice, lo: int, tile: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that may still be the best, and the upper bounds of their ratios."""
        used = np.append(self.seen[s].any(0), [True, True])
        columns = tile[used] if not used.all() else tile
        slack = 1e-3 + 1e-6 * (longest + int(self.left.sizes[s].max(initial=0)))
        margin = self._margin(s, used, columns)
        near = margin >= -slack
        if np.count_nonzero(near) > RAISE * near.size:  # raise what is reached first
            top = np.argpartition(margin, -2, axis=1)[:, -2:] if margin.shape[1] > 2 else np.tile(np.arange(margin.shape[1]), (len(near), 1))
            i, j = np.repeat(np.arange(s.start, s.stop), top.shape[1]), top.ravel() + lo
            self._put(i, j, self.ratio(i, j))
            near = self._margin(s, used, columns) >= -slack
        i, j = np.divmod(np.flatnonzero(near), near.shape[1])
        i, j = i + s.start, j + lo
        bound = self._share(i, j, self.common(i, j))
        keep = self._may(i, j, bound)
        return i[keep], j[keep], bound[keep]

    def _settle(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> None:
        order = np.lexsort((j, -bound, i))
        i, j, bound = i[order], j[order], bound[order]
        most = 1
        while len(i):  # the most promising of each text first
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            now = rank < most
            self._put(i[now], j[now], self.ratio(i[now], j[now]))
            keep = ~now
            keep[keep] = self._may(i[keep], j[keep], bound[keep])
            i, j, bound, most = i[keep], j[keep], bound[keep], most * 2

    def _margin(self, s: slice, used: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Letters in common less those that the reached score needs."""
        half = self.reached[s] / 2
        own = np.column_stack([self.seen[s], -half, self.beyond[s] - half * self.left.sizes[s]]).astype(np.float32)
        return own[:, used] @ columns

    def _may(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return (bound > self.reached[i]) | (bound == self.reached[i]) & (j < self.at[i])

    def _share(self, i: np.ndarray, j: np.ndarray, matched: np.ndarray) -> np.ndarray:
        total = self.left.sizes[i] + self.right.sizes[j]
        return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)

    def _put(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        """Scores of pairs laid into the best so far."""
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
        first = first[self._may(i[first], j[first], score[first])]
        self.reached[i[first]], self.at[i[first]] = score[first], j[first]

    def _by_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best pairs by shared words, and the ratios of pairs that share most.

        A left text's words are looked up from the rarest on, until texts that hold none of those seen cannot reach the best.
        """
        starts, word = self.words
        first, rows = self.index
        flag = np.zeros(len(self.ids), bool)
        pairs, alike = [], []
        for i, t in enumerate(self.x):
            own = set(re.findall(r"\w{3,}", t))
            known = np.array([self.ids[w] for w in own if w in self.ids], np.int64)
            known = known[np.argsort(first[known + 1] - first[known], kind="stable")]
            flag[known] = True
            reached = self.reached[i]
            shares, js = [], []
            for r, w in enumerate(known):
                if (len(known) - r) / len(own) < reached:
                    break
                j = rows[first[w] : first[w + 1]]
                n = starts[j + 1] - starts[j]
                ends = np.cumsum(n)
                held = flag[word[np.arange(ends[-1]) + np.repeat(starts[j] - ends + n, n)]]
                both = np.add.reduceat(held, ends - n, dtype=np.int64)
                share = both / (n + len(own) - both)
                shares.append(share)
                js.append(j)
                reached = max(reached, share.max())
            flag[known] = False
            if not js:
                continue
            share, j = np.concatenate(shares), np.concatenate(js)
            top = share.max()
            pairs.append((i, j[share == top].min(), top))
            alike += [(i, k) for k in dict.fromkeys(j[np.argsort(-share, kind="stable")[:6]].tolist())]
        i, j = np.array(alike, np.int64).reshape(-1, 2).T
        pi, pj, ps = (np.array(v, kind) for v, kind in zip(zip(*pairs, strict=True), (np.int64, np.int64, float), strict=True)) if pairs else (i, j, np.zeros(0))
        return np.concatenate([pi, i]), np.concatenate([pj, j]), np.concatenate([ps, self.ratio(i, j)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each pair, which no matching in order exceeds."""
        out = np.zeros(len(i), np.int64)
        order = np.argsort(self.right.sizes[j], kind="stable")
        step = max(1, PAIRS // self.deep)
        for k in range(0, len(order), step):
            part = order[k : k + step]
            start, base, size = self.right.starts[j[part]], i[part] * self.letters, self.right.sizes[j[part]]
            v = np.full((self.deep, len(part)), _ONES)
            lows = np.searchsorted(size, np.arange(int(size[-1])), "right")
            at, letter = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            held, total = np.empty(len(part), np.uint64), np.empty(len(part), np.uint64)
            for c, low in enumerate(lows.tolist()):  # texts that have ended are in front
                p, q, h, t = at[low:], letter[low:], held[low:], total[low:]
                np.add(start[low:], c, out=p)
                np.take(self.codes, p, out=q, mode="clip")
                np.add(base[low:], q, out=p)
                carry = None
                for d in range(self.deep):
                    u = v[d, low:]
                    np.take(self.places[d], p, out=h, mode="clip")
                    np.bitwise_and(h, u, out=h)
                    np.add(u, h, out=t)
                    if self.deep > 1:
                        over = t < u
                        if carry is not None:
                            np.add(t, carry, out=t)
                            over |= t < carry
                        carry = over.astype(np.uint64)
                    np.subtract(u, h, out=u)
                    np.bitwise_or(u, t, out=u)
            out[part] = np.bitwise_count(~v).sum(0)
        return out

    def ratio(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``difflib.SequenceMatcher(None, left, right).ratio()`` of each pair."""
        quick = (self.left.sizes[i] <= 64) & (self.right.sizes[j] < AUTOJUNK)
        out = np.zeros(len(i))
        out[quick] = self._share(i[quick], j[quick], self._matched(i[quick], j[quick]))
        for k in np.flatnonzero(~quick):
            out[k] = difflib.SequenceMatcher(None, self.x[i[k]], self.right.texts[j[k]]).ratio()
        return out

    def _matched(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Characters in difflib's matching blocks: the longest block, the first of several, then those before and behind it."""
        out = np.zeros(len(i), np.int64)
        zero = np.zeros(len(i), np.int64)
        todo = np.array([np.arange(len(i)), zero, self.left.sizes[i], zero, self.right.sizes[j]])
        todo = todo[:, (todo[2] > 0) & (todo[4] > 0)]
        while todo.shape[1]:
            todo = todo[:, np.argsort(todo[4] - todo[3], kind="stable")]
            after = []
            step = max(1, PAIRS // 4)
            for k in range(0, todo.shape[1], step):
                p, a0, a1, b0, b1 = todo[:, k : k + step]
                row = np.arange(int((b1 - b0).max()))
                at = np.where(row < (b1 - b0)[:, None], (self.right.starts[j[p]] + b0)[:, None] + row, len(self.codes) - 1)
                within = (_ONES >> (64 - (a1 - a0)).astype(np.uint64)) << a0.astype(np.uint64)
                held = self.places[0][(i[p] * self.letters)[:, None] + self.codes[at]] & within[:, None]
                live = held.any(1)
                held, rest = held[live], todo[:, k : k + step][:, live]
                run, size = held, 1  # bits where blocks of this size end
                while len(run):
                    longer = (run[:, :-1] << _ONE) & held[:, size:]
                    goes = longer.any(1)
                    if not goes.all():
                        p, a0, a1, b0, b1 = rest[:, ~goes]
                        ends = run[~goes]
                        low = np.bitwise_or.reduce(ends, axis=1)
                        low &= ~low + _ONE
                        a = np.bitwise_count(low - _ONE).astype(np.int64) - size + 1
                        b = b0 + ((ends & low[:, None]) != 0).argmax(1)
                        np.add.at(out, p, size)
                        both = np.hstack([[p, a0, a, b0, b], [p, a + size, a1, b + size, b1]])
                        after.append(both[:, (both[1] < both[2]) & (both[3] < both[4])])
                        longer, held, rest = longer[goes], held[goes], rest[:, goes]
                    run, size = longer, size + 1
            todo = np.hstack(after) if after else todo[:, :0]
        return out
