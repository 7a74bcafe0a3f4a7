"""Periodic runs of words: maximal pairs of a bottom-up LCP-interval tree whose distance fits their length are the runs.

A word is a maximal run of characters other than blank, \\t, \\n, \\v, \\f and \\r. A run is a stretch of consecutive words with smallest period q
(words q apart are identical) and at least ``max(min_length, exponent * q)`` words that no neighbouring word extends with that period.

A maximal pair is two places i < j of one text whose next ``ell`` words are equal, the words before and after them differing. With q = j - i
it says that the words i to j + ell have period q and that neither neighbour does: the pair is a run, without any extending, if
``q + ell >= max(min_length, exponent * q)``. So distances are bounded by ``ell / (exponent - 1)``.

Texts are taken in blocks. Prefix doubling in numpy sorts those suffixes of a block that share ``least`` words (the shortest ``ell`` a run can have)
with another of their text; others cannot begin a pair. The ranks of each doubling give the common prefixes of neighbours. In groups
that hold two places near enough the tree is built from the leaves up. An interval has the places below it in order, each with its class,
the word on its left. When children meet, each place of the smaller looks at the nearest places of the larger on both sides; a pair of
different classes within the distance is reported. That is enough: with an exponent of 3 or more the pair of a run's smallest period
is always one of neighbours, because a place between them would give the run a smaller period. Pairs at multiples of a period cover the
same words, so the least distance of each stretch is its period. Small sets go into large ones, so a text of n words takes
O(n log n) steps whatever repeats in it.

A word is dropped if a run holds it behind that run's first q words; kept words are joined by one blank. A null or empty text
has no words, no runs and the empty text. Rows are judged one by one, so repeated rows, ties of doc_id and null ids don't matter; an empty
table gives an empty result.
"""

import re
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, text_function

WORDS = re.compile("[^ \t-\r]+")
MIN_LENGTH, EXPONENT, BLOCK_WORDS = 6, 4, 200_000


class Codes(dict):
    """Numbers of words in the order of their first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks from 1 of pairs, in their order."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1


def suffixes(x: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share ``least`` words or more with another of their text, in suffix order; and the common prefix of each with the one before
    it (0 at the first of a group that shares ``least`` words). ``end`` is where each place's text ends."""
    n = len(x)
    here = np.arange(n)

    def ahead(r: np.ndarray, at: np.ndarray, h: int, none: int = 0) -> np.ndarray:
        """r at h places further, ``none`` beyond the end of the text."""
        return np.where(at + h < end[at], r[np.minimum(at + h, n - 1)], none)

    r, h = x + 1, 1
    while h < least:
        step = min(h, least - h)
        r, h = ranked(r, ahead(r, here, step)), h + step
    key = doc * (int(r.max(initial=0)) + 1) + r
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])
    slot = np.maximum.accumulate(np.where(head, here, 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    single = head & np.append(head[1:], True)
    sa = order[~single]
    slots = np.flatnonzero(~single)
    levels, active = [(h, rank.astype(np.int32))], np.arange(len(sa))
    while len(active):
        at = sa[active]
        group, after = rank[at], ahead(rank, at, h, -1)
        o = np.lexsort((after, group))
        at, group, after = at[o], group[o], after[o]
        sa[active] = at
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots[active], 0))
        h *= 2
        active = active[~(new & np.append(new[1:], True))]
        if len(active):
            levels.append((h, rank.astype(np.int32)))
    lcp = np.zeros(len(sa), np.int64)
    if len(sa):
        first, base = np.zeros(len(sa), bool), levels[0][1]
        first[0], first[1:] = True, base[sa[1:]] != base[sa[:-1]]
        pair = np.flatnonzero(~first)
        a, b, ell = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
        stop = end[b]
        for h, r in reversed(levels):
            while True:  # the longest level may hold more than once, the others once
                fits = np.flatnonzero((a + ell + h <= stop) & (b + ell + h <= stop))
                fits = fits[r[a[fits] + ell[fits]] == r[b[fits] + ell[fits]]]
                if not len(fits):
                    break
                ell[fits] += h
                if h != levels[-1][0] and h != levels[0][0]:
                    break
        for _ in range(least - 1):
            fits = np.flatnonzero((a + ell < stop) & (b + ell < stop))
            ell[fits[x[a[fits] + ell[fits]] == x[b[fits] + ell[fits]]]] += 1
        lcp[pair] = ell
    return sa, lcp


def maximal_pairs(sa: list[int], lcp: list[int], left: list[int], ratio: int, length: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs among a group's suffixes to ``found``: (start, end) and period. ``left`` is each suffix's class."""
    word = dict(zip(sa, left))

    def join(one: list[int], two: list[int], ell: int) -> list[int]:
        small, large = (one, two) if len(one) < len(two) else (two, one)
        size, far = len(large), ell // ratio
        for i in small:
            k = bisect_left(large, i)
            if k and (q := i - (j := large[k - 1])) <= far and q + ell >= length and word[j] != word[i]:
                if q < found.get((j, i + ell), ell):
                    found[j, i + ell] = q
            if k < size and (q := (j := large[k]) - i) <= far and q + ell >= length and word[j] != word[i]:
                if q < found.get((i, j + ell), ell):
                    found[i, j + ell] = q
        if 8 * len(small) > size:
            large += small
            large.sort()
        else:
            for i in small:
                insort(large, i)
        return large

    stack: list[tuple[int, list[int]]] = []  # open intervals: their common prefix, the places of their children so far
    done = [sa[0]]
    for at, ell in zip(sa[1:], lcp[1:]):
        while stack and stack[-1][0] > ell:
            top, places = stack.pop()
            done = join(places, done, top)
        if stack and stack[-1][0] == ell:
            done = join(stack.pop()[1], done, ell)
        stack.append((ell, done))
        done = [at]
    while stack:
        top, places = stack.pop()
        done = join(places, done, top)


def runs_of(texts: list[list[str]], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of every word list, by start and then period."""
    if exponent < 3:
        raise ValueError("the pairs of runs of fewer than three periods need not be neighbours")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    least = min(max((exponent - 1) * q, min_length - q, 1) for q in range(1, min_length + 1))
    code = Codes().__getitem__
    x = np.fromiter((c for t in texts for c in map(code, t)), np.int64, total)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    sa, lcp = suffixes(x, doc, ends[doc], least)
    if not len(sa):
        return out
    begins = (ends - sizes)[doc]
    left = np.where(sa > begins[sa], x[sa - 1], -1)
    first = np.flatnonzero(lcp == 0)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sa))))
    by_place = np.lexsort((sa, group))
    gap = np.where(np.append(True, group[1:] != group[:-1]), total, np.diff(sa[by_place], prepend=0))
    near = np.minimum.reduceat(gap, first) * (exponent - 1) <= np.maximum.reduceat(lcp, first)
    last = np.append(first[1:], len(sa))
    for a, b in zip(first[near].tolist(), last[near].tolist()):
        found: dict[tuple[int, int], int] = {}
        maximal_pairs(sa[a:b].tolist(), lcp[a:b].tolist(), left[a:b].tolist(), exponent - 1, min_length, found)
        if found:
            d = int(doc[sa[a]])
            begin = int(begins[sa[a]])
            out[d] += [(i - begin, j - i, q) for (i, j), q in found.items()]
    for d, rows in enumerate(out):
        least_period: dict[tuple[int, int], int] = {}
        for i, n, q in rows:  # groups of one text can report one stretch at several multiples of its period
            least_period[i, n] = min(q, least_period.get((i, n), q))
        out[d] = sorted(((i, n, q) for (i, n), q in least_period.items()), key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one blank."""
    if not runs:
        return " ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.array(runs, np.int64)
    np.add.at(cover, at[:, 0] + at[:, 2], 1)
    np.add.at(cover, at[:, 0] + at[:, 1], -1)
    return " ".join(w for w, c in zip(words, np.cumsum(cover[:-1]).tolist()) if not c)


def find(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, text_col: str = TEXT) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start and then period) and ``collapsed`` appended (after any of
    these names)."""
    def work(texts: list[str]) -> list[dict]:
        out: list[dict] = []
        block: list[list[str]] = []
        size = 0
        for n, text in enumerate(texts):
            block.append(WORDS.findall(text))
            size += len(block[-1])
            if size >= BLOCK_WORDS or n == len(texts) - 1:
                for words, runs in zip(block, runs_of(block, min_length, exponent)):
                    out.append({"runs": [{"start": i, "length": k, "period": q} for i, k, q in runs], "collapsed": collapse(words, runs)})
                block, size = [], 0
        return out

    kind = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
    keep = [F.col(c) for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.select("*", text_function(lambda: work, kind)(F.col(text_col)).alias("_runs_found")).select(*keep, "_runs_found.runs", "_runs_found.collapsed")
