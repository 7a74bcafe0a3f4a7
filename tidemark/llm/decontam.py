"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit distances.

Texts are words: lower-cased, split at white space and ASCII punctuation. A document holds an item if the word edit distance between the
item and some run of the document's words is at most ``1 - SIMILARITY`` of the item's words. Items shorter than ``MIN_WORDS`` must stand
word by word; items without words match nothing.

An item is embedded by a random walk that emits the word it stands on and steps on when a hash bit of (step, word) says so: edits become
Hamming differences of the emitted sequences. ``REPEATS`` walks, each with its own sample of emitted places, give the keys of every
``ANCHOR_STEP``-th word of an item as a start, so that edits near one start leave others whole. The same walks start at every document
word of windows that can hold an item: an item-sized window has at most as many words foreign to all items as edits are allowed, and
other windows are passed over without loss. Equal keys give candidates; each is verified with the bit-parallel edit distance of the
whole item against the window, both ends free. The measured recall at the largest allowed distance is in the README.

Walks run off the end of short items. Items of at most ``SHORT_WORDS`` words are cut into one piece more than edits are allowed instead:
one piece stands unedited in every document that holds the item. All places of all pieces are looked up and verified: nothing is lost.

Items go to the tasks in blocks of ``BLOCK_ITEMS``, one pass over the documents for each block, so that what is broadcast is bounded.
Null and empty texts hold nothing; repeated rows give repeated results; an item table without usable items gives none. Items whose id is
null are searched like others and reported with a null id. Similarities under ``SIMILARITY`` are refused: the walks would miss too many.
"""

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, text_function

SIMILARITY, MIN_WORDS, SHORT_WORDS = 0.8, 5, 14
REPEATS, STEPS, SAMPLED, ANCHOR_STEP, SEED = 6, 14, 5, 2, 11
BLOCK_ITEMS, BLOCK_WORDS, BLOCK_HITS = 50_000, 1_000_000, 200_000
BREAKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(BREAKS).split()


class Items:
    """What the tasks know of one block of items: their words, the keys of their walks, and the pieces of short ones."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS):
        if not SIMILARITY <= similarity <= 1:
            raise ValueError(f"walks find enough of the items from a similarity of {SIMILARITY} on")
        parts = [(i, w) for i, t in rows if (w := words(t or ""))]
        self.names = [i for i, _ in parts]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in parts for x in ws))}
        self.foreign = len(self.vocabulary)
        self.texts = [np.array([self.vocabulary[x] for x in ws], np.int32) for _, ws in parts]
        self.edits = [int((1 - similarity) * len(x) + 1e-9) if len(x) >= MIN_WORDS else 0 for x in self.texts]
        long = [k for k, x in enumerate(self.texts) if len(x) > SHORT_WORDS]
        self.masks = [_masks(x.tolist()) for x in self.texts]
        rng = np.random.default_rng(SEED)
        self.samples = [np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(repeats)]
        self.bits = np.array([[xxhash.xxh64_intdigest(w, s) for w in self.vocabulary] + [0] for s in range(repeats)], np.uint64)
        self.classes, sizes = [], sorted({len(self.texts[k]) for k in long})
        while sizes:  # sizes within a fifth of each other share one test for windows that can hold an item
            own = [n for n in sizes if n <= 1.2 * sizes[0]]
            sizes = sizes[len(own):]
            few = max(1, min(len(x) - 1 - 2 * e for x, e in zip(self.texts, self.edits) if len(x) in own))
            self.classes.append((few, max(len(x) + e - 1 for x, e in zip(self.texts, self.edits) if len(x) in own)))
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[:-1] * np.int64(self.foreign + 1) + x[1:] for x in (self.texts[k] for k in long))]))
        keys, item, offset = [], [], []
        for k in long:
            x = self.texts[k]
            at = np.arange(0, max(1, len(x) - SAMPLED), ANCHOR_STEP)
            padded = np.append(x, np.full(STEPS + 1, self.foreign, np.int32))
            for r in range(repeats):
                key, whole = self.walk(padded, at, r)
                keys.append(key[whole])
                item.append(np.full(whole.sum(), k))
                offset.append(at[whole])
        keys, self.item, self.offset = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((keys, np.uint64), (item, np.int64), (offset, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], self.item[order], self.offset[order]
        self.sizes, self.short = np.array([len(x) for x in self.texts], np.int64), np.zeros((len(self.texts), SHORT_WORDS), np.int32)
        for row, x in zip(self.short, self.texts):
            row[:len(x)] = x[:SHORT_WORDS]
        self.pieces = self._pieces()

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of short items' pieces their keys in order, their items and their offsets."""
        found: dict[int, list[tuple]] = {}
        for k, x in enumerate(self.texts):
            if len(x) <= SHORT_WORDS:
                cuts = np.arange(self.edits[k] + 2) * len(x) // (self.edits[k] + 1)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    found.setdefault(b - a, []).append((x[a:b], k, a))
        out = {}
        for size, rows in found.items():
            keys = runs(np.stack([r[0] for r in rows]).ravel(), np.arange(len(rows)) * size, size)
            order = np.argsort(keys, kind="stable")
            out[size] = keys[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order]
        return out

    def walk(self, x: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks that start at ``at``, and whether all their sampled words are words of items."""
        place, key, whole = at.copy(), np.full(len(at), r + 1, np.uint64), np.ones(len(at), bool)
        for step in range(int(self.samples[r][-1]) + 1):
            word = x[place]
            if step in self.samples[r]:
                key = (key ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
                whole &= word != self.foreign
            place = place + (self.bits[r][word] >> np.uint64(step) & np.uint64(1)).astype(np.int64)
        return key, whole

    def possible(self, x: np.ndarray) -> np.ndarray:
        """Places of known words within windows that hold enough of the items' word pairs: an edit spoils two pairs at most."""
        if not len(self.pairs):
            return np.zeros(0, np.int64)
        both = np.flatnonzero((x[:-1] != self.foreign) & (x[1:] != self.foreign))
        pair = x[both] * np.int64(self.foreign + 1) + x[both + 1]
        at = np.searchsorted(self.pairs, pair)
        both = both[self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair]
        cover = np.zeros(len(x) + 1, np.int32)
        for few, wide in self.classes:  # the first and the last pair of a window that has enough lie at most ``wide`` apart
            last = both[few - 1:]
            first = both[:len(last)]
            ok = last - first < wide
            cover += np.bincount(np.maximum(last[ok] - wide, 0), minlength=len(cover))
            cover -= np.bincount(np.minimum(first[ok] + wide + 1, len(x)), minlength=len(cover))
        return np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (x != self.foreign))

    def search(self, texts: list[str]) -> list[list[dict]]:
        out, block, size = [{} for _ in texts], [], 0
        for k, t in enumerate(texts):
            ws = words(t)
            block.append((k, np.fromiter(map(self.vocabulary.get, ws, repeat(self.foreign)), np.int32, len(ws))))
            size += len(ws)
            if size >= BLOCK_WORDS:
                self._search(block, out)
                block, size = [], 0
        self._search(block, out)
        return [[{"item_id": self.names[i], "similarity": s, "start": p} for i, (s, p) in sorted(o.items())] for o in out]

    def _search(self, block: list[tuple[int, np.ndarray]], out: list[dict]) -> None:
        if not block or not self.texts:
            return
        gap = np.full(max([2 * SHORT_WORDS, *(w for _, w in self.classes)]) + STEPS + 1, self.foreign, np.int32)
        x = np.concatenate([p for _, w in block for p in (w, gap)])
        begins = np.cumsum([0] + [len(w) + len(gap) for _, w in block])
        self._search_short(x, begins, [k for k, _ in block], out)
        at = self.possible(x)
        found = []
        for r in range(len(self.samples)):
            key, whole = self.walk(x, at, r)
            key, p = key[whole], at[whole]
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            n = hi - lo
            hits = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack((self.item[hits], np.repeat(p, n) - self.offset[hits], np.repeat(p, n))))
        item, start, p = np.concatenate(found, 1)
        _, first = np.unique(item * (len(x) + len(gap)) + start + len(gap), return_index=True)
        item, start, doc = item[first], start[first], np.searchsorted(begins, p[first], "right") - 1
        done: dict[tuple[int, int], int] = {}
        for i, s, d in zip(item.tolist(), start.tolist(), doc.tolist()):
            k, own = block[d][0], self.texts[i]
            best = out[k].get(i)
            if best and best[0] == 1.0 or done.get((i, d), -1) >= s:
                continue
            m, most = len(own), self.edits[i]
            s = max(s, int(begins[d]))
            if np.array_equal(x[s:s + m], own):
                out[k][i] = (1.0, s - int(begins[d]))
                continue
            lo = max(int(begins[d]), s - most)
            least, end = distance(self.masks[i], m, x[lo:s + m + 2 * most].tolist())
            done[i, d] = s + most // 2  # starts so near have been looked at by the same window
            if least <= most and (best is None or best[0] < 1 - least / m):
                out[k][i] = (1 - least / m, max(0, lo + end - m - int(begins[d])))

    def _search_short(self, x: np.ndarray, begins: np.ndarray, names: list[int], out: list[dict]) -> None:
        """The best run of every short item in every document; of equal ones the first."""
        known = np.flatnonzero(x != self.foreign)
        for size, (keys, items, offsets) in self.pieces.items():
            key = runs(x, known, size)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(lo < hi)
            places, lo, n = known[hit], lo[hit], (hi - lo)[hit]
            ends = np.cumsum(n)
            for first in range(0, int(n.sum()), BLOCK_HITS):  # hits are numbered through: a common piece of many items has very many
                number = np.arange(first, min(first + BLOCK_HITS, int(ends[-1])))
                of = np.searchsorted(ends, number, "right")
                at = lo[of] + number - (ends[of] - n[of])
                item, place = items[at], places[of]
                doc = np.searchsorted(begins, place, "right") - 1
                sizes = self.sizes[item]
                for m in np.unique(sizes).tolist():
                    own = sizes == m
                    self._verify_short(m, item[own], doc[own], place[own] - offsets[at[own]], x, begins, names, out)

    def _verify_short(self, m: int, item: np.ndarray, doc: np.ndarray, start: np.ndarray, x: np.ndarray, begins: np.ndarray, names: list[int], out: list[dict]) -> None:
        """The same for hits of items of m words that would start at ``start``."""
        most = self.edits[item[0]]
        start = np.maximum(start - most, begins[doc])
        least, end = distances(self.short[item, :m], x[start[:, None] + np.arange(m + 2 * most)])
        near = np.flatnonzero(least <= most)
        near = near[np.lexsort((start[near], least[near], item[near], doc[near]))]
        new = np.append(True, (np.diff(doc[near]) != 0) | (np.diff(item[near]) != 0))[:len(near)]
        for i in near[new].tolist():
            found, k, d = out[names[doc[i]]], int(item[i]), int(begins[doc[i]])
            hit = (1 - int(least[i]) / m, max(0, int(start[i] + end[i]) - m - d))
            if k not in found or (-hit[0], hit[1]) < (-found[k][0], found[k][1]):
                found[k] = hit


def runs(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each place on."""
    key = np.full(len(at), size, np.uint64)
    for i in range(size):
        key = (key ^ x[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def distances(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distance`` between each item and its window, as rows of two matrices of words: the same columns, all rows at a time."""
    m = items.shape[1]
    row = np.repeat(np.arange(m + 1)[:, None], len(windows), 1)
    least, end = row[-1].copy(), np.zeros(len(windows), np.int64)
    for j in range(windows.shape[1]):
        last, row = row, np.zeros_like(row)
        for i in range(1, m + 1):
            row[i] = np.minimum(np.minimum(row[i - 1], last[i]) + 1, last[i - 1] + (windows[:, j] != items[:, i - 1]))
        better = row[-1] < least
        least[better], end[better] = row[-1][better], j + 1
    return least, end


def _masks(item: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def distance(masks: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance between a pattern of m words and any run of the text, and where that run ends (bit-parallel columns)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, least, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (~(zero | up) & full), up & zero
        score += bool(right & top) - bool(left & top)
        if score < least:
            least, end = score, j
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (~(zero | right) & full), right & zero
    return least, end


def matches(text: Column, items: list[tuple[int, str]], similarity: float = SIMILARITY) -> Column:
    """array of (item_id, similarity, start word) of the given items that a text holds."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(Items(items, similarity))
    return text_function(lambda: lambda texts: [{"hits": h} for h in shared.value.search(texts)],
                         "struct<hits: array<struct<item_id: bigint, similarity: double, start: bigint>>>")(text)["hits"]


def item_blocks(items: DataFrame, size: int = BLOCK_ITEMS):
    """The item table in blocks of about ``size`` rows."""
    n = max(1, -(-items.count() // size))
    for k in range(n):
        yield [tuple(r) for r in items.select("item_id", TEXT).where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, item_id, similarity, start)``: every item a document holds, the best run of each."""
    out = None
    for block in item_blocks(items):
        part = docs.select(F.col(id_col).alias(ID), F.explode(matches(F.col(text_col), block, similarity)).alias("hit")).select(ID, "hit.*")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows whose text holds no item, all columns kept."""
    for block in item_blocks(items):
        docs = docs.where(F.size(matches(F.col(TEXT), block, similarity)) == 0)
    return docs
