"""Byte-level BPE: encoding by replaying the merges in rank order over the distinct pieces of a block of the corpus, and decoding.

Texts are cut into pieces by the tokenizer's pattern. A block's pieces that no earlier block of the task had are laid out as one array of
byte tokens with links to both neighbours; an inverted index holds, for each rank, the places where a pair of that rank begins. Ranks are
taken in order; each merge touches its two neighbours only, whose new pairs enter the index. A place counts only while it still begins a
pair of that rank. If a merge makes a pair of a lower rank, that rank is taken first. So every piece comes out as if merged alone,
lowest rank first, then leftmost; a piece that is a token itself is that token.

Blocks live in the tasks: merges never reach over a piece's ends, so that no shuffle is needed and memory is bounded by ``BLOCK_CHARS`` of
text and ``KEPT`` pieces, whatever the corpus. The rank file is read on the driver (its size is fixed) and sent to every executor once.

Null and empty texts have no tokens. Any string is encoded, special-token strings too, as ordinary text; decoding gives its UTF-8 bytes.
Copies and ties need no care: the result depends on the text alone.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID, TEXT

BLOCK_CHARS, KEPT = 8_000_000, 500_000
#: Longer stretches and pieces are kept for their block only, and of shorter ones so many characters of either.
LONG_KEPT, KEPT_CHARS = 256, 16_000_000
#: Pieces of more bytes, and the pieces of a block that has fewer, are replayed one place at a time.
LONG_PIECE, FEW_PIECES = 256, 2000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left token, right token) to the rank of their bytes together."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def replay(pieces: list[bytes], singles: list[int], pairs: dict[tuple[int, int], int]) -> list[list[int]]:
    """The tokens of every piece (not empty)."""
    token: list[int] = [-1]
    begins = []
    for p in pieces:
        begins.append(len(token))
        token += [singles[b] for b in p]
        token.append(-1)
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = list(map(pairs.get, zip(token, token[1:])))
    rank_at.append(None)
    index: dict[int, list[int]] = {}
    for i, r in enumerate(rank_at):
        if r is not None:
            index.setdefault(r, []).append(i)
    waiting, get = list(index), pairs.get
    heapify(waiting)
    while waiting:
        r = heappop(waiting)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        for k, i in enumerate(places):
            if rank_at[i] != r:
                continue
            j = after[i]
            right, left = after[j], before[i]
            token[i] = r
            after[i], before[right], rank_at[j] = right, i, None
            token[j] = -2
            lower = False
            for place, new in ((left, get((token[left], r))), (i, get((r, token[right])))):
                rank_at[place] = new
                if new is not None:
                    if (held := index.get(new)) is None:
                        index[new] = [place]
                        heappush(waiting, new)
                    else:
                        held.append(place)
                    lower |= new < r
            if lower:
                if rest := places[k + 1:]:
                    index.setdefault(r, []).extend(rest)
                    heappush(waiting, r)
                break
    out = []
    for b, p in zip(begins, pieces):
        out.append([t for t in token[b:b + len(p)] if t != -2])
    return out


class Merges:
    """Pair ranks as sorted arrays, and the replay over many pieces at once."""

    none = 1 << 30

    def __init__(self, pairs: dict[tuple[int, int], int], singles: list[int], tokens: int):
        self.width, self.tokens = tokens + 1, tokens
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(pairs.values()), np.int32)[order]
        self.singles = np.array(singles, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * np.int64(self.width) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(self.none))

    def replay(self, pieces: list[bytes], parts: int = 64) -> list[bytes]:
        """Little-endian ids of every piece (not empty), as ``replay`` gives them.

        The index is one array of (rank, place) for each ``parts``-th of the ranks, sorted when its turn comes; what merges add to the
        part at hand goes to lists by rank. A step takes all places of a rank, one of each piece: a piece's others wait for the next
        step, so that a pair of a lower rank, should one arise, goes first.
        """
        lengths = np.array([len(p) for p in pieces])
        begins = np.cumsum(lengths + 1) - lengths
        n = int(lengths.sum() + len(pieces) + 1)
        token = np.full(n, self.tokens, np.int32)
        inner = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
        token[inner] = self.singles[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank_at = np.append(self.rank(token[:-1], token[1:]), np.int32(self.none))
        owner = np.zeros(n, np.int32)
        owner[inner] = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        later = [(rank_at[some := np.flatnonzero(rank_at < self.none)], some.astype(np.int32))]
        step = -(-self.tokens // parts)
        for top in range(step, self.tokens + step, step):
            rank, place = (np.concatenate(x) for x in zip(*later))
            live = rank_at[place] == rank
            now = live & (rank < top)
            later = [(rank[live & ~now], place[live & ~now])]
            rank, place = rank[now], place[now]
            order = np.lexsort((place, rank))
            rank, place = rank[order], place[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else []
            index = {int(rank[c]): [place[c:d]] for c, d in zip(cuts, [*cuts[1:], len(rank)])}
            waiting = list(index)
            while waiting:
                r = heappop(waiting)
                held = index.pop(r, None)
                if held is None:
                    continue
                at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
                at = at[rank_at[at] == r]
                if len(at) > 1:
                    own = owner[at]
                    lead = np.append(True, own[1:] != own[:-1])
                    if not lead.all():
                        index[r] = [at[~lead]]
                        heappush(waiting, r)
                        at = at[lead]
                elif not len(at):
                    continue
                gone = after[at]
                right, left = after[gone], before[at]
                token[at], token[gone], rank_at[gone] = r, -1, self.none
                after[at], before[right] = right, at
                places = np.concatenate((left, at))
                new = self.rank(token[places], np.concatenate((token[at], token[right])))
                rank_at[places] = new
                ok = new < self.none
                new, places = new[ok], places[ok]
                soon = new < top
                if soon.any():
                    for x, y in zip(new[soon].tolist(), places[soon]):
                        if x in index:
                            index[x].append(np.array([y], np.int32))
                        else:
                            index[x] = [np.array([y], np.int32)]
                            heappush(waiting, x)
                    new, places = new[~soon], places[~soon]
                later.append((new, places))
        left = token[inner]
        alive = left >= 0
        ids = left[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.add.reduceat(alive, np.cumsum(lengths) - lengths))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes and decodes texts; keeps the pieces and blank-separated stretches it has met, up to ``KEPT`` and ``KEPT_CHARS`` of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern).findall
        self.pairs = pair_ranks(ranks)
        self.singles = [ranks[bytes([b])] for b in range(256)]
        self.merges = Merges(self.pairs, self.singles, max(ranks.values()) + 1)
        self.pieces: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.piece_chars = self.stretch_chars = 0
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        self.size, self.begin = size, np.cumsum(size) - size
        self.all_bytes = np.frombuffer(b"".join(t for _, t in sorted((r, t) for t, r in ranks.items())), np.uint8)

    def cut(self, stretch: str) -> list[str]:
        """Pieces of a stretch; letters alone, or with a comma or stop behind them, need no pattern."""
        word = stretch[1:] if stretch[0] == " " else stretch
        if word.isalpha():
            return [stretch]
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        return self.pattern(stretch)

    def learn(self, stretches: list[str]) -> list[bytes]:
        """Little-endian ids of stretches."""
        if len(self.pieces) > KEPT or self.piece_chars > KEPT_CHARS:
            self.pieces.clear()
            self.piece_chars = 0
        cuts = [self.cut(s) for s in stretches]
        pieces = self.pieces
        merged, raw, odd = [], [], []
        fresh = dict.fromkeys(p for c in cuts for p in c if p not in pieces)
        for p in fresh:
            b = p.encode()
            if (r := self.ranks.get(b)) is not None:
                pieces[p] = r.to_bytes(4, "little")
            elif len(b) > LONG_PIECE:
                odd.append(p)
            else:
                merged.append(p)
                raw.append(b)
        if len(merged) < FEW_PIECES:
            odd, merged, raw = odd + merged, [], []
        if merged:
            pieces.update(zip(merged, self.merges.replay(raw)))
        if odd:
            pieces.update(zip(odd, (np.array(x, "<u4").tobytes() for x in replay([p.encode() for p in odd], self.singles, self.pairs))))
        out = [pieces[c[0]] if len(c) == 1 else b"".join([pieces[p] for p in c]) for c in cuts]
        self.piece_chars += forget_long(pieces, fresh)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= BLOCK_CHARS:
                yield from self._encode(block)
                block, size = [], 0
        yield from self._encode(block)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.stretches) + len(self.firsts) > KEPT or self.stretch_chars > KEPT_CHARS:
            self.stretches.clear()
            self.firsts.clear()
            self.stretch_chars = 0
        firsts, rest = set(), set()
        for t in texts:
            first, *others = split(t)
            firsts.add(first)
            rest.update(others)
        firsts, rest = [s for s in firsts if s and s not in self.firsts], [s for s in rest if s not in self.stretches]
        ids = self.learn(firsts + [" " + s for s in rest])
        self.firsts.update(zip(firsts, ids))
        self.firsts[""] = b""
        self.stretches.update(zip(rest, ids[len(firsts):]))
        get = self.stretches.__getitem__
        for t in texts:
            first, *others = split(t)
            yield self.firsts[first] + b"".join(map(get, others))
        self.stretch_chars += forget_long(self.firsts, firsts) + forget_long(self.stretches, rest)

    def decode(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4")
        size = self.size[x]
        at = np.repeat(self.begin[x] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.all_bytes[at].tobytes()


def forget_long(known: dict[str, bytes], fresh: Iterable[str]) -> int:
    """Takes out the long ones of the fresh entries; the number of characters of the others."""
    chars = 0
    for s in fresh:
        if len(s) > LONG_KEPT:
            del known[s]
        else:
            chars += len(s)
    return chars


AFTER_WHITE = regex.compile(r"\s ")


def split(text: str) -> list[str]:
    """Stretches whose pieces, each but the first with a blank before it, are those of the whole text: a blank after a character that is
    not white space always begins a piece. A text with a blank after white space is one stretch."""
    return [text] if AFTER_WHITE.search(text) else text.split(" ")


def tokens(text: Column, path: str, pattern: str, with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of a text, and its ids if asked for."""
    shared = SparkSession.active().sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Encoder(shared.value, pattern)
        for texts in batches:
            out = []
            for ids in coder.encode([t or "" for t in texts.to_pylist()]):
                row = {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(coder.decode(ids)).hexdigest()}
                if with_ids:
                    row["ids"] = np.frombuffer(ids, "<u4").tolist()
                out.append(row)
            yield pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *[("ids", pa.list_(pa.int32()))] * with_ids]))

    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return F.arrow_udf(run, kind).asNondeterministic()(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of a list of ids; null for a null list, and null if an id is not a token."""
    shared = SparkSession.active().sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = {r: t for t, r in shared.value.items()}
        for lists in batches:
            yield pa.array([None if x is None or not all(i in of for i in x) else b"".join(map(of.__getitem__, x)) for x in lists.to_pylist()], pa.binary())
    return F.arrow_udf(run, "binary").asNondeterministic()(ids)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` of every row."""
    return docs.select(F.col(id_col).alias(ID), tokens(F.col(text_col), path, pattern, with_ids).alias("t")).select(ID, "t.*")
