"""Exact substring deduplication: windows of words travel as super-k-mers to the bucket of their minimiser, where sorting finds equal ones.

A word is a maximal run of characters other than blank, \\t, \\n, \\v, \\f and \\r, a window ``k`` consecutive words of one text. A word is removed
if a window over it also starts in a document with a smaller doc_id; windows are judged on the input. Kept words are joined by one blank.

The minimiser of a window is the least hash among its runs of ``m`` words. Consecutive windows with the same minimiser form a super-k-mer,
one string of their words: about 3 words are sent for a window instead of 13. Rows are stored in blocks of bounded size, a compressed
row for each block, as they come. A block's distinct super-k-mers go out with the smallest and largest doc_id of their rows, so that a
passage is one entry of a block however many rows hold it. A bucket cuts its strings into windows again and sorts them by a 64-bit hash;
neighbours are compared as text, so equal windows are exactly those counted. Only strings with a window seen in a smaller document are
answered, to their block, which cuts its texts. Nothing is shuffled by document, passage or word.

A first pass counts the windows of every bucket. A bucket of more than ``HOT`` times the mean (a minimiser in very many contexts) is split by
the window's own hash, whatever its size: its windows travel in shorter strings. Equal windows still meet. What is sent to the tasks of
that is two bytes a bucket, a bucket standing for ``BUCKET_WINDOWS`` windows.

A null or empty text has no words, and becomes the empty text. A null doc_id counts as the largest: such rows lose what other rows
hold, but nothing to each other. Rows that repeat a doc_id are one document: they lose nothing to each other either. An empty table gives an
empty result. A text longer than a block is a block of its own.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, stored

WINDOW, MINIMISER = 13, 3
#: Bytes of a block; windows of a bucket; times the mean from which on a bucket is split; bytes cut at a time; level of compression.
BLOCK_BYTES, BUCKET_WINDOWS, HOT, PART_BYTES, LEVEL = 6_000_000, 500_000, 3, 1_000_000, 5
LAST = (1 << 63) - 1
MIX, BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) <= n:
            cls.up, cls.down = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` entries from each place on (fewer at the end): sum of h[i + j] * MIX**j, mixed."""
    out, reach, power = np.zeros(len(h), np.uint64), 0, 1
    wide, width, rest = h.copy(), 1, size
    while rest:  # windows of the powers of two of ``size``, each a sum of two of half the width
        if rest & 1:
            out[:len(h) - reach] += wide[reach:] * np.uint64(power)
            reach, power = reach + width, power * pow(MIX, width, 1 << 64) % (1 << 64)
        step = wide.copy()
        step[:-width] += wide[width:] * np.uint64(pow(MIX, width, 1 << 64))
        wide, width, rest = step, 2 * width, rest >> 1
    return mixed(out)


def least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` entries from each place on, for places that have so many."""
    width = 1
    while 2 * width <= size:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    return np.minimum(h[:len(h) - (size - width)], h[size - width:]) if size > width else h


class Words:
    """The words of consecutive texts in a buffer of UTF-8: ``data`` has each text's words with one blank between them, word w standing at
    ``begin[w]:end[w]``; the words of text t are ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        blank = BLANK[raw]
        before, after = np.append(True, blank[:-1])[:len(raw)], np.append(blank[1:], True)[:len(raw)]
        full = starts < stops
        before[starts[full]] = True
        after[stops[full] - 1] = True
        opens, closes, keep = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after), ~(blank & before)
        place = np.cumsum(keep) - 1
        text = raw[keep]
        text[BLANK[text]] = 32
        self.data, self.begin, self.end = text.tobytes(), place[opens], place[closes] + 1
        self.first = np.append(np.searchsorted(opens, starts), len(opens))
        Powers.to(len(text))
        sums = np.append(np.uint64(0), np.cumsum(text * Powers.up[:len(text)]))
        self.hash = mixed((sums[self.end] - sums[self.begin]) * Powers.down[self.begin])


def parts_of(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """The texts in parts of about ``PART_BYTES``: number of a part's first text, where it starts, its words."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + PART_BYTES, "right")))
        at = int(starts[lo])
        yield lo, at, Words(raw[at:int(stops[hi - 1])], starts[lo:hi] - at, stops[lo:hi] - at)
        lo = hi


def buffer_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow column of texts without nulls as bytes, and where each text starts and stops."""
    column = pa.concat_arrays(texts.cast(pa.large_binary()).chunks) if len(texts) else pa.array([], pa.large_binary())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return raw, cuts[:-1], cuts[1:]


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte place by byte place."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), LEVEL)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Cutter:
    """Cuts texts into super-k-mers of ``k``-word windows, dealt into ``buckets`` by minimiser; bucket b is split into ``parts[b]``."""

    def __init__(self, k: int, m: int, buckets: int, parts: np.ndarray | None = None):
        self.k, self.m, self.buckets, self.parts = k, min(m, k), buckets, parts

    def cut(self, words: Words) -> tuple[np.ndarray, ...]:
        """Of each super-k-mer: number of its text, first word of all, windows, bucket key."""
        none, total = np.zeros(0, np.int64), len(words.begin)
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        own = np.flatnonzero(np.arange(total) + self.k <= words.first[1:][doc])
        if not len(own):
            return none, none, none, none
        low = least(rolled(words.hash, self.m)[:total - self.m + 1], self.k - self.m + 1)[own]
        key = ((low >> np.uint64(16)) % np.uint64(self.buckets)).astype(np.int64)
        if self.parts is not None and (self.parts > 1).any():
            hot = np.flatnonzero(self.parts[key] > 1)
            whole = (rolled(words.hash, self.k)[own[hot]] >> np.uint64(8)) % self.parts[key[hot]].astype(np.uint64)
            key[hot] += self.buckets * (1 + whole.astype(np.int64))
        doc = doc[own]
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        return doc[first], own[first], np.diff(np.append(first, len(own))), key[first]

    def pieces(self, words: Words) -> tuple[list[int], np.ndarray, list[int], list[bytes]]:
        """The same with the first word counted in its text, and without the windows: text, first word, bucket key, words of each."""
        doc, at, n, key = self.cut(words)
        strings = [words.data[i:j] for i, j in zip(words.begin[at].tolist(), words.end[at + n + self.k - 2].tolist())]
        return doc.tolist(), at - words.first[doc], key.tolist(), strings


def block_pieces(cutter: Cutter, texts: pa.ChunkedArray, who: np.ndarray) -> tuple[dict[int, list[bytes]], dict[bytes, list[int]]]:
    """The distinct super-k-mers of a block, in order, by bucket; the smallest and largest document of each."""
    held: dict[bytes, list[int]] = {}
    keyed: dict[int, list[bytes]] = {}
    for number, _, words in parts_of(*buffer_of(texts)):
        doc, _, keys, strings = cutter.pieces(words)
        for w, key, string in zip(who[np.array(doc, np.int64) + number].tolist(), keys, strings):
            known = held.get(string)
            if known is None:
                held[string] = [w, w]
                keyed.setdefault(key, []).append(string)
            elif w < known[0]:
                known[0] = w
            elif w > known[1]:
                known[1] = w
    for strings in keyed.values():
        strings.sort()
    return keyed, held


def firsts(strings: list[bytes], first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all strings in turn the smallest document of any equal window, ``first`` being those of the strings; and
    where each string's windows begin."""
    whole = b"\n".join(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    hashed, begin, end, of = [], [], [], []
    for number, at, words in parts_of(np.frombuffer(whole, np.uint8), starts, starts + sizes):
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        own = np.flatnonzero(np.arange(len(text)) + k <= words.first[1:][text])
        hashed.append(rolled(words.hash, k)[own])
        begin.append(words.begin[own] + at)
        end.append(words.end[own + k - 1] + at)
        of.append(text[own] + number)
    hashed, begin, end, of = (np.concatenate(x) for x in (hashed, begin, end, of))
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    at = np.flatnonzero(same)
    here, there = order[at], order[at + 1]
    alike = all(whole[a:b] == whole[c:d] for a, b, c, d in zip(*(x.tolist() for x in (begin[here], end[here], begin[there], end[there]))))
    if alike:
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.append(0, ~same))[:len(order)]
    else:  # two windows of one hash: tell them apart by their words
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist())])
    smallest = np.full(int(group.max()) + 1, LAST, np.int64)
    np.minimum.at(smallest, group, first[of])
    n = np.bincount(of, minlength=len(strings))
    return smallest[group], np.cumsum(n) - n


def _pack(block_bytes: int):
    """Rows as they come, in blocks: number, bytes of texts, and the rows, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "bytes": pa.array([size], pa.int64()), "rows": pa.array([zstandard.compress(sink.getvalue(), LEVEL)], pa.binary())})

        for batch in batches:
            _, starts, stops = buffer_of(pa.chunked_array([batch.column("text")]))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + block_bytes - size, "right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(stops[hi - 1] - starts[lo])
                lo = hi
                if size >= block_bytes or lo < batch.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()
    return run


def _rows(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_all()


def _count(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for payload in batch.column(0):
                for _, _, words in parts_of(*buffer_of(_rows(payload.as_py())["text"])):
                    _, _, n, key = cutter.cut(words)
                    keys, inverse = np.unique(key, return_inverse=True)
                    seen.update(dict(zip(keys.tolist(), np.bincount(inverse, n, len(keys)).astype(np.int64).tolist())))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})
    return run


def _send(cutter: Cutter):
    """A block's distinct super-k-mers, one row for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _rows(payload.as_py())
                keyed, held = block_pieces(cutter, rows["text"], rows["who"].to_numpy())
                ends = [packed(np.fromiter((held[s][i] for i in (0, 1) for s in x), np.int64, 2 * len(x))) for x in keyed.values()]
                strings = [zstandard.compress(b"\n".join(x), LEVEL) for x in keyed.values()]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(keyed), pa.int64()), "block": pa.array([block] * len(keyed), pa.int64()),
                                                  "strings": pa.array(strings, pa.binary()), "ends": pa.array(ends, pa.binary())})
    return run


def _answer(k: int):
    """For each block the strings of this bucket that hold a window of a smaller document, and the smallest document of all their windows."""
    def run(group: pa.Table) -> pa.Table:
        entries = [zstandard.decompress(s.as_py()).split(b"\n") for s in group["strings"]]
        ends = [unpacked(e.as_py()).reshape(2, -1) for e in group["ends"]]
        number: dict[bytes, int] = {}
        string = [np.array([number.setdefault(s, len(number)) for s in x]) for x in entries]
        first = np.full(len(number), LAST, np.int64)
        for s, e in zip(string, ends):
            np.minimum.at(first, s, e[0])
        del entries
        small, begins = firsts(list(number), first, k)
        lowest = np.minimum.reduceat(small, begins)
        sizes = np.diff(np.append(begins, len(small)))
        blocks, which, lows = [], [], []
        for block, s, e in zip(group["block"].to_pylist(), string, ends):
            hit = np.flatnonzero(lowest[s] < e[1])
            if len(hit):
                blocks.append(block)
                which.append(packed(hit))
                n = sizes[s[hit]]
                lows.append(packed(small[np.repeat(begins[s[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]))
        key = group["bucket"][0].as_py()
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([key] * len(blocks), pa.int64()), "which": pa.array(which, pa.binary()), "lows": pa.array(lows, pa.binary())})
    return run


def _cut(cutter: Cutter, schema):
    """The rows of a block without the words that their answers tell to remove."""
    k = cutter.k

    def run(stored_rows: pa.Table, answers: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = _rows(stored_rows["rows"][0].as_py())
        who, low = rows["who"].to_numpy(), {}
        if len(answers):
            keyed, _ = block_pieces(cutter, rows["text"], who)
            for key, which, lows in zip(answers["bucket"].to_pylist(), answers["which"], answers["lows"]):
                lows, at = unpacked(lows.as_py()), 0
                for i in unpacked(which.as_py()).tolist():
                    s = keyed[key][i]
                    n = s.count(b" ") + 2 - k
                    low[s] = lows[at:at + n]
                    at += n
        kept, sizes, removed = [], [], []
        for number, _, words in parts_of(*buffer_of(rows["text"])):
            gone = np.zeros(len(words.begin) + 1, np.int64)
            if low:
                for d, at, string in zip(*(cutter.pieces(words)[i] for i in (0, 1, 3))):
                    if (found := low.get(string)) is not None:
                        cut = words.first[d] + at + np.flatnonzero(found < who[number + d])
                        gone[cut] += 1
                        gone[cut + k] -= 1
            drop = np.cumsum(gone[:-1]) > 0
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                n = int(drop[a:b].sum())
                sizes.append(b - a)
                removed.append(n)
                if n:  # stretches of kept words
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], drop[a:b], [True]))))
                    kept.append(b" ".join(words.data[i:j] for i, j in zip(words.begin[a + edge[::2]].tolist(), words.end[a + edge[1::2] - 1].tolist())))
                else:
                    kept.append(words.data[words.begin[a]:words.end[b - 1]] if a < b else b"")
        out = to_arrow_schema(schema)
        return pa.table([rows["row"].combine_chunks().cast(out.field("row").type), pa.array(kept, pa.binary()).cast(out.field("text").type), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], schema=out)
    return run


def deduplicate(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, id_col: str = ID, text_col: str = TEXT, block_bytes: int = BLOCK_BYTES,
                bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``docs`` with repeated passages removed from the text, and ``n_words``, ``n_removed`` (long) appended (after any of these names)."""
    others = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    rows = docs.select(F.struct(*(F.col(c) for c in others)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("who"))
    schema = rows.select("row", "text", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed")).schema
    blocks = stored(rows.mapInArrow(_pack(block_bytes), "block bigint, bytes bigint, rows binary"), "none")
    total, n = blocks.agg(F.sum("bytes"), F.count("*")).first()
    buckets, parallel = max(1, -(-(total or 0) // (6 * bucket_windows))), 4 * docs.sparkSession.sparkContext.defaultParallelism
    counted = blocks.select("rows").mapInArrow(_count(Cutter(k, m, buckets)), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    parts = np.ones(buckets, np.uint16)
    for r in counted.where(F.col("n") > HOT * bucket_windows).collect():  # at most one in three of the buckets
        parts[r["bucket"]] = min(65535, -(-r["n"] // bucket_windows))
    cutter = Cutter(k, m, buckets, parts)
    sent = blocks.select("block", "rows").mapInArrow(_send(cutter), "bucket bigint, block bigint, strings binary, ends binary")
    groups = sent.repartition(max(min(int(parts.sum()), parallel), -(-int(parts.sum()) // 4)), "bucket").groupBy("bucket")
    answers = groups.applyInArrow(_answer(k), "block bigint, bucket bigint, which binary, lows binary")
    width = max(1, min(n, parallel), -(-n // 16))
    out = blocks.select("block", "rows").repartition(width, "block").groupBy("block").cogroup(answers.repartition(width, "block").groupBy("block")).applyInArrow(_cut(cutter, schema), schema)
    keep = [F.col("row")[c].alias(c) if c != text_col else F.col("text").alias(text_col) for c in docs.columns if c not in ("n_words", "n_removed")]
    return out.select(*keep, "n_words", "n_removed")
