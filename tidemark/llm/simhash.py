"""Near-duplicate documents: SimHash fingerprints, a segment-popcount embedding, a grid join, and exact Hamming checks.

A fingerprint's bits are cut into segments; the numbers of set bits of all segments are a point. The Manhattan distance of two points
never exceeds the Hamming distance of their fingerprints. If the segments are dealt to ``groups`` and the whole distance is at most
``distance``, one group has a distance of at most ``distance // groups``; with 3 groups and 4 bits that is 1. So every pair meets in a
grid cell of some group if each point is written to its own cell of each group and to the cells one step up. Pairs of a cell are then
checked exactly.

Only distinct fingerprints take part, as one row each; copies are one fingerprint. Cells travel as packed arrays in buckets of bounded
size. A cell gives the edges of a spanning forest of its links, never all pairs: points within reach of a leader join it at once, and
what stays apart is compared until it is joined.

Null and empty texts have fingerprint zero, and so have texts of white space; zero is linked like any other. Repeated rows are copies.
An empty table gives an empty result. A null doc_id is an error of the table: such rows keep a fingerprint, and never become a class id.
A class whose rows all have null ids has a null class id, and ``keep_one`` keeps one of its rows; beside a row with an id they are copies.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut_lineage

from .common import ID, TEXT, components, roots, text_function

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENT_BITS, GROUPS = 2, 3
#: Packed entries (16 bytes each) of one bucket, and texts' shingles unpacked at a time.
BUCKET_ENTRIES, BLOCK = 1_000_000, 50_000


def simhash(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; ASCII letters are lower-cased; no words: 0."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        cut = map(slice, starts[i:i + BLOCK], ends[i:i + BLOCK])
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(seed)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, words: int = SHINGLE, seed: int = SEED) -> Column:
    """The text's SimHash as a signed 64-bit integer."""
    def start():
        return lambda texts: [{"v": v - (1 << 64) if (v := simhash(t, words, seed)) >> 63 else v} for t in texts]
    return text_function(start, "struct<v: bigint>")(text)["v"]


def cells(x: np.ndarray, bits: int = SEGMENT_BITS, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """(cell keys, index of the point) of every own cell and every cell one step up; the key's last digit is the group."""
    n = 64 // bits
    one = np.uint64((1 << bits) - 1)
    counts = [np.bitwise_count((x >> np.uint64(bits * i)) & one).astype(np.int64) for i in range(n)]
    keys, owner, every = [], [], np.arange(len(x))
    for g in range(groups):
        own = range(g, n, groups)
        power = {i: (bits + 1) ** k * groups for k, i in enumerate(own)}
        base = sum(counts[i] * power[i] for i in own) + g
        keys.append(base)
        owner.append(every)
        for i in own:
            room = counts[i] < bits
            keys.append(base[room] + power[i])
            owner.append(every[room])
    return np.concatenate(keys), np.concatenate(owner)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether fingerprints link: the popcount bound first (a Manhattan distance of whole words), then the exact distance."""
    out = np.abs(np.bitwise_count(a).astype(np.int8) - np.bitwise_count(b).astype(np.int8)) <= most
    out[out] = hamming(a[out], b[out]) <= most
    return out


def cell_links(x: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (indices) that join all that is linked within one large cell.

    Leaders take in all within reach. Then leaders' groups are compared with each other, only while they are apart, and only those
    whose leaders lie within three reaches.
    """
    left, group_of, edges, leaders = np.arange(len(x)), np.zeros(len(x), np.int64), [], []
    while len(left):
        lead = left[0]
        got = hamming(x[left], x[lead]) <= most
        group_of[left[got]] = len(leaders)
        edges += [(lead, j) for j in left[got][1:].tolist()]
        leaders.append(lead)
        left = left[~got]
    if len(leaders) == 1:
        return edges
    label, members = np.arange(len(leaders)), np.split(np.argsort(group_of, kind="stable"), np.cumsum(np.bincount(group_of))[:-1])
    heads = x[leaders]
    for i in range(len(leaders)):
        for j in (np.flatnonzero(hamming(heads[i + 1:], heads[i]) <= 3 * most) + i + 1).tolist():
            if label[i] == label[j]:
                continue
            small, big = sorted((members[i], members[j]), key=len)
            found = None
            for m in small.tolist():
                hit = np.flatnonzero(hamming(x[big], x[m]) <= most)
                if len(hit):
                    found = (m, int(big[hit[0]]))
                    break
            if found:
                edges.append(found)
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return edges


def bucket_links(key: np.ndarray, x: np.ndarray, most: int = DISTANCE, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints that share a cell and link, as a spanning forest of the bucket."""
    order = np.lexsort((x, key))
    key, x = key[order], x[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1])))
    key, x = key[fresh], x[fresh]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(first, len(key)))
    place = np.arange(len(key)) - np.repeat(first, sizes)
    size_of = np.repeat(sizes, sizes)
    a, b = [], []
    live = np.flatnonzero((size_of > 1) & (size_of <= small))
    for step in range(1, int(min(small, sizes.max(initial=0)))):
        live = live[place[live] + step < size_of[live]]
        hit = live[near(x[live], x[live + step], most)]
        a.append(x[hit])
        b.append(x[hit + step])
    for f, s in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist()):
        part = x[f:f + s]
        e = np.array(cell_links(part, most), np.int64).reshape(-1, 2)
        a.append(part[e[:, 0]])
        b.append(part[e[:, 1]])
    a, b = np.concatenate([*a, x[:0]]), np.concatenate([*b, x[:0]])
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = nodes[roots(len(nodes), at[:len(a)], at[len(a):])]
    other = root != nodes
    return nodes[other], root[other]


def links(prints: DataFrame, most: int = DISTANCE, bits: int = SEGMENT_BITS) -> DataFrame:
    """``(a, b)`` edges that connect all distinct fingerprints ``(fp)`` at ``most`` or fewer differing bits."""
    groups = most // 2 + 1
    n = prints.count()
    buckets = max(1, -(-n * groups * (64 // bits) // BUCKET_ENTRIES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, owner = cells(x, bits, groups)
            to = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(to, kind="stable")
            packed, cuts = np.stack((key[order].view(np.uint64), x[owner[order]]), 1), np.searchsorted(to[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "packed": pa.array([packed[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary())})

    def join(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(group["packed"].to_pylist()), np.uint64).reshape(-1, 2)
        a, b = bucket_links(e[:, 0].astype(np.int64), e[:, 1], most)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return prints.mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInArrow(join, "a bigint, b bigint")


def _classes(docs: DataFrame, most: int, id_col: str = ID, text_col: str = TEXT) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of each document, and ``(fp, root, component_id)`` of each distinct fingerprint; root is never null."""
    seen = cut_lineage(docs.select(F.col(id_col).alias(ID), fingerprint(F.col(text_col)).alias("fp")))
    prints = cut_lineage(seen.groupBy("fp").agg(F.min(ID).alias("least")))
    part = components(links(prints.select("fp"), most)).withColumnsRenamed({"node": "fp"})
    classes = prints.join(part, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return seen, cut_lineage(classes.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, most: int = DISTANCE, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, fp, component_id)``: each document's fingerprint and the smallest doc_id reachable over links, itself included."""
    seen, per_print = _classes(docs, most, id_col, text_col)
    return seen.join(per_print, "fp").select(ID, "fp", "component_id")


def keep_one(docs: DataFrame, most: int = DISTANCE) -> DataFrame:
    """The documents whose doc_id is their class's smallest, all columns kept. Rows that repeat a kept doc_id stay.

    Of a class without any doc_id, the row with the smallest hash of its columns (maps left out) stays.
    """
    seen, per_print = _classes(docs, most)
    kept = seen.join(per_print, "fp").where(F.col(ID) == F.col("component_id")).select(ID).distinct()
    named = docs.join(kept, ID, "left_semi").select(docs.columns)
    hashed = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    bare = docs.where(F.col(ID).isNull()).select(F.struct(*docs.columns).alias("row"), hashed.alias("order"), fingerprint(F.col(TEXT)).alias("fp"))
    lone = bare.join(per_print.where("component_id is null").select("fp", "root"), "fp").groupBy("root").agg(F.min_by("row", "order").alias("row"))
    return named.union(lone.select("row.*"))
