"""Ranked lexical search by NRA: impact-sorted lists are read in step, documents keep score intervals, until the best are resolved.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. N documents (rows) hold a term, L terms in
all, repeats included; n is a document's number of them, df the documents that hold a term, tf its occurrences in a document. A term weighs
``w = floor(1000 * ln((2N + 2) / (2df + 1)))``, in doubles; the rest is integer arithmetic, rounding down: with ``m = 75 + 25nN div L`` a term of
an item adds ``w * (10**9 * tf div (1000 * tf + 12 * m))``, once for each time the item holds it. An item's ``k`` documents of highest score above 0 are
returned, equal scores by doc_id (null last), ranked from 1.

Documents are indexed in blocks of bounded size: one pass writes for each block its documents' sizes and, for the terms of the items,
postings of document and tf. Sizes and document counts are summed over all blocks. A second pass reads the index block by block: every
posting gets its impact, a list is sorted by falling impact, and each item reads its lists from the top, ever further in each round. A
document's lower bound is what has been read of it; its upper bound adds, for lists it was not yet seen in, the impact they have come down to.
Reading goes on until no document outside can still reach the k-th score or tie with it, and all that can are known exactly. A task keeps the
best of its earlier blocks, so that later ones are read less far. The best of all tasks are ranked in two steps, by item and share of
the tasks and then by item. No list, term or item is ever gathered whole; a term in every document is a list as long as a block.

Items are read to the driver in blocks of ``BLOCK_ITEMS``, each a pass over the index; they are a stated query set. An item without terms (or null) finds
nothing; items with equal or null ids are told apart, each with its own ranks. A null or empty text holds no term and does not count. Rows
that repeat a doc_id are documents of their own. Without documents or items the result is empty.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TEXT, stored

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BEST = 20
#: Documents and characters of a block; postings first read of a list; items sent out at a time; shares of tasks ranked on their own.
BLOCK_DOCS, BLOCK_CHARS, FIRST_READ, BLOCK_ITEMS, SHARES = 16_384, 16_000_000, 256, 5_000, 64
NONE = -(1 << 62)  # of a block without documents yet: below any score
NULL_ID = (1 << 63) - 1


def terms(text: str | None) -> list[str]:
    return TERMS.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _index(number: dict[str, int]):
    """Blocks of documents: ids and sizes of those with terms; per known term its number, how many postings, and these."""
    def row(ids, sizes, docs, known, counts):
        d, t, c = (np.fromiter(x, np.int64, len(x)) for x in (docs, known, counts))
        order = np.argsort(t, kind="stable")
        found, df = np.unique(t, return_counts=True)
        packed = {"ids": ids, "sizes": sizes, "terms": found, "df": df, "docs": d[order], "tf": c[order]}
        return pa.RecordBatch.from_pydict({k: pa.array([np.array(v, np.int64).astype(np.int32 if k in ("docs", "terms", "df") else np.int64).tobytes()], pa.binary()) for k, v in packed.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, docs, known, counts, size = [], [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not (own := terms(text)):
                    continue
                for t, c in Counter(filter(None, map(number.get, own))).items():  # numbers start from 1
                    docs.append(len(ids))
                    known.append(t)
                    counts.append(c)
                ids.append(NULL_ID if doc is None else doc)
                sizes.append(len(own))
                size += len(text)
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield row(ids, sizes, docs, known, counts)
                    ids, sizes, docs, known, counts, size = [], [], [], [], [], 0
        if ids:
            yield row(ids, sizes, docs, known, counts)
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term -1: documents, -2: their terms; others: documents that hold the term."""
    total: Counter[int] = Counter()
    for batch in batches:
        for sizes, found, df in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n = np.frombuffer(sizes, np.int64)
            total[-1] += len(n)
            total[-2] += int(n.sum())
            for t, c in zip(np.frombuffer(found, np.int32).tolist(), np.frombuffer(df, np.int32).tolist()):
                total[t] += c
    yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})


def leading(score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by document."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((doc[at], -score[at]))][:k]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray], first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (scores, doc ids) of a block's documents and those ``held`` before.

    A list is (documents, impacts), impacts falling and above 0. Scores stay below 2**53, so sums of doubles are exact."""
    lower, seen = np.zeros(len(ids)), np.zeros((len(lists), len(ids)), bool)
    read, step = [0] * len(lists), first_read
    while True:
        bound = np.zeros(len(lists))
        for t, (docs, impact) in enumerate(lists):
            part = docs[read[t]:read[t] + step]
            lower[part] += impact[read[t]:read[t] + step]
            seen[t, part] = True
            read[t] += len(part)
            if read[t] < len(docs):
                bound[t] = impact[read[t]]
        step *= 2
        score, doc = np.concatenate((held[0], lower)), np.concatenate((held[1], ids))
        top = leading(score, doc, k)
        kth = score[top[-1]] if len(top) == k else 0.0
        most = bound.sum()
        if most and most >= kth:  # a document not seen at all may still come in, or tie
            continue
        able = np.flatnonzero((lower > 0) & (lower + most >= kth))
        upper = lower[able] + bound @ ~seen[:, able]
        if ((upper > lower[able]) & (upper >= kth)).any():
            continue
        top = top[score[top] > 0]
        return score[top], doc[top]


def _search(items: list[dict[int, int]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0), np.zeros(0, np.int64)
        best = [none] * len(items)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids, sizes, found, df, docs, tf = (np.frombuffer(b, t) for b, t in zip(row, (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64)))
                m = 100 - 25 + 25 * sizes * n_docs // n_terms
                impact = np.repeat(weight[found], df) * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
                cuts, lists = np.cumsum(df)[:-1], {}
                for t, d, i in zip(found.tolist(), np.split(docs, cuts), np.split(impact, cuts)):
                    order = np.argsort(-i, kind="stable")
                    order = order[:np.count_nonzero(i)]
                    if len(order):
                        lists[t] = d[order], i[order].astype(np.float64)
                for q, own in enumerate(items):
                    mine = [(lists[t][0], lists[t][1] * c) for t, c in own.items() if t in lists]
                    if mine:
                        best[q] = nra(mine, ids, k, best[q])
        number = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
        score, doc = (np.concatenate([b[i] for b in best] or [none[i]]) for i in (0, 1))
        yield pa.RecordBatch.from_pydict({"item": pa.array(number, pa.int32()), ID: pa.array(doc, pa.int64(), mask=doc == NULL_ID), "score": pa.array(score.astype(np.int64), pa.int64())})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of every row of ``items (item_id, text)``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias(ID), F.col(text_col).alias(TEXT))
    out = None
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    kind = dict(items.dtypes)["item_id"]
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", TEXT), F.lit(blocks)) == b).select("item_id", TEXT).collect()
        part = _search_block(spark, plain, [(r["item_id"], terms(r[TEXT])) for r in rows], kind, k)
        out = part if out is None else out.union(part)
    return out


def _search_block(spark, docs: DataFrame, items: list[tuple], kind: str, k: int) -> DataFrame:
    number = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}), 1)}
    index = stored(docs.mapInArrow(_index(number), "ids binary, sizes binary, terms binary, df binary, docs binary, tf binary"))
    counts = index.select("sizes", "terms", "df").mapInArrow(_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    held = {r["term"]: r["n"] for r in counts.collect()}  # one row for each term of the items
    n_docs, n_terms = held.get(-1, 0), max(1, held.get(-2, 0))
    weight = np.zeros(len(number) + 1, np.int64)
    for t in number.values():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1)))
    wanted = [dict(Counter(number[t] for t in own)) for _, own in items]
    best = index.mapInArrow(_search(wanted, weight, n_docs, n_terms, k), f"item int, {ID} bigint, score bigint")
    order = [F.desc("score"), F.asc_nulls_last(ID)]
    share = best.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {kind}")
    return last.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), ID, "score")
