"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes, calibration.

Terms are all words of at most ``MOST_LABELLED`` labelled texts, those with the smallest hashes. A term weighs ``(1 + ln tf) * idf``, with
document counts over all documents, times what the labels say of it: the absolute log ratio of its smoothed shares of toxic and of clean
examples. No term is left out; one that toxic and clean texts hold alike, or that no example holds, has ratio 1 and weighs nothing.
Vectors have length 1.

Equal examples are one entry with its numbers of examples and toxic examples. Entries are sorted by their heaviest term and cut into blocks
of ``BLOCK``. A term's inverted list is cut by blocks and holds the largest weight of each block that has the term; the lists of terms that
more than ``1 / DENSE`` of the entries hold are dense rows. A query adds up block maxima to bounds for all blocks, scores the blocks with
the highest bounds, and then every block whose bound reaches its ``NEIGHBOURS`` nearest so far: the result is exact. All examples at the
last distance vote, so ties have one result. Votes weigh 1 / (distance + ``SOFT``). A monotone map gives the score; it is fitted to votes of
all examples, each from an index and weights of the ``FOLDS - 1`` parts of the examples that it isn't in.

Null and empty texts, and texts of unknown words only, are as far from one example as from any other: all vote. Repeated rows score
alike. Labels that are null, or of rows without an id, are left out; of rows that share a labelled id one text is learned, the smallest; an
id with two labels is an example of both kinds. Rows with a null id are scored, and are in neither part (held_out is null). Without toxic
labels, or without labels at all, every score is the smoothed share of toxic labels (0.5 of none). An empty table gives no rows; columns
beyond the id and the text are not read. The driver and every task hold the distinct words of the sampled texts, with their counts.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ID, TEXT, text_function
from .decontam import words

MOST_LABELLED, NEIGHBOURS, SOFT, FOLDS = 4000, 25, 0.1, 4
BLOCK, FIRST_BLOCKS, DENSE, BATCH = 64, 8, 32, 256
NEAR = 1e-6  # similarities that differ by less are ties


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.abs(np.log((toxic + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean + 0.5)))


class Examples:
    """Term counts of labelled texts as rows of a sparse matrix: row i has ``term[at[i]:at[i + 1]]``, each ``times`` times."""

    def __init__(self, at: np.ndarray, term: np.ndarray, times: np.ndarray, toxic: np.ndarray, ids: np.ndarray, n_terms: int):
        self.at, self.term, self.times, self.toxic, self.ids, self.n_terms = at, term, times, toxic, ids, n_terms
        row = np.repeat(np.arange(len(toxic)), np.diff(at))
        self.bad = np.bincount(term, toxic[row], n_terms)
        self.good = np.bincount(term, minlength=n_terms) - self.bad
        self.n_bad, self.n_good = float(toxic.sum()), float(len(toxic) - toxic.sum())

    def weights(self, idf: np.ndarray) -> np.ndarray:
        return idf * log_ratio(self.bad, self.good, self.n_bad, self.n_good)

    def part(self, keep: np.ndarray) -> "Examples":
        """The rows for which ``keep`` holds."""
        n = np.diff(self.at)
        places = np.repeat(keep, n)
        return Examples(np.append(0, np.cumsum(n[keep])), self.term[places], self.times[places], self.toxic[keep], self.ids[keep], self.n_terms)

    def queries(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [slice(a, b) for a, b in zip(self.at[:-1], self.at[1:])]
        return [(self.term[p], unit(self.times[p], weights[self.term[p]])) for p in parts]


def unit(times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = (1 + np.log(times)) * weights
    length = np.sqrt((x * x).sum())
    return x / length if length > 0 else x


class Index:
    """Entries in blocks; for each term the blocks that have it with their largest weight, and its places within them."""

    def __init__(self, examples: Examples, weights: np.ndarray):
        e = examples
        first: dict[bytes, int] = {}
        same = np.array([first.setdefault(e.term[a:b].tobytes() + e.times[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(e.at[:-1], e.at[1:]))], np.int64)
        queries = e.queries(weights)
        vectors = {i: queries[i][1] for i in first.values()}
        heaviest = {i: queries[i][0][np.argmax(x)] if len(x) else -1 for i, x in vectors.items()}
        order = sorted(vectors, key=lambda i: (heaviest[i], i))
        number = np.zeros(len(same), np.int64)
        number[order] = np.arange(len(order))
        entry_of = number[same]
        self.size = len(order)
        self.n = np.bincount(entry_of, minlength=self.size).astype(float)
        self.toxic = np.bincount(entry_of, e.toxic, self.size)
        self.least_id = np.full(self.size, np.iinfo(np.int64).max)
        np.minimum.at(self.least_id, entry_of, e.ids)
        self.share = (e.n_bad + 1) / (len(e.toxic) + 2)

        term = np.concatenate([queries[i][0] for i in order] or [np.zeros(0, np.int64)])
        entry = np.repeat(np.arange(self.size), [len(vectors[i]) for i in order]).astype(np.int64)
        weight = np.concatenate([vectors[i] for i in order] or [np.zeros(0)])
        held = np.bincount(term, minlength=e.n_terms)
        common = np.flatnonzero(held > self.size / DENSE)
        self.row = np.full(e.n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.size), np.float32)
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], entry[often]] = weight[often]

        self.begins = np.arange(0, self.size, BLOCK)
        term, entry, weight = term[~often], entry[~often], weight[~often]
        by_term = np.lexsort((entry, term))
        term, self.place, self.weight = term[by_term], entry[by_term].astype(np.int32), weight[by_term]
        block = self.place // BLOCK
        new = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(block) != 0))) if len(term) else np.zeros(0, np.int64)
        self.list_block, self.list_start = block[new].astype(np.int32), new.astype(np.int32)
        self.list_length = np.diff(np.append(new, len(term))).astype(np.int32)
        self.list_most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.lists = np.searchsorted(term[new], np.arange(e.n_terms + 1))  # a term's block lists are lists[term]:lists[term + 1]

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(vote, nearest entry) of each query (terms, weights); the entry is -1 where there are no examples."""
        vote, first = np.full(len(queries), self.share), np.full(len(queries), -1)
        for begin in range(0, len(queries) if self.size else 0, BATCH):
            part = queries[begin:begin + BATCH]
            often = np.zeros((len(part), len(self.dense)), np.float32)
            for i, (term, weight) in enumerate(part):
                rows = self.row[term]
                often[i, rows[rows >= 0]] = weight[rows >= 0]
            often = often @ self.dense
            for i, (term, weight) in enumerate(part):
                vote[begin + i], first[begin + i] = self._vote(term, weight, often[i])
        return vote, first

    def _vote(self, term: np.ndarray, weight: np.ndarray, often: np.ndarray) -> tuple[float, int]:
        rare = self.row[term] < 0
        term, weight = term[rare], weight[rare]
        length = self.lists[term + 1] - self.lists[term]
        lists, weight = spans(self.lists[term], length), np.repeat(weight, length)
        block = self.list_block[lists]
        bound = np.bincount(block, self.list_most[lists] * weight, len(self.begins)) + np.maximum.reduceat(often, self.begins)

        def similarities(open_blocks: np.ndarray) -> np.ndarray:
            """Of the entries of some blocks; -1 for others."""
            take = open_blocks[block]
            size = self.list_length[lists[take]]
            at = spans(self.list_start[lists[take]], size)
            out = often + np.bincount(self.place[at], self.weight[at] * np.repeat(weight[take], size), self.size)
            return np.where(np.repeat(open_blocks, BLOCK)[:self.size], out, -1.0)

        def last(sims: np.ndarray) -> float:
            """The similarity at which NEIGHBOURS examples are reached; -1 if they are not."""
            k = min(NEIGHBOURS, len(sims))
            top = np.argpartition(-sims, k - 1)[:k]
            top = top[np.argsort(-sims[top], kind="stable")]
            reached = np.flatnonzero(np.cumsum(self.n[top] * (sims[top] >= 0)) >= NEIGHBOURS)
            return sims[top[reached[0]]] if len(reached) else -1.0

        k = min(FIRST_BLOCKS, len(bound))
        some = np.zeros(len(bound), bool)
        some[np.argpartition(-bound, k - 1)[:k]] = True
        sims = similarities(some)
        more = (bound >= last(sims) - NEAR) & ~some
        if more.any():
            sims = np.maximum(sims, similarities(more))
        voters = np.flatnonzero(sims >= max(last(sims) - NEAR, -0.5))
        w = 1 / (np.sqrt(np.maximum(0, 2 - 2 * sims[voters])) + SOFT)
        return (w * self.toxic[voters]).sum() / (w * self.n[voters]).sum(), voters[np.argmax(sims[voters])]


def monotone(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from votes to shares of toxic labels: pooled neighbours (PAV), each smoothed by one label of either kind."""
    blocks: list[list[float]] = []
    for v in np.unique(votes):
        same = votes == v
        blocks.append([v * same.sum(), float(toxic[same].sum()), float(same.sum())])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x = np.array([0.0, *(b[0] / b[2] for b in blocks), 1.0])
    y = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    y = np.maximum.accumulate(np.concatenate((y[:1], y, y[-1:])))
    # a trace of the vote itself keeps the order of votes within a pool
    return np.maximum.accumulate(x), y


class Model:
    def __init__(self, at: dict[bytes, int], weights: np.ndarray, index: Index, knots: tuple[np.ndarray, np.ndarray] | None):
        self.at, self.weights, self.index, self.knots = at, weights, index, knots

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at = self.at
        found = sorted((at[w], n) for w, n in Counter(words(text)).items() if w in at)
        term, times = np.array(found, np.int64).reshape(-1, 2).T
        return term, unit(times, self.weights[term])

    def score(self, texts: list[str]) -> list[dict]:
        distinct, out = list(dict.fromkeys(texts)), {}
        for i in range(0, len(distinct), BATCH):
            part = distinct[i:i + BATCH]
            queries = [self.query(t) for t in part]
            votes, first = self.index.votes(queries)
            if self.knots is None:
                score = np.full(len(part), self.index.share)
            else:
                score = 0.99 * np.interp(votes, *self.knots) + 0.01 * votes
            for text, (term, _), s, f in zip(part, queries, score.tolist(), first.tolist()):
                out[text] = {"score": s, "nearest_id": int(self.index.least_id[f]) if f >= 0 else None, "n_terms": len(term)}
        return [out[t] for t in texts]


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``(id, toxic, words, times)`` of rows ``(id, toxic, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sorted(Counter(words(t)).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "toxic": batch.column(1), "words": pa.array([[w.decode() for w, _ in c] for c in counts], pa.list_(pa.string())),
                                              "times": pa.array([[k for _, k in c] for c in counts], pa.list_(pa.int32()))})
    return texts.mapInArrow(run, "id bigint, toxic boolean, words array<string>, times array<int>")


def document_counts(docs: DataFrame, vocabulary: list[bytes]) -> tuple[int, np.ndarray]:
    """The number of rows, and how many of them hold each word."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = known.value, np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                n[[at[w] for w in set(words(text or "")) if w in at]] += 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(-1, held), pa.int32()), "n": pa.array(np.append(total, n[held]), pa.int64())})
    found = docs.select(TEXT).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(vocabulary) + 1, np.int64)
    n[found.column("term").to_numpy()] = found.column("n").to_numpy()  # -1 is the last place
    return int(n[-1]), n[:-1]


def cross_votes(spark: SparkSession, examples: Examples, idf: np.ndarray) -> np.ndarray:
    """Votes of the examples of each part by those of the others; a part is a task."""
    shared = spark.sparkContext.broadcast((examples, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, idf = shared.value
        for fold in (f for b in batches for f in b.column(0).to_pylist()):
            mine = np.arange(len(e.toxic)) % FOLDS == fold
            others = e.part(~mine)
            weights = others.weights(idf)
            votes, _ = Index(others, weights).votes(e.part(mine).queries(weights))
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.flatnonzero(mine), pa.int64()), "vote": pa.array(votes, pa.float64())})
    out = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "row bigint, vote double").toArrow()
    votes = np.zeros(len(examples.toxic))
    votes[out.column("row").to_numpy()] = out.column("vote").to_numpy()
    return votes


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns from labelled rows that are not held out. The sample's word counts and its words' document counts reach the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(ID).isNotNull() & ~held_out(F.col(ID)))
    sample = known.select(F.col(ID).alias("_id"), (F.col("toxic") == 1).alias("_toxic")).distinct().orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(most)
    # a hot id is one row: the smallest text, found before the shuffle
    texts = docs.select(ID, TEXT).join(F.broadcast(sample), F.col(ID) == F.col("_id")).groupBy("_id", "_toxic").agg(F.min(F.coalesce(TEXT, F.lit(""))).alias("_text"))
    rows = word_counts(texts).toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    lists = rows.column("words").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    vocabulary = [w.encode() for w in coded.dictionary.to_pylist()]
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    times = pc.list_flatten(rows.column("times")).to_numpy().astype(np.int64)
    at = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    # terms of a row ascend, as in queries
    order = np.lexsort((term, np.repeat(np.arange(len(at) - 1), np.diff(at))))
    examples = Examples(at, term[order], times[order], rows.column("toxic").to_numpy().astype(float), rows.column("id").to_numpy(), len(vocabulary))
    total, n = document_counts(docs, vocabulary)
    idf = np.log((total + 1) / (n + 1)) + 1
    weights = examples.weights(idf)
    index = Index(examples, weights)
    if not examples.n_bad or not examples.n_good:
        knots = None
    else:
        knots = monotone(cross_votes(docs.sparkSession, examples, idf), examples.toxic)
    return Model({w: i for i, w in enumerate(vocabulary)}, weights, index, knots)


def score(docs: DataFrame, model: Model, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, held_out, score, predicted, nearest_id, n_terms)`` of every row; nearest_id is the nearest example's smallest doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    s = text_function(lambda: shared.value.score, "struct<score: double, nearest_id: bigint, n_terms: bigint>")(F.col(text_col))
    out = docs.select(F.col(id_col).alias(ID), s.alias("s"))
    return out.select(ID, held_out(F.col(ID)).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.nearest_id", "s.n_terms")
