"""License scans: a positional index of the templates' rarest words, offsets that agree, mandatory key phrases.

A text's words are runs of ASCII letters and digits (letters lower-cased) and of anything outside ASCII. A template is a sequence of words
with a label, and key phrases that must stand at their places. Its postings are kept under its ``KEYS`` words of the highest IDF, counted
over all documents. A document's words that have postings are looked up; each gives (template, begin of the template in the document).
Begins on which enough of the template's postings agree (all, for a template of one phrase) are verified: every key phrase must stand
there word by word, and at least ``SIMILARITY`` of all words must agree. The score is the largest share of agreeing words.

A template may take or miss a word for every ``WORDS_PER_SLIP`` it has. Those of fewer words stand at fixed places. For longer ones the
begins may drift by so many words, the share is that of words in common order (longest common subsequence), and a key phrase may have one
word put in.

Base phrases are templates whose only key phrase is the whole, so each place is found by its rarest word and verified.
Null and empty texts have no words and no labels, and score 0. Repeated rows are judged alike. Without documents there are no rows.
"""

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, text_function

KEYS, SIMILARITY, WORDS_PER_SLIP = 3, 0.8, 8
#: The base phrases, and the opening words of further licences with the phrases that tell them from others.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("gpl-3.0", "gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license", "version 2"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2"]),
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", ["redistribution and use", "source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ["permission to use copy modify"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def in_order(a: tuple, b: list) -> int:
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for i, y in enumerate(b):
            new.append(best[i] + 1 if x == y else max(best[i + 1], new[i]))
        best = new
    return best[-1]


def stands(phrase: tuple, ws: list) -> bool:
    """Whether the phrase's words stand in ws one after the other, with at most one other word among them."""
    for at, w in enumerate(ws):
        if w == phrase[0] and in_order(phrase, ws[at:at + len(phrase) + 1]) == len(phrase):
            return True
    return False


class Index:
    """Templates and their postings under their rarest words, for document counts of all template words."""

    def __init__(self, counts: dict[str, int]):
        self.templates = [(label, tuple(p.encode().split()), [(0, tuple(p.encode().split()))], True) for p, label in BASE.items()]
        for label, text, phrases in TEMPLATES:
            own = tuple(text.encode().split())
            places = [(next(i for i in range(len(own)) if own[i:i + len(p)] == p), p) for p in (tuple(x.encode().split()) for x in phrases)]
            self.templates.append((label, own, places, False))
        self.postings = defaultdict(list)
        self.needed = []
        for t, (_, own, _, base) in enumerate(self.templates):
            rare = sorted(set(own), key=lambda w: (counts.get(w.decode(), 0), w))[:1 if base else KEYS]
            held = [(w, i) for i, w in enumerate(own) if w in rare]
            # a base phrase is found by one posting; others may miss a word, so half of the postings are enough
            self.needed.append(1 if base else -(-len(held) // 2))
            for w, i in held[:1] if base else held:
                self.postings[w].append((t, i))
        self.keys = set(self.postings)

    def scan(self, text: str) -> dict:
        ws = words(text)
        out = {"n_words": len(ws), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
        keys = self.keys.intersection(ws)
        if not keys:
            return out
        votes = Counter((t, i - k) for i, w in enumerate(ws) if w in keys for t, k in self.postings[w])
        begins, base, more = [], set(), set()
        drifting = defaultdict(list)
        for t, b in votes:
            if len(self.templates[t][1]) >= WORDS_PER_SLIP and not self.templates[t][3]:
                drifting[t].append(b)
        for t, at in drifting.items():
            label, own, phrases, _ = self.templates[t]
            slips, at = len(own) // WORDS_PER_SLIP, sorted(at)
            lo = n = 0
            for hi, b in enumerate(at):  # votes for begins of b - slips to b
                n += votes[t, b]
                while at[lo] < b - slips:
                    n -= votes[t, at[lo]]
                    lo += 1
                if n >= self.needed[t]:
                    near = ws[max(0, b - 2 * slips):max(0, b + len(own) + 2 * slips)]
                    share = in_order(own, near) / len(own)
                    if share >= SIMILARITY and all(stands(p, near) for _, p in phrases):
                        out["score"] = max(out["score"], share)
                        more.add(label)
        for (t, b), n in votes.items():
            if t in drifting:
                continue
            label, own, phrases, is_base = self.templates[t]
            if n < self.needed[t] or any(b + k < 0 or tuple(ws[b + k:b + k + len(p)]) != p for k, p in phrases):
                continue
            share = sum(0 <= b + k < len(ws) and ws[b + k] == w for k, w in enumerate(own)) / len(own)
            if share < SIMILARITY:
                continue
            out["score"] = max(out["score"], share)
            if is_base:
                begins.append(b)
                base.add(label)
            else:
                more.add(label)
        if begins:
            out |= {"n_base": len(begins), "first_word": min(begins), "last_word": max(begins)}
        return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more))}


def document_counts(docs: DataFrame, text_col: str = TEXT) -> dict[str, int]:
    """In how many documents each template word stands; one row per word reaches the driver."""
    wanted = {w.encode() for p in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in p.split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(wanted.intersection(words(text or "")))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})
    return {r["word"]: r["n"] for r in docs.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row."""
    counts = document_counts(docs, text_col)

    def start():
        index = Index(counts)
        return lambda texts: [index.scan(t) for t in texts]
    found: Column = text_function(start, "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double>")(F.col(text_col))
    return docs.select(F.col(id_col).alias(ID), found.alias("s")).select(ID, "s.*")
