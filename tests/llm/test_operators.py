"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, common, decontam, licenses, line_dedup, periodic_runs, pii, queries, quality, ranked_search, simhash, substring_dedup, toxicity, url_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "long tale of words " * 20_000
ODD = [None, "", " \t\n", "one", "a b c", "é ñ \u3000 \x1c ß", "same text here\nand a second line", "same text here\nand a second line", LONG, "x" * 100_000, "1" * 50_000, "@" * 20_000, "1.2.3.4 " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def frame(spark, rows, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a row twice, a null doc_id, and columns named like results."""
    rows = frame(spark, ODD)
    rows = rows.union(rows.where("doc_id = 6")).union(rows.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint")))
    return rows.selectExpr("*", "1 AS line", "2 AS score", "3 AS fp", "4 AS m", "5 AS s", "6 AS n_lines", "7 AS rule", "8 AS hit", "9 AS component_id", "10 AS _id").coalesce(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    e = np.array([x for x in edges if x[0] != x[1]])
    want = common.roots(1100, e[:, 0], e[:, 1])
    assert got == {n: want[n] for n in set(e.ravel().tolist())}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1 toxicity
def test_toxicity(spark, docs, labels, odd):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    assert (rows["score"].between(0, 1)).all() and (rows["predicted"] == (rows["score"] >= 0.5)).mean() == 1
    assert ((rows["predicted"] == rows["toxic"]).mean()) > 0.85
    assert toxicity.score(odd, model).where("score is null").count() == 0 and toxicity.score(odd, model).count() == len(ODD) + 2
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(odd.where("false"), model).count() == 0


def dense_votes(x, toxic, q):
    """Votes of dense queries over dense examples, all pairs."""
    out = []
    for v in q:
        sims = np.asarray(x @ v, float)
        least = np.sort(sims)[::-1][min(toxicity.NEIGHBOURS, len(sims)) - 1]
        w = 1 / (np.sqrt(np.maximum(0, 2 - 2 * sims)) + toxicity.SOFT) * (sims >= least - toxicity.NEAR)
        out.append((w * toxic).sum() / w.sum())
    return np.array(out)


def test_toxicity_search_is_exact():
    rng = np.random.default_rng(1)
    times = rng.poisson(np.geomspace(0.004, 0.3, 300), (900, 300))
    times[300:400] = times[0]
    times[:, 7] = 0
    times[5] = 0
    row, term = np.nonzero(times)
    toxic = (rng.random(900) < 0.3).astype(float)
    e = toxicity.Examples(np.append(0, np.cumsum(np.bincount(row, minlength=900))), term, times[row, term], toxic, np.arange(900), 300)
    weights = e.weights(rng.random(300) + 1)
    index = toxicity.Index(e, weights)
    assert 0 < len(index.dense) < 300 and len(index.place) > 0
    x = np.where(times, 1 + np.log(np.maximum(times, 1)), 0) * weights
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    votes, _ = index.votes(e.queries(weights)[:420])
    assert np.abs(votes - dense_votes(x, toxic, x[:420])).max() < 1e-3


def test_toxicity_score_by_brute_force(spark, docs, labels, texts):
    """Words, document counts, weights, votes, parts and the map, without index or Spark."""
    known = {r["doc_id"]: float(r["toxic"] == 1) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    ids = sorted(d for d in known if d in texts)
    cut = lambda t: collections.Counter(re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower()))
    counts = {d: cut(t) for d, t in texts.items()}
    vocabulary = sorted({w for d in ids for w in counts[d]})
    at = {w: i for i, w in enumerate(vocabulary)}
    df = collections.Counter(w for c in counts.values() for w in c)
    idf = np.array([np.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocabulary])
    raw = lambda c: np.array([1 + np.log(c[w]) if w in c else 0 for w in vocabulary])
    examples, y = np.array([raw(counts[d]) for d in ids]), np.array([known[d] for d in ids])

    def votes(e, label, q):
        bad, good = ((e > 0) * label[:, None]).sum(0), ((e > 0) * (1 - label)[:, None]).sum(0)
        w = idf * np.abs(np.log((bad + 0.5) / (label.sum() + 1) * ((1 - label).sum() + 1) / (good + 0.5)))
        unit = lambda m: m * w / np.maximum(np.sqrt((m * m * w * w).sum(1, keepdims=True)), 1e-300)
        return dense_votes(unit(e), label, unit(q))
    part = np.arange(len(ids)) % toxicity.FOLDS
    own = np.zeros(len(ids))
    for f in range(toxicity.FOLDS):
        own[part == f] = votes(examples[part != f], y[part != f], examples[part == f])
    knots = toxicity.monotone(own, y)
    some = sorted(texts)[::5]
    v = votes(examples, y, np.array([raw(counts[d]) for d in some]))
    want = dict(zip(some, 0.99 * np.interp(v, *knots) + 0.01 * v))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(at) > 1000 and np.mean([abs(got[d] - want[d]) < 2e-3 for d in some]) > 0.99


def test_toxicity_repeated_ids(spark, docs, labels):
    """A labelled id that many rows hold is one example; a null id has a score and no part."""
    many = docs.union(*[docs.where("doc_id % 3 = 0")] * 1).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    model = toxicity.fit(many, labels.union(labels))
    assert model.index.n.sum() == toxicity.fit(docs, labels).index.n.sum()
    lost = toxicity.score(many, model).where("doc_id is null").collect()
    assert len(lost) == 1 and lost[0]["held_out"] is None and lost[0]["score"] is not None


# 2 personal data
def luhn(d):
    d = [int(c) for c in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_personal_data(spark, docs, texts, odd):
    detector = pii.fit(docs)
    for r in pii.detect(docs, detector).collect():
        base = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@+- ()9b%") for _ in range(30))
        assert pii.base_spans(t) == base_spans(t), t
    assert pii.detect(odd, detector).count() == len(ODD) + 2
    assert pii.detect(odd.where("false"), pii.fit(odd.where("false"))).count() == 0
    assert pii.redact("call +1 (222) 333-4444 now", [("phone", 5, 22)]) == "call [PHONE] now"


def test_looser_personal_data_is_found(spark):
    detector = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    planted = {"EMAIL": ["john at example dot com", "ann.lee(at)example(dot)org", "bob [at] example.net"], "CARD": ["4556.7375.8689.9855", "4556/7375/8689/9855", "3782 822463 10005"],
               "PHONE": ["171-555-2028", "(171) 555-2028", "030.1234.5678"], "IP": ["192 . 168 . 0 . 1"]}
    for kind, forms in planted.items():
        for form in forms:
            assert detector.find(f"then we saw {form} over there")["redacted"] == f"then we saw [{kind}] over there", form
    for t in ("4556.7375.8689.9856", "2024-05-17", "12/05/1999", "12345678", "1.2.3.4567", "1, 2, 3, 4", "meet at noon. Then"):
        assert detector.find(f"then we saw {t} over there")["spans"] == "", t


def test_personal_data_is_learned_from_every_row(spark):
    """Documents beyond the 20 000 with the smallest hashes teach as much; the order and the parts of the table don't matter."""
    ids = spark.range(20_100).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
    late = [r["doc_id"] for r in ids.collect()[20_000:]]
    texts = {d: f"write to user{d}@mail{d % 7}.example.com or call +1 (2{d % 90 + 10}) 555-0{d % 900 + 100}, host 10.{d % 200}.3.{d % 250}" for d in late}
    rows = ids.join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "doc_id", "left")
    counted = collections.Counter(tuple(r) for t in texts.values() for r in pii.lessons(t))
    taught = collections.Counter()
    for r in pii._taught(rows).collect():
        taught[(r["y"], *r["x"])] += r["n"]
    assert taught == counted
    detector, again = pii.fit(rows), pii.fit(rows.repartition(5))
    assert detector.thresholds and detector.thresholds == again.thresholds and (detector.trees.value == again.trees.value).all()
    assert detector.find("mail bob (at) mail3 (dot) example (dot) com")["redacted"] == "mail [EMAIL]"


def test_personal_data_lessons_are_held_in_parts(spark, monkeypatch):
    """One text or one batch of texts with very many lessons goes through in bounded batches, none made ahead, and all of them are counted."""
    many = [" ".join(f"u{d}.{i}@mail.example.com" for i in range(400)) for d in range(3)] + ["", None, "call +1 (222) 333-4444"]
    made, counted = [], collections.Counter(tuple(r) for t in many for r in pii.lessons(t or ""))
    own = pii.lessons
    monkeypatch.setattr(pii, "lessons", lambda t: (made.append(1) or r for r in own(t)))
    got = 0
    for batch in pii._teach(iter([pa.record_batch({"text": many})])):
        assert 0 < len(batch) <= pii.LESSONS and len(made) <= got + pii.LESSONS
        got += len(batch)
    assert got == len(made) == counted.total() > 3 * pii.LESSONS
    monkeypatch.undo()
    taught = collections.Counter()
    for r in pii._taught(spark.createDataFrame([(t,) for t in many], "text string").coalesce(1)).collect():
        taught[(r["y"], *r["x"])] += r["n"]
    assert taught == counted


def test_personal_data_results_are_held_in_parts(spark, monkeypatch):
    """A batch of texts is answered in parts: what was found is sent on before much more is read, row by row the same, ids null or repeated."""
    texts = [None, "", "a@b.de " * 50, *(f"u{i}@mail.example.com and +1 (222) 333-4444 " * 3 for i in range(40)), "x" * 5000, None]
    ids = [None, 7, 7, *range(len(texts) - 3)]
    want = [(i, pii.Detector(None, {}).find(t or "")) for i, t in zip(ids, texts)]
    monkeypatch.setattr(pii, "FOUND", 1000)
    at = 0
    for part in pii._found(iter([pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": texts})]), pii.Detector(None, {})):
        assert sum(len(t or "") for t in texts[at:at + len(part) - 1]) < 1000
        assert [(r.pop("doc_id"), r) for r in part.to_pylist()] == want[at:at + len(part)]
        at += len(part)
    assert at == len(texts)
    rows = spark.createDataFrame(list(zip(map(str, ids), texts, ids)), "key string, text string, doc_id bigint").coalesce(1)
    got = pii.detect(rows, pii.Detector(None, {}), id_col="key")
    assert dict(got.dtypes)["doc_id"] == "string" and [(r["doc_id"], r["redacted"]) for r in got.collect()] == [(str(i), r["redacted"]) for i, r in want]


# 3 BPE
def test_bpe(spark, encoding, odd, texts):
    ranks, own = encoding
    rng = random.Random(1)
    made = ["".join(rng.choice("aab \n\t'stéñ12.,　\x1c🙂") for _ in range(rng.randrange(60))) for _ in range(500)] + ["a" * 300 + " " * 40 + "ab" * 200, "x" * 5000]
    for few in (0, 10**9):
        bpe.FEW_PIECES = few
        coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
        for t, ids in zip(made, coder.encode(made)):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t), t
            assert coder.decode(ids) == t.encode()
    bpe.FEW_PIECES = 2000
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(odd, path, public_tokenizers.PATTERN, with_ids=True)
    for r in out.withColumn("back", bpe.decode(F.col("ids"), path)).collect():
        t = "one" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        assert r["n_tokens"] == len(r["ids"]) and bytes(r["back"]) == t.encode() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        if len(t) < 1000:
            assert r["ids"] == own.encode_ordinary(t)
    assert bpe.encode(odd.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_caches_are_bounded_by_characters(encoding, monkeypatch):
    ranks, own = encoding
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5000)
    monkeypatch.setattr(bpe, "KEPT_CHARS", 20_000)
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    made = [f"def f{i}():\n    return {i} + x\n" * 40 + "y" * 700 + str(i) for i in range(80)] + [f"word{i} " * 3 + f"  w{i}" for i in range(4000)] + [f"tide{i} mark{i}" for i in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(made)] == own.encode_ordinary_batch(made)
    for known in (coder.firsts, coder.stretches, coder.pieces):
        assert max(map(len, known), default=0) <= bpe.LONG_KEPT and sum(map(len, known)) <= 20_000 + 2 * 6000


# 4 urls
def test_url_rules(spark):
    hosts = ["example.com", "www.example.com", "a.b.net", "net", "xnet", "EXAMPLE.com", "", "com", "m.www.example.com", "com.", "é.com"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "") for h in hosts for p in ("", "/", "/en/", "/en", "/es/x?y", "?/en/", "#a", "/fr/#://b")] + [None, "://", "x://a://b.net/fr/"]
    rng = random.Random(3)
    rules = queries.RULES + [(rng.choice(hosts).lower(), rng.choice(["/", "/e", "/en/", ""]), rng.choice(["allow", "block"])) for _ in range(25)] + [(None, "/", "block"), ("net", None, "allow")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, key string, best string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for block in (1000, 4):
        for r in url_rules.judge(pages, table, block=block).collect():
            u = urls[r["page_id"]]
            h = p = ""
            if u and "://" in u:
                rest = u.split("://", 1)[1]
                h = re.match("[^/?#]*", rest).group()
                p, h = re.match("[^?#]*", rest[len(h):]).group(), "".join(c.lower() if c.isascii() else c for c in h)
            fits = [(len(a) + len(b or ""), len(a), v == "block", a + (b or "")) for a, b, v in rules if a and (h == a or h.endswith("." + a)) and p.startswith(b or "")]
            best = max(fits, default=None)
            assert (r["host"], r["path"]) == (h, p)
            assert (r["rule"], r["verdict"]) == ((best[3], "block" if best[2] else "allow") if best else (None, "allow")), (u, r, best)
    assert {r["verdict"] for r in url_rules.judge(pages, table.where("false"), default="block").collect()} == {"block"}
    assert url_rules.judge(pages.where("false"), table).count() == 0


# 5 quality
def measured(t):
    w = re.findall("[^\x20\x09-\x0D]+", t)
    c, m, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            m |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(m)


def test_quality(spark, docs, labels, texts, odd):
    rules = quality.fit(docs, labels)
    for r in quality.judge(docs, rules).collect():
        got = tuple(r[c] for c in quality.COUNTS)
        assert got == measured(texts[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and r["kept"] == (not r["base_failed"] and r["rule"] is None)
    judged = quality.judge(docs, rules).join(labels, "doc_id").where("not base_failed")
    assert judged.where("kept = (quality = 1)").count() > 0.9 * judged.count()
    for r in quality.judge(odd, rules).where("doc_id is not null").collect():
        assert tuple(r[c] for c in quality.COUNTS) == measured(ODD[r["doc_id"]] or "")
    assert quality.fit(docs, labels.where("false")) == []
    assert quality.keep(odd, rules).columns == odd.columns and quality.keep(odd.where("false"), []).count() == 0


def test_decision_list_is_ordered():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.1) & (x["a"] > 0.3))
    rules = quality.learn(x, bad)
    got = np.zeros(600, bool)
    for r in rules:
        got |= quality._covers(r, x, 600)
    assert rules and (got & ~bad).sum() <= 0.03 * got.sum() and (got & bad).sum() > 0.8 * bad.sum()


# 6 chats
def test_chat(spark):
    tricky = [queries.TRICKY, "\\\\l \\h ### user: <image:1.1></turn>\n", "", None, "a\\", "é🙂#<\\c:", LONG[:5000]]
    rows = [(i % 3, i, "assistant" if i % 2 else "user: <x>#\\", t) for i, t in enumerate(tricky)] + [(None, None, None, "x"), (1, 1, "user", "tie"), (1, 1, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    for r in out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == r["conv_id"]), key=lambda t: (t[0] is not None, t))
        assert [(x["role"], x["text"]) for x in r["read"]] == [x[1:] for x in own]
        assert r["loss"] == "".join(x for _, role, x in own if role == "assistant") and r["n_turns"] == len(own)
    parts = spark.sql("""SELECT 1L conv_id, 0 turn, 'user' role, array(named_struct('kind','text','text','see <','ref',null,'units',0L), named_struct('kind','image','text',null,'ref','a.png','units',2L),
        named_struct('kind','audio','text',null,'ref','b.wav','units',4L), named_struct('kind','document','text',null,'ref',null,'units',null)) parts""")
    r = chat.format_conversations(parts).first()
    assert r["formatted"] == "### user: see \\l<image:1.2><audio:1.3><document:1.4></turn>\n" and r["attachment_tokens"] == 612
    assert [(a["placeholder"], a["ref"]) for a in r["attachments"]] == [("<image:1.2>", "a.png"), ("<audio:1.3>", "b.wav"), ("<document:1.4>", None)]
    assert chat.format_conversations(parts.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7 line dedup
def deduplicated(rows):
    """(doc_id, text) pairs with their lines cut, all pairs compared."""
    lines = [(d, i, f) for d, t in rows for i, f in enumerate(line_dedup.forms_of(t or "")) if f]
    forms = sorted({f for _, _, f in lines})
    sets, post, a, b = [line_dedup.shingles(f) for f in forms], {}, [], []
    for i, x in enumerate(sets):
        both = collections.Counter(j for g in x for j in post.get(g, ()))
        for g in x:
            post.setdefault(g, []).append(i)
        for j, n in both.items():
            if n >= line_dedup.SIMILARITY * (len(x) + len(sets[j]) - n):
                a.append(i)
                b.append(j)
    root = dict(zip(forms, common.roots(len(forms), np.array(a, int), np.array(b, int)).tolist()))
    first = {}
    for d, i, f in lines:
        first[root[f]] = min(first.get(root[f], (d, i)), (d, i))
    return [(d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if not (f := line_dedup.forms_of(t)[i]) or first[root[f]] == (d, i))) for d, t in rows]


def test_line_dedup(spark, docs, texts, odd):
    base = "the quick brown fox jumps over the lazy dog while the band plays on and on into the night number "
    more = {10_000 + i: f"{base}{i // 3}{'x' * (i % 4)}\nunique {hashlib.md5(str(i).encode()).hexdigest() * 3}\n\n{base.upper()}" for i in range(60)}
    rows = list(texts.items()) + list(more.items())
    got = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    found, want = {r["doc_id"]: r["text"] for r in got.collect()}, dict(deduplicated(rows))
    wrong = [d for d in want if want[d] != found[d]]
    assert len(wrong) <= 0.01 * len(want), wrong
    out = line_dedup.deduplicate(odd).collect()
    assert len(out) == len(ODD) + 2
    by_id = collections.defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append(r["text"])
    assert by_id[6] == [ODD[6]] * 2 and by_id[7] == [""] and by_id[0] == [""] and by_id[2] == [ODD[2]]
    assert line_dedup.deduplicate(odd.where("false")).count() == 0


def test_group_without_common_leader():
    import pyarrow as pa
    forms = [(hashlib.sha512(b"x").hexdigest() + hashlib.sha512(b"y").hexdigest())[:n] for n in (100, 130, 155)]
    t = pa.table({"band": [1] * 3, "line": [10, 20, 30], "form": forms, "ok": [True, False, False], "part": [0] * 3})
    assert line_dedup._complete(0.8)(t).to_pydict() == {"a": [20], "b": [30]}


def variants(n, seed=8):
    """Lines of one template with a few words of their own."""
    rng = random.Random(seed)
    stem = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(20)]
    out = []
    for i in range(n):
        own = list(stem)
        for k in rng.sample(range(20), rng.choice((1, 2, 3, 4))):
            own[k] = hashlib.md5(f"{i % 90}-{k}-{rng.randrange(3)}".encode()).hexdigest()[:6]
        out.append(" ".join(own))
    return out


def test_few_exact_comparisons_in_a_group(monkeypatch):
    """Lines that other links connect aren't compared, and most that are too far apart fail a bound first (F1, F2)."""
    forms = sorted(set(variants(300)))
    sets, calls, plain = [line_dedup.shingles(f) for f in forms], [], line_dedup.alike
    pairs = [(i, j) for i, x in enumerate(sets) for j in range(i) if plain(x, sets[j], 0.8)]
    label = common.roots(len(forms), *np.array([p for k, p in enumerate(pairs) if k % 7 == 0]).T)
    t = pa.table({"line": range(len(forms)), "form": forms, "ok": label == np.bincount(label).argmax(), "part": [0] * len(forms), "label": label})
    monkeypatch.setattr(line_dedup, "alike", lambda *a: calls.append(1) or plain(*a))
    got = line_dedup._complete(0.8)(t).to_pydict()
    assert all(plain(sets[a], sets[b], 0.8) and label[a] != label[b] for a, b in zip(got["a"], got["b"]))
    every = np.array([*pairs, *zip(label, range(len(forms)))]).T, np.array([*zip(got["a"], got["b"]), *zip(label, range(len(forms)))]).T
    assert (common.roots(len(forms), *every[0]) == common.roots(len(forms), *every[1])).all()
    assert len(calls) < 3 * len(forms)


def test_group_numbers_are_exact():
    for forms in (["abcdefgh", "abcdefghi", "a", "\x00", "é" * 9], ["short", "".join(map(chr, range(300, 700))), "".join(map(chr, range(350, 720)))]):
        x, sets = line_dedup.numbered(forms), [line_dedup.shingles(f) for f in forms]
        for i in range(len(forms)):
            for j in range(len(forms)):
                assert len(np.intersect1d(x[i], x[j])) == len(sets[i] & sets[j])


def test_groups_of_few_parts_go_in_pairs_of_parts(spark, monkeypatch):
    """Parting by shingles sends a line once for each of its rare shingles; groups of some parts do without (F1, F2)."""
    lines = variants(400)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string").repartition(4)

    def found(together):
        return {tuple(sorted(r)) for r in common.components(line_dedup.links(rows, len(lines), together=together)).select("node", "root").collect()}
    whole = found(10_000)
    monkeypatch.setattr(line_dedup, "_parted", lambda *a: pytest.fail("parted by shingles"))
    assert found(40) == whole


def test_shingles_as_numbers():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh é\x00") for _ in range(3000))
    x, y = line_dedup.compact(text), line_dedup.compact(text[:2600] + "\u0101" * 9 + text[2600:])
    assert isinstance(x, np.ndarray) and isinstance(y, set) and line_dedup.plain(x) == line_dedup.shingles(text)
    for n in (2390, 2400, 2410, 2600):
        z = text[:n]
        want = len(line_dedup.shingles(z) & line_dedup.shingles(text)) / len(line_dedup.shingles(z) | line_dedup.shingles(text)) >= 0.8
        assert line_dedup.alike(x, line_dedup.compact(z), 0.8) == want
    assert line_dedup.alike(x, y, 0.8) and line_dedup.alike(line_dedup.compact("short", 0), {"short"}, 0.8)


def test_large_groups_lose_no_link(spark):
    """Variants of one template, of which many lie just below the similarity asked for: parted groups give the components of whole ones."""
    rng = random.Random(8)
    stem = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(20)]
    lines = []
    for i in range(400):
        own = list(stem)
        for k in rng.sample(range(20), rng.choice((1, 1, 2, 2, 3, 4))):
            own[k] = hashlib.md5(f"{i % 90}-{k}-{rng.randrange(3)}".encode()).hexdigest()[:6]
        lines.append(" ".join(own))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string").repartition(4)

    def found(together):
        edges = line_dedup.links(rows, len(lines), together=together).collect()
        nodes = {n: k for k, n in enumerate(sorted({n for e in edges for n in e}))}
        root = common.roots(len(nodes), np.array([nodes[e["a"]] for e in edges]), np.array([nodes[e["b"]] for e in edges]))
        return {n: root[k] for n, k in nodes.items()}
    whole = found(10_000)
    assert len(whole) > 100 and len(set(whole.values())) > 1
    assert found(20) == whole and found(3) == whole


# 8 licences
@pytest.mark.parametrize("kind", ["in", "out", "other"])
def test_licenses_with_slips(kind):
    """A word put in, left out or changed anywhere outside key phrases, or put into one, loses no label of a longer template."""
    index = licenses.Index({})
    lost = []
    for label, text, phrases in licenses.TEMPLATES:
        own = text.split()
        held = {i for p in phrases for i in range(len(own)) if own[i:i + len(p.split())] == p.split() for i in range(i, i + len(p.split()))}
        for i in range(len(own)) if len(own) >= licenses.WORDS_PER_SLIP else ():
            if kind == "in" or i not in held:
                changed = own[:i] + {"in": ["any", own[i]], "out": [], "other": ["any"]}[kind] + own[i + 1:]
                found = index.scan("some words before " + " ".join(changed) + " and after")
                if label not in found["labels"].split(",") or not 0.8 <= found["score"] <= 1:
                    lost.append((label, i))
    assert not lost
    assert index.scan("permission to redistribution of charge and use any copy of this free software")["labels"] == ""


def test_licenses(spark, docs, texts, odd):
    extra = ["MIT License, mit license; cc by-nc 4.0, the Apache License", "gnu gnu general public license version 3", "mit lizenz license", LONG + " GNU General Public License"]
    rows = {**texts, **{10_000 + i: t for i, t in enumerate(extra)}}
    for r in licenses.scan(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect():
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in rows[r["doc_id"]]))
        at, found = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at += (own := [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p])
            found |= {label} if own else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
        assert found <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(odd).count() == len(ODD) + 2 and licenses.scan(odd.where("false")).count() == 0


# 9 decontamination
def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 70))], [rng.randrange(4) for _ in range(rng.randrange(90))]
        assert decontam.distance(decontam._masks(p), len(p), t)[0] == edits(p, t)


def test_decontam(spark, docs, texts, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r["item_id"]: decontam.words(r["text"]) for r in items.collect()}
    rng, rows = random.Random(5), list(texts.items())
    for k, w in held.items():
        if len(w) < decontam.MIN_WORDS:
            continue
        for share in (0.0, 0.1, 0.2):
            v = list(w)
            for p in sorted(rng.sample(range(len(w)), int(share * len(w) + 1e-9)), reverse=True):
                v[p:p + 1] = rng.choice([[b"zz"], [], [v[p], b"qq"]])
            rows.append((len(rows) + 10_000, "Some words before. " * 5 + b" ".join(v).decode().upper() + ", and words after." * 5))
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    want = {}
    for d, t in rows:
        ws = decontam.words(t)
        have = set(ws)
        for k, w in held.items():
            most = int((1 - decontam.SIMILARITY) * len(w) + 1e-9)
            if len(w) >= decontam.MIN_WORDS and sum(x not in have for x in w) <= most and (n := edits(w, ws)) <= most:
                want[d, k] = 1 - n / len(w)
    assert set(found) <= set(want) and len(found) >= 0.97 * len(want), (len(found), len(want))
    assert all(s <= want[k] + 1e-9 for k, s in found.items())
    assert decontam.contaminated(odd, items).count() == 0 and decontam.clean(odd, items).columns == odd.columns
    unnamed = items.withColumn("item_id", F.lit(None).cast("bigint"))
    assert decontam.clean(docs, unnamed).count() == decontam.clean(docs, items).count() < docs.count()
    assert {r["item_id"] for r in decontam.contaminated(docs, unnamed).collect()} == {None}
    with pytest.raises(ValueError):
        decontam.contaminated(docs, items, similarity=0.7)
    assert decontam.clean(odd, items.where("false")).count() == len(ODD) + 2 and decontam.contaminated(odd.where("false"), items).count() == 0


def test_short_items_are_found():
    """Items of 1 to 14 words, whole and with all edits allowed, against all distances; also many that share common words."""
    rng = random.Random(6)
    items = [(100 * m + k, " ".join(rng.choice(["the", "of"] if rng.random() < 0.2 else [f"w{rng.randrange(300)}"]) for _ in range(m))) for m in range(1, 15) for k in range(8)] + [(5000, ""), (5001, None)]
    held = {k: decontam.words(t or "") for k, t in items}
    texts = []
    for w in held.values():
        for n in {0, len(w) // 5}:
            v = list(w)
            for p in sorted(rng.sample(range(len(w)), n), reverse=True):
                v[p:p + 1] = rng.choice([[b"zz"], [], [v[p], b"qq"]])
            texts.append(" ".join([*(f"w{rng.randrange(900)}" for _ in range(rng.randrange(12))), b" ".join(v).decode().upper(), *(rng.choice(["the", "of", "u", "w5"]) for _ in range(rng.randrange(12)))]))
    for hits in (200_000, 7):
        decontam.BLOCK_HITS = hits
        for t, got in zip(texts, decontam.Items(items).search(texts)):
            ws = decontam.words(t)
            want = {k: 1 - n / len(w) for k, w in held.items() if w and (n := edits(w, ws)) <= len(w) // 5}
            assert {h["item_id"]: h["similarity"] for h in got} == want, t
            assert all(ws[h["start"]:h["start"] + len(held[h["item_id"]])] == held[h["item_id"]] for h in got if h["similarity"] == 1)
    decontam.BLOCK_HITS = 200_000


# 10 SimHash
def brute_print(t):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs, texts, odd):
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    assert all(out[d]["fp"] % (1 << 64) == p for d, p in prints.items())
    ids = sorted(prints)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[ids[i]] ^ prints[ids[j]]).count("1") <= 4]
    e = np.array(pairs, int).reshape(-1, 2)
    root = common.roots(len(ids), e[:, 0], e[:, 1])
    assert all(out[d]["component_id"] == ids[r] for d, r in zip(ids, root))
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2 and {r["fp"] for r in got if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_duplicates(odd.where("false")).count() == 0 and simhash.keep_one(odd).columns == odd.columns


def test_rows_without_id_are_kept(spark, odd):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in ("ash", "birch", "cedar"))
    rows = [(None, a, "en"), (None, a, "en"), (None, b, "en"), (None, b, "de"), (7, c, "en"), (None, c, "en"), (8, c, "en"), (None, None, "en"), (None, "", "en")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, ""), (0, a), (0, b), (7, c)]
    assert {r["doc_id"] for r in simhash.keep_one(odd).collect()} >= {0, 3, 6} and simhash.keep_one(odd).where("doc_id is null").count() == 0


def test_simhash_links_lose_nothing():
    rng = np.random.default_rng(2)
    heart = rng.integers(0, 1 << 64, 40, np.uint64)
    x = np.unique(np.concatenate([heart, *(heart ^ sum((np.uint64(1) << rng.integers(0, 64, 40, np.uint64) for _ in range(k)), np.zeros(40, np.uint64)) for k in (1, 2, 3, 4, 5, 8) for _ in range(6)), heart[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    key, owner = simhash.cells(x)
    a, b = simhash.bucket_links(key, x[owner])
    at = {v: i for i, v in enumerate(x.tolist())}
    got = common.roots(len(x), np.array([at[v] for v in a.tolist()], int), np.array([at[v] for v in b.tolist()], int))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    assert (got == common.roots(len(x), i, j)).all()
    assert (simhash.hamming(a, b) <= 64).all()


# pipeline
def test_pipeline(spark, docs, labels):
    rows, stages = docs, dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in stages.items():
        out = stage(spark, rows, SF)
        seen[name] = (rows.toPandas(), out.toPandas())
        if name != "tokens":
            assert out.columns == docs.columns
        rows = spark.createDataFrame(seen[name][1], out.schema) if name != "tokens" else out
    before, after = seen["quality_rules"]
    kept = quality.judge(docs, quality.fit(docs, labels)).where("kept").toPandas()["doc_id"]
    assert set(after["doc_id"]) == set(kept)
    before, after = seen["line_dedup"]
    want = dict(deduplicated(list(zip(before["doc_id"], before["text"]))))
    assert len(after) == len(before) and sum(want[d] != t for d, t in zip(after["doc_id"], after["text"])) <= 1 and (after["text"].str.len() == after["n_chars"]).all()
    before, after = seen["near_duplicates"]
    prints = [brute_print(t) for t in before["text"]]
    e = np.array([(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4], int).reshape(-1, 2)
    root = common.roots(len(prints), e[:, 0], e[:, 1])
    assert set(after["doc_id"]) == set(before.groupby(root)["doc_id"].min())
    before, after = seen["decontamination"]
    items = [decontam.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(b" " + b" ".join(w) + b" " in b" " + b" ".join(decontam.words(t)) + b" " for w in items if len(w) >= decontam.MIN_WORDS)
    assert set(after["doc_id"]) == {d for d, t in zip(before["doc_id"], before["text"]) if not holds(t)}
    before, after = seen["tokens"]
    assert set(after["doc_id"]) == set(before["doc_id"]) and dict(zip(after["doc_id"], after["decoded_sha256"])) == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(before["doc_id"], before["text"])}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_gives_its_columns(spark, name):
    first = {"op4_url_rules": "page_id", "op6_chat": "conv_id", "op13_ranked_search": "item_id"}.get(name, "doc_id")
    assert queries.QUERIES[name](spark, SF).columns[0] == first


# 11 periodic runs
def brute_runs(w, least=6, exponent=4):
    """Every period in turn: the stretches whose words equal those a period on."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(5):
            w = [rng.choice("abc"[:rng.randrange(1, 4)]) for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                w += ([rng.choice("ab") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 12))[:rng.randrange(1, 80)] + [rng.choice("abc")] * rng.randrange(2)
            texts.append(w)
        for exponent, least in ((4, 6), (3, 5), (5, 12)):
            assert periodic_runs.runs_of(texts, least, exponent) == [brute_runs(w, least, exponent) for w in texts]
    many = ["x"] * 60_000
    assert periodic_runs.runs_of([many, ["a", "b", "c"] * 20_000, []]) == [[(0, 60_000, 1)], [(0, 60_000, 3)], []]
    with pytest.raises(ValueError):
        periodic_runs.runs_of([many], exponent=2)


def test_runs_query(spark, texts, odd):
    for r in queries.op11_periodic_runs(spark, SF).collect():
        w = re.findall("[^\x20\x09-\x0d]+", texts[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {k for i, m, q in runs for k in range(i + q, i + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert tuple(r[1:6]) == (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4))
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{i},{m},{q}\n" for i, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    out = periodic_runs.find(odd.withColumn("runs", F.lit(1)))
    rows = {r["doc_id"]: r for r in out.where("doc_id <> 6").collect()}
    assert out.columns == [*odd.columns, "runs", "collapsed"] and out.count() == len(ODD) + 2
    assert [tuple(x) for x in rows[8]["runs"]] == [(0, 80_000, 4)] and rows[8]["collapsed"] == "long tale of words"
    assert rows[0]["collapsed"] == rows[1]["collapsed"] == "" and rows[0]["runs"] == [] and rows[5]["collapsed"] == "é ñ 　 \x1c ß"
    assert periodic_runs.find(odd.where("false")).count() == 0


# 12 substring dedup
def brute_passages(rows, k=13):
    last = substring_dedup.LAST
    held = [(last if d is None else d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in held:
        for i in range(len(w) - k + 1):
            first[tuple(w[i:i + k])] = min(d, first.get(tuple(w[i:i + k]), last))
    out = []
    for (d, w), (own, _) in zip(held, rows):
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i:i + k])] < d for j in range(i, i + k)}
        out.append((own, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes,bucket_windows", [(substring_dedup.BLOCK_BYTES, substring_dedup.BUCKET_WINDOWS), (500, 20)])
def test_passages_against_brute_force(spark, block_bytes, bucket_windows):
    """Shared passages in very many documents, so that small buckets are hot and split; ids that are null or repeated."""
    rng = random.Random(1)
    passages = [[rng.choice("a b c d e f the of".split()) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(250):
        w = []
        for _ in range(rng.randrange(4)):
            at = rng.randrange(40)
            w += rng.choice(passages)[at:at + rng.randrange(25)] + [rng.choice("uvwé")] * rng.randrange(3)
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", "  "]).join(w) if rng.random() < 0.95 else None))
    got = substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=block_bytes, bucket_windows=bucket_windows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_passages(rows)


def test_passages_of_odd_rows(spark, odd):
    more = odd.selectExpr("*", "1 AS row", "2 AS block", "3 AS n_removed")
    out = substring_dedup.deduplicate(more)
    assert out.columns == [c for c in more.columns if c != "n_removed" and c != "n_words"] + ["n_words", "n_removed"]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, out.select("doc_id", "text", "n_words", "n_removed").collect()), key=str) == brute_passages(rows)
    assert substring_dedup.deduplicate(odd.where("false")).count() == 0


def test_windows_of_one_hash():
    """Equal hashes of different windows are told apart by their words."""
    strings = [" ".join(f"w{i + j}" for j in range(5)).encode() for i in range(4)] + [b"w0 w1 w2 w3 w4 w5"]
    first = np.array([9, 8, 7, 6, 5])
    plain_hash = substring_dedup.rolled
    try:
        for hashing in (plain_hash, lambda h, k: np.zeros(len(h), np.uint64)):
            substring_dedup.rolled = hashing
            got, begins = substring_dedup.firsts(strings, first, 5)
            assert got.tolist() == [5, 5, 7, 6, 5, 5] and begins.tolist() == [0, 1, 2, 3, 4]
    finally:
        substring_dedup.rolled = plain_hash


# 13 ranked search
def brute_search(docs, items, k):
    rows = [(d, collections.Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, n_terms, df, out = len(rows), sum(n for *_, n in rows), collections.Counter(t for _, c, _ in rows for t in c), []
    for item, text in items:
        own = ranked_search.terms(text)
        scores = []
        for d, c, n in rows:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in own if c[t])
            if s:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_against_brute_force(spark, docs, odd):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "The", "the"]
    pick = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    rows = [(rng.choice([i, i, i, i // 2, None]), pick(rng.randrange(1, 40)) if rng.random() < 0.9 else None) for i in range(400)]
    asked = [(i, pick(rng.randrange(9))) for i in range(12)] + [(None, "w1 w2"), (3, "w3 the"), (99, None), (3, "nowhere")]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    got = ranked_search.search(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), items, 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, asked, 5)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(1, "one same text"), (2, "LONG tale of é ß x"), (3, "1 2 3 4")]
    got = ranked_search.search(odd, spark.createDataFrame(asked, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, asked, 20)
    assert ranked_search.search(odd.where("false"), items).count() == 0 and ranked_search.search(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("first_read", [1, 3, 256])
def test_lists_are_read_until_the_best_are_known(first_read):
    """Small impacts make ties at the last rank; blocks are searched one after another, the best so far carried along."""
    rng = np.random.default_rng(first_read)
    for _ in range(60):
        held, scores, ids = (np.zeros(0), np.zeros(0, np.int64)), {}, rng.permutation(200)
        for block in np.split(ids, 4):
            lists = []
            for _ in range(6):
                at = np.flatnonzero(rng.random(50) < rng.random())
                impact = np.sort(rng.integers(1, 6, len(at)))[::-1].astype(float)
                lists.append((rng.permutation(at), impact))
                for d, i in zip(block[lists[-1][0]].tolist(), impact.tolist()):
                    scores[d] = scores.get(d, 0) + i
            held = ranked_search.nra(lists, block, 7, held, first_read)
        assert list(zip((-held[0]).tolist(), held[1].tolist())) == sorted((-s, d) for d, s in scores.items())[:7]
