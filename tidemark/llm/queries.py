"""The registered query of every operator of this package: production parameters, whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, licenses, line_dedup, periodic_runs, pii, quality, ranked_search, simhash, substring_dedup, toxicity, url_rules
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.detect(docs, pii.fit(docs)).drop("redacted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: The rules of the url query, and the conversation that tests escaping.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TRICKY = "\\### Assistant: </turn> ok"


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    out = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", read.alias("read"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which one document in ten, by crc32 of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumns({"_h": h, "_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))})
    words = words.withColumn("_a", F.expr("if(size(_w) > 0, _g % size(_w), NULL)"))
    words = words.withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    text = F.expr("CASE WHEN _p IS NULL THEN text ELSE array_join(transform(sequence(0, size(_w) - 1), i -> _w[int(if(i < _a, i, _a + (i - _a) % _p))]), ' ') END")
    return words.withColumn("text", text).select(docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("aggregate(runs, get(runs, 0), (m, r) -> if(r.length * m.period > m.length * r.period, r, m))")  # runs stand by start, then period
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.withColumn("best", best).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                                               F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_bpe, op4_url_rules, op5_quality, op6_chat, op7_line_dedup, op8_licenses, op9_decontam, op10_simhash,
                                   op11_periodic_runs, op12_substring_dedup, op13_ranked_search)}


def _url_sql() -> str:
    """The rules from the longest down, as one CASE."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in ordered]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits)
    return f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {case(1)} END AS rule, {case(2)} ELSE 'allow' END AS verdict FROM u"""


def _chat_sql() -> str:
    """Lengths of the escaped texts, and digests of the plain ones."""
    def escaped(column: str, codes: dict[str, str]) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for plain, code in codes.items():
            out = f"replace({out}, '{plain}', '{code}')"
        return out
    marks = len(chat.BEGIN + chat.MIDDLE + chat.END)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}'))),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
  sum({marks} + length({escaped("role", chat.ROLE_CODES)}) + length({escaped("text", chat.CODES)}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""


def _substring_sql() -> str:
    """Every window of 13 words as a string, and the smallest document of each."""
    return r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS window_words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT window_words, min(doc_id) AS d FROM windows GROUP BY window_words),
gone AS (SELECT DISTINCT doc_id, i + j AS i, true AS cut FROM windows JOIN first USING (window_words), range(13) AS r(j) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(cut) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (cut IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _search_sql() -> str:
    """Scores of all pairs of an item and a document that share a term."""
    found = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""WITH p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {found} AS t FROM documents) GROUP BY doc_id, t),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id), s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, nd),
q AS (SELECT item_id, t, count(*) AS r FROM (SELECT item_id, {found} AS t FROM benchmark) GROUP BY item_id, t),
sums AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sums WHERE score > 0) WHERE rank <= 20"""


#: What SQL can express; the other operators are tested against brute force, round trips and held-out rows.
SQL = {"op4_url_rules": _url_sql(), "op6_chat": _chat_sql(), "op12_substring_dedup": _substring_sql(), "op13_ranked_search": _search_sql()}
