"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard checks, union-find, one line kept per component.

A line is a ``\\n``-separated part of a text. It takes part if it holds a character other than blank, tab, \\r, \\v and \\f; its form for comparison has
ASCII letters lower-cased and runs of those as one blank. Equal forms are copies. Two forms are linked if the Jaccard similarity of
their sets of ``SHINGLE``-character shingles is at least ``SIMILARITY`` (a shorter form is its own only shingle). Of each component of
copies and links the first line stays, by doc_id and then by place; all others go. Other lines stay where they are.

Every distinct line of a task gives ``BANDS`` band keys of ``ROWS`` min-hashes each: a pair at the similarity asked for meets with 98%,
one at 0.9 with 99.98%. Keys travel as packed arrays in buckets of bounded size. A bucket gives each of its groups a leader and one
candidate pair per other member, never all pairs; candidates' texts are fetched by a scan that a Bloom filter of fixed size thins (its
false positives cost time, not results), and pairs are verified exactly. What these links connect in two steps, in whichever bands, is one label; only a
group of several labels, and that holds three lines or more, is compared further, with its texts, and only lines of different labels, by exact bounds from
hashes first: in one task up to ``TOGETHER`` lines; a larger one is dealt into parts, and each two parts are a task; one of more than
``MOST_PARTS`` parts is first parted by its lines' rarest shingles (similar lines share one of them: prefix filtering, which loses no
pair), and what is still too large is compared in pairs of parts, so no task holds more than two parts. Lines are known by a 64-bit hash.

Null and empty texts have no lines and are returned as they are (null: empty). Repeated rows of one doc_id count as copies of each
other: their lines share a place, and are kept or dropped alike. An empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut_lineage

from .common import ID, TEXT, components

SHINGLE, SIMILARITY = 8, 0.8
BANDS, ROWS, SEED = 8, 4, 7
BLANKS = re.compile(b"[ \t\r\v\f]+")
#: Packed entries (16 bytes each) of a bucket; bits of the Bloom filter; characters hashed at a time.
BUCKET_ENTRIES, BLOOM_BITS, BLOCK = 1_000_000, 1 << 26, 250_000
#: Lines of an open group that one task compares; lines from which on sketches save comparisons; parts of a group up to which each two parts are compared.
TOGETHER, SKETCHED, MOST_PARTS = 2000, 8, 16


def byte_forms(text: str) -> list[bytes]:
    """The form of every line of a text, as UTF-8; most texts need nothing but lower-casing."""
    raw = text.encode().lower()
    if b"  " in raw or b"\t" in raw or b"\r" in raw or b"\v" in raw or b"\f" in raw:
        return [b" ".join(x for x in BLANKS.split(line) if x) for line in raw.split(b"\n")]
    return [x.strip(b" ") for x in raw.split(b"\n")]


def forms_of(text: str) -> list[str]:
    return [x.decode() for x in byte_forms(text)]


def line_ids(forms: list[bytes]) -> np.ndarray:
    """Signed 64-bit ids of forms."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms)).view(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def shingle_hashes(forms: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """One 32-bit hash per character of all forms, in which each form has all of its k-character shingles and no others, and where
    each form begins. The last places of a form, whose windows would reach into the next, repeat its first."""
    h = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32) + np.uint32(1)
    lengths = np.array([len(f) for f in forms], np.int64)
    begins = np.cumsum(lengths) - lengths
    width = 1
    while width < k:  # a window of twice the width is two windows side by side
        wide = h * np.uint32(pow(0x01000193, width, 1 << 32))
        wide[:-width] += h[width:]
        h, width = wide, 2 * width
    h = mixed(h)
    long = lengths >= k
    for back in range(1, k):
        h[begins[long] + lengths[long] - back] = h[begins[long]]
    for i in np.flatnonzero(~long).tolist():
        h[begins[i]:begins[i] + lengths[i]] = xxhash.xxh32_intdigest(forms[i].encode())
    return h, begins


def band_keys(forms: list[str]) -> np.ndarray:
    """``len(forms) x BANDS`` 64-bit keys. A min-hash orders shingles by an odd multiple of their hash, modulo 2**32."""
    h, begins = shingle_hashes(forms)
    turns = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS, ROWS, 2), np.uint32)
    key, at = np.empty((len(forms), BANDS), np.uint64), np.empty_like(h)
    for b in range(BANDS):
        k = np.full(len(forms), b + 1, np.uint64)
        for turn, odd in turns[b]:
            np.multiply(np.bitwise_xor(h, turn, out=at), odd | np.uint32(1), out=at)
            k = (k ^ np.minimum.reduceat(at, begins)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        key[:, b] = k
    return key


def shingles(f: str, k: int = SHINGLE) -> set[str]:
    return {f[i:i + k] for i in range(max(1, len(f) - k + 1))}


def _windows(raw: np.ndarray, at: int, n: int) -> np.ndarray:
    """The distinct runs of eight of ``n`` bytes from a place on, as sorted numbers."""
    return np.unique(np.ndarray((n - 7,), np.uint64, raw, at, (1,)))


def compact(f: str, least: int = SHINGLE) -> "set[str] | np.ndarray":
    """A form's shingles; from ``least`` one-byte characters on as sorted numbers, for eight such characters are just a 64-bit number."""
    if len(f) < max(least, SHINGLE):
        return shingles(f)
    try:
        raw = np.frombuffer(f.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return shingles(f)
    return _windows(raw, 0, len(raw))


def numbered(forms: list[str]) -> list[np.ndarray]:
    """The shingles of a group's forms as sorted numbers, equal where shingles are. Up to 255 characters in a group, its forms are bytes, of which no window
    holds a zero and a short form's only number does; beyond, shingles are numbered as they are met."""
    codes = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(codes.max(initial=0)) + 1, bool)
    used[codes] = True
    if used.sum() > 255:
        known: dict[str, int] = {}
        return [np.unique(np.array([known.setdefault(s, len(known)) for s in shingles(f)], np.uint64)) for f in forms]
    raw, out, at = np.cumsum(used).astype(np.uint8)[codes], [], 0
    for f in forms:
        out.append(_windows(raw, at, len(f)) if len(f) >= SHINGLE else np.pad(raw[at:at + len(f)], (0, 8 - len(f))).view(np.uint64))
        at += len(f)
    return out


def plain(x: "set[str] | np.ndarray") -> set[str]:
    if isinstance(x, set):
        return x
    raw = x.tobytes().decode("latin-1")
    return {raw[i:i + 8] for i in range(0, len(raw), 8)}


def alike(x: "set[str] | np.ndarray", y: "set[str] | np.ndarray", least: float) -> bool:
    """Whether two sets' Jaccard similarity is at least ``least``."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    if isinstance(x, np.ndarray) and isinstance(y, np.ndarray):
        both = len(np.intersect1d(x, y, assume_unique=True))
    else:
        both = len(plain(x) & plain(y))
    return both >= least * (len(x) + len(y) - both)


def _near_enough(sets: list[np.ndarray], least: float):
    """``near(i, other)``: which of the other sets may be like set i, exact comparisons aside.

    First by their sketches of 1024 bits, of which every shingle sets one: bits of x that y lacks are shingles of x that y lacks, at least so
    many. What is left then counts the shingles of y whose 16-bit hash one of x has: at least as many as both have."""
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    flat = np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros((len(sets), 1024), np.uint8)
    bits[np.repeat(np.arange(len(sets)), size), (flat >> np.uint64(54)).astype(np.int64)] = 1
    marks = np.packbits(bits, axis=1).view(np.uint64)
    flat, held = (flat >> np.uint64(48)).astype(np.uint16), np.zeros(1 << 16, np.uint8)

    def near(i: int, other: np.ndarray) -> np.ndarray:
        j = np.flatnonzero(other & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i])))
        both = least / (1 + least) * (size[i] + size[j])
        j = j[(np.bitwise_count(marks[i] & ~marks[j]).sum(1) <= size[i] - both + 1e-9) & (np.bitwise_count(marks[j] & ~marks[i]).sum(1) <= size[j] - both + 1e-9)]
        if not len(j):
            return j
        mine = flat[starts[i]:starts[i] + size[i]]
        held[mine] = 1
        ends = np.cumsum(size[j])
        hits = np.add.reduceat(held[np.concatenate([flat[a:b] for a, b in zip(starts[j].tolist(), (starts[j] + size[j]).tolist())])], ends - size[j], dtype=np.int64)
        held[mine] = 0
        return j[hits >= least / (1 + least) * (size[i] + size[j]) - 1e-9]
    return near


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, line)`` of every line that takes part, ``place`` counted from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, places, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = byte_forms(text or "")
                held = [i for i, x in enumerate(found) if x]
                forms += [found[i] for i in held]
                places += held
                counts.append(len(held))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_pydict({ID: ids, "place": pa.array(places, pa.int32()), "line": pa.array(line_ids(forms))})
    return docs.select(ID, TEXT).mapInArrow(run, f"{ID} bigint, place int, line bigint")


def _distinct_forms(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of a task's distinct lines (ids, forms), those for which ``wanted(ids)`` holds."""
    seen: set[int] = set()
    ids, forms, size = [], [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = [x for x in byte_forms(text or "") if x]
            for line, i in zip(found, line_ids(found).tolist()):
                if i not in seen:
                    seen.add(i)
                    ids.append(i)
                    forms.append(line)
                    size += len(line)
            if size > BLOCK:
                yield _block(ids, forms, wanted)
                ids, forms, size = [], [], 0
                if len(seen) > 2_000_000:
                    seen.clear()
    if ids:
        yield _block(ids, forms, wanted)


def _block(ids, forms, wanted):
    if wanted is None:
        return ids, [x.decode() for x in forms]
    keep = np.flatnonzero(wanted(np.array(ids, np.int64))).tolist()
    return [ids[i] for i in keep], [forms[i].decode() for i in keep]


def _groups(docs: DataFrame, buckets: int) -> DataFrame:
    """``(band, line, leader, size)`` of every group of two or more lines that share a band key; the leader is its smallest id."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, forms in _distinct_forms(batches):
            key = band_keys(forms).ravel()
            line = np.repeat(np.array(ids, np.int64), BANDS)
            to = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            packed, cuts = np.stack((key[order], line[order].view(np.uint64)), 1), np.searchsorted(to[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "packed": pa.array([packed[cuts[k]:cuts[k + 1]].tobytes() for k in full], pa.binary())})

    def collide(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(group["packed"].to_pylist()), np.uint64).reshape(-1, 2)
        key, line = e[:, 0], e[:, 1].view(np.int64)
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))
        key, line = key[fresh], line[fresh]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size > 1, size)
        return pa.table({"band": key.view(np.int64)[many], "line": line[many], "leader": np.repeat(line[first], size)[many], "size": np.repeat(size, size)[many]})

    return docs.select(TEXT).mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInArrow(collide, "band bigint, line bigint, leader bigint, size bigint")


def _texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(line, form)`` of the given lines. A line's two places in the filter are two cuts of its id, which is a hash already."""
    mask = BLOOM_BITS - 1
    places = lines.select(F.explode(F.array(F.col("line").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("line", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    bloom = np.zeros(BLOOM_BITS // 64, np.uint64)  # of fixed size, whatever the input
    bloom[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value

        def wanted(ids):
            u = ids.view(np.uint64)
            return np.logical_and(*(held[(p := (u >> np.uint64(s)) & np.uint64(mask)) >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) == 1 for s in (0, 32)))
        for ids, forms in _distinct_forms(batches, wanted):
            yield pa.RecordBatch.from_pydict({"line": pa.array(ids, pa.int64()), "form": pa.array(forms, pa.string())})

    found = docs.select(TEXT).mapInArrow(scan, "line bigint, form string")
    return found.join(lines, "line", "left_semi").groupBy("line").agg(F.min("form").alias("form"))


def _similar(least: float):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for leaders, others in batches:
            out, last, held = [], None, set()
            for a, b in zip(leaders.to_pylist(), others.to_pylist()):
                if a != last:
                    last, held = a, compact(a)
                out.append(alike(held, compact(b), least))
            yield pa.array(out, pa.bool_())
    return F.arrow_udf(run, "boolean").asNondeterministic()


def _complete(least: float):
    """Links of the lines of one group that are apart so far: each of a part that isn't ``ok`` is compared until the group is one component or none are left.
    Lines of one ``label`` are connected already; without that column those that are ``ok``. Of a group with lines of two
    parts (column ``part``) only lines of different parts are compared."""
    def run(group: pa.Table) -> pa.Table:
        ids, forms, ok, side = (group[c].to_pylist() for c in ("line", "form", "ok", "part"))
        part = np.unique(group["label"].to_numpy(), return_inverse=True)[1] if "label" in group.column_names else np.array([0 if x else i + 1 for i, x in enumerate(ok)])
        side, edges = np.array(side), []
        if len(forms) < SKETCHED:  # exact comparisons cost less than sketches
            sets, near = [compact(f) for f in forms], lambda i, other: np.flatnonzero(other)
        else:
            sets = numbered(forms)
            near = _near_enough(sets, least)
        across = len(np.unique(side)) > 1
        for i in (i for i, x in enumerate(ok) if not x):
            other = part != part[i]
            if across:
                other &= side != side[i]
            if not other.any():
                continue
            for j in near(i, other).tolist():
                if part[i] != part[j] and alike(sets[i], sets[j], least):
                    edges.append((ids[i], ids[j]))
                    old, new = max(part[i], part[j]), min(part[i], part[j])
                    part[part == old] = new
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})
    return run


def _all_shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for forms in batches:
        yield pa.array([[int.from_bytes(xxhash.xxh3_64_digest(s.encode()), "big", signed=True) for s in shingles(f)] for f in forms.to_pylist()], pa.list_(pa.int64()))


def _parted(rest: DataFrame, least: float, together: int) -> DataFrame:
    """The rows ``(band, line, form, ok, label)`` of very large groups under keys of at most about ``2 * together`` lines, ``(band, shingle, low, high, part)``.

    Every pair of a group with a similarity of at least ``least`` shares a shingle among its rarest ``n - ceil(least * n) + 1`` of n, in
    the order of (lines of the group that have it, shingle). A shingle of too many lines gets its lines dealt into parts, and
    each two parts a key."""
    hashes = F.arrow_udf(_all_shingles, "array<bigint>").asNondeterministic()
    each = cut_lineage(rest.select("band", "line", F.explode(hashes("form")).alias("shingle")))
    count = each.groupBy("band", "shingle").agg(F.count("*").alias("lines"))
    ordered = each.join(count, ["band", "shingle"]).groupBy("band", "line").agg(F.sort_array(F.collect_list(F.struct("lines", "shingle"))).alias("all"))
    size = F.size("all")
    rare = cut_lineage(ordered.select("band", "line", F.explode(F.slice("all", F.lit(1), size - F.ceil(least * size - 1e-9).cast("int") + 1)).alias("s")).select("band", "line", "s.shingle"))
    marked = rare.join(rest.select("band", "line", "label"), ["band", "line"])
    held = marked.groupBy("band", "shingle").agg(F.count("*").alias("lines"), (F.min("label") < F.max("label")).alias("apart")).where("apart").drop("apart")
    parts = F.ceil(F.col("lines") / together).cast("int")
    mine = rare.join(held, ["band", "shingle"]).select("*", parts.alias("parts"), F.pmod(F.xxhash64("line"), parts).cast("int").alias("part"))
    paired = mine.select("band", "line", "shingle", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return paired.select("band", "line", "shingle", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part").join(rest, ["band", "line"])


def links(docs: DataFrame, lines: int, least: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """``(a, b)`` edges between line ids that connect what is similar; ``lines`` is about the number of lines."""
    groups = cut_lineage(_groups(docs, max(1, -(-lines * BANDS // BUCKET_ENTRIES))))
    texts = cut_lineage(_texts(docs, groups.select("line").distinct()))
    pairs = groups.where("line <> leader").select("leader", "line").distinct()
    pairs = pairs.join(texts, "line").join(texts.withColumnsRenamed({"line": "leader", "form": "other"}), "leader")
    judged = cut_lineage(pairs.select("leader", "line", _similar(least)("other", "form").alias("ok")))
    direct = judged.where("ok").select(F.col("leader").alias("a"), F.col("line").alias("b"))
    # lines that the links to leaders connect in two steps, in whichever bands, have one label and are not compared again
    up = direct.groupBy(F.col("b").alias("line")).agg(F.min("a").alias("label"))
    up = up.join(up.select(F.col("line").alias("label"), F.col("label").alias("above")), "label", "left").select("line", F.coalesce("above", "label").alias("label"))
    known = groups.where("size > 2").select("band", "line", "leader").join(up, "line", "left").select("band", "line", "leader", F.coalesce("label", "line").alias("label"))
    # the same lines often meet in several bands: one of these is enough
    same = known.groupBy("band").agg(F.min("leader").alias("leader"), F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("lines"), (F.min("label") < F.max("label")).alias("apart"), F.mode("label").alias("most"))
    open_groups = same.where("apart").groupBy("leader", "n", "lines").agg(F.min(F.struct("band", "most")).alias("of")).select("of.*", "n")
    rest = cut_lineage(known.join(open_groups, "band").select("band", "line", "label", "n", (F.col("label") == F.col("most")).alias("ok")))
    formed = rest.join(texts, "line").select("band", "line", "form", "ok", "label", "n", F.lit(0).alias("part"))
    out = direct.union(formed.where(F.col("n") <= together).groupBy("band").applyInArrow(_complete(least), "a bigint, b bigint"))
    parts = F.ceil(F.col("n") / together).cast("int")
    most = rest.agg(F.max(parts)).first()[0] or 0
    if most > 1:
        dealt = rest.where(parts.between(2, MOST_PARTS)).withColumn("part", F.pmod(F.xxhash64("line"), parts).cast("int"))
        paired = dealt.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).join(texts, "line")
        paired = paired.select("band", "line", "form", "ok", "label", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
        out = out.union(paired.groupBy("band", "low", "high").applyInArrow(_complete(least), "a bigint, b bigint"))
    if most <= MOST_PARTS:
        return out
    large = cut_lineage(formed.where(parts > MOST_PARTS).select("band", "line", "form", "ok", "label"))
    return out.union(_parted(large, least, together).groupBy("band", "shingle", "low", "high").applyInArrow(_complete(least), "a bigint, b bigint"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``docs`` with dropped lines cut out of the text, and ``n_lines``, ``n_dropped`` (long) appended (after any of these names)."""
    plain = docs.select(F.col(id_col).cast("bigint").alias(ID), F.col(text_col).alias(TEXT))
    seen = cut_lineage(_occurrences(plain))
    part = components(links(plain, seen.count(), least))
    first = seen.groupBy("line").agg(F.min(F.struct(ID, "place")).alias("first"), F.count("*").alias("n"))
    several = cut_lineage(first.join(part, first["line"] == part["node"], "left").where("n > 1 or root is not null").select("line", "first", "n", F.coalesce("root", "line").alias("root")))
    keeper = several.groupBy("root").agg(F.min("first").alias("keeper"))
    copies = cut_lineage(several.join(keeper, "root").select("line", "keeper"))
    dropped = seen.join(copies, "line").where(~F.struct(ID, "place").eqNullSafe(F.col("keeper")))
    drops = dropped.groupBy(F.col(ID).alias("_drop_of")).agg(F.collect_set(F.struct("place", "line")).alias("_drops"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            out = []
            for text, g in zip(texts.to_pylist(), gone.to_pylist()):
                text = text or ""
                if g is None:
                    out.append({"text": text, "n_lines": text.count("\n") + 1, "n_dropped": 0})
                    continue
                lines, forms = text.split("\n"), byte_forms(text)
                at = [x["place"] for x in g if x["place"] < len(forms) and forms[x["place"]]]
                go = {(x["place"], x["line"]) for x in g}.intersection(zip(at, line_ids([forms[i] for i in at]).tolist()))
                go = {i for i, _ in go}
                keep = [x for i, x in enumerate(lines) if i not in go]
                out.append({"text": "\n".join(keep), "n_lines": len(lines), "n_dropped": len(lines) - len(keep)})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    cut = F.arrow_udf(run, "text string, n_lines bigint, n_dropped bigint").asNondeterministic()
    joined = docs.join(drops, docs[id_col].cast("bigint").eqNullSafe(F.col("_drop_of")), "left").withColumn("_cut", cut(docs[text_col], F.col("_drops")))
    keep = [docs[c] if c != text_col else F.col("_cut.text").alias(text_col) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*keep, F.col("_cut.n_lines").alias("n_lines"), F.col("_cut.n_dropped").alias("n_dropped"))
