"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select what is redacted.

Base spans of the kinds e-mail, IP address, card and phone follow fixed patterns with checks (parts up to 255, Luhn, numbers of digits)
and always stand. Generators propose further spans, overlapping each other and of looser format: addresses spelled with "at" and "dot",
digit groups with other separators or spaces. Gradient-boosted trees on format and context features judge these. They are trained on
all documents: equal lessons are counted, bins end at exact quantiles, and each level of a tree is one pass in which tasks add up sums per
node, feature and bin. Personal are base spans rewritten in their own places to looser formats (``rewritten``). Not personal are the same
formats with a check broken (``broken``: Luhn, parts up to 255, dates and plain numbers where phones stood), other proposals that meet a
rewritten span, and the documents' own proposals that fail a check (``fails``); proposals that fail none and aren't base spans may be
personal, so they teach nothing. Each kind's threshold is the lowest at which, on the third kept out
of training, at least ``PRECISION`` of those above it are personal; a kind with too few gets none. Of overlapping spans a base span wins,
then the higher score, then the longer, then the first.

Null and empty texts have no spans. Repeated rows give the same spans. Without documents nothing is learned and only base spans stand.
"""

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, stored

PRECISION, LEAST_PROPOSALS = 0.99, 20
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
LEAVES = 1 << DEPTH
#: Steps of sums and of thresholds between 0 and 1.
STEPS = 1 << 16
#: Lessons that a task holds at once, however many a text or a batch of texts has.
LESSONS = 4096
#: Characters of texts whose results a task holds at once; a longer text is alone.
FOUND = 1 << 20
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A run of digits is entered at its first digit only, which finds the same matches in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PROPOSALS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]{1,63})+", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:\s?[.,]\s?[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./_-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])\(?[0-9](?:[ ().\/-]{0,3}[0-9]){6,14}(?![0-9])"),
}
SPELLED = re.compile(r"\bat\b.*\bdot\b", re.I | re.S)
SIGNS = re.compile(r"[0-9@]|\(at\)|\[at\]|\bdot\b", re.I)
CONTEXT = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile")}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_emails(text: str) -> list[Span]:
    """An address's local part is all that may stand before the at sign, from the last address on; then a domain with a dot."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append(("email", begin, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    out = base_emails(text) if "@" in text else []
    if SIGNS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def proposals(text: str) -> list[Span]:
    if not SIGNS.search(text):
        return []
    return [(kind, *m.span()) for kind, p in PROPOSALS.items() for m in p.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    digits = [c for c in s if c.isdigit()]
    groups = [g for g in re.split("[^0-9]+", s) if g]
    before, after = text[max(0, a - 24):a], text[b:b + 1]
    near = before.lower()
    return [float(KINDS.index(kind)), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), s.count("."), s.count("-"), s.count(" "), s.count("("),
            sum(c.isalpha() for c in s), float(luhn("".join(digits)) if len(digits) > 12 else -1), max((int(g[:4]) for g in groups), default=0), float(len(set(digits))),
            float(any(w in near for w in CONTEXT[kind])), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ('"', "=", "'", ":")), float(bool(re.search(r"\.[a-z]{2,}$", s, re.I))),
            s.count("/"), s.count(","), float(bool(SPELLED.search(s)))]


def rewritten(kind: str, s: str) -> list[str]:
    """A base span's text in looser formats."""
    d = re.sub("[^0-9]", "", s)
    if kind == "email":
        local, _, domain = s.rpartition("@")
        bare = re.sub("[0-9]", "", local).strip("._%+-") or local
        pairs = [(local, domain), (bare, ".".join(domain.split(".")[-2:]))]
        return [x + at + y.replace(".", dot) for x, y in pairs for at, dot in ((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", "."), ("[at]", "."))]
    if kind == "ip":
        return [sep.join(s.split(".")) for sep in (" . ", " .", ". ", ",")]
    if kind == "card":
        short = [d[:n - 1] + next(c for c in "0123456789" if luhn(d[:n - 1] + c)) for n in (13, 14, 15)]
        fours = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [sep.join(fours) for sep in "./_"] + short + [f"{x[:4]}{sep}{x[4:10]}{sep}{x[10:]}" for x in short for sep in " -."]
    groups = [g for g in re.split("[^0-9]+", s) if g]
    out, ways = [s.lstrip("+")], [groups, groups[1:]]
    for cut in ((3, 4), (3, 3, 4), (2, 4, 4), (3, 4, 4), (4, 3, 3), (3, 3, 2, 2)):
        if sum(cut) <= len(d):
            at = np.cumsum((len(d) - sum(cut), *cut)).tolist()
            ways.append([d[i:j] for i, j in zip(at, at[1:])])
    for own in ways:
        if sum(map(len, own)) >= 7 and len(own) > 1:
            out += [sep.join(own) for sep in " -./"] + [f"({own[0]}) {'-'.join(own[1:])}"]
    return out


def broken(kind: str, s: str) -> list[str]:
    """Texts alike in format that are not personal."""
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        parts, low = s.split("."), [str(int(p[-2:]) % 30) for p in s.split(".")]
        return [sep.join(["9" + p[-1:] * 2 if i == int(d[-1]) % 4 else p for i, p in enumerate(parts)]) for sep in (".", " . ", ",")] + [sep.join(low) for sep in (", ", ". ", ",")]
    if kind == "card":
        return [v[:-1] + str((int(v[-1]) + 1 + i % 8) % 10) for i, v in enumerate([d, s, *rewritten(kind, s)])]
    if kind == "phone":
        year, month, day = f"20{d[-2:]}", f"0{1 + int(d[-3]) % 9}", f"1{d[-4]}"
        return [f"{year}-{month}-{day}", f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{year}/{month}/{day}", year + month + day, d, d[-7:], d[-8:], d[-10:], f"{d[-8:-3]}.{d[-3:]}", f"{d[-8]} {d[-7:-4]} {d[-3:]}", f"{year}-{year}", f"{year} {d[-4:]}"]
    return []


def fails(text: str, span: Span) -> bool:
    """Whether a proposal fails a check that personal data of its kind passes in any format."""
    kind, a, b = span
    s, d = text[a:b], re.sub("[^0-9]", "", text[a:b])
    inside = text[a - 1:a].isalnum() or text[b:b + 1].isalnum()
    if kind == "email":
        return bool(re.search(r"\sat\s", s, re.I)) and not re.search(r"dot\b", s, re.I)
    if kind == "ip":
        return inside or any(int(p) > 255 for p in re.findall("[0-9]+", s))
    return inside or (not luhn(d) if kind == "card" else not 7 <= len(d) <= 15)


def lessons(text: str) -> Iterator[list[float]]:
    """(personal or not, features) of a document's rewritten spans, their broken forms and its failing proposals, one after another."""
    base = base_spans(text)
    taken = _merged(base)
    for span in dict.fromkeys(proposals(text)):
        if not _meets(span, taken) and fails(text, span):
            yield [0.0, *features(text, span)]
    for kind, a, b in base:
        before, after = text[max(0, a - 24):a], text[b:b + 8]
        for personal, forms in ((1.0, rewritten(kind, text[a:b])), (0.0, broken(kind, text[a:b]))):
            for form in forms:
                local, own = before + form + after, (kind, len(before), len(before) + len(form))
                met = [s for s in dict.fromkeys(proposals(local)) if _meets(s, [own[1:]])]
                yield from ([personal if s == own else 0.0, *features(local, s)] for s in met if s == own or personal)


class Trees:
    """Boosted regression trees for a yes or no, on binned features: full binary trees, each level's axes, highest bins of the left side
    and, below the last level, values."""

    def __init__(self, cuts: list[np.ndarray], share: float):
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.cuts, self.start = cuts, float(np.log(share / (1 - share)))
        self.axis, self.high, self.value = np.zeros((0, LEAVES - 1), np.int64), np.zeros((0, LEAVES - 1), np.int64), np.zeros((0, LEAVES))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)

    def score(self, bins: np.ndarray) -> np.ndarray:
        tree, rows, node = np.arange(len(self.value))[:, None], np.arange(len(bins)), np.zeros((len(self.value), len(bins)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, self.axis[tree, node]] > self.high[tree, node])
        margin = np.full(len(bins), self.start)
        for own in self.value[tree, node - (LEAVES - 1)]:
            margin += own
        return 1 / (1 + np.exp(-margin))

    def boost(self, counts: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> None:
        """One more tree. ``counts(axis, high, level)`` gives for each node of the level, feature and bin: sums of g, sums of h, rows.

        A node that isn't worth a split sends all to its left."""
        axis, high = np.zeros(LEAVES - 1, np.int64), np.full(LEAVES - 1, BINS)
        for level in range(DEPTH):
            per_bin = counts(axis, high, level)
            below = np.cumsum(per_bin, 2)
            whole = below[:, :1, -1:]
            (g, h, _), (all_g, all_h, _) = np.moveaxis(below[:, :, :-1], 3, 0), np.moveaxis(whole, 3, 0)
            gain = (g ** 2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g ** 2 / (all_h + 1)).reshape(len(below), -1)
            best = gain.argmax(1)
            first, own = (1 << level) - 1, np.arange(len(below))
            split = (gain[own, best] > 1e-6) & (whole[:, 0, 0, 2] >= 10)
            axis[first + own], high[first + own] = np.where(split, best // (BINS - 1), 0), np.where(split, best % (BINS - 1), BINS)
            left = np.where(split[:, None], below[own, best // (BINS - 1), best % (BINS - 1)], whole[:, 0, 0])
            sides = np.stack([left, whole[:, 0, 0] - left], 1).reshape(-1, 3)
        self.axis, self.high = np.vstack([self.axis, axis]), np.vstack([self.high, high])
        self.value = np.vstack([self.value, RATE * sides[:, 0] / (sides[:, 1] + 1)])


class Detector:
    def __init__(self, trees: Trees | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def find(self, text: str) -> dict:
        base = base_spans(text)
        taken = _merged(base)
        more = [s for s in proposals(text) if s[0] in self.thresholds and not _meets(s, taken)] if self.trees else []
        if more:
            scores = self.trees.score(self.trees.bins(np.array([features(text, s) for s in more])))
            ranked = sorted((-p, s[1] - s[2], s[1], s) for s, p in zip(more, scores.tolist()) if p >= self.thresholds[s[0]])
            more, taken = [], []
            for *_, s in ranked:
                if not _meets(s, taken):
                    more.append(s)
                    insort(taken, s[1:])
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))
        out = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
        return out | {"base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(base + more), "redacted": redact(text, base + more)}


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places the spans cover, in order and free of overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s[1:] for s in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(span: Span, taken: list[tuple[int, int]]) -> bool:
    """Whether the span meets one of the places, which are in order and free of overlaps."""
    i = bisect_left(taken, (span[2],))  # the last place that begins before the span's end
    return i > 0 and taken[i - 1][1] > span[1]


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the first, then the longer one names the place."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lessons of batches of texts, at most ``LESSONS`` in a batch and none beyond those made ahead."""
    def dealt():
        for batch in batches:
            for text in (t.as_py() or "" for t in batch.column(0)):
                crc = zlib.crc32(text.encode())
                for i, (y, *x) in enumerate(lessons(text)):
                    yield zlib.crc32(b"%d" % i, crc) % 3 == 2, int(y), x
    rows = dealt()
    while own := list(islice(rows, LESSONS)):
        held, y, x = zip(*own)
        flat = np.array(x)
        at = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(y, pa.int64()), pa.ListArray.from_arrays(at, flat.ravel())], names=["held", "y", "x"])


def _taught(docs: DataFrame) -> DataFrame:
    """``(held, y, x, n)``: how often each lesson is taught by all documents; ``held`` marks the third kept out of training."""
    rows = docs.select(TEXT).mapInArrow(_teach, "held boolean, y bigint, x array<double>")
    return rows.groupBy("held", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of byte strings, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width).astype(np.int64)


def _level_counts(train: DataFrame, trees: Trees, axis: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Sums of g and h and numbers of rows for each node of a level, feature and bin, as whole steps of 1 / ``STEPS`` so that the order of adding doesn't matter."""
    width, nodes = len(trees.cuts), 1 << level
    cells = nodes * width * BINS

    def partial(batches):
        sums = np.zeros((3, cells))
        for batch in batches:
            bins, n, y = _matrix(batch.column("b"), width), batch.column("n").to_numpy(), batch.column("y").to_numpy()
            rows, node, p = np.arange(len(bins)), np.zeros(len(bins), np.int64), trees.score(bins)
            for _ in range(level):
                node = 2 * node + 1 + (bins[rows, axis[node]] > high[node])
            cell = (((node - (nodes - 1)) * width)[:, None] + np.arange(width)) * BINS + bins
            for i, v in enumerate((np.rint((y - p) * STEPS) * n, np.rint(p * (1 - p) * STEPS) * n, n)):
                sums[i] += np.bincount(cell.ravel(), np.repeat(v, width), cells)
        at = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v[at].astype(np.int64)) for v in sums)], names=["cell", "g", "h", "n"])

    found = train.mapInArrow(partial, "cell bigint, g bigint, h bigint, n bigint").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn")).toPandas()
    out = np.zeros((cells, 3))
    out[found["cell"].to_numpy()] = found[["g", "h", "n"]].to_numpy() / (STEPS, STEPS, 1)
    return out.reshape(nodes, width, BINS, 3)


def fit(docs: DataFrame) -> Detector:
    """Learns from every row. The driver gets sums per node, feature and bin, quantiles, and numbers of held-out lessons per step of the score."""
    taught = stored(_taught(docs))
    total, right = taught.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total or total < LEAST_PROPOSALS or not 0 < right < total:
        return Detector(None, {})
    width, ends = len(features("", (KINDS[0], 0, 0))), F.lit(np.linspace(0, 1, BINS + 1)[1:-1].tolist())
    known = taught.where("not held").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("share"), *(F.percentile(F.col("x")[i], ends, F.col("n")).alias(f"c{i}") for i in range(width))).first()
    if known["share"] is None:
        return Detector(None, {})
    trees = Trees([np.unique(known[f"c{i}"]) for i in range(width)], known["share"])

    def binned(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            held, y, n = (batch.column(c) for c in ("held", "y", "n"))
            yield pa.RecordBatch.from_arrays([held, y, pa.array(x[:, 0].astype(np.int64)), pa.array([b.tobytes() for b in trees.bins(x).astype(np.uint8)], pa.binary()), n], names=["held", "y", "kind", "b", "n"])

    rows = stored(taught.mapInArrow(binned, "held boolean, y bigint, kind bigint, b binary, n bigint").groupBy("held", "y", "kind", "b").agg(F.sum("n").alias("n")))
    train = rows.where("not held").select("y", "b", "n").persist()
    for _ in range(TREES):
        trees.boost(lambda axis, high, level: _level_counts(train, trees, axis, high, level))
    train.unpersist()

    def scored(batches):
        for batch in batches:
            step = np.floor(trees.score(_matrix(batch.column("b"), width)) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(step), batch.column("y"), batch.column("n")], names=["kind", "step", "y", "n"])

    kept = rows.where("held").mapInArrow(scored, "kind bigint, step bigint, y bigint, n bigint").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("right")).toPandas()
    thresholds = {}
    for i, name in enumerate(KINDS):
        own = kept[kept["kind"] == i].sort_values("step", ascending=False)
        good = own["step"][own["right"].cumsum() >= PRECISION * own["n"].cumsum()]
        if own["n"].sum() >= LEAST_PROPOSALS and len(good):
            thresholds[name] = max(0.5, float(good.iloc[-1]) / STEPS)
    return Detector(trees, thresholds)


def _found(batches: Iterator[pa.RecordBatch], detector: Detector) -> Iterator[pa.RecordBatch]:
    """What is found in batches of ids and texts, sent on whenever ``FOUND`` characters have been read."""
    for batch in batches:
        out, first, size = [], 0, 0
        for i, text in enumerate(t.as_py() or "" for t in batch.column(1)):
            out.append(detector.find(text))
            size += len(text)
            if size >= FOUND or i + 1 == len(batch):
                names = list(out[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), *(pa.array([r[c] for r in out], pa.int64() if c.startswith("n_") else pa.string()) for c in names)], names=[ID, *names])
                out, first, size = [], i + 1, 0


def detect(docs: DataFrame, detector: Detector, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    known = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))
    kind = f"{ID} {dict(known.dtypes)[ID]}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, redacted string"
    return known.mapInArrow(lambda batches: _found(batches, shared.value), kind)
