"""Secret scans: base patterns, and a character convolutional network over every candidate.

The base patterns give the findings that always stand. Every run of 6 or more key characters is a
candidate, but for plain words of under 16 letters. A small convolutional network in numpy reads a candidate with the text around it. It learns from
labelled findings: values that the base patterns found are secrets; runs whose parts are plain words,
numbers, dates, host names or ids are not. Other runs carry no label and teach nothing. As the base patterns
need a key word before a value and other secrets have none, every secret is also shown, whole and cut off,
between the texts around other candidates. Scores are calibrated by cross-fitting: each labelled finding is
scored, over all its windows, by a network that did not learn from it. The threshold is the largest that
keeps the wanted share of the secrets among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_chunks

KINDS = ("assign", "access", "hex")
LEARNED = "learned"


def _any_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = re.compile(_any_case("(?:password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more are the runs of any length that pass
LEAST = 6  # characters of a candidate, as of a value of the base rule
# Whole runs; a plain word of under 16 letters, with a full stop or without, is none.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?![A-Z]?[a-z]{0,14}\.?(?![A-Za-z0-9+/_.=-]))[A-Za-z0-9+/_.=-]{6,}")
BREAKS = re.compile(r"[._/=+-]+")
# What the parts of runs that are no secrets look like (words, words in one, short numbers behind them, numbers, times).
COMMON = re.compile(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,3}|[A-Z]+[0-9]{0,3}|[0-9]+(?:T[0-9]+Z?)?|(.)\1*")
UNIQUE_ID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

BEFORE, WIDTH = 24, 96  # a window starts so far before a candidate; a long candidate has windows every STEP
STEP = 48
CLASSES = 193  # padding, and twice, around and inside of the candidate: other and printable ASCII
_CLASS_OF = bytes(c - 30 if 32 <= c < 127 else 1 for c in range(256))
_INSIDE = bytes(min(c + 96, 255) for c in range(256))
SECRET, OTHER, UNKNOWN = 1, 0, -1  # labels
FOLDS = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings in order, by code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def is_common(run: str) -> bool:
    """A run that is known not to be a secret."""
    return UNIQUE_ID.fullmatch(run) is not None or all(not p or COMMON.fullmatch(p) for p in BREAKS.split(run))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, label, found) of all runs: the values in the base findings, and all other candidates."""
    out, at, reach, value = [], 0, 0, 0
    for m in CANDIDATE.finditer(text):
        start = m.start()
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            if base[at][1] == 0:
                value = ASSIGN.match(text, base[at][0]).start(1)
            at += 1
        if start < value < m.end():
            start = value  # the key word before a value is no part of it
        found, common = reach > m.start(), is_common(text[start : m.end()])
        # A value in a finding that looks like a word or number teaches nothing.
        label = SECRET if found and not common else OTHER if common and not found else UNKNOWN
        if start + LEAST <= m.end():
            out.append((start, m.end(), label, found))
    return out


def window_starts(start: int, end: int) -> list[int]:
    """Where the windows over a candidate start; together they cover all of it."""
    return [start - BEFORE, *range(start - BEFORE + STEP, end - WIDTH + STEP, STEP)]


def codes(text: str, start: int, own: int, end: int) -> bytes:
    """The WIDTH characters from ``start`` as classes, those of the candidate from ``own`` to ``end`` apart; outside of the text is 0."""
    at = max(0, start)
    part = text[at : max(0, start + WIDTH)].encode("ascii", "replace").translate(_CLASS_OF)
    a, b = max(0, own - at), max(0, end - at)
    part = part[:a] + part[a:b].translate(_INSIDE) + part[b:]
    return (b"\0" * max(0, -start) + part).ljust(WIDTH, b"\0")[:WIDTH]


def findings(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans of a text and its candidates with their windows."""
    base = base_spans(text)
    found = [
        {"start": s, "end": e, "label": label, "found": known, "windows": b"".join(codes(text, w, s, e) for w in window_starts(s, e))}
        for s, e, label, known in candidates(text, base) if label != UNKNOWN or not known
    ]
    return [{"start": s, "kind": k, "end": e} for s, k, e in base], found


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and candidate windows of every whole text.

    ``id, base array<struct<start,kind,end>>, found array<struct<start,end,label,found,windows>>``; null is empty.
    """
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    cand = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("found", pa.bool_()), ("windows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                both = list(map(findings, texts))
                columns = [pa.array([b for b, _ in both], pa.list_(span)), pa.array([f for _, f in both], pa.list_(cand))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *columns], ["id", "base", "found"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,label:int,found:boolean,windows:binary>>")


class CharNet:
    """Embedding, two convolutions with ReLU, the maximum over places, and a logistic output."""

    KERNEL, EMBED, FILTERS = 5, 8, 16

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
        k = self.KERNEL
        self.params = {
            "embed": rng.normal(0, 0.5, (CLASSES, self.EMBED)).astype(np.float32),
            "w1": scale(k * self.EMBED, self.FILTERS), "b1": np.zeros(self.FILTERS, np.float32),
            "w2": scale(k * self.FILTERS, self.FILTERS), "b2": np.zeros(self.FILTERS, np.float32),
            "w3": scale(2 * self.FILTERS, 1), "b3": np.zeros(1, np.float32),
        }
        self.slope, self.shift, self.threshold, self.recall = 1.0, 0.0, 1.1, 0.0

    def _unfold(self, x: np.ndarray) -> np.ndarray:
        n, width, c = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.KERNEL, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(n, width - self.KERNEL + 1, self.KERNEL * c)

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows (rows of classes)."""
        p = self.params
        u1 = self._unfold(p["embed"][x])
        h1 = np.maximum(u1 @ p["w1"] + p["b1"], 0)
        u2 = self._unfold(h1)
        h2 = np.maximum(u2 @ p["w2"] + p["b2"], 0)
        cut_ = BEFORE - 4  # places that see only the text before, and the others
        at = np.concatenate([h2[:, :cut_].argmax(axis=1), h2[:, cut_:].argmax(axis=1) + cut_], axis=1)
        filters = np.tile(np.arange(self.FILTERS), 2)
        top = h2[np.arange(len(x))[:, None], at, filters]
        if keep is not None:
            keep.update(x=x, u1=u1, h1=h1, u2=u2, at=at, filters=filters, top=top)
        return (top @ p["w3"] + p["b3"])[:, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, k, keep = self.params, self.KERNEL, {}
        z = self.forward(x, keep)
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / len(x)).astype(np.float32)
        g = {"w3": keep["top"].T @ dz[:, None], "b3": dz.sum(keepdims=True)}
        dtop = dz[:, None] * p["w3"][:, 0] * (keep["top"] > 0)
        rows = np.arange(len(x))[:, None]
        dh2 = np.zeros((len(x), WIDTH - 2 * (k - 1), self.FILTERS), np.float32)
        dh2[rows, keep["at"], keep["filters"]] = dtop
        g["w2"] = np.tensordot(keep["u2"], dh2, ((0, 1), (0, 1)))
        g["b2"] = dh2.sum(axis=(0, 1))
        du2 = (dh2 @ p["w2"].T).reshape(len(x), -1, k, self.FILTERS)
        dh1 = np.zeros_like(keep["h1"])
        for j in range(k):
            dh1[:, j : j + du2.shape[1]] += du2[:, :, j]
        dh1 *= keep["h1"] > 0
        g["w1"] = np.tensordot(keep["u1"], dh1, ((0, 1), (0, 1)))
        g["b1"] = dh1.sum(axis=(0, 1))
        du1 = (dh1 @ p["w1"].T).reshape(len(x), -1, k, self.EMBED)
        dx = np.zeros((len(x), WIDTH, self.EMBED), np.float32)
        for j in range(k):
            dx[:, j : j + du1.shape[1]] += du1[:, :, j]
        g["embed"] = np.stack([np.bincount(x.ravel(), dx[..., e].ravel(), CLASSES) for e in range(self.EMBED)], axis=1).astype(np.float32)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
        for t in range(1, steps + 1):
            some = order[(t - 1) * batch : t * batch]
            for k, g in self.gradients(x[some], y[some], weight[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.params[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512].astype(np.int64)) for i in range(0, len(x), 512)]).astype(np.float64) if len(x) else np.zeros(0)

    def probability(self, z: np.ndarray) -> np.ndarray:
        """Calibrated probability of a candidate whose largest logit is ``z``."""
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Fit the logistic curve of logits and take the largest threshold with the wanted recall."""
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.05 * float(((p - y) * z).mean()) / (1 + float((z * z).mean()))
            b -= 0.05 * float((p - y).mean())
        self.slope, self.shift = max(a, 1e-3), b
        hits = np.sort(self.probability(z[y > 0]))
        self.threshold = float(hits[int(np.floor((1 - recall) * len(hits)))])
        self.recall = float((hits >= self.threshold).mean())


def _by_candidate(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest value of each candidate, whose windows follow each other."""
    return np.maximum.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else np.zeros(0)


def moved(secret: np.ndarray, size: int, other: np.ndarray, other_size: int) -> np.ndarray:
    """The first ``size`` characters of a secret between the texts around another candidate; both given as first windows."""
    value = secret[BEFORE : BEFORE + size]
    row = np.concatenate([other[:BEFORE], value, other[BEFORE + other_size :]])[:WIDTH]
    return np.pad(row, (0, WIDTH - len(row)))


def learn(windows: list[np.ndarray], lengths: np.ndarray, labels: np.ndarray, fold: np.ndarray, recall: float, seed: int = 3) -> CharNet:
    """A network from labelled candidates (windows as rows of classes, characters), calibrated on networks that leave a fold out."""
    rng = np.random.default_rng(seed)
    secret, other = np.flatnonzero(labels == SECRET), np.flatnonzero(labels == OTHER)

    def elsewhere(of: np.ndarray, among: np.ndarray, cut_off: bool) -> np.ndarray:
        """Secrets ``of`` between the texts around candidates ``among``, also cut off."""
        sizes = [int(rng.integers(min(max(LEAST, lengths[i] // 2), lengths[i]), lengths[i] + 1)) if cut_off else lengths[i] for i in of]
        return np.array([moved(windows[i][0], n, windows[j][0], lengths[j]) for i, n, j in zip(of, sizes, rng.choice(among, len(of)), strict=True)], np.uint8).reshape(-1, WIDTH)

    def fitted(rows: np.ndarray) -> CharNet:
        of, among = secret[rows[secret]], other[rows[other]]
        copies = [elsewhere(of, among, cut_off) for cut_off in (False, True, True)]
        x = np.concatenate([windows[i] for i in np.flatnonzero(rows)] + copies)
        y = np.concatenate([np.repeat(labels[rows], [len(windows[i]) for i in np.flatnonzero(rows)]), np.ones(len(x) - sum(len(windows[i]) for i in np.flatnonzero(rows)))])
        net = CharNet()
        net.fit(x.astype(np.int64), y.astype(np.float64))
        return net

    z, y = [], []
    for k in range(FOLDS):
        net, out = fitted(fold != k), np.flatnonzero(fold == k)
        some = [windows[i] for i in out] + [w[None] for w in elsewhere(secret[fold[secret] == k], other[fold[other] == k], False)] * bool((fold[other] == k).any())
        z.append(_by_candidate(net.logits(np.concatenate(some)), np.array([len(w) for w in some])))
        y.append(np.concatenate([labels[out], np.ones(len(some) - len(out))]))
    net = fitted(np.ones(len(windows), bool))
    net.calibrate(np.concatenate(z), np.concatenate(y), recall)
    return net


def train(found: DataFrame, sample: int = 2000, recall: float = 0.98, least: int = 12, most_windows: int = 64) -> CharNet | None:
    """A network from the labelled findings of ``extract``; None unless each label has ``least`` distinct ones.

    Learns from about ``sample`` distinct findings of each label, drawn by a hash of their windows: the bound on
    rows. Of a finding of more than ``most_windows`` windows (3,000 characters), so many of them are taken, evenly
    spread from the first on. All three are parameters.
    """
    each = found.select(F.explode("found").alias("c")).select("c.label", "c.windows", (F.col("c.end") - F.col("c.start")).alias("size"))
    n = F.length("windows") / WIDTH
    spread = F.concat(*[F.substring("windows", (F.floor(i * n / most_windows) * WIDTH + 1).cast("int"), F.lit(WIDTH)) for i in range(most_windows)])
    each = each.filter(F.col("label") != UNKNOWN).withColumn("windows", F.when(n > most_windows, spread).otherwise(F.col("windows"))).distinct()
    count = {r.label: r["count"] for r in each.groupBy("label").count().collect()}
    if min(count.get(SECRET, 0), count.get(OTHER, 0)) < least:
        return None
    place = F.pmod(F.xxhash64("windows"), F.lit(1_000_003))
    share = F.when(F.col("label") == SECRET, sample / count[SECRET]).otherwise(sample / count[OTHER])
    rows = each.filter(place < share * 1_000_003).toPandas().sort_values(["label", "windows", "size"])
    windows = [np.frombuffer(bytes(w), dtype=np.uint8).reshape(-1, WIDTH) for w in rows.windows]
    labels = rows.label.to_numpy()
    # A value goes to one fold whatever stands around it.
    keys = {k: i for i, k in enumerate(sorted({(label, w[0, BEFORE:].tobytes()) for label, w in zip(labels, windows, strict=True)}))}
    fold = np.array([keys[label, w[0, BEFORE:].tobytes()] % FOLDS for label, w in zip(labels, windows, strict=True)])
    if any(len(set(labels[fold != k])) < 2 for k in range(FOLDS)):
        return None
    return learn(windows, rows["size"].to_numpy(), labels, fold, recall)


def judge(docs: list[tuple[list, list]], net: CharNet | None) -> tuple[list[list], list[list]]:
    """Base and all spans, as (start, kind, end), of documents given as base spans and candidates with windows."""
    free = [(i, c) for i, (_, found) in enumerate(docs) for c in found if not c["found"]] if net else []
    more: dict[int, list] = {}
    if free:
        sizes = np.array([len(c["windows"]) // WIDTH for _, c in free])
        x = np.frombuffer(b"".join(c["windows"] for _, c in free), dtype=np.uint8).reshape(-1, WIDTH)
        score = net.probability(_by_candidate(net.logits(x), sizes))
        for k in np.flatnonzero(score >= net.threshold):
            i, c = free[k]
            more.setdefault(i, []).append((c["start"], len(KINDS), c["end"]))
    bases = [[(b["start"], b["kind"], b["end"]) for b in base] for base, _ in docs]
    return bases, [sorted(base + more.get(i, [])) for i, base in enumerate(bases)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, recall: float = 0.98) -> DataFrame:
    """Secrets of every whole text: ``id_col, base, spans``.

    Both are arrays of ``struct<start, kind, end>`` in order of start, then of kind, counted in code points
    with an exclusive end; ``spans`` has the base findings and, of kind ``learned``, the candidates that the
    network accepts. A null text is empty and has none; equal rows give equal results, one row per input
    row; other columns are ignored; very long texts are read whole, one at a time. Without
    12 findings of each label (a parameter of ``train``), as in an empty table, nothing is learned or added.
    """
    found = cut(extract(df, id_col, text_col))
    model = df.sparkSession.sparkContext.broadcast(train(found, sample, recall))
    kind = found.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    names = [*KINDS, LEARNED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = judge(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), model.value)
            columns = [pa.array([[{"start": s, "kind": names[k], "end": e} for s, k, e in doc] for doc in docs], span) for docs in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "base", "spans"])

    shape = "array<struct<start:long,kind:string,end:long>>"
    return found.mapInArrow(run, f"id {kind}, base {shape}, spans {shape}").withColumnRenamed("id", id_col)


def clean(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 2000, recall: float = 0.98) -> DataFrame:
    """The rows of ``df`` with every secret in ``text_col`` replaced by ``[SECRET]``; all rows and columns stay.

    Learns as ``scan`` does, then finds and replaces in one narrow pass, without moving a text. A null
    text stays null.
    """
    model = df.sparkSession.sparkContext.broadcast(train(cut(extract(df, id_col, text_col)), sample, recall))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column(at)):
                part = batch.slice(first, len(texts))
                _, spans = judge(list(map(findings, texts)), model.value)
                columns = list(part.columns)
                if any(spans):
                    there = part.column(at).is_valid().to_pylist()
                    texts = [None if not ok else t if not s else redact(t, [(a, b) for a, _, b in s]) for t, s, ok in zip(texts, spans, there, strict=True)]
                    columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)


def digest(spans: str):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
