"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of 16 or more characters that keys are made of, with a digit or
with both cases after its first letter.  The network reads the candidate and the text
around it, a candidate longer than INSIDE in overlapping windows and in its parts
between = / . too, of which the most suspicious counts; it is trained here on labelled findings, its outputs are calibrated on
findings held out from training, and its threshold is the highest that keeps the wanted
recall there.  It adds spans; those of the patterns always stay.

Cases: a null text counts as empty; an empty text has no spans (and the digest of an
empty list).  Texts are scanned whole, whatever their length.  Repeated rows are scanned
each; null doc_ids stay null; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Patterns of the query (fixed values of its contract).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "cnn")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
DIGIT = re.compile(r"[0-9]")
ENDS = "+/_.=~-"
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Characters from one window of a long candidate to the next.
STEP = 10
PART = re.compile(r"[^=/.]{16,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def mixed(text: str, a: int, b: int) -> bool:
    """Whether a run has a digit, or both cases after its first letter."""
    if DIGIT.search(text, a, b):
        return True
    tail = text[a + 1 : b]
    return tail != tail.lower() and tail != tail.upper()


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns.  Access keys and hex strings lie inside runs."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for a, b in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        if b - a >= 32:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def outside(text: str, run: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of a candidate outside the patterns' spans (sorted), where it is long enough to be one itself; separators at its ends are dropped."""
    a, b = run
    cuts = [(s, e) for s, _, e in base if s < b and a < e]
    if not cuts:
        return [run]
    found, at = [], a
    for s, e in [*cuts, (b, b)]:
        if s > at:
            found += [(at + len(x) - len(x.lstrip(ENDS)), s - len(x) + len(x.rstrip(ENDS))) for x in (text[at:s],)]
        at = max(at, e)
    return [(x, y) for x, y in found if RUN.fullmatch(text, x, y)]


# --- the network -----------------------------------------------------------------------

#: Character classes: lower-case letters, upper-case letters, digits and common signs each for itself; the rest together.
_SIGNS = " \n\t\"'=:+/_.-~,;()[]{}<>@#$%&*!?|\\"
_CLASS = np.full(256, 1, dtype=np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + _SIGNS):
    _CLASS[ord(_c)] = _i + 2
N_CLASSES = int(_CLASS.max()) + 1  # 0 fills up


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Character classes of each candidate and what surrounds it."""
    out = np.zeros((len(spans), WIDTH), dtype=np.int64)
    for row, (a, b) in zip(out, spans, strict=True):
        for at, part in ((BEFORE - len(text[max(0, a - BEFORE) : a]), text[max(0, a - BEFORE) : a]), (BEFORE, text[a : min(b, a + INSIDE)]), (BEFORE + INSIDE, text[b : b + AFTER])):
            codes = np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)
            row[at : at + len(codes)] = _CLASS[codes]
    return out


def within(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Parts and windows of a long candidate that are candidates themselves, as spans."""
    for m in PART.finditer(text, a, b):
        if mixed(text, *m.span()):
            yield m.span()
    for at in [*range(a + STEP, b - INSIDE, STEP), b - INSIDE]:
        if mixed(text, at, at + INSIDE):
            yield at, at + INSIDE


@dataclass
class Network:
    """Embedding, one convolution, pooling by mean and maximum, a linear layer; scale and shift calibrate."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    report: dict = field(default_factory=dict)

    SPAN = 5

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        steps = x.shape[1] - self.SPAN + 1
        cols = np.concatenate([e[:, i : i + steps] for i in range(self.SPAN)], axis=2)
        act = np.maximum(cols @ self.filters + self.bias, 0)
        pooled = np.concatenate([act.mean(1), act.max(1)], axis=1)
        return cols, act, pooled, pooled @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048)] or [np.zeros(0, np.float32)])
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64) + self.shift, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 10, n_filters: int = 24, size: int = 8) -> Network:
    """Adam on the log loss, in small batches, in a fixed order."""
    rng = np.random.default_rng(seed)
    real = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    net = Network(rng.normal(0, 0.5, (N_CLASSES, size)).astype(np.float32), real(Network.SPAN * size, n_filters), np.zeros(n_filters, np.float32), real(2 * n_filters))
    params = [net.embed, net.filters, net.bias, net.out]
    bias = np.zeros(1, np.float32)
    params.append(bias)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            some = order[at : at + 64]
            net.out_bias = float(bias[0])
            cols, act, pooled, logit = net.forward(x[some])
            d = ((1 / (1 + np.exp(-logit)) - y[some]) / len(some)).astype(np.float32)
            g_pool = d[:, None] * net.out
            g_act = np.repeat(g_pool[:, None, :n_filters] / act.shape[1], act.shape[1], axis=1)
            peak = act.argmax(1)
            np.put_along_axis(g_act, peak[:, None, :], np.take_along_axis(g_act, peak[:, None, :], 1) + g_pool[:, None, n_filters:], 1)
            g_act = g_act * (act > 0)
            g_cols = g_act @ net.filters.T
            g_embed = np.zeros_like(net.embed)
            for i in range(Network.SPAN):
                np.add.at(g_embed, x[some][:, i : i + act.shape[1]], g_cols[:, :, i * size : (i + 1) * size])
            grads = [g_embed, cols.reshape(-1, cols.shape[2]).T @ g_act.reshape(-1, n_filters), g_act.sum((0, 1)), pooled.T @ d, d.sum(keepdims=True)]
            t += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    net.out_bias = float(bias[0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, recall: float) -> None:
    """Platt scaling on held-out findings, then the highest threshold that keeps the recall there."""
    z = np.concatenate([net.forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048)]).astype(np.float64)
    a, b = 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(25):  # Newton on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w, r = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, np.array([(r * z).sum(), r.sum()])), -2, 2)
    net.scale, net.shift = float(a), float(b)
    score = np.sort(net.probability(x)[y > 0])
    net.threshold = float(score[int((1 - recall) * len(score))])
    hit = net.probability(x) >= net.threshold
    net.report = {"recall": float(hit[y > 0].mean()), "false": float(hit[y == 0].mean()), "threshold": net.threshold}


def findings(n: int, seed: int) -> list[tuple[str, tuple[int, int], int]]:
    """Labelled findings (text, span, 1 for a secret), made by rule: n are drawn, half of them secrets."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    syllable = lambda: r.choice(["b", "c", "d", "f", "g", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w", "sch", ""]) + r.choice("aeiou") + r.choice(["n", "r", "s", "t", "nd", "ng", "", "", "l"])
    word = lambda a=1, b=3: "".join(syllable() for _ in range(r.randint(a, b)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    secrets = [
        lambda: some(low + up + dig, 20, 48),
        lambda: some("0123456789abcdef", 24, 64),
        lambda: "AKIA" + some(up + dig, 14, 16),
        lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "pk_"]) + some(low + up + dig, 20, 36),
        lambda: some(low + up + dig + "+/", 24, 60) + r.choice(["", "=", "=="]),
        lambda: "eyJ" + some(low + up + dig, 20, 36) + "." + some(low + up + dig + "_-", 20, 40),
    ]
    others = [
        lambda: word(6, 10),
        lambda: word(6, 9).capitalize(),
        lambda: "_".join(word() for _ in range(r.randint(4, 6))) + some(dig, 1, 2),
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 5))),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}",
        lambda: some(dig, 16, 20),
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 999)}.html",
        lambda: f"www.{word()}.example.com/{word()}/{r.randint(1, 9999)}",
        lambda: "-".join(word() for _ in range(r.randint(3, 5))) + f"-{r.randint(1, 99)}",
        lambda: f"{word()}.{word()}{r.randint(1, 99)}.example.org",
        lambda: ".".join(str(r.randint(100, 255)) for _ in range(4)) + f".{r.randint(1, 9)}",
        lambda: "+" + "-".join(some(dig, 3, 4) for _ in range(4)),
        lambda: r.choice("-=_.~+") * r.randint(16, 40) + r.choice(["", "1", "A1"]),
        lambda: word(3, 5).upper() + r.choice(["_", "-"]) + word(3, 4).upper() + str(r.randint(0, 9)),
    ]
    cue = lambda: r.choice(["key", "Bearer", "auth", "credential", "pwd", "access", "private_key", "sig"]) + r.choice([" ", ": ", " = ", '="', "='", ":"])
    out = []
    for i in range(n):
        secret = i % 2
        core = r.choice(secrets if secret else others)()
        while len(core) < 16:
            core += r.choice("0123456789") if secret else syllable() + "1"
        before = prose(1, 4) + " " + (cue() if r.random() < (0.5 if secret else 0.15) else r.choice(["", "", "(", '"']))
        text = before + core + r.choice([" ", ", ", '"', "'", "\n", ") ", "; "]) + prose(0, 3)
        out.append((text, (len(before), len(before) + len(core)), secret))
    return out


_model: list[Network] = []


def model(n: int = 6000, recall: float = 0.98) -> Network:
    """The trained network; training is deterministic and happens once in a process."""
    if not _model:
        made = findings(n, 11)
        x = np.concatenate([windows(t, [s]) for t, s, _ in made])
        y = np.array([k for *_, k in made], dtype=np.float32)
        cut = n * 2 // 3
        net = train(x[:cut], y[:cut])
        calibrate(net, x[cut:], y[cut:], recall)
        _model.append(net)
    return _model[0]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def hidden(net: Network, text: str, a: int, b: int) -> bool:
    """Whether some part or window of a long candidate reaches the threshold."""
    inside = within(text, a, b)
    while some := list(islice(inside, 1024)):
        if (net.probability(windows(text, some)) >= net.threshold).any():
            return True
    return False


def _scan(net: Network):
    def flush(rows: list, held: list[np.ndarray], owners: list[tuple[int, int, int]], deep: list[tuple[int, int, int]]) -> pa.RecordBatch:
        extra: dict[int, list] = {}
        found = set(deep)
        if owners:
            p = net.probability(np.concatenate(held))
            for (row, a, b), q in zip(owners, p, strict=True):
                if q >= net.threshold or (row, a, b) in found:
                    extra.setdefault(row, []).append((a, 3, b))
        cols: list[list] = [[], [], [], [], [], []]
        for i, (doc, base) in enumerate(rows):
            for c, v in zip(cols, (doc, *(sum(k == kind for _, k, _ in base) for kind in (0, 1, 2)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(sorted(base + extra.get(i, [])))), strict=True):
                c.append(v)
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, owners, deep = [], [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                text = text.as_py() or ""
                runs = [m.span() for m in RUN.finditer(text)]
                base = base_spans(text, runs)
                picked = [s for r in runs for s in outside(text, r, base) if mixed(text, *s)]
                if picked:
                    held.append(windows(text, picked))
                    owners += [(len(rows), *s) for s in picked]
                deep += [(len(rows), *s) for s in picked if s[1] - s[0] > INSIDE and hidden(net, text, *s)]
                rows.append((doc, base))
                if len(owners) >= 4096:
                    yield flush(rows, held, owners, deep)
                    rows, held, owners, deep = [], [], [], []
            if rows:
                yield flush(rows, held, owners, deep)

    return run


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.  The network (some ten KB) goes along with the code."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(net or model()), SCHEMA)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
