"""Secrets in texts: base rules, and a convolutional network over characters that adds to them.

Candidates are long runs of the characters that secrets are written in. The network sees each
of them with what stands before and after. It is trained in numpy on labelled findings
(``findings``: a window of characters and whether it is a secret), its scores are calibrated on
findings that training didn't see, and a threshold per shape of candidate is the highest one
that still finds the wanted share of the known secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import value_counts
from ..values import number
from .common import frugal, written

# Base rules (fixed values), in the order in which kinds are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Kind of the spans that the network adds; it is listed last.
MODEL = "model"
KINDS = ("assign", "access", "hex", MODEL)

#: A candidate is a run of value characters, so long where it has a digit and so long where not.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_DIGIT = re.compile(r"[0-9]")
PLAIN_LEAST = 20
#: Characters of a window: before the candidate, of it (its ends, if it is longer), after it.
BEFORE, HELD, AFTER = 24, 40, 8
WIDTH = BEFORE + HELD + AFTER
_GAP = "\x00"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the base rules find, by start, then kind as listed.

    Long runs that a rule takes whole are searched for directly: a shorter one fails and, as it
    ends where its characters end, hides no other.
    """
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= PLAIN_LEAST or _DIGIT.search(text, *m.span())]


def window(text: str, start: int, end: int) -> str:
    """``WIDTH`` characters around a candidate, filled up with gaps."""
    size = end - start
    body = text[start:end].ljust(HELD, _GAP) if size <= HELD else text[start : start + HELD // 2] + text[end - HELD // 2 : end]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, _GAP) + body + text[end : end + AFTER].ljust(AFTER, _GAP)


def overlapped(span: tuple[int, int], spans: list[tuple[int, int, str]]) -> bool:
    return any(a < span[1] and span[0] < b for a, b, _ in spans)


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# Characters as the network sees them: printable ASCII, a gap, a line's end, any other.
_SYMBOLS = 98


def encoded(windows: list[str]) -> np.ndarray:
    """Symbols of each window, a row each."""
    points = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)
    out = np.where((points >= 32) & (points < 127), points - 31, 97)
    out[points == 0] = 0
    out[points == 10] = 96
    return out.astype(np.int32)


def shapes(symbols: np.ndarray) -> np.ndarray:
    """1 where a candidate is lower-case hexadecimal, 2 where it is upper-case letters and digits, else 0."""
    body = symbols[:, BEFORE : BEFORE + HELD] + 31
    gap, digit = body == 31, (body >= 48) & (body <= 57)
    lower = (gap | digit | ((body >= 97) & (body <= 102))).all(axis=1)
    upper = (gap | digit | ((body >= 65) & (body <= 90))).all(axis=1)
    return np.where(lower, 1, np.where(upper, 2, 0))


SHAPES = 3
_EMBED, _SPAN, _FILTERS, _HIDDEN = 10, 5, 24, 16
#: 1 where a position belongs to the candidate.
_INSIDE = np.zeros((1, WIDTH, 1), np.float32)
_INSIDE[:, BEFORE : BEFORE + HELD] = 1


@dataclass
class Network:
    """Embedding, one convolution, its greatest and mean response, a hidden layer and a logit."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        size = {"embed": (_SYMBOLS, _EMBED), "conv": (_SPAN * (_EMBED + 1), _FILTERS), "conv_b": (_FILTERS,), "hidden": (2 * _FILTERS, _HIDDEN), "hidden_b": (_HIDDEN,), "out": (_HIDDEN, 1), "out_b": (1,)}
        return Network({k: (rng.standard_normal(s) * (0 if k.endswith("_b") else 0.3 if k == "embed" else (2 / s[0]) ** 0.5)).astype(np.float32) for k, s in size.items()})

    def forward(self, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, n = self.weights, len(symbols)
        rows = np.concatenate([w["embed"][symbols], np.broadcast_to(_INSIDE, (n, WIDTH, 1))], axis=2)
        spans = np.lib.stride_tricks.sliding_window_view(rows, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, WIDTH - _SPAN + 1, -1)
        conv = np.maximum(spans @ w["conv"] + w["conv_b"], 0)
        top = conv.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0], conv.mean(axis=1)], axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_b"], 0)
        return (hidden @ w["out"] + w["out_b"])[:, 0], (symbols, spans, conv, top, pooled, hidden)

    def gradients(self, wrong: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Of the loss whose derivative by each logit is ``wrong``."""
        symbols, spans, conv, top, pooled, hidden = kept
        w, n, places = self.weights, len(wrong), WIDTH - _SPAN + 1
        out = {"out": hidden.T @ wrong[:, None], "out_b": wrong.sum(keepdims=True)}
        at_hidden = wrong[:, None] * w["out"].T * (hidden > 0)
        out |= {"hidden": pooled.T @ at_hidden, "hidden_b": at_hidden.sum(axis=0)}
        at_pooled = at_hidden @ w["hidden"].T
        at_conv = np.repeat(at_pooled[:, None, _FILTERS:] / places, places, axis=1)
        rows, filters = np.arange(n)[:, None], np.arange(_FILTERS)[None, :]
        at_conv[rows, top, filters] += at_pooled[:, :_FILTERS]
        at_conv *= conv > 0
        flat = at_conv.reshape(-1, _FILTERS)
        out |= {"conv": spans.reshape(len(flat), -1).T @ flat, "conv_b": flat.sum(axis=0)}
        at_spans = (flat @ w["conv"].T).reshape(n, places, _SPAN, _EMBED + 1)[..., :_EMBED]
        at_rows = np.zeros((n, WIDTH, _EMBED), np.float32)
        for i in range(_SPAN):
            at_rows[:, i : i + places] += at_spans[:, :, i]
        at_embed = np.zeros_like(w["embed"])
        np.add.at(at_embed, symbols.ravel(), at_rows.reshape(-1, _EMBED))
        return out | {"embed": at_embed}

    def logits(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(symbols[i : i + 512])[0] for i in range(0, len(symbols), 512)] or [np.zeros(0, np.float32)])


@dataclass
class Adam:
    """A network with the running means of its gradients and of their squares."""

    network: Network
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    @staticmethod
    def fresh(seed: int) -> Adam:
        net = Network.fresh(seed)
        return Adam(net, *({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2)))

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.network.weights, self.first, self.second]

    def packed(self) -> bytes:
        return b"".join(part[k].astype(np.float32).tobytes() for part in self.parts() for k in sorted(part))

    def replaced(self, flat: np.ndarray, step: int) -> Adam:
        """The state that ``flat`` holds, in the order of ``packed``."""
        at, out = 0, []
        for part in self.parts():
            made = {}
            for k in sorted(part):
                made[k] = flat[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size
            out.append(made)
        return Adam(Network(out[0]), out[1], out[2], step)

    def learn(self, symbols: np.ndarray, secret: np.ndarray, share: np.ndarray, rng: np.random.Generator, batch: int = 128, rate: float = 4e-3) -> None:
        """One pass over the rows, in any order. Half of the windows of every batch lose what stands
        around the candidate, so that its own shape is learned too."""
        order = rng.permutation(len(symbols))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            x = symbols[some].copy()
            bare = rng.random(len(some)) < 0.5
            x[bare, :BEFORE] = 0
            x[bare, BEFORE + HELD :] = 0
            logit, kept = self.network.forward(x)
            wrong = ((1 / (1 + np.exp(-logit)) - secret[some]) * share[some] / len(some)).astype(np.float32)
            self.step += 1
            for k, g in self.network.gradients(wrong, kept).items():
                self.first[k] += 0.1 * (g - self.first[k])
                self.second[k] += 0.001 * (g * g - self.second[k])
                self.network.weights[k] -= rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


def _shares(secret: np.ndarray, mean: float) -> np.ndarray:
    """Weights of rows by which both classes weigh the same."""
    return np.where(secret, 0.5 / max(mean, 1e-9), 0.5 / max(1 - mean, 1e-9)).astype(np.float32)


#: Passes over all findings.
ROUNDS = 8
#: Findings up to which the driver learns by itself, and about as many a task learns from; there are
#: at most so many tasks a pass, whose shares grow beyond that.
TASK_ROWS, TASKS = 8192, 64


def train_network(rows: DataFrame, n: int, mean: float, seed: int = 7) -> Network:
    """Adam on the cross entropy over all ``n`` rows (``window``, ``secret``, ``h``), both classes of equal
    weight; ``mean`` is the share of secrets. Beyond ``TASK_ROWS`` rows each task passes over its own
    rows from the common state, and the tasks' states are averaged by their rows after each pass."""
    state = Adam.fresh(seed)
    ordered = ["h", "window", "secret"]
    if n <= TASK_ROWS:
        here = rows.orderBy(*ordered).collect()
        symbols, secret = encoded([r["window"] for r in here]), np.array([r["secret"] for r in here])
        rng = np.random.default_rng(seed)
        for _ in range(ROUNDS):
            state.learn(symbols, secret, _shares(secret, mean), rng)
        return state.network
    dealt = written(rows.select(*ordered), "finding-shares").repartition(min(TASKS, -(-n // TASK_ROWS)), "h", "window").sortWithinPartitions(*ordered)
    for i in range(ROUNDS):
        ends = dealt.mapInArrow(frugal(_pass(state, i, mean, seed)), "task int, n long, steps int, state binary").collect()
        ends.sort(key=lambda r: r["task"])
        total = sum(r["n"] for r in ends)
        flat = sum(np.frombuffer(r["state"], np.float32).astype(np.float64) * (r["n"] / total) for r in ends)
        state = state.replaced(flat, state.step + max(r["steps"] for r in ends))
    return state.network


def _pass(start: Adam, i: int, mean: float, seed: int):
    """A task's pass over its rows from the state ``start``: how many rows, steps, and the state then."""
    packed, begun = start.packed(), start.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        state = Adam.fresh(seed).replaced(np.frombuffer(packed, np.float32), begun)
        rng = np.random.default_rng([seed, i, task])
        for batch in batches:
            if len(batch):
                secret = batch.column("secret").to_numpy(zero_copy_only=False)
                state.learn(encoded(batch.column("window").to_pylist()), secret, _shares(secret, mean), rng)
                n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([state.step - begun], pa.int32()), pa.array([state.packed()], pa.binary())], names=["task", "n", "steps", "state"])

    return run


@dataclass(frozen=True)
class Scanner:
    """A trained network, the slope and shift that calibrate its logits, and a threshold a shape."""

    network: Network
    slope: float
    shift: float
    thresholds: tuple[float, ...]
    #: How many findings it was learned from, those that calibrate included.
    findings: int = 0

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that windows are secrets."""
        return _sigmoid(self.slope * self.network.logits(symbols).astype(float) + self.shift)

    def secrets(self, windows: list[str]) -> np.ndarray:
        symbols = encoded(windows)
        return self.scores(symbols) >= np.array(self.thresholds)[shapes(symbols)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrated(logits: DataFrame, good: int, bad: int) -> tuple[float, float]:
    """Slope and shift of least cross entropy (Newton's method) of ``logit`` and ``secret``, with the usual
    softened targets; a pass over the rows for each step."""
    x, target = F.col("logit"), F.when(F.col("secret"), (good + 1) / (good + 2)).otherwise(1 / (bad + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x * float(w[0]) + float(w[1])))
        p = logits.select(x.alias("x"), (1 / (1 + F.exp(-z))).alias("p"), target.alias("t"))
        q, d = F.col("p") * (1 - F.col("p")), F.col("p") - F.col("t")
        a, b, c, u, v = p.agg(F.sum(q * F.col("x") * F.col("x")), F.sum(q * F.col("x")), F.sum(q), F.sum(d * F.col("x")), F.sum(d)).first()
        step = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-6 * np.eye(2), np.array([u, v]) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def constrained(scores: np.ndarray, recall: float) -> float:
    """The highest threshold that ``recall`` of the scores of known secrets reach."""
    ordered = np.sort(scores)[::-1]
    return float(ordered[max(0, int(np.ceil(recall * len(ordered))) - 1)])


#: Known secrets of a shape below which the threshold is that of all shapes.
SHAPE_LEAST = 20
#: Share of the findings that calibrate, in fifths.
_HELD_OUT = 5


def _least_logits(secrets: DataFrame, recall: float) -> dict[int, tuple[float, int]]:
    """The highest logit that ``recall`` of the known secrets reach, and how many there are, by shape, and
    of all under -1. Values are ordered in ranges apart from each other."""
    both = secrets.select(F.explode(F.array(F.lit(-1), "shape")).alias("kind"), "logit")
    counts = value_counts(both, number("logit"), ["kind"])
    place = F.col("total") - F.greatest(F.ceil(F.col("total") * F.lit(recall)), F.lit(1))
    reached = counts.where((place >= F.col("below")) & (place < F.col("below") + F.col("n")))
    return {r["kind"]: (r["v"], r["total"]) for r in reached.select("kind", "v", "total").collect()}


def train_scanner(findings: DataFrame, recall: float = 0.99, seed: int = 7) -> Scanner | None:
    """A scanner from labelled ``findings`` (``window``, ``secret``), or None where either class has
    none.

    All findings are learned from; equal windows with equal labels count once. A fifth, by a hash of
    the window, isn't trained on and sets calibration and thresholds.
    """
    hashed = findings.where(F.col("window").isNotNull() & F.col("secret").isNotNull()).select("window", "secret").distinct().withColumn("h", F.xxhash64("window", F.lit(seed)))
    hashed = written(hashed.withColumn("held", F.pmod("h", F.lit(_HELD_OUT)) == 0), "labelled-findings")
    counts = {(r["held"], r["secret"]): r["count"] for r in hashed.groupBy("held", "secret").count().collect()}
    of = lambda secret: counts.get((True, secret), 0) + counts.get((False, secret), 0)
    if not of(True) or not of(False):
        return None
    apart = len(counts) == 4  # else too few for both: all train and calibrate
    rows, left = (hashed.where("not held"), hashed.where("held")) if apart else (hashed, hashed)
    size = lambda held, secret: counts[held, secret] if apart else of(secret)
    n = size(False, True) + size(False, False)
    network = train_network(rows, n, size(False, True) / n, seed)
    judged = written(left.mapInArrow(frugal(_logits_of(network)), "secret boolean, logit double, shape int"), "judged-findings")
    slope, shift = calibrated(judged, size(True, True), size(True, False))
    least = _least_logits(judged.where("secret"), recall)
    # a threshold stays above even odds: a lower one would be none
    score = lambda kind: max(0.5, float(_sigmoid(slope * least[kind][0] + shift)))
    thresholds = tuple(score(k if k in least and least[k][1] >= SHAPE_LEAST else -1) for k in range(SHAPES))
    return Scanner(network, slope, shift, thresholds, sum(counts.values()))


def _logits_of(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = encoded(batch.column("window").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("secret"), pa.array(network.logits(symbols).astype(np.float64)), pa.array(shapes(symbols).astype(np.int32))], names=["secret", "logit", "shape"])

    return run


def base_findings(docs: DataFrame) -> DataFrame:
    """Labelled findings (``window``, ``secret``) that the base rules give: a candidate is a secret
    where a base span covers it. Distinct, of all whole texts."""
    out = pa.schema([("window", pa.string()), ("secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, bool]] = set()
            for value in batch.column("text"):
                text = value.as_py()
                spans = base_spans(text)
                rows.update((window(text, a, b), overlapped((a, b), spans)) for a, b in candidates(text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], out.field(i).type) for i in range(2)], schema=out)

    return docs.where("text is not null").select("text").mapInArrow(frugal(run), "window string, secret boolean")


_ADDED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanned(docs: DataFrame, scanner: Scanner | None) -> DataFrame:
    """``doc_id`` and what ``secret_spans`` says of every row of ``docs``."""
    names = [c.split()[0] for c in _ADDED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[tuple[int, int, str]]] = []
            asked: list[tuple[int, int, int]] = []
            windows: list[str] = []
            hits: list[np.ndarray] = []

            def judge() -> None:
                if windows:
                    hits.append(scanner.secrets(windows))
                    windows.clear()

            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                spans = base_spans(text)
                found.append(spans)
                if scanner is not None:
                    new = [s for s in candidates(text) if not overlapped(s, spans)]
                    asked += [(i, a, b) for a, b in new]
                    for a, b in new:
                        windows.append(window(text, a, b))
                        if len(windows) >= 4096:
                            judge()
            judge()
            base = [shown(spans) for spans in found]
            more: dict[int, list[tuple[int, int, str]]] = {}
            for (i, a, b), hit in zip(asked, np.concatenate(hits).tolist() if hits else [], strict=True):
                if hit:
                    more.setdefault(i, []).append((a, b, MODEL))
            every = [shown(sorted(spans + more[i], key=lambda s: (s[0], KINDS.index(s[2])))) if i in more else base[i] for i, spans in enumerate(found)]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in KINDS[:3]]
            digests = pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array(every, pa.string())], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {dict(docs.dtypes)['doc_id']}, {_ADDED}")


def secret_spans(docs: DataFrame, findings: DataFrame | None = None, recall: float = 0.99) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` (base findings), ``base_sha256`` of the base
    spans and ``spans``, all spans as kind:start:end (code points), by start, then kind.

    ``findings`` (``window``, ``secret``) are labelled ones to learn from; without any, candidates
    that base rules cover are the secrets and all others are not (``base_findings``). The network
    only adds spans that no base span overlaps. Every row of ``docs`` is judged apart; a null text
    counts as an empty one and has no spans. Where there is nothing to learn from, as in an empty
    table, the base rules alone decide. Other columns of ``docs`` are ignored.
    """
    known = written(base_findings(docs) if findings is None else findings.select("window", "secret"), "findings")
    return scanned(docs, train_scanner(known, recall=recall))
