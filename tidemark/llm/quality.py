"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Training boosts shallow trees in turn over the features, each tree seeing one feature (later: one pair), and adds their steps
up into one lookup table a feature and one a pair. Scoring is binning and adding table entries, whole columns at a time.

Labels are learned from at most ``max_rows`` labelled rows, chosen by a hash of the id; that bound is the only one: every
text is read whole and every document is scored. The rows held out (crc32 of the id modulo 5 is 0) are never learned from,
and label, language, source and id are not features.

Null and edge cases
* null or empty text: all statistics are 0; it is scored like any other.
* a null label is not learned from; an id labelled more than once counts with its smallest label.
* without labels the score is 0.5, with labels of one class that class's smoothed share.
* repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw

FEATURES = (
    "log_words", "word_length", "lower", "upper", "digits", "marks", "stops", "wide", "distinct_words", "repeated_lines",
    "top_word", "doubled_words", "symbols", "bars", "shouts", "line_words", "capitals", "sentence_words", "distinct_pairs",
)
_LOWER, _UPPER, _DIGIT, _MARK, _SPACE = (np.zeros(256) for _ in range(5))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = 1
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_MARK[33:127] = 1
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = 0
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _MARK, _SPACE], axis=1)
_CONTINUES = slice(0x80, 0xC0)


def text_features(text: bytes) -> list[float]:
    """Statistics of one whole text, in the order of ``FEATURES``."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lower, upper, digit, mark, space = (seen @ _CLASSES).tolist()
    chars = n - int(seen[_CONTINUES].sum())
    words = text.split()
    k = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    letters = max(lower + upper, 1)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stops = int(seen[46])
    return [
        float(np.log1p(k)), (chars - space) / max(k, 1), lower / chars, upper / letters, digit / chars, mark / chars,
        (stops + int(seen[44])) / max(k, 1), 1 - (n - int(seen[128:].sum())) / chars, len(counts) / max(k, 1),
        1 - len(set(lines)) / max(len(lines), 1), max(counts.values(), default=0) / max(k, 1), doubled / max(k, 1),
        int(seen[[35, 36, 37, 38, 42, 94, 95, 126]].sum()) / max(k, 1), int(seen[124]) / max(k, 1), int(seen[33]) / max(k, 1),
        k / max(len(lines), 1), sum(w[:1].isupper() for w in words) / max(k, 1), k / (stops + 1),
        len(set(zip(words, words[1:], strict=False))) / max(k - 1, 1),
    ]


@dataclass
class AdditiveModel:
    """Intercept, cut points and tables by feature, coarse cut points and tables by pair."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, a row of features each."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Newton steps by bin of a tree of the given depth over one ordered feature."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1, l2), _tree(g[at:], h[at:], depth - 1, l2)])
    return np.full(len(g), g.sum() / (h.sum() + l2))


def _quarters(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best split of a pair of features into four quarters."""
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        return [a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a]

    pg, ph = parts(cg), parts(ch)
    gain = sum(x**2 / (y + l2) for x, y in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = np.empty_like(g)
    v = [x[i, j] / (y[i, j] + l2) for x, y in zip(pg, ph, strict=True)]
    steps[: i + 1, : j + 1], steps[: i + 1, j + 1 :], steps[i + 1 :, : j + 1], steps[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + l2)), steps


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, bins: int = 64, rate: float = 0.15, l2: float = 5.0) -> AdditiveModel:
    """Cyclic boosting: one shallow tree a feature in every round, then the pairs with the most gain left."""
    model = AdditiveModel(intercept=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(c, bins) for c in x.T]
    model.coarse = [_cuts(c, 12) for c in x.T]
    fine = [np.searchsorted(c, v, side="right") for c, v in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), 2, l2)
            model.tables[j] += step
            total += step[b]
    rough = [np.searchsorted(c, v, side="right") for c, v in zip(model.coarse, x.T, strict=True)]
    size = [len(c) + 1 for c in model.coarse]

    def grid(v: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.bincount(rough[a] * size[b] + rough[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    found = sorted(((_quarters(grid(g, a, b), grid(h, a, b), l2)[0], a, b) for a in range(len(size)) for b in range(a)), reverse=True)
    model.pairs = {(a, b): np.zeros((size[a], size[b])) for gain, a, b in found[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            g, h = slopes()
            step = rate * _quarters(grid(g, a, b), grid(h, a, b), l2)[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = 20_000) -> AdditiveModel:
    """The model of at most ``max_rows`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.min(label) > 0).cast("int").alias("__y"))
    chosen = known.orderBy(F.xxhash64(F.lit(17), id_col), id_col).limit(max_rows)  # the documented bound
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    seen = map_batches(
        rows, lambda c: {id_col: c[id_col], "y": c["__y"], "x": [text_features(t) for t in raw(c[text])]}, f"`{id_col}` {kind}, y int, x array<double>"
    ).orderBy(F.xxhash64(F.lit(17), id_col), id_col, "x").limit(max_rows).collect()
    x = np.array([r["x"] for r in seen], dtype=float).reshape(len(seen), len(FEATURES))
    return fit(x, np.array([r["y"] for r in seen], dtype=float))


def score_documents(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text: str = "text", carry=()) -> DataFrame:
    """id, the columns of ``carry`` and score (0 to 1) of every document."""
    keep = list(dict.fromkeys([id_col, *carry]))
    read = docs.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)

    def score(cols: dict) -> dict:
        x = np.array([text_features(t) for t in raw(cols[text])], dtype=float).reshape(-1, len(FEATURES))
        return {**{c: cols[c] for c in keep}, "score": model.score(x)}

    return map_batches(read, score, f"{fields}, score double")
