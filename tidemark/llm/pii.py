"""Personal data: patterns, and a skip-chain conditional random field for what they leave.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels every token that holds a digit or
an at sign: neighbours share transition potentials (the chain), and distant tokens with the same characters, or the same digits,
share skip potentials. Loopy message passing, until no message changes any more, makes their labels agree across the document, so
that a number recognised once is found again where it is written otherwise. Tokens inside base spans are evidence and keep their
label; every other token is linked with the evidence of its group itself, so that distance and number of repeats do not matter.
A run of adjacent tokens whose digits end as those of a recognised card or phone number, seven digits or more, is linked with it too.

Weights are learned by pseudo-likelihood from the base spans of at most ``max_docs`` documents and ``max_tokens`` tokens, chosen by
hash; these bounds are the only ones. For each token of a base span a second occurrence is learned whose label is
hidden: written otherwise, elsewhere in its text, linked with the first; the same form without a link is no personal data. These rows
together weigh as much as the tokens of the texts, if those are more. An unlabelled token that is linked with evidence is unknown: neither
a target nor a neighbour. Finding runs over every whole text.

Null and edge cases
* null or empty text: no spans. * repeated rows are scanned each; an empty table gives an empty result.
* where nothing can be learned (no token with a digit or an at sign) the field adds nothing.
* spans of the field never overlap base spans; columns other than id and text are only passed through by ``mask_spans``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping by kind, in code points.

    E-mail addresses are sought from their at signs and IP addresses from the starts of digit runs, which gives the same
    matches as the plain patterns in linear time.
    """
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            first = at
            while first > last and text[first - 1] in _LOCAL:
                first -= 1
            if first < at:
                out.append((first, m.end(), "email"))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for pattern, kind, least, most in ((_CARD, "card", 12, 19), (_PHONE, "phone", 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the field -------------------------------------------------------------------------------------------------------

_LABELS = ("none", *KINDS)
_N_FEATURES = 256
#: Digits at the end that make two numbers the same, and the most digits of a number.
_SUFFIX, _MOST = 7, 19


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", "9", token)
    s = re.sub(r"[A-Za-z\x80-\U0010ffff]+", "a", s)
    return s[:12]


def _stable(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode(errors="replace"))


def _features(token: str, before: str, after: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    given = (
        f"d{min(digits, 16)}", f"s{_shape(token)}", f"l{min(len(token), 20)}", f"at{'@' in token}", f"dot{min(token.count('.'), 4)}", f"p{token[:1] == '+'}",
        f"par{'(' in token}", f"b{_shape(before)[:4]}", f"a{_shape(after)[:4]}", f"dd{min(digits, 16)}.{min(token.count('.'), 4)}",
    )
    return [_stable(g) % (_N_FEATURES - 1) for g in given] + [_N_FEATURES - 1]


def _key(token: str) -> str:
    """Equal for tokens that say the same: four groups of an address, their digits if there are four or more, else their letters, digits and at signs."""
    groups = re.findall("[0-9]+", token)
    if len(groups) == 4 and "@" not in token and all(len(d) <= 3 and int(d) <= 255 for d in groups):
        return ".".join(groups)  # an address is not the number of the same digits
    digits = "".join(groups)
    return digits if len(digits) >= 4 and "@" not in token else re.sub(r"[^a-z0-9@.]", "", token.lower()).strip(".")


class _Graph:
    """Candidate tokens of one text: features, base labels, chain and skip edges."""

    def __init__(self, text: str, base: list[Span]):
        self.tokens: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.labels: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        groups: dict[str, list[int]] = {}
        anchors: dict[Span, int] = {}
        at, last = 0, None
        for i, (a, b) in enumerate(found):
            token = text[a:b]
            if not _SOME.search(token):
                continue
            while at < len(base) and base[at][1] <= a:
                at += 1
            span = next((x for x in base[at : at + 8] if x[0] < b and x[1] > a), None)
            label = _LABELS.index(span[2]) if span else 0
            n = len(self.tokens)
            self.tokens.append((a, b))
            self.features.append(_features(token, text[slice(*found[i - 1])] if i else "", text[slice(*found[i + 1])] if i + 1 < len(found) else ""))
            self.labels.append(label)
            if last == i - 1 and n:
                self.chain.append((n - 1, n))
            whole = not span or not _SOME.search(text[span[0] : a] + text[b : span[1]])
            key = _key(token) if whole else ""  # a piece of a span says nothing about its equals
            if span:
                anchors.setdefault(span, n)
            if len(key) >= 4:
                groups.setdefault(key, []).append(n)
            last = i
        done, pieces = self._link_runs(text, anchors)
        for members in ([n for n in g if n not in pieces] for g in groups.values()):  # stars, not pairs: around the first evidence of each label, else around the first token
            hubs = {self.labels[n]: n for n in reversed(members) if self.labels[n]}.values() or members[:1]
            self.skip += [(min(hub, n), max(hub, n)) for hub in hubs for n in members if n != hub and not self.labels[n] and (n, self.labels[hub]) not in done]

    def _link_runs(self, text: str, anchors: dict[Span, int]) -> tuple[set[tuple[int, int]], set[int]]:
        """Skip edges from recognised numbers to the runs of unlabelled tokens that end in the same digits.

        Gives the linked (token, label), and the tokens that are only pieces of such runs.
        """
        done: set[tuple[int, int]] = set()
        pieces: set[int] = set()
        ends: dict[str, dict[int, int]] = {}
        for (a, b, kind), n in anchors.items():
            if kind in ("card", "phone"):
                digits = re.sub("[^0-9]", "", text[a:b])
                for size in range(_SUFFIX, len(digits) + 1):
                    ends.setdefault(digits[-size:], {}).setdefault(_LABELS.index(kind), n)
        if not ends:
            return done, pieces
        follows = {b for _, b in self.chain}
        run: list[tuple[int, str]] = []
        for n, (a, b) in enumerate(self.tokens):
            token = text[a:b]
            if self.labels[n] or "@" in token:
                run = []
                continue
            if n not in follows or any(c.isalpha() for c in token):
                run = []
            run.append((n, re.sub("[^0-9]", "", token)))
            run = run[-_MOST:]  # each has a digit, and no number has more
            digits = "".join(d for _, d in run)[-_MOST:]
            size = next((k for k in range(len(digits), _SUFFIX - 1, -1) if digits[-k:] in ends), 0)
            for label, hub in ends[digits[-size:]].items() if size else ():
                left = size
                for m, d in reversed(run):
                    if left > 0 and (m, label) not in done:
                        done.add((m, label))
                        self.skip.append((min(hub, m), max(hub, m)))
                    if left > 0 and len(d) < size:
                        pieces.add(m)
                    left -= len(d)
        return done, pieces


class Field:
    """Weights: node (feature by label), chain (label by label, in order), skip (label by label, symmetric)."""

    def __init__(self, node: np.ndarray | None = None, chain: np.ndarray | None = None, skip: np.ndarray | None = None):
        k = len(_LABELS)
        self.trained = node is not None
        self.node = np.zeros((_N_FEATURES, k)) if node is None else node
        self.chain = np.zeros((k, k)) if chain is None else chain
        self.skip = np.zeros((k, k)) if skip is None else skip

    def beliefs(self, features: np.ndarray, fixed: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int | None = None, tolerance: float = 1e-7) -> np.ndarray:
        """Label probabilities of each token by damped sum-product messages over both kinds of edges.

        Only messages whose inputs changed are sent again, until no change exceeds ``tolerance``. After ``rounds`` rounds, by default
        more than any message needs to cross the text, the steps shrink, so that it also ends where loops make messages swing.
        """
        k, n = len(_LABELS), len(features)
        own = self.node[features].sum(1)
        own[fixed > 0] = -30.0
        own[fixed > 0, fixed[fixed > 0]] = 30.0
        own -= own.max(1, keepdims=True)
        edges = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
        m = len(edges)
        table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.exp(np.concatenate([table, table.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        free = fixed[target] == 0  # evidence hears nothing, however many tokens are linked with it
        message, total = np.zeros((2 * m, k)), own.copy()
        active, step, done = np.nonzero(free)[0], 0.5, 0
        rounds = 3 * n + 100 if rounds is None else rounds
        while len(active):
            out = total[source[active]] - message[back[active]]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("es,est->et", out, table[active]) + 1e-300)
            change = step * (new - new.max(1, keepdims=True) - message[active])
            message[active] += change
            np.add.at(total, target[active], change)
            moved = active[np.abs(change).max(1) > tolerance]
            heard = np.zeros(n, dtype=bool)
            heard[target[moved]] = True
            again = heard[source]
            again[moved] = True
            active = np.nonzero(again & free)[0]
            done += 1
            step *= 0.9 if done > rounds else 1
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_field(features: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray, weight: np.ndarray, steps: int = 150, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood: each token's label given its features, its neighbours' labels (-1: no such neighbour) and the number of
    tokens of each label it shares a skip edge with; each token counts by its weight."""
    k, n = len(_LABELS), len(labels)
    if not n:
        return Field()
    node, chain, skip = np.zeros((_N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
    hot = np.eye(k)[labels]
    speed = [np.zeros_like(w) + 1e-8 for w in (node, chain, skip)]
    for _ in range(steps):
        z = node[features].sum(1)
        for side, w in ((left, chain), (right, chain.T)):
            has = side >= 0
            z[has] += w[side[has]]
        z += linked @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        d = (hot - p / p.sum(1, keepdims=True)) * weight[:, None]
        gn, gc, gs = np.zeros_like(node), np.zeros_like(chain), linked.T @ d
        for j in range(features.shape[1]):
            np.add.at(gn, features[:, j], d)
        for side, turned in ((left, False), (right, True)):
            has = side >= 0
            add = np.zeros((k, k))
            np.add.at(add, side[has], d[has])
            gc += add.T if turned else add
        gs = (gs + gs.T) / 2
        for w, g, v in zip((node, chain, skip), (gn, gc, gs), speed, strict=True):
            g = g / weight.sum() - l2 * w
            v += g**2
            w += 0.3 * g / np.sqrt(v)
    return Field(node, chain, skip)


def _rewritten(token: str) -> list[str]:
    """A number in other forms, without its outer marks; other tokens stay as they are."""
    if "@" in token:
        return [token]
    inner = token.strip("+()[]{}<>.,;:!?\"'")
    forms = [inner, *(re.sub("[^0-9A-Za-z]+", sep, inner) for sep in ("", "-", ".", "/"))]
    return list(dict.fromkeys(f for f in forms if f != token)) or [token]


def _training_rows(text: str) -> list[dict]:
    """Target (y), features (f), neighbours' labels (n), linked labels (s) of the tokens to learn from, and whether they are made."""
    base = base_spans(text)
    g = _Graph(text, base)
    n = len(g.tokens)
    sides, linked = [[-1] * n for _ in range(2)], [[0] * len(_LABELS) for _ in range(n)]
    for a, b in g.skip:
        linked[a][g.labels[b]] += 1
        linked[b][g.labels[a]] += 1
    unknown = [not y and any(s[1:]) for y, s in zip(g.labels, linked, strict=True)]
    for a, b in g.chain:
        sides[0][b], sides[1][a] = -1 if unknown[a] else g.labels[a], -1 if unknown[b] else g.labels[b]
    rows = [{"f": g.features[i], "y": y, "n": [s[i] for s in sides], "s": linked[i] if not y else [0] * len(_LABELS), "made": False} for i, y in enumerate(g.labels) if not unknown[i]]
    words = [m.group() for m in _TOKEN.finditer(text)]
    for i, y in enumerate(g.labels):
        if y:
            token = text[slice(*g.tokens[i])]
            for other in _rewritten(token):
                at = _stable(f"{i} {other}") % len(words)
                row = {"f": _features(other, words[at - 1] if at else "", words[at]), "n": [-1, -1], "made": True}
                rows.append(row | {"y": y, "s": [int(k == y) for k in range(len(_LABELS))]})
                if not base_spans(other):
                    rows.append(row | {"y": 0, "s": [0] * len(_LABELS)})
    return rows


def train_field(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_docs: int = 4000, max_tokens: int = 20_000) -> Field:
    """The field learned from the base spans of a sample of the documents that hold a digit or an at sign."""
    some = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(id_col, text).alias("__h")).distinct().orderBy("__h").limit(max_docs)
    rows = docs.select(F.col(text), F.xxhash64(id_col, text).alias("__h")).join(F.broadcast(some), "__h").dropDuplicates(["__h"])
    seen = map_batches(
        rows.select("__h", text), lambda c: _flat(c["__h"].to_pylist(), [_training_rows(t) for t in texts(c[text])]), "h long, i int, f array<int>, y int, n array<int>, s array<int>, made boolean"
    ).orderBy(F.xxhash64("h", "i"), "h", "i").limit(max_tokens).collect()
    if not seen:
        return Field()
    f = np.array([r["f"] for r in seen], dtype=np.int64)
    sides = np.array([r["n"] for r in seen], dtype=np.int64).reshape(len(seen), 2)
    made = np.array([r["made"] for r in seen])
    weight = np.where(made, max(1.0, (~made).sum() / max(made.sum(), 1)), 1.0)
    return fit_field(f, np.array([r["y"] for r in seen], dtype=np.int64), *sides.T, np.array([r["s"] for r in seen], dtype=float), weight)


def _flat(ids: list, rows: list[list[dict]]) -> dict:
    out: dict[str, list] = {"h": [], "i": [], "f": [], "y": [], "n": [], "s": [], "made": []}
    for h, found in zip(ids, rows, strict=True):
        for i, r in enumerate(found):
            for name, v in (("h", h), ("i", i), *r.items()):
                out[name].append(v)
    return out


def field_spans(text: str, base: list[Span], field: Field, sure: float = 0.9) -> list[Span]:
    """Spans that the field adds: runs of adjacent tokens of one label, outer punctuation left off."""
    g = _Graph(text, base)
    if not field.trained or not g.tokens or all(y > 0 for y in g.labels):
        return []
    fixed = np.array(g.labels)
    p = field.beliefs(np.array(g.features), fixed, np.array(g.chain, dtype=np.int64).reshape(-1, 2), np.array(g.skip, dtype=np.int64).reshape(-1, 2))
    label = np.where((p.max(1) >= sure) & (fixed == 0), p.argmax(1), 0)
    linked = {b for _, b in g.chain}
    out: list[Span] = []
    for i, y in enumerate(label.tolist()):
        if not y:
            continue
        a, b = g.tokens[i]
        if out and i in linked and label[i - 1] == y and out[-1][2] == _LABELS[y] and out[-1][1] <= a:
            out[-1] = (out[-1][0], b, _LABELS[y])
        else:
            out.append((a, b, _LABELS[y]))
    trimmed = []
    for a, b, kind in out:
        while b > a and not (text[b - 1].isalnum()):
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        if a < b and not any(s < b and e > a for s, e, _ in base):
            trimmed.append((a, b, kind))
    return trimmed


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of one text."""
    if not _SOME.search(text):
        return [], []
    base = base_spans(text)
    every = sorted(base + field_spans(text, base, field), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, every


def find_personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and spans: arrays of (kind, start, end) in code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"

    def scan(cols: dict) -> dict:
        both = [find_spans(t, field) for t in texts(cols[text])]
        return {id_col: cols[id_col]} | {n: [[{"kind": k, "start": a, "end": b} for a, b, k in x[i]] for x in both] for i, n in enumerate(("base", "spans"))}

    return map_batches(docs.select(id_col, text), scan, f"`{id_col}` {kind}, base {span}, spans {span}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_spans(docs: DataFrame, field: Field, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All columns, personal data in the text masked; a null text stays null. ``n_chars`` follows where it was not null."""

    def mask(cols: dict) -> dict:
        done = [None if t.as_py() is None else masked(t.as_py(), find_spans(t.as_py(), field)[1]) for t in cols[text]]
        out = dict(cols) | {text: done}
        if n_chars in cols:
            out[n_chars] = [old if new is None or old is None else len(new) for old, new in zip(cols[n_chars].to_pylist(), done, strict=True)]
        return out

    return map_batches(docs, mask, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
