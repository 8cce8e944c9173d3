"""N-gram Jaccard join by chosen paths: near-duplicate texts by the Jaccard similarity of their word shingles.

A run draws, for every set at every node of a random tree, about 1 / threshold of its shingles: those whose hash at the node lies
below 1 / (threshold * size). Each is a child node, so similar sets tend to follow the same paths. A node with few sets is
compared by brute force, a larger one is split by the paths of the next level, down to ``LEVELS``. A pair at the threshold meets in
a run with probability 0.63 at the first level, 0.47 at the second, 0.37 at the third, or more, whatever its sizes; runs are repeated until the chance to
miss it falls below ``1 - recall``.

Inside a node, pairs are filtered by one-permutation sketches and then verified on the whole texts' shingles. A pair that shares several
nodes is counted only in the first of them, which each node can tell from the sets' own lists of nodes, so no pair is ever
emitted: a node gives link counts by set and one edge a set to the smallest set it is linked with. Nodes beyond ``CHUNK`` sets
are compared in blocks, in separate tasks. Texts with equal shingle sets are joined as one set with a number of copies.

Words are lower-case runs of ASCII letters and digits and non-ASCII characters, so case and punctuation do not tell texts
apart; texts of fewer than n words have one shingle of all of them, texts of marks alone are one word.

Null and edge cases
* null text: empty. Empty texts have no shingles; they are copies of each other and linked to nothing else.
* null ids count as ids (smaller than all others); repeated rows are copies of each other.
* an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ODD, WordHashes, gram_hashes, map_batches, mix, plain_words, raw, sized, written

LEVELS = 3
#: Sets up to which a node is compared by brute force before the last level, and sets in a block of a large last node.
SMALL, CHUNK = 64, 512
BINS = 128
#: Pairs whose sketches agree in fewer bins are not verified: over five standard deviations below a threshold of 0.8.
SLACK = 0.2


@functools.lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes()


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` words; of all words if there are fewer, of the text if it has none."""
    words = _hashes().of(plain_words(text) or [text] * bool(text))
    return np.unique(gram_hashes(words, n if len(words) >= n else len(words))) if len(words) else np.empty(0, dtype=np.uint64)


def needed_runs(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold is missed at the last level with probability 1 - recall at most."""
    shared = 1.0  # common shingles over threshold * larger size, at least: 1 for a contained set, more for sets of nearer sizes
    meet = 1.0
    for _ in range(LEVELS):
        meet = 1 - math.exp(-shared * meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _chosen(tokens: np.ndarray, seeds: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the seed, child path) of the tokens drawn at each seed."""
    at, out = [], []
    step = max(1, 200_000 // max(len(tokens), 1))
    for i in range(0, len(seeds), step):
        h = mix(tokens[None, :] ^ seeds[i : i + step, None])
        s, t = np.nonzero(h < limit)
        at.append(s + i)
        with np.errstate(over="ignore"):
            out.append(mix(seeds[s + i] * ODD + tokens[t]))
    return (np.concatenate(at), np.concatenate(out)) if at else (np.empty(0, np.int64), np.empty(0, np.uint64))


def paths(tokens: np.ndarray, runs: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the (parent path, path) of a set, over all runs."""
    share = 1 / (threshold * max(len(tokens), 1))
    limit = np.uint64((1 << 64) - 1) if share >= 1 else np.uint64(int(share * (1 << 64)))
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD)
    out = []
    for _ in range(LEVELS):
        at, path = _chosen(tokens, seeds, limit)
        out.append((seeds[at], path))
        seeds = np.unique(path)
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """For each of ``BINS`` bins a byte of its smallest hash, 0 where it is empty."""
    out = np.zeros(BINS, dtype=np.uint8)
    if len(tokens):
        with np.errstate(over="ignore"):
            h = np.sort(mix(tokens * ODD))
        bins = (h >> np.uint64(57)).astype(np.int64)
        found, first = np.unique(bins, return_index=True)
        out[found] = (h[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ ODD).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _signatures(docs: DataFrame, id_col: str, text: str, n: int, threshold: float, runs: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    level = "array<struct<up:long,path:long>>"
    kinds = [pa.field("up", pa.int64()), pa.field("path", pa.int64())]

    def sign(cols: dict) -> dict:
        sets, sizes, sketches = [], [], []
        drawn: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LEVELS)]
        for data in raw(cols[text]):
            tokens = shingle_set(data, n)
            sets.append(set_key(tokens))
            sizes.append(len(tokens))
            sketches.append(sketch(tokens))
            for at, found in zip(drawn, paths(tokens, runs, threshold), strict=True):
                at.append(found)
        levels = {}
        for i, found in enumerate(drawn):
            ends = np.cumsum([0] + [len(path) for _, path in found]).astype(np.int32)
            up, path = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
            both = pa.StructArray.from_arrays([pa.array(up, pa.int64()), pa.array(path, pa.int64())], fields=kinds)
            levels[f"l{i + 1}"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)
        return {id_col: cols[id_col], "tie": cols["tie"], "set": sets, "size": sizes, "sketch": sketches} | levels

    rows = docs.select(id_col, F.xxhash64(text).alias("tie"), text)
    return map_batches(rows, sign, f"`{id_col}` {kind}, tie long, set binary, size int, sketch binary, " + ", ".join(f"l{i + 1} {level}" for i in range(LEVELS)))


def _final_nodes(signed: DataFrame, sets: DataFrame, id_col: str) -> DataFrame:
    """path, set and members of the nodes to be compared, each with two sets at least; copies count once.

    A set in a large node takes up its paths of the next level, which lie in the row of its representative. It is found by its own
    (id, text hash), of which no two sets share one, so a large node never meets in one task.
    """
    final, rows = None, None
    for i in range(LEVELS):
        if rows is None:
            rows = signed.select("set", F.explode("l1").alias("n")).select("set", F.col("n.path").alias("path")).distinct()
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= 2)
        nodes = written(rows.join(counts, "path"), "join-nodes")
        last = i == LEVELS - 1
        done = nodes if last else nodes.where(F.col("members") <= SMALL)
        final = done if final is None else final.unionByName(done)
        if not last:
            large = nodes.where(F.col("members") > SMALL).groupBy("set").agg(F.collect_set("path").alias("ups")).join(sets.select("set", "rep"), "set")
            large = written(large.select("ups", F.col(f"rep.{id_col}").alias("__id"), F.col("rep.tie").alias("__tie")), "join-large")
            large = sized(large, large.agg(F.sum(F.size("ups") * 8 + 40)).first()[0] or 0)
            held = signed.select(id_col, "tie", "set", f"l{i + 2}").join(large, F.col(id_col).eqNullSafe(F.col("__id")) & F.col("tie").eqNullSafe(F.col("__tie")))
            below = F.filter(f"l{i + 2}", lambda n: F.array_contains("ups", n["up"]))
            rows = held.select("set", F.explode(F.array_distinct(F.transform(below, lambda n: n["path"]))).alias("path")).distinct()
    return final


def _groups(df: DataFrame, fn, schema: str) -> DataFrame:
    """One call for each (path, a, b), rows in the order of ``set``; the groups of a partition stream by."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    key = ("path", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in key):
                    out += fn(held)
                    held = []
                if not held or row["set"] != held[-1]["set"]:  # repeated rows have one set
                    held.append(row)
                    size += 1
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if held:
            out += fn(held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return df.repartition(*key).sortWithinPartitions(*key, "set").mapInArrow(run, schema)


def _candidates(rows: list[dict], least: float) -> np.ndarray:
    """Pairs (i, j) of the group that are counted here and whose sketches are close enough, one a row."""
    path, a, b = rows[0]["path"], rows[0]["a"], rows[0]["b"]
    m = len(rows)
    s = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8).reshape(m, BINS)
    # nodes in front of this one that two sets share: their pairs are counted there
    where: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for k in r["keys"]:
            if k >= path:
                break
            where.setdefault(k, []).append(i)
    shared = [v for v in where.values() if len(v) > 1]
    earlier = np.zeros((m, len(shared)), dtype=np.float32)
    for k, v in enumerate(shared):
        earlier[v, k] = 1
    blk = np.array([r["blk"] for r in rows])
    out = []
    for i in range(m - 1):
        rest = np.arange(i + 1, m)
        if a != b:
            rest = rest[blk[rest] != blk[i]]
        if len(shared):
            rest = rest[earlier[rest] @ earlier[i] == 0]
        if len(rest):
            filled = ((s[rest] > 0) | (s[i] > 0)).sum(1)
            same = ((s[rest] == s[i]) & (s[i] > 0)).sum(1)
            rest = rest[same >= least * filled]
            out.append(np.stack([np.full(len(rest), i), rest], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _similar(tokens: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs whose Jaccard similarity reaches the threshold."""
    size = np.array([len(t) for t in tokens])
    common = np.empty(len(pairs), dtype=np.int64)
    if len(pairs) <= 4 * len(tokens):
        for k, (i, j) in enumerate(pairs):
            common[k] = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
    else:
        value, at = np.unique(np.concatenate(tokens), return_inverse=True)
        row = np.repeat(np.arange(len(tokens)), size)
        often = np.bincount(at, minlength=len(value)) > 1
        column = np.cumsum(often) - 1
        row, at = row[often[at]], column[at[often[at]]]
        total = np.zeros((len(tokens), len(tokens)), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for c in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(at, [c, c + 4096])
            part = np.zeros((len(tokens), 4096), dtype=np.float32)
            part[row[lo:hi], at[lo:hi] - c] = 1
            total += part @ part.T
        common = np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - common
    return pairs[common >= threshold * union - 1e-9]


def _linked(rows: list[dict], n: int, threshold: float) -> list[dict]:
    """Link counts and an edge to the smallest set of its part of the group, for every linked set."""
    pairs = _candidates(rows, threshold - SLACK)
    if len(pairs):
        pairs = _similar([shingle_set(r["text"] or b"", n) for r in rows], pairs, threshold)
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    copies = np.array([r["copies"] for r in rows], dtype=np.int64)
    links = np.zeros(len(rows), dtype=np.int64)
    for i, j in pairs.tolist():
        links[i] += copies[j]
        links[j] += copies[i]
        x, y = top(i), top(j)
        parent[max(x, y)] = min(x, y)
    return [{"set": rows[i]["set"], "hub": rows[top(i)]["set"], "links": int(links[i])} for i in np.nonzero(links)[0].tolist()]


def components(edges: DataFrame, node: str = "set", hub: str = "hub") -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of the edges.

    Each round takes the smallest label around every node and then the label of that label, so rounds grow with the logarithm of a
    component's length; a node with very many edges costs a combinable minimum.
    """
    one = edges.where(F.col(node) != F.col(hub)).select(F.col(node).alias("x"), F.col(hub).alias("y"))
    both = written(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        moved = label.join(near, "x").select("x", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        far = moved.select(F.col("x").alias("to"), F.col("to").alias("jump"))
        new = written(moved.join(far, "to", "left").select("x", F.least("to", F.coalesce("jump", "to")).alias("label"), "old"), "labels")
        label = new.select("x", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return label.select(F.col("x").alias(node), "label")


def _joined(docs: DataFrame, id_col: str, text: str, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their set, sets with first: smallest (id, text hash) of the group, n_links and copies)."""
    runs = needed_runs(threshold, recall)
    signed = written(_signatures(docs, id_col, text, n, threshold, runs), "signatures")
    who = F.struct(F.col(id_col), F.col("tie"))
    sets = written(signed.groupBy("set").agg(F.min(who).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")), "sets")
    nodes = _final_nodes(signed, sets, id_col)
    keys = nodes.groupBy("set").agg(F.sort_array(F.collect_list("path")).alias("keys"))
    shown = signed.select("set", "sketch").dropDuplicates(["set"])
    blocks: Column = F.ceil(F.col("members") / CHUNK).cast("int")
    row = nodes.join(keys, "set").join(shown, "set").join(sets.select("set", "rep", "copies"), "set").withColumn("blk", F.pmod(F.xxhash64("set", "path"), blocks).cast("int"))
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("a", F.least("blk", "other")).withColumn("b", F.greatest("blk", "other"))
    fields = ["path", "a", "b", "blk", "set", "keys", "sketch", "copies"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "path long, a int, b int, blk int, set binary, keys array<long>, sketch binary, copies long"
    least = threshold - SLACK

    def close(rows: list[dict]) -> list[dict]:
        if len(rows) < 2:
            return []
        return [rows[i] for i in np.unique(_candidates(rows, least)).tolist()]

    rep = f"rep struct<`{id_col}`:{kind},tie:bigint>"
    found = written(_groups(row.select(*fields, "rep"), close, f"{schema}, {rep}"), "join-candidates")
    said = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__tie"), F.col(text).cast("binary").alias("text"))
    # only texts of candidates are shuffled, as long as a list of these may be broadcast
    reps = written(found.select(F.col(f"rep.{id_col}").alias("__i"), F.col("rep.tie").alias("__t")).distinct(), "candidate-texts")
    if (count := reps.count()) * 40 <= BROADCAST_BYTES:
        said = said.join(sized(reps, count * 40), F.col("__id").eqNullSafe(F.col("__i")) & F.col("__tie").eqNullSafe(F.col("__t")), "left_semi")
    full = found.hint("shuffle_merge").join(said, F.col(f"rep.{id_col}").eqNullSafe(F.col("__id")) & F.col("rep.tie").eqNullSafe(F.col("__tie"))).select(*fields, "text")
    linked = written(_groups(full, lambda rows: _linked(rows, n, threshold) if len(rows) > 1 else [], "set binary, hub binary, links long"), "links")
    label = components(linked)
    of = sets.join(label, "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = of.groupBy("label").agg(F.min("rep").alias("first"))
    links = linked.groupBy("set").agg(F.sum("links").alias("links"))
    known = of.join(smallest, "label").join(links, "set", "left").select(
        "set", "first", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "copies"
    )
    return signed, known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """id, class_id (smallest id of its group of linked texts), n_links (other rows within the threshold, copies too), copies."""
    signed, known = _joined(docs, id_col, text, n, threshold, recall)
    return signed.select(id_col, "set").join(known, "set").select(id_col, F.col(f"first.{id_col}").alias("class_id"), "n_links", "copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """rep_id and rep_tie (xxhash64 of the text) of one row of each group of linked texts: the smallest (id, text hash)."""
    _, known = _joined(docs, id_col, text, n, threshold, recall)
    return known.where(F.col("rep").eqNullSafe(F.col("first"))).select(F.col(f"rep.{id_col}").alias("rep_id"), F.col("rep.tie").alias("rep_tie"))
