"""SimHash near-duplicates: a binary trie joined with itself within a budget of differing bits.

Fingerprints of 64 bits are made from all word shingles of a text. Two fingerprints link when at
most BUDGET bits differ. The distinct fingerprints (a fingerprint's copies are one row) are dealt
out so that every link meets in some group: of BANDS bands of bits, a link leaves at least
BANDS - BUDGET untouched, so each fingerprint goes to one group for each choice of that many bands,
named by their bits. A group is a binary trie (its sorted fingerprints), joined with itself from
the root down: a pair of nodes goes on to its pairs of children, adding one to the differing bits
where they go apart, and is dropped when the sum exceeds the budget.

Links are wanted for components only, so a group gives a spanning forest of its links: budgets
of 1, 2, .. bits are tried in turn, and a pair of nodes that lies in one component already is
dropped. A crowd of near copies then costs about its size, not its square. Groups of more than
GROUP rows are split into blocks, and each pair of blocks is a group of its own.

For stages on word shingles similar() links texts by their Jaccard similarity over shingles of
STAGE_SHINGLE words instead. Such texts differ in about 10 of 64 bits at a similarity of 0.8, which no choice of whole bands
survives, so the groups are named by samples of bits: about log2 of the number of fingerprints less 3 bits
a sample, and so many samples that a pair with NEAR_BITS differing bits shares one with 95 %. The trie join
with WIDE_BUDGET bits gives the clusters of each group, and the similarity of texts decides. Only a row's nearest leaves the group as a pair;
of other pairs only the rows' clusters do, one row for each text and sample. Where the links of the nearest leave a cluster in parts, a task gets the shingles of
its rows and compares each pair within the budget whose ends no verified link has joined yet, in the first of the samples that the two share,
and gives only the links that join components. A second fingerprint, by other hashes, tells
pairs that are near by chance, whose number would grow faster than the texts'. So no pair is given up because
candidates that fail would connect it, or because others are nearer, and rows grow with the texts, not with the pairs of a cluster.

Null and empty texts have fingerprint 0 and link like any other. A text with fewer words than a
shingle has is one shingle. Repeated rows share fingerprint and component; null ids count for
nobody's component_id, which is null if all ids are. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import give_back, id_text, keep, per_text, shared_dir, small_batches, small_side, table
from frameloom.llm.components import components, least_labels

SHINGLE, BUDGET, SEED = 4, 4, 42
STAGE_SHINGLE, SIMILARITY, NEAR_BITS, WIDE_BUDGET = 5, 0.8, 10, 14
#: First bits of the bands; each choice of BANDS - BUDGET of them names a group.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
GROUP = 20_000
#: Rows joined at a time, and pairs of nodes held at a time.
ROWS, PAIRS = 30_000, 200_000
#: Rows on either side of a row that its nearest is looked for among; clusters of more rows have nearest pairs of parts compared first.
CLUSTER = 48
#: Shingles that count as a row where crowded groups are cut into blocks; pairs of fingerprints, and shingles, looked at at a time.
ROW_SHINGLES, CELLS, VALUES = 500, 1 << 21, 1 << 21
#: Bits that the second fingerprints of a candidate pair may differ in; at a similarity of 0.8 about 10 do, by chance 32.
SECOND = 19


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)], np.uint64)


def _majority(h: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number."""
    return _majority(_hashes(text, shingle))


def two_fingerprints(text: str | None, shingle: int) -> tuple[int, int]:
    """The fingerprint, and one of the same shingles by other hashes: texts that are near by chance in one are not so in the other."""
    h = _hashes(text, shingle)
    return _majority(h), _majority(_second_hash(h))


def _second_hash(h: np.ndarray) -> np.ndarray:
    other = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    other = (other ^ other >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return other ^ other >> np.uint64(32)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """docs with the fingerprint of each text as a signed long."""
    return per_text(docs, f"{out_col} long", lambda texts: [np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64).tolist()], text_col)


def trie_join(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that join what is linked within groups; rows are sorted by group, then by unsigned fp, without repeats.

    With other, a second fingerprint of each row, links need at most SECOND differing bits there too.
    """
    n = len(fp)
    label = np.arange(n)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    roots = np.stack([first, np.r_[first[1:], n]]).astype(np.int32) if n else np.empty((2, 0), np.int32)
    roots = roots[:, roots[1] - roots[0] > 1]
    for allowed in sorted({min(x, budget) for x in (1, 2, 4, 8)} | {budget}):
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, np.stack([roots[0], roots[1], roots[0], roots[1], np.zeros_like(roots[0])]))]
        ones_before: dict[int, np.ndarray] = {}
        while stack:
            bit, pairs = stack.pop()
            if pairs.shape[1] > PAIRS:
                half = pairs.shape[1] // 2
                stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
                continue
            if bit not in ones_before:
                ones_before[bit] = np.r_[0, np.cumsum(fp >> np.uint64(63 - bit) & np.uint64(1))].astype(np.int32)
            below = _children(pairs, ones_before[bit])
            below = below[:, below[4] <= allowed]
            a, a_end, b, b_end, _ = below
            one = (changes[a] == changes[a_end - 1]) & (changes[b] == changes[b_end - 1]) & (label[a] == label[b])
            below = below[:, ~one]
            a, a_end, b, b_end, _ = below
            leaf = (a_end - a == 1) & (b_end - b == 1)
            x, y = a[leaf], b[leaf]
            near = _near(fp, other, x, y, allowed)
            found.append((x[near], y[near]))
            rest = below[:, ~leaf]
            if rest.shape[1]:
                stack.append((bit + 1, rest))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int32),) * 2
        if len(x):
            old, label = label, least_labels(n, x, y, label)
            merged = np.flatnonzero(old == np.arange(n))  # earlier components' least rows, each linked to its new least row
            merged = merged[label[merged] != merged]
            kept.append((merged, label[merged]))
    return tuple(np.concatenate(z) for z in zip(*kept, strict=True)) if kept else (np.empty(0, np.int64),) * 2


def _near(fp: np.ndarray, other: np.ndarray | None, x: np.ndarray, y: np.ndarray, budget: int) -> np.ndarray:
    near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
    return near if other is None else near & (np.bitwise_count(other[x] ^ other[y]) <= SECOND)


def _children(pairs: np.ndarray, ones_before: np.ndarray) -> np.ndarray:
    """The pairs of children of pairs of nodes (from, to, from, to, bits that differ); a node is a range of rows."""
    a, a_end, b, b_end, bits = pairs
    a_mid = a_end - (ones_before[a_end] - ones_before[a])
    b_mid = b_end - (ones_before[b_end] - ones_before[b])
    same = a == b
    out = np.concatenate([
        np.stack([a, a_mid, b, b_mid, bits]),
        np.stack([a_mid, a_end, b_mid, b_end, bits]),
        np.stack([a, a_mid, b_mid, b_end, bits + 1]),
        np.stack([a_mid, a_end, b, b_mid, bits + 1])[:, ~same],
    ], axis=1)
    return out[:, (out[1] > out[0]) & (out[3] > out[2]) & ~((out[0] == out[2]) & (out[1] - out[0] == 1))]


def _join_groups(join: Callable):
    """Rows (key, fp), equal keys next to each other, to links (u, v) of fingerprints, by join(group, fp) of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f in _whole_groups(batches):
            x, y = join(k, f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(f[x]), pa.array(f[y])], names=["u", "v"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of about ROWS rows at a time, groups whole, sorted by group and unsigned fingerprint (the first two columns)."""

    def out(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        order = np.lexsort((columns[1].view(np.uint64), columns[0]))
        return tuple(c[order] for c in columns)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(c[0]) for c in held) >= ROWS:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = int(np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])[-1])  # the last group may go on
            if whole:
                give_back()
                yield out([c[:whole] for c in columns])
            held = [[c[whole:] for c in columns]]
    columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
    if columns and len(columns[0]):
        yield out(columns)


def links(fps: DataFrame, uri: str) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) that connect whatever is linked."""
    bits = [F.shiftrightunsigned(F.shiftleft("fp", 64 - at - width), 64 - width) for at, width in BANDS]
    names = [F.lit(i << 22).cast("long").bitwiseOR(F.shiftleft(bits[x], 11)).bitwiseOR(bits[y]) for i, (x, y) in enumerate(combinations(range(len(BANDS)), len(BANDS) - BUDGET))]
    return _dealt(fps.select(F.explode(F.array(*names)).alias("key"), "fp"), uri).mapInArrow(_join_groups(trie_join), "u long, v long")


def _dealt(keyed: DataFrame, uri: str, weight: F.Column | None = None, by: str = "fp") -> DataFrame:
    """Rows (key, fp) with the rows of a key next to each other; crowded keys as pairs of blocks, each pair a key of its own.

    A row counts as weight rows, if that is given. Blocks are cut by the column by.
    """
    # Crowded keys are told by every rate-th fingerprint: one with over GROUP rows has 300 in it or so, far from half of that. Both ways are
    # exact, whatever the estimate: a key is left as it is, or cut into two blocks or more, of which each two meet.
    rate = max(1, GROUP // 300)
    some = keyed.where(F.pmod(F.xxhash64(F.lit(SEED), by), F.lit(rate)) == 0) if rate > 1 else keyed
    large = some.groupBy("key").agg(((F.count("*") if weight is None else F.sum(weight)) * rate).alias("n")).where(F.col("n") > (GROUP if rate == 1 else GROUP // 2))
    large = keep(large, f"{uri}/large")
    if not large.isEmpty():
        joined = keyed.join(large, "key", "left")
        blocks = F.greatest(F.lit(2), F.ceil(F.col("n") / GROUP)).cast("int")
        own = F.pmod(F.xxhash64(by), blocks).cast("int")
        others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != own)
        split = F.transform(others, lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
        keyed = joined.select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(split)).alias("key"), *(c for c in keyed.columns if c != "key"))
    return keyed.repartition("key").sortWithinPartitions("key")


def bit_samples(n: int) -> np.ndarray:
    """Masks of the samples of bits that name groups among n fingerprints."""
    width = min(40, max(4, n.bit_length() - 3))
    count = int(np.ceil(3 / (1 - NEAR_BITS / 64) ** width))
    rng = np.random.default_rng(SEED)
    return np.array([sum(1 << int(b) for b in rng.choice(64, width, replace=False)) for _ in range(count)], np.uint64).view(np.int64)


def clusters(group: np.ndarray, fp: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by group and fp those that links within WIDE_BUDGET bits connect: the row, its cluster, its nearest row (-1: none) and the bits that differ.

    A cluster is named by its fingerprints, so one that several samples of bits give has one name. The nearest row is
    that of the CLUSTER rows before and after in the cluster.
    """
    label = least_labels(len(fp), *trie_join(group, fp, WIDE_BUDGET, other), np.arange(len(fp)))
    order = np.argsort(label, kind="stable")
    order = order[np.bincount(label, minlength=len(fp))[label[order]] > 1]
    if not len(order):
        return order, np.empty(0, np.int64), order, order
    first = np.flatnonzero(np.r_[True, label[order[1:]] != label[order[:-1]]])
    sizes = np.diff(np.r_[first, len(order)])
    left = np.repeat(first + sizes, sizes) - np.arange(len(order))
    nearest, partner = np.full(len(order), WIDE_BUDGET + 1), np.full(len(order), -1)
    for step in range(1, min(CLUSTER, int(sizes.max()) - 1) + 1):
        at = np.flatnonzero(left > step)
        x, y = order[at], order[at + step]
        bits = np.where(_near(fp, other, x, y, WIDE_BUDGET), np.bitwise_count(fp[x] ^ fp[y]).astype(np.int64), WIDE_BUDGET + 1)
        for here, there in ((at, at + step), (at + step, at)):
            closer = bits < nearest[here]
            nearest[here[closer]], partner[here[closer]] = bits[closer], order[there[closer]]
    names = np.add.reduceat(_second_hash(fp[order]), first)
    return order, np.repeat(names, sizes).view(np.int64), partner, nearest


def between(group: np.ndarray, fp: np.ndarray, other: np.ndarray, component: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest row of each of the ``most`` nearest other components within WIDE_BUDGET bits in its group, as pairs (row, other)."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    ends = np.r_[first[1:], n]
    roots = np.stack([first, ends, first, ends, np.zeros_like(first)]).astype(np.int32)[:, ends - first > 1]
    changes = np.r_[0, np.cumsum(component[1:] != component[:-1])]
    ones_before: dict[int, np.ndarray] = {}
    full, out = np.zeros(n, bool), []
    for allowed in sorted({min(x, WIDE_BUDGET) for x in (4, 8, 10, 12)} | {WIDE_BUDGET}):
        # Rows that have enough partners within fewer bits are full; nodes that hold no other rows are dropped.
        open_before = np.r_[0, np.cumsum(~full)]
        stack, found, held = [(0, roots)], [], 0
        while stack:
            bit, pairs = stack.pop()
            if pairs.shape[1] > PAIRS:
                half = pairs.shape[1] // 2
                stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
                continue
            if bit not in ones_before:
                ones_before[bit] = np.r_[0, np.cumsum(fp >> np.uint64(63 - bit) & np.uint64(1))].astype(np.int32)
            below = _children(pairs, ones_before[bit])
            a, a_end, b, b_end, bits = below
            one = (changes[a] == changes[a_end - 1]) & (changes[b] == changes[b_end - 1]) & (component[a] == component[b])
            any_open = (open_before[a_end] > open_before[a]) | (open_before[b_end] > open_before[b])
            below = below[:, (bits <= allowed) & any_open & ~one]
            a, a_end, b, b_end, _ = below
            leaf = (a_end - a == 1) & (b_end - b == 1)
            x, y = a[leaf], b[leaf]
            near = _near(fp, other, x, y, allowed)
            x, y = np.r_[x[near], y[near]], np.r_[y[near], x[near]]
            found.append((x[~full[x]], y[~full[x]]))
            held += len(found[-1][0])
            if held > 8 * PAIRS:
                found = [_nearest(found, fp, component, most)]
                held = 0
            if (~leaf).any():
                stack.append((bit + 1, below[:, ~leaf]))
        x, y = _nearest(found, fp, component, most)
        enough = np.bincount(x, minlength=n) >= most
        last = enough[x] | (allowed == WIDE_BUDGET)
        out.append((x[last], y[last]))
        full |= enough
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _nearest(found: list[tuple[np.ndarray, np.ndarray]], fp: np.ndarray, component: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    bits = np.bitwise_count(fp[x] ^ fp[y])
    order = np.lexsort((y, bits, component[y], x))
    x, y, bits = x[order], y[order], bits[order]
    keep_first = np.r_[True, (x[1:] != x[:-1]) | (component[y[1:]] != component[y[:-1]])][: len(x)]
    x, y, bits = x[keep_first], y[keep_first], bits[keep_first]
    order = np.lexsort((y, bits, x))
    x, y = x[order], y[order]
    start = np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]][: len(x)], np.arange(len(x)), 0)) if len(x) else x
    return x[np.arange(len(x)) - start < most], y[np.arange(len(x)) - start < most]


def _join_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, other) to rows of clusters: the cluster, u, the nearest v or null, and the bits between."""
    for k, f, g in _whole_groups(batches):
        row, cluster, partner, bits = clusters(k, f.view(np.uint64), g.view(np.uint64))
        alone = partner < 0
        columns = [pa.array(cluster), pa.array(f[row]), pa.array(f[partner], mask=alone), pa.array(bits.astype(np.int32), mask=alone)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "u", "v", "bits"])


def crowd_links(fp: np.ndarray, other: np.ndarray, label: np.ndarray, masks: np.ndarray, values: np.ndarray, ends: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of one cluster with a similarity of least or more that join what is joined by all such pairs within the budget.

    Row k has the sorted distinct shingles values[ends[k] : ends[k + 1]]; rows of one label are joined already. Pairs that agree in the
    bits of one of masks, those of earlier samples, meet there and are left out here.
    """
    n = len(fp)
    label = np.unique(label, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    if n < 2 or not label.any():
        return (np.empty(0, np.int64),) * 2
    size = np.diff(ends)
    _, ids, counts = np.unique(values, return_inverse=True, return_counts=True)
    # Shingles that no other row of the cluster has are counted but not kept.
    held = counts[ids] > 1
    before = np.r_[0, np.cumsum(held)]
    ids, ends = ids[held], before[ends]
    shared = np.diff(ends)
    mark = np.zeros(len(counts), bool)

    def compare(x: int, y: np.ndarray) -> None:
        """Link row x to those of rows y that are similar; few first, as a link spares the rest of a component."""
        most = 16
        mark[ids[ends[x] : ends[x + 1]]] = True
        while len(y := y[label[y] != label[x]]):
            some = y[: max(1, int(np.searchsorted(np.cumsum(shared[y[:most]]), VALUES)))]
            start = np.cumsum(shared[some]) - shared[some]
            at = np.arange(shared[some].sum()) + np.repeat(ends[some] - start, shared[some])
            both = np.diff(np.r_[0, np.cumsum(mark[ids[at]])][np.r_[start, len(at)]])
            near = some[both / (size[x] + size[some] - both) >= least]
            if len(near):
                near = near[np.unique(label[near], return_index=True)[1]]
                links.extend((x, z) for z in near.tolist())
                label[np.isin(label, label[near])] = label[x]
            y, most = y[len(some) :], 4 * most
        mark[ids[ends[x] : ends[x + 1]]] = False

    # A row's similarity to any other is at most the part of its shingles that others have.
    rows = np.flatnonzero(shared >= least * size - 1e-6)
    if len(rows) > CLUSTER:
        # Each row's nearest of another component comes first, as its link may spare all other pairs of the two.
        fps, first = np.unique(fp[rows], return_index=True)
        first = rows[first]
        for x, y in zip(*between(np.zeros(len(fps), np.int64), fps, other[first], label[first], 1), strict=True):
            compare(int(first[x]), first[[y]])
    step = max(1, CELLS // max(1, len(rows)))
    for low in range(0, len(rows), step):
        a, b = rows[low : low + step], rows[low:]
        bits = np.bitwise_count(fp[a, None] ^ fp[b])
        most = np.minimum(shared[a, None], shared[b])
        near = (bits <= WIDE_BUDGET) & (label[a, None] != label[b]) & (np.arange(len(a))[:, None] < np.arange(len(b)))
        near &= (np.bitwise_count(other[a, None] ^ other[b]) <= SECOND) & (most * (1 + least) >= least * (size[a, None] + size[b]) - 1e-6)
        x, y = np.nonzero(near)
        apart, here = fp[a[x]] ^ fp[b[y]], np.ones(len(x), bool)
        for m in masks:
            here &= apart & m != 0
        x, y = x[here], y[here]
        order = np.lexsort((bits[x, y], x))
        x, y = a[x[order]], b[y[order]]
        for part in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1) if len(x) else ():
            compare(int(x[part[0]]), y[part])
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def first_sample(fp: np.ndarray, masks: np.ndarray) -> int:
    """The first of masks in whose bits all fingerprints agree (0: in none).

    A pair meets first in the first sample that it agrees in. All of its cluster there agree in that one, and in none before.
    """
    return int(np.argmax(masks & np.bitwise_or.reduce(fp ^ fp[0]) == 0))


def _join_clusters(masks: np.ndarray, least: float):
    """Rows (key, fp, other, node, c, s), equal keys next to each other, to links (a, b) of nodes."""
    masks = masks.view(np.uint64)

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        fp, other, node, c, s = pa.Table.from_batches(held).combine_chunks().columns[1:]
        fp, other, node, c = (x.to_numpy() for x in (fp, other, node, c))
        s = s.combine_chunks()
        ends = np.r_[0, np.cumsum(pa.compute.list_value_length(s).to_numpy())].astype(np.int64)
        values = s.flatten().to_numpy()
        fp, other = fp.view(np.uint64), other.view(np.uint64)
        x, y = crowd_links(fp, other, c, masks[: first_sample(fp, masks)], values, ends, least)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != key[a]:
                    made = links(held)
                    held = []
                    if made.num_rows:
                        yield made
                held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    return run


def wide_keys(fps: DataFrame, masks: np.ndarray, uri: str) -> DataFrame:
    """Rows (fp, ..) as rows (key, fp, ..), once for each sample of bits."""
    names = F.transform(F.array(*(F.lit(int(m)) for m in masks)), lambda m: F.xxhash64(m, m.bitwiseAND(F.col("fp"))))
    return _dealt(fps.select(F.explode(names).alias("key"), "fp", *(c for c in fps.columns if c != "fp")), uri)


def _cluster_links(members: DataFrame, nodes: DataFrame, tried: DataFrame, sets: DataFrame, masks: np.ndarray, least: float, uri: str) -> DataFrame:
    """Rows of clusters (cluster, fp), nodes (node, fp, other, component or null) and shingles (node, s) to the links (a, b) that join components.

    Pairs (a, b) of tried are known: clusters of such a pair alone are left out, as are clusters of one component.
    """
    nodes = nodes.select("node", "fp", "other", F.coalesce("component", "node").alias("c"))
    rows = keep(members.join(nodes, "fp"), f"{uri}/of_clusters")
    ends = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("b"), (F.min("c") != F.max("c")).alias("mixed"))
    mixed = ends.where("mixed").select("cluster", F.when(F.col("n") == 2, F.col("low")).alias("a"), "b").join(tried, ["a", "b"], "left_anti").select("cluster")
    mixed = small_side(keep(mixed, f"{uri}/mixed"))
    columns = ["key", "fp", "other", "node", "c", "s"]
    keyed = rows.join(mixed, "cluster").join(sets, "node").withColumnRenamed("cluster", "key").select(columns)
    dealt = _dealt(keyed, f"{uri}/crowds", F.greatest(F.lit(1.0), F.size("s") / ROW_SHINGLES), "node").select(columns)
    return dealt.mapInArrow(_join_clusters(masks, least), "a long, b long").distinct()


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; 32 bits tell the shingles of two texts apart."""
    words = (text or "").encode().lower().split()
    k = min(shingle, len(words))
    return np.unique(np.array([xxhash.xxh32_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)] if words else [0], np.uint32), return_counts=True)[0]


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.asarray(x.values), np.asarray(y.values)
        both = int((np.unique(np.concatenate([x, y]), return_counts=True)[1] > 1).sum())
        out.append(both / (len(x) + len(y) - both))
    return pa.array(out, pa.float64())


def similar(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Per distinct (doc_id, words) with an id: doc_id and component_id, by links of at least that similarity."""

    def digest(texts: list[str | None]) -> list:
        words = [b" ".join((x or "").encode().lower().split()) for x in texts]
        both = np.array([two_fingerprints(x, shingle) for x in texts], np.uint64).reshape(-1, 2).view(np.int64)
        return [both[:, 0].tolist(), both[:, 1].tolist(), [xxhash.xxh64_intdigest(w) - (1 << 63) for w in words]]

    plain = id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    marked = keep(per_text(plain, "fp long, other long, words long", digest).select("doc_id", "fp", "other", "words"), f"{uri}/marked")
    # A node is one content; its number is that of the least document with it.
    nodes = keep(marked.groupBy("fp", "words").agg(F.min("doc_id").alias("least"), F.min("other").alias("other")).withColumn("node", F.xxhash64("fp", "words")), f"{uri}/nodes")
    first = keep(nodes.groupBy("fp").agg(F.min_by(F.struct("node", "other"), F.struct("least", "node")).alias("n")).select("fp", "n.node", "n.other"), f"{uri}/first")
    masks = bit_samples(first.count())
    searched = wide_keys(first.select("fp", "other"), masks, uri).mapInArrow(_join_wide, "cluster long, u long, v long, bits int")
    searched = keep(searched, f"{uri}/searched")
    end = lambda a, b: first.select(F.col("fp").alias(a), F.col("node").alias(b))
    of_fps = lambda links: links.join(end("u", "a"), "u").join(end("v", "b"), "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = nodes.select("fp", F.col("node").alias("b")).join(end("fp", "a"), "fp").where("a <> b").select("fp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Each one's nearest first; clusters are compared only where the links of these leave them in parts. Contents of one fingerprint are a cluster too.
    nearest = searched.where(F.col("v").isNotNull()).groupBy("u").agg(F.min_by("v", F.struct("bits", "v")).alias("v"))
    some = keep(of_fps(nearest).unionByName(same.select("a", "b")).distinct(), f"{uri}/nearest")
    members = searched.select("cluster", F.col("u").alias("fp")).unionByName(same.select(F.xxhash64("fp").alias("cluster"), "fp"))
    members = keep(members.distinct(), f"{uri}/members")
    near = nodes.join(members.select("fp").distinct(), "fp", "left_semi")
    asked = keep(near.select("node", "words", F.col("least").alias("doc_id")), f"{uri}/asked")

    def sets(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for want, x in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
            own = xxhash.xxh64_intdigest(b" ".join(x.encode().lower().split())) - (1 << 63) == want
            out.append(_shingle_set(x, shingle).view(np.int32) if own else None)  # another text with the same id
        return pa.array(out, pa.list_(pa.int32()))

    found = plain.join(small_side(asked), "doc_id").select("node", F.arrow_udf(sets, "array<int>").asNondeterministic()("words", "text").alias("s"))
    found = keep(found.where(F.col("s").isNotNull()).dropDuplicates(["node"]), f"{uri}/sets")

    def merged(links: DataFrame, name: str) -> DataFrame:
        return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{uri}/{name}")

    side = lambda a: found.select(F.col("node").alias(a), F.col("s").alias(f"s_{a}"))
    score = F.arrow_udf(_jaccard, "double").asNondeterministic()("s_a", "s_b")
    true = some.join(side("a"), "a").join(side("b"), "b").withColumn("score", score).where(F.col("score") >= least).select("a", "b")
    true = keep(true, f"{uri}/true")
    reach = merged(true, "by_nearest")
    new = keep(_cluster_links(members, near.join(reach, "node", "left"), some, found, masks, least, uri), f"{uri}/between")
    if not new.isEmpty():
        reach = merged(true.unionByName(new), "all")
    of = nodes.join(reach, "node", "left").select("fp", "words", "least", F.coalesce("component", "node").alias("c"))
    ids = of.groupBy("c").agg(F.min("least").alias("component_id"))
    return marked.join(of.join(ids, "c").select("fp", "words", "component_id"), ["fp", "words"]).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp and component_id, the least id that links lead to. Intermediate tables go to uri."""
    marked = keep(fingerprints(id_text(docs, id_col, text_col)).select("doc_id", "fp"), f"{uri}/fingerprints")
    distinct = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{uri}/distinct")
    reach = components(links(distinct.select("fp"), uri), uri)
    of = distinct.join(reach, distinct["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    ids = of.groupBy("c").agg(F.min("least").alias("component_id"))
    return marked.join(of.join(ids, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the least id of their group of similar texts; rows that repeat that id stay together, rows without id stay."""
    found = similar(docs, uri, id_col, text_col)
    # An id with several texts goes only if all of them go.
    gone = keep(found.groupBy("doc_id").agg(F.max("component_id").alias("c")).where(F.col("c") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")), f"{uri}/gone")
    return docs.join(small_side(gone), docs[id_col].cast("long") == gone["__gone"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), shared_dir(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
