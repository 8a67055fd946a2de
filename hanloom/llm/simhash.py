"""SimHash fingerprints and their near-duplicate groups, found with pivot distance tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, chunks, free_name, map_arrow, slices, spread, squeeze, text_or_empty, trim
from .components import connected_components
from .hashing import mix, padded, xxh64_spans

WORDS, MAX_BITS = 3, 2
#: Reference fingerprints of the distance table, besides zero.
REFERENCES = 16
#: The 64 one-bit references are taken in this many groups; two fingerprints at MAX_BITS or less agree on all but MAX_BITS groups.
GROUPS = 4
#: A cell of more fingerprints is cut by further references, in groups of FINE. (Runs of words that more nodes share are dense as well.)
DENSE, FINE = 32, 4
#: One of so many texts tells common runs of words, if at least so many of those have them; the most common ones, up to so many.
SAMPLE, COMMON, COMMON_MOST = 8, 4, 1 << 20
#: Characters of text for each bucket of hashes; pairs of a key that are verified together.
BUCKET, GROUP = 8 << 20, 64
#: Differing bits of fingerprints that make candidates for a likeness; one-bit references of so many groups are equal in a cell, and fingerprints of
#: a bucket of cells.
RADIUS, EQUAL, CELLS = 8, 3, 1 << 20
#: Nodes, and hashes of their sets, of a block that is compared with other blocks.
BLOCK, BLOCK_HASHES = 128, 1 << 17
#: Classes of size from a size to the least one that can be as alike.
CLASSES = 4

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _shingles(texts: list[bytes], words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words, and the text of each; words stand lower-cased, with one space between."""
    buf = padded(b" ".join(texts) + b" ")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc_start = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.flatnonzero(buf[: len(doc)] == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    full = ends > starts  # not so where a text has no word
    starts, ends = starts[full], ends[full]
    owner = doc[starts]
    n = np.bincount(owner, minlength=len(texts))
    last = (np.cumsum(n) - 1)[owner]  # of the same text
    at = np.arange(len(starts))
    first = at == (np.cumsum(n) - n)[owner]
    keep = (at + words - 1 <= last) | (first & (n[owner] < words))
    at = at[keep]
    stop = ends[np.minimum(at + words - 1, last[keep])]
    return xxh64_spans(buf, starts[at], stop - starts[at], seed), owner[at]


def _majority(h: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The fingerprint of each of so many texts, from the hashes of their runs."""
    many = np.bincount(owner, minlength=texts)
    ones = np.empty((texts, 64), np.int64)
    for k, lane in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        ones[:, 8 * k : 8 * k + 8] = np.bincount(owner * 256 + lane, minlength=256 * texts).reshape(-1, 256) @ _BITS
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_texts(texts: list[str], words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints; lower-cases A-Z, splits at the white space of ASCII."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in chunks(texts):
        out[a:b] = _majority(*_shingles([b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts[a:b]], words, seed), b - a)
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long. A null text counts as empty, fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprint_texts(b.column(1).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).transform(map_arrow, run, "doc_id long, fp long")


def references(n: int = REFERENCES) -> list[int]:
    """Reference fingerprints spread over the space by a rule: signed longs."""
    rng = np.random.Generator(np.random.PCG64(64))
    return [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distances(fp: Column) -> Column:
    """Hamming distances to zero and to the references."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("tinyint") for r in (0, *references())])


def _masks(max_bits: int) -> list[tuple[int, list[int]]]:
    """For each choice of all but ``max_bits`` groups of the one-bit references, the mask of their bits; and for each choice of all but
    ``max_bits`` of the rest's smaller groups, the mask of those and the first ones together."""
    def of(groups: tuple[int, ...], size: int) -> int:
        return sum(((1 << size) - 1) << (size * g) for g in groups)

    size, out = 64 // GROUPS, []
    for chosen in combinations(range(GROUPS), GROUPS - max_bits):
        mask = of(chosen, size)
        rest = [g for g in range(64 // FINE) if not mask >> (FINE * g) & 1]
        out.append((mask, [mask | of(fine, FINE) for fine in combinations(rest, len(rest) - max_bits)]))
    return out


def _cell(fp: Column, tag: int, mask: int) -> Column:
    return F.xxhash64(F.lit(tag), fp.bitwiseAND(F.lit(_signed(mask))))


def near_edges(spark: SparkSession, nodes: DataFrame, ws: Workspace, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b): all pairs of ``nodes`` (node, fp; fp differs) at ``max_bits`` or less.

    Distances of every fingerprint to zero and to REFERENCES references are laid down in a table. Those to the 64 one-bit references are
    the one to zero and 1 or -1 by the bit, and so are the fingerprint itself. The references cut the space into cells: fingerprints
    within ``max_bits`` have equal distances to all one-bit references of GROUPS - max_bits groups at least, and a cell for each such
    choice. A cell of more than ``dense`` fingerprints is cut by further references: of the rest's groups of FINE, too, all but
    ``max_bits`` are equal, which leaves cells of 1 << (FINE * max_bits) fingerprints at most, whatever the data. In a cell, pairs whose
    distances to any reference differ by more than ``max_bits`` are discarded (triangle inequality), and the rest are verified.
    """
    if not 0 < max_bits <= 2:
        raise ValueError("max_bits must be 1 or 2")
    table = ws.save(nodes.select("node", "fp", _distances(F.col("fp")).alias("dist")), "pivot-distances")
    masks = _masks(max_bits)
    coarse = F.array(*[F.struct(F.lit(t).alias("tag"), _cell(F.col("fp"), t, m).alias("cell")) for t, (m, _) in enumerate(masks)])
    put = table.select("node", "fp", "dist", F.explode(coarse).alias("c")).select("node", "fp", "dist", "c.*")
    sizes = ws.save(put.groupBy("cell").count().where("count > 1"), "cell-sizes")
    shared = ws.save(put.join(sizes, "cell"), "shared-cells")
    fine = F.array()
    for t, (_, finer) in enumerate(masks):
        fine = F.when(F.col("tag") == t, F.array(*[_cell(F.col("fp"), 1_000 * (t + 1) + j, m) for j, m in enumerate(finer)])).otherwise(fine.cast("array<bigint>"))
    cut = shared.where(F.col("count") > dense).select("node", "fp", "dist", F.explode(fine).alias("cell"))
    again = ws.save(cut.groupBy("cell").count().where("count > 1"), "fine-sizes")
    cells = ws.save(shared.where(F.col("count") <= dense).select("node", "fp", "dist", "cell").union(cut.join(again, "cell").select("node", "fp", "dist", "cell")), "cells")
    other = cells.select(*[F.col(c).alias(f"{c}_2") for c in ("node", "fp", "dist")], "cell")
    apart = F.array_max(F.zip_with("dist", "dist_2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    pairs = cells.join(other, "cell").where(F.col("node_2") < F.col("node")).where(apart <= max_bits).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_2"))) <= max_bits)
    return pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def _cuts(max_bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of max_bits + EQUAL groups of the one-bit references, and every choice of EQUAL of them."""
    at = np.linspace(0, 64, max_bits + EQUAL + 1).astype(int).tolist()
    return [(1 << b) - (1 << a) for a, b in zip(at[:-1], at[1:], strict=True)], list(combinations(range(max_bits + EQUAL), EQUAL))


def _table_of(fps: np.ndarray) -> np.ndarray:
    """Distances to zero and to the references, a row per fingerprint."""
    out = np.empty((len(fps), REFERENCES + 1), np.int8)
    for k, r in enumerate((0, *references())):
        out[:, k] = np.bitwise_count(fps ^ np.uint64(r & 0xFFFFFFFFFFFFFFFF))
    return out


def _cell_links(fps: np.ndarray, masks: list[int], chosen: tuple[int, ...], max_bits: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at ``max_bits`` or less that share a cell of the chosen groups, and none of an earlier choice; in a cell of more than ``dense``
    fingerprints only as many as link the same ones."""
    cell = fps & np.uint64(sum(masks[g] for g in chosen))
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(start, len(cell)))
    x = fps[order[np.repeat(size, size) > 1]]
    size = size[size > 1]
    table, end = _table_of(x), np.repeat(np.cumsum(size), size)
    earlier = [np.uint64(masks[g]) for g in range(chosen[-1]) if g not in chosen]

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of places: the largest difference of distances discards, the rest are verified."""
        on = np.flatnonzero(np.abs(table[a] - table[b]).max(axis=1, initial=0) <= max_bits)
        apart = x[a[on] if a.shape else a] ^ x[b[on]]
        keep = np.bitwise_count(apart) <= max_bits
        for m in earlier:
            keep &= apart & m != 0
        return on[keep]

    left, right = [], []
    at, step = np.flatnonzero(np.repeat(size, size) <= dense), 0
    while len(at):
        step += 1
        at = at[at + step < end[at]]
        for some in np.array_split(at, len(at) // (1 << 18) + 1):
            on = some[linked(some, some + step)]
            left.append(on)
            right.append(on + step)
    for stop, n in zip(np.cumsum(size)[size > dense].tolist(), size[size > dense].tolist(), strict=True):
        rest = np.arange(stop - n, stop)
        while len(rest):
            found, rest = [rest[0]], rest[1:]
            while found and len(rest):
                u = np.array(found.pop())
                on = linked(u, rest)
                left.append(np.full(len(on), u))
                right.append(rest[on])
                found += rest[on].tolist()
                rest = np.delete(rest, on)
    a, b = (x[np.concatenate([*p, np.zeros(0, np.int64)]).astype(np.int64)] for p in (left, right))
    return a, b


def near_links(nodes: DataFrame, max_bits: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Pairs (fp, fp_2) of different fingerprints of ``nodes`` (fp) at ``max_bits`` or less, such that their components are those of all such pairs.

    As ``near_edges``, for larger distances: two fingerprints have equal distances to all one-bit references of EQUAL of max_bits + EQUAL
    groups at least. Each choice of groups cuts the space into cells, and buckets of whole cells go to workers. There the distances to
    zero and to the references are laid down; pairs of a cell whose distances to any differ by more than ``max_bits`` are discarded
    (triangle inequality), and the rest are verified. A pair is given by the first choice that it shares. Cells of up to ``dense``
    fingerprints give all their pairs, larger ones as many as link the same fingerprints.
    """
    masks, choices = _cuts(max_bits)
    fps = nodes.select("fp").distinct()
    parts = int(max(1, fps.count() // CELLS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            buckets, blobs = [], []
            for t, chosen in enumerate(choices if len(x) else []):
                to = ((mix(x & np.uint64(sum(masks[g] for g in chosen)), t) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                for p in np.unique(to).tolist():
                    buckets.append(t * parts + p)
                    blobs.append(x[to == p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "fps"])

    def link(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(f, np.uint64) for f in rows["fps"].to_pylist()])
        a, b = _cell_links(x, masks, choices[key[0].as_py() // parts], max_bits, dense)
        return pa.table([a.view(np.int64), b.view(np.int64)], ["fp", "fp_2"])

    return fps.transform(map_arrow, deal, "bucket long, fps binary").groupBy("bucket").applyInArrow(link, "fp long, fp_2 long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id): a row per row of ``docs``; the component is the smallest doc_id reachable over links of
    fingerprints at ``max_bits`` or fewer differing bits.

    Null texts count as empty: fingerprint zero, linked like any other. A null doc_id takes the component of its fingerprint, null
    if no other row gives one. Repeated rows stay; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    prints = ws.save(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    found = connected_components(spark, near_edges(spark, nodes, ws, max_bits), ws)
    groups = ws.save(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "groups")
    ws.remove("nodes", "pivot-distances", "cell-sizes", "shared-cells", "fine-sizes", "cells")
    return prints.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def _sets(texts: list[str], words: int, prints: bool, seed: int = 42) -> tuple[list[np.ndarray], list[int]]:
    out: list[np.ndarray] = []
    fps: list[int] = []
    for a, b in chunks(texts):
        h, owner = _shingles([b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts[a:b]], words, seed)
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        out += [np.unique(h[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        fps += _majority(h, owner, b - a).tolist() if prints else []
    return out, fps


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted different hashes of each text's runs of ``words`` words, of all its words where there are fewer."""
    return _sets(texts, words, False)[0]


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _among(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the runs that one of SAMPLE texts has most often. They only decide an order, so the sample has no part in results."""
    every = SAMPLE if texts.count() > 1_000 * SAMPLE else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, n = np.unique(np.concatenate([*shingle_sets(b.column(0).to_pylist(), words), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0)
    counts = some.select("text").transform(map_arrow, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


_HEADS = "slice long, bucket int, ids array<long>, of binary, digests binary, n binary, fps binary, h binary, node binary, pos binary"


def _heads(texts: DataFrame, words: int, like: float, buckets: int, common: object) -> DataFrame:
    """Rows of slices of ``texts`` (doc_id, text). One a slice holds its ids, the number of each one's set among the slice's different sets, and the
    digests, sizes and fingerprints of those; others, by bucket, hold the first hashes of the sets, n - ceil(like * n) + 1 of n, common ones last, with their
    places."""
    names = [f.split()[0] for f in _HEADS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8 << 20):
            trim()
            known: dict[bytes, int] = {}
            of, sizes, prints, heads = [], [], [], []
            for h, fp in zip(*_sets(b.column(1).to_pylist(), words, True), strict=True):
                d = _digest(h)
                if d not in known:
                    known[d] = len(known)
                    sizes.append(len(h))
                    prints.append(fp)
                    late = _among(common.value, h)
                    heads.append(np.concatenate([h[~late], h[late]])[: len(h) - int(np.ceil(like * len(h) - 1e-9)) + 1])
                of.append(known[d])
            slice_ = uuid.uuid4().int >> 65
            rows = [(slice_, None, b.column(0).to_pylist(), np.array(of, "<i4").tobytes(), b"".join(known), np.array(sizes, "<i4").tobytes(), np.array(prints, "<u8").tobytes(), None, None, None)]
            pos = np.concatenate([*map(np.arange, map(len, heads)), np.zeros(0, np.int64)])
            h, node = np.concatenate([*heads, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(heads), dtype="<i4"), list(map(len, heads)))
            to = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                rows.append((slice_, int(to[at[0]]), None, None, None, None, None, h[at].tobytes(), squeeze(node[at]), squeeze(pos[at])))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return texts.transform(map_arrow, run, _HEADS)


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """(h, slice, node, pos) of the hashes of a bucket that stand more than once."""
    trim()
    h = [np.frombuffer(x, np.int64) for x in rows["h"].to_pylist()]
    slice_ = np.repeat(rows["slice"].to_numpy(), list(map(len, h)))
    h, node, pos = np.concatenate(h), *(np.concatenate([spread(x) for x in rows[c].to_pylist()]) for c in ("node", "pos"))
    _, place, many = np.unique(h, return_inverse=True, return_counts=True)
    keep = many[place] > 1
    return pa.table([h[keep], slice_[keep], node[keep].astype(np.int32), pos[keep].astype(np.int32)], ["h", "slice", "node", "pos"])


def _prints(heads: DataFrame) -> DataFrame:
    """(doc_id, slice, node, digest, n, fp), a row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slice_, ids, of, digests, n, fps in zip(*(b.column(k) for k in range(6)), strict=True):
                of, d, size, fp = np.frombuffer(of.as_py(), "<i4"), digests.as_py(), np.frombuffer(n.as_py(), "<i4"), np.frombuffer(fps.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.full(len(of), slice_.as_py())), pa.array(of), pa.array([d[16 * k : 16 * k + 16] for k in of.tolist()], pa.binary()), pa.array(size[of].astype(np.int64)), pa.array(fp[of])], ["doc_id", "slice", "node", "digest", "n", "fp"])

    return heads.where("bucket is null").select("slice", "ids", "of", "digests", "n", "fps").transform(map_arrow, run, "doc_id long, slice long, node int, digest binary, n long, fp long")


def _alike_in_size(like: float) -> Column:
    return F.least("n", "n_2") >= F.lit(like) * F.greatest("n", "n_2") - 1e-9


def _both(n: Column, n_2: Column, like: float) -> Column:
    """How many hashes two sets as alike share at least."""
    return F.ceil((n + n_2) * F.lit(like / (1 + like)) - 1e-9)


def _enough(shared: Column, like: float) -> Column:
    """If texts that share so many of their first hashes can be as alike: of those they share all but ceil(like * n) - 1 are among the first of
    the one whose first hashes end earlier, and then among the other's."""
    return shared >= _both(F.col("n"), F.col("n_2"), like) + 1 - F.ceil(F.greatest("n", "n_2") * F.lit(like) - 1e-9)


def _early(like: float) -> Column:
    """If a hash at these places can be the first that the two share: enough must be left behind it in both."""
    return F.least(F.col("n") - F.col("pos"), F.col("n_2") - F.col("pos_2")) >= _both(F.col("n"), F.col("n_2"), like)


def _wanted(keys: DataFrame, texts: DataFrame, nodes: DataFrame, ws: Workspace, words: int, name: str) -> DataFrame:
    """(key, hashes): the whole sets of ``keys``; a key may come twice, and other sets of the same documents with it."""
    reps = ws.save(keys.distinct().join(nodes.select("key", "doc"), "key"), f"{name}-wanted")
    found = texts.join(reps.select("doc").distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left_semi").select("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            trim()
            sets = shingle_sets(b.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array([_key(_digest(h)) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["key", "hashes"])

    return ws.save(found.transform(map_arrow, whole, "key long, hashes binary"), f"{name}-sets")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, ws: Workspace, words: int, name: str) -> DataFrame:
    """(key, key_2, apart) of ``pairs`` (key, key_2): the Jaccard distance of their whole sets. The sets of pairs with one key meet in groups of about
    GROUP; a key with more pairs has more groups, and its set goes to each."""
    sets = _wanted(pairs.select("key").union(pairs.select("key_2")), texts, nodes, ws, words, name)
    groups = ws.save(pairs.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), f"{name}-groups")
    members = pairs.join(groups, "key").select("key", F.pmod(F.xxhash64("key_2"), F.col("groups")).cast("int").alias("part"), F.col("key_2").alias("of"))
    firsts = groups.select("key", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("key").alias("of"))
    sent = ws.save(members.union(firsts).select(F.col("key").alias("first"), "part", "of"), f"{name}-sent")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        first = key[0].as_py()
        sets = {k: np.frombuffer(h, np.uint64) for k, h in zip(rows["of"].to_pylist(), rows["hashes"].to_pylist(), strict=True)}
        of, apart = [], []
        for k, y in sets.items():
            x = sets.get(first)
            if x is not None and k != first:
                both = int(_among(x, y).sum())
                of.append(k)
                apart.append(1 - both / (len(x) + len(y) - both))
        return pa.table([pa.array([first] * len(of), pa.int64()), pa.array(of, pa.int64()), pa.array(apart, pa.float64())], ["key", "key_2", "apart"])

    # Merged whatever the sizes, so that the plan is the same at any scale.
    met = sent.join(sets.hint("merge"), F.col("of") == F.col("key")).select("first", "part", "of", "hashes")
    out = ws.save(met.groupBy("first", "part").applyInArrow(compare, "key long, key_2 long, apart double"), f"{name}-links")
    ws.remove(*(f"{name}-{old}" for old in ("sets", "sent", "groups", "wanted")))
    return out


def _across(families: DataFrame, texts: DataFrame, nodes: DataFrame, ws: Workspace, words: int, like: float) -> DataFrame:
    """(key, key_2) of all nodes as alike, of one of ``families`` (family, key, n, component_id, out) and of different components, one of them ``out``.
    Nodes are dealt to blocks; blocks of those that are out meet all blocks, so a set is sent once for a block and not for a node."""
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int")
    blocks = ws.save(families.groupBy("family").agg(many.alias("blocks")), "family-blocks")
    of = families.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("key", "family"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = of.where("out").withColumn("other", every).select("family", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"), "component_id", F.col("key").alias("of"))
    met = ws.save(first.select("family", "i", "j").distinct(), "family-meetings")
    second = of.join(met.withColumnRenamed("j", "own"), ["family", "own"]).select("family", "i", F.col("own").alias("j"), F.lit(False).alias("first"), "component_id", F.col("key").alias("of"))
    sent = ws.save(first.union(second), "family-sent")
    sets = _wanted(families.select("key"), texts, nodes, ws, words, "family")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        sides: list[dict] = [{}, {}]
        for first, component, k, h in zip(*(rows[c].to_pylist() for c in ("first", "component_id", "of", "hashes")), strict=True):
            sides[not first][k] = (component, np.frombuffer(h, np.uint64))
        if not all(sides):
            return pa.table([pa.array([], pa.int64())] * 2, ["key", "key_2"])
        names, groups = (np.array(x) for x in zip(*((k, c) for k, (c, _) in sides[0].items()), strict=True))
        sizes = np.array([len(h) for _, h in sides[0].values()])
        hashes, owner = np.concatenate([h for _, h in sides[0].values()]), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        a, b = [], []
        for k, (component, h) in sides[1].items():
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            both = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
            on = np.flatnonzero((both >= (like - 1e-9) * (sizes + len(h) - both)) & (groups != component))
            a += np.minimum(names[on], k).tolist()
            b += np.maximum(names[on], k).tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "key_2"])

    # Merged whatever the sizes, so that the plan is the same at any scale.
    out = sent.join(sets.hint("merge"), F.col("of") == F.col("key")).select("family", "i", "j", "first", "component_id", "of", "hashes")
    out = ws.save(out.groupBy("family", "i", "j").applyInArrow(compare, "key long, key_2 long").distinct(), "family-links")
    ws.remove("family-sets", "family-sent", "family-meetings", "family-blocks", "family-wanted")
    return out


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, like: float = 0.8, dense: int = DENSE) -> DataFrame:
    """(doc_id, component_id): a row per row of ``docs``; the component is the smallest doc_id reachable over links of texts whose sets of
    runs of ``words`` words have a Jaccard likeness of ``like`` or more.

    Equal sets are one node, with the SimHash fingerprint of ``words`` words. Fingerprints at RADIUS bits or less, found with pivot distance
    tables (``near_links``), are candidates; whole sets are compared, and nodes as alike are linked. No radius is exact for a likeness:
    texts of likeness 0.8 differ by about ten bits, give or take some. So what this leaves in different components is completed:

    Under one order of all runs, the first n - ceil(like * n) + 1 of two sets as alike share one, early enough in both (``_early``), and
    as many more as their sizes tell (``_enough``). Common runs come last in the order. Runs that up to ``dense`` nodes have among
    their first give all their pairs, whose shared runs are counted; of the pairs with enough, whole sets are compared. Nodes of other
    runs are parted by sizes and places first. Of a part that is still dense, each node is compared with one in its middle. Parts with
    one middle are a family; where a family is left in more than one component, nodes outside its largest are compared with all of the
    others, in blocks (``_across``). Pairs of one component are nowhere compared.
    Null texts count as empty and link to each other only; a null doc_id takes the component of its text, null if no other row gives
    one. Rows that repeat a doc_id are linked. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "similar")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    common = spark.sparkContext.broadcast(_common(texts, words))
    buckets = int(max(1, (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET))
    heads = ws.save(_heads(texts, words, like, buckets, common), "heads")
    prints = ws.save(_prints(heads), "prints")
    met = ws.save(heads.where("bucket is not null").select("bucket", "slice", "h", "node", "pos").groupBy("bucket").applyInArrow(_shared, "h long, slice long, node int, pos int"), "met")
    ws.remove("heads")
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    nodes = ws.save(prints.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.min("fp").alias("fp")).where("doc is not null").withColumn("key", key), "nodes")
    numbers = ws.save(prints.select("slice", "node", "digest").distinct().join(nodes, "digest").select("slice", "node", "key", "n"), "numbers")
    near = F.col("apart") <= 1 - like + 1e-9
    ends = nodes.select("key", F.col("doc").alias("a")), nodes.select(F.col("key").alias("key_2"), F.col("doc").alias("b"))

    def components(links: DataFrame, name: str) -> DataFrame:
        found = connected_components(spark, links.join(ends[0], "key").join(ends[1], "key_2").select("a", "b"), ws, name)
        return ws.save(nodes.join(found, nodes["doc"] == found["node"], "left").select("digest", "key", F.coalesce("component", "doc").alias("component_id")), f"{name}-of")

    # A fingerprint's least node stands for it; the others that have it are candidates with that one.
    printed = nodes.where("n > 0").select("fp", "key")
    least = ws.save(printed.groupBy("fp").agg(F.min("key").alias("key")), "fingerprints")
    close = ws.save(near_links(least), "near-links")
    least_2 = least.select(F.col("fp").alias("fp_2"), F.col("key").alias("key_2"))
    close = close.join(least.hint("merge"), "fp").join(least_2.hint("merge"), "fp_2").select("key", "key_2")
    same = printed.join(least_2.hint("merge"), F.col("fp") == F.col("fp_2")).where("key <> key_2").select(F.col("key_2").alias("key"), F.col("key").alias("key_2"))
    links = _verified(ws.save(close.union(same), "close"), texts, nodes, ws, words, "close").where(near).select("key", "key_2")
    groups = components(links, "close").select("key", "component_id")
    apart = groups.hint("merge"), groups.select(F.col("key").alias("key_2"), F.col("component_id").alias("component_2")).hint("merge")

    rows = ws.save(met.join(numbers.hint("merge"), ["slice", "node"]).select("h", "key", "n", "pos").distinct(), "rows")
    sizes = ws.save(rows.groupBy("h").count().where("count > 1"), "sizes")
    rows = ws.save(rows.join(sizes.hint("merge"), "h"), "members")
    ws.remove("met", "numbers", "rows", "sizes")

    few, many = rows.where(F.col("count") <= dense).drop("count"), ws.save(rows.where(F.col("count") > dense).drop("count"), "dense")
    twin = [F.col(c).alias(f"{c}_2") for c in ("key", "n", "pos")]
    met = few.join(few.select("h", *twin).hint("merge"), "h").where((F.col("key") < F.col("key_2")) & _alike_in_size(like))
    counted = met.groupBy("key", "key_2", "n", "n_2").agg(F.count("*").alias("shared"), F.bool_or(_early(like)).alias("early")).where("early")
    # Dense runs that they share are not counted, so all that both have may be.
    more = ws.save(many.groupBy("key").agg(F.count("*").alias("more")), "dense-counts")
    more_2 = more.select(F.col("key").alias("key_2"), F.col("more").alias("more_2"))
    bound = F.col("shared") + F.least(F.coalesce("more", F.lit(0)), F.coalesce("more_2", F.lit(0)))
    pairs = counted.join(more.hint("merge"), "key", "left").join(more_2.hint("merge"), "key_2", "left").where(_enough(bound, like)).select("key", "key_2")

    # A dense run's nodes are parted by classes of size, theirs and that of the other node; a node is in a part only if the run stands early
    # enough in it for the least sizes of the other class. Parts that are still dense meet in their middle: the node with the most dense runs.
    step = -float(np.log(like)) / CLASSES
    level = F.floor(F.log("n") / step + 1e-9)
    least = F.greatest(F.ceil(F.exp(F.col("other") * F.lit(step)) - 1e-6), F.ceil(F.lit(like) * F.col("n") - 1e-9))
    parted = many.withColumn("class", level).withColumn("other", F.explode(F.transform(F.sequence(F.lit(-CLASSES - 1), F.lit(CLASSES + 1)), lambda d: F.col("class") + d)))
    parted = parted.where((F.col("n") - F.col("pos") >= _both(F.col("n"), least, like)))
    parted = parted.select("h", F.least("class", "other").alias("low"), F.greatest("class", "other").alias("high"), "class", "key", "n", "pos")
    parts = parted.groupBy("h", "low", "high").agg(F.count("*").alias("count"), (F.min("class") < F.max("class")).alias("two"))
    parts = ws.save(parts.where((F.col("count") > 1) & (F.col("two") | (F.col("low") == F.col("high")))).drop("two"), "part-sizes")
    parted = ws.save(parted.join(parts.hint("merge"), ["h", "low", "high"]).join(more.hint("merge"), "key"), "parted")
    at, others = ["h", "low", "high"], (F.col("low") == F.col("high")) | (F.col("class") != F.col("class_2"))
    twin.append(F.col("class").alias("class_2"))
    few = parted.where(F.col("count") <= dense)
    met = few.join(few.select(*at, *twin).hint("merge"), at).where((F.col("key") < F.col("key_2")) & others & _alike_in_size(like) & _early(like)).select("key", "key_2")
    many = ws.save(parted.where(F.col("count") > dense), "dense-parts")
    middle = ws.save(many.groupBy(*at).agg(F.max(F.struct("more", "key", "n", "pos")).alias("m")).select(*at, F.col("m.key").alias("key_2"), F.col("m.n").alias("n_2"), F.col("m.pos").alias("pos_2")), "middles")
    stars = many.join(middle.hint("merge"), at).where((F.col("key") != F.col("key_2")) & _alike_in_size(like)).select(F.least("key", "key_2").alias("key"), F.greatest("key", "key_2").alias("key_2"))
    pairs = pairs.union(met).union(stars).distinct().join(apart[0], "key").join(apart[1], "key_2").where("component_id <> component_2").select("key", "key_2")
    links = links.union(_verified(ws.save(pairs, "pairs"), texts, nodes, ws, words, "first").where(near).select("key", "key_2"))
    groups = components(links, "near")
    family = many.join(middle.select(*at, F.col("key_2").alias("family")).hint("merge"), at).select("family", "key", "n").distinct()
    placed = ws.save(family.join(groups.select("key", "component_id").hint("merge"), "key"), "families")
    largest = placed.groupBy("family", "component_id").count().groupBy("family").agg(F.max_by("component_id", F.struct("count", "component_id")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    left = placed.join(ws.save(largest.select("family", "largest"), "family-largest").hint("merge"), "family")
    left = ws.save(left.withColumn("out", F.col("component_id") != F.col("largest")).drop("largest"), "families-left")
    if left.limit(1).count():
        again = _across(left, texts, nodes, ws, words, like)
        if again.limit(1).count():
            groups = components(links.union(again), "all")
    ws.remove("members", "dense", "dense-counts", "part-sizes", "parted", "dense-parts", "middles", "families", "family-largest", "families-left", "pairs", "near-links", "close", "fingerprints", "first-links", "close-links", "family-links")
    return prints.select("doc_id", "digest").join(groups.select("digest", "component_id"), "digest", "left").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, like: float | None = None) -> DataFrame:
    """The rows of ``docs`` without those that have a near-duplicate of smaller doc_id in their group: by fingerprints, or by the likeness
    ``like`` of their runs of words. Rows that repeat a doc_id, and rows without one, stand or go together."""
    groups = near_duplicates(docs, id_col, text_col, words=words) if like is None else similar(docs, id_col, text_col, words, like)
    name = free_name("gone", docs.columns)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    # Merged whatever the sizes, so that the plan is the same at any scale.
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col(name), "left_anti")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
