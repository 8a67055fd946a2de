"""Cross-entropy difference: a target and a background bigram model with one vocabulary score each document."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, map_arrow, shuffles_removed, spread, squeeze, trim, worker_state
from .hashing import mix

#: Characters of text for each bucket of the tables, and bytes of text of a slice.
BUCKET, SLICE = 8 << 20, 10 << 20
DISCOUNT = 0.75
#: The pairs of a context that has more than a bucket's share of all words, or this share, are dealt to several buckets by the second word.
COMMON = 1e-5
_START = np.uint64(2)
_KEPT = 1 << 16
#: Pairs whose logarithms are taken together.
_BLOCK = 1 << 17
_WORDS = re.compile(r"[^\W_]+")
_WORD, _PAIR, _CONTEXT, _SUM = range(4)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > _KEPT:
            self.clear()
        self[word] = h
        return h


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts; how many each text has."""
    get = worker_state().setdefault("lm-words", _Hashes()).__getitem__
    found = [np.fromiter(map(get, _WORDS.findall(t.lower())), np.uint64) for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.concatenate([*found, np.zeros(0, np.uint64)]), n


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and the end of the last."""
    start = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)
    return start, np.append(start, len(sorted_))[1:]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, the place of each value among them, how many there are; as ``np.unique``, in less memory."""
    order = np.argsort(x, kind="stable")
    start, end = _runs(sorted_ := x[order])
    keys = sorted_[start]
    del sorted_
    place = np.empty(len(x), np.int32)
    place[order] = np.repeat(np.arange(len(keys), dtype=np.int32), end - start)
    return keys, place, end - start


class _Slice:
    """The words and pairs of a slice of documents, each in the order in which its buckets are asked and answer."""

    def __init__(self, words: bytes, place: bytes, n: bytes, buckets: int, salts: tuple[np.ndarray, np.ndarray]):
        self.words = np.append(np.frombuffer(words, "<u8"), _START)  # the last is the start of a text
        self.n = np.frombuffer(n, "<i8")
        size = len(self.words)
        after = spread(place)
        code = np.empty_like(after)
        code[1:] = after[:-1]
        first = np.cumsum(self.n) - self.n
        code[first[self.n > 0]] = size - 1
        code *= size
        code += after
        del after
        code, self.pair, _ = _distinct(code)
        self.before, self.after = (code // size).astype(np.int32), (code % size).astype(np.int32)
        self.word_bucket = _bucket(self.words, buckets)
        known, many = salts
        at = np.minimum(np.searchsorted(known, self.words), max(0, len(known) - 1))
        parts = np.where(known[at] == self.words, many[at], np.uint64(1)) if len(known) else np.ones(size, np.uint64)
        salt = mix(self.words, 7)[self.after] % parts[self.before]
        self.pair_bucket = _bucket(mix(self.words[self.before], salt), buckets)
        self.word_order, self.pair_order = (np.argsort(x, kind="stable").astype(np.int32) for x in (self.word_bucket, self.pair_bucket))

    def counts(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For documents that count ``weight`` times: of pairs; of words; of words as contexts."""
        pair = np.bincount(self.pair, np.repeat(weight, self.n), len(self.before))
        word, context = (np.bincount(x, pair, len(self.words)) for x in (self.after, self.before))
        return tuple(x.astype(np.int64) for x in (pair, word, context))


_ASKED = "kind int, bucket int, slice binary, contexts binary, runs binary, words binary, counts binary"
_GOT = "kind int, bucket int, slice binary, words binary, counts binary, n_target long, n_all long, n_words long"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _pairs_of(bucket: int, asked: pa.Table, buckets: int) -> list[tuple]:
    """Answers of a bucket of pairs, and what it adds to how many different words follow a context."""
    contexts, words, target, every = [], [], [], []
    for c, r, w, n in zip(*(asked[k].to_pylist() for k in ("contexts", "runs", "words", "counts")), strict=True):
        contexts.append(np.repeat(np.frombuffer(c, "<u8"), spread(r)))
        words.append(np.frombuffer(w, "<u8"))
        both = spread(n).reshape(2, -1)
        target.append(both[0])
        every.append(both[1])
    sizes = list(map(len, words))
    context = np.concatenate(contexts)
    _, first, place = np.unique(mix(context, np.concatenate(words)), return_index=True, return_inverse=True)
    total = [np.bincount(place, np.concatenate(x), len(first)).astype(np.int64) for x in (target, every)]
    out, at = [], 0
    for s, size in zip(asked["slice"].to_pylist(), sizes, strict=True):
        own = place[at : at + size]
        out.append((_PAIR, bucket, s, None, squeeze(np.concatenate([x[own] for x in total])), None, None, None))
        at += size
    keys, of = np.unique(context[first], return_inverse=True)
    kinds = np.stack([np.bincount(of, x > 0, len(keys)).astype(np.int64) for x in total])
    to = _bucket(keys, buckets)  # keys are sorted, so each bucket is a run
    out += [(_CONTEXT, int(to[a]), None, keys[a:b].tobytes(), squeeze(kinds[:, a:b].ravel()), None, None, None) for a, b in zip(*_runs(to), strict=True)]
    return out


def _summed(keys: list[bytes], values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the place of each key among them, the sums of their ``width`` values."""
    found, place = np.unique(np.concatenate([np.frombuffer(k, "<u8") for k in keys] or [np.zeros(0, np.uint64)]), return_inverse=True)
    rows = np.concatenate([spread(v).reshape(width, -1) for v in values] or [np.zeros((width, 0), np.int64)], 1)
    return found, place, np.stack([np.bincount(place, v, len(found)).astype(np.int64) for v in rows])


def _words_of(bucket: int, asked: pa.Table) -> list[tuple]:
    """The counts of a bucket of words: of target and all, as words and as contexts; and a row of sums."""
    keys = asked["words"].to_pylist()
    found, place, total = _summed(keys, asked["counts"].to_pylist(), 4)
    out, at = [], 0
    for s, k in zip(asked["slice"].to_pylist(), keys, strict=True):
        own = place[at : at + len(k) // 8]
        out.append((_WORD, bucket, s, k, squeeze(total[:, own].ravel()), None, None, None))
        at += len(k) // 8
    return [*out, (_SUM, bucket, None, None, None, int(total[0].sum()), int(total[1].sum()), int((total[1] > 0).sum()))]


def _follow(key: tuple, rows: pa.Table) -> pa.Table:
    """The words of a bucket with the number of different words that follow each, under target and all."""
    kinds, keys, counts = (rows[c].to_pylist() for c in ("kind", "words", "counts"))
    after = [i for i, k in enumerate(kinds) if k == _CONTEXT]
    found, _, total = _summed([keys[i] for i in after], [counts[i] for i in after], 2)
    total = np.concatenate([total, np.zeros((2, 1), np.int64)], 1)
    out = []
    for i, s in enumerate(rows["slice"].to_pylist()):
        if kinds[i] == _WORD:
            h = np.frombuffer(keys[i], "<u8")
            at = np.searchsorted(found, h)
            at[~np.isin(h, found)] = len(found)
            out.append((_WORD, key[0].as_py(), s, None, squeeze(np.concatenate([spread(counts[i]), *total[:, at]])), None, None, None))
    return _table(out, _GOT)


def _salts(packs: DataFrame, share: float, buckets: int) -> object:
    """Broadcast: the sorted hashes of the words that make up ``share`` of all or more, about, and the number of buckets of each as a context. There
    are 1 / ``share`` of them at most, and they decide nothing but where pairs are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, n, common, many in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                words = np.append(np.frombuffer(common, "<u8"), _START)
                counts = np.append(spread(many), int((np.frombuffer(n, "<i8") > 0).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts), pa.array([0] * len(counts[1:]) + [len(spread(place))])], ["word", "n", "of"])

    found = packs.select("place", "n", "common", "common_n").transform(map_arrow, run, "word long, n long, of long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
    total = found.agg(F.sum("of")).first()[0] or 1
    rows = sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, -(-r["n"] * buckets // total)) for r in found.where(F.col("n") >= share * total).collect())
    return packs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.uint64), np.array([max(1, r[1]) for r in rows], np.uint64)))


def score(docs: DataFrame, target_ids: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, counted_col: str | None = None) -> DataFrame:
    """(row, n_tokens, target_loss, background_loss, difference), a row per row of ``docs``, ``row`` with all columns but the text.

    The target model counts the documents whose id is in ``target_ids`` (first column), the background model all of them. Every word and
    every bigram of the corpus has an entry in both: one vocabulary, one absolute discount; what a context's bigrams lack goes to
    the unigrams, which are smoothed by one. With ``counted_col``, rows where it is not true are scored only. The difference, target
    less background in nats a token, is low where a document is like the target. A null text, or one without a word, has no tokens
    and zeros. Repeated rows stay and count as often; a null id is no target; an empty table gives an empty result.

    Texts become slices of word places. The different pairs and words of a slice go to buckets by hash, with their counts; a bucket adds
    them up and answers each slice with the sums. So what is gathered grows with the text, in buckets of bounded size, and a common
    pair, word or context is a number a slice. Nothing of the corpus is on the driver but three sums. What the steps before the last one
    shuffle goes from disk as each ends.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    buckets = int(max(1, (docs.agg(F.sum(F.length(text))).first()[0] or 0) // BUCKET))
    others = [c for c in docs.columns if c != text_col]
    share = max(1 / buckets, COMMON)
    counted = F.coalesce(F.col(f"`{counted_col}`"), F.lit(False)) if counted_col else F.lit(True)
    target = ws.save(target_ids.select(F.col(target_ids.columns[0]).alias("target")).where("target is not null").distinct(), "target")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text"), counted.alias("counted"))
    # Merged whatever the sizes, before texts become slices, so that slices need no second meeting with what was found of their rows.
    rows = rows.join(target.hint("merge"), F.col("row")[id_col] == F.col("target"), "left")
    rows = rows.select("row", "text", F.when(~F.col("counted"), 0).when(F.col("target").isNull(), 1).otherwise(2).cast("byte").alias("counted"))

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        trim()
        table = pa.Table.from_batches(batches)
        words, n = tokens(table["text"].to_pylist())
        keys, place, many = _distinct(words)
        order = np.argsort(-many, kind="stable")  # common words have small numbers
        number = np.empty(len(keys), np.int64)
        number[order] = np.arange(len(keys))
        row = pa.concat_arrays(table["row"].chunks)
        common = order[: int((many >= max(2, share / 2 * len(words))).sum())]
        cells = [[uuid.uuid4().bytes], None, [keys[order].tobytes()], [squeeze(number[place])], [n.tobytes()], [table["counted"].to_numpy().astype(np.uint8).tobytes()], [keys[common].tobytes()], [squeeze(many[common])]]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), row) if c is None else pa.array(c, pa.binary()) for c in cells], names_packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.nbytes for x in held) >= SLICE:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    names_packed = ["slice", "rows", "words", "place", "n", "counted", "common", "common_n"]
    schema = T.StructType([T.StructField(c, T.ArrayType(rows.schema["row"].dataType) if c == "rows" else T.BinaryType()) for c in names_packed])
    with shuffles_removed(spark):
        packs = ws.save(rows.transform(map_arrow, pack, schema), "slices")
        salts = _salts(packs, share, buckets)
    ws.remove("target")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                trim()
                yield from asked_by(*(c[i].as_py() for c in b.columns)).to_batches()

    def asked_by(slice_: bytes, words: bytes, place: bytes, n: bytes, counted: bytes) -> pa.Table:
        own = _Slice(words, place, n, buckets, salts.value)
        kind = np.frombuffer(counted, np.uint8)
        (pair_t, word_t, ctx_t), (pair, word, ctx) = (own.counts((kind >= k).astype(float)) for k in (2, 1))
        out = []
        bucket = own.word_bucket[own.word_order]
        for a, b in zip(*_runs(bucket), strict=True):
            at = own.word_order[a:b]
            out.append((_WORD, int(bucket[a]), slice_, None, None, own.words[at].tobytes(), squeeze(np.concatenate([x[at] for x in (word_t, word, ctx_t, ctx)]))))
        bucket = own.pair_bucket[own.pair_order]
        for a, b in zip(*_runs(bucket), strict=True):
            at = own.pair_order[a:b]  # pairs of a context stand together
            start, end = _runs(own.before[at])
            out.append((_PAIR, int(bucket[a]), slice_, own.words[own.before[at[start]]].tobytes(), squeeze(end - start), own.words[own.after[at]].tobytes(), squeeze(np.concatenate([pair_t[at], pair[at]]))))
        return _table(out, _ASKED)

    asked = packs.select("slice", "words", "place", "n", "counted").transform(map_arrow, ask, _ASKED)

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        trim()
        kind, bucket = (k.as_py() for k in key)
        return _table(_words_of(bucket, rows) if kind == _WORD else _pairs_of(bucket, rows, buckets), _GOT)

    with shuffles_removed(spark):
        got = ws.save(asked.groupBy("kind", "bucket").applyInArrow(answer, _GOT), "counts")
    sums = [x or 0 for x in got.where(F.col("kind") == _SUM).agg(F.sum("n_target"), F.sum("n_all"), F.sum("n_words")).first()]
    total, size = np.array(sums[:2], float), sums[2] + 1
    words = got.where(F.col("kind").isin(_WORD, _CONTEXT)).groupBy("bucket").applyInArrow(_follow, _GOT)
    answers = got.where(F.col("kind") == _PAIR).union(words).select("kind", "bucket", "slice", "counts")

    def finish(pack: pa.Table, got: pa.Table) -> pa.Table:
        if not pack.num_rows:
            return pa.table([pa.array([], t) for t in (pack.schema.field("rows").type.value_type, pa.int64(), *[pa.float64()] * 3)], names)
        trim()
        (words,), (place,), (n,) = (pack[c].to_pylist() for c in ("words", "place", "n"))
        own = _Slice(words, place, n, buckets, salts.value)
        kinds, blobs = got["kind"].to_numpy(), got["counts"]
        order = np.argsort(got["bucket"].to_numpy(), kind="stable")
        of = []
        for kind, width, at in ((_WORD, 6, own.word_order), (_PAIR, 2, own.pair_order)):
            counts, done = np.zeros((width, len(at))), 0
            for i in order[kinds[order] == kind].tolist():
                part = spread(blobs[i].as_py()).reshape(width, -1)
                counts[:, at[done : done + part.shape[1]]] = part
                done += part.shape[1]
            of.append(counts)
        word, p = of
        for a in range(0, p.shape[1], _BLOCK):  # counts of pairs become the logarithms of their probabilities
            some = slice(a, a + _BLOCK)
            before, after = own.before[some], own.after[some]
            mass, follow = word[2:4, before], word[4:6, before]
            left = np.where(mass > 0, np.maximum(discount * follow, 1e-12) / np.maximum(mass, 1), 1.0)
            p[:, some] = np.log(np.maximum(p[:, some] - discount, 0) / np.maximum(mass, 1) + left * (word[:2, after] + 1) / (total[:, None] + size))
        doc = np.repeat(np.arange(len(own.n)), own.n)
        loss = [-np.bincount(doc, x[own.pair], len(own.n)) / np.maximum(own.n, 1) for x in p]
        return pa.table([pa.chunked_array([c.flatten() for c in pack["rows"].chunks]), own.n, loss[0], loss[1], loss[0] - loss[1]], names)

    names = ["row", "n_tokens", "target_loss", "background_loss", "difference"]
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[2:])]
    return packs.select("slice", "rows", "words", "place", "n").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, T.StructType([rows.schema["row"], *fields]))


def good_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids that have a label of quality 1 and none of less, and none that is toxic. A null label of quality counts as 0, of toxicity as not
    toxic; ids may repeat; a null id is none."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    return good.where((F.col("id").isNotNull()) & (F.col("quality") == 1) & (F.col("toxic") == 0)).select("id")
