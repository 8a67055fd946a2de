"""BPE encoding and decoding with a minimal acyclic transducer of frequent words and exact merges for the rest."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, chunks, free_name, map_arrow, once, shared_dir, slices, text_or_empty

#: A word is frequent if it makes up this share of all words; so there are 1 / SHARE of them at most.
SHARE = 4e-6
#: Longer words are merged one by one and not kept; of others a worker keeps two generations of so many.
_LONGEST, _KEPT = 64, 1 << 16


def _latin() -> str:
    """A regex class of Latin letters in NFC whose lower case is one letter of the class; texts of these and plain ASCII take a quicker way."""
    found = {chr(i) for i in range(0xC0, 0x250) if chr(i).isalpha() and unicodedata.is_normalized("NFC", chr(i))}
    return "".join(sorted(c for c in found if c.lower() in found))


_LATIN = _latin()
_PLAIN = re.compile(f"[\t\n\r -~\u00a1\u00a7\u00ab\u00bb\u00bf\u2010-\u2027{_LATIN}]*")
_NO_PAIR = 1 << 60
_MAGIC = b"HLTX0001"


def _byte_symbols() -> list[str]:
    """The usual printable stand-ins of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


@lru_cache(maxsize=1)
def unlike() -> bytes:
    """A bit for each code point for which the library's tables may differ from Python's: those that Python's Unicode leaves unassigned, and
    those found by probing letters, numbers, white space, normal forms, also beside marks of low and of high class, and lower case."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    bad = {c for c in chars if unicodedata.category(c) == "Cn"}
    whole = "".join(c for c in chars if c not in bad)
    for kind in ("\\p{L}", "\\p{N}", "\\s"):
        runs = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(whole)
        bad.update(set("".join(regex.findall(f"{kind}+", whole))) ^ set("".join(r for r, _ in runs)))
    # Ideographs, syllables and private characters have neither case nor, by rule, another normal form than Python gives.
    same = regex.compile(r"[\p{Co}\u3400-\u9fff\uac00-\ud7a3\U00020000-\U0002f7ff\U00030000-\U000323af]")
    probed = [c for c in whole if c != "\n" and not same.match(c)]
    frames = ("{}", "a{}\u0334", "a\u0345{}")
    steps = ((normalizers.NFC(), partial(unicodedata.normalize, "NFC")), (normalizers.NFD(), partial(unicodedata.normalize, "NFD")), (normalizers.Lowercase(), lambda t: "".join(map(str.lower, t))))
    for library, own in steps:
        for frame in frames:
            text = "\n".join(map(frame.format, probed))
            bad.update(c for c, x, y in zip(probed, library.normalize_str(text).split("\n"), own(text).split("\n"), strict=True) if x != y)
    for c in probed:  # a composition that only one side knows
        if (parts := unicodedata.normalize("NFD", c)) != c and (c in bad or normalizers.NFC().normalize_str(parts) != unicodedata.normalize("NFC", parts)):
            bad.update(parts)
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in bad]] = True
    return np.packbits(table).tobytes()


class WordBpe:
    """The model of a tokenizers file of the kind: NFC, white space runs to one space, lower case; split by pattern, byte symbols, BPE
    with word ends. Anything else in the file is refused. ``odd``: what ``unlike`` gives for the file; texts with such a code point
    are left to the library."""

    def __init__(self, source: bytes, odd: bytes = b""):
        self.source = source
        self.odd = np.unpackbits(np.frombuffer(odd or bytes(0x110000 // 8), np.uint8)).astype(bool)
        spec = json.loads(source)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        plain = not (model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"] or model["type"] != "BPE" or not plain or spec["decoder"]:
            raise ValueError("not a tokenizer of this kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {}
        for x in spec["added_tokens"]:
            if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]:
                raise ValueError("not a tokenizer of this kind")
            self.special[x["content"]] = x["id"]
            self.tokens[x["id"]] = x["content"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(merges)}
        symbols = _byte_symbols()
        self.first = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self._first, self._last = np.array(self.first, np.int64), np.array(self.last, np.int64)
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._pair_rank = pairs[order], np.fromiter((k for k, _ in self.ranks.values()), np.int64, len(pairs))[order]
        self._merged = np.zeros(len(merges) + 1, np.int64)
        for k, one in self.ranks.values():
            self._merged[k] = one
        self._library = None
        pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(pattern.replace("[\\p{L}]", f"[a-z{_LATIN}]").replace("[\\p{N}]", "[0-9]").replace("[^\\s\\p{L}\\p{N}]", f"[^\\sa-z0-9{_LATIN}]"))
        if "\\p" in self.plain.pattern:
            raise ValueError("not a tokenizer of this kind")
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, the leftmost first, until none is left."""
        return self._merge_long([self.first[b] for b in word[:-1]] + [self.last[word[-1]]])

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many short words at once: in each step every word that has a pair left merges its best one. The ids of all, and
        where those of each word begin and the last end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        of = np.repeat(np.arange(len(words)), sizes)
        ids = self._first[raw]
        stop = np.cumsum(sizes) - 1
        ids[stop] = self._last[raw[stop]]
        rank = np.full(len(ids), _NO_PAIR)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        done_of, done_ids = [], []
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            left = best < _NO_PAIR
            if not left.all():
                done_of.append(of[~left])
                done_ids.append(ids[~left])
                of, ids, rank, best = of[left], ids[left], rank[left], best[left]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate(([True], of[at[1:]] != of[at[:-1]]))]
            ids[at] = self._merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            of, ids, rank = of[keep], ids[keep], rank[keep]
            at -= np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                pair = p[p + 1 < len(ids)]
                rank[p] = _NO_PAIR
                pair = pair[of[pair] == of[pair + 1]]
                rank[pair] = self._rank(ids[pair], ids[pair + 1])
        of, ids = np.concatenate(done_of), np.concatenate(done_ids)
        order = np.argsort(of, kind="stable")
        return ids[order].astype("<u4"), np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(words)))))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self._pairs, key)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == key, self._pair_rank[at], _NO_PAIR)

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right, ranks = list(range(-1, n - 1)), list(range(1, n + 1)), self.ranks
        heap = [(ranks[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = ranks[pair][1], -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], a, p))
        return [x for x in ids if x >= 0]

    def _pieces(self, text: str, plain: bool) -> list[str]:
        if plain:  # in NFC; letters, digits and white space are told apart without Unicode's tables
            return self.plain.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: a whole string would take the other small sigma at the end of words.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str | int] | None:
        """Words, and the ids of special strings, which stand apart as in the library; None if a code point leaves the text to the library."""
        plain = _PLAIN.fullmatch(text) is not None
        if not plain and self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
            return None
        if self.at_special is None or "<" not in text or not self.at_special.search(text):
            return self._pieces(text, plain)
        out: list[str | int] = []
        at = 0
        for m in self.at_special.finditer(text):
            out += self._pieces(text[at : m.start()], plain)
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._pieces(text[at:], plain)

    def by_library(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source.decode())
        return self._library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens stand with a space between."""
        return " ".join(self.tokens[i] for i in ids)


class Lexicon:
    """Words to id sequences as one block of bytes that can be mapped.

    A deterministic acyclic automaton over UTF-8 bytes in which equal right languages share one state. Each arc carries the number of
    words that come before those behind it; the sum along a word's path is its number, which places its ids in a pool.
    """

    _PARTS = (("arcs", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("final", "<u1"), ("offsets", "<i4"), ("ids", "<u4"))

    def __init__(self, block):
        view = memoryview(block)
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a lexicon")
        sizes = np.frombuffer(view, "<i8", len(self._PARTS), 8)
        at = 8 + 8 * len(sizes)
        for (name, kind), n in zip(self._PARTS, sizes, strict=True):
            setattr(self, name, np.frombuffer(view, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = node[0], tuple(node[1])
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, before = [[False, []]], b""
        for w in words:
            same = 0
            while same < min(len(w), len(before)) and w[same] == before[same]:
                same += 1
            for k in range(len(before), same, -1):
                path[k - 1][1].append((before[k - 1], settle(path.pop())))
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = True
            before = w
        for k in range(len(before), 0, -1):
            path[k - 1][1].append((before[k - 1], settle(path.pop())))
        root = settle(path[0])
        count = [0] * len(states)
        arcs, targets, outputs = [], [], []
        for s, (final, out) in enumerate(states):  # targets come before
            n = int(final)
            for label, to in out:
                arcs.append(s << 8 | label)
                targets.append(to)
                outputs.append(n)
                n += count[to]
            count[s] = n
        lens = [len(entries[w]) for w in words]
        parts = [arcs, targets, outputs, [f for f, _ in states], [root, 0, *np.cumsum(lens)], [i for w in words for i in entries[w]]]
        arrays = [np.asarray(x, kind) for x, (_, kind) in zip(parts, cls._PARTS, strict=True)]
        body = b"".join(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in arrays)
        return _MAGIC + np.array([len(a) for a in arrays], "<i8").tobytes() + body

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon; all words take a step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not len(self.arcs) or not len(words):
            return np.full(len(words), -1)
        buf = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(sizes) - sizes
        state, number = np.full(len(words), int(self.offsets[0]), np.int64), np.zeros(len(words), np.int64)
        state[sizes == 0] = -1
        for k in range(int(sizes.max())):
            on = np.flatnonzero((sizes > k) & (state >= 0))
            if not len(on):
                break
            arc = state[on] << 8 | buf[start[on] + k]
            at = np.searchsorted(self.arcs, arc)
            at[at == len(self.arcs)] = 0
            hit = self.arcs[at] == arc
            number[on] += np.where(hit, self.outputs[at], 0)
            state[on] = np.where(hit, self.targets[at], -1)
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, number, -1)

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number + 1] : self.offsets[number + 2]]


class Encoder:
    """Looks words up in the lexicon, merges those it lacks, and keeps what a worker met."""

    def __init__(self, model: WordBpe, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon
        self.ids: dict = {}
        self.said: dict = {}
        self.old: tuple[dict, dict] = {}, {}

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        numbers = self.lexicon.numbers(raw)
        text = self.model.tokens
        for i in np.flatnonzero(numbers >= 0).tolist():
            ids = self.lexicon.ids_of(numbers[i])
            self.ids[words[i]], self.said[words[i]] = ids.astype("<u4").tobytes(), self.model.decode(ids.tolist())
        short = [i for i in np.flatnonzero(numbers < 0).tolist() if len(raw[i]) <= _LONGEST]
        ids, at = self.model.merge_all([raw[i] for i in short])
        flat, names, at = ids.tobytes(), [text[k] for k in ids.tolist()], at.tolist()
        for i, a, b in zip(short, at, at[1:]):
            self.ids[words[i]], self.said[words[i]] = flat[4 * a : 4 * b], " ".join(names[a:b])
        for w, b, n in zip(words, raw, numbers.tolist(), strict=True):
            if n < 0 and len(b) > _LONGEST:
                own = self.model.merge(b)
                self.ids[w], self.said[w] = np.array(own, "<u4").tobytes(), self.model.decode(own)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian unsigned 32-bit integers; what they decode to."""
        ids: list[bytes] = []
        said: list[str] = []
        for a, b in chunks(texts, 1 << 18):
            if len(self.ids) > _KEPT:  # what was met since the last time stays
                self.old, self.ids, self.said = (self.ids, self.said), {}, {}
            for i in self.model.special.values():
                self.ids[i], self.said[i] = np.array([i], "<u4").tobytes(), self.model.tokens[i]
            split = [self.model.pieces(t) for t in texts[a:b]]
            new = [w for w in set(chain.from_iterable(x for x in split if x)) if w not in self.ids]
            for w in new:
                if w in self.old[0]:
                    self.ids[w], self.said[w] = self.old[0][w], self.old[1][w]
            self._learn([w for w in new if w not in self.ids])
            get, say = self.ids.__getitem__, self.said.__getitem__
            for t, words in zip(texts[a:b], split, strict=True):
                if words is None:
                    own = self.model.by_library(t)
                    ids.append(np.array(own, "<u4").tobytes())
                    said.append(self.model.decode(own))
                else:
                    ids.append(b"".join(map(get, words)))
                    said.append(" ".join(map(say, words)))
            for w in new:
                if len(w) > _LONGEST:
                    del self.ids[w], self.said[w]
        return ids, said


def word_counts(docs: DataFrame, source: bytes, text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts; counts of a batch are summed before the shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast((source, unlike())), hashlib.sha256(source).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("bpe", key), lambda: WordBpe(*shared.value))
        for b in slices(batches):
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                n.update(model.pieces(t) or ())
            for i in model.special.values():
                n.pop(i, None)
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    return docs.where(F.col(text_col).isNotNull()).select(text_col).transform(map_arrow, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, model_path: str, ws: Workspace, text_col: str = "text", share: float = SHARE) -> str:
    """Counts all words, compiles those of at least ``share`` of all into a lexicon in the shared folder; returns its path.

    The driver gets 1 / ``share`` words at most.
    """
    source = Path(model_path).read_bytes()
    counts = ws.save(word_counts(docs, source, text_col), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    model = WordBpe(source)
    frequent = [r[0].encode("utf-8", "surrogatepass") for r in counts.where((F.col("n") >= share * total) & (F.length("word") <= _LONGEST)).select("word").toLocalIterator()]
    ws.remove("word-counts")
    block = Lexicon.compile({w: model.merge(w) for w in frequent if w})
    sc = docs.sparkSession.sparkContext
    path = f"{shared_dir(docs.sparkSession)}/hanloom-lexicon-{hashlib.sha256(block).hexdigest()[:32]}.bin"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(block))
    out.close()
    return path


def encode(docs: DataFrame, model_path: str, lexicon: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``ids`` (binary: little-endian unsigned 32-bit integers), ``decoded`` (string). Columns of ``docs`` with
    these names are replaced.

    As the tokenizers library does with add_special_tokens=False, and its decode with skip_special_tokens=False. A null text
    counts as empty: no ids, decoded empty. Rows stay as they are, repeated ones too. ``lexicon`` is a file in the shared
    folder; Spark brings it to each executor once, whose workers map it.
    """
    sc = docs.sparkSession.sparkContext
    source = Path(model_path).read_bytes()
    shared, key = sc.broadcast((source, unlike())), hashlib.sha256(source).hexdigest()
    sc.addFile(lexicon)
    name = lexicon.rsplit("/", 1)[-1]
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    own = free_name("_text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(("bpe", key), lambda: WordBpe(*shared.value))
        encoder = once(("encoder", key, name), lambda: Encoder(model, Lexicon.mapped(SparkFiles.get(name))))
        for b in slices(batches):
            ids, said = encoder.encode(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(ids, pa.binary()), pa.array(said, pa.string())], [*(f.name for f in kept), "ids", "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids binary, decoded string"])
    return docs.select(text_or_empty(text_col).alias(own), *[F.col(f"`{f.name}`") for f in kept]).transform(map_arrow, run, schema)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpack_ids(ids: Column) -> Column:
    """Ids as an array of long."""
    at = F.sequence(F.lit(1), F.octet_length(ids) - 3, F.lit(4))
    return F.when(F.octet_length(ids) < 4, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(F.concat(*[F.hex(F.substring(ids, i + k, F.lit(1))) for k in (3, 2, 1, 0)]), 16, 10).cast("bigint")))
