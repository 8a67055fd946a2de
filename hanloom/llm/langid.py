"""Language identification with interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow, once, slices, worker_state

ORDER = 5
#: The most labelled rows of a language that the models are fitted on; chosen by a hash of doc_id.
ROWS_PER_LANGUAGE = 300
#: One of so many sample rows is kept from the models, to calibrate the rejection.
CALIBRATE = 5
#: A document is rejected if its loss lies more than this, in nats a letter, above the worst calibration document of its language
#: (SLACK), with more leave for short documents (SHORT over the root of its length).
SLACK, SHORT = 0.75, 6.0
#: Letters that count in the score, at most; beyond that any document would score 0 or 1.
EVIDENCE = 24

_MULT = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOTS = 1 << 20


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, each run of other characters as one 0, ``order - 1`` zeros before each text; the text each
    belongs to; whether it is the text's own."""
    pad = "\0" * (order - 1)
    low = [pad + t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low)), sizes)
    own = np.ones(len(codes), bool)
    first = np.cumsum(sizes) - sizes
    for k in range(order - 1):
        own[first + k] = False
    c = np.where(once("letters", _letters)[codes], codes, 0)
    keep = (c > 0) | ~own
    keep[1:] |= c[:-1] > 0
    return c[keep].astype(np.uint64), doc[keep], own[keep]


def hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n symbols that end at each place."""
    out = np.full(len(c), _MULT[16 + n], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(n, len(c))):
            out[j:] += (c[: len(c) - j] + np.uint64(1)) * _MULT[j]
    return out


def _hash_of(back: list[np.ndarray]) -> np.ndarray:
    """As ``hashes``, of the symbols back[0], before it back[1] and so on."""
    out = np.full(len(back[0]), _MULT[16 + len(back)], np.uint64)
    with np.errstate(over="ignore"):
        for j, x in enumerate(back):
            out += (x + np.uint64(1)) * _MULT[j]
    return out


@dataclass
class Model:
    """Interpolated probabilities of the n-grams seen and weights of the contexts seen, sorted by hash; index n - 1."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: float
    worst: float = 0.0


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, keys[at] == h


def fit(texts: list[str], alphabet: int, order: int = ORDER) -> Model | None:
    """``alphabet``: the number of symbols that all languages share."""
    c, _, own = symbols(texts, order)
    at = np.flatnonzero(own)
    if not len(at):
        return None
    h = [None, *(hashes(c, n) for n in range(1, order + 1))]
    grams: dict[int, tuple] = {}
    keys, rep, count = np.unique(h[order][at], return_index=True, return_counts=True)
    grams[order] = keys, at[rep], count
    for n in range(order - 1, 0, -1):  # lower orders count the different symbols before an n-gram
        above = grams[n + 1][1]
        keys, rep, count = np.unique(h[n][above], return_index=True, return_counts=True)
        grams[n] = keys, above[rep], count
    model = Model([], [], [], [], 0.0)
    for n in range(1, order + 1):
        keys, pos, count = grams[n]
        once_, twice = (count == 1).sum(), (count == 2).sum()
        d = once_ / (once_ + 2 * twice) if once_ and twice else 0.5
        if n == 1:
            context, inverse, lower = np.zeros(1, np.uint64), np.zeros(len(keys), np.int64), np.full(len(keys), 1 / (alphabet + 1))
        else:
            context, inverse = np.unique(h[n - 1][pos - 1], return_inverse=True)
            lower = np.exp(model.logp[-1][np.searchsorted(model.keys[-1], h[n - 1][pos])])
        total = np.bincount(inverse, count, len(context))
        weight = d * np.bincount(inverse, minlength=len(context)) / total
        p = np.maximum(count - d, 0) / total[inverse] + weight[inverse] * lower
        if n == 1:
            model.unseen = float(np.log(weight[0] / (alphabet + 1)))
        model.keys.append(keys)
        model.logp.append(np.log(p))
        model.contexts.append(context)
        model.weights.append(np.log(weight))
    return model


def log_probability(model: Model, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """h[n - 1]: hashes of the last n symbols; before[n - 1]: of the n - 1 symbols before the last."""
    out = np.zeros(len(h[0]))
    left = np.arange(len(out))
    for n in range(len(h), 0, -1):
        at, hit = _found(model.keys[n - 1], h[n - 1][left])
        out[left[hit]] += model.logp[n - 1][at[hit]]
        left = left[~hit]
        if n > 1:
            at, hit = _found(model.contexts[n - 1], before[n - 1][left])
            out[left[hit]] += model.weights[n - 1][at[hit]]
    out[left] += model.unseen
    return out


class Identifier:
    """The models of all languages, with a table of the scores of n-grams that a worker has met."""

    def __init__(self, models: dict[str, Model], order: int = ORDER):
        self.languages, self.order = sorted(models), order
        self.models = [models[x] for x in self.languages]
        self.slots = max(1 << 10, min(_SLOTS, 1 << int(np.log2((1 << 22) / max(1, len(models))))))
        self.met = None

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cross-entropy of each text under each language, nats a symbol; the number of its symbols."""
        c, doc, own = symbols(texts, self.order)
        n = np.bincount(doc[own], minlength=len(texts))
        if self.met is None:
            self.met = np.zeros(self.slots, np.uint64), np.zeros((self.slots, len(self.models)), np.float32)
        met, score = self.met
        whole, doc = hashes(c, self.order)[own], doc[own]
        with np.errstate(over="ignore"):
            slot = (whole * _MULT[31] >> np.uint64(64 - int(np.log2(self.slots)))).astype(np.int64)
        values = score[slot]
        new = np.flatnonzero(met[slot] != whole)
        if len(new):
            _, first, inverse = np.unique(whole[new], return_index=True, return_inverse=True)
            place = np.flatnonzero(own)[new[first]]
            back = [c[place - j] for j in range(self.order)]
            h = [_hash_of(back[:k]) for k in range(1, self.order + 1)]
            before = [None, *(_hash_of(back[1:k]) for k in range(2, self.order + 1))]
            fresh = np.stack([log_probability(m, h, before) for m in self.models], 1).astype(np.float32)
            values[new] = fresh[inverse]
            met[slot[new[first]]] = 0  # where two fall on one slot, the last stays; its number must fit
            score[slot[new[first]]] = fresh
            met[slot[new[first]]] = whole[new[first]]
        out = np.stack([np.bincount(doc, values[:, k], len(texts)) for k in range(len(self.models))], 1)
        return -out / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, loss and whether it is rejected."""
        if not self.models or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.array([not any(map(str.isalpha, t)) for t in texts], bool)
        parts = [self.losses(texts[a:b]) for a, b in chunks(texts, 1 << 17)]
        loss, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        best = loss.argmin(1)
        least = loss[np.arange(len(texts)), best]
        score = 1 / np.exp((least[:, None] - loss) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        worst = np.array([m.worst for m in self.models])[best]
        none = n == 0
        rejected = none | (least > worst + SLACK + SHORT / np.sqrt(np.maximum(n, 1)))
        return ["und" if z else self.languages[k] for k, z in zip(best, none, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, least), rejected


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; of a null id, of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, rows: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> Identifier:
    """Fits the models on at most ``rows`` rows of each language whose fold is not ``held_out``, whole texts.

    Languages are counted over all rows; then the rows with the smallest hashes of their ids come to the driver, which therefore
    holds ``rows`` texts of each language, whatever the size of the table.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != held_out))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return Identifier({}, order)
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, (1 << 40) * rows * 3 // (2 * n)))]), F.col(lang_col)), F.lit(0))
    taken = labelled.where(h < share).select(F.col(lang_col), F.col(text_col), h.alias("h")).orderBy("h", text_col)
    sample: dict[str, list[str]] = {}
    for lang, text, _ in taken.toLocalIterator():
        if len(own := sample.setdefault(lang, [])) < rows:
            own.append(text)
    alphabet = len({ch for own in sample.values() for t in own for ch in t.lower() if ch.isalpha()}) + 1
    models = {lang: m for lang, own in sample.items() if (m := fit([t for i, t in enumerate(own) if i % CALIBRATE or len(own) < CALIBRATE], alphabet, order))}
    found = Identifier(models, order)
    for lang, model in models.items():
        own = [t for i, t in enumerate(sample[lang]) if not i % CALIBRATE or len(sample[lang]) < CALIBRATE]
        loss, n = found.losses(own)
        model.worst = float(loss[n > 0, found.languages.index(lang)].max(initial=0.0))
    found.met = None
    return found


def identify(docs: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, loss, rejected), a row per row of ``docs``; ``row`` holds all its columns, whatever their names.

    A null text, or one without a letter, is ``und`` with score 0, and rejected. Repeated rows stay. Ties go to the language first in
    order. If nothing was learned, every document is ``und``, and rejected only if it has no letter.
    """
    plain = model.order, {k: vars(m) for k, m in zip(model.languages, model.models, strict=True)}
    shared, token = docs.sparkSession.sparkContext.broadcast(plain), uuid.uuid4().hex
    names = ["row", "lang_pred", "score", "loss", "rejected"]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if state.get("langid", ("",))[0] != token:
            order, models = shared.value
            state["langid"] = token, Identifier({k: Model(**m) for k, m in models.items()}, order)
        found = state["langid"][1]
        for b in slices(batches):
            lang, score, loss, rejected = found.predict([t or "" for t in b.column(0).field(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(loss), pa.array(rejected)], names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("loss", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.transform(map_arrow, run, schema)


def accepted(docs: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return identify(docs, model, text_col).where("not rejected").select("row.*")
