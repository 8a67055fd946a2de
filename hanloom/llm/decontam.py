"""Benchmark decontamination by winnowing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, free_name, text_or_empty

#: A shared span of WINDOW words has WINDOW - GRAM + 1 grams, which is the winnowing window: each such span keeps a common gram.
WINDOW, GRAM = 10, 5
#: A benchmark table goes to every executor only up to this many rows of at most ROW_BYTES; beyond, both sides are exchanged.
BROADCAST_ROWS, ROW_BYTES = 100_000, 200

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In a packed gram the lower bits hold its place, the upper ones its hash.
_PLACE = 31


def lower_ascii(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _SEPARATORS), "")


def _gram(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(h, i + j) for j in range(n)])


def _range(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _winnowed(df: DataFrame, key: str, window: int, gram: int) -> DataFrame:
    """(key, gram, at) from ``df`` (key, h): of each window the least gram; equal hashes go to the first place, alike wherever the span
    stands. Each array is a column of its own, so that no lambda computes it again for every word."""
    w = window - gram + 1
    packed = F.transform(_range(F.size("h") - (gram - 1)), lambda i: F.shiftleft(F.shiftright(_gram(F.col("h"), i, gram), _PLACE), _PLACE).bitwiseOR(i.cast("long")))
    least = F.array_distinct(F.transform(_range(F.size("p") - (w - 1)), lambda s: F.least(*[F.get("p", s + j) for j in range(w)])))
    out = df.select(key, packed.alias("p")).select(key, F.explode(least).alias("g"))
    return out.select(key, F.shiftright("g", _PLACE).alias("gram"), F.col("g").bitwiseAND((1 << _PLACE) - 1).cast("int").alias("at"))


def _all_grams(hashes: Column, n: int) -> Column:
    return F.transform(_range(F.size(hashes) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("start"), F.xxhash64(F.slice(hashes, i + 1, n)).alias("gram")))


def _hashes(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.transform("words", lambda x: F.xxhash64(x)).alias("h"))


def _window_key(words: Column, start: Column, n: Column | int) -> Column:
    """Words hold no space, so that the joined window tells them apart."""
    return F.unhex(F.sha2(F.array_join(F.slice(words, start + 1, n), " "), 256))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df``, whose columns are numbers, digests and one id at most, marked for broadcast if it is counted to be small."""
    rows, width = df.select(F.count("*"), F.coalesce(F.max(sum(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and width <= ROW_BYTES else df


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hits_by_text(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(digest, n_hit, items) for every different text of ``docs`` in which an item has a window. See ``contamination``."""
    text = text_or_empty(text_col)
    rows = docs.select(_digest(text).alias("digest"), words_of(text).alias("words"))

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text_or_empty(item_text_col)).alias("words")).where(F.size("words") > 0)
    items = ws.save(items.withColumn("of", _digest(F.array_join("words", " "))), "items")
    texts = items.groupBy("of").agg(F.first("words").alias("words"))
    n = F.least(F.size("words"), F.lit(window))
    starts = F.transform(_range(F.size("words") - (n - 1)), lambda s: F.struct(n.alias("n"), _window_key(F.col("words"), s, n).alias("key")))
    windows = ws.save(texts.select("of", F.explode(starts).alias("w")).select("w.key", "w.n", "of").distinct(), "windows")
    keys = ws.save(windows.select("key").distinct(), "window-keys")
    grams = ws.save(_winnowed(_hashes(texts.where(F.size("words") >= window), "of"), "of", window, gram).select("gram").distinct(), "item-grams")
    short = sorted(r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # fewer than ``window`` numbers

    hashed = _hashes(rows, "digest")
    mine = _winnowed(hashed, "digest", window, gram)
    hit = mine.join(_maybe_broadcast(grams), "gram")
    near = hit.select("digest", F.explode(F.sequence(F.col("at") - (window - gram), F.col("at"))).alias("start"), F.lit(window).alias("n")).where("start >= 0")
    if short:
        brief = _hashes(texts.where(F.size("words") < window), "words").select(F.size("words").alias("n"), F.xxhash64("h").alias("gram")).distinct()
        brief = ws.save(brief, "short-grams")
        all_grams = F.flatten(F.array(*[_all_grams(F.col("h"), k) for k in short]))
        near = near.unionByName(hashed.select("digest", F.explode(all_grams).alias("g")).select("digest", "g.*").join(_maybe_broadcast(brief), ["n", "gram"]).select("digest", "start", "n"))
    candidates = ws.save(near.groupBy("digest").agg(F.collect_set(F.struct("start", "n")).alias("near")), "candidates")

    # One document of each such text brings it. Copies meet as digests only, summed before they are exchanged; texts are dealt by id, and
    # stream past the few that are wanted. Merged whatever the sizes, so that the plan is the same at any scale.
    source = docs.select(F.col(f"`{id_col}`").alias("id"), _digest(text).alias("digest"), text.alias("text"))
    first = source.groupBy("digest").agg(F.min("id").alias("at"))
    wanted = ws.save(first.join(candidates.hint("merge"), "digest").select(F.col("digest").alias("of"), "at", "near"), "wanted")
    mine = source.join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("of"))).select("digest", words_of(F.col("text")).alias("words"), "near")
    seen = F.transform(F.filter("near", lambda c: c["start"] + c["n"] <= F.size("words")), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), _window_key(F.col("words"), c["start"], c["n"]).alias("key")))
    verified = mine.select("digest", F.explode(seen).alias("c")).select("digest", "c.*")
    verified = ws.save(verified.join(_maybe_broadcast(keys), "key"), "hits")

    end = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("digest").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(end, F.lit(0))))
    hits = verified.select("digest", "start", "n").distinct().select("digest", covered.alias("x")).groupBy("digest").agg(F.sum("x").alias("n_hit"))
    item_rows = windows.select("key", "of")
    classes = verified.select("digest", "key").distinct().join(_maybe_broadcast(item_rows), "key").select("digest", "of").distinct()
    ids = items.where("item is not null").select("of", "item").distinct()
    listed = classes.join(_maybe_broadcast(ids), "of").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = ws.save(hits.join(listed, "digest", "left").select("digest", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "result")
    ws.remove("items", "windows", "window-keys", "item-grams", "short-grams", "candidates", "wanted", "hits")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, n_words, n_hit, items): a row per row of ``docs``; ``items`` are the ids, as sorted strings, of the items that have a window
    in it, n_hit counts the words inside windows.

    A window is ``window`` consecutive words of an item; an item of fewer is one window. Fingerprints of documents and items are
    joined; around each common one, every window that holds it is compared whole. For items shorter than a window winnowing
    gives no guarantee, so all grams of their lengths are taken instead, only if there are such items. Work is done once for each
    different text. Null texts, and texts without words, have no words and no hits. Items without id hit, but are not listed.
    Repeated rows and items change nothing; other columns are not read.
    """
    found = hits_by_text(docs, benchmark, ws, id_col, text_col, **more)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), F.size(words_of(text)).cast("long").alias("n_words"))
    out = rows.join(found, "digest", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns. Null and empty texts stay, repeated rows stand or go together; without items all stay."""
    name = free_name("digest", docs.columns)
    found = hits_by_text(docs, benchmark, ws, id_col, text_col, **more).select(F.col("digest").alias(name))
    return docs.join(found.hint("merge"), _digest(text_or_empty(text_col)) == F.col(name), "left_anti")
