"""Near-duplicates, fingerprints and components against brute force."""

import random
import re
from functools import partial

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from hanloom.llm import simhash, spotsigs
from hanloom.llm.common import Workspace
from hanloom.llm.components import connected_components
from hanloom.llm.hashing import padded, xxh64_spans

DATA = "/root/testdata/sf0.001/documents.parquet"


def groups(nodes, linked):
    up = {k: k for k in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {k: root(k) for k in nodes}


def test_hashes():
    rng = random.Random(1)
    data = rng.randbytes(5000)
    starts = np.array([rng.randrange(4600) for _ in range(2000)])
    lens = np.array([rng.randrange(400) for _ in range(2000)])
    got = xxh64_spans(padded(data), starts, lens)
    assert all(int(h) == xxhash.xxh64_intdigest(data[s : s + n], seed=42) for h, s, n in zip(got, starts, lens, strict=True))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = pq.read_table(DATA).column("text").to_pylist()[:40] + ["", " \t", "A", "a B", "A  b\nC d", "É é\x0b\x85x", "x" * 700 + " y z w"]
    assert [int(f) for f in simhash.fingerprint_texts(texts)] == [plain_fingerprint(t) for t in texts]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)] + [(1, 1), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(spark, df, Workspace(spark, "test")).collect()}
    want = groups({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert connected_components(spark, df.limit(0), Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize(("bits", "dense"), [(2, 32), (2, 1), (1, 32), (1, 1)])
def test_near_edges(spark, bits, dense):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(12):
            prints.add(s)
            for _ in range(rng.randrange(4)):
                s ^= 1 << rng.randrange(64)
            prints.add(s)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, fp long")
    ws = Workspace(spark, "test")
    got = {r.node: r.component for r in connected_components(spark, simhash.near_edges(spark, nodes, ws, bits, dense), ws).collect()}
    want = groups(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits])
    assert {k: got.get(k, k) for k in want} == want and len(set(want.values())) < len(prints)


def test_near_duplicates(spark):
    texts = pq.read_table(DATA).column("text").to_pylist()[:120]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500 + i, t + " end", "y") for i, t in enumerate(texts[:40])] + [(900, None, "z"), (901, "", "z"), (902, " \n", None), (None, texts[3], "n"), (5, texts[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    fp = {i: plain_fingerprint(t) for i, t, _ in rows if i is not None}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == sorted([(i if i is not None else -1, want[i] if i is not None else want[3]) for i, _, _ in rows])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *want.values()}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df).select(simhash.hex_fingerprint(simhash.F.col("fp")).alias("h")).where("length(h) <> 16").count() == 0


def test_signatures():
    f = spotsigs.signatures
    assert list(f("The quick brown fox of old times")) == sorted({xxhash.xxh32_intdigest("the quick brown"), xxhash.xxh32_intdigest("of old times")})
    assert len(f("")) == 0 and len(f("!!")) == 1 and list(f("the")) == [xxhash.xxh32_intdigest("the")]
    assert np.array_equal(spotsigs.from_string(spotsigs.to_string(f("the big cat"))), f("the big cat"))
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    assert spotsigs.jaccard(a, b) == 0.4 and spotsigs.jaccard(a, b, 0.8) == 0 and spotsigs.jaccard(a[:0], a[:0]) == 1 and spotsigs.jaccard(a, a[:0]) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 250])
def test_compare_edited(spark, n):
    rng = random.Random(n)
    texts = pq.read_table(DATA).column("text").to_pylist()
    rows = [(rng.randrange(-50, 300), rng.choice([None, "", "the cat sat", "é" * rng.randrange(9), rng.choice(texts)[:400]])) for _ in range(n)]
    if n == 7:
        rows[3] = (None, "no id")
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for i, (k, x) in enumerate(order):
        x, y = x or "", order[(i + 1) % n][1] or ""
        third = len(x) // 3
        edited = x[: len(x) - third] + y[:third]
        mine = spotsigs.signatures(x)
        want.append((str(k), len(x), edited, spotsigs.to_string(mine), spotsigs.to_string(spotsigs.signatures(edited)), spotsigs.jaccard(mine, spotsigs.signatures(edited)), spotsigs.jaccard(mine, spotsigs.signatures(y))))
    got = [(str(r[0]), *r[1:]) for r in spotsigs.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_spotsigs_classes(spark):
    texts = pq.read_table(DATA).column("text").to_pylist()[:90]
    rows = list(enumerate(texts)) + [(1000 + i, t + " extra word") for i, t in enumerate(texts[:40])] + [(3000, None), (3001, ""), (None, texts[0])]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = {k: spotsigs.signatures(t or "") for k, t in rows if k is not None}
    want = groups(s, [(a, b) for a in s for b in s if a < b and spotsigs.jaccard(s[a], s[b]) >= 0.8])
    assert {k: got[k] for k in want} == want and got[None] == want[0]


@pytest.mark.parametrize("dense", [32, 1])
def test_similar(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BUCKET", 1 << 16)
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "similar", partial(simhash.similar, dense=dense))
    rng = random.Random(5)
    texts = pq.read_table(DATA).column("text").to_pylist()[:90]

    def edited(t):
        w = t.split()
        for _ in range(max(1, len(w) // rng.choice((50, 60, 90)))):
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w)

    rows = list(enumerate(texts)) + [(1000 + i, edited(t)) for i, t in enumerate(texts)] + [(3000, None), (3001, ""), (None, texts[0]), (3002, "two words")]
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    for i in range(40):  # a chain of copies, each near the next ones only; all share many runs
        base[rng.randrange(300)] = f"new{i}"
        rows.append((5000 + i, " ".join(base[: 300 - rng.randrange(20)])))
    passage = " ".join(f"p{i}" for i in range(60))  # a passage that many documents share
    rows += [(6000 + i, f"{passage} " + " ".join(f"q{i}-{k}" for k in range(rng.choice((3, 8, 15, 40))))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    sets = {}
    for k, t in rows:
        w = (t or "").lower().split()
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    alike = {(a, b): (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) for a in sets for b in sets if None not in (a, b) and a < b}
    want = groups([k for k in sets if k is not None], [p for p, x in alike.items() if x >= 0.8])
    assert {k: got[k] for k in want} == want and got[None] == want[0] and sum(want[1000 + i] == want[i] for i in range(90)) > 20
    kept = {r.doc_id for r in simhash.one_of_each(df, words=5, like=0.8).collect()}
    assert kept == {None, *want.values()}
    assert simhash.similar(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "dense"), [(8, 32), (8, 1), (3, 4)])
def test_near_links(spark, bits, dense, monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 50)
    rng = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(10):
        s = rng.getrandbits(64)
        for _ in range(25):  # a walk, and copies around its start
            prints.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
            for b in rng.sample(range(64), rng.randrange(12)):
                s ^= 1 << b
            prints.add(s)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, dense).collect()
    place = {p: i for i, p in enumerate(signed)}
    near = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits}
    found = [tuple(sorted((place[r.fp], place[r.fp_2]), reverse=True)) for r in got]
    assert set(found) <= near and len(set(found)) == len(found) and (dense < 32 or set(found) == near)
    assert groups(range(len(prints)), found) == groups(range(len(prints)), near)
    assert simhash.near_links(spark.createDataFrame([], "fp long"), bits, dense).count() == 0


def tables_of(monkeypatch):
    """Rows of all tables that are written, by name."""
    rows, save = {}, Workspace.save

    def counted(self, df, table):
        out = save(self, df, table)
        rows[table] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    return rows


def test_similar_starts_from_fingerprints(spark, monkeypatch):
    rng = random.Random(12)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t[:-1], "end"])) for i, t in enumerate(texts)]
    made = tables_of(monkeypatch)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), words=5, like=0.8)
    assert {r.doc_id for r in kept.collect()} == set(range(30))
    assert made["close"] == 30 and made["near-links"] > 10 and made["pairs"] == 0  # all were found by their fingerprints


def test_similar_in_a_group_of_near_copies_without_its_pairs(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):  # copies of one text, most of which are alike to no other
        w = list(base)
        for _ in range(rng.choice((2, 4, 8, 9, 10))):
            w[rng.randrange(200)] = f"x{i}-{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    made = tables_of(monkeypatch)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    alike = [(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == groups(range(400), alike) and len(set(got.values())) > 30
    sent = {t: n for t, n in made.items() if t in ("first-sent", "second-sent", "family-sent", "pairs", "cross-pairs")}
    assert max(sent.values()) < 400 * 10 and made["family-sent"] > 0, sent


def test_compare_edited_with_clashing_columns_and_long_texts(spark):
    long = "the cat sat on a mat " * 60_000
    rows = [(2, long, "x", 1), (1, long, None, 2), (1, long, None, 2), (None, None, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, place int")
    got = spotsigs.compare_edited(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(long), len(long), len(long)] and len({r.fingerprint for r in got if r.n_chars}) == 1
    assert {r.near_next for r in got if r.doc_id == 2} == {1.0} and spotsigs.compare_edited(df.limit(0)).count() == 0


def test_places_among_many_bounds(spark):
    rng = random.Random(7)
    bounds = sorted({rng.randrange(-500, 500) for _ in range(230)}, reverse=True)
    got = spark.range(-510, 510).select("id", spotsigs._place(spotsigs.F.col("id"), bounds).alias("p")).collect()
    assert all(r.p == sum(b > r.id for b in bounds) for r in got)
    assert spark.range(3).select(spotsigs._place(spotsigs.F.col("id"), []).alias("p")).distinct().collect()[0].p == 0
