"""Near copies and repeated passages against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import near, suffix
from tidemark.llm.near import dart_signatures, near_classes, without_copies
from tidemark.llm.suffix import suffix_report


def words(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def near_texts():
    rng = random.Random(4)
    base, out = [words(rng, n) for n in (40, 120, 300)], []
    for b in base:
        out.append(" ".join(b))
        for _ in range(8):
            copy = list(b)
            for _ in range(rng.randint(0, len(b) // 40)):
                copy[rng.randrange(len(copy))] = "edited"
            out.append(" ".join(copy))
    out += [" ".join(words(rng, rng.randint(1, 60))) for _ in range(20)]
    return [(i, t) for i, t in enumerate(out)] + [(100, "a b c"), (101, "A  b\nc"), (102, None), (103, ""), (None, "a b c"), (None, None), (104, "q " * 4000)]


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_classes(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, node string")
    own = [(i, shingles(t)) for i, t in texts if i is not None]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(own):
        for j, y in own[a + 1 :]:
            common = sum((x & y).values())
            if common and common >= 0.8 * (sum(x.values()) + sum(y.values()) - common):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = [(r.doc_id, r.class_id) for r in near_classes(docs).collect()]
    assert len(got) == len(texts)
    assert {i: c for i, c in got if i is not None} == {i: find(i) for i in root}
    assert sorted(str(c) for i, c in got if i is None) == ["100", "None"]
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in root})


def test_near_shared_boilerplate(spark):
    """Pages alike in 85 % of their shingles aren't links, the two versions of each body are."""
    rng, pairs = random.Random(9), 100
    common, first, second = words(rng, 425), [], []
    for _ in range(pairs):
        body = [f"b{rng.randrange(10**9)}" for _ in range(75)]
        first.append(common + body)
        second.append(common + body[:25] + [f"c{rng.randrange(10**9)}" for _ in range(50)])
    texts = [" ".join(t) for t in first + second]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x, y in zip(map(shingles, texts[:pairs]), map(shingles, texts[pairs:]), strict=True):
        assert 0.8 <= sum((x & y).values()) / sum((x | y).values()) < 0.83
    assert {r.doc_id: r.class_id for r in near_classes(docs).collect()} == {i: i % pairs for i in range(2 * pairs)}


def test_near_counts_every_document(spark, monkeypatch):
    """The prefix filter's order comes from the cells of all documents that it filters."""
    rng = random.Random(17)
    texts = [" ".join(words(rng, 9)) for _ in range(60_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sent, context = [], type(spark.sparkContext)
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    links = near.Links(docs)
    links.by_prefixes(docs.select("doc_id"), len(texts))
    counted = [x for x in sent if isinstance(x, np.ndarray)]
    assert [int(x.sum()) for x in counted] == [5 * len(texts)] and links.edges is None


def test_near_repeated_ids(spark):
    """Rows with one doc_id are one document: its texts join classes, and one row of a class stays."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(words(rng, 30)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (2, d), (2, None), (11, d + " end"), (None, b), (6, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id) for r in near_classes(docs).collect())
    assert got == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (9, 9), (2, 2), (2, 2), (11, 2), (-1, 3), (6, 6), (8, 8)])
    kept = [tuple(r) for r in without_copies(docs).collect()]
    assert sorted(i for i, _ in kept) == [2, 3, 6, 8, 9] and (3, a) in kept and (9, c) in kept and set(kept) <= set(rows)


def test_near_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(docs).count() == 0 and without_copies(docs).count() == 0


def test_darts_are_unbiased():
    rng, agree = np.random.default_rng(1), []
    for _ in range(60):
        a = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        b = np.r_[a[:50], rng.integers(0, 1 << 62, 300).astype(np.uint64)]
        s = dart_signatures(np.r_[a, b], np.array([60, 350]))
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - 50 / 360) < 0.02


def test_darts_of_many_short_texts():
    rows, size = 10_000, 8
    hashes = np.random.default_rng(2).integers(0, 1 << 62, rows * size)
    ids, lists = pa.array(np.arange(rows)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(hashes))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, lists], ["doc_id", "c1", "c2", "words"])
    tracemalloc.start()
    made = list(near._signed(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert [d for x in made for d in x.column("doc_id").to_pylist()] == list(range(rows))
    bands = [b for x in made for b in x.column("bands").to_pylist()]
    for at in range(0, rows, 500):  # each as if it were alone
        (alone,) = near._signed(iter([batch.slice(at, 1)]))
        assert alone.column("bands").to_pylist() == [bands[at]]


def brute(texts, n=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                covered[i : i + n] = True
        runs = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


def test_suffixes(spark, monkeypatch):
    rng, letters = random.Random(3), "abcdefgh é\n"
    base, texts = "".join(rng.choices(letters, k=3000)), []
    for _ in range(40):
        at, n = rng.randint(0, 2500), rng.choice([150, 195, 199, 200, 201, 230, 400])
        texts.append("".join(rng.choices(letters, k=rng.randint(0, 90))) + base[at : at + n] + "".join(rng.choices(letters, k=rng.randint(0, 90))))
    texts += ["a" * 500, "ab" * 400, None, "", base[:300], base[:300], "x" * 199, "x" * 199]
    ids = [*range(len(texts) - 2), None, 7]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, k string")
    expected = Counter(zip(ids, brute(texts), strict=True))
    for many in (20_000, 3):
        monkeypatch.setattr(suffix, "MANY", many)
        got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_report(docs).collect())
        assert got == expected
    assert suffix_report(docs.limit(0)).count() == 0


def test_suffixes_in_a_long_text(spark):
    """A long text that repeats itself and others, with columns that bear the operator's own names."""
    rng = random.Random(14)
    long = "".join(rng.choices("abcdefgh ", k=400_000))
    texts = [long + "x" + long[5000:9000] + "é" + long[100:298], long[20_000:20_199], long[30_000:30_200], None]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, name int, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_report(docs).collect()}
    data = [(t or "").encode() for t in texts]
    first = data[0]
    kept = first[:5000] + first[9000:30_000] + first[30_200 : 400_000 + 1] + first[404_001:]
    assert got[0] == (len(first), 4000 + 200 + 4000, 3, hashlib.sha256(kept).hexdigest())
    assert got[1] == (199, 0, 0, hashlib.sha256(data[1]).hexdigest()) and got[2] == (200, 200, 1, hashlib.sha256(b"").hexdigest())
    assert got[3] == (0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_tiles(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    whole = suffix.samples(data)
    monkeypatch.setattr(suffix, "TILE", 300)
    for a, b in zip(whole, suffix.samples(data), strict=True):
        assert (a == b).all()
