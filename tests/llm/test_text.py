"""Quality rules, line dedup, license scans and chat formatting against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat import LAYOUTS, MAPPINGS, chat_report, escape, format_turns, read_turns, record_of, records_to_turns, rows_to_turns, through_records, unescape
from tidemark.llm.licenses import BASE, COVER, TEMPLATES, VOCABULARY, scan_licenses
from tidemark.llm.lines import line_dedup
from tidemark.llm import licenses, quality
from tidemark.llm.quality import quality_rules

DOCS = "doc_id long, text string, n_lines string, score string"
LONG = "this very line is long enough to be counted as a line"
TEXTS = [
    (1, f"{LONG}\nonly here\n{LONG.upper()}  "), (2, f"\t{LONG}\nb"), (3, LONG), (4, LONG), (5, f"x\n{LONG}\n"), (6, None), (7, ""), (None, LONG),
    (8, "a b c a b c d"), (9, "word " * 3000), (9, "word " * 3000), (10, " \n\n \n" + "q " * 60), (11, "### $$$ && a" * 40), (12, "short\nshort\nshort"),
    (13, "cc by cc by-CC BY"), (14, "GNU General Public License; all rights reserved"), (15, "Released under the MIT License."), (16, "é licensed under the apache license, version 2.0"),
]
WS = "[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in TEXTS], DOCS)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(8, 1, 0), (15, 1, 0), (11, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = r.text or ""
        w = re.findall(WS, t)
        lines = [x for x in t.split("\n") if re.search(WS, x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        expected = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    empty = quality_rules(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def brute_scores(rows, labels):
    """Score and verdict of (doc_id, text) rows, counted plainly; hashes are those of the fixed 64-bit function."""
    import regex
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    def bucket(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return signed(h) % quality.BUCKETS

    token = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+")
    grams = []
    for _, t in rows:
        w = token.findall(t or "")
        grams.append([bucket(x) for x in w] + [bucket(*p) for p in zip(w, w[1:], strict=False)])

    def half(i):
        h = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), seed=42)
        return signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=h) if i is not None else h) % 2

    raw, target = Counter(), (Counter(), Counter())
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if i in labels:
            target[half(i)].update(g)
    total = sum(raw.values()) + quality.BUCKETS
    weight = lambda k, b: round(quality.SCALE * math.log((target[k][b] + quality.PRIOR) / ((raw[b] + 1) / total * sum(target[k].values()) + quality.PRIOR)))
    scores = [sum(weight(1 - half(i), b) for b in g) / quality.SCALE / len(g) if g else 0.0 for (i, _), g in zip(rows, grams, strict=True)]
    own = sorted(s for (i, t), s in zip(rows, scores, strict=True) if i in labels and len(re.findall(WS, t or "")) >= quality.MIN_WORDS)
    if not own:
        return scores, -math.inf
    at = quality.QUANTILE * (len(own) - 1)
    return scores, own[int(at)] + (at % 1) * (own[min(int(at) + 1, len(own) - 1)] - own[int(at)]) - quality.MARGIN


def test_quality_scores(spark):
    rng = random.Random(8)
    good = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", f"w{rng.randint(0, 300)}", "é,"]) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "NOW!!", f"x{rng.randint(0, 300)}%%"]) for _ in range(n))
    rows = [(i, good(rng.randint(60, 90)) if i % 4 else junk(80)) for i in range(160)] + [(None, good(70)), (1, good(60)), (500, None), (501, "a b")]
    marks = {i: int(i % 4 > 0) for i in range(0, 160, 2)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()] + [(None, 1, 0), (9999, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    scores, cut = brute_scores(rows, {i for i, q in marks.items() if q})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules(docs, labels).collect()
    assert sorted((r.doc_id or -1, r.text or "", round(r.score, 9)) for r in got) == sorted((i or -1, t or "", round(s, 9)) for (i, t), s in zip(rows, scores, strict=True))
    assert all(r.kept == (not r.base_failed and r.score >= cut) for r in got)
    assert all(r.kept == (r.doc_id is None or r.doc_id % 4 > 0) for r in got if not r.base_failed)
    # without labels the plain rules alone decide
    assert all(r.score == 0 and r.kept != r.base_failed for r in quality_rules(docs, labels.limit(0)).collect())
    # the same documents in a table four times as large: the same verdicts
    more = [(1000 + i, good(70) if i % 4 else junk(80)) for i in range(480)]
    wide = {(r.doc_id, r.text): r.kept for r in quality_rules(spark.createDataFrame(rows + more, "doc_id long, text string"), labels).collect()}
    assert all(wide[r.doc_id, r.text] == r.kept for r in got)


def test_quality_whole_target(spark):
    """Every document labelled good is counted and bears on the cut, however many labels there are."""
    rng, many = random.Random(15), 240_000
    text = lambda kind: " ".join(f"{kind}{rng.randint(0, 40)}" for _ in range(60))
    rows = [(i * 1000, text("a" if i % 3 else "b")) for i in range(240)] + [(-i, text("b")) for i in range(1, 60)]
    labels = spark.range(many).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    scores, cut = brute_scores(rows, set(range(0, many, 1000)))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert {i: round(got[i].score, 9) for i, _ in rows} == {i: round(s, 9) for (i, _), s in zip(rows, scores, strict=True)}
    assert all(got[i].kept == (not got[i].base_failed and s >= cut) for (i, _), s in zip(rows, scores, strict=True))


def test_quantile(spark):
    rng = random.Random(16)
    for values in ([], [0.25], [1.0, -8.0], [rng.gauss(0, 0.5) for _ in range(3000)], [rng.choice([-0.1, 0.0, 3.5]) for _ in range(500)]):
        scores = spark.createDataFrame([(v,) for v in values], "score double")
        for q in (0.0, 0.005, 0.3, 1.0):
            assert quality.quantile(scores, q) == scores.agg(F.percentile("score", F.lit(q))).first()[0]


def test_lines(docs):
    cut = {(r.doc_id, r.text): r for r in line_dedup(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    held = {}
    for i, t in TEXTS:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    hot = {k: max(i for i in v if i is not None) for k, v in held.items() if len(v) >= 5}
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), i) == i]
        text = t if len(kept) == len(lines) else "\n".join(kept)
        row = cut[i, text]
        assert (row.n_lines, row.n_dropped) == (len(lines), len(lines) - len(kept))
    assert len(cut) == len(set(TEXTS))


def test_licenses(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = scan_licenses(docs).collect()
    texts = {i: t for i, t in TEXTS if i is not None}
    for r in (r for r in rows if r.doc_id is not None):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").translate(low))
        found = [(i, l) for i in range(len(w)) for p, l in BASE.items() if w[i : i + len(p.split())] == p.split()]
        labels = {l for _, l in found}
        for t in TEMPLATES:
            words, k = t.text.split(), t.key.split()
            o = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            for d in range(-len(words), len(w)):
                same = sum(0 <= d + q < len(w) and w[d + q] == words[q] for q in range(len(words)))
                if d + o >= 0 and w[d + o : d + o + len(k)] == k and same / len(words) >= COVER:
                    labels.add(t.label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1
    assert len(rows) == len(TEXTS)


def test_licenses_all_in_one(spark):
    """A document of all notices and all licence words has all labels, also among documents that make words common."""
    both = " x ".join(t.text for t in TEMPLATES) + " " + " ".join(VOCABULARY)
    rows = [(1, both), (2, "use free copy public source terms person 0 2 " * 5 + both)] + [(i, "licensed license affero mozilla released mit cc lesser gnu") for i in range(3, 9)]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = ",".join(sorted({t.label for t in TEMPLATES} | {"gpl", "cc-by"}))
    assert got[1] == got[2] == expected and got[3] == ""


def test_licenses_frequencies(spark, monkeypatch):
    """Words are counted over all documents, also those that hold no word worth a look."""
    texts = ["the MIT license", "use free copy; a copy", "Free software version 2", "version 2", None, "the apache license version 2"]
    seen, found = [], licenses.found_labels
    monkeypatch.setattr(licenses, "found_labels", lambda words, rarity: seen.append(rarity) or found(words, rarity))
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [set(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    assert seen == [[round(1000 * math.log((1 + len(texts)) / (1 + sum(w in x for x in sets)))) for w in VOCABULARY]]
    assert {r.doc_id: r.labels for r in rows} == {0: "mit", 1: "", 2: "", 3: "", 4: "", 5: "apache-2.0"}


def test_chat_layouts(spark):
    two = [("user", "x"), ("assistant", "y")]
    cases = {
        '{"prompt":"a","response":"b"}': ("prompt_response", [("user", "a"), ("assistant", "b")]),
        '{"id":7,"prompt":"a","meta":{"date":[1,{"z":null}]},"response":"b","system":"s"}': ("prompt_response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        '{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"<|end|>"}]}': ("messages", [("user", "x"), ("assistant", "<|end|>")]),
        '{"messages":[{"role":"user","content":"x","at":3},{"role":"gpt","content":"y","name":"n"}],"source":"web"}': ("messages", two),
        '{"messages":[{"role":"user","content":[{"type":"text","text":"x"},{"text":"z"}]},{"role":"assistant","content":[{"text":"y"}]}]}': ("message_parts", [("user", "x\nz"), ("assistant", "y")]),
        '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}': ("shared", two),
        '{"instruction":"i","input":"n","output":"o"}': ("instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        '{"instruction":"i","output":3}': ("instruction", [("user", "i"), ("assistant", "3")]),
        '{"data":{"input":"x","output":"y","id":1},"id":2}': ("nested_pair", two),
        '{"question":null,"answer":"\\ud800!"}': ("question_answer", [("user", ""), ("assistant", "?!")]),
        '{"prompt":"a","response":"b","answer":"c"}': (None, []),
        '{"messages":[]}': (None, []),
        '{"z":1}': (None, []),
        "[1]": (None, []),
        "no json": (None, []),
        "": (None, []),
        "[" * 100_000: (None, []),
    }
    records = spark.createDataFrame([*enumerate(cases), (-1, None)], "conv_id long, record string")
    found = {r.conv_id: r for r in records_to_turns(records).withColumn("back", read_turns(format_turns(F.col("turns")))).collect()}
    for i, expected in enumerate(cases.values()):
        assert (found[i].layout, [tuple(x) for x in found[i].turns]) == expected
        assert found[i].back == found[i].turns
    assert (found[-1].layout, found[-1].turns) == (None, [])
    assert len(MAPPINGS) == sum(len(x.keys) for x in LAYOUTS)  # no fingerprint selects two


def test_chat_records(spark):
    """Every conversation comes back from its record, whatever its roles and texts; several layouts are met."""
    rng, parts = random.Random(6), ["<|turn|>\\", "</s>[INST]", "\x00", "é😀", "\n\n", "\\n", '"', "", "system", "a  b"]
    rows = []
    for conv in range(120):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user", "assistant"], ["Human", "gpt"], ["tool", "user\nx\\n", ""], ["user"]])
        rows += [(conv, i, r, rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 4)))])) for i, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (None, 1, None, None), (500, None, "user", "x" * 300_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, layout string")
    expected = {}
    for c, _, r, t in rows:
        expected.setdefault(c, []).append((r or "", t or ""))
    got = through_records(table).withColumn("back", read_turns(format_turns(F.col("turns")))).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == expected and all(r.back == r.turns for r in got)
    records = rows_to_turns(table.drop("layout")).withColumn("record", record_of(F.col("turns"), F.col("conv_id")))
    layouts = Counter(r.layout for r in records_to_turns(records).collect())
    assert set(layouts) == {"prompt_response", "question_answer", "messages", "shared", "message_parts", None}


def test_chat_rows(spark):
    said = ["<|turn|>\\", "</s>[INST] ok [/INST]", "", None, "a\nb<|", "\\<|end|>\\\\"]
    rows = spark.createDataFrame([(i // 3, None if i == 4 else 2 - i % 3, "assistant" if i % 2 else "us\ner", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    texts = spark.createDataFrame([(t or "",) for t in said], "t string")
    assert texts.where(unescape(escape(F.col("t"))) != F.col("t")).count() == 0
    got = {r.conv_id: r for r in chat_report(through_records(rows)).collect()}
    for conv in (0, 1):
        own = sorted(((r.turn is None, r.turn or 0, r.role, r.text or "") for r in rows.collect() if r.conv_id == conv))
        turns = [(x[2], x[3]) for x in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (3, len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_report(through_records(rows.limit(0))).count() == 0
    with pytest.raises(ValueError):
        rows_to_turns(rows.drop("role"))
