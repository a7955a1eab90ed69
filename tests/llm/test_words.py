"""Phrases, benchmark passages and spellings against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import contamination, phrases, spellings
from fieldcast.llm.queries import QUERIES, SQL

from .conftest import SF

ASCII_LOWER = {b: b + 32 for b in range(65, 91)}


# --- phrases -----------------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    counts = defaultdict(Counter)
    totals = Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and m >= least and p in (q[:2], q[1:]) and 100 * m >= 50 * a for q, m in f.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def wild_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "a", "a\x01", "a\x00b", "\x01", "x\x08y", "of", "new", "york", "york.", "city", "é", "É", "été,", " ", "z "]
    gaps = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", ". ", "; "]
    rows = []
    for _ in range(n):
        k = rng.randrange(0, 40)
        rows.append(("".join(rng.choice(words) + rng.choices(gaps, [20, 2, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(k)), rng.choice(["en", "en", "und", None, "d\x00e"])))
    return rows


@pytest.mark.parametrize("least,top", [(1, 10_000), (3, 7)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = wild_texts(5, 120) + [(None, "en"), ("", "en"), ("new york city " * 300, "en"), (". ,", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash")).withColumn("gram", F.lit(1))
    got = sorted(map(tuple, phrases.collocations(docs, least, top).collect()))
    assert got == phrases_by_hand(rows, least, top)


def test_phrases_of_a_hot_word_and_repeated_rows(spark):
    rows = [(" ".join(f"the w{i % 50} the w{i % 7}" for i in range(j, j + 30)), "en") for j in range(60)] * 2
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == phrases_by_hand(rows, 10, 2000) and got


def test_phrases_of_nothing(spark, no_docs, odd_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert sorted(map(tuple, phrases.collocations(odd_docs).collect())) == phrases_by_hand(rows, 10, 2000)


def test_phrases_do_not_depend_on_block_size(monkeypatch):
    texts = [t.encode() for t, _ in wild_texts(9, 50)]

    def counted():
        total = Counter()
        batch = pa.RecordBatch.from_arrays([pa.array([b"en"] * len(texts), pa.binary()), pa.array(texts, pa.binary())], names=["lang", "text"])
        for run in phrases._count(iter([batch])):
            keys = run.column(0).to_pylist()
            assert keys == sorted(keys)
            for k, n in zip(keys, run.column(1).to_pylist()):
                total[k] += n
        return total

    whole = counted()
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 100)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    assert counted() == whole


def test_scan_hands_on_what_a_partition_knows_partly():
    keys = sorted([b"en\0a\0b\0c", b"en\0a\0b\0d", b"en\0a\0c", b"en\0b\0c\0d", b"en\0c"])
    n = [4, 5, 6, 7, 8]

    def scanned(parts):
        total = Counter()
        for part in parts:
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["gram", "n"])
            for out in phrases._scanner(9)(iter([batch])):
                for *p, c in zip(*[out.column(i).to_pylist() for i in range(5)]):
                    total[tuple(p)] += c
        return {k: c for k, c in total.items() if c >= 9 or k[1] is None}

    rows = list(zip(keys, n))
    want = {(b"en", None, None, None): 30, (b"en", b"a", None, None): 15, (b"en", b"a", b"b", None): 9}
    assert scanned([rows]) == want
    for cut in range(len(rows) + 1):
        assert scanned([rows[:cut], rows[cut:]]) == want


def test_score_of_large_counts(spark):
    a, left, right = 3_000_000_000_000, 3_000_000_000_001, 4_000_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score("a", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (left * right)


# --- benchmark passages ------------------------------------------------------------------------------------------


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def hits_by_hand(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_by_hand(text)
        z = min(len(w), window)
        for i in range(len(w) - z + 1 if w else 0):
            windows[tuple(w[i : i + z])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words_by_hand(text)
        hit, ids = set(), set()
        for z in sizes:
            for i in range(len(w) - z + 1):
                if tuple(w[i : i + z]) in windows:
                    hit |= set(range(i, i + z))
                    ids |= windows[tuple(w[i : i + z])]
        names = ",".join(sorted(ids))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr), hit


PASSAGE = "One two three, four five six seven eight nine ten eleven twelve thirteen"


def benchmark_cases():
    rng = random.Random(3)
    items = [(1, PASSAGE), (2, "Straße über alles"), (None, "tiny"), (3, None), (4, ""), (5, "... !!"), (2, "another Item of id two, a longer one with twelve words in all here"), (10, PASSAGE), (7, "a b a b a b a b a b a b")]
    vocabulary = "a b one two three four tiny Tiny über ÜBER alles Straße x9 9x É".split()
    docs = [(i, rng.choice(["", " ", "-"]).join([" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))])) for i in range(60)]
    docs += [(100, "before " + PASSAGE.upper() + " after"), (101, PASSAGE.replace(" ", "\n--")), (101, PASSAGE), (None, PASSAGE), (102, None), (103, ""), (104, "x " * 5_000 + PASSAGE + " y" * 5_000), (105, PASSAGE + " " + PASSAGE), (106, "a b " * 40)]
    return docs, items


def test_contamination_equals_brute_force(spark):
    docs, items = benchmark_cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("w", "h", "digest", "words", "size", "n_hit")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    for window in (10, 3):
        got = sorted(map(tuple, contamination.judge(d, b, window).collect()), key=repr)
        assert got == hits_by_hand(docs, items, window)[0]


def test_contamination_in_parts(spark):
    docs, items = benchmark_cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").select(contamination._digest(F.col("text")).alias("digest"), contamination.words_of(F.col("text")).alias("w"))
    w = contamination.benchmark_windows(spark.createDataFrame(items, "item_id long, text string")).select("size", "h", "words").distinct()
    whole = {tuple(r) for r in contamination.hits(d, w).collect()}
    assert len(contamination._parts(w, 4, 1 << 20)) > 2 and len(contamination._parts(w, 1 << 20, 50)) > 2
    assert {tuple(r) for r in contamination.hits(d, w, most=4).collect()} == whole and whole


def test_contamination_of_nothing(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in contamination.judge(odd_docs, none).collect()} == {False}
    assert contamination.judge(no_docs, none).collect() == []
    assert contamination.judge(odd_docs, odd_docs.withColumn("item_id", F.col("doc_id"))).count() == odd_docs.count()


def test_contamination_runs_without_python_and_holds_the_words_once(spark):
    docs, items = benchmark_cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    df = contamination.judge(d, spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hit_words_are_cut_out(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "tiny")], "item_id long, text string")
    rows = [(1, "(before) " + PASSAGE + "! After."), (2, "Clean, it stays!  "), (3, None), (4, "tiny"), (5, " Tiny-tiny end"), (1, PASSAGE + " " + PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = sorted((r.doc_id, r.text or "") for r in contamination.clean(docs, bench).collect())
    assert got == sorted([(1, "(before) After."), (2, "Clean, it stays!  "), (3, ""), (4, ""), (5, " end"), (1, "")])
    assert sorted(r.doc_id for r in contamination.clean(docs, bench, "documents").collect()) == [2, 3]
    assert contamination.clean(docs, bench).columns == docs.columns
    with pytest.raises(ValueError):
        contamination.clean(docs, bench, "lines")


# --- spellings ---------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings_by_hand(rows, letters=5, least=3, factor=2):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= letters and c >= least}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n.get(form[w])))
    return sorted(out)


def spelling_cases(seed, alphabet="abé", n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(alphabet, k=rng.choice([4, 5, 5, 5, 6, 6, 7]))) for _ in range(rng.randrange(0, 20))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abé"])
def test_spellings_equal_brute_force(spark, alphabet):
    rows = spelling_cases(2, alphabet) + [(None, "aaaaa bbbbb"), (5, None), (6, ""), (7, "×÷aaa ÀÀÀÀÀ ÀÀÀÀÀ ÀÀÀÀÀ ààààà"), (8, "aaaaa " * 700), (8, "aaaaa " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "form", "prefix")})
    got = sorted(map(tuple, spellings.group_spellings(docs).collect()))
    want = spellings_by_hand(rows)
    assert got == want
    assert any(r[1] for r in want) and any(r[1] is None for r in want)


def test_neighbours_are_all_pairs_once(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 7))) for _ in range(80)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(map(tuple, spellings.neighbours(df).collect()))
    assert got == sorted((a, b) for a in words for b in words if near(a, b))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w3"), ("y", "z")]
    got = dict(map(tuple, spellings.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "x": "w40", "y": "z"}
    assert spellings.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_spellings_of_nothing(spark, no_docs, odd_docs):
    assert spellings.group_spellings(no_docs).collect() == []
    found = {r.word: r for r in spellings.group_spellings(odd_docs).collect()}
    assert set(found) and all(r.n >= 3 and len(w) >= 5 for w, r in found.items())


def test_spellings_query_equals_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = sorted(map(tuple, QUERIES["op13_spellings"](spark, SF).collect()))
    want = spellings_by_hand(docs)
    assert got == want


def test_word_queries_have_sql():
    assert {"op11_phrases", "op12_decontamination"} <= set(SQL)
