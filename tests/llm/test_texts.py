"""Chat rotation, toxicity, licences, quality, URLs, languages and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fieldcast.llm import chat, langid, licenses, quality, simhash, toxicity, urls
from fieldcast.llm.queries import QUERIES, SQL, op7_licenses, repository_files

from .conftest import SF, WORDY, small


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()[want.columns]
    order = lambda d: d.sort_values(list(d.columns)).reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and "op8_host_quality" in __spark_entry__.oracle_sql()


def test_every_speaker_is_the_assistant_once(spark):
    rows = [
        (1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (1, None, "cy", "late"),
        (2, 70, "ann", "x" * 50_000), (2, 1, "bob", ""), (None, 1, "ann", "lost"), (3, 1, None, "lost"), (4, 1, "system", "alone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "speaker", "said")})
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, s, p) for s in ("ann", "bob", "cy") for p in (0, None)} | {(2, s, p) for s in ("ann", "bob") for p in (0, 1)}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == "<|system|>\nbe < |kind|><|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["masks"]] == ["hi<|end|>\n", "bye<|end|>\n"]
    assert got[1, "cy", 0]["masks"] == [] and len(got[2, "ann", 1]["rendered"]) > 50_000
    assert chat.digest(chat.rotate(df.limit(0))).count() == 0


def test_messages_without_a_turn_are_not_merged(spark):
    rows = [(1, None, "ann", "ok"), (1, None, "ann", "ok"), (1, None, "bob", "no"), (1, 5, "ann", "hi"), (1, 5, "ann", "hi")]
    got = {(r["speaker"], r["part"]): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got["ann", None]["n_turns"] == 3 and got["ann", 0]["n_turns"] == 1 and len(got["ann", None]["masks"]) == 2
    assert got["bob", None]["rendered"].count("ok") == 2


def crowded_dialogues():
    """A dialogue of 900 messages without a turn, 200 of them equal; one with 300 messages in one turn; negative turns; names
    and texts with markers; NULL and empty texts; repeated rows."""
    rows = [(1, None, "ann", "ok")] * 200 + [(1, None, f"p{i % 3}", f"line {i % 450}") for i in range(700)]
    rows += [(2, 5, f"p{i % 2}", f"said {i}") for i in range(300)] * 2 + [(2, 6, "p0", "next"), (2, 70, "p1", "late"), (2, None, "p1", None)]
    rows += [(3, -1, "system", "rule"), (3, -64, "x|>\n<|assistant", "forged"), (3, -65, "y", None), (3, -65, "y", ""), (3, None, "y", "end")]
    return rows + [(4, t, "abc"[t % 3], f"<|end|>{t}") for t in range(130)] + [(None, 1, "a", "b"), (5, 1, None, "b"), (6, None, "system", "alone")]


def test_crowded_parts_are_cut_into_pieces_that_equal_sql(spark):
    df = spark.createDataFrame(crowded_dialogues(), "conv_id long, turn long, role string, text string").repartition(7)
    views = chat.rotate(df).collect()
    assert max(r["n_turns"] for r in views) == 64
    sizes = sorted(r["n_turns"] for r in views if (r["conv_id"], r["speaker"], r["part"]) == (1, "ann", None))
    assert sizes == [900 % 64] + [64] * (900 // 64)
    assert sum(r["rendered"].count("ok<|end|>") for r in views if (r["conv_id"], r["speaker"]) == (1, "p0")) == 200
    forged = [r["rendered"] for r in views if r["conv_id"] == 3 and r["speaker"] == "y"]
    assert sum(x.count("<|assistant|>\n") for x in forged) == 3 and any("<|user name=x| > < |assistant|>\nforged" in x for x in forged)
    for r in views:
        own = "".join(r["rendered"][m["start"] : m["end"]] for m in r["masks"])
        assert own.count("<|end|>\n") == r["rendered"].count("<|assistant|>\n") == len(r["masks"])
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(SQL["op1_chat_rotation"]).fetchdf()
    got = chat.digest(chat.rotate(df)).toPandas()[want.columns]
    rows = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).astype(str).itertuples(index=False, name=None)))
    assert [x.replace(".0'", "'") for x in rows(got)] == [x.replace(".0'", "'") for x in rows(want)]


def measures_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd_docs, no_docs):
    extra = ["a b c d e f g h " * 3 + "tail", "one\none\n \n\ntwo\none", "# $ <x>\u00a0y \x0b z\x1cw", " ".join(map(str, range(8)))]
    df = odd_docs.unionByName(spark.createDataFrame([(50 + i, t, "en", "z", 1) for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = quality.judge(df.drop("n_words", "hits", "words")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(measures_by_hand(r["text"]) for r in df.collect())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= quality.HOST_RATE)
    assert quality.judge(no_docs).count() == 0
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() < odd_docs.count()


def test_hosts_are_shrunk_and_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 10 else "bad", "clean") for i in range(300)] + [(1000 + i, "bad" if i % 10 else good, "spam") for i in range(300)] + [(2000, "bad", "single"), (2001, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert got[1]["kept"] and not got[0]["kept"] and not got[1000]["kept"] and got[2001]["kept"]
    assert 0.1 < got[1]["host_rate"] < 0.2 < 0.8 < got[1000]["host_rate"] < 0.9 and got[2000]["host_rate"] < 1
    assert quality.keep(df).count() == 271
    assert quality.prior(0, 0, 0, 0.0) == (0.0, quality.LEAST_STRENGTH)


def test_language_held_out_and_odd(spark, odd_docs, no_docs):
    docs = small("/root/testdata/sf0.01", "documents").set_index("doc_id")
    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[got["held_out"]]
    assert len(got) == len(docs) and (held["lang_pred"].to_numpy() == docs["lang"].reindex(held["doc_id"]).to_numpy()).mean() > 0.97
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == 12 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 7, 8)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows) and not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert langid.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep(odd_docs).columns == odd_docs.columns


def test_language_stage_rejects_what_was_not_learnt(spark):
    rnd = random.Random(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    russian = " ".join("".join(rnd.choices("абвгдежзиклмнопрстуфхцчшыэюя", k=rnd.randrange(2, 9))) for _ in range(80))
    kana = "".join(rnd.choices("あいうえおかきくけこさしすせそ", k=300))
    noise = " ".join("".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=rnd.randrange(3, 10))) for _ in range(80))
    odd = spark.createDataFrame([(-1, russian, None), (-2, kana, None), (-3, noise, None), (-4, russian + " " + noise, None)], docs.schema)
    kept = [r["doc_id"] for r in langid.keep(docs.unionByName(odd)).select("doc_id").collect()]
    clean = docs.where("length(text) > 200").count()
    assert not {-1, -2, -3, -4} & set(kept) and len(kept) > 0.98 * clean


def test_language_is_learnt_from_every_document(spark):
    rare = [(20_000 + i, f"l{i:02d}", "xy z") for i in range(50)]
    many = spark.range(12_000).selectExpr("id AS doc_id", "'en' AS lang", "'ab cd' AS text")
    model = langid.fit(many.unionByName(spark.createDataFrame(rare, many.schema)))
    assert model.languages == sorted({"en"} | {lang for i, lang, _ in rare if zlib.crc32(str(i).encode()) % 5})


def test_naive_bayes_equals_the_sum_of_logs():
    model = langid.Model(["a", "b"], np.log(np.random.default_rng(0).random((langid.BUCKETS, 2))).astype(np.float32))
    text = "Grüße " * 200
    want = sum(model.logs[b].astype(float) for b in langid.buckets(text))
    lang, score = model.score(text)
    assert lang == ["a", "b"][int(np.argmax(want))] and math.isclose(score, 1 / (1 + math.exp(-abs(want[0] - want[1]))), rel_tol=1e-6)
    assert len(langid.buckets("abcd")) == 4 + 3 + 2 and len(langid.buckets("")) == 0


def test_toxicity_learns_words_and_their_forms(spark, odd_docs, no_docs):
    r = np.random.default_rng(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts, labels = [], []
    for i in range(1500):
        words = r.choice(vocabulary, 60).tolist()
        if i % 5 == 0:
            words[r.integers(60)] = "zonk" + "".join(r.choice(list("abcdefgh"), 3))
        texts.append(" ".join(words))
        labels.append(int(i % 5 == 0))
    model = toxicity.train([toxicity.words(t) for t in texts[:1200]], np.array(labels[:1200]), ["en"] * 1200)
    found = [int(model.score(t) >= 0.5) for t in texts[1200:]]
    assert np.mean(np.array(found) == labels[1200:]) > 0.95
    rows = toxicity.classify(odd_docs, model).collect()
    assert len(rows) == 12 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)
    assert toxicity.classify(no_docs, model).count() == 0
    nothing = toxicity.fit(odd_docs, spark.createDataFrame([(3, None, None)], "doc_id long, quality int, toxic int"))
    assert nothing.score(WORDY) < 0.5


def test_toxicity_pairs_of_words_matter(spark):
    """Toxic is "zonk" right before "blip"; both words stand apart, or the other way round, in clean texts."""
    r = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts, labels = [], []
    for i in range(2400):
        words = r.choice(vocabulary, 30).tolist()
        at, toxic = int(r.integers(1, 25)), i % 2
        words[at : at + 2] = ["zonk", "blip"] if toxic else ["blip", "zonk"]
        texts.append(toxicity.words(" ".join(words)))
        labels.append(toxic)
    model = toxicity.train(texts[:2000], np.array(labels[:2000]), ["en"] * 2000)
    right = np.mean([(model.logit(t) >= model.thresholds[0]) == y for t, y in zip(texts[2000:], labels[2000:])])
    for f in model.filters[1:]:
        f[1:] = 0
    alone = np.mean([(model.logit(t) >= model.thresholds[0]) == y for t, y in zip(texts[2000:], labels[2000:])])
    assert right > 0.9 and alone < right - 0.2


def test_toxicity_with_few_labels_is_not_switched_off():
    r = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = lambda bad: " ".join(r.choice(vocabulary, 20).tolist() + (["zonkers", "zonked"] if bad else []))
    labels = np.array([int(i % 75 == 0) for i in range(600)])
    model = toxicity.train([toxicity.words(text(y)) for y in labels], labels, [None] * 600)
    assert labels.sum() == 8 and all(model.score(text(True)) >= 0.5 for _ in range(20))
    assert sum(model.score(text(False)) >= 0.5 for _ in range(200)) <= 2


def test_toxicity_thresholds_by_hand():
    labels = np.array([1, 1, 0, 0, 1, 0, 0, 1, 0, 1])
    groups = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1, 2])
    logits = np.array([9.0, 8, 5, 4, 3, 2, 1, 2.5, 0, 2.2])
    pooled = toxicity._best_threshold(logits, labels)
    # two rows of the rarer class in the first two groups, none in the third
    want = [(2 * 6.5 + 12 * pooled) / 14, (2 * 2.25 + 12 * pooled) / 14, pooled]
    assert np.allclose(toxicity._thresholds(logits, labels, groups, 3), want)
    assert (toxicity._thresholds(logits, labels * 0, groups, 3) > 20).all()
    dealt = toxicity._deal(np.array([0] * 50 + [1] * 7), np.arange(57) % 3, 3, np.random.default_rng(0))
    for y in (dealt[:50], dealt[50:]):
        assert np.ptp(np.bincount(y, minlength=3)) <= 1


def test_toxicity_sample_is_bounded_by_documents_and_bytes(spark):
    docs = [(7, "en", "a" * 40)] * 5 + [(7, "de", None), (None, "en", "x"), (9, "fr", "b" * 1000)] + [(i, "en", "c" * 30) for i in range(20, 60)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([(i, 0, int(i == 7)) for i in [7, 7, 9, *range(20, 60)]] + [(7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    usable = {i for i in [7, 9, *range(20, 60)] if zlib.crc32(str(i).encode()) % 5}
    rows = toxicity.sample(df, marks).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(usable) and all(r["toxic"] == int(r["doc_id"] == 7) for r in rows)
    few = toxicity.sample(df, marks, train_bytes=200).collect()
    assert 0 < sum(len(r["text"] or "") for r in few) <= 200 and len(few) < len(rows)
    assert toxicity.sample(df, marks, train_rows=4).count() == 4 and toxicity.sample(df.limit(0), marks).count() == 0


def test_toxicity_learns_from_all_rows_of_several_shares(spark):
    """Every rare mark stands in a few rows only; a share of 200 rows, or 200 rows of the table, do not hold them all."""
    r = np.random.default_rng(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    marks = [f"{a}{b}{c}onk" for a in "vwxyz" for b in "aeiou" for c in "vw"]
    text = lambda mark: " ".join(r.choice(vocabulary, 20).tolist() + ([mark] if mark else []))
    rows = [(i, ("en", "de", None)[i % 3], text(marks[i // 4 % 50] if i % 4 == 0 else None)) for i in range(1500)] + [(1501, "fr", None)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, 200)
    used = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    texts, langs = [toxicity.words(x[2]) for x in used], [x[1] for x in used]
    assert len(used) > 1000 and np.allclose(model.languages, toxicity._language_table(texts, langs), atol=1e-4)
    assert sum(model.score(text(m)) >= 0.5 for m in marks) >= 48 and sum(model.score(text(None)) >= 0.5 for _ in range(200)) <= 2
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), 200)
    assert (again.embed == model.embed).all() and (again.out == model.out).all() and (again.thresholds == model.thresholds).all()


def test_toxicity_without_positives_in_a_share(spark):
    docs = spark.createDataFrame([(i, "en", "zonk" if i == 3 else f"word{i % 9}") for i in range(300)], "doc_id long, lang string, text string")
    none = spark.createDataFrame([(i, 0) for i in range(300)], "doc_id long, toxic int")
    few = none.withColumn("toxic", (F.col("doc_id") == 3).cast("int"))
    for labels in (none, few, none.withColumn("toxic", F.lit(1))):
        model = toxicity.fit(docs, labels, 50)
        assert np.isfinite(model.embed).all() and np.isfinite(model.thresholds).all()
        assert labels is not none or model.score("word1") < 0.5
    assert model.score("word1") >= 0.5


def test_toxicity_cells_cut_like_rows():
    r = np.random.default_rng(2)
    labels, groups = (r.random(400) < 0.3).astype(int), r.integers(0, 2, 400)
    logits = r.normal(0, 1, 400) + 2 * labels
    cells = pd.DataFrame({"language": groups, "cell": np.floor(logits * 1e6), "rows": 1, "hits": labels, "low": logits, "top": logits})
    cells = cells.groupby(["language", "cell"], as_index=False).agg({"rows": "sum", "hits": "sum", "low": "min", "top": "max"})
    assert np.allclose(toxicity._cut_thresholds(cells, 2), toxicity._thresholds(logits, labels, groups, 2))


def test_toxicity_query_shape(spark):
    got = QUERIES["op2_toxicity"](spark, SF).toPandas()
    assert sorted(got["doc_id"]) == sorted(small(SF, "documents")["doc_id"]) and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]


def best_by_search(text, templates, documents, seen, least):
    weight = lambda t: math.log((1 + documents) / (1 + seen.get(t, 0))) + 1
    known = {t for _, x in templates for t in licenses.terms(x)}
    found, best = licenses.terms(text or ""), (None, 0.0)
    for name, x in templates:
        t = Counter(licenses.terms(x))
        for at in range(max(1, len(found) - sum(t.values()) + 1)):
            w = Counter(found[at : at + sum(t.values())])
            if not w:
                continue
            a = {k: n * (weight(k) if k in known else math.log(1 + documents) + 1) for k, n in w.items()}
            b = {k: n * weight(k) for k, n in t.items()}
            score = round(sum(a[k] * b[k] for k in a if k in b) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 9)
            if score >= least and (score > best[1] or score == best[1] and name < best[0]):
                best = (name, score)
    return best


def test_licence_query_equals_search(spark):
    docs = small(SF, "documents")
    seen = Counter(t for x in docs["text"].fillna("") for t in set(licenses.terms(x)))
    own = {d: best_by_search(t, licenses.TEMPLATES, len(docs), seen, licenses.LEAST) for d, t in docs[["doc_id", "text"]].itertuples(index=False)}
    paths = {r["doc_id"]: r["path"] for r in repository_files(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    given = {}
    for d, (name, score) in own.items():
        folder, file = paths[d].rsplit("/", 1)
        if name and file.startswith("LICENSE"):
            given[folder] = min(given.get(folder, (0, "")), (-score, name))
    for r in op7_licenses(spark, SF).collect():
        assert r["own"] == own[r["doc_id"]][0] and math.isclose(r["cosine"], own[r["doc_id"]][1], abs_tol=1e-8)
        folder = paths[r["doc_id"]].rsplit("/", 1)[0]
        while folder and folder not in given:
            folder = folder.rpartition("/")[0]
        want = (r["own"], "file") if r["own"] else (given[folder][1], folder) if folder in given else (None, None)
        assert (r["licence"], r["licence_from"]) == want


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "licensed under the GNU General Public License, version 3"
    rows = [
        (1, "LICENSE", f"x y z {apache} more"), (2, "a/LICENSE.txt", mit), (3, "a/b/c.py", "print"), (4, "d/e.py", ""), (5, "a/b/f.py", gpl), (6, None, None),
        (7, "a/b/c.py", "print"), (8, "nolicense/COPYING", "nothing here"), (None, "ab/x", "w " * 50_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(0) for c in ("own", "cosine", "above", "depth")})
    got = {r["doc_id"]: (r["licence"], r["licence_from"]) for r in licenses.label(df).collect()}
    assert got == {1: ("Apache-2.0", "file"), 2: ("MIT", "file"), 3: ("MIT", "a"), 4: ("Apache-2.0", ""), 5: ("GPL-3.0", "file"), 6: (None, None), 7: ("MIT", "a"), 8: ("Apache-2.0", ""), None: ("Apache-2.0", "")}
    assert licenses.label(df.limit(0)).count() == 0


GNU = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
BSD = licenses.TEMPLATES[2][1] + ": 1. Redistributions of source code must retain the above copyright notice. {}THIS SOFTWARE IS PROVIDED BY THE AUTHOR"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
DUAL = "This is released under the MIT License. " + "word " * 40 + "Licensed under the Apache License, Version 2.0"


def test_licences_are_told_apart(spark):
    whole = licenses.whole_texts()
    third = "Neither the name of the author may be used to endorse or promote products. "
    texts = {
        GNU.format("") + "; either version 2 of the License, or any later version": ["GPL-2.0"], GNU.format("") + ", either version 3 of the License": ["GPL-3.0"],
        GNU.format("") + ".": ["GPL-3.0"], GNU.format("Lesser ") + "; either version 2.1 of the License": ["LGPL-2.1"], GNU.format("Affero ") + ", version 3": ["AGPL-3.0"],
        BSD.format(""): ["BSD-2-Clause"], BSD.format(third): ["BSD-3-Clause"], ISC: ["ISC"], "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-2-Clause\nint x;": ["BSD-2-Clause", "GPL-2.0"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"], DUAL: ["Apache-2.0", "MIT"],
        "Copyright 1999 by nobody\n" + whole["GPL-2.0"]: ["GPL-2.0"], "the wizards quietly examine a box of old letters": None,
        whole["BSD-3-Clause"].split("3. Neither")[0] + "THIS" + whole["BSD-3-Clause"].split("THIS", 1)[1]: ["BSD-2-Clause"],
        whole["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL", 1): ["AGPL-3.0"], **{x: [name] for name, x in whole.items()},
    }
    df = spark.createDataFrame([(i, f"p{i}/LICENSE", x) for i, x in enumerate(texts)] + [(1000 + i, f"p{i}/src/a.c", "int y;") for i in range(len(texts))], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.label(df).collect()}
    for i, want in enumerate(texts.values()):
        assert got[i]["licences"] == got[1000 + i]["licences"] == want, (want, got[i])
        assert got[i]["own"] == got[1000 + i]["licence"] == (want[0] if want else None)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
        ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/"), ("x://y.com/FR/", "y.com", "/FR/", None), ("s://org", "org", "", None),
        ("http://h?x=/a://b/", "h", "", None), ("http://h#f", "h", "", None), ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None),
        ("a://b\n.org/p\nq", "b\n.org", "/p\nq", "org/"),
    ],
)
def test_url_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = urls.parts(F.col("url"))
    name, _ = urls.longest_rule(h, p)
    assert tuple(df.select(h, p, name).first()) == (host, path, rule)


def test_url_models_tell_kinds_apart(spark):
    rows = [(i, f"http://news{i}.org/story/{i}", "x") for i in range(400)] + [(1000 + i, f"http://spam{i}.com/de/{i}", "x") for i in range(400)]
    rows += [(5000, "http://news7.net/story/12", "x"), (5001, "http://spam7.net/de/9", "x"), (5002, None, "x"), (None, "http://news1.org/story/1", "x"), (1, "http://news1.org/story/1", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, key string")
    got = {(r["page_id"]): r for r in urls.judge(df).collect()}
    assert got[5000]["verdict"] == "allow" and got[5001]["verdict"] == "block" and got[5002]["difference"] == 0
    assert got[1]["rule"] == "org/" and got[1000]["verdict"] == "block"
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df.where("page_id = 5000")).collect()} == {"allow"}


def test_url_difference_by_hand():
    counts = np.random.default_rng(0).integers(0, 5, (2, 2, urls.SLOTS)).astype(float)
    url, total = "a.org/ü", 0.0
    before, joint = urls.contexts(url)
    for i in range(len(url.encode())):
        p = [1 / 256, 1 / 256]
        for k in range(urls.ORDER + 1):
            for m in (0, 1):
                n = counts[m, 1][joint[k][i]]
                p[m] = (n + urls.STRENGTH * p[m]) / (max(counts[m, 0][before[k][i]], n) + urls.STRENGTH)
        total += math.log(p[1]) - math.log(p[0])
    assert math.isclose(urls.difference(url, counts), total / len(url.encode()), rel_tol=1e-9)
    _, other = urls.contexts("b.org/ü")
    assert joint[2][-1] == other[2][-1] and joint[0][0] != other[0][0]


def test_url_models_count_exactly(spark):
    """More distinct strings than the hashed table has slots: every estimate still equals one from exact counts."""
    r = np.random.default_rng(3)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    learnt = [(f"{word(30)}.{'org' if i % 2 else 'com'}/{word(30)}ü", bool(i % 2)) for i in range(6000)]
    asked = [learnt[0][0], learnt[1][0], word(40), "a", "", learnt[1][0]]
    n = {False: Counter(), True: Counter()}
    for url, accepted in learnt:
        raw = b"\0" * urls.ORDER + url.encode()
        for i in range(urls.ORDER, len(raw)):
            n[accepted].update(x for k in range(urls.ORDER + 1) for x in ((k, raw[i - k : i], None), (k, raw[i - k : i], raw[i])))
    assert sum(x[2] is not None for c in n.values() for x in c) > urls.SLOTS

    def by_hand(url):
        raw, total = b"\0" * urls.ORDER + url.encode(), 0.0
        for i in range(urls.ORDER, len(raw)):
            for accepted in n:
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    context = raw[i - k : i]
                    p = (n[accepted][k, context, raw[i]] + urls.STRENGTH * p) / (n[accepted][k, context, None] + urls.STRENGTH)
                total += math.log(p) if accepted else -math.log(p)
        return total / max(1, len(raw) - urls.ORDER)

    counts = urls.fit(spark.createDataFrame(learnt, "url string, accepted boolean"))
    pages = spark.createDataFrame([(2**60 + i, i // 2, u) for i, u in enumerate(asked)], "page_id long, block long, key string")
    got = {x["page_id"] - 2**60: x["difference"] for x in urls.score(pages, counts).collect()}
    assert len(got) == len(asked) and all(math.isclose(got[i], by_hand(u), rel_tol=1e-9, abs_tol=1e-12) for i, u in enumerate(asked))


def test_url_models_read_query_and_fragment(spark):
    rows = [(i, f"https://h{i % 9}.org/a?page={i % 50}#top") for i in range(300)] + [(1000 + i, f"https://h{i % 9}.com/de/?utm_source=feed{i % 50}") for i in range(300)]
    asked = {5000: "https://H1.net/a?page=7#top", 5001: "https://h1.net/a?utm_source=feed7", 5002: "utm_source=feed7", 5003: "https://h1.net/a?page=7#top"}
    df = spark.createDataFrame([*rows, *asked.items()], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert got[5000]["verdict"] == "allow" and got[5001]["verdict"] == got[5002]["verdict"] == "block" and got[5002]["host"] == ""
    assert got[5000]["difference"] == got[5003]["difference"]
    texts = ["HTTP://A.Org:80/X?Q#F", "http://H?x=/a://B/", "No Scheme", "", None, "a://b\n.ORG/p\nQ", "s://ORG"]
    whole = spark.createDataFrame([(i, u) for i, u in enumerate(texts)], "i int, url string").select("i", urls.whole(F.col("url")).alias("w"))
    assert [r["w"] for r in whole.orderBy("i").collect()] == ["HTTP://a.org:80/X?Q#F", "http://h?x=/a://B/", "No Scheme", "", "", "a://b\n.org/p\nQ", "s://org"]


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    by_hand = {d for d, t in small(SF, "documents")[["doc_id", "text"]].itertuples(index=False) if (m := measures_by_hand(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r["doc_id"] for r in kept.collect()} == by_hand and kept.columns == docs.columns
    spoken = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    assert spoken.columns == docs.columns and spoken.count() > 0.98 * len(by_hand)
    single = corpus_pipeline.STAGES[2][1](spark, spoken, SF)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spoken).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(found.values()))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(found.values())


def test_pipeline_takes_odd_and_empty_documents(spark, odd_docs, no_docs):
    # of the odd documents only one passes the base rules, and the other two of its host fail them, so the host is rejected
    assert [r["doc_id"] for r in quality.judge(odd_docs).where("NOT base_failed").collect()] == [4]
    for given in (odd_docs, no_docs):
        docs = given.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert {"doc_id", "sequence_id"} <= set(docs.columns) and docs.count() == 0
