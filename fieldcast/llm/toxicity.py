"""Convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling, and decision
thresholds calibrated by language. A word's vector is the sum of those of its own bucket and of its beginnings', so that
inflected forms share what is learnt.

Training reads all labelled documents. They are dealt to shares of bounded size; each share trains a network in a task of its
own, and what the networks learnt is counted and averaged by bucket. Only sums of the size of the model reach the driver.
Scoring runs over whole texts in Spark tasks with the model broadcast. The language behind a threshold is guessed from the
same hashed words, never taken from a column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import bound_batches, bounded_sample, fold, stored

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
BEGINNINGS = (4, 5)
PARTS = 1 + len(BEGINNINGS)
CACHE_WORDS = 400_000
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled documents that one network is trained on, about, and the bytes of their texts: a share. A table that is one share
#: is trained on by the driver.
SHARE_ROWS = 8_000
SHARE_BYTES = 64 * 1024 * 1024
#: Languages with thresholds of their own, at most: the most frequent ones. Bounds the broadcast table.
MOST_LANGUAGES = 64
#: Words whose filter answers are held at once.
SLICE_WORDS = 1 << 14
EPOCHS = 4
BATCH = 32
RATE = 0.02
#: Parts of the labelled rows that are scored in turn by a network trained on the others, to calibrate thresholds.
CALIBRATION_PARTS = 3
#: Logits are counted in cells of 1 / CELLS, up to MOST_LOGIT to both sides. Learnt steps are summed as whole numbers of
#: 1 / STEPS, so that the sum does not depend on the order.
CELLS, MOST_LOGIT, STEPS = 256, 30, 1 << 24
#: What ``_learn`` returns beside the counts of languages, which are numbered from 0.
SEEN, TOTAL, EMBED, DENSE = -1, -2, -3, -4
#: Rows of the rarer class at which a language's own threshold weighs as much as the pooled one.
PRIOR_ROWS = 12
TRIM = ".,;:!?\"'()[]{}<>«»„“”‘’…*_-"


class Words(dict):
    """Word to row of ``table``, which has its buckets. Bounded: it starts anew between texts when it is full."""

    def __init__(self) -> None:
        self.table = np.zeros((1 << 16, PARTS), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bare = word.strip(TRIM) or word
        digest = xxhash.xxh64_intdigest
        self.table[at] = [1 + digest(x, seed) % (BUCKETS - 1) for seed, x in enumerate([bare, *(bare[:n] for n in BEGINNINGS)])]
        self[word] = at
        return at


WORDS = Words()


def words(text: str | None) -> np.ndarray:
    """Buckets of each word, a row of PARTS."""
    if len(WORDS) > CACHE_WORDS:
        WORDS.clear()
    said = (text or "").lower().split()
    rows = np.fromiter(map(WORDS.__getitem__, said), dtype=np.int64, count=len(said))
    return WORDS.table.take(rows, axis=0)


class Model:
    """Parameters of the network, the language table and the thresholds."""

    def __init__(self, embed: np.ndarray, rng: np.random.Generator) -> None:
        self.embed = embed
        self.filters = [np.zeros((w, DIMS, FILTERS), dtype=np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:] = rng.normal(0, 0.3, f.shape)
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.languages = np.zeros((BUCKETS, 1), dtype=np.float32)
        self.thresholds = np.zeros(1)

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled filter answers of one text and the places they come from; answers are never below zero."""
        best = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        places = [np.full(FILTERS, -1) for _ in WIDTHS]
        if not len(ids):
            return best, places
        padded = np.concatenate([ids, np.zeros((max(WIDTHS) - 1, PARTS), dtype=ids.dtype)])
        for start in range(0, len(ids), SLICE_WORDS):
            n = min(SLICE_WORDS, len(ids) - start)
            part = padded[start : start + n + max(WIDTHS) - 1]
            vectors = self.embed.take(part[:, 0], axis=0)
            for k in range(1, PARTS):  # several times faster than one look-up summed over its parts
                vectors += self.embed.take(part[:, k], axis=0)
            for k, w in enumerate(WIDTHS):
                answer = vectors[:n] @ self.filters[k][0]
                for j in range(1, w):
                    answer += vectors[j : j + n] @ self.filters[k][j]
                at = answer.argmax(axis=0)
                top = answer[at, np.arange(FILTERS)] + self.bias[k]
                part = best[k * FILTERS : (k + 1) * FILTERS]
                better = top > part
                part[better] = top[better]
                places[k][better] = at[better] + start
        return best, places

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids)[0] @ self.out + self.out_bias)

    def language(self, ids: np.ndarray) -> int:
        return int(np.argmax(self.languages.take(ids.ravel(), axis=0).sum(axis=0))) if len(ids) else 0

    def score(self, text: str | None) -> float:
        """0 to 1; 0.5 is the threshold of the text's language."""
        ids = words(text)
        x = self.logit(ids) - self.thresholds[self.language(ids)]
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _train(model: Model, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Stochastic gradient descent with per-parameter step sizes; gradients reach embeddings at pooled places only."""
    seen = {id(p): np.zeros_like(p) for p in [*model.filters, *model.bias, model.out]}
    seen_embed = np.zeros((BUCKETS, 1), dtype=np.float32)
    weight = np.array([1.0, (labels == 0).sum() / max(1, labels.sum())])
    scale = (weight[labels] / weight[labels].mean()).astype(np.float32)

    def move(p: np.ndarray, g: np.ndarray) -> None:
        seen[id(p)] += g * g
        p -= RATE * g / (np.sqrt(seen[id(p)]) + 1e-3)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            answers = [model.pooled(texts[i]) for i in batch]
            best = np.stack([x[0] for x in answers])
            p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30)))
            error = ((p - labels[batch]) * scale[batch] / len(batch)).astype(np.float32)
            moves, buckets, steps = [(model.out, error @ best)], [], []
            for k, w in enumerate(WIDTHS):
                places = np.stack([x[1][k] for x in answers])
                used = places >= 0
                back = error[:, None] * model.out[k * FILTERS : (k + 1) * FILTERS] * used
                moves.append((model.bias[k], back.sum(axis=0)))
                grad = np.zeros_like(model.filters[k])
                for j in range(w):
                    rows = np.zeros((*places.shape, PARTS), dtype=np.int64)
                    for b, i in enumerate(batch):
                        inside = used[b] & (places[b] + j < len(texts[i]))
                        rows[b, inside] = texts[i][places[b, inside] + j]
                    grad[j] = np.einsum("bf,bfd->df", back, model.embed[rows].sum(axis=2))
                    step = back[..., None] * model.filters[k][j].T
                    buckets.append(rows.reshape(-1, PARTS))
                    steps.append(step.reshape(-1, DIMS))
                moves.append((model.filters[k], grad))
            for p, g in moves:
                move(p, g)
            model.out_bias -= np.float32(RATE * error.sum())
            where, group = np.unique(np.concatenate(buckets).ravel(), return_inverse=True)
            total = np.zeros((len(where), DIMS), dtype=np.float32)
            np.add.at(total, group, np.repeat(np.concatenate(steps), PARTS, axis=0))
            total[where == 0] = 0
            seen_embed[where] += (total * total).sum(axis=1, keepdims=True)
            model.embed[where] -= RATE * total / (np.sqrt(seen_embed[where]) + 1e-3)


def _seen(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Documents that hold a bucket, by label."""
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(texts, labels, strict=True):
        seen[label, np.unique(ids)] += 1
    return seen


def _evidence(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a word's documents being toxic, near 0 for rare words: the start of the embedding. ``total``
    has the documents by label."""
    share = (total[1] + 1) / (total.sum() + 2)
    rate = (seen[1] + 8 * share) / (seen.sum(axis=0) + 8)
    return np.log(rate / (1 - rate)) - np.log(share / (1 - share))


def _best_cut(low: np.ndarray, top: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """Threshold between cells of logits with the best F1, in the middle of the gap to the next lower cell. A cell has its
    lowest and highest logit, its positives and all its rows."""
    order = np.argsort(-low)
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(rows[order]) + hits.sum())
    at = int(np.argmax(f1))
    below = top[order[at + 1]] if at + 1 < len(order) else low[order[at]] - 1
    return float((low[order[at]] + below) / 2)


def _best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Logit with the best F1, in the middle of the gap to the next lower one."""
    return _best_cut(logits, logits, labels, np.ones(len(logits), dtype=np.int64))


def _started(seen: np.ndarray, total: np.ndarray, seed: int) -> tuple[Model, np.random.Generator]:
    """A network before training, with the generator to go on with. Networks of one seed differ in the evidence only."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, DIMS)).astype(np.float32)
    embed[:, 0] = _evidence(seen, total)
    embed[0] = 0
    return Model(embed, rng), rng


def _network(texts: list[np.ndarray], labels: np.ndarray, seed: int) -> Model:
    """Network trained on all given texts; without both classes it stays at its start."""
    model, rng = _started(_seen(texts, labels), np.bincount(labels, minlength=2), seed)
    if 0 < labels.sum() < len(texts):
        _train(model, texts, labels, rng)
    return model


def _language_table(texts: list[np.ndarray], langs: list[str | None]) -> np.ndarray:
    """Log shares of buckets by language, a column for each of the most frequent languages (ties: by name)."""
    counts = Counter(x for x in langs if x is not None)
    names = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:MOST_LANGUAGES])
    table = np.full((BUCKETS, max(1, len(names))), 0.05, dtype=np.float32)
    column = {x: i for i, x in enumerate(names)}
    for ids, lang in zip(texts, langs, strict=True):
        if lang in column:
            np.add.at(table[:, column[lang]], ids.ravel(), 1)
    return _log_shares(table)


def _log_shares(table: np.ndarray) -> np.ndarray:
    return np.log(table / table.sum(axis=0, dtype=np.float64).astype(np.float32))


def _deal(labels: np.ndarray, groups: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each row, so that the parts' counts of any label differ by one at most, and of any label and group by one as well."""
    order = rng.permutation(len(labels))
    order = order[np.lexsort((groups[order], labels[order]))]
    dealt = np.empty(len(labels), dtype=np.int64)
    dealt[order] = np.arange(len(labels)) % parts
    return dealt


def _thresholds(logits: np.ndarray, labels: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """``_cut_thresholds`` of rows, each a cell of its own."""
    return _cut_thresholds(
        pd.DataFrame({"language": groups, "cell": np.arange(len(logits)), "rows": 1, "hits": labels, "low": logits, "top": logits}), n
    )


def _cut_thresholds(cells: pd.DataFrame, n: int) -> np.ndarray:
    """Thresholds of ``n`` languages: each one's best, drawn to the best one of all rows the more, the fewer rows of its
    rarer class it has. Without any positive nothing is flagged. ``cells`` has a row per language and cell of logits."""
    if not cells["hits"].sum():
        return np.full(n, 30.0)
    best = lambda of: _best_cut(*(of[c].to_numpy() for c in ("low", "top", "hits", "rows")))
    pooled = best(cells.groupby("cell", sort=True).agg({"low": "min", "top": "max", "hits": "sum", "rows": "sum"}))
    found = np.full(n, pooled)
    for i, own in cells.groupby("language"):
        rows = min(own["hits"].sum(), own["rows"].sum() - own["hits"].sum())
        if rows:
            found[i] = (rows * best(own) + PRIOR_ROWS * pooled) / (rows + PRIOR_ROWS)
    return found


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 11) -> Model:
    """Fits network, language table and thresholds of one share, each on all its rows. Thresholds are calibrated on answers of networks
    that did not see the row, by cross-validation in parts stratified by label and guessed language. Without a positive
    every score is below one half; without a negative the network stays at its start."""
    model = _network(texts, labels, seed)
    model.languages = _language_table(texts, langs)
    guessed = np.array([model.language(t) for t in texts], dtype=np.int64)
    part = _deal(labels, guessed, CALIBRATION_PARTS, np.random.default_rng(seed))
    logits = np.zeros(len(texts))
    for k in range(CALIBRATION_PARTS):
        apart = np.flatnonzero(part == k)
        others = np.flatnonzero(part != k)
        network = _network([texts[i] for i in others], labels[others], seed)
        logits[apart] = [network.logit(texts[i]) for i in apart]
    model.thresholds = _thresholds(logits, labels, guessed, model.languages.shape[1])
    return model


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"key": rows["key"], "lang": rows["lang"], "toxic": rows["toxic"], "ids": [words(t).astype("<i4").tobytes() for t in rows["text"]]})


def sample(docs: DataFrame, labels: DataFrame, train_rows: int | None = None, train_bytes: int | None = None) -> DataFrame:
    """(doc_id, lang, text, toxic, size) of all labelled documents; the fold with remainder 0 is left out. A document with
    several labels is toxic if one of them says so; of rows that repeat a doc_id the one whose text has the smallest hash
    is taken. On request of ``train_rows`` at most, whose texts have at most ``train_bytes`` together, in the order of a hash
    of doc_id."""
    usable = labels.select("doc_id", "toxic").where("toxic IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    if train_rows is not None:
        usable = bounded_sample(usable, "doc_id", train_rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")
    row = F.min(F.struct(F.xxhash64("text").alias("digest"), size, "lang", "text")).alias("row")
    rows = docs.select("doc_id", "lang", "text").join(usable, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), row)
    rows = stored(rows.select("doc_id", "toxic", "row.size", "row.lang", "row.text"), "toxicity_sample").select("doc_id", "lang", "text", "toxic", "size")
    if train_bytes is None:
        return rows
    # one task, over as many numbers as rows were asked for
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    taken = rows.select("doc_id", upto.alias("upto")).where(F.col("upto") <= train_bytes).select("doc_id")
    return rows.join(taken, "doc_id")


def _learn(rows: pd.DataFrame, names: list[str], seed: int) -> pd.DataFrame:
    """What one share adds to the model, as sums by (part, kind, at): occurrences of buckets by language, documents with a
    bucket and all documents by label, and the way that embeddings and other parameters went from their start. A share
    without both classes goes no way and is not counted in ``used``."""
    rows = rows.sort_values(["key", "doc_id"]).sample(frac=1, random_state=0)
    texts, labels = [words(t) for t in rows["text"]], rows["toxic"].to_numpy(dtype=np.int64)
    out: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for i, name in enumerate(names):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for ids, lang in zip(texts, rows["lang"], strict=True):
            if lang == name:
                np.add.at(counts, ids.ravel(), 1)
        out.append((i, np.flatnonzero(counts), counts[counts > 0][:, None], 0))
    seen, total = _seen(texts, labels), np.bincount(labels, minlength=2)
    held = np.flatnonzero(seen.sum(axis=0))
    out += [(SEEN, held, seen[:, held].T, 0), (TOTAL, np.arange(1), total[None, :], 0)]
    if total.all():
        model, rng = _started(seen, total, seed)
        begun, before = model.embed.copy(), _dense(model)
        _train(model, texts, labels, rng)
        way = model.embed - begun
        moved = np.flatnonzero(way.any(axis=1))
        way, dense = (np.rint(x.astype(np.float64) * STEPS) for x in (way[moved], _dense(model) - before))
        out += [(EMBED, moved, way, 1), (DENSE, np.arange(len(dense)), dense[:, None], 1)]
    part = int(rows["share"].iloc[0]) % CALIBRATION_PARTS
    frames = []
    for kind, at, values, used in out:
        frame = pd.DataFrame({"part": part if kind < 0 else 0, "kind": kind, "at": at, "used": used})
        for k in range(DIMS):
            frame[f"v{k}"] = values[:, k].astype(np.int64) if k < values.shape[1] else 0
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


def _dense(model: Model) -> np.ndarray:
    """All parameters but the embedding, in one row."""
    return np.concatenate([*(f.ravel() for f in model.filters), *model.bias, model.out, [model.out_bias]])


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of one part and kind, as bytes: the driver takes a row for each. A kind has as many rows as buckets at most."""
    rows = rows.sort_values("at")
    kind = int(rows["kind"].iloc[0])
    wide = DIMS if kind == EMBED else 2 if kind in (SEEN, TOTAL) else 1
    values = rows[[f"v{k}" for k in range(wide)]].to_numpy(dtype="<i8")
    one = {"part": rows["part"].iloc[0], "kind": kind, "wide": wide, "at": rows["at"].to_numpy(dtype="<i4").tobytes()}
    return pd.DataFrame([one | {"used": rows["used"].to_numpy(dtype="<i4").tobytes(), "sums": values.tobytes()}])


def _merged(sums: dict, parts: Iterable[int], languages: np.ndarray, seed: int) -> Model:
    """One network from what the shares of ``parts`` learnt: the evidence of all their documents, and from there the mean
    way of the shares, for embeddings of those that moved a bucket."""
    seen, total = np.zeros((2, BUCKETS)), np.zeros(2)
    way, ways = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS)
    dense, shares = 0.0, 0
    for part in parts:
        if (part, TOTAL) in sums:
            total += sums[part, TOTAL][2][0]
            at, _, values = sums[part, SEEN] if (part, SEEN) in sums else (np.zeros(0, dtype=int), None, np.zeros((0, 2)))
            seen[:, at] += values.T
        if (part, DENSE) in sums:
            _, used, values = sums[part, DENSE]
            dense, shares = dense + values[:, 0], shares + used[0]
        if (part, EMBED) in sums:
            at, used, values = sums[part, EMBED]
            way[at] += values
            ways[at] += used
    model, _ = _started(seen, total, seed)
    model.languages = languages
    model.embed += (way / STEPS / np.maximum(ways, 1)[:, None]).astype(np.float32)
    if shares:
        whole, place = (_dense(model) + dense / STEPS / shares).astype(np.float32), 0
        for p in [*model.filters, *model.bias, model.out]:
            p[...] = whole[place : place + p.size].reshape(p.shape)
            place += p.size
        model.out_bias = whole[place]
    return model


def _fit_shares(rows: DataFrame, shares: int, seed: int = 11) -> Model:
    """Model of rows (doc_id, key, lang, text, toxic) in several shares, dealt by ``key``. Shares fall into parts; thresholds
    are calibrated on counts of all rows' logits, each by the network of the parts that the row is not in."""
    spark = rows.sparkSession
    rows = rows.withColumn("share", F.pmod("key", F.lit(shares)).cast("int"))
    top = rows.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    names = sorted(r["lang"] for r in top.collect())
    values = [f"v{k}" for k in range(DIMS)]
    learnt = rows.select("doc_id", "key", "lang", "text", "toxic", "share").repartitionById(shares, "share").groupBy("share").applyInPandas(
        lambda share: _learn(share, names, seed), f"part int, kind int, at int, used long, {', '.join(f'{v} long' for v in values)}"
    )
    added = learnt.groupBy("part", "kind", "at").agg(*[F.sum(c).alias(c) for c in ["used", *values]])
    packed = added.groupBy("part", "kind").applyInPandas(_packed, "part int, kind int, wide int, at binary, used binary, sums binary")
    sums = {
        (r["part"], r["kind"]): (np.frombuffer(r["at"], "<i4"), np.frombuffer(r["used"], "<i4"), np.frombuffer(r["sums"], "<i8").reshape(-1, r["wide"]))
        for r in packed.toLocalIterator()
    }
    table = np.full((BUCKETS, max(1, len(names))), 0.05, dtype=np.float32)
    for i in range(len(names)):
        if (0, i) in sums:
            at, _, counts = sums.pop((0, i))
            table[at, i] += counts[:, 0]
    languages = _log_shares(table)
    others = spark.sparkContext.broadcast(
        [_merged(sums, [p for p in range(CALIBRATION_PARTS) if p != k], languages, seed) for k in range(CALIBRATION_PARTS)]
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        networks = others.value
        for batch in batches:
            found = []
            for text, share in zip(batch["text"], batch["share"], strict=True):
                ids, network = words(text), networks[share % CALIBRATION_PARTS]
                found.append((network.language(ids), network.logit(ids)))
            rows = pd.DataFrame(found, columns=["language", "logit"])
            yield rows.assign(toxic=batch["toxic"].to_numpy())

    answers = rows.select("text", "share", "toxic").mapInPandas(answer, "language int, logit double, toxic bigint")
    logit = F.greatest(F.least("logit", F.lit(float(MOST_LOGIT))), F.lit(-float(MOST_LOGIT)))
    cells = answers.withColumn("logit", logit).groupBy("language", F.floor(F.col("logit") * CELLS).alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("hits"), F.min("logit").alias("low"), F.max("logit").alias("top")
    ).toPandas()
    others.unpersist()
    model = _merged(sums, range(CALIBRATION_PARTS), languages, seed)
    model.thresholds = _cut_thresholds(cells, languages.shape[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, share_rows: int = SHARE_ROWS, share_bytes: int = SHARE_BYTES) -> Model:
    """Model from all labelled documents of ``sample``. Without a labelled row nothing is ever flagged. One share is trained
    on by the driver, more by a task for each (``_fit_shares``)."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    rows = sample(docs, labels).withColumn("key", F.xxhash64("doc_id"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shares = max(-(-n // share_rows), -(-size // share_bytes))
    if shares > 1:
        return _fit_shares(rows, max(shares, CALIBRATION_PARTS))
    rows = rows.mapInPandas(_hashed, "key long, lang string, toxic bigint, ids binary").toPandas()
    rows = rows.sort_values("key").sample(frac=1, random_state=0) if len(rows) else rows
    langs = [x if isinstance(x, str) else None for x in rows["lang"]]
    # as bytes: lists of numbers would take the driver ten times the memory
    return train([np.frombuffer(x, dtype="<i4").reshape(-1, PARTS) for x in rows["ids"]], rows["toxic"].to_numpy(dtype=np.int64), langs)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text, anything else) from the whole text. NULL
    and empty texts are scored as having no word; repeated rows and rows without doc_id are each scored; a text of any
    length is read in slices; no rows give none. Equal texts get equal scores, and a score of exactly 0.5 is toxic."""
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for rows in batches:
            scores = np.array([model.score(t) for t in rows["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int")
