"""Language identification: averaged embeddings of hashed subwords with a linear softmax.

Subwords are the letter n-grams (2 to 4 codepoints, word edges marked) of lower-cased text, hashed into BUCKETS. A text is
the mean of its subwords' embeddings; a linear layer and softmax give the languages. Training is stochastic gradient
descent in numpy on a bounded sample (TRAIN_ROWS) of labelled rows. A fifth of the sample is kept from training and
fixes the softmax temperature, so that scores are probabilities, and the threshold under which a text is rejected: the one
that costs at most REJECTED of the kept rows, within bounds. The trained layers multiply out to one table of BUCKETS x languages, so that prediction over the
whole corpus is look-ups and sums.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm import pretok, textops

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIM = 16
EPOCHS = 4
RATE = 4.0
#: Bound of the training sample: expected rows, and n-grams of a row, spread evenly over its whole text.
TRAIN_ROWS, TRAIN_GRAMS = 4_000, 2_048
#: Share of the rows kept from training that rejection may cost, and bounds of the threshold so chosen.
REJECTED, LEAST_REJECT, MOST_REJECT = 0.001, 0.3, 0.5
UNKNOWN = "und"
SEED = 7

_lower: np.ndarray | None = None


def _lower_table() -> np.ndarray:
    """Codepoint -> lower-case letter, or 0 where it is no letter."""
    global _lower
    if _lower is None:
        size = sys.maxunicode + 1
        table = np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(size)), np.uint32, size)
        table[pretok.class_table() < pretok.LETTER] = 0
        _lower = table
    return _lower


def features(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram size, the buckets of all n-grams in raw and n+1 offsets into them by row."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    edges = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    # a gap before each row and one after the last, so that words have edges there too
    rows = len(off) - 1
    letters = np.zeros(len(points) + rows + 1, np.uint32)
    shift = np.repeat(np.arange(1, rows + 1), np.diff(edges))
    letters[np.arange(len(points)) + shift] = _lower_table()[points]
    starts = edges + np.arange(rows + 1)  # the gap before each row
    solid = letters != 0
    out, bounds = [], []
    h = letters.astype(np.uint64)
    inner = None  # all codepoints but the first and the last are letters
    code = textops.mix(h + np.uint64(0x51ED270B))
    rolling = code.copy()
    for n in range(2, max(GRAMS) + 1):
        m = len(letters) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            bounds.append(np.zeros(rows + 1, np.int64))
            continue
        rolling = rolling[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 : n - 1 + m]
        if n == 2:
            valid = solid[:m] | solid[1 : 1 + m]
            inner = np.ones(m, bool)
        else:
            inner = inner[:m] & solid[n - 2 : n - 2 + m]
            valid = inner
        if n not in GRAMS:
            continue
        at = np.flatnonzero(valid)
        x = rolling[at]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(((x >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        bounds.append(np.searchsorted(at, starts))
    return out, bounds


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, float32
    bias: np.ndarray
    temperature: float
    reject: float = LEAST_REJECT

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities by row, and whether a row has a subword at all."""
        rows, k = len(off) - 1, len(self.languages)
        total, number = np.zeros((rows, k)), np.zeros(rows)
        if len(raw):
            for f, b in zip(*features(raw, off), strict=True):
                if not len(f):
                    continue
                some = np.flatnonzero(b[1:] > b[:-1])
                total[some] += np.add.reduceat(self.table[f], b[some], axis=0)
                number += np.diff(b)
        logits = total / np.maximum(number, 1)[:, None] + self.bias
        return softmax(logits / self.temperature), number > 0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(raw: np.ndarray) -> np.ndarray:
    """At most TRAIN_GRAMS n-grams of a text, at even distances over all of it."""
    if not len(raw):
        return np.zeros(0, np.int64)
    every = np.concatenate(features(raw, np.array([0, len(raw)]))[0])
    return every[:: max(1, -(-len(every) // TRAIN_GRAMS))]


def train(texts: list[str], languages: list[str], seed: int = SEED) -> Model | None:
    return train_bags([bag(np.frombuffer(t.encode(), np.uint8)) for t in texts], languages, seed)


def train_bags(grams: list[np.ndarray], languages: list[str], seed: int = SEED) -> Model | None:
    """None if nothing is labelled."""
    bags, labels = [], []
    names = sorted(set(languages))
    for every, lang in zip(grams, languages, strict=True):
        if len(every):
            ids, counts = np.unique(every, return_counts=True)
            bags.append((ids, (counts / counts.sum()).astype(np.float32)))
            labels.append(names.index(lang))
    if not bags:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = order[: len(bags) // 5]
    fit = order[len(bags) // 5 :]
    k = len(names)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ emb[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weight @ p
            weight -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            emb[ids] -= rate * share[:, None] * back
    table = (emb @ weight).astype(np.float32)
    logits = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in (held if len(held) else fit)])
    truth = np.array([labels[i] for i in (held if len(held) else fit)])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    reject = float(np.clip(np.quantile(softmax(logits / heat).max(axis=1), REJECTED), LEAST_REJECT, MOST_REJECT))
    return Model(names, table, bias, heat, reject)


def held_out(id_col: str, fold: int = 0) -> Column:
    """Whether crc32(id as text) mod 5 is the fold; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == fold, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """Trains on about train_rows of the labelled rows that are not held out, spread by a hash of the id."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, train_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def bags(batches):
        for batch in batches:
            grams = [bag(np.frombuffer((t.as_py() or "").encode(), np.uint8)).astype("<u4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), batch.column(1)], names=["grams", "lang"])

    got = sample.select("text", "lang").mapInArrow(bags, "grams binary, lang string").limit(2 * train_rows).collect()
    rows = sorted((r.lang, bytes(r.grams)) for r in got)
    return train_bags([np.frombuffer(g, "<u4").astype(np.int64) for _, g in rows], [lang for lang, _ in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each whole text; predicted from the text alone.

    lang_pred is `und` with score 0, and rejected, where the text is null or has no letter, or where nothing was
    learned. Otherwise it is the likeliest learned language, of two equal ones the first by name, and rejected says
    whether its calibrated probability is under the model's threshold. Repeated rows give repeated rows; an empty table none. With
    keep_columns the input's columns come first, those of the same name replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    outputs = ["held_out", "lang_pred", "score", "rejected"]
    carried = [c for c in docs.columns if c not in {id_col, *outputs}] if keep_columns else []
    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carried)])
    rest = "".join(f", {n} {t}" for n, t in inner.dtypes if n not in ("id", "t"))

    def run(batches):
        model = shared.value
        for batch in batches:
            raw, off = textops.buffers(batch.column(1))
            langs: list[str] = []
            scores = [np.zeros(0)]
            for lo, hi in textops.chunks(off):
                if model is None:
                    langs += [UNKNOWN] * (hi - lo)
                    scores.append(np.zeros(hi - lo))
                    continue
                p, some = model.scores(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                best = p.argmax(axis=1)
                langs += [model.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                scores.append(np.where(some, p[np.arange(len(best)), best], 0.0))
            score = np.concatenate(scores)
            new = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(score < (shared.value.reject if shared.value else LEAST_REJECT), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, batch.num_columns)], *new], names=["id", *[f"x{i}" for i in range(len(carried))], "lang_pred", "score", "rejected"])

    out = inner.mapInArrow(run, f"id {dict(inner.dtypes)['id']}{rest}, lang_pred string, score double, rejected boolean")
    return out.select(F.col("id").alias(id_col), *[F.col(f"x{i}").alias(c) for i, c in enumerate(carried)], held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
