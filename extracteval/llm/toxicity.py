"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel counts common subsequences of three characters, each weighted by ``DECAY`` to the power of
the span it has in either string, and is normalised: ``idiot``, ``id-iot`` and ``ixdxiot`` stay near
each other whatever stands in between. A string's Nyström features are its kernel values with a few
landmark strings, whitened; the machine is linear on them. Summed up, a string's margin is that of
its subsequences' weights divided by its norm, so scoring needs a table of weights and no landmark.

Training and scoring take single words in place of sentences, over the whole text. Only texts carry
labels, so training labels words itself: words that tell toxic from clean texts are toxic, words of
clean texts are clean. Insults made of several ordinary words are not seen. A text's score is a
logistic function of the margins of its two worst words, fitted on the training texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .shingles import shingle_set, words

DECAY = 0.6
START, END = "\x02", "\x03"
WIDTH = 20  # characters a kernel sees at once; a longer word is read in overlapping pieces
PIECE = 10  # characters between the starts of such pieces
ALPHABET = 40  # letters a-z, and numbers that all other characters share
MEMO = 1 << 19  # words a worker remembers the margin of
DOCS = 256
FREQUENT, SOME, HARD = 2000, 4000, 4000  # clean words to train on: frequent, chosen by hash, nearest in each round

_JUNK = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\w(?:\s+\w(?!\w)){2,}")


# ---- strings ----


def normal(word: str) -> str:
    """A word as the kernel sees it: lower case, letters and digits only, between signs for its
    start and its end; empty if there is nothing but signs."""
    word = _JUNK.sub("", word.lower())
    return f"{START}{word}{END}" if word else ""


def tokens(text: str) -> list[str]:
    """The words of a text; single letters set apart by blanks are a word together as well."""
    return text.split() + [_JUNK.sub("", m) for m in _SPACED.findall(text)]


def pieces(word: str) -> list[str]:
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH + PIECE, PIECE)]


def codes(words: Sequence[str]) -> np.ndarray:
    """Characters as numbers below ``ALPHABET``, rows filled up with -1. Letters a-z, start and end
    have numbers of their own, other characters share the rest."""
    raw = np.frombuffer("".join(w.ljust(WIDTH, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), WIDTH)
    own = np.where((raw >= 97) & (raw < 123), raw - 97, 28 + raw % (ALPHABET - 28))
    own = np.where(raw == 2, 26, np.where(raw == 3, 27, own)).astype(np.int32)
    return np.where(raw == 0, -1, own)


# ---- kernel ----


def by_length(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length of three characters or more, and the rows without filling."""
    lengths = (x >= 0).sum(axis=1)
    for n in np.unique(lengths[lengths >= 3]):
        rows = np.flatnonzero(lengths == n)
        yield rows, x[rows, :n]


def norms(x: np.ndarray) -> np.ndarray:
    """The norm of each string's subsequence vector, by the usual recursion over prefixes; 1 for
    strings of fewer than three characters."""
    out = np.ones(len(x))
    for rows, y in by_length(x):
        n = y.shape[1]
        same = (y[:, :, None] == y[:, None, :]).astype(np.float32).transpose(1, 2, 0).copy()  # strings last
        hit = DECAY**2 * same
        for _ in range(2):
            # sums over both ends, with a decay for each further character
            for i in range(1, n):
                hit[i] += DECAY * hit[i - 1]
            for j in range(1, n):
                hit[:, j] += DECAY * hit[:, j - 1]
            nxt = np.zeros_like(hit)
            nxt[1:, 1:] = DECAY**2 * same[1:, 1:] * hit[:-1, :-1]
            hit = nxt
        out[rows] = np.sqrt(np.maximum(hit.sum(axis=(0, 1)), 1e-12))
    return out


def subsequence_sums(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each string the decayed sum, over its subsequences of three, of their rows of ``table``."""
    out = np.zeros((len(x), *table.shape[1:]), np.float32)
    decay = (DECAY ** np.arange(WIDTH + 1)).astype(np.float32)
    for rows, y in by_length(x):
        n = y.shape[1]
        y = y.T.copy()
        total = np.zeros((len(rows), *table.shape[1:]), np.float32)
        for i in range(n - 2):
            for j in range(i + 1, n - 1):
                head = (y[i] * ALPHABET + y[j]) * ALPHABET
                for k in range(j + 1, n):
                    total += decay[k - i + 1] * table[head + y[k]]
        out[rows] = total
    return out


def feature_rows(x: np.ndarray) -> np.ndarray:
    """The subsequence vectors of a few strings (landmarks), normalised."""
    out = np.zeros((len(x), ALPHABET**3), np.float32)
    for row, y in zip(out, x):
        n = int((y >= 0).sum())
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, n):
                    row[(y[i] * ALPHABET + y[j]) * ALPHABET + y[k]] += DECAY ** (k - i + 1)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


# ---- model ----


@dataclass
class Model:
    weights: np.ndarray  # one weight per subsequence
    bias: float
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)  # weights of both margins, offset

    def margins(self, words: Sequence[str]) -> np.ndarray:
        """Of normalised words. Words of fewer than three characters have no subsequence: the bias."""
        each = [pieces(w) for w in words]
        flat = [p for ps in each for p in ps]
        if not flat:
            return np.zeros(0)
        x = codes(flat)
        found = subsequence_sums(x, self.weights) / norms(x) + self.bias
        return np.maximum.reduceat(found, np.cumsum([0, *(len(p) for p in each[:-1])]))

    def score(self, worst: np.ndarray, next_: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * worst + b * next_ + c, -50, 50)))


class Scorer:
    """Margins of texts; words that come again are remembered."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def texts(self, texts: Iterable[str | None]) -> np.ndarray:
        """The two worst margins of each text's words."""
        split = [tokens(t or "") for t in texts]
        new = list({w for words in split for w in words if w not in self.memo})
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            self.memo.update(zip(part, self.model.margins([normal(w) for w in part]).tolist()))
        get, bias = self.memo.__getitem__, self.model.bias
        worst = []
        for words in split:
            first = second = max(map(get, words), default=bias)
            if first > bias / 2:
                second = max(sorted(map(get, words))[-2:-1], default=bias)
            worst.append((first, second))
        for w in new:
            if len(w) > 4 * WIDTH:
                del self.memo[w]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return np.array(worst, dtype=float).reshape(-1, 2)


# ---- training ----


def _svm(phi: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps that are halved until they help."""
    a = np.hstack([phi, np.ones((len(phi), 1))]).astype(float)
    w, eye = np.zeros(a.shape[1]), np.eye(a.shape[1])
    eye[-1, -1] = 1e-6
    loss = lambda w: w @ eye @ w + (c * weight * np.maximum(0, 1 - y * (a @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        bad = y * (a @ w) < 1
        d = (weight[bad] * c)[:, None]
        step, size = np.linalg.solve(eye + (a[bad] * d).T @ a[bad], (a[bad] * d).T @ y[bad]) - w, 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w, was, now = w + size * step, now, loss(w + size * step)
        if was - now < 1e-7 * was:
            break
    return w[:-1], float(w[-1])


def telling_words(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """Words that a hundredth of the toxic texts have, at least, and that are far likelier there than
    in clean texts, likeliest first."""
    found = []
    for w, n in toxic.items():
        if len(w) >= 5 and n >= max(3, 0.01 * n_toxic):
            ratio = (n / max(n_toxic, 1)) / ((clean.get(w, 0) + 0.5) / max(n_clean, 1))
            if ratio >= 10:
                found.append((n * np.log(ratio), w))
    return [w for _, w in sorted(found, reverse=True)]


def fit_words(telling: list[str], toxic: dict[str, int], frequent: list[str], some: list[str], hardest: Callable[[Model, int], list[str]], landmarks: int = 96) -> Model:
    """A machine from telling words, how many toxic texts have each, and clean words: the most frequent
    ones and a random choice, to which ``hardest`` adds those that a model finds nearest."""
    none = Model(np.zeros(ALPHABET**3, np.float32), -1.0)
    ordinary = list(dict.fromkeys(w for w in frequent + some if w not in set(telling)))
    if not telling or not ordinary:  # nothing to tell apart
        return none
    marks = telling[: landmarks // 2]
    marks += some[: landmarks - len(marks)]
    rows = feature_rows(codes([m[:WIDTH] for m in marks]))
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(float))
    keep = values > 1e-5
    table = (rows.T @ (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)).copy()  # Nyström features of each subsequence

    def phi(words: Sequence[str]) -> np.ndarray:
        out = []
        for lo in range(0, len(words), 1 << 11):  # norms hold a square of each word
            x = codes([w[:WIDTH] for w in words[lo : lo + (1 << 11)]])
            out.append(subsequence_sums(x, table) / norms(x)[:, None])
        return np.vstack(out)

    # positives also with a character put in, so that the machine learns what gaps look like
    gapped = [w[:i] + "x" + w[i:] for w in telling[:100] for i in range(2, len(w) - 1)]
    good = telling[:1000] + gapped
    weight = np.array([min(toxic.get(w, 1), 50) for w in good], float)
    bad = ordinary
    good_phi, bad_phi, seen = phi(good), phi(bad), {*bad, *telling}
    model = none
    for _ in range(4):
        w, b = _svm(
            np.vstack([good_phi, bad_phi]), np.concatenate([np.ones(len(good)), -np.ones(len(bad))]),
            np.concatenate([weight, np.ones(len(bad))]), 10.0,
        )
        model = Model((table @ w).astype(np.float32), b)
        # clean words that still come near join the negatives
        hard = [x for x in hardest(model, HARD) if x not in seen]
        if not hard:
            break
        bad, seen, bad_phi = bad + hard, seen | set(hard), np.vstack([bad_phi, phi(hard)])
    return model


def calibrate(model: Model, margins: np.ndarray, labels: np.ndarray) -> Model:
    """The logistic curve from both margins to scores, a little regularised, by Newton steps."""
    if len(set(labels.tolist())) < 2:
        return model
    a, t = np.hstack([margins, np.ones((len(margins), 1))]), np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ t, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3)
        step = np.linalg.solve(h, a.T @ (labels - p) - 1e-2 * t)
        t = t + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.bias, tuple(t.tolist())) if t[0] + t[1] > 0 else model


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 to 4; that of a null id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_texts: int = 6000) -> Model:
    """A model from labelled documents outside fold 0: at most ``max_texts`` of them, chosen by the
    hash of their id. What comes to the driver is bounded by that sample."""
    labelled = labels.where("toxic is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = labelled.where(fold(F.col("label_id")) != 0).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(max_texts)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                found = sorted({normal(w) for w in tokens(text or "")} - {""})  # the words of all its sentences
                # near copies mostly share their least shingle, and count once
                like = int(min(shingle_set(words(text)), default=0)) >> 1
                size = len(found) + 1
                yield pa.RecordBatch.from_arrays([pa.array(["", *found]), pa.array([toxic] * size, pa.int32()), pa.array([like] * size, pa.int64())], ["word", "toxic", "like"])

    counted = texts.mapInArrow(count, "word string, toxic int, like bigint")
    words_of = counted.groupBy("word").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("like"))).alias("toxic"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("like"))).alias("clean"))
    words_of = materialise(words_of, "toxic-words")
    total = words_of.where("word = ''").first()
    if total is None:
        return Model(np.zeros(ALPHABET**3, np.float32), -1.0)
    ordinary = words_of.where("clean > 0 and word <> ''")

    def hardest(model: Model, most: int) -> list[str]:
        near = ordinary.select("word").mapInArrow(_word_margins(model), "word string, margin double")
        return [r["word"] for r in near.where("margin > -0.7").orderBy(F.desc("margin"), "word").limit(most).collect()]

    # of the sample's words only these come to the driver
    often = words_of.where(F.col("toxic") >= F.greatest(F.lit(3.0), F.lit(0.01 * total["toxic"]))).where("word <> ''").collect()
    toxic, clean = {r["word"]: r["toxic"] for r in often}, {r["word"]: r["clean"] for r in often}
    telling = telling_words(toxic, clean, total["toxic"], total["clean"])
    frequent = [r["word"] for r in ordinary.orderBy(F.desc("clean"), "word").limit(FREQUENT + len(telling)).collect()]
    some = [r["word"] for r in ordinary.orderBy(F.xxhash64("word"), "word").limit(SOME + len(telling)).collect()]
    told = set(telling)
    model = fit_words(telling, toxic, [w for w in frequent if w not in told][:FREQUENT], [w for w in some if w not in told][:SOME], hardest)
    margins = texts.select("toxic", "text").mapInArrow(_margins(model, ["toxic"]), "toxic int, worst double, next double").toPandas()
    return calibrate(model, margins[["worst", "next"]].to_numpy(), margins["toxic"].to_numpy(float))


def _word_margins(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                part = batch["word"].slice(lo, 1 << 12)
                yield pa.RecordBatch.from_arrays([part, pa.array(np.asarray(model.margins(part.to_pylist()), float))], ["word", "margin"])

    return run


def _margins(model: Model, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                found = scorer.texts(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keep), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], [*keep, "worst", "next"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, max_texts: int = 6000) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` and ``text_hash``.

    * null or empty text: the score of a text without words;
    * very long texts: all their sentences count;
    * repeated rows: the same score; repeated labels: toxic if one says so; null labels or ids: no
      training row; null ``doc_id``: scored, ``held_out`` false;
    * no usable labels: every score below 0.5; empty table: no rows. Other columns are ignored.
    """
    model = train(docs, labels, max_texts)
    run = _margins(model, ["doc_id", "text_hash"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(model.score(batch["worst"].to_numpy(), batch["next"].to_numpy()))], ["doc_id", "text_hash", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(scored, "doc_id bigint, text_hash bigint, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_texts: int = 6000) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept."""
    bad = toxicity(docs, labels, max_texts).where("predicted = 1").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
