"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two spans (words of a sentence) counts their shared three-letter subsequences with gaps, each weighted by
DECAY to the letters that it spans, at most SPAN; word ends are letters too. Inserted characters, spaced-out words and
digits for letters so leave most of the kernel in place. The machine is fitted on words of labelled documents, each
weighed by the documents of either label that hold it, less what chance would give; words of clean documents that look
toxic after a first fit are examples of the second. Similarities to 256 landmarks are the features of a squared-hinge machine;
because the kernel has explicit features, machine and landmarks fold into one fixed table of weights, and scoring a text is one vectorised pass over its
letters, whole texts at any length. A document's score is the logistic of how many and how dense its toxic words are.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a letter in a subsequence's span, and the longest span.
DECAY, SPAN = 0.7, 5
_STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_OPEN, _CLOSE, _KINDS = 27, 28, 64
#: Letters beside a-z that have a class of their own, and digits and signs read as letters.
_ACCENTED = "äöüßàâçéèêëîïôùûáíóúñ"
_READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Share of the words of clean documents that may pass for toxic ones; it sets the bar of a word's margin.
CLEAN_SHARE = 1 / 4000
#: Words that chance may put among those held to be toxic, as a share of them.
FALSE_WORDS = 0.5
#: Bounds of the sample that the machine is fitted on: documents of each label, bytes of text, word
#: types, landmarks, clean documents that the bar is set on. All are parameters of :func:`train`.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_WORDS, LANDMARKS, BAR_DOCS = 2500, 24 << 20, 18_000, 256, 500


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane: 0 not a letter, 255 white space."""
    out = np.zeros(0x10000, np.uint8)
    for k in range(128, 0x10000):
        if not 0xD800 <= k < 0xE000 and chr(k).isalpha():
            out[k] = 50 + k % 14
    out[[*range(9, 14), 32]] = 255
    for k in range(26):
        out[97 + k] = out[65 + k] = k + 1
    for k, c in enumerate(_ACCENTED):
        out[ord(c)] = out[ord(c.upper()[0])] = 29 + k
    out[ord("ß")] = 29 + _ACCENTED.index("ß")
    for c, k in _READ_AS.items():
        out[ord(c)] = out[ord(k)]
    return out


_CLASSES = _classes()


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter classes of all words with their ends marked, the word of each letter, and the letters of each word.

    Other characters inside a word are left out; three or more single letters in a row are one word.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _CLASSES[np.minimum(codes, 0xFFFF)]
    blank = kinds == 255
    begins = ~blank & np.concatenate([[True], blank[:-1]]) if len(kinds) else blank
    word = np.cumsum(begins) - 1
    keep = ~blank & (kinds > 0)
    kinds, word = kinds[keep], word[keep]
    if not len(kinds):
        return kinds, word, word
    word = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]).astype(np.int64)]))
    size = np.bincount(word)
    single = size == 1
    run = np.cumsum(np.concatenate([[True], ~(single[1:] & single[:-1])])) - 1  # words of one letter in a row
    if (long := np.bincount(run) >= 3).any():
        own = np.where(long[run], -1 - run, np.arange(len(size)))[word]
        word = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]).astype(np.int64)]))
        size = np.bincount(word)
    at = np.arange(len(kinds)) + 2 * word + 1
    letters = np.zeros(len(kinds) + 2 * len(size), np.uint8)
    letters[at] = kinds
    ends = np.cumsum(size + 2)
    letters[ends - size - 2], letters[ends - 1] = _OPEN, _CLOSE
    return letters, np.repeat(np.arange(len(size)), size + 2), size


def _features(letters: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, subsequence code, weight) of every gap pattern."""
    wide = letters.astype(np.int32)
    for a, b in _STEPS:
        n = len(wide) - a - b
        if n > 0:
            same = word[:n] == word[a + b :]
            code = (wide[:n] * _KINDS + wide[a : a + n]) * _KINDS + wide[a + b :]
            yield word[:n][same], code[same], DECAY ** (a + b + 1)


def _norm(size: np.ndarray) -> np.ndarray:
    """Length of a word's features if none repeats; it scales the kernel by each word's number of letters."""
    total = np.zeros(len(size))
    for a, b in _STEPS:
        total += np.maximum(size + 2 - a - b, 0) * DECAY ** (2 * (a + b + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def _matrix(words: list[str], codes: np.ndarray) -> np.ndarray:
    """Scaled features of ``words`` at the subsequences ``codes``."""
    letters, word, size = spans(" ".join(words))
    if len(size) != len(words):
        raise ValueError("words must hold a letter and no white space")
    out = np.zeros((len(words), len(codes)), np.float32)
    for w, c, weight in _features(letters, word):
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        hit = codes[at] == c
        np.add.at(out, (w[hit], at[hit]), weight)
    return out / _norm(size)[:, None].astype(np.float32)


@dataclass
class Model:
    """Folded machine (a weight per subsequence and a bias), the margin that few words of clean documents reach, and the
    logistic over a document's toxic words."""

    table: np.ndarray
    bias: float
    bar: float
    logistic: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        letters, word, size = spans(text)
        total = np.zeros(len(size))
        for w, c, weight in _features(letters, word):
            total += np.bincount(w, self.table[c], len(size)) * weight
        return total / _norm(size) + self.bias

    def describe(self, text: str | None) -> np.ndarray:
        m = self.margins(text or "")
        hits = (1 / (1 + np.exp(-np.clip(12 * (m - self.bar), -40, 40)))).sum() if len(m) else 0.0
        return np.array([1.0, np.log1p(hits), np.log(hits / max(len(m), 1) + 0.003)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.describe(text) @ self.logistic, -30, 30))))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, hinge: bool) -> np.ndarray:
    """Weighted squared hinge (or logistic loss) with an L2 penalty on all but the first column, by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-8

    def loss(w: np.ndarray) -> float:
        z = y * (x @ w)
        each = np.maximum(0, 1 - z) ** 2 if hinge else np.logaddexp(0, -z)
        return float(weight @ each + penalty @ (w * w) / 2)

    now = loss(w)
    for _ in range(40):
        z = y * (x @ w)
        if hinge:
            active = z < 1
            g = -2 * (weight * y * np.maximum(0, 1 - z)) @ x + penalty * w
            h = 2 * (x[active] * weight[active, None]).T @ x[active]
        else:
            p = 1 / (1 + np.exp(np.clip(z, -40, 40)))
            g = -(weight * y * p) @ x + penalty * w
            h = (x * (weight * p * (1 - p))[:, None]).T @ x
        step, size = np.linalg.solve(h + np.diag(penalty + 1e-9), g), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-7 * max(1.0, abs(last)):
            break
    return w


def _chance_floor(in_pos: np.ndarray, in_neg: np.ndarray, n_pos: int, n_neg: int) -> float:
    """What a word's count in toxic documents must exceed its due by, so that few words do by chance.

    How many words clean documents have as much too often shows what chance makes: at the floor at most FALSE_WORDS of those.
    """
    over_pos, over_neg = in_pos - 2 * in_neg * n_pos / n_neg, (in_neg - 2 * in_pos * n_neg / n_pos) * min(1.0, n_pos / n_neg)
    found = [(floor, int((over_pos > floor).sum()), int((over_neg > floor).sum())) for floor in np.arange(1.5, 41.5)]
    good = [floor for floor, p, n in found if p and n <= FALSE_WORDS * p]
    return float(good[0] if good else min((n / p, floor) for floor, p, n in found if p)[1] if found[0][1] else 1.5)


def _order(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=8).digest()


def fit(texts: list[str | None], labels: list[int], words: int = SAMPLE_WORDS, landmarks: int = LANDMARKS, bar_docs: int = BAR_DOCS) -> Model:
    """Fits the machine on labelled texts. Without both labels, or without a word of two letters, all texts score next to 0."""
    pos, neg = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        (pos if label else neg).update({w for w in (text or "").lower().split() if any(_CLASSES[min(ord(c), 0xFFFF)] not in (0, 255) for c in w)})
    n_pos, n_neg = sum(map(bool, labels)), len(labels) - sum(map(bool, labels))
    nothing = Model(np.zeros(_KINDS**3, np.float32), -2.0, 0.0, np.array([-9.0, 0.0, 0.0]))
    if not n_pos or not n_neg:
        return nothing
    clean = lambda w: "".join(c for c in w if _CLASSES[min(ord(c), 0xFFFF)] not in (0, 255))
    merged_pos, merged_neg = Counter(), Counter()
    for merged, counted in ((merged_pos, pos), (merged_neg, neg)):
        for w, n in counted.items():
            if len(w := clean(w)) > 1:
                merged[w] += n
    # a word's lift: how much more often it is in toxic documents, shrunk by its count
    lift = {w: merged_pos[w] * np.log((merged_pos[w] + 0.1) / (n_pos + 1) / ((merged_neg[w] + 0.1) / (n_neg + 1))) for w in merged_pos}
    ranked = sorted(lift, key=lambda w: (-lift[w], w))
    often = sorted(merged_neg, key=lambda w: (-merged_neg[w], w))
    rest = sorted({*ranked[words // 3 :], *often[words // 3 :]}, key=_order)
    chosen = list(dict.fromkeys([*ranked[: words // 3], *often[: words // 3], *rest[: words // 3]]))
    marks = list(dict.fromkeys([*ranked[: landmarks // 2], *sorted(merged_neg, key=_order)[: landmarks // 2]]))
    if not marks:
        return nothing
    letters, word, _ = spans(" ".join(marks))
    codes = np.unique(np.concatenate([c for _, c, _ in _features(letters, word)]))
    at_marks = _matrix(marks, codes).astype(np.float64)
    values, vectors = np.linalg.eigh(at_marks @ at_marks.T)
    good = values > 1e-5 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    project = at_marks.T @ whiten  # codes -> Nystroem features

    def features_of(some_words: list[str]) -> np.ndarray:
        x = np.concatenate([_matrix(some_words[lo : lo + 500], codes) @ project for lo in range(0, len(some_words), 500)])
        return np.hstack([np.ones((len(x), 1)), x])

    known = sorted({*merged_pos, *merged_neg})
    floor = _chance_floor(np.array([merged_pos[w] for w in known], float), np.array([merged_neg[w] for w in known], float), n_pos, n_neg)
    x = features_of(chosen)
    for mined in (False, True):
        in_pos, in_neg = (np.array([m[w] for w in chosen], float) for m in (merged_pos, merged_neg))
        # what a word's count exceeds its due by clean documents, and chance, makes it toxic
        due = in_neg * n_pos / n_neg
        weight_pos, weight_neg = np.maximum(0, in_pos - floor - 2 * due), due + 0.1
        some = weight_pos > 0
        w = _newton(np.vstack([x[some], x]), np.repeat([1.0, -1.0], [some.sum(), len(x)]), np.concatenate([weight_pos[some], weight_neg]), 0.05, True)
        table = np.zeros(_KINDS**3, np.float32)
        table[codes] = project @ w[1:]
        model = Model(table, float(w[0]), 0.0, np.zeros(3))
        if not mined:  # words of clean documents that look most toxic so far are examples too
            rest = sorted(set(merged_neg) - set(chosen))
            margins = np.concatenate([model.margins(" ".join(rest[lo : lo + 20_000])) for lo in range(0, len(rest), 20_000)]) if rest else np.zeros(0)
            hard = [rest[k] for k in np.lexsort((np.arange(len(rest)), -margins))[: words // 3]]
            if not hard:
                break
            chosen, x = chosen + hard, np.vstack([x, features_of(hard)])
    clean_words = np.concatenate([[-1.0], *[model.margins(t or "") for t, label in zip(texts, labels, strict=True) if not label][:bar_docs]])
    model.bar = float(np.clip(np.quantile(clean_words, 1 - CLEAN_SHARE), 0.0, 0.9))
    described = np.array([model.describe(t) for t in texts])
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    model.logistic = _newton(described, y, np.ones(len(y)), 0.02, False)
    return model


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS,
    sample_bytes: int = SAMPLE_BYTES, sample_words: int = SAMPLE_WORDS, landmarks: int = LANDMARKS, bar_docs: int = BAR_DOCS,
) -> Model:
    """Fits on a bounded sample: per label at most ``sample_docs`` documents by hash of the identifier, ``sample_bytes`` of text.

    ``usable`` limits the labelled rows by their identifier, named ``key``. Rows with a null label or identifier are left out.
    The machine is fitted in one task over the sample, sorted, so a repeated task gives the same one; the driver gets the
    identifiers of the sample and the model of fixed size, no texts.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
        made = fit([r[1] for r in rows], [r[2] for r in rows], sample_words, landmarks, bar_docs)
        cols = [pa.array([made.table.tobytes()], pa.binary()), *[pa.array([x], pa.float64()) for x in (made.bias, made.bar)], pa.array([made.logistic.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["table", "bias", "bar", "logistic"])

    marked = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label")).dropna()
    marked = marked.groupBy("key").agg(F.max("label").alias("label"))
    marked = marked.filter(usable) if usable is not None else marked
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    sized = marked.join(texts.select("key", F.octet_length("body").alias("size")), "key")
    picked, budget = [], sample_bytes
    for label in (1, 0):
        some = sized.filter(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(sample_docs).collect()
        for row in some:
            if row["size"] <= budget // (2 if label else 1):
                budget -= row["size"]
                picked.append((row["key"], label))
    if not picked:
        return fit([], [])
    asked = docs.sparkSession.createDataFrame(picked, "key long, label int")
    rows = texts.join(F.broadcast(asked), "key").select("key", "body", "label").repartition(1)  # at most 2 x sample_docs, 24 MB
    made = rows.mapInArrow(learn, "table binary, bias double, bar double, logistic array<double>").first()
    return Model(np.frombuffer(made["table"], np.float32), made["bias"], made["bar"], np.array(made["logistic"])) if made else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row's whole text.

    A null text is scored as an empty one; repeated rows get a score each; a null identifier is carried. Other columns are
    not read. An empty table gives no rows. The model has a fixed size (one megabyte) whatever it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [sent.value.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, bar: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``bar``, all columns kept; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield part.filter(pa.array([sent.value.score(t) < bar for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
