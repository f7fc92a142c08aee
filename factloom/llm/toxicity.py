"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums, over the subsequences of three and four letters
that both hold, ``decay ** gaps`` for each pair of places: letters may be
missing or put in between ("id*iot", "i d i o t").  It is divided by a norm
that depends on the words' lengths.  A sentence's kernel with a landmark word
is the sum over its words, divided by the root of their number.

Landmarks are words of the training sample; the Nystroem map turns kernels
with them into vectors, and linear SVMs (squared hinge, Newton steps) learn on
labelled sentences, as in multiple-instance learning: a document's label
reaches its sentences, and a first fit scores them as wholes.  From then on a
sentence stands for its highest word, the witness: the witnesses of toxic
documents' sentences (those above 0, and each document's best) against words
of clean sentences, the hardest among them, fitted anew each round.  At
the end sentences as wholes are fitted once more, with the sentences of toxic
documents that hold a witness as the toxic ones.  A document's highest
sentence, its two highest words and its number of words are calibrated on
documents that neither SVM saw.

As the decision is linear in the kernel, landmarks and weights fold into one
table over subsequences for each SVM, so a new word costs a few gathers, whatever the
number of landmarks.

Defined cases: a null text is empty and gets the score of a sentence without
words; equal rows are scored each; null ids are kept and never train; rows
with null labels, and labels of unknown documents, are left out; without both
labels everything scores 0.
"""

from __future__ import annotations

import pickle
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, text_or_empty
from factloom.llm.textbytes import U, Rolling, mix, trim

#: Classes of characters: 0 between words, 1-26 letters (those of other scripts by their code), 27 digits, 30 a gap in a word, 31 a word's start.
GAP, START, CLASSES = 30, 31, 32
_SPAN = 7
_WIDTH = 26
_SENTENCE = 32
_CHUNK = 1 << 20
#: A word's decision counts no lower than this; texts without words have it.
FLOOR = -2.0


@dataclass(frozen=True)
class Toxicity:
    """``toxic_rows`` and ``clean_rows`` bound the training sample (by hash of the id); labelled texts of more than ``train_chars`` characters are not in it."""

    toxic_rows: int = 1500
    clean_rows: int = 2500
    train_chars: int = 200_000
    sentences: int = 40_000
    landmarks: int = 160
    decay: float = 0.6
    cost: float = 1.0
    rounds: int = 4
    folds: int = 5


@dataclass
class Model:
    """``w3`` and ``w4``: weights of subsequences in the two SVMs, of words and of sentences; then their offsets and the calibration's weights (two words, the highest sentence, log of the number of words, offset)."""

    w3: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES**3, 2), np.float32))
    w4: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES**4, 2), np.float32))
    decay: float = 0.6
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    bias: float = 0.0
    sentence_bias: float = 0.0
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -30.0)


def _class_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace() or 0xD800 <= c < 0xE000:
            continue
        base = unicodedata.normalize("NFKD", ch)[0].lower() if ch.isalnum() else ch
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif ch.isdigit():
            table[c] = 27
        elif ch.isalnum():
            table[c] = 1 + c % 26
        else:
            table[c] = GAP
    return table


_tables: dict[str, np.ndarray] = {}


def _classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a text's characters, and where a sentence may end."""
    if "t" not in _tables:
        _tables["t"] = _class_table()
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 1 << 16, _tables["t"][np.minimum(code, (1 << 16) - 1)], 1 + code % 26)
    stop = (code == 10) | (code == 46) | (code == 33) | (code == 63)
    n = len(kind)
    solid = np.zeros(n + 4, bool)
    solid[2:-2] = (kind > 0) & (kind < GAP)
    before, after = solid[1:-3], solid[3:-1]
    gap = (kind == GAP) & before & after
    # white space between single letters is a gap as well: letters spaced out
    alone = (kind == 0) & (code != 10) & before & ~solid[:-4] & after & ~solid[4:]
    kind = np.where(solid[2:-2], kind, 0).astype(np.uint8)
    kind[gap | alone] = GAP
    return kind, stop & (kind == 0)


def _words(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; longer ones as overlapping parts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (kind > 0).view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    most = _WIDTH - 1
    if len(a) and (b - a).max() > most:
        step = most - _SPAN
        parts = np.maximum(1, -(-(b - a - _SPAN) // step))
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.repeat(a, parts) + k * step, np.repeat(b, parts)
        b = np.minimum(b, a + most)
    return a, b


def _matrix(kind: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    at = a[:, None] + np.arange(width - 1)
    out = np.zeros((len(a), width), np.int32)
    out[:, 0] = START
    out[:, 1:] = np.where(at < b[:, None], kind[np.minimum(at, len(kind) - 1)], 0)
    return out


_places: dict[tuple[int, int], list[tuple[int, ...]]] = {}


def places(width: int, p: int) -> list[tuple[int, ...]]:
    """The places of ``p`` letters within a span, in a word of ``width`` classes."""
    if (width, p) not in _places:
        _places[width, p] = [(i, *(i + x for x in rest)) for i in range(width) for rest in combinations(range(1, _SPAN), p - 1) if i + rest[-1] < width]
    return _places[width, p]


def _norm(length: int, decay: float) -> float:
    return float(np.sqrt(sum(decay ** (2 * (q[-1] - q[0] + 1 - p)) for p in (3, 4) for q in places(length + 1, p)))) or 1.0


def norms(decay: float) -> np.ndarray:
    return np.array([_norm(n, decay) for n in range(_WIDTH)])


def _subsequences(matrix: np.ndarray, decay: float) -> Iterator[tuple[int, float, np.ndarray]]:
    """(p, weight, index of the subsequence in each word); index 0 where a place is no letter."""
    solid = (matrix > 0) & (matrix != GAP)
    for p in (3, 4):
        for q in places(matrix.shape[1], p):
            index = matrix[:, q[0]].copy()
            good = solid[:, q[0]]
            for x in q[1:]:
                index = index * CLASSES + matrix[:, x]
                good = good & solid[:, x]
            yield p, decay ** (q[-1] - q[0] + 1 - p), np.where(good, index, 0)


def word_scores(model: Model, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The folded decisions of every word: alone, and as a part of a sentence."""
    out, size = np.zeros((len(a), 2)), b - a
    norm = norms(model.decay)
    for low, width in ((0, 9), (8, 14), (13, _WIDTH)):
        pick = np.flatnonzero((size > low) & (size < width) if low else size < width)
        for k in range(0, len(pick), 20_000):
            part = pick[k : k + 20_000]
            total = np.zeros((len(part), 2))
            for p, weight, index in _subsequences(_matrix(kind, a[part], b[part], width), model.decay):
                total += weight * (model.w3 if p == 3 else model.w4)[index]
            out[part] = total / norm[size[part]][:, None]
    return out


class _Scorer:
    """Scores words by table, each distinct one once for a worker (the table is begun anew when full)."""

    def __init__(self, model: Model, most: int = 1 << 20):
        self.model, self.most = model, most
        self.keys, self.values = np.zeros(0, U), np.zeros((0, 2))

    def words(self, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, where, inverse = np.unique(Rolling(kind).ranges(a, b), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + new.sum() > self.most and len(self.keys):
                self.keys, self.values = np.zeros(0, U), np.zeros((0, 2))
                new[:] = True
            w = where[new]
            spot = np.searchsorted(self.keys, keys[new])
            self.values = np.insert(self.values, spot, word_scores(self.model, kind, a[w], b[w]), axis=0)
            self.keys = np.insert(self.keys, spot, keys[new])
        return self.values[np.searchsorted(self.keys, keys)][inverse]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's two highest words and highest sentence, and its number of words."""
        best, count = np.full((len(texts), 3), -np.inf), np.zeros(len(texts), np.int64)
        for owner, text in _parts(texts):
            kind, stop = _classes(text)
            a, b = _words(kind)
            if not len(a):
                continue
            doc = np.array(owner[0])[np.searchsorted(owner[1], a, "right") - 1]
            both = self.words(kind, a, b)
            score = both[:, 0] + self.model.bias
            start = np.flatnonzero(np.isin(np.arange(len(a)), sentence_starts(a, stop)) | np.concatenate(([True], doc[1:] != doc[:-1])))
            whole = np.add.reduceat(both[:, 1], start) / np.sqrt(np.diff(np.append(start, len(a)))) + self.model.sentence_bias
            np.maximum.at(best[:, 2], doc[start], whole)
            order = np.lexsort((-score, doc))
            first = np.flatnonzero(np.concatenate(([True], doc[order][1:] != doc[order][:-1])))
            size = np.diff(np.append(first, len(order)))
            who = doc[order[first]]
            two = np.where(size > 1, score[order[np.minimum(first + 1, len(order) - 1)]], -np.inf)
            merged = np.concatenate((best[who, :2], score[order[first]][:, None], two[:, None]), 1)
            best[who, :2] = -np.sort(-merged, 1)[:, :2]
            count[who] += size
        return np.maximum(best, FLOOR), count

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(*self.texts(texts)) @ np.array(self.model.calibration), -50, 50)))


def _inputs(best: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.column_stack([best, np.log1p(count), np.ones(len(count))])


def sentence_starts(a: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Indexes of the words that begin a sentence; after ``_SENTENCE`` words another begins."""
    number = np.cumsum(stop)[a]
    new = np.concatenate(([True], number[1:] != number[:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return np.flatnonzero(place % _SENTENCE == 0)


def _parts(texts: list[str]) -> Iterator[tuple[tuple[list[int], list[int]], str]]:
    """Texts joined by line ends to about a chunk, with whose they are and where they begin; long ones in parts, cut at white space."""
    owner: tuple[list[int], list[int]] = ([], [])
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            to = min(len(text), at + _CHUNK)
            if to < len(text):
                gap = max(text.rfind(" ", at, to), text.rfind("\n", at, to))
                to = gap + 1 if gap > at else to
            owner[0].append(k)
            owner[1].append(size)
            held.append(text[at:to])
            size += to - at + 1
            at = max(to, 1)
            if size >= _CHUNK:
                yield owner, "\n".join(held)
                owner, held, size = ([], []), [], 0
    if held:
        yield owner, "\n".join(held)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge; the last column of the result is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, keep = np.zeros(x.shape[1]), np.diag(np.append(np.ones(x.shape[1] - 1), 1e-6))
    for _ in range(20):
        use = y * (x @ w) < 1
        xs, cs = x[use], cost * weight[use]
        h = keep + (xs * cs[:, None]).T @ xs
        new = np.linalg.solve(h, (xs * (cs * y[use])[:, None]).sum(0))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _weights(up: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights under which both labels weigh the same, a mean of 1 in all."""
    weight = np.ones(len(up)) if weight is None else weight
    total = np.where(up, weight[up].sum(), weight[~up].sum())
    return weight * len(up) / 2 / np.maximum(total, 1e-9)


def _calibrate(best: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """A logistic fit with a small ridge."""
    x = _inputs(best, count)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / np.abs(step).max())
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(texts: list[str], labels: list[int], p: Toxicity, ids: list[int]) -> Model:
    """The model of a labelled sample; every fifth text, by hash of its id, only calibrates."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(decay=p.decay)
    held = mix(np.array(ids, np.int64).astype(U) + U(99)) % U(5) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    words_of: dict[bytes, int] = {}
    shape: list[np.ndarray] = []
    sentences: list[list[int]] = []
    whose: list[int] = []
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for k in np.flatnonzero(~held).tolist():
        seen: set[int] = set()
        for _, text in _parts([texts[k]]):
            kind, stop = _classes(text)
            a, b = _words(kind)
            if not len(a):
                continue
            raw, row = kind.tobytes(), []
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                w = words_of.setdefault(raw[s:e], len(words_of))
                if w == len(shape):
                    shape.append(kind[s:e])
                row.append(w)
            seen.update(row)
            cuts = np.append(sentence_starts(a, stop), len(a))
            sentences += [row[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            whose += [k] * (len(cuts) - 1)
        df[int(y[k])].update(seen)
    if not sentences:
        return Model(decay=p.decay)
    # words that mark the label, and others by hash
    positive, negative = int(y[~held].sum()), int((~held).sum() - y[~held].sum())
    odds = sorted(df[1], key=lambda w: (-df[1][w] / positive * np.log((df[1][w] + 0.5) / positive / ((df[0][w] + 0.5) / negative)), w))
    common = sorted((w for w in range(len(shape)) if df[0][w] + df[1][w] > 2), key=lambda w: int(mix(np.array([w], U))[0]))
    chosen = [w for w in dict.fromkeys(odds[: p.landmarks * 5 // 8] + common) if len(shape[w]) > 2][: p.landmarks]
    m = len(chosen)
    if not m:
        return Model(decay=p.decay)
    # the marking words once more with characters put in: a gap in the middle, gaps all through, a letter
    variants: dict[int, list[int]] = {}
    for w in odds[: p.landmarks]:
        c = shape[w][: _WIDTH // 2]
        half, letter = len(c) // 2, int(mix(np.array([w], U))[0] % U(26)) + 1
        made = (np.insert(c, half, GAP), np.insert(c, np.arange(1, len(c)), GAP), np.insert(c, half, letter), np.insert(c, 1, GAP))
        variants[w] = list(range(len(shape), len(shape) + len(made)))
        shape += [x.astype(np.uint8) for x in made]
    flat = np.concatenate(shape)
    ends = np.cumsum([len(x) for x in shape])
    starts = ends - [len(x) for x in shape]
    norm = norms(p.decay)
    tables = {3: {}, 4: {}}  # subsequence -> its row in ``rows``
    rows: list[np.ndarray] = [np.zeros(m, np.float32)]
    for col, w in enumerate(chosen):
        for q, weight, index in _subsequences(_matrix(flat, starts[w : w + 1], ends[w : w + 1], _WIDTH), p.decay):
            if index[0]:
                at = tables[q].setdefault(int(index[0]), len(rows))
                if at == len(rows):
                    rows.append(np.zeros(m, np.float32))
                rows[at][col] += weight / norm[len(shape[w])]
    table = np.stack(rows)
    lookup = {3: np.zeros(CLASSES**3, np.int32), 4: np.zeros(CLASSES**4, np.int32)}
    for q in (3, 4):
        lookup[q][list(tables[q])] = list(tables[q].values())

    def kernels(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), m), np.float32)
        size = (ends - starts)[which]
        for low, width in ((0, 9), (8, 14), (13, _WIDTH)):
            pick = np.flatnonzero((size > low) & (size < width) if low else size < width)
            if len(pick):
                for q, weight, index in _subsequences(_matrix(flat, starts[which[pick]], ends[which[pick]], width), p.decay):
                    hit = lookup[q][index]
                    some = np.flatnonzero(hit)
                    out[pick[some]] += np.float32(weight) * table[hit[some]]
        return out / norm[size][:, None].astype(np.float32)

    values, vectors = np.linalg.eigh(kernels(np.array(chosen)).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
    whose_, truth = np.array(whose), y[np.array(whose)]
    order = np.argsort(mix(np.arange(len(sentences), dtype=U)))
    picked = np.sort(np.concatenate([order[truth[order] == c][: p.sentences // 2] for c in (0, 1)]))
    used = np.unique(np.concatenate([*(sentences[k] for k in picked), *variants.values()]))
    phi = (kernels(used) @ root).astype(np.float32)
    local = [np.searchsorted(used, sentences[k]) for k in picked]
    x = np.stack([phi[r].sum(0) / np.sqrt(len(r)) for r in local])
    doc, up = whose_[picked], truth[picked] > 0
    w, bias = _newton(x, np.where(up, 1, -1), _weights(up), p.cost)
    lengths = np.array([len(r) for r in local])
    flat_words, first = np.concatenate(local), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    clean = np.unique(flat_words[np.repeat(~up, lengths)])
    often = np.array([df[0][v] for v in used[clean]], float)
    for _ in range(p.rounds):
        score = phi @ w + bias
        top = np.maximum.reduceat(score[flat_words], first)
        order = np.lexsort((-score[flat_words], np.repeat(np.arange(len(local)), lengths)))
        witness = flat_words[order[first]]
        best = np.full(doc.max() + 1, -np.inf)
        np.maximum.at(best, doc, top)
        yes = np.unique(witness[up & ((top > 0) | (top == best[doc]))], return_counts=True)
        hard = clean[np.argsort(-score[clean], kind="stable")[: p.sentences // 4]]
        some = clean[np.argsort(mix(used[clean].astype(U)), kind="stable")[: p.sentences // 4]]
        no = np.unique(np.concatenate((hard, some)))
        more = [v for k in used[yes[0]].tolist() for v in variants.get(k, ())]
        more_at = np.searchsorted(used, np.array(more, np.int64))
        is_yes = np.arange(len(yes[0]) + len(more) + len(no)) < len(yes[0]) + len(more)
        weight = np.concatenate((np.log1p(yes[1]), np.ones(len(more)), np.log1p(often[np.searchsorted(clean, no)])))
        w, bias = _newton(phi[np.concatenate((yes[0], more_at, no))], np.where(is_yes, 1, -1), _weights(is_yes, weight), p.cost)
    # sentences as wholes: those of toxic documents that hold a witness against those of clean ones
    score = phi @ w + bias
    top = np.maximum.reduceat(score[flat_words], first)
    best = np.full(doc.max() + 1, -np.inf)
    np.maximum.at(best, doc, top)
    told = up & ((top > 0) | (top == best[doc]))
    w_all, bias_all = _newton(x[told | ~up], np.where(told[told | ~up], 1, -1), _weights(told[told | ~up]), p.cost)
    fold = (table @ (root @ np.column_stack([w, w_all]))).astype(np.float32)
    model = Model(decay=p.decay, bias=bias, sentence_bias=bias_all)
    for q, dense in ((3, model.w3), (4, model.w4)):
        dense[list(tables[q])] = fold[list(tables[q].values())]
    test = np.flatnonzero(held) if held.any() else np.arange(len(y))
    best, count = _Scorer(model).texts([texts[k] for k in test])
    model.calibration = _calibrate(best, count, y[test])
    return model


def train(docs: DataFrame, labels: DataFrame, params: Toxicity | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit, in one task, on a bounded sample of the labelled rows whose crc32(id) modulo ``folds`` is not 0."""
    p = params or Toxicity()
    key = F.col(id_col).cast("long")
    known = labels.select(key.alias("k"), F.col(label_col).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(F.crc32(F.col("k").cast("string").cast("binary")) % p.folds != 0).groupBy("k").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == c).orderBy(F.xxhash64("k"), "k").limit(n) for c, n in ((0, p.clean_rows), (1, p.toxic_rows))]
    # the sample's bound is the broadcast's bound, and that of the one task that fits the model
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(key.alias("k"), F.col(text_col).alias("text")).where(F.length("text") <= p.train_chars).join(sample, "k")
    rows = rows.orderBy(F.xxhash64("k"), "text").limit(2 * (p.clean_rows + p.toxic_rows))
    made = rows.repartition(1).mapInArrow(_fitter(p), "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else Model(decay=p.decay)


def _fitter(p: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[str, int]] = {}
        for batch in batches:
            for k, text, y in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "y")), strict=True):
                found[k] = min(found.get(k, (text, y)), (text, y))  # of rows with one id, always the same
        rows = sorted(found.items())
        model = fit([t for _, (t, _) in rows], [y for _, (_, y) in rows], p, [k for k, _ in rows])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})
        trim()

    return run


def _applier(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        if model.name not in _scorers:  # a worker keeps its word table between tasks
            _scorers.clear()
            _scorers[model.name] = _Scorer(model)
        scorer = _scorers[model.name]
        for batch in batches:
            column, out = batch.column("text"), []
            for lo in range(0, batch.num_rows, 64):
                out.append(scorer.probabilities(column.slice(lo, 64).to_pylist()))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score)], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


_scorers: dict[str, _Scorer] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the data
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(_applier(shipped), "doc_id long, score double")


def _keeper(shipped, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        if model.name not in _scorers:
            _scorers.clear()
            _scorers[model.name] = _Scorer(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            if texts:
                yield batch.filter(pa.array(_scorers[model.name].probabilities(texts) < 0.5))
        trim()

    return run


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score 0.5 or more, all columns kept."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeper(shipped, text_col), docs.schema)
