"""Toxicity: a counterfactual-regularised linear classifier over words and word stems.

Training rows are labelled documents of the training folds, at most ``ROWS`` of them (the smallest by a hash of the
doc_id: a bound on what the driver holds).  Features are the presence of words and of stems (the first ``STEM`` letters of
longer words, so that an inflected form that was never seen counts too), of those all whose association with the label would
arise by chance less than once among all candidates, and of identity terms.  The loss is the logistic loss with an L2 term
and, for every training document that names a group, the squared change of its score when the term is swapped for each
other group's term of that language, or for a neutral word.  So a group's name alone moves the score as little as any
other group's, and hardly at all.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound on labelled rows that are fitted on, letters of a stem, and the weight of the L2 and the counterfactual terms.
ROWS, STEM, RIDGE, SWAP = 6000, 5, 0.1, 10.0
FOLDS, HELD_OUT = 5, 0
# Group names by language; those of one language are swapped for one another in training.
IDENTITY = {
    "en": (
        "asian", "asians", "black", "blacks", "white", "whites", "latino", "latinos", "arab", "arabs", "african", "africans", "immigrant", "immigrants", "refugee", "refugees",
        "christian", "christians", "jew", "jews", "jewish", "muslim", "muslims", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists",
        "man", "men", "woman", "women", "gay", "gays", "lesbian", "lesbians", "bisexual", "transgender", "queer", "straight",
        "deaf", "blind", "disabled", "autistic", "old", "elderly", "young", "teenager", "teenagers",
    ),
    "fr": (
        "asiatique", "asiatiques", "noir", "noirs", "blanc", "blancs", "arabe", "arabes", "africain", "africains", "immigré", "immigrés", "réfugié", "réfugiés", "chrétien", "chrétiens", "juif", "juifs",
        "musulman", "musulmans", "hindou", "hindous", "bouddhiste", "bouddhistes", "athée", "athées", "homme", "hommes", "femme", "femmes", "homosexuel", "homosexuels", "lesbienne", "lesbiennes",
        "transgenre", "transgenres", "sourd", "sourds", "aveugle", "aveugles", "handicapé", "handicapés", "vieux", "jeune", "jeunes",
    ),
    "de": (
        "asiate", "asiaten", "schwarze", "schwarzen", "weiße", "weißen", "araber", "afrikaner", "einwanderer", "flüchtling", "flüchtlinge", "christ", "christen", "jude", "juden",
        "muslim", "muslime", "hindu", "hindus", "buddhist", "buddhisten", "atheist", "atheisten", "mann", "männer", "frau", "frauen", "schwule", "schwulen", "lesbe", "lesben",
        "gehörlose", "gehörlosen", "blinde", "blinden", "behinderte", "behinderten", "alte", "alten", "junge", "jungen",
    ),
    "es": (
        "asiático", "asiáticos", "negro", "negros", "blanco", "blancos", "árabe", "árabes", "africano", "africanos", "inmigrante", "inmigrantes", "refugiado", "refugiados", "cristiano", "cristianos",
        "judío", "judíos", "musulmán", "musulmanes", "hindú", "hindúes", "budista", "budistas", "ateo", "ateos", "hombre", "hombres", "mujer", "mujeres", "homosexual", "homosexuales",
        "lesbiana", "lesbianas", "transgénero", "sordo", "sordos", "ciego", "ciegos", "discapacitado", "discapacitados", "viejo", "viejos", "joven", "jóvenes",
    ),
}
_NAMED = frozenset(term for terms in IDENTITY.values() for term in terms)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words (runs of letters) of the whole text."""
    return set(_WORD.findall(text.lower())) if text else set()


def stem_of(word: str) -> str | None:
    """The stem that a word counts for too, marked ``*``; short words and identity terms have none."""
    return f"{word[:STEM]}*" if len(word) > STEM and word not in _NAMED else None


class Model:
    """Weights by word or stem and a bias; ``score`` is the probability of label 1."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._words = frozenset(w for w in weights if not w.endswith("*"))
        self._stems = frozenset(w[:-1] for w in weights if w.endswith("*"))

    def score(self, text: str | None) -> float:
        words = words_of(text)
        met = self._words & words
        if self._stems:
            met |= {f"{w[:STEM]}*" for w in words if w[:STEM] in self._stems and stem_of(w)}
        z = self.bias + sum(self.weights[w] for w in sorted(met))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _coded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and feature of every word and stem that a document has (each pair once), and the features' names.  Numbers and Arrow
    strings only: the vocabulary is many times the features that are kept."""
    start, end = words.offsets[0].as_py(), words.offsets[-1].as_py()
    coded = pc.dictionary_encode(words.values.slice(start, end - start))
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    vocabulary = coded.dictionary
    stemmed = pc.and_(pc.greater(pc.utf8_length(vocabulary), STEM), pc.invert(pc.is_in(vocabulary, value_set=pa.array(sorted(_NAMED)))))
    stems = pc.dictionary_encode(pc.if_else(stemmed, pc.binary_join_element_wise(pc.utf8_slice_codeunits(vocabulary, 0, STEM), "*", ""), None))
    stem = stems.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n, kinds = len(vocabulary), max(1, len(stems.dictionary))
    of_word = stem[code] if len(code) else code
    pairs = np.unique(row[of_word >= 0] * np.int64(kinds) + of_word[of_word >= 0])
    return np.concatenate([row, (pairs // kinds).astype(np.int32)]), np.concatenate([code, (pairs % kinds + n).astype(np.int32)]), pa.concat_arrays([vocabulary, stems.dictionary])


def _least_chi2(candidates: int) -> float:
    """The chi-square (one degree of freedom) that less than one of so many candidates reaches by chance."""
    low, high = 0.0, 1500.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if candidates * math.erfc(math.sqrt(mid / 2)) >= 1 else (low, mid)
    return high


def _swaps(row: np.ndarray, code: np.ndarray, groups: list[list[int]], d: int, n: int) -> np.ndarray:
    """The matrix of the counterfactual term, a quadratic form: for every document and term ``a`` in it, ``w_a^2`` for the
    neutral word, and on average over the other terms ``b`` of the language ``(w_b - w_a)^2``, or ``w_a^2`` where the document
    has ``b`` already and the swap only takes ``a`` out."""
    out = np.zeros((d, d))
    for terms in groups:
        place = np.full(d, -1)
        place[terms] = np.arange(len(terms))
        kept = place[code] >= 0
        has = np.zeros((n, len(terms)))
        has[row[kept], place[code[kept]]] = 1
        both = has.T @ has
        for i, a in enumerate(terms):
            out[a, a] += both[i, i]
            for j, b in enumerate(terms):
                if i != j:
                    share, alone = 1 / (len(terms) - 1), both[i, i] - both[i, j]
                    out[a, a] += both[i, i] * share
                    out[b, b] += alone * share
                    out[a, b] -= alone * share
                    out[b, a] -= alone * share
    return out


def _minimum(row: np.ndarray, code: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights and (last) bias of the least penalised logistic loss, by Newton steps on the features' counts."""
    n, d = len(y), len(penalty)
    x = np.zeros((n, d + 1))
    x[row, code] = 1
    x[:, d] = 1
    full = np.zeros((d + 1, d + 1))
    full[:d, :d] = penalty
    full[d, d] = 1e-9
    w = np.zeros(d + 1)
    w[d] = np.log(y.sum() / (n - y.sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (p - y) + full @ w
        hessian = full.copy()
        for at in range(0, n, 1024):  # in blocks: no second table of the size of x
            part = x[at : at + 1024]
            hessian += (part * np.maximum(p * (1 - p), 1e-9)[at : at + 1024, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(words: pa.ListArray, labels: np.ndarray, ridge: float = RIDGE, swap: float = SWAP) -> Model:
    """Fit on distinct words per document.  Without rows of both labels the score is the labels' mean everywhere."""
    n, positive = len(labels), int(labels.sum())
    if not n or positive in (0, n):
        rate = min(max(positive / n, 1e-6), 1 - 1e-6) if n else 1e-6
        return Model({}, float(np.log(rate / (1 - rate))))
    row, code, names = _coded(words)
    seen = np.bincount(code, minlength=len(names)).astype(float)
    hit = np.bincount(code[labels[row] > 0], minlength=len(names)).astype(float)
    expected = seen * positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.nan_to_num((hit - expected) ** 2 / expected + (hit - expected) ** 2 / (seen - expected)) / np.maximum(1 - seen / n, 1e-9)
    named = pc.is_in(names, value_set=pa.array(sorted(_NAMED))).to_numpy(zero_copy_only=False)
    found = np.flatnonzero((chi2 >= _least_chi2(len(names))) | named)
    known = names.take(pa.array(found)).to_pylist()
    order = sorted(range(len(found)), key=known.__getitem__)
    chosen, known = found[order], [known[k] for k in order]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[code] >= 0
    row, code, d = row[kept], place[code[kept]], len(chosen)
    at = {name: i for i, name in enumerate(known)}
    groups = [[at[t] for t in terms if t in at] for terms in IDENTITY.values()]
    penalty = np.eye(d) * ridge + 2 * swap * _swaps(row, code, groups, d, n)
    w = _minimum(row, code, labels, penalty)
    return Model({name: round(float(v), 9) for name, v in zip(known, w[:d], strict=True)}, round(float(w[d]), 9))


def _fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold.

    Rows with a null doc_id or label are not used; of several labels of one doc_id the largest counts, of several texts the
    smallest, so that never more than ``rows`` rows reach the driver.
    """
    key = F.crc32(F.col("doc_id").cast("long").cast("string"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(key % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sorted(words_of(t.as_py())) for t in batch.column(1)], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    # ``sample`` has at most ``rows`` rows, so it can be sent to every executor.
    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    words = once.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, words array<string>")
    # copies of a text with one label count once
    found = words.groupBy("words", "toxic").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").select("words", "toxic").toArrow()
    if not found.num_rows:
        return fit(pa.array([], pa.list_(pa.string())), np.zeros(0))
    lists = found.column("words").combine_chunks()
    model = fit(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists, (found.column("toxic").to_numpy() > 0).astype(float))
    del found, lists
    pa.default_memory_pool().release_unused()
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score double, predicted int`` (1 from 0.5 on) appended, from the whole text alone (null: empty).

    One row per input row; all other columns pass; existing columns of these two names are replaced.  Map-only.
    """
    out = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]

    def run(batches):
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column("text")], float)
            kept = [batch.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*(f.name for f in out), "score", "predicted"])

    fields = T.StructType([*out, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in out)).mapInArrow(run, fields)


def held_out(doc_id="doc_id"):
    """Whether a row is in the fold that no model is fitted on."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT
