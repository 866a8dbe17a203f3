"""Toxicity by a chain of linear classifiers, each of which sees the probabilities of those before it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from venuekit.llm.common import replace_columns

# Words that mark the kinds of a document labelled toxic. The last link is the label itself.
CATEGORIES = {
    "insult": "idiot moron stupid clown loser fool dumb".split(),
    "contempt": "pathetic worthless scum useless disgrace".split(),
    "disgust": "disgusting trash garbage filthy vile".split(),
}
CHAIN = [*CATEGORIES, "toxic"]
MAX_DOCUMENTS = 20_000  # labelled documents, the first in hash order, whole texts
MIN_DOCUMENTS, MIN_Z, MAX_FEATURES, FOLDS = 5, 4.0, 5_000, 5
STEPS, RATE, PENALTY = 200, 0.5, 1e-3
FEATURE_BITS = 22
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Hashes of the word and of its beginning."""
    names = [f"w{word}", f"p{word[:5]}"] if len(word) > 5 else [f"w{word}"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS) for n in names]


def document_features(text: str) -> np.ndarray:
    """Distinct feature codes of a whole text, sorted."""
    codes = {f for w in {w.lower() for w in _WORD.findall(text)} for f in features_of(w)}
    return np.array(sorted(codes), np.int32)


def _probability(total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression with balanced classes, from the documents marked in ``use``.

    A document has the features ``cols`` at its places in ``rows``, ``width`` in all, and a row of ``dense``.
    """
    n, w, seen = len(y), np.zeros(width + dense.shape[1]), np.zeros(width + dense.shape[1])
    yes, no = use & (y == 1), use & (y == 0)
    weight = yes * (0.5 / max(1, yes.sum())) + no * (0.5 / max(1, no.sum()))
    for _ in range(STEPS):
        error = weight * (y - _probability(margins(rows, cols, n, dense, w)))
        grad = np.concatenate([np.bincount(cols, error[rows], width), dense.T @ error]) - PENALTY * w
        seen += grad**2
        w += RATE * grad / (np.sqrt(seen) + 1e-8)
    return w


def margins(rows: np.ndarray, cols: np.ndarray, n: int, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each document's features and of its ``dense`` values."""
    width = len(w) - dense.shape[1]
    return np.bincount(rows, w[cols], n) + dense @ w[width:]


def fit_chain(texts: Iterator[str], toxic: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Chosen features, their weights per link, and per link the weights of earlier links and the intercept.

    A later link learns from out-of-fold probabilities of the earlier ones, so it sees them as they
    will be on new documents. Documents are kept as arrays of feature codes, never as a matrix.
    """
    sets = [document_features(t) for t in texts]
    n, n_bad = len(sets), max(1, int(toxic.sum()))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.int32)])
    del sets
    owner = np.repeat(np.arange(n), sizes)
    seen, bad = np.bincount(flat, minlength=2**FEATURE_BITS), np.bincount(flat[toxic[owner]], minlength=2**FEATURE_BITS)
    rate = n_bad / max(1, n)
    z = np.where(seen >= MIN_DOCUMENTS, (bad - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1e-9), 0.0)
    strong = np.flatnonzero(z > MIN_Z)
    chosen = np.sort(strong[np.lexsort((strong, -z[strong]))][:MAX_FEATURES])
    place = np.full(2**FEATURE_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    used = place[flat] >= 0
    rows, cols = owner[used], place[flat[used]]
    fold = np.arange(n) % FOLDS
    dense = np.ones((n, 1))  # earlier links, then the intercept
    link_weights = np.zeros((len(CHAIN), len(chosen)))
    chain_weights = np.zeros((len(CHAIN), len(CHAIN)))
    for link, name in enumerate(CHAIN):
        y = toxic.astype(np.float64)
        if name in CATEGORIES:
            marked = np.isin(flat, [features_of(m)[0] for m in CATEGORIES[name]])
            y = y * (np.bincount(owner[marked], minlength=n) > 0)
        w = fit_logistic(rows, cols, len(chosen), dense, y, np.ones(n, bool))
        held = np.zeros(n)
        for f in range(FOLDS):
            inside = fold == f
            if inside.any() and not inside.all():
                part = fit_logistic(rows, cols, len(chosen), dense, y, ~inside)
                held[inside] = _probability(margins(rows, cols, n, dense, part))[inside]
        link_weights[link] = w[: len(chosen)]
        chain_weights[link, :link] = w[len(chosen) : -1]
        chain_weights[link, -1] = w[-1]
        dense = np.hstack([dense[:, :-1], held[:, None], dense[:, -1:]])
    return chosen.tolist(), link_weights, chain_weights


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   threshold: float = 0.6, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Every document with ``p_insult, p_contempt, p_disgust, p_toxic`` and ``toxic``; columns so named are replaced.

    The chain is fitted on at most ``max_documents`` labelled documents, the first in hash order, in
    one task of bounded size. Only that many ids are broadcast to find their texts. Scoring reads every
    word of every text.

    A null or empty text counts as one without marks. Labels that are null or name no document are
    left out; repeated labels count once, a toxic one first. Repeated rows score alike. Without
    labelled documents every probability is null and ``toxic`` false.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    sample = known.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(max_documents)
    found = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(sample), F.col(id_col) == F.col("_id"))
    order = F.md5(F.concat_ws("|", F.col("_id").cast("string"), F.xxhash64(text_col).cast("string")).cast("binary"))
    keyed = found.select(order.alias("h"), F.col(text_col).alias("t"), F.col("_y").cast("int").alias("y"))
    # repeated ids could exceed the sample's bound, so the limit holds for documents too: the keys alone are ordered
    cut = keyed.select("h").distinct().orderBy("h").limit(max_documents).agg(F.max("h")).first()[0]
    rows = keyed.filter(F.col("h") <= cut).groupBy("h").agg(F.min(F.struct("t", "y")).alias("s")).select("h", "s.*")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = pd.concat([*batches, pd.DataFrame({"h": [], "t": [], "y": []})]).sort_values("h")
        if len(data):
            chosen, links, chain = fit_chain(iter(data["t"]), data["y"].to_numpy(dtype=int) > 0)
            yield pd.DataFrame([(chosen, links.ravel().tolist(), chain.ravel().tolist())], columns=["features", "links", "chain"])

    fitted = rows.coalesce(1).mapInPandas(fit, "features array<int>, links array<double>, chain array<double>").collect()
    names = [f"p_{c}" for c in CHAIN]
    base = replace_columns(docs, *names, "toxic", "_p")
    if not fitted:
        return base.withColumns({n: F.lit(None).cast("double") for n in names} | {"toxic": F.lit(False)})
    m = fitted[0]
    links = np.array(m.links).reshape(len(CHAIN), -1)
    model = {f: links[:, i] for i, f in enumerate(m.features)}  # at most MAX_FEATURES features
    chain = np.array(m.chain).reshape(len(CHAIN), len(CHAIN))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple] = {}
        for texts in batches:
            out = []
            for text in texts:
                hits: set[int] = set()
                for w in set(_WORD.findall(text or "")):
                    f = cache.get(w)
                    if f is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        f = cache[w] = tuple(x for x in features_of(w.lower()) if x in model)
                    if f:
                        hits.update(f)
                marks = sum((model[f] for f in sorted(hits)), np.zeros(len(CHAIN)))
                p: list[float] = []
                for link in range(len(CHAIN)):
                    total = marks[link] + chain[link, -1] + sum(c * q for c, q in zip(chain[link], p))
                    p.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
                out.append(p)
            yield pd.DataFrame(out, columns=names)

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    predicted = F.pandas_udf(predict, ", ".join(f"{n} double" for n in names))
    scored = base.withColumn("_p", predicted(F.col(text_col))).select(*base.columns, "_p.*")
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
