"""Language identification of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from venuekit.llm.common import replace_columns

MAX_DOCUMENTS = 600  # labelled documents, the first in hash order, whole texts
FEATURE_BITS = 18
PIECE, BLOCK_WORDS = 32, 200_000  # words of a piece of a chain, and of the texts labelled at once
TRAIN_PIECE = 64
STEPS, RATE, PENALTY = 20, 0.3, 1e-6
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of word characters with a letter; fractions, raised digits and number signs alone are none."""
    return [w for w in _WORD.findall(text.lower()) if _has_letter(w)]


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def word_features(word: str, lexicons: dict[str, frozenset]) -> list[int]:
    """Hashed affixes, character n-grams and lexicon memberships of a word."""
    marked = f"<{word}>"
    names = ["p" + word[:1], "p" + word[:2], "p" + word[:3], "e" + word[-1:], "e" + word[-2:], "e" + word[-3:], f"s{len(word)}"]
    names += {marked[i : i + 2] for i in range(len(marked) - 1)}
    names += {marked[i : i + 3] for i in range(len(marked) - 2)}
    names += ["l" + lang for lang, known in lexicons.items() if word in known]
    return [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS), *map(_slot, names)]


@lru_cache(maxsize=2**18)
def _slot(name: str) -> int:
    """Hash of a short feature; affixes and n-grams repeat from word to word."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - FEATURE_BITS)


def learn_lexicons(texts: list[list[str]], labels: list[str]) -> dict[str, frozenset]:
    """The words that a language shows twice or more, and more than twice as often as any other language."""
    counts: dict[str, Counter] = {}
    for words, label in zip(texts, labels):
        counts.setdefault(label, Counter()).update(words)
    totals = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
    out = {}
    for lang, c in counts.items():
        other = lambda w, lang=lang: max((k[w] / totals[o] for o, k in counts.items() if o != lang), default=0)
        out[lang] = frozenset(w for w, n in c.items() if n > 1 and n / totals[lang] > 2 * other(w))
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Marginals of padded sequences ``scores`` (sequence, place, label), longest first.

    Probabilities are scaled at each place. With ``pairs`` also the expected number of moves, summed.
    """
    n, t, k = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    step, first = np.exp(move - move.max()), np.exp(start - start.max())
    active = [int((lengths > i).sum()) for i in range(t)]
    ahead = np.zeros((n, t, k))
    ahead[:, 0] = first * emit[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = active[i]
        x = (ahead[:a, i - 1] @ step) * emit[:a, i]
        ahead[:a, i] = x / x.sum(1, keepdims=True)
    behind = np.ones((n, k))
    out = np.zeros((n, t, k))
    moves = np.zeros((k, k))
    for i in range(t - 1, -1, -1):
        a = active[i]
        m = ahead[:a, i] * behind[:a]
        out[:a, i] = m / m.sum(1, keepdims=True)
        if i:
            right = emit[:a, i] * behind[:a]
            if pairs:
                joint = ahead[:a, i - 1, :, None] * step * right[:, None, :]
                moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            left = right @ step.T
            behind[:a] = left / left.sum(1, keepdims=True)
    return out, moves


def train(texts: list[list[str]], labels: list[str], languages: list[str], steps: int = STEPS) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Lexicons, feature weights, start and move weights, by gradient ascent on the conditional likelihood.

    Long sequences are fitted in pieces, so that blocks stay small. Neighbours are joined in pairs, so the
    chain sees moves between languages too.
    """
    lexicons = learn_lexicons(texts, labels)
    k = len(languages)
    pieces = [(words[i : i + TRAIN_PIECE], label) for words, label in zip(texts, labels) for i in range(0, len(words), TRAIN_PIECE)]
    sequences = [(w, [languages.index(label)] * len(w)) for w, label in pieces]
    sequences += [(a[0] + b[0], a[1] + b[1]) for a, b in zip(sequences[::2], sequences[1::2])]
    sequences.sort(key=lambda s: -len(s[0]))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s[0]))}
    features = [word_features(w, lexicons) for w in vocabulary]
    sizes = np.array([len(f) for f in features])
    flat, begins = np.concatenate(features), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lengths = np.array([len(s[0]) for s in sequences])
    # per group of sequences the row, place, word and true label of every word
    groups = []
    d_gold_start, d_gold_move = np.zeros(k), np.zeros((k, k))
    for i in range(0, len(sequences), 512):
        part, n_words = sequences[i : i + 512], lengths[i : i + 512]
        rows = np.repeat(np.arange(len(part)), n_words)
        places = np.concatenate([np.arange(n) for n in n_words])
        ids = np.array([vocabulary[w] for s in part for w in s[0]])
        gold = np.concatenate([s[1] for s in part])
        np.add.at(d_gold_start, gold[places == 0], 1)
        inner = np.flatnonzero(places > 0)
        np.add.at(d_gold_move, (gold[inner - 1], gold[inner]), 1)
        groups.append((rows, places, ids, gold, n_words))
    weights, start, move = np.zeros((2**FEATURE_BITS, k)), np.zeros(k), np.zeros((k, k))
    sums = [np.zeros_like(weights), np.zeros_like(start), np.zeros_like(move)]
    total = lengths.sum()
    for _ in range(steps):
        word_scores = np.add.reduceat(weights[flat], begins, axis=0)
        residual, d_start, d_move = np.zeros((len(vocabulary), k)), d_gold_start.copy(), d_gold_move.copy()
        for rows, places, ids, gold, n_words in groups:
            scores = np.zeros((len(n_words), n_words[0], k))
            scores[rows, places] = word_scores[ids]
            marginals, moves = forward_backward(scores, n_words, start, move, pairs=True)
            d_start -= marginals[:, 0].sum(0)
            d_move -= moves
            errors = -marginals[rows, places]
            errors[np.arange(len(ids)), gold] += 1
            residual += np.stack([np.bincount(ids, errors[:, c], len(vocabulary)) for c in range(k)], 1)
        spread = np.repeat(residual, sizes, axis=0)
        d_weights = np.stack([np.bincount(flat, spread[:, c], 2**FEATURE_BITS) for c in range(k)], 1)
        for value, grad, seen in ((weights, d_weights, sums[0]), (start, d_start, sums[1]), (move, d_move, sums[2])):
            grad = grad / total - PENALTY * value
            seen += grad**2
            value += RATE * grad / (np.sqrt(seen) + 1e-8)
    return lexicons, weights.astype(np.float32), start, move


def label_shares(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Mean label marginals of each text, all of at least one word, from the flat ``scores`` (word, label).

    Exact forward-backward, in pieces of ``PIECE`` words that advance together: the product of a piece's
    moves carries what comes before and after it across, so only pieces, not words, follow one another.
    """
    k, n = scores.shape[1], len(lengths)
    step, first = np.exp(move - move.max()), np.exp(start - start.max())
    emit = np.exp(scores - scores.max(1, keepdims=True))
    counts = -(-lengths // PIECE)
    begins = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(n), counts)
    rank = np.arange(begins[-1]) - begins[text]
    sizes = np.minimum(PIECE, lengths[text] - rank * PIECE)
    order = np.argsort(-sizes, kind="stable")
    sizes, opening = sizes[order], rank[order] == 0
    offset = ((np.cumsum(lengths) - lengths)[text] + rank * PIECE)[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    active = [int((sizes > i).sum()) for i in range(int(sizes[0]))]

    whole = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for i, a in enumerate(active):
        x = (whole[:a].reshape(-1, k) @ step).reshape(a, k, k)
        if i == 0:
            x[opening] = first
        x *= emit[offset[:a] + i][:, None, :]
        whole[:a] = x / x.max((1, 2), keepdims=True)
    before, after = np.full((len(order), k), 1.0 / k), np.ones((len(order), k))
    for r in range(1, int(counts.max())):
        here = np.flatnonzero(counts > r)
        left, at = place[begins[here] + r - 1], place[begins[here] + r]
        x = (before[left][:, None, :] @ whole[left])[:, 0]
        before[at] = x / x.sum(1, keepdims=True)
        at, right = place[begins[here + 1] - 1 - r], place[begins[here + 1] - r]
        x = (whole[right] @ after[right][:, :, None])[:, :, 0]
        after[at] = x / x.sum(1, keepdims=True)

    ahead, last = np.empty((len(active), len(order), k)), before
    for i, a in enumerate(active):
        x = last[:a] @ step
        if i == 0:
            x[opening] = first
        x *= emit[offset[:a] + i]
        last = ahead[i, :a] = x / x.sum(1, keepdims=True)
    shares, behind = np.zeros((len(order), k)), after
    for i in range(len(active) - 1, -1, -1):
        a = active[i]
        m = ahead[i, :a] * behind[:a]
        shares[:a] += m / m.sum(1, keepdims=True)
        x = (emit[offset[:a] + i] * behind[:a]) @ step.T
        behind[:a] = x / x.sum(1, keepdims=True)
    out = np.stack([np.bincount(text[order], shares[:, c], n) for c in range(k)], 1)
    return out / lengths[:, None]


class WordScores(dict):
    """Place of a word in a growing table of scores; -1 for a word without a letter."""

    def __init__(self, lexicons: dict, weights: np.ndarray):
        super().__init__()
        self.lexicons, self.weights = lexicons, weights
        self.new: list[str] = []
        self.table = np.empty((0, weights.shape[1]))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.table) + len(self.new) if _has_letter(word) else -1
        if at >= 0:
            self.new.append(word)
        return at

    def scores(self, places: np.ndarray) -> np.ndarray:
        if self.new:
            features = [word_features(w, self.lexicons) for w in self.new]
            sizes = np.cumsum([0] + [len(f) for f in features])
            added = np.add.reduceat(self.weights[np.concatenate(features)], sizes[:-1], axis=0)
            self.table, self.new = np.concatenate([self.table, added]), []
        return self.table[places]


def label_documents(texts: list[str | None], model: tuple) -> list[np.ndarray | None]:
    """Mean label marginals over the words of each text; None for a text without a letter."""
    start, move, known = model
    out: list[np.ndarray | None] = [None] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    n_words = 0
    for i, text in enumerate(texts):
        places = np.array([known[w] for w in _WORD.findall((text or "").lower())], np.int64)
        places = places[places >= 0]
        if len(places):
            held.append((i, places))
            n_words += len(places)
        if held and (n_words >= BLOCK_WORDS or i + 1 == len(texts)):
            shares = label_shares(known.scores(np.concatenate([p for _, p in held])), np.array([len(p) for _, p in held]), start, move)
            for (j, _), share in zip(held, shares):
                out[j] = share
            held, n_words = [], 0
            if len(known) > CACHE_WORDS:
                known.clear()
                known.table = known.table[:0]
    return out


def identify_languages(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Every document with ``lang_pred`` and ``score``; columns of those names are replaced.

    The field is fitted on at most ``max_documents`` labelled documents that satisfy ``train_on``, the
    first in hash order, in one task of bounded size; the labels are never read for a prediction. Each
    word of a text is labelled by forward-backward; ``score`` is the mean share of the winning label.

    Long lines are fitted in pieces of ``TRAIN_PIECE`` words and labelled whole. Null texts and texts
    without a letter (a character of a Unicode letter class) are ``und`` with score 0. Ties go to the first label in order.
    Repeated rows get equal results. Without labelled documents all texts are ``und``.
    """
    labelled = docs.filter(train_on & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")).cast("binary"))
    keys = labelled.select(hashed.alias("h"))
    # the keys alone are ordered; texts move only for the sample, repeated rows once
    cut = keys.distinct().orderBy("h").limit(max_documents).agg(F.max("h")).first()[0]
    chosen = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang"), hashed.alias("h")).filter(F.col("h") <= cut)
    sample = chosen.groupBy("h").agg(F.min(F.struct("t", "lang")).alias("s")).select("h", "s.*")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"t": [], "lang": [], "h": []})]).sort_values("h")
        texts, labels, languages = [], [], sorted(rows["lang"].unique())
        for text, lang in zip(rows["t"], rows["lang"]):
            for line in text.split("\n"):
                texts.append(words_of(line))
                labels.append(lang)
        if languages and any(texts):
            lexicons, weights, start, move = train(texts, labels, languages)
            used = np.flatnonzero(np.abs(weights).sum(1) > 0)
            known = [f"{lang}\n{w}" for lang, ws in lexicons.items() for w in sorted(ws)]
            yield pd.DataFrame([(languages, known, start.tolist(), move.ravel().tolist(), used.tolist(), weights[used].ravel().tolist())],
                               columns=["languages", "lexicon", "start", "move", "used", "weights"])

    schema = "languages array<string>, lexicon array<string>, start array<double>, move array<double>, used array<int>, weights array<float>"
    fitted = sample.coalesce(1).mapInPandas(fit, schema).collect()  # one model of at most 2^FEATURE_BITS features
    base = replace_columns(docs, "lang_pred", "score", "_lang")
    if not fitted:
        return base.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    m = fitted[0]
    k = len(m.languages)
    weights = np.zeros((2**FEATURE_BITS, k), np.float32)
    weights[m.used] = np.array(m.weights, np.float32).reshape(-1, k)
    lexicons: dict[str, set] = {}
    for entry in m.lexicon:
        lang, word = entry.split("\n")
        lexicons.setdefault(lang, set()).add(word)
    shared = docs.sparkSession.sparkContext.broadcast((lexicons, weights, np.array(m.start), np.array(m.move).reshape(k, k)))
    languages = list(m.languages)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicons, weights, start, move = shared.value
        model = (start, move, WordScores(lexicons, weights))
        for texts in batches:
            out = []
            values = texts.tolist()
            for i in range(0, len(values), 1000):
                for p in label_documents(values[i : i + 1000], model):
                    best = None if p is None else int(np.argmax(np.round(p, 9)))
                    out.append(("und", 0.0) if p is None else (languages[best], float(min(1.0, p[best]))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    predicted = F.pandas_udf(predict, "lang_pred string, score double")
    return base.withColumn("_lang", predicted(F.col(text_col))).select(*base.columns, "_lang.*")
