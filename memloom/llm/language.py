"""Language identification by error-correcting output codes.

Each language has a codeword. Binary logistic classifiers over hashed byte n-grams
predict its bits. A text goes to the codeword with the least loss, each bit weighted by
how well its classifier did on labelled texts set aside; if the second is close, the
row is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import bounded_chunks, held_out, keyed_sample, map_rows, table
from memloom.llm.grams import fit_logistic, gram_counts, normed

#: The fit reads at most this many documents of each language, none longer than FIT_CHARS.
FIT_DOCS, FIT_CHARS = 400, 20_000
GRAM_BITS = 12
#: Beyond this many languages, codewords are drawn instead of exhausting all splits.
EXHAUSTIVE = 6
#: Flag rows whose two best languages are closer than this in probability.
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """0/1 code (languages x bits): all splits of up to EXHAUSTIVE languages, else drawn ones far apart."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int64)
    if n <= EXHAUSTIVE:
        columns = [[(c >> k) & 1 for k in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns).T.reshape(n, -1)
    bits, best, far = int(np.ceil(12 * np.log2(n))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).integers(0, 2, size=(n, bits))
        if (code.min(axis=0) == code.max(axis=0)).any():
            continue
        near = (code[:, None, :] != code[None, :, :]).sum(axis=2)[np.triu_indices(n, 1)].min()
        if near > far:
            best, far = code, near
    return best


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, constants: np.ndarray, bit_weights: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        self.weights, self.constants, self.bit_weights = weights, constants, bit_weights

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, probability, ambiguous) of each text; no letter: und, 0."""
        langs, score, close = [], np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for k, text in enumerate(texts):
            if not self.languages or not any(c.isalpha() for c in text):
                langs.append(UNKNOWN)
                continue
            z = normed(gram_counts(text, GRAM_BITS)) @ self.weights + self.constants
            sign = 2 * self.code - 1
            loss = (np.logaddexp(0, -sign * z) * self.bit_weights).sum(axis=1)
            p = np.exp(loss.min() - loss)
            p /= p.sum()
            best = np.argsort(-p, kind="stable")
            langs.append(self.languages[best[0]])
            score[k] = p[best[0]]
            close[k] = len(p) > 1 and p[best[0]] - p[best[1]] < AMBIGUOUS
        return langs, score, close


def fit_languages(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Learn from the text and lang of documents that are not held out; a lang of no text is not learned.

    Without a labelled text the model knows no language and tells `und` of all; with one, that one.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.length("text").between(1, FIT_CHARS))
    sample = keyed_sample(known.select("doc_id", "lang", "text"), "doc_id", "lang", fit_docs)
    got = sample.toPandas().sort_values(["doc_id", "lang"]).reset_index(drop=True)
    got = got[np.array([any(c.isalpha() for c in t) for t in got["text"]], dtype=bool)]
    languages = sorted(got["lang"].unique().tolist())
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((1 << GRAM_BITS, 0)), np.zeros(0), np.zeros(0))
    x = normed(np.array([gram_counts(t, GRAM_BITS) for t in got["text"]]))
    y = codewords(len(languages))[np.searchsorted(languages, got["lang"])]
    aside = np.arange(len(x)) % 5 == 0
    w, c = fit_logistic(x[~aside], y[~aside])
    right = (((x[aside] @ w + c) > 0) == y[aside]).mean(axis=0).clip(0.5, 0.999)
    bit_weights = np.log(right / (1 - right)).clip(0.05)
    return LanguageModel(languages, w, c, bit_weights / bit_weights.mean())


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous) for every row, from its whole text and nothing else.

    Null, empty and letterless texts: und, 0. Repeated rows fare alike. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** GRAM_BITS weights per code bit

    def prepare():
        def told(rows):
            for _, part in bounded_chunks([t or "" for t in rows["t"]]):
                yield [(lang, float(p), bool(c)) for lang, p, c in zip(*shared.value.predict(part), strict=True)]

        return told

    return map_rows(docs, key, {"t": F.col(text)}, "lang_pred string, score double, ambiguous boolean", prepare)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score, ambiguous."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
