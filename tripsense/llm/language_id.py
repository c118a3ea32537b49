"""Language identification by mixture inference over character n-grams.

Training counts hashed character trigrams per language (a fixed number of bins, so the
model's size is bins times languages whatever the corpus). A document is then taken as a
mixture: each trigram is drawn from one language, chosen with the document's proportions.
Expectation-maximisation estimates the proportions; the set of languages is the prefix of
the languages in order of their proportion that maximises the log likelihood less a
penalty per language (half the log of the number of trigrams, times ``penalty``).

Letters are lower-cased, everything else separates words; a trigram may hold one word
boundary on either side. All documents of a slice go through EM together.

Defined results: NULL text or text without a letter gives ``und`` with score 0; documents
without a language, or with empty text, teach nothing; without any training rows every
document is ``und``; repeated rows repeat their result; more than ``MAX_LANGUAGES``
distinct language values is an error (the model is broadcast: bins x languages x 4 bytes); languages that
explain a text equally well are taken in the order of their names; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripsense.llm.segments import mix64, slices

BITS = 16
BINS = 1 << BITS
MAX_LANGUAGES = 512
SMOOTHING = 0.05
PENALTY = 2.0
_ROUNDS = 12
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams whose middle is a letter, and how many each text has."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                               # one separator after each word
    keep[0] = True
    begin = np.cumsum([1] + [len(t) + 1 for t in lower])
    at = np.concatenate([[0], np.cumsum(keep)])[begin]
    short = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    middle = letter[keep][1:-1]
    mixed = mix64(short[:-2] * np.uint64(0x1F35D7B1) + (short[1:-1] << np.uint64(21)) * np.uint64(0x2545F491)
                  + (short[2:] << np.uint64(42)))
    bins = (mixed >> np.uint64(64 - BITS)).astype(np.uint32)[middle]
    upto = np.concatenate([[0], np.cumsum(middle)])
    return bins, np.diff(upto[np.clip(at - 1, 0, len(middle))])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the probabilities of their bins, counted over all rows of ``docs``."""
    letters = docs.sparkSession.sparkContext.broadcast(letter_table())

    def count(stream):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for batch in stream:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([t.encode("utf-8", "replace") for t in texts]):
                bins, per = trigrams(texts[a:b], letters.value)
                owner = np.repeat(np.arange(b - a), per)
                names = np.array(langs[a:b], object)
                for lang in set(langs[a:b]):
                    mine = (names == lang)[owner]
                    if lang not in seen:
                        seen[lang] = np.zeros(BINS, np.int64)
                    seen[lang] += np.bincount(bins[mine], minlength=BINS)
        for lang, n in seen.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()),
                                              pa.array(n[some], pa.int64())], ["lang", "bin", "n"])

    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col)).filter(
        F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    if rows.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # BINS entries a language at most, whatever the corpus; one language at a time comes to the driver
    counts = (rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
              .groupBy("lang").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts")))
    columns = {}
    for row in counts.toLocalIterator():
        column = np.full(BINS, SMOOTHING)
        column[np.array(row["bins"], np.int64)] += np.array(row["counts"], np.float64)
        columns[row["lang"]] = (column / column.sum()).astype(np.float32)
    names = sorted(columns)
    return names, np.stack([columns[x] for x in names], axis=1) if names else np.zeros((BINS, 0), np.float32)


def _em(p: np.ndarray, c: np.ndarray, owner: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions after ``rounds`` EM steps and their log likelihood, per document."""
    total = np.add.reduceat(c, first)
    for k in range(rounds + 1):
        w = p * share[owner]
        all_ = w.sum(axis=1)
        if k == rounds:
            return share, np.add.reduceat(c * np.log(np.maximum(all_, 1e-30)), first)
        share = np.add.reduceat(w * (c / np.maximum(all_, 1e-30))[:, None], first, axis=0) / total[:, None]


def infer(texts: list[str], letters: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text (zero where a language is not in the chosen set)."""
    n, n_lang = len(texts), model.shape[1]
    out = np.zeros((n, n_lang))
    bins, per = trigrams(texts, letters)
    if not len(bins) or not n_lang:
        return out
    key = np.repeat(np.arange(n, dtype=np.uint64), per) * np.uint64(BINS) + bins
    key.sort()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.append(start, len(key))).astype(np.float64)
    key = key[start]
    doc = (key >> np.uint64(BITS)).astype(np.int64)
    p = model[(key & np.uint64(BINS - 1)).astype(np.int64)]
    docs, first = np.unique(doc, return_index=True)
    owner = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(doc))))
    share, _ = _em(p, c, owner, first, np.full((len(docs), n_lang), 1.0 / n_lang), _ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n_lang)[None, :].repeat(len(docs), 0), axis=1)
    size = np.log(np.maximum(np.add.reduceat(c, first), 2.0))
    best_share, best = _em(p, c, owner, first, (rank == 0).astype(float), 0)
    best = best - 0.5 * penalty * size
    live = np.arange(len(docs))
    for k in range(2, n_lang + 1):                        # one more language while a document may gain by it
        live = live[share[live, order[live, k - 1]] > 1e-3]
        if not len(live):
            break
        pick = np.zeros(len(docs), bool)
        pick[live] = True
        rows = pick[owner]
        sub = np.cumsum(pick)[owner[rows]] - 1
        begin = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        begun = np.where(rank[live] < k, share[live], 0.0)
        s, like = _em(p[rows], c[rows], sub, begin, begun / begun.sum(axis=1, keepdims=True), _ROUNDS // 2)
        like = like - 0.5 * penalty * k * size[live]
        better = like > best[live]
        best_share[live[better]], best[live[better]] = s[better], like[better]
        live = live[better]
    out[docs] = best_share
    return out


def identify(docs: DataFrame, languages: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
             penalty: float = PENALTY) -> DataFrame:
    """Per document: id, ``lang_pred``, ``score`` (its proportion) and ``lang_shares``."""
    shared = docs.sparkSession.sparkContext.broadcast((letter_table(), model))
    limit = max(1 << 16, (16 << 20) // max(4, len(languages)))

    def batches(stream):
        import pyarrow as pa

        letters, probs = shared.value
        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([t.encode("utf-8", "replace") for t in texts], limit):
                share = infer(texts[a:b], letters, probs, penalty)
                best = share.argmax(axis=1) if len(languages) else np.zeros(b - a, int)
                known = share.sum(axis=1) > 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([languages[k] if x else UNKNOWN for k, x in zip(best, known)], pa.string()),
                    pa.array([min(1.0, float(s[k])) if x else 0.0 for s, k, x in zip(share, best, known)], pa.float64()),
                    pa.array([[(languages[j], float(s[j])) for j in np.flatnonzero(s > 0)] for s in share],
                             pa.map_(pa.string(), pa.float64())),
                ], [id_col, "lang_pred", "score", "lang_shares"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(batches, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, "
                                    "lang_shares map<string,double>")


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the documents that no model sees."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def op1(docs: DataFrame) -> DataFrame:
    languages, model = train(docs.filter(~held_out()))
    found = identify(docs, languages, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_shares")
