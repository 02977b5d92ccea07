"""Reading level of texts by gradient-boosted regression trees.

Features describe the distributions of lengths (of words, sentences, paragraphs), vocabulary (syllables, variety, share
of function words by language), syntax (commas, subordinating words, sentence openings) and cohesion (words that a
sentence shares with the one before). The trees are trained on the mean level that people gave, cross-validated with
whole sources left out, and the predictions for left-out sources calibrate the scale by isotonic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.boosting import Boosted, isotonic
from tessera.sources.tables import load, persisted, spread

#: Labelled documents that the model is fitted on at most, drawn by a hash of the id; all documents are scored.
LABELLED_MAX = 20_000
FOLDS = 4
#: Tokens of a run over which the variety of words is taken.
RUN = 120

# Frequent function words, and words that open subordinate clauses or join argument, by language.
_FUNCTION = {
    "en": "the a an and or of to in on at is are was were it its be been he she they we you i my your his her their our this that these those not no do does did has have had with for from by as but so then can will",
    "de": "der die das den dem des ein eine einen einem einer und oder in im an am auf ist sind war waren es er sie wir ihr ich nicht kein keine mit für von zu zum zur bei aus nach so dann kann wird sich auch noch",
    "es": "el la los las un una unos unas y o de del a al en es son era eran que no con por para se su sus lo le les mi tu este esta esto ese esa muy más ya también",
    "fr": "le la les un une des et ou de du à au aux en est sont était étaient que ne pas avec pour par se sa son ses ce cette ces il elle ils elles nous vous je on très plus aussi",
}
_JOINING = (
    "because although though whereas while since unless whether which whom whose thereby therefore consequently nevertheless notwithstanding however moreover furthermore hence thus provided particularly rather despite insofar "
    "weil obwohl während wenn dass sobald sofern wodurch welche welcher welches deren dessen dennoch jedoch folglich somit demnach keineswegs hingegen vielmehr indem falls "
    "porque aunque mientras cuando cuyo cuya dado puesto siempre según resulta mediante asimismo embargo conviene sino "
    "parce quoique tandis lorsque puisque dont lequel laquelle ainsi cependant toutefois afin selon néanmoins dès"
).split()
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[.!?…]+|[,;:()]|\n+")
_VOWELS = re.compile("[aeiouyáàâäãåéèêëíìîïóòôöõúùûüýœæ]+")
_LANGUAGES = list(_FUNCTION)
_FLAGS: dict[str, int] = {}
for _i, _ws in enumerate(_FUNCTION.values()):
    for _w in _ws.split():
        _FLAGS[_w] = _FLAGS.get(_w, 0) | 1 << _i
for _w in _JOINING:
    _FLAGS[_w] = _FLAGS.get(_w, 0) | 1 << len(_LANGUAGES)

NAMES = [
    "words", "sentences", "sent_mean", "sent_sd", "sent_p10", "sent_p50", "sent_p90", "word_mean", "word_sd", "w2", "w4", "w7", "w10", "w13",
    "syl_mean", "syl1", "syl3", "syl4", "variety", "variety100", "commas", "semicolons", "brackets", "joining", "digits", "exclaim", "question", "upper",
    *(f"fn_{x}" for x in _LANGUAGES), "fn_max", "cohesion", "cohesion_sd", "long_cohesion", "para", "chars_word", "openings", "long_sent", "short_sent", "long_p90",
]

_IDS: dict[str, int] = {}
_ATTRIBUTES: list[tuple[int, int, int, int]] = []  # kind, letters, syllables, flags
_VOCABULARY_MAX = 1 << 20
_WORD, _NUMBER, _END, _COMMA, _SEMI, _BRACKET, _BREAK = range(7)


def _attributes(token: str) -> tuple[int, int, int, int]:
    c = token[0]
    if c == "\n":
        return _BREAK, 0, 0, 0
    if c in ".!?…":
        return _END, 0, 0, ("!" in token) + 2 * ("?" in token)
    if c.isdigit():
        return _NUMBER, 0, 0, 0
    if c.isalpha():
        low = token.lower()
        return _WORD, len(low), max(1, len(_VOWELS.findall(low))), _FLAGS.get(low, 0) | (64 if c.isupper() else 0)
    return (_COMMA if c == "," else _BRACKET if c in "()" else _SEMI), 0, 0, 0


def features(texts: list[str]) -> np.ndarray:
    """One row of NAMES for each text; texts without words have zeros."""
    out = np.zeros((len(texts), len(NAMES)), dtype=np.float32)
    if len(_IDS) > _VOCABULARY_MAX:
        _IDS.clear()
        _ATTRIBUTES.clear()
    lists = [_TOKEN.findall(t) for t in texts]
    flat = [x for ts in lists for x in ts]
    for token in set(flat).difference(_IDS):
        _IDS[token] = len(_IDS)
        _ATTRIBUTES.append(_attributes(token))
    if not flat:
        return out
    ids = np.fromiter(map(_IDS.__getitem__, flat), dtype=np.int64, count=len(flat))
    of, index = np.unique(ids, return_inverse=True)
    kind, letters, syllables, flags = np.array([_ATTRIBUTES[i] for i in of.tolist()], dtype=np.int32).T[:, index]
    doc = np.repeat(np.arange(len(texts)), [len(ts) for ts in lists])
    n = len(texts)
    per = lambda mask, weights=None: np.bincount(doc[mask], weights=None if weights is None else weights[mask], minlength=n).astype(float)
    word = kind == _WORD
    words = per(word)
    some = np.maximum(words, 1)
    # sentences: the number of ends (or line breaks) before a token, over all texts
    ends = (kind == _END) | (kind == _BREAK)
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    sentence = np.cumsum(np.concatenate(([True], ends[:-1])) | first) - 1
    lengths = np.bincount(sentence[word], minlength=sentence[-1] + 1)
    owner = np.zeros(sentence[-1] + 1, dtype=np.int64)
    owner[sentence] = doc
    real = lengths > 0
    sent_len, sent_doc = lengths[real].astype(float), owner[real]
    sentences = np.maximum(np.bincount(sent_doc, minlength=n), 1).astype(float)
    mean = np.bincount(sent_doc, weights=sent_len, minlength=n) / sentences
    spread_ = np.sqrt(np.maximum(np.bincount(sent_doc, weights=sent_len**2, minlength=n) / sentences - mean**2, 0))
    order = np.lexsort((sent_len, sent_doc))
    starts = np.searchsorted(sent_doc[order], np.arange(n))
    counts = np.bincount(sent_doc, minlength=n)
    quantile = lambda q: np.where(counts > 0, sent_len[order][np.minimum(starts + np.floor(q * np.maximum(counts - 1, 0)).astype(int), len(sent_len) - 1)], 0) if len(sent_len) else np.zeros(n)
    wl = letters.astype(float)
    word_mean = per(word, wl) / some
    word_sd = np.sqrt(np.maximum(per(word, wl**2) / some - word_mean**2, 0))
    distinct = np.unique(doc[word] * len(of) + index[word])
    types = np.bincount(distinct // len(of), minlength=n)
    # variety: the mean over all runs of RUN tokens (of shorter texts the whole) of distinct words to words
    begin = np.searchsorted(doc, np.arange(n))[doc]
    last = begin + np.maximum(np.bincount(doc, minlength=n)[doc] - RUN, 0)
    at_word = np.flatnonzero(word)
    same = doc[at_word] * len(of) + index[at_word]
    by_word = np.argsort(same, kind="stable")
    again = np.flatnonzero(np.diff(same[by_word]) == 0) + 1
    lower = np.maximum(at_word - RUN + 1, begin[at_word])
    lower[by_word[again]] = np.maximum(lower[by_word[again]], at_word[by_word[again - 1]] + 1)
    upper = np.minimum(at_word, last[at_word])
    counted = lower <= upper
    size = len(doc) + 1
    run_types = np.cumsum(np.bincount(lower[counted], minlength=size) - np.bincount(upper[counted] + 1, minlength=size))[:-1]
    before_word = np.concatenate(([0], np.cumsum(word)))
    stop = np.minimum(np.arange(len(doc)) + RUN, (begin + np.bincount(doc, minlength=n)[doc]))
    run_words = before_word[stop] - before_word[:-1]
    runs = (np.arange(len(doc)) <= last) & (run_words > 0)
    early = per(runs, run_types / np.maximum(run_words, 1)) / np.maximum(per(runs), 1)
    # cohesion: words of four letters and more that the sentence before holds, too
    content = word & (letters >= 4)
    rank = np.cumsum(real) - 1
    keys = np.unique(rank[sentence[content]] * len(of) + index[content])
    at, what = keys // len(of), keys % len(of)
    before = (at - 1) * len(of) + what
    hit = np.searchsorted(keys, before)
    shared = (hit < len(keys)) & (keys[np.minimum(hit, max(len(keys) - 1, 0))] == before) if len(keys) else np.zeros(0, dtype=bool)
    if len(keys):
        shared &= sent_doc[at] == sent_doc[np.maximum(at - 1, 0)]
    by_sentence = np.bincount(at, weights=shared, minlength=len(sent_len)) / np.maximum(np.bincount(at, minlength=len(sent_len)), 1) if len(sent_len) else np.zeros(0)
    cohesion = np.bincount(sent_doc, weights=by_sentence, minlength=n) / sentences
    cohesion_sd = np.sqrt(np.maximum(np.bincount(sent_doc, weights=by_sentence**2, minlength=n) / sentences - cohesion**2, 0))
    long_shared = np.bincount(sent_doc[at], weights=shared, minlength=n) / np.maximum(types, 1) if len(keys) else np.zeros(n)
    share = lambda mask: per(word & mask) / some
    function = [share(flags & 1 << i > 0) for i in range(len(_LANGUAGES))]
    opening = np.zeros(len(doc), dtype=bool)
    opening[1:] = ends[:-1]
    opening |= first
    long_words = np.bincount(sentence[word & (letters >= 9)], minlength=len(lengths))[real] / np.maximum(sent_len, 1)
    order_long = np.lexsort((long_words, sent_doc))
    long_p90 = np.where(counts > 0, long_words[order_long][np.minimum(starts + np.floor(0.9 * np.maximum(counts - 1, 0)).astype(int), len(sent_len) - 1)], 0) if len(sent_len) else np.zeros(n)
    columns = [
        np.log1p(words), np.log1p(sentences), mean, spread_, quantile(0.1), quantile(0.5), quantile(0.9), word_mean, word_sd,
        share(letters <= 2), share(letters <= 4), share(letters >= 7), share(letters >= 10), share(letters >= 13),
        per(word, syllables.astype(float)) / some, share(syllables == 1), share(syllables >= 3), share(syllables >= 4), types / np.sqrt(some), early,
        per(kind == _COMMA) / sentences, per(kind == _SEMI) / sentences, per(kind == _BRACKET) / sentences, share(flags & 1 << len(_LANGUAGES) > 0),
        per(kind == _NUMBER) / some, per((kind == _END) & (flags & 1 > 0)) / sentences, per((kind == _END) & (flags & 2 > 0)) / sentences, share(flags & 64 > 0),
        *function, np.max(function, axis=0), cohesion, cohesion_sd, long_shared, words / np.maximum(per(kind == _BREAK), 1), np.array([len(t) for t in texts]) / some,
        per(opening & word & (letters >= 8)) / sentences, np.bincount(sent_doc, weights=sent_len >= 20, minlength=n) / sentences, np.bincount(sent_doc, weights=sent_len <= 7, minlength=n) / sentences, long_p90,
    ]
    out[:] = np.stack(columns, axis=1)
    out[words == 0] = 0
    return out


def text_features(documents: DataFrame) -> DataFrame:
    """(doc_id, x ARRAY<FLOAT>) of documents that have a text with at least one letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                part = whole.iloc[at : at + 500]
                part = part[part["text"].notna()]
                x = features(part["text"].tolist())
                keep = x[:, 0] > 0
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[keep], "x": list(x[keep])})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, x array<float>")


#: Labels that a fold must leave for training, and the calibration where no fold does.
TRAINED_MIN = 20
SAME = (np.array([1.0, 5.0]), np.array([1.0, 5.0]))


class Model:
    """Trees for all labels, and the calibration learned from sources left out of training.

    `held_out` are the grades of each row by trees and a calibration that its fold of sources had no part in; NaN where
    the other folds have under TRAINED_MIN labels.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, groups: np.ndarray) -> None:
        weight = np.ones(len(y))
        self.trees = Boosted().fit(x, y, weight)
        raw, folds = np.full(len(y), np.nan), groups % FOLDS
        for fold in range(FOLDS):
            test = folds == fold
            if test.any() and (~test).sum() >= TRAINED_MIN:
                raw[test] = Boosted().fit(x[~test], y[~test], weight[~test], fold + 1).predict(x[test])
        # rows of folds that left too little to train on are no evidence for the calibration
        seen = ~np.isnan(raw)
        self.knots = isotonic(raw[seen], y[seen]) if seen.any() else SAME
        self.held_out = np.full(len(y), np.nan)
        for fold in range(FOLDS):
            test, rest = seen & (folds == fold), seen & (folds != fold)
            if test.any():
                self.held_out[test] = np.clip(np.interp(raw[test], *(isotonic(raw[rest], y[rest]) if rest.any() else SAME)), 1, 5)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.predict(x), *self.knots), 1, 5)


def mean_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean of the levels people gave a document; null levels and repeated rows don't count."""
    given = labels.select("doc_id", "rater", "reader_level").filter("doc_id is not null and reader_level is not null").distinct()
    return given.groupBy("doc_id").agg(F.avg("reader_level").alias("y"))


def trained(features_: DataFrame, documents: DataFrame, labels: DataFrame) -> tuple[Model | None, np.ndarray, np.ndarray, np.ndarray]:
    """The model, and the ids, labels and sources it was trained on; no model if nothing is labelled."""
    sources = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    rows = mean_labels(labels).join(features_, "doc_id").join(sources, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("source", "x")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_MAX)
    got = rows.select("doc_id", "r.x", "y", "r.source", F.pmod(F.xxhash64("r.source"), F.lit(1 << 20)).alias("g")).toPandas()
    if not len(got):
        return None, *(np.zeros(0),) * 3
    model = Model(np.stack(got["x"].to_list()).astype(np.float32), got["y"].to_numpy(float), got["g"].to_numpy())
    return model, got["doc_id"].to_numpy(), got["y"].to_numpy(float), got["source"].to_numpy()


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level DOUBLE from 1 to 5, reader_level INT) of every row of `documents`.

    Null, empty and blank texts, and those without a letter, have null levels; so have all if no label is left.
    Repeated rows come out as often, with one level if their id has several texts; further columns are ignored.
    """
    spark = documents.sparkSession
    x = persisted(text_features(spread(documents.select("doc_id", "text"))))
    model = spark.sparkContext.broadcast(trained(x, documents, labels)[0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p) and model.value:
                yield pd.DataFrame({"doc_id": p["doc_id"], "reading_level": np.round(model.value.predict(np.stack(p["x"].to_list())), 4)})

    levels = x.groupBy("doc_id").agg(F.min("x").alias("x")).mapInPandas(score, "doc_id long, reading_level double")
    return documents.select("doc_id").join(levels, "doc_id", "left").withColumn("reader_level", F.round("reading_level").cast("int"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reading_level, reader_level) of each document."""
    return reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels"))


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: labelled documents, and how the calibrated grades of models without that source's fold agree with the
    labels (mean error, share within one level, correlation); the row without a source is over all of them."""
    documents = load(spark, sf_dir, "documents")
    model, _, y, sources = trained(persisted(text_features(spread(documents.select("doc_id", "text")))), documents, load(spark, sf_dir, "reading_labels"))
    guess = model.held_out if model else np.zeros(0)
    judged = ~np.isnan(guess)
    rows = []
    for source in [None, *sorted(set(sources))]:  # of at most LABELLED_MAX rows
        g, t = (v[judged & (np.ones(len(y), dtype=bool) if source is None else sources == source)] for v in (guess, y))
        error = np.abs(g - t)
        vary = len(t) > 2 and g.std() > 0 and t.std() > 0
        rows.append((source, len(t), *((float(error.mean()), float((error <= 1).mean())) if len(t) else (None, None)), float(np.corrcoef(g, t)[0, 1]) if vary else None))
    return spark.createDataFrame(rows, "source string, documents long, mean_error double, within_one double, correlation double")


QUERIES = {"p8_levels": p8_levels, "p8_validation": p8_validation}
SQL: dict[str, str] = {}
