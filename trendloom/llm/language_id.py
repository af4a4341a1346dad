"""Language identification: known words by frequency, unseen words by shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import bounded_batches, drawn, fold, fresh
from trendloom.plans.scratch import Scratch

#: A letter, then letters and the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Training documents that a model learns from at most, about, and words that it keeps; either is shared out evenly among the languages, of which each keeps LEAST_WORDS.
SAMPLE_DOCS, MODEL_WORDS, LEAST_WORDS = 8192, 60_000, 100
#: Longest character n-gram; words are padded by one mark at either end.
LONGEST = 5
_CACHE_WORDS = 200_000


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and their marks."""
    return LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the padded word."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language of words and of character n-grams; picklable, its size bounded by that of counts."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray]):
        self.langs = langs
        k = max(1, len(langs))
        total = np.sum(list(counts.values()), axis=0) if counts else np.zeros(k)
        self.word_of = {w: i for i, w in enumerate(counts)}
        self.word_log = self._logs(list(counts.values()), total, k)
        self.gram_of: list[dict[str, int]] = [{}]
        self.gram_log: list[np.ndarray] = [np.zeros((0, k))]
        of_word = np.array(list(counts.values()), dtype=float).reshape(len(counts), k)
        for n in range(1, LONGEST + 1):
            place, row, of = {}, [], []
            for i, w in enumerate(counts):
                for g in grams(w, n):
                    row.append(place.setdefault(g, len(place)))
                    of.append(i)
            table = np.zeros((len(place), k))
            np.add.at(table, row, of_word[of])
            self.gram_of.append(place)
            self.gram_log.append(self._logs(table, table.sum(axis=0), k))
        self._fresh()

    def _fresh(self) -> None:
        """Forgets the unseen words met; rows of known words come first in the table, theirs after."""
        self._at, self._table = dict(self.word_of), self.word_log
        self._all_logs = np.vstack(self.gram_log)

    @staticmethod
    def _logs(rows: np.ndarray | list[np.ndarray], total: np.ndarray, k: int) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, k))
        return np.log((np.array(rows, dtype=float) + 0.5) / (total + 0.5 * len(rows) + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_at", "_table", "_all_logs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._fresh()

    def backed_off(self, word: str) -> np.ndarray:
        """Of the longest n-grams of which any is known, the mean log frequency of the known ones; else zeros."""
        return self._backed_off([word])[0]

    def _backed_off(self, unseen: list[str]) -> np.ndarray:
        flat, lengths = [], []
        first = np.cumsum([0, *map(len, self.gram_log)])
        tables = [(n, int(first[n]), self.gram_of[n].get) for n in range(LONGEST, 0, -1)]
        for word in unseen:
            padded = f"<{word}>"
            size = len(padded)
            known: list[int] = []
            for n, base, get in tables:
                known = [base + i for at in range(size - n + 1) if (i := get(padded[at : at + n])) is not None]
                if known:
                    break
            flat += known
            lengths.append(len(known))
        per_word = np.array(lengths)
        out, some = np.zeros((len(unseen), len(self.langs))), np.flatnonzero(per_word)
        if len(some):
            starts = np.append(0, np.cumsum(per_word[some])[:-1])
            out[some] = np.add.reduceat(self._all_logs[flat], starts, axis=0) / per_word[some][:, None]
        return out

    def rows(self, found: list[str]) -> np.ndarray:
        """Log frequencies of each word, those of unseen ones backed off; unseen words are kept, _CACHE_WORDS at most but for one call's."""
        if len(self._at) > len(self.word_of) + _CACHE_WORDS:
            self._fresh()
        at = [*map(self._at.get, found)]
        if None in at:
            new = {w: None for w, i in zip(found, at, strict=True) if i is None}
            first = len(self._at)
            if first + len(new) > len(self._table):  # room for as many again
                self._table = np.vstack([self._table, np.zeros((len(new) + len(self._table), len(self.langs)))])
            self._table[first : first + len(new)] = self._backed_off(list(new))
            self._at.update(zip(new, range(first, first + len(new)), strict=True))
            at = [*map(self._at.get, found)]
        return self._table[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior under equal priors; ties go to the smaller name."""
        found = words(text)
        if not found or not self.langs:
            return "und", 0.0
        score = self.rows(found).sum(axis=0)
        best = int(np.argmax(score))
        return self.langs[best], float(1 / np.exp(score - score[best]).sum())


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE_DOCS, keep: int = MODEL_WORDS, seed: int = 17) -> Model:
    """Learns from (text, lang) of docs where train holds; rows with a null text or lang teach nothing.

    Of each language, documents are drawn whose seeded hash of the id falls under its part of
    ``sample``, so that rare languages aren't drowned. Words are counted where the texts are
    and summed by (lang, word); of each language the most frequent words come to the driver,
    ``keep`` divided by the number of languages, with their counts in all languages. Equal
    counts go by the word. Every language of the sample is one of the model's.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", "text", "lang").where(train & F.col("lang").isNotNull())
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / len(langs) / n[lang]))])[F.col("lang")]
    rows = rows.where(drawn("doc_id", share, seed) & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([held[k] for k in keys], pa.int64())})

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(words(text)).items():
                    held[lang, w] += n
            if len(held) > _CACHE_WORDS:
                yield flush()
                held.clear()
        yield flush()

    scratch = Scratch(spark, "language")
    counted = scratch.save(rows.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "words")
    quota = max(LEAST_WORDS, keep // len(langs))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") <= quota).select("word").distinct()
    top = counted.join(kept, "word", "left_semi").toPandas().sort_values(["word", "lang"])
    scratch.drop(counted)
    at = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for word, lang, c in zip(top["word"], top["lang"], top["n"], strict=True):
        if word not in counts:
            counts[word] = np.zeros(len(langs))
        counts[word][at[lang]] = c
    return Model(langs, counts)


def predict_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang_pred string, score double) of whole texts, with the model broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in batches:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, parts: int = 5, held: int = 0, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs.

    Documents whose crc32(doc_id) mod parts is ``held`` teach nothing and are predicted like
    the rest. A text that is null or has no letter (categories L*) is ``und`` with score 0; so
    is every text if there is nothing to learn from. Texts are read whole however long, in
    batches bounded in bytes; languages that score the same are decided by name. Repeated rows
    get the same prediction each; other columns of docs are ignored whatever their names; an
    empty table gives an empty one.
    """
    out = fold("doc_id", parts) == held
    model = model or fit(docs, ~out)
    p = fresh(docs, "prediction")
    return docs.select("doc_id", out.alias("held_out"), predict_column(docs, model).alias(p)).select("doc_id", "held_out", f"{p}.lang_pred", f"{p}.score")


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """docs, all columns, without the documents whose language can't be told (und, or a score under ``least``).

    Null and empty texts and texts without a letter go; long ones are judged whole. A score of
    just ``least`` stays. Repeated rows stay or go together; if there is nothing to learn from
    every document goes; columns keep their names and values; an empty table gives an empty one.
    """
    model = model or fit(docs, F.lit(True))
    p = fresh(docs, "prediction")
    told = docs.withColumn(p, predict_column(docs, model))
    return told.where((F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= least)).drop(p)
