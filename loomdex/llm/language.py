"""Language ID: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import distinct_name, pick, plain_names, ship, stored, text_blocks, trimmed

#: The sample a model is fitted on: labelled documents per language (about; a hash of the id chooses them), and languages, those with most documents.
FIT_DOCS = 2_000
FIT_LANGS = 200
#: Words up to which a text's evidence counts in the score: with more, it isn't surer.
EVIDENCE = 20
#: Distinct tokens that a worker remembers between blocks.
REMEMBERED = 400_000
WORD = r"\p{L}[\p{L}\p{M}]*"
_WORD = regex.compile(WORD)
_SPACE_TOKENS = r"[ \t\n\r\f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LONGEST = 5


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[k : k + n] for k in range(len(w) - n + 1)]


class Model:
    """Per word and n-gram a row of log probabilities, one per language."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray]):
        """words: counts per language. A gram's counts are those of the words it occurs in."""
        gram: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for w, c in words.items():
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    gram[n][g] = gram[n].get(g, 0) + np.asarray(c, float)
        table = lambda d: (list(d), np.array(list(d.values()), float).reshape(-1, max(1, len(langs))))
        self._set(langs, table(words), [table(g) for g in gram])

    @classmethod
    def counted(cls, langs: list[str], words: tuple[list[str], np.ndarray], gram: list[tuple[list[str], np.ndarray]]) -> Model:
        """The model of counts made elsewhere: names and their counts per language, for words and for the grams of each length from 0 on."""
        out = cls.__new__(cls)
        out._set(langs, words, gram)
        return out

    def _set(self, langs, words, gram) -> None:
        names = lambda x: pa.array(x, pa.large_string())
        self.langs = langs
        self.words, self.score = names(words[0]), self._log(words[1])
        self.gram, self.gram_score = [names(x) for x, _ in gram], [self._log(counts) for _, counts in gram]
        self._at: list[dict[str, int]] = []
        self.forget()

    def forget(self) -> None:
        """Empty the memory of tokens that a worker has scored."""
        self.seen = pa.array([], pa.large_string())
        self.seen_rows, self.seen_n = np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (counts.sum(0) + 0.1 * max(1, len(counts)))).astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        """A known word's scores; else the mean over its known n-grams of the longest order that has any; else zeros."""
        if not self._at:
            self._at = [{x: k for k, x in enumerate(names.to_pylist())} for names in (self.words, *self.gram)]
        if (k := self._at[0].get(w)) is not None:
            return self.score[k]
        for n in range(min(LONGEST, len(w) + 2), 0, -1):
            if at := [k for g in grams(w, n) if (k := self._at[n + 1].get(g)) is not None]:
                return self.gram_score[n][at].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """word() of many words at once, without a table of Python strings."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = np.asarray(pc.index_in(pa.array(words, pa.large_string()), value_set=self.words).fill_null(-1))
        out[at >= 0] = self.score[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            found = [grams(words[k], n) for k in left.tolist()]
            of = np.repeat(np.arange(len(left)), [len(g) for g in found])
            at = np.asarray(pc.index_in(pa.array([x for g in found for x in g], pa.large_string()), value_set=self.gram[n]).fill_null(-1))
            of, at = of[at >= 0], at[at >= 0]
            n_found = np.bincount(of, minlength=len(left))
            total = np.stack([np.bincount(of, weights=self.gram_score[n][at, j], minlength=len(left)) for j in range(len(self.langs))], axis=1)
            has = n_found > 0
            out[left[has]] = total[has] / n_found[has, None]
            left = left[~has]
        return out

    def score_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed scores, words) of each of what stands between white space."""
        found = [_WORD.findall(t.lower()) for t in tokens]
        size = np.array([len(f) for f in found], np.int64)
        flat = [w for f in found for w in f]
        of = np.repeat(np.arange(len(tokens)), size)
        scores = self.score_words(flat)
        return np.stack([np.bincount(of, weights=scores[:, j], minlength=len(tokens)) for j in range(len(self.langs))], axis=1).astype(np.float32), size

    def _tokens(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """score_tokens() of distinct tokens; new ones are scored and remembered."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        at = pc.index_in(names, value_set=self.seen)
        if at.null_count:
            new = names.filter(at.is_null())
            rows, n = self.score_tokens(new.to_pylist())
            self.seen = pa.concat_arrays([self.seen, new])
            self.seen_rows, self.seen_n = np.concatenate([self.seen_rows, rows]), np.concatenate([self.seen_n, n])
            at = pc.index_in(names, value_set=self.seen)
        at = np.asarray(at)
        return self.seen_rows[at], self.seen_n[at]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language or und, probability): scores are means over a text's words; the probability takes EVIDENCE words at most as evidence."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern_regex(texts, _SPACE_TOKENS)
        flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        off = off - off[0]
        coded = flat.dictionary_encode()
        rows, n = self._tokens(coded.dictionary)
        at = np.asarray(coded.indices)
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        count = np.bincount(doc, weights=n[at], minlength=len(texts))
        total = np.stack([np.bincount(doc, weights=rows[at, j], minlength=len(texts)) for j in range(len(self.langs))], axis=1)
        mean = total / np.maximum(count, 1)[:, None]
        z = (mean - mean.max(1, keepdims=True)) * np.minimum(count, EVIDENCE)[:, None]
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = mean.argmax(1)
        lang = [self.langs[b] if c else "und" for b, c in zip(best, count, strict=True)]
        return lang, np.where(count > 0, p[np.arange(len(p)), best], 0.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(table: DataFrame, n_langs: int) -> tuple[list[str], np.ndarray]:
    """(names, counts per language) of table(g, l, n)."""
    got = table.toArrow()
    coded = got.column("g").combine_chunks().dictionary_encode()
    out = np.zeros((len(coded.dictionary), n_langs))
    out[np.asarray(coded.indices), np.asarray(got.column("l"))] = np.asarray(got.column("n"))
    return coded.dictionary.to_pylist(), out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_langs: int = FIT_LANGS) -> Model:
    """Fit a model on labelled documents that are not held out, about fit_docs a language at most, whole texts, of the fit_langs languages with most documents.

    All words and n-grams of the sample are kept, whatever its size; its bound, a parameter, bounds the model. Words and the n-grams of
    distinct words are counted in Spark. No label, no language: such a model answers und.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(fit_langs).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], {})
    known = F.broadcast(docs.sparkSession.createDataFrame([(x, k, min(1 << 20, -(-(fit_docs << 20) // n[x]))) for k, x in enumerate(langs)], "lang string, l int, share long"))
    chosen = rows.withColumn("lang", F.col("lang").cast("string")).join(known, "lang").where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.col("share"))
    words = stored(chosen.select("l", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("g")).groupBy("g", "l").agg(F.count(F.lit(1)).alias("n")), "lang-words")
    framed = F.concat(F.lit("<"), F.col("g"), F.lit(">"))
    parts = lambda k: F.transform(F.sequence(F.lit(1), F.length(framed) - k + 1), lambda at: F.substr(framed, at, F.lit(k)))
    found = F.flatten(F.array(*[F.when(F.length(framed) >= k, parts(k)).otherwise(F.array().cast("array<string>")) for k in range(1, LONGEST + 1)]))
    gram = stored(words.select("l", "n", F.explode(found).alias("g")).groupBy("g", "l").agg(F.sum("n").alias("n")), "lang-grams")
    return Model.counted(langs, _counts(words, len(langs)), [_counts(gram.where(F.length("g") == k), len(langs)) for k in range(LONGEST + 1)])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1 as two columns more, by the text alone; null or letterless text: und, 0.

    A word begins with a letter and goes on with letters and combining marks. The columns come last; their names get underscores where docs
    has them already, and docs' own columns stay.

    Rows are never moved. The model, of bounded size, goes to the executors; a text is read whole.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [distinct_name(docs, lang_name), distinct_name(docs, score_name)]
    rows, text = plain_names(docs, text_col)

    def each(batches):
        for batch in batches:
            for part in text_blocks(batch, text):
                lang, score = sent.value.predict(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names, "lang", "score"])

    return rows.mapInArrow(trimmed(each), T.StructType([*rows.schema, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])).toDF(*docs.columns, *names)


def reject(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose language is told with a score of `least` or more."""
    told = identify(docs, model, text_col)
    lang, score = (told[f"`{c}`"] for c in told.columns[-2:])
    return told.where((lang != "und") & (score >= least)).select(*[f"`{c}`" for c in docs.columns])
