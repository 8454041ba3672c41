"""Hierarchical language identification.

Texts are reduced to hashed counts of byte trigrams of their lower-cased letters. A first set of
linear support vector machines, one for each two families, picks the language family; then
one-versus-one machines between the languages of that family separate close relatives. All
machines are trained here, on at most ``SAMPLE_PER_LANGUAGE`` documents of each labelled language
(``SAMPLE_ROWS`` in all, so fewer of each where there are very many), drawn by a hash of their ids
from the labelled rows that are not held out. Prediction reads nothing but the text, all of it.

Families of languages come from ``FAMILIES``. A label that is not listed there joins the listed
family whose mean vector is nearest to its own, so every label is learned and the number of
machines stays small; where none is listed, all labels are one family.

Defined cases: a null text or one without letters (Unicode category L) is ``und`` with score 0.
Without any labelled row everything is ``und``; with one language everything else is that
language. Null ids are not held out and not learned from; an id with several labelled rows stands
for the least of its labels and texts. Repeated rows are predicted alike. An empty table gives an
empty result. Only the id, text and language columns are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_LANGUAGE = 300
SAMPLE_ROWS = 60_000
#: Certainty (0 to 1) below which the filter rejects a document.
LEAST_SCORE = 0.4
WIDTH = 4096
UNKNOWN = "und"

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi bn ur pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "sino-tibetan": "zh my bo",
    "austronesian": "id ms tl jv mg mi",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
#: Bytes that are neither ASCII letters nor parts of longer characters separate words.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)
#: Texts are counted in parts of this many bytes, so memory does not grow with their length.
PART = 1 << 20


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of hashed trigram counts; None without letters."""
    if not text or not _LETTER.search(text):
        return None
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(WIDTH)
    for at in range(0, len(raw) - 2, PART):
        b = _FOLD[raw[at : at + PART + 2]]
        grams = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA77) + b[2:]
        counts += np.bincount((grams * np.uint32(0xC2B2AE3D)) >> np.uint32(20), minlength=WIDTH)
    out = np.sqrt(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


def linear_svm(x: np.ndarray, positive: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights and, last, the bias of a hinge-loss machine, by averaged sub-gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for step in range(1, steps + 1):
        wrong = (y * (x @ w)) < 1
        rate = 1 / (penalty * (step + 10))
        w = w - rate * (penalty * w - ((share * y)[wrong] @ x[wrong]))
        norm = np.linalg.norm(w)
        w *= min(1.0, (1 / np.sqrt(penalty)) / norm) if norm else 1.0
        if step > steps // 2:
            mean += w
    return mean / (steps - steps // 2)


class Hierarchy:
    """Families and, within each, languages, each level decided by one-versus-one machines."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILY_OF.get(code, "") for code in langs], object)
        listed = sorted(set(family) - {""})
        means = np.array([x[family == f].mean(axis=0) for f in listed])
        for code in sorted(set(langs[family == ""])) if listed else []:
            family[langs == code] = listed[int(np.argmax(means @ x[langs == code].mean(axis=0)))]
        self.families = sorted(set(family))
        self.languages = {f: sorted(set(langs[family == f])) for f in self.families}
        self.between_families = self._machines(x, family, self.families)
        self.within = {f: self._machines(x[family == f], langs[family == f], codes) for f, codes in self.languages.items()}

    @staticmethod
    def _machines(x: np.ndarray, labels: np.ndarray, names: list[str]) -> np.ndarray | None:
        """One column for each pair of names, in the order of ``_decide``."""
        found = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                either = (labels == a) | (labels == b)
                found.append(linear_svm(x[either], labels[either] == a))
        return np.array(found).T if found else None

    @staticmethod
    def _decide(x: np.ndarray, machines: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes, ties by summed margins, and its mean certainty against the others."""
        if machines is None:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ machines[:-1] + machines[-1]
        sure = 1 / (1 + np.exp(-4 * margin))
        votes, certainty = np.zeros((len(x), n)), np.zeros((len(x), n))
        column = 0
        for i in range(n):
            for j in range(i + 1, n):
                votes[:, i] += margin[:, column] >= 0
                votes[:, j] += margin[:, column] < 0
                certainty[:, i] += sure[:, column]
                certainty[:, j] += 1 - sure[:, column]
                column += 1
        best = np.argmax(votes + certainty / n, axis=1)
        return best, certainty[np.arange(len(x)), best] / (n - 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self._decide(x, self.between_families, len(self.families))
        lang = np.empty(len(x), object)
        for i, name in enumerate(self.families):
            at = np.flatnonzero(family == i)
            if len(at):
                codes = self.languages[name]
                best, sure = self._decide(x[at], self.within[name], len(codes))
                lang[at] = np.array(codes, object)[best]
                score[at] *= sure
        return lang, score


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(1).to_pylist()]
        vectors = [None if v is None else v.astype(np.float16).tobytes() for v in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["lang", "vector"])


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Hierarchy | None:
    """Trains on the bounded sample; ids are drawn first, so only sampled texts are read twice.

    The counts of the languages give each a hash threshold that lets about twice the wanted rows
    through; only those are ordered.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        "lang IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL"
    ).filter(~held_out("id"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    wanted = max(1, min(per_language, sample_rows // n_languages))
    luck = (F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = labelled.select("id", "lang").join(counts.withColumnRenamed("lang", "as"), F.col("lang") == F.col("as")).filter(luck < (2 * wanted + 50) / F.col("n"))
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = (
        drawn.groupBy("id").agg(F.min("lang").alias("lang")).withColumn("place", F.row_number().over(draw)).filter(F.col("place") <= wanted).select("id", F.col("lang").alias("as"))
    )
    # At most ``sample_rows`` ids, or one for each language.
    texts = labelled.join(F.broadcast(sample), "id").filter(F.col("lang") == F.col("as")).groupBy("id", "lang").agg(F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInArrow(_featured, "lang string, vector binary").filter("vector IS NOT NULL").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["vector"]))
    x = np.array([np.frombuffer(r["vector"], np.float16) for r in rows]).astype(np.float32)
    return Hierarchy(x, np.array([r["lang"] for r in rows], object))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs, id_col, text_col, lang_col, per_language)
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (
        docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
        .mapInArrow(_predictor(shared), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
    )


def _predictor(shared, rows_at_once: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            texts = batch.column(batch.schema.get_field_index("text"))
            for start in range(0, n if model else 0, rows_at_once):
                found = [(i, v) for i in range(start, min(n, start + rows_at_once)) if (v := features(texts[i].as_py())) is not None]
                if found:
                    at = np.array([i for i, _ in found])
                    lang[at], score[at] = model.predict(np.array([v for _, v in found]))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1] + ["lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names)

    return run


def identified_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: set[str] | None = None, least_score: float = LEAST_SCORE
) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; the columns stay as they are.

    A row goes if its text is null or has no letters, if the model is less certain than
    ``least_score``, or, where ``languages`` are given, if it predicts none of them. Where nothing
    could be learned (no labelled rows), only texts without letters go. The text goes through the
    workers together with its row, so no join is needed and ids may be null or repeat.
    """
    model = fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(shared)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            if shared.value is None:
                stays = [bool(_LETTER.search(t.as_py() or "")) for t in texts]
            else:
                (found,) = predict(iter([pa.RecordBatch.from_arrays([texts], ["text"])]))
                pairs = zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)
                stays = [code != UNKNOWN and s >= least_score and (languages is None or code in languages) for code, s in pairs]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
