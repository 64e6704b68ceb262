"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed character n-grams. Spherical
k-means gives each language several centroids; a text gets the language of the
centroid with the greatest cosine. Texts that lie farther from every centroid
than nearly all training texts do are rejected.

The model is fitted on a bounded sample: of each language the FIT_DOCS different
labelled texts with the smallest hashes, which come to the driver as sparse
vectors. Of many languages each has fewer texts and centroids, so that all have
FIT_TEXTS texts and MODEL_CENTROIDS centroids; every language keeps one of each
at least, however many there are. Predictions cover every whole text.

Edge cases: a null text or one without a letter is `und` with score 0; where no
labelled text is left to learn from, every text is; ties go to the language and
centroid that come first; repeated rows get equal results; an empty table gives
an empty result; other columns pass through, and the columns added here replace
any of the same name (names that start with _lt_ are not to be used); a very
long text is hashed whole, piece by piece, in a fixed number of counters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import row_hash, small_batches, stored, with_fields

UNKNOWN = "und"
#: Labelled texts of a language that the model is fitted on, at most, and of all languages together.
FIT_DOCS = 300
FIT_TEXTS = 60_000
#: N-gram lengths and the number of hashed features.
GRAMS = (1, 2, 3)
FEATURES = 1 << 15
#: Centroids of a language, at most, and of all together: a centroid takes 4 x FEATURES bytes.
CENTROIDS = 4
MODEL_CENTROIDS = 800
ROUNDS = 12
#: Share of training texts that may lie beyond the rejection distance.
REJECTED = 0.005
#: Code points of a text that are hashed at once; whole texts are.
PIECE = 1 << 20


def counts(text: str):
    """Counts of hashed n-grams of a whole text, lower-cased, with runs of non-letters as one space."""
    import numpy as np
    import regex

    clean = f" {regex.sub(r'[^\p{L}\p{M}]+', ' ', text.lower()).strip()} "
    code = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = None
    for at in range(0, len(code), PIECE):
        places = []
        for n in GRAMS:
            part = code[at : at + PIECE + n - 1]
            h = np.full(max(0, len(part) - n + 1), n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            places.append(h % np.uint64(FEATURES))
        own = np.bincount(np.concatenate(places).astype(np.int64), minlength=FEATURES)
        found = own if found is None else found + own
    return found.astype(np.float32)


def weighted(found, idf):
    """Damped counts times inverse document frequency, of length 1; sparse: places and values."""
    import numpy as np

    at = np.nonzero(found)[0]
    v = (1 + np.log(found[at])) * idf[at]
    return at, (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list  # of each centroid
    centroids: object  # rows of length 1
    idf: object
    least: float  # cosine below which a text is rejected

    def predict(self, text: str | None) -> tuple:
        """Language, cosine and whether it is rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, v = weighted(counts(text), self.idf)
        likeness = self.centroids[:, at] @ v
        k = int(likeness.argmax())
        score = min(1.0, max(0.0, float(likeness[k])))
        return self.languages[k], score, score < self.least


def clustered(x, k: int):
    """Spherical k-means on the rows of x, each of length 1; the start is spread out and fixed by the data."""
    import numpy as np

    first = int((x @ x.mean(axis=0)).argmax())
    chosen, near = [first], x @ x[first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(labelled: DataFrame) -> Model:
    """A model of (text, lang); rows without a language or a letter teach nothing."""
    import numpy as np

    small_batches(labelled.sparkSession)
    known = labelled.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}")).select("lang", "text")
    hashed = known.withColumn("h", row_hash(F.col("text")))
    langs = stored(hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    many = max(1, langs.count())
    most = max(1, min(FIT_DOCS, FIT_TEXTS // many))
    # Of each language's different texts (copies don't count) about three times the wanted number by hash, each text once, then the smallest hashes: no language meets whole in one task.
    held = hashed.join(langs, "lang")
    near = held.filter(F.pmod("h", F.lit(1 << 40)) < F.least(F.lit(1.0), 3 * FIT_DOCS / F.col("n")) * (1 << 40)).dropDuplicates(["lang", "h"])
    chosen = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= most).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            full = [counts(t) for t in b.column(1).to_pylist()]
            at = [np.nonzero(f)[0] for f in full]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([f[a].tobytes() for f, a in zip(full, at)], pa.binary())], ["lang", "at", "n"])

    rows = sorted(chosen.mapInArrow(run, "lang string, at binary, n binary").collect())
    by: dict[str, list] = {}
    seen = np.zeros(FEATURES)
    for r in rows:
        at = np.frombuffer(r["at"], np.int32)
        seen[at] += 1
        by.setdefault(r["lang"], []).append((at, np.frombuffer(r["n"], np.float32)))
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    languages, centroids, cosines = [], [], []
    for lang, texts in sorted(by.items()):
        x = np.zeros((len(texts), FEATURES), np.float32)
        for k, (at, n) in enumerate(texts):
            v = (1 + np.log(n)) * idf[at]
            x[k, at] = v / (np.linalg.norm(v) or 1.0)
        c = clustered(x, max(1, min(CENTROIDS, MODEL_CENTROIDS // many)))
        languages += [lang] * len(c)
        centroids.append(c)
        cosines.append((x @ c.T).max(axis=1))
    if not languages:
        return Model([], None, idf, 0.0)
    return Model(languages, np.concatenate(centroids), idf, float(np.quantile(np.concatenate(cosines), REJECTED)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with nearest (language of the nearest centroid), score (its cosine), rejected, and lang_pred: nearest, or `und` where rejected."""
    small_batches(docs.sparkSession)
    new = "nearest string, score double, rejected boolean, lang_pred string"
    left = docs.drop("nearest", "score", "rejected", "lang_pred")
    width = len(left.columns)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.centroids, model.idf, model.least))  # MODEL_CENTROIDS rows of FEATURES numbers, or one a language where there are more of these

    def run(batches):
        import pyarrow as pa

        own = Model(*shared.value)
        for b in batches:
            found = [own.predict(t) for t in b.column(width).to_pylist()]
            lang, score, no = zip(*found) if found else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_()), pa.array([UNKNOWN if x else y for x, y in zip(no, lang)], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *columns], [*b.schema.names[:width], "nearest", "score", "rejected", "lang_pred"])

    return left.select(*left.columns, F.col("text").alias("_lt_t")).mapInArrow(run, with_fields(left, new))
