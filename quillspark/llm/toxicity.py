"""Toxicity of documents: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize
from quillspark.llm.langid import held_out

#: The classifier is fitted on at most this many labelled rows, those of smallest hash.
SAMPLE_ROWS = 20_000
#: Words and stems kept of those learned from the sample.
LEARNED_TERMS = 2000
#: Insults, and words for the second person.
INSULTS = frozenset("idiot idiots stupid moron morons scum trash pathetic worthless disgusting loser losers clown clowns dumb fool filth garbage vermin imbecile jerk ugly hate shut bastard damn crap idioten dumm trottel abschaum wertlos erbärmlich ekelhaft stupide crétin imbécile ordure minable dégoûtant idiota estúpido imbécil basura patético asqueroso inútil".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
TOKENS = re.compile(r"[^\W_]+")
OBFUSCATED = re.compile(r"[^\W\d_][*@$!#%&+|]+[^\W_]|[^\W\d_][013457]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}|[!?]{2,}")
NAMES = ("insults", "learned", "stems", "weight", "hits", "stem_hits", "near_you", "you", "capitals", "shouted", "punctuation", "exclamations", "obfuscated", "stretched", "digits", "other", "distinct", "log_words", "word_length", "top_share")
STEMS = range(4, 10)


@dataclass
class Lexicon:
    """Learned words and word stems with their weights."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.begin = {s[: STEMS.start] for s in self.stems}


class Features:
    """The dense features of a text, in the order of NAMES."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        # letter 1, upper case 2, digit 4, white space 8; beyond the basic plane: none
        self.kind = np.fromiter(((c := chr(i)).isalpha() + 2 * c.isupper() + 4 * c.isdigit() + 8 * c.isspace() for i in range(0x10000)), np.uint8, 0x10000)

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        lex = self.lexicon
        tokens = TOKENS.findall(text.lower())
        n = max(1, len(tokens))
        bad, learned, stems, weight = [], 0, 0, 0.0
        you = []
        for i, w in enumerate(tokens):
            if w in INSULTS:
                bad.append(i)
            if w in SECOND_PERSON:
                you.append(i)
            if w in lex.words:
                learned += 1
                weight += lex.words[w]
                if not bad or bad[-1] != i:
                    bad.append(i)
            if w[: STEMS.start] in lex.begin:
                best = max((lex.stems.get(w[:k], 0.0) for k in STEMS), default=0.0)
                if best:
                    stems += 1
                    weight += best
        at = set(bad)
        near = sum(any(j in at for j in range(i - 3, i + 4)) for i in you) if at else 0
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.bincount(self.kind[np.minimum(c, 0xFFFF)], minlength=16)
        letters = max(1, int(kinds[1] + kinds[3]))
        marks, upper, digits, spaces, size = int(kinds[0]), int(kinds[3]), int(kinds[4]), int(kinds[8]), len(c)
        shouted = sum(w.isupper() and len(w) > 1 for w in TOKENS.findall(text)) if upper > 0.1 * letters else 0
        counts: dict[str, int] = {}
        for w in tokens:
            counts[w] = counts.get(w, 0) + 1
        insults = sum(w in INSULTS for w in (tokens[i] for i in bad))
        return [
            insults / n, learned / n, stems / n, weight / n, min(10, len(bad)), min(10, stems), near / n, len(you) / n,
            upper / letters, shouted / n, marks / size, text.count("!") / n, len(OBFUSCATED.findall(text)) / n, len(STRETCHED.findall(text)) / n,
            digits / size, (size - letters - marks - digits - spaces) / size, len(counts) / n, float(np.log1p(n)), letters / n, max(counts.values(), default=0) / n,
        ]


@dataclass
class ToxicityModel:
    """trees and steps are None where the labels hold one class only; then every score is `rate`."""

    lexicon: Lexicon
    rate: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None


def _learn_lexicon(sample: DataFrame, rate: float, least: int = 8, z: float = 7.0) -> Lexicon:
    """Words, and stems of them, that documents labelled 1 have far oftener than the rate of that label tells.

    A term needs `least` documents and a binomial score of `z`; the LEARNED_TERMS of highest score are kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], ["term", "n", "toxic"])

        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                words = set(TOKENS.findall((t.as_py() or "").lower()))
                terms = words | {w[:k] + "~" for w in words for k in STEMS if len(w) >= k}
                y = y.as_py()
                for x in terms:
                    v = counts.setdefault(x, [0, 0])
                    v[0] += 1
                    v[1] += y
                if len(counts) > 200_000:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    sums = sample.select("text", "toxic").mapInArrow(count, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    score = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    share = F.log(((F.col("toxic") + 0.5) / (F.col("n") - F.col("toxic") + 0.5)) * ((1 - rate) / rate))
    kept = sums.where(F.col("n") >= least).select("term", score.alias("z"), share.alias("weight")).where(F.col("z") >= z).orderBy(F.desc("z"), "term").limit(LEARNED_TERMS).collect()
    return Lexicon({r["term"]: r["weight"] for r in kept if not r["term"].endswith("~")}, {r["term"][:-1]: r["weight"] for r in kept if r["term"].endswith("~")})


def annotate(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with the column _quill_features."""
    # at most LEARNED_TERMS terms
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema, at = docs.withColumn("_quill_features", F.array().cast("array<double>")).schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                rows = [features(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float64()))], [*b.schema.names, "_quill_features"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rounds: int = 30, depth: int = 4, seed: int = 7) -> ToxicityModel:
    """Fit on labelled documents: docs(doc_id, text), labels(doc_id, toxic).

    Labels whose id is held out (crc32 of its text modulo 5 is 0) are not used; of several labels of an id the
    largest counts, null ones don't. At most SAMPLE_ROWS ids, of smallest hash, are used: the lexicon and the trees
    learn from four of five, the calibration from the fifth, which neither has seen.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE_ROWS)
    # the broadcast holds at most SAMPLE_ROWS ids
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return ToxicityModel(Lexicon(), rate)
    kept = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0
    lexicon = _learn_lexicon(sample.where(~kept), rate)
    rows = annotate(sample, lexicon).select("doc_id", "toxic", "_quill_features", kept.alias("kept"))
    rows = materialize(rows, "toxicity-features").coalesce(8).select(F.col("toxic").cast("double").alias("label"), array_to_vector("_quill_features").alias("features"), "kept")
    fit = rows.where("not kept")
    if fit.select("label").distinct().count() < 2:
        fit = rows
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=3, maxMemoryInMB=64).fit(fit.select("label", "features"))
    probe = trees.transform(rows.where("kept")).select("label", vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(probe) if not probe.isEmpty() else None
    return ToxicityModel(lexicon, rate, trees, steps)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with _quill_score: 99 % the calibrated score and 1 % the trees' own, which ranks within its steps."""
    if model.trees is None:
        return docs.withColumn("_quill_score", F.lit(float(model.rate)))
    out = annotate(docs, model.lexicon).withColumn("_quill_vector", array_to_vector("_quill_features"))
    trees = model.trees.copy().setFeaturesCol("_quill_vector").setPredictionCol("_quill_class").setRawPredictionCol("_quill_raw").setProbabilityCol("_quill_probability")
    out = trees.transform(out).withColumn("_quill_p", vector_to_array("_quill_probability")[1])
    if model.steps is None:
        return out.withColumn("_quill_score", F.col("_quill_p"))
    out = model.steps.copy().setFeaturesCol("_quill_p").setPredictionCol("_quill_step").transform(out)
    return out.withColumn("_quill_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_quill_step") + 0.01 * F.col("_quill_p"))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score, predicted (1 from score 0.5).

    Null and empty texts are scored as texts without any word. Null ids are passed on and not held out.
    Repeated rows are each scored. Without labels of both classes every score is the rate of label 1 (0 without
    labels). An empty table gives no rows. Whole texts are read; other columns are ignored.
    """
    model = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("_quill_score").alias("score"), (F.col("_quill_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic; same columns."""
    return scored(docs, train(docs, labels)).where("_quill_score < 0.5").select(*docs.columns)
