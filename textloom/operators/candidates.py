"""Candidate rows for another look: relabelling, gap filling, quota samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.cascade import cascade
from textloom.operators.splits import order_digest, top_of_each
from textloom.places import shared_folder
from textloom.schema import LANGUAGES, NEEDS_REVIEW

# Hints of harassment, and words by which Indonesian rows are suggested.
HARASS_HINTS = (
    "催收|欠款|逾期|讨债|灰产|发票代开|色情|约炮|加微信下款|无抵押|赌博|博彩|私服",
    r"\bdebt\b|\bcollect(ion|or)\b|\boverdue\b|\bloan\b.{0,20}\b(whatsapp|wechat|telegram)\b",
    r"\bsexy\b|\bhook ?up\b|\bget laid\b|\badult\b|\bpoker\b|\bcasino\b",
    "hutang|penagihan|terlambat|pinjaman|togel|judi|dewasa|seks",
    "loan|debt|collection|sexy|casino|gambling",
)
ID_FRAUD_HINT = "hadiah|menang|undian|pinjaman cair|biaya admin|klik link|akun terblokir"
ID_TXN_HINT = "otp|kode verifikasi|kode rahasia|transfer berhasil|pembayaran berhasil|saldo|rekening|resi|pengiriman|pesanan"
ID_HARASS_HINT = "hutang|penagihan|terlambat|judi|togel|dewasa"
ID_AD_HINT = "diskon|promo|gratis|beli sekarang|sale|voucher"
GAP_ORDER = ("HARASS", "TRANSACTION", "FRAUD", "AD", NEEDS_REVIEW)


def harass_score(text: Column) -> Column:
    """How many of the hint patterns a text has."""
    out = F.lit(0)
    for pattern in HARASS_HINTS:
        out = out + text.rlike(f"(?i){pattern}").cast("int")
    return out


def relabel_candidates(rows: DataFrame, most: int = 800, include_ad: bool = True, seed: int = 42) -> DataFrame:
    """Rows (id, text, language, prior_label) that may be harassment, likeliest first, with score and reason.

    Hinted rows left for review score 10 and their hints, hinted advertising its hints, other rows left for review nothing.
    Of an id its best row counts; ties go by digest.
    """
    review, hits = F.col("prior_label") == NEEDS_REVIEW, harass_score(F.coalesce("text", F.lit("")))
    scored = rows.withColumn("_hits", hits)
    found = F.col("_hits") > 0
    reason = F.when(review & found, "nr_hint").when(F.lit(include_ad) & (F.col("prior_label") == "AD") & found, "ad_borderline").when(review & F.col("language").isin(*LANGUAGES), "nr_pool")
    score = F.when(reason == "nr_hint", F.col("_hits") + 10).when(reason == "ad_borderline", F.col("_hits")).otherwise(0)
    scored = scored.withColumn("suggest_reason", reason).withColumn("score", score).filter("suggest_reason IS NOT NULL").withColumn("_digest", order_digest(seed, F.col("id")))
    best = scored.groupBy("id").agg(F.max_by(F.struct("text", "language", "prior_label", "suggest_reason", "score", "_digest"), "score").alias("r")).select("id", "r.*")
    suggested = F.when(F.col("suggest_reason") == "nr_pool", NEEDS_REVIEW).otherwise("HARASS")
    return best.orderBy(F.desc("score"), "_digest").limit(most).withColumn("suggested_label", suggested).drop("_digest")


def gap_fill_candidates(rows: DataFrame, most: int = 1000, language: str = "id") -> DataFrame:
    """Rows of a language left for review with a suggested label, weak labels first, then by id."""
    text = F.coalesce("text", F.lit(""))
    hint = cascade([(text.rlike(f"(?i){p}"), label, f"id_{label[:3].lower() if label == 'TRANSACTION' else label.lower()}_hint") for p, label in ((ID_FRAUD_HINT, "FRAUD"), (ID_TXN_HINT, "TRANSACTION"), (ID_HARASS_HINT, "HARASS"), (ID_AD_HINT, "AD"))], (NEEDS_REVIEW, "id_nr_open"))
    pool = rows.filter((F.col("language") == language) & (F.col("prior_label") == NEEDS_REVIEW)).withColumn("_h", hint)
    order = F.array_position(F.array(*(F.lit(x) for x in GAP_ORDER)), F.col("_h.label"))
    return pool.withColumn("_order", order).orderBy("_order", "id").limit(most).withColumn("suggested_label", F.col("_h.label")).withColumn("suggest_reason", F.col("_h.reason")).drop("_h", "_order")


def quotas(have: dict[str, int], n: int) -> dict[str, int]:
    """How many rows of each label a pilot of ``n`` takes: 30 % (120 at least) for review, every transaction, a third of the
    rest (80 at least) each for fraud and advertising, what is left for harassment; an overflow is taken from advertising
    and then from fraud."""
    review = min(have.get(NEEDS_REVIEW, 0), max(120, n * 3 // 10))
    txn = min(have.get("TRANSACTION", 0), n - review)
    rest = n - review - txn
    fraud, ad = (min(have.get(x, 0), max(80, rest // 3)) for x in ("FRAUD", "AD"))
    over = max(0, fraud + ad - rest)
    cut = min(ad, over)
    ad, fraud = ad - cut, max(0, fraud - (over - cut))
    return {"TRANSACTION": txn, "FRAUD": fraud, "AD": ad, "HARASS": min(have.get("HARASS", 0), max(0, rest - fraud - ad)), NEEDS_REVIEW: review}


def sample_quota(rows: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A pilot sample by ``quotas``, topped up from the rest; counts of the labels, five rows, are all that is collected."""
    have = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    wanted = F.create_map(*(F.lit(x) for kv in quotas(have, n).items() for x in kv))
    drawn = rows.withColumn("_digest", order_digest(seed, F.col(key)))
    most = max([1, *quotas(have, n).values()])  # a literal bound, so that each partition keeps its first rows only
    picked = top_of_each(drawn, [label], [F.col("_digest")], most).filter(F.col("_rank") <= F.coalesce(wanted[F.col(label)], F.lit(0))).drop("_rank")
    rest = drawn.join(picked.select(key), key, "left_anti").select(*picked.columns)
    short = max(0, n - sum(min(have.get(x, 0), q) for x, q in quotas(have, n).items()))
    return picked.unionByName(rest.orderBy("_digest").limit(short)).drop("_digest")


def representative_sample(rows: DataFrame, order: str, n: int, text: str = "text") -> DataFrame:
    """The first ``n`` rows as model inputs."""
    from textloom.functions.text import encode_bytes, normalize_text

    first = rows.orderBy(order).limit(n).withColumn("_text", normalize_text(F.col(text)))
    return first.select(order, encode_bytes(F.col("_text")).alias("ids"))


def ngram_table(rows: DataFrame, vocabulary: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """``rows`` that have a trainable label, with ``features`` (counts of the vocabulary's byte n-grams) and ``label_index``.

    Counts are made once, some texts at a time, and kept in a table, since who fits a model reads them more than once.
    """
    from pyspark.ml.linalg import VectorUDT

    from textloom.functions.text import gram_code, window_codes
    from textloom.schema import LABELS

    spark = rows.sparkSession
    known = rows.filter(F.col(label).isin(*LABELS))
    at = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col(label)).cast("double") - 1
    codes = np.array([gram_code(r["gram"]) for r in vocabulary.toLocalIterator()], np.int32)  # a fixed number of n-grams
    size, order = len(codes), np.argsort(codes, kind="stable")
    ordered, names = codes[order], [*known.columns, "label_index"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, code in window_codes(batch[text]):
                place = np.minimum(np.searchsorted(ordered, code), max(0, size - 1))
                held = ordered[place] == code if size else np.zeros(len(code), bool)
                kind = np.int32 if n * size < 1 << 31 else np.int64  # the smaller sorts faster
                key, count = np.unique(row[held].astype(kind) * size + order[place[held]].astype(kind), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n + 1) * size).astype(np.int32))
                indices, values = pa.array((key % max(1, size)).astype(np.int32)), pa.array(count.astype(np.float64))
                vectors = pa.StructArray.from_arrays(
                    [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, indices), pa.ListArray.from_arrays(ends, values)], names=["type", "size", "indices", "values"]
                )
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns, vectors], names=[*names, "features"])

    marked, folder = known.withColumn("label_index", at), shared_folder(spark, "ngram-table")
    sparse = T.StructType.fromDDL("features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    marked.mapInArrow(counted, T.StructType([*marked.schema.fields, *sparse.fields])).write.parquet(folder)
    return spark.read.schema(T.StructType([*marked.schema.fields, T.StructField("features", VectorUDT())])).parquet(folder)


def train_ngram_logistic(rows: DataFrame, vocabulary: DataFrame, text: str = "text", label: str = "label", iterations: int = 100):
    """Multinomial logistic regression over byte n-gram counts; returns (model, the table it was fitted on).

    Only trainable rows are used, so features and labels stay aligned. Rows of equal text and label are one row with their
    number as its weight: the loss is the same sum, and each round goes over fewer.
    """
    from pyspark.ml.classification import LogisticRegression

    weighted = rows.groupBy(text, label).agg(F.count("*").cast("double").alias("weight"))
    table = ngram_table(weighted, vocabulary, text, label)
    model = LogisticRegression(family="multinomial", regParam=0.0, maxIter=iterations, featuresCol="features", labelCol="label_index", weightCol="weight").fit(table)
    return model, table
