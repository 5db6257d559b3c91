"""Queries of the router that learns: fitted on two thirds of the labelled documents, written, read again, and put to every document."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from ..functions import linear, tokens
from ..functions.scoring import ArrowScorer, padding
from ..operators import train
from ..sources import sinks

#: The label that stands for what the moderation route is for, and the remainder of doc_id whose rows teach nothing.
CLASSES, THIRD = ("moderation", "safe"), 1
#: A public vocabulary; only the driver reads the file.
VOCABULARY = os.environ.get("SAFELENS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _held():
    return F.col("doc_id") % 3 == THIRD


def _scored(spark, sf):
    """doc_id, toxic, held_out and router of all documents that have a text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = docs.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("text <> ''").join(labels, "doc_id", "left")
    known = rows.filter(F.col("toxic").isNotNull() & ~_held()).withColumn("class", F.when(F.col("toxic") == 1, CLASSES[0]).otherwise(CLASSES[1]))
    at = f"{sinks.scratch(spark)}/router"
    train.fit(known, "text", "class", CLASSES).write(spark, at)
    scorer = train.trained_scorer(router=linear.read_model(spark, at))
    return rows.withColumn("router", scorer.router(F.col("text"))).select("doc_id", "toxic", _held().alias("held_out"), "router")


def trained_router_scores(spark, sf):
    return _scored(spark, sf).select("doc_id", "held_out", F.round("router.moderation", 6).alias("moderation"), F.round("router.safe", 6).alias("safe"))


def trained_router_auc(spark, sf):
    """How well scores part toxic documents from others, among those that taught and those that didn't."""
    rows = _scored(spark, sf).filter("toxic IS NOT NULL").withColumn("score", F.round("router.moderation", 6))
    return train.auc(rows, F.col("toxic") == 1, F.col("score"), ("held_out",)).select("held_out", "rows", "positives", F.round("auc", 6).alias("auc"))


def document_tokens(spark, sf):
    """Subword tokens of every document, and how many a model of 512 reads."""
    tokenizer = tokens.SubwordTokenizer(VOCABULARY, special=2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", tokens.token_counts(F.col("text"), tokenizer).alias("tokens")).withColumn("read", F.least("tokens", F.lit(512)))


def batch_padding(spark, sf):
    """What a model of 512 tokens reads of all documents in batches of 32, and the shares that are padding in the order of rows and in that of lengths."""
    model = tokens.TokenReader(linear.LinearModel(CLASSES, [], np.zeros((1, len(CLASSES)))), tokens.SubwordTokenizer(VOCABULARY, special=2))
    scorer = ArrowScorer(None, lambda: model, lambda: model, 32, 512)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = padding(docs.select(scorer.measured_prompt(F.col("text")).alias("m")), "m")
    return out.select("texts", "tokens", F.round("padding_unsorted", 4).alias("padding_unsorted"), F.round("padding", 4).alias("padding"))


QUERIES = [trained_router_scores, trained_router_auc, document_tokens, batch_padding]


def _model_sql() -> str:
    """The same model in SQL: buckets, the choice of telling ones, every round, and the scores of all documents."""
    q = linear.BUCKETS
    rounds = []
    for k in range(train.ROUNDS):
        rounds.append(f"""m{k} AS MATERIALIZED (SELECT doc_id, any_value(y) AS y, any_value(n) AS n, 1 / (1 + exp(-2 * (any_value(b) + coalesce(sum(w), 0) / sqrt(greatest(any_value(n), 1))))) - any_value(y) AS e
  FROM teach LEFT JOIN x USING (doc_id) LEFT JOIN w{k} USING (bucket), b{k} GROUP BY doc_id),
b{k + 1} AS MATERIALIZED (SELECT any_value(b) - sum(e) / count(*) AS b FROM m{k}, b{k}),
w{k + 1} AS MATERIALIZED (SELECT bucket, any_value(w) - sum(e / sqrt(n)) / any_value(mass) AS w FROM x JOIN m{k} USING (doc_id) JOIN w{k} USING (bucket) JOIN telling USING (bucket) GROUP BY bucket)""")
    return f"""
docs AS (SELECT doc_id, toxic, doc_id % 3 = {THIRD} AS held_out, translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
cut AS (SELECT doc_id, [unicode(c)::BIGINT FOR c IN string_split(t, '')] AS c,
  [(list_sum(list_transform(string_split(v, ''), lambda x, i: unicode(x)::BIGINT * (i * 40503 % 65521))) % {q})::BIGINT FOR v IN regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')] AS h FROM docs),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_concat(h, [(h[i] * 8191 + h[i + 1] * 131071 + 7) % {q} FOR i IN range(1, len(h))],
  [(c[i] * 31337 + c[i + 1] * 1009 + c[i + 2] * 65537 + 11) % {q} FOR i IN range(1, len(c) - 1)])) AS bucket FROM cut),
taught AS (SELECT doc_id, (toxic = 1)::INTEGER AS y FROM docs WHERE toxic IS NOT NULL AND NOT held_out),
total AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM taught),
telling AS MATERIALIZED (SELECT bucket, has + {train.SHRINK}::DOUBLE AS mass FROM (SELECT bucket, count(*)::DOUBLE AS has, sum(y)::DOUBLE AS yes FROM grams JOIN taught USING (doc_id) GROUP BY bucket), total
  WHERE p > 0 AND p < n AND abs(yes / p - (has - yes) / (n - p)) >= {train.TELLING}::DOUBLE * sqrt((has + 1) / n * (1 / p + 1 / (n - p)))),
kept AS MATERIALIZED (SELECT doc_id, bucket, count(*) OVER (PARTITION BY doc_id) AS n FROM grams JOIN telling USING (bucket)),
x AS MATERIALIZED (SELECT doc_id, bucket FROM kept JOIN taught USING (doc_id)),
teach AS MATERIALIZED (SELECT doc_id, y, coalesce(n, 0) AS n FROM taught LEFT JOIN (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id) USING (doc_id)),
w0 AS (SELECT bucket, 0.0::DOUBLE AS w FROM telling), b0 AS (SELECT 0.0::DOUBLE AS b),
{", ".join(rounds)},
scored AS (SELECT doc_id, any_value(toxic) AS toxic, any_value(held_out) AS held_out, any_value(b) + coalesce(sum(w), 0) / sqrt(greatest(count(bucket), 1)) AS m
  FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN w{train.ROUNDS} USING (bucket), b{train.ROUNDS} GROUP BY doc_id),
s AS (SELECT doc_id, toxic, held_out, round(1 / (1 + exp(-2 * m)), 6) AS moderation, round(1 / (1 + exp(2 * m)), 6) AS safe FROM scored)"""


def oracle_sql() -> dict[str, str]:
    model = _model_sql()
    won = "count(*) FILTER (WHERE a.moderation > b.moderation) + count(*) FILTER (WHERE a.moderation = b.moderation) / 2"
    return {
        "trained_router_scores": f"WITH {model} SELECT doc_id, held_out, moderation, safe FROM s",
        "trained_router_auc": f"""WITH {model}, k AS (SELECT * FROM s WHERE toxic IS NOT NULL),
pairs AS (SELECT a.held_out, ({won})::DOUBLE / count(*) AS auc FROM k a JOIN k b ON a.held_out = b.held_out AND a.toxic = 1 AND b.toxic <> 1 GROUP BY a.held_out)
SELECT held_out, count(*) AS rows, count(*) FILTER (WHERE toxic = 1) AS positives, round(any_value(auc), 6) AS auc FROM k LEFT JOIN pairs USING (held_out) GROUP BY held_out""",
    }
