"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, against quantiles of each language.

The model is counted on most of the trusted documents, as byte n-grams of whole texts that run over word boundaries. The rest of the
trusted documents, a fifth by a hash of the text, is held out: the thresholds are quantiles of its perplexities, so what the model has
seen doesn't lower them. Short texts have widely spread perplexities, so a language has a quantile for each band of lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.kneser_ney import build_model, labelled, score
from ledgermesh.llm.text import texts_of
from ledgermesh.session import cut

#: A document is rejected above this quantile of the perplexities that held-out trusted documents of its language and length have.
QUANTILE = 0.995
#: One trusted document in so many is held out.
HELD_OUT = 5
#: Lengths in symbols at which the bands of a language begin.
BANDS = (64, 256, 1024)
#: Decimals of the log-perplexity in which quantiles are told apart, so that an aggregate holds few values.
DIGITS = 3
#: With fewer held-out documents a band takes its language's quantile, a language its band's over all languages, and that one the quantile of all.
LEAST_TRUSTED = 30


def perplexity() -> Column:
    return F.when(F.col("n_symbols") > 0, F.exp(-F.col("ll") / F.col("n_symbols")))


def band() -> Column:
    """Number of the document's length band."""
    return reduce(lambda a, b: a + b, ((F.col("n_symbols") >= n).cast("int") for n in BANDS))


def quality_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and keep of each row of docs.

    Trusted text is that of rows labelled with quality 1: the model is counted on it but for one text in HELD_OUT, and the
    thresholds are quantiles over those. A null lang is a language of its own. A text that is null, empty or
    white space has no perplexity and isn't kept. Without any held-out text no threshold exists and every
    text with words is kept. Repeated rows repeat, and equal texts are held out together; columns other than doc_id, text and lang are left out.
    """
    return _decided(docs, labels, quantile).drop("_tag")


def keep_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs, with all their columns, that quality_documents keeps."""
    kept = _decided(docs, labels, quantile).filter("keep").select("doc_id", "lang", "_tag").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_own"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("_row.lang").eqNullSafe(F.col("lang")) & (F.col("_own") == F.col("_tag"))
    return rows.join(kept, same, "left_semi").select("_row.*")


def _mark(held: DataFrame, quantile: float, name: str, *by: str) -> DataFrame:
    """The groups' quantiles of the log-perplexity where enough documents are held out: values that occur, so the largest one of a small group. Tasks send one histogram a group."""
    found = held.groupBy(*(F.col(c).alias(f"{name}_{c}") for c in by)).agg(F.expr(f"percentile_disc({quantile!r}) WITHIN GROUP (ORDER BY _bin)").alias(name), F.count("*").alias("_n"))
    return found.filter(F.col("_n") >= (LEAST_TRUSTED if by else 1)).drop("_n")


def _decided(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    rows = labelled(texts_of(docs, "doc_id", "lang"), labels, "quality").withColumn("_tag", F.xxhash64("text"))
    trusted, held = F.coalesce(F.col("_quality") == 1, F.lit(False)), F.pmod(F.col("_tag"), F.lit(HELD_OUT)) == 0
    model = build_model(rows.select("text", F.when(trusted & ~held, 0).alias("class")), words=False)
    scored = score(rows.withColumn("_held", trusted & held).drop("_quality"), model, words=False)
    scored = cut(scored.select("doc_id", "lang", "_tag", "_held", "n_words", perplexity().alias("perplexity"), band().alias("band")))
    bins = scored.filter(F.col("_held") & F.col("perplexity").isNotNull()).withColumn("_bin", F.ceil(F.ln("perplexity") * 10**DIGITS) / 10**DIGITS)
    joined = scored
    for name, by in (("own", ("lang", "band")), ("of_lang", ("lang",)), ("of_band", ("band",))):
        marks = F.broadcast(_mark(bins, quantile, name, *by))  # a row for each language and band
        joined = joined.join(marks, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in by)), "left")
    of_all = _mark(bins, quantile, "of_all").first()  # one row
    limit = F.exp(F.coalesce("own", "of_lang", "of_band", F.lit(float("inf") if of_all is None else of_all["of_all"])))
    return joined.select("doc_id", "lang", "_tag", "n_words", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))
