"""Queries of the training-data operators: each applies one operator, with
production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.llm import chat, lexical_search, licenses, oracles
from tardy.llm.decontaminate import contamination
from tardy.llm.html_text import extract_text
from tardy.llm.langid import held_out, predict_language, train_language
from tardy.llm.licenses import scan_licenses
from tardy.llm.lexical_search import search
from tardy.llm.near_dedup import near_duplicates
from tardy.llm.periodic_runs import periodic_runs
from tardy.llm.piece_sampling import sample_pieces
from tardy.llm.quality import fit_quality, score_quality
from tardy.llm.urls import filter_urls
from tardy.llm.weighted_sampling import fingerprint_edits
from tardy.llm.word_bpe import encode_texts
from tardy.session import ship_package

#: rows that a Python task holds at once
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings of the queries: small Arrow batches (texts are long)
    and this package on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = sample_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "sample", "n_ids", F.xxhash64("ids").alias("ids_hash"), "log_prob", "log_inclusion", "round_trip")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                       F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return predict_language(docs, train_language(docs)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return (score_quality(docs, fit_quality(docs, labels)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def repeat_tails(ids: list[int | None], texts: list[str | None]) -> list[str | None]:
    """Texts of the run query: with h = crc32 of the decimal id and g = h div 10,
    where h mod 10 is 0 the words from a = g mod n on repeat the p =
    1 + (n - a) div (3 + g mod 8) words at a."""
    out = list(texts)
    for i, (key, text) in enumerate(zip(ids, texts)):
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        w = (text or "").encode("utf-8", "surrogatepass").split() if h % 10 == 0 else []
        if w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w[a:] = (w[a:a + p] * -(-(n - a) // p))[:n - a]
            out[i] = b" ".join(w).decode("utf-8", "surrogatepass")
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=repeat_tails)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start, then period, so an equal exponent keeps the earlier one
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
                        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_piece_sampling": op2_piece_sampling,
    "op3_chat_format": op3_chat_format,
    "op4_html_text": op4_html_text,
    "op5_fingerprints": op5_fingerprints,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_word_bpe": op12_word_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": oracles.near_duplicates_sql(),
    "op3_chat_format": chat.oracle_sql(),
    "op6_decontamination": oracles.contamination_sql(),
    "op7_license_scan": licenses.oracle(),
    "op11_lexical_search": lexical_search.oracle_sql(),
}
