"""One query for each operator of this package, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import (
    chat, decontaminate, exact_dedup, fill_in_middle, filter_audit, licences, mixing, near_dup, secrets, shards, suffix_dedup, toxicity, url_filter
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    older, newer = exact_dedup.halves(table(spark, folder, "documents"))
    return exact_dedup.exact_duplicates(older, newer).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.concat("base", "extra")).alias("spans"),
    )


def op3_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.write_shards(table(spark, folder, "documents"))[1]


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.contaminated_words(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conflict = chat.END + chat.START + "assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(conflict).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat.format_chats(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.get("copies", F.lit(0))["position"]).alias("first_position"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licence_hits(table(spark, folder, "documents"))
    rules = F.transform("matches", lambda m: F.concat_ws(":", m["rule"], m["first"].cast("string"), m["last"].cast("string")))
    return found.select(
        "doc_id", "n_sentences", F.size("identifiers").cast("long").alias("n_identified"),
        F.array_join(F.array_sort(rules), ",").alias("rules"), F.array_join("licences", ",").alias("licences"),
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules, url_filter.unwanted_pages(pages))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_shards": op3_token_shards,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_licence_scan": op8_licence_scan,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}
