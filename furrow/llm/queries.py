"""The contract queries of the text operators: thin callers that derive digest columns from real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.shared import fold, table

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    from furrow.llm.chat_format import format_chats, loss_text, parse_chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, '{CONTROL_TEXT}' text from values (0, 'user'), (1, 'assistant') as v(t, r)")
    out = format_chats(turns.unionByName(extra))
    out = out.withColumn("turns", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.exact_dedup import exact_dedup

    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The contract's rules for op5.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.toxicity import score_toxicity, train_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.language_id import predict_language, train_language_model

    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(fold("doc_id", 3) != 1))
    return predict_language(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' own verdicts are the labels that the trees learn from."""
    from furrow.llm.url_filter import Rule, best_rule, host_of, judge_urls, path_of, train_url_model

    rules = [Rule(*r) for r in URL_RULES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = pages.withColumn("verdict", best_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"])
    return judge_urls(pages, train_url_model(labelled), rules)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.language_model import score_texts, train_language_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, train_language_model(docs.where(fold("doc_id", 10) != 0)))
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of a benchmark item, with the items and the places."""
    from furrow.llm.decontamination import find_contamination

    hits = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumnsRenamed({"start": "doc_start", "end": "doc_end"})


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from furrow.llm.quality import quality_features, score_features, train_on_features

    found, labels = quality_features(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    out = score_features(found, train_on_features(found, labels.where(fold("doc_id", 3) != 1)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def language_model_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's rows with sums rounded, so that engines that add in another order agree."""
    out = op7_language_model(spark, sf_dir).drop("perplexity")
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join as the pipeline uses it: five words, four fifths."""
    from furrow.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=5, num=80)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every url."""
    from furrow.llm.url_filter import Rule, best_rule, host_of, path_of

    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return pages.withColumn("found", best_rule(F.col("host"), F.col("path"), [Rule(*r) for r in URL_RULES])).select("page_id", "host", "path", "found.rule", "found.verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_model": op7_language_model,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "language_model_rounded": language_model_rounded,
    "near_duplicates": near_duplicates,
    "url_rules": url_rules,
}
