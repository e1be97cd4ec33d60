"""The queries opN_<name>, each one operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearopt.llm import centroids, chat, fim, langid, minhash, mixing, nndescent, packing, pii, pqdedup, resample, secrets, urlrules

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str, apply: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: apply(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": _table("conversations", lambda t: chat.format_digest(chat.with_trap(t))),
        "op2_pq_dedup": _table("embeddings", pqdedup.near_duplicates),
        "op3_nn_descent": _table("embeddings", nndescent.nearest),
        "op4_pii": _table("documents", pii.find),
        "op5_resample": lambda spark, sf_dir: resample.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")),
        "op6_language_id": _table("documents", lambda t: langid.identify(t, langid.learn(t))),
        "op7_packing": _table("documents", packing.pack),
        "op8_minhash": _table("documents", minhash.near_duplicates),
        "op9_secret_scan": _table("documents", lambda t: secrets.scan_digest(t, thorough=True)),
        "op10_mixing": _table("documents", mixing.mix_digest),
        "op11_fill_in_middle": _table("documents", fim.digest),
        "op12_url_rules": _table("pages", urlrules.judge),
        "op13_centroids": _table("embeddings", centroids.cluster),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.SQL, "op2_pq_dedup": pqdedup.SQL, "op8_minhash": minhash.SQL, "op10_mixing": mixing.SQL, "op11_fill_in_middle": fim.SQL, "op12_url_rules": urlrules.SQL, "op13_centroids": centroids.SQL,
    }
