"""Columns whose names clash with those of results."""

from pyspark.sql import functions as F

from anchorline.llm import bpe, mpegts
from anchorline.llm.queries import vocabulary_path


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words", "x", "y"), (2, None, None, "z")], "doc_id long, text string, payload string, ids string")
    made = mpegts.mux(docs.select("doc_id", "text"))
    plain = mpegts.demux(made)
    rows = {r["doc_id"]: r for r in mpegts.demux(made.withColumn("payload", F.lit("mine")).withColumn("packets", F.lit(-1))).collect()}
    assert {r["doc_id"]: (bytes(r["payload"]), r["packets"]) for r in plain.collect()} == {k: (bytes(r["payload"]), r["packets"]) for k, r in rows.items()}
    assert all((r["given_payload"], r["given_packets"]) == ("mine", -1) for r in rows.values())
    found = {r["doc_id"]: r for r in bpe.encode_texts(docs, vocabulary_path(), keep=("doc_id", "ids", "text")).collect()}
    assert (found[1]["given_ids"], found[1]["text"], found[2]["ids"]) == ("y", "some words", []) and found[1]["ids"]
