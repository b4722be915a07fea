"""The pipeline's stages on a corpus with planted cases, and what the entry offers."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quirelake.llm import common
from tests.llm import data


def planted(tmp_path, spark):
    rng = random.Random(11)
    new = lambda: "\n".join(" ".join(f"{rng.choice(data.WORDS)}{rng.randint(0, 999)}" for _ in range(12)) + "." for _ in range(8))
    docs = {i: new() for i in range(200)}
    item = " ".join(f"{rng.choice(data.WORDS)}{rng.randint(0, 999)}" for _ in range(25))
    passage = " ".join(f"{rng.choice(data.WORDS)}{rng.randint(0, 999)}" for _ in range(60)) + "."
    toxic, leaked, quoting, copies = range(0, 40), range(40, 50), range(50, 65), range(65, 75)
    for i in toxic:
        docs[i] = docs[i].replace(".", f" vileword and vileness{i}.", 1)
    for i in leaked:
        docs[i] += f" And so on {i}: {item}, says number {i * 7}."
    for i in quoting:
        docs[i] += "\n" + passage
    for i in copies:
        words = docs[75].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        docs[i] = " ".join(words)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in docs], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, toxic, leaked, passage


def test_stages_in_order(spark, tmp_path):
    docs, toxic, leaked, passage = planted(tmp_path, spark)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {*toxic, *leaked, *range(66, 76)}  # of the copies, 65 stays
    assert set(out) == set(docs) - gone
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in out.items():
        text = docs[i].replace("\n" + passage, "")
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        assert bytes(r["ids"]) == ids.tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_stage_keeps_the_columns(spark, tmp_path):
    planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_release_their_tables(spark, tmp_path):
    """What a stage wrote on the way, and its result doesn't read, is gone before the next."""
    planted(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage, needed in (
        (corpus_pipeline.drop_lines, {"line-cut", "line-places", "line-recurring", "line-held", "line-fields", "line-told"}),
        (corpus_pipeline.drop_near_copies, {"copy-marks", "copy-rows", "copy-fingerprints", "copy-bands", "copy-open", "copy-large", "copy-met", "copy-links", "links"}),
    ):
        before = set(os.listdir(common.shared_folder(spark)))
        found = stage(spark, docs, str(tmp_path))
        left = {x.rsplit("-", 1)[0] for x in set(os.listdir(common.shared_folder(spark))) - before}
        assert left <= needed
        assert len(found.collect()) == found.count()  # read more than once


def test_stages_of_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, shared and null ids,
    clashing columns."""
    planted(tmp_path, spark)
    docs = data.documents(spark).withColumn("doc_id", F.col("doc_id") + 100)  # labelled as clean
    extra = spark.createDataFrame([(None, None, None, None, None), (102, "an unlike text under an id that is taken", None, "s", 1), (None, "a text without an id", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    awkward = docs.unionByName(extra, allowMissingColumns=True)
    n = awkward.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, awkward, str(tmp_path)).collect()
        # Near copies: the copy, its repetition, and all but one of four texts without a word.
        assert len(found) == (n - 5 if name == "near_copies" else n), name
        assert {r.text for r in found} >= {"a text without an id", "an unlike text under an id that is taken", "é"}
    tokens = corpus_pipeline.tokenise(spark, awkward, str(tmp_path))
    assert tokens.count() == n


def test_shared_ids_are_judged_by_text(spark, tmp_path):
    docs, _, leaked, _ = planted(tmp_path, spark)
    rows = [(1, docs[leaked[0]]), (1, "nothing of the kind stands here at all"), (None, docs[leaked[1]]), (None, "nor here")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert sorted(r.text for r in found) == ["nor here", "nothing of the kind stands here at all"]


def test_entry_offers_the_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
