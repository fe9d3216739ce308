"""The pipeline's stages against the operators' brute force, one after another."""

from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pytest

from vecloom.llm import common, queries, secret_scan
from vecloom.llm.quality_crf import train

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    secret = spark.createDataFrame([(70, "A line with token = abcdef123456 inside it here.", "en", "s", 48), (71, "BUY!! NOW!! FREE!! WIN!! CASH!! BIG!! DEAL!!", "en", "s", 44)], docs.schema)
    docs.union(secret).write.parquet(f"{path}/documents.parquet")
    rows = [(i, 1) for i in range(30, 60)] + [(71, 0)]
    spark.createDataFrame([(i, q, 0) for i, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        old, new = before.collect(), docs.collect()
        if name == "quality":
            assert not Counter(new) - Counter(old)
        elif name == "exact_dedup":
            texts = Counter(r["text"] or "" for r in new)
            assert set(texts) == {r["text"] or "" for r in old} and set(texts.values()) == {1}
            best = {}
            for r in old:
                best[r["text"] or ""] = max(best.get(r["text"] or "", -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert all((-1 if r["doc_id"] is None else r["doc_id"]) == best[r["text"] or ""] for r in new)
        elif name == "near_dedup":
            assert not Counter(new) - Counter(old) and len(new) < len(old)
        elif name == "secrets":
            assert len(new) == len(old)
            grammars = secret_scan.automata(tuple(secret_scan.labelled_credentials()))
            want = Counter(secret_scan.redact(r["text"], secret_scan.scan(r["text"], grammars)[1]) if r["text"] else r["text"] for r in old)
            assert Counter(r["text"] for r in new) == want
            assert any(r["doc_id"] == 70 and "[assign]" in r["text"] and r["n_chars"] == len(r["text"]) for r in new)
        else:
            assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old}


def test_run_is_the_stages_in_a_row(spark, folder):
    rows = P.run(spark, folder).collect()
    assert rows and Counter((r["doc_id"], r["piece"]) for r in rows).most_common(1)[0][1] <= 2


def test_quality_stage_drops_what_the_model_rejects(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chain = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert chain.weights is not None
    assert P.quality(spark, docs, folder).count() <= docs.count()


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    """64 texts of 256 KB in one partition (16 MB): no batch holds much over BATCH bytes, whatever the session allows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(64, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 52429) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    monkeypatch.setattr(P.near_copies, "drop_near_copies", lambda docs: docs.mapInArrow(sizes, "n long, size long"))
    for held, most in (("64m", 4 << 20), ("1m", 1 << 20)):
        try:
            spark.conf.set(name, held)
            got = P.near(spark, docs, "").collect()
        finally:
            spark.conf.unset(name)
        assert sum(r["n"] for r in got) == 64 and max(r["size"] for r in got) <= most + (1 << 19)


def test_workers_keep_small_tables(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    for n in (1000, 70_000, common.BLOCK_BYTES + 1):
        up, down = common.powers(n, 0)
        assert n <= len(up) == len(down) < 2 * n and (up[:n] * down[:n] == 1).all()


def test_registered_once():
    assert [n for n in queries.QUERIES if n.startswith("op")] == list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert P.ORACLE_SQL is None
