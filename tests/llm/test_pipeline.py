"""The pipeline's stages on the smallest tables."""

import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from epilens.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    again = docs.groupBy(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("t")).count().where("count > 1")
    assert again.isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(0 <= r.ids_crc32 <= zlib.crc32(b"") + 2**32 for r in pieces)


def test_stages_keep_any_columns(spark):
    """Columns named as the stages' own, and a map, come out as they went in."""
    extra = {"row_key": F.concat(F.lit("mine"), "doc_id"), "digest": F.lit("d"), "shard": F.lit(3), "key": F.lit("k"), "norm": F.lit(1.5), "row": F.col("doc_id") + 1, "doc": F.lit("x"), "a.b": F.lit(2), "m": F.create_map(F.lit("id"), "doc_id")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, *extra], name
        rows = docs.collect()
        assert rows and all(r.row_key == f"mine{r.doc_id}" and r.m == {"id": r.doc_id} and r.row == r.doc_id + 1 and r["a.b"] == 2 for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)


def test_intermediates_are_deleted(spark, tmp_path, monkeypatch):
    """A stage's result needs none of what its operator wrote on the way."""
    monkeypatch.setattr(common, "shared_root", lambda _: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = set(tmp_path.iterdir())
        kept = stage(spark, docs, SF)
        written = {p.name.rpartition("-")[0] for folder in set(tmp_path.iterdir()) - before for p in folder.iterdir() if p.is_dir()}
        assert written in ({"dropped"}, {"groups"})
        assert 0 < kept.count() < docs.count()
