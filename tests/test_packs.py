"""Packs: round trips, repeats, sizes, and what a task that fails leaves behind."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from deltaloom.sources import packs


def held(spark, path):
    return {r.digest: (r.length, bytes(r.content)) for r in packs.objects(spark, path).collect()}


def test_contents_come_back_once_each(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    texts = ["", "a", "é" * 1000, "x" * 100_000, *(f"text {i % 40}" for i in range(90))]
    packs.stored(spark.createDataFrame([(t,) for t in texts] + [(None,)], "content string").repartition(5), path)
    want = {hashlib.sha256(t.encode()).hexdigest(): (len(t.encode()), t.encode()) for t in texts}
    assert held(spark, path) == want
    packs.stored(spark.createDataFrame([("a",), ("new",)], "content string"), path)
    assert held(spark, path) == want | {hashlib.sha256(b"new").hexdigest(): (3, b"new")}
    packs.stored(spark.createDataFrame([("a",)], "content string"), path)  # nothing is new
    assert len(held(spark, path)) == len(want) + 1
    heads = packs.objects(spark, path, contents=False).collect()
    assert {r.content for r in heads} == {None}
    for pack in {r.pack for r in heads}:  # offsets are sums of the lengths before
        own = sorted((r.offset, r.length) for r in heads if r.pack == pack)
        assert own == [(sum(n for _, n in own[:i]), n) for i, (_, n) in enumerate(own)]
    assert not os.listdir(f"{path}/_staged")


def test_a_failing_job_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "store")
    packs.stored(spark.createDataFrame([("first",)], "content string"), path)
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    bad = rows.withColumn("digest", F.sha2("content", 256)).select("digest", "content")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("packs").mode("append").save(path)
    assert [c for _, c in held(spark, path).values()] == [b"first"]
    assert len(os.listdir(f"{path}/manifests")) == 1


def test_packs_are_bounded_and_stray_files_are_not_read(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packs, "PACK", 100)
    writer = packs.PackWriter(str(tmp_path / "store"))
    batch = pa.RecordBatch.from_pylist([{"digest": str(i), "content": bytes(60)} for i in range(5)] + [{"digest": "big", "content": bytes(500)}])
    lost = writer.write(iter([batch]))  # an attempt whose result never came back
    won = writer.write(iter([batch]))
    assert len(won.packs) == len(lost.packs) == 6
    writer.commit([won, None])
    assert sorted(r.digest for r in packs.objects(spark, str(tmp_path / "store")).collect()) == ["0", "1", "2", "3", "4", "big"]
