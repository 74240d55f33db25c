"""Operators 4 and 5, and the pipeline's form."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import nearest, warc_store
from cloakwork.llm.common import fresh_path
from cloakwork.llm.hilbert import hilbert_keys
from cloakwork.llm.queries import ORACLE_SQL, op4_nearest, op5_warc


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        near = sorted((float(np.sqrt(((np.array(vectors[q]) - np.array(v)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = near[:k]
    return out


def test_nearest_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {}
    for r in op4_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(vectors, [i for i in vectors if i % 100 == 0], 10)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in near})
        for _, i, s in found:
            assert s == pytest.approx(float(np.linalg.norm(np.array(vectors[q]) - np.array(vectors[i]))), abs=1e-12)
    assert hits / (10 * len(want)) >= 0.9


def test_nearest_edges(spark):
    rows = [(i, [1.0, float(i % 3)], "x") for i in range(0, 60)]  # many copies of three vectors
    rows += [(100, None, "n"), (101, [0.0, 0.0], "z"), (102, [float("nan"), 1.0], "f"), (103, [None, 1.0], "f"), (104, [1.0], "d"), (None, [1.0, 2.0], "i"), (0, [1.0, 0.0], "again")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    vectors = {i: v for i, v, _ in rows[:60]}
    got = {}
    for r in nearest.nearest(d, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute_nearest(vectors, [0, 20, 40], 10)
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == want  # ties go to the smaller ids
    few = spark.createDataFrame([(0, [1.0, 2.0]), (5, [2.0, 2.0]), (7, [9.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in nearest.nearest(few, F.col("id") == 0).collect()) == [(0, 1, 5, 1.0), (0, 2, 7, 8.0)]
    assert nearest.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_op5_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    got = op5_warc(spark, sf)
    want = con.sql(ORACLE_SQL["op5_warc"]).df()[got.columns]
    want = want.astype(object).where(want.notna(), None)
    assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, want.values.tolist()))


def test_archive_round_trip(spark):
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(5, "http://a", big, 1), (3, "http://b", big, 1), (9, None, big, 1), (4, "u\r\nvé", small, 1), (2, "u", small, 1), (7, "u", None, 1), (8, "u", "", 1), (3, "http://b", big, 1), (None, "n", "one\r\n\r\nmore" * 30, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, headers int")
    path = fresh_path(spark, "w")
    warc_store.write_archive(pages, path)
    index = sorted(map(tuple, warc_store.read_index(spark, path).collect()), key=repr)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    again, want = False, []
    for i, _, t, _ in rows:  # of the two rows with id 3 one is the response
        revisit = t == big and (i != 3 or again)
        again |= i == 3
        want.append((i, len((t or "").encode()), digest(t), "revisit" if revisit else "response", 3 if revisit else None))
    assert index == sorted(want, key=repr)
    assert warc_store.payloads(spark, path).count() == 4  # each payload once
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # and readable without the session's table
    stored = {r.record_id: r for r in warc_store.headers(spark, path).collect()}
    assert len(stored) == len(rows)  # record ids are unique
    texts = {}
    for i, _, t, _ in rows:
        texts.setdefault(i, set()).add(t or "")
    for r in warc_store.records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        assert version == "WARC/1.1" and body.endswith(b"\r\n\r\n") and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
        assert head.decode() == stored[r.record_id].headers and int(fields["Content-Length"]) == len(body) - 4
        assert datetime.fromisoformat(fields["WARC-Date"]) and uuid.UUID(fields["WARC-Record-ID"].strip("<>")).version == 4
        if fields["WARC-Type"] == "revisit":
            target = stored[fields["WARC-Refers-To"].strip("<>")]
            assert target.record_type == "response" and target.payload_digest == fields["WARC-Payload-Digest"].removeprefix("sha256:") and body == b"\r\n\r\n"
        else:
            assert body[:-4].decode() in texts[r.page_id] and "sha256:" + hashlib.sha256(body[:-4]).hexdigest() == fields["WARC-Payload-Digest"]
    empty = fresh_path(spark, "w")
    warc_store.write_archive(pages.limit(0), empty)
    assert warc_store.read_index(spark, empty).count() == 0


def test_records_join_payloads_where_they_lie(spark):
    """Payloads are read in buckets: no exchange stands above their scan."""
    path = fresh_path(spark, "w")
    warc_store.write_archive(spark.createDataFrame([(i, "u", f"{i}" * 200) for i in range(20)], "page_id long, url string, html string"), path)
    plan = warc_store.records(spark, path)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_broken_payload_is_found(spark):
    path = fresh_path(spark, "w")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "x" * 300)], "page_id long, url string, html string"), path)
    bad = warc_store.payloads(spark, path).withColumn("payload", F.encode(F.lit("y" * 300), "UTF-8")).collect()
    spark.sql(f"drop table {warc_store._table(path)}")
    spark.createDataFrame(bad, warc_store.PAYLOADS).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="missing or broken"):
        warc_store.read_index(spark, path).collect()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    sizes, held = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert out.exceptAll(held).isEmpty()  # a filter: rows come whole from the stage before
        held = corpus_pipeline.stored(out, "t")
        sizes.append(held.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > sizes[4] == sizes[5] > 0
    assert held.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_pipeline_on_empty_and_null_rows(spark, sf, tmp_path):
    import shutil

    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The cat and the dog. " * 9, "en", None, 1)]
    for name in ("benchmark", "labels"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 1
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
