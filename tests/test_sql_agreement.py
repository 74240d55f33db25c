"""Queries of the sanitizer against their SQL, on texts that the given tables lack."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

from cloakwork import redact_documents, restore_documents, sanitize
from cloakwork.plans.catalogue import ORACLE_SQL, QUERIES

TEXTS = [
    "555-123-4567 555-123-4568 555-123-4569",
    "call (555) 123 4567",
    "1\x0b555-123-4567 and 1\xa0555-123-4567 and ٣555-123-4567",
    "10.20.30.1 555-123-4567",
    "555-123-4567@mail.com a@10.9.8.7.com",
    "10.9.8.7 10.9.8.8 10.9.8.9. 10.9.8.6.5 ٣10.9.8.5 127.0.0.1\n10.9.8.4",
    "38.211.12.42 4366089147969128 7",
    "4111111111111111 4111111111111111 4111 1111 1111 1111 4111-1111-1111-1111",
    "id 123-45-6789",
    "dn: CN=x,OU=10.9.\n 8.7 end\nMAC aa:bb:cc:dd:ee:ff AA-BB-CC-DD-EE-FF dc1.corp.local DC1.corp.local",
    "a@b.com-a@c.com.a@d.com é10.9.8.7é [IPV4_REDACTED_0001]",
    "a@b.com a@b.com",
    "",
    None,
]


def written(folder, texts, ids):
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([("en", None, "de")[i % 3] for i in range(len(ids))], pa.string()), "source": pa.array([("web", None)[i % 2] for i in range(len(ids))], pa.string())}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    return str(folder)


def differences(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    ours, theirs = Counter(tuple(r) for r in QUERIES[name](spark, folder).collect()), Counter(con.execute(ORACLE_SQL[name]).fetchall())
    return list((ours - theirs).elements()), list((theirs - ours).elements())


@pytest.mark.parametrize(
    "name",
    [
        "audit_counts",
        "check_mode",
        "detect_by_source_lang",
        "detect_counts_by_rule",
        "detect_phone",
        "dry_run_sorted",
        "pii_decisions_combine",
        "topk_docs_by_hits",
        "detect_credit_card_luhn",
        "detect_ipv4",
        "pii_candidates",
        "redaction_stats_by_category",
        "restore_round_trip",
    ],
)
def test_agrees_with_sql(spark, tmp_path, name):
    assert differences(spark, written(tmp_path, TEXTS, range(len(TEXTS))), name) == ([], [])


@pytest.mark.parametrize("name", ["audit_counts", "detect_by_source_lang", "redaction_stats_by_category"])
def test_several_rows_of_an_id(spark, tmp_path, name):
    assert differences(spark, written(tmp_path, TEXTS[:6] * 2, [*range(6), *range(6)]), name) == ([], [])


def test_total_without_matches(spark, tmp_path):
    assert differences(spark, written(tmp_path, ["nothing"], [1]), "detect_by_source_lang") == ([], [])


def test_phone_without_dot_or_hyphen():
    assert sanitize("call (555) 123 4567")[0] == "call [PHONE_REDACTED_0001]"


def test_restores_tokens_inside_words(spark):
    docs = spark.createDataFrame([(1, TEXTS[6]), (2, "a@b.com-a@c.com.a@d.com")], "doc_id long, text string")
    out = restore_documents(redact_documents(docs))
    assert all(r.restored == r.text != r.redacted for r in out.collect())
    made = redact_documents(docs).selectExpr("doc_id", "concat(redacted, '0 x.', redacted) as redacted", "reverse_map")
    assert all("_REDACTED_" in r.restored for r in restore_documents(made).collect())  # words that others made stay
