"""Registered queries against their DuckDB statements on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("events", "embeddings", "labels")
NAMES = (
    "aggregate_windows", "align_clock", "label_packets", "parse_telemetry", "decode_frames", "seq_jumps", "attack_spans",
    "gateway_mac_flips", "calibrated_alerts", "elastic_windows", "roc_curve", "stratified_split", "read_packets", "stream_windows",
    "device_state", "stream_device_state", "stream_windows_late", "parse_control", "calibrated_alerts_by_boot", "align_clock_by_device",
    "tree_to_sql_differences", "neutralized_fills", "lda_multiclass_moments", "cleaning_counts",
)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("NULL" if pd.isna(v) else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r.attack_type for r in entry.entry(spark).collect()} == {"DEAUTH", "SYN_FLOOD", "ARP_SPOOF"}
