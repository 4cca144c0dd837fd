"""Registered queries against their plain SQL.

A choice of them runs by default; READFRAME_ALL_QUERIES=1 takes all.  Tables come from READFRAME_TABLES.
"""

import math
import os

import pytest

from readframe.queries.catalog import ORACLES, QUERIES
from readframe.queries.inputs import TABLES

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("READFRAME_TABLES", "/root/testdata/sf0.001")
CHOICE = [
    "clean_reads", "translate_frames", "read_windows", "md_errors", "read_cds_overlap", "merged_regions", "frame_labels_with_indels",
    "label_segments", "decoded_labels", "gc_bin_rollup", "codon_confusion", "iou_match_counts", "indel_matches", "family_split", "newick_tree",
]
NAMES = sorted(ORACLES) if os.environ.get("READFRAME_ALL_QUERIES") else CHOICE
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    relation = database.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    sql_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == sql_types
    order = [relation.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    theirs = sorted((tuple(plain(row[i]) for i in order) for row in relation.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_is_registered_once():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
