"""Registered queries against plain SQL, and the pipeline's stages against brute force, over the test tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from readframe.llm import best_fit, cube_mix, line_rules, queries, secret_links
from readframe.llm.shared import table, tokenizer_files

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("READFRAME_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    relation = connection.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types), strict=True))
    order = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in order) for row in relation.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr) == theirs


@pytest.mark.parametrize("name", ["op1_best_fit", "op4_secret_links", "op6_html_layout", "op8_multi_index", "op9_cube_mix"])
def test_query_covers_its_table(spark, name):
    rows = queries.queries()[name](spark, FOLDER).collect()
    if name == "op8_multi_index":
        ids = [r.vec_id for r in table(spark, FOLDER, "embeddings").collect()]
        assert Counter(r.query_id for r in rows) == {q: min(20, len(ids) - 1) for q in ids if q % 20 == 0}
    else:
        key = "page_id" if name == "op6_html_layout" else "doc_id"
        given = table(spark, FOLDER, "pages" if key == "page_id" else "documents").select(key).collect()
        assert {r[key] for r in rows} == {r[key] for r in given} and len(rows) >= len(given)


def shingles(text):
    words = text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, FOLDER).cache()
    verdict = {r.doc_id: r.kept for r in line_rules.line_quality(docs).collect()}
    assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in verdict.items() if v)

    single = stages[1](spark, kept, FOLDER).cache()
    sets = {r.doc_id: shingles(r.text) for r in kept.collect()}
    parent = {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == [k for k in ids if root(k) == k]

    clean = stages[2](spark, single, FOLDER).cache()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert clean.columns == names and {r.doc_id: r.text for r in clean.collect()} == {k: secret_links.redacted(t, 200) for k, t in texts.items()}

    mixed = stages[3](spark, clean, FOLDER).cache()
    taken = {r.doc_id: r.taken for r in cube_mix.mix(clean).collect() if r.taken}
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.doc_id] += len(r.text.encode().split())
    assert mixed.columns == names and dict(sizes) == taken

    packed = stages[4](spark, mixed, FOLDER).collect()
    files = tokenizer_files()
    tokens = sum(len(best_fit.encoded(r.text, *files)) // 4 + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= -(-tokens // 2048) + 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(tuple(r) for r in packed)
