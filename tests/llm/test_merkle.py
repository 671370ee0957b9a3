"""The Merkle manifest against a plain tree, with small superblocks, and against its SQL."""

import sys
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tallyloom.llm import merkle, queries

DOCS = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING, leaf STRING"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, k, leaf):
    proof = []
    for level in levels[:-1]:
        run = level[k & ~1 : (k & ~1) + 2]
        proof += [x for i, x in enumerate(run) if i != k & 1]
        leaf = h(*(leaf if i == k & 1 else x for i, x in enumerate(run)))
        k >>= 1
    return proof, leaf


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for k, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            found = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                found = leaf_of(*r[:3], r[3] + 1, r[4])
            low, node = climb(trees[g], k, found)
            high, node = climb(top, j, node)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*low, *high), node, node == top[-1][0]))
    return sorted(out, key=repr)


def hostile(n):
    rows = [(k, "a" if k % 3 else None, ("de", "fr", None, "日本", "")[k % 5] if k % 2 else "en", k if k % 11 else None, "é" * (k % 7) if k % 13 else None) for k in range(n)]
    return [*rows, *rows[:9], *[(5, "s", "en", 1, "same")] * 9, (None, None, None, None, None), (None, "x", "en", 4, "t"), (-3, "x", "zz", 4, ""), (2**60 + 1, "x", "en", 4, "t")]


@pytest.mark.parametrize(("n", "block"), [(0, 4), (37, 4), (150, 4), (120, 1024)])
def test_against_a_plain_tree(spark, monkeypatch, n, block):
    rows = hostile(n)
    df = spark.createDataFrame([(*r, "other") for r in rows], DOCS)
    monkeypatch.setattr(merkle.merkle_manifest, "__defaults__", (block,))
    got = sorted(map(tuple, merkle.op13_merkle_manifest(df).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert any(not r[-1] for r in got) or n == 0


def test_one_row_and_none(spark):
    one = [(7, "s", "en", 3, "abc")]
    got = merkle.op13_merkle_manifest(spark.createDataFrame([(*one[0], "")], DOCS)).collect()
    assert [tuple(r) for r in got] == plain(one)
    assert merkle.op13_merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op13_merkle_manifest"])
    df = queries.QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert df.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
