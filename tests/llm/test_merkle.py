"""The Merkle manifest against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from moodspark.llm import merkle
from moodspark.llm.common import scratch
from moodspark.llm.queries import ORACLES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        first = place - place % 16
        run = level[first : first + 16]
        out.append((run[: place - first], run[place - first + 1 :]))
        place //= 16
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0], leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = tree([r[1] for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for place, (key, own, row) in enumerate(groups[name]):
            path = siblings(trees[name], place) + siblings(top, k)
            text = row[4]
            if key is not None and zlib.crc32(str(key).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((*row[:4], text))
            for left, right in path:
                node = digest("".join([*left, node, *right]))
            proof = digest("".join("".join(left + right) for left, right in path))
            out.append((key, own, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"place": F.lit("own"), "digest": F.lit(1)}).write.parquet(f"{folder}/documents.parquet")
    return merkle.op13_merkle_manifest(spark, folder).collect()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_manifest_is_the_plain_one(spark, tmp_path):
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(3000)]
    rows += [(i, f"s{i % 21}", None, None, ["A", "", None, "é漢 X", "x" * 200_000][i % 5]) for i in range(100)]
    rows += [(i, None, "de", i, "None's") for i in range(17)] + [(i, "-", "-", 0, "-") for i in range(16)]
    rows += [(1, "lone", "en", 1, "L"), (None, "hot", "en", 1, "N"), (None, "hot", "en", 2, "N"), (5, "hot", None, None, None), (5, "hot", "en", 3, "Text 5"), (2**62, "", "en", -1, "Z"), (-7, "", "en", -1, "Z")]
    got = ran(spark, f"{tmp_path}/a", rows)
    assert ordered(got) == ordered(plain(rows))
    assert not all(r.verified for r in got) and sum(r.verified for r in got) > 2000


def test_few_rows(spark, tmp_path):
    assert ran(spark, f"{tmp_path}/none", []) == []
    for n, rows in enumerate(([(3, "a", "en", 1, "x")], [(3, None, None, None, None)] * 2, [(i, f"s{i}", "en", 1, "X") for i in range(18)])):
        assert ordered(ran(spark, f"{tmp_path}/{n}", rows)) == ordered(plain(rows))


def test_proofs_of_wanted_rows(spark):
    rows = [(i, "a" if i % 3 else None, "en", 1, f"t{i}") for i in range(900)] + [(1, "lone", "en", 1, "L")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), merkle.leaf_of({n: F.col(n) for n in merkle.FIELDS}).alias("leaf"))
    folder = scratch(spark, "manifest")
    merkle.write_manifest(leaves, folder)
    wanted = spark.createDataFrame([(None, 0), (None, 897), ("a", 1), ("a", 1), ("a", 898), ("lone", 1), ("a", 3), ("b", 1)], "group string, key long")
    proofs = merkle.extract_proofs(spark, folder, wanted)
    got = {(r.group, r.key): (r.leaf, r.path, r.root) for r in proofs.collect()}
    assert set(got) == {(None, 0), (None, 897), ("a", 1), ("a", 898), ("lone", 1)}
    expected = {p[0:2]: p for p in plain(rows)}
    for node, path, root in got.values():
        assert expected[next(k for k in expected if k[1] == node)][3] == root
        for level in path:
            node = digest(level["left"] + node + level["right"])
        assert node == root
    assert [spark.read.parquet(f"{folder}/groups/level={k}").count() for k in range(4)] == [901, 38 + 19, 3 + 2, 2]
    assert [spark.read.parquet(f"{folder}/top/level={k}").count() for k in range(2)] == [3, 1]


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    result = con.execute(ORACLES["op13_merkle_manifest"])
    names = [c[0] for c in result.description]
    expected = [tuple(row) for row in result.fetchall()]
    got = [tuple(r[n] for n in names) for r in merkle.op13_merkle_manifest(spark, SMALL).collect()]
    assert sorted(got) == sorted(expected)
    docs = con.execute("select doc_id, source, lang, n_chars, text from documents").fetchall()
    assert ordered(tuple(r[n] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in [dict(zip(names, e, strict=True)) for e in expected]) == ordered(plain(docs))
