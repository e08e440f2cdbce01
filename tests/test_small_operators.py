"""Small operators that no query runs: vectors of fixed size, one-contig nesting, feature names, promoter texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basalt.functions import sequence as seq
from basalt.operators import nested
from basalt.sources import tables


def test_fixed_size_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<double>")
    tables.write_parquet(tables.fixed_size(df, "v", 2), str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert dict(back.dtypes)["v"] == "array<float>" and {r["id"]: r["v"] for r in back.collect()} == {1: [1.0, 2.0], 2: None}
    with pytest.raises(Exception, match="v must have 3 elements"):
        tables.fixed_size(df, "v", 3).collect()


def test_one_contig(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "genes array<string>")
    wrapped = df.select(nested.as_one_contig(F.col("genes")).alias("contigs"))
    assert [r["contigs"] for r in wrapped.collect()] == [[["a", "b"]], [[]]]
    assert [r["g"] for r in wrapped.select(nested.only_contig(F.col("contigs")).alias("g")).collect()] == [["a", "b"], []]
    assert [r["t"] for r in df.select(nested.join_contigs(F.col("genes")).alias("t")).collect()] == ["a b", ""]


def test_feature_names(spark):
    df = spark.createDataFrame([("c1", 30), ("c1", 5), ("c2", 7)], "contig string, start int")
    got = {(r["contig"], r["start"]): r["feature_id"] for r in nested.feature_ids(df, "contig", "start").collect()}
    assert got[("c1", 5)].rsplit("_", 1)[0] == "c1" and got[("c1", 5)] < got[("c1", 30)] and len(set(got.values())) == 3


def test_promoter_and_protein(spark):
    one = lambda strand, most: spark.range(1).select(seq.promoter_and_protein(F.lit("AACCGGTTAC"), F.lit("MKV"), F.lit(4), F.lit(7), F.lit(strand), 3, most).alias("x")).first()["x"]
    forward, backward = one(1, 100), one(-1, 100)
    assert (forward, backward) == ("acc<+>MKV", "gta<->MKV")
    assert one(1, 4) == forward[:4]
