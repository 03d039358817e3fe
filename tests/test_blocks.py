"""Blocked products of a group against all pairs, whatever the size of a block; exports that are too large."""

import numpy as np
import pandas as pd

from clipsift.operators import vectors
from clipsift.sources import analytics


def test_blocks_cover_every_pair_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "hot" if k % 3 else f"g{k % 7}", rng.normal(size=5).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")

    def judge(products, own, near):
        return pd.DataFrame({"k": own["id"], "total": products.sum(axis=1), "n": len(near)})

    found = vectors.block_products(df, df, "id", "v", "grp", judge, "k long, total double, n long", block=7).groupBy("k").sum("total", "n").collect()
    got = {r["k"]: (r["sum(total)"], r["sum(n)"]) for r in found}
    for k, g, v in rows:
        near = [np.dot(v, w) for _, h, w in rows if h == g]
        assert got[k][1] == len(near) and np.isclose(got[k][0], sum(near))


def test_large_exports_give_a_reason(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(analytics, "FILE_BYTES", 50)
    (tmp_path / "small.csv").write_text("Views,Saved\n1,2\n")
    (tmp_path / "large.csv").write_text("Views\n" + "1\n" * 100)
    rows = analytics.read_exports(spark, str(tmp_path)).collect()
    assert sorted((r.header, r.value) for r in rows if r.file.endswith("small.csv")) == [("Saved", "2"), ("Views", "1")]
    assert [(r.header, "more than 50" in r.value) for r in rows if r.file.endswith("large.csv")] == [(None, True)]
