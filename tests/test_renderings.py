"""Rendered texts against their SQL on tables made for them."""

import duckdb
from oracle import assert_same

from strandline.plans import common, windows  # noqa: F401


def test_torrent_sizes_round_halves_as_the_sql(spark, tmp_path):
    """A size that ends in 5 of the third place exactly (115.625 MB), and parts without a name or size."""
    parts = [(320, "old ring", 32), (7, "bolt", 5), (16, "ring", 4), (3328, "half", 10), (12, None, 9), (13, "rod", None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = common.QUERIES["render_torrents"](spark, str(tmp_path)).toPandas()
    assert "**Size:** 115.62 MB" in "\n".join(got["page"])
    assert_same(got, con.sql(common.ORACLES["render_torrents"]).df())
