"""Numbers that lie at halves, in floats and in texts, against DuckDB."""

import duckdb
from pyspark.sql import functions as F

from oracles import same_rows
from pagewright.functions import summaries
from pagewright.functions import text as T
from pagewright.plans import ORACLES, QUERIES


def test_pixels_at_halves_of_floats(spark, tmp_path):
    # 0.0005 and its odd multiples: their products are halves in floats, and near them in doubles
    duckdb.sql(f"copy (select i as vec_id, list_transform(range(16), lambda k: ((2 * (i * 16 + k) + 1) * 0.0005)::float * (case when k % 2 = 0 then 1 else -1 end))::float[] as embedding from range(200) t(i)) to '{tmp_path}/embeddings.parquet'")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    same_rows(QUERIES["bilinear_half"], ORACLES["bilinear_half"], spark, con, str(tmp_path))


def test_sizes_are_rounded_by_their_exact_value(spark):
    sizes = [0, 5_000, 15_000, 37_035_000, 12_345_000, 1_125_000, 250_000, 350_000, 999_995_000, 9_007_199_254_740_993, -37_035_000, None]
    rows = spark.createDataFrame([(x,) for x in sizes], "n long").select("n", T.megabytes(F.col("n")).alias("two"), summaries.merge_text(False, F.lit(1), F.lit(2), F.col("n"), F.col("n")).alias("one")).collect()
    con = duckdb.connect()
    for n, two, one in rows:
        want = con.execute("select printf('%.2f MB', $1::bigint / 1e6), printf('%.1f MB', coalesce($1::bigint, 0) / 1e6)", [n]).fetchone()
        assert two == want[0]
        assert one == f"Pages merged: 1\nPages skipped: 2\nOriginal: {want[1]}\nOutput: {want[1]}\n"


def test_reports_of_many_parts(spark, tmp_path):
    duckdb.sql(f"copy (select 1000::bigint * i as p_partkey, 'a.PDF' as p_name, (i % 50)::int as p_size from range(1, 400) t(i)) to '{tmp_path}/part.parquet'")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    same_rows(QUERIES["scalar_reports"], ORACLES["scalar_reports"], spark, con, str(tmp_path))
