"""The sandbox reads tables of the session and nothing else."""

import pytest
from pyspark.sql import functions as F

from quarrywork.functions.requests import clean_sql, clean_text, guard_sql, guard_text
from quarrywork.operators import sandbox
from quarrywork.plans.decision_queries import SQL_TEXTS

REFUSED = (
    "SELECT TRANSFORM(r_regionkey) USING 'id' AS (x string) FROM region",
    'SELECT TRANSFORM(r_regionkey) USING "id" AS (x string) FROM region',
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM `text`.`hostname`",
    "SELECT * FROM csv . `file:///etc/passwd`",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT * FROM nowhere",
    "SELECT 1; SELECT 2", "DROP TABLE region", "",
)
ALLOWED = (
    "SELECT r_name FROM region",
    "WITH a AS (SELECT r_regionkey AS k FROM region) SELECT count(*) FROM a JOIN region r ON a.k = r.r_regionkey",
    "SELECT transform(array(1, 2), x -> x + 1) AS y",
    "SELECT a.r_name FROM region a JOIN region b USING (r_regionkey)",
)


@pytest.fixture(scope="module")
def region(spark, sf):
    spark.read.parquet(f"{sf}/region.parquet").createOrReplaceTempView("region")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, region, sql):
    with pytest.raises(sandbox.RefusedQuery):
        sandbox.run(spark, sql)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, region, sql):
    assert sandbox.run(spark, sql).rows.count() > 0


def test_row_limit_is_the_callers(spark, region):
    assert sandbox.run(spark, "SELECT * FROM region").rows.count() == 5
    limited = sandbox.run(spark, "SELECT * FROM region", 2).with_flag().collect()
    assert len(limited) == 2 and all(r["truncated"] for r in limited)


def test_text_and_column_forms_agree(spark):
    texts = [a + "error" + b for a, b in SQL_TEXTS] + list(REFUSED) + list(ALLOWED)
    rows = spark.createDataFrame([(t,) for t in texts], "sql string").select(
        "sql", clean_sql(F.col("sql")).alias("cleaned"), guard_sql(F.col("sql")).alias("verdict")
    )
    for r in rows.collect():
        assert (r["cleaned"], r["verdict"]) == (clean_text(r["sql"]), guard_text(r["sql"]))
