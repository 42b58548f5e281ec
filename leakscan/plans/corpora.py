"""Corpora derived from the driver tables: seeded lines, commits, findings, hunks and paths.

Each has a Spark form and the same text for DuckDB; ``{s}`` is the string type. A dollar sign is chr(36)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = """SELECT c_custkey AS file_ord, CAST(1 AS int) AS line_no, CASE c_custkey % 7 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'docs/guide.md' WHEN 2 THEN 'node_modules/x/index.js'
 WHEN 3 THEN 'src/lib.rs' WHEN 4 THEN 'assets/logo.png' WHEN 5 THEN 'README.md' ELSE 'config/settings.yml' END AS path,
 CASE c_custkey % 12 WHEN 0 THEN 'aws_key = "AKIA' || upper(substr(h,1,16)) || '"' WHEN 1 THEN 'token: ghp_' || h || substr(h,1,8) WHEN 2 THEN 'api_key = "' || h || '"'
 WHEN 3 THEN 'password = "changeme"' WHEN 4 THEN 'password = "Kx9!' || upper(substr(h,1,5)) || substr(h,6,7) || '#z"' WHEN 5 THEN 'db = postgres://app:' || substr(h,1,16) || '@db.internal/x'
 WHEN 6 THEN 'let x = ' || h || ' * 2;' WHEN 7 THEN 'secret = "' || h || '" # md5 digest' WHEN 8 THEN 'secret = "' || chr(36) || '{{DB_SECRET}}"'
 WHEN 9 THEN '{{{{ secret = "' || h || '" }}}}' WHEN 10 THEN 'secret = "' || h || '"' ELSE 'aws_key = AKIAXXXX' || upper(substr(h,1,12)) END AS line
 FROM (SELECT c_custkey, md5(CAST(c_custkey AS {s})) AS h FROM customer) t"""
COMMITS = "SELECT md5(CAST(o_orderkey AS {s})) AS hash, 'author' || CAST(o_custkey AS {s}) AS author, CAST({epoch}(o_orderdate) AS bigint) AS timestamp, o_orderkey AS commit_ord, o_orderkey FROM orders"
FINDINGS = """SELECT 'file' || CAST(l_suppkey % 20 AS {s}) AS path, 'rule' || CAST(l_linenumber AS {s}) AS rule_id, 'value' || CAST(l_partkey % 50 AS {s}) AS secret,
 l_linenumber AS line_no, CAST(l_extendedprice * 100 AS bigint) AS match_ord, hash, author, timestamp, commit_ord FROM lineitem JOIN ({commits}) c ON l_orderkey = o_orderkey"""
PATHS = """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'a/vendor/b/' WHEN 4 THEN 'myvendor/vendor/' WHEN 5 THEN ''
 WHEN 6 THEN 'wiki/x/' WHEN 7 THEN '.git/' WHEN 8 THEN 'lib/' WHEN 9 THEN 'Doc/' ELSE 'test/fixtures/' END || CASE o_custkey % 13 WHEN 0 THEN '.env' WHEN 1 THEN '.env.local' WHEN 2 THEN '.env.example' WHEN 3 THEN 'a.min.js'
 WHEN 4 THEN 'Cargo.lock' WHEN 5 THEN 'logo.PNG' WHEN 6 THEN 'main.py' WHEN 7 THEN 'README' WHEN 8 THEN 'guide.rst' WHEN 9 THEN 'CHANGELOG.txt' WHEN 10 THEN '.envrc' WHEN 11 THEN 'go.sum' ELSE 'x.css.map' END AS path FROM orders"""
BLOCKS = """SELECT l_orderkey AS file_ord, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS int) AS line_no,
 CASE l_partkey % 5 WHEN 0 THEN '-----BEGIN PUBLIC KEY-----' WHEN 1 THEN '-----END PUBLIC KEY-----' ELSE 'AKIA' || upper(substr(md5(CAST(l_partkey AS {s})),1,16)) END AS line, 'src/k.txt' AS path FROM lineitem"""
HUNKS = """SELECT l_orderkey AS diff_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) + 1 AS ord,
 CASE l_suppkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE '\\' END || 'l' || CAST(l_partkey AS {s}) AS raw FROM lineitem"""


def duck(sql: str, **more) -> str:
    return sql.format(s="VARCHAR", epoch="epoch", **more)


def of(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **more) -> DataFrame:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    text = sql.format(s="STRING", epoch="unix_timestamp", **more).replace("'\\'", "chr(92)")
    return spark.sql(text)


def seeded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, LINES, "customer")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(spark, sf_dir, FINDINGS, "orders", "lineitem", commits=COMMITS.format(s="STRING", epoch="unix_timestamp"))
