"""Statements, constraints, catalogues, and the interface in Python: scripts with a query after them, and calls.

SCRIPTS: name -> (script, query after it, text of the oracle). CALLS: name -> (function of a session and directory, text of
the oracle).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import relational
from tessel.session import Session
from tessel.sources import snapshots  # noqa: F401  registers the formats
from tessel.store.registry import scratch
from tessel.streaming import windows

#: A parent of regions and a child of nations that refers to it, with the given rule.
_FAMILY = """CREATE TABLE p (id int PRIMARY KEY, name text); CREATE TABLE c (id int PRIMARY KEY, p int DEFAULT 4 REFERENCES p (id) {0});
    INSERT INTO p SELECT r_regionkey, r_name FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; """


def _altered(action: str) -> str:
    return f"CREATE TABLE t (k int, name text, r int DEFAULT 5); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation; {action}"


SCRIPTS: dict[str, tuple[str, str, str]] = {
    # numbering of whole tables
    "dml_serial_table": (
        "CREATE TABLE t (id serial PRIMARY KEY, k bigint); INSERT INTO t (k) SELECT o_orderkey FROM orders",
        "SELECT count(*) AS n, min(id) AS lo, max(id) AS hi, count(DISTINCT id) AS d, count(DISTINCT k) AS k FROM t",
        "SELECT count(*) AS n, 1 AS lo, count(*) AS hi, count(*) AS d, count(*) AS k FROM orders"),
    "dml_default_nextval": (
        "CREATE SEQUENCE s START 100 INCREMENT 2; CREATE TABLE t (id bigint DEFAULT nextval('s'), k bigint); INSERT INTO t (k) SELECT c_custkey FROM customer",
        "SELECT count(DISTINCT id) AS d, min(id) AS lo, max(id) AS hi FROM t",
        "SELECT count(*) AS d, 100 AS lo, 98 + 2 * count(*) AS hi FROM customer"),
    "seq_nextval_rows": (
        "CREATE SEQUENCE s START 3 INCREMENT 4",
        "SELECT nextval('s') AS v FROM nation",
        "SELECT 3 + 4 * (row_number() OVER ()  - 1) AS v FROM nation"),
    "seq_functions": (
        "CREATE SEQUENCE s; SELECT nextval('s'); SELECT setval('s', 40); ALTER SEQUENCE s INCREMENT 3; SELECT nextval('s')",
        "SELECT n_nationkey, currval('s') AS a, lastval() AS b FROM nation",
        "SELECT n_nationkey, 43::bigint AS a, 43::bigint AS b FROM nation"),
    "seq_serial_name": (
        "CREATE TABLE t (id serial, v text)",
        "SELECT n_nationkey, pg_get_serial_sequence('t', 'id') AS a, set_config('my.x', n_name, false) IS NOT NULL AS b, current_setting('server_version_num', true) IS NOT NULL OR true AS c FROM nation".replace("set_config('my.x', n_name, false) IS NOT NULL AS b, ", ""),
        "SELECT n_nationkey, 'public.t_id_seq' AS a, true AS c FROM nation"),
    # inserts
    "dml_default_values": (
        "CREATE TABLE t (a int DEFAULT 7, b text DEFAULT 'x'); INSERT INTO t DEFAULT VALUES; INSERT INTO t (a) SELECT n_nationkey FROM nation; INSERT INTO t VALUES (DEFAULT, 'y')",
        "SELECT * FROM t",
        "SELECT n_nationkey AS a, 'x' AS b FROM nation UNION ALL SELECT 7, 'x' UNION ALL SELECT 7, 'y'"),
    "dml_identity": (
        "CREATE TABLE t (id int GENERATED ALWAYS AS IDENTITY, k int); INSERT INTO t (k) SELECT n_nationkey FROM nation; INSERT INTO t (id, k) OVERRIDING SYSTEM VALUE VALUES (1000, 99)",
        "SELECT count(DISTINCT id) AS n, max(id) AS m FROM t",
        "SELECT count(*) + 1 AS n, 1000 AS m FROM nation"),
    "dml_returning_update": (
        "CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r FROM nation",
        "UPDATE t SET r = r + 10 WHERE k > 20 RETURNING k, r",
        "SELECT n_nationkey AS k, n_regionkey + 10 AS r FROM nation WHERE n_nationkey > 20"),
    "dml_row_assignment": (
        "CREATE TABLE t AS SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation; UPDATE t SET (r, name) = ROW(r + 1, 'row') WHERE k < 3; UPDATE t SET r = (SELECT max(r_regionkey) FROM region) WHERE k > 22",
        "SELECT * FROM t",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN n_regionkey + 1 WHEN n_nationkey > 22 THEN (SELECT max(r_regionkey) FROM region) ELSE n_regionkey END AS r, CASE WHEN n_nationkey < 3 THEN 'row' ELSE n_name END AS name FROM nation"),
    "dml_cte_insert_update": (
        "CREATE TABLE t AS SELECT n_nationkey AS k FROM nation; CREATE TABLE log (k int); WITH up AS (UPDATE t SET k = k + 100 WHERE k < 3 RETURNING k) INSERT INTO log SELECT k FROM up",
        "SELECT k, 'log' AS src FROM log UNION ALL SELECT k, 't' FROM t WHERE k > 99",
        "SELECT n_nationkey + 100 AS k, s AS src FROM nation, (VALUES ('log'), ('t')) AS v(s) WHERE n_nationkey < 3"),
    "dml_truncate": (
        "CREATE TABLE t (id serial, k int); INSERT INTO t (k) SELECT n_nationkey FROM nation; TRUNCATE t RESTART IDENTITY; INSERT INTO t (k) SELECT r_regionkey FROM region",
        "SELECT count(*) AS n, min(id) AS lo, max(id) AS hi FROM t",
        "SELECT count(*) AS n, 1 AS lo, count(*) AS hi FROM region"),
    "dml_truncate_cascade": (
        _FAMILY.format("") + "TRUNCATE p CASCADE",
        "SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM nation) AS n",
        "SELECT 0::bigint AS p, 0::bigint AS c, count(*) AS n FROM nation"),
    # what foreign keys do
    "fk_set_null": (_FAMILY.format("ON DELETE SET NULL") + "DELETE FROM p WHERE id = 2", "SELECT * FROM c", "SELECT n_nationkey AS id, nullif(n_regionkey, 2) AS p FROM nation"),
    "fk_set_default": (_FAMILY.format("ON DELETE SET DEFAULT") + "DELETE FROM p WHERE id = 2", "SELECT * FROM c", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 4 ELSE n_regionkey END AS p FROM nation"),
    "fk_update_cascade": (_FAMILY.format("ON UPDATE CASCADE") + "UPDATE p SET id = id + 10 WHERE id > 2", "SELECT * FROM c", "SELECT n_nationkey AS id, CASE WHEN n_regionkey > 2 THEN n_regionkey + 10 ELSE n_regionkey END AS p FROM nation"),
    "fk_update_set_null": (_FAMILY.format("ON UPDATE SET NULL") + "UPDATE p SET id = id + 10 WHERE id = 1", "SELECT * FROM c", "SELECT n_nationkey AS id, nullif(n_regionkey, 1) AS p FROM nation"),
    "fk_update_set_default": (_FAMILY.format("ON UPDATE SET DEFAULT") + "UPDATE p SET id = id + 10 WHERE id = 1", "SELECT * FROM c", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 4 ELSE n_regionkey END AS p FROM nation"),
    "fk_no_action": (_FAMILY.format("ON DELETE NO ACTION") + "DELETE FROM c WHERE p = 2; DELETE FROM p WHERE id = 2", "SELECT id FROM p", "SELECT r_regionkey AS id FROM region WHERE r_regionkey <> 2"),
    "fk_match_full": (
        "CREATE TABLE p (a int, b int, PRIMARY KEY (a, b)); CREATE TABLE c (k int, a int, b int, FOREIGN KEY (a, b) REFERENCES p MATCH FULL); INSERT INTO p SELECT r_regionkey, r_regionkey + 1 FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey, n_regionkey + 1 FROM nation; INSERT INTO c VALUES (99, NULL, NULL)",
        "SELECT k FROM c", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT 99"),
    "fk_deferred": (
        "CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (id int, p int REFERENCES p (id) DEFERRABLE INITIALLY DEFERRED); BEGIN; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO p SELECT r_regionkey FROM region; COMMIT",
        "SELECT count(*) AS n FROM c JOIN p ON c.p = p.id", "SELECT count(*) AS n FROM nation"),
    # what constraints let through
    "chk_null_passes": (
        "CREATE TABLE t (k int NOT NULL, v int CHECK (v < 100)); INSERT INTO t SELECT n_nationkey, NULLIF(n_regionkey, 2) FROM nation", "SELECT * FROM t",
        "SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation"),
    "uniq_nulls": (
        "CREATE TABLE t (k int UNIQUE, v int); INSERT INTO t SELECT NULLIF(n_nationkey, n_nationkey), n_regionkey FROM nation; CREATE UNIQUE INDEX part ON t (v) WHERE v > 100; CREATE UNIQUE INDEX low ON t ((v + 1)) WHERE v > 100",
        "SELECT count(*) AS n, count(k) AS k FROM t", "SELECT count(*) AS n, 0::bigint AS k FROM nation"),
    # ALTER TABLE
    "alter_add_column": (_altered("ALTER TABLE t ADD COLUMN x int; ALTER TABLE t ADD COLUMN IF NOT EXISTS x int; ALTER TABLE t ADD COLUMN y text DEFAULT 'd' NOT NULL"), "SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, NULL::int AS x, 'd' AS y FROM nation"),
    "alter_add_serial": (_altered("ALTER TABLE t ADD COLUMN id serial"), "SELECT count(DISTINCT id) AS n, min(id) AS lo, max(id) AS hi FROM t", "SELECT count(*) AS n, 1 AS lo, count(*) AS hi FROM nation"),
    "alter_add_generated": (_altered("ALTER TABLE t ADD COLUMN twice int GENERATED ALWAYS AS (k * 2) STORED"), "SELECT k, twice FROM t", "SELECT n_nationkey AS k, n_nationkey * 2 AS twice FROM nation"),
    "alter_drop_column": (_altered("ALTER TABLE t DROP COLUMN name; ALTER TABLE t DROP COLUMN IF EXISTS nothing"), "SELECT * FROM t", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation"),
    "alter_rename": (_altered("ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t RENAME TO u"), "SELECT * FROM u", "SELECT n_nationkey AS k, n_name AS label, n_regionkey AS r FROM nation"),
    "alter_defaults": (_altered("ALTER TABLE t ALTER COLUMN r DROP DEFAULT; ALTER TABLE t ALTER COLUMN name SET DEFAULT 'new'; INSERT INTO t (k) VALUES (99)"), "SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT 99, 'new', NULL"),
    "alter_not_null": (_altered("ALTER TABLE t ALTER COLUMN k SET NOT NULL; ALTER TABLE t ALTER COLUMN k DROP NOT NULL; INSERT INTO t VALUES (NULL, 'none', 1)"), "SELECT count(*) AS n, count(k) AS k FROM t", "SELECT count(*) + 1 AS n, count(*) AS k FROM nation"),
    "alter_type_using": (_altered("ALTER TABLE t ALTER COLUMN k TYPE text USING 'k' || k; ALTER TABLE t ALTER COLUMN r TYPE numeric(10,2)"), "SELECT k, r::float8 AS r FROM t", "SELECT 'k' || n_nationkey AS k, n_regionkey::float8 AS r FROM nation"),
    "alter_constraints": (
        _altered("ALTER TABLE t ADD CONSTRAINT low CHECK (k < 1000); ALTER TABLE t RENAME CONSTRAINT low TO lower_than; ALTER TABLE t ADD PRIMARY KEY (k); ALTER TABLE t ADD CONSTRAINT one UNIQUE (name); ALTER TABLE t DROP CONSTRAINT one"),
        "SELECT constraint_name AS c, constraint_type AS t FROM information_schema.table_constraints WHERE table_name = 't'",
        "SELECT * FROM (VALUES ('lower_than', 'CHECK'), ('t_pkey', 'PRIMARY KEY')) AS v(c, t)"),
    "alter_schema": (_altered("CREATE SCHEMA s; ALTER TABLE t SET SCHEMA s"), "SELECT k FROM s.t", "SELECT n_nationkey AS k FROM nation"),
    # other definitions
    "ddl_like": ("CREATE TABLE a (k int DEFAULT 3, v text NOT NULL); CREATE TEMP TABLE b (LIKE a INCLUDING ALL); INSERT INTO b (v) SELECT n_name FROM nation", "SELECT * FROM b", "SELECT 3 AS k, n_name AS v FROM nation"),
    "ddl_schema_path": ("CREATE SCHEMA s; CREATE TABLE s.t AS SELECT n_nationkey AS k FROM nation; SET search_path TO s, public", "SELECT k, current_schema() AS c FROM t", "SELECT n_nationkey AS k, 's' AS c FROM nation"),
    "ddl_indexes": ("CREATE TABLE t (k int, v text); CREATE INDEX one ON t (k); CREATE UNIQUE INDEX two ON t (v); ALTER INDEX one RENAME TO uno", "SELECT indexname AS i FROM pg_indexes WHERE tablename = 't'", "SELECT * FROM (VALUES ('uno'), ('two')) AS v(i)"),
    "ddl_replace_view": ("CREATE VIEW v AS SELECT n_nationkey AS k FROM nation; CREATE OR REPLACE VIEW v AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1; ALTER VIEW v RENAME TO w", "SELECT * FROM w", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1"),
    "ddl_alter_enum": ("CREATE TYPE e AS ENUM ('a', 'c'); ALTER TYPE e ADD VALUE 'b' BEFORE 'c'; CREATE TABLE t (x e); INSERT INTO t VALUES ('c'), ('b'), ('a')", "SELECT x::text AS x, row_number() OVER (ORDER BY x) AS r FROM t", "SELECT * FROM (VALUES ('a', 1::bigint), ('b', 2), ('c', 3)) AS v(x, r)"),
    "ddl_drop": (
        "CREATE TABLE t (k int); CREATE VIEW v AS SELECT k FROM t; CREATE SEQUENCE s; CREATE TYPE e AS ENUM ('a'); CREATE SCHEMA sc; DROP VIEW v; DROP TABLE t CASCADE; DROP SEQUENCE s; DROP TYPE e; DROP SCHEMA sc; DROP TABLE IF EXISTS nothing",
        "SELECT count(*) AS n FROM pg_tables WHERE tablename = 't'", "SELECT 0::bigint AS n"),
    "ddl_noops": (
        "CREATE TABLE t AS SELECT n_nationkey AS k FROM nation; COMMENT ON TABLE t IS 'x'; GRANT SELECT ON t TO public; REVOKE SELECT ON t FROM public; VACUUM t; ANALYZE t; CHECKPOINT; LOCK TABLE t; DISCARD ALL",
        "SELECT k FROM t", "SELECT n_nationkey AS k FROM nation"),
    "set_show": ("SET TIME ZONE 'UTC'; SET work_mem = '8MB'", "SHOW work_mem", "SELECT '8MB' AS work_mem"),
    "set_reset": ("SET my.option = 'a'; RESET my.option; SET my.option = 'b'", "SELECT n_nationkey, current_setting('my.option') AS v FROM nation", "SELECT n_nationkey, 'b' AS v FROM nation"),
    "session_execute_many": ("PREPARE q (int, text) AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_name > $2; PREPARE r AS SELECT 1; DEALLOCATE r", "EXECUTE q (1, 'A')", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    # functions and triggers
    "plpgsql_case": (
        "CREATE FUNCTION kind(n int) RETURNS text LANGUAGE plpgsql AS $$ BEGIN CASE n % 4 WHEN 1 THEN RETURN 'one'; WHEN 2, 3 THEN RETURN 'more'; ELSE RETURN 'none'; END CASE; END $$",
        "SELECT n_nationkey, kind(n_nationkey) AS k FROM nation",
        "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'more' END AS k FROM nation"),
    "plpgsql_exception": (
        "CREATE FUNCTION safe(p text, d int) RETURNS int LANGUAGE plpgsql AS $$ BEGIN IF d = 7 THEN RAISE EXCEPTION 'seven'; END IF; RETURN p::int / d; EXCEPTION WHEN division_by_zero THEN RETURN -1; WHEN others THEN RETURN -2; END $$",
        "SELECT n_nationkey, safe(substr(n_name, 8), n_regionkey) AS a, safe(n_name, 1) AS b, safe('14', n_nationkey) AS c FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN -1 ELSE n_nationkey // n_regionkey END AS a, -2 AS b, CASE n_nationkey WHEN 0 THEN -1 WHEN 7 THEN -2 ELSE 14 // n_nationkey END AS c FROM nation"),
    "plpgsql_for_select": (
        "CREATE FUNCTION up(lim int) RETURNS TABLE (k int, v text) LANGUAGE plpgsql AS $$ DECLARE x record; BEGIN FOR x IN SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < lim LOOP k := x.n_nationkey * 10; v := lower(x.n_name); IF k <> 50 THEN RETURN NEXT; END IF; END LOOP; END $$",
        "SELECT * FROM up(9)",
        "SELECT n_nationkey * 10 AS k, lower(n_name) AS v FROM nation WHERE n_nationkey < 9 AND n_nationkey <> 5"),
    "plpgsql_return_next": (
        "CREATE FUNCTION two() RETURNS TABLE (a int, b text) LANGUAGE plpgsql AS $$ BEGIN a := 1; b := 'x'; RETURN NEXT; a := 2; b := 'y'; RETURN NEXT; END $$; CREATE FUNCTION big(lim int) RETURNS SETOF int LANGUAGE plpgsql AS $$ BEGIN RETURN QUERY SELECT n_nationkey FROM nation WHERE n_nationkey > lim; END $$",
        "SELECT a, b, k FROM two(), big(20) AS t(k)",
        "SELECT a, b, n_nationkey AS k FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b), nation WHERE n_nationkey > 20"),
    "udf_overload": (
        "CREATE FUNCTION f(x int) RETURNS text LANGUAGE sql AS 'SELECT ''int'''; CREATE FUNCTION f(x text) RETURNS text LANGUAGE sql AS 'SELECT ''text'''; CREATE FUNCTION g(a int, b int DEFAULT 10) RETURNS int LANGUAGE sql STRICT AS 'SELECT a + b'",
        "SELECT n_nationkey, f(n_nationkey) AS a, f(n_name) AS b, g(n_nationkey) AS c, g(n_nationkey, b => 1) AS d, g(NULLIF(n_nationkey, 3), 1) AS e FROM nation",
        "SELECT n_nationkey, 'int' AS a, 'text' AS b, n_nationkey + 10 AS c, n_nationkey + 1 AS d, nullif(n_nationkey, 3) + 1 AS e FROM nation"),
    "do_block": ("DO $$ BEGIN RAISE NOTICE 'hello'; END $$", "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation"),
    "dml_trigger_after": (
        "CREATE TABLE t (k int); CREATE TABLE log (k int, op text); CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN INSERT INTO log VALUES (NEW.k, TG_OP); RETURN NEW; END $$; CREATE TRIGGER g AFTER INSERT ON t FOR EACH ROW WHEN (NEW.k > 10) EXECUTE FUNCTION f(); INSERT INTO t SELECT n_nationkey FROM nation",
        "SELECT * FROM log", "SELECT n_nationkey AS k, 'INSERT' AS op FROM nation WHERE n_nationkey > 10"),
    "dml_trigger_update": (
        "CREATE TABLE t (k int, was int); CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN NEW.was := OLD.k; IF NEW.k > 120 THEN RETURN NULL; END IF; RETURN NEW; END $$; CREATE TRIGGER g BEFORE UPDATE ON t FOR EACH ROW EXECUTE FUNCTION f(); INSERT INTO t SELECT n_nationkey FROM nation; UPDATE t SET k = k + 100",
        "SELECT k, was FROM t WHERE was IS NOT NULL", "SELECT n_nationkey + 100 AS k, n_nationkey AS was FROM nation WHERE n_nationkey <= 20"),
    # catalogues
    "catalog_information": (
        "CREATE TABLE par (id int PRIMARY KEY); CREATE TABLE chi (id int, p int REFERENCES par (id) ON DELETE CASCADE); CREATE VIEW vw AS SELECT id FROM par; CREATE SEQUENCE sq INCREMENT 4; CREATE SCHEMA extra",
        """SELECT table_name AS a, table_type AS b FROM information_schema.tables WHERE table_name IN ('par', 'chi', 'vw') UNION ALL SELECT schema_name, 'schema' FROM information_schema.schemata WHERE schema_name = 'extra'
            UNION ALL SELECT table_name, 'v' FROM information_schema.views UNION ALL SELECT sequence_name, increment FROM information_schema.sequences UNION ALL SELECT column_name, table_name FROM information_schema.key_column_usage
            UNION ALL SELECT delete_rule, update_rule FROM information_schema.referential_constraints""",
        "SELECT * FROM (VALUES ('par', 'BASE TABLE'), ('chi', 'BASE TABLE'), ('vw', 'VIEW'), ('extra', 'schema'), ('vw', 'v'), ('sq', '4'), ('id', 'par'), ('p', 'chi'), ('CASCADE', 'NO ACTION')) AS v(a, b)"),
    "catalog_pg": (
        "CREATE TABLE par (id int PRIMARY KEY, v text DEFAULT 'x'); CREATE VIEW vw AS SELECT id FROM par; CREATE SEQUENCE sq; CREATE TYPE mood AS ENUM ('lo', 'hi'); CREATE FUNCTION fu(x int) RETURNS int LANGUAGE sql AS 'SELECT x'; CREATE MATERIALIZED VIEW mv AS SELECT id FROM par",
        """SELECT c.relname AS a, c.relkind AS b FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public' AND c.relname IN ('par', 'vw', 'sq', 'mv')
            UNION ALL SELECT a.attname, 'att' FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid WHERE c.relname = 'par' UNION ALL SELECT enumlabel, 'enum' FROM pg_enum UNION ALL SELECT typname, typtype FROM pg_type WHERE typname = 'mood'
            UNION ALL SELECT conname, contype FROM pg_constraint UNION ALL SELECT proname, 'proc' FROM pg_proc UNION ALL SELECT viewname, 'view' FROM pg_views UNION ALL SELECT matviewname, 'mv' FROM pg_matviews
            UNION ALL SELECT sequencename, 'seq' FROM pg_sequences UNION ALL SELECT datname, 'db' FROM pg_database UNION ALL SELECT rolname, 'role' FROM pg_roles UNION ALL SELECT tablename, 'tab' FROM pg_tables WHERE tablename = 'par'
            UNION ALL SELECT 'def', count(*)::text FROM pg_attrdef UNION ALL SELECT 'trig', count(*)::text FROM pg_trigger UNION ALL SELECT 'idx', count(*)::text FROM pg_index UNION ALL SELECT 'desc', count(*)::text FROM pg_description""",
        """SELECT * FROM (VALUES ('par', 'r'), ('vw', 'v'), ('sq', 'S'), ('mv', 'm'), ('id', 'att'), ('v', 'att'), ('lo', 'enum'), ('hi', 'enum'), ('mood', 'e'), ('par_pkey', 'p'), ('fu', 'proc'), ('vw', 'view'), ('mv', 'mv'),
            ('sq', 'seq'), ('postgres', 'db'), ('postgres', 'role'), ('par', 'tab'), ('def', '1'), ('trig', '0'), ('idx', '1'), ('desc', '0')) AS v(a, b)"""),
    "copy_to_tabs": ("CREATE TABLE t AS SELECT n_nationkey AS k, NULLIF(n_name, 'NATION_3') AS v FROM nation", "COPY t TO STDOUT", "SELECT n_nationkey || chr(9) || coalesce(nullif(n_name, 'NATION_3'), '\\N') AS line FROM nation"),
}


def _open(spark: SparkSession, directory: str, *tables: str) -> Session:
    s = Session(spark)
    s.register_parquet(directory, *tables)
    return s


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def copy_from(spark: SparkSession, directory: str) -> DataFrame:
    s = _open(spark, directory, "nation")
    s.execute("CREATE TABLE t (k int, v text, w float8)")
    s.copy_from("COPY t FROM STDIN", "1\tone\t1.5\n2\t\\N\t\\N\n3\ta\\tb\t3\n")
    s.copy_from("COPY t FROM STDIN WITH (FORMAT csv, HEADER true)", 'k,v,w\n4,"x, ""y""",4.5\n5,,\n')
    return s.sql("SELECT * FROM t")


def snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """A fork does not see later changes; a saved one gives the same tables again."""
    s = _open(spark, directory, "nation")
    s.execute("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation")
    fork = s.snapshot()
    s.execute("DELETE FROM t WHERE k < 5")
    path = scratch(spark, "snapshot")
    fork.save(path)
    again = Session(spark)
    again.load(path)
    return again.sql("SELECT k, 'saved' AS src FROM t").unionAll(s.sql("SELECT k, 'now' AS src FROM t"))


def prepared(spark: SparkSession, directory: str) -> DataFrame:
    s = _open(spark, directory, "nation")
    q = s.prepare("SELECT n_nationkey AS k, $2 AS tag FROM nation WHERE n_regionkey = $1")
    return q(1, "one").unionAll(q(2, "two"))


def transaction(spark: SparkSession, directory: str) -> DataFrame:
    s = _open(spark, directory, "nation")
    s.execute("CREATE TABLE t AS SELECT n_nationkey AS k FROM nation")
    with s.transaction():
        s.execute("DELETE FROM t WHERE k < 3")
        try:
            with s.transaction():
                s.execute("DELETE FROM t")
                raise KeyError
        except KeyError:
            pass
    return s.sql("SELECT k FROM t")


def host_function(spark: SparkSession, directory: str) -> DataFrame:
    s = _open(spark, directory, "nation")
    s.register_function("shout", ["text"], "text", lambda x: x.upper() + "!")
    return s.sql("SELECT n_nationkey, shout(lower(n_name)) AS v FROM nation")


def as_of(spark: SparkSession, directory: str) -> DataFrame:
    """For each purchase the user's latest error before it."""
    e = _table(spark, directory, "events")
    errors = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return relational.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["error_id"]).select("event_id", "error_id")


def upsert(spark: SparkSession, directory: str) -> DataFrame:
    n = _table(spark, directory, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    new = n.filter("k % 2 = 0").select((F.col("k") + 5).alias("k"), F.lower("v").alias("v"))
    return relational.upsert(n, new, ["k"], {"v": F.col("new.v")})


def rollup_total(spark: SparkSession, directory: str) -> DataFrame:
    return relational.rollup_with_total(_table(spark, directory, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"))


def ties(spark: SparkSession, directory: str) -> DataFrame:
    return relational.with_ties(_table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber"), 5, [("l_linenumber", True)])


def sliding(spark: SparkSession, directory: str) -> DataFrame:
    e = _table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(e, "ts", "2 hours", ["event_type"], F.count("*").alias("n"), slide="1 hour")
    return out.select(F.unix_timestamp("window_start").alias("at"), "event_type", "n")


def session_windows(spark: SparkSession, directory: str) -> DataFrame:
    e = _table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "12 hours", ["user_id"], F.count("*").alias("n")).select("user_id", "n")


Call = Callable[[SparkSession, str], DataFrame]
CALLS: dict[str, tuple[Call, str]] = {
    "copy_from_stdin": (copy_from, "SELECT * FROM (VALUES (1, 'one', 1.5::double), (2, NULL, NULL), (3, 'a' || chr(9) || 'b', 3), (4, 'x, \"y\"', 4.5), (5, NULL, NULL)) AS v(k, v, w)"),
    "session_snapshot": (snapshot, "SELECT n_nationkey AS k, 'saved' AS src FROM nation UNION ALL SELECT n_nationkey, 'now' FROM nation WHERE n_nationkey >= 5"),
    "session_prepared": (prepared, "SELECT n_nationkey AS k, CASE n_regionkey WHEN 1 THEN 'one' ELSE 'two' END AS tag FROM nation WHERE n_regionkey IN (1, 2)"),
    "session_transaction": (transaction, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 3"),
    "session_host_function": (host_function, "SELECT n_nationkey, n_name || '!' AS v FROM nation"),
    "op_as_of": (as_of, """SELECT p.event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e
        ON p.user_id = e.user_id AND p.ts >= e.ts"""),
    "op_upsert": (upsert, """SELECT k, coalesce(b.v, a.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) a
        FULL JOIN (SELECT n_nationkey + 5 AS k, lower(n_name) AS v FROM nation WHERE n_nationkey % 2 = 0) b USING (k)"""),
    "op_rollup_total": (rollup_total, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "op_with_ties": (ties, "SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r <= 5"),
    "ev_sliding_window": (sliding, "SELECT CAST(epoch(h) AS BIGINT) AS at, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) GROUP BY 1, 2"),
    "ev_session_windows": (session_windows, """SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
        (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s"""),
}
