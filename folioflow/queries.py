"""Registered queries of the core operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import files, i18n
from .operators import diff, joins, merge, periods, versions
from .operators import reducers as R
from .operators.query import Collection, Engine, Query
from .operators.shared import shared_dir
from .plans import JoinLeg, adapters
from .sources import exports, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ERA = "1998-01-01"  # splits the orders
MID = "2024-01-15"  # splits the events


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The driver tables as collections with their references."""
    e, t = Engine(), lambda n: read(spark, sf_dir, n)
    table = lambda name, *more, **named: e.declare(name, lambda: Collection(name, t(name), *more, **named))
    table("region", "r_regionkey")
    table("nation", "n_nationkey", references={"n_regionkey": ("region", "warn")})
    table("customer", "c_custkey", references={"c_nationkey": ("nation", "warn")})
    table("part", "p_partkey")
    table("supplier", "s_suppkey", references={"s_nationkey": ("nation", "warn")})
    table("orders", "o_orderkey", "o_orderkey", {"o_custkey": ("customer", "warn")}, {"o_orderstatus": "status"}, ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    table("lineitem", "l_orderkey", None, {"l_partkey": ("part", "warn"), "l_orderkey": ("orders", "warn"), "l_suppkey": ("supplier", "warn")})
    e.declare("labelled", lambda: Collection("labelled", t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id", "left"), "doc_id", "doc_id"))
    e.declare("events", lambda: Collection("events", t("events").withColumn("props", F.from_json("props", "k int")), "event_id", "event_id"))
    status = "SELECT * FROM VALUES ('F', map('en', 'finished', 'th', 'เสร็จ')), ('O', map('en', 'open')), ('P', map('en', '', 'th', 'รอ')) AS d(key, labels)"
    e.dictionaries.builders["status"] = lambda: spark.sql(status)
    return e


STATUS_SQL = "(VALUES ('F', 'finished', 'เสร็จ'), ('O', 'open', NULL), ('P', '', 'รอ')) AS d(key, en, th)"


def where_query(name: str, collection: str, columns: str, build: Callable[[Query], Query], condition: str, source: str | None = None):
    """A query of clauses on one collection and its SQL."""
    select = ", ".join(columns.split())
    query(name, f"SELECT {select} FROM {source or collection} WHERE {condition}")(lambda s, d: build(engine(s, d).query(collection)).to_df().select(*columns.split()))


ORD = "o_orderkey o_orderstatus o_totalprice o_orderpriority"
LINE = "l_orderkey l_linenumber l_quantity l_extendedprice"
LABELLED_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"

where_query("where_eq", "orders", ORD, lambda q: q.where("o_orderstatus", "==", "F"), "o_orderstatus = 'F'")
where_query("where_ne", "orders", ORD, lambda q: q.where("o_orderstatus", "!=", "F"), "o_orderstatus IS DISTINCT FROM 'F'")
where_query("where_lt", "lineitem", LINE, lambda q: q.where("l_quantity", "<", 10), "l_quantity < 10")
where_query("where_lte", "lineitem", LINE, lambda q: q.where("l_quantity", "<=", 10), "l_quantity <= 10")
where_query("where_gt", "lineitem", LINE, lambda q: q.where("l_quantity", ">", 40), "l_quantity > 40")
where_query("where_gte", "lineitem", LINE, lambda q: q.where("l_quantity", ">=", 40), "l_quantity >= 40")
where_query("where_between", "lineitem", LINE, lambda q: q.where("l_quantity", "between", [10, 20]), "l_quantity BETWEEN 10 AND 20")
where_query("where_in", "orders", ORD, lambda q: q.where("o_orderpriority", "in", ["1-URGENT", "2-HIGH", None, 3]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
where_query("where_not_in", "orders", ORD, lambda q: q.where("o_orderpriority", "not-in", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
where_query("where_contains", "part", "p_partkey p_name", lambda q: q.where("p_name", "contains", "ring"), "contains(p_name, 'ring')")
where_query("where_starts_with", "part", "p_partkey p_brand", lambda q: q.where("p_brand", "startsWith", "Brand#1"), "starts_with(p_brand, 'Brand#1')")
where_query("where_type_mismatch", "orders", ORD, lambda q: q.where("o_totalprice", "==", "100").or_(lambda b: b), "false")
where_query("where_mismatch_ne", "orders", ORD, lambda q: q.where("o_totalprice", "!=", "100").where("o_orderkey", ">", 10), "o_orderkey > 10")
where_query("where_or_group", "orders", ORD, lambda q: q.where("o_totalprice", ">", 1000.0).or_(lambda b: b.where("o_orderstatus", "==", "P").where("o_orderpriority", "==", "5-LOW")), "o_totalprice > 1000 AND (o_orderstatus = 'P' OR o_orderpriority = '5-LOW')")
where_query("where_nested_groups", "orders", ORD, lambda q: q.or_(lambda b: b.where("o_orderstatus", "==", "P").and_(lambda c: c.where("o_totalprice", ">", 100000.0).where("o_orderpriority", "startsWith", "1"))), "o_orderstatus = 'P' OR (o_totalprice > 100000 AND starts_with(o_orderpriority, '1'))")
where_query("where_empty_and_group", "orders", ORD, lambda q: q.and_(lambda b: b).where("o_orderstatus", "==", "P"), "o_orderstatus = 'P'")
where_query("where_missing_field", "orders", ORD, lambda q: q.where("nothing", "==", None).where("nothing.deeper", "!=", 1).where("o_orderstatus", "==", "O"), "o_orderstatus = 'O'")
where_query("where_ne_nullable", "labelled", "doc_id quality", lambda q: q.where("quality", "!=", 1), "quality IS DISTINCT FROM 1", LABELLED_SQL)
where_query("where_eq_null", "labelled", "doc_id lang", lambda q: q.where("toxic", "==", None), "toxic IS NULL", LABELLED_SQL)
where_query("where_in_null", "labelled", "doc_id quality", lambda q: q.where("quality", "in", [0, None]), "quality = 0 OR quality IS NULL", LABELLED_SQL)
where_query("where_gt_nullable", "labelled", "doc_id quality", lambda q: q.where("quality", ">", 0), "coalesce(quality > 0, false)", LABELLED_SQL)
where_query("where_filter_fn", "lineitem", LINE, lambda q: q.filter(lambda df: df.l_extendedprice * (1 - df.l_discount) > 50000), "l_extendedprice * (1 - l_discount) > 50000")
query("where_nested_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")(
    lambda s, d: engine(s, d).query("events").where("props.k", ">=", 50).to_df().select("event_id", F.col("props.k").alias("k"))
)


def _flags(s, d):
    return Collection("flags", read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags")), "l_orderkey")


query("where_array_contains", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_contains(list(DISTINCT l_returnflag), 'R')")(
    lambda s, d: Query(Engine(), _flags(s, d), engine(s, d).query("orders").plan).where("flags", "contains", "R").to_df().select("l_orderkey")
)
query("where_array_contains_any", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag IN ('A', 'N'))")(
    lambda s, d: Query(Engine(), _flags(s, d), engine(s, d).query("orders").plan).where("flags", "array-contains-any", ["A", "N"]).to_df().select("l_orderkey")
)

# sort and pages


@query("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_limit_offset(s, d):
    return engine(s, d).query("orders").order_by("o_totalprice", "desc").offset(10).limit(20).to_df().select("o_orderkey", "o_totalprice")


@query("order_two_keys", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def order_two_keys(s, d):
    return engine(s, d).query("orders").order_by("o_orderpriority").order_by("o_totalprice", "desc").to_df().select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("order_asc_nulls_last", f"SELECT doc_id, quality FROM {LABELLED_SQL} ORDER BY quality ASC NULLS LAST, doc_id")
def order_asc_nulls_last(s, d):
    return engine(s, d).query("labelled").order_by("quality").to_df().select("doc_id", "quality")


@query("order_desc_nulls_first", f"SELECT doc_id, quality FROM {LABELLED_SQL} ORDER BY quality DESC NULLS FIRST, doc_id")
def order_desc_nulls_first(s, d):
    return engine(s, d).query("labelled").order_by("quality", "desc").to_df().select("doc_id", "quality")


@query("first_row", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first_row(s, d):
    return engine(s, d).query("orders").where("o_orderstatus", "==", "F").order_by("o_totalprice").limit(1).to_df().select("o_orderkey", "o_totalprice")


@query("lazy_order_drops_nulls", f"SELECT doc_id, quality FROM {LABELLED_SQL} WHERE quality IS NOT NULL ORDER BY quality DESC, doc_id LIMIT 40")
def lazy_order_drops_nulls(s, d):
    e = engine(s, d)
    c = e.collections["labelled"]
    e.add(Collection(c.name, c.df, c.id_col, c.seq, indexes=("quality",)))
    return e.lazy("labelled").order_by("quality", "desc").limit(40).to_df().select("doc_id", "quality")


@query("page_keyset", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def page_keyset(s, d):
    return engine(s, d).query("orders").page(500, 100).select("o_orderkey", "o_orderstatus")


@query("count_ignores_page", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_ignores_page(s, d):
    return engine(s, d).query("orders").where("o_orderstatus", "==", "O").order_by("o_totalprice").limit(3).aggregate({"n": R.count()})


@query("lazy_composite", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 50000")
def lazy_composite(s, d):
    return engine(s, d).lazy("orders").where("o_orderstatus", "==", "F").where("o_orderpriority", "==", "1-URGENT").where("o_totalprice", ">", 50000.0).to_df().select("o_orderkey")


# reducers

SPEC = {"n": R.count(), "total": R.sum_of("o_totalprice"), "mean": R.avg("o_totalprice"), "low": R.least("o_totalprice"), "high": R.greatest("o_totalprice")}
SPEC_SQL = "CAST(count(*) AS BIGINT) AS n, round(coalesce(sum({0}), 0.0), 2) AS total, round(avg({0}), 4) AS mean, CAST(min({0}) AS DOUBLE) AS low, CAST(max({0}) AS DOUBLE) AS high"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c, k in (("total", 2), ("mean", 4)) if c in df.columns})


@query("agg_all_reducers", f"SELECT {SPEC_SQL.format('o_totalprice')} FROM orders WHERE o_orderstatus = 'F'")
def agg_all_reducers(s, d):
    return rounded(engine(s, d).query("orders").where("o_orderstatus", "==", "F").aggregate(SPEC))


@query("agg_nullable_as_zero", f"SELECT {SPEC_SQL.format('coalesce(quality, 0)')} FROM {LABELLED_SQL}")
def agg_nullable_as_zero(s, d):
    return rounded(engine(s, d).query("labelled").aggregate({k: R.Reducer(r.kind, "quality") for k, r in SPEC.items()}))


@query("agg_text_as_zero", "SELECT CAST(0.0 AS DOUBLE) AS total, CAST(0.0 AS DOUBLE) AS high FROM orders LIMIT 1")
def agg_text_as_zero(s, d):
    return engine(s, d).query("orders").aggregate({"total": R.sum_of("o_orderstatus"), "high": R.greatest("o_orderstatus")})


@query(
    "agg_empty",
    """SELECT CAST(0 AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS low
    FROM (SELECT count(*)
    FROM orders)""",
)
def agg_empty(s, d):
    return engine(s, d).query("orders").where("o_orderstatus", "==", "never").aggregate({k: SPEC[k] for k in ("n", "total", "mean", "low")})


@query("agg_custom_reducer", "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders")
def agg_custom_reducer(s, d):
    return engine(s, d).query("orders").aggregate({"customers": R.custom(lambda df: F.countDistinct("o_custkey"))})


@query("groupby_status", f"SELECT o_orderstatus, {SPEC_SQL.format('o_totalprice')} FROM orders GROUP BY o_orderstatus")
def groupby_status(s, d):
    return rounded(engine(s, d).query("orders").group_by("o_orderstatus", SPEC))


@query(
    "groupby_priority_paid",
    f"""SELECT o_orderpriority, {SPEC_SQL.format('o_totalprice')}
    FROM orders
    WHERE o_orderstatus = 'F'
    GROUP BY o_orderpriority""",
)
def groupby_priority_paid(s, d):
    return rounded(engine(s, d).query("orders").where("o_orderstatus", "==", "F").group_by("o_orderpriority", SPEC))


@query(
    "groupby_null_key",
    f"""SELECT quality, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS DOUBLE) AS total
    FROM {LABELLED_SQL}
    GROUP BY quality""",
)
def groupby_null_key(s, d):
    return engine(s, d).query("labelled").group_by("quality", {"n": R.count(), "total": R.sum_of("n_chars")})


@query("groupby_nested_key", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def groupby_nested_key(s, d):
    return engine(s, d).query("events").group_by("props.k", {"n": R.count()})


@query("groupby_first_seen", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey ORDER BY min(o_orderkey)")
def groupby_first_seen(s, d):
    return engine(s, d).query("orders").group_by("o_custkey", {"n": R.count()}, max_groups=None)


@query("groupby_label", f"SELECT o_orderstatus, n, coalesce(d.th, d.en) AS \"o_orderstatusLabel\" FROM (SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) LEFT JOIN {STATUS_SQL} ON d.key = o_orderstatus")
def groupby_label(s, d):
    return engine(s, d).query("orders").group_by("o_orderstatus", {"n": R.count()}, label=("th", ("en",)))


# joins

CUSTOMER = "customer.c_custkey customer.c_name customer.c_mktsegment"


def flat(df: DataFrame, keep: str, *paths: str) -> DataFrame:
    return df.select(*keep.split(), *[F.col(p).alias(p.replace(".", "_")) for p in paths])


@query(
    "join_ref",
    """SELECT o_orderkey, c_custkey AS customer_c_custkey, c_name AS customer_c_name, c_mktsegment AS customer_c_mktsegment
    FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey""",
)
def join_ref(s, d):
    return flat(engine(s, d).query("orders").join("o_custkey", "customer").to_df(), "o_orderkey", *CUSTOMER.split())


@query(
    "join_hash_strategy",
    """SELECT o_orderkey, c_name AS customer_c_name
    FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'P'""",
)
def join_hash_strategy(s, d):
    return flat(engine(s, d).query("orders").where("o_orderstatus", "==", "P").join("o_custkey", "customer", strategy="hash").to_df(), "o_orderkey", "customer.c_name")


CHAIN = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def chain(q: Query) -> Query:
    return q.join("o_custkey", "customer").join("customer.c_nationkey", "nation").join("nation.n_regionkey", "region")


@query("join_chain3", f"SELECT o_orderkey, c_name AS customer_c_name, n_name AS nation_n_name, r_name AS region_r_name {CHAIN}")
def join_chain3(s, d):
    return flat(chain(engine(s, d).query("orders")).to_df(), "o_orderkey", "customer.c_name", "nation.n_name", "region.r_name")


@query(
    "join_limit_before",
    """SELECT o_orderkey, c_name AS customer_c_name
    FROM (SELECT *
    FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
    LEFT JOIN customer ON o_custkey = c_custkey""",
)
def join_limit_before(s, d):
    return flat(engine(s, d).query("orders").order_by("o_totalprice", "desc").limit(10).join("o_custkey", "customer").to_df(), "o_orderkey", "customer.c_name")


@query("join_dangling_warn", "SELECT d.doc_id, l.quality AS label_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_dangling_warn(s, d):
    """Labels cover only some documents: the others get null."""
    leg = JoinLeg("doc_id", "label", "labels")
    return flat(joins.lookup_join(read(s, d, "documents").select("doc_id", "lang"), read(s, d, "labels"), leg, "doc_id", unique=True), "doc_id", "label.quality")


@query(
    "join_last_duplicate_wins",
    """SELECT c_custkey, arg_max(o_orderkey, o_orderkey) AS last_o_orderkey
    FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey""",
)
def join_last_duplicate_wins(s, d):
    return flat(joins.lookup_join(read(s, d, "customer"), read(s, d, "orders"), JoinLeg("c_custkey", "last", "orders"), "o_custkey", "o_orderkey"), "c_custkey", "last.o_orderkey")


@query("join_dictionary", f"SELECT o_orderkey, d.key AS status_key, d.en AS status_en FROM orders LEFT JOIN {STATUS_SQL} ON d.key = o_orderstatus")
def join_dictionary(s, d):
    e = engine(s, d)
    return flat(joins.dictionary_join(read(s, d, "orders"), e.dictionaries["status"], "o_orderstatus", "status", ("en", "th")), "o_orderkey", "status.key", "status.en")


@query(
    "scan_join_agg",
    """SELECT CAST(count(*) AS BIGINT) AS n, round(sum(p_retailprice), 2) AS total, CAST(max(p_size) AS DOUBLE) AS high
    FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey
    WHERE l_quantity > 25""",
)
def scan_join_agg(s, d):
    return rounded(engine(s, d).scan("lineitem").where("l_quantity", ">", 25).join("l_partkey", "part").aggregate({"n": R.count(), "total": R.sum_of("part.p_retailprice"), "high": R.greatest("part.p_size")}))


@query(
    "scan_join_group",
    f"""SELECT r_name, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total {CHAIN}
    WHERE o_orderstatus = 'F'
    GROUP BY r_name""",
)
def scan_join_group(s, d):
    return rounded(chain(engine(s, d).scan("orders").where("o_orderstatus", "==", "F")).group_by("region.r_name", {"n": R.count(), "total": R.sum_of("o_totalprice")}))


@query(
    "integrity_report",
    """SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS id, 'doc_id' AS field, 'labels' AS target, CAST(doc_id AS VARCHAR) AS value
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'o_custkey', 'customer', CAST(o_custkey AS VARCHAR)
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def integrity_report(s, d):
    t = lambda n: read(s, d, n)
    held = {"labels": (t("labels"), "doc_id"), "documents": (t("documents"), "doc_id"), "orders": (t("orders"), "o_orderkey"), "customer": (t("customer"), "c_custkey")}
    return joins.integrity_report(held, [("documents", "doc_id", "labels"), ("orders", "o_custkey", "customer")])


@query(
    "cascade_delete_ids",
    """WITH c AS (SELECT c_custkey
    FROM customer
    WHERE c_nationkey = 3), o AS (SELECT o_orderkey
    FROM orders
    WHERE o_custkey IN (SELECT c_custkey
    FROM c)) SELECT 'customer' AS collection, CAST(c_custkey AS VARCHAR) AS id
    FROM c
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR)
    FROM o
    UNION ALL SELECT 'nation', '3'
    FROM nation
    WHERE n_nationkey = 3""",
)
def cascade_delete_ids(s, d):
    t = lambda n: read(s, d, n)
    held = {"nation": (t("nation"), "n_nationkey"), "customer": (t("customer"), "c_custkey"), "orders": (t("orders"), "o_orderkey")}
    gone = joins.cascade_delete(held, [("customer", "c_nationkey", "nation", "cascade"), ("orders", "o_custkey", "customer", "cascade")], "nation", t("nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("id")))
    return stores.union_all([df.select(F.lit(n).alias("collection"), "id") for n, df in gone.items()])


@query("get_many", "SELECT k AS id, o_totalprice FROM (VALUES (1), (2), (-5)) v(k) LEFT JOIN orders ON o_orderkey = k")
def get_many(s, d):
    found = engine(s, d).collections["orders"].get_many(s.createDataFrame([(1,), (2,), (-5,)], "id int"))
    return flat(found, "id", "row.o_totalprice").withColumnRenamed("row_o_totalprice", "o_totalprice")


@query("get_one", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def get_one(s, d):
    return engine(s, d).collections["orders"].get(7).select("o_orderkey", "o_totalprice")


# versions: events as a change log of user states


def log(s, d) -> versions.Log:
    df = read(s, d, "events").select(F.col("user_id").alias("id"), "event_id", "ts", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.round("value", 4).alias("value"))
    return versions.Log(versions.with_versions(df, "id", "ts"), "id", "_v", "ts", "op")


LOG_SQL = "(SELECT user_id AS id, event_id, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, round(value, 4) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS _v FROM events)"
LATEST_SQL = f"(SELECT * FROM {LOG_SQL} WHERE {{0}} QUALIFY row_number() OVER (PARTITION BY id ORDER BY _v DESC) = 1)"
STATE = "id event_id value _v"


def state(df: DataFrame) -> DataFrame:
    return df.select("id", "event_id", "value", F.col("_v").cast("long").alias("_v"))


@query("current_state", f"SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v FROM {LATEST_SQL.format('true')} WHERE op <> 'delete'")
def current_state(s, d):
    return state(versions.current(log(s, d)))


@query(
    "as_of",
    f"""SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v
    FROM {LATEST_SQL.format(f'''ts <= TIMESTAMP '{MID}' ''')}
    WHERE op <> 'delete'""",
)
def as_of(s, d):
    return state(versions.as_of(log(s, d), F.lit(MID).cast("timestamp_ntz")))


@query("alive_ids_at", f"SELECT id FROM {LATEST_SQL.format(f'''ts <= TIMESTAMP '{MID}' ''')} WHERE op <> 'delete' ORDER BY id")
def alive_ids_at(s, d):
    return versions.alive_ids(log(s, d), F.lit(MID).cast("timestamp_ntz"))


@query(
    "history_of_one",
    f"""SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v
    FROM {LOG_SQL}
    WHERE id = 7 AND ts >= TIMESTAMP '2024-01-05' AND _v < (SELECT max(_v)
    FROM {LOG_SQL}
    WHERE id = 7)
    ORDER BY _v DESC LIMIT 10""",
)
def history_of_one(s, d):
    return state(versions.history(log(s, d), 7, since=F.lit("2024-01-05").cast("timestamp_ntz"), limit=10))


@query(
    "history_all",
    f"""SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v
    FROM (SELECT *, max(_v) OVER (PARTITION BY id) AS m
    FROM {LOG_SQL})
    WHERE _v < m""",
)
def history_all(s, d):
    return state(versions.history(log(s, d)))


@query("version_lookup", f"SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v FROM {LOG_SQL} WHERE id = 7 AND _v = 3")
def version_lookup(s, d):
    return state(versions.get_version(log(s, d), 7, 3))


@query(
    "revert_to_version",
    f"""SELECT CAST(max(_v) + 1 AS BIGINT) AS _v, (SELECT value
    FROM {LOG_SQL}
    WHERE id = 7 AND _v = 2) AS value
    FROM {LOG_SQL}
    WHERE id = 7""",
)
def revert_to_version(s, d):
    reverted = versions.revert(log(s, d), 7, 2, F.lit("2024-02-01").cast("timestamp_ntz"))
    return versions.Log(reverted, "id", "_v", "ts", "op").df.where("id = 7").orderBy(F.desc("_v")).limit(1).select(F.col("_v").cast("long").alias("_v"), "value")


@query(
    "prune_keep_3",
    f"""SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v
    FROM {LOG_SQL}
    QUALIFY row_number() OVER (PARTITION BY id
    ORDER BY _v DESC) <= 4""",
)
def prune_keep_3(s, d):
    return state(versions.prune(log(s, d), keep=3))


@query(
    "prune_before",
    f"""SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v
    FROM {LOG_SQL}
    QUALIFY row_number() OVER (PARTITION BY id
    ORDER BY _v DESC) = 1 OR ts >= TIMESTAMP '{MID}'""",
)
def prune_before(s, d):
    return state(versions.prune(log(s, d), before=F.lit(MID).cast("timestamp_ntz")))


@query(
    "version_fields_changed",
    f"""SELECT id, CAST(_v AS BIGINT) AS _v, value IS DISTINCT
    FROM p AS value_changed, op IS DISTINCT
    FROM o AS op_changed
    FROM (SELECT *, lag(value) OVER w AS p, lag(op) OVER w AS o
    FROM {LOG_SQL} WINDOW w AS (PARTITION BY id
    ORDER BY _v))
    WHERE _v > 1""",
)
def version_fields_changed(s, d):
    return versions.fields_changed(log(s, d), ["value", "op"]).withColumn("_v", F.col("_v").cast("long"))


@query(
    "ledger_gap_check",
    """SELECT user_id, event_id, p AS before, event_id - p - 1 AS gap
    FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id
    ORDER BY event_id) AS p
    FROM events)
    WHERE event_id - p <> 1""",
)
def ledger_gap_check(s, d):
    return versions.ledger_gaps(read(s, d, "events"), "event_id", "user_id")


LEDGER = ["event_id", "event_type", "user_id"]
#: The chain again, entry by entry: each hash is that of the canonical JSON of the entry with the hash before.
LEDGER_SQL = """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
c AS (SELECT user_id, i, event_id, '' AS p, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","index":0,"prevHash":"","user_id":' || user_id || '}') AS h
      FROM e WHERE i = 0
      UNION ALL
      SELECT e.user_id, e.i, e.event_id, c.h, sha256('{"event_id":' || e.event_id || ',"event_type":"' || e.event_type || '","index":' || e.i || ',"prevHash":"' || c.h || '","user_id":' || e.user_id || '}')
      FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)"""


def ledger(s, d) -> DataFrame:
    return versions.ledger_append(read(s, d, "events").select(*LEDGER), LEDGER, "event_id", "user_id")


@query("ledger_append", LEDGER_SQL + ' SELECT user_id, CAST(i AS BIGINT) AS index, event_id, p AS "prevHash", h AS "entryHash" FROM c')
def ledger_append(s, d):
    return ledger(s, d).select("user_id", "index", "event_id", "prevHash", "entryHash")


@query(
    "ledger_verify",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS entries, count(*) < 6 AS ok, CASE WHEN count(*) >= 6 THEN CAST(5 AS BIGINT) END AS first_bad
    FROM events
    GROUP BY user_id""",
)
def ledger_verify(s, d):
    """Chains whose entry 5 was changed afterwards: verification names it."""
    tampered = ledger(s, d).withColumn("event_type", F.when(F.col("index") == 5, "tampered").otherwise(F.col("event_type")))
    return versions.ledger_verify(tampered, LEDGER, "user_id")


@query(
    "ledger_forged",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS entries, count(*) < 4 AS ok, CASE WHEN count(*) >= 4 THEN CAST(3 AS BIGINT) END AS first_bad
    FROM events
    GROUP BY user_id""",
)
def ledger_forged(s, d):
    """Chains whose entry 2 was changed and hashed anew: the entry after it no longer holds."""
    forged = ledger(s, d).withColumn("event_type", F.when(F.col("index") == 2, "forged").otherwise(F.col("event_type")))
    rehashed = F.when(F.col("index") == 2, versions.entry_hash([*LEDGER, "index", "prevHash"])).otherwise(F.col("entryHash"))
    return versions.ledger_verify(forged.withColumn("entryHash", rehashed), LEDGER, "user_id")


@query("ledger_head", LEDGER_SQL + " SELECT user_id, CAST(max(i) AS BIGINT) AS index, arg_max(h, i) AS hash FROM c GROUP BY user_id")
def ledger_head(s, d):
    return versions.ledger_head(ledger(s, d), "user_id")


@query("ledger_continue", LEDGER_SQL + ' SELECT user_id, CAST(i AS BIGINT) AS index, h AS "entryHash" FROM c WHERE event_id >= 5000')
def ledger_continue(s, d):
    """The entries of the later events, appended to the heads that the earlier ones left."""
    events = read(s, d, "events").select(*LEDGER)
    early = versions.ledger_append(events.where("event_id < 5000"), LEDGER, "event_id", "user_id")
    late = versions.ledger_append(events.where("event_id >= 5000"), LEDGER, "event_id", "user_id", versions.ledger_head(early, "user_id"))
    return late.select("user_id", "index", "entryHash")


@query(
    "put_many_cas",
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'written' ELSE 'rejected' END AS outcome, CAST(CASE WHEN id % 2 = 0 THEN _v + 1 ELSE _v END AS BIGINT) AS _v
    FROM {LATEST_SQL.format('true')}""",
)
def put_many_cas(s, d):
    held = log(s, d)
    incoming = versions.latest(held).select("id", "value", F.when(F.col("id") % 2 == 0, F.col("_v")).otherwise(F.lit(-1)).alias("expected"))
    after, rejected = versions.put_many(held, incoming, F.lit("2024-03-01").cast("timestamp_ntz"), "expected")
    written = after.where("ts = timestamp_ntz'2024-03-01'").select("id", F.lit("written").alias("outcome"), F.col("_v").cast("long").alias("_v"))
    return written.unionByName(rejected.select("id", F.lit("rejected").alias("outcome"), F.col("actual_version").cast("long").alias("_v")))


@query(
    "put_many_batch",
    f"""SELECT c.id, CAST(coalesce(l._v, 0) + n AS BIGINT) AS _v, c.id * 10 + n AS event_id
    FROM (SELECT c_custkey AS id, unnest([1, 2]) AS n FROM customer) c LEFT JOIN {LATEST_SQL.format('true')} l ON l.id = c.id""",
)
def put_many_batch(s, d):
    """Two writes an id in one batch, to ids that are there and to new ones: they take the next two versions."""
    twice = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    incoming = twice.select("id", (F.col("id") * 10 + F.col("n")).alias("event_id"), "n")
    after, _ = versions.put_many(log(s, d), incoming, F.lit("2024-03-01").cast("timestamp_ntz"), arrival="n")
    return after.where("ts = timestamp_ntz'2024-03-01'").select("id", F.col("_v").cast("long").alias("_v"), "event_id")


@query(
    "delete_many",
    f"""SELECT id, CAST(_v + 1 AS BIGINT) AS _v, 'delete' AS op
    FROM {LATEST_SQL.format('true')}
    WHERE op <> 'delete' AND id IN (SELECT c_custkey
    FROM customer
    WHERE c_nationkey < 12)""",
)
def delete_many(s, d):
    """Tombstones for ids that are alive; the others are left out."""
    ids = read(s, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("id"))
    after = versions.delete_many(log(s, d), ids, F.lit("2024-03-01").cast("timestamp_ntz"))
    return after.where("ts = timestamp_ntz'2024-03-01'").select("id", F.col("_v").cast("long").alias("_v"), "op")


@query("clear_history", f"SELECT id, event_id, value, CAST(_v AS BIGINT) AS _v FROM {LATEST_SQL.format('true')}")
def clear_history(s, d):
    return state(versions.clear_history(log(s, d)))


@query(
    "transaction_commit",
    f"""SELECT 'users' AS collection, id, CAST(_v + 1 AS BIGINT) AS _v, 'put' AS op FROM {LATEST_SQL.format('true')}
    UNION ALL SELECT 'customers', c_custkey, CAST(2 AS BIGINT), 'delete' FROM customer WHERE c_acctbal < 0""",
)
def transaction_commit(s, d):
    """Puts with the version each relies on in one collection, deletions in another, committed together."""
    users, at = log(s, d), F.lit("2024-03-01").cast("timestamp_ntz")
    customers = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("_v"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("put").alias("op"), "c_acctbal")
    logs = {"users": users, "customers": versions.Log(customers, "id", "_v", "ts", "op")}
    puts = {"users": versions.latest(users).select("id", "value", F.col("_v").alias("expected"))}
    after = versions.transaction(logs, puts, {"customers": customers.where("c_acctbal < 0").select("id")}, at, "expected")
    new = [df.where("ts = timestamp_ntz'2024-03-01'").select(F.lit(n).alias("collection"), F.col("id").cast("long").alias("id"), F.col("_v").cast("long").alias("_v"), "op") for n, df in after.items()]
    return stores.union_all(new)


@query(
    "reconstruct_version",
    f"""SELECT l.id, e.event_id, e.value
    FROM {LATEST_SQL.format('true')} l JOIN {LOG_SQL} e ON e.id = l.id AND e._v = least(2, l._v)""",
)
def reconstruct_version(s, d):
    """Version 2 of every user, from the newest rows and the reverse deltas of the later ones."""
    held = log(s, d)
    deltas = diff.reverse_deltas(held.df, ["event_id", "value"], "id", "_v")
    return diff.reconstruct(versions.latest(held).select("id", "event_id", "value"), deltas, 2, "id", "_v")


# differences and imports


def edited(s, d) -> DataFrame:
    """Customers with edits: every 7th balance raised, every 11th gone, 50 new ones."""
    c = read(s, d, "customer")
    kept = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return kept.unionByName(c.where("c_custkey <= 50").withColumn("c_custkey", -F.col("c_custkey")))


EDITED_SQL = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey <= 50)"
DIFF_SQL = f"(SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' WHEN o.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'modified' ELSE 'unchanged' END AS change, o.c_acctbal AS old_bal, n.c_acctbal AS new_bal, coalesce(o.c_name, n.c_name) AS c_name FROM customer o FULL JOIN {EDITED_SQL} n ON o.c_custkey = n.c_custkey)"


@query(
    "vault_diff_rows",
    f"""SELECT c_custkey, change, CASE WHEN change = 'modified' THEN 'c_acctbal' ELSE '' END AS fields
    FROM {DIFF_SQL}
    WHERE change <> 'unchanged'""",
)
def vault_diff_rows(s, d):
    return diff.collection_diff(read(s, d, "customer"), edited(s, d), "c_custkey").select("c_custkey", "change", F.array_join("fields_changed", ",").alias("fields"))


@query(
    "vault_diff_summary",
    f"""SELECT CAST(count(*) FILTER (change = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (change = 'modified') AS BIGINT) AS modified, CAST(count(*) FILTER (change = 'deleted') AS BIGINT) AS deleted
    FROM {DIFF_SQL}""",
)
def vault_diff_summary(s, d):
    return diff.diff_summary(diff.collection_diff(read(s, d, "customer"), edited(s, d), "c_custkey"))


def import_query(policy: str, keep: str, balance: str):
    name = f"import_{policy.replace('-', '_')}"
    query(name, f"SELECT c_custkey, c_name, {balance} AS c_acctbal FROM {DIFF_SQL} WHERE {keep}")(lambda s, d: diff.import_plan(read(s, d, "customer"), edited(s, d), policy, "c_custkey").select("c_custkey", "c_name", "c_acctbal"))


import_query("merge", "true", "coalesce(new_bal, old_bal)")
import_query("replace", "change <> 'deleted'", "new_bal")
import_query("insert-only", "true", "coalesce(old_bal, new_bal)")


# with fields that one side lacks, nested ones, and several collections

NESTED_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '~ place.city: "' || c_name || '" → "moved"' WHEN c_custkey % 5 = 0 THEN '+ note: "new"' END AS text
FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0"""


def nested(s, d) -> tuple[DataFrame, DataFrame]:
    """Customers with a nested place; every 7th moved, every 5th other one with a note that the live side does not know."""
    c = read(s, d, "customer")
    place = lambda city: F.struct(city.alias("city"), F.col("c_nationkey").alias("nation")).alias("place")
    live = c.select("c_custkey", place(F.col("c_name")))
    city = F.when(F.col("c_custkey") % 7 == 0, F.lit("moved")).otherwise(F.col("c_name"))
    return live, c.select("c_custkey", place(city), F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_custkey") % 7 != 0), "new").alias("note"))


@query("field_diffs", NESTED_SQL)
def field_diffs(s, d):
    found = diff.field_diffs(diff.collection_diff(*nested(s, d), "c_custkey"))
    return found.select("c_custkey", diff.format_changes(F.col("field_diffs")).alias("text"))


@query(
    "import_new_field",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'moved' ELSE c_name END AS city, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN 'new' END AS note
    FROM customer""",
)
def import_new_field(s, d):
    return diff.import_plan(*nested(s, d), "merge", "c_custkey").select("c_custkey", F.col("place.city").alias("city"), "note")


@query(
    "vault_diff_collections",
    f"""SELECT 'customer' AS collection, CAST(c_custkey AS VARCHAR) AS id, change, CASE WHEN change = 'modified' THEN 1 ELSE 0 END AS fields FROM {DIFF_SQL} WHERE change <> 'unchanged'
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'deleted', 0 FROM nation
    UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'added', 0 FROM region""",
)
def vault_diff_collections(s, d):
    live = {"customer": (read(s, d, "customer"), "c_custkey"), "nation": (read(s, d, "nation"), "n_nationkey"), "_hidden": (read(s, d, "part"), "p_partkey")}
    candidate = {"customer": (edited(s, d), "c_custkey"), "region": (read(s, d, "region"), "r_regionkey")}
    return diff.vault_diff(live, candidate).select("collection", "id", "change", F.size("field_diffs").alias("fields"))


@query(
    "vault_diff_format",
    f"""SELECT 0 AS place, '' AS collection, '' AS id, count(*) FILTER (change = 'added') || ' added · ' || count(*) FILTER (change = 'modified') || ' modified · ' || count(*) FILTER (change = 'deleted') || ' deleted' AS line FROM {DIFF_SQL}
    UNION ALL SELECT 1, 'customer', CAST(c_custkey AS VARCHAR), CASE change WHEN 'added' THEN '+ ' WHEN 'deleted' THEN '- ' ELSE '~ ' END || 'customer/' || c_custkey || CASE WHEN change = 'modified' THEN ' (c_acctbal)' ELSE '' END
    FROM {DIFF_SQL} WHERE change <> 'unchanged'""",
)
def vault_diff_format(s, d):
    found = diff.vault_diff({"customer": (read(s, d, "customer"), "c_custkey")}, {"customer": (edited(s, d), "c_custkey")})
    return diff.format_vault_diff(found, "one-line")


@query("json_patch_names", f"SELECT c_custkey, '[{{\"op\": \"replace\", \"path\": \"/c_name\", \"value\": \"' || 'x' || c_custkey || '\"}}]' AS patch FROM customer")
def json_patch_names(s, d):
    c = read(s, d, "customer")
    new = F.struct("c_custkey", F.concat(F.lit("x"), F.col("c_custkey")).alias("c_name"))
    both = c.select("c_custkey", F.struct("c_custkey", "c_name").alias("old"), new.alias("new"))
    return both.select("c_custkey", diff.patch_json(F.col("old"), F.col("new"), both.schema["old"].dataType).alias("patch"))


# reconciliation


@query(
    "lww_merge",
    """SELECT user_id, event_type, round(value, 4) AS value, event_id
    FROM (SELECT *
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type
    ORDER BY ts DESC, event_id % 2) = 1)""",
)
def lww_merge(s, d):
    """Registers (user, kind) of two replicas, the even and the odd events: the later write wins, a tie goes to the even."""
    e = read(s, d, "events").select("user_id", "event_type", "ts", F.struct(F.round("value", 4).alias("value"), "event_id").alias("v"), (F.col("event_id") % 2).alias("side"))
    return merge.lww_registers(e, ["user_id", "event_type"], "v", "ts", "side").select("user_id", "event_type", "v.value", "v.event_id")


@query(
    "lww_map_merge",
    """SELECT user_id, event_type, max(event_id) AS event_id
    FROM (SELECT user_id, event_type, event_id % 2 AS side, max(event_id) AS event_id
    FROM events
    GROUP BY ALL)
    GROUP BY ALL""",
)
def lww_map_merge(s, d):
    """The same as maps: each side's map of registers (v and ts: the event's id), merged, and taken apart again."""
    e = read(s, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("side"), "event_type").agg(F.max("event_id").alias("m"))
    maps = e.groupBy("user_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(F.col("m").alias("v"), F.col("m").alias("ts"))))).alias("state"))
    left, right = (maps.where(f"side = {k}").select("user_id", F.col("state").alias(n)) for k, n in ((0, "a"), (1, "b")))
    empty = F.create_map().cast("map<string,struct<v:bigint,ts:bigint>>")
    both = left.join(right, "user_id", "full_outer").select("user_id", merge.merge_lww(F.coalesce("a", empty), F.coalesce("b", empty)).alias("state"))
    return both.select("user_id", F.explode(merge.lww_snapshot(F.col("state"))).alias("event_type", "event_id"))


@query(
    "rga_merge",
    """SELECT conv_id, CAST(count(*) FILTER (turn % 5 <> 0) AS BIGINT) AS n, string_agg(role, ','
    ORDER BY (turn % 3 = 1), turn) FILTER (turn % 5 <> 0) AS roles
    FROM conversations
    GROUP BY conv_id HAVING count(*) FILTER (turn % 3 <> 1) > 0 AND count(*) FILTER (turn % 5 <> 0) > 0""",
)
def rga_merge(s, d):
    """Conversations as replicated lists: one side lacks every third turn, every fifth turn is deleted on the other."""
    c = read(s, d, "conversations").withColumn("x", F.struct(F.col("turn").cast("string").alias("nid"), F.col("role").alias("v"), F.col("turn").alias("t")))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("all"))
    items = lambda keep: F.transform(F.filter("all", keep), lambda y: y["x"])
    left = items(lambda y: y["turn"] % 3 != 1)
    right, gone = items(lambda y: F.lit(True)), F.transform(F.filter("all", lambda y: y["turn"] % 5 == 0), lambda y: y["x"]["nid"])
    merged, tombstones = merge.merge_rga(left, F.array().cast("array<string>"), right, gone)
    out = lists.where(F.size(left) > 0).select("conv_id", merge.rga_values(merged, tombstones).alias("v")).where("size(v) > 0")
    return out.select("conv_id", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("roles"))


def replicas(s, d) -> tuple[DataFrame, DataFrame]:
    c = read(s, d, "customer")
    local = c.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).cast("int").alias("_v"), (F.col("c_custkey") % 17).cast("int").alias("_ts"), (F.col("c_custkey") % 3 == 0).alias("dirty"))
    remote = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).cast("int").alias("_v"), (F.col("c_custkey") % 19).cast("int").alias("_ts"))
    return local, remote


def pull_sql(wins: str) -> str:
    k = "CAST(c_custkey AS BIGINT)"
    return f"""WITH b AS (SELECT {k} AS id, c_custkey % 13 <> 0 AS l, c_custkey % 11 <> 0 AS r, CAST(c_custkey % 5 AS INTEGER) AS lv, CAST(c_custkey % 17 AS INTEGER) AS lt, c_custkey % 3 = 0 AS dirty, CAST(c_custkey % 4 AS INTEGER) AS rv, CAST(c_custkey % 19 AS INTEGER) AS rt FROM customer),
a AS (SELECT *, CASE WHEN NOT r THEN 'keep' WHEN NOT l THEN 'insert' WHEN rv <= lv THEN 'ignore' WHEN NOT dirty THEN 'overwrite' WHEN {wins} THEN 'conflict-local' ELSE 'conflict-remote' END AS action FROM b WHERE l OR r)
SELECT id, action, CASE WHEN action IN ('insert', 'overwrite', 'conflict-remote') THEN rv ELSE lv END AS _v, CASE WHEN action IN ('insert', 'overwrite', 'conflict-remote') THEN rt ELSE lt END AS _ts FROM a"""


for _policy, _wins in (("version", "lv >= rv"), ("last-writer-wins", "lt >= rt"), ("first-writer-wins", "lv <= rv"), ("local-wins", "true"), ("remote-wins", "false")):
    query(f"sync_pull_{_policy.replace('-', '_')}", pull_sql(_wins))(lambda s, d, p=_policy: merge.pull(*replicas(s, d), p))


@query(
    "sync_push",
    """SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 5 AS INTEGER) AS _v, CASE WHEN c_custkey % 11 = 0 THEN 'created' WHEN c_custkey % 4 = c_custkey % 5 - 1 THEN 'written' ELSE 'conflict' END AS outcome
    FROM customer
    WHERE c_custkey % 13 <> 0 AND c_custkey % 3 = 0""",
)
def sync_push(s, d):
    return merge.push(*replicas(s, d))


SYNC_SQL = """WITH b AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_custkey % 13 <> 0 AS l, c_custkey % 11 <> 0 AS r, CAST(c_custkey % 5 AS INTEGER) AS lv, CAST(c_custkey % 17 AS INTEGER) AS lt,
c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS dirty, CAST(c_custkey % 4 AS INTEGER) AS rv, CAST(c_custkey % 19 AS INTEGER) AS rt FROM customer),
o AS (SELECT *, CASE WHEN NOT l THEN 'pulled' WHEN NOT r AND dirty THEN 'created' WHEN NOT r THEN 'kept' WHEN dirty AND rv = lv - 1 THEN 'pushed' WHEN dirty THEN 'merged' WHEN rv > lv THEN 'pulled' ELSE 'kept' END AS outcome FROM b WHERE l OR r)
SELECT id, outcome, CASE outcome WHEN 'pulled' THEN rv WHEN 'merged' THEN greatest(lv, rv) + 1 ELSE lv END AS _v, CASE outcome WHEN 'pulled' THEN rt WHEN 'merged' THEN greatest(lt, rt) ELSE lt END AS _ts FROM o"""


@query("sync_both_ways", SYNC_SQL)
def sync_both_ways(s, d):
    """Push (of even ids only) and pull together; conflicts become a merged row."""
    local, remote = replicas(s, d)
    merged = F.struct((F.greatest("local._v", "remote._v") + 1).alias("_v"), F.greatest("local._ts", "remote._ts").alias("_ts"))
    return merge.sync(local, remote, only=F.col("id") % 2 == 0, merged=merged).select("id", "outcome", "row._v", "row._ts")


@query(
    "cross_vault",
    """SELECT r_name AS vault, CAST(count(c_custkey) AS BIGINT) AS n, round(coalesce(sum(c_acctbal), 0.0), 2) AS total
    FROM region
    LEFT JOIN nation ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey
    GROUP BY r_name""",
)
def cross_vault(s, d):
    """A vault a region: one grouped scan over all of them."""
    vaults = read(s, d, "region").join(read(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = vaults.join(read(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    spec = {"n": R.custom(lambda x: F.count("c_custkey")), "total": R.custom(lambda x: F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2))}
    return merge.across_by(rows, "r_name", spec)


@query(
    "cross_vault_each",
    """SELECT 'orders' AS vault, CAST(count(*) AS BIGINT) AS n
    FROM orders
    UNION ALL SELECT 'customers', CAST(count(*) AS BIGINT)
    FROM customer""",
)
def cross_vault_each(s, d):
    """The same query over vaults that are tables of their own."""
    vaults = {"orders": read(s, d, "orders").select(F.col("o_orderkey").alias("k")), "customers": read(s, d, "customer").select(F.col("c_custkey").alias("k"))}
    return merge.across(vaults, lambda df: R.reduce_rows(df, {"n": R.count()})).select("vault", "n")


@query(
    "lww_build",
    """SELECT doc_id, source AS a, CASE WHEN lang = 'en' THEN 'new' ELSE source END AS b, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS b_ts
    FROM documents""",
)
def lww_build(s, d):
    """Registers a and b written first; b alone written again for English documents: a keeps its value and time."""
    docs = read(s, d, "documents")
    first = merge.lww_build(i18n.map_of({"a": F.col("source"), "b": F.col("source")}), F.lit(None).cast("map<string,struct<v:string,ts:int>>"), F.lit(1))
    again = merge.lww_build(i18n.map_of({"b": F.lit("new")}), F.col("state"), F.lit(2))
    held = docs.select("doc_id", "lang", first.alias("state")).select("doc_id", F.when(F.col("lang") == "en", again).otherwise(F.col("state")).alias("state"))
    return held.select("doc_id", F.col("state")["a"]["v"].alias("a"), F.col("state")["b"]["v"].alias("b"), F.col("state")["b"]["ts"].alias("b_ts"))


@query(
    "rga_build",
    """SELECT conv_id, CAST(count(*) FILTER (turn % 2 = 1) AS INTEGER) AS gone, CAST(count(*) AS INTEGER) + 1 AS items
    FROM conversations
    GROUP BY conv_id""",
)
def rga_build(s, d):
    """Conversations written again without their odd turns and with a new one: the odd ones stay as tombstones."""
    item = F.struct(F.concat(F.lit("n"), F.col("turn")).alias("nid"), F.col("turn").cast("string").alias("v"))
    lists = read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda y: y["x"]).alias("items"))
    kept = F.transform(F.filter("items", lambda x: x["v"].cast("int") % 2 == 0), lambda x: x["v"])
    built, gone = merge.rga_build(F.concat(kept, F.array(F.lit("new"))), F.col("items"), F.array().cast("array<string>"), F.lit("m"))
    return lists.select("conv_id", F.size(gone).alias("gone"), F.size(built).alias("items"))


# periods, tiers, attachments, presence


@query(
    "period_seal_violations",
    f"""SELECT o_orderkey
    FROM orders
    WHERE o_orderdate <= TIMESTAMP '{ERA}' OR o_orderdate + INTERVAL 400 DAY <= TIMESTAMP '{ERA}'""",
)
def period_seal_violations(s, d):
    end = F.lit(ERA).cast("timestamp_ntz")
    return periods.violations(read(s, d, "orders"), end, F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 400 days")).select("o_orderkey")


@query("period_text_dates", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') <= '1996-03-31'")
def period_text_dates(s, d):
    return periods.violations(read(s, d, "orders"), "1996-03-31", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).select("o_orderkey")


@query(
    "carry_forward",
    f"""SELECT o_custkey, round(sum(o_totalprice), 2) AS opening, CAST(count(*) AS BIGINT) AS entries
    FROM orders
    WHERE o_orderdate <= TIMESTAMP '{ERA}'
    GROUP BY o_custkey""",
)
def carry_forward(s, d):
    return periods.carry_forward(read(s, d, "orders"), "o_custkey", "o_totalprice", "o_orderdate", F.lit(ERA).cast("timestamp_ntz")).withColumn("opening", F.round("opening", 2))


@query("age_tier_split", f"SELECT event_id, CASE WHEN ts < TIMESTAMP '{MID}' THEN 'cold' ELSE 'hot' END AS tier FROM events")
def age_tier_split(s, d):
    return read(s, d, "events").select("event_id", periods.age_tier(F.col("ts"), F.lit(MID).cast("timestamp_ntz")).alias("tier"))


def tiered(s, d) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).cast("int").alias("_tier"), "c_name")


@query("tier_invisible", "SELECT c_custkey AS id, CAST(c_custkey % 4 AS INTEGER) AS _tier, c_name FROM customer WHERE c_custkey % 4 <= 1")
def tier_invisible(s, d):
    return periods.visible(tiered(s, d), 1)


@query(
    "tier_ghost",
    """SELECT c_custkey AS id, CAST(c_custkey % 4 AS INTEGER) AS _tier, CASE WHEN c_custkey % 4 <= 1 THEN c_name END AS c_name
    FROM customer""",
)
def tier_ghost(s, d):
    return periods.visible(tiered(s, d), 1, "ghost")


@query(
    "blob_dedupe",
    """SELECT sha256(text) AS hash, CAST(strlen(any_value(text)) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS ref_count
    FROM documents
    GROUP BY 1""",
)
def blob_dedupe(s, d):
    return periods.dedupe_blobs(read(s, d, "documents"), "text")


@query(
    "blob_evictions",
    """SELECT event_id, CASE WHEN a > 10 AND event_type = 'error' THEN 'both' WHEN a > 10 THEN 'ttl' ELSE 'predicate' END AS reason
    FROM (SELECT event_id, event_type, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS a
    FROM events)
    WHERE a > 10 OR event_type = 'error'""",
)
def blob_evictions(s, d):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date"))
    return periods.evictions(read(s, d, "events"), age, 10, F.col("event_type") == "error").select("event_id", "reason")


@query(
    "presence_alive",
    """SELECT user_id, max(ts) AS last_seen
    FROM events
    WHERE user_id <> 7
    GROUP BY user_id HAVING max(ts) >= (SELECT max(ts)
    FROM events) - INTERVAL 6 HOUR""",
)
def presence_alive(s, d):
    e = read(s, d, "events")
    return periods.presence(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), F.expr("interval 6 hours"), 7)


@query(
    "consent_audit",
    """SELECT event_id, user_id
    FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND event_type = 'purchase' AND user_id = 42""",
)
def consent_audit(s, d):
    import datetime

    e = Query(Engine(), Collection("events", read(s, d, "events"), "event_id"), engine(s, d).query("orders").plan)
    return e.where("ts", "between", [datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 20)]).where("event_type", "==", "purchase").where("user_id", "==", 42).to_df().select("event_id", "user_id")


# localised text, file functions


def texts(s, d) -> DataFrame:
    languages = i18n.map_of({"en": F.when(F.col("lang") == "en", F.col("source")), "de": F.when(F.col("lang") == "de", F.col("source")).otherwise(F.lit("")), "fr": F.concat(F.lit("fr-"), F.col("source"))})
    return read(s, d, "documents").select("doc_id", languages.alias("name"))


@query(
    "i18n_resolve",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN source ELSE 'fr-' || source END AS name
    FROM documents""",
)
def i18n_resolve(s, d):
    return i18n.apply_locale(texts(s, d), ["name"], "en", ("de", "any"))


@query(
    "i18n_missing",
    """SELECT doc_id, concat_ws(',', CASE WHEN lang <> 'en' THEN 'en' END, CASE WHEN lang <> 'de' THEN 'de' END) AS missing
    FROM documents""",
)
def i18n_missing(s, d):
    return texts(s, d).select("doc_id", F.array_join(i18n.missing_locales(F.col("name"), ("en", "de", "fr")), ",").alias("missing"))


@query("dictionary_labels", f"SELECT o_orderkey, d.en AS \"o_orderstatusLabel\" FROM orders LEFT JOIN {STATUS_SQL} ON d.key = o_orderstatus")
def dictionary_labels(s, d):
    return i18n.with_label(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", engine(s, d).dictionaries["status"], "en", ("th",)).select("o_orderkey", "o_orderstatusLabel")


@query(
    "dictionary_rename",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(count(*) AS BIGINT) AS n
    FROM orders
    GROUP BY 1""",
)
def dictionary_rename(s, d):
    _, (orders,) = i18n.dictionary_rename(engine(s, d).dictionaries["status"], "P", "X", [(read(s, d, "orders"), "o_orderstatus")])
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


#: Signatures that text can begin with, in the order of the table.
TEXT_MAGIC = (
    ("GIF8", "image/gif"), ("BM", "image/bmp"), ("8BPS", "image/vnd.adobe.photoshop"), ("%PDF", "application/pdf"), ("BZh", "application/x-bzip2"), ("LZIP", "application/x-lzip"),
    ("MSCF", "application/vnd.ms-cab-compressed"), ("fLaC", "audio/flac"), ("OggS", "application/ogg"), ("MThd", "audio/midi"), ("ID3", "audio/mpeg"), ("FLV", "video/x-flv"),
    ("MZ", "application/vnd.microsoft.portable-executable"), ("FWS", "application/x-shockwave-flash"), ("CWS", "application/x-shockwave-flash"),
    ("ZWS", "application/x-shockwave-flash"), ("PAR1", "application/vnd.apache.parquet"),
)
MIME_SQL = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{m}') THEN '{k}'" for m, k in TEXT_MAGIC) + f" WHEN {{0}} IS NOT NULL THEN '{files.UNKNOWN}' END AS mime"


@query(
    "mime_by_magic",
    f"""SELECT 'page' AS kind, page_id AS id, {MIME_SQL.format('html')}
    FROM pages
    UNION ALL SELECT 'word', doc_id, {MIME_SQL.format('upper(text)')}
    FROM documents""",
)
def mime_by_magic(s, d):
    """Kinds of the bytes of every page, and of every document in capitals."""
    pages = read(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), files.mime_type(F.encode("html", "UTF-8")).alias("mime"))
    docs = read(s, d, "documents").select(F.lit("word").alias("kind"), F.col("doc_id").alias("id"), files.mime_type(F.encode(F.upper("text"), "UTF-8")).alias("mime"))
    return pages.unionByName(docs)


@query("safe_filenames", r"SELECT page_id, regexp_replace(regexp_replace(url, '[<>:\"/\\|?*]', '_', 'g'), '[. ]+$', '') AS name FROM pages")
def safe_filenames(s, d):
    return read(s, d, "pages").select("page_id", files.safe_filename(F.col("url")).alias("name"))


# exports


CSV_SQL = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@query(
    "export_csv_lines",
    f"""SELECT doc_id || ',' || {CSV_SQL.format('lang')} || ',' || coalesce({CSV_SQL.format('text')}, '') AS line
    FROM documents""",
)
def export_csv_lines(s, d):
    """Whole texts, with their commas, quotes and line ends."""
    return exports.csv_lines(read(s, d, "documents").select("doc_id", "lang", "text"))


@query("export_ndjson", """SELECT '{"_schema":"documents","doc_id":' || doc_id || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}' AS line FROM documents WHERE text IS NOT NULL""")
def export_ndjson(s, d):
    return exports.json_lines(read(s, d, "documents").where("text is not null").select("doc_id", "text"), "documents")


def _folder(s: SparkSession, kind: str) -> str:
    import uuid

    return f"{shared_dir(s)}/{kind}/{uuid.uuid4()}"


@query("csv_round_trip", "SELECT doc_id, lang, nullif(text, '') AS text FROM documents")
def csv_round_trip(s, d):
    """All documents written as CSV and read back."""
    docs, at = read(s, d, "documents").select("doc_id", "lang", "text"), _folder(s, "csv")
    exports.write_lines(exports.csv_lines(docs), at)
    return exports.read_csv(s, at, docs.schema)


@query("xml_round_trip", "SELECT page_id, url, html FROM pages")
def xml_round_trip(s, d):
    """All pages, markup and all, written as XML elements and read back."""
    pages, at = read(s, d, "pages").select("page_id", "url", "html"), _folder(s, "xml")
    exports.write_xml(pages, "pages", at)
    return exports.read_xml(s, at, "pages", pages.schema)


@query("json_document_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_document_round_trip(s, d):
    """All turns written as JSON documents, one a partition, and read back."""
    turns, at = read(s, d, "conversations").select("conv_id", "turn", "role", "text"), _folder(s, "json")
    exports.write_json_documents(turns, "conversations", at)
    return exports.read_json_documents(s, at, "conversations", turns.schema)


@query(
    "archive_round_trip",
    """SELECT 'orders' AS collection, CAST(o_orderkey AS BIGINT) AS id, o_totalprice AS value
    FROM orders
    UNION ALL SELECT 'customer', c_custkey, c_acctbal
    FROM customer""",
)
def archive_round_trip(s, d):
    """Two collections written as an archive and read back with their schemas."""
    at = _folder(s, "archive")
    exports.write_archive({"orders": read(s, d, "orders"), "customer": read(s, d, "customer"), "_hidden": read(s, d, "nation")}, at)
    held = exports.read_archive(s, at)
    one = lambda n, k, v: held[n].select(F.lit(n).alias("collection"), F.col(k).cast("long").alias("id"), F.col(v).alias("value"))
    return one("orders", "o_orderkey", "o_totalprice").unionByName(one("customer", "c_custkey", "c_acctbal"))


@query(
    "dump_load_verify",
    """SELECT 'customer' AS collection, CAST(count(*) AS BIGINT) AS rows, true AS ok
    FROM customer
    UNION ALL SELECT 'orders', count(*), true
    FROM orders""",
)
def dump_load_verify(s, d):
    at = _folder(s, "dump")
    exports.dump({"orders": read(s, d, "orders"), "customer": read(s, d, "customer")}, at)
    return exports.verify_dump(s, at)


@query("load_dump", f"SELECT c_custkey, coalesce(new_bal, old_bal) AS c_acctbal FROM {DIFF_SQL}")
def load_dump(s, d):
    """A dump of edited customers, loaded over the live ones."""
    at = _folder(s, "dump")
    exports.dump({"customer": edited(s, d)}, at)
    return exports.load({"customer": (read(s, d, "customer"), "c_custkey")}, at)["customer"].select("c_custkey", "c_acctbal")


ULID_SQL = f"""WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS t, sha256(CAST(event_id AS VARCHAR)) AS h FROM events),
y AS (SELECT event_id, t, CAST('0x' || h[1:10] AS BIGINT) AS a, CAST('0x' || h[11:20] AS BIGINT) AS b FROM x)
SELECT event_id, array_to_string([substr('{files.ULID_DIGITS}', ((t >> (45 - 5 * i)) & 31) + 1, 1) FOR i IN range(10)], '')
|| array_to_string([substr('{files.ULID_DIGITS}', ((a >> (35 - 5 * i)) & 31) + 1, 1) FOR i IN range(8)], '')
|| array_to_string([substr('{files.ULID_DIGITS}', ((b >> (35 - 5 * i)) & 31) + 1, 1) FOR i IN range(8)], '') AS ulid FROM y"""


@query("ulids", ULID_SQL)
def ulids(s, d):
    """Sortable ids of all events; entropy is derived from the event, so that a task that runs again gives the same."""
    e = read(s, d, "events")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", files.ulid(millis, F.sha2(F.col("event_id").cast("string"), 256)).alias("ulid"))


@query(
    "blob_files",
    r"""WITH s AS (SELECT page_id, sha256(html) AS h, html, regexp_replace(replace(url, '\', '/'), '^/+', '') AS p FROM pages),
    b AS (SELECT h, any_value(html) AS html FROM s GROUP BY h), c AS (SELECT *, count(*) OVER (PARTITION BY p) AS n FROM s)
    SELECT CASE WHEN n > 1 THEN h[1:12] || '-' || p ELSE p END AS path, b.html AS content FROM c JOIN b USING (h)""",
)
def blob_files(s, d):
    """Pages as attachments, stored once by their hash, exported under names of their own."""
    pages = read(s, d, "pages").select("url", "html", F.sha2("html", 256).alias("hash"))
    blobs = pages.groupBy("hash").agg(F.first("html").alias("content"))
    return exports.blob_files(pages.select("url", "hash"), blobs, "url")


@query(
    "export_xml_lines",
    """SELECT '<Supplier><s_suppkey>' || s_suppkey || '</s_suppkey><s_name>' || replace(s_name, '&', '&amp;') || '</s_name></Supplier>' AS line
    FROM supplier""",
)
def export_xml_lines(s, d):
    return exports.xml_lines(read(s, d, "supplier").select("s_suppkey", "s_name"), "suppliers")


@query("export_sql_lines", "SELECT 'INSERT INTO \"part\" (\"p_partkey\", \"p_name\") VALUES (' || p_partkey || ', ''' || replace(p_name, '''', '''''') || ''');' AS line FROM part")
def export_sql_lines(s, d):
    return exports.sql_lines(read(s, d, "part").select("p_partkey", "p_name"), "part")


@query(
    "bundle_slice",
    """SELECT c_custkey AS id, CAST(c_custkey % 4 AS INTEGER) AS _tier, c_name
    FROM customer
    WHERE c_custkey % 4 <= 2 AND c_custkey > 100""",
)
def bundle_slice(s, d):
    return stores.slice_of(tiered(s, d), tier_at_most=2, where=F.col("id") > 100)


@query(
    "store_metrics",
    """SELECT event_type AS method, CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (value > 90) AS BIGINT) AS errors, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max, round(avg(value), 4) AS avg
    FROM events
    GROUP BY 1""",
)
def store_metrics(s, d):
    calls = read(s, d, "events").select(F.col("event_type").alias("method"), F.col("value").alias("ms"), (F.col("value") > 90).alias("error"))
    return stores.op_metrics(calls).drop("p90").withColumns({c: F.round(c, 4) for c in ("p50", "p99", "max", "avg")})


# plans from elsewhere


@query(
    "rest_where",
    """SELECT o_orderkey, o_totalprice
    FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 1000
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""",
)
def rest_where(s, d):
    return adapters.from_params(engine(s, d).query("orders"), {"where": ["o_orderstatus:eq:F", "o_totalprice:gte:1000"], "orderBy": "o_totalprice:desc", "limit": "30"}).to_df().select("o_orderkey", "o_totalprice")


@query(
    "table_state",
    """SELECT o_orderkey, o_orderpriority
    FROM orders
    WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '2-HIGH'
    ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40""",
)
def table_state(s, d):
    state = {"columnFilters": [{"id": "o_orderstatus", "value": ["O", "P"]}, {"id": "o_orderpriority", "value": "2-HIGH"}, {"id": "o_custkey", "value": ""}], "sorting": [{"id": "o_orderkey", "desc": True}], "pagination": {"pageIndex": 2, "pageSize": 20}}
    return adapters.from_table_state(engine(s, d).query("orders"), state).to_df().select("o_orderkey", "o_orderpriority")


@query("digest_lookup", "SELECT c_custkey, c_name FROM customer WHERE sha256(c_mktsegment) = sha256('BUILDING')")
def digest_lookup(s, d):
    """Equality search on a digest column, as over fields that are stored encrypted."""
    return engine(s, d).collections["customer"].find_by_digest("c_mktsegment", "BUILDING").select("c_custkey", "c_name")


# streaming


@query(
    "live_group_totals",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total
    FROM (SELECT *
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id
    ORDER BY event_id DESC) = 1)
    WHERE event_type <> 'error'
    GROUP BY 1""",
)
def live_group_totals(s, d):
    """A grouped live query over the newest event of each user, kept by a stream of several files, stopped and started again."""
    from .streaming.live import LiveState, change_stream

    folder, events = _folder(s, "live"), read(s, d, "events")
    n = 4
    for k in range(n):  # files arrive in two halves; all events are in one of them
        events.where(F.pmod("event_id", F.lit(n)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        if k % 2:
            changes = change_stream(s, f"{folder}/log", events.schema, files_a_batch=1).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
            live = LiveState(s, f"{folder}/state", "user_id", "event_id", "op")  # knows only what is in the folder
            live.start(changes, f"{folder}/checkpoint").awaitTermination()
    return live.rows().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("live_join_totals", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def live_join_totals(s, d):
    """A live join: orders come first, customers later; the value follows both sides."""
    from .streaming.live import LiveJoin, LiveState, change_stream

    folder, states = _folder(s, "livejoin"), {}
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        states[name] = LiveState(s, f"{folder}/{name}", key, key)
    joined = LiveJoin(states, lambda t: t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    for name, state in states.items():
        state.start(change_stream(s, f"{d}/{name}*.parquet", read(s, d, name).schema), f"{folder}/cp_{name}").awaitTermination()
    if joined.error:
        raise joined.error
    return s.createDataFrame(joined.value, "c_mktsegment string, n long")
