"""Projection and schema operators."""

from pyspark.sql import functions as F

from catalog.base import FLAGS, Tables, from_signal, query, r, rounded, rq, rule_case
from strandline.functions import scalars
from strandline.operators import columns
from strandline.operators.intervals import flag_by_rules


@query("project_select", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_select(t: Tables):
    return columns.project(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity")


@query(
    "project_rename_in_select",
    "SELECT p_partkey, p_retailprice AS price, p_brand AS brand FROM part",
)
def project_rename_in_select(t: Tables):
    return columns.project(t.part, "p_partkey", price="p_retailprice", brand="p_brand")


@query(
    "rename_columns",
    "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation",
)
def rename_columns(t: Tables):
    return columns.rename(t.nation, nation_id="n_nationkey", nation="n_name")


@query(
    "rename_with_regex",
    """SELECT s_suppkey AS "s suppkey", s_name AS "s name", s_nationkey AS "s nationkey",
              s_acctbal AS "s acctbal" FROM supplier""",
)
def rename_with_regex(t: Tables):
    return columns.rename_matching(t.supplier, "_", " ")


@query(
    "clean_names",
    """SELECT c_custkey AS cust_key, c_name AS full_name, c_nationkey AS nation_percent,
              c_acctbal AS acct_bal, c_mktsegment AS acct_bal_2 FROM customer""",
)
def clean_names(t: Tables):
    messy = t.customer.toDF("CustKey", " full  name", "Nation %", "Acct.Bal", "acct-bal")
    return columns.clean_names(messy)


@query("drop_columns", "SELECT * EXCLUDE (o_orderpriority, o_orderstatus) FROM orders")
def drop_columns(t: Tables):
    return columns.drop(t.orders, "o_orderpriority", "o_orderstatus")


@query(
    "select_range",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
       FROM lineitem""",
)
def select_range(t: Tables):
    li = t.lineitem
    return li.select("l_orderkey", *columns.span(li, "l_linenumber", "l_tax"))


@query(
    "derive_columns",
    f"""SELECT l_orderkey, l_linenumber, {rq('net', 4)} AS net, {rq('gross', 4)} AS gross,
               {rq('gross / l_quantity / 997e0')} AS per_unit
        FROM (SELECT *, net * (1 + l_tax) AS gross
              FROM (SELECT *, l_extendedprice / 997e0 * (1 - l_discount) AS net FROM lineitem))""",
)
def derive_columns(t: Tables):
    out = columns.derive(
        t.lineitem,
        {"net": F.col("l_extendedprice") / 997.0 * (1 - F.col("l_discount"))},
        {"gross": F.col("net") * (1 + F.col("l_tax"))},
        {"per_unit": F.col("gross") / F.col("l_quantity") / 997.0},
    )
    return out.select(
        "l_orderkey", "l_linenumber", r("net", 4).alias("net"), r("gross", 4).alias("gross"),
        r("per_unit").alias("per_unit"),
    )


@query(
    "cast_columns",
    """SELECT event_id, TRY_CAST(CASE WHEN value < 20 THEN 'n/a' ELSE CAST(value AS VARCHAR) END
                                 AS DOUBLE) AS volumetric_flow,
              TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS pressure
       FROM events""",
)
def cast_columns(t: Tables):
    text = t.events.select(
        "event_id",
        F.when(F.col("value") < 20, "n/a").otherwise(F.col("value").cast("string")).alias(
            "volumetric_flow"
        ),
        F.regexp_extract("props", r"(\d+)", 1).alias("pressure"),
    )
    return columns.to_double(text, columns.span(text, "volumetric_flow", "pressure"))


@query(
    "mask_by_flag",
    from_signal(
        f"""SELECT event_id, flag, CASE WHEN flag IN (0, 2) THEN ch1 END AS night_ch1,
                   CASE WHEN flag = 3 THEN NULL ELSE ch1 END AS za_ch1,
                   CASE WHEN flag = 0 THEN ch2 END AS good_ch2
            FROM (SELECT *, {rule_case(FLAGS)} AS flag FROM signal)"""
    ),
)
def mask_by_flag(t: Tables):
    flagged = flag_by_rules(t.signal(), FLAGS)
    return flagged.select(
        "event_id",
        "flag",
        scalars.keep_codes("ch1", "flag", [0, 2]).alias("night_ch1"),
        scalars.drop_codes("ch1", "flag", [3]).alias("za_ch1"),
        scalars.mask_unless(F.col("flag") == 0, "ch2").alias("good_ch2"),
    )


@query(
    "coalesce_fallback",
    from_signal(f"SELECT event_id, {rq('coalesce(ch1, ch2)')} AS measured FROM signal"),
)
def coalesce_fallback(t: Tables):
    out = t.signal().select(
        "event_id", scalars.coalesce_fallback("ch1", "ch2").alias("measured")
    )
    return rounded(out, "measured")


@query(
    "split_column_by_time",
    """SELECT o_orderkey,
              CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END AS before,
              CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN o_totalprice END AS after
       FROM orders""",
)
def split_column_by_time(t: Tables):
    before, after = scalars.split_at("o_totalprice", "o_orderdate", "1998-01-01")
    return t.orders.select("o_orderkey", before.alias("before"), after.alias("after"))
