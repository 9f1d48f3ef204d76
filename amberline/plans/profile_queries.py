"""Profiles and statistics over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.functions.text import age_band, is_blank
from amberline.operators import profile, stats
from amberline.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: The customer table with blanks, nulls, a constant and a nearly constant column put in.
SPOILED = """spoiled as (
    select c_custkey, case when c_custkey % 7 = 0 then ' ' when c_custkey % 11 = 0 then null else c_mktsegment end as segment,
           case when c_custkey % 5 = 0 then null else c_acctbal end as balance, case when c_custkey % 25 <> 0 then null else c_nationkey end as sparse,
           'L' as fixed, case when c_custkey % 500 = 0 then 'y' else 'x' end as flag, c_name, c_nationkey
    from customer)"""
COLUMNS = ["c_custkey", "segment", "balance", "sparse", "fixed", "flag", "c_name", "c_nationkey"]
KINDS = {"c_custkey": "int", "segment": "string", "balance": "float", "sparse": "int", "fixed": "string", "flag": "string", "c_name": "string", "c_nationkey": "int"}


def spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k, F.when(k % 7 == 0, " ").when(k % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 5 == 0, None).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(k % 25 != 0, None).otherwise(F.col("c_nationkey")).alias("sparse"), F.lit("L").alias("fixed"), F.when(k % 500 == 0, "y").otherwise("x").alias("flag"), "c_name", "c_nationkey",
    )


def _inventory_sql(where: str = "") -> str:
    parts = [
        f"""select '{c}' as "column", {i} as position, '{KINDS[c]}' as dtype, count({c}) as non_null, round(100 * (1 - count({c}) / count(*)), 4) as pct_missing,
            round(100 * {f"count(*) filter (trim({c}) = '')" if KINDS[c] == "string" else "0"} / count(*), 4)::double as pct_blank, count(distinct {c}) as n_unique from spoiled"""
        for i, c in enumerate(COLUMNS)
    ]
    return f"with {SPOILED}, inv as ({' union all '.join(parts)}) select * from inv {where}"


@query(_inventory_sql())
def column_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inventory(spoiled(spark, sf_dir))


@query(_inventory_sql().replace("select * from inv ", "select dtype, count(*) as n_columns from inv group by dtype"))
def dtype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inventory(spoiled(spark, sf_dir)).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


@query(_inventory_sql().replace("select * from inv ", 'select "column", pct_missing from inv order by pct_missing desc, "column" limit 3'))
def top_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inventory(spoiled(spark, sf_dir)).select("column", "pct_missing").orderBy(F.desc("pct_missing"), "column").limit(3)


@query(_inventory_sql().replace("select * from inv ", 'select "column", pct_missing from inv where pct_missing > 90'))
def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inventory(spoiled(spark, sf_dir)).where("pct_missing > 90").select("column", "pct_missing")


@query(_inventory_sql().replace("select * from inv ", "select \"column\", n_unique from inv where dtype = 'string' and n_unique > 50"))
def high_cardinality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inventory(spoiled(spark, sf_dir)).where("dtype = 'string' and n_unique > 50").select("column", "n_unique")


@query(f"with {SPOILED} select round(avg(case when trim(segment) = '' then 1.0 else 0.0 end), 6) as blank_share from spoiled")
def blank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoiled(spark, sf_dir).agg(F.round(F.avg(is_blank(F.col("segment")).cast("double")), 6).alias("blank_share"))


_MELT = " union all ".join(f"""select '{c}' as "column", {c}::varchar as value from spoiled""" for c in COLUMNS)


@query(f"""with {SPOILED}, melt as ({_MELT}), n as (select "column", value, count(*) as n from melt group by all)
    select "column", round(100.0 * max(n) / sum(n), 2) as top_value_pct from n group by 1 having max(n) / sum(n) > 0.99""")
def near_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.near_constant(spoiled(spark, sf_dir), COLUMNS)


@query(f"""with {SPOILED}, melt as ({_MELT}), n as (select "column", value from melt group by all)
    select "column" from n group by 1 having count(*) = 1""")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.constant(spoiled(spark, sf_dir), COLUMNS)


@query("""select * from (values ('l_orderkey', 'keys'), ('l_partkey', 'keys'), ('l_suppkey', 'keys'), ('l_linenumber', 'order'), ('l_quantity', 'amounts'), ('l_extendedprice', 'amounts'),
    ('l_discount', 'amounts'), ('l_tax', 'amounts'), ('l_returnflag', 'status'), ('l_linestatus', 'status'), ('l_shipdate', 'order')) as t("column", "group")""")
def column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = {"l_orderkey": "keys", "l_partkey": "keys", "l_suppkey": "keys", "l_quantity": "amounts", "l_extendedprice": "amounts", "l_discount": "amounts", "l_tax": "amounts", "l_returnflag": "status", "l_linestatus": "status"}
    return spark.createDataFrame(list(profile.assign_groups(table(spark, sf_dir, "lineitem").columns, explicit, {"l_line": "order", "l_ship": "order"}).items()), "column string, group string")


_YYMM = "(year(o_orderdate) % 100 * 100 + month(o_orderdate))"


@query(f"""with d as (select case when o_orderkey % 9 = 0 then 0 else {_YYMM} end as first_date, case when o_orderkey % 4 = 0 then null else {_YYMM} end as last_date from orders)
    select 'first_date' as field, min(first_date)::bigint as low, max(first_date)::bigint as high, count(*) filter (first_date = 0) as zeros, count(first_date) as filled from d
    union all select 'last_date', min(last_date), max(last_date), count(*) filter (last_date = 0), count(last_date) from d""")
def range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    yymm = (F.year("o_orderdate") % 100 * 100 + F.month("o_orderdate")).cast("long")
    d = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(yymm).alias("first_date"), F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(yymm).alias("last_date"))
    facts = [F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("low"), F.col(f"h_{c}").alias("high"), F.col(f"z_{c}").alias("zeros"), F.col(f"n_{c}").alias("filled")) for c in d.columns]
    return d.agg(*(x for c in d.columns for x in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"), F.count_if(F.col(c) == 0).alias(f"z_{c}"), F.count(c).alias(f"n_{c}")))).select(F.inline(F.array(*facts)))


@query(f"""with {SPOILED} select count(*) filter (balance is null and segment is null) as both_missing, count(*) filter (c_nationkey = 0) as zero_codes,
    count(*) filter (c_nationkey = 0 and balance is null) as zero_and_missing, min(case when balance > 0 then balance end) as least_positive, count(*) filter (balance < 20) as under_20, count(*) filter (balance <= 5) as at_most_5 from spoiled""")
def sentinel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, missing = F.col("balance"), F.col("balance").isNull()
    return spoiled(spark, sf_dir).agg(
        F.count_if(missing & F.col("segment").isNull()).alias("both_missing"), F.count_if(F.col("c_nationkey") == 0).alias("zero_codes"), F.count_if((F.col("c_nationkey") == 0) & missing).alias("zero_and_missing"),
        F.min(F.when(b > 0, b)).alias("least_positive"), F.count_if(b < 20).alias("under_20"), F.count_if(b <= 5).alias("at_most_5"),
    )


@query("select p_type as code from (select case when p_partkey % 50 = 0 then p_name else p_type end as p_type from part) group by 1 having count(*) = 1")
def rare_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("code")


LINES = "lines as (select l_linestatus, year(l_shipdate)::varchar as year, l_extendedprice as amount, l_quantity, l_tax, nullif(l_discount, 0) as discount, (l_returnflag = 'R')::int as y from lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_linestatus", F.year("l_shipdate").cast("string").alias("year"), F.col("l_extendedprice").alias("amount"), "l_quantity", "l_tax", F.nullif("l_discount", F.lit(0.0)).alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query(f"with {LINES} select count(*) as n, sum(y)::bigint as positives, round(avg(y), 6) as rate, round((1 - avg(y)) / avg(y), 6) as negatives_per_positive from lines")
def target_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.target_rate(lines(spark, sf_dir), "y")


@query(f"""with {LINES} select count(amount) as n, round(min(amount), 4) as min, round(quantile_cont(amount, 0.25), 4) as q25, round(quantile_cont(amount, 0.5), 4) as median,
    round(quantile_cont(amount, 0.75), 4) as q75, round(max(amount), 4) as max, round(avg(amount), 4) as mean, round(stddev_samp(amount), 4) as std from lines where y = 1""")
def describe_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(lines(spark, sf_dir).where("y = 1"), "amount")


@query(f"""with {LINES} select unnest([0.01, 0.5, 0.99])::double as share, round(unnest([quantile_cont(amount, 0.01), quantile_cont(amount, 0.5), quantile_cont(amount, 0.99)]), 4) as value from lines""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranked_quantiles(lines(spark, sf_dir), "amount", [0.01, 0.5, 0.99]).select("share", F.round("value", 4).alias("value"))


@query(f"with {LINES}, n as (select l_quantity as value, count(*) as n from lines group by 1) select value, n, round(n / (select count(*) from lines), 6) as share from n order by n desc, value limit 10")
def mode_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.modes(lines(spark, sf_dir), "l_quantity", 10)


@query(f"with {LINES} select round(avg((l_quantity in (5, 10, 15, 20, 25))::int), 6) as in_set, round(avg((l_quantity % 5 = 0)::int), 6) as multiple_of_5 from lines")
def round_amount_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return lines(spark, sf_dir).agg(F.round(F.avg(q.isin(5, 10, 15, 20, 25).cast("int")), 6).alias("in_set"), F.round(F.avg((q % 5 == 0).cast("int")), 6).alias("multiple_of_5"))


@query(f"with {LINES} select (floor(amount / 1000) * 1000)::double as bin_low, count(*) as n from lines group by 1")
def amount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(lines(spark, sf_dir), "amount", 1000.0)


@query(f"with {LINES} select least(floor((l_quantity - 1.0) / ((50.0 - 1.0) / 10)), 9)::bigint as bin, count(*) as n from lines where l_quantity between 1 and 50 group by 1")
def edge_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_histogram(lines(spark, sf_dir), "l_quantity", 1.0, 50.0, 10)


@query("""with b as (select c_acctbal as v from customer) select case when v <= 0 then -1 else least(floor((log10(v) - 0.0) / ((4.0 - 0.0) / 60)), 59) end::bigint as bin, count(*) as n
    from b where v <= 0 or log10(v) between 0 and 4 group by 1""")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_histogram(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 4.0, 60, log=True)


_ERFC = "(1 / (1 + 0.5 * x)) * exp(-x * x + ("
_poly = "0.17087277"
for _k in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
    _poly = f"({_poly} * (1 / (1 + 0.5 * x)) + {_k})"


@query(f"""with {LINES}, melt as (select 'discount' as "column", discount is null as missing, y from lines union all select 'tax', nullif(l_tax, 0.0) is null, y from lines),
    t as (select "column", count(*) filter (missing and y = 1)::double as a, count(*) filter (missing and y = 0)::double as b, count(*) filter (not missing and y = 1)::double as c, count(*) filter (not missing and y = 0)::double as d from melt group by 1),
    x as (select *, (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0.0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) as chi from t), z as (select *, sqrt(chi / 2) as x from x)
    select "column", (a + b)::bigint as n_missing, round(a / (a + b), 6) as rate_missing, round(c / (c + d), 6) as rate_present, round(100 * (a / (a + b) - c / (c + d)), 4) as diff_pp,
           round((a / (a + b)) / (c / (c + d)), 6) as ratio, round(chi, 4) as chi2, round({_ERFC}{_poly})), 5) as p_value from z""")
def missing_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return stats.missing_against_target(df, ["discount", "tax"], "y")


def _wilson_sql(segment: str, source: str) -> str:
    return f"""select {segment} as segment, count(*) as n, sum(y)::bigint as responders, round(sum(y) / count(*), 6) as rate,
        round(greatest((avg(y) + 3.8416 / (2 * count(*)) - 1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))) / (1 + 3.8416 / count(*)), 0.0), 6) as ci_low,
        round(least((avg(y) + 3.8416 / (2 * count(*)) + 1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))) / (1 + 3.8416 / count(*)), 1.0), 6) as ci_high
        from {source} where {segment} is not null group by 1"""


@query(f"with {LINES} {_wilson_sql('year', 'lines')}")
def response_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.response_by_segment(lines(spark, sf_dir), "year", "y")


_BAND = "case when age >= 80 and age < 100 then '80-99' when age >= 20 and age < 80 then (floor(age / 10) * 10)::int || '-' || ((floor(age / 10) * 10)::int + 9) end"


@query(f"with c as (select c_custkey % 110 as age, (c_acctbal > 5000)::int as y from customer), b as (select {_BAND} as band, y from c) {_wilson_sql('band', 'b')}")
def response_by_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(age_band(F.col("c_custkey") % 110, None).alias("band"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    return stats.response_by_segment(c, "band", "y")


@query(f"with {LINES}, s as ({_wilson_sql('year', 'lines')}) select max(rate) as highest, min(rate) as lowest, round(max(rate) / nullif(min(rate), 0), 4) as ratio from s")
def segment_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.response_by_segment(lines(spark, sf_dir), "year", "y")
    return s.agg(F.max("rate").alias("highest"), F.min("rate").alias("lowest"), F.round(F.try_divide(F.max("rate"), F.min("rate")), 4).alias("ratio"))


@query(f"with {SPOILED} select segment, count(*) as n from spoiled group by 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoiled(spark, sf_dir).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {LINES} select round(skewness(amount), 5) as amount_skew, round(skewness(discount), 5) as discount_skew from lines")
def skew_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(F.round(stats.skew_g1("amount"), 5).alias("amount_skew"), F.round(stats.skew_g1("discount"), 5).alias("discount_skew"))


_NUMBERS = ["amount", "l_quantity", "l_tax", "discount", "y"]
_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lines" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :])


@query(f"with {LINES} {_PAIRS}")
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(lines(spark, sf_dir), _NUMBERS)


@query(f"with {LINES}, p as ({_PAIRS}) select a, b, abs(r) as strength from p order by abs(r) desc, a, b limit 4")
def top_collinear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.correlations(lines(spark, sf_dir), _NUMBERS)
    return own.select("a", "b", F.abs("r").alias("strength")).orderBy(F.desc("strength"), "a", "b").limit(4)
