"""Queries: dates, monthly trends, release versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import lexicons as lx
from revlens.functions import dates as dt
from revlens.functions import text as tx
from revlens.functions import versions as vr
from revlens.operators import trends as tr
from revlens.plans import sqltext as sq
from revlens.plans.catalog import query
from revlens.plans.fixtures import PARTS, reviews, table
from revlens.plans.q_labels import LISTS, TRUSTED, trusted
from revlens.plans.trust import aspect_trend

# A Solar Hijri calendar in SQL, built year by year from the leap years of the 33-year cycle.
CALENDAR = """years AS (SELECT y, CASE WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 366 ELSE 365 END AS days
           FROM range(1290, 1511) t(y)),
starts AS (SELECT y, days, DATE '1911-03-22' + CAST(coalesce(sum(days) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING
           AND 1 PRECEDING), 0) AS INT) AS first_day FROM years),
months AS (SELECT y, m, first_day + CAST(CASE WHEN m <= 6 THEN 31 * (m - 1) ELSE 186 + 30 * (m - 7) END AS INT) AS month_start,
           CASE WHEN m <= 6 THEN 31 WHEN m <= 11 THEN 30 WHEN days = 366 THEN 30 ELSE 29 END AS month_days
           FROM starts CROSS JOIN range(1, 13) r(m))"""

_YMD = "1300 + o_custkey % 200 AS y, 1 + o_orderkey % 13 AS m, 1 + (o_orderkey // 13) % 31 AS d"


def _parts(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", (1300 + F.col("o_custkey") % 200).alias("y"), (1 + F.col("o_orderkey") % 13).alias("m"),
        (1 + F.floor(F.col("o_orderkey") / 13) % 31).alias("d"),
    )


@query(
    "jalali_to_gregorian",
    f"""WITH {CALENDAR}, p AS (SELECT o_orderkey, {_YMD} FROM orders)
        SELECT o_orderkey, CASE WHEN p.d <= month_days THEN month_start + CAST(p.d - 1 AS INT) END AS gregorian
        FROM p LEFT JOIN months USING (y, m)""",
)
def _(spark, folder):
    rows = _parts(spark, folder)
    return rows.select("o_orderkey", dt.jalali_to_gregorian(F.col("y"), F.col("m"), F.col("d")).alias("gregorian"))


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


@query(
    "unify_date",
    f"""WITH {CALENDAR}, p AS (SELECT o_orderkey, o_orderdate, {_YMD} FROM orders)
        SELECT o_orderkey, CASE o_orderkey % 5
          WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 4 THEN NULL
          ELSE CASE WHEN p.d <= month_days THEN month_start + CAST(p.d - 1 AS INT) END END AS unified
        FROM p LEFT JOIN months USING (y, m)""",
)
def _(spark, folder):
    rows = _parts(spark, folder)
    y, m, d = _pad(F.col("y"), 4), _pad(F.col("m"), 2), _pad(F.col("d"), 2)
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, F.translate(F.concat_ws("/", y, m, d), tx.LATIN_DIGITS, tx.PERSIAN_DIGITS))
        .when(kind == 3, F.concat_ws("-", d, m, y))
        .otherwise("Unknown")
    )
    return rows.select("o_orderkey", dt.unify_date(text).alias("unified"))


@query(
    "parse_native_date",
    f"""WITH {CALENDAR}, p AS (SELECT o_orderkey, {_YMD} FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 AND p.d <= month_days THEN month_start + CAST(p.d - 1 AS INT) END AS parsed
        FROM p LEFT JOIN months USING (y, m)""",
)
def _(spark, folder):
    rows = _parts(spark, folder)
    slashed = F.concat_ws("/", F.col("y").cast("string"), F.col("m").cast("string"), F.col("d").cast("string"))
    dashed = F.concat_ws("-", F.col("y").cast("string"), F.col("m").cast("string"), F.col("d").cast("string"))
    text = F.when(F.col("o_orderkey") % 4 == 3, dashed).otherwise(
        F.concat(F.translate(slashed, tx.LATIN_DIGITS, tx.PERSIAN_DIGITS), F.lit(" ۱۲:۰۰"))
    )
    return rows.select("o_orderkey", dt.parse_native_date(text).alias("parsed"))


@query("month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", dt.month_key(F.col("o_orderdate").cast("date")).alias("month"))


_MONTHLY = 'SELECT {keys}last_day(date) AS "Month", avg("Composite_Trust") * 100 AS "Trust_Level_Pct" FROM {source} GROUP BY ALL'


def _dated(spark, folder):
    return trusted(spark, folder).withColumn("Unified_Date", F.col("date"))


@query("monthly_trust", sq.reviews(_MONTHLY.format(keys="", source="trusted"), *TRUSTED))
def _(spark, folder):
    return tr.monthly_trust(_dated(spark, folder))


@query(
    "union_ecosystems",
    sq.reviews(
        """SELECT CASE WHEN ecosystem = 'Global' THEN 'Global AI' ELSE 'Native AI' END AS "Ecosystem", last_day(date) AS "Month",
           avg("Composite_Trust") * 100 AS "Trust_Level_Pct" FROM trusted GROUP BY ALL""", *TRUSTED
    ),
)
def _(spark, folder):
    rows = _dated(spark, folder)
    return tr.union_ecosystems(
        {
            "Global AI": tr.monthly_trust(rows.filter(F.col("ecosystem") == "Global")),
            "Native AI": tr.monthly_trust(rows.filter(F.col("ecosystem") == "Native")),
        }
    )


@query(
    "monthly_trust_by_aspect",
    sq.reviews(_MONTHLY.format(keys='"Final_Aspect" AS "Aspect_EN", ', source="trusted"), *TRUSTED),
)
def _(spark, folder):
    rows = _dated(spark, folder).withColumn("Aspect_EN", tx.recode_label(F.col("Final_Aspect")))
    return tr.monthly_trust_by_aspect(rows)


_SMOOTH = """SELECT *, avg("Trust_Level_Pct") OVER (PARTITION BY "Aspect_EN" ORDER BY "Month" ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
             AS "Smoothed" FROM monthly"""


@query(
    "aspect_trend",
    sq.reviews(
        _SMOOTH, *TRUSTED, "monthly AS (" + _MONTHLY.format(keys='"Final_Aspect" AS "Aspect_EN", ', source="trusted") + ")"
    ),
)
def _(spark, folder):
    return aspect_trend(reviews(spark, folder, parts=PARTS), **LISTS)


@query(
    "rolling_mean_2",
    """WITH m AS (SELECT l_returnflag, last_day(l_shipdate) AS "Month", avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, "Month", round(v, 9) AS v,
         round((v + coalesce(lag(v) OVER w, v)) / 2, 9) AS "Smoothed" FROM m WINDOW w AS (PARTITION BY l_returnflag ORDER BY "Month")""",
)
def _(spark, folder):
    monthly = table(spark, folder, "lineitem").groupBy(
        "l_returnflag", dt.month_end(F.col("l_shipdate")).alias("Month")
    ).agg(F.avg("l_quantity").alias("v"))
    smooth = tr.rolling_mean_2(monthly, ["l_returnflag"], "Month", "v")
    return smooth.withColumn("v", F.round("v", 9)).withColumn("Smoothed", F.round("Smoothed", 9))


@query(
    "top4_aspect_trend",
    sq.reviews(
        _SMOOTH.replace('PARTITION BY "Aspect_EN"', 'PARTITION BY ecosystem, "Aspect_EN"'), *TRUSTED,
        "monthly AS ("
        + _MONTHLY.format(
            keys='ecosystem, "Final_Aspect" AS "Aspect_EN", ',
            source="""(SELECT * FROM trusted WHERE date BETWEEN DATE '2025-10-01' AND DATE '2026-06-30' AND ("""
            + " OR ".join(f"(ecosystem = {sq.quoted(e)} AND \"Final_Aspect\" IN ({', '.join(map(sq.quoted, tops))}))" for e, tops in lx.TOP_ASPECTS.items())
            + "))",
        )
        + ")",
    ),
)
def _(spark, folder):
    from revlens.operators import filters as fl

    rows = _dated(spark, folder).withColumn("Aspect_EN", tx.recode_label(F.col("Final_Aspect")))
    chosen = fl.isin_top_aspects(fl.date_range(rows, "Unified_Date"))
    keys = ["ecosystem", "Aspect_EN"]
    return tr.rolling_mean_2(tr.monthly_trust_by(chosen, keys), keys)


# Versions made of order fields: 0..119 . 0..23, some unknown, some with a leading zero.
_VERSION_SQL = """versions AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'Unknown' WHEN o_orderkey % 19 = 0 THEN 'null'
  WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'beta'
  ELSE concat(CAST(o_custkey % 120 AS VARCHAR), '.', CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '' END, CAST(o_orderkey % 24 AS VARCHAR), '.3') END AS v
  FROM orders)"""


def _versions(spark, folder):
    k = F.col("o_orderkey")
    made = F.concat(
        (F.col("o_custkey") % 120).cast("string"), F.lit("."), F.when(k % 5 == 0, "0").otherwise(""),
        (k % 24).cast("string"), F.lit(".3"),
    )
    v = F.when(k % 17 == 0, "Unknown").when(k % 19 == 0, "null").when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, "beta")
    return table(spark, folder, "orders").select("o_orderkey", v.otherwise(made).alias("v"))


@query(
    "version_major_minor",
    f"WITH {_VERSION_SQL} SELECT o_orderkey, TRY_CAST(regexp_extract(v, '^(\\d+\\.\\d+)', 1) AS DOUBLE) AS version FROM versions",
)
def _(spark, folder):
    return _versions(spark, folder).select("o_orderkey", vr.version_major_minor(F.col("v")).alias("version"))


@query(
    "version_bounded",
    f"""WITH {_VERSION_SQL} SELECT o_orderkey, CASE WHEN TRY_CAST(split_part(v, '.', 1) AS INT) <= 100 AND
        TRY_CAST(split_part(v, '.', 2) AS INT) <= 999 THEN CAST(concat(CAST(split_part(v, '.', 1) AS INT), '.',
        CAST(split_part(v, '.', 2) AS INT)) AS DOUBLE) END AS version FROM versions""",
)
def _(spark, folder):
    return _versions(spark, folder).select("o_orderkey", vr.version_bounded(F.col("v")).alias("version"))


_VERSIONED = """versioned AS (SELECT *, TRY_CAST(regexp_extract(app_version, '^(\\d+\\.\\d+)', 1) AS DOUBLE) AS "Major_Minor_Version" FROM trusted)"""
_BY_VERSION = """by_version AS (SELECT "Major_Minor_Version", avg("Composite_Trust") * 100 AS "Trust_Level_Pct", count(*) AS reviews
                 FROM versioned WHERE "Major_Minor_Version" IS NOT NULL GROUP BY 1)"""


def _versioned(spark, folder):
    return trusted(spark, folder).withColumn("Major_Minor_Version", vr.version_major_minor(F.col("app_version")))


@query("trust_by_version", sq.reviews("SELECT * FROM by_version ORDER BY 1", *TRUSTED, _VERSIONED, _BY_VERSION))
def _(spark, folder):
    return tr.trust_by_version(_versioned(spark, folder))


@query(
    "top_versions",
    sq.reviews(
        'SELECT * FROM (SELECT * FROM by_version ORDER BY reviews DESC, "Major_Minor_Version" LIMIT 5) ORDER BY 1',
        *TRUSTED, _VERSIONED, _BY_VERSION,
    ),
)
def _(spark, folder):
    return tr.top_versions(tr.trust_by_version(_versioned(spark, folder)), 5)


@query(
    "low_trust_events",
    sq.reviews('SELECT * FROM by_version WHERE "Trust_Level_Pct" < 60', *TRUSTED, _VERSIONED, _BY_VERSION),
)
def _(spark, folder):
    return tr.low_trust_events(tr.trust_by_version(_versioned(spark, folder)), 60)


@query(
    "min_support",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       JOIN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30) USING (l_partkey)""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return tr.min_support(rows, ["l_partkey"], 30)


@query(
    "top_apps",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
       (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 6)""",
)
def _(spark, folder):
    return tr.top_apps(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), 6, "o_custkey")


_SHIP = "SELECT l_suppkey, l_shipdate, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL"


@query(
    "last_n_per_group",
    f"SELECT * FROM ({_SHIP}) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) <= 10",
)
def _(spark, folder):
    days = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_linenumber").alias("n"))
    return tr.last_n_per_group(days, "l_suppkey", "l_shipdate", 10)


@query(
    "stage_dense_rank",
    """SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY version) AS "Stage_Num",
         concat('Stage ', dense_rank() OVER (PARTITION BY l_suppkey ORDER BY version)) AS "Display_Version"
       FROM (SELECT DISTINCT l_suppkey, l_quantity AS version, l_linenumber FROM lineitem)""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_suppkey", F.col("l_quantity").alias("version"), "l_linenumber").distinct()
    return tr.stage_dense_rank(rows, "l_suppkey", "version")


@query(
    "release_stages",
    sq.reviews(
        """SELECT *, dense_rank() OVER (PARTITION BY app_label ORDER BY "Clean_Version") AS "Stage_Num",
             concat('Stage ', dense_rank() OVER (PARTITION BY app_label ORDER BY "Clean_Version")) AS "Display_Version"
           FROM (SELECT * FROM supported WHERE app_label IN (SELECT app_label FROM supported GROUP BY 1 ORDER BY sum(reviews) DESC, 1 LIMIT 6)
                 QUALIFY row_number() OVER (PARTITION BY app_label ORDER BY "Clean_Version" DESC) <= 4)""",
        *TRUSTED, _VERSIONED.replace("Major_Minor_Version", "Clean_Version"),
        """supported AS (SELECT app_label, "Clean_Version", avg("Composite_Trust") * 100 AS "Trust_Level_Pct", count(*) AS reviews
           FROM versioned WHERE "Clean_Version" IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)""",
    ),
)
def _(spark, folder):
    rows = trusted(spark, folder).withColumn("Clean_Version", vr.version_bounded(F.col("app_version")))
    return tr.release_stages(rows, support=2, last=4)
