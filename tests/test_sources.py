"""Files in and out, store replies, survey, reports."""

import json

import pytest
from pyspark.sql import functions as F

from revlens import schema as sc
from revlens.operators import stats as st
from revlens.operators import trends as tr
from revlens.session import build_session, materialised, scratch_path
from revlens.sources import reviews as src
from revlens.sources import sinks, survey

ROW = ("1", "u", 'He said "hi",\nthen left', 5, "2025-10-01 10:00:00", "2025-10-01", "10:00:00", "1.2", None, "Bot", "en")


def test_csv_round_trip_with_bom_quotes_and_line_breaks(spark, tmp_path):
    header = ",".join(sc.RAW_REVIEW.names)
    (tmp_path / "balanced_data_Bot_en_us.csv").write_text(
        "﻿" + header + '\n1,u,"He said ""hi"",\nthen left",5,2025-10-01 10:00:00,2025-10-01,10:00:00,1.2,,Bot,en\n',
        encoding="utf-8",
    )
    (tmp_path / "native_data_Roo_cafebazaar.csv").write_text(header + "\n2,v,خوب,4,x,۱۴۰۴/۰۷/۰۹,00:00:00,,,Roo,fa\n", encoding="utf-8")
    df = src.with_file_meta(src.read_reviews(spark, str(tmp_path))).orderBy("review_id")
    a, b = df.collect()
    assert tuple(a[:11]) == ROW and a._source == "balanced_data_Bot_en_us"
    assert (a.platform_type, a.Ecosystem, a.file_lang, a.file_app, a.file_country) == ("Global", "Global", "en_us", "Bot", "us")
    assert (b.platform_type, b.Ecosystem, b.file_lang, b.file_app, b.file_country) == ("Native", "Native", "fa_ir", "Roo", None)


@pytest.mark.parametrize(
    ("path", "name"),
    [
        ("file:/x/balanced_data_A_en_us.csv", "balanced_data_A_en_us"),
        ("file:/x/file=native_data_A_cafebazaar/part-0000-uuid.c000.csv", "native_data_A_cafebazaar"),
        ("file:/x/data_A_en_us_2026_04.csv/part-0000.csv", "data_A_en_us_2026_04"),
    ],
)
def test_source_name(one, path, name):
    assert one([path], lambda d: src.source_name(F.col("x"))) == [name]


def test_old_style_names(spark):
    df = src.with_file_meta(spark.createDataFrame([("data_Chat_fa_ir_2026_04",), ("Chat_x",)], "_source string")).collect()
    assert [(r.platform_type, r.file_app, r.file_country) for r in df] == [("Unknown", "Chat", "ir"), ("Unknown", "Chat", None)]


def test_select_files(spark):
    names = ["a", "a_train", "a_labeled", "a_ready_for_ml"]
    df = spark.createDataFrame([(n,) for n in names], "_source string")
    assert [r[0] for r in src.select_files(df).collect()] == ["a", "a_train"]
    assert [r[0] for r in src.select_files(df, ("_train",)).collect()] == ["a_train"]
    assert [r[0] for r in src.select_files(df, ("_labeled",)).collect()] == ["a_labeled"]


def test_payload_defaults(spark):
    full = {"id": 7, "user": "u", "comment": " خوب ", "rate": 5, "date": "۱۴۰۴/۰۷/۰۹", "appVersion": "1.2", "reply": "r"}
    pages = [
        {"singleReply": {"reviewReply": {"reviews": [full, {"comment": "x"}, {"id": 8, "comment": ""}, {"id": 9}]}}},
        {"singleReply": {"reviewReply": {"reviews": []}}},
        {"properties": {"statusCode": 400}},
    ]
    df = spark.createDataFrame([(json.dumps(p),) for p in pages], "payload string")
    a, b = src.parse_store_payload(df, F.lit("Roo")).orderBy(F.col("score").desc()).collect()
    assert tuple(a) == ("bazaar_Roo_7", "u", "خوب", 5, "۱۴۰۴/۰۷/۰۹", "۱۴۰۴/۰۷/۰۹", "00:00:00", "1.2", "r", "Roo", "fa")
    assert b.review_id.startswith("bazaar_Roo_") and (b.user_name, b.score, b.date, b.app_version) == ("Unknown", 0, "Unknown", "Unknown")
    again = src.parse_store_payload(df, F.lit("Roo")).filter("score = 0").first().review_id
    assert again == b.review_id


def test_normalise_defaults(spark):
    df = spark.createDataFrame(
        [("9", None, "text", None, "2026-04-05 06:07:08", None, None, "A", "en")],
        "review_id string, user_name string, content string, score int, at string, app_version string, developer_reply string, app_label string, lang string",
    )
    r = src.normalise_review(df).first()
    assert tuple(r) == ("9", "Unknown", "text", 0, "2026-04-05 06:07:08", "2026-04-05", "06:07:08", "Unknown", None, "A", "en")
    ios = src.normalise_review(df.withColumn("title", F.lit("T")), title="title", ios=True).first()
    assert (ios.review_id, ios.content) == ("ios_user_20260405060708", "T. text")


def test_stage_is_pruned_by_ecosystem(spark):
    df = spark.createDataFrame([("1", "Global"), ("2", "Native")], "review_id string, ecosystem string")
    path = scratch_path(spark, "stage")
    sinks.write_stage(df, path)
    stored = spark.read.parquet(path).filter("ecosystem = 'Native'")
    assert [r.review_id for r in stored.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(ecosystem" in stored._jdf.queryExecution().executedPlan().toString()


def test_report_and_lexicon_files(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*.csv"))) == 1
    (tmp_path / "lex.csv").write_text("priority,label,word\n2,B,x\n1,A,y\n1,A,z\n")
    assert src.read_lexicon(spark, str(tmp_path / "lex.csv")) == {"A": ["y", "z"], "B": ["x"]}
    sinks.write_report(spark.range(10).repartition(3).selectExpr("id"), str(tmp_path / "many"), single_file=False)
    assert len(list((tmp_path / "many").glob("part-*.csv"))) == 3


def test_survey_by_position(spark, tmp_path):
    names = [f"q{i}" for i in range(64)]
    answers = ["کاملاً مخالفم", "موافقم", "کاملاً موافقم", "قابل ارزیابی نیست"]
    lines = [",".join(names), ",".join(["note"] * 64), ",".join(["note"] * 64)]
    lines += [",".join([answers[i % 4]] * 64) for i in range(8)]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = survey.read_survey(spark, str(tmp_path / "s.csv"))
    assert df.count() == 8
    out = survey.survey_reliability(df).collect()
    # Equal answers in a block: perfect agreement; two of eight people skipped.
    assert len(out) == 6 and all(r.alpha == 1.0 and r.answers == 6 and r.status == "good" for r in out)


def test_alpha_without_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    r = st.cronbach_alpha(df, {"x": ["a", "b"]}).first()
    assert (r.answers, r.alpha, r.status) == (0, None, "no data")


def test_reports_on_edges(spark):
    df = spark.createDataFrame(
        [("Global", "a", "x y", 5, None), ("Global", "a", None, 3, "r"), (None, "a", "z", 1, None)],
        "platform_type string, app_label string, content string, score int, developer_reply string",
    )
    assert [tuple(r) for r in st.app_basic_stats(df).collect()] == [("Global", "a", 1, 4.0)]
    assert [tuple(r) for r in st.reply_rate(df).collect()] == [("Global", 1, 1, 100.0)]
    nulls = {r.column_name: (r.null_count, r.null_percentage) for r in st.null_report(df).collect()}
    assert nulls["content"] == (1, 33.33) and nulls["score"] == (0, 0.0)
    empty = st.confusion_matrix(df.filter("false").selectExpr("app_label a", "app_label b"), "a", "b", ["p", "q"]).collect()
    assert [(r.n, r.row_pct) for r in empty] == [(0, 0.0)] * 4


def test_trend_windows(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 4, 50.0), ("b", 2, 7.0)], "k string, Month int, v double")
    out = tr.rolling_mean_2(df, ["k"], "Month", "v").orderBy("k", "Month").collect()
    assert [r.Smoothed for r in out] == [10.0, 20.0, 40.0, 7.0]
    versions = spark.range(40).select((F.col("id") % 20).cast("double").alias("Major_Minor_Version"), F.lit(1).alias("Composite_Trust"))
    by = tr.trust_by_version(versions)
    assert tr.top_versions(by).count() == 15 and tr.top_versions(by.limit(4)).count() == 4


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    stored = materialised(spark.range(5), "ids")
    assert stored.count() == 5 and build_session() is not None


def test_balance_classes(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1800, 1).otherwise(0).alias("c"))
    counts = {r.c: r["count"] for r in sinks.balance_classes(df, "c", "id").groupBy("c").count().collect()}
    assert counts[0] == 200 and 140 < counts[1] < 260


def test_survey_notes_go_in_every_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("q1,q2\nnote,1\nnote,2\n5,x\n6,y\n")
    out = survey.read_survey(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("5", "x"), ("5", "x"), ("6", "y"), ("6", "y")]
    assert out.columns == ["q1", "q2"]


def test_block_of_one_item_has_no_alpha(spark):
    out = st.cronbach_alpha(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0)], "a double, b double"), {"x": ["a"], "y": ["a", "b"]})
    one_, two = out.orderBy("block").collect()
    assert (one_.alpha, one_.status) == (None, "no data") and two.alpha > 0.9
