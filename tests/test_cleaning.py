import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom import names as N
from riskloom.functions import text
from riskloom.operators import cleaning, contracts, features
from riskloom.sources import catalog, files, publish


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return df.select(expr).first()[0]


def test_raw_csv_round_trip_keeps_text_and_accents(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes("Order Id,order date (DateOrders),City\n007,1/31/2018 22:56,Bogotá\n".encode("iso-8859-1"))
    df = files.sanitize_columns(files.read_raw_csv(spark, str(path)))
    assert df.columns == ["Order_Id", "order_date_DateOrders", "City"]
    assert df.first() == ("007", "1/31/2018 22:56", "Bogotá")


def test_column_mapping_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], ["a (b)", "plain"])
    assert [tuple(r) for r in files.column_mapping(df).collect()] == [(1, "a (b)", "a_b", True), (2, "plain", "plain", False)]
    assert files.clean_name("_source_file") == "source_file"
    assert files.clean_name("_source_file", keep_leading_underscore=True) == "_source_file"
    with pytest.raises(ValueError, match="collide"):
        files.sanitize_columns(spark.createDataFrame([(1, 2)], ["a b", "a_b"]))


SPEC = cleaning.SilverSpec(integers=["n"], doubles=["x"], timestamps=["t"], text=["s"], watched_gaps=["s"])
ROWS = [(" 12 ", "1.5", "1/31/2018 22:56", "  a   b "), ("x", " ", "31/31/2018", "   "), (None, "oops", None, None)]


def test_silver_is_null_on_failure(spark):
    raw = spark.createDataFrame(ROWS, "n STRING, x STRING, t STRING, s STRING")
    got = [tuple(r)[:4] for r in cleaning.clean_silver(raw, SPEC).collect()]
    assert got == [(12, 1.5, dt.datetime(2018, 1, 31, 22, 56), "a b"), (None,) * 4, (None,) * 4]


def test_integers_from_decimal_text(spark):
    for raw, want in {"3.0": 3, "12.7": 12, " -4.5 ": -4, "5.": 5, "1e3": None, ".": None, "x.1": None, "99999999999.5": None}.items():
        assert one(spark, cleaning.integer_or_null(F.col("a")), a=raw) == want


def test_quality_report_counts_failures_not_gaps(spark):
    raw = spark.createDataFrame(ROWS, "n STRING, x STRING, t STRING, s STRING")
    got = {r["metric_name"]: r["metric_value"] for r in cleaning.quality_report(raw, cleaning.clean_silver(raw, SPEC).limit(2), SPEC, expected_rows=3).collect()}
    assert got["silver_row_count"] == "2" and got["dropped_row_count"] == "1"
    assert got["bronze_row_count"] == "3" and got["expected_bronze_rows"] == "3"
    assert got["invalid_integer_cast_n"] == "1" and got["invalid_decimal_cast_x"] == "1"
    assert got["invalid_timestamp_parse_t"] == "1" and got["missing_s"] == "2"


def test_tokens_and_labels(spark):
    assert one(spark, text.text_token("a"), a="  Two\t Words ") == "two_words"
    assert one(spark, text.location_token("a"), a=" São  Paulo (SP) ") == "so_paulo_sp"
    assert one(spark, text.label_or("a", "none"), a="") == "none"
    assert one(spark, text.composite_key("a", "b"), a=None, b="x") == "x"
    assert one(spark, text.equality_flag("a", "b"), a=None, b=None) == 0
    for raw, shown in {"Países-Bajos": "Netherlands", "ESPAÑA": "Spain", "mxico": "Mexico", "new_place": "New Place"}.items():
        assert one(spark, text.country_label("a"), a=raw) == shown


def test_feature_defaults_for_missing_values(spark):
    df = spark.createDataFrame([(None, None), (1, "Standard  Class")], "d INT, m STRING")
    cols = features.shipping_columns("d", "m")
    rows = df.select(*[e.alias(n) for n, e in cols.items()]).collect()
    assert rows[0]["shipping_speed_tier"] == "economy" and rows[0]["is_standard_shipping"] == 0
    assert rows[1]["shipping_speed_tier"] == "expedited" and rows[1]["is_same_day_or_next_day_shipping"] == 1


def test_contract_lists_every_problem(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, 9)], "k INT, s STRING, v INT")
    contract = contracts.Contract(types={"v": "double", "gone": "int"}, forbidden=["s"], non_null=["s"], unique=["k"], rows=3,
                                  rules={"big": F.col("v") > 8})
    found = {(r["problem"], r["subject"].split(":")[0]): r["violations"] for r in contracts.check_contract(df, contract).collect()}
    assert found == {("missing_column", "gone"): 1, ("wrong_type", "v"): 1, ("forbidden_column", "s"): 1, ("null", "s"): 1,
                     ("duplicate_key", "k"): 1, ("row_count", "expected 3"): 1, ("rule", "big"): 1}
    with pytest.raises(ValueError):
        contracts.enforce(df, contract)


def test_ordering_breaks_seen_across_block_borders(spark):
    rows = [(i, v) for i, v in enumerate([1, 2, 3, 2, 5, 6, 4, 8], 1)]
    df = spark.createDataFrame(rows, "n INT, v INT")
    for block in (1, 2, 3, 100):
        assert sorted(r["n"] for r in contracts.ordering_breaks(df, "n", ["v"], block).collect()) == [4, 7]


def test_prediction_contract_flags_held_out_rows(spark):
    rows = [("m", N.INNER_VALIDATION, 1, 1, "x", 0, 0.5), ("m", "Hold-out test", 2, 1, "x", 1, 1.5)]
    df = spark.createDataFrame(rows, f"model_name STRING, evaluation_slice STRING, {N.ORDER} INT, {N.ITEM} INT, {N.ORDER_TS} STRING, {N.LATE} INT, predicted_probability DOUBLE")
    found = {r["rule"]: r["violations"] for r in contracts.check_predictions(df, N.LATE, "predicted_probability").collect()}
    assert found["held_out_rows_evaluation_slice"] == 1 and found["unexpected_slice"] == 1
    assert found["probability_out_of_range"] == 1 and found["duplicate_key"] == 0


def test_served_projection_refuses_outcomes(spark):
    df = spark.createDataFrame([(1, 2)], ["a", N.LATE])
    with pytest.raises(ValueError, match="realized"):
        publish.served_projection(df)


def test_catalog_validation(spark):
    good = ("a", "A", "g", "order_creation", "allowed", "review", "allowed", "direct_candidate", "r", "d", "doc")
    df = spark.createDataFrame([good], catalog.CATALOG_COLUMNS)
    assert "_registered_timestamp" in catalog.register_feature_catalog(df).columns
    bad = spark.createDataFrame([good, good[:3] + ("someday", "") + good[5:]], catalog.CATALOG_COLUMNS)
    problems = {(r["problem"], r["subject"]) for r in catalog.catalog_problems(bad).collect()}
    assert ("vocabulary_availability_timing", "someday") in problems and ("duplicate_source_column", "a") in problems
    assert ("blank_cell", "ao1_policy") in problems


def test_stream_runs_silver_cleaning_once_per_file(spark, tmp_path):
    from riskloom.streaming.incremental import append_new_files

    source, target, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    raw = spark.createDataFrame(ROWS, "n STRING, x STRING, t STRING, s STRING")
    raw.coalesce(1).write.parquet(source)
    clean = lambda df: cleaning.clean_silver(df, SPEC).drop(N.SILVER_TS)
    assert append_new_files(spark, source, raw.schema, clean, target, progress).count() == 3
    raw.coalesce(1).write.mode("append").parquet(source)
    assert append_new_files(spark, source, raw.schema, clean, target, progress).count() == 6


def test_errors_count_all_problems(spark):
    columns = [f"c{i:03}" for i in range(70)]
    df = spark.range(2).select("id", *[F.lit(None).cast("string").alias(c) for c in columns])
    with pytest.raises(ValueError, match=r"contract violated: 70 problems; null: 70 \(violations 140\); examples: "):
        contracts.enforce(df, contracts.Contract(non_null=columns))
    rows = [tuple(f"{c} {i // 2}" if c in ("source_column", "silver_column") else "x" for c in catalog.CATALOG_COLUMNS) for i in range(60)]
    bad = spark.createDataFrame(rows, catalog.CATALOG_COLUMNS)
    total = catalog.catalog_problems(bad).count()
    assert total > 20
    with pytest.raises(ValueError, match=rf"catalog is not sound: {total} problems; .*examples: "):
        catalog.register_feature_catalog(bad)


def test_dictionary_names_that_are_often_on_both_sides_meet_as_counts(spark):
    from riskloom.sources import catalog

    layout = "column_name STRING, data_type STRING, source_layer STRING, source_name STRING, guidance STRING, review_status STRING"
    doc = spark.createDataFrame([("a", "int", "silver", "x", "use", "")] * 300 + [("a", "string", "silver", "x", "use", ""), ("b", "int", "silver", "x", "use", "")], layout)
    have = spark.createDataFrame([("a", "string")] * 300 + [("c", "string")], "column_name STRING, data_type STRING")
    out = catalog.dictionary_problems(doc, have, spark.createDataFrame([], "variable_name STRING"))
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["problem"], r["subject"]): r["count"] for r in out.groupBy("problem", "subject").count().collect()}
    assert got == {("type_mismatch", "a"): 90_000, ("unexpected_column", "b"): 1, ("undocumented_column", "c"): 1}
