"""Readers and sinks on small files written to a fresh temp folder."""

import json
import os

from pyspark.sql import functions as F

from wellspark.operators import nutrition as nu
from wellspark.sources import readers as rd
from wellspark.sources import schemas as S
from wellspark.sources import sinks


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_sleep_and_activity_scans_with_path_keys(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "affect")
    header = ",".join(("extra",) + S.SLEEP_RAW)
    _write(os.path.join(root, "par_1", "oura", "sleep.csv"),
           header + "\nx,2020-08-01,27690,1110,14550,7080,6060,240,14400,96,70.97,63,33,17.38,0.56\n"
           "y,2020-08-02,NA,,1,1,1,1,1,1,1,1,1,1,1\n")
    _write(os.path.join(root, "par_2", "oura", "activity.csv"),
           ",".join(S.ACTIVITY_RAW) + "\n2023-01-01,500,360,180,120,60,30\n")
    sleep = rd.read_daily_sleep(spark, root)
    rows = {r.date.isoformat(): r for r in sleep.collect()}
    r = rows["2020-08-01"]
    assert (r.user_id, r.device) == ("par_1", "oura")
    assert r.total_sleep_time == 461.5 and r.awake_duration == 18.5 and r.sleep_efficiency == 96.0
    assert rows["2020-08-02"].total_sleep_time is None and rows["2020-08-02"].awake_duration is None
    act = rd.read_daily_activity(spark, root).first()
    assert (act.user_id, act.steps_count, act.medimum_acitivity_time) == ("par_2", 500.0, 60.0)
    assert rd.read_daily_sleep(spark, root, users=[" par_1 "]).count() == 2
    assert rd.read_daily_sleep(spark, root, users=["par_1", "par_9"]).count() == 2  # par_9 has no file
    nobody = rd.read_daily_sleep(spark, root, users=["par_9", "p{x,*}"])
    assert nobody.collect() == [] and nobody.dtypes == sleep.dtypes


def test_ppg_scan(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "affect")
    _write(os.path.join(root, "par_5", "samsung", "ppg.csv"),
           "timestamp,ppg,hr\n1596240000000,0.5,0\n1596240000050,0.7049,70\n")
    df = rd.read_ppg(spark, root).orderBy("sample_no").collect()
    assert df[0].user_id == "par_5" and df[0].date.year == 2020 and df[1].hr == 70.0
    assert df[1].ppg == 0.7  # two decimals
    assert rd.read_ppg(spark, root, users=["nobody"]).count() == 0


def test_string_tables(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "participant_information.csv")
    _write(p, 'id,group,sex,usual_weight_kg\nA4F_00001,1,F,NA\nA4F_00002,2,M,""\nA4F_00003,1,F,71.5\n')
    df = rd.read_participants(spark, p)
    rows = {r.id: r for r in df.collect()}
    assert rows["A4F_00001"].usual_weight_kg is None and rows["A4F_00002"].usual_weight_kg is None
    assert rows["A4F_00003"].usual_weight_kg == "71.5" and rows["A4F_00003"].usual_weight_kg_num == 71.5
    folder = os.path.join(tmpdir_path, "sleep_ds")
    _write(os.path.join(folder, "A4F_00001_additional_sleep_data.csv"),
           "sleep_id,start_time\n1,2022-06-08 00:45:30+02:00\n")
    s = rd.read_sleep_datasets(spark, folder).first()
    assert (s.id, s.start_time) == ("A4F_00001", "2022-06-08 00:45:30+02:00")


def test_nutrition_json_scan(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "meals.json")
    doc = {"foods": [{"food_name": "milk", "nf_calories": 122, "nf_total_fat": 4.83,
                      "alt_measures": [{"serving_weight": 1, "measure": "cup", "seq": "null", "qty": 1}]},
                     {"food_name": "eggs", "nf_calories": 143, "nf_total_fat": None}]}
    _write(p, json.dumps(doc) + "\n" + json.dumps({"foods": []}) + "\n")
    docs = rd.read_nutrition_docs(spark, p)
    totals = {round(r.Calories, 2) for r in nu.nested_totals(docs).collect()}
    assert totals == {265.0, 0.0}
    flat = nu.explode_foods(docs, ["log_id"])
    assert flat.where(F.col("food_name").isNotNull()).count() == 2


def test_lines_images_and_sinks(spark, tmpdir_path):
    q = os.path.join(tmpdir_path, "questions.txt")
    _write(q, "one\ntwo\n")
    assert rd.read_lines(spark, q).count() == 2
    img = os.path.join(tmpdir_path, "imgs", "a.png")
    os.makedirs(os.path.dirname(img))
    with open(img, "wb") as f:
        f.write(b"\x89PNG")
    url = rd.read_images_as_data_urls(spark, os.path.join(tmpdir_path, "imgs")).first().data_url
    assert url == "data:image/png;base64,iVBORw=="
    df = spark.createDataFrame([("2020-08-01", 1.5)], "d string, v double").withColumn("date", F.to_date("d")).drop("d")
    assert json.loads(sinks.records_json(df).first().json) == {"v": 1.5, "date": 1596240000000}
    out = os.path.join(tmpdir_path, "csv_out")
    sinks.append_csv(df, out)
    sinks.append_csv(df, out)
    assert spark.read.option("header", "true").csv(out).count() == 2


def test_result_store(spark):
    res = spark.createDataFrame([("r1", "k1", "{}", "d")], "run_id string, key string, data string, description string")
    path = sinks.store_results(spark, res, "unit")
    keys = spark.createDataFrame([("r1", "k1"), ("r1", "nope")], "run_id string, key string")
    found, missing = sinks.retrieve(spark, path, keys)
    assert found.count() == 1 and [r.key for r in missing.collect()] == ["nope"]


def test_streaming_sleep_files(spark, tmpdir_path):
    """ST1: files landing in the participant tree are picked up by the same reader in streaming mode."""
    from wellspark.streaming import jobs

    root = os.path.join(tmpdir_path, "affect")
    header = ",".join(S.SLEEP_RAW)
    for user in ("par_1", "par_2"):
        _write(os.path.join(root, user, "oura", "sleep.csv"),
               header + "\n2020-08-01,27690,1110,14550,7080,6060,240,14400,96,70.97,63,33,17.38,0.56\n")
    stream = rd.read_daily_sleep(spark, root, streaming=True)
    out = jobs.run_to_table(spark, stream.select("user_id", "date", "total_sleep_time"), "sleep_files")
    assert sorted((r.user_id, r.total_sleep_time) for r in out.collect()) == [("par_1", 461.5), ("par_2", 461.5)]
