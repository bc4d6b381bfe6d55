"""Sources/sinks round trips, spec scan and typing, streaming, and the preparation jobs on synthetic files."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprep.plans import jobs
from flowprep.plans.spec import read_specs, typed_param, typed_specs, with_defaults
from flowprep.sources import io
from flowprep.streaming import stream


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_spec_scan_typing_defaults(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "spec.csv"),
               "experiment_num,model,units,act,lr,normal_label\n# a comment row\n1,rf,\"64,32\",\"relu,\",0.01,normal\n"
               "2,ann,8,tanh,1_000,normal\n")
    specs = read_specs(spark, p)
    assert specs.count() == 2
    t = {(r["experiment_num"], r["key"]): r for r in typed_specs(with_defaults(specs)).collect()}
    assert t[("1", "units")]["kind"] == "list" and [i["int_value"] for i in t[("1", "units")]["items"]] == [64, 32]
    assert [i["text"] for i in t[("1", "act")]["items"]] == ["relu"]
    assert t[("1", "lr")]["kind"] == "float" and t[("2", "lr")]["int_value"] == 1000
    assert t[("2", "action")]["raw"] == "train_test"
    r = spark.range(1).select(typed_param(F.lit("abc")).alias("t")).first()["t"]
    assert r["kind"] == "str" and r["n_items"] == 1


def test_csv_na_and_prepared_roundtrip(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.csv"), " Label , x \nA,1\nNA,2\nB,\n")
    df = io.read_csv(spark, p, strip_names=True)
    assert df.columns == ["Label", "x", "file_key"]
    assert [tuple(r) for r in df.select("Label", "x").collect()] == [("A", "1"), (None, "2"), ("B", None)]
    out = os.path.join(tmpdir_path, "prep")
    io.write_prepared(df.withColumn("split", F.when(F.col("x") == "1", "train").otherwise("test")), out)
    assert io.read_prepared(spark, out, split="train").count() == 1


def test_streaming_clean_and_scale(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    rows = [("aé", 1.0), ("b", float("inf")), ("c", 3.0)]
    spark.createDataFrame(rows, "label string, x double").write.parquet(src)
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("x", T.DoubleType())])
    s = stream.read_stream_parquet(spark, src, schema)
    stats = spark.createDataFrame([(2.0, 1.0, 1.0, 3.0, 2)], "mean_x double, std_x double, min_x double, max_x double, n long")
    cleaned = stream.scale_stream(stream.clean_stream(s, "label", ["x"]), stats, ["x"])
    out = os.path.join(tmpdir_path, "sink")
    q = stream.write_batches(cleaned, lambda b, i: b.write.mode("append").parquet(out),
                             os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", -1.0), ("c", 1.0)]


def test_prepare_nsl_like(spark, tmpdir_path):
    import random
    rnd = random.Random(3)
    labels = ["normal"] * 40 + ["neptune"] * 25 + ["smurf"] * 10 + ["satan"] * 12 + ["guess_passwd"] * 8 + ["rootkit"] * 5
    lines, tlines = [], []
    for i, lab in enumerate(labels):
        feats = [str(rnd.randint(0, 9)) if j not in (1, 2, 3) else rnd.choice(["tcp", "udp"]) for j in range(41)]
        lines.append(",".join(feats + [lab, "20"]))
    for lab in ["normal", "neptune", "mscan", "worm", "named"] * 4:
        feats = [str(rnd.randint(0, 9)) if j not in (1, 2, 3) else rnd.choice(["tcp", "icmp"]) for j in range(41)]
        tlines.append(",".join(feats + [lab, "15"]))
    tr = _write(os.path.join(tmpdir_path, "train.txt"), "\n".join(lines) + "\n")
    te = _write(os.path.join(tmpdir_path, "test.txt"), "\n".join(tlines) + "\n")
    out = os.path.join(tmpdir_path, "nsl")
    prepared = jobs.prepare_kdd(spark, [tr], out, nsl=True, test_paths=[te], five_classes=True, expected_classes=5)
    sizes = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    assert sizes == {"train": 80, "val": 20, "test": 20}
    # 38 numeric + dummies of c1 (tcp, udp, icmp) and c2, c3 (same values), fitted on train + test
    assert prepared.select(F.size("features")).distinct().first()[0] == 38 + 3 * 3
    tr_stats = prepared.where("split = 'train'").select(F.posexplode("features")).groupBy("pos") \
        .agg(F.avg("col").alias("m")).agg(F.max(F.abs("m"))).first()[0]
    assert tr_stats < 1e-9
    data, codes = jobs.prepare_tabular(spark, out, merge_val=True)
    assert codes.count() == 5 and data.where("split = 'val'").count() == 0
    seqs, _ = jobs.prepare_sequences(spark, out, length=8)
    assert seqs.where("split = 'train'").count() == 10


def test_prepare_ids17_like(spark, tmpdir_path):
    import random
    rnd = random.Random(5)
    header = " Destination Port, Flow Duration, Flow Bytes/s, Flow Packets/s, Label\n"
    rows = []
    for i in range(60):
        rows.append(f"{rnd.randint(1, 9000)},{rnd.randint(1, 999)},{rnd.random() * 100:.3f},{rnd.random():.4f},BENIGN")
    for i in range(20):
        rows.append(f"{rnd.randint(1, 9000)},{rnd.randint(1, 999)},{rnd.random() * 100:.3f},{rnd.random():.4f},DDoS")
    for i in range(10):
        rows.append(f"{rnd.randint(1, 9000)},{rnd.randint(1, 999)},{rnd.random() * 100:.3f},{rnd.random():.4f},"
                    "Web Attack – XSS")
    rows += ["80,5,Infinity,1.0,BENIGN", "80,5,NaN,1.0,DDoS", "80,5,,1.0,BENIGN", "443,7,1.5,2.5,Heartbleed"]
    p = _write(os.path.join(tmpdir_path, "ids17.csv"), header + "\n".join(rows) + "\n")
    out = os.path.join(tmpdir_path, "ids17")
    prepared = jobs.prepare_ids17(spark, [p], out)
    got = {(r["label"], r["split"]): r["count"] for r in prepared.groupBy("label", "split").count().collect()}
    assert got == {("BENIGN", "train"): 36, ("BENIGN", "val"): 12, ("BENIGN", "test"): 12,
                   ("DDoS", "train"): 12, ("DDoS", "val"): 4, ("DDoS", "test"): 4,
                   ("Web Attack XSS", "train"): 6, ("Web Attack XSS", "val"): 2, ("Web Attack XSS", "test"): 2}
    assert prepared.select(F.size("features")).distinct().first()[0] == 4
    # SMP-4: keep a stratified half first (BENIGN 30, DDoS 10, XSS 5), then 60/20/20
    sub = jobs.prepare_ids17(spark, [p], os.path.join(tmpdir_path, "ids17_half"), subset=0.5)
    per_class = {r["label"]: r["count"] for r in sub.groupBy("label").count().collect()}
    assert per_class == {"BENIGN": 30, "DDoS": 10, "Web Attack XSS": 5}
    assert {r["split"]: r["count"] for r in sub.groupBy("split").count().collect()} == {"train": 27, "val": 9, "test": 9}


def test_prepare_ids18_like(spark, tmpdir_path):
    day1 = ("Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Label\n"
            + "".join(f"{80 + i},6,{'02/03/2018' if i % 2 else '01/03/2018'} 08:{i:02d}:00,{i * 10},{i % 7},"
                      f"{'Benign' if i % 3 else 'Bot'}\n" for i in range(30))
            + "Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Label\n"
            + "53,17,01/03/2018 09:00:00,Infinity,1,Benign\n")
    day2 = ("Flow ID,Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Label\n"
            + "".join(f"f{i},1.1.1.1,{1000 + i},2.2.2.2,{443},6,15/02/2018 10:{i:02d}:00,{i * 3},{i % 5},"
                      f"{'Benign' if i % 4 else 'Bot'}\n" for i in range(30)))
    p1 = _write(os.path.join(tmpdir_path, "day1.csv"), day1)
    p2 = _write(os.path.join(tmpdir_path, "day2.csv"), day2)
    out = os.path.join(tmpdir_path, "ids18")
    prepared = jobs.prepare_ids18(spark, [p1, p2], out)
    # repeated header row (non-numeric Dst Port) and the Infinity row are gone
    assert prepared.count() == 60
    assert set(prepared.columns) >= {"row_id", "label", "features", "split", "file_key"}
    assert prepared.select(F.size("features")).distinct().first()[0] == 3
    sizes = {r["split"]: r["count"] for r in prepared.groupBy("split").count().collect()}
    assert sizes == {"train": 36, "val": 12, "test": 12}
    # rows of one file are numbered in timestamp *text* order: 01/03 before 02/03
    d1 = spark.read.parquet(out).where(F.col("file_key").endswith("/day1.csv")).orderBy("row_id")
    assert d1.count() == 30
    out2 = os.path.join(tmpdir_path, "ids18_sub")
    sub = jobs.prepare_ids18(spark, [p1, p2], out2, every_kth=0.2)
    assert sub.count() == 12


def test_run_experiment_train_test(spark, tmpdir_path):
    rows = [(i, "train" if i < 60 else ("val" if i < 80 else "test"), "normal" if i % 3 else "dos",
             [float(i % 3 == 0), float(i % 5), float(i % 7)]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, split string, label string, features array<double>")
    path = os.path.join(tmpdir_path, "prep")
    io.write_prepared(df, path)
    res = jobs.run_experiment(spark, {"dataset_dir": path, "model": "rf", "normal_label": "normal",
                                      "model_params": {"num_trees": 5, "max_depth": 4},
                                      "model_path": os.path.join(tmpdir_path, "m1")},
                              report_dir=os.path.join(tmpdir_path, "report"))
    am = res["tables"]["average_metrics"]
    acc = am.where("split = 'test' AND granularity = 'multi' AND avg_type = 'micro'").first()["acc"]
    assert acc == 1.0
    assert spark.read.parquet(os.path.join(tmpdir_path, "report", "class_metrics")).count() > 0
    timing = jobs.run_experiment(spark, {"dataset_dir": path, "action": "compute_prediction_time",
                                         "model_path": os.path.join(tmpdir_path, "m1"), "num_samples": 30,
                                         "repetitions": 2})["timing"].collect()
    assert [r["rows"] for r in timing] == [30, 30] and all(r["seconds"] > 0 for r in timing)
    tested = jobs.run_experiment(spark, {"dataset_dir": path, "action": "test_only", "normal_label": "normal",
                                         "model_path": os.path.join(tmpdir_path, "m1")})
    assert tested["tables"]["class_metrics"].where("granularity = 'binary'").count() == 6
    again = jobs.run_experiment(spark, {"dataset_dir": path, "action": "stat_test_2_models",
                                        "model_path": os.path.join(tmpdir_path, "m1"),
                                        "model_path_2": os.path.join(tmpdir_path, "m1")})
    assert again["folds"].count() == 10
    t = again["ttest"].first()
    assert t["df"] == 18


def test_file_order_head_chunks_history_sinks(spark, tmpdir_path):
    from flowprep.operators import history, sequence
    from flowprep.operators.split import sample_with_replacement
    df = spark.createDataFrame([("b.csv", 0), ("a.csv", 1), ("a.csv", 0)], "file_key string, row_id long")
    top = io.head(df, 2, io.file_order()).collect()
    assert [(r["file_key"], r["row_id"]) for r in top] == [("a.csv", 0), ("a.csv", 1)]
    out = os.path.join(tmpdir_path, "chunks")
    sequence.write_chunks(spark.range(10), ["id"], 3, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("chunk=")) == ["chunk=1", "chunk=2", "chunk=3"]
    h = history.history_frame(spark, "r1", [1.0, 0.5], val_loss=None)
    hp = os.path.join(tmpdir_path, "hist")
    history.save_history(h, hp)
    back = spark.read.option("header", True).csv(hp)
    assert back.count() == 2 and back.where("val_loss = '0.0'").count() == 2
    draws = sample_with_replacement(spark.range(5).withColumnRenamed("id", "seq"), "seq", 5, 40, seed=3)
    assert draws.count() == 40 and draws.select("seq").distinct().count() <= 5


def test_parquet_files_fresh_index(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "b_part.parquet")
    b = os.path.join(tmpdir_path, "a_part.parquet")
    spark.range(5).coalesce(1).write.parquet(a)
    spark.range(100, 103).coalesce(1).write.parquet(b)
    df = io.with_fresh_index(io.read_parquet_files(spark, [a, b]))
    got = [(r["id"], r["row_id"]) for r in df.orderBy("row_id").collect()]
    # files in name order (a_part first), rows in file order
    assert got == [(100, 0), (101, 1), (102, 2), (0, 3), (1, 4), (2, 5), (3, 6), (4, 7)]


def test_grid_runs_every_spec_row(spark, tmpdir_path):
    rows = [(i, "train" if i < 90 else "test", "normal" if i % 3 else "dos", [float(i % 3 == 0), float(i % 5), float(i % 7)])
            for i in range(120)]
    path = os.path.join(tmpdir_path, "prep")
    io.write_prepared(spark.createDataFrame(rows, "row_id long, split string, label string, features array<double>"), path)
    spec = _write(os.path.join(tmpdir_path, "grid.csv"),
                  "experiment_num,dataset_dir,model,num_trees,max_depth,units,class_weights,normal_label,model_location,dataset_split_ratio,action\n"
                  f"1,{path},rf,5,4,,1,normal,{tmpdir_path}/m1,,train_test\n"
                  f"# {path}\n"
                  f"2,{path},ann,,,\"4,3\",0,normal,{tmpdir_path}/m2,0.3,train_test\n"
                  f"3,{path},ae_ann,,,,0,normal,{tmpdir_path}/m3,,train_test\n"
                  f"4,{path},rf,,,,0,normal,{tmpdir_path}/m1,,test_only\n")
    assert jobs.grid_params(spark, spec)[1]["units"] == [4, 3]
    report = os.path.join(tmpdir_path, "report")
    params = jobs.grid_params(spark, spec)
    params[2]["n_components"] = 2
    done = {str(p["experiment_num"]): jobs.run_experiment(spark, p, report) for p in params}
    assert set(done) == {"1", "2", "3", "4"}
    back = spark.read.parquet(os.path.join(report, "average_metrics")).where("split = 'test' and avg_type = 'micro' and granularity = 'multi'")
    acc = {str(r["run"]): r["acc"] for r in back.collect()}
    assert set(acc) == {"1", "2", "3", "4"} and acc["1"] == acc["4"] == 1.0
    again = jobs.run_grid(spark, _write(os.path.join(tmpdir_path, "one.csv"), "experiment_num,dataset_dir,model,num_trees,max_depth\n"
                                        f"1,{path},rf,3,3\n"), report)
    assert set(again) == {"1"}
