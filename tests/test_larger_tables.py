"""Steps whose cost must grow no faster than their input."""


import glob
import json
import random

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from context_shaper.operators import alerts as A, impact as I, lookup as K
from context_shaper.plans import sessions as E
from context_shaper.session import new_shared_path
from context_shaper.sources import folders, transcripts as C
from context_shaper.streaming import impact as live
from workload import queries as Q


def test_patterns_of_whole_names_are_not_tested_one_by_one(spark, monkeypatch):
    staged = {}

    def stage(rows, label):
        staged[label] = rows.localCheckpoint()
        return staged[label]

    monkeypatch.setattr(K, "stage", stage)
    table = [(1, "^m[.]1$"), (1, r"^M\.2:a$"), (0, "^m.1$"), (2, "m"), (1, "^m-3"), (3, "^x$"), (1, "^$"), (0, None), (1, "^M[.]1$"),
             (4, r"^\u00c4$"), (1, "^a[.]$"), (1, "^[.]b$"), (0, "^a|c$"), (1, "^end$")]
    names = ["m.1", "M.1", "mx1", "M.2:A", "m-3", "m-33", "X", "", "x\n", "x\r\n", "x\n\n", "\u00c4", "\u00e4", "A.", ".B", "abc", "end\u2028", "END\r",
             "e\nend", None, "K", "\u212a"]
    rows = spark.createDataFrame([(*row, number) for number, row in enumerate(table)], "priority int, pattern string, number int")
    found = K.pattern_values(spark.createDataFrame([(n,) for n in names], "name string"), rows)
    pairs = rows.crossJoin(spark.createDataFrame([(n,) for n in names], "name string")).filter(F.rlike("name", F.concat(F.lit("(?i)"), "pattern")))
    want = pairs.groupBy("name").agg(F.min_by("number", F.struct("priority", "pattern")).alias("number"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r.pattern for r in staged["loose-patterns"].collect()} == {"^m.1$", "m", "^m-3", "^\u00c4$", "^a|c$", r"^\u00c4$"} & {p for _, p in table if p}


def most_tasks(spark, run):
    spark.sparkContext.setJobGroup(f"{run}", "")
    try:
        result = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(f"{run}") for s in tracker.getJobInfo(job).stageIds]
    return max(info.numTasks for s in stages if (info := tracker.getStageInfo(s))), result


def test_paths_are_listed_in_few_tasks(spark, tmp_path):
    line = '{"type":"user","message":{"role":"user","content":"hi"}}'
    for number in range(50):
        (tmp_path / f"p{number}").mkdir()
        (tmp_path / f"p{number}" / "a b.jsonl").write_text(line if number else "")
    tasks, files = most_tasks(spark, lambda: C.session_inventory(spark, str(tmp_path), limit=None))
    assert tasks <= 32
    assert sorted((r.project, r.size_bytes) for r in files.collect()) == sorted((f"p{n}", len(line) if n else 0) for n in range(50))
    tasks, entries = most_tasks(spark, lambda: C.transcript_entries(spark, [str(p) for p in tmp_path.glob("*/*.jsonl")]))
    assert tasks <= 32 and entries.count() == 49
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_small_sessions_are_written_by_many_tasks(spark, tmp_path):
    lines = spark.range(60).select(
        F.lit("p").alias("project"), F.col("id").cast("string").alias("session"), F.lit(0).alias("turn"), F.lit(0).alias("part"),
        F.lit("{}").alias("value"))
    Q.write_transcripts(lines, str(tmp_path / "files"))
    names = glob.glob(f"{tmp_path}/files/project=p/session=*/part-*.txt")
    assert len(names) == 60 and len({name.split("/part-")[1][:5] for name in names}) >= 8


def test_parts_of_a_stream_are_written_by_many_tasks(spark, monkeypatch):
    path = new_shared_path(spark, "parts")
    for number, count in enumerate((2, 1000, 0), 1):
        Q.append_part(spark.range(count), path, 5)
        assert sum(name.endswith(".parquet") for name in folders.files(spark, path)) == 5 * number
    assert spark.read.parquet(path).count() == 1002
    monkeypatch.setattr(Q, "STREAM_FILE_BYTES", 1000)
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    asked, append = [], Q.append_part
    monkeypatch.setattr(Q, "append_part", lambda part, path, files: asked.append(files) or append(part, path, files))
    stream, seen = Q.as_stream(rows, "rows", "id", [9, 1999]), []
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(
        batch.agg(F.min("id"), F.max("id"), F.count("*")).first())).trigger(
        availableNow=True).option("checkpointLocation", new_shared_path(spark, "checkpoint")).start().awaitTermination()
    assert [tuple(row) for row in seen] == [(0, 9, 10), (10, 1999, 1990), (2000, 2999, 1000)]
    assert len(asked) == 3 and min(asked) > 8


def test_activity_of_small_and_grown_sessions(spark):
    rng, path = random.Random(3), new_shared_path(spark, "impact")
    schema = "ts bigint, ev string, sid string, tok bigint, warn boolean, src string, saved bigint, model string, seq bigint"
    rows = [
        (rng.randrange(40_000), "check", rng.choice("aaaaaaaabbc"), rng.randrange(1000), rng.choice([True, False, None]), None, None, None, i)
        for i in range(120)
    ]
    for part in range(3):
        spark.createDataFrame(rows[40 * part : 40 * part + 40], schema).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ledger")
        with Q.state_store(spark):
            for run in live.impact_streams(stream, path, bucket_ms=1000, small=25):
                run.awaitTermination()
    for part in range(3):
        want = I.session_activity(spark.createDataFrame(rows[: 40 * part + 40], schema))
        assert sorted(map(tuple, live.activity_as_of(spark, path, part).collect())) == sorted(map(tuple, want.collect()))


def read_at_once(monkeypatch):
    """Numbers of files of the tables read from transcripts from now on, with lots of seven."""
    monkeypatch.setattr(C, "FILES_A_LOT", 7, raising=False)
    monkeypatch.setattr(C, "FEW_FOLDERS", 4, raising=False)
    sizes = []
    for name in ("load", "text"):
        def read(self, *given, method=getattr(DataFrameReader, name), **more):
            rows = method(self, *given, **more)
            sizes.append(len(rows.inputFiles()))
            return rows
        monkeypatch.setattr(DataFrameReader, name, read)
    return sizes


def session_folders(root, per_project):
    line = lambda n, k: json.dumps({"type": "user", "message": {"role": "user", "content": f"{n} {k} " + "word " * (n % 5 * 20)}})
    for project, count in enumerate(per_project):
        (root / f"p {project}").mkdir(parents=True)
        for n in range(count):
            (root / f"p {project}" / f"s{n},{project}.jsonl").write_text("\n".join(line(n, k) for k in range(n % 4)))
    return str(root)


def test_files_are_listed_and_checked_in_lots(spark, tmp_path, monkeypatch):
    few, many = session_folders(tmp_path / "few", [20, 1, 0]), session_folders(tmp_path / "many", [3] * 9)
    (tmp_path / "few" / "p 0" / "sub").mkdir()
    (tmp_path / "few" / "p 0" / "sub" / "deeper.jsonl").write_text("{}")

    def found(root):
        files = C.session_inventory(spark, root, limit=None)
        prompts = files.select(F.lit(1).alias("ts"), F.col("session_key").alias("session_id"), F.col("path").alias("transcript_path"))
        checks = E.check_sessions(spark, root, prompts, options=A.AlertOptions(warn_tokens=60))
        rows = checks.checks.select("session_id", "bytes", "tokens", "warn")
        return sorted(map(tuple, files.collect())), sorted(map(tuple, rows.collect())), sorted(checks.paths)

    want = [found(few), found(many)]
    sizes = read_at_once(monkeypatch)
    assert [found(few), found(many)] == want
    assert [len(files) for files, _, _ in want] == [21, 27] and all(len(checks) > 3 for _, checks, _ in want)
    assert max(sizes) <= 7 < sum(sizes)


def test_profiles_are_read_in_lots(spark, tmp_path, monkeypatch):
    root = session_folders(tmp_path / "files", [11, 9])

    def report():
        table = E.ProfileTable(spark, new_shared_path(spark, "profiles"))
        activity = spark.createDataFrame([], "sid string, reduction bigint, warn_count bigint")
        rows = sorted(map(str, E.report_from_files(table, root, activity).collect()))
        assert table.refresh(root).read == []
        return rows

    want = report()
    sizes = read_at_once(monkeypatch)
    assert report() == want and len(want) == 14
    assert max(sizes) <= 7 < sum(sizes)


def test_sessions_are_written_in_lots(spark, tmp_path, monkeypatch):
    lines = spark.range(120).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("project"), F.floor(F.col("id") / 2).cast("string").alias("session"),
        F.lit(0).alias("turn"), (1 - F.col("id") % 2).alias("part"), F.col("id").cast("string").alias("value"))
    monkeypatch.setattr(Q, "FILES_A_LOT", 20, raising=False)
    runs = set()
    Q.write_transcripts(lines, str(tmp_path / "files"))
    for project, session, at in [(r.project, r.session, f"{tmp_path}/files/project={r.project}/session={r.session}") for r in lines.select("project", "session").distinct().collect()]:
        [name] = glob.glob(f"{at}/part-*.txt")
        runs.add(name.split("/part-")[1][6:42])
        ids = [int(value) for value in open(name).read().split()]
        assert ids == sorted(ids, reverse=True) and {(f"p{i % 3}", str(i // 2)) for i in ids} == {(project, session)}
    assert len(glob.glob(f"{tmp_path}/files/*/*/part-*.txt")) == 120 and len(runs) == 6
