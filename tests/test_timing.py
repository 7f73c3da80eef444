import json
import random
import statistics

import pytest

from headloom.operators import timing
from headloom.plans import timings


def plain(xs):
    xs = sorted(xs)
    n = len(xs)
    at = lambda p: xs[max(1, int(n * p / 100)) - 1]
    return sum(xs), int(sum(xs) / n), int((xs[(n + 1) // 2 - 1] + xs[n // 2]) / 2), at(90), at(99), xs[-1]


@pytest.mark.parametrize("ranges", [2, 1024])
def test_ranks_by_ranges(spark, monkeypatch, ranges):
    """Even, tied, heavy-tailed, negative and single values; with two ranges a step, many steps."""
    monkeypatch.setattr(timing.at_ranks, "__defaults__", (ranges,))
    rng = random.Random(3)
    groups = {
        "even": list(range(1, 201)), "tied": [7] * 99 + [8], "one": [5], None: [3, 1], "tail": [rng.randint(0, 9) for _ in range(300)] + [10**15, 10**12, 10**6],
        "negative": [rng.randint(-1000, 1000) for _ in range(101)], "wide": [int(1.3**i) for i in range(90)],
    }
    if ranges == 2:
        groups = {k: groups[k] for k in ("even", None, "tied")}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("even", None)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(3)
    got = {r.g: tuple(r)[1:] for r in timing.summary(df, ["g"], "x").collect()}
    assert got == {k: plain(xs) for k, xs in groups.items()}
    assert timing.summary(df.filter("1 = 0"), ["g"], "x").count() == 0


def test_no_group_is_ordered_whole(spark):
    """The only windows are over ranges."""
    df = spark.range(5000).selectExpr("id % 2 as g", "id * id as x")
    plan = timing.summary(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert {r.g: tuple(r)[1:] for r in timing.summary(df, ["g"], "x").collect()} == {g: plain([i * i for i in range(g, 5000, 2)]) for g in (0, 1)}


def _reading(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text("utf-8").splitlines()]


def test_summary_of_logs(spark, tmp_path):
    """Totals, spreads of archives and workers, failures and timeouts, as JSON and as Markdown, against a plain count."""
    rng = random.Random(5)
    archives = {f"c{i}": [(rng.randint(0, 9), ms, ms // 2, ms // 3) for ms in (rng.randint(0, 90_000) for _ in range(i))] for i in (1, 4, 9)}
    lines = [(c, f"x INFO: finished WARC {k}: p/{c}/{k} | records={r} total_ms={t} process_ms={p} iterator_download_ms={d} more") for c, xs in archives.items() for k, (r, t, p, d) in enumerate(xs)]
    lines += [("c1", "mapper_init finished successfully in 120ms"), ("c4", "jitter sleep 2.25s"), ("idle", "mapper_init finished successfully in 9ms"), ("c1", "anything else"), ("c1", None)]
    lines += [("c9", "ERROR: failed WARC 3: p|q | exit_code=-9 signal=9"), ("idle", "ERROR: failed WARC 5: f | exit_code=1"), ("c4", "ERROR: timeout WARC 4: e after 900s; terminating child")]
    found = timings.parse(spark.createDataFrame(lines, "container string, line string").repartition(3))
    timings.write_json(found, str(tmp_path / "json"))
    (row,) = _reading(tmp_path / "json" / "summary")
    flat = [x for xs in archives.values() for x in xs]
    assert row["totals"] == {"mappers": 3, "warcs_completed": 14, "warcs_failed": 2, "warcs_timed_out": 1, "records_seen": sum(x[0] for x in flat)}
    start = {"c1": (120, 0), "c4": (0, 2250), "c9": (0, 0)}
    numbers = {
        "warc_ms": {"total": [x[1] for x in flat], "process": [x[2] for x in flat], "iterator_download": [x[3] for x in flat]},
        "mapper_ms": {"elapsed": [sum(start[c]) + sum(x[1] for x in xs) for c, xs in archives.items()], "jitter": [j for _, j in start.values()], "init": [i for i, _ in start.values()]},
    }

    def spread(xs):
        at = lambda p: sorted(xs)[max(0, min(len(xs) - 1, int(len(xs) * p / 100) - 1))]
        return {"sum": sum(xs), "mean": int(statistics.mean(xs)), "median": int(statistics.median(xs)), "p90": at(90), "p99": at(99), "max": max(xs)}

    assert {part: row[part] for part in numbers} == {part: {m: spread(xs) for m, xs in of.items()} for part, of in numbers.items()}
    assert sorted(map(str, _reading(tmp_path / "json" / "failures"))) == sorted(map(str, [{"container": "c9", "path": "p|q", "exit_code": "-9", "signal": "9"}, {"container": "idle", "path": "f", "exit_code": "1", "signal": ""}]))
    assert _reading(tmp_path / "json" / "timeouts") == [{"container": "c4", "path": "e", "timeout_s": 900}]
    parts = timings.write_markdown(found, str(tmp_path / "summary.md"), top=3)
    text = (tmp_path / "summary.md").read_text("utf-8")
    assert [s.title for s in parts] == ["Totals", "Failed archives", "Timed-out archives", "Archive timings", "Worker timings", "Slowest 3 archives"]
    assert "| -9 | 9 | c9 | p\\|q |" in text and "| 1 | - | idle | f |" in text
    assert f"> Processing share: {sum(x[2] for x in flat) / sum(x[1] for x in flat) * 100:.1f}%" in text
    assert [r[0] for r in parts[-1].rows] == [f"{t / 1000:.1f}s" for t in sorted((x[1] for x in flat), reverse=True)[:3]]


def test_logs_without_timings(spark):
    nothing = timings.parse(spark.createDataFrame([("c", "noise"), (None, None)], "container string, line string"))
    row = timings.summary_row(nothing).first()
    assert set(row["totals"]) == {0} and {x for part in ("warc_ms", "mapper_ms") for metric in row[part] for x in metric} == {0}
    assert timings.totals(nothing).first()["processing_pct"] == 0.0
    with pytest.raises(ValueError, match="finished"):
        timings.sections(nothing)
