import gzip
import json

import pytest

from headloom import config
from headloom.plans import outcomes
from headloom.sources import logs, paths, tables, wat


def envelope(url, headers, **extra):
    meta = {"Response-Message": {"Status": "200", "Reason": "OK", "Version": "HTTP/1.1"}, "Headers": headers}
    head = {"WARC-Target-URI": url, "WARC-IP-Address": "10.1.1.1", "WARC-Date": "2026-06-29T10:18:14Z"} | extra
    return json.dumps({"Envelope": {"WARC-Header-Metadata": head, "Payload-Metadata": {"HTTP-Response-Metadata": meta}}})


def test_wat(spark, tmp_path):
    lines = ["WARC/1.0", envelope("https://www.a.example/x", {"Server": "nginx", "Vary": ["a", "b"]}), "{broken", json.dumps({"Envelope": {}}), envelope("http://b.example/", {"X": "[1"}), '{"Envelope":{"Payload-Metadata":{"HTTP-Response-Metadata":{"Headers":{"A":"1","A":"2"}}}}}']
    path = tmp_path / "x.wat.gz"
    with open(path, "wb") as f:  # one gzip member a record, as crawls write them
        for x in lines:
            f.write(gzip.compress((x + "\n").encode()))
    rows = sorted(wat.read_wat(spark, str(path)).collect(), key=lambda r: r.url or "")
    assert [(r.url, r.site, r.status, r.crawl_ts) for r in rows[1:]] == [("http://b.example/", "b.example", "200", 1782728294.0), ("https://www.a.example/x", "a.example", "200", 1782728294.0)]
    assert [tuple(h) for h in rows[2].headers] == [("server", "nginx"), ("vary", "a"), ("vary", "b")]
    assert [tuple(h) for h in rows[1].headers] == [("x", "[1")]
    assert rows[0].version == "HTTP/1.1" and [tuple(h) for h in rows[0].headers][-1] == ("a", "2")
    assert wat.read_wat(spark, str(path), record_limit=1).count() == 1
    assert {r.outcome: r["count"] for r in wat.parse_outcomes(wat.read_lines(spark, str(path))).collect()}["response"] == 3


def test_wat_headers_keep_their_types(spark):
    """A string that looks like an array is one header, an array is one a member, and nothing vanishes."""
    raw = {"A": '["x","y"]', "B": ["x", "y"], "C": "[]", "D": [], "E": 5, "F": None, "G": [1, None, ["z"]], "H": "null", "I": True, "J": {"k": 1}, "K": "[1"}
    lines = [envelope("http://a.example/", raw), envelope("http://b.example/", "none").replace('"none"', '{"a": "1", "b": "2", "a": "3"}'), envelope("http://c.example/", ["no map"])]
    df = spark.createDataFrame([("p", x) for x in lines], "path string, line string")
    got = {r.site: [tuple(h) for h in r.headers] for r in wat.parse_responses(df).collect()}
    assert got["a.example"] == [
        ("a", '["x","y"]'), ("b", "x"), ("b", "y"), ("c", "[]"), ("e", "5"), ("f", "null"), ("g", "1"), ("g", "null"), ("g", '["z"]'), ("h", "null"), ("i", "true"), ("j", '{"k":1}'), ("k", "[1"),
    ]
    assert sorted(got["b.example"]) == [("a", "3"), ("b", "2")] and got["c.example"] == []


def test_paths(spark, tmp_path):
    (tmp_path / "p").write_text("a/warc/x.warc.gz\n\n# no\n b/wat/y.warc.wat.gz \n")
    found = paths.read_paths(spark, str(tmp_path / "p"))
    assert [r[0] for r in found.select(paths.wat_path("path")).collect()] == ["a/wat/x.warc.wat.gz", "b/wat/y.warc.wat.gz"]
    twice = found.select(paths.wat_path(paths.wat_path("path")).alias("p"))
    assert twice.collect() == found.select(paths.wat_path("path").alias("p")).collect()
    many = spark.createDataFrame([(f"{i:02}",) for i in range(7)], "path string")
    assert sorted(r["count"] for r in paths.chunks(many, 3).groupBy("chunk").count().collect()) == [1, 3, 3]


def test_paths_keep_file_order(spark, tmp_path):
    """Several files, split into blocks, adaptive execution on: chunks are runs of the files' lines."""
    want = []
    for name in "ab":
        lines = [f"{name}/{(i * 7919) % 1000:04}/x.warc.gz" for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = paths.read_paths(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        dealt = paths.chunks(found, 7).orderBy("chunk", *paths.PLACE).collect()
        assert [r.path for r in dealt] == want and [r.chunk for r in dealt] == [i // 115 for i in range(800)]
        assert sorted(r.path for r in paths.read_paths(spark, str(tmp_path), 403).collect()) == sorted(want[:403])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_outcomes_of_a_scan(spark, tmp_path):
    """Counts come out of the one scan that writes the enriched table."""
    lines = [envelope(f"http://{s}.example/", {"Server": "nginx"}) for s in "aabc"] + ["{broken", '{"Envelope": {}}', "no json", envelope("http://a.example/", {}).replace("HTTP-Response", "HTTP-Request")]
    (tmp_path / "x.wat").write_text("\n".join(lines) + "\n")
    sites = spark.createDataFrame([("a.example",), ("b.example",)], "site string")
    got = outcomes.write_enriched(spark, str(tmp_path / "x.wat"), str(tmp_path / "out"), sites)
    assert got == {"read": 7, "malformed": 1, "no_response": 2, "filtered": 1, "linted": 3}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    again = outcomes.Outcomes()
    again.enriched(again.responses(wat.read_lines(spark, str(tmp_path / "x.wat")))).write.format("noop").mode("overwrite").save()
    assert again.context() == {"lines_read": "7", "lines_malformed": "1", "lines_no_response": "2", "lines_filtered": "0", "lines_linted": "4"}


def test_top_sites(spark, tmp_path):
    (tmp_path / "t").write_text("1,a.example\nbad\n3,c.example\n4,d.example\n")
    assert {r.site for r in tables.top_sites(spark, str(tmp_path / "t"), 3).collect()} == {"a.example", "c.example"}


def test_longest_prefix(spark):
    lines = ["# c", "10.0.0.0\t8\t111", "10.1.0.0\t16\t222", "10.1.2.9\t24\t333_444", "10.1.2.0\t24\t9", "2001:db8::\t32\t{555,666}", "2001:db8:8000::\t33\t777", "x\t1\t1", "10.0.0.0\t99\t1", "1.1.1.0\t24", "9.0.0.0\t8\tnone"]
    table = tables.prefixes(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    want = {"10.1.2.3": 333, "10.1.9.9": 222, "10.9.9.9": 111, "11.0.0.1": None, "2001:db8::1": 555, "2001:0DB8:8001::": 777, "2001:db9::": None, "junk": None, "010.1.2.3": None, "10.1.2.300": None, "::1": None, "1:2": None}
    df = spark.createDataFrame([(x,) for x in [*want, None]], "ip string")
    assert {r.ip: r.asn for r in tables.lookup_asn(df, table).collect()} == want | {None: None}
    assert tables.lookup_asn(df, table.filter("1 = 0")).filter("asn is not null").count() == 0


def test_logs(spark, tmp_path):
    for name, lines in {"c1": ["INFO: finished WARC 1: a/b | records=5 total_ms=30 process_ms=20 iterator_download_ms=7", "mapper_init finished successfully in 12ms", "jitter sleep 1.5s", "INFO: finished WARC 2: c | records=1 total_ms=10 process_ms=2 iterator_download_ms=1"], "c2": ["ERROR: failed WARC 3: d | exit_code=-9 signal=9", "ERROR: timeout WARC 4: e after 900s; terminating child", "ERROR: failed WARC 5: f | exit_code=1"]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "stderr.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    found = logs.read_logs(spark, str(tmp_path))
    assert {tuple(r) for r in logs.finished(found).select("path", "records", "total_ms").collect()} == {("a/b", 5, 30), ("c", 1, 10)}
    assert {tuple(r) for r in logs.failed(found).collect()} == {("c2", "d", "-9", "9"), ("c2", "f", "1", "")}
    assert tuple(logs.timed_out(found).first()) == ("c2", "e", 900)
    (m,) = logs.mappers(found).collect()
    assert [r.path for r in logs.slowest(found, 1).collect()] == ["a/b"] and logs.processing_share(found).first().pct == 55.0
    assert {r.metric: r.max for r in logs.summary(found).collect()} == {"records": 5, "total_ms": 30, "process_ms": 20, "iterator_ms": 7}
    assert {r.kind: r["count"] for r in logs.failures_by_kind(found).collect()} == {"warc_signal_sigkill": 1, "warc_exit_nonzero": 1}
    assert (m.container, m.warc_total_ms, m.init_ms, m.jitter_ms, m.warcs) == ("c1", 40, 12, 1500, 2)


@pytest.mark.parametrize(
    "bad",
    [{}, {"layer": []}, {"layer": [{"role": "x", "asns": [1]}]}, {"layer": [{"id": "a", "asns": [1]}]}, {"layer": [{"id": "a", "role": "r"}]}, {"layer": [{"id": "a", "role": "r", "asns": ["1"]}]}, {"layer": [{"id": "a", "role": "r", "signals": [{"header": "x", "contains": "a", "regex": "b"}]}]}, {"layer": [{"id": "a", "role": "r", "signals": [{"header": "x", "regex": "("}]}]}, {"layer": [{"id": "a", "role": "r", "signals": [{"contains": "x"}]}]}, {"layer": [{"id": "a", "role": "r", "asns": [1]}] * 2}, {"layer": [{"id": "a", "role": "r", "asns": [1], "name_prefixes": [1]}]}],
)
def test_bad_layers(bad):
    with pytest.raises(ValueError):
        config.parse_layers(bad)


@pytest.mark.parametrize("bad", [{}, {"family": [{"id": "a"}]}, {"family": [{"label": "a"}]}, {"family": [{"id": "a", "label": "b", "prefixes": [""]}]}, {"family": [{"id": "a", "label": "b"}] * 2}, {"family": [{"id": "a", "label": "b"}], "well_known": {"names": "x"}}])
def test_bad_families(bad):
    with pytest.raises(ValueError):
        config.parse_families(bad)


def test_alphabet(tmp_path):
    assert config.parse_alphabet({"headers": ["B", "a", "b"]}) == ("b", "a")
    for bad in ({}, {"headers": []}, {"headers": [1]}):
        with pytest.raises(ValueError):
            config.parse_alphabet(bad)
    (tmp_path / "a.toml").write_text('headers = ["x"]')
    assert config.alphabet(str(tmp_path / "a.toml")) == ("x",) and len(config.alphabet()) == 16
