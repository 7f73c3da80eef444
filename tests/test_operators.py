import pytest
from pyspark.sql import functions as F

from headloom.functions import headers as H
from headloom.functions import hll
from headloom.operators import census, cooccur, counters, findings, ranking, recipes, timing, transition
from headloom.plans import report, rules, store
from headloom.plans.enrich import enrich, keep_sites
from headloom.streaming.incremental import merge_registers, windowed_counts

SCHEMA = "resp_id long, url string, site string, crawl_ts double, headers array<struct<name: string, value: string>>"


def made(spark, *lists, sites=None):
    rows = [(i, f"http://s{i}.example/", (sites or {}).get(i, f"s{i}.example"), 1782728294.0, list(h)) for i, h in enumerate(lists)]
    return enrich(spark.createDataFrame(rows, SCHEMA))


def pairs(df, *columns):
    return {tuple(r) if len(columns) > 2 else r[0]: r[1] if len(columns) == 2 else None for r in df.select(*columns).collect()}


def test_vary(spark):
    e = made(spark, [("vary", "Accept-Encoding, Cookie")], [("vary", "cookie"), ("vary", "accept-encoding")], [("vary", "User-Agent")], [("vary", "*")], [("x", "y")])
    assert pairs(recipes.vary_recipes(e), "recipe", "occ") == {"accept-encoding, cookie": 2, "user-agent": 1, "*": 1}
    assert pairs(recipes.vary_marginals(e), "token", "occ") == {"accept-encoding": 2, "cookie": 2, "user-agent": 1}
    assert pairs(recipes.vary_factored(e), "recipe", "occ") == {"cookie": 2, "user-agent": 1, "*": 1}


def test_cache_control(spark):
    e = made(spark, [("cache-control", "max-age=1, private, no-cache, no-store")], [("cache-control", "no-store, no-cache"), ("cache-control", "private, max-age=9")], [("cache-control", "public, max-age=5, x-edge-cache")])
    assert pairs(recipes.cc_recipes(e), "recipe", "occ") == {"max-age=N, no-cache, no-store, private": 2, "max-age=N, public, x-edge-cache": 1}
    assert pairs(recipes.cc_marginals(e), "token", "occ")["max-age"] == 3
    assert pairs(recipes.cc_nonstandard(e), "token", "occ") == {"x-edge-cache": 1}


def test_null_sites_count_but_are_no_site(spark):
    e = made(spark, [("vary", "a")], [("vary", "a")], sites={1: None})
    assert tuple(recipes.vary_recipes(e).first()) == ("a", 2, 1)


def test_lifts(spark):
    a, b = "strict-transport-security", "x-frame-options"
    lists = [[(a, "x"), (b, "DENY")]] * 6 + [[(b, "DENY")]] + [[]] * 3
    (r,) = cooccur.lifts(made(spark, *lists), F.array_sort(F.array_distinct(H.names(F.col("headers"))))).collect()
    assert (r.a, r.b, r.joint) == (a, b, 6)
    assert r.p_a_given_b == pytest.approx(6 / 7, abs=1e-6) and r.p_b_given_a == 1.0 and r.lift == pytest.approx(60 / 42, abs=1e-6)


def test_layer_default(spark):
    e = made(spark, [("server", "nginx")], [("server", "nginx")], [("server", "nginx"), ("x-frame-options", "DENY")])
    assert tuple(cooccur.layer_defaults(e, cooccur.security(e)).first()) == ("nginx", 3, "(none)", 0.666667)


def test_bytes(spark):
    e = made(spark, [("server", "nginx"), ("x-test", "abc"), ("x-crawler-a", "zzz"), ("x-test", "abc")], [])
    assert pairs(counters.header_bytes(e), "name", "bytes") == {"server": 15, "x-test": 26}
    assert counters.total_header_bytes(e).first()[0] == 41
    assert pairs(counters.block_histogram(e), "bucket", "responses") == {"<256 B": 2}
    assert pairs(counters.category_bytes(e), "category", "bytes") == {"standard": 15, "deprecated": 0, "proprietary": 26}
    assert pairs(counters.field_counts(e), "name", "occ")["x-crawler-a"] == 1 and pairs(counters.unregistered(e), "name", "responses") == {"x-test": 1}


def test_policy_sizes(spark):
    csp = "content-security-policy"
    e = made(spark, [(csp, "abc"), (csp, "de")], [(csp, "x")], [], sites={0: "a", 1: "a", 2: "b"})
    assert pairs(counters.policy_sizes(e), "site", "size") == {"a": 5, "b": 0}


def test_lifetimes(spark):
    date = ("date", "Mon, 29 Jun 2026 10:18:14 GMT")
    e = made(spark, [("cache-control", "max-age=3600, s-maxage=600"), ("age", "120")], [("cache-control", "max-age=0"), ("strict-transport-security", "max-age=31536000")], [date, ("expires", "Sun, 28 Jun 2026 10:18:14 GMT")], [("set-cookie", "a=b; Max-Age=86400; Expires=Mon, 29 Jun 2026 10:18:14 GMT"), ("set-cookie", "c=d; Expires=Wed, 29 Jul 2026 10:18:15 GMT"), ("set-cookie", "s=1")])
    found = {(r.histogram, r.bucket): r.occ for r in counters.value_histograms(e).collect()}
    assert found == {
        ("cache_control_max_age", "1-24 hours"): 1, ("cache_control_s_maxage", "10-60 min"): 1, ("age", "1-10 min"): 1, ("freshness_lifetime", "1-24 hours"): 1, ("cache_control_max_age", "0"): 1,
        ("freshness_lifetime", "0"): 1, ("hsts_max_age", "1-10 years"): 1, ("expires_date_delta", "negative"): 1, ("freshness_lifetime", "negative"): 1, ("cookie_lifetime", "1-7 days"): 1, ("cookie_lifetime", "30-365 days"): 1,
    }


def test_unmatched_layer(spark):
    e = made(spark, [("server", "nginx"), ("cf-ray", "1")], [])
    assert pairs(counters.layer_counts(e), "layer", "responses") == {"nginx": 1, "cloudflare": 1, "__unmatched__": 1}
    assert {r.layer for r in counters.field_by_layer(e).collect()} == {"nginx", "cloudflare"}


def test_lineage_and_severity(spark):
    csp = [("content-security-policy", "script-src 'unsafe-inline' 'unsafe-eval'"), ("strict-transport-security", "max-age=5")]
    e = made(spark, csp, [])
    found = pairs(findings.note_pairs(e), "pair", "occ")
    assert "CSP_UNSAFE_EVAL, CSP_UNSAFE_INLINE" in found and "CSP_UNSAFE_INLINE, HSTS_SHORT_MAX_AGE" in found
    assert not any("CONTENT_SECURITY_POLICY" in p or "HSTS_VALID" in p for p in found)  # their level is no defect
    assert pairs(counters.severity(e), "severity", "responses") == {"warn": 1, "clean": 1}
    assert pairs(findings.note_bundles(e), "bundle", "occ")["(none)"] == 1


def test_a_finding_and_its_ancestor_do_not_pair(spark):
    note = "struct<note_id: string, level: string, ancestors: array<string>, vars: map<string, string>>"
    rows = [(1, "s", [("A", "bad", [], {}), ("B", "info", ["A"], {}), ("C", "warn", ["A", "B"], {}), ("D", "warn", [], {}), ("E", "odd", [], {})])]
    e = spark.createDataFrame(rows, f"resp_id long, site string, notes array<{note}>")
    assert {r.pair for r in findings.note_pairs(e).collect()} == {"A, D", "C, D"}
    assert counters.severity(e).first().severity == "bad"


def test_samples_are_of_distinct_listed_sites(spark):
    lists = [[("pragma", "x")]] * 8
    e = made(spark, *lists, sites={6: "s1.example", 7: None})
    assert findings.note_samples(e).filter("note_id = 'FIELD_DEPRECATED'").count() == 5
    gate = spark.createDataFrame([("s1.example",)], "site string")
    got = findings.note_samples(e, gate).filter("note_id = 'FIELD_DEPRECATED'").collect()
    assert [r.site for r in got] == ["s1.example"]
    assert pairs(findings.note_counts(e), "note_id", "occ")["FIELD_DEPRECATED"] == 8
    assert keep_sites(e, gate).count() == 2


def test_captured_values_hold_no_secrets(spark):
    e = made(spark, [("pragma", "x?token=SEKRET&p=1"), ("cookie", "sid=SEKRET")])
    text = str([r.asDict() for r in findings.var_samples(e).collect()])
    assert "SEKRET" not in text and "[redacted]" in text


def test_rules(spark):
    long = [("set-cookie", "a=" + "x" * 5000), ("x-big", "y" * 9000), ("bad name", "1"), ("reporting-endpoints", "a=1,,b=2"), ("permissions-policy", "a=(), a=*")]
    e = made(spark, long)
    found = {r.note_id for r in findings.note_counts(e).collect()}
    assert {"SET_COOKIE_VALUE_TOO_LARGE", "FIELD_TOO_LARGE", "BAD_SYNTAX", "STRUCTURED_FIELD_PARSE_ERROR", "DUPLICATE_KEY"} <= found
    assert pairs(findings.numeric_max(e), "field_name", "largest") == {"x-big": 9009}
    values = {(r.var, r.val) for r in findings.note_vars(e).collect()}
    assert ("field_size_bucket", "8-16 KB") in values and ("cookie_value_size_bucket", "4-8 KB") in values and ("field_error", "reporting-endpoints: member expected") in values
    assert len({r.id for r in rules.rules()}) == len(rules.rules()) and set(rules.TRACKED) <= {r.id for r in rules.rules()}


def test_transitions(spark):
    old, new = ("x-frame-options", "DENY"), ("content-security-policy", "frame-ancestors 'none'")
    e = made(spark, *[[old, new]] * 1, *[[new]] * 3, *[[old]] * 2, *[[]] * 4)
    r = {x.pair: x for x in transition.rows(e).collect()}
    f = r["frame_options"]
    assert (f.both, f.modern_only, f.legacy_only, f.neither, f.modern_present, f.legacy_present, f.scoped) == (1, 3, 2, 4, 4, 3, 7)
    assert f.ratio == pytest.approx(4 / 7, abs=1e-6) and len(r) == 6 and r["reporting"].ratio is None and r["xss_protection"].legacy_only_pair
    assert {x.pair for x in transition.rows(e.filter("1 = 0")).collect()} == set(r)


def test_census(spark):
    e = made(spark, [("cf-ray", "1"), ("x-own-a", "1")], [("cf-ray", "1"), ("x-own-b", "2"), ("server", "x")])
    got = census.entries(e)
    assert pairs(census.clusters(got, "vendor", "c"), "c", "responses") == {"cloudflare": 2, "__unattributed__": 2}
    assert pairs(census.clusters(got, "prefix", "c"), "c", "members") == {"cf": "cf-ray", "x-own": "x-own-a, x-own-b"}
    t = census.totals(got).first()
    assert (t.names, t.responses, t.novel_names) == (3, 4, 3)


def test_ranking(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "k string, n int")
    assert [r.k for r in ranking.top(df, 2, "n", "k").collect()] == ["c", "a"] and ranking.cut(df, 2).first().truncated
    assert not ranking.cut(df, 3).first().truncated
    assert [r.k for r in ranking.top_in(df.withColumn("g", F.lit(1)), ["g"], 1, "n", "k").collect()] == ["c"]


def test_percentiles(spark):
    import statistics

    for values in ([5], [1, 2], list(range(1, 101)), [3, 3, 3, 9, 27, 1]):
        df = spark.createDataFrame([(1, v) for v in values], "g int, v long")
        r = timing.summary(df, ["g"], "v").first()
        s = sorted(values)
        at = lambda p: s[max(0, min(len(s) - 1, int(len(s) * p / 100) - 1))]
        assert (r.sum, r.mean, r.median, r.p90, r.p99, r.max) == (sum(s), int(statistics.mean(s)), int(statistics.median(s)), at(90), at(99), s[-1])


def test_stores_merge(spark, tmp_path):
    lists = [[("server", "nginx"), ("vary", "a"), ("content-security-policy", "x")], [("pragma", "no-cache")], [], [("cache-control", "max-age=5, public")]]
    made(spark, *lists).coalesce(1).write.parquet(str(tmp_path / "enriched"))
    whole = spark.read.parquet(str(tmp_path / "enriched"))
    store.save(whole.filter("resp_id < 2"), str(tmp_path / "1"), crawl="a")
    store.save(whole.filter("resp_id >= 2"), str(tmp_path / "2"), crawl="b", record_limit=9)
    both = [str(tmp_path / "1"), str(tmp_path / "2")]
    for name in ("responses", "notes", "vary", "transitions"):
        kept = store.SUMS[name]
        columns = [*kept.keys, *kept.sums]
        assert sorted(map(tuple, store.merged(spark, both, name).select(*columns).collect())) == sorted(map(tuple, store.aggregate(whole, name).select(*columns).collect())), name
        if kept.rows is not None:
            columns = [*kept.keys, "idx", "rho"]
            assert sorted(map(tuple, store.merged_registers(spark, both, name).select(*columns).collect())) == sorted(map(tuple, store.registers(whole, name).select(*columns).collect())), name
    for name in (*store.LARGEST, *store.SAMPLES):
        want = store.aggregate(whole, name)
        assert sorted(map(tuple, store.merged(spark, both, name).select(*want.columns).collect())) == sorted(map(tuple, want.collect())), name
    assert dict(store.merged_context(spark, both).collect()) == {"crawl": "a", "record_limit": "9"}
    get, direct = store.opened(spark, both), store.live(whole)
    # few sites: estimates of so few are exact
    for name in ("responses", "notes", "vary", "transition_rows"):
        want = direct(name)
        assert sorted(map(str, get(name).select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_narrower_registers(spark):
    rows = spark.createDataFrame([("k", i, 1 + i % 3) for i in range(256)], "key string, idx int, rho int")
    assert hll.union(rows, ["key"], 64).count() == 64


def test_records(spark, tmp_path):
    (tmp_path / "part-0").write_text('["a", "b"]\t{"n": 1}\nbroken\n["c"]\t{\n\n"k"\t2\n')
    (tmp_path / "other").write_text("x\n")
    good, bad = store.read_records(spark, str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [('"k"', "2"), ('["a", "b"]', '{"n": 1}')]
    assert sorted(r.line for r in bad.collect()) == ['["c"]\t{', "broken"]


def test_report(spark, tmp_path):
    e = made(spark, [("server", "nginx"), ("vary", "a|b"), ("pragma", "<x>")], [("set-cookie", "a=1")]).cache()
    parts = report.write(e, str(tmp_path / "r.html"), title="A & B")
    page, text = (tmp_path / "r.html").read_text(), (tmp_path / "r.md").read_text()
    assert "A &amp; B" in page and "a\\|b" in text and all(s.title in text for s in parts)
    assert page.count("<section") == len(parts) == text.count("\n## ")
    assert report.size_text(1536) == "1.5 KB" and report.markdown_path("a/b") == "a/b.md"
    assert any("missing by chance" in n for s in parts for n in s.notes)
    (noted,) = [s for s in parts if s.title == "Single headers of note"]
    assert [r[0] for r in noted.rows] == ["set-cookie"] and "set-cookie: clients" in text and "content-security-policy: the policy" not in text


def test_byte_callouts(spark):
    sizes = spark.createDataFrame([("set-cookie", 30), ("server", 50), ("content-security-policy", 20)], "name string, bytes long")
    assert sorted(map(tuple, counters.callouts_of(sizes).collect())) == [("content-security-policy", 20, 20.0), ("set-cookie", 30, 30.0)]
    assert counters.callouts_of(sizes.filter("name = 'server'")).count() == 0 and counters.callouts_of(sizes.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    rows = [(f"2026-01-01 00:0{i}:00", f"s{i % 3}", "nginx") for i in range(9)]
    df = spark.createDataFrame(rows, "t string, site string, layer string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "t", ["layer"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert tuple(spark.table("seen").select("layer", "responses", "sites").first()) == ("nginx", 9, 3)
    a = merge_registers(None, df.limit(4), ["layer"], "site")
    assert merge_registers(a, df, ["layer"], "site").count() == merge_registers(None, df, ["layer"], "site").count()
