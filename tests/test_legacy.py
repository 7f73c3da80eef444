"""Old results as a store: against the store of the same responses, in one shard and in several."""

import json

import pytest
from pyspark.sql import functions as F

from headloom.functions import hll
from headloom.plans import legacy, store
from headloom.queries import generated_notes, testbed
from tests.conftest import SF


def nested(rows, value):
    """Rows of keys and a value as maps in maps."""
    out = {}
    for *path, x in rows:
        at = out
        for k in path[:-1]:
            at = at.setdefault(str(k), {})
        at[str(path[-1])] = x
    return out


def packed(rows, width):
    out = {}
    for *keys, idx, rho in rows:
        at = out.setdefault(tuple(keys), [0] * width)
        if idx < width:
            at[idx] = rho
    return out


def old_lines(spark, path, shards=1, width=None):
    """The lines that the older form would hold for a store; each value is dealt over shards, registers by index."""
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{path}/{n}").collect()]
    get = lambda n: nested([r for r in spark.read.parquet(f"{path}/{n}").select(*store.SUMS[n].keys, *store.SUMS[n].sums).collect()], None)

    def regs(n, strip=False):
        kept = store.SUMS[n]
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/{n}.sites").select(*kept.keys, "idx", "rho").collect()]
        return packed(rows, width or 1 << kept.p)

    def recipes(n):
        return {"occ": get(n), "hlls": {k[0]: v for k, v in regs(n).items()}}

    (responses,) = (r[0] for r in read("responses"))
    values = [("globals", {
        "total_responses": responses, "field_counts": get("fields"), "unprocessed_counts": get("unregistered"), "severity_counts": get("severity"), "layer_counts": get("layers"), "asn_counts": get("networks"),
        "field_bytes": get("bytes"), "header_block_hist": get("blocks"), "field_counts_by_layer": get("field_layers"), "sites_hll": regs("responses")[()], "run_context": {"crawl": "old"}, "truncated_asn_counts": True,
    })]
    notes = {k: {"count": n} for k, n in read("notes")}
    for n, field in (("note_layers", "by_layer"), ("note_vars", "vars")):
        for k, v in get(n).items():
            notes[k][field] = v
    for (k,), v in regs("notes").items():
        notes[k]["sites_hll"] = v
    for r in spark.read.parquet(f"{path}/largest_lines").collect():
        notes[r.note_id].setdefault("numeric_maxes", {}).setdefault("field_size", {})[r.field_name] = r.largest
    for r in spark.read.parquet(f"{path}/note_samples").collect():
        notes[r.note_id].setdefault("samples", []).append({"url": r.url, "site": r.site, "vars": {"x": "y"}})
    for r in spark.read.parquet(f"{path}/var_samples").collect():
        notes[r.note_id].setdefault("var_samples", {}).setdefault(r["var"], {}).setdefault(r.val, []).append({"url": r.url, "site": r.site, "vars": {"field_values": r.field_values}})
    values += [(f"note:{k}", v) for k, v in notes.items()]
    values.append(("csp_sizes", {r.site: r.size for r in spark.read.parquet(f"{path}/policies").collect()}))
    values.append(("value_histograms", get("lifetimes")))
    values.append(("vary", {"responses_with_vary": 1, "recipes": recipes("vary"), "marginals": recipes("vary_tokens")}))
    values.append(("cache_control", {"recipes": recipes("cache_control"), "marginals": recipes("cache_tokens")}))
    values.append(("cooccur", {"responses": responses, "bundles": recipes("bundles"), "marginals": recipes("bundle_tokens"), "pairs": recipes("bundle_pairs"), "by_layer": get("bundle_layers")}))
    values.append(("note_cooccur", {"bundles": recipes("note_bundles"), "marginals": recipes("note_marginals"), "pairs": recipes("note_pairs")}))
    moved = {k: {"occ": v, "hlls": {}} for k, v in get("transitions").items()}
    for (pair, category), v in regs("transitions").items():
        moved[pair]["hlls"][category] = v
    values.append(("transition", {"pairs": moved}))
    return [[f"{json.dumps(k)}\t{json.dumps(share(v, i, shards, k))}" for k, v in values] for i in range(shards)]


def share(v, i, n, key=""):
    """A shard's part of a value: numbers are split, registers and samples dealt out, maxima kept in one."""
    if isinstance(v, bool) or n == 1:
        return v
    if isinstance(v, dict):
        return {k: (x if i == 0 else 0) if key in ("csp_sizes", "field_size") else share(x, i, n, k) for k, x in v.items()}
    if isinstance(v, list):
        return [x if j % n == i else 0 for j, x in enumerate(v)] if v and isinstance(v[0], int) else [x for j, x in enumerate(v) if j % n == i]
    return v // n + (i < v % n) if isinstance(v, int) else v


@pytest.fixture(scope="module")
def ours(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ours"))
    e = testbed.enriched(spark, SF)
    more = generated_notes.generated(spark, SF).filter("resp_id < 400").withColumn("asn", F.lit(None).cast("long"))
    both = e.select("resp_id", "url", "site", "asn", "layers", "crawl_ts", "headers", "notes").unionByName(more.select("resp_id", "url", "site", "asn", "layers", "crawl_ts", "headers", "notes"))
    both.write.parquet(f"{path}/enriched")
    store.save(spark.read.parquet(f"{path}/enriched"), f"{path}/store", crawl="new")
    return f"{path}/store"


def rows_of(spark, path, name):
    df = spark.read.parquet(f"{path}/{name}")
    return sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect()))), sorted(df.dtypes)


@pytest.mark.parametrize("shards", [1, 3])
def test_same_store(spark, ours, tmp_path, shards):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(old_lines(spark, ours, shards)):
        (tmp_path / "in" / f"part-{i}").write_text("\n".join([*lines, "", "broken", '"other"\t{}', '["list"]\t1', '"note:BAD\t{}']) + "\n")
    bad = legacy.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert bad.count() == 4 * shards
    names = [*store.SUMS, *store.LARGEST, *store.SAMPLES, *(f"{n}.sites" for n, k in store.SUMS.items() if k.rows)]
    for name in names:
        got, want = rows_of(spark, str(tmp_path / "out"), name), rows_of(spark, ours, name)
        assert got == want, name
    told = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "out" / "context")).collect()}
    assert told == {"crawl": "old", "truncated_asn_counts": "true"}
    merged = store.opened(spark, [ours, str(tmp_path / "out")])
    once = store.opened(spark, [ours])
    for name, key in (("notes", "note_id"), ("vary", "recipe"), ("bundle_pairs", "pair")):
        twice = {r[key]: (r.occ, r.sites) for r in merged(name).collect()}
        assert twice == {r[key]: (2 * r.occ, r.sites) for r in once(name).collect()}


def test_unequal_widths(spark, ours, tmp_path):
    """Narrow registers fill what they can, wide ones are cut to what a store keeps."""
    for width in (16, 8192):
        (tmp_path / f"in{width}").mkdir()
        (tmp_path / f"in{width}" / "part-0").write_text("\n".join(old_lines(spark, ours, 1, width)[0]) + "\n")
        legacy.convert(spark, str(tmp_path / f"in{width}"), str(tmp_path / f"out{width}"))
    assert rows_of(spark, str(tmp_path / "out8192"), "notes.sites") == rows_of(spark, ours, "notes.sites")
    narrow = spark.read.parquet(str(tmp_path / "out16" / "notes.sites"))
    assert narrow.agg(F.max("idx")).first()[0] < 16 and rows_of(spark, str(tmp_path / "out16"), "notes") == rows_of(spark, ours, "notes")
    both = store.merged_registers(spark, [ours, str(tmp_path / "out16")], "notes")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, store.merged_registers(spark, [ours], "notes").collect()))
    wide = spark.createDataFrame([("k", i, 1) for i in range(300)], "note_id string, idx int, rho int")
    assert hll.union(wide, ["note_id"], 256).count() == 256


def test_no_results(spark, tmp_path):
    (tmp_path / "part-0").write_text("broken\n")
    with pytest.raises(ValueError):
        legacy.convert(spark, str(tmp_path), str(tmp_path / "out"))
