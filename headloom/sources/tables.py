"""Small dimension tables: top sites and IP prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_sites(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Second column of the first ``limit`` lines of ``rank,domain``; shorter lines use up the limit too."""
    lines = spark.read.text(path, wholetext=False).withColumn("at", F.monotonically_increasing_id())
    first = lines.orderBy("at").limit(limit)
    parts = F.split(F.trim("value"), ",")
    return first.filter(F.size(parts) >= 2).select(F.get(parts, 1).alias("site")).distinct()


def parse_v4(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else, leading zeros included."""
    part = r"(0|[1-9]\d{0,2})"
    ok = ip.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    value = F.get(n, 0) * 16777216 + F.get(n, 1) * 65536 + F.get(n, 2) * 256 + F.get(n, 3)
    return F.when(ok & F.forall(n, lambda x: x <= 255), value)


def parse_v6(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, or null. Handles ``::``; embedded IPv4 and zones are not taken."""
    low = F.lower(ip)
    halves = F.split(low, "::", 3)
    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    left = groups(halves[0])
    right = F.when(F.size(halves) > 1, groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    fine = (F.size(halves) == 1) & (gap == 0) | (F.size(halves) == 2) & (gap >= 1)
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    fine = fine & F.forall(every, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    return F.when(low.contains(":") & fine, F.array_join(F.transform(every, lambda x: F.lpad(x, 4, "0")), ""))


def masked_v4(value: Column, length: Column) -> Column:
    step = F.pow(F.lit(2.0), 32 - length).cast("long")
    return value - value % step


def masked_v6(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of 32 hex digits: whole digits, then one cut digit."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2.0), 4 - rest).cast("int")
    cut = F.when(rest == 0, "").otherwise(F.lower(F.conv((digit - digit % step).cast("string"), 10, 16)))
    return F.rpad(F.concat(F.left(digits, whole), cut), 32, "0")


def prefixes(lines: DataFrame) -> DataFrame:
    """``value``: prefix, length, AS field, tab-separated. Returns ver, len, net, asn; the first line of a prefix counts,
    host bits are masked, and of several AS numbers the first counts."""
    parts = F.split(F.trim("value"), "\t")
    rows = lines.withColumn("at", F.monotonically_increasing_id()).filter(~F.trim("value").startswith("#") & (F.size(parts) >= 3))
    rows = rows.select("at", F.get(parts, 0).alias("p"), F.get(parts, 1).try_cast("int").alias("len"), F.regexp_extract(F.get(parts, 2), r"(\d+)", 1).try_cast("long").alias("asn"))
    v4, v6 = parse_v4(F.col("p")), parse_v6(F.col("p"))
    four = v4.isNotNull() & F.col("len").between(0, 32)
    six = v6.isNotNull() & F.col("len").between(0, 128)
    net = F.when(four, masked_v4(v4, F.col("len")).cast("string")).when(six, masked_v6(v6, F.col("len")))
    rows = rows.select("at", F.when(four, 4).when(six, 6).alias("ver"), "len", net.alias("net"), "asn").filter("net is not null and asn is not null")
    first = F.row_number().over(Window.partitionBy("ver", "len", "net").orderBy("at"))
    return rows.withColumn("nth", first).filter("nth = 1").select("ver", "len", "net", "asn")


def lookup_asn(df: DataFrame, table: DataFrame, ip_col: str = "ip", out: str = "asn") -> DataFrame:
    """Longest-prefix match by one equi-join per address: every distinct prefix length of the table (at most 161)
    gives a masked address to look up, and the longest hit counts. Distinct addresses are looked up once."""
    lengths: dict[int, list[int]] = {4: [], 6: []}
    for r in table.select("ver", "len").distinct().collect():
        lengths[r["ver"]].append(r["len"])
    ips = df.select(F.col(ip_col).alias("_ip")).filter("_ip is not null").distinct()
    v4, v6 = parse_v4(F.col("_ip")), parse_v6(F.col("_ip"))
    keys = [F.struct(F.lit(4).alias("ver"), F.lit(n).alias("len"), masked_v4(v4, F.lit(n)).cast("string").alias("net")) for n in sorted(lengths[4])]
    more = [F.struct(F.lit(6).alias("ver"), F.lit(n).alias("len"), masked_v6(v6, F.lit(n)).alias("net")) for n in sorted(lengths[6])]
    if not keys and not more:
        return df.withColumn(out, F.lit(None).cast("long"))
    kind = "array<struct<ver: int, len: int, net: string>>"
    tries = F.when(v4.isNotNull(), F.array(*keys).cast(kind) if keys else F.array().cast(kind)).otherwise(F.array(*more).cast(kind) if more else F.array().cast(kind))
    probes = ips.select("_ip", F.explode(tries).alias("k")).select("_ip", "k.*")
    hits = probes.join(table, ["ver", "len", "net"]).groupBy("_ip").agg(F.max_by("asn", "len").alias(out))
    return df.join(hits, df[ip_col] == hits["_ip"], "left").drop("_ip")
