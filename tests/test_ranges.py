"""Addresses and ranges against Python's own address module."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import ranges as R
from wardline.plans.scan import analyze
from wardline.policy import Policy
from wardline.registry import Registry, Signature
from wardline.sources import telemetry

TEXTS = [
    "1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "1.2.3.4:80", "", " 10.0.0.1 ",
    "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
    "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::1:2:3:4:5:6:7", "1::2::3", ":::", ":1", "1:", "12345::", "g::", "::ffff:1.2.3.4",
    "::1.2.3.4", "64:ff9b::10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "fe80::1%lo0",
    "[2001:db8::5]", "localhost", "api.openai.com", "::ffff:0:0", "::FFFF:A00:1",
]


def python_hex(text):
    bare = text.strip().strip("[]").split("%")[0]
    try:
        found = ipaddress.ip_address(bare)
    except ValueError:
        return None
    if found.version == 6 and found.ipv4_mapped:
        found = found.ipv4_mapped
    return f"{int(found):0{found.max_prefixlen // 4}x}"


def test_addresses(spark):
    rng = random.Random(5)
    texts = TEXTS + [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.hex for r in R.with_address(df, "t", "hex").collect()}
    assert got == {t: python_hex(t) for t in texts} | {None: None}


def plain_owner(text, table):
    found = python_hex(text) if text is not None else None
    if found is None:
        return None
    best = None
    for cidr, owner in table:
        try:
            net = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        if net.version == 6 and net[0].ipv4_mapped and net.prefixlen >= 96:
            net = ipaddress.ip_network(f"{net[0].ipv4_mapped}/{net.prefixlen - 96}")
        if net.max_prefixlen // 4 == len(found) and int(net[0]) <= int(found, 16) <= int(net[-1]):
            rank = (-net.prefixlen, owner)
            best = rank if best is None or rank < best else best
    return best and best[1]


def ranges_and_addresses():
    rng = random.Random(7)
    table = [("10.0.0.0/8", "b"), ("10.0.0.0/8", "a"), ("10.1.2.3/16", "c"), ("0.0.0.0/0", "z"), ("10.1.2.3", "d"),
             ("::/0", "y"), ("2001:db8::/33", "e"), ("::ffff:10.1.0.0/120", "f"), ("::ffff:0:0/90", "g"), ("1.2.3.0/33", "h"),
             ("1.2.3.0/-1", "h"), ("1.2.3.0/", "h"), ("x/8", "h"), ("1.2.3.0/024", "h"), (None, "h"), ("9.0.0.0/8", None)]
    for _ in range(300):
        bits = rng.randrange(4, 33)
        table.append((f"{ipaddress.IPv4Address(10 << 24 | rng.getrandbits(24))}/{bits}", f"o{rng.randrange(40)}"))
        table.append((f"{ipaddress.IPv6Address(0x20010db8 << 96 | rng.getrandbits(96))}/{rng.randrange(30, 129)}", f"o{rng.randrange(40)}"))
    texts = [*TEXTS, None, "10.1.2.3", "10.1.2.4"] + [str(ipaddress.IPv4Address(10 << 24 | rng.getrandbits(24))) for _ in range(200)]
    texts += [str(ipaddress.IPv6Address(0x20010db8 << 96 | rng.getrandbits(96))) for _ in range(100)] + ["10.9.9.9"] * 100
    return table, texts


@pytest.mark.parametrize("broadcast_bytes", [8_000_000, 0])
def test_longest_range_in_both_ways(spark, broadcast_bytes):
    table, texts = ranges_and_addresses()
    ranges = spark.createDataFrame(table, "cidr string, owner string")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, address string").repartition(3)
    usable = [(c, o) for c, o in table if c and o and "/0" + c.split("/")[-1][1:] != "/" + c.split("/")[-1] or c in ("0.0.0.0/0", "::/0")]
    got = R.join_range_owner(df, "address", ranges, "owner", broadcast_bytes=broadcast_bytes)
    assert got.columns == ["k", "address", "owner"]
    assert {r.k: r.owner for r in got.collect()} == {k: plain_owner(t, usable) for k, t in enumerate(texts)}


def test_many_ranges_are_no_literals_and_small_ones_need_no_shuffle(spark):
    addresses = spark.range(50).selectExpr("concat('10.0.', id, '.7') AS address")
    many = spark.range(100_000).selectExpr(
        "concat(10 + id DIV 16777216, '.', id DIV 65536 % 256, '.', id DIV 256 % 256, '.', id % 256, '/', 20 + id % 11) AS cidr",
        "concat('owner-of-network-', id % 7) AS owner",
    )
    large = R.join_range_owner(addresses, "address", many, "owner", broadcast_bytes=1000)
    plan = large._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "owner-of-network-3" not in plan
    assert large.count() == 50
    small = R.join_range_owner(addresses, "address", many.limit(100).persist(), "owner")
    plan = small._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_many_ranges_from_few_rows_are_not_broadcast(spark, tmp_path):
    # a small file whose rows are exploded looks small to Spark on either side of the join
    spark.range(100).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    addresses = few.selectExpr("concat('10.0.', id, '.7') AS address")
    many = few.selectExpr("id", "explode(sequence(0, 49)) AS k").selectExpr(
        "concat('10.', k, '.', id, '.0/', 20 + k % 5) AS cidr", "concat('owner-', id) AS owner"
    )
    out = R.join_range_owner(addresses, "address", many, "owner", broadcast_bytes=0)
    assert "SortMergeJoin [width" in out._jdf.queryExecution().sparkPlan().toString()
    assert {r.address: r.owner for r in out.collect()}["10.0.9.7"] == "owner-0"


def test_no_ranges(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "address string")
    none = spark.createDataFrame([], "cidr string, owner string")
    assert R.join_range_owner(df, "address", none, "owner").collect()[0].owner is None


def test_findings_only_where_asked_for(spark):
    registry = Registry.of([Signature("svc", "Service", "1", 40, domains=("svc.com",), ip_ranges=("10.0.0.0/8",))])
    rows = [("h", "10.1.1.1", 443), ("h", "11.1.1.1", 443), ("h", "svc.com", 443), ("h", None, 443)]
    df = spark.createDataFrame(rows, "host string, remote_ip string, port int").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    table = R.registry_ranges(spark, registry)
    without = analyze(telemetry.connection_events(df, registry), registry, Policy())
    assert [r.event.remote_ip for r in without.collect()] == ["svc.com"]
    found = analyze(telemetry.connection_events(df, registry, ranges=table), registry, Policy(), ranges=table)
    assert sorted((r.event.remote_ip, r.signature_id) for r in found.collect()) == [("10.1.1.1", "svc"), ("svc.com", "svc")]


def test_a_stream_is_matched_too(spark, tmp_path):
    spark.createDataFrame([("10.1.1.1",), ("x",)], "address string").write.parquet(str(tmp_path / "in"))
    ranges = spark.createDataFrame([("10.0.0.0/8", "a")], "cidr string, owner string")
    stream = spark.readStream.schema("address string").parquet(str(tmp_path / "in"))
    out = R.join_range_owner(stream, "address", ranges, "owner")
    query = out.writeStream.format("memory").queryName("ranged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.address, r.owner) for r in spark.table("ranged").collect()) == [("10.1.1.1", "a"), ("x", None)]
