from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.functions import draws as R
from flowtide.operators import splits as P
from flowtide.sources import captures as CP
from flowtide.sources import flow_csv as V
from flowtide.sources import flow_table as FT


@pytest.fixture()
def csv(tmp_path):
    def write(name: str, rows: list[dict]):
        lines = [",".join(V.HEADER)]
        for r in rows:
            base = {c: "0" for c in V.HEADER if c.startswith("FLAG_")} | {c: "POISON" for c in ("SRC_IP", "DST_IP", "DST_ASN", "DST_PORT", "TLS_SNI", "TLS_JA3")}
            base |= {"TIME_FIRST": "2022-01-03T10:00:00", "DURATION": "1.5", "BYTES": "10", "BYTES_REV": "20", "PACKETS": "1", "PACKETS_REV": "2",
                     "PROTOCOL": "6", "APP": "a", "CATEGORY": "c", "PPI": '"[[0,5],[1,-1],[100,9999],[1,0]]"', "PPI_LEN": "2"} | r
            lines.append(",".join(str(base.get(c, "")) for c in V.HEADER))
        (tmp_path / name).write_text("\n".join(lines) + "\n" if rows else "")
        return str(tmp_path)

    return write


def test_scan_reads_the_allowed_columns_only(spark, csv):
    path = csv("flows-20220103.csv", [{}, {"FLAG_SYN_REV": "1", "FLAG_PSH": "1"}])
    csv("flows-20220104.csv", [])
    raw = V.scan(spark, path)
    assert raw.columns == [*V.READ, "source_file"] and raw.count() == 2
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "SRC_IP" not in plan.split("ReadSchema")[1]
    flows = V.parse(raw)
    assert not [r for r in flows.collect() if "POISON" in str(r)]
    r = flows.orderBy(F.col("flags_seen").desc()).first()
    assert r["flags_seen"] == 2 | 8 and r["period"] == "WEEK-2022-01" and [p["size"] for p in r["ppi"]] == [100, 1500]


def test_xz_files_are_read_alike(spark, csv, tmp_path, monkeypatch):
    import lzma

    monkeypatch.setattr(V, "XZ_BYTES", 700)
    csv("flows-20220103.csv", [{}, {"FLAG_SYN_REV": "1"}, {"PPI_LEN": "3"}])
    path, packed = str(tmp_path / "flows-20220103.csv"), str(tmp_path / "flows-20220103.csv.xz")
    with open(path, "rb") as f, lzma.open(packed, "wb") as g:
        g.write(f.read())
    plain = sorted(map(str, V.scan(spark, path).drop("source_file").collect()))
    raw = V.scan(spark, packed)
    assert sorted(map(str, raw.drop("source_file").collect())) == plain and len(plain) == 3
    assert {r["source_file"] for r in raw.collect()} == {"flows-20220103.csv.xz"}
    assert V.scan(spark, [path, packed]).count() == 6
    with lzma.open(str(tmp_path / "flows-20220105.csv.xz"), "wb") as g:
        g.write(b"a,b\n1,2\n")
    with pytest.raises(Exception, match="header"):
        V.scan(spark, str(tmp_path / "flows-20220105.csv.xz")).collect()


def test_wrong_length_raises_or_is_set_apart(spark, csv):
    path = csv("flows-20220103.csv", [{}, {"PPI_LEN": "3"}])
    raw = V.scan(spark, path)
    with pytest.raises(Exception, match="declared length"):
        V.parse(raw).collect()
    good, bad = V.quarantine(V.parse(raw, strict=False))
    assert good.count() == 1 and bad.count() == 1


def test_bad_file_name_raises(spark, csv):
    path = csv("flows-2022.csv", [{}])
    with pytest.raises(Exception, match="not a flow file name"):
        V.parse(V.scan(spark, path)).collect()


@pytest.mark.parametrize(
    ("day", "label"),
    [("2022-01-01", "WEEK-2022-00"), ("2022-01-02", "WEEK-2022-00"), ("2022-01-03", "WEEK-2022-01"), ("2022-01-09", "WEEK-2022-01"),
     ("2022-06-15", "WEEK-2022-24"), ("2022-12-31", "WEEK-2022-52"), ("2019-12-31", "WEEK-2020-01")],
)
def test_week_labels(spark, day, label):
    from flowtide.functions.labels import week_label

    assert spark.range(1).select(week_label(F.lit(day).cast("date")).alias("w")).first()["w"] == label


def test_guarded_writer(spark, tmp_path):
    ppi = "array<struct<ipt:int,dir:int,size:int,push:int>>"
    flows = spark.createDataFrame(
        [(1, [(0, 1, 5, 0)], 1, 0, "d", "p"), (2, [], 0, 1, "d", "p")], f"flow_id bigint, ppi {ppi}, ppi_len int, label int, dataset string, period string"
    )
    path = str(tmp_path / "t")
    FT.write(flows, path)
    assert FT.scan(spark, path).count() == 1
    with pytest.raises(FileExistsError):
        FT.write(flows, path)
    with pytest.raises(ValueError, match="unknown label"):
        FT.write(flows.withColumn("label", F.lit(-1)), path, overwrite=True)
    with pytest.raises(ValueError, match="reserved"):
        FT.write(flows, path, overwrite=True, meta={"n_flows": "1"})
    with pytest.raises(KeyError):
        FT.require(spark.createDataFrame([("a", "b")], "name string, sha256 string"), "x")


def frame(proto=6, payload=100, flags=0x18, version=4, kind=b"\x08\x00", offset=0, link=CP.ETHERNET):
    l4 = struct.pack(">HHIIBBHHH", 1000, 443, 0, 0, 5 << 4, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", 1000, 443, 8 + payload, 0)
    if version == 4:
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + payload, 0, offset, 64, proto, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    else:
        ip = struct.pack(">IHBB16s16s", 6 << 28, len(l4) + payload, proto, 64, b"\1" * 16, b"\2" * 16)
    head = {CP.ETHERNET: b"\0" * 12 + kind, CP.NULL_LINK: b"\2\0\0\0", CP.RAW: b"", CP.COOKED: b"\0" * 14 + kind}[link]
    return head + ip + l4


def test_frames_are_decoded_and_skips_named():
    src, sport, dst, dport, proto, size, flags, skip = CP.packet(frame(), CP.ETHERNET)
    assert (sport, dport, proto, size, flags, skip) == (1000, 443, 6, 100, 0x18, None) and src == b"\x0a\0\0\1"
    assert CP.packet(frame(17, 60), CP.ETHERNET)[5] == 60
    assert CP.packet(frame(version=6, kind=b"\x86\xdd"), CP.ETHERNET)[5] == 100
    for link in (CP.RAW, CP.NULL_LINK, CP.COOKED):
        assert CP.packet(frame(link=link), link)[5] == 100
    assert CP.packet(frame(kind=b"\x08\x06"), CP.ETHERNET)[-1] == "non_ip"
    assert CP.packet(frame(offset=5), CP.ETHERNET)[-1] == "malformed"
    assert CP.packet(frame(payload=-30), CP.ETHERNET)[-1] == "malformed"
    assert CP.packet(frame()[:30], CP.ETHERNET)[-1] == "malformed"
    tagged = b"\0" * 12 + b"\x81\x00\0\1" + b"\x08\x00" + frame(link=CP.RAW)
    assert CP.packet(tagged, CP.ETHERNET)[5] == 100
    twice = b"\0" * 12 + b"\x81\x00\0\1" + b"\x81\x00\0\1" + b"\x08\x00" + frame(link=CP.RAW)
    assert CP.packet(twice, CP.ETHERNET)[-1] == "tunnelled"


def test_capture_files_of_both_formats(spark, tmp_path):
    f = frame()
    classic = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 5, 7_000, len(f), len(f)) + f
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    pad = f + b"\0" * (-len(f) % 4)
    ng = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(
        6, struct.pack("<IIIII", 0, 0, 5_000_007, len(f), len(f)) + pad
    )
    (tmp_path / "a.pcap").write_bytes(classic)
    (tmp_path / "b.pcapng").write_bytes(ng)
    rows = CP.decode(CP.read(spark, str(tmp_path))).orderBy("path").collect()
    assert [r["ts_us"] for r in rows] == [5_000_007, 5_000_007] and all(r["payload_len"] == 100 for r in rows)
    with pytest.raises(ValueError):
        list(CP.frames(b"nonsense"))


def test_leakage_rules_raise(spark):
    spec = {"train": {"periods": ["a"]}, "val": {"periods": ["a"]}}
    with pytest.raises(P.LeakageError):
        P.assert_no_overlap(P.split_table(spark, spec))
    spec = {"train": {"periods": ["a"], "session_ids": [1, 2]}, "val": {"periods": ["a", "b"], "session_ids": [2, 3]}}
    with pytest.raises(P.LeakageError):
        P.assert_no_overlap(P.split_table(spark, spec))
    spec["val"]["session_ids"] = [3]
    P.assert_no_overlap(P.split_table(spark, spec))
    hashes = spark.createDataFrame([("train", "x"), ("val", "y")], "split string, standardizer_hash string")
    with pytest.raises(P.LeakageError):
        P.assert_one_standardizer(hashes)
    flows = spark.createDataFrame([("train", 0, 1, 10), ("train", 0, -1, 20), ("val", 1, 1, 20), ("val", 1, 1, 30)], "split string, ord int, label int, ts bigint")
    none = spark.createDataFrame([], "label int")
    with pytest.raises(P.LeakageError):
        P.assert_training_labels(flows, none)
    with pytest.raises(P.LeakageError):
        P.assert_temporal_order(flows)
    with pytest.raises(P.LeakageError):
        P.assert_small_trim(flows)
    assert P.trim_boundaries(flows).count() == 3
    P.assert_temporal_order(P.trim_boundaries(flows))


def test_label_space(spark):
    space = P.label_space(spark, [4, 2], [7])
    rows = spark.createDataFrame([(2,), (4,), (7,), (-1,)], "label int")
    assert [r["model_idx"] for r in P.to_model(rows, space).orderBy("label").collect()] == [-1, 0, 1, -1]
    with pytest.raises(Exception, match="not in the label space"):
        P.to_model(spark.createDataFrame([(9,)], "label int"), space).collect()
    for known, unknown in (([], []), ([1], [1]), ([-2], [])):
        with pytest.raises(ValueError):
            P.label_space(spark, known, unknown)


def test_open_set_draw_counts_and_support(spark):
    prof = spark.createDataFrame([(c, 10 * c, c % 3) for c in range(30)], "label int, support bigint, category int")
    a = P.draw_open_set(prof, 15, 7, 50, R.hashed(1))
    roles = {r["label"]: r["role"] for r in a.collect()}
    assert list(roles.values()).count("unknown") == 7 and list(roles.values()).count("known") == 15
    assert all(10 * c >= 50 for c, r in roles.items() if r == "unknown")
    b = {r["label"] for r in P.draw_open_set(prof, 15, 7, 50, R.hashed(2)).where("role = 'unknown'").collect()}
    assert b != {c for c, r in roles.items() if r == "unknown"}
    with pytest.raises(ValueError):
        P.draw_open_set(prof, 30, 7, 50, R.hashed(1))


def test_sampling_does_not_depend_on_partitions(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderkey")
    a = P.sample_rows(rows, 0.2, 1, F.col("o_orderkey"))
    assert a.exceptAll(P.sample_rows(rows.repartition(5), 0.2, 1, F.col("o_orderkey"))).isEmpty()
    assert 0.1 < a.count() / rows.count() < 0.3


def test_draws_differ_2_to_31_apart_and_take_strings(spark):
    rows = spark.createDataFrame([(i + j * 2**31, f"k{i}") for i in range(50) for j in (0, 1)], "id bigint, name string")
    d = rows.select("name", R.hashed(4)("x", F.col("id")).alias("d"), R.hashed(4)("x", F.col("name")).alias("e"))
    assert d.select("d").distinct().count() == 100 and d.select("e").distinct().count() == 50
    assert P.subsample(rows.select("name").distinct(), 20, R.hashed(1), "name").count() == 20


def _tcp(i, extra=b""):
    tcp = struct.pack(">HHIIBBHHH", 1000 + i % 50, 443, 0, 0, 5 << 4, 16, 0, 0, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(extra), 0, 0, 64, 6, 0, bytes([10, 0, 0, i % 7]), bytes([10, 0, 0, 200]))
    return b"\0" * 12 + b"\x08\x00" + ip + tcp + extra


def _classic(frames, order="<"):
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    return b"".join(out + [struct.pack(order + "IIII", 1_700_000_000 + i, i, len(f), len(f)) + f for i, f in enumerate(frames)])


def _blocks(frames, order="<"):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    section = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out = [section, block(1, struct.pack(order + "HHI", 1, 0, 0))]
    for i, f in enumerate(frames):
        if i == len(frames) // 2:
            # a second section whose first interface has another clock, and a second interface
            out += [section, block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0)), block(1, struct.pack(order + "HHI", 101, 0, 0))]
        who, data = (1, f[14:]) if i > len(frames) // 2 and i % 5 == 0 else (0, f)
        out.append(block(6, struct.pack(order + "IIIII", who, 0, 1_000_000 + i * 7, len(data), len(data)) + data))
    return b"".join(out)


def test_captures_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CP, "HELD_BYTES", 64)
    fake = b"".join(struct.pack("<IIII", 1_700_000_000 + k, 0, 4, 4) + b"abcd" for k in range(40))
    frames = [_tcp(i, fake if i % 9 == 4 else b"x" * (i % 200)) for i in range(120)]
    (tmp_path / "a.pcap").write_bytes(_classic(frames))
    (tmp_path / "b.pcap").write_bytes(_classic(frames[:100], ">")[:-3])
    (tmp_path / "c.pcapng").write_bytes(_blocks(frames))
    (tmp_path / "d.pcapng").write_bytes(_blocks(frames[:50], ">"))
    (tmp_path / "e.pcap").write_bytes(_classic([]))
    (tmp_path / "f.pcap").write_bytes(_classic([_tcp(0, b"y" * 9000), *frames[:30]]))
    want = CP.decode(CP.read(spark, str(tmp_path)))
    for size in (3000, None):
        got = CP.scan(spark, str(tmp_path), size=size)
        assert got.count() == want.count() == 120 + 100 + 120 + 50 + 31
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # records inside a payload were taken for a first record and walked again
    data = (tmp_path / "a.pcap").read_bytes()
    read, (head, _) = CP.reader(data), CP.head_of(CP.reader(data))
    true = {at for at, _, _, _ in CP.records(read, 24, len(data), head)}
    guesses = {CP.first_record(read, k, k + 700, len(data), head) for k in range(700, len(data), 700)}
    assert guesses - true - set(range(700, len(data) + 700, 700))


def test_files_are_hashed_as_streams(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"ab" * 5_000_000)
    (tmp_path / "y.bin").write_bytes(b"c")
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in FT.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {n: ((tmp_path / n).stat().st_size, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in ("x.bin", "y.bin")}


def test_many_small_captures_share_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.pcap").write_bytes(_classic([_tcp(i, b"x" * i) for i in range(9)]))
    got = CP.scan(spark, str(tmp_path), size=300)
    assert got.count() == 60 * 9 and got.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_the_audited_table_is_not_written_by_one_task(spark, sf, monkeypatch):
    from flowtide.plans import ingest as I
    from flowtide.session import configure

    plans, write = [], FT.write
    monkeypatch.setattr(FT, "write", lambda flows, path: plans.append(flows._jdf.queryExecution().optimizedPlan().toString()) or write(flows.repartition(3), path))
    got = sorted(tuple(r) for r in I.completeness_audit(configure(spark), sf).collect())
    assert "Repartition 1, false" not in plans[0]
    assert got == [("WEEK-2024-03", "file rows do not add up"), ("WEEK-2024-03", "row count differs")]
