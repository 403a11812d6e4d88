"""Capture files to packets, and the export join with their labels.

``scan`` reads capture files of any size in byte ranges, side by side. A range does not know where its first record
begins, so it looks for the first place from which a row of records hangs together, and says where its last record
ends. A range whose guess is not where the range before it ended is walked again from there, until all ranges of
a file join; only then are frames decoded, as streams of a few MB. ``decode`` does the same for captures that are
values already (``path``, ``content``), one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.session import cut

ETHERNET, NULL_LINK, RAW, RAW_ALT, COOKED = 1, 0, 101, 12, 113
SKIPS = ("non_ip", "non_tcp_udp", "malformed", "tunnelled")

OUT = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("pkt_no", T.LongType()), T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.BinaryType()), T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_ip", T.BinaryType()), T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.IntegerType()), T.StructField("payload_len", T.LongType()),
        T.StructField("flags", T.IntegerType()), T.StructField("skip", T.StringType()),
    ]
)


def read(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.pcap*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")


#: reads up to n bytes from a position; fewer at the end
Read = Callable[[int, int], bytes]
#: bytes of a range that one task reads, and that it holds at a time
RANGE_BYTES, HELD_BYTES = 64 << 20, 4 << 20
#: records in a row that a guessed first record has to lead to, and the longest frame a guess believes in
CHAIN, LONGEST_FRAME = 8, 1 << 18
NG = b"\x0a\x0d\x0d\x0a"


@dataclass
class Head:
    """What the bytes before a record say about it: byte order, and the link types of the interfaces."""

    order: str = "<"
    ng: bool = False
    nano: bool = False
    links: list[tuple[int, int]] = field(default_factory=list)  # link type, ticks per second of every interface

    def see(self, block: bytes) -> None:
        """Take up a section header or an interface description."""
        if block[:4] == NG:
            self.order, self.links = "<" if block[8:12] == b"\x4d\x3c\x2b\x1a" else ">", []
        else:
            body = block[8:-4]
            self.links.append((struct.unpack_from(self.order + "H", body)[0], _ticks(body[8:], self.order)))


def head_of(read: Read) -> tuple[Head, int]:
    """The head at the first record of a capture, and where that is."""
    start = read(0, 24)
    magic = start[:4]
    if magic == NG:
        return Head("<" if start[8:12] == b"\x4d\x3c\x2b\x1a" else ">", True), 0
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}.get(magic)
    if order is None:
        raise ValueError(f"not a capture file (magic {magic.hex()})")
    link = struct.unpack_from(order + "I", start, 20)[0] & 0xFFFF
    return Head(order, False, magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"), [(link, 0)]), 24


#: position, where the record ends, (microseconds, link type, frame) of a frame, bytes of a block that changes the head
Record = tuple[int, int, "tuple[int, int, bytes] | None", "bytes | None"]


def records(read: Read, at: int, end: int, head: Head) -> Iterator[Record]:
    """The records that begin in [at, end). A record cut off by the end of the file is the last."""
    while at < end:
        if not head.ng:
            fixed = read(at, 16)
            if len(fixed) < 16:
                return
            sec, frac, size, _ = struct.unpack(head.order + "4I", fixed)
            frame = sec * 1_000_000 + (frac // 1000 if head.nano else frac), head.links[0][0], read(at + 16, size)
            yield at, at + 16 + size, frame, None
            at += 16 + size
            continue
        fixed = read(at, 12)
        if len(fixed) < 12:
            return
        order = ("<" if fixed[8:12] == b"\x4d\x3c\x2b\x1a" else ">") if fixed[:4] == NG else head.order
        kind, size = struct.unpack_from(order + "2I", fixed)
        if size < 12:
            return
        frame = changes = None
        if fixed[:4] == NG or kind == 1:
            changes = read(at, size)
            head.see(changes)
        elif kind == 6 and head.links:
            body = read(at + 8, size - 12)
            who, hi, lo, cap = struct.unpack_from(order + "4I", body)
            link, ticks = head.links[who]
            frame = ((hi << 32) | lo) * 1_000_000 // ticks, link, body[20 : 20 + cap]
        yield at, at + size, frame, changes
        at += size


def _leads_on(read: Read, at: int, length: int, head: Head) -> bool:
    """Does a row of believable records begin here, or one that ends with the file?"""
    before = None
    for _ in range(CHAIN):
        if at == length:
            return before is not None
        fixed = read(at, 16)
        if head.ng:
            if len(fixed) < 12:
                return False
            kind, size = struct.unpack_from(head.order + "2I", fixed)
            if size < 12 or size % 4 or size > LONGEST_FRAME + 64 or not (1 <= kind <= 10 or fixed[:4] == NG):
                return False
            if read(at + size - 4, 4) != fixed[4:8]:
                return False
            before, at = kind, at + size
            continue
        if len(fixed) < 16:
            return False
        sec, frac, size, whole = struct.unpack(head.order + "4I", fixed)
        if frac >= (10**9 if head.nano else 10**6) or not size <= whole <= LONGEST_FRAME or (before is not None and abs(sec - before) > 86_400 * 366):
            return False
        before, at = sec, at + 16 + size
    return True


def first_record(read: Read, start: int, end: int, length: int, head: Head) -> int:
    """The first place in [start, end) where a row of records begins, else ``end``: a guess that has to be checked."""
    step = 4 if head.ng else 1
    return next((at for at in range(-(-start // step) * step, end, step) if _leads_on(read, at, length, head)), end)


def reader(content: bytes) -> Read:
    return lambda at, n: content[at : at + n]


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, frame) of a classic or next-generation capture."""
    read = reader(data)
    head, at = head_of(read)
    yield from (frame for _, _, frame, _ in records(read, at, len(data), head) if frame is not None)


def _placed(path: str) -> tuple:
    """(file system, place) of a path. The file system is that of its scheme; it has to be one that Arrow opens."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


def output(path: str):
    """A new file and its folders, open for writing."""
    system, place = _placed(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place)


class Opened:
    """A file on any file system (local, HDFS, S3, GCS), of which a few MB are held."""

    def __init__(self, path: str):
        system, place = _placed(path)
        self.file = system.open_input_file(place)
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, HELD_BYTES))
        return self.held[at - self.at : at - self.at + n]


def _ticks(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 0:
            break
        if code == 9:
            v = options[at + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10**v
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def _network(frame: bytes, link: int) -> tuple[str | None, bytes]:
    """(skip reason, network packet) below one link header; one VLAN tag is taken off."""
    if link in (RAW, RAW_ALT):
        return None, frame
    if link == NULL_LINK:
        return None, frame[4:]
    at, kind = (16, frame[14:16]) if link == COOKED else (14, frame[12:14])
    if kind == b"\x81\x00":
        kind, at = frame[at + 2 : at + 4], at + 4
        if kind in (b"\x81\x00", b"\x88\xa8"):
            return "tunnelled", b""
    if kind not in (b"\x08\x00", b"\x86\xdd"):
        return "non_ip", b""
    return None, frame[at:]


def packet(frame: bytes, link: int) -> tuple:
    """(src ip, src port, dst ip, dst port, proto, payload length, flags, skip reason).

    The payload length comes from header fields, so cut-off captures keep true lengths.
    """
    none = (None, None, None, None, None, None, None)
    try:
        skip, ip = _network(frame, link)
        if skip:
            return (*none, skip)
        version = ip[0] >> 4
        if version == 4:
            head = (ip[0] & 15) * 4
            if struct.unpack_from(">H", ip, 6)[0] & 0x1FFF:
                return (*none, "malformed")
            proto, src, dst = ip[9], ip[12:16], ip[16:20]
            size = struct.unpack_from(">H", ip, 2)[0] - head
        elif version == 6:
            head, proto, src, dst = 40, ip[6], ip[8:24], ip[24:40]
            size = struct.unpack_from(">H", ip, 4)[0]
        else:
            return (*none, "non_ip")
        if proto not in (S.TCP, S.UDP):
            return (*none, "non_tcp_udp")
        sport, dport = struct.unpack_from(">2H", ip, head)
        if proto == S.TCP:
            size -= (ip[head + 12] >> 4) * 4
            flags = ip[head + 13]
        else:
            size, flags = size - 8, 0
        if size < 0:
            return (*none, "malformed")
        return bytes(src), sport, bytes(dst), dport, proto, size, flags, None
    except (IndexError, struct.error):
        return (*none, "malformed")


_ARROW = pa.schema(
    [("path", pa.string()), ("pkt_no", pa.int64()), ("ts_us", pa.int64()), ("src_ip", pa.binary()), ("src_port", pa.int32()),
     ("dst_ip", pa.binary()), ("dst_port", pa.int32()), ("proto", pa.int32()), ("payload_len", pa.int64()),
     ("flags", pa.int32()), ("skip", pa.string())]
)


def _decoded(path: str, first: int, found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Frames numbered from ``first``, in batches."""
    rows: list[tuple] = []
    for i, (ts, link, frame) in enumerate(found, first):
        rows.append((path, i, ts, *packet(frame, link)))
        if len(rows) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def decode(captures: DataFrame) -> DataFrame:
    """One row per frame; frames that cannot be used carry a ``skip`` reason instead of fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                yield from _decoded(path.as_py(), 0, frames(content.as_py()))

    return captures.select("path", "content").mapInArrow(run, OUT)


_RANGE = "path string, length long, no int, start long, stop long"
_WALKED = f"{_RANGE}, first long, next long, n long, heads array<binary>"


def _walk(ranges: DataFrame) -> DataFrame:
    """Ranges with where their first record begins (``first``, guessed where ``due`` is null), where the record after their
    last begins, how many frames they hold, and the blocks that change the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                read = Opened(r["path"]).read
                head, at = head_of(read)
                if r["due"] is not None:
                    at = r["due"]
                elif r["no"] > 0:
                    at = first_record(read, r["start"], r["stop"], r["length"], head)
                first, n, heads = at, 0, []
                # a head is taken up in full below; here an interface that lies before the range must not end the walk
                known = Head(head.order, head.ng, head.nano, [(1, 1_000_000)] * 65536 if head.ng else head.links)
                for _, at, frame, changes in records(read, at, r["stop"], known):  # noqa: B020
                    n += frame is not None
                    if changes is not None:
                        heads.append(changes)
                        known.links = [(1, 1_000_000)] * 65536
                row = {c: r[c] for c in ("path", "length", "no", "start", "stop")} | {"first": first, "next": at, "n": n, "heads": heads}
                yield pa.RecordBatch.from_pylist([row], _walked_arrow())

    return ranges.mapInArrow(run, _WALKED)


def _walked_arrow() -> pa.Schema:
    whole = [("path", pa.string()), ("length", pa.int64()), ("no", pa.int32()), *((c, pa.int64()) for c in ("start", "stop", "first", "next", "n"))]
    return pa.schema([*whole, ("heads", pa.list_(pa.binary()))])


def _spread(ranges: DataFrame) -> DataFrame:
    """Ranges dealt over tasks by their bytes: a task takes about ``RANGE_BYTES`` one after the other, and few ranges are
    dealt over four tasks a core."""
    n, total = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(n, max(4 * cores, -(-total // RANGE_BYTES)))))


def ranges_of(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.pcap*", size: int | None = None) -> DataFrame:
    """The byte ranges of capture files, with their records joined up: one row per range of ``size`` bytes."""
    size = size or RANGE_BYTES
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "length").where("length > 0")
    numbers = F.explode(F.expr(f"sequence(0, cast((length - 1) div {size} as int))"))
    cutting = cut(files.select("path", "length", numbers.alias("no")))
    ranges = cutting.select("*", (F.col("no") * F.lit(size).cast("long")).alias("start")).withColumn("stop", F.least(F.col("start") + size, "length"))
    walked = cut(_walk(_spread(ranges).withColumn("due", F.lit(None).cast("long"))))
    by_file = W.partitionBy("path").orderBy("no")
    while True:
        due = walked.withColumn("due", F.lag("next").over(by_file)).where("due is not null and due <> first")
        due = cut(due.select("path", "length", "no", "start", "stop", "due"))
        if due.isEmpty():
            return walked
        # the first wrong guess of a file is right after this, the others at the latest after as many rounds as there are
        walked = cut(walked.join(due.select("path", "no"), ["path", "no"], "left_anti").unionByName(_walk(due.repartition("path", "no"))))


def scan(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.pcap*", size: int | None = None) -> DataFrame:
    """The rows of ``decode`` for capture files, read in ranges of ``size`` bytes."""
    before = W.partitionBy("path").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges_of(spark, paths, glob, size).select(
        "*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.flatten(F.collect_list("heads").over(before)).alias("seen")
    )
    ranges = cut(ranges.drop("heads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                read = Opened(r["path"]).read
                head, _ = head_of(read)
                for block in r["seen"]:
                    head.see(block)
                found = (frame for _, _, frame, _ in records(read, r["first"], r["stop"], head) if frame is not None)
                yield from _decoded(r["path"], r["base"], found)

    return _spread(ranges.where("n > 0")).mapInArrow(run, OUT)


def usable(decoded: DataFrame) -> DataFrame:
    """Packets with endpoints as sortable structs, ready for ``bidirectional_key``."""
    return decoded.where("skip is null").select(
        "path", F.col("pkt_no").alias("pkt_id"), "ts_us",
        F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")).alias("src"),
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("dst"),
        "proto", "payload_len", "flags",
    )


def skip_counts(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("path").agg(
        F.count("*").alias("frames"), *[F.count(F.when(F.col("skip") == s, 1)).alias(s) for s in SKIPS]
    )


def encode(packets: DataFrame, file: Column) -> DataFrame:
    """Packets written as classic Ethernet captures (to make test captures).

    Needs ts_us, pkt_id, src_ip, src_port, dst_ip, dst_port (IPv4), payload_len, flags; the payload
    itself is not stored, only its length. A file's packets are one group, so ``file`` has to cut
    the packets into files of a bounded number.
    """
    rows = packets.withColumn("path", file)

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by([("ts_us", "ascending"), ("pkt_id", "ascending")])
        out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, ETHERNET)]
        for r in part.to_pylist():
            tcp = struct.pack(">HHIIBBHHH", r["src_port"], r["dst_port"], 0, 0, 5 << 4, r["flags"], 0, 0, 0)
            ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, min(40 + r["payload_len"], 65535), 0, 0, 64, 6, 0, r["src_ip"], r["dst_ip"])
            frame = b"\0" * 12 + b"\x08\x00" + ip + tcp
            out.append(struct.pack("<IIII", r["ts_us"] // 1_000_000, r["ts_us"] % 1_000_000, len(frame), len(frame)))
            out.append(frame)
        return pa.table({"path": [part.column("path")[0].as_py()], "content": [b"".join(out)]})

    return rows.groupBy("path").applyInArrow(write, "path string, content binary")


# --- labels ---------------------------------------------------------------------------------------


def labelled(files: DataFrame, labels: DataFrame, pattern: str | None = None) -> DataFrame:
    """Files with a non-empty class; ``session_id`` numbers them in name order, 0-based."""
    from flowtide.operators.ordered import global_row_number

    ok = labels.where(F.trim(F.coalesce("class_name", F.lit(""))) != "")
    rows = files.join(ok, "file_name")
    if pattern is not None:
        rows = rows.where(F.col("file_name").rlike(pattern))
    names = global_row_number(rows.select("file_name").distinct(), ["file_name"], "_rn")
    return rows.join(names.select("file_name", (F.col("_rn") - 1).cast("int").alias("session_id")), "file_name")


def unlabelled(files: DataFrame, labels: DataFrame) -> DataFrame:
    ok = labels.where(F.trim(F.coalesce("class_name", F.lit(""))) != "").select("file_name")
    return files.join(ok, "file_name", "left_anti")


# fixed values: words in a capture's name and what they mean
SEVERAL_ACTIVITIES = [("skype", "skype"), ("facebook", "facebook"), ("hangout", "hangouts")]
ONE_ACTIVITY = [
    ("file_transfer", ["ftps", "sftp", "scp"]),
    ("streaming", ["youtube", "vimeo", "netflix", "spotify"]),
    ("mail", ["email", "gmail"]),
    ("chat", ["icq", "aim"]),
    ("voip", ["voipbuster"]),
    ("browsing", ["firefox", "chrome"]),
]
PEER_WORDS = ["torrent", "p2p"]
CALL_WORDS = ["audio", "voip", "call", "video"]


def name_labels(file_name: Column) -> Column:
    """Struct (app, category, condition, class_name) read off a capture's name; NULL where unclear."""
    stem = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    has = lambda w: F.instr(stem, w) > 0
    any_of = lambda ws: F.greatest(*[has(w) for w in ws]) if len(ws) > 1 else has(ws[0])
    condition = F.when(has("vpn"), F.lit("vpn")).otherwise(F.lit("nonvpn"))
    null = F.lit(None).cast("string")
    app, category = null, null
    for word in reversed(PEER_WORDS):
        app, category = F.when(has(word), F.lit("torrent")).otherwise(app), F.when(has(word), F.lit("p2p")).otherwise(category)
    for cat, words in reversed(ONE_ACTIVITY):
        for word in reversed(words):
            app = F.when(has(word), F.lit(word)).otherwise(app)
            category = F.when(has(word), F.lit(cat)).otherwise(category)
    for word, canonical in reversed(SEVERAL_ACTIVITIES):
        activity = F.when(has("chat"), F.lit("chat"))
        if canonical == "skype":
            activity = activity.when(has("file"), F.lit("file_transfer"))
        activity = activity.when(any_of(CALL_WORDS), F.lit("voip"))
        app = F.when(has(word), F.lit(canonical)).otherwise(app)
        category = F.when(has(word), activity).otherwise(category)
    return F.struct(
        app.alias("app"), category.alias("category"), condition.alias("condition"),
        F.when(category.isNotNull(), F.concat(category, F.lit("_"), condition)).alias("class_name"),
    )
