"""Fixed values and table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------
K_MAX = 30
IPT_MAX = 32767
SIZE_MAX = 1500

FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
FLAG_BITS = {"SYN": SYN, "FIN": FIN, "RST": RST, "PSH": PSH, "ACK": ACK, "URG": URG}
TCP, UDP = 6, 17

SIZE_EDGES = [16, 32, 64, 128, 256, 512, 1024]
IPT_EDGES = [1, 4, 16, 64, 256, 1024, 4096]
N_BINS = 8

SIZE_TOKENS = 64
IPT_TOKENS = 32

K_GRID = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30]

COMMIT, REJECT, FORCED_COMMIT, FORCED_REJECT = 0, 1, 2, 3
DECISIONS = {0: "commit", 1: "reject", 2: "forced_commit", 3: "forced_reject"}
UNKNOWN = -1

BASE_STATS = [
    "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV",
    "DURATION", "PPI_LEN", "PPI_DURATION", "PPI_ROUNDTRIPS",
]
HIST_BLOCKS = ["PSIZE_HIST", "PSIZE_HIST_REV", "IPT_HIST", "IPT_HIST_REV"]
HIST_STATS = [f"{b}_{i}" for b in HIST_BLOCKS for i in range(N_BINS)]
FLAG_STATS = [f"FLAG_{f}" for f in FLAG_BITS]
FLOWSTATS = BASE_STATS + HIST_STATS + FLAG_STATS

CHANNELS = ["size_dir", "log_ipt", "dir", "push"]

DRIFT_SIGNALS = [
    "mean_k", "commit_rate", "reject_rate", "mean_safe_at_commit", "mean_pkt_nll", "prior_kl",
]
CONTROLLED_SIGNALS = [
    "reject_rate", "mean_safe_at_commit", "mean_pkt_nll", "prior_kl", "theta_commit",
]

# --- table schemas ------------------------------------------------------------------
PPI = T.ArrayType(
    T.StructType(
        [
            T.StructField("ipt", T.IntegerType()),
            T.StructField("dir", T.IntegerType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("push", T.IntegerType()),
        ]
    )
)

PACKETS = T.StructType(
    [
        T.StructField("flow_key", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("pkt_id", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("payload_len", T.LongType()),
        T.StructField("flags", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
