"""The flow stream hands over groups of keys: each key keeps its own open flow."""

import pandas as pd
import pytest

from flowtide.bindings import Timeouts
from flowtide.streaming import flows as SF


class _Map(dict):
    """A map state in memory."""

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.pop(key, None)


class _Handle:
    def __init__(self) -> None:
        self.maps: dict[str, _Map] = {}

    def getMapState(self, name, key, value):  # noqa: N802
        return self.maps.setdefault(name, _Map())


def _rows(packets):
    names = ["flow_key", "ts_us", "pkt_id", "side", "proto", "payload_len", "flags"]
    return pd.DataFrame(packets, columns=names)


@pytest.mark.parametrize("held", [100, 2])
def test_keys_of_a_group_do_not_mix(held) -> None:
    p = SF.FlowProcessor(Timeouts(idle_us=100, active_us=None, linger_us=None), False, held, 1)
    handle = _Handle()
    p.init(handle)
    first = [(1, 0, 10, 0, 6, 5, 0), (2, 5, 20, 1, 6, 7, 0), (1, 50, 11, 1, 6, 5, 0), (2, 200, 21, 0, 6, 9, 0)]
    out = pd.concat(p.handleInputRows((7,), iter([_rows(first)]), None))
    assert out[["flow_key", "flow_id", "packets", "end_reason"]].values.tolist() == [[2, 20, 1, "idle"]]
    assert set(handle.maps["open"]) == {(1,), (2,)} and not handle.maps["runs"]
    end = [(k, 210, 2**62, 0, SF.FLUSH, 0, 0) for k in (1, 2)]
    out = pd.concat(p.handleInputRows((7,), iter([_rows(end)]), None))
    assert out[["flow_key", "flow_id", "packets", "packets_rev", "end_reason"]].values.tolist() == [[1, 10, 1, 1, "idle"], [2, 21, 1, 0, "eof"]]
    assert not handle.maps["open"]


def test_a_packet_without_a_key_raises() -> None:
    p = SF.FlowProcessor(Timeouts(), False)
    p.init(_Handle())
    with pytest.raises(TypeError):
        list(p.handleInputRows((7,), iter([_rows([(None, 0, 1, 0, 6, 5, 0)])]), None))
