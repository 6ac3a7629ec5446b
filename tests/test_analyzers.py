"""Registry, selection, presets and the one pass of analyzers."""

import numpy as np
import pytest

from glyphmill.operators.analyzers import PRESETS, Analyzer, Config, Registry, default_registry, inventory, run, select


def registry():
    # local functions travel to workers by value
    def mean(rgb):
        return {"mean": rgb.mean(), "odd": float("nan")}

    def broken(rgb):
        raise ValueError("no")

    return Registry([Analyzer("late", "L1", mean, ("planes",)), Analyzer("mean", "L0", mean, provides=("planes",), confidence=0.5), Analyzer("paid", "L0", mean, licence="paid"), Analyzer("broken", "L2", broken), Analyzer("blind", "L0", mean, ("depth",))])


def test_selection():
    r = registry()
    assert [a.name for a in select(r, Config())] == ["mean", "late", "broken"]
    assert [a.name for a in select(r, PRESETS["proximal"])] == ["mean"]
    assert [a.name for a in select(r, Config.from_mapping({"licences": ["permissive", "paid"], "names": ["paid"], "unknown": 1}))] == ["paid"]
    assert Config().fingerprint() == Config().fingerprint() != PRESETS["structural"].fingerprint()
    with pytest.raises(ValueError, match="already"):
        r.register(Analyzer("mean", "L0", len))
    with pytest.raises(ValueError, match="tier"):
        r.register(Analyzer("x", "L9", len))


def test_one_pass(spark):
    data = np.full((2, 2, 3), 7, np.uint8).tobytes()
    images = spark.createDataFrame([(1, 2, 2, 3, bytearray(data))], "id long, height int, width int, nChannels int, data binary")
    got = {(r.key, r.value, r.analyzer, r.tier, r.confidence, r.error) for r in run(images, select(registry(), Config())).collect()}
    assert got == {("mean.mean", 7.0, "mean", "L0", 0.5, None), ("late.mean", 7.0, "late", "L1", 1.0, None), ("broken", None, "broken", "L2", 1.0, "ValueError: no")}
    assert run(images, []).count() == 0
    assert {r.tier: r.n for r in inventory(registry(), spark).collect()} == {"L0": 3, "L1": 1, "L2": 1}
    assert len(select(default_registry(), Config())) == len(default_registry().known)
