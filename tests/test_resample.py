import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import resample, stencils


def forward(signal, chain):
    """The chain run forwards over a signal whose edges repeat, stage by stage, on long stretches instead of clamped places."""
    n, ahead = len(signal), 4000
    x = np.concatenate([np.full(ahead, signal[0]), signal, np.full(ahead, signal[-1])])  # index 0 is at `ahead`

    def filtered(x, taps):
        return np.convolve(x, taps[::-1], mode="same")

    origin, length = ahead, n
    if chain.first:
        x = filtered(x, chain.correction)
    for taps in chain.halvings:
        y = filtered(x, taps)
        low = origin % 16
        x, origin, length = y[low::16], origin // 16, -(-length // 16)
        x[: origin - 3], x[origin + length + 3 :] = x[origin - 3], x[origin + length + 2]
    step, offset = chain.step / 16 ** len(chain.halvings), chain.offset / 16 ** len(chain.halvings)
    if chain.doubles:
        wide = np.zeros(2 * len(x))
        wide[::2] = x
        x, origin, step, offset = wide, 2 * origin, 2 * step, 2 * offset
    out = []
    for i in range(chain.wanted):
        at = offset + step * i
        whole = int(np.floor(at))
        first, taps = chain.fractional(int((at - whole) * resample.PHASES))
        out.append(x[origin + whole + first : origin + whole + first + len(taps)] @ taps)
    out = np.array(out)
    if not chain.first:
        half = len(chain.correction) // 2
        out = filtered(np.concatenate([np.full(half, out[0]), out, np.full(half, out[-1])]), chain.correction)[half:-half]
    return out


@pytest.mark.parametrize("size,wanted", [(40, 9), (40, 29), (40, 40), (40, 90), (900, 20), (1, 4), (7, 1), (2, 3)])
@pytest.mark.parametrize("preset", ["default", "ultra", "ulr"])
def test_matrix_is_the_chain_run_forwards(size, wanted, preset):
    chain = resample.Chain(size, wanted, preset)
    signal = np.random.default_rng(size).random(size)
    matrix = np.zeros((wanted, size))
    for t, s, w in resample.weights(preset, size, wanted):
        matrix[t, s] = w
    assert np.allclose(matrix @ signal, forward(signal, chain), atol=2e-6)
    assert np.allclose(matrix.sum(axis=1), 1, atol=5e-4)
    assert bool(chain.halvings) == (size == 900)


def test_filters():
    assert resample.PHASES == 606
    taps = resample.low_pass(10.5, 1.2, 2.0, 3.0)
    assert len(taps) == 21 and np.allclose(taps, taps[::-1]) and abs(taps.sum() - 3) < 1e-12
    short = resample.trimmed(np.array([1e-6, 1e-3, 1, 1e-3, 1e-6]), 2.0)
    assert len(short) == 3 and abs(short.sum() - 2) < 1e-12
    flat = resample.equaliser(np.ones(65), 6.3077, 1.0)  # a flat response is a single tap
    assert np.allclose(flat, [0, 0, 0, 1, 0, 0, 0], atol=1e-12)
    x = np.linspace(0, np.pi, 50)
    assert np.allclose(resample.response(np.array([0.25, 0.5, 0.25]), x), 0.5 + 0.5 * np.cos(x))


def test_correction_flattens_the_band():
    """With the correction, low frequencies pass nearly unchanged."""
    chain = resample.Chain(64, 200)
    low = np.linspace(0, 0.5 * np.pi, 20)
    whole = resample.response(chain.correction, low) * resample.response(chain.fractional(0)[1], low / 2) / 2
    assert np.abs(whole - 1).max() < 0.06 < np.abs(resample.response(chain.fractional(0)[1], low / 2) / 2 - 1).max()


@pytest.mark.parametrize("size,wanted", [(16, 7), (16, 24)])
def test_constants_stay(spark, size, wanted):
    rows = [(1, x, y, 200, 10, 255, 0) for x in range(size) for y in range(5)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    got = resample.designed_resize(df, wanted, 3).collect()
    assert len(got) == wanted * 3 and {(r["r"], r["g"], r["b"], r["a"]) for r in got} == {(200, 10, 255, 0)}


def test_dispatch(spark):
    rows = [(1, x, y, 10 * x, 10 * y, 5, 255) for x in range(6) for y in range(4)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    for method in ("point", "bilinear", "lanczos", "designed"):
        assert resample.resized(df, 3, 5, method).count() == 15
    assert resample.resized(df, 3, 5, "designed").schema == stencils.resize(df, 3, 5).schema
    corner = {(r["x"], r["y"]): (r["r"], r["g"]) for r in resample.repositioned(df, 2, 2, 8).collect()}
    assert corner == {(0, 0): (40, 20), (1, 0): (50, 20), (0, 1): (40, 30), (1, 1): (50, 30)}
    for bad in ((0, 1, "point"), (1, 0, "designed")):
        with pytest.raises(ValueError):
            resample.resized(df, *bad)
    with pytest.raises(ValueError):
        resample.repositioned(df, 1, 1, 9)


def test_presets_go_in_one_pass(spark, monkeypatch):
    """As one by one; each axis deals the pixels out once for all presets, to more tasks when there are more pixels."""
    df = spark.createDataFrame([(i, x, y, 9 * x, 11 * y, (x * y) % 256, 255) for i in (1, 2) for x in range(20) for y in range(17)], "image_id long, x int, y int, r int, g int, b int, a int")
    monkeypatch.setattr(stencils, "TASK_PIXELS", 68)
    every = resample.designed_resizes(df, 7, 9, ["default", "ultra"])
    for preset in ("default", "ultra"):
        alone = resample.designed_resize(df, 7, 9, preset)
        assert sorted(every.where(F.col("preset") == preset).drop("preset").collect()) == sorted(alone.collect())
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("RepartitionByExpression") == 2 and plan.count(", 10\n") == 2
