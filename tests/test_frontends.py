"""Front ends on a synthetic case: every one runs, and the good ones improve it."""

import numpy as np
import pytest

from roomlake.functions import frontends, spectral
from roomlake.operators import arrays

FS = 8000


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(0)
    n = 12000
    dry, other = (np.convolve(rng.standard_normal(n) * (1 + np.sin(np.arange(n) / 900 * k)), [1, 0.6, 0.2])[:n] for k in (1, 1.7))
    late = np.concatenate([np.zeros(400), rng.standard_normal(900) * np.exp(-np.arange(900) / 250) * 0.05])
    wet = dry + np.convolve(dry, late)[:n]
    target = np.stack([np.roll(wet, 2 * k) for k in range(4)])
    noise = np.stack([np.roll(other, -3 * k) for k in range(4)]) * 0.7
    sensor = rng.standard_normal((4, n)) * 0.01
    return {"target": target, "noise": noise + sensor, "mixture": target + noise + sensor, "sensor": sensor}, [2 * k / FS for k in range(4)], dry


def test_front_ends(case):
    parts, arrivals, dry = case
    rows = {r["pipeline"]: r for r in frontends.compare(frontends.FRONT_ENDS, parts, arrivals, dry, FS, n_fft=256)}
    assert set(rows) == set(frontends.FRONT_ENDS) and abs(rows["single_raw"]["gain_snr_db"]) < 1e-9
    for name in ("local_ds", "local_mvdr", "local_mwf", "distributed_weighted_ds", "distributed_mvdr"):
        assert rows[name]["gain_snr_db"] > 1, name
    assert rows["local_mvdr"]["gain_snr_db"] > rows["local_ds"]["gain_snr_db"]
    assert all(np.isfinite(v) for r in rows.values() for k, v in r.items() if k.endswith("_db"))
    with pytest.raises(ValueError, match="no front end"):
        frontends.process("local_magic", parts, arrivals, FS)


def test_filters_of_one_recording_serve_another(case):
    parts, _, _ = case
    filters = spectral.prediction_filters(parts["mixture"], n_fft=256, taps=4)
    both = [spectral.without_prediction(parts[k], filters, n_fft=256, taps=4) for k in ("target", "noise")]
    assert np.allclose(sum(both), spectral.without_prediction(parts["mixture"], filters, n_fft=256, taps=4), atol=1e-9)


def test_front_ends_of_cases(spark, case):
    parts, arrivals, dry = case
    rows = [(k, c, arrivals[c], *[parts[p][c, :4000].tolist() for p in ("target", "noise", "mixture", "sensor")], dry[:4000].tolist()) for k in (1, 2) for c in range(4)]
    df = spark.createDataFrame(rows, "case_id long, channel int, arrival double, target array<double>, noise array<double>, mixture array<double>, sensor array<double>, dry array<double>")
    got = arrays.front_ends(df, ["case_id"], ["single_raw", "local_mvdr"], fs=FS, n_fft=256).collect()
    assert {(r.case_id, r.pipeline) for r in got} == {(k, p) for k in (1, 2) for p in ("single_raw", "local_mvdr")}
    assert all(r.gain_snr_db > 1 for r in got if r.pipeline == "local_mvdr") and all(r.output_stoi is None for r in got)
