"""Front ends from many microphones to one signal, and how good they are.

A front end is named by its microphones and its stages: ``local_wpe_mvdr`` takes
the late part off and then beamforms the microphones of one device. Weights come
from a calibration stretch and go over target, noise and mixture alike, so that
the ratio of what is left of each can be told.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from roomlake.functions import spectral as s

#: The front ends that are compared.
FRONT_ENDS = (
    "single_raw", "single_wiener", "local_ds", "local_mvdr", "local_mwf", "local_wpe_mvdr", "local_wpe_mwf", "local_wpd",
    "distributed_weighted_ds", "distributed_mvdr", "distributed_mwf", "distributed_wpe_mvdr", "distributed_wpe_mwf", "distributed_wpd",
)
PARTS = ("target", "noise", "mixture")
#: Frames of the past that predict the late part, for one device and for several; the most a signal may be late (s), and the start that isn't judged (s, part).
TAPS_LOCAL, TAPS_APART, LATE, SETTLE, SETTLE_PART = 5, 10, 0.35, 0.15, 4


def calibration(n: int, fs: float) -> slice:
    """The stretch at the start that weights come from: half of the signal."""
    return slice(0, max(1, n // 2))


def evaluation(n: int, fs: float) -> slice:
    return slice(min(round(SETTLE * fs), max(n // SETTLE_PART, 1)), n)


def _apart(parts: Mapping[str, np.ndarray], arrivals, fs: float, n_fft: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Channels of devices that stand apart, brought to one time."""
    return {k: s.align(v, arrivals, fs) for k, v in parts.items()}, np.zeros(len(arrivals))


def process(name: str, parts: Mapping[str, np.ndarray], arrivals: Sequence[float], fs: float, *, n_fft: int = 512) -> dict[str, np.ndarray]:
    """One signal for each of target, noise and mixture ([channel, sample] each; sensor noise as "sensor")."""
    if name not in FRONT_ENDS:
        raise ValueError(f"no front end {name!r}; there are {', '.join(FRONT_ENDS)}")
    scope, *stages = name.split("_")
    parts = {k: s.channels(parts[k]) for k in (*PARTS, "sensor")}
    span = calibration(parts["target"].shape[1], fs)
    heard = lambda p: (p["target"][:, span] + p["sensor"][:, span], p["noise"][:, span])
    target, noise = heard(parts)
    level = lambda x: np.sqrt((x**2).mean(1))
    reliability = level(target) / np.maximum(level(noise), s.TINY)
    best = int(reliability.argmax())
    if scope == "single":
        one = {k: parts[k][best] for k in PARTS}
        if stages == ["raw"]:
            return one
        gain = s.wiener_gain(one["mixture"], noise[best], n_fft)
        return {k: s.apply_gain(x, gain, n_fft) for k, x in one.items()}
    if stages == ["wpd"]:
        if scope == "distributed":
            parts, arrivals = _apart(parts, arrivals, fs, n_fft)
            target, noise = heard(parts)
        weights = s.distortionless_weights(np.concatenate([target, noise], axis=1), arrivals, fs, n_fft=n_fft)
        return {k: s.apply_distortionless(parts[k], weights, n_fft=n_fft) for k in PARTS}
    if stages[0] == "wpe":
        taps = TAPS_APART if scope == "distributed" else TAPS_LOCAL
        groups = [[c] for c in range(len(target))] if scope == "distributed" else [list(range(len(target)))]  # devices apart predict their own past only
        filters = [s.prediction_filters(parts["mixture"][g], n_fft=n_fft, taps=taps) for g in groups]
        dry = lambda x: np.vstack([s.without_prediction(x[g], f, n_fft=n_fft, taps=taps) for g, f in zip(groups, filters)])
        parts, target, noise = {k: dry(parts[k]) for k in PARTS}, dry(target), dry(noise)
        stages = stages[1:]
    vector, kind = s.steering(arrivals, fs, n_fft), "_".join(stages)
    if kind == "weighted_ds":
        weights = s.weighted_steering(vector, reliability)
    else:
        # the multichannel filter aims at the first channel: the most reliable one goes there
        order = np.argsort(np.arange(len(target)) != best, kind="stable")
        covariances = (s.covariance(s.stft(x[order], n_fft)) for x in (target, noise))
        weights = np.empty_like(vector)
        weights[:, order] = s.beamformer(kind, vector[:, order], *covariances)
    return {k: s.apply_weights(parts[k], weights, n_fft) for k in PARTS}


def stoi(estimate, reference, fs: float) -> float | None:
    """Intelligibility, where the package for it is installed."""
    try:
        from pystoi import stoi as measure
    except ImportError:
        return None
    return float(measure(np.asarray(reference), np.asarray(estimate), int(fs), extended=False))


def pesq(estimate, reference, fs: float) -> float | None:
    """Perceived quality at 8 or 16 kHz of a quarter of a second and more, where the package for it is installed."""
    try:
        from pesq import pesq as measure
    except ImportError:
        return None
    if fs not in (8000, 16000) or len(estimate) < 0.25 * fs:
        return None
    return float(measure(int(fs), np.asarray(reference), np.asarray(estimate), "wb" if fs == 16000 else "nb"))


def quality(out: Mapping[str, np.ndarray], wet, dry, fs: float) -> dict[str, float | None]:
    """Ratios and scores of a front end's output against the target as heard (wet) and as spoken (dry)."""
    span = evaluation(len(out["mixture"]), fs)
    power = lambda x: max(float((np.asarray(x)[span] ** 2).mean()), 1e-20)
    found: dict[str, float | None] = {"snr_db": 10 * np.log10(power(out["target"]) / power(out["noise"]))}
    for prefix, reference in (("", wet), ("dry_", dry)):
        estimate, truth, _ = s.align_pair(np.asarray(out["mixture"])[span], np.asarray(reference)[span], int(LATE * fs))
        found |= {f"{prefix}si_sdr_db": s.si_sdr(estimate, truth), f"{prefix}stoi": stoi(estimate, truth, fs), f"{prefix}pesq": pesq(estimate, truth, fs)}
    return found


def compare(names: Sequence[str], parts: Mapping[str, np.ndarray], arrivals: Sequence[float], dry, fs: float, *, n_fft: int = 512) -> list[dict]:
    """For each front end its measures and what it improved on the most reliable microphone."""
    raw = process("single_raw", parts, arrivals, fs, n_fft=n_fft)
    before = quality(raw, raw["target"], dry, fs)
    rows = []
    for name in names:
        after = quality(process(name, parts, arrivals, fs, n_fft=n_fft), raw["target"], dry, fs)
        rows.append({"pipeline": name, **{f"input_{k}": before[k] for k in ("snr_db", "si_sdr_db")}, **{f"output_{k}": v for k, v in after.items()}, **{f"gain_{k}": after[k] - before[k] for k in ("snr_db", "si_sdr_db")}})
    return rows
