"""A synthetic survey: serpentine lines over buried targets, five frequencies, noise, drift and flagged readings."""

from __future__ import annotations

import numpy as np
import pandas as pd

FREQUENCIES = (475, 1525, 5325, 18325, 63025)


def survey(lines: int = 7, length: float = 20.0, step: float = 0.25, apart: float = 1.0, seed: int = 42) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    y = np.arange(0, length + step / 2, step)
    out = []
    for k in range(lines):
        yy = y if k % 2 == 0 else y[::-1]
        out.append(pd.DataFrame({"Line": k, "Sample": np.arange(len(y)), "X": k * apart, "Y": yy}))
    df = pd.concat(out, ignore_index=True)
    n = len(df)
    df["Time[ms]"] = 36_000_000 + 100 * np.arange(n)
    df["Mark"] = df["Sample"] // 20
    df["Status"] = np.where(r.random(n) < 0.01, 3, 0)
    df["PowerLn"] = r.normal(1, 0.1, n)
    bump = sum(a * np.exp(-((df["X"] - x0) ** 2 + (df["Y"] - y0) ** 2) / 2 / s**2) for a, x0, y0, s in ((12, 2, 6, 1.0), (8, 4.5, 14, 1.5)))
    for j, f in enumerate(FREQUENCIES):
        noise = (3.0, 1.0, 0.4, 0.2, 0.3)[j]
        df[f"EC{f}Hz[mS/m]"] = 20 + bump + np.arange(n) * 2e-4 + r.normal(0, noise, n)
        df[f"MSusc{f}Hz[1/1000]"] = 0.5 + bump / 50 + r.normal(0, 0.02, n)
        df[f"Ip_{f}Hz"], df[f"Qd_{f}Hz"] = r.normal(10, 1, n), 50 + 4 * bump + r.normal(0, 1, n)
    return df
