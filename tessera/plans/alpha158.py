"""A library of 158 price and volume features, built from a rule, and its label."""

from __future__ import annotations

WINDOWS = (5, 10, 20, 30, 60)
LABEL = "delay(close, -3) / delay(close, -1) - 1"


def features(windows=WINDOWS) -> dict[str, str]:
    """Name to formula: nine candle shapes, four prices over the close, and 29 rolling families for each window."""
    top, bottom, span = "greater(open, close)", "less(open, close)", "(high - low + 1e-12)"
    shapes = {"kmid": "close - open", "klen": "high - low", "kup": f"high - {top}", "klow": f"{bottom} - low", "ksft": "2 * close - high - low"}
    out = {name: f"({shape}) / open" for name, shape in shapes.items()}
    out |= {f"{name}_2": f"({shape}) / {span}" for name, shape in shapes.items() if name != "klen"}
    out |= {f"{field}_0": f"{field} / close" for field in ("open", "high", "low", "vwap")}

    def moves(x: str, w: int, prefix: str) -> dict[str, str]:
        step = f"({x} - delay({x}, 1))"
        gain, loss, base = f"sum(greater({step}, 0), {w})", f"sum(greater(delay({x}, 1) - {x}, 0), {w})", f"(sum(abs({step}), {w}) + 1e-12)"
        return {f"{prefix}p_{w}": f"{gain} / {base}", f"{prefix}n_{w}": f"{loss} / {base}", f"{prefix}d_{w}": f"({gain} - {loss}) / {base}"}

    for w in windows:
        high, low = f"max(high, {w})", f"min(low, {w})"
        ups, downs = f"mean(close > delay(close, 1), {w})", f"mean(close < delay(close, 1), {w})"
        churn = "abs(close / delay(close, 1) - 1) * volume"
        out |= {
            f"roc_{w}": f"delay(close, {w}) / close", f"ma_{w}": f"mean(close, {w}) / close", f"std_{w}": f"std(close, {w}) / close",
            f"beta_{w}": f"ts_slope(close, {w}) / close", f"rsqr_{w}": f"ts_rsquare(close, {w})", f"resi_{w}": f"ts_resi(close, {w}) / close",
            f"max_{w}": f"{high} / close", f"min_{w}": f"{low} / close",
            f"qtlu_{w}": f"ts_quantile(close, {w}, 0.8) / close", f"qtld_{w}": f"ts_quantile(close, {w}, 0.2) / close",
            f"rank_{w}": f"ts_rank(close, {w})", f"rsv_{w}": f"(close - {low}) / ({high} - {low} + 1e-12)",
            f"imax_{w}": f"argmax(high, {w}) / {w}", f"imin_{w}": f"argmin(low, {w}) / {w}", f"imxd_{w}": f"(argmax(high, {w}) - argmin(low, {w})) / {w}",
            f"corr_{w}": f"corr(close, log(volume + 1), {w})", f"cord_{w}": f"corr(close / delay(close, 1), log(volume / delay(volume, 1) + 1), {w})",
            f"cntp_{w}": ups, f"cntn_{w}": downs, f"cntd_{w}": f"{ups} - {downs}",
            **moves("close", w, "sum"),
            f"vma_{w}": f"mean(volume, {w}) / (volume + 1e-12)", f"vstd_{w}": f"std(volume, {w}) / (volume + 1e-12)",
            f"wvma_{w}": f"std({churn}, {w}) / (mean({churn}, {w}) + 1e-12)",
            **moves("volume", w, "vsum"),
        }
    return out
