"""Parameters of the panel operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    days: int = 252
    horizons: tuple[int, ...] = (1, 5, 21, 63)
    windows: tuple[int, ...] = (21, 63, 126, 252)
    lags: tuple[int, ...] = (1, 5, 21)
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    crossover: tuple[int, int] = (50, 200)
    ewma_halflife: int = 63
    cv: tuple[int, int, int, int] = (5, 756, 63, 5)  # folds, first train rows, test rows, gap
    walk: tuple[int, int, int, int] = (756, 21, 21, 5)  # train, test, step, gap
    max_weight: float = 0.40
    max_turnover: float = 0.50
    max_class: float = 0.70
    rebalance: int = 21
    lookback: int = 252
    offset: int = 756
    cost_bps: float = 10.0
    risk_free: float = 0.0
    chunk: tuple[int, int] = (500, 50)


DEFAULT = Config()
