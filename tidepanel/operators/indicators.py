"""Indicators that depend on all earlier rows of a series: exponential averages and what is made of them, and the trend filter."""

from __future__ import annotations

from .scans import ema_macd_rsi, kalman_trend

__all__ = ["ema_macd_rsi", "kalman_trend"]
