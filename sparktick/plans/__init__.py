"""Multi-step plans: walk-forward backtest, tuning, analysis reports."""
