"""Multi-step plans: feature chains, splits, metrics, models, forecasts, explanations."""
