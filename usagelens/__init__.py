"""Usage, cost and burn-rate analytics over coding-agent logs, on Spark."""
