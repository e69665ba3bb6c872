"""The dialect, nested-query plans, the cost model and metrics."""
