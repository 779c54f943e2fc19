"""Multi-step plans and the queries the driver runs."""
