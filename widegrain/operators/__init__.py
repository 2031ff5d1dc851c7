"""DataFrame builders of the wide tables; none of them triggers a Spark action."""
