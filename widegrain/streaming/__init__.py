"""Wide tables are full rebuilds; there are no streaming operators to provide."""
