"""Reading page snapshots and reading and writing the notice table."""
