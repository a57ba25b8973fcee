"""Plan-level helpers: lineage, sizes, loops."""
