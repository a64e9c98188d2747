"""Plan-level building blocks shared by the operators: lineage cuts, skew-safe joins, prefix sums, components."""
