"""Plans that span several operators: iteration, staged rebuilds, query registry."""
