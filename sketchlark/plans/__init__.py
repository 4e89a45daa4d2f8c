"""What several operators are planned with: shared tables, running sums, column names."""
