"""Physical building blocks shared by the operators: range shards, size-checked lookups, materialisation."""
