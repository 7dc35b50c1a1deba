"""Record linkage on Spark: normalise, block, compare, score and decide, each step a DataFrame plan."""
