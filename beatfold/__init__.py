"""Population-scale analysis of long-term heart-rhythm monitoring on Spark."""
