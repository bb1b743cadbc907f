"""readrouter: sequencer base-call runs to per-sample reads, as Spark DataFrames."""
