"""Entity resolution and text retrieval over DataFrames."""
