"""Graph, spatial, packing and time-line operators over DataFrames."""
