"""Archives of tiled map data as DataFrames: scans, merges, grids, profiles, pyramids and live ingestion."""
