"""Reports on finished crosswalks. Every function returns lazy DataFrames."""
