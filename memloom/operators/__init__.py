"""Set-valued operators: each takes and returns DataFrames over many queries or scopes."""
