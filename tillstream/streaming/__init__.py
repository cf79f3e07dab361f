"""Incremental versions of the hourly mart, the drift monitor and the early-stop alert."""
