"""Files and formats."""
