"""Sources and the log of what was taken from them."""
