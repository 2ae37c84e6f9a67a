"""Sources: the stand-in portfolio (and its SQL twin), inline lookups, file readers and writers."""
