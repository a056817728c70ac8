"""Part of the pagewright engine."""
