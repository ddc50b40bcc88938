"""Part of fieldtrace."""
