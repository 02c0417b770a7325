"""Everything that is settled on the driver before a DataFrame is built: rewrites, covers and join plans."""
