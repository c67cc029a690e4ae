"""Writers for other formats."""
