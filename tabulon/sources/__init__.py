"""Part of tabulon: sources."""
