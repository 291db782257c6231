"""Part of tabulon: plans."""
